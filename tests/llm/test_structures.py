"""Operators 11 to 13: Merkle manifest, main text of pages, prefix trie, and the ranks that two of them use."""

from __future__ import annotations

import hashlib
import random
import string
import time
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from metaloom.llm import html_text, merkle, prefix_trie, queries
from metaloom.llm.ranges import running
from metaloom.session import checkpoint_dir, release

DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, rank long, digest string, above string, root string, lo long, bucket long"
TURNS = "conv_id long, turn long, role string, text string, pos long, depth long, key string, path string, rank long, bound int, a long"


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


# Ranks and running sums


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_ranks_go_on_over_partitions(spark, partitions):
    rng = random.Random(partitions)
    rows = [(rng.choice([None, "hot", "hot", "hot", "a", "z"]), rng.choice([None, *range(40)]), rng.randrange(100)) for _ in range(400)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = running(spark.createDataFrame(rows, "k string, o long, v long"), ["k"], ["o", "v"], ["v"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    low = lambda x: (x is not None, x or 0)
    groups = defaultdict(list)
    for k, o, v in rows:
        groups[k].append((o, v))
    want = []
    for k, items in groups.items():
        total = 0
        for i, (o, v) in enumerate(sorted(items, key=lambda x: (low(x[0]), x[1])), 1):
            total += v
            want.append((k, o, v, i, total))
    order = lambda r: (r[0] is not None, r[0] or "", r[3])
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


def test_ranks_without_keys_or_rows(spark):
    df = spark.createDataFrame([(3,), (1,), (2,)], "x int")
    assert sorted(tuple(r) for r in running(df, [], ["x"]).collect()) == [(1, 1), (2, 2), (3, 3)]
    assert running(df.filter("x > 9"), [], ["x"], ["x"]).collect() == []


# Merkle manifest


def hashed(rows: list[tuple]) -> list[tuple]:
    """Brute force over (doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root, proof, folded root, verified."""

    def leaf(values):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def climb(level):
        """The root, and of each place its siblings (left, right) level by level."""
        paths, at = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            for i, p in enumerate(at):
                a = p // 16 * 16
                paths[i].append(("".join(level[a:p]), "".join(level[p + 1 : a + 16])))
            level = [sha("".join(level[a : a + 16])) for a in range(0, len(level), 16)]
            at = [p // 16 for p in at]
        return level[0], paths

    sources = defaultdict(list)
    for r in rows:
        crc = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        given = (*r[:4], r[4].translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))) if crc and r[4] is not None else r
        sources[r[1]].append((r[0], leaf(r), leaf(given)))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    subs = []
    for s in names:
        sources[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        subs.append(climb([x[1] for x in sources[s]]))
    root, tops = climb([s[0] for s in subs])
    out = []
    for s, (sub, paths), top in zip(names, subs, tops, strict=True):
        for (i, own, given), path in zip(sources[s], paths, strict=True):
            h = given
            for left, right in path + top:
                h = sha(left + h + right)
            out.append((i, own, sub, root, sha("".join(a + b for a, b in path + top)), h, h == root))
    return out


def manifest(df):
    text = F.col("text")
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return merkle.manifest(df, tampered={"text": F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, lowered).otherwise(text)})


def text_rows(found) -> list[tuple]:
    return sorted(tuple(map(str, r)) for r in found)


@pytest.mark.parametrize("sizes", [{"one": 1}, {"a": 16, "b": 17, None: 256, "": 257, "é": 1, "z": 3}, {f"s{i}": 1 for i in range(40)}, {"only": 4097}])
def test_manifest_against_brute_force(spark, sizes):
    rows = []
    for s, n in sizes.items():
        rows += [(1000 * len(rows) + i, s, None if i % 7 == 0 else "en", i or None, None if i % 5 == 3 else f"Text {i} É" * (i % 3)) for i in range(n)]
    df = spark.createDataFrame([(*r, *[None] * 7) for r in rows], DOCS).repartition(3)
    assert text_rows(manifest(df).collect()) == text_rows(hashed(rows))


def test_manifest_of_odd_rows(spark, odd_rows):
    rows = [(i, [None, "", "x"][k % 3], None, None, t if t is None else t.replace("퟿", "")) for k, (i, t) in enumerate(odd_rows)] * 2
    df = spark.createDataFrame([(*r, *[None] * 7) for r in rows], DOCS).repartition(4)
    got = manifest(df)
    assert text_rows(got.collect()) == text_rows(hashed(rows))
    assert manifest(df.filter("false")).collect() == []


def test_tampering_is_found_where_it_changes_something(spark, data):
    out = queries.op11_merkle_manifest(spark, data).join(spark.read.parquet(f"{data}/documents.parquet"), "doc_id")
    changed = (F.crc32(F.col("doc_id").cast("string")) % 5 == 0) & F.col("text").rlike("[A-Z]")
    assert out.filter(F.col("verified") == changed).count() == 0 and out.filter("not verified").count() > 10


# Prefix trie


def trie(rows: list[tuple]) -> list[tuple]:
    """Brute force over (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = sha(f"{len(role.encode())}:{role}{text}")
            convs[c].append(((turn is not None, turn or 0, key), (role, text)))
    for v in convs.values():
        v.sort()
    built = {}
    for c, v in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(x for _, x in convs.get(c - c % 100, [])[:h]) + tuple(x for _, x in v[h:])
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    total = {}
    for p in sorted(members, key=len, reverse=True):
        leaves, saved = int(not kids[p]), (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        total[p] = (leaves + sum(total[k][0] for k in kids[p]), saved + sum(total[k][1] for k in kids[p]))
    return [(m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids[p]), *total[p], sha(",".join(str(c) for c in m if built[c] == p))) for p, m in members.items()]


def trie_rows(spark, rows):
    df = spark.createDataFrame([(*r, *[None] * 7) for r in rows], TURNS).repartition(3)
    turns, convs = prefix_trie.with_shared_openings(prefix_trie.positions(df))
    out = prefix_trie.prefix_trie(turns, convs)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()


def some_conversations(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(420), 150):
        for t in range(rng.choice([1, 2, 3, 7, 9])):
            rows.append((c, t, rng.choice(["user", None]), rng.choice(["a", "b", "é🙂", None, ""])))
    rows += [(7, t, "user", "long") for t in range(120)] + [(8, t, "user", "long") for t in range(60)]
    rows += [(c, t, "u", "same") for c in range(500, 560) for t in range(8)]  # copies
    rows += [(300, None, "u", "null turn"), (300, 1, "u", "twice"), (300, 1, "u", "twice"), (300, 1, "u", "once"), (None, 0, "u", "no one"), (901, 0, "u", "turnless?"), (900 + 33, 0, "u", "x")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_against_brute_force(spark, seed):
    rows = some_conversations(seed)
    assert text_rows(trie_rows(spark, rows)) == text_rows(trie(rows))


def test_trie_of_few_rows(spark):
    assert trie_rows(spark, []) == [] and trie_rows(spark, [(None, 1, "u", "x")]) == []
    for rows in ([(0, 0, "u", "x")], [(101, 0, "u", "x")], [(5, 0, None, None), (5, 1, "", "")]):
        assert text_rows(trie_rows(spark, rows)) == text_rows(trie(rows))


def test_prefixes_of_one_pattern_differ(spark):
    """Thue-Morse turns, on which sums of powers collide."""
    word = [bin(i).count("1") % 2 for i in range(1024)]
    rows = [(1, i, "u", "ab"[x]) for i, x in enumerate(word)] + [(2, i, "u", "ba"[x]) for i, x in enumerate(word)]
    turns = prefix_trie.positions(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    last = prefix_trie.prefixes(turns).filter("depth = 1024").collect()
    assert (last[0]["a"], last[0]["b"]) != (last[1]["a"], last[1]["b"])


def test_ends_in_pieces(spark):
    ends = spark.createDataFrame([(1, 1, 1, c) for c in range(100)] + [(2, 1, 1, 7), (3, 5, 5, 1), (3, 5, 5, 0), (3, 5, 5, 10)], "depth long, a long, b long, conv_id long").repartition(3)
    got = {r["depth"]: r["ends_sha256"] for r in prefix_trie.ends_digests(ends, ids_a_piece=3).collect()}
    assert got == {1: sha(",".join(map(str, range(100)))), 2: sha("7"), 3: sha("0,1,10")}


def test_rollup_of_any_shape(spark):
    """Random trees, a star and a caterpillar, against sums from the leaves up."""
    rng = random.Random(5)
    for shape in ("random", "star", "caterpillar", "chain"):
        # Conversations as sequences of numbers.
        seqs = {
            "random": [tuple(rng.randrange(3) for _ in range(rng.randrange(9))) for _ in range(200)],
            "star": [(i,) for i in range(150)],
            "caterpillar": [(*[0] * i, 1) for i in range(40)],
            "chain": [tuple([0] * 90)],
        }[shape]
        members = defaultdict(list)
        for c, s in enumerate(seqs):
            for d in range(len(s) + 1):
                members[s[:d]].append(c)
        value = {p: rng.randrange(50) for p in members}
        rows = [(m[0], len(p), members[p[:-1]][0] if p else None, len(members[p[:-1]]) if p else None, len(m), value[p]) for p, m in members.items()]
        df = spark.createDataFrame(rows, "conv_id long, depth long, parent_conv_id long, parent_convs long, n_convs long, v long")
        want = defaultdict(int)
        for p in members:
            for d in range(len(p) + 1):
                want[(members[p[:d]][0], d)] += value[p]
        assert {(r["conv_id"], r["depth"]): r["v"] for r in prefix_trie.rollup(df, ["v"]).collect()} == dict(want)


# Main text of pages

ARTICLE = ["First paragraph of the article, which says something at length.", "A second one with <b>bold</b> &amp; <a href=x>linked</a> words in it, also at length.", "Third."]
PLAIN = ["First paragraph of the article, which says something at length.", "A second one with bold & linked words in it, also at length.", "Third."]
BODY = "".join(f"<p>{p}</p>" for p in ARTICLE)
NOISE = {
    "menu": "<nav><ul><li><a href=/>Home</a></li><li>About us and what we do here</li></ul></nav>",
    "header": "<header><h1>Name of the site, which is long enough to be a text</h1><p>Its motto, long enough as well to be taken for one.</p></header>",
    "footer": "<footer><p>All rights reserved by the company that owns this page and others.</p></footer>",
    "sidebar": "<aside><p>Read also this other text, which we have put beside the article for you.</p></aside>",
    "named sidebar": "<div class='col right-sidebar'><p>Read also this other text, which we have put beside the article for you.</p></div>",
    "notice": "<div id='cookie-notice'><p>We use cookies, as everybody does, and you have to agree to all of them now.</p></div>",
    "advert": "<div class=ad><p>Buy this thing now, it is cheap, good and nearly new, so do not wait.</p></div>",
    "form": "<form action=/s><p>Write to us about what you think of this page and of the others.</p><input name=q><select><option>One</option></select></form>",
    "script": "<script>var t = '</p><p>not a text, though it has the look of one, really';</script><style>p { content: 'text' }</style><noscript><p>Please turn on scripts to read this page.</p></noscript>",
    "comments": "<section class='comments-area'><article class=comment><p>I do not agree with a word of this, and neither does anybody I know.</p></article></section>",
    "comment": "<!-- <p>a paragraph that nobody sees since it stands in a comment</p> -->",
}


@pytest.mark.parametrize("frame", ["<article>{}</article>", "<main><div class='post-42'>{}</div></main>", "<div id=wrap><div class=entry-content>{}</div></div>", "<table><tr><td>{}</td></tr></table>"])
@pytest.mark.parametrize("noise", sorted(NOISE))
def test_what_is_not_article_goes(frame, noise):
    for source in (f"<html><head><title>T</title></head><body>{NOISE[noise]}{frame.format(BODY)}{NOISE[noise]}</body></html>", f"<body>{frame.format(BODY + NOISE[noise])}"):
        if noise == "header" and source.startswith("<body>") and ("article" in frame or "main" in frame):
            continue  # a heading inside the article belongs to it
        assert html_text.extract(source, None) == "\n".join(PLAIN)


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""), ("", ""), (" \n ", ""), ("plain", "plain"), ("a < b &lt; c <3", "a < b < c <3"), ("<p>one<p>two<br>lines<ul><li>x<li>y</ul>", "one\ntwo lines\nx\ny"), ("<p>a&nbsp;\n\t b</p>", "a b"), ("<p title='>'>in", "in"),
        ("<p>1</p><!-- x > y --><p>2</p><!-->3", "1\n2\n3"), ("<!-- open <p>x", ""), ("<script>never closed <p>x", ""), ("<p>a<script>x</script>b</p>", "ab"), ("<article><header><h1>T</h1><p>by A</p></header><p>Body</p></article>", "T\nBody"),
        ("<div class=has-sidebar><p>kept</p></div>", "kept"), ("<div class=ad>never closed<article><p>kept</p></article>", "kept"), ("<P>UP</P><DIV>x</DIV>", "UP\nx"), ("&copy&am; &#65;&#x42;", "©&am; AB"), ("<p hidden>no</p><p>yes</p>", "yes"),
        ("<nav>only a menu</nav>", ""), ("<td>a</td><td>b</td>", "a\nb"), ("<p>🙂 é ü</p>", "🙂 é ü"), ("<h1>Head</h1>text", "Head\ntext"), ("</p></div></x>rest", "rest"), ("<", "<"), ("x</", "x</"),
    ],
)
def test_markup_of_all_kinds(source, text):
    assert html_text.extract(source, None) == text


@pytest.mark.parametrize("piece", ["<div>", "<p>", "<a x='", "<!--", "<!-- x --!", "<b class=ad>", "</div>", "<li><span class=q>", "<table><tr><td>", "&amp", "<article class=comment>", "<script>x</script>", "< "])
def test_time_grows_with_the_page(piece):
    began = time.time()
    html_text.extract(piece * 40_000 + "<p>end</p>", None)
    assert time.time() - began < 6


def paragraphs(k: int, n: int) -> str:
    return "".join(f"<p>Sentence {i} of page {k}, as long as sentences of articles are wont to be.</p>" for i in range(n))


def consensus_pages() -> list[tuple]:
    """One host with short articles, one of its pages with a far longer box that no name gives away; a second host with other paths."""
    page = "<body><div class=c1>{}</div><div class=c2>{}</div></body>"
    rows = [(i, f"https://A.example.org:8080/{i}", page.format(paragraphs(i, 4), "<p>x</p>")) for i in range(6)]
    rows.append((6, "http://u@a.example.org/6?q=//b", page.format(paragraphs(6, 2), paragraphs(99, 9))))
    rows += [(10 + i, f"https://b.example.org/{i}", f"<body><section class=s{1000 + i}>{paragraphs(10 + i, 3)}</section></body>") for i in range(3)]
    rows += [(20, None, f"<div>{paragraphs(20, 2)}</div>"), (21, "no url", None), (None, "https://b.example.org/9", f"<article>{paragraphs(22, 1)}</article>"), (None, "https://b.example.org/9", f"<article>{paragraphs(22, 1)}</article>")]
    return rows


@pytest.mark.parametrize("few", [8 << 20, 0])
def test_pages_follow_their_host(spark, few):
    schema = "page_id long, url string, html string, host string, text int, n_chars string, _host int, paths string, key string, votes int"
    df = spark.createDataFrame([(*r, *[None] * 7) for r in consensus_pages()], schema).repartition(3)
    out = html_text.main_text(df, few=few)
    assert set(out.columns) == set(df.columns)
    rows = out.collect()
    got = {r["page_id"]: r["text"] for r in rows if r["page_id"] is not None}
    text = lambda k, n: paragraphs(k, n).replace("</p><p>", "\n").replace("<p>", "").replace("</p>", "")
    assert html_text.extract(consensus_pages()[6][2], None) == text(99, 9)  # alone it would be fooled
    want = {i: text(i, 4) for i in range(6)} | {6: text(6, 2)} | {10 + i: text(10 + i, 3) for i in range(3)} | {20: text(20, 2), 21: ""}
    assert got == want and len(rows) == len(consensus_pages())
    assert [r["text"] for r in rows if r["page_id"] is None] == [text(22, 1)] * 2
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_votes_and_ranks(spark):
    df = spark.createDataFrame(consensus_pages(), "page_id long, url string, html string")
    votes = {(r["host"], r["path"]): r["votes"] for r in html_text.host_paths(df).collect()}
    assert votes == {("a.example.org", "body/div.c1"): 6, ("a.example.org", "body/div.c2"): 1, ("b.example.org", "body/section.s"): 3, ("b.example.org", "body/article"): 2, ("", "body/div"): 1}
    assert html_text.main_text(df.filter("false")).collect() == []


def test_pages_of_the_table(spark, data):
    """The given pages: title and paragraphs of the article, cut by hand."""
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    for r in queries.op12_html_text(spark, data).collect():
        inner = pages[r["page_id"]].split("<article>")[1].split("</article>")[0]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>", inner))
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("name", ["op4_sharding", "op5_near_dedup", "op6_lm_score", "op8_line_dedup", "op10_exact_dedup", "op11_merkle_manifest", "op12_html_text", "op13_prefix_trie"])
def test_tables_of_a_query_go_when_released(spark, data, name):
    path = spark._jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark))
    left = lambda: len(path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path))
    release(spark)
    before = left()
    assert queries.QUERIES[name](spark, data).count() > 0
    release(spark)
    assert left() == before
