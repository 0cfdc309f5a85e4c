"""URL filters with DataFrame functions alone: rules, then a blocked Bloom filter before an exact hash join.

The list of canonical URLs may be of any size. It is folded into a blocked Bloom filter: a URL's hash names one block
of four 64-bit words and sets one bit in each; the number of blocks follows the list (``KEYS`` URLs a block, where about
one other URL in 250 passes). Up to ``blocks`` blocks, 10.5 MB by default, which serve four million URLs, the filter is
broadcast to the pages' URLs, and only what passes is shuffled; a larger filter is dealt by blocks and meets each wanted
URL once. Possible hits then meet the list itself in a hash join on the canonical URL, which removes false ones. No
column of a page but its canonical URL takes part.

What is left, the listed URLs that pages want, goes back to the pages as a broadcast while it has at most ``few`` bytes
(checked on the written table). Beyond that a filter of it, of ``blocks`` blocks, is broadcast: pages that it stops are
not moved, and the others meet the confirmed URLs in a shuffled join. The URL column is read twice, all else once (twice
beyond ``few``).

Canonical URLs: scheme, user, fragment, default ports, a leading ``www.`` and slashes at the path's end are left out;
dot segments are resolved; escapes of unreserved characters are undone and the others written in capitals; parameters of
the query are sorted, and those that only track (``TRACKING``) left out. All other parameters count.

Rules are few and given as a parameter: (verdict, host, path). A rule fits its host and all subdomains if the URL's
path starts with the rule's path; of several the longest wins and its verdict stands; else a listed URL is blocked,
and any other allowed. A null URL or one without ``://`` has empty host and path, fits no rule and is allowed. Repeated
rows are judged alike; all other columns stay.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.session import cut

BLOCKS, KEYS, FEW = 1 << 18, 16, 32 << 20
# Parameters of a query that name the way to a page, not the page.
TRACKING = r"^(utm_[^=]*|gclid|fbclid|msclkid|ref|ref_src)(=|$)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    cut_off = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(cut_off, string.ascii_uppercase, string.ascii_lowercase), F.lit("")), F.coalesce(path, F.lit(""))


def _unescaped(x: Column) -> Column:
    """Escapes of unreserved characters undone, the others in capitals."""

    def part(y: Column) -> Column:
        code = F.upper(F.substring(y, 1, 2))
        char = F.char(F.conv(code, 16, 10).cast("long"))
        rest = F.substring(y, 3, 2**31 - 1)
        return F.when(~code.rlike("^[0-9A-F]{2}$"), F.concat(F.lit("%"), y)).when(char.rlike("^[A-Za-z0-9._~-]$"), F.concat(char, rest)).otherwise(F.concat(F.lit("%"), code, rest))

    pieces = F.split(x, "%", -1)
    return F.concat(F.element_at(pieces, 1), F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), part), ""))


def _resolved(path: Column) -> Column:
    """The path without ``.`` and ``..``, and without slashes at its end."""
    step = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(x)))
    plain = F.when(path.contains("/."), F.array_join(F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), step), "/")).otherwise(path)
    return F.regexp_replace(plain, r"/+$", "")


def canonical(url: Column) -> Column:
    """The canonical form of a URL; empty where it has no ``://``."""
    host, path = host_and_path(url)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r":(80|443)?$", ""), r"^www\.", "")
    parameters = F.split(_unescaped(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))), "&", -1)
    kept = F.array_join(F.array_sort(F.filter(parameters, lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    return F.concat(host, _resolved(_unescaped(path)), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bits(key: Column) -> list[Column]:
    """One bit for each word of the block, from a hash that is independent of the block's number."""
    h = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(4)]


def blocked_bloom(listed: DataFrame, key: str, blocks: int = BLOCKS) -> DataFrame:
    """``block, w0..w3``: at most ``blocks`` rows."""
    bits = _bits(F.col(key))
    return listed.select(_block(F.col(key), blocks).alias("block"), *(b.alias(f"w{k}") for k, b in enumerate(bits))).groupBy("block").agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(4)))


def _hit(key: Column, at: str, words: list[str]) -> Column:
    """Whether a key passes the block that it was joined with."""
    passed = F.col(at).isNotNull()
    for w, b in zip(words, _bits(key), strict=True):
        passed = passed & (F.col(w).bitwiseAND(b) != 0)
    return F.coalesce(passed, F.lit(False))


def confirmed_keys(wanted: DataFrame, keys: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """The distinct ``key`` of ``wanted`` that are in ``keys`` (distinct): possible hits by the filter, then a hash join of those with the list."""
    n = max(1024, -(-keys.count() // KEYS))
    names = [f"w{k}" for k in range(4)]
    bloom = blocked_bloom(keys, "key", n if n > blocks else min(blocks, n))
    if n <= blocks:  # what the filter stops is not shuffled
        tested = wanted.join(F.broadcast(bloom), _block(F.col("key"), n) == F.col("block"))
    else:  # a larger filter is dealt by blocks, and meets each wanted key once
        tested = wanted.distinct().withColumn("block", _block(F.col("key"), n)).join(bloom, "block")
    return tested.filter(_hit(F.col("key"), "block", names)).select("key").distinct().join(keys, "key", "left_semi")


def judge_urls(df: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", blocks: int = BLOCKS, few: int = FEW) -> DataFrame:
    """``df`` with ``host, path, rule, listed, verdict`` (columns of these names are replaced); ``listed`` has a column ``canonical_url`` (repeats and nulls allowed)."""
    tag = "_"
    while any(c.lower().startswith(tag) for c in df.columns):
        tag += "_"
    keys = cut(listed.filter("canonical_url is not null").select(F.col("canonical_url").alias("key")).distinct())
    source, wanted = F.col(f"{tag}source"), F.col(f"{tag}wanted")
    host, path = host_and_path(source)
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    parts = df.withColumn(f"{tag}source", F.col(f"`{url_col}`").cast("string")).drop("host", "path", "rule", "listed", "verdict").withColumns({"host": host, "path": path})
    # A URL that a rule settles, or without a host, is not looked up.
    parts = parts.withColumns({"rule": rule, f"{tag}settled": verdict})
    parts = parts.withColumn(f"{tag}wanted", F.when(F.col("rule").isNull() & (F.col("host") != ""), canonical(source)))
    confirmed = cut(confirmed_keys(parts.select(wanted.alias("key")).filter("key is not null"), keys, blocks)).select(F.col("key").alias(f"{tag}key"))
    size = confirmed.agg(F.sum(F.octet_length(f"{tag}key") + 16)).first()[0] or 0
    if size <= few:
        judged = parts.join(F.broadcast(confirmed), wanted == F.col(f"{tag}key"), "left")
    else:
        # Too many to broadcast: a filter of them lets all other pages by, and only those that pass are shuffled.
        at, words = f"{tag}at", [f"{tag}w{k}" for k in range(4)]
        tested = parts.join(F.broadcast(blocked_bloom(confirmed, f"{tag}key", blocks).toDF(at, *words)), _block(wanted, blocks) == F.col(at), "left").withColumn(f"{tag}hit", _hit(wanted, at, words)).drop(at, *words)
        yes = tested.filter(f"{tag}hit").join(confirmed, wanted == F.col(f"{tag}key"), "left")
        judged = yes.unionByName(tested.filter(f"not {tag}hit").withColumn(f"{tag}key", F.lit(None).cast("string"))).drop(f"{tag}hit")
    judged = judged.withColumn("listed", F.col(f"{tag}key").isNotNull())
    return judged.withColumn("verdict", F.coalesce(F.col(f"{tag}settled"), F.when(F.col("listed"), "block").otherwise("allow"))).drop(*(f"{tag}{x}" for x in ("source", "settled", "wanted", "key")))
