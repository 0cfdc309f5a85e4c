"""Token counts, encoding and decoding, packing."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from metaloom.llm import bpe, bpe_codec, packing, pretok, token_counts
from metaloom.llm.queries import QUERIES

JSON, MULTI = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
LIBRARY = tokenizers.Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def by_rank():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab's tre vmlld'\n\t 1²!?.éЖ中\u3000\u00a0'", max_size=30), max_size=5))
def test_boundaries_are_those_of_the_pattern(texts):
    joined, starts, first = pretok.boundaries(texts)
    split = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    at = 0
    for i, t in enumerate(texts):
        assert (starts[first[i] : first[i + 1]] - at).tolist() == [a for _, (a, _) in split.pre_tokenize_str(t)]
        at += len(t)


def test_composition_is_associative():
    table = pretok._monoid()[0]
    rng = np.random.default_rng(0)
    a, b, c = rng.integers(0, len(table), (3, 2000))
    assert (table[table[a, b], c] == table[a, table[b, c]]).all()


def test_whole_tokens_are_proved():
    vocab = bpe.vocabulary(JSON)
    whole = vocab.whole_tokens()
    assert len(whole) > 40_000
    for t in list(whole)[::997]:
        assert library_ids(t.decode()) == [whole[t]]


def twins(n: int = 1024) -> tuple[str, str]:
    """The Thue-Morse word and its complement: equal under every polynomial hash modulo 2**64 with an odd base."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_strings_that_weak_hashes_confuse(spark, by_rank):
    texts = list(twins())
    assert [len(library_ids(t)) for t in texts] == [341, 342] == token_counts.count_run(texts, JSON, token_counts.proved(JSON)).tolist()
    ids = list(bpe_codec.encode_run(texts, MULTI))
    assert [x.tolist() for x in ids] == [by_rank.encode_ordinary(t) for t in texts]
    assert [bpe_codec.decode_ids(x, MULTI).decode() for x in ids] == texts
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    packed_right(packing.pack(df, JSON).collect(), dict(enumerate(texts)), None)


def test_counts_query(spark, data, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in QUERIES["op1_token_counts"](spark, data).collect():
        n = len(library_ids(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)


def test_counts(odd, none):
    got = token_counts.with_token_counts(odd, JSON).select("doc_id", "text", "n_bytes", "n_tokens", "over_limit").collect()
    assert len(got) == odd.count()
    for r in got:
        assert r.n_tokens == len(library_ids(r.text)) and r.n_bytes == len((r.text or "").encode()) and r.over_limit == (r.n_tokens > 512)
    assert token_counts.with_token_counts(none, JSON).count() == 0


def test_codec(odd, none, by_rank):
    got = odd.select("text", bpe_codec.encoded(F.col("text"), MULTI).alias("e")).withColumn("b", bpe_codec.decoded(F.col("e.ids"), MULTI)).collect()
    for r in got:
        assert r.e.ids == by_rank.encode_ordinary(r.text or "") and bytes(r.b) == (r.text or "").encode()
        raw = (r.text or "").encode()
        assert all(raw[a : a + len(by_rank.decode_single_token_bytes(i))] == by_rank.decode_single_token_bytes(i) for i, a in zip(r.e.ids, r.e.offsets))
    assert none.select(bpe_codec.encoded(F.col("text"), MULTI)).count() == 0


def test_codec_query(spark, data, documents, by_rank):
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in QUERIES["op2_bpe_codec"](spark, data).collect():
        ids = by_rank.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_memo_forgets_but_stays_right():
    memo = bpe.Memo(lambda ks: [k * 2 for k in ks], limit=4)
    for keys in (["a", "b", "a"], ["c", "d", "a"], ["e", "f", "a"]):
        assert memo.many(keys) == [k * 2 for k in keys] and len(memo.young) + len(memo.old) <= 8


def packed_right(rows, texts, most_padding=0.01):
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for i, pieces in docs.items():
        ids = [*library_ids(texts[i]), 0]
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], dtype="<u4").tobytes())
            at += p.length
        assert at == len(ids)
    padding = total = 0
    for pieces in seqs.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= 1024
        padding += 1024 - at if at & (at - 1) else 0
        total += at
    assert set(docs) == set(texts)
    assert most_padding is None or padding <= most_padding * total
    return seqs


def test_packing_query(spark, data, documents):
    packed_right(QUERIES["op7_packing"](spark, data).collect(), {r.doc_id: r.text for r in documents.collect()})


def test_packing_odd_rows(odd, none):
    rows = odd.filter("doc_id is not null").dropDuplicates(["doc_id"])
    packed_right(packing.pack(rows, JSON).collect(), {r.doc_id: r.text for r in rows.collect()})
    again = packing.pack(odd, JSON, with_ids=True).collect()
    assert sum(r.length for r in again) == sum(len(library_ids(r.text)) + 1 for r in odd.select("text").collect())
    assert all(zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 for r in again)
    assert packing.pack(none, JSON).count() == 0
    with pytest.raises(ValueError):
        packing.pack(odd, JSON, capacity=1000)


def test_classes_take_a_fixed_number_of_documents():
    out = []
    bins = packing.Bins(64, 8, 0, lambda p, s, o: out.append((p[0], p[1], len(p[2]), s, o)))
    for i in range(12):
        bins.add(i, np.arange(64 // (1 + i % 3), dtype=np.uint32))  # 64, 32, 21
    bins.add(12, np.arange(130, dtype=np.uint32))  # two sequences and 2 tokens
    size = {i: 64 // (1 + i % 3) for i in range(12)} | {12: 130}
    bins.close()
    by_seq, pieces = defaultdict(list), defaultdict(list)
    for doc, start, n, seq, at in out:
        by_seq[seq].append((doc, n, at))
        pieces[doc].append((start, n))
    assert all(sum(n for _, n in sorted(v)) == size[i] for i, v in pieces.items()) and set(pieces) == set(size)
    whole = [v for v in by_seq.values() if all(n == size[i] for i, n, _ in v)]
    assert sum(len(v) == 1 for v in whole) == 4 and sum([n for _, n, _ in v] == [32, 32] for v in whole) == 2 and sum([n for _, n, _ in v] == [21, 21, 21] for v in whole) == 1
    assert sorted(pieces[12])[:2] == [(0, 64), (64, 64)]  # what the last open bins hold is cut into powers of two


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=120), st.integers(1, 20))
def test_bins_hold_every_token_once(sizes, waiting):
    out = []
    bins = packing.Bins(64, 8, 0, lambda p, s, o: out.append((p[0], p[1], len(p[2]), s, o)), waiting)
    for i, n in enumerate(sizes):
        bins.add(i, np.arange(n, dtype=np.uint32))
    bins.close()
    docs, seqs = defaultdict(list), defaultdict(list)
    for doc, start, n, seq, at in out:
        docs[doc].append((start, n))
        seqs[seq].append((at, n))
    for of, goal in ((docs, dict(enumerate(sizes))), (seqs, None)):
        for k, v in of.items():
            at = 0
            for start, n in sorted(v):
                assert start == at and n > 0
                at += n
            assert at == goal[k] if goal else at <= 64
    assert set(docs) == set(range(len(sizes)))
