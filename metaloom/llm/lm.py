"""Language-model scoring with bigrams in Elias-Fano tries.

The model is absolute discounting, interpolated: ``P(w | h) = max(c(h w) - D, 0) / c(h) + D * T(h) / c(h) * B(w)``, with
T(h) the number of different words seen after h, and the add-one base ``B(w) = (c(w) + 1) / (N + V + 1)``, which alone counts
after a context that was never seen. The first part is kept for each bigram as a quantised logarithm in a trie of two
levels: contexts, and behind monotone pointers each context's successors, all Elias-Fano coded in flat buffers that open
in place. A bigram is found by successor search relative to its context; T(h) is the distance of two pointers.

Nothing grows beyond a task. Each task cuts its rows into blocks of about ``block_bytes`` of text, where they are read; a
block's tokens are kept as numbers, so texts are scanned once and never shuffled. Words and bigrams belong to shards.

1. A block tells each shard its distinct words, as bytes, with their training counts. The shard adds up what all blocks
   say and answers with a number for each word, dense and by falling count, and its count. Equal numbers are equal words.
2. A block tells each shard its distinct bigrams, as numbers, with their training counts. The shard builds its trie from
   the sums. Tries are written as a table, each with the bigrams that are asked of it.
3. A second pass opens each trie of that table and answers from it; the block adds up its documents.

A context with very many occurrences is dealt over several shards by its successors (``hot``), so no shard holds a
whole frequent context; a block asks all of them for their part of T(h), and the scores do not depend on it. All counts are
complete: every word and bigram of the training texts counts, none is cut off.

A null or empty text has one token, its end. A row without an id is scored and belongs to the training rows. Rows are
scored as often as they occur.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.llm.elias_fano import EliasFano
from metaloom.llm.words import mix, scan
from metaloom.session import cut, ship_package

U = np.uint64
START = 0  # the context before a text's first token; words are numbered from 1
FLOOR, STEPS = -14.0, 65534.0


@dataclass(frozen=True)
class Model:
    discount: float = 0.75
    block_bytes: int = 8_000_000
    hot: int = 2_000_000


def held_out(doc_id: Column, parts: int = 7, part: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def pack(rising: list[np.ndarray], plain: list[np.ndarray] = ()) -> bytes:
    """Integers in the narrowest bytes, laid out by byte and compressed together: ``rising`` as differences, ``plain`` (none negative) as they are."""
    parts = []
    for delta, a in [*((True, a) for a in rising), *((False, a) for a in plain)]:
        z = a.astype(np.int64)
        if delta:
            z = np.diff(z, prepend=0)
            z = (z << 1) ^ (z >> 63)
        z = z.view(np.uint64)
        width = next(w for w in (1, 2, 4, 8) if not len(z) or int(z.max()) < 1 << (8 * w))
        parts += [bytes([width | delta << 7]), len(z).to_bytes(6, "little"), z.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpack(b: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(b), 0, []
    while at < len(raw):
        width, delta, n = raw[at] & 127, raw[at] >> 7, int.from_bytes(raw[at + 1 : at + 7], "little")
        z = np.frombuffer(raw, np.uint8, n * width, at + 7).reshape(width, n)
        z = np.ascontiguousarray(z.T).view(f"<u{width}").reshape(n).astype(np.int64) if width < 8 else np.ascontiguousarray(z.T).view("<i8").reshape(n)
        if delta:
            z = np.cumsum((z >> 1 & np.int64(2**63 - 1)) ^ -(z & 1))
        at += 7 + n * width
        out.append(z)
    return out


def _cells(shard: np.ndarray) -> list[tuple[int, int, int]]:
    """(shard, from, to) of each that occurs in a sorted array."""
    at = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, dtype=np.int64)
    return list(zip(shard[at].tolist(), at.tolist(), [*at[1:].tolist(), len(shard)], strict=True))


class Block:
    """A block's tokens as numbers of its distinct words, the texts' sizes in tokens, and which of them train."""

    def __init__(self, number: np.ndarray, sizes: np.ndarray, held: np.ndarray, words: int):
        self.number, self.sizes, self.words = number, sizes, words
        self.first = np.cumsum(sizes) - sizes
        self.train = np.repeat(~held, sizes)

    def counts(self) -> np.ndarray:
        return np.bincount(self.number, weights=self.train, minlength=self.words).astype(np.int64)

    def bigrams(self) -> None:
        """Distinct pairs (context, word) by number (context 0 is the start), their training counts, and each token's pair."""
        before = np.empty(len(self.number), dtype=np.int64)
        before[1:] = self.number[:-1] + 1
        before[self.first] = 0
        pairs, self.pair = np.unique(before * (self.words + 1) + self.number, return_inverse=True)
        self.pair_counts = np.bincount(self.pair, weights=self.train, minlength=len(pairs)).astype(np.int64)
        self.context, self.word = np.divmod(pairs, self.words + 1)


class Trie:
    """Two levels: contexts, pointers and successors as Elias-Fano sequences, with a 16-bit quantised value a bigram."""

    def __init__(self, bits: int, contexts: EliasFano, pointers: EliasFano, successors: EliasFano, values: np.ndarray):
        self.bits, self.contexts, self.pointers, self.successors, self.values = bits, contexts, pointers, successors, values

    @classmethod
    def build(cls, context: np.ndarray, successor: np.ndarray, value: np.ndarray) -> bytes:
        """From bigrams of numbers sorted by (context, successor)."""
        names, begin, number = np.unique(context, return_index=True, return_inverse=True)
        bits = int(successor.max()).bit_length() if len(successor) else 0
        own = number.astype(np.uint64) << U(bits) | successor.astype(np.uint64)
        top = int(names[-1]) + 1 if len(names) else 1
        parts = [EliasFano.of(names, top), EliasFano.of(np.append(begin, len(context)), len(context) + 1), EliasFano.of(own, max(len(names), 1) << bits)]
        return np.array([bits], dtype="<u8").tobytes() + b"".join(p.to_bytes() for p in parts) + value.astype("<u2").tobytes()

    @classmethod
    def open(cls, buffer) -> Trie:
        """From a buffer or a memory map, without a copy."""
        at, parts = 8, []
        for _ in range(3):
            part, at = EliasFano.open(buffer, at)
            parts.append(part)
        return cls(int(np.frombuffer(buffer, "<u8", 1)[0]), *parts, np.frombuffer(buffer, dtype="<u2", offset=at))

    def find(self, context: np.ndarray, counts: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Values of bigrams given as contexts, the number of successors asked of each, and those; 0: not there."""
        c = np.repeat(self.contexts.find(context), counts)
        out = np.zeros(len(successor), dtype="<u2")
        known = np.flatnonzero((c >= 0) & (successor < 1 << self.bits))
        at = self.successors.find(c[known].astype(np.uint64) << U(self.bits) | successor[known].astype(np.uint64))
        hit = at >= 0
        out[known[hit]] = self.values[at[hit]]
        return out

    def followers(self, context: np.ndarray) -> np.ndarray:
        """How many successors each context has here."""
        c = self.contexts.find(context)
        at = np.maximum(c, 0)
        return np.where(c >= 0, (self.pointers.get(at + 1) - self.pointers.get(at)).astype(np.int64), 0) if self.contexts.n else np.zeros(len(c), dtype=np.int64)


def quantise(logp: np.ndarray) -> np.ndarray:
    return (1 + np.clip(np.round((logp - FLOOR) / -FLOOR * STEPS), 0, STEPS)).astype(np.uint16)


def dequantise(code: np.ndarray) -> np.ndarray:
    """The probability part; code 0 is none."""
    return np.where(code > 0, 10.0 ** (FLOOR - FLOOR * (code.astype(np.float64) - 1) / STEPS), 0.0)


def _columns(rows: list[dict], kinds: dict[str, pa.DataType]) -> dict[str, pa.Array]:
    return {k: pa.array([r.get(k) for r in rows], t) for k, t in kinds.items()}


class Scorer:
    """The steps on blocks and shards, as functions that Spark runs on tasks and groups."""

    def __init__(self, model: Model, shards: int, n: int = 0, v: int = 0, docs: int = 0):
        self.model, self.shards, self.n, self.v, self.docs = model, shards, n, v, docs

    # Blocks, where texts are read.
    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each block (``ids``, ``held``, ``body``), and one for each shard that it has words for (``shard``, ``body``)."""
        part, made = TaskContext.get().partitionId(), 0
        texts, ids, held, size = [], [], [], 0
        for batch in batches:
            own, begin = batch.column("id"), 0
            for i, (text, out) in enumerate(zip(batch.column("text").to_pylist(), batch.column("held_out").to_pylist(), strict=True)):
                texts.append(text)
                held.append(out)
                size += len(text) + 16
                if size >= self.model.block_bytes:
                    yield self._block(pa.concat_arrays([*ids, own.slice(begin, i + 1 - begin)]), texts, held, (part << 32) + made)
                    texts, ids, held, size, begin, made = [], [], [], 0, i + 1, made + 1
            ids.append(own.slice(begin))
        if texts:
            yield self._block(pa.concat_arrays(ids), texts, held, (part << 32) + made)

    def _block(self, ids: pa.Array, texts: list, held: list, block: int) -> pa.RecordBatch:
        w = scan(texts, lower=True)
        sizes, held = w.counts + 1, np.array(held, dtype=bool)
        # The end of a text is a word that no text has: the empty one. Words are numbered by falling frequency.
        number = np.insert(w.number, w.first[1:], len(w.names))
        rank = np.empty(len(w.names) + 1, dtype=np.int64)
        by_use = np.argsort(-np.bincount(number, minlength=len(rank)), kind="stable")
        rank[by_use] = np.arange(len(rank))
        b = Block(rank[number], sizes, held, len(rank))
        counts = b.counts()
        names = [*w.names.to_numpy(zero_copy_only=False).tolist(), b""]
        shard = (np.append(w.digests[:, 0], U(0)) % U(self.shards)).astype(np.int64)[by_use]
        order = np.argsort(shard, kind="stable")
        rows = []
        for s, i, j in _cells(shard[order]):
            mine = sorted(order[i:j].tolist(), key=lambda k: names[by_use[k]])
            order[i:j] = mine
            rows.append({"block": block, "shard": s, "names": zstandard.ZstdCompressor(level=3).compress(b"\n".join([names[by_use[k]] for k in mine])), "body": pack([], [counts[mine]])})
        rows.append({"block": block, "body": pack([], [b.number, sizes, order])})
        out = _columns(rows, {"block": pa.int64(), "shard": pa.int64(), "names": pa.binary(), "body": pa.binary()})
        none = pa.nulls(len(rows) - 1, pa.list_(ids.type))
        whole = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        out |= {"ids": pa.concat_arrays([none, whole]), "held": pa.array([None] * (len(rows) - 1) + [held.tolist()], pa.list_(pa.bool_()))}
        return pa.RecordBatch.from_pydict(out)

    # Words.
    def answer_words(self, table: pa.Table) -> pa.Table:
        """For each block the numbers and counts of its words here; in a row without a block this shard's part of N and V."""
        shard = table.column("shard")[0].as_py()
        lists = [zstandard.ZstdDecompressor().decompress(x).split(b"\n") for x in table.column("names").to_pylist()]
        counts = np.concatenate([unpack(x)[0] for x in table.column("body").to_pylist()])
        coded = pa.array([x for names in lists for x in names], pa.large_binary()).dictionary_encode()
        number = coded.indices.to_numpy().astype(np.int64)
        total = np.bincount(number, weights=counts.astype(np.float64), minlength=len(coded.dictionary)).astype(np.int64)
        rank = np.empty(len(total), dtype=np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(total))
        ends = np.cumsum([len(x) for x in lists]).tolist()
        rows = [{"block": b, "shard": shard, "body": pack([], [1 + rank[own] * self.shards + shard, total[own]])} for b, own in zip(table.column("block").to_pylist(), np.split(number, ends[:-1]), strict=True)]
        rows.append({"shard": shard, "n": int(total.sum()), "v": int((total > 0).sum())})
        return pa.table(_columns(rows, {"block": pa.int64(), "shard": pa.int64(), "body": pa.binary(), "n": pa.int64(), "v": pa.int64()}))

    @staticmethod
    def _known(table: pa.Table, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of a block's words from the shards' answers."""
        got = dict(zip(table.column("shard").to_pylist(), table.column("body").to_pylist(), strict=True))
        answers = [unpack(got[s]) for s in sorted(got)]
        number, total = np.empty(len(order), dtype=np.int64), np.empty(len(order), dtype=np.int64)
        number[order], total[order] = (np.concatenate([a[k] for a in answers]) for k in (0, 1))
        return number, total

    # Bigrams.
    def _opened(self, row: pa.Table, words: pa.Table) -> tuple[Block, np.ndarray, np.ndarray, np.ndarray]:
        """The block with its bigrams, its words in order of their numbers; numbers of contexts and their occurrences by local number (0: the start), and counts of words."""
        tokens, sizes, order = unpack(row.column("body")[0].as_py())
        number, total = self._known(words, order)
        by_number = np.argsort(number)
        rank = np.empty(len(order), dtype=np.int64)
        rank[by_number] = np.arange(len(order))
        b = Block(rank[tokens], sizes, np.array(row.column("held")[0].as_py(), dtype=bool), len(order))
        b.bigrams()
        number, total = number[by_number], total[by_number]
        return b, np.concatenate([[START], number]), np.concatenate([[self.docs], total]), total

    def _asked(self, b: Block, names: np.ndarray, seen: np.ndarray) -> tuple:
        """Questions in order of shard, context and successor: order, runs of equal contexts, cells; of each question the context's local number and the successor's number.

        The block's bigrams come first; then, for contexts that are dealt over several shards, one question to each of
        them that stands for no bigram (successor 0).
        """
        parts = 1 + seen // self.model.hot
        split = np.unique(b.context[parts[b.context] > 1])
        local = np.concatenate([b.context, np.repeat(split, parts[split])])
        of_part = np.arange(len(local) - len(b.context)) - np.repeat(np.cumsum(parts[split]) - parts[split], parts[split])
        successor = np.concatenate([names[1 + b.word], np.zeros(len(of_part), dtype=np.int64)])
        part = np.concatenate([(mix(names[1 + b.word].astype(np.uint64)) % parts[b.context].astype(np.uint64)).astype(np.int64), of_part])
        shard = (mix(names[local].astype(np.uint64) + part.astype(np.uint64) * U(0x9E3779B97F4A7C15)) % U(self.shards)).astype(np.int64)
        # Pairs come by context and successor already, but for the questions at their end.
        order = np.lexsort((successor, names[local], shard)) if len(split) else np.argsort(shard.astype(np.uint16) if self.shards < 1 << 16 else shard, kind="stable")
        s, n = shard[order], local[order]
        new = np.concatenate([[True], (s[1:] != s[:-1]) | (n[1:] != n[:-1])]) if len(s) else np.zeros(0, dtype=bool)
        return order, np.flatnonzero(new), _cells(s), local, successor

    def ask(self, row: pa.Table, words: pa.Table) -> pa.Table:
        rows = []
        if row.num_rows:
            b, names, seen, _ = self._opened(row, words)
            order, runs, cells, local, successor = self._asked(b, names, seen)
            counts = np.concatenate([b.pair_counts, np.zeros(len(order) - len(b.pair_counts), dtype=np.int64)])
            for shard, i, j in cells:
                at = runs[np.searchsorted(runs, i) : np.searchsorted(runs, j)]
                of = local[order[at]]
                rows.append({"shard": shard, "block": row.column("block")[0].as_py(), "asked": pack([names[of], successor[order[i:j]]], [np.diff(at, append=j)]), "told": pack([seen[of]], [counts[order[i:j]]])})
        return pa.table(_columns(rows, {"shard": pa.int64(), "block": pa.int64(), "asked": pa.binary(), "told": pa.binary()}))

    def build(self, table: pa.Table) -> pa.Table:
        """The shard's trie from the training counts of all blocks, and beside it what they ask."""
        context, seen, successor, count = [], [], [], []
        for asked, told in zip(table.column("asked").to_pylist(), table.column("told").to_pylist(), strict=True):
            (names, follow, sizes), (occur, times) = unpack(asked), unpack(told)
            use = times > 0  # only what the training texts hold
            context.append(np.repeat(names, sizes)[use])
            seen.append(np.repeat(occur, sizes)[use])
            successor.append(follow[use])
            count.append(times[use])
        context, seen, successor, count = (np.concatenate(x) for x in (context, seen, successor, count))
        order = np.lexsort((successor, context))
        context, successor = context[order], successor[order]
        new = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (successor[1:] != successor[:-1])])) if len(order) else np.zeros(0, dtype=np.int64)
        total = np.add.reduceat(count[order], new) if len(new) else np.zeros(0, dtype=np.int64)
        value = quantise(np.log10((total - self.model.discount) / seen[order][new]))
        asked = [dict(zip(("block", "asked"), x, strict=True)) for x in zip(table.column("block").to_pylist(), table.column("asked").to_pylist(), strict=True)]
        kind = pa.list_(pa.struct({"block": pa.int64(), "asked": pa.binary()}))
        return pa.table({"shard": table.column("shard").slice(0, 1), "trie": pa.array([Trie.build(context[new], successor[new], value)], pa.binary()), "questions": pa.array([asked], kind)})

    @staticmethod
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From each row of the written table: the trie opened in place, and the answers to its questions."""
        for batch in batches:
            for i in range(batch.num_rows):
                trie, shard = Trie.open(batch.column("trie")[i].as_buffer()), batch.column("shard")[i].as_py()
                questions = [(q["block"].as_py(), *unpack(q["asked"].as_py())) for q in batch.column("questions")[i]]
                rows, at = [], 0
                while at < len(questions):
                    to, size = at, 0
                    while to < len(questions) and size < 1 << 20:
                        size += len(questions[to][2])
                        to += 1
                    part = questions[at:to]
                    names, successor, sizes = (np.concatenate([q[k] for q in part]) for k in (1, 2, 3))
                    followers = np.split(trie.followers(names), np.cumsum([len(q[1]) for q in part])[:-1])
                    found = np.split(trie.find(names, sizes, successor), np.cumsum([len(q[2]) for q in part])[:-1])
                    rows += [{"block": q[0], "shard": shard, "body": pack([], [f, x])} for q, f, x in zip(part, followers, found, strict=True)]
                    at = to
                yield pa.RecordBatch.from_pydict(_columns(rows, {"block": pa.int64(), "shard": pa.int64(), "body": pa.binary()}))

    def score(self, row: pa.Table, answers: pa.Table) -> pa.Table:
        kind = row.schema.field("ids").type.value_type
        if not row.num_rows:
            return pa.table({"id": pa.array([], kind), "held_out": pa.array([], pa.bool_())} | {k: pa.array([], t) for k, t in (("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))})
        kinds = answers.column("kind").to_numpy()
        b, names, seen, total = self._opened(row, answers.filter(pa.array(kinds == 1)))
        order, runs, cells, local, _ = self._asked(b, names, seen)
        found = answers.filter(pa.array(kinds == 2))
        got = dict(zip(found.column("shard").to_pylist(), found.column("body").to_pylist(), strict=True))
        code, followers = np.zeros(len(order), dtype=np.int64), np.zeros(b.words + 1, dtype=np.int64)
        for shard, i, j in cells:
            at = runs[np.searchsorted(runs, i) : np.searchsorted(runs, j)]
            many, code[order[i:j]] = unpack(got[shard])
            np.add.at(followers, local[order[at]], many)
        code, seen = code[: len(b.word)], seen[b.context]
        base = (total[b.word] + 1.0) / (self.n + (self.v + 1))
        rest = np.where(seen > 0, self.model.discount * followers[b.context] / np.maximum(seen, 1), 1.0)
        p = dequantise(code) + rest * base
        sums = lambda x: np.add.reduceat(x, b.first)  # noqa: E731  every text has a token
        return pa.table(
            {"id": row.column("ids").combine_chunks().flatten(), "held_out": row.column("held").combine_chunks().flatten(), "n_tokens": pa.array(b.sizes, pa.int64()), "n_known": pa.array(sums((total > 0)[b.number].astype(np.int64)), pa.int64())}
            | {"base_score": pa.array(sums(np.log10((total + 1.0) / (self.n + (self.v + 1)))[b.number]), pa.float64()), "score": pa.array(sums(np.log10(p)[b.pair]), pa.float64())}
        )


def score_documents(df: DataFrame, model: Model = Model(), held: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row. ``held``: rows that do not train."""
    ship_package(df.sparkSession)
    held = held_out(F.col(f"`{id_col}`")) if held is None else held
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), held.alias("held_out"))
    size, rows, trained = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*"), F.count_if(~F.col("held_out"))).first()
    shards = 1 + (size + 16 * rows) // (3 * model.block_bytes)
    kind = docs.schema["id"].dataType.simpleString()
    plain = Scorer(model, shards)
    table = cut(docs.mapInArrow(lambda b: plain.blocks(b), f"block long, shard long, names binary, body binary, ids array<{kind}>, held array<boolean>"))
    told = table.filter("shard is not null").select("block", "shard", "names", "body")
    answered = cut(told.groupBy("shard").applyInArrow(lambda t: plain.answer_words(t), "block long, shard long, body binary, n long, v long"))
    n, v = answered.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    s = Scorer(model, shards, n, v, trained)
    own = table.filter("shard is null").select("block", "body", "ids", "held")
    words = answered.filter("block is not null").select("block", "shard", "body")
    bigrams = own.drop("ids").groupBy("block").cogroup(words.groupBy("block")).applyInArrow(lambda d, w: s.ask(d, w), "shard long, block long, asked binary, told binary")
    # A file a trie, so that a task holds one at a time.
    tries = cut(bigrams.groupBy("shard").applyInArrow(lambda t: s.build(t), "shard long, trie binary, questions array<struct<block: long, asked: binary>>"), rows_a_file=1)
    found = tries.mapInArrow(lambda b: s.answer(b), "block long, shard long, body binary")
    both = words.withColumn("kind", F.lit(1)).unionByName(found.withColumn("kind", F.lit(2)))
    scored = own.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(lambda d, a: s.score(d, a), f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity(score: float, n_tokens: int) -> float:
    return math.pow(10.0, -score / n_tokens)
