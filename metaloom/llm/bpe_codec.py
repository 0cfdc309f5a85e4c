"""Byte-level BPE encoding and decoding.

Encoding: class arrays and a scan of transition functions give the pre-token boundaries (:mod:`pretok`, no pattern is
run over texts); slices go through cached pair merging (:mod:`bpe`). Decoding: ids index a table of token bytes. The
byte offset of each token is kept, so that any span of ids can be mapped back to its place in the text.

A null text encodes as the empty text: no ids, empty bytes. An id outside the vocabulary raises when decoded.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from metaloom.llm import bpe
from metaloom.llm.words import slices


@lru_cache(2)
def _memo(path: str) -> bpe.Memo:
    vocab = bpe.vocabulary(path)
    return bpe.Memo(vocab.merge_many)


@lru_cache(2)
def _lengths(path: str) -> np.ndarray:
    return np.array([len(b) for b in bpe.vocabulary(path).bytes_of], dtype=np.int64)


def encode_run(texts: list[str | None], path: str, special: bool = False):
    """Yields the ids of each text in order, as arrays; ``special``: the vocabulary's special strings are their ids."""
    names = bpe.vocabulary(path).special if special else {}
    for a, b in slices(texts):
        ids, at = bpe.encode(texts[a:b], _memo(path), names)
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield ids[i:j]


def offsets(ids: np.ndarray, path: str) -> np.ndarray:
    """The byte offset in its text at which each id's bytes begin."""
    n = _lengths(path)[ids]
    return np.cumsum(n) - n


def decode_ids(ids: np.ndarray, path: str) -> bytes:
    return b"".join(map(bpe.vocabulary(path).bytes_of.__getitem__, ids.tolist()))


def encoded(text: Column, path: str, special: bool = False) -> Column:
    """A struct of ``ids`` and ``offsets`` (arrays of int) for a text column."""

    @F.pandas_udf("struct<ids: array<int>, offsets: array<int>>")
    def run(s: pd.Series) -> pd.DataFrame:
        ids = list(encode_run(s.tolist(), path, special))
        return pd.DataFrame({"ids": [x.astype(np.int32) for x in ids], "offsets": [offsets(x, path).astype(np.int32) for x in ids]})

    return run(text)


def decoded(ids: Column, path: str) -> Column:
    """The bytes that a column of id arrays stands for (null: none)."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([decode_ids(np.asarray(x if x is not None else [], dtype=np.int64), path) for x in s])

    return run(ids)
