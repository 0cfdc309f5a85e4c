"""Token counts by the whole-token shortcut.

Before any text is read, it is proved once, on the driver, which vocabulary strings encode alone as one token
(:meth:`Vocabulary.whole_tokens`); the proved strings (never more than the vocabulary has) go to the workers with the
function. A pre-token that is such a string counts one at once, and only the others are merged, each distinct one once while the
bounded memo holds it. No shuffle: counts are computed where the text is read.

A null or empty text has 0 tokens and 0 bytes. Texts of any length are scanned whole. All other columns stay.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.llm import bpe
from metaloom.llm.words import slices
from metaloom.session import ship_package


@lru_cache(2)
def proved(path: str) -> frozenset[bytes]:
    """The strings that encode alone as one token."""
    return frozenset(bpe.vocabulary(path).whole_tokens())


_COUNTERS: dict[str, bpe.Memo] = {}


def _counter(path: str, whole: frozenset[bytes]) -> bpe.Memo:
    """A worker's memo of counts, with the proved strings fixed in it."""
    if path not in _COUNTERS:
        vocab = bpe.vocabulary(path)
        _COUNTERS[path] = bpe.Memo(lambda names: [len(x) // 4 for x in vocab.merge_many(names)], fixed=dict.fromkeys(whole, 1))
    return _COUNTERS[path]


def count_run(texts: list[str | None], path: str, whole: frozenset[bytes]) -> np.ndarray:
    """Number of tokens of each text, special strings counting one; ``whole``: what :func:`proved` gives."""
    special = bpe.vocabulary(path).special
    out = np.zeros(len(texts), dtype=np.int64)
    for a, b in slices(texts):
        parts, owner, then = bpe.split_special(texts[a:b], special)
        names, number, first = bpe.distinct(parts)
        each = np.array(_counter(path, whole).many(names), dtype=np.int64)[number] if names else np.zeros(0, dtype=np.int64)
        sums = np.concatenate([[0], np.cumsum(each)])
        np.add.at(out, np.array(owner, dtype=np.int64) + a, sums[first[1:]] - sums[first[:-1]] + (np.array(then) >= 0))
    return out


def token_count(text: Column, path: str) -> Column:
    """The number of tokens of a text column under the vocabulary file at ``path`` (a place on every worker)."""
    whole = proved(path)

    @F.pandas_udf("long")
    def count(s: pd.Series) -> pd.Series:
        return pd.Series(count_run(s.tolist(), path, whole))

    return count(text)


def with_token_counts(df: DataFrame, path: str, text_col: str = "text", limit: int = 512, names: tuple[str, str, str] = ("n_bytes", "n_tokens", "over_limit")) -> DataFrame:
    """``df`` with the text's UTF-8 bytes, its tokens, and whether they exceed ``limit``; columns of these names are replaced."""
    ship_package(df.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    n_bytes, n_tokens, over = names
    held = df.withColumns({n_bytes: F.octet_length(text).cast("long"), n_tokens: token_count(text, path)})
    return held.withColumn(over, F.col(f"`{n_tokens}`") > limit)
