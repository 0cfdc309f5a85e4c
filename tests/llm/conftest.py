from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(40_000))
TEXTS = [
    None, "", " \t\n\r\v\f", "a", "One two three.", "one  two\tTHREE.", "one two three.", "One two three.", "x" * 50_000, LONG, LONG + " tail", "é中 文字 ß\u00a0\u2003don't 12½ ²", "<|endoftext|>a<|endoftext|>", "'s 'll!'re '", "line\nline\n LINE \nother",
    "#" * 300, "same words here again " * 60, "\n\n", "🙂👍 \ud7ff end", " ".join(f"b{i}" for i in range(30)), " ".join(f"b{i}" for i in range(31)), " ".join(f"B{i}" for i in range(28)),
]


@pytest.fixture(scope="session")
def odd_rows():
    """Ids with a null and a repeated row; texts of all odd kinds."""
    rows = [(10 + i, t) for i, t in enumerate(TEXTS)]
    return [*rows, rows[4], (None, "One two three."), (None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """With extra columns whose names the operators use inside."""
    extra = "id long, key string, n long, node long, label long, size long, bucket int, quality string, norm string, digest string, pos int, words string, block long, held_out boolean"
    return spark.createDataFrame([(i, t, *[None] * 14) for i, t in odd_rows], f"doc_id long, text string, {extra}").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
