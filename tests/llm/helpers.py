"""Small documents that hold the hard cases, and plain readings of the rules."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, start int, n int, __pii_key string"


def documents(spark, texts):
    """Rows (doc_id, text) as documents, with extra columns whose names the operators use themselves."""
    rows = [(i, t, "en", "s", None if t is None else len(t), "x", 1, 2, "k") for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def prose(seed: int, n: int, words: int = 400) -> str:
    r = random.Random(seed)
    vocabulary = ["".join(random.Random(k).choices("abcdefghij", k=2 + k % 6)) for k in range(words)]
    return " ".join(r.choice(vocabulary) + ("." if r.random() < 0.1 else "") for _ in range(n))


EDGE = [(100, None), (101, ""), (102, "   \n\t "), (None, "no id here at all, only text"), (103, "one"), (104, "é ü 漢字 \U0001f600")]
