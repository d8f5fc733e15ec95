from __future__ import annotations

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_data import prose  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, key string, gone string, score double, node binary, class string, matches string, h long, rank int"
EXTRA = (None,) * 10


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with names that operators use inside."""
    r = random.Random(5)
    base, long = prose(r, 120), "\n".join(prose(r, 30) for _ in range(1200))
    rows = [
        (1, base, "en", "s"), (2, base, "en", "s"), (3, base.replace(" the ", " a ", 1), None, "s"), (4, "", "en", "s"), (5, None, "en", None), (None, base, "fr", "s"), (None, None, None, None),
        (6, long, "en", "s"), (7, long + "\nend", "en", "s"), (8, "a b c", "en", "s"), (9, "A B c", "en", "s"), (10, " \t\n ", "en", "s"), (11, prose(r, 200), "fr", "s"), (11, prose(r, 200), "fr", "s"), (12, "x" * 50_000, "en", "s"),
        (13, "日本 語\U0001f600 ﬁ İ", "ja", "s"), (13, "日本 語\U0001f600 ﬁ İ", "ja", "s"), (None, "only text", None, "s"), (14, "\n\n\n", "en", "s"), (15, "1234 !!", "en", "s"),
    ]
    return spark.createDataFrame([(*x, None if x[1] is None else len(x[1]), *EXTRA[:]) for x in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
