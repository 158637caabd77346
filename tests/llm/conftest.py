"""Documents that an operator must survive."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, sig string, class_id string, key string, score string, block int"
LONG = " ".join(f"w{i % 997} x{i % 31}" for i in range(30_000))
PROSE = " ".join(f"word{i} other{i * 7 % 13}" for i in range(60))


def awkward_rows() -> list[tuple]:
    extra = (7, True, "s", "c", "k", "z", 1)
    rows = [
        (1, PROSE, "en", "a"), (2, PROSE, "en", "a"), (3, PROSE + " tail", "en", "b"), (4, "", "en", "b"), (5, None, "en", "b"), (6, "   \n\t ", None, None), (7, "one", None, "b"), (8, LONG, "fr", "c"),
        (9, "x" * 50_000, "fr", "c"), (9, "x" * 50_000, "fr", "c"), (None, PROSE, "en", "a"), (None, "no id at all", None, None), (10, "é中\U0001f600 \u0000 tab\there", "de", "d"),
    ]
    return [(*r, len(r[1]) if r[1] is not None else None, *extra[:]) for r in rows]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
