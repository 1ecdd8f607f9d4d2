"""Documents with every oddity the operators must take: nulls, blanks, long texts, copies, odd columns."""

from __future__ import annotations

import random

import pytest

FOLDER = "/root/testdata/sf0.001"

# Names that the operators use inside.
CLASHING = ["score", "fp", "component_id", "epoch", "block", "row", "key", "n_tokens", "own_id", "leaking_id"]


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 7))) for _ in range(words))


LONG = prose(1, 20_000)

ROWS = [
    (1, prose(2, 60), "a"),
    (2, prose(2, 60), "a"),
    (2, prose(2, 60), "a"),
    (3, prose(2, 59) + " other", None),
    (4, None, "b"),
    (5, "", "b"),
    (6, " \t\n ", None),
    (None, prose(3, 40), "c"),
    (None, None, None),
    (7, LONG, "a"),
    (8, LONG[:-3] + "xyz", "a"),
    (9, "one two", "c"),
    (10, "Ünïcode \U0001f600 ÉCOLE Σ ΑΣ <|endoftext|> it's", "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string").cache()


@pytest.fixture(scope="session")
def clashing(odd):
    from pyspark.sql import functions as F

    return odd.withColumns({name: F.lit(f"own {name}") for name in CLASHING})


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")
