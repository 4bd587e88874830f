"""Awkward rows that every operator must take."""

import random

import pytest

from storyscale.llm.common import ready

SCHEMA = "doc_id long, text string, score string, shard string, size string, fp string, kept string, matches string, votes string, labels string, n_words string, predicted string"


def prose(n: int, seed: int = 0) -> str:
    r = random.Random(seed)
    words = ["sun", "river", "stone", "Light", "over", "the", "and", "moves", "été", "straße", "quiet", "hill", "17", "under"]
    return " ".join(r.choice(words) + r.choice(["", "", "", ",", ".", ".\n"]) + str(r.randrange(60)) for _ in range(n))


AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, prose(30_000, 1)), (6, prose(80, 2)), (6, prose(80, 2)), (7, prose(80, 2)), (None, "no id here at all"), (8, "x" * 50_000), (9, "<|endoftext|> odd spaces here \x00 \x01 İ Σ 中文 😀")]


@pytest.fixture(scope="session")
def awkward(spark):
    ready(spark)
    return spark.createDataFrame([(i, t, *["clash"] * 10) for i, t in AWKWARD], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    ready(spark)
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    ready(spark)
    return spark.read.parquet(f"{sf}/documents.parquet")
