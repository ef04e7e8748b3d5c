"""Texts that are awkward in every way, and the small tables of the given data."""

import random

import pytest
from pyspark.sql import functions as F

from spacegauge.llm.tables import ship

SF = "/root/testdata/sf0.001"
CLASHING = ("key", "text_no", "rest", "node", "x", "label", "rank", "cell", "shard", "draw", "copies", "their_key", "KEPT")


def sentence(rng, n):
    return " ".join(rng.choice(["ab", "cde", "f", "ghij", "kl,", "Mn.", "où", "x1"]) + str(rng.randint(0, 400)) for _ in range(n))


def texts():
    rng = random.Random(4)
    shared = sentence(rng, 60)
    long = sentence(rng, 20_000)
    near = sentence(rng, 300).split()
    changed = [*near[:150], "other", *near[151:]]
    return [
        (None, "no id at all " + sentence(rng, 40)),
        (1, None),
        (2, ""),
        (3, " \t\n\x0b  "),
        (4, "one"),
        (5, "one"),
        (6, "a b c d"),
        (7, sentence(rng, 50) + " " + shared),
        (8, shared + "\n" + sentence(rng, 50)),
        (8, shared + "\n" + sentence(rng, 50)),
        (9, long),
        (10, long),
        (10, long),
        (11, "same " * 200),
        (12, " ".join(near)),
        (13, " ".join(changed)),
        (14, "w" * 5_000),
        (15, "tick | tock | " * 30),
        (16, "A LINE\nA LINE\nA LINE\n" + sentence(rng, 60)),
        (17, shared[: len(shared) // 2]),
    ]


@pytest.fixture(scope="session")
def rows():
    return texts()


@pytest.fixture(scope="session")
def messy(spark, rows):
    """The awkward texts, with other columns whose names the operators use themselves, one of them all null."""
    ship(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASHING)}).withColumn("blank", F.lit(None).cast("double"))


@pytest.fixture(scope="session")
def none(messy):
    return messy.filter("doc_id < 0")


@pytest.fixture(scope="session")
def documents(spark):
    ship(spark)
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")
