"""Reading the given tables and cutting lineage with tables in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import spacegauge
from spacegauge.session import shared_folder

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python, once per application, where it may not be installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(spacegauge.__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="spacegauge-"), "spacegauge-package.zip")
    with zipfile.ZipFile(archive, "w") as files:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    files.write(path, os.path.relpath(path, os.path.dirname(top)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one that all executors share; the caller may write it."""
    return f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that what follows starts from files.

    A lost executor then costs only the tasks after the table, and nothing above it runs twice.
    """
    folder = new_folder(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def fingerprint(text: str) -> Column:
    """128 bits that stand for the text in a column; null for null."""
    return F.unhex(F.md5(F.col(f"`{text}`").cast("binary")))


def spare_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it; Spark compares names without case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
