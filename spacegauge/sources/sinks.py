"""Where results go: partitioned tables, one folder per kind of result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from spacegauge.sources.staging import remove


def write_table(df: DataFrame, path: str, run_date: str, fmt: str = "parquet") -> None:
    """Replace one run's partition of a result table, by nothing if there are no rows; other runs stay.

    The rows are written aside first and then take the place of the former ones by renaming, so a job that fails leaves
    the former run whole, and readers never see half a run.
    """
    spark = df.sparkSession
    top, own = path.rstrip("/"), uuid.uuid4().hex
    aside, former, place = (f"{top}/{name}" for name in (f"_new-{own}", f"_old-{own}", f"run_date={run_date}"))
    try:
        df.write.format(fmt).save(aside)
        replaced = _renamed(spark, place, former)
        if not _renamed(spark, aside, place):
            if replaced:
                _renamed(spark, former, place)
            raise OSError(f"cannot move {aside} to {place}")
    finally:
        remove(spark, aside)
    remove(spark, former)


def _renamed(spark: SparkSession, source: str, target: str) -> bool:
    """Move a folder if it is there; whether it was."""
    paths = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in (source, target)]
    files = paths[0].getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(files.exists(paths[0]) and files.rename(*paths))


def write_scorecard(scorecard: DataFrame, path: str, run_date: str, fmt: str = "parquet") -> None:
    write_table(scorecard, path, run_date, fmt)


def write_findings(findings: DataFrame, path: str, run_date: str, fmt: str = "parquet") -> None:
    write_table(findings, path, run_date, fmt)


def write_recommendations(recommendations: DataFrame, path: str, run_date: str, fmt: str = "parquet") -> None:
    write_table(recommendations, path, run_date, fmt)


def write_reports(reports: DataFrame, path: str, run_date: str, fmt: str = "parquet") -> None:
    write_table(reports, path, run_date, fmt)
