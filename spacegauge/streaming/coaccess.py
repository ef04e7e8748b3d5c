"""Co-access kept current as audit rows arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spacegauge.operators.usage import BLOCK_ROWS, pair_counts, session_pairs
from spacegauge.sources.staging import exists

SESSIONS = "user string, table_name string, day date, batch_id long"
FILES = 8  # at least, that the rows of one day and batch are dealt to
PAIRS = "table_a string, table_b string, n_sessions long, day date, batch_id long"


def coaccess_stream(audit_stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Each (user, day, table) once, as its first audit row arrives; later than ``watermark`` is too late.

    State is one small entry per user, day and table, hence spread evenly however busy a single user is.
    An entry is dropped when no row of its day can still be accepted.
    """
    return (
        audit_stream.where((F.col("action_name") == "getTable") & F.col("table_name").isNotNull())
        .select(
            F.col("event_time").cast("timestamp").alias("event_time"),
            F.col("user_email").alias("user"),
            F.to_date("event_time").alias("day"),
            "table_name",
        )
        .withWatermark("event_time", watermark)
        .dropDuplicatesWithinWatermark(["user", "day", "table_name"])
    )


def write_sessions(
    sessions: DataFrame, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Append sessions to a table by day. A batch that is run again replaces its own part of each day."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("user", "day", "table_name", F.lit(batch_id).alias("batch_id"))
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("day", "batch_id").parquet(path)

    writer = sessions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def rows_too_late(query: StreamingQuery) -> int:
    """Audit rows of the query's recent batches that came after the watermark and so count nowhere."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def session_table(spark, path: str, as_of: str | None = None, days: int = 90) -> DataFrame:
    """Sessions written so far, or those of the window that starts ``days`` before ``as_of``, whose days alone are read.

    A user-day-table that several batches hold counts once.
    """
    rows = spark.read.schema(SESSIONS).parquet(path)
    if as_of is not None:
        rows = rows.where(F.col("day") >= F.date_sub(F.lit(as_of).cast("date"), days))
    return rows.select("user", "day", "table_name").distinct()


def current_pairs(spark, path: str, as_of: str | None = None, days: int = 90) -> DataFrame:
    """Pair counts over what the stream has written, or over a window of it."""
    return pair_counts(session_table(spark, path, as_of, days))


def added_pairs(new: DataFrame, kept: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs that ``new`` rows make with one another and with ``kept`` rows of the same user-day, none of them equal.

    Both sides of a user-day are cut into blocks that meet in cells of their own, as in a batch.
    """
    keys = ["user", "day"]
    sizes = [df.groupBy(*keys).agg(F.ceil(F.count("*") / block_rows).alias(n)) for df, n in ((new, "rows"), (kept, "cols"))]
    both = sizes[0].join(sizes[1], keys)
    block = "pmod(xxhash64(table_name), {})".format
    a = new.join(both, keys).select(
        *keys, F.col("table_name").alias("one"), F.expr(block("rows")).alias("row"), F.expr("explode(sequence(0L, cols - 1))").alias("col")
    )
    b = kept.join(both, keys).select(
        *keys, F.col("table_name").alias("other"), F.expr(block("cols")).alias("col"), F.expr("explode(sequence(0L, rows - 1))").alias("row")
    )
    met = a.join(b, [*keys, "row", "col"]).select(
        *keys, F.least("one", "other").alias("table_a"), F.greatest("one", "other").alias("table_b")
    )
    return met.unionByName(session_pairs(new, block_rows))


def write_pairs(
    sessions: DataFrame, path: str, checkpoint: str, available_now: bool = True, block_rows: int = BLOCK_ROWS
) -> StreamingQuery:
    """Append sessions, and what each batch adds to the pair counts of its days, to two tables under ``path``.

    Only the days of a batch are read again: its rows that are new to their user-day are paired with one another and with
    those that the batches before it kept. A batch that is run again replaces its own part of both tables.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # Written aside, so that the stream's plan and its state are run through once a batch.
        batch.select("user", "day", "table_name").distinct().write.mode("overwrite").parquet(f"{path}/_batch")
        new = spark.read.schema("user string, day date, table_name string").parquet(f"{path}/_batch")
        days = [r.day for r in new.select("day").distinct().collect()]
        folders = [f"{path}/sessions/day={day}" for day in days]
        folders = [folder for folder in folders if exists(spark, folder)]
        if folders:
            kept = spark.read.schema(SESSIONS).option("basePath", f"{path}/sessions").parquet(*folders)
            kept = kept.where(F.col("batch_id") < batch_id).drop("batch_id")
        else:
            kept = new.limit(0)
        new = new.join(kept, ["user", "day", "table_name"], "left_anti")
        pairs = added_pairs(new, kept, block_rows).groupBy("day", "table_a", "table_b").agg(F.count("*").alias("n_sessions"))
        # Dealt out by day, lest every task writes a file for every day and later batches read all of them.
        dealt = max(FILES, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // max(1, len(days))))
        for rows, name, by in ((pairs, "pairs", ("table_a", "table_b")), (new, "sessions", ("user", "table_name"))):
            rows = rows.repartition("day", F.pmod(F.xxhash64(*by), F.lit(dealt)))
            writer = rows.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite")
            writer.option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch_id").parquet(f"{path}/{name}")

    writer = sessions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def kept_pairs(spark: SparkSession, path: str, as_of: str | None = None, days: int = 90) -> DataFrame:
    """Pair counts of what :func:`write_pairs` has written, or of the window that starts ``days`` before ``as_of``.

    What the batches added is summed up; no session is read.
    """
    rows = spark.read.schema(PAIRS).parquet(f"{path}/pairs")
    if as_of is not None:
        rows = rows.where(F.col("day") >= F.date_sub(F.lit(as_of).cast("date"), days))
    return rows.groupBy("table_a", "table_b").agg(F.sum("n_sessions").alias("n_sessions"))
