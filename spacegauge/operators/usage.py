"""Which tables feed each other (lineage) and which are used together (audit)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spacegauge.operators.lists import ranked
from spacegauge.sources.staging import staged

BLOCK_ROWS = 256  # tables of one user-day paired within one group of the pair join
LISTED = 1 << 16  # user-days of one table that are kept in one list


def since(df: DataFrame, as_of: str, days: int, ts: str = "event_time", day: str = "event_date") -> DataFrame:
    """Rows of the trailing window that starts ``days`` before ``as_of``.

    Where events lie by ``day``, only the days of the window are read, and the one before, as days may have been taken in
    another time zone. Rows without a day are judged by their time alone.
    """
    first = F.date_sub(F.lit(as_of).cast("date"), days)
    recent = df.where(F.col(ts) >= first.cast("timestamp_ntz"))
    return recent.where(F.col(day).isNull() | (F.col(day) >= F.date_sub(first, 1))) if day in df.columns else recent


# ---- lineage ----------------------------------------------------------------------------------
def edge_counts(lineage: DataFrame) -> DataFrame:
    """Number of lineage events per source and target."""
    return lineage.groupBy("source_table", "target_table").agg(F.count("*").alias("n"))


def top_edges(edges: DataFrame, space_tables: DataFrame, k: int = 30) -> DataFrame:
    """The ``k`` most frequent edges that touch each space.

    An edge in a space's top ``k`` is also in the top ``k`` of the member table it touches, so each table's edges are cut
    to ``k`` before the spaces are joined. Edges are sorted once and known by their place from there on: a table has a
    list of at most ``k`` places, and names are looked up for the edges that are left.
    """
    order = [F.desc("n"), F.col("source_table").asc_nulls_first(), F.col("target_table").asc_nulls_first()]
    placed = edges.select("source_table", "target_table", "n").orderBy(*order).withColumn("place", F.monotonically_increasing_id())
    placed = staged(placed, "edges")
    ends = placed.select(
        "place", F.explode(F.array_distinct(F.array("source_table", "target_table"))).alias("table_id")
    ).where(F.col("table_id").isNotNull())
    per_table = ranked(ends, ["table_id"], ["place"], k).groupBy("table_id").agg(F.collect_list("place").alias("places"))
    # A space with very many tables is cut in parts, lest all its lists meet in one row.
    large = space_tables.groupBy(F.col("space_id").alias("large_id")).agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("parts"))
    members = space_tables.select("space_id", "table_id").join(
        large.where("parts > 1"), F.col("space_id").eqNullSafe(F.col("large_id")), "left"
    )
    part = F.pmod(F.xxhash64("table_id"), F.coalesce("parts", F.lit(1)))
    first = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))), 1, k).alias("places")
    held = members.join(per_table, "table_id").groupBy("space_id", part.alias("part")).agg(first)
    top = held.groupBy("space_id").agg(first).select("space_id", F.posexplode("places").alias("rank", "place"))
    named = top.join(placed, "place")
    return named.select("space_id", "source_table", "target_table", "n", (F.col("rank") + 1).alias("rank"))


def lineage_edges(
    lineage: DataFrame, space_tables: DataFrame, as_of: str, days: int = 90, k: int = 30
) -> DataFrame:
    """Top lineage edges per space over the trailing window."""
    return top_edges(edge_counts(since(lineage, as_of, days)), space_tables, k)


# ---- co-access --------------------------------------------------------------------------------
def access_sessions(audit: DataFrame) -> DataFrame:
    """Distinct (user, day, table) of table reads."""
    return (
        audit.where((F.col("action_name") == "getTable") & F.col("table_name").isNotNull())
        .select(F.col("user_email").alias("user"), F.to_date("event_time").alias("day"), "table_name")
        .distinct()
    )


def _pairs(rows: DataFrame, group: list[str], n: Column, block_rows: int, *carried: str) -> DataFrame:
    """Pairs of ``table_name`` within ``group``, each once; of ``carried`` columns, both tables' values.

    A group of ``n`` tables is cut into blocks, and every two blocks meet in their own cell, so a user
    who reads very many tables in a day is spread over many tasks and no task pairs more than two blocks.
    """
    n_blocks = F.ceil(n / block_rows).cast("int")
    placed = rows.withColumn("block", F.pmod(F.xxhash64("table_name"), n_blocks).cast("int"))
    cells = F.transform(
        F.sequence(F.lit(0), n_blocks - 1),
        lambda other: F.struct(
            F.least("block", other).alias("lo"), F.greatest("block", other).alias("hi")
        ),
    )
    placed = placed.withColumn("cell", F.explode(cells)).select("*", "cell.lo", "cell.hi").drop("cell")
    a = placed.withColumnsRenamed({"table_name": "table_a", "block": "block_a"} | {c: f"{c}_a" for c in carried})
    b = placed.select(
        *group, "lo", "hi", F.col("table_name").alias("table_b"), F.col("block").alias("block_b"),
        *[F.col(c).alias(f"{c}_b") for c in carried],
    )
    met = a.join(b, [*group, "lo", "hi"])
    return met.where(
        (F.col("table_a") < F.col("table_b"))
        & ((F.col("lo") == F.col("hi")) | (F.col("block_a") != F.col("block_b")))
    )


def session_pairs(sessions: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs of tables read by the same user on the same day."""
    sizes = sessions.groupBy("user", "day").agg(F.count("*").alias("n")).where("n > 1")
    rows = sessions.join(sizes, ["user", "day"])
    return _pairs(rows, ["user", "day"], F.col("n"), block_rows).select(
        "user", "day", "table_a", "table_b"
    )


def _folded(sessions: DataFrame, *more: Column) -> DataFrame:
    """User-days that read several tables, those with the same set of tables as one with a ``weight``.

    Scheduled jobs read the same tables day after day; pairing each such set once removes most of the pairs. ``more``
    are further aggregates that depend on the tables alone.
    """
    shape = sessions.groupBy("user", "day").agg(
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("table_name")).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit("second"), "table_name")).alias("h2"),
        F.min("table_name").alias("least"),
        *more,
    )
    kept = [c for c in shape.columns if c not in ("user", "day", "h1", "h2", "least")]
    sets = shape.where("n > 1").groupBy("h1", "h2", "least", *kept)
    folded = sets.agg(F.min(F.struct("user", "day")).alias("rep"), F.count("*").alias("weight"))
    return folded.select("rep.user", "rep.day", *kept, "weight")


def pair_counts(sessions: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Number of user-days in which two tables were read together."""
    rows = sessions.join(_folded(sessions), ["user", "day"])
    return (
        _pairs(rows, ["user", "day"], F.col("n"), block_rows)
        .groupBy("table_a", "table_b")
        .agg(F.sum("weight").alias("n_sessions"))
    )


def pairs_by_space(pairs: DataFrame, space_tables: DataFrame) -> DataFrame:
    """Pair counts for every space that holds both tables.

    Each pair is looked up through whichever of its tables is in fewer spaces.
    """
    members = space_tables.select("space_id", "table_id").distinct()
    spread = members.groupBy("table_id").agg(F.count("*").alias("n_spaces"))
    sized = pairs.join(
        spread.withColumnsRenamed({"table_id": "table_a", "n_spaces": "spaces_a"}), "table_a"
    ).join(spread.withColumnsRenamed({"table_id": "table_b", "n_spaces": "spaces_b"}), "table_b")
    return _placed(sized, members)


def _placed(sized: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs with ``spaces_a`` and ``spaces_b``, in the spaces that hold both tables."""
    a_rarer = F.col("spaces_a") <= F.col("spaces_b")
    sided = sized.select(
        "table_a",
        "table_b",
        "n_sessions",
        F.when(a_rarer, F.col("table_a")).otherwise(F.col("table_b")).alias("table_id"),
        F.when(a_rarer, F.col("table_b")).otherwise(F.col("table_a")).alias("other"),
    )
    return (
        sided.join(members, "table_id")
        .join(members.withColumnRenamed("table_id", "other"), ["space_id", "other"], "left_semi")
        .select("space_id", "table_a", "table_b", "n_sessions")
    )


def member_pairs(sessions: DataFrame, members: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Counts of all pairs of tables that share a space: ``space_id, table_a, table_b, n_sessions``.

    ``members(space_id, table_id)`` are distinct. A user-day's tables are paired and the pairs looked up in the spaces of
    their rarer table, or the user-day is taken to all places that its tables have in spaces, whichever is less. For the
    latter each table has a list of the numbers of its user-days (of one weight, and cut by number so that no list is
    long); lists, not rows, go to the spaces, and a pair's count is what its two lists share.
    """
    spread = members.groupBy(F.col("table_id").alias("table_name")).agg(F.count("*").alias("spaces"))
    known = sessions.join(spread, "table_name")
    folded = _folded(known, F.sum("spaces").alias("reach"), F.sum(F.sqrt("spaces")).alias("root"))
    folded = staged(folded.withColumn("visit", F.monotonically_increasing_id()), "user-days")
    # A pair has no more places to be looked up than the root of the product of its tables' places.
    lookups = (F.col("root") * F.col("root") - F.col("reach")) / 2
    within = F.col("n") * (F.col("n") - 1) / 2 + lookups > F.col("reach")
    by_day = known.join(folded.where(~within), ["user", "day"])
    # A pair's tables carry their spread, so that it need not be joined again.
    by_day = _pairs(by_day, ["user", "day"], F.col("n"), block_rows, "spaces")
    by_day = by_day.groupBy("table_a", "table_b", "spaces_a", "spaces_b").agg(F.sum("weight").alias("n_sessions"))
    found = _placed(by_day, members)
    if folded.where(within).isEmpty():
        return found
    most = sessions.groupBy("table_name").agg(F.count("*").alias("reads")).agg(F.max("reads")).first()[0]
    visits = known.join(folded.where(within).select("user", "day", "visit", "weight"), ["user", "day"])
    bucket = F.pmod(F.xxhash64("visit"), F.lit(-(-most // LISTED)))
    lists = visits.groupBy("table_name", "weight", bucket.alias("bucket")).agg(F.collect_list("visit").alias("visits"))
    sizes = members.groupBy("space_id").agg(F.count("*").alias("n")).where("n > 1")
    placed = members.join(sizes, "space_id").withColumnRenamed("table_id", "table_name").join(lists, "table_name")
    shared = F.size(F.array_intersect("visits_a", "visits_b"))
    by_space = _pairs(placed, ["space_id", "weight", "bucket"], F.col("n"), block_rows, "visits").withColumn("shared", shared)
    by_space = by_space.where("shared > 0").groupBy("space_id", "table_a", "table_b")
    found = found.unionByName(by_space.agg(F.sum(F.col("shared") * F.col("weight")).alias("n_sessions")))
    return found.groupBy("space_id", "table_a", "table_b").agg(F.sum("n_sessions").alias("n_sessions"))


def top_pairs(space_pairs: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most frequent pairs of each space."""
    return ranked(space_pairs, ["space_id"], [F.desc("n_sessions"), "table_a", "table_b"], k)


def busiest_pairs(sessions: DataFrame, space_tables: DataFrame, k: int = 10, first: int | None = None) -> DataFrame:
    """The ``k`` most frequent pairs of each space, found without pairing its other tables.

    A pair is read together no more often than the less read of its tables. The ``first`` busiest tables of each space
    (2 ``k`` unless given) are paired; where the next table is read less often than the k-th best pair, no other pair
    can enter. Elsewhere all tables read as often as the k-th best pair are paired, or sixteen times as many of the
    busiest while there are fewer than ``k`` pairs. Of pairs with equal counts those first in order of names are kept,
    so a tie with the next table is settled if the k-th pair starts with the least name and ends before that table's.
    """
    first = first or 2 * k
    members = staged(space_tables.select("space_id", "table_id").distinct(), "members")
    tables = members.select(F.col("table_id").alias("table_name")).distinct()
    sessions = staged(sessions.join(tables, "table_name", "left_semi"), "sessions")
    reads = sessions.groupBy(F.col("table_name").alias("table_id")).agg(F.count("*").alias("reads"))
    left = members.join(reads, "table_id")
    out = few = None
    while True:
        order = [F.desc("reads"), "table_id"]
        if few is None:
            few = ranked(left, ["space_id"], order, first + 1)
        else:  # more of the busiest, or all that are read as often as the last of enough pairs
            left = left.join(open_spaces, "space_id")
            more = ranked(left.where("kth_reads = 0"), ["space_id"], order, first + 1)
            few = more.unionByName(left.where("kth_reads > 0 and reads >= kth_reads").withColumn("rank", F.lit(0))).drop("kth_reads")
            left = left.drop("kth_reads")
        few = staged(few, "busiest")
        chosen = few.where(F.col("rank") <= first)
        top = staged(top_pairs(member_pairs(sessions, chosen.select("space_id", "table_id")), k), "pairs")
        last = top.where(F.col("rank") == k).select("space_id", F.struct("n_sessions", "table_a", "table_b").alias("kth"))
        after = few.where(F.col("rank") == first + 1).join(last, "space_id", "left")
        after = after.join(chosen.groupBy("space_id").agg(F.min("table_id").alias("least")), "space_id")
        count = F.coalesce("kth.n_sessions", F.lit(0))
        settled = (F.col("reads") < count) | (
            (F.col("reads") == count) & (F.col("kth.table_a") == F.col("least")) & (F.col("kth.table_b") < F.col("table_id"))
        )
        unsettled = after.where(~F.coalesce(settled, F.lit(False))).select("space_id", count.alias("kth_reads"))
        if unsettled.isEmpty():
            return top if out is None else out.unionByName(top)
        open_spaces = staged(unsettled, "open")
        done = top.join(open_spaces, "space_id", "left_anti")
        out = done if out is None else out.unionByName(done)
        first *= 16


def coaccess_pairs(
    audit: DataFrame, space_tables: DataFrame, as_of: str, days: int = 90, k: int = 10
) -> DataFrame:
    """Top co-accessed pairs per space over the trailing window."""
    return busiest_pairs(access_sessions(since(audit, as_of, days)), space_tables, k)


def sample_audit(audit: DataFrame, rows: int | None = None) -> DataFrame:
    """First rows by user, day and table; all rows unless a number is given."""
    if rows is None:
        return audit
    return audit.orderBy("user_email", F.to_date("event_time"), "table_name", "event_time").limit(rows)
