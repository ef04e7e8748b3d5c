"""Areas 4 and 5: sample questions, their coverage of tables, and benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spacegauge.functions import rules as R
from spacegauge.functions import text as X
from spacegauge.operators import joins as J
from spacegauge.operators.findings import alignment_gaps_expr, area_findings
from spacegauge.operators.texts import joint_hits, joints


def samples(questions: DataFrame) -> DataFrame:
    return questions.where(F.col("question_type") == "SAMPLE_QUESTION")


def benchmarks(questions: DataFrame) -> DataFrame:
    return questions.where(F.col("question_type") == "BENCHMARK")


def sample_expr(n: Column) -> Column:
    return F.when(n >= 10, 3).when(n >= 5, 2).otherwise(1)


def benchmark_expr(n: Column) -> Column:
    return F.when(n >= 15, 3).when(n >= 5, 2).otherwise(1)


def sample_score(counts: DataFrame) -> DataFrame:
    return counts.select("space_id", sample_expr(F.col("samples")).alias("score"))


def benchmark_score(counts: DataFrame) -> DataFrame:
    return counts.select("space_id", benchmark_expr(F.col("benchmarks")).alias("score"))


def sample_findings(counts: DataFrame) -> DataFrame:
    return area_findings(counts, 4, ("no_samples", "few_samples", "sample_diversity")).select("space_id", "message")


def benchmark_findings(counts: DataFrame) -> DataFrame:
    return area_findings(counts, 5, ("no_benchmarks", "few_benchmarks", "some_benchmarks")).select("space_id", "message")


def question_joint_asks(sample_questions: DataFrame) -> DataFrame:
    """Wording that only shows where two neighbouring questions meet."""
    sides = joints(
        sample_questions.withColumn("text", F.lower("question_text")), "space_id", ["question_id"], "text", " ",
        skip_blank=False,
    )
    return sides.select(
        "space_id", *[(joint_hits(rule, " ") > 0).alias(n) for n, rule in R.QUESTION_PATTERNS.items()]
    )


def question_asks(questions: DataFrame) -> DataFrame:
    """What the sample questions of a space ask for, read as one text."""
    rows = samples(questions).select("space_id", "question_id", "question_text")
    asked = rows.select(
        "space_id",
        *[F.expr(rule.hit_sql("lower(question_text)")).alias(n) for n, rule in R.QUESTION_PATTERNS.items()],
    )
    return (
        asked.unionByName(question_joint_asks(rows))
        .groupBy("space_id")
        .agg(*[F.bool_or(n).alias(n) for n in R.QUESTION_PATTERNS])
    )


def uncovered_tables(space_tables: DataFrame, questions: DataFrame) -> DataFrame:
    """Tables no sample question mentions, in spaces with three questions and two tables at least."""
    asked = samples(questions).select("space_id", "question_text")
    enough = (
        asked.groupBy("space_id")
        .agg(F.count("*").alias("n"))
        .where("n >= 3")
        .join(space_tables.groupBy("space_id").agg(F.count("*").alias("t")).where("t >= 2"), "space_id")
        .select("space_id")
    )
    members = space_tables.join(enough, "space_id", "left_semi")
    mentioned = J.question_mentions(J.name_variants(members, shortest=True), asked)
    return members.join(mentioned, ["space_id", "table_id"], "left_anti").select("space_id", "table_id")


def covered_sample_expr(samples: Column, n_uncovered: Column, table_count: Column) -> Column:
    """Sample score, lowered from good where half the tables, and two at least, are never mentioned."""
    score = sample_expr(samples)
    half = F.greatest(F.lit(2), F.floor(table_count / 2))
    return F.when((score == 3) & (n_uncovered >= half), 2).otherwise(score)


def covered_sample_score(counts: DataFrame, uncovered: DataFrame) -> DataFrame:
    n = uncovered.groupBy("space_id").agg(F.count("*").alias("n"))
    joined = counts.select("space_id", "samples", "table_count").join(n, "space_id", "left").na.fill(0, ["n"])
    return joined.select(
        "space_id", covered_sample_expr(F.col("samples"), F.col("n"), F.col("table_count")).alias("score")
    )


def missing_gold_sql(questions: DataFrame) -> DataFrame:
    """Number of benchmarks without an expected SQL, for spaces that have any."""
    return (
        benchmarks(questions)
        .where(X.is_blank(F.col("answer_text")))
        .groupBy("space_id")
        .agg(F.count("*").alias("n"))
    )


def hardcoded_gold_sql(questions: DataFrame) -> DataFrame:
    return benchmarks(questions).where(R.HARDCODED_GOLD_SQL.hit(F.col("answer_text"))).select(
        "space_id", F.substring("question_text", 1, 50).alias("question_text")
    )


def question_alignment(questions: DataFrame, flags: DataFrame, counts: DataFrame) -> DataFrame:
    """Kinds of question a space features without an example SQL of that kind."""
    facts = (
        counts.select("space_id", "samples", "table_count")
        .join(question_asks(questions), "space_id")
        .join(flags, "space_id", "left")
        .na.fill(False)
    )
    return facts.select("space_id", F.explode(alignment_gaps_expr()).alias("gap"))
