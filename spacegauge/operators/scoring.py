"""Area scores, totals and the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spacegauge.functions import rules as R
from spacegauge.functions.text import kept
from spacegauge.operators import config_lint as C
from spacegauge.operators import curation, metadata, questions, readiness
from spacegauge.operators.findings import alignment_gaps_expr


def area_label(score: Column) -> Column:
    return F.when(score == 3, R.LABELS[3]).when(score == 2, R.LABELS[2]).otherwise(R.LABELS[1])


def area_name(area: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in R.AREAS.values()]), area + 1)


def configuration_expr() -> Column:
    score = C.config_expr(F.col("sql_sub"), F.col("text_sub"))
    return F.when((score == 3) & (F.size(alignment_gaps_expr()) > 0), 2).otherwise(score)


def with_scores(facts: DataFrame) -> DataFrame:
    """Add the scores of the six areas, ``score_0`` to ``score_5``, to the wide row of each space."""
    col = F.col
    sub = facts.withColumns(
        {
            "sql_sub": C.sql_sub_expr(col("sql"), C.covered_expr(), col("n_unknown")),
            "text_sub": C.text_sub_expr(),
        }
    )
    return sub.withColumns(
        {
            "score_0": readiness.readiness_expr(readiness.structure_expr()),
            "score_1": curation.budget_expr(col("base_count")),
            "score_2": metadata.metadata_expr(col("pct"), col("n_coded"), col("n_date_string"), col("n_thin")),
            "score_3": configuration_expr(),
            "score_4": questions.covered_sample_expr(col("samples"), col("n_uncovered"), col("table_count")),
            "score_5": questions.benchmark_expr(col("benchmarks")),
        }
    )


def area_scores(scored: DataFrame) -> DataFrame:
    """One row per space and area: ``space_id, area, score, label``."""
    rows = F.array(
        *[F.struct(F.lit(a).alias("area"), F.col(f"score_{a}").alias("score")) for a in R.AREAS]
    )
    return scored.select("space_id", F.inline(rows)).withColumn("label", area_label(F.col("score")))


def score_totals(area_scores: DataFrame) -> DataFrame:
    """Total, possible total and share of each space over its rated areas."""
    rated = F.col("score").isNotNull()
    return area_scores.groupBy("space_id").agg(
        F.sum("score").alias("total"), (F.count_if(rated) * R.MAX_AREA_SCORE).alias("max_total")
    ).withColumn("pct", F.coalesce(F.try_divide("total", "max_total"), F.lit(0.0)))


def verdict_expr(pct: Column) -> Column:
    return F.when(pct >= R.READY_FROM, R.READY).when(pct >= R.IMPROVE_FROM, R.IMPROVE).otherwise(R.REBUILD)


def verdict(area_scores: DataFrame) -> DataFrame:
    return score_totals(area_scores).withColumn("verdict", verdict_expr(F.col("pct")))


def blockers_of(area_scores: DataFrame) -> DataFrame:
    """Names of the critical areas that score 1, in order of area; at most three per space."""
    poor = (F.col("score") == 1) & F.col("area").isin(*R.BLOCKER_AREAS)
    picked = F.sort_array(F.collect_list(F.when(poor, F.struct("area", area_name(F.col("area")).alias("name")))))
    return area_scores.groupBy("space_id").agg(F.transform(picked, lambda p: p["name"]).alias("blockers"))


def cap_expr(verdict: Column, blockers: Column) -> Column:
    return F.when((verdict == R.READY) & (F.size(blockers) > 0), R.IMPROVE).otherwise(verdict)


def capped_verdict(verdict: DataFrame, area_scores: DataFrame) -> DataFrame:
    """Verdict, lowered from the best to the middle one where a critical area is poor."""
    return verdict.join(blockers_of(area_scores), "space_id").select(
        "space_id", cap_expr(F.col("verdict"), F.col("blockers")).alias("verdict"), "blockers"
    )


def with_totals(scored: DataFrame) -> DataFrame:
    """Add total, share, verdict and the critical areas that are poor, from the six scores of the row."""
    total = sum((F.col(f"score_{a}") for a in list(R.AREAS)[1:]), F.col("score_0"))
    blockers = kept(*[F.when(F.col(f"score_{a}") == 1, F.lit(R.AREAS[a])) for a in R.BLOCKER_AREAS])
    rated = scored.withColumns(
        {"total": total, "max_total": F.lit(R.MAX_AREA_SCORE * len(R.AREAS)), "blockers": blockers}
    ).withColumn("pct_total", F.col("total") / F.col("max_total"))
    uncapped = verdict_expr(F.col("pct_total"))
    return rated.withColumns(
        {
            "verdict": cap_expr(uncapped, F.col("blockers")),
            "is_capped": (uncapped == R.READY) & (F.size("blockers") > 0),
        }
    )


def scorecard(scored: DataFrame) -> DataFrame:
    """One row per space with its six scores, total and capped verdict; nothing is shuffled."""
    return with_totals(scored).select(
        "space_id",
        "title",
        *[f"score_{a}" for a in R.AREAS],
        "total",
        "max_total",
        F.col("pct_total").alias("pct"),
        "verdict",
        "blockers",
    )


def needs_domain_split(area_scores: DataFrame, schema_spread: DataFrame) -> DataFrame:
    """Spaces whose curation is below good, or whose tables come from several schemas."""
    weak = area_scores.where("area = 1 and score < 3").select("space_id")
    return weak.unionByName(schema_spread.where("n_schemas > 1").select("space_id")).distinct()
