"""The whole audit: facts, scores, findings, next steps and reports of every space."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spacegauge.functions import rules as R
from spacegauge.functions import text as X
from spacegauge.operators import findings as FD
from spacegauge.operators import config_lint, metadata, recommend, scoring, usage
from spacegauge.operators.findings import Sql, col, joined, say
from spacegauge.plans.facts import Estate, column_items, space_facts, space_items
from spacegauge.sources import readers, sinks
from spacegauge.sources.staging import scratch, staged


def scored_facts(estate: Estate, strict_compat: bool = False, items: DataFrame | None = None) -> DataFrame:
    """The wide row of every space with its scores."""
    return scoring.with_scores(space_facts(estate, strict_compat, items))


def scorecard(estate: Estate, strict_compat: bool = False) -> DataFrame:
    """Scores and verdict of every space."""
    return scoring.scorecard(scored_facts(estate, strict_compat))


def staged_facts(estate: Estate, strict_compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """Names behind the findings, and the scored wide rows that show them, each written once.

    A lost executor costs the step it was in and not the audit.
    """
    items = staged(space_items(estate, strict_compat), "items")
    return items, staged(scored_facts(estate, strict_compat, items), "facts")


def _area_lines(area: int, name: str) -> str:
    found, steps = FD.messages(area), recommend.steps(area)
    title = say(f"### {area}. {name}: ", _label(area), " (", col(f"score_{area}"), "/3)")
    return (
        f"array({title}), "
        f"if(size({found}) = 0, array('No issues found.'), transform({found}, x -> concat('- ', x))), "
        f"if(size({steps}) = 0, {X.NO_ARRAY}, concat(array('', '**Next steps:**'), transform({steps}, x -> concat('- ', x)))), "
        "array('')"
    )


def _label(area: int) -> Sql:
    levels = " ".join(f"when {score} then '{label}'" for score, label in R.LABELS.items())
    return Sql(f"case score_{area} {levels} end")


def _report(scored: DataFrame, run_date: str) -> DataFrame:
    """Each space with its report as an array of lines; made of its own row only, so nothing is shuffled."""
    total = say(col("total"), "/", col("max_total"))
    reason = say(": critical areas are poor: ", joined("blockers", ", "))
    lines = [
        say("# Assessment: ", Sql("title")),
        say(f"**Date:** {run_date}  |  **Space:** ", col("space_id"), "  |  **Score:** ", total),
        say(""),
        say("> ", Sql("verdict"), Sql(f"if(is_capped, {reason}, '')")),
        say(""),
        say("## Scorecard"),
        say(""),
        say("| Area | Score | Rating |"),
        say("|------|-------|--------|"),
        *[
            say(f"| {area}. {name} | ", col(f"score_{area}"), "/3 | ", _label(area), " |")
            for area, name in R.AREAS.items()
        ],
        say("| **TOTAL** | **", total, "** | |"),
        say(""),
        say("## Assessment by Area"),
        say(""),
    ]
    areas = ", ".join(_area_lines(area, name) for area, name in R.AREAS.items())
    return scoring.with_totals(scored).selectExpr("space_id", "title", f"concat(array({', '.join(lines)}), {areas}) as lines")


def report_lines(scored: DataFrame, run_date: str) -> DataFrame:
    """Reports line by line: ``space_id, line_no, line``."""
    return _report(scored, run_date).select("space_id", F.posexplode("lines").alias("line_no", "line"))


def report_rows(scored: DataFrame, run_date: str, folder: str = "") -> DataFrame:
    """One document per space with the path it belongs under, made of its title and the date."""
    path = F.concat(F.lit(folder), X.safe_key(F.col("title")), F.lit(f"_{run_date}.md"))
    return _report(scored, run_date).select(
        "space_id", path.alias("path"), F.array_join("lines", "\n").alias("document")
    )


def run(
    estate: Estate,
    out: str,
    run_date: str,
    strict_compat: bool = False,
    lineage: DataFrame | None = None,
    audit: DataFrame | None = None,
) -> DataFrame:
    """Audit every space; write scorecard, area ratings, findings with their names, next steps, pattern gaps, spaces to
    split, digests in pieces and reports under ``out``, and where there is lineage or audit, what it tells of use.

    Returns the written scorecard. What is staged on the way is removed.
    """
    with scratch(estate.spaces.sparkSession):
        _written(estate, out, run_date, strict_compat, lineage, audit)
    return estate.spaces.sparkSession.read.parquet(f"{out}/scorecard").where(F.col("run_date") == F.lit(run_date).cast("date"))


def _written(
    estate: Estate, out: str, run_date: str, strict_compat: bool, lineage: DataFrame | None, audit: DataFrame | None
) -> None:
    items, scored = staged_facts(estate, strict_compat)
    tables = estate.space_tables
    flags = config_lint.pattern_flags(readers.sql_instructions(estate.instructions))
    sinks.write_table(scoring.area_scores(scored), f"{out}/area_scores", run_date)
    sinks.write_table(config_lint.pattern_gaps(scored, flags), f"{out}/pattern_gaps", run_date)
    split = scoring.needs_domain_split(scoring.area_scores(scored), scored.select("space_id", "n_schemas"))
    sinks.write_table(split, f"{out}/domain_splits", run_date)
    digests = metadata.digest_pieces(tables, estate.tables, estate.columns)
    sinks.write_table(digests, f"{out}/digest_pieces", run_date)
    if lineage is not None:
        sinks.write_table(usage.lineage_edges(lineage, tables, run_date), f"{out}/lineage_edges", run_date)
    if audit is not None:
        sinks.write_table(usage.coaccess_pairs(audit, tables, run_date), f"{out}/coaccess_pairs", run_date)
    sinks.write_scorecard(scoring.scorecard(scored), f"{out}/scorecard", run_date)
    sinks.write_findings(FD.findings(scored), f"{out}/findings", run_date)
    sinks.write_table(items, f"{out}/finding_items", run_date)
    sinks.write_table(column_items(estate.columns), f"{out}/column_items", run_date)
    sinks.write_recommendations(recommend.area_items(scored), f"{out}/recommendations", run_date)
    sinks.write_reports(report_rows(scored, run_date), f"{out}/reports", run_date)
