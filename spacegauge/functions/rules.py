"""The rule book: every pattern, word list and threshold the audit uses, stated as data.

A :class:`Rule` is a named regular expression that turns into a built-in Spark
expression, so rules run inside whole-stage codegen and never in Python.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """A regular expression with ``i``/``m``/``s`` flags; Unicode classes and ``\\n``-only lines always on.

    ``needs`` are lower-case strings of which any text it matches holds one; they spare most texts the expression.
    """

    name: str
    pattern: str
    flags: str = "i"
    needs: tuple[str, ...] = ()

    @property
    def regex(self) -> str:
        return f"(?uUd{self.flags}){self.pattern}"

    def hit(self, text: Column) -> Column:
        return F.coalesce(text, F.lit("")).rlike(self.regex)

    def count(self, text: Column) -> Column:
        return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(self.regex))

    # The same as SQL text: a projection of many rules is parsed in one call that way. ``low`` names the text made by
    # :func:`lowered`; where it lacks what the rule needs, the expression is not tried.
    def hit_sql(self, text: str, low: str | None = None) -> str:
        return self._tried(f"(coalesce({text}, '') rlike r\"{self.regex}\")", "false", low)

    def count_sql(self, text: str, low: str | None = None) -> str:
        return self._tried(f"regexp_count(coalesce({text}, ''), r\"{self.regex}\")", "0", low)

    def _tried(self, found: str, nothing: str, low: str | None) -> str:
        if low is None or not self.needs:
            return found
        held = " or ".join(f"contains({low}, '{need}')" for need in self.needs)
        return f"if(not ({held}), {nothing}, {found})"

    def find_all(self, text: Column, group: int = 0) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.regex), F.lit(group))


def lowered(text: str) -> str:
    """Lower-case text as SQL, by which rules are spared; null, which spares none, where letters may not be ASCII."""
    return f"if(octet_length({text}) = length({text}), lower({text}), null)"


# ---- Fixed values: scores and labels ----------------------------------------------------------
LABELS = {3: "Good", 2: "OK", 1: "Poor"}
SEVERITIES = {1: "CRITICAL", 2: "IMPROVE"}
AREAS = {
    0: "Data Readiness",
    1: "Table & Space Curation",
    2: "Metadata Quality",
    3: "Instructions Configuration",
    4: "Sample Questions",
    5: "Benchmarks",
}
BLOCKER_AREAS = (0, 2, 5)
MAX_AREA_SCORE = 3
READY_FROM, IMPROVE_FROM = 0.83, 0.61
READY, IMPROVE, REBUILD = "PRODUCTION READY", "NEEDS IMPROVEMENT", "RECOMMEND REBUILD"

# ---- Fixed values: metadata of tables ---------------------------------------------------------
KEY_CONSTRAINTS = ("PRIMARY KEY", "FOREIGN KEY")
GRANTING_ACTIONS = ("SELECT", "ALL_PRIVILEGES")
NON_GOLD_KEYWORDS = ("raw", "bronze", "silver", "landing", "staging", "ingest", "stg_", "ods_")
LAYER_TAG_KEYS = ("layer", "data_tier", "medallion_layer", "data_layer")
NON_GOLD_TAG_VALUES = ("bronze", "silver", "raw", "landing", "staging", "ingest")
STRING_TYPES = ("STRING", "VARCHAR", "CHAR")
WIDE_TABLE_COLUMNS = 50
THIN_COMMENT_CHARS = 50
SHORT_DESCRIPTION_CHARS = 80
LONG_BLOCK_CHARS = 800
MAX_TEXT_LINES = 100
DESCRIPTION_ELEMENTS = {
    "metrics": "what is measured",
    "dimensions": "what it is broken down by",
    "grain": "what a row stands for and how fresh it is",
    "users": "who it is for",
}

NON_GOLD_NAME = Rule("non_gold_name", "|".join(NON_GOLD_KEYWORDS))
GENERIC_COMMENT = Rule(
    "generic_comment",
    r"\bPK\b|\bFK\b|foreign key|primary key|stores the|references the|surrogate key",
)
CODED_NAME = Rule("coded_name", r"(status|type|code|flag|indicator|category|tier|class|mode|state)$")
VALUE_DICTIONARY = Rule("value_dictionary", r"\w+=\w+|\bY/N\b|\btrue/false\b")
DATE_NAME = Rule("date_name", r"date|timestamp|time|_at$|_on$|_dt$")
TECHNICAL_NAME = Rule(
    "technical_name",
    r"(_cd|_flg|_ind|_nr|_nbr|_no|_amt|_qty|_dsc|_tp|_typ|_grp|_ctgry|_cat|_val|_pct|_fg)$",
)
ABBREVIATION_TOKEN = Rule("abbreviation_token", r"^\p{L}{2,5}$", "")

# Short column-name words that are not business abbreviations.
COMMON_SHORT_WORDS = (
    "id", "is", "at", "by", "on", "in", "of", "to", "no", "up",
    "dt", "ts", "key", "val", "num", "seq", "ref", "cnt", "max",
    "min", "avg", "sum", "pct", "amt", "qty", "date", "time",
    "name", "type", "code", "flag", "rank", "rate", "tier", "area",
    "note", "text", "desc", "json", "uuid", "hash", "user", "role",
    "item", "unit", "cost", "size", "list", "last", "next", "prev",
    "from", "true", "null", "data", "info", "meta", "tags", "src",
    "raw", "new", "old", "all", "any", "end", "set", "map", "log",
    "agent", "event", "label", "score", "state", "count", "total",
    "start", "stop", "level", "order", "index", "value", "error",
    "limit", "group", "owner", "batch", "token", "model", "class",
)

# Full terms of well-known abbreviations.
ABBREVIATION_LABELS = {
    "rm": "Relationship Manager",
    "kpi": "Key Performance Indicator",
    "aum": "Assets Under Management",
    "nps": "Net Promoter Score",
    "arr": "Annual Recurring Revenue",
    "mrr": "Monthly Recurring Revenue",
    "ltv": "Lifetime Value",
    "cac": "Customer Acquisition Cost",
    "ytd": "Year-to-Date",
    "mtd": "Month-to-Date",
    "qtd": "Quarter-to-Date",
    "yoy": "Year-over-Year",
    "mom": "Month-over-Month",
    "qoq": "Quarter-over-Quarter",
    "ebitda": "EBITDA",
    "roe": "Return on Equity",
    "roa": "Return on Assets",
    "nim": "Net Interest Margin",
    "fum": "Funds Under Management",
    "nav": "Net Asset Value",
    "glp": "Gross Loan Portfolio",
    "npl": "Non-Performing Loan",
    "nrr": "Net Revenue Retention",
    "mfa": "Multi-Factor Authentication",
    "sku": "Stock Keeping Unit",
    "gmv": "Gross Merchandise Value",
    "aov": "Average Order Value",
    "dau": "Daily Active Users",
    "mau": "Monthly Active Users",
    "ctr": "Click-Through Rate",
    "cvr": "Conversion Rate",
    "rpm": "Revenue Per Mille",
    "cpv": "Cost Per View",
}

# ---- Fixed values: SQL text rules -------------------------------------------------------------
HARDCODED_SQL = Rule("hardcoded", r"= '[A-Z0-9]{4,}'|WHERE \w+ = '[^']{1,30}'|= \d{5,}", "", ("= ",))
HARDCODED_GOLD_SQL = Rule("hardcoded_gold", r"= '[A-Z0-9]{4,}'|WHERE \w+ = '\w+'|= \d{5,}", "")
PARAMETER = Rule("parameter", r":\w+|\{\{.*?\}\}|getArgument\(", "", (":", "{{", "getargument("))
SQL_PATTERNS = {
    "has_join": Rule("join", r"\bJOIN\b", needs=("join",)),
    "has_date": Rule(
        "date",
        r"\b(date|timestamp|month|year|quarter|period|week)\b",
        needs=("date", "timestamp", "month", "year", "quarter", "period", "week"),
    ),
    "has_agg": Rule(
        "agg", r"\b(SUM|COUNT|AVG|MAX|MIN|GROUP BY)\b", needs=("sum", "count", "avg", "max", "min", "group by")
    ),
    "has_topn": Rule("topn", r"\bORDER\s+BY\b.{1,200}\bLIMIT\s+\d+", "is", ("limit",)),
    "has_compare": Rule(
        "compare",
        r"\bLAG\s*\(|prior[_\s]period|year.over.year|yoy\b|previous[_\s]*(month|quarter|year)|"
        r"period.over.period|pop\b|mom\b|qoq\b",
        needs=("lag", "period", "year", "yoy", "previous", "pop", "mom", "qoq"),
    ),
}
PLACEHOLDER = Rule("placeholder", r"[\[\{].*?[\]\}]", "")
# References after FROM / JOIN and names defined by WITH: the narrow forms see one plain name and the
# first name only; the full forms also read quoted multi-part names and every name of a WITH list.
TABLE_REF_NARROW = Rule("table_ref_narrow", r"\b(?:FROM|JOIN)\s+([`]?[\w.]+[`]?)")
TABLE_REF_FULL = Rule("table_ref_full", r"\b(?:FROM|JOIN)\s+((?:`[^`]+`|\w+)(?:\.(?:`[^`]+`|\w+))*)")
CTE_NARROW = Rule("cte_narrow", r"\bWITH\b\s+(\w+)\s+AS\s*\(")
CTE_FULL = Rule("cte_full", r"(?:\bWITH\b(?:\s+RECURSIVE\b)?|,)\s*`?(\w+)`?\s+AS\s*\(")
FUNCTION_FROM = Rule("function_from", r"\b(?:EXTRACT|TRIM|SUBSTRING|OVERLAY)\s*\([^()]*?\bFROM\b")

AGGREGATE_CALL = Rule("aggregate_call", r"\b(SUM|COUNT|AVG|MAX|MIN|try_divide)\s*\(")
CONDITION = Rule("condition", r"\bWHERE\b|\bAND\b|\bOR\b|=\s*'")

# ---- Fixed values: prose rules ----------------------------------------------------------------
METRIC_PROSE = Rule(
    "metric_prose",
    r"\bsum\s+of\b|\bdivided\s+by\b|(?:revenue|profit|margin)\s*[=:]|\bSUM\s*\(|\bCOUNT\s*\(",
    needs=("sum", "divided", "revenue", "profit", "margin", "count"),
)
JOIN_PROSE = Rule(
    "join_prose",
    r"\b(?:join|link|connect|relat)\w*\b.{0,50}\btable\b|\bforeign\s+key\b|\brelates?\s+to\b",
    needs=("table", "foreign", "relate"),
)
VAGUE = Rule(
    "vague",
    r"\bconsider\b|\btry\s+to\b|\bif\s+possible\b|\bhandle\s+null|\bask\s+follow.up\b|\byou\s+might\b",
    needs=("consider", "try", "possible", "handle", "follow", "might"),
)
DIRECTIVE = Rule(
    "directive",
    r"^[\s*\-•]*(?:when\b|always\b|never\b|if\s+(?:a\s+)?user|do\s+not\b)",
    "im",
    ("when", "always", "never", "user", "not"),
)
SECTIONS = {
    "role / behavior": Rule("sec_role", r"^\s*#+.*(role|behav|context|overview|about)\b", "im", ("#",)),
    "critical rules": Rule("sec_rules", r"^\s*#+.*(critical|rule|filter|default|must|always)\b", "im", ("#",)),
    "business terms": Rule(
        "sec_terms", r"^\s*#+.*(term|synonym|glossary|definition|abbreviation|business)\b", "im", ("#",)
    ),
    "date handling": Rule("sec_dates", r"^\s*#+.*(date|time|period|fiscal|calendar)\b", "im", ("#",)),
}
INLINE_SQL = Rule("inline_sql", r"\bSELECT\b.{5,200}\bFROM\b", "is", ("select",))
EMPHATIC = Rule("emphatic", r"\*\*\s*(CRITICAL|IMPORTANT|ALWAYS|NEVER|MUST|WARNING)\b.*?\*\*|!!+\s*\w", needs=("**", "!!"))
SCHEMA_DUMP_RULES = tuple(
    Rule(f"schema_{i}", p, needs=(need,))
    for i, (p, need) in enumerate(
        (
            (r"\bFK\b", "fk"),
            (r"foreign key", "foreign key"),
            (r"primary key", "primary key"),
            (r"\bSCHEMA\b", "schema"),
            (r"field uses codes", "field uses codes"),
            (r"This table", "this table"),
            (r"stores all", "stores all"),
            (r"references the", "references the"),
            (r"This \w+ space contains", "space contains"),
            (r"The following tables", "the following tables"),
        )
    )
)
BUSINESS_RULES = tuple(
    Rule(f"business_{i}", p, needs=(need,))
    for i, (p, need) in enumerate(
        (
            (r"\bshould\b", "should"),
            (r"\balways\b", "always"),
            (r"\bnever\b", "never"),
            (r"fiscal", "fiscal"),
            (r"year.to.date", "year"),
            (r"rolling \d+", "rolling"),
            (r"default.*filter", "default"),
            (r"business rule", "business rule"),
            (r"case.sensitive", "sensitive"),
            (r"case.insensitive", "insensitive"),
            (r"\bNULL\b.*mean", "mean"),
            (r"missing.*value", "missing"),
            (r"wildcard", "wildcard"),
            (r"partial match", "partial match"),
            (r"exclude\b", "exclude"),
            (r"\binclude only\b", "include only"),
            (r"KPI", "kpi"),
            (r"metric", "metric"),
            (r"definition", "definition"),
            (r"do not.*join", "join"),
            (r"prefer.*join", "prefer"),
        )
    )
)
SCHEMA_DUMP_FROM = 4

# ---- Fixed values: question wording (the \b binds to the first and last option only) ----------
QUESTION_PATTERNS = {
    "asks_time": Rule(
        "asks_time", r"\btrend|over time|monthly|quarterly|yearly|growth|change|last \d+\b"
    ),
    "asks_join": Rule("asks_join", r"\bby customer|across|with their|for each\b|breakdown by\b"),
    "asks_topn": Rule("asks_topn", r"\btop \d+|bottom \d+|highest|lowest|best|worst|ranking\b"),
    "asks_compare": Rule(
        "asks_compare", r"\bvs\.?|versus|compare|year.over.year|yoy\b|period.over.period\b"
    ),
}
