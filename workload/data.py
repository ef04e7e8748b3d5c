"""The test tables of one scale factor, and the audit inputs bound to them."""

from __future__ import annotations

import re
import uuid
from dataclasses import fields
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spacegauge.operators import joins
from spacegauge.plans.facts import Estate
from spacegauge.session import shared_folder
from spacegauge.sources import readers
from workload.bindings import BINDINGS

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


class Data:
    """Tables and bindings by attribute, each read when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            df = self.table(name)
        elif name in BINDINGS:
            df = self._bind(BINDINGS[name])
        else:
            raise AttributeError(name)
        setattr(self, name, df)
        return df

    def _bind(self, sql: str) -> DataFrame:
        """Run a binding with the tables and bindings it names."""
        names = {n for n in (*TABLES, *BINDINGS) if re.search(rf"\b(?:from|join) {n}\b", sql)}
        return self.spark.sql(self._escape(sql, names), **{n: getattr(self, n) for n in sorted(names)})

    @staticmethod
    def _escape(sql: str, names: set[str]) -> str:
        """Double the braces of the text, then mark the tables."""
        doubled = sql.replace("{", "{{").replace("}", "}}")
        return re.sub(
            r"\b(from|join) (\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in names else m[0], doubled
        )

    # ---- inputs in the shape the operators take --------------------------------------------
    @cached_property
    def spaces(self) -> DataFrame:
        return self.b_spaces

    @cached_property
    def space_tables(self) -> DataFrame:
        return self.b_space_tables

    @cached_property
    def tables(self) -> DataFrame:
        return self.b_tables.drop("s_suppkey")

    @cached_property
    def columns(self) -> DataFrame:
        return readers.table_columns(self.b_columns)

    @cached_property
    def acl(self) -> DataFrame:
        return self.b_acl.select(
            "object_type",
            "object_id",
            "user_name",
            "group_name",
            F.lit(None).cast("string").alias("service_principal_name"),
            F.array("level").alias("levels"),
        )

    @cached_property
    def questions(self) -> DataFrame:
        return readers.questions(self.b_questions)

    @cached_property
    def texts(self) -> DataFrame:
        return readers.text_instructions(self.b_instructions)

    @cached_property
    def sqls(self) -> DataFrame:
        return readers.sql_instructions(self.b_instructions)

    @cached_property
    def expressions(self) -> DataFrame:
        return readers.parse_expressions(self.b_instructions)

    @cached_property
    def synonyms(self) -> DataFrame:
        return readers.explode_synonyms(self.expressions)

    @cached_property
    def metric_views(self) -> DataFrame:
        return readers.metric_views(self.tables)

    @cached_property
    def labels(self) -> DataFrame:
        return joins.label_table(self.spark)

    @cached_property
    def estate(self) -> Estate:
        """All inputs of a full audit, as tables in the shared folder, which is how an audit finds them."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _INPUTS:
            inputs = {
                "spaces": self.spaces,
                "space_tables": self.space_tables,
                "tables": self.tables,
                "columns": self.columns,
                "table_tags": self.b_table_tags,
                "table_constraints": self.b_table_constraints,
                "table_grants": self.b_table_grants,
                "grant_status": self.b_grant_status,
                "acl": self.acl,
                "warehouses": self.b_warehouses,
                "instructions": self.b_instructions,
                "questions": self.questions,
                "description_verdicts": self.b_description_verdicts,
            }
            folder = f"{shared_folder(self.spark)}/inputs-{uuid.uuid4().hex}"
            spread = self.spark.sparkContext.defaultParallelism
            for name, df in inputs.items():
                # Text rules are heavy on the processor, so every input is spread over several files.
                df.repartition(spread).write.parquet(f"{folder}/{name}")
            _INPUTS[key] = folder, {name: df.schema for name, df in inputs.items()}
        folder, schemas = _INPUTS[key]
        return Estate(
            **{f.name: self.spark.read.schema(schemas[f.name]).parquet(f"{folder}/{f.name}") for f in fields(Estate)}
        )


# Folder and schemas of the inputs written for each session and scale factor.
_INPUTS: dict[tuple[str, str], tuple[str, dict]] = {}
