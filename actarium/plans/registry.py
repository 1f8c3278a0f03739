"""Registry of the queries: a name (the operator id), a function of the tables, and the checking SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import compute_once
from ..operators.lineage import shared_folder
from .projections import PROJECTIONS, STEPS

RAW_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages",
    "benchmark", "labels", "conversations",
)
PARTS_PER_CORE = 8
QUERIES: dict[str, Callable[["Tables"], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables and the gazette projections over them, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in RAW_TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in PROJECTIONS:
            return self._project(PROJECTIONS[name], {})
        raise AttributeError(name)

    def _project(self, sql: str, given: dict[str, DataFrame]) -> DataFrame:
        used = {t: given.get(t) or getattr(self, t) for t in RAW_TABLES if "{" + t + "}" in sql}
        for step, text in STEPS.items():
            if "{" + step + "}" in sql:
                df = self._project(text, given)
                # a boundary keeps every step's generated code small and its columns computed once
                used[step] = compute_once(df, **{c: F.col(c) for c in df.columns})
        return self.spark.sql(sql, **used)

    @property
    def parts(self) -> int:
        """The number of parts that `spread` deals rows to."""
        named = self.spark.conf.get("spark.actarium.spread", None)
        return int(named) if named else max(PARTS_PER_CORE * self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")))

    def spread(self, name: str) -> DataFrame:
        """A table whose rows need much CPU. A file of few splits would keep most cores idle, so the narrow source rows are dealt
        to parts first: some for every core, or as many as the session names (spark.actarium.spread). The long texts are
        computed once, as if they were stored."""
        source = {"gz_pages": "orders", "gz_acts": "orders", "gz_responses": "orders", "gz_mentions": "lineitem"}.get(name, name)
        raw = getattr(self, source)
        wide = raw.repartition(self.parts)
        if source == name:
            return wide
        df = self._project(PROJECTIONS[name], {source: wide})
        return compute_once(df, **{c: F.col(c) for c in ("text", "excerpt", "summary", "response") if c in df.columns})

    def scratch(self, name: str) -> str:
        """Folder for written results of a round-trip query, below the shared checkpoint folder."""
        import uuid

        return f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"


def query(name: str, oracle: str | None = None):
    """Register a query under the id of its operator."""

    def deco(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = with_projections(oracle)
        return fn

    return deco


def with_projections(sql: str) -> str:
    """Put the used projections in front of a checking statement as common table expressions."""
    used = [p for p in PROJECTIONS if re.search(rf"\b{p}\b", sql)]
    if not used:
        return sql.strip()
    names = {t: t for t in RAW_TABLES}
    for step, text in STEPS.items():
        names[step] = "(" + text.format(**names) + ")"
    ctes = ",\n".join(f"{p} AS ({PROJECTIONS[p].format(**names)})" for p in used)
    body = sql.strip()
    if re.match(r"(?i)with\s+recursive\b", body):
        return f"WITH RECURSIVE {ctes},\n{body[body.lower().index('recursive') + 9:]}"
    if re.match(r"(?i)with\b", body):
        return f"WITH {ctes},\n{body[4:]}"
    return f"WITH {ctes}\n{body}"


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES[name](Tables(spark, str(Path(sf_dir))))
