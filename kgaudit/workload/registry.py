"""Named queries over the test tables and the SQL each one is checked against.

A query is a function of ``Tables``; its check is DuckDB SQL that may read base
tables and the derived tables of ``fixtures`` by name after FROM or JOIN.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kgaudit.session import shared_folder

BASE = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

_REF = re.compile(r"\b(FROM|JOIN)\s+([a-z_][a-z0-9_]*)\b")

FIXTURES: dict[str, Callable[[str], str]] = {}
QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


# Derived tables that a user would hold as stored tables. They are computed from the
# base tables once per session and folder, written to the shared folder and read back.
STORED = {
    "kg_nodes", "kg_rels", "edges_a", "edges_b", "call_edges", "code_index", "code_files", "trav_calls", "app_files", "app_index",
}
_WRITTEN: dict[tuple[str, str, str], str] = {}


def fixture(fn: Callable[[str], str]) -> Callable[[str], str]:
    """Register derived-table SQL; the argument is 'spark' or 'duckdb'."""
    FIXTURES[fn.__name__] = fn
    return fn


def query(name: str, oracle: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


class Tables:
    """Base and derived tables of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in BASE:
                self._made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            elif name in FIXTURES:
                sql = FIXTURES[name]("spark")
                deps = {d for d in refs(sql)}
                sql = sql.replace("{", "{{").replace("}", "}}")
                sql = _REF.sub(lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in deps else m[0], sql)
                derived = self.spark.sql(sql, **{d: getattr(self, d) for d in deps})
                self._made[name] = self._stored(name, derived) if name in STORED else derived
            else:
                raise AttributeError(name)
        return self._made[name]

    def _stored(self, name: str, derived: DataFrame) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _WRITTEN:
            path = shared_folder(self.spark, name)
            # A stored table has many files. Small base tables are single ones, so what comes of them is dealt
            # out; one read in enough parts gives as many files as it is, and its wide rows are not shuffled.
            parts = self.spark.sparkContext.defaultParallelism
            scanned = max(getattr(self, base).rdd.getNumPartitions() for base in bases(name))
            (derived if 2 * scanned > parts else derived.repartition(parts)).write.parquet(path)
            _WRITTEN[key] = path
        return self.spark.read.parquet(_WRITTEN[key])


def bases(name: str) -> set[str]:
    """Base tables that a derived table is made of."""
    return {name} if name in BASE else {b for d in refs(FIXTURES[name]("spark")) for b in bases(d)}


def refs(sql: str) -> list[str]:
    """Tables of ours that ``sql`` reads, in order of first use."""
    seen = dict.fromkeys(m[1] for m in _REF.findall(sql))
    return [t for t in seen if t in FIXTURES or t in BASE]


def check_sql(body: str) -> str:
    """Prepend the derived tables that ``body`` needs as common table expressions."""
    order: list[str] = []

    def visit(sql: str) -> None:
        for name in refs(sql):
            if name in FIXTURES and name not in order:
                visit(FIXTURES[name]("duckdb"))
                order.append(name)

    visit(body)
    parts = [f"{n} AS ({FIXTURES[n]('duckdb')})" for n in order]
    body = body.strip()
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    if own:
        body = body[own.end():]
        sep = ", " if parts else ""
        return "WITH RECURSIVE " + ", ".join(parts) + sep + body
    return ("WITH RECURSIVE " + ", ".join(parts) + " " if parts else "") + body
