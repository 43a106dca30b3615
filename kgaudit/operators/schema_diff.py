"""Relational schema against graph entities (JOIN-6, JOIN-7, JOIN-20, AGG-9, AGG-28, FIL-12).

Both schemas are flat: (table_name, column_name, data_type, seq); a table without
columns has one row with a null column. ``seq`` is the reading order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgaudit.functions import scalars as fx


def last_tables(schema: DataFrame) -> DataFrame:
    """Rows of the last table of every case-insensitive name."""
    keyed = schema.withColumn("table_key", F.lower("table_name"))
    winner = keyed.groupBy("table_key").agg(F.max_by("table_name", F.struct("seq", "table_name")).alias("_winner"))
    return keyed.join(winner, "table_key").where(F.col("table_name") == F.col("_winner")).drop("_winner")


def _sides(db: DataFrame, graph: DataFrame) -> DataFrame:
    cols = ["table_key", "table_name", "column_name", "data_type", "seq"]
    return (
        last_tables(db).select(*cols, F.lit(True).alias("in_db"))
        .unionByName(last_tables(graph).select(*cols, F.lit(False).alias("in_db")))
    )


def _status(a, b):
    return F.when(a & b, "MATCHED").when(a, "ONLY_IN_DB").otherwise("ONLY_IN_NEO4J")


def compare_tables(db: DataFrame, graph: DataFrame) -> DataFrame:
    """JOIN-6: status of every table name on either side; the DB spelling is shown."""
    both = _sides(db, graph)
    is_db = F.col("in_db")
    grouped = both.groupBy("table_key").agg(
        F.bool_or(is_db).alias("_a"), F.bool_or(~is_db).alias("_b"),
        F.max(F.when(is_db, F.col("table_name"))).alias("_db"), F.max(F.when(~is_db, F.col("table_name"))).alias("_graph"),
    )
    return grouped.select("table_key", F.coalesce("_db", "_graph").alias("table_name"), _status(F.col("_a"), F.col("_b")).alias("status"))


def compare_columns(db: DataFrame, graph: DataFrame) -> DataFrame:
    """JOIN-7: status of every column of the matched tables."""
    matched = compare_tables(db, graph).where("status = 'MATCHED'").select("table_key", "table_name")
    is_db = F.col("in_db")
    last = F.struct("seq", "column_name")

    def newest(c: str, side) -> F.Column:
        return F.max_by(F.when(side, F.col(c)), F.when(side, last))

    cols = (
        _sides(db, graph).where("column_name IS NOT NULL")
        .groupBy("table_key", F.lower("column_name").alias("column_key"))
        .agg(
            F.bool_or(is_db).alias("_a"), F.bool_or(~is_db).alias("_b"),
            newest("column_name", is_db).alias("_dbname"), newest("column_name", ~is_db).alias("_gname"),
            newest("data_type", is_db).alias("db_type"), newest("data_type", ~is_db).alias("graph_type"),
        )
        .join(matched, "table_key")
    )
    x, y = F.lower(fx.strip(fx.text("db_type"))), F.lower(fx.strip(fx.text("graph_type")))
    both = F.col("_a") & F.col("_b")
    return cols.select(
        "table_key", "table_name", F.coalesce("_dbname", "_gname").alias("column_name"),
        F.when(both & (x != "") & (y != "") & (x != y), "TYPE_MISMATCH").otherwise(_status(F.col("_a"), F.col("_b"))).alias("status"),
        fx.text("db_type").alias("db_type"), fx.text("graph_type").alias("graph_type"),
    )


def schema_summary(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """AGG-9: nine counters over both comparisons in one aggregate."""
    marks = tables.select(F.lit("t").alias("k"), "status").unionByName(columns.select(F.lit("c").alias("k"), "status"))

    def n(kind: str, status: str | None = None):
        hit = F.col("k") == kind
        return F.count_if(hit if status is None else hit & (F.col("status") == status))

    return marks.agg(
        n("t").alias("total_tables"), n("t", "MATCHED").alias("matched_tables"), n("t", "ONLY_IN_DB").alias("only_in_db"),
        n("t", "ONLY_IN_NEO4J").alias("only_in_neo4j"), n("c").alias("total_columns_compared"), n("c", "MATCHED").alias("matched_columns"),
        n("c", "ONLY_IN_DB").alias("columns_only_in_db"), n("c", "ONLY_IN_NEO4J").alias("columns_only_in_neo4j"),
        n("c", "TYPE_MISMATCH").alias("type_mismatches"),
    )


def table_listing(columns: DataFrame) -> DataFrame:
    """AGG-28: matched and total columns and issue count of each matched table."""
    ok = F.count_if(F.col("status") == "MATCHED")
    return columns.groupBy("table_name").agg(ok.alias("matched"), F.count(F.lit(1)).alias("total"), (F.count(F.lit(1)) - ok).alias("issues"))


def tables_with_issues(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """FIL-12: one-sided tables and matched tables with a differing column."""
    differing = columns.where("status <> 'MATCHED'").select("table_key").distinct()
    inner = tables.where("status = 'MATCHED'").join(differing, "table_key", "left_semi")
    return tables.where("status <> 'MATCHED'").unionByName(inner)


def catalog_schema(tables: DataFrame, columns: DataFrame, constraints: DataFrame, key_usage: DataFrame, schema: str) -> DataFrame:
    """SRC-23, JOIN-20: columns of the base tables of a schema with a primary-key flag,
    from DataFrames shaped like the information schema."""
    base = tables.where((F.col("table_schema") == schema) & (F.col("table_type") == "BASE TABLE")).select("table_name")
    primary = constraints.where("constraint_type = 'PRIMARY KEY'").select("table_schema", "table_name", "constraint_name")
    usage = key_usage.select("constraint_name", "table_schema", "table_name", "column_name", F.lit(True).alias("_pk")).distinct()
    listed = (
        columns.where(F.col("table_schema") == schema)
        .join(primary, ["table_schema", "table_name"], "left")
        .join(usage, ["constraint_name", "table_schema", "table_name", "column_name"], "left")
    )
    return base.join(listed, "table_name", "left").select(
        "table_name", "column_name", fx.text("data_type").alias("data_type"), (fx.text("is_nullable") == "YES").alias("is_nullable"),
        F.coalesce("_pk", F.lit(False)).alias("is_primary_key"), F.col("ordinal_position").alias("seq"),
    )
