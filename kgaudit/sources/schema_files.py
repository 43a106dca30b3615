"""Schema readers: CSV, JSON in both shapes, and JDBC catalogs (SRC-21..23)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgaudit.functions import scalars as fx
from kgaudit.operators.schema_diff import catalog_schema

FIELDS = ["table_name", "column_name", "data_type", "is_nullable", "is_primary_key"]
COLUMN = "STRUCT<name STRING, data_type STRING, is_nullable BOOLEAN, is_primary_key BOOLEAN>"
TABLE = f"STRUCT<name STRING, schema_name STRING, columns ARRAY<{COLUMN}>>"


def clean_csv_rows(raw: DataFrame) -> DataFrame:
    """SRC-21 on rows already split into text fields; absent fields may be missing."""
    have = set(raw.columns)

    def field(name: str, default: str):
        return fx.text(name) if name in have else F.lit(default)

    return raw.where(~fx.is_blank("table_name")).select(
        fx.strip("table_name").alias("table_name"), fx.strip(field("column_name", "")).alias("column_name"),
        fx.strip(field("data_type", "")).alias("data_type"), fx.lenient_bool(field("is_nullable", "true")).alias("is_nullable"),
        fx.lenient_bool(field("is_primary_key", "false")).alias("is_primary_key"),
    )


def read_schema_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC-21: a header line names the fields; a byte order mark is dropped by Spark."""
    return clean_csv_rows(spark.read.csv(path, header=True, quote='"', escape='"'))


def parse_schema_json(documents: DataFrame, column: str = "value") -> DataFrame:
    """SRC-22: one JSON document per row, ``{"tables": [...]}`` or a list of tables."""
    wrapped = F.from_json(F.col(column), f"tables ARRAY<{TABLE}>")["tables"]
    bare = F.from_json(F.col(column), f"ARRAY<{TABLE}>")
    is_list = F.startswith(F.ltrim(F.col(column)), F.lit("["))
    tables = documents.select(F.inline(F.when(is_list, bare).otherwise(wrapped)))
    return tables.select(F.col("name").alias("table_name"), F.explode_outer("columns").alias("c")).select(
        "table_name", F.col("c.name").alias("column_name"), fx.text("c.data_type").alias("data_type"),
        F.coalesce("c.is_nullable", F.lit(True)).alias("is_nullable"), F.coalesce("c.is_primary_key", F.lit(False)).alias("is_primary_key"),
    )


def read_schema_json(spark: SparkSession, path: str) -> DataFrame:
    """SRC-22 over whole files."""
    return parse_schema_json(spark.read.text(path, wholetext=True))


def read_schema_jdbc(spark: SparkSession, url: str, schema: str, **options: str) -> DataFrame:
    """SRC-23: the four catalog views of a live database, joined in Spark."""
    views = ["tables", "columns", "table_constraints", "key_column_usage"]
    frames = [spark.read.format("jdbc").options(url=url, dbtable=f"information_schema.{v}", **options).load() for v in views]
    return catalog_schema(*frames, schema)
