"""Index, call-site, cache and vector tables as Parquet (SRC-24..27)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgaudit.functions import scalars as fx


def build_code_index(definitions: DataFrame) -> DataFrame:
    """SRC-24: one row per (function, file); the first definition wins and its empty
    class is filled from the next definition that has one."""
    named = definitions.withColumn("function_name", F.coalesce(F.nullif("function_name", F.lit("")), F.nullif("class_name", F.lit(""))))
    order = F.struct("seq", "language", "class_name")
    return named.where("function_name IS NOT NULL").groupBy("function_name", "file_path").agg(
        F.min_by("language", order).alias("language"),
        F.coalesce(F.min_by("class_name", F.when(fx.text("class_name") != "", order)), F.lit("")).alias("class_name"),
    )


def replace_table(df: DataFrame, path: str) -> None:
    """SRC-24, SRC-25: full rebuild of a stored table."""
    df.write.mode("overwrite").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def split_by_cache(items: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """SRC-26: items with their cached result; a null result is a miss."""
    return items.join(cache.select(key, "result_json", F.lit(True).alias("_hit")), key, "left").withColumn(
        "cached", F.coalesce("_hit", F.lit(False))
    ).drop("_hit")


def put_cache(cache: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """SRC-26: insert or replace; the newest ``created_at`` of a key stays."""
    rows = cache.unionByName(fresh)
    return rows.groupBy(key).agg(F.max_by(F.struct("result_json", "model", "created_at"), F.struct("created_at", "result_json")).alias("_r")).select(key, "_r.*")


def clear_cache(cache: DataFrame) -> DataFrame:
    return cache.limit(0)


def upsert(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """SRC-27: incoming rows replace current rows of the same key; none is deleted."""
    return current.join(incoming.select(key), key, "left_anti").unionByName(incoming)
