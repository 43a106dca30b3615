"""Project-wide edge audit: catalog CALLS edges against stored call sites (JOIN-5, JOIN-22, AGG-8, SET-1..2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgaudit.functions import scalars as fx
from kgaudit.session import first_per

EDGE_KEY = ["k_caller", "k_caller_file", "k_callee", "k_callee_file"]


def with_edge_key(edges: DataFrame) -> DataFrame:
    """FN-7: the four-part comparison key of an edge."""
    return edges.withColumns(
        {
            "k_caller": fx.norm_name("caller"),
            "k_caller_file": fx.norm_file("caller_file"),
            "k_callee": fx.norm_name("callee"),
            "k_callee_file": fx.norm_file("callee_file"),
        }
    )


def keyed_first(edges: DataFrame, order: list[str]) -> DataFrame:
    """First edge of every key; edges without both names are skipped."""
    named = with_edge_key(edges).where("caller <> '' AND callee <> ''")
    return first_per(named, EDGE_KEY, [F.col(c) for c in order])


def common_keys(catalog: DataFrame, stored: DataFrame) -> DataFrame:
    """SET-1: distinct edge keys of both sides. One grouping of the keys alone, so neither side is sent to the driver."""
    sides = with_edge_key(catalog).where("caller <> '' AND callee <> ''").select(*EDGE_KEY, F.lit(1).alias("side")).unionByName(
        with_edge_key(stored).where("caller <> '' AND callee <> ''").select(*EDGE_KEY, F.lit(2).alias("side")))
    return sides.groupBy(*EDGE_KEY).agg(F.bit_or("side").alias("sides")).where("sides = 3").select(*EDGE_KEY)


def class_by_function(code_index: DataFrame) -> DataFrame:
    """Class of a (function, file name); of several paths the greatest wins."""
    return code_index.groupBy(
        fx.norm_name("function_name").alias("_fn"), fx.norm_file("file_path").alias("_file")
    ).agg(F.max_by(fx.text("class_name"), F.struct("file_path", fx.text("class_name"))).alias("_class"))


def backfill_classes(edges: DataFrame, code_index: DataFrame) -> DataFrame:
    """JOIN-22: empty classes of both edge ends from the function index."""
    info = class_by_function(code_index)
    out = edges
    for end in ("caller", "callee"):
        key = info.withColumnsRenamed({"_fn": f"_fn_{end}", "_file": f"_file_{end}", "_class": f"_class_{end}"})
        out = (
            out.withColumns({f"_fn_{end}": fx.norm_name(end), f"_file_{end}": fx.norm_file(f"{end}_file")})
            .join(key, [f"_fn_{end}", f"_file_{end}"], "left")
            .withColumn(
                f"{end}_class",
                F.coalesce(F.nullif(f"{end}_class", F.lit("")), F.col(f"_class_{end}"), F.lit("")),
            )
        )
    return out.select(*edges.columns)


def audit_edges(catalog: DataFrame, stored: DataFrame) -> DataFrame:
    """JOIN-5: one row per edge with its bucket: confirmed, missing or phantom.

    Both inputs are keyed by ``with_edge_key`` and distinct. Exact keys are compared
    first; a missing edge whose name pair is left over in the catalog then counts as
    confirmed by name and clears the smallest such catalog key.
    """
    tagged = catalog.select(*EDGE_KEY, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        stored.select(*EDGE_KEY, F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    keys = tagged.groupBy(*EDGE_KEY).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    rest_key = F.when((F.col("a") == 1) & (F.col("b") == 0), F.struct("k_caller_file", "k_callee_file"))
    per_pair = keys.groupBy("k_caller", "k_callee").agg(
        F.min(rest_key).alias("_first"),
        F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("_missing"),
    )
    joined = keys.join(per_pair, ["k_caller", "k_callee"])
    cleared = (F.col("_missing") > 0) & (F.struct("k_caller_file", "k_callee_file") == F.col("_first"))
    return joined.select(
        *EDGE_KEY,
        F.when((F.col("a") == 1) & (F.col("b") == 1), "confirmed")
        .when((F.col("b") == 1) & F.col("_first").isNotNull(), "confirmed_by_name")
        .when(F.col("b") == 1, "missing")
        .when(cleared, "cleared")
        .otherwise("phantom").alias("bucket"),
    ).where("bucket <> 'cleared'")


def audit_summary(audit: DataFrame) -> DataFrame:
    """AGG-8: counts, coverage and its colour band."""
    counted = audit.agg(
        F.count_if(F.col("bucket").isin("confirmed", "confirmed_by_name")).alias("confirmed"),
        F.count_if(F.col("bucket") == "missing").alias("missing"),
        F.count_if(F.col("bucket") == "phantom").alias("phantom"),
        F.count_if(F.col("bucket") == "confirmed_by_name").alias("name_only_matches"),
    )
    score = fx.safe_ratio(F.col("confirmed"), F.col("confirmed") + F.col("missing"))
    return counted.withColumn("coverage", score).withColumn("band", coverage_band(F.col("coverage") * 100))


def coverage_band(percent):
    return F.when(percent >= 70, "green").when(percent >= 40, "orange").otherwise("red")
