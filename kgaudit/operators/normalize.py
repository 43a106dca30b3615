"""Edge normalisation: aliases, names, files and project scope (FN-5, FN-6, FIL-1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgaudit.functions import scalars as fx


def resolve_aliases(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """FN-5: replace ``column`` by its canonical name, upper-cased when unknown.

    ``aliases`` has rows (alias, canonical). A canonical name resolves to itself.
    """
    known = aliases.select("alias", "canonical").unionByName(
        aliases.select(F.col("canonical").alias("alias"), "canonical")
    )
    lookup = known.groupBy(fx.norm_name("alias").alias("_alias")).agg(
        F.min("canonical").alias("_canonical")
    )
    return (
        df.withColumn("_alias", fx.norm_name(column))
        .join(lookup, "_alias", "left")
        .withColumn(column, F.upper(F.coalesce("_canonical", "_alias")))
        .select(*df.columns)
    )


def normalize_edges(edges: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """FN-6: canonical names, upper-cased classes and file names; ``seq`` is kept."""
    if aliases is not None:
        for c in ("caller", "callee"):
            edges = resolve_aliases(edges, c, aliases)
    return edges.withColumns(
        {
            "caller": fx.norm_name("caller"),
            "callee": fx.norm_name("callee"),
            "caller_class": fx.norm_name("caller_class"),
            "callee_class": fx.norm_name("callee_class"),
            "caller_file": fx.norm_file("caller_file"),
            "callee_file": fx.norm_file("callee_file"),
        }
    )


def project_prefixes(roots: DataFrame, paths: DataFrame) -> DataFrame:
    """Top folder of every root file, found through the indexed paths.

    ``roots`` has (flow_key, root_file), ``paths`` has (path). A path with the same
    file name wins over one with the same stem; the smallest path wins inside a tier.
    A root without a hit, or a hit without a folder, gives the empty prefix.
    """
    indexed = paths.select(fx.slashes("path").alias("path")).distinct()
    by_name = indexed.groupBy(fx.norm_file("path").alias("_name")).agg(F.min("path").alias("_p1"))
    by_stem = indexed.groupBy(fx.file_stem(fx.norm_file("path")).alias("_stem")).agg(
        F.min("path").alias("_p2")
    )
    found = (
        roots.withColumn("_name", fx.norm_file("root_file"))
        .withColumn("_stem", fx.file_stem(F.col("_name")))
        .join(by_name, "_name", "left")
        .join(by_stem, "_stem", "left")
        .withColumn("_hit", F.when(fx.is_blank("root_file"), None).otherwise(F.coalesce("_p1", "_p2")))
    )
    top = F.when(F.col("_hit").contains("/"), F.substring_index("_hit", "/", 1)).otherwise("")
    return found.select("flow_key", F.coalesce(top, F.lit("")).alias("prefix"))


def scope_edges(edges: DataFrame, prefixes: DataFrame, path_column: str) -> DataFrame:
    """FIL-1: the edges in scope of every distinct prefix, ignoring case.

    A prefix is a top folder, so only the leading substrings of a path's top folder can
    equal it; they become equi-join keys. The empty prefix takes every edge.
    """
    scopes = prefixes.select("prefix", F.upper("prefix").alias("_lead")).distinct()
    top = F.upper(F.substring_index(fx.slashes(path_column), "/", 1))
    leads = F.transform(F.sequence(F.lit(0), F.length(top)), lambda n: F.substring(top, F.lit(1), n))
    return edges.withColumn("_lead", F.explode(leads)).join(scopes, "_lead").drop("_lead")
