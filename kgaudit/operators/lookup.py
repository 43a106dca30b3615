"""Lookups over the function index and the stored call sites (FIL-2..6, FIL-8, FIL-10, SET-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgaudit.functions import scalars as fx


def lookup_files(names: DataFrame, code_index: DataFrame) -> DataFrame:
    """FIL-2: file of each name; an exact hit beats one that differs in case only.

    The index is reduced to its first file per name before it is joined.
    """
    exact = code_index.groupBy(F.col("function_name").alias("_n")).agg(F.min_by("file_path", F.struct("seq", "file_path")).alias("_exact"))
    loose = code_index.groupBy(F.lower("function_name").alias("_l")).agg(F.min_by("file_path", F.struct("seq", "file_path")).alias("_loose"))
    return (
        names.withColumn("_n", fx.strip("name")).withColumn("_l", F.lower("_n"))
        .join(exact, "_n", "left").join(loose, "_l", "left")
        .select("name", F.coalesce("_exact", "_loose").alias("file_path"))
    )


def search_functions(chunks: DataFrame, function_name: str, class_name: str | None = None, file_path: str | None = None, limit: int | None = None) -> DataFrame:
    """FIL-3: exact metadata filter; absent predicates are not applied. ``limit`` keeps the first rows."""
    hits = chunks.where(F.col("function_name") == function_name)
    if class_name:
        hits = hits.where(F.col("class_name") == class_name)
    if file_path:
        hits = hits.where(F.col("file_path") == file_path)
    ordered = hits.orderBy("file_path", "class_name", "seq")
    return ordered if limit is None else ordered.limit(limit)


def search_index(code_index: DataFrame, function_name: str, class_name: str | None = None) -> DataFrame:
    """FIL-4: case-insensitive search by function and optional class."""
    hits = code_index.where(F.upper("function_name") == function_name.upper().strip())
    if class_name:
        hits = hits.where(F.upper("class_name") == class_name.upper().strip())
    return hits.select("function_name", "file_path", "class_name")


def outgoing_edges(call_edges: DataFrame, caller_name: str) -> DataFrame:
    """FIL-5: call sites of a function, found by the last part of the caller id."""
    return call_edges.where(F.upper(fx.chunk_last("caller")) == caller_name.upper().strip()).select(
        F.col("caller").alias("caller_raw"), F.col("callee").alias("callee_raw"), fx.chunk_last("callee").alias("callee_name"), "confidence"
    )


def list_functions(code_index: DataFrame, prefix: str | None = None, limit: int | None = None) -> DataFrame:
    """FIL-6: functions below a path prefix, in index order. ``limit`` keeps the first rows."""
    found = code_index
    if prefix:
        found = found.where(F.startswith(F.upper(fx.slashes("file_path")), F.lit(prefix.upper())))
    ordered = found.orderBy("seq", "function_name", "file_path").select("function_name", "file_path", "class_name")
    return ordered if limit is None else ordered.limit(limit)


def edges_like(call_edges: DataFrame, pattern: str) -> DataFrame:
    """FIL-8: call sites whose caller or callee matches a LIKE pattern."""
    return call_edges.where(F.col("caller").like(pattern) | F.col("callee").like(pattern))


def files_present(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """FIL-10: whether each wanted path exists."""
    known = files.select(F.col("path")).distinct().withColumn("_hit", F.lit(True))
    return wanted.join(known, "path", "left").withColumn("file_exists", F.coalesce("_hit", F.lit(False))).drop("_hit")


def functions_present(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """FIL-10: whether a function name occurs in the text of its file."""
    return wanted.join(files.select("path", "content"), "path", "left").withColumn(
        "function_exists", F.coalesce(F.contains("content", "function_name"), F.lit(False))
    ).drop("content")


def endpoint_files(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """SET-7: distinct non-empty files on either end of a flow's edges plus its root file."""
    ends = edges.select("flow_key", F.explode(F.array("caller_file", "callee_file")).alias("file"))
    return ends.unionByName(roots.select("flow_key", F.col("root_file").alias("file"))).where(~fx.is_blank("file")).distinct()


def index_listing(code_index: DataFrame) -> DataFrame:
    """SRC-33: index rows as graph nodes."""
    cls = fx.text("class_name")
    return code_index.select(
        F.concat_ws("@", "function_name", "file_path").alias("id"), F.col("function_name").alias("name"),
        F.col("file_path").alias("file"), "language", cls.alias("class"),
        F.when(cls != "", "class").otherwise("function").alias("type"),
    )
