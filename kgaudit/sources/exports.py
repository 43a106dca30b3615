"""JSON and CSV exports and the nested ground-truth reader (SRC-28..32)."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgaudit.functions import scalars as fx
from kgaudit.session import checkpointed


def without_nulls(props: Column | str) -> Column:
    """SRC-30: a property map without null values."""
    return F.map_filter(fx.col(props), lambda k, v: v.isNotNull())


def node_dump(nodes: DataFrame) -> DataFrame:
    """SRC-30: one JSON line per node; ``to_json`` leaves null fields out."""
    cols = [c for c in nodes.columns if c not in ("key", "props")]
    return nodes.select("key", F.to_json(F.struct("key", *cols, without_nulls("props").alias("props"))).alias("json"))


def edge_dump(nodes: DataFrame, rels: DataFrame) -> DataFrame:
    """SRC-30: CALLS edges with the properties of both ends."""
    ends = nodes.select("key", F.struct(*[c for c in nodes.columns if c != "props"]).alias("node"))
    calls = rels.where("rel_type = 'CALLS'")
    edge = F.struct("execution_order", "global_execution_order")
    return (
        calls.join(ends.withColumnsRenamed({"key": "src_key", "node": "caller"}), "src_key")
        .join(ends.withColumnsRenamed({"key": "dst_key", "node": "callee"}), "dst_key")
        .select("src_key", "dst_key", F.to_json(F.struct("caller", edge.alias("edge"), "callee")).alias("json"))
    )


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def flow_result_records(scores: DataFrame, verified: DataFrame, edges: DataFrame, per_record: int = 1000, per_task: int = 100_000) -> DataFrame:
    """SRC-32: nested JSON records per flow.

    A flow gives one header record and as many edge records as it needs, each with at
    most ``per_record`` entries, so no record grows with the data.

    Entries are shuffled once, by flow and part. Parts of more than ``per_task`` entries are dealt to
    several ``chunk`` numbers by a hash of the whole row; only these parts, at most one per ``per_task``
    rows, are broadcast.
    """
    header = scores.select("flow_key", F.lit("summary").alias("part"), F.lit(0).cast("bigint").alias("chunk"), F.to_json(F.struct("*")).alias("json"))
    graph_rows = edges.withColumn("part", F.concat(F.lit("graph_"), "side"))
    verdict_rows = verified.withColumn("part", F.concat(F.col("classification"), F.lit("_edges")))

    def records(rows: DataFrame, entry: list[str]) -> DataFrame:
        key = ["flow_key", "part", "chunk"]
        sizes = rows.groupBy("flow_key", "part").agg(F.count(F.lit(1)).alias("_n"))
        large = sizes.where(F.col("_n") > per_task).select("flow_key", "part", F.ceil(F.col("_n") / per_task).alias("_deals"))
        spread = rows.withColumn("_hash", F.xxhash64(*rows.columns)).join(large.hint("broadcast"), ["flow_key", "part"], "left")
        chunk = F.pmod("_hash", F.coalesce("_deals", F.lit(1))).cast("bigint")
        # As one text an entry takes less room in the shuffle than as columns.
        text = spread.select("flow_key", "part", chunk.alias("chunk"), F.to_json(F.struct(*entry)).alias("_entry")).repartition(*key)
        placed = text.withColumn("_pos", F.row_number().over(Window.partitionBy(*key).orderBy("_entry")))
        cut = placed.withColumn("sub", F.floor((F.col("_pos") - 1) / per_record))
        return cut.groupBy(*key, "sub").agg(F.array_sort(F.collect_list("_entry")).alias("_e")).select(
            *key, F.concat(F.lit("["), F.array_join("_e", ","), F.lit("]")).alias("json"))

    graphs = records(graph_rows, ["caller", "callee", "caller_file", "callee_file", "caller_class", "callee_class", "confidence", "extraction_method"])
    verdicts = records(verdict_rows, ["caller", "callee", "caller_file", "callee_file", "tier", "trust_score"])
    return header.unionByName(graphs).unionByName(verdicts)


def flatten_call_trees(documents: DataFrame, column: str, max_depth: int | None = None) -> DataFrame:
    """SRC-29: nested ground truth to edges with depth.

    Each document is ``{"key", "function_name", "class_name", "file_name", "call_tree"}``
    with children under ``callees``. Trees are opened one level per step on the
    executors and each level is stored, so a document is parsed once; the driver only asks
    whether a level is empty. All levels are read unless ``max_depth`` is given.
    """
    def attr(v: str, path: str) -> Column:
        return F.expr(f"coalesce(try_variant_get({v}, '$.{path}', 'string'), '')")

    doc = documents.select(F.parse_json(F.col(column)).alias("v"))
    level = doc.select(
        attr("v", "key").alias("snippet_key"), attr("v", "function_name").alias("caller_func"), attr("v", "class_name").alias("caller_class"),
        attr("v", "file_name").alias("caller_file"), F.expr("try_variant_get(v, '$.call_tree', 'array<variant>')").alias("kids"))
    out = None
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        step = level.select("snippet_key", "caller_func", "caller_class", "caller_file", F.posexplode("kids").alias("position", "kid")).select(
            "snippet_key", "caller_func", "caller_class", "caller_file", attr("kid", "callee_function").alias("callee_func"),
            attr("kid", "callee_class").alias("callee_class"), attr("kid", "callee_file").alias("callee_file"),
            F.lit(depth).alias("depth"), "position", F.expr("try_variant_get(kid, '$.callees', 'array<variant>')").alias("kids"))
        step = checkpointed(step)
        if step.isEmpty():
            break
        flat = step.drop("kids")
        out = flat if out is None else out.unionByName(flat)
        level = step.select("snippet_key", F.col("callee_func").alias("caller_func"), F.col("callee_class").alias("caller_class"),
                            F.col("callee_file").alias("caller_file"), "kids")
    return step.drop("kids") if out is None else out
