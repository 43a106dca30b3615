"""Node and edge verdicts against source files (QR-18..20, AGG-5) and report tables (QR-31)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgaudit.functions import scalars as fx
from kgaudit.operators.calls import function_bodies
from kgaudit.operators.profile import head_with_more, lines_of


def node_verdicts(snippets: DataFrame, files: DataFrame, code_index: DataFrame) -> DataFrame:
    """QR-18: verdict and confidence of every snippet.

    ``snippets`` has (key, function_name, class_name, file_path, snippet,
    start_line_number, end_line_number), ``files`` (path, content) one row per path.
    """
    name, stored = fx.text("function_name"), ~fx.is_blank("snippet")
    lines = F.slice(lines_of("content"), F.greatest("start_line_number", F.lit(1)), F.greatest(F.col("end_line_number") - F.col("start_line_number") + 1, F.lit(0)))
    ranged = (F.coalesce("start_line_number", F.lit(0)) > 0) & (F.coalesce("end_line_number", F.lit(0)) > 0)
    # Text is reduced to flags in the join's own stage; no content travels further.
    seen = snippets.join(files.select(F.col("path").alias("file_path"), "content"), "file_path", "left").select(
        *snippets.columns, F.col("content").isNotNull().alias("in_file"), F.coalesce(F.contains("content", name), F.lit(False)).alias("named"),
        F.coalesce(ranged & F.contains(F.array_join(lines, "\n"), name), F.lit(False)).alias("in_range"))
    by_name = code_index.select(F.col("function_name").alias("_fn"), F.lit(True).alias("_i1")).distinct()
    by_class = code_index.select(F.col("function_name").alias("_fn"), F.col("class_name").alias("_cls"), F.lit(True).alias("_i2")).distinct()
    found = seen.withColumns({"_fn": name, "_cls": fx.text("class_name")}).join(by_name, "_fn", "left").join(by_class, ["_fn", "_cls"], "left")
    indexed = F.when(F.col("_cls") == "", F.coalesce("_i1", F.lit(False))).otherwise(F.coalesce("_i2", F.lit(False)))
    here, known = F.col("in_file"), F.col("named")
    verdict = (
        F.when(here & known, "valid").when(here & stored, "drifted").when(here, "missing")
        .when(stored, "valid").when(indexed, "drifted").otherwise("missing")
    )
    confidence = (
        F.when(here & known & F.col("in_range"), 0.95).when(here & known, 0.85).when(here & stored, 0.7).when(here, 0.85)
        .when(stored, 0.75).when(indexed, 0.6).otherwise(0.9)
    )
    return found.select("key", verdict.alias("verdict"), confidence.alias("confidence"))


def snippet_code(snippets: DataFrame, files: DataFrame) -> DataFrame:
    """QR-20: stored code, else the function's body in its file, else its line range."""
    open_code = snippets.where(fx.text("snippet") == "")
    bodies = function_bodies(files, open_code.select(F.col("file_path").alias("path"), "function_name").where("path IS NOT NULL").distinct())
    body = bodies.select(F.col("path").alias("file_path"), "function_name", F.col("body").alias("_body"))
    first, last = F.col("start_line_number"), F.col("end_line_number")
    part = F.slice("_lines", F.greatest(first, F.lit(1)), F.greatest(last - first + 1, F.lit(0)))
    region = F.when((F.coalesce(first, F.lit(0)) > 0) & (F.coalesce(last, F.lit(0)) > 0), F.array_join(part, "\n"))
    read = open_code.join(body, ["file_path", "function_name"], "left").join(
        files.select(F.col("path").alias("file_path"), lines_of("content").alias("_lines")), "file_path", "left").select("key", F.coalesce("_body", region).alias("code"))
    return snippets.where(fx.text("snippet") != "").select("key", F.col("snippet").alias("code")).unionByName(read)


def edge_verdicts(edges: DataFrame, snippets: DataFrame, nodes: DataFrame, code: DataFrame, external: DataFrame) -> DataFrame:
    """QR-19: verdict of every call (caller_key, callee_key).

    ``nodes`` are node verdicts, ``code`` the snippet codes, ``external`` the verdicts
    (caller_key, callee_key, verdict, confidence) for edges that pass the text check.
    """
    caller = code.select(F.col("key").alias("caller_key"), "code")
    state = nodes.select(F.col("key").alias("caller_key"), F.col("verdict").alias("_node"))
    callee = snippets.select(F.col("key").alias("callee_key"), fx.text("function_name").alias("_callee"))
    ext = external.select("caller_key", "callee_key", F.col("verdict").alias("_v"), F.col("confidence").alias("_c")).dropDuplicates(["caller_key", "callee_key"])
    joined = edges.join(state, "caller_key", "left").join(callee, "callee_key", "left").join(caller, "caller_key", "left").join(ext, ["caller_key", "callee_key"], "left")
    lost = (F.coalesce("_node", F.lit("missing")) == "missing") | F.col("_callee").isNull() | (fx.text("code") == "")
    absent = ~F.contains("code", F.col("_callee"))
    return joined.select(
        *edges.columns,
        F.when(lost, "unconfirmed").when(absent, "contradicted").otherwise(F.coalesce("_v", F.lit("unconfirmed"))).alias("verdict"),
        F.when(lost, 0.0).when(absent, 0.85).otherwise(F.coalesce("_c", F.lit(0.0))).alias("confidence"))


def verdict_summary(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """AGG-5: verdict counts per flow and, with a null flow, for the project.

    Both inputs have (flow_key, verdict).
    """
    marks = node_table.select("flow_key", F.concat(F.lit("node_"), "verdict").alias("v")).unionByName(edge_table.select("flow_key", F.concat(F.lit("edge_"), "verdict").alias("v")))
    kinds = ["node_valid", "node_drifted", "node_missing", "edge_confirmed", "edge_unconfirmed", "edge_contradicted"]
    return marks.rollup("flow_key").agg(
        F.count_if(F.startswith("v", F.lit("node_"))).alias("nodes"), F.count_if(F.startswith("v", F.lit("edge_"))).alias("edges"),
        *[F.count_if(F.col("v") == k).alias(k) for k in kinds])


SECTIONS = ["confirmed", "phantom", "missing", "gap"]


def flow_report(verified: DataFrame, gaps: DataFrame, shown: dict[str, int] | None = None) -> DataFrame:
    """QR-31: the rows of every section of each flow; with ``shown``, so many of a section
    and how many more there are."""
    rows = _sections(verified).unionByName(
        gaps.select("flow_key", F.lit("gap").alias("section"), "caller", "callee", F.lit("gap").alias("tier"), "trust_score"))
    parts = [head_with_more(rows.where(F.col("section") == s), ["flow_key", "section"], ["caller", "callee", "tier", F.desc("trust_score")], (shown or {}).get(s)) for s in SECTIONS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _sections(verified: DataFrame) -> DataFrame:
    return verified.select("flow_key", F.col("classification").alias("section"), "caller", "callee", "tier", "trust_score")


def flow_report_heads(verified: DataFrame, heads: DataFrame, shown: dict[str, int]) -> DataFrame:
    """QR-31 with ``shown``, from ``diff.first_gaps`` instead of all gaps. The other sections are ranked in one pass."""
    limit = F.lit(0)
    for s in SECTIONS[:-1]:
        limit = F.when(F.col("section") == s, shown[s]).otherwise(limit)
    keys = ["flow_key", "section"]
    head = head_with_more(_sections(verified), keys, ["caller", "callee", "tier", F.desc("trust_score")], max(shown.values()))
    spare = max(shown.values()) - limit
    total = F.when(F.col("more") > 0, F.col("more") + spare).otherwise(F.count(F.lit(1)).over(Window.partitionBy(*keys)) - limit)
    edges = head.withColumn("more", F.greatest(total, F.lit(0)).cast("bigint")).where(F.col("position") <= limit)
    gaps = heads.select("flow_key", F.lit("gap").alias("section"), "caller", "callee", F.lit("gap").alias("tier"), "trust_score", "position", F.greatest(F.col("gaps") - shown["gap"], F.lit(0)).alias("more"))
    return edges.unionByName(gaps)
