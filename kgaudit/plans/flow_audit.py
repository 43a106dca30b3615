"""Audit all flows of a run: catalog call graphs against the indexed code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgaudit.functions import scalars as fx
from kgaudit.operators import diff, graph, normalize
from kgaudit.session import checkpointed
from kgaudit.sources import graph as source


def audit_flows(nodes: DataFrame, rels: DataFrame, code_index: DataFrame, call_edges: DataFrame, project_id: int, run_id: int, aliases: DataFrame | None = None) -> dict[str, DataFrame]:
    """Edges of both graphs, verdicts, scores, gaps and causes of every flow, in one run.

    ``call_edges`` has (seq, caller, callee, confidence) with chunk ids.
    """
    flows = source.flow_keys(nodes, project_id, run_id)
    members = checkpointed(source.participants(nodes, rels, flows))
    catalog = source.catalog_edges(nodes, source.flow_calls(nodes, rels, members))
    a = checkpointed(normalize.normalize_edges(catalog, aliases))

    roots = checkpointed(source.root_snippets(members).select(
        "flow_key", fx.display_name("function_name", "name", "key").alias("root_function"), fx.text("class_name").alias("root_class"), fx.text("file_path").alias("root_file")))
    paths = code_index.select(F.col("file_path").alias("path"))
    prefixes = normalize.project_prefixes(roots.select("flow_key", "root_file"), paths)
    sites = graph.split_sites(call_edges)
    found = checkpointed(graph.resolve_roots(roots, code_index, sites))
    wanted = found.join(roots.select("flow_key", "root_file"), "flow_key").select("flow_key", F.col("start").alias("function_name"), F.col("root_file").alias("file_path"))
    starts = graph.resolve_index_file(wanted, code_index).select("flow_key", F.col("function_name").alias("start"), F.col("index_file").alias("start_file")).join(prefixes, "flow_key")
    traversed = graph.traverse(starts, graph.located_sites(sites, code_index))
    observed = traversed.where("resolved").withColumn("extraction_method", F.lit("regex"))
    b = checkpointed(normalize.normalize_edges(observed, aliases))

    verified = checkpointed(diff.diff_edges(a, b))
    explained = diff.explain_discrepancies(verified)
    return {
        "catalog_edges": a, "observed_edges": b, "verified_edges": verified, "flow_scores": diff.flow_scores(verified, a, b),
        "order": diff.order_kept(a, b), "gaps": diff.coverage_gaps(a, b, call_edges, roots),
        "unresolved": graph.unresolved_callees(traversed), "explained": explained, "causes": diff.flow_causes(explained, found),
    }
