"""Topic analysis of a run: nodes, groups, trees, issues and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgaudit.operators import graph, topics
from kgaudit.session import checkpointed
from kgaudit.sources import graph as source


def analyze_run(nodes: DataFrame, rels: DataFrame, scores: DataFrame, suggestions: DataFrame, project_id: int, run_id: int) -> dict[str, DataFrame]:
    """All tables of the topic report; ``scores`` and ``suggestions`` may be empty."""
    found = checkpointed(source.topic_nodes(nodes, rels, project_id, run_id))
    pairs = checkpointed(topics.similar_topics(found))
    groups = topics.topic_groups(found, pairs)
    members = source.participants(nodes, rels, source.flow_keys(nodes, project_id, run_id)).select("flow_key", F.col("key").alias("src_key"))
    callees = source.labelled(nodes, "Snippet").select(F.col("key").alias("dst_key"))
    calls = checkpointed(rels.where("rel_type = 'CALLS'").join(members, "src_key").join(callees, "dst_key", "left_semi").select(
        "flow_key", F.col("src_key").alias("caller"), F.col("dst_key").alias("callee"), F.coalesce("global_execution_order", F.lit(0)).alias("exec_order")))
    tree, children = graph.journey_tree(calls), graph.tree_children(calls)
    named = nodes.select("key", "topic")
    analysis = checkpointed(topics.analyze_topics(found, groups, scores, suggestions))
    return {
        "analysis": analysis, "similar_pairs": pairs, "duplicates": topics.duplicate_members(found), "issues": topics.issue_breakdown(analysis),
        "totals": topics.topic_summary(analysis), "chains": graph.chain_context(tree, children, named), "topic_tree": graph.topic_tree(children, named),
    }
