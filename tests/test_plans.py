"""The end-to-end plans on the smallest data."""

import pytest
from pyspark.sql import functions as F

from kgaudit.plans.flow_audit import audit_flows
from kgaudit.plans.index_code import index_code
from kgaudit.plans.topic_report import analyze_run
from kgaudit.session import shared_folder
from kgaudit.workload import load
from kgaudit.workload.registry import Tables

load()


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, "/root/testdata/sf0.001")


def test_flow_audit(t):
    out = audit_flows(t.kg_nodes, t.kg_rels, t.code_index, t.call_edges, 1, 1, t.aliases)
    scores = out["flow_scores"].collect()
    verified = out["verified_edges"].groupBy("flow_key", "classification").count().collect()
    counts = {(r.flow_key, r.classification): r["count"] for r in verified}
    assert scores and all(counts.get((r.flow_key, "phantom"), 0) == r.phantom for r in scores)
    pairs = out["catalog_edges"].select("flow_key", "caller", "callee").distinct()
    placed = out["verified_edges"].where("classification <> 'missing'").select("flow_key", "caller", "callee").distinct()
    assert pairs.exceptAll(placed).isEmpty() and placed.exceptAll(pairs).isEmpty()
    assert out["causes"].count() >= 0 and out["order"].count() >= 0 and out["gaps"].count() >= 0


def test_index_code(t, spark):
    forms = t.form_files.select("path", "content", F.lit("delphi").alias("language"))
    files = t.code_files.select("path", "content", "language").unionByName(forms)
    out = index_code(files, shared_folder(spark, "index"))
    chunks = out["chunks"].count()
    assert chunks == 4 * t.code_files.count() + 2 * t.form_files.count()
    ids = out["chunks"].select("chunk_id")
    edges = out["call_edges"]
    assert edges.count() > t.form_files.count()
    assert edges.join(ids, edges.callee == ids.chunk_id, "left_anti").isEmpty()
    again = index_code(files, shared_folder(spark, "index"))
    assert again["call_edges"].exceptAll(edges).isEmpty()


def test_topic_report_with_empty_external_tables(t, spark):
    scores = spark.createDataFrame([], t.alignment_scores.schema)
    journeys = spark.createDataFrame([], "node_key STRING, suggested STRING")
    out = analyze_run(t.kg_nodes, t.kg_rels, scores, journeys, 1, 1)
    total = out["totals"].where("node_type IS NULL").first()
    assert total.nodes == out["analysis"].count() > 0
    assert out["chains"].count() > 0 and out["topic_tree"].count() > 0 and out["issues"].count() > 0
