"""Cases of the third round's findings."""

import random
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from kgaudit import session
from kgaudit.operators import calls, coverage, diff, edge_audit, graph
from kgaudit.sources import graph as g
from kgaudit.workload import q_code

CALL = "flow_key STRING, caller STRING, callee STRING, exec_order INT"


def test_pages_that_share_a_url_are_rows_of_their_own(spark):
    pages = spark.createDataFrame([(1, "u", "<article>x</article>"), (2, "u", "<nav></nav>"), (3, "v", None), (4, "w", "text")], "page_id BIGINT, url STRING, html STRING")
    found = q_code.udf_2(SimpleNamespace(spark=spark, pages=pages))
    assert found.columns == ["path", "scanned"]
    assert sorted(map(tuple, found.collect()), key=str) == [("u", True), ("u", True), ("v", None), ("w", True)]


def test_first_places_of_several_roots(spark):
    """u is first at 1 below a, but what u calls third is first at 1.2.3 below b."""
    calls = [("a", "u", 1), ("b", "v", 1), ("v", "x", 1), ("v", "u", 2), ("u", "p", 1), ("u", "q", 2), ("u", "w", 3)]
    edges = spark.createDataFrame([("f", *c) for c in calls], CALL)
    listed = graph.tree_listing(edges, graph.roots_of(edges)).where("node IN ('u', 'w')").collect()
    assert sorted((r.node, list(r.place), r.recursive) for r in listed) == [("u", [1], False), ("u", [1, 2], True), ("w", [1, 3], True)]


def test_snippets_and_fields_of_an_entity_do_not_meet(spark):
    """300 snippets in 3 flows use one entity of 300 fields: no step of the plan gives 90,000 rows."""
    n = 300
    ids = spark.range(n)
    flows = spark.range(3).selectExpr("concat('f', id) AS key", "array('ExecutionFlow') AS labels", "concat('Flow ', id) AS name")
    node = lambda key, label: ids.selectExpr(f"concat('{key}', id) AS key", f"array('{label}') AS labels", "'n' AS name")
    nodes = flows.unionByName(node("s", "Snippet")).unionByName(node("c", "DBCall")).unionByName(node("d", "DatabaseField"))
    nodes = nodes.unionByName(spark.range(1).selectExpr("'e' AS key", "array('DatabaseEntity') AS labels", "'e' AS name"))
    rest = {c: "STRING" for c in ("function_name", "class_name", "file_path", "file_name", "type", "root_type", "topic", "business_summary", "description", "short_summary", "snippet")}
    nodes = nodes.select("*", F.lit(1).alias("project_id"), F.lit(1).alias("run_id"), F.lit(0).alias("execution_order"), *[F.lit(None).cast(t).alias(c) for c, t in rest.items()])
    link = lambda src, rel, dst: ids.selectExpr(f"{src} AS src_key", f"'{rel}' AS rel_type", f"{dst} AS dst_key", "1 AS execution_order", "CAST(1 AS BIGINT) AS global_execution_order", "true AS starts_flow")
    rels = link("concat('s', id)", "PARTICIPATES_IN_FLOW", "concat('f', id % 3)").unionByName(link("concat('s', id)", "CONTAINS_DB_CALLS", "concat('c', id)"))
    rels = rels.unionByName(link("concat('c', id)", "ACCESSES", "'e'")).unionByName(link("'e'", "HAS_FIELD", "concat('d', id)"))
    found = g.topic_nodes(nodes, rels, 1, 1)
    rows = {r.node_key: r for r in found.collect()}
    assert (rows["d7"].ef_key, rows["d7"].parent_snippet_key, rows["e"].parent_snippet_key) == ("f0", "e", "s0")
    assert max(row_counts(found)) < n * n


def test_gaps_and_extra_callees_are_not_shuffled_as_pairs(spark):
    """200 flows (snippets) know a function with 200 callees: 40,000 pairs, of which no exchange has to move any."""
    n = 200
    edge = {"seq": "id", "caller": "'F'", "callee": "concat('G', id)", "caller_file": "''", "callee_file": "''", "caller_class": "''", "callee_class": "''", "extraction_method": "'neo4j'"}
    a = spark.range(n).selectExpr("concat('f', id) AS flow_key", *[f"{e} AS {c}" for c, e in edge.items()])
    stored = spark.range(n).selectExpr("id AS seq", "'a.pas::T::F' AS caller", "concat('b.pas::T::X.G', id) AS callee", "0.5D AS confidence")
    gaps = diff.coverage_gaps(a, a.limit(0), stored)
    assert len(gaps.collect()) == n * n - n
    assert max(row_counts(gaps, "shuffleRecordsWritten")) < 3 * n
    truth = spark.range(n).selectExpr("concat('s', id) AS snippet_key", "'f' AS caller_func", "concat('g', id) AS callee_func")
    extra = coverage.extra_callees(truth, truth.select("snippet_key", "caller_func"), coverage.stored_calls(stored))
    assert len(extra.collect()) == n * n - n
    assert max(row_counts(extra, "shuffleRecordsWritten")) < 3 * n


def test_edges_are_shuffled_once(spark):
    """All tiers are found inside the buckets of the stored keys."""
    rows = [("f", i, f"T.c{i % 9}" if i % 2 else f"c{i % 9}", f"e{i % 7}", "x", "y", "", "", "regex" if i % 3 else "neo4j") for i in range(300)]
    names = ["flow_key", "seq", "caller", "callee", "caller_file", "callee_file", "caller_class", "callee_class", "extraction_method"]
    a, b = spark.createDataFrame(rows[:200], names), spark.createDataFrame(rows[100:], names)
    found = diff.diff_edges(a, b)
    assert found.count() > 0 and len(found.collect()) > 0
    assert not row_counts(found, "shuffleRecordsWritten")


def test_pairs_of_flows_are_counted_where_edges_are_stored(spark):
    """The scores are those of the edges; nothing but sums per flow is shuffled for them."""
    rows = [(f"f{i % 2}", i, f"T.c{i % 9}" if i % 4 else f"c{i % 9}", f"e{i % 41}", "x", "y", "", "", "regex" if i % 3 else "neo4j") for i in range(900)]
    names = ["flow_key", "seq", "caller", "callee", "caller_file", "callee_file", "caller_class", "callee_class", "extraction_method"]
    a, b = spark.createDataFrame(rows[:600], names), spark.createDataFrame(rows[300:], names)
    verified, scores = diff.diff_flows(a, b)
    got = scores.collect()
    assert sorted(map(str, got)) == sorted(map(str, diff.flow_scores(diff.diff_edges(a, b), a, b).collect())) and len(got) == 2
    assert max(row_counts(scores, "shuffleRecordsWritten")) < 50


def test_large_inputs_are_not_dealt_out_again(spark, tmp_path):
    """A table read in many parts gives a stored table without a shuffle, a single file is dealt out."""
    from kgaudit.workload import load, registry

    load()
    dealt, real = [], type(spark.range(1)).repartition
    for files in (1, 16):
        spark.range(160).selectExpr("id AS p_partkey", "'a b' AS p_name", "'B#1' AS p_brand", "'T' AS p_type", "1 AS p_size").repartition(files).write.parquet(f"{tmp_path}/{files}/part.parquet")
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(type(spark.range(1)), "repartition", lambda df, *n: dealt.append(files) or real(df, *n))
            assert registry.Tables(spark, f"{tmp_path}/{files}").code_index.count() == 160
    assert dealt == [1]


def test_names_nobody_calls_are_not_spread_over_leads(spark):
    """500 candidates of other names meet no call: nothing but their names is compared, and no side is broadcast."""
    chunks = spark.range(500).selectExpr("concat('a/b/c/u', id, '.pas::::F', id) AS chunk_id", "concat('a/b/c/u', id, '.pas') AS path", "concat('F', id) AS function_name", "id AS seq")
    called = spark.createDataFrame([("f7", "a/x.pas"), ("F8", "a/b/c/u8.pas"), ("gone", "q")], "callee STRING, caller_file STRING")
    found = calls.resolve_callees(called, chunks)
    assert sorted((r.callee, r.callee_chunk) for r in found.collect()) == [("F8", "a/b/c/u8.pas::::F8"), ("f7", "a/b/c/u7.pas::::F7")]
    assert max(row_counts(found)) < 500
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_name_leaves_its_chunk_once(spark):
    """A name that is called with parentheses and stands alone is one row; a form's counts only when called."""
    text = "procedure F;\nbegin\n  G(1);\n  H;\n  call K;\n  PPP;\nend;"
    chunks = spark.createDataFrame([("c", "a.pas", "pascal", "F", text)], "chunk_id STRING, path STRING, language STRING, function_name STRING, content STRING")
    known = spark.createDataFrame([("G", False), ("HHH", False), ("K", True), ("PPP", True), ("CALL", False)], "name STRING, is_form BOOLEAN")
    rows = sorted(map(tuple, calls.known_mentions(chunks, known).collect()), key=str)
    assert rows == [("c", "CALL", 3, True), ("c", "G", 1, False), ("c", "K", 2, False), ("c", "PPP", None, False)]
    long = chunks.withColumn("content", F.lit("procedure F;\n  GGG(1);\n  call KKK; HHH;"))
    names = spark.createDataFrame([("GGG", False), ("KKK", True), ("HHH", False)], "name STRING, is_form BOOLEAN")
    mentions = calls.known_mentions(long, names)
    assert sorted(map(tuple, calls.calls_of(mentions).collect())) == [("c", "GGG", 0.7), ("c", "HHH", 0.6), ("c", "KKK", 0.8)]
    assert sorted(map(tuple, calls.supplemented_calls(mentions).collect())) == [("c", "GGG", 0.7), ("c", "HHH", 0.55)]


def test_small_levels_are_followed_several_at_once(spark, monkeypatch):
    """A chain of 40 calls with a short cut and a cycle, and 400 callers that nobody calls."""
    calls_made, real = [], graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: calls_made.append(1) or real(df))
    chain = [(f"N{i}", f"N{i + 1}") for i in range(40)] + [("N3", "N20"), ("N40", "N1")] + [(f"X{i}", f"Y{i}") for i in range(400)]
    sites = spark.createDataFrame([(a, "A.PAS", b, "a.pas", "a.pas", "", b, "", 1.0, 1) for a, b in chain], "caller_key STRING, caller_path STRING, callee_key STRING, callee_file STRING, caller_file STRING, caller_class STRING, callee STRING, callee_class STRING, confidence DOUBLE, seq INT")
    starts = spark.createDataFrame([("f", "N0", "a.pas", "")], "flow_key STRING, start STRING, start_file STRING, prefix STRING")
    depth = {(r.caller, r.callee): r.depth for r in graph.traverse(starts, sites).collect()}
    at = lambda i: i if i < 20 else min(i, i - 16)
    assert depth == {(a, b): at(int(a[1:])) + 1 for a, b in chain if a[0] == "N"}
    assert len(calls_made) < 12
    assert {r.callee for r in graph.traverse(starts, sites, 3).collect()} == {"N1", "N2", "N3"}


def test_common_keys_are_grouped_not_joined(spark):
    names = "caller STRING, caller_file STRING, callee STRING, callee_file STRING"
    catalog = spark.createDataFrame([("a", "x/u.pas", "b", ""), ("A", "u.pas", "B", None), ("a", "u.pas", "", ""), ("c", "", "d", "")], names)
    stored = spark.createDataFrame([("A ", "U.PAS", "b", ""), ("a", "u.pas", "", ""), ("d", "", "c", "")], names)
    found = edge_audit.common_keys(catalog, stored)
    assert list(map(tuple, found.collect())) == [("A", "U.PAS", "B", "")]
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_roots_of_one_class_are_dealt_to_several_tasks(spark):
    """300 roots of a class of 100 members: every pair, and no task has most of them."""
    index = spark.range(100).selectExpr("concat('M', id) AS function_name", "'a.pas' AS file_path", "'TC' AS class_name")
    roots = spark.range(300).selectExpr("concat('f', id) AS flow_key", "concat('No', id) AS root_function", "'tc' AS root_class")
    sites = spark.createDataFrame([], "caller STRING, caller_class STRING")
    found = graph.resolve_roots(roots, index, sites).where("resolved_via = 'class_members'")
    rows = found.groupBy("flow_key").agg(F.count("start").alias("n"), F.count_distinct("start").alias("d")).collect()
    assert {(r.n, r.d) for r in rows} == {(100, 100)} and len(rows) == 300
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 30_000 and max(sizes) < 20_000


def test_first_gaps_are_those_of_all_gaps(spark):
    """Ranked like all gaps; 100 flows that know a function of 100 callees make no 10,000 pairs."""
    edge = {"seq": "id", "caller_file": "''", "callee_file": "''", "caller_class": "''", "callee_class": "''", "extraction_method": "'neo4j'"}
    side = lambda caller, callee: spark.range(400).selectExpr("concat('f', id % 100) AS flow_key", f"{caller} AS caller", f"{callee} AS callee", *[f"{e} AS {c}" for c, e in edge.items()])
    a, b = side("concat('F', id % 3)", "concat('G', id % 37)"), side("concat('T.F', id % 2)", "concat('G', id % 11)")
    stored = spark.range(300).selectExpr("id AS seq", "concat('a.pas::T::', CASE WHEN id % 5 = 0 THEN 'T.' ELSE '' END, 'f', id % 3) AS caller", "concat('b.pas::T::X.G', floor(id / 3)) AS callee", "0.5D AS confidence")
    every = diff.coverage_gaps(a, b, stored).toPandas().sort_values(["flow_key", "caller", "callee"])
    for n in (1, 4, 150):
        heads = diff.first_gaps(a, b, stored, n)
        got = {(r.flow_key, r.position): (r.caller, r.callee, r.gaps) for r in heads.collect()}
        want = {}
        for flow, part in every.groupby("flow_key"):
            want |= {(flow, i + 1): (r.caller, r.callee, len(part)) for i, r in enumerate(part.head(n).itertuples())}
        assert got == want
        assert n > 4 or max(row_counts(heads)) < len(every) / 4


def test_names_of_a_file_are_found_once(spark):
    """The patterns stand once in the plan, below the join with the wanted functions."""
    files = spark.createDataFrame([("a.py", "def f():\n  g()\n\ndef h(): pass"), ("b.go", "func f() {\n  g()\n}\nfunc h() { }")], "path STRING, content STRING")
    wanted = spark.createDataFrame([(p, f) for p in ("a.py", "b.go", "c.py") for f in ("f", "h", "none")], "path STRING, function_name STRING")
    found = calls.function_bodies(files, wanted)
    assert sorted(map(tuple, found.drop("body").collect())) == [("a.py", "f", 1, 3), ("a.py", "h", 4, 4), ("b.go", "f", 1, 3), ("b.go", "h", 4, 4)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(calls.FINDERS[".go"]) == 1


def test_a_file_of_many_definitions_costs_no_more_than_many_files(spark):
    """The last class seen is found in one pass over a file's definitions: 24,000 of them in one file or in 24."""
    from kgaudit.operators import chunking

    def took(files):
        routines = "concat('TC', id, ' = class', chr(10), 'procedure F', id, ';', chr(10), 'begin', chr(10), 'end;', chr(10), 'procedure G', id, ';', chr(10), 'begin', chr(10), 'end;')"
        texts = spark.range(8000).selectExpr(f"id % {files} AS f", "id", f"{routines} AS r").groupBy("f").agg(F.array_sort(F.collect_list(F.struct("id", "r"))).alias("rs"))
        texts = texts.select(F.concat(F.lit("a/u"), "f", F.lit(".pas")).alias("path"), F.array_join("rs.r", "\n").alias("content"), F.lit("pascal").alias("language"))
        stored = session.checkpointed(texts.coalesce(1))
        found = chunking.chunk_definitions(stored).where("function_name RLIKE '^[FG]'")
        start = time.time()
        sums = found.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("class_name = concat('TC', substr(function_name, 2))")).alias("same")).first()
        assert tuple(sums) == (16_000, 16_000)
        return time.time() - start

    took(24)
    assert took(1) < 5 * took(24) + 1


def test_a_larger_tree_has_more_files(spark):
    """No file of the scanned tree grows with the parts, and no routine is cut."""
    from kgaudit.sources import files as sf

    seen, real = [], sf.scan_sources
    part = spark.range(40_000).selectExpr("id AS p_partkey")
    try:
        q_code.sf.scan_sources = lambda *a: seen.append(real(*a)) or seen[0].limit(0)
        q_code.scanned_tree(SimpleNamespace(spark=spark, part=part))
    finally:
        q_code.sf.scan_sources = real
    found = seen[0].selectExpr("language", "size(split(content, 'ga[0-9]+', -1)) - 1 AS names", "rtrim(content) AS text").collect()
    assert max(r.names for r in found) <= 2000 and sum(r.names for r in found) == 80_000


def test_entries_of_records_are_shuffled_once(spark):
    """Every entry moves once; a record has at most 50, copies too, and a large part is dealt to several tasks."""
    from kgaudit.sources import exports

    names = "caller, callee, 'x' AS caller_file, 'y' AS callee_file, '' AS caller_class, '' AS callee_class, 1.0D AS confidence, 'regex' AS extraction_method, 'a' AS side, id AS seq"
    edges = spark.range(3000).selectExpr("IF(id < 2400, 'big', concat('f', id % 3)) AS flow_key", "'C' AS caller", "IF(id < 1200, 'same', concat('e', id)) AS callee", "id").selectExpr("flow_key", *names.split(", "))
    verified = edges.selectExpr("flow_key", "caller", "callee", "caller_file", "callee_file", "'confirmed' AS classification", "'full' AS tier", "0.5D AS trust_score").distinct()
    scores = edges.selectExpr("flow_key", "1 AS confirmed").distinct()
    found = exports.flow_result_records(scores, verified, edges, per_record=50, per_task=500)
    rows = found.where("part <> 'summary'").selectExpr("flow_key", "part", "chunk", "json_array_length(json) AS n").collect()
    total = lambda part, flow: sum(r.n for r in rows if (r.part, r.flow_key) == (part, flow))
    assert [total("graph_a", f) for f in ("big", "f0", "f2")] == [2400, 200, 200] and total("confirmed_edges", "big") == 1201
    assert max(r.n for r in rows) <= 50 and len([r for r in rows if r.flow_key == "f1" and r.part == "graph_a"]) == 4
    assert len({r.chunk for r in rows if r.flow_key == "big" and r.part == "graph_a"}) == 5
    graphs = found.where("part = 'graph_a'")
    graphs.collect()
    # A shuffle and its stage both show the count.
    assert [n for n in row_counts(graphs, "shuffleRecordsWritten") if n >= 3000] == [3000, 3000]


def test_order_is_checked_without_positions(spark, monkeypatch):
    """Equal to the positions, also where every caller is cut into many slices; edges are shuffled once."""
    rng = random.Random(5)
    names = ["T.C0", "U.C0", "C0", "T.C1", "C1", "T.C2", "V.C3"]

    def side(seed, some):
        return spark.createDataFrame([(f"f{rng.randrange(3)}", c, f"e{rng.randrange(90)}" if c != "C1" else f"e{i}", i if c in ("C1", "T.C1") else rng.randrange(40)) for i in range(300) for c in some], "flow_key STRING, caller STRING, callee STRING, seq INT")

    a, b = side(1, names), side(2, ["T.C0", "C0", "C1", "C2"])
    want = sorted(map(tuple, diff.order_check(diff.call_order(a, b)).collect()))
    assert len({w[1] for w in want}) == 6 and {w[3] for w in want} == {True, False}
    ranges = []
    monkeypatch.setattr(session, "checkpointed", lambda df: ranges.append(1) or df)
    for per_slice in (7, 100_000):
        assert sorted(map(tuple, diff.order_kept(a, b, per_slice).collect())) == want
    assert not ranges


def row_counts(df, metric="numOutputRows"):
    """A metric of every step of the executed plan that has it."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        step = todo.pop()
        name = step.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(step.executedPlan())
        if name.endswith("QueryStageExec"):
            todo.append(step.plan())
        found = step.metrics().get(metric)
        if found.isDefined():
            out.append(found.get().value())
        kids = step.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return out
