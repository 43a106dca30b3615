"""Cases of the fourth round's findings."""

import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from kgaudit import session
from kgaudit.operators import coverage, diff, graph
from kgaudit.sources import graph as g
from test_r03 import row_counts

EDGE = {"seq": "id", "caller_file": "''", "callee_file": "''", "caller_class": "''", "callee_class": "''", "extraction_method": "'neo4j'"}


def test_known_callees_are_not_repeated_for_every_place(spark):
    """100 flows know 100 callees of a function of 300: what they know is shuffled once, not with each of its places."""
    calls = spark.range(10_000).selectExpr("concat('f', id % 100) AS flow_key", "'F' AS caller", "concat('CALLEE_', floor(id / 100))  AS callee", *[f"{e} AS {c}" for c, e in EDGE.items()])
    stored = spark.range(300).selectExpr("id AS seq", "'a.pas::T::F' AS caller", "concat('b.pas::T::CALLEE_', id) AS callee", "0.5D AS confidence")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        heads = diff.first_gaps(calls, calls.limit(0), stored, 5)
        found = heads.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(found) == 500 and {r.gaps for r in found} == {200}
    assert sorted(r.callee for r in found if r.flow_key == "f7") == [f"CALLEE_{i}" for i in range(100, 105)]
    assert max(row_counts(heads, "dataSize"), default=0) < 1_000_000


def test_first_gaps_of_many_functions(spark):
    """Functions whose callers are written in several ways, so that the gaps of two of them lie in turns; flows that know much, little and nothing."""
    pick = random.Random(3)
    names = ["F", "T.F", "A.F", "G", "Z.G", "B.G", "H", "f"]
    sites = [(i, f"a.pas::T::{pick.choice(names)}", f"b.pas::T::{pick.choice(['', 'X.'])}c{pick.randrange(12)}", 0.5) for i in range(120)]
    stored = spark.createDataFrame(sites, "seq BIGINT, caller STRING, callee STRING, confidence DOUBLE")
    rows = [(f"f{flow}", pick.choice(["F", "X.G", "H", "none"]), f"C{pick.randrange(14)}") for flow in range(6) for _ in range(flow * flow * 3)]
    edges = spark.createDataFrame(rows, "flow_key STRING, caller STRING, callee STRING").selectExpr("*", "CAST(1 AS BIGINT) AS id").selectExpr(
        "flow_key", "caller", "callee", *[f"{e} AS {c}" for c, e in EDGE.items()])
    a = edges.withColumns({c: F.upper(c) for c in ("caller", "callee")})
    every = diff.coverage_gaps(a, a.limit(0), stored).toPandas().sort_values(["flow_key", "caller", "callee"])
    assert len(every) > 40
    for n in (1, 3, 7, 100):
        got = {(r.flow_key, r.position): (r.caller, r.callee, r.gaps) for r in diff.first_gaps(a, a.limit(0), stored, n).collect()}
        want = {}
        for flow, part in every.groupby("flow_key"):
            want |= {(flow, i + 1): (r.caller, r.callee, len(part)) for i, r in enumerate(part.head(n).itertuples())}
        assert got == want


def _calls(spark, sites):
    """Located sites of (seq, caller file, caller, callee file, callee) and the index of their functions."""
    stored = spark.createDataFrame([(i, f"{cf}::TC::{c}", f"{ef}::TC::{e}", 0.5) for i, cf, c, ef, e in sites], "seq BIGINT, caller STRING, callee STRING, confidence DOUBLE")
    index = spark.createDataFrame(sorted({(c, cf) for _, cf, c, _, _ in sites}), "function_name STRING, file_path STRING").withColumns({"class_name": F.lit("TC"), "language": F.lit("pascal")})
    return graph.located_sites(graph.split_sites(stored), index)


def test_sites_are_numbered_once_for_all_flows(spark):
    """60 flows visit a function of 100 sites: none of its 6,000 edges is shuffled to be numbered."""
    sites = _calls(spark, [(i, "a.pas", "F", "b.pas", f"G{i % 40}") for i in range(100)])
    starts = spark.range(60).selectExpr("concat('f', id) AS flow_key", "'F' AS start", "'a.pas' AS start_file", "'' AS prefix")
    placed = graph.callee_order(graph.traverse(starts, sites, ordered=True))
    found = placed.collect()
    assert len(found) == 6000 and sorted(r.execution_order for r in found if r.flow_key == "f3") == list(range(1, 101))
    assert max(row_counts(placed, "shuffleRecordsWritten"), default=0) < 1000


def test_order_given_by_traverse(spark):
    """Starts without a file and with one, repeated under another prefix, without a flow, and paths in two spellings: as if all edges were numbered."""
    pick = random.Random(5)
    files = ["app/a.pas", "App/A.pas", "lib/b.pas", ""]
    sites = _calls(spark, [(i % 9 or None, pick.choice(files), f"F{pick.randrange(7)}", pick.choice(files), f"F{pick.randrange(9)}") for i in range(90)])
    starts = [("f1", "F1", "", ""), ("f1", "F1", "app/a.pas", ""), ("f1", "F1", "", "app"), ("f2", "F2", "lib/b.pas", "lib"), ("f3", "F3", "App/A.pas", "app"), (None, "F4", "", ""), ("f5", "F5", "", None), ("f6", "F1", "app/a.pas", "")]
    starts = spark.createDataFrame(starts, "flow_key STRING, start STRING, start_file STRING, prefix STRING")
    edges = graph.traverse(starts, sites, 3)
    # Sites that are alike but for their number may stand in any order.
    shown = lambda df: sorted(map(str, df.select("flow_key", "caller", "caller_file", "callee", "callee_file", "depth", "seq", "execution_order").collect()))
    alike = ["flow_key", "caller", "caller_file", "seq", "callee", "callee_file", "confidence"]
    ranked = lambda df: df.groupBy(*alike).agg(F.sort_array(F.collect_list("execution_order")).alias("at"), F.sort_array(F.collect_list("depth")).alias("depths"))
    ordered = graph.traverse(starts, sites, 3, ordered=True)
    assert sorted(map(str, ordered.drop("execution_order").collect())) == sorted(map(str, edges.collect()))
    assert ordered.where("NOT resolved AND execution_order IS NOT NULL").isEmpty()
    want, got = graph.callee_order(edges), graph.callee_order(ordered)
    assert len(shown(want)) > 100 and sorted(map(str, ranked(got).collect())) == sorted(map(str, ranked(want).collect()))


def _written(df, path):
    """Rows, bytes, and rows of the largest file of a written result."""
    df.write.parquet(str(path))
    files = [(pq.ParquetFile(f).metadata.num_rows, f.stat().st_size) for f in path.glob("*.parquet")]
    return sum(n for n, _ in files), sum(b for _, b in files), max(n for n, _ in files)


def test_pairs_made_by_lists_are_those_of_a_join(spark):
    pick = random.Random(7)
    row = lambda i: (pick.choice([None, "a", "b", "c", "d"]), pick.choice([None, 1, 2, 3]), i % 40)
    left = spark.createDataFrame([row(i) for i in range(60)], "k STRING, l INT, x INT")
    right = spark.createDataFrame([r for r in map(row, range(90)) if r[0] != "d"], "k STRING, l INT, y INT")
    for keys, b in ((["k"], right.withColumnRenamed("l", "z")), (["k", "l"], right)):
        for how in ("inner", "left"):
            for size in (1, 4, 504):
                want = left.join(b, keys, how).select(*left.columns, *[c for c in b.columns if c not in keys])
                got = session.paired(left, b, keys, how, size)
                assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert session.paired(left, right.limit(0), ["k", "l"]).isEmpty()
    assert session.paired(left, right.limit(0), ["k", "l"], "left").count() == 60


def test_fields_of_an_entity_are_written_small_and_by_several_tasks(spark, tmp_path):
    """300 snippets use an entity of 5,000 fields: 1.5 million rows, in 2.0 MB by one task before, in 0.2 MB by several now."""
    ids = spark.range(5000)
    node = lambda rows, key, label: rows.selectExpr(f"concat('{key}', id) AS key", f"array('{label}') AS labels")
    nodes = node(spark.range(1), "e", "DatabaseEntity").unionByName(node(ids, "d", "DatabaseField")).unionByName(node(ids.where("id < 300"), "c", "DBCall"))
    link = lambda rows, src, rel, dst: rows.selectExpr(f"{src} AS src_key", f"'{rel}' AS rel_type", f"{dst} AS dst_key")
    few = ids.where("id < 300")
    rels = link(few, "concat('s', id)", "CONTAINS_DB_CALLS", "concat('c', id)").unionByName(link(few, "concat('c', id)", "ACCESSES", "'e0'")).unionByName(link(ids, "'e0'", "HAS_FIELD", "concat('d', id)"))
    members = few.selectExpr("concat('f', id % 7) AS flow_key", "concat('s', id) AS key")
    rows, size, largest = _written(g.flow_entities(nodes, rels, members), tmp_path / "r")
    assert rows == 1_500_000 and size < 0.2 * rows and largest < rows


def test_members_of_a_class_are_written_small(spark, tmp_path):
    """300 roots name a class of 5,000 members."""
    roots = spark.range(300).selectExpr("concat('f', id) AS flow_key", "concat('none', id) AS root_function", "IF(id < 0, 'x', 'TC') AS root_class")
    index = spark.range(5000).selectExpr("concat('m', id) AS function_name", "'a.pas' AS file_path", "IF(id < 0, 'x', 'TC') AS class_name")
    none = spark.createDataFrame([], "caller STRING, caller_class STRING")
    rows, size, largest = _written(graph.resolve_roots(roots, index, none), tmp_path / "r")
    assert rows == 1_500_000 and size < 0.2 * rows and largest < rows


def test_pairs_left_out_are_cut_from_the_lists(spark):
    """All, some, none, the first and the last of a list; rows that come twice; a null is like no pair."""
    pick = random.Random(11)
    left = [(pick.choice([None, "f", "g", "h"]), pick.choice("abc")) for _ in range(40)]
    right = [(k, i) for k in "ab" for i in range(9)]
    out = {(o, k, i) for o, k in set(left) for i in range(9) if (k == "a" and o == "f") or (o, i) in (("g", 0), ("g", 8), ("h", 3), ("h", 4), (None, 5))}
    want = sorted(str((o, k, i)) for o, k in left for k2, i in right if k == k2 and (o is None or (o, k, i) not in out))
    made = [spark.createDataFrame(rows, names) for rows, names in ((left, "o STRING, k STRING"), (right, "k STRING, i INT"), (sorted(out, key=str), "o STRING, k STRING, i INT"))]
    for size in (1, 2, 4, 504):
        got = session.paired(made[0], made[1], ["k"], size=size, without=made[2], own="o", item="i").collect()
        assert sorted(str(tuple(r)) for r in got) == want


def test_extra_callees_are_written_small(spark, tmp_path):
    """300 snippets of a function of 5,000 callees, of which each names one."""
    stored = spark.range(5000).selectExpr("'F' AS caller", "IF(id % 9 = 0, concat('X.G', id), concat('G', id)) AS callee", "'' AS callee_class", "'' AS callee_file")
    truth = spark.range(300).selectExpr("concat('s', id) AS snippet_key", "'f' AS caller_func", "concat('g', id * 3) AS callee_func")
    found = coverage.extra_callees(truth, truth.select("snippet_key", "caller_func"), stored.withColumn("caller", F.expr("IF(callee = '', 'x', caller)")))
    assert found.where("snippet_key = 's3'").count() == 4999 and found.where("snippet_key = 's3' AND callee = 'X.G9'").isEmpty()
    rows, size, largest = _written(found, tmp_path / "r")
    assert rows == 300 * 4999 and size < 0.4 * rows and largest < rows
