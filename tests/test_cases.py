"""Small literal cases and brute-force comparisons."""

import random
from collections import deque
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from kgaudit.functions import scalars as fx
from kgaudit.operators import calls, changes, checklist, chunking, coverage, diff, graph, profile, roadmap, schema_diff, text_joins, topics
from kgaudit.operators.normalize import normalize_edges
from kgaudit.session import first_per, ordinal
from kgaudit.sources import schema_files

EDGE = "flow_key STRING, seq BIGINT, caller STRING, callee STRING, caller_file STRING, callee_file STRING, caller_class STRING, callee_class STRING, extraction_method STRING"


def edges(spark, *rows):
    full = [("EF", i, *r, *[""] * (6 - len(r)), "neo4j") for i, r in enumerate(rows)]
    return normalize_edges(spark.createDataFrame(full, EDGE))


def tiers(spark, a, b):
    rows = diff.diff_edges(edges(spark, *a), edges(spark, *b)).collect()
    return sorted((r.tier, r.caller, r.callee) for r in rows), {r.tier: round(r.trust_score, 4) for r in rows}


# ------------------------------------------------------------------ flow diff


def test_full_match_ignores_folders_and_case(spark):
    a = [("Run", "Pay", "C:\\app\\Main.pas", "/x/Pay.pas", "TMain", "TPay")]
    b = [("run", "pay", "src/main.PAS", "src/pay.pas", "tmain", "tpay")]
    assert tiers(spark, a, b)[0] == [("full", "RUN", "PAY")]


def test_missing_class_falls_to_name_and_file(spark):
    a = [("Run", "Pay", "m.pas", "p.pas")]
    b = [("Run", "Pay", "m.pas", "p.pas", "T", "U")]
    assert tiers(spark, a, b) == ([("name_file", "RUN", "PAY")], {"name_file": 0.9025})


def test_qualified_names_match_bare_names(spark):
    a = [("TForm1.Click", "Show", "m.pas", "p.pas"), ("TForm1.Open", "Load")]
    b = [("Click", "Show", "m.pas", "p.pas"), ("Open", "Load", "q.pas", "r.pas")]
    found, score = tiers(spark, a, b)
    assert found == [("bare_name_file", "TFORM1.CLICK", "SHOW"), ("bare_name_only", "TFORM1.OPEN", "LOAD")]
    assert score == {"bare_name_file": 0.8844, "bare_name_only": 0.76}


def test_phantom_missing_and_scores(spark):
    a, b = edges(spark, ("A", "B"), ("A", "C")), edges(spark, ("A", "B"), ("A", "D"))
    verified = diff.diff_edges(a, b)
    assert {(r.callee, r.classification) for r in verified.collect()} == {("B", "confirmed"), ("C", "phantom"), ("D", "missing")}
    score = diff.flow_scores(verified, a, b).first()
    assert score.flow_trust_score == 0.5
    assert score.graph_trust_score == pytest.approx((0.95 + 0.2 * 0.5) / 1.5)


def test_one_name_pair_in_two_tiers_can_exceed_one(spark):
    a = edges(spark, ("A", "B", "f.pas", "g.pas", "K", "L"), ("A", "B", "f.pas", "g.pas", "", ""))
    b = edges(spark, ("A", "B", "f.pas", "g.pas", "K", "L"))
    verified = diff.diff_edges(a, b)
    assert sorted(r.tier for r in verified.collect()) == ["full", "name_file"]
    assert diff.flow_scores(verified, a, b).first().flow_trust_score == 2.0


def test_empty_sides(spark):
    none = edges(spark, ("A", "B")).limit(0)
    assert diff.diff_edges(none, none).count() == 0
    assert {r.tier for r in diff.diff_edges(edges(spark, ("A", "B"), ("A", "C")), none).collect()} == {"phantom"}
    assert {r.tier for r in diff.diff_edges(none, edges(spark, ("A", "B"))).collect()} == {"missing"}


def test_call_order(spark):
    a = edges(spark, ("M", "X"), ("M", "Y"), ("M", "Z"), ("N", "X"))
    same, swapped = edges(spark, ("M", "X"), ("M", "Q"), ("M", "Z")), edges(spark, ("M", "Z"), ("M", "X"))
    assert {(r.caller, r.common, r.in_order) for r in diff.order_check(diff.call_order(a, same)).collect()} == {("M", 2, True)}
    assert {(r.caller, r.in_order) for r in diff.order_check(diff.call_order(a, swapped)).collect()} == {("M", False)}


def test_every_catalog_pair_is_confirmed_or_phantom(spark):
    rng = random.Random(7)
    names = ["A", "B", "T.A", "T.B", "C"]

    def side():
        return edges(spark, *[tuple(rng.choice(names) for _ in range(2)) + tuple(rng.choice(["", "f.pas", "g.pas"]) for _ in range(2)) for _ in range(30)])

    for _ in range(3):
        a, b = side(), side()
        verified = diff.diff_edges(a, b).collect()
        pairs = {(r.caller, r.callee) for r in a.collect()}
        confirmed = {(r.caller, r.callee) for r in verified if r.classification == "confirmed"}
        phantom = {(r.caller, r.callee) for r in verified if r.classification == "phantom"}
        missing = {(r.caller, r.callee) for r in verified if r.classification == "missing"}
        assert confirmed | phantom == pairs and not confirmed & phantom
        bare = {(c.split(".")[-1], e.split(".")[-1]) for c, e in confirmed}
        assert not {(c.split(".")[-1], e.split(".")[-1]) for c, e in missing} & bare
        assert phantom == {(r.caller, r.callee) for r in diff.phantom_pairs(a, b).collect()}
        assert missing == {(r.caller, r.callee) for r in diff.missing_pairs(a, b).collect()}


# ------------------------------------------------------------------ helpers


def test_ordinal_equals_row_number_on_a_hot_key(spark):
    rows = [("hot" if i % 3 else "cold", (i * 7919) % 500, i) for i in range(900)]
    df = spark.createDataFrame(rows, "k STRING, s BIGINT, t INT")
    got = {(r.t, r.n) for r in ordinal(df, ["k"], "s", ["t"], "n").collect()}
    want = set()
    for key in ("hot", "cold"):
        ordered = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        want |= {(r[2], i + 1) for i, r in enumerate(ordered)}
    assert got == want


def test_ordinal_splits_a_key_with_one_sequence_value(spark):
    """One key owns all rows and ``seq`` is constant; the ties alone spread the rows."""
    df = spark.range(4000).selectExpr("'k' AS k", "CAST(0 AS BIGINT) AS s", "(id * 7919) % 4000 AS t")
    placed = ordinal(df, ["k"], "s", ["t"], "n")
    assert placed.where("n <> t + 1").isEmpty() and placed.count() == 4000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranges = df.repartitionByRange("k", "s", "t").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(ranges) > 1


def test_first_per(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, None)], "k STRING, o INT, v STRING")
    assert {tuple(r) for r in first_per(df, ["k"], [F.col("o")]).collect()} == {("a", 1, "y"), ("b", 5, None)}


@pytest.mark.parametrize("path, want", [("", ""), ("C:\\a\\Pay.pas", "PAY.PAS"), (" /x/y.pas ", "Y.PAS"), ("plain", "PLAIN")])
def test_norm_file(spark, path, want):
    assert spark.createDataFrame([(path,)], "p STRING").select(fx.norm_file("p")).first()[0] == want


def test_chunk_ids(spark):
    ids = ["a/b.pas::::F", "a/b.pas::T::F", "a/b.pas", "RAVII::::RAVII", "a/b.pas::T::"]
    df = spark.createDataFrame([(i,) for i in ids], "c STRING").select(fx.chunk_file("c"), fx.chunk_class("c"), fx.chunk_function("c"))
    assert [tuple(r) for r in df.collect()] == [("a/b.pas", "", "F"), ("a/b.pas", "T", "F"), ("a/b.pas", "", ""), ("RAVII", "", "RAVII"), ("a/b.pas", "T", "T")]


# ------------------------------------------------------------------ schema


def test_schema_json_shapes_agree(spark):
    one = '{"name":"T","columns":[{"name":"a","data_type":"INT"},{"name":"b","is_nullable":false,"is_primary_key":true}]}'
    docs = spark.createDataFrame([(f'{{"tables":[{one}]}}',), (f"[{one}]",)], "value STRING")
    rows = [tuple(r) for r in schema_files.parse_schema_json(docs).collect()]
    assert rows[:2] == rows[2:] == [("T", "a", "INT", True, False), ("T", "b", "", False, True)]


def test_schema_compare(spark):
    cols = "table_name STRING, column_name STRING, data_type STRING, seq BIGINT"
    db = spark.createDataFrame([("Card", "ID", "INT", 1), ("Card", "NAME", "CHAR", 2), ("Gone", "X", "INT", 3)], cols)
    kg = spark.createDataFrame([("CARD", "id", " int ", 1), ("CARD", "name", "TEXT", 2), ("CARD", "more", "", 3), ("Only", None, None, 4)], cols)
    tables, columns = schema_diff.compare_tables(db, kg), schema_diff.compare_columns(db, kg)
    assert {(r.table_name, r.status) for r in tables.collect()} == {("Card", "MATCHED"), ("Gone", "ONLY_IN_DB"), ("Only", "ONLY_IN_NEO4J")}
    assert {(r.column_name, r.status) for r in columns.collect()} == {("ID", "MATCHED"), ("NAME", "TYPE_MISMATCH"), ("more", "ONLY_IN_NEO4J")}
    total = schema_diff.schema_summary(tables, columns).first()
    assert (total.total_tables, total.matched_tables, total.type_mismatches) == (3, 1, 1)


# ------------------------------------------------------------------ graph


def random_edges(spark, n=12, m=30, seed=1):
    rng = random.Random(seed)
    rows = [("f", f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}", i) for i in range(m)]
    return rows, spark.createDataFrame(rows, "flow_key STRING, caller STRING, callee STRING, exec_order BIGINT")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_journey_positions(spark, seed):
    rows, df = random_edges(spark, seed=seed)
    roots = sorted({r[1] for r in rows} - {r[2] for r in rows}) or [rows[0][1]]
    kids = {}
    for _, c, e, _ in rows:
        kids.setdefault(c, [])
        if e not in kids[c]:
            kids[c].append(e)
    order, queue = ["f"], deque(roots)
    seen = set(roots)
    while queue:
        node = queue.popleft()
        order.append(node)
        for k in kids.get(node, []):
            if k not in seen:
                seen.add(k)
                queue.append(k)
    for _, c, e, _ in rows:
        for k in (c, e):
            if k not in seen:
                seen.add(k)
                order.append(k)
    got = graph.journey_tree(df).orderBy("position").collect()
    assert [r.node for r in got] == order


def test_closure_terminates_on_cycles(spark):
    calls_df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "e")], "caller STRING, callee STRING")
    roots = spark.createDataFrame([("a",)], "key STRING")
    assert {(r.key, r.depth) for r in graph.closure(roots, calls_df).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_listing_opens_a_node_once(spark):
    df = spark.createDataFrame([("f", "r", "a", 1), ("f", "r", "b", 2), ("f", "a", "b", 1), ("f", "b", "c", 1), ("f", "c", "c", 1)], "flow_key STRING, caller STRING, callee STRING, exec_order BIGINT")
    lines = [(r.node, r.depth, r.recursive) for r in graph.tree_listing(df, graph.roots_of(df)).orderBy("place").collect()]
    assert lines == [("r", 0, False), ("a", 1, False), ("b", 2, False), ("c", 3, False), ("c", 4, True), ("b", 1, True)]


def test_list_parts_bounds_rows(spark):
    df = spark.createDataFrame([("k", i, f"v{i:02}") for i in range(25)], "k STRING, s BIGINT, v STRING")
    parts = graph.list_parts(df, ["k"], F.col("v"), "s", ["v"], size=10).orderBy("part").collect()
    assert [len(p["items"]) for p in parts] == [10, 10, 5]
    assert [v for p in parts for v in p["items"]] == [f"v{i:02}" for i in range(25)]


def test_traversal_unresolved_self_call_and_scope(spark):
    index = spark.createDataFrame([("A", "app/a.pas", ""), ("B", "app/b.pas", ""), ("Z", "lib/z.pas", "")], "function_name STRING, file_path STRING, class_name STRING")
    stored = spark.createDataFrame([
        (1, "app/a.pas::::A", "app/b.pas::::B", 0.9), (2, "app/a.pas::::A", "app/a.pas::::A", 0.9), (3, "app/b.pas::::B", "::::Nope", 0.9),
        (4, "app/b.pas::::B", "lib/z.pas::::Z", 0.9), (5, "app/b.pas::::B", "app/a.pas::::A", 0.9), (6, "other/a.pas::::A", "lib/z.pas::::Z", 0.9)], "seq BIGINT, caller STRING, callee STRING, confidence DOUBLE")
    starts = spark.createDataFrame([("f", "a", "app/a.pas", "app")], "flow_key STRING, start STRING, start_file STRING, prefix STRING")
    out = graph.traverse(starts, graph.located_sites(graph.split_sites(stored), index)).collect()
    assert {(r.caller, r.callee, r.depth, r.resolved) for r in out} == {("A", "B", 1, True), ("A", "A", 1, True), ("B", "Nope", 2, False), ("B", "Z", 2, False), ("B", "A", 2, True)}


def test_checklist_passes_exactly_without_failures(spark):
    failures = spark.createDataFrame([(2, "a"), (2, "b"), (28, "c")], "item_id INT, key STRING")
    items = {r.item_id: r for r in checklist.checklist(failures).collect()}
    assert len(items) == 29 and items[2].failures == 2
    assert {i for i, r in items.items() if not r.passed} == {2, 28}


# ------------------------------------------------------------------ topics


@pytest.mark.parametrize("topic, want", [
    ("Validate Customer Account", []), ("Process Customer", ["technical_glue", "verb_noun"]), ("Validate data", ["technical_glue"]), ("Customer Account", ["verb_noun"]), ("  ", ["topic_missing"]), (None, ["topic_missing"])])
def test_topic_rules(spark, topic, want):
    assert spark.createDataFrame([(topic,)], "topic STRING").select(topics.rule_issues("topic")).first()[0] == want


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def varied(rng, base, count, chars, edits):
    names = set(base)
    while len(names) < count:
        s = list(rng.choice(base))
        for _ in range(rng.randrange(1, edits)):
            i = rng.randrange(len(s))
            rng.choice([lambda: s.insert(i, rng.choice(chars)), lambda: s.pop(i) if len(s) > 2 else None, lambda: s.__setitem__(i, rng.choice(chars))])()
        name = "".join(s).strip()
        if name:
            names.add(name)
    return names


@pytest.mark.parametrize("threshold", [0.55, 0.7, 0.8, 0.85, 0.95])
def test_similar_topics_equal_brute_force(spark, threshold, monkeypatch):
    monkeypatch.setattr(text_joins, "SALT_ROWS", 5)
    rng = random.Random(3)
    base = ["validate customer account", "check order", "assign ticket owner", "abc", "aaaa aaaa aaaa", "route mail", "prüfe Überweisung"]
    names = varied(rng, base, 500 if threshold == 0.85 else 150, "abcxyz üA ", 5)
    want = {(a, b) for a, b in combinations(sorted(names), 2) if 1 - edit_distance(a, b) / max(len(a), len(b)) >= threshold}
    rows = [(n,) for n in names] + [("abc",), ("",), (None,)]
    got = text_joins.edit_pairs(spark.createDataFrame(rows, "t STRING"), threshold).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want) > 5
    assert all(r.ratio == pytest.approx(1 - edit_distance(r.a, r.b) / max(len(r.a), len(r.b))) for r in got)


@pytest.mark.parametrize("threshold", [0.6, 0.85])
def test_edits_at_starts_and_ends_lose_no_pair(spark, threshold):
    """Texts of 14 to 40 characters, some with 𝄞, with edits heaped at the start, the border of a margin, or the end."""
    rng = random.Random(5)
    names = set()
    for _ in range(12):
        base = [rng.choice("abcdefgh 0123𝄞") for _ in range(rng.randrange(14, 40))]
        for at in (0, 7, 8, 15, 16, len(base) - 9, len(base) - 1):
            s = list(base)
            for _ in range(rng.randrange(1, 7)):
                i = max(0, min(at + rng.randrange(-1, 2), len(s) - 1))
                rng.choice([lambda: s.insert(i, rng.choice("xyz𝄞")), lambda: s.pop(i), lambda: s.__setitem__(i, rng.choice("xyz𝄞"))])()
            names |= {"".join(base), "".join(s)}
    want = {(a, b) for a, b in combinations(sorted(names), 2) if 1 - edit_distance(a, b) / max(len(a), len(b)) >= threshold}
    got = text_joins.edit_pairs(spark.createDataFrame([(n,) for n in names], "t STRING"), threshold).collect()
    assert {(r.a, r.b) for r in got} == want and len(want) > 50


def test_few_candidates_among_topics_that_share_words(spark):
    """20,000 topics of a few common words and a number: under 1 % of all pairs are compared."""
    rng = random.Random(4)
    verbs, things = ["validate", "update", "process", "archive", "notify"], ["customer", "account", "order", "invoice", "shipment", "payment"]
    names = {f"{rng.choice(verbs)} {rng.choice(things)} {rng.choice(things)} {rng.randrange(10**6):06d}" for _ in range(20_500)}
    texts = spark.createDataFrame([(n,) for n in sorted(names)[:20_000]], "t STRING")
    assert text_joins.edit_candidates(texts, 0.85).count() < 0.01 * 20_000 * 19_999 / 2


def test_containment_compares_few_names(spark):
    """Long names that share most of their text meet only where the rare part is the same."""
    rng = random.Random(5)
    stem = "".join(rng.choice("abcdefgh") for _ in range(150))
    names = [stem + f"_{i:04d}_" + "".join(rng.choice("ijklmnop") for _ in range(44)) for i in range(400)]
    parts = [n[rng.randrange(100, 140) : rng.randrange(165, 200)] for n in names[:200]] + ["zz_not_there_1", names[7], "ab", "q"]
    keys = spark.createDataFrame([(n,) for n in names], "key STRING")
    needles = spark.createDataFrame([(p,) for p in parts] + [("",)], "name STRING")
    got = {r.name: r.key for r in text_joins.smallest_holder(needles, keys).collect()}
    assert got == {p: min(n for n in names if p in n) for p in parts if any(p in n for n in names)}
    index = text_joins._index(keys, "key", 3)
    long = needles.selectExpr("name AS needle").where("length(needle) > 3")
    assert text_joins.contained_candidates(long, index, "key", 3).count() < 0.05 * 400 * 202
    back = {(r.name, r.key) for r in text_joins.contained_keys(keys.toDF("name"), needles.toDF("key")).collect()}
    assert back == {(n, p) for n in names for p in parts if p in n}


def test_undo_restores_the_oldest_topic(spark):
    log = spark.createDataFrame([("n", "Snippet", "Snippet", "old", "mid", "u", 1, "f", False), ("n", "Snippet", "Snippet", "mid", "new", "u", 2, "f", False)],
                                "node_key STRING, node_type STRING, node_label STRING, old_topic STRING, new_topic STRING, changed_by STRING, seq BIGINT, execution_flow_key STRING, is_undo BOOLEAN"
                                ).withColumn("changed_at", F.timestamp_seconds("seq"))
    undone = log.unionByName(changes.undo_all(log, F.timestamp_seconds(F.lit(10))).withColumn("seq", F.col("seq") + 100))
    assert changes.current_topics(undone).first().topic == "old" == changes.restored_topics(log).first().topic


def test_unknown_label_is_refused(spark):
    nodes = spark.createDataFrame([("n", "t", ["Secret"])], "key STRING, topic STRING, labels ARRAY<STRING>")
    updates = spark.createDataFrame([(1, "n", "Secret", "x", "f")], "seq BIGINT, node_key STRING, node_label STRING, new_topic STRING, execution_flow_key STRING").withColumn("changed_at", F.timestamp_seconds("seq"))
    with pytest.raises(Exception, match="label not allowed"):
        changes.log_updates(nodes, updates).collect()


# ------------------------------------------------------------------ source code


def code(spark, text, language="pascal", path="src/u.pas"):
    return spark.createDataFrame([(path, text, language)], "path STRING, content STRING, language STRING")


def test_chunker_discards_forward_declarations(spark):
    text = "unit u;\ninterface\nprocedure A;\nprocedure T.B;\nimplementation\n\nprocedure A;\nbegin\nend;\n\n\nprocedure T.B;\nend;\n\n"
    rows = [(r.function_name, r.class_name, r.line_start, r.line_end) for r in chunking.chunk_definitions(code(spark, text)).collect()]
    assert rows == [("u", "", 1, 3), ("B", "T", 4, 5), ("A", "", 7, 9), ("B", "T", 12, 13)]


def test_chunker_whole_file(spark):
    rows = chunking.chunk_definitions(code(spark, "a\nb\n", "other", "x/readme")).collect()
    assert [(r.function_name, r.line_start, r.line_end, r.content) for r in rows] == [("readme", 1, 2, "a\nb\n")]


def test_forms(spark):
    text = "object F: TF\n  OnShow = Go\n  object B: TB\n    OnClick = Go\n    OnHide = Stop\n  end\nend\nobject G: TG\nend\n"
    rows = chunking.chunk_forms(code(spark, text)).collect()
    assert [(r.function_name, r.class_name, r.line_start, r.line_end, r.event_handlers) for r in rows] == [("F", "TF", 1, 7, ["Go", "Stop"]), ("G", "TG", 8, 9, [])]
    assert chunking.chunk_forms(code(spark, "")).count() == 0


def test_blocks_cover_the_text_and_split_at_lines(spark):
    html = "<p>intro</p>\n<article>" + "\n".join("x" * 30 for _ in range(10)) + "</article>\nmiddle\n<nav>n</nav>tail text"
    rows = chunking.chunk_blocks(code(spark, html, "html", "p.html"), size=100).orderBy("start", "part").collect()
    assert [r.block_type for r in rows] == ["preamble"] + ["article"] * 4 + ["preamble", "nav", "epilogue"]
    article = "\n".join(r.text for r in rows if r.block_type == "article")
    assert article == html[html.index("<article>"):html.index("</article>") + len("</article>")]
    assert all(r.chars <= 100 for r in rows)


def test_block_overlap_is_dropped():
    import re

    rules = [("a", re.compile(r"<a(?P<name>\w*)>"), re.compile("</a>")), ("b", re.compile(r"<b(?P<name>\w*)>"), re.compile("</b>"))]
    found = chunking.match_blocks("<a1><b1></b></a><b2>", rules)
    assert [(k, n) for _, _, k, n in found] == [("a", "1"), ("b", "2")]


def test_call_extraction_strategies(spark):
    text = "procedure Main;\n  Pay(1); // Skip(2)\n  s := 'Hide(3)';\n  call Ship;\n  Log + x-Rate;\n  Label: y;\nend;"
    df = spark.createDataFrame([("c", "u.pas", "pascal", "Main", text)], "chunk_id STRING, path STRING, language STRING, function_name STRING, content STRING")
    known = spark.createDataFrame([(n, False) for n in ("PAY", "SKIP", "HIDE", "SHIP", "LOG", "RATE", "LABEL", "MAIN")], "name STRING, is_form BOOLEAN")
    got = {(r.callee, r.confidence) for r in calls.extract_calls(df, known).collect()}
    assert got == {("PAY", 0.70), ("SHIP", 0.80), ("LOG", 0.60)}


def test_callee_resolution_equals_brute_force(spark):
    rng = random.Random(5)
    paths = [f"{a}/{b}/{c}.{e}" for a in ("p", "q") for b in ("x", "y", "z") for c in ("u", "v") for e in ("pas", "dfm")]
    cands = [(f"id{i:03}", rng.choice(paths), rng.choice(["Go", "go", "Stop"]), i) for i in range(60)]
    wants = [(n, p) for n in ("GO", "stop") for p in paths + ["r/x/u.pas", "u.pas"]]

    def stem(p):
        return p.rsplit("/", 1)[-1].rsplit(".", 1)[0].upper()

    def lead(a, b):
        n = 0
        for x, y in zip(a.upper().split("/"), b.upper().split("/")):
            if x != y:
                break
            n += 1
        return n

    want = {}
    for name, p in wants:
        pool = [c for c in cands if c[2].upper() == name.upper()]
        want[(name, p)] = max(pool, key=lambda c: (c[1].upper() == p.upper(), lead(c[1], p), stem(c[1]) == stem(p), -c[3]))[0]
    chunks = spark.createDataFrame(cands, "chunk_id STRING, path STRING, function_name STRING, seq BIGINT")
    asked = spark.createDataFrame(wants, "callee STRING, caller_file STRING")
    assert {(r.callee, r.caller_file): r.callee_chunk for r in calls.resolve_callees(asked, chunks).collect()} == want


def test_coverage_tiers(spark):
    nodes = spark.createDataFrame([("Snippet", "k1", "", "T.Pay", "T", "/x/p.pas", ""), ("Snippet", "k2", "Ship", "", "", "", "s.pas")],
                                  "label STRING, key STRING, name STRING, function_name STRING, class_name STRING, file_path STRING, file_name STRING")
    index = spark.createDataFrame([("Pay", "p.pas", "T"), ("Pay", "p.pas", ""), ("Pay", "q.pas", "T"), ("Ship", "s.pas", ""), ("None", "n.pas", "")], "function_name STRING, file_path STRING, class_name STRING")
    rows = {(r.function_name, r.file_path, r.class_name): r.match_tier for r in coverage.match_functions(index, nodes).collect()}
    assert rows == {("Pay", "p.pas", "T"): "full", ("Pay", "p.pas", ""): "name_file", ("Pay", "q.pas", "T"): "name_only", ("Ship", "s.pas", ""): "name_file", ("None", "n.pas", ""): "none"}


def test_line_slices(spark):
    files = spark.createDataFrame([("a", "l1\nl2\nl3\nl4")], "path STRING, content STRING")
    ranges = spark.createDataFrame([("a", 2, 3)], "path STRING, start INT, end INT")
    assert [(r.line_number, r.line) for r in profile.slice_lines(files, ranges, 1).collect()] == [(1, "l1"), (2, "l2"), (3, "l3"), (4, "l4")]


def test_parity_prefers_equal_then_suffix_then_containment(spark):
    names = spark.createDataFrame([("PAY",), ("ORDER",), ("SHIP",), ("LONGNAMEX",), ("QQ",)], "name STRING")
    declared = spark.createDataFrame([("PAY", "a"), ("PAYLATER", "b"), ("ORDERSERVICE", "c"), ("ORDERBOOK", "d"), ("SHIPMENT", "e"), ("NAME", "f"), ("LONG", "g"), ("NAMEX", "h")], "name STRING, path STRING")
    assert {(r.name, r.match) for r in roadmap.match_names(names, declared).collect()} == {("PAY", "PAY"), ("ORDER", "ORDERSERVICE"), ("SHIP", "SHIPMENT"), ("LONGNAMEX", "NAMEX")}


# ------------------------------------------------------------------ traversal state


def test_reach_follows_deep_chains(spark, monkeypatch):
    """A chain, a cycle and shared targets against a plain search; the buckets are rewritten on the way."""
    monkeypatch.setattr(graph, "LEVELS_PER_TABLE", 4)
    edges = [(i, i + 1) for i in range(22)] + [(22, 3), (5, 100), (9, 100), (100, 101), (200, 201), (7, 7)]
    table = spark.createDataFrame(edges, "a INT, b INT")
    seeds = spark.createDataFrame([(0,), (0,), (101,)], "key INT")
    got = graph.reach(seeds, lambda level: level.join(table, F.col("key") == F.col("a")).select(F.col("b").alias("key")), ["key"])
    depth, queue = {0: 0, 101: 0}, deque([0, 101])
    while queue:
        n = queue.popleft()
        for a, b in edges:
            if a == n and b not in depth:
                depth[b] = depth[n] + 1
                queue.append(b)
    assert {r.key: r.depth for r in got.collect()} == depth and got.count() == len(depth)


def test_seen_rows_are_not_shuffled_again(spark):
    """A step meets the stored rows bucket by bucket: only the step's side has an exchange."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        visited = graph.Visited(spark, ["key"])
        visited.add(spark.range(5000).select(F.col("id").alias("key")))
        visited.add(spark.range(5000, 6000).select(F.col("id").alias("key")))
        step = visited.unseen(spark.range(4000, 8000).select(F.col("id").alias("key")))
        plan = step._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
        assert step.count() == 2000
        assert visited.close().count() == 6000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# ------------------------------------------------------------------ language profiles

SOURCES = {
    "delphi": ("a.pas", "unit U;\nfunction TBox.Open(x: int): int;\nbegin\nend;\nprocedure Shut;", [("Open", "TBox"), ("Shut", "")]),
    "python": ("a.py", "class Box:\n    async def open(self):\n        pass\n    def shut(self): pass", [("open", "Box"), ("shut", "Box")]),
    "java": ("A.java", "public class Box {\n  public static <T> Map<String, T> open(int x) {\n    if (x > 1) return shut(x);\n  }\n  private int shut(int x) { }\n}", [("open", "Box"), ("shut", "Box")]),
    "javascript": ("a.js", "export class Box {\n}\nexport async function open(x) {}\nconst shut = async (x) => x;\nlet n = open(1);", [("open", "Box"), ("shut", "Box")]),
    "typescript": ("a.ts", "interface Box { }\nexport const open = (x: number): number => x;\nfunction shut() {}", [("open", "Box"), ("shut", "Box")]),
    "csharp": ("a.cs", "internal sealed class Box {\n  public override async Task<int> Open(int x) {\n    while (x > 1) Shut(x);\n  }\n  static void Shut<T>(T x) { }", [("Open", "Box"), ("Shut", "Box")]),
    "go": ("a.go", "type Box struct {\n}\nfunc (b *Box) Open(x int) int {\n}\nfunc Shut[T any](x T) {\n}", [("Open", "Box"), ("Shut", "Box")]),
    "kotlin": ("a.kt", "data class Box(val n: Int)\noverride suspend fun <T> open(x: T) {}\nfun Lid.shut() = 1", [("open", "Box"), ("shut", "Lid")]),
    "cobol": ("a.cbl", "       PROGRAM-ID. BOX.\n       OPEN-IT SECTION.\n           PERFORM SHUT-IT.\n       SHUT-IT.\n           STOP RUN.", [("OPEN-IT", "BOX"), ("SHUT-IT", "BOX")]),
    "rpg": ("a.rpg", "dcl-proc open;\n  exsr shut;\nend-proc;\nbegsr shut;\nendsr;", [("open", ""), ("shut", "")]),
    "rpgle": ("a.rpgle", "     C     SHUT          BEGSR\n     C                   ENDSR\n dcl-proc open;", [("SHUT", ""), ("open", "")]),
    "natural": ("a.nat", "DEFINE SUBROUTINE OPEN-IT\n  PERFORM SHUT\nEND-SUBROUTINE\nDEFINE FUNCTION SHUT", [("OPEN-IT", ""), ("SHUT", "")]),
    "focus": ("a.foc", "-DEFINE FUNCTION OPENIT(X)\n-OTHER\n-IF X THEN GOTO OTHER;", [("OPENIT", ""), ("OTHER", "")]),
}


def test_default_profiles_find_definitions(spark):
    """Functions and the class each belongs to, for every language that a scan yields profiles for; \\r\\n lines too."""
    rows = [(path, text.replace("\n", end), lang) for lang, (path, text, _) in SOURCES.items() for end in ("\n", "\r\n")]
    found = chunking.chunk_definitions(spark.createDataFrame(rows, "path STRING, content STRING, language STRING"))
    got = {}
    for r in found.where("line_start > 0").collect():
        got.setdefault(r.language, []).append((r.line_start, r.function_name, r.class_name))
    for lang, (_, _, want) in SOURCES.items():
        names = {n for n, _ in want}
        assert sorted({(n, c) for _, n, c in got[lang] if n in names}) == sorted(want), lang
        assert len([1 for _, n, _ in got[lang] if n in names]) == 2 * len(want), lang


def test_definitions_of_a_long_text(spark):
    """A text of many lines takes time in proportion, since no line is looked at twice."""
    text = "\n".join(f"def f{i}(x):\n    return f{i + 1}(x)" for i in range(20_000))
    files = spark.createDataFrame([("a.py", text, "python"), ("b.py", None, "python"), ("c.x", "def f(): 1", "none")], "path STRING, content STRING, language STRING")
    found = chunking.find_definitions(chunking.DEFAULT_PROFILES)(chunking._text_lines("content"), F.col("language"))
    sizes = {r.path: r.n for r in files.select("path", F.size(found).alias("n")).collect()}
    assert sizes["a.py"] == 20_000 and sizes["c.x"] == 0
