"""Traversal, trees, adjacency and the checklist: GRA-*, WIN-6..10, WIN-13, SET-5/6, QR-1..17, JOIN-12/16/21."""

from pyspark.sql import functions as F

from kgaudit.operators import checklist as cl
from kgaudit.operators import graph as gr
from kgaudit.workload.q_sources import RUN, SCOPE, nf, snippets
from kgaudit.workload.registry import fixture, query

# ------------------------------------------------------------------ inputs


@fixture
def trav_functions(d):
    return """SELECT concat('F', CAST(c_custkey AS STRING)) AS function_name,
      concat(CASE WHEN c_custkey % 11 = 5 THEN 'lib' ELSE 'app' END, '/m', CAST(c_custkey % 7 AS STRING), '/u', CAST(c_custkey % 50 AS STRING), '.pas') AS file_path,
      CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('TC', CAST(c_custkey % 40 AS STRING)) END AS class_name, 'pascal' AS language, c_custkey AS seq FROM customer"""


@fixture
def trav_calls(d):
    return """SELECT o.o_orderkey AS seq, concat(a.file_path, '::', a.class_name, '::', a.function_name) AS caller,
      CASE WHEN b.function_name IS NULL OR o.o_orderkey % 4 = 0 THEN concat('::::F', CAST(o.o_custkey * 2 + o.o_orderkey % 3 + 1 AS STRING))
           ELSE concat(b.file_path, '::', b.class_name, '::', b.function_name) END AS callee, CAST(0.8 AS DOUBLE) AS confidence
      FROM orders o JOIN trav_functions a ON a.seq = o.o_custkey LEFT JOIN trav_functions b ON b.seq = o.o_custkey * 2 + o.o_orderkey % 3 + 1"""


@fixture
def trav_starts(d):
    return """SELECT concat('EF-', CAST(s_suppkey AS STRING)) AS flow_key, concat('f', CAST(s_suppkey AS STRING)) AS start,
      CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE f.file_path END AS start_file, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'app' END AS prefix
      FROM supplier s JOIN trav_functions f ON f.seq = s.s_suppkey"""


@fixture
def flow_calls(d):
    """Call sites inside flows of fifteen nodes; the only cycle is a self call."""
    nxt = "o_custkey % 15 * 2 + o_orderkey % 3 + 1"
    return f"""SELECT concat('EF-', CAST(CAST(floor(o_custkey / 15) AS BIGINT) AS STRING)) AS flow_key, concat('S', CAST(o_custkey AS STRING)) AS caller,
      concat('S', CAST(o_custkey - o_custkey % 15 + CASE WHEN {nxt} < 15 THEN {nxt} ELSE 14 END AS STRING)) AS callee, o_orderkey AS exec_order FROM orders"""


@fixture
def ck_journey(d):
    return """SELECT m.flow_key, r.src_key AS caller, r.dst_key AS callee, coalesce(r.global_execution_order, 0) AS exec_order FROM ck_members m
      JOIN kg_rels r ON r.src_key = m.key AND r.rel_type = 'CALLS' WHERE r.dst_key IN (SELECT key FROM kg_nodes WHERE list_contains(labels,'Snippet'))"""


def journey_edges(t):
    members = snippets(t).select("flow_key", F.col("key").alias("src_key"))
    callees = t.kg_nodes.where(F.array_contains("labels", "Snippet")).select(F.col("key").alias("dst_key"))
    return t.kg_rels.where("rel_type = 'CALLS'").join(members, "src_key").join(callees, "dst_key", "left_semi").select(
        "flow_key", F.col("src_key").alias("caller"), F.col("dst_key").alias("callee"), F.coalesce("global_execution_order", F.lit(0)).alias("exec_order"))


# ------------------------------------------------------------------ traversal


@fixture
def ck_sites2(d):
    return """WITH f AS (SELECT function_name, upper(function_name) AS k, min(file_path) AS file_path FROM trav_functions GROUP BY ALL)
      SELECT upper(string_split(c.caller,'::')[3]) AS caller_key, upper(string_split(c.caller,'::')[1]) AS caller_path, string_split(c.caller,'::')[1] AS caller_file, string_split(c.callee,'::')[3] AS callee,
        upper(string_split(c.callee,'::')[3]) AS callee_key, coalesce(nullif(string_split(c.callee,'::')[1],''), f.file_path, '') AS callee_file, c.seq FROM trav_calls c LEFT JOIN f ON f.k = upper(string_split(c.callee,'::')[3])"""


CK_VISIT = """v AS (SELECT flow_key, prefix, upper(start) AS node, start_file AS node_file, 0 AS depth FROM trav_starts
   UNION SELECT v.flow_key, v.prefix, s.callee_key, s.callee_file, v.depth + 1 FROM v JOIN ck_sites2 s ON s.caller_key = v.node AND (v.node_file = '' OR s.caller_path = upper(v.node_file))
     WHERE s.callee_key <> s.caller_key AND s.callee_file <> '' AND (v.prefix = '' OR starts_with(upper(s.callee_file), upper(v.prefix))) AND v.depth < 49),
   n AS (SELECT flow_key, prefix, node, node_file, min(depth) AS depth FROM v GROUP BY ALL),
   e AS (SELECT n.flow_key, s.caller_key AS caller, coalesce(nullif(n.node_file,''), s.caller_file) AS caller_file, s.callee, s.callee_file, n.depth + 1 AS depth,
      s.callee_file <> '' AND (n.prefix = '' OR starts_with(upper(s.callee_file), upper(n.prefix))) AS resolved, s.seq
      FROM n JOIN ck_sites2 s ON s.caller_key = n.node AND (n.node_file = '' OR s.caller_path = upper(n.node_file)))"""


def sites(t):
    return gr.located_sites(gr.split_sites(t.trav_calls), t.trav_functions)


@query("gra_1", f"WITH RECURSIVE {CK_VISIT} SELECT flow_key, caller, caller_file, callee, callee_file, depth, resolved, seq FROM e")
def gra_1(t):
    return gr.traverse(t.trav_starts, sites(t)).drop("caller_class", "callee_class", "confidence")


@query("gra_1_unresolved", f"WITH RECURSIVE {CK_VISIT} SELECT DISTINCT flow_key, callee AS name FROM e WHERE NOT resolved")
def gra_1_unresolved(t):
    return gr.unresolved_callees(gr.traverse(t.trav_starts, sites(t)))


@query("win_9", f"""WITH RECURSIVE {CK_VISIT} SELECT flow_key, caller, callee, seq, row_number() OVER (PARTITION BY flow_key, caller, caller_file ORDER BY seq, callee) AS execution_order FROM e WHERE resolved""")
def win_9(t):
    return gr.callee_order(gr.traverse(t.trav_starts, sites(t), ordered=True)).select("flow_key", "caller", "callee", "seq", "execution_order")


@fixture
def flow_roots(d):
    return """SELECT concat('EF-', CAST(c_custkey AS STRING)) AS flow_key,
      CASE c_custkey % 5 WHEN 0 THEN concat('f', CAST(c_custkey AS STRING)) WHEN 1 THEN concat('TX.F', CAST(c_custkey AS STRING)) WHEN 2 THEN concat('Gone', CAST(c_custkey AS STRING)) ELSE concat('No', CAST(c_custkey AS STRING)) END AS root_function,
      CASE c_custkey % 5 WHEN 2 THEN concat('F', CAST(c_custkey AS STRING)) WHEN 3 THEN concat('tc', CAST(c_custkey % 60 AS STRING)) ELSE '' END AS root_class FROM customer"""


@query("gra_2", """WITH keys AS (SELECT upper(function_name) AS k, true AS i, false AS e FROM trav_functions UNION ALL SELECT upper(concat(class_name,'.',function_name)), true, false FROM trav_functions WHERE class_name <> ''
     UNION ALL SELECT upper(string_split(caller,'::')[3]), false, true FROM trav_calls UNION ALL SELECT upper(concat(string_split(caller,'::')[2],'.',string_split(caller,'::')[3])), false, true FROM trav_calls WHERE string_split(caller,'::')[2] <> ''),
   kn AS (SELECT k, bool_or(i) AS found, bool_or(e) AS calls FROM keys GROUP BY k),
   r AS (SELECT flow_key, upper(root_function) AS k1, regexp_replace(upper(root_function),'^.*[.]','') AS k2, upper(root_class) AS k3 FROM flow_roots),
   p AS (SELECT r.*, CASE WHEN k1 IN (SELECT k FROM kn) THEN 'original' WHEN k2 IN (SELECT k FROM kn) THEN 'bare_name' WHEN k3 <> '' AND k3 IN (SELECT k FROM kn) THEN 'class' END AS via FROM r),
   m AS (SELECT DISTINCT upper(class_name) AS k3, upper(function_name) AS start FROM trav_functions WHERE class_name <> '')
   SELECT p.flow_key, kn.k AS start, p.via AS resolved_via, kn.found AS root_found, kn.calls AS root_has_edges FROM p JOIN kn ON kn.k = CASE via WHEN 'original' THEN k1 WHEN 'bare_name' THEN k2 ELSE k3 END WHERE via IS NOT NULL
   UNION ALL SELECT p.flow_key, m.start, 'class_members', true, true FROM p JOIN m ON m.k3 = p.k3 WHERE via IS NULL AND p.k3 <> ''
   UNION ALL SELECT flow_key, k1, 'original', false, false FROM p WHERE via IS NULL AND k3 NOT IN (SELECT k3 FROM m)""")
def gra_2(t):
    return gr.resolve_roots(t.flow_roots, t.trav_functions, gr.split_sites(t.trav_calls))


@query("join_12", f"""WITH w AS (SELECT function_name, CASE WHEN seq % 4 = 0 THEN '' WHEN seq % 4 = 1 THEN concat('/mnt/z/', regexp_replace(file_path,'^.*/','')) WHEN seq % 4 = 2 THEN '/q/PROMO.dfm' ELSE '/q/none.pas' END AS file_path, seq FROM code_index),
   k AS (SELECT DISTINCT upper(trim(function_name)) AS fn, file_path AS p FROM code_index)
   SELECT w.function_name, w.file_path, w.seq, coalesce(CASE WHEN trim(w.file_path) = '' THEN NULL WHEN (SELECT count(*) FROM k WHERE fn = upper(w.function_name)) = 1 THEN (SELECT min(p) FROM k WHERE fn = upper(w.function_name))
     ELSE coalesce((SELECT min(p) FROM k WHERE fn = upper(w.function_name) AND {nf('k.p')} = {nf('w.file_path')}),
       (SELECT min(p) FROM k WHERE fn = upper(w.function_name) AND regexp_replace({nf('k.p')},'[.][^.]*$','') = regexp_replace({nf('w.file_path')},'[.][^.]*$',''))) END, '') AS index_file FROM w""")
def join_12(t):
    wanted = t.code_index.selectExpr("function_name", "CASE WHEN seq % 4 = 0 THEN '' WHEN seq % 4 = 1 THEN concat('/mnt/z/', substring_index(file_path, '/', -1)) WHEN seq % 4 = 2 THEN '/q/PROMO.dfm' ELSE '/q/none.pas' END AS file_path", "seq")
    return gr.resolve_index_file(wanted, t.code_index)


@query("join_16", """SELECT upper(function_name) AS key, count(*) AS functions, min(file_path) AS file_path FROM (SELECT function_name, file_path FROM trav_functions UNION ALL SELECT concat(class_name,'.',function_name), file_path FROM trav_functions WHERE class_name <> '') GROUP BY 1""")
def join_16(t):
    return gr.name_keys(t.trav_functions, "function_name", "class_name").groupBy("key").agg(F.count(F.lit(1)).alias("functions"), F.min("file_path").alias("file_path"))


# ------------------------------------------------------------------ trees

ROOTS = """{n} AS (SELECT DISTINCT flow_key, caller AS node FROM {e} x WHERE NOT EXISTS (SELECT 1 FROM {e} y WHERE y.flow_key = x.flow_key AND y.callee = x.caller)
   UNION ALL SELECT flow_key, arg_min(caller, (exec_order, caller)) FROM {e} z WHERE NOT EXISTS (SELECT 1 FROM {e} x WHERE x.flow_key = z.flow_key AND NOT EXISTS (SELECT 1 FROM {e} y WHERE y.flow_key = x.flow_key AND y.callee = x.caller)) GROUP BY flow_key)"""


@query("set_6", f"WITH {ROOTS.format(n='r', e='ck_journey')} SELECT * FROM r")
def set_6(t):
    return gr.roots_of(journey_edges(t))


ADJ = "adj AS (SELECT flow_key, caller, callee, min(exec_order) AS o FROM ck_journey GROUP BY ALL)"


@query("gra_3", f"""WITH RECURSIVE {ROOTS.format(n='r', e='ck_journey')}, {ADJ},
   d AS (SELECT flow_key, node, 1 AS lv FROM r UNION SELECT d.flow_key, a.callee, lv + 1 FROM d JOIN adj a ON a.flow_key = d.flow_key AND a.caller = d.node WHERE lv < 20),
   m AS (SELECT flow_key, node, min(lv) AS lv FROM d GROUP BY ALL),
   p AS (SELECT flow_key, node, 1 AS lv, [{{'o': 0::BIGINT, 'n': node}}] AS path FROM r
     UNION ALL SELECT p.flow_key, a.callee, p.lv + 1, list_append(p.path, {{'o': a.o::BIGINT, 'n': a.callee}}) FROM p JOIN adj a ON a.flow_key = p.flow_key AND a.caller = p.node JOIN m ON m.flow_key = p.flow_key AND m.node = a.callee AND m.lv = p.lv + 1),
   q AS (SELECT flow_key, node, lv, min(path) AS path FROM p GROUP BY ALL),
   ends AS (SELECT flow_key, exec_order AS o, 0 AS p, caller AS node FROM ck_journey UNION ALL SELECT flow_key, exec_order, 1, callee FROM ck_journey),
   rest AS (SELECT flow_key, node, min((o, p)) AS k FROM ends WHERE (flow_key, node) NOT IN (SELECT (flow_key, node) FROM m) GROUP BY ALL),
   pos AS (SELECT flow_key, node, lv, row_number() OVER (PARTITION BY flow_key ORDER BY lv, path) AS position FROM q),
   par AS (SELECT flow_key, callee AS node, arg_min(caller, (exec_order, caller)) AS parent FROM ck_journey WHERE (flow_key, callee) NOT IN (SELECT (flow_key, node) FROM r) GROUP BY ALL UNION ALL SELECT flow_key, node, flow_key FROM r),
   alln AS (SELECT flow_key, node, lv, position FROM pos UNION ALL SELECT x.flow_key, x.node, NULL, (SELECT count(*) FROM pos z WHERE z.flow_key = x.flow_key) + row_number() OVER (PARTITION BY x.flow_key ORDER BY x.k, x.node) FROM rest x)
   SELECT DISTINCT flow_key, flow_key AS node, NULL AS parent, 0 AS level, 0 AS position FROM ck_journey
   UNION ALL SELECT a.flow_key, a.node, par.parent, a.lv, a.position FROM alln a LEFT JOIN par ON par.flow_key = a.flow_key AND par.node = a.node""")
def gra_3(t):
    return gr.journey_tree(journey_edges(t))


@query("win_10", "SELECT flow_key, callee AS node, arg_min(caller, (exec_order, caller)) AS parent FROM ck_journey GROUP BY ALL")
def win_10(t):
    return gr.first_parents(journey_edges(t))


def topics(t):
    return t.kg_nodes.select("key", "topic")


KIDS = f"""kids AS (SELECT flow_key, caller AS parent, callee AS node, min(exec_order) AS o FROM ck_journey GROUP BY ALL UNION ALL SELECT flow_key, flow_key, node, 0 FROM r)"""


@query("gra_12", f"""WITH {ROOTS.format(n='r', e='ck_journey')}, {KIDS}
   SELECT k.flow_key, k.parent, coalesce(nullif(p.topic,''), '(missing)') AS parent_topic, string_agg(coalesce(nullif(c.topic,''), '(missing)'), '|' ORDER BY k.o, k.node) AS children
   FROM kids k LEFT JOIN kg_nodes p ON p.key = k.parent LEFT JOIN kg_nodes c ON c.key = k.node GROUP BY ALL""")
def gra_12(t):
    out = gr.topic_tree(gr.tree_children(journey_edges(t)), topics(t))
    return out.select("flow_key", "parent", "parent_topic", F.array_join("items", "|").alias("children"))


@query("gra_4", f"""WITH {ROOTS.format(n='r', e='ck_journey')}, {KIDS},
   par AS (SELECT flow_key, callee AS node, arg_min(caller, (exec_order, caller)) AS parent FROM ck_journey WHERE (flow_key, callee) NOT IN (SELECT (flow_key, node) FROM r) GROUP BY ALL UNION ALL SELECT flow_key, node, flow_key FROM r),
   alln AS (SELECT flow_key, caller AS node FROM ck_journey UNION SELECT flow_key, callee FROM ck_journey UNION SELECT flow_key, flow_key FROM ck_journey),
   ctx AS (SELECT k.flow_key, k.parent AS node, string_agg(coalesce(nullif(c.topic,''), '?'), ', ' ORDER BY k.o, k.node) AS s FROM kids k LEFT JOIN kg_nodes c ON c.key = k.node GROUP BY ALL)
   SELECT a.flow_key, a.node, concat(CASE WHEN par.parent IS NULL THEN '' ELSE concat(coalesce(nullif(u.topic,''), '?'), ' -> ') END, '[', coalesce(nullif(n.topic,''), '(missing)'), ']', CASE WHEN ctx.s IS NULL THEN '' ELSE concat(' -> {{', ctx.s, '}}') END) AS context
   FROM alln a LEFT JOIN par ON par.flow_key = a.flow_key AND par.node = a.node LEFT JOIN kg_nodes n ON n.key = a.node LEFT JOIN kg_nodes u ON u.key = par.parent LEFT JOIN ctx ON ctx.flow_key = a.flow_key AND ctx.node = a.node""")
def gra_4(t):
    edges = journey_edges(t)
    return gr.chain_context(gr.journey_tree(edges), gr.tree_children(edges), topics(t)).select("flow_key", "node", "context")


@query("join_21", f"""WITH {ROOTS.format(n='r', e='ck_journey')}, {KIDS},
   par AS (SELECT flow_key, callee AS node, arg_min(caller, (exec_order, caller)) AS parent FROM ck_journey WHERE (flow_key, callee) NOT IN (SELECT (flow_key, node) FROM r) GROUP BY ALL UNION ALL SELECT flow_key, node, flow_key FROM r),
   alln AS (SELECT flow_key, caller AS node FROM ck_journey UNION SELECT flow_key, callee FROM ck_journey UNION SELECT flow_key, flow_key FROM ck_journey)
   SELECT a.flow_key, a.node, par.parent, (SELECT count(*) FROM kids k WHERE k.flow_key = a.flow_key AND k.parent = a.node) AS children,
     (SELECT count(*) FROM kids k WHERE k.flow_key = a.flow_key AND k.parent = par.parent AND k.node <> a.node) AS siblings FROM alln a LEFT JOIN par ON par.flow_key = a.flow_key AND par.node = a.node""")
def join_21(t):
    edges = journey_edges(t)
    return gr.family_sizes(gr.journey_tree(edges), gr.tree_children(edges))


@query("gra_5", f"""WITH RECURSIVE e AS (SELECT r.src_key AS caller, r.dst_key AS callee FROM kg_rels r JOIN kg_nodes a ON a.key = r.src_key AND a.project_id = 1 AND a.run_id = 1 AND list_contains(a.labels,'Snippet') JOIN kg_nodes b ON b.key = r.dst_key AND list_contains(b.labels,'Snippet') WHERE r.rel_type='CALLS'),
   v AS (SELECT DISTINCT key FROM ck_members WHERE starts_flow UNION SELECT e.callee FROM v JOIN e ON e.caller = v.key)
   SELECT key FROM v""")
def gra_5(t):
    r = cl.RunGraph(t.kg_nodes, t.kg_rels, *RUN)
    return gr.closure(r.roots, r.calls).select("key")


PATHS = """WITH RECURSIVE adj AS (SELECT flow_key, caller, callee, min(exec_order) AS o FROM flow_calls GROUP BY ALL),
   p AS (SELECT flow_key, caller AS root, caller, callee, 1 AS depth, o AS exec_order, [caller] AS path, callee = caller AS cut FROM adj
     UNION ALL SELECT p.flow_key, p.root, a.caller, a.callee, p.depth + 1, a.o, list_append(p.path, a.caller), list_contains(list_append(p.path, a.caller), a.callee) FROM p JOIN adj a ON a.flow_key = p.flow_key AND a.caller = p.callee WHERE NOT p.cut)
   SELECT flow_key, root, caller, callee, depth, exec_order, cut, array_to_string(list_append(path, callee), '>') AS path FROM p"""


@query("gra_6", PATHS)
def gra_6(t):
    edges = gr.adjacency(t.flow_calls).select("flow_key", "caller", "callee", "exec_order")
    starts = edges.select("flow_key", F.col("caller").alias("node")).distinct()
    return gr.call_paths(edges, starts, None).withColumn("path", F.array_join("path", ">"))


@query("src_28", PATHS)
def src_28(t):
    """Every entry of the written ground truth, read back."""
    from kgaudit.session import shared_folder
    from kgaudit.sources import exports

    path = shared_folder(t.spark, "ground-truth")
    entries = gra_6(t)
    exports.write_json(entries, path)
    return t.spark.read.schema(entries.schema).json(path)


@query("gra_7", f"""WITH RECURSIVE {ROOTS.format(n='r', e='flow_calls')}, a0 AS (SELECT flow_key, caller, callee, min(exec_order) AS o FROM flow_calls GROUP BY ALL),
   adj AS (SELECT *, row_number() OVER (PARTITION BY flow_key, caller ORDER BY o, callee) AS rk FROM a0),
   p AS (SELECT flow_key, node, []::BIGINT[] AS place, [node] AS path FROM r UNION ALL SELECT p.flow_key, a.callee, list_append(p.place, a.rk), list_append(p.path, a.callee) FROM p JOIN adj a ON a.flow_key = p.flow_key AND a.caller = p.node WHERE len(p.place) < 15 AND NOT list_contains(p.path, a.callee)),
   b AS (SELECT flow_key, node, min(place) AS place FROM p GROUP BY ALL),
   l AS (SELECT b.flow_key, a.callee AS node, list_append(b.place, a.rk) AS place FROM b JOIN adj a ON a.flow_key = b.flow_key AND a.caller = b.node WHERE len(b.place) < 15)
   SELECT l.flow_key, l.node, array_to_string(l.place, '.') AS place, len(l.place) AS depth, coalesce(b.place <> l.place, true) AS recursive FROM l LEFT JOIN b ON b.flow_key = l.flow_key AND b.node = l.node
   UNION ALL SELECT flow_key, node, '', 0, false FROM r""")
def gra_7(t):
    return gr.tree_listing(t.flow_calls, gr.roots_of(t.flow_calls)).withColumn("place", F.array_join(F.col("place").cast("array<string>"), "."))


LEVELS = f"""WITH RECURSIVE {ROOTS.format(n='r', e='ck_journey')}, d AS (SELECT flow_key, node, 0 AS lv FROM r UNION SELECT d.flow_key, a.callee, lv + 1 FROM d JOIN ck_journey a ON a.flow_key = d.flow_key AND a.caller = d.node WHERE lv < 20),
   m AS (SELECT flow_key, node, min(lv) AS lv FROM d GROUP BY ALL), n AS (SELECT flow_key, caller AS node FROM ck_journey UNION SELECT flow_key, callee FROM ck_journey),
   l AS (SELECT n.flow_key, n.node, coalesce(m.lv, (SELECT max(lv) FROM m x WHERE x.flow_key = n.flow_key) + 1) AS level FROM n LEFT JOIN m ON m.flow_key = n.flow_key AND m.node = n.node)"""


@query("gra_8", LEVELS + " SELECT flow_key, level, count(*) AS nodes FROM l GROUP BY ALL")
def gra_8(t):
    edges = journey_edges(t)
    return gr.level_sizes(gr.bfs_levels(edges, gr.roots_of(edges)))


LONE = f"""SELECT key FROM (SELECT key FROM kg_nodes WHERE list_contains(labels,'Snippet') AND {SCOPE}) WHERE key NOT IN (SELECT key FROM ck_members WHERE starts_flow)
   AND key NOT IN (SELECT r.dst_key FROM kg_rels r JOIN kg_nodes a ON a.key = r.src_key WHERE r.rel_type='CALLS' AND a.project_id = 1 AND a.run_id = 1)"""


@query("gra_9", LONE)
def gra_9(t):
    r = cl.RunGraph(t.kg_nodes, t.kg_rels, *RUN)
    return gr.orphans(r.labelled("Snippet"), r.roots, r.calls)


@query("set_5", LONE)
def set_5(t):
    return gra_9(t)


@query("gra_10", "SELECT flow_key, callee AS node, 'callee' AS side FROM flow_calls WHERE caller = 'S17' UNION ALL SELECT flow_key, caller, 'caller' FROM flow_calls WHERE callee = 'S17'")
def gra_10(t):
    out = gr.callees_of(t.flow_calls, "S17").select("flow_key", F.col("callee").alias("node"), F.lit("callee").alias("side"))
    return out.unionByName(gr.callers_of(t.flow_calls, "S17").select("flow_key", F.col("caller").alias("node"), F.lit("caller").alias("side")))


@query("gra_11", """SELECT flow_key, caller, string_agg(callee, ',' ORDER BY o, callee) AS callees FROM (SELECT flow_key, caller, callee, min(exec_order) AS o FROM flow_calls GROUP BY ALL) GROUP BY ALL""")
def gra_11(t):
    return gr.adjacency_lists(t.flow_calls).select("flow_key", "caller", F.array_join("items", ",").alias("callees"))


@query("win_13", """SELECT flow_key, caller, callee, o AS exec_order, row_number() OVER (PARTITION BY flow_key, caller ORDER BY o, callee) AS rank FROM (SELECT flow_key, caller, callee, min(exec_order) AS o FROM flow_calls GROUP BY ALL)""")
def win_13(t):
    return gr.adjacency(t.flow_calls)


@query("gra_13", """SELECT n.key, coalesce(o.n, 0) AS calls, coalesce(i.n, 0) AS called, coalesce(o.n, 0) > 0 AS is_caller, coalesce(i.n, 0) > 0 AS is_callee, coalesce(o.n, 0) = 0 AND coalesce(i.n, 0) > 0 AS is_leaf
   FROM kg_nodes n LEFT JOIN (SELECT caller, count(*) AS n FROM flow_calls GROUP BY 1) o ON o.caller = n.key LEFT JOIN (SELECT callee, count(*) AS n FROM flow_calls GROUP BY 1) i ON i.callee = n.key""")
def gra_13(t):
    return gr.degrees(t.kg_nodes, t.flow_calls)


@query("gra_16", """WITH te AS (SELECT DISTINCT concat('EF-', o_custkey % 25) AS flow_key, o_orderstatus AS parent_topic, o_orderpriority AS child_topic FROM orders),
   sg AS (SELECT DISTINCT flow_key, child_topic AS topic, concat('Review ', child_topic) AS suggested FROM te WHERE child_topic <> '1-URGENT'), rt AS (SELECT DISTINCT flow_key, parent_topic AS topic FROM te UNION SELECT flow_key, '5-LOW' FROM te),
   e AS (SELECT DISTINCT te.flow_key, te.parent_topic, coalesce(s.suggested, te.child_topic) AS child_topic FROM te LEFT JOIN sg s ON s.flow_key = te.flow_key AND s.topic = te.child_topic),
   tops AS (SELECT DISTINCT rt.flow_key, coalesce(s.suggested, rt.topic) AS topic FROM rt LEFT JOIN sg s ON s.flow_key = rt.flow_key AND s.topic = rt.topic)
   SELECT flow_key, 'edge' AS kind, concat(parent_topic, ' -> ', child_topic) AS item FROM e UNION ALL SELECT flow_key, 'root', topic FROM tops WHERE (flow_key, topic) NOT IN (SELECT (flow_key, child_topic) FROM e)""")
def gra_16(t):
    te = t.orders.selectExpr("concat('EF-', o_custkey % 25) AS flow_key", "o_orderstatus AS parent_topic", "o_orderpriority AS child_topic").distinct()
    sg = te.where("child_topic <> '1-URGENT'").selectExpr("flow_key", "child_topic AS topic", "concat('Review ', child_topic) AS suggested").distinct()
    rt = te.selectExpr("flow_key", "parent_topic AS topic").unionByName(te.selectExpr("flow_key", "'5-LOW' AS topic")).distinct()
    edges, roots = gr.suggested_tree(te, sg, rt)
    return edges.select("flow_key", F.lit("edge").alias("kind"), F.concat_ws(" -> ", "parent_topic", "child_topic").alias("item")).unionByName(
        roots.select("flow_key", F.lit("root").alias("kind"), F.col("topic").alias("item")))


# ------------------------------------------------------------------ checklist


@fixture
def ck_scope_nodes(d):
    return f"""SELECT * FROM kg_nodes WHERE ({SCOPE}) OR key IN (SELECT c.key FROM ck_members m JOIN kg_rels r ON r.src_key = m.key JOIN kg_nodes c ON c.key = r.dst_key
      WHERE r.rel_type = 'CONTAINS_INPUT' OR (r.rel_type, c.labels[1]) IN (('CONTAINS_DB_CALLS','DBCall'),('CONTAINS_CALCULATION','Calculation'),('CONTAINS_SERVICE_CALLS','ServiceCall'),('Contains_variable','Variable')))"""


@fixture
def ck_calls_run(d):
    return """SELECT r.src_key AS caller, r.dst_key AS callee, r.execution_order AS eo, r.global_execution_order AS geo, concat(r.src_key,'->',r.dst_key) AS key FROM kg_rels r
      JOIN kg_nodes a ON a.key = r.src_key AND a.project_id = 1 AND a.run_id = 1 AND list_contains(a.labels,'Snippet') JOIN kg_nodes b ON b.key = r.dst_key AND list_contains(b.labels,'Snippet') WHERE r.rel_type='CALLS'"""


VARS = "(SELECT r.dst_key FROM kg_rels r WHERE r.rel_type='Contains_variable' AND r.src_key IN (SELECT key FROM ck_members) UNION SELECT variable_key FROM ck_steps WHERE variable_key IS NOT NULL)"
DBC = "(SELECT r.dst_key FROM kg_rels r WHERE r.rel_type='CONTAINS_DB_CALLS' AND r.src_key IN (SELECT key FROM ck_members))"
SN = "list_contains(labels,'Snippet')"
ROOTKEYS = "(SELECT key FROM ck_members WHERE starts_flow)"


def _blank(c):
    return f"trim(coalesce({c},'')) = ''"


@fixture
def ck_failures(d):
    order = "coalesce(geo, eo)"
    return f"""
      WITH RECURSIVE reach AS (SELECT DISTINCT key FROM ck_members WHERE starts_flow UNION SELECT c.callee FROM reach JOIN ck_calls_run c ON c.caller = reach.key),
      placed AS (SELECT m.flow_key, m.key, m.execution_order AS o, m.key IN {ROOTKEYS} AS is_root FROM ck_members m),
      fl AS (SELECT flow_key, bool_or(is_root) AS rooted, min(o) FILTER (is_root) AS first, min(key) AS smallest FROM placed GROUP BY flow_key)
      SELECT 2 AS item_id, key FROM ck_scope_nodes WHERE execution_order IS NULL
      UNION ALL SELECT 3, key FROM ck_scope_nodes WHERE key IN {ROOTKEYS} AND {_blank('root_type')}
      UNION ALL SELECT 4, key FROM ck_scope_nodes WHERE {_blank('name')}
      UNION ALL SELECT 5, key FROM ck_scope_nodes WHERE {SN} AND {_blank('short_summary')}
      UNION ALL SELECT 6, key FROM ck_scope_nodes WHERE {SN} AND {_blank('business_summary')}
      UNION ALL SELECT 7, key FROM ck_scope_nodes WHERE {SN} AND {_blank('snippet')}
      UNION ALL SELECT 8, key FROM ck_scope_nodes WHERE {_blank('topic')}
      UNION ALL SELECT 9, key FROM ck_scope_nodes WHERE {SN} AND {_blank('function_name')}
      UNION ALL SELECT 10, key FROM ck_scope_nodes WHERE list_contains(labels,'Variable') AND key IN {VARS} AND {_blank('meaning')}
      UNION ALL SELECT 11, key FROM ck_scope_nodes WHERE visual_imagery_data IS NULL AND ({SN} OR list_contains(labels,'Step'))
      UNION ALL SELECT 12, key FROM ck_scope_nodes WHERE list_contains(labels,'DBCall') AND key IN {DBC} AND table_names IS NULL
      UNION ALL SELECT unnest([13, 27]), key FROM ck_scope_nodes WHERE {SN} AND key NOT IN {ROOTKEYS} AND key NOT IN (SELECT callee FROM ck_calls_run)
      UNION ALL SELECT 14, key FROM ck_calls_run WHERE geo IS NULL AND eo IS NULL
      UNION ALL SELECT 15, key FROM ck_scope_nodes WHERE {SN} AND key NOT IN (SELECT key FROM ck_members)
      UNION ALL SELECT 16, key FROM ck_scope_nodes WHERE list_contains(labels,'DBCall') AND key NOT IN {DBC}
      UNION ALL SELECT 22, job_key FROM (SELECT DISTINCT job_key FROM ck_steps) WHERE job_key NOT IN (SELECT job_key FROM ck_steps WHERE step_key IS NOT NULL)
      UNION ALL SELECT 23, key FROM ck_scope_nodes WHERE list_contains(labels,'Variable') AND key NOT IN {VARS}
      UNION ALL SELECT 24, key FROM (SELECT key, count(*) OVER (PARTITION BY flow_key, execution_order) AS n FROM ck_members WHERE execution_order IS NOT NULL) WHERE n > 1
      UNION ALL SELECT DISTINCT 25, key FROM (SELECT key, {order} AS v, count(*) OVER (PARTITION BY {order}) AS n FROM ck_calls_run) WHERE v IS NULL OR n > 1
      UNION ALL SELECT 26, key FROM placed JOIN fl ON fl.flow_key = placed.flow_key WHERE CASE WHEN NOT rooted THEN key = smallest WHEN first IS NULL THEN is_root ELSE NOT is_root AND o < first END
      UNION ALL SELECT 28, key FROM ck_scope_nodes WHERE {SN} AND key NOT IN (SELECT key FROM reach)"""


def run_graph(t):
    return cl.RunGraph(t.kg_nodes, t.kg_rels, *RUN)


@query("qr_1_failures", "SELECT item_id, key FROM ck_failures")
def qr_1_failures(t):
    return cl.rule_failures(run_graph(t))


_RULES = ", ".join(f"({i}, '{n}', '{c}', '{p}')" for i, n, c, p in cl.RULES)
ITEMS = f"""(SELECT r.i AS item_id, r.n AS title, r.c AS category, r.p AS priority, count(f.key) = 0 AS passed, count(f.key) AS failures, CASE WHEN r.i BETWEEN 17 AND 21 THEN 'N/A' ELSE '' END AS note
   FROM (VALUES {_RULES}) r(i, n, c, p) LEFT JOIN ck_failures f ON f.item_id = r.i GROUP BY ALL)"""


@query("qr_1", f"SELECT * FROM {ITEMS} x")
def qr_1(t):
    return cl.checklist(cl.rule_failures(run_graph(t)))


@query("agg_17", f"""SELECT category, count_if(passed) AS passed, count_if(NOT passed) AS failed, count_if(NOT passed AND priority='Critical') AS critical_failed, count_if(NOT passed AND priority='Required') AS required_failed
   FROM {ITEMS} x GROUP BY ROLLUP (category)""")
def agg_17(t):
    return cl.checklist_summary(qr_1(t))


@query("qr_2", "SELECT label, count(*) AS nodes FROM (SELECT unnest(labels) AS label FROM ck_scope_nodes) GROUP BY label")
def qr_2(t):
    return cl.label_usage(run_graph(t))


GROUPS = {
    "qr_3": (2, 4, 8), "qr_4": (5, 6, 7, 9), "qr_5": (3,), "qr_6": (10,), "qr_7": (11,), "qr_8": (12,), "qr_9": (13, 27), "qr_10": (14,), "qr_11": (15,),
    "qr_12": (16, 23), "qr_14": (22,), "qr_15": (24, 25, 26), "qr_16": (28,),
}


def _rule_query(items):
    wanted = ", ".join(map(str, items))

    def run(t):
        return cl.rule_failures(run_graph(t), set(items))

    return run, f"SELECT item_id, key FROM ck_failures WHERE item_id IN ({wanted})"


for _name, _items in GROUPS.items():
    _fn, _sql = _rule_query(_items)
    query(_name, _sql)(_fn)


@query("qr_13", "SELECT i AS item_id, true AS passed, 'N/A' AS note, (SELECT count(*) FROM ck_scope_nodes) AS nodes FROM range(17, 22) t(i)")
def qr_13(t):
    n = run_graph(t).nodes.agg(F.count(F.lit(1)).alias("nodes"))
    items = n.withColumn("item_id", F.explode(F.array(*[F.lit(i).cast("bigint") for i in cl.NOT_VERIFIABLE])))
    return items.select("item_id", F.lit(True).alias("passed"), F.lit("N/A").alias("note"), "nodes")


@query("qr_17", "SELECT 29 AS item_id, count(*) > 0 AS passed, count(*) AS flows FROM ck_flows")
def qr_17(t):
    return run_graph(t).flows.agg(F.count(F.lit(1)).alias("flows")).select(F.lit(29).alias("item_id"), (F.col("flows") > 0).alias("passed"), "flows")


@query("win_6", "SELECT key FROM ck_failures WHERE item_id = 24")
def win_6(t):
    return cl.duplicate_orders(run_graph(t))


@query("win_7", "SELECT key FROM ck_failures WHERE item_id = 25")
def win_7(t):
    return cl.unordered_calls(run_graph(t))


@query("win_8", "SELECT key FROM ck_failures WHERE item_id = 26")
def win_8(t):
    return cl.misplaced_roots(run_graph(t))
