"""Graph scans, lookups and set operations: SRC-1..19, SRC-33/34, FIL, SET, FN."""

from pyspark.sql import functions as F

from kgaudit.functions import scalars as fx
from kgaudit.operators import diff, edge_audit, lookup, normalize
from kgaudit.sources import graph as g
from kgaudit.workload.q_flow import LAST as _LAST
from kgaudit.workload.q_flow import sides
from kgaudit.workload.registry import fixture, query

RUN = (1, 1)
SCOPE = "project_id = 1 AND run_id = 1"
LAST = _LAST


def snippets(t, label="Snippet"):
    return g.participants(t.kg_nodes, t.kg_rels, g.flow_keys(t.kg_nodes, *RUN), label)


@fixture
def ck_flows(d):
    return f"SELECT key AS flow_key, coalesce(name,'') AS flow_name FROM kg_nodes WHERE list_contains(labels,'ExecutionFlow') AND {SCOPE}"


@fixture
def ck_members(d):
    return """SELECT r.dst_key AS flow_key, coalesce(r.starts_flow, false) AS starts_flow, n.* FROM kg_rels r JOIN kg_nodes n ON n.key = r.src_key
      WHERE r.rel_type = 'PARTICIPATES_IN_FLOW' AND list_contains(n.labels, 'Snippet') AND r.dst_key IN (SELECT flow_key FROM ck_flows)"""


@fixture
def ck_jobs(d):
    return """SELECT r.dst_key AS flow_key, n.key FROM kg_rels r JOIN kg_nodes n ON n.key = r.src_key
      WHERE r.rel_type = 'PARTICIPATES_IN_FLOW' AND list_contains(n.labels, 'Job') AND r.dst_key IN (SELECT flow_key FROM ck_flows)"""


@fixture
def ck_calls(d):
    return """SELECT m.flow_key, r.src_key AS caller_key, r.dst_key AS callee_key, r.execution_order, coalesce(r.execution_order, 0)::BIGINT AS seq
      FROM ck_members m JOIN kg_rels r ON r.src_key = m.key AND r.rel_type = 'CALLS'
      WHERE r.dst_key IN (SELECT key FROM kg_nodes WHERE list_contains(labels, 'Snippet'))"""


@query("src_1", f"SELECT key, array_to_string(labels, ',') AS labels, name FROM kg_nodes WHERE {SCOPE} AND key <> ''")
def src_1(t):
    return g.run_nodes(t.kg_nodes, *RUN).select("key", F.array_join("labels", ",").alias("labels"), "name")


@query("src_2", f"""SELECT 'Snippet' AS label, key, coalesce(name,'') AS name, coalesce(function_name,'') AS function_name, coalesce(class_name,'') AS class_name,
   coalesce(file_path,'') AS file_path, coalesce(file_name,'') AS file_name FROM kg_nodes WHERE {SCOPE} AND list_contains(labels,'Snippet')""")
def src_2(t):
    return g.label_nodes(t.kg_nodes, "Snippet", *RUN)


@query("src_3", f"SELECT label, count(*) AS nodes FROM (SELECT unnest(labels) AS label FROM kg_nodes WHERE {SCOPE}) GROUP BY label")
def src_3(t):
    return g.label_counts(t.kg_nodes, *RUN)


@query("src_4", "SELECT key, name, topic FROM kg_nodes WHERE key = 'EF-3' AND list_contains(labels,'ExecutionFlow')")
def src_4(t):
    return g.flow_by_key(t.kg_nodes, "EF-3").select("key", "name", "topic")


@query("src_5", f"SELECT key, name, description FROM kg_nodes WHERE list_contains(labels,'ExecutionFlow') AND {SCOPE}")
def src_5(t):
    return g.run_flows(t.kg_nodes, *RUN).select("key", "name", "description")


@query("src_6", "SELECT flow_key, key FROM ck_members WHERE starts_flow")
def src_6(t):
    return g.participants(t.kg_nodes, t.kg_rels, g.flow_keys(t.kg_nodes, *RUN), starts_flow_only=True).select("flow_key", "key")


@query("src_7", """SELECT flow_key, key, type FROM (SELECT *, row_number() OVER (PARTITION BY flow_key ORDER BY CASE WHEN type='ROOT' THEN 0 ELSE 1 END, key) AS rn
   FROM ck_members WHERE starts_flow) WHERE rn = 1""")
def src_7(t):
    return g.root_snippets(snippets(t)).select("flow_key", "key", "type")


@query("src_8", "SELECT flow_key, key FROM ck_members UNION SELECT flow_key, callee_key FROM ck_calls")
def src_8(t):
    members = snippets(t)
    return g.flow_nodes(g.flow_calls(t.kg_nodes, t.kg_rels, members), members)


@query("src_9", "SELECT * FROM ck_calls")
def src_9(t):
    return g.flow_calls(t.kg_nodes, t.kg_rels, snippets(t))


DISPLAY = "coalesce(nullif({p}.function_name,''), nullif({p}.name,''), {p}.key)"


@query("src_10", f"""SELECT k.flow_key, k.seq, {DISPLAY.format(p='a')} AS caller, {DISPLAY.format(p='b')} AS callee, coalesce(a.file_path,'') AS caller_file,
   coalesce(b.file_path,'') AS callee_file, coalesce(a.class_name,'') AS caller_class, coalesce(b.class_name,'') AS callee_class,
   'neo4j' AS extraction_method, 1.0::DOUBLE AS confidence, k.execution_order FROM ck_calls k JOIN kg_nodes a ON a.key = k.caller_key JOIN kg_nodes b ON b.key = k.callee_key""")
def src_10(t):
    return g.catalog_edges(t.kg_nodes, g.flow_calls(t.kg_nodes, t.kg_rels, snippets(t)))


@fixture
def ck_raw_edges(d):
    return f"""SELECT coalesce(nullif(a.function_name,''), nullif(a.name,''), '') AS caller, coalesce(nullif(b.function_name,''), nullif(b.name,''), '') AS callee,
     coalesce(nullif(a.file_path,''), nullif(a.file_name,''), '') AS caller_file, coalesce(nullif(b.file_path,''), nullif(b.file_name,''), '') AS callee_file,
     coalesce(a.class_name,'') AS caller_class, coalesce(b.class_name,'') AS callee_class
     FROM kg_rels r JOIN kg_nodes a ON a.key = r.src_key JOIN kg_nodes b ON b.key = r.dst_key
     WHERE r.rel_type='CALLS' AND list_contains(a.labels,'Snippet') AND list_contains(b.labels,'Snippet') AND a.project_id = 1 AND a.run_id = 1"""


def nf(x):
    return f"upper(trim(regexp_replace(translate({x}, chr(92), '/'), '^.*/', '')))"


@fixture
def ck_catalog_keys(d):
    return f"""SELECT DISTINCT upper(trim(caller)) AS k_caller, {nf('caller_file')} AS k_caller_file, upper(trim(callee)) AS k_callee, {nf('callee_file')} AS k_callee_file
      FROM ck_raw_edges WHERE caller <> '' AND callee <> ''"""


def catalog_keyed(t):
    raw = g.project_call_edges(t.kg_nodes, t.kg_rels, *RUN)
    return edge_audit.keyed_first(raw, ["caller_file", "callee_file", "caller", "callee", "caller_class", "callee_class"])


@query("src_11", f"""WITH s AS (SELECT *, upper(trim(caller)) AS k_caller, {nf('caller_file')} AS k_caller_file, upper(trim(callee)) AS k_callee, {nf('callee_file')} AS k_callee_file
     FROM ck_raw_edges WHERE caller <> '' AND callee <> '')
   SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY k_caller, k_caller_file, k_callee, k_callee_file ORDER BY caller_file, callee_file, caller, callee, caller_class, callee_class) AS rn FROM s) WHERE rn = 1""")
def src_11(t):
    return catalog_keyed(t).drop("src_key", "dst_key")


@query("src_11_counts", """SELECT (SELECT count(*) FROM ck_raw_edges) AS raw_edges,
   (SELECT count(*) FROM kg_nodes WHERE project_id = 1 AND run_id = 1 AND list_contains(labels,'Snippet')) AS snippets""")
def src_11_counts(t):
    edges = g.project_call_edges(t.kg_nodes, t.kg_rels, *RUN).select(F.lit(1).alias("e"), F.lit(0).alias("s"))
    snips = g.label_nodes(t.kg_nodes, "Snippet", *RUN).select(F.lit(0).alias("e"), F.lit(1).alias("s"))
    return edges.unionByName(snips).agg(F.sum("e").alias("raw_edges"), F.sum("s").alias("snippets"))


CHILD_FIT = """CASE r.rel_type WHEN 'CONTAINS_DB_CALLS' THEN list_contains(c.labels,'DBCall') WHEN 'CONTAINS_CALCULATION' THEN list_contains(c.labels,'Calculation')
   WHEN 'CONTAINS_SERVICE_CALLS' THEN list_contains(c.labels,'ServiceCall') WHEN 'CONTAINS_INPUT' THEN list_has_any(c.labels,['InputEntity','InputInterface'])
   WHEN 'Contains_variable' THEN list_contains(c.labels,'Variable') ELSE false END"""


@fixture
def ck_children(d):
    return f"""SELECT DISTINCT m.flow_key, m.key AS parent_key, r.rel_type, r.dst_key AS child_key, c.labels[1] AS node_type
      FROM ck_members m JOIN kg_rels r ON r.src_key = m.key JOIN kg_nodes c ON c.key = r.dst_key WHERE {CHILD_FIT}"""


@query("src_12", "SELECT * FROM ck_children")
def src_12(t):
    return g.snippet_children(t.kg_nodes, t.kg_rels, snippets(t))


@fixture
def ck_steps(d):
    return """SELECT j.flow_key, j.key AS job_key, st.dst_key AS step_key, v.dst_key AS variable_key FROM ck_jobs j
      LEFT JOIN (SELECT DISTINCT src_key, dst_key FROM kg_rels WHERE rel_type='HAS_STEP' AND dst_key IN (SELECT key FROM kg_nodes WHERE list_contains(labels,'Step'))) st ON st.src_key = j.key
      LEFT JOIN (SELECT DISTINCT src_key, dst_key FROM kg_rels WHERE rel_type='Contains_variable' AND dst_key IN (SELECT key FROM kg_nodes WHERE list_contains(labels,'Variable'))) v ON v.src_key = st.dst_key"""


@query("src_13", "SELECT * FROM ck_steps")
def src_13(t):
    return g.job_steps(t.kg_nodes, t.kg_rels, snippets(t, "Job"))


@fixture
def ck_entities(d):
    return """SELECT DISTINCT m.flow_key, m.key AS snippet_key, e.key AS entity_key, f.key AS field_key FROM ck_members m
      JOIN kg_rels r1 ON r1.src_key = m.key AND r1.rel_type='CONTAINS_DB_CALLS' JOIN kg_nodes dbc ON dbc.key = r1.dst_key AND list_contains(dbc.labels,'DBCall')
      JOIN kg_rels r2 ON r2.src_key = dbc.key AND r2.rel_type IN ('ACCESSES','REFERENCES') JOIN kg_nodes e ON e.key = r2.dst_key AND list_contains(e.labels,'DatabaseEntity')
      LEFT JOIN kg_rels r3 ON r3.src_key = e.key AND r3.rel_type='HAS_FIELD' LEFT JOIN kg_nodes f ON f.key = r3.dst_key AND list_contains(f.labels,'DatabaseField')"""


@query("src_14", "SELECT * FROM ck_entities")
def src_14(t):
    return g.flow_entities(t.kg_nodes, t.kg_rels, snippets(t))


@fixture
def ck_topic_nodes(d):
    return """SELECT n.key AS node_key, coalesce(n.name,'') AS node_name, p.node_type, p.parent_key AS parent_snippet_key, p.flow_key AS ef_key,
      CASE WHEN priority = 3 THEN '' ELSE fl.flow_name END AS ef_name, n.topic,
      coalesce(nullif(n.business_summary,''), CASE WHEN p.node_type='DatabaseEntity' THEN n.description END, '') AS business_summary, coalesce(n.function_name,'') AS function_name
      FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY priority, flow_key, coalesce(parent_key,''), node_type) AS rn FROM (
        SELECT 0 AS priority, key, coalesce(list_filter(labels, lambda x: x NOT IN ('Node','Resource'))[1], 'Snippet') AS node_type, NULL AS parent_key, flow_key FROM ck_members
        UNION ALL SELECT 1, child_key, node_type, parent_key, flow_key FROM ck_children
        UNION ALL SELECT 2, key, 'Job', NULL, flow_key FROM ck_jobs
        UNION ALL SELECT 2, step_key, 'Step', job_key, flow_key FROM ck_steps WHERE step_key IS NOT NULL
        UNION ALL SELECT 2, variable_key, 'Variable', job_key, flow_key FROM ck_steps WHERE variable_key IS NOT NULL
        UNION ALL SELECT 3, entity_key, 'DatabaseEntity', snippet_key, flow_key FROM ck_entities
        UNION ALL SELECT 3, field_key, 'DatabaseField', entity_key, flow_key FROM ck_entities WHERE field_key IS NOT NULL)) p
      JOIN kg_nodes n ON n.key = p.key JOIN ck_flows fl ON fl.flow_key = p.flow_key WHERE rn = 1"""


@query("src_15", "SELECT * FROM ck_topic_nodes")
def src_15(t):
    return g.topic_nodes(t.kg_nodes, t.kg_rels, *RUN)


@query("src_16", f"""SELECT DISTINCT c.key, c.labels[1] AS label FROM ck_members m JOIN kg_rels r ON r.src_key = m.key JOIN kg_nodes c ON c.key = r.dst_key
   WHERE r.rel_type = 'CONTAINS_INPUT' OR {CHILD_FIT}""")
def src_16(t):
    return g.child_nodes(t.kg_nodes, t.kg_rels, snippets(t)).select("key", F.get("labels", F.lit(0)).alias("label"))


@query("src_17", f"""SELECT DISTINCT r.src_key AS snippet_key, r.rel_type, r.dst_key AS child_key FROM kg_rels r
   WHERE r.src_key IN (SELECT key FROM ck_members) AND r.rel_type IN {tuple(g.CONTAINED_RELATIONS)}""")
def src_17(t):
    return g.contained_keys(t.kg_rels, snippets(t))


@query("src_18", f"""WITH e AS (SELECT key, name, coalesce(nullif(schema_name,''), nullif(schema_table,''), '') AS schema_name FROM kg_nodes WHERE list_contains(labels,'DatabaseEntity') AND {SCOPE}),
   s AS (SELECT name AS entity, arg_min(schema_name, key) AS schema_name FROM e GROUP BY name),
   f AS (SELECT e.name AS entity, n.name AS field, n.data_type, NOT list_contains(n.constraints,'NOT NULL') AS is_nullable, list_contains(n.constraints,'PRIMARY KEY') AS is_primary_key,
      row_number() OVER (PARTITION BY e.name, n.name ORDER BY e.key, n.key) AS rn FROM e JOIN kg_rels r ON r.src_key = e.key AND r.rel_type='HAS_FIELD' JOIN kg_nodes n ON n.key = r.dst_key)
   SELECT s.entity, s.schema_name, f.field, f.data_type, f.is_nullable, f.is_primary_key FROM s LEFT JOIN f ON f.entity = s.entity AND f.rn = 1""")
def src_18(t):
    return g.entity_fields(t.kg_nodes, t.kg_rels, *RUN)


@query("src_19", """WITH r AS (SELECT src_key AS node_key, 'out' AS direction, rel_type, dst_key AS other_key FROM kg_rels UNION ALL SELECT dst_key, 'in', rel_type, src_key FROM kg_rels)
   SELECT r.node_key, r.direction, r.rel_type, r.other_key, n.labels[1] AS other_label, n.name AS other_name FROM r JOIN kg_nodes n ON n.key = r.other_key
   WHERE r.node_key IN (SELECT key FROM kg_nodes WHERE list_contains(labels,'DatabaseEntity'))""")
def src_19(t):
    return g.neighbourhood(t.kg_nodes, t.kg_rels, "DatabaseEntity")


@query("src_33", """SELECT concat(function_name,'@',file_path) AS id, function_name AS name, file_path AS file, language, class_name AS class,
   CASE WHEN class_name <> '' THEN 'class' ELSE 'function' END AS type FROM code_index""")
def src_33(t):
    return lookup.index_listing(t.code_index)


@query("src_34", "SELECT DISTINCT l AS label, unnest(map_keys(props)) AS property FROM (SELECT unnest(labels) AS l, props FROM kg_nodes)")
def src_34(t):
    return g.property_keys(t.kg_nodes)


@query("src_34_runs", "SELECT DISTINCT run_id FROM kg_nodes WHERE project_id = 1")
def src_34_runs(t):
    return g.project_runs(t.kg_nodes, 1)


# ------------------------------------------------------------------ filters


@fixture
def wanted_names(d):
    return "SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN upper(fn) WHEN p_partkey % 3 = 1 THEN concat(' ', fn) ELSE concat(fn, 'x') END AS name FROM part JOIN kg_part ON pk = p_partkey"


@query("fil_1", """WITH r AS (SELECT concat('EF-', s_suppkey) AS flow_key, CASE WHEN s_suppkey % 7 = 0 THEN '' WHEN s_suppkey % 2 = 0 THEN 'D:/x/PROMO.dfm' ELSE '/mnt/small.PAS' END AS root_file FROM supplier),
   p AS (SELECT DISTINCT file_path AS path, upper(regexp_replace(file_path,'^.*/','')) AS fname FROM code_index),
   x AS (SELECT flow_key, root_file, upper(regexp_replace(root_file,'^.*/','')) AS fname FROM r),
   h AS (SELECT flow_key, CASE WHEN root_file = '' THEN NULL ELSE coalesce((SELECT min(path) FROM p WHERE p.fname = x.fname),
       (SELECT min(path) FROM p WHERE regexp_replace(p.fname,'[.][^.]*$','') = regexp_replace(x.fname,'[.][^.]*$',''))) END AS hit FROM x),
   q AS (SELECT flow_key, CASE WHEN hit LIKE '%/%' THEN string_split(hit,'/')[1] ELSE '' END AS prefix FROM h),
   k AS (SELECT prefix, count(*) AS kept FROM (SELECT DISTINCT coalesce(prefix,'') AS prefix FROM q) JOIN call_edges e ON starts_with(upper(e.caller), upper(prefix)) GROUP BY prefix)
   SELECT q.flow_key, coalesce(q.prefix,'') AS prefix, coalesce(k.kept, 0) AS kept, (SELECT count(*) FROM call_edges) - coalesce(k.kept, 0) AS skipped FROM q LEFT JOIN k ON k.prefix = coalesce(q.prefix,'')""")
def fil_1(t):
    roots = t.supplier.selectExpr("concat('EF-', s_suppkey) AS flow_key", "CASE WHEN s_suppkey % 7 = 0 THEN '' WHEN s_suppkey % 2 = 0 THEN 'D:/x/PROMO.dfm' ELSE '/mnt/small.PAS' END AS root_file")
    prefixes = normalize.project_prefixes(roots, t.code_index.select(F.col("file_path").alias("path")))
    edges = t.call_edges.withColumn("path", fx.chunk_file("caller"))
    kept = normalize.scope_edges(edges, prefixes, "path").groupBy("prefix").agg(F.count(F.lit(1)).alias("kept"))
    total = t.call_edges.agg(F.count(F.lit(1)).alias("n")).scalar()
    n = F.coalesce("kept", F.lit(0))
    return prefixes.join(kept, "prefix", "left").select("flow_key", "prefix", n.alias("kept"), (total - n).alias("skipped"))


@query("fil_2", """WITH e AS (SELECT function_name, arg_min(file_path, seq) AS f FROM code_index GROUP BY 1), l AS (SELECT lower(function_name) AS n, arg_min(file_path, seq) AS f FROM code_index GROUP BY 1)
   SELECT w.name, coalesce(e.f, l.f) AS file_path FROM wanted_names w LEFT JOIN e ON e.function_name = trim(w.name) LEFT JOIN l ON l.n = lower(trim(w.name))""")
def fil_2(t):
    return lookup.lookup_files(t.wanted_names, t.code_index)


@query("fil_3", "SELECT function_name, file_path, class_name, seq FROM code_index WHERE function_name = 'Red_bolt' AND class_name = 'TSMALL' ORDER BY file_path, class_name, seq LIMIT 10")
def fil_3(t):
    return lookup.search_functions(t.code_index, "Red_bolt", class_name="TSMALL", limit=10).select("function_name", "file_path", "class_name", "seq")


@query("fil_4", "SELECT function_name, file_path, class_name FROM code_index WHERE upper(function_name) = 'RED_BOLT' AND upper(class_name) = 'TSMALL'")
def fil_4(t):
    return lookup.search_index(t.code_index, "red_Bolt", "tsmall")


@query("fil_5", f"SELECT caller AS caller_raw, callee AS callee_raw, {LAST.format(x='callee')} AS callee_name, confidence FROM call_edges WHERE upper({LAST.format(x='caller')}) = 'RED_BOLT'")
def fil_5(t):
    return lookup.outgoing_edges(t.call_edges, "red_bolt")


@query("fil_6", "SELECT function_name, file_path, class_name FROM code_index WHERE starts_with(upper(file_path), 'SRC/BRAND_1') ORDER BY seq LIMIT 50")
def fil_6(t):
    return lookup.list_functions(t.code_index, "src/brand_1", limit=50)


@query("fil_8", "SELECT caller, callee, confidence FROM call_edges WHERE caller LIKE '%Small_gear%' OR callee LIKE '%Small_gear%'")
def fil_8(t):
    return lookup.edges_like(t.call_edges, "%Small_gear%").select("caller", "callee", "confidence")


@query("fil_10", """SELECT c.key, c.path IN (SELECT url FROM pages) AS file_exists, coalesce((SELECT bool_or(contains(html, c.function_name)) FROM pages WHERE url = c.path), false) AS function_exists
   FROM (SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN (SELECT min(url) FROM pages) ELSE concat('x', c_custkey) END AS path, CASE WHEN c_custkey % 4 = 0 THEN 'article' ELSE 'nonesuch' END AS function_name FROM customer) c""")
def fil_10(t):
    first = t.pages.agg(F.min("url")).scalar()
    files = t.pages.select(F.col("url").alias("path"), F.col("html").alias("content")).dropDuplicates(["path"])
    want = t.customer.select(
        F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 2 == 0, first).otherwise(F.concat(F.lit("x"), "c_custkey")).alias("path"),
        F.when(F.col("c_custkey") % 4 == 0, "article").otherwise("nonesuch").alias("function_name"))
    return lookup.functions_present(lookup.files_present(want, files), files).select("key", "file_exists", "function_exists")


@query("fil_14", f"SELECT key, label FROM (SELECT key, unnest(labels) AS label, topic FROM kg_nodes WHERE {SCOPE}) WHERE trim(coalesce(topic,'')) = ''")
def fil_14(t):
    return g.run_nodes(t.kg_nodes, *RUN).where(fx.is_blank("topic")).select("key", F.explode("labels").alias("label"))


# ------------------------------------------------------------------ edge audit and sets


def stored_raw(t):
    return t.call_edges.select(
        fx.chunk_function_strict("caller").alias("caller"), fx.chunk_function_strict("callee").alias("callee"), fx.chunk_file("caller").alias("caller_file"),
        fx.chunk_file("callee").alias("callee_file"), fx.chunk_class("caller").alias("caller_class"), fx.chunk_class("callee").alias("callee_class"), "confidence", "seq")


@fixture
def ck_stored(d):
    fn = f"CASE WHEN {LAST} = trim(string_split({{x}},'::')[1]) THEN '' ELSE {LAST} END"
    return f"""SELECT seq, confidence, {fn.format(x='caller')} AS caller, {fn.format(x='callee')} AS callee, trim(string_split(caller,'::')[1]) AS caller_file, trim(string_split(callee,'::')[1]) AS callee_file,
      CASE WHEN len(string_split(caller,'::')) >= 3 THEN trim(string_split(caller,'::')[2]) ELSE '' END AS caller_class, CASE WHEN len(string_split(callee,'::')) >= 3 THEN trim(string_split(callee,'::')[2]) ELSE '' END AS callee_class FROM call_edges"""


@fixture
def ck_stored_keys(d):
    return f"""SELECT DISTINCT upper(trim(caller)) AS k_caller, {nf('caller_file')} AS k_caller_file, upper(trim(callee)) AS k_callee, {nf('callee_file')} AS k_callee_file FROM ck_stored WHERE caller <> '' AND callee <> ''"""


def stored_keyed(t):
    return edge_audit.keyed_first(stored_raw(t), ["seq", "caller", "callee", "caller_file", "callee_file", "caller_class", "callee_class", "confidence"])


@fixture
def ck_audit(d):
    return """WITH conf AS (SELECT * FROM ck_catalog_keys INTERSECT SELECT * FROM ck_stored_keys), miss AS (SELECT * FROM ck_stored_keys EXCEPT SELECT * FROM ck_catalog_keys),
      ph AS (SELECT * FROM ck_catalog_keys EXCEPT SELECT * FROM ck_stored_keys),
      firsts AS (SELECT k_caller, k_callee, min((k_caller_file, k_callee_file)) AS f FROM ph GROUP BY ALL)
      SELECT *, 'confirmed' AS bucket FROM conf
      UNION ALL SELECT m.*, CASE WHEN f.f IS NULL THEN 'missing' ELSE 'confirmed_by_name' END FROM miss m LEFT JOIN firsts f ON f.k_caller = m.k_caller AND f.k_callee = m.k_callee
      UNION ALL SELECT p.*, 'phantom' FROM ph p JOIN firsts f ON f.k_caller = p.k_caller AND f.k_callee = p.k_callee
        WHERE NOT (f.f = (p.k_caller_file, p.k_callee_file) AND EXISTS (SELECT 1 FROM miss m WHERE m.k_caller = p.k_caller AND m.k_callee = p.k_callee))"""


@query("join_5", "SELECT * FROM ck_audit")
def join_5(t):
    return edge_audit.audit_edges(catalog_keyed(t), stored_keyed(t))


@query("agg_8", """SELECT *, CASE WHEN coverage*100 >= 70 THEN 'green' WHEN coverage*100 >= 40 THEN 'orange' ELSE 'red' END AS band FROM (
   SELECT confirmed, missing, phantom, name_only_matches, round(confirmed / greatest(confirmed + missing, 1), 6) AS coverage FROM (
   SELECT count_if(bucket LIKE 'confirmed%') AS confirmed, count_if(bucket='missing') AS missing, count_if(bucket='phantom') AS phantom, count_if(bucket='confirmed_by_name') AS name_only_matches FROM ck_audit))""")
def agg_8(t):
    return edge_audit.audit_summary(edge_audit.audit_edges(catalog_keyed(t), stored_keyed(t))).withColumn("coverage", F.round("coverage", 6))


@query("join_22", f"""WITH i AS (SELECT upper(trim(function_name)) AS fn, {nf('file_path')} AS f, arg_max(class_name, (file_path, class_name)) AS cls FROM code_index GROUP BY ALL)
   SELECT s.caller, s.callee, s.caller_file, s.callee_file, s.seq, s.confidence, coalesce(nullif(s.caller_class,''), i1.cls, '') AS caller_class, coalesce(nullif(s.callee_class,''), i2.cls, '') AS callee_class
   FROM ck_stored s LEFT JOIN i i1 ON i1.fn = upper(trim(s.caller)) AND i1.f = {nf('s.caller_file')} LEFT JOIN i i2 ON i2.fn = upper(trim(s.callee)) AND i2.f = {nf('s.callee_file')}""")
def join_22(t):
    return edge_audit.backfill_classes(stored_raw(t), t.code_index)


@query("set_1", "SELECT * FROM ck_catalog_keys INTERSECT SELECT * FROM ck_stored_keys")
def set_1(t):
    return edge_audit.common_keys(g.project_call_edges(t.kg_nodes, t.kg_rels, *RUN), stored_raw(t))


@query("set_2", "SELECT *, 'catalog' AS side FROM (SELECT * FROM ck_catalog_keys EXCEPT SELECT * FROM ck_stored_keys) UNION ALL SELECT *, 'stored' FROM (SELECT * FROM ck_stored_keys EXCEPT SELECT * FROM ck_catalog_keys)")
def set_2(t):
    k = edge_audit.EDGE_KEY
    a, b = catalog_keyed(t).select(*k), stored_keyed(t).select(*k)
    return a.subtract(b).withColumn("side", F.lit("catalog")).unionByName(b.subtract(a).withColumn("side", F.lit("stored")))


@query("set_3", "SELECT lower(p_brand) AS table_key FROM part UNION SELECT lower(name) FROM kg_nodes WHERE list_contains(labels,'DatabaseEntity')")
def set_3(t):
    entities = g.labelled(t.kg_nodes, "DatabaseEntity").select(F.lower("name").alias("table_key"))
    return t.part.select(F.lower("p_brand").alias("table_key")).unionByName(entities).distinct()


@query("set_4", "SELECT node_type, count(*) AS nodes FROM ck_topic_nodes GROUP BY node_type")
def set_4(t):
    return g.topic_nodes(t.kg_nodes, t.kg_rels, *RUN).groupBy("node_type").agg(F.count(F.lit(1)).alias("nodes"))


@query("set_7", """SELECT DISTINCT flow_key, file FROM (SELECT flow_key, caller_file AS file FROM edges_a UNION ALL SELECT flow_key, callee_file FROM edges_a UNION ALL SELECT DISTINCT flow_key, 'root.pas' FROM edges_a) WHERE trim(file) <> ''""")
def set_7(t):
    roots = t.edges_a.select("flow_key", F.lit("root.pas").alias("root_file")).distinct()
    return lookup.endpoint_files(t.edges_a, roots)


@query("set_8", "SELECT caller_key, callee_key, count(*) AS sites, count(DISTINCT flow_key) AS flows FROM ck_calls GROUP BY ALL")
def set_8(t):
    calls = g.flow_calls(t.kg_nodes, t.kg_rels, snippets(t))
    return calls.groupBy("caller_key", "callee_key").agg(F.count(F.lit(1)).alias("sites"), F.countDistinct("flow_key").alias("flows"))


# ------------------------------------------------------------------ scalar functions


@query("fn_1", f"SELECT DISTINCT caller_file AS path, {nf('caller_file')} AS file FROM edges_a")
def fn_1(t):
    return t.edges_a.select(F.col("caller_file").alias("path"), fx.norm_file("caller_file").alias("file")).distinct()


@query("fn_2", "SELECT DISTINCT caller, regexp_replace(upper(trim(caller)), '^.*[.]', '') AS bare FROM edges_a")
def fn_2(t):
    return t.edges_a.select("caller", fx.bare_name("caller").alias("bare")).distinct()


@query("fn_3", f"""SELECT DISTINCT callee AS chunk, trim(string_split(callee,'::')[1]) AS file, CASE WHEN len(string_split(callee,'::')) >= 3 THEN trim(string_split(callee,'::')[2]) ELSE '' END AS class,
   CASE WHEN {LAST.format(x='callee')} = trim(string_split(callee,'::')[1]) AND contains(callee, '/') THEN '' ELSE {LAST.format(x='callee')} END AS function FROM call_edges""")
def fn_3(t):
    return t.call_edges.select(F.col("callee").alias("chunk"), fx.chunk_file("callee").alias("file"), fx.chunk_class("callee").alias("class"), fx.chunk_function("callee").alias("function")).distinct()


@query("fn_4", "SELECT concat(file_path,'::',class_name,'::',function_name) AS chunk_id FROM code_index")
def fn_4(t):
    return t.code_index.select(fx.chunk_id("file_path", "class_name", "function_name").alias("chunk_id"))


@query("fn_5", """SELECT p_partkey AS pk, coalesce(upper(a.canonical), upper(trim(x.name))) AS name FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN concat(' A_', upper(p_name)) ELSE concat('b ', p_name) END AS name FROM part) x
   LEFT JOIN aliases a ON upper(a.alias) = upper(trim(x.name))""")
def fn_5(t):
    names = t.part.selectExpr("p_partkey AS pk", "CASE WHEN p_partkey % 2 = 0 THEN concat(' A_', upper(p_name)) ELSE concat('b ', p_name) END AS name")
    return normalize.resolve_aliases(names, "name", t.aliases)


@query("fn_6", "SELECT flow_key, seq, c AS caller, cc AS caller_class, cf AS caller_file, e AS callee, ec AS callee_class, ef AS callee_file FROM norm_a")
def fn_6(t):
    return sides(t)[0].select("flow_key", "seq", *[c for c in diff.KEY6 if c != "flow_key"])


@query("fn_7", f"SELECT DISTINCT upper(trim(caller)) AS k_caller, {nf('caller_file')} AS k_caller_file, upper(trim(callee)) AS k_callee, {nf('callee_file')} AS k_callee_file FROM edges_b")
def fn_7(t):
    return edge_audit.with_edge_key(t.edges_b).select(*edge_audit.EDGE_KEY).distinct()


@query("fn_8", """SELECT DISTINCT regexp_replace(regexp_replace(caller_file,'^.*/',''),'[.][^.]*$','') AS stem, caller_file, callee_file,
   CASE WHEN caller_file = callee_file THEN 3 WHEN string_split(caller_file,'/')[2] = string_split(callee_file,'/')[2] THEN 2 ELSE 1 END AS shared FROM edges_b""")
def fn_8(t):
    return t.edges_b.select(fx.file_stem("caller_file").alias("stem"), "caller_file", "callee_file",
                            fx.shared_lead(F.split("caller_file", "/"), F.split("callee_file", "/")).alias("shared")).distinct()


@query("fn_9", "SELECT key, coalesce(list_filter(labels, lambda x: x NOT IN ('Node','Resource'))[1], 'Snippet') AS label FROM kg_nodes")
def fn_9(t):
    return t.kg_nodes.select("key", fx.pick_label("labels", "Snippet").alias("label"))


@query("fn_10", """SELECT doc_id, CASE WHEN length(b) > 500 THEN concat(substr(b,1,500), chr(10), '... (truncated)') ELSE b END AS body
   FROM (SELECT doc_id, trim(text, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)) AS b FROM documents)""")
def fn_10(t):
    return t.documents.select("doc_id", fx.truncate("text").alias("body"))


@query("fn_11", "SELECT event_type, props, lower(trim(event_type)) IN ('true','yes','1','t','y') AS flag FROM (SELECT DISTINCT CASE WHEN event_id % 3 = 0 THEN ' Yes ' WHEN event_id % 3 = 1 THEN 'T' ELSE event_type END AS event_type, props FROM events)")
def fn_11(t):
    e = t.events.selectExpr("CASE WHEN event_id % 3 = 0 THEN ' Yes ' WHEN event_id % 3 = 1 THEN 'T' ELSE event_type END AS event_type", "props").distinct()
    return e.withColumn("flag", fx.lenient_bool("event_type"))


@query("fn_12", f"SELECT key, {DISPLAY.format(p='n')} AS display FROM kg_nodes n")
def fn_12(t):
    return t.kg_nodes.select("key", fx.display_name("function_name", "name", "key").alias("display"))


@query("fn_13", """SELECT DISTINCT callee, CASE WHEN len(p) >= 3 THEN concat(coalesce(nullif(p[3],''), nullif(p[2],''), f), ' (', f, ')') ELSE callee END AS short
   FROM (SELECT callee, string_split(callee,'::') AS p, regexp_replace(string_split(callee,'::')[1],'^.*/','') AS f FROM call_edges)""")
def fn_13(t):
    return t.call_edges.select("callee", fx.short_chunk("callee").alias("short")).distinct()


@query("fn_15", "SELECT l_suppkey, round(count_if(l_returnflag='R') / greatest(count_if(l_linestatus='O'), 1), 6) AS ratio FROM lineitem GROUP BY l_suppkey")
def fn_15(t):
    return t.lineitem.groupBy("l_suppkey").agg(
        F.round(fx.safe_ratio(F.count_if(F.col("l_returnflag") == "R"), F.count_if(F.col("l_linestatus") == "O")), 6).alias("ratio"))
