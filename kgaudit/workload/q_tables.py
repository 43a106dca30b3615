"""Schema compare, coverage, ground truth, stored tables, exports, vectors, change log, streams."""

from pyspark.sql import functions as F

from kgaudit.functions import scalars as fx
from kgaudit.operators import changes, coverage, schema_diff, vectors
from kgaudit.session import shared_folder
from kgaudit.sources import exports, schema_files, tables
from kgaudit.sources import graph as g
from kgaudit.streaming import change_log, reindex
from kgaudit.workload.q_flow import bare, sides
from kgaudit.workload.q_sources import RUN, SCOPE, nf, snippets
from kgaudit.workload.registry import fixture, query

# ------------------------------------------------------------------ schema compare


@fixture
def db_columns(d):
    return """SELECT p_brand AS table_name, p_type AS column_name, concat('TYPE', CAST(min(p_size) % 3 AS STRING)) AS data_type, min(p_partkey) AS seq
      FROM part WHERE p_brand NOT LIKE '%3' AND NOT (p_type = 'PROMO' AND p_brand LIKE '%5') GROUP BY p_brand, p_type"""


@fixture
def entity_columns(d):
    return """SELECT upper(p_brand) AS table_name, lower(p_type) AS column_name,
      CASE WHEN p_type = 'SMALL' THEN '' ELSE concat('type', CAST(max(p_size) % 3 AS STRING)) END AS data_type, min(p_partkey) AS seq
      FROM part WHERE p_brand NOT LIKE '%7' AND NOT (p_type = 'LARGE' AND p_brand LIKE '%2') GROUP BY p_brand, p_type"""


@fixture
def ck_tables(d):
    return """SELECT coalesce(a.k, b.k) AS table_key, coalesce(a.n, b.n) AS table_name, CASE WHEN a.k IS NULL THEN 'ONLY_IN_NEO4J' WHEN b.k IS NULL THEN 'ONLY_IN_DB' ELSE 'MATCHED' END AS status
      FROM (SELECT lower(table_name) AS k, max(table_name) AS n FROM db_columns GROUP BY 1) a FULL JOIN (SELECT lower(table_name) AS k, max(table_name) AS n FROM entity_columns GROUP BY 1) b ON a.k = b.k"""


@fixture
def ck_columns(d):
    return """SELECT t.table_key, t.table_name, coalesce(a.column_name, b.column_name) AS column_name,
      CASE WHEN a.column_name IS NULL THEN 'ONLY_IN_NEO4J' WHEN b.column_name IS NULL THEN 'ONLY_IN_DB'
           WHEN trim(a.data_type) <> '' AND trim(b.data_type) <> '' AND lower(a.data_type) <> lower(b.data_type) THEN 'TYPE_MISMATCH' ELSE 'MATCHED' END AS status,
      coalesce(a.data_type,'') AS db_type, coalesce(b.data_type,'') AS graph_type
      FROM db_columns a FULL JOIN entity_columns b ON lower(a.table_name) = lower(b.table_name) AND lower(a.column_name) = lower(b.column_name)
      JOIN ck_tables t ON t.table_key = lower(coalesce(a.table_name, b.table_name)) AND t.status = 'MATCHED'"""


@query("join_6", "SELECT * FROM ck_tables")
def join_6(t):
    return schema_diff.compare_tables(t.db_columns, t.entity_columns)


@query("join_7", "SELECT * FROM ck_columns")
def join_7(t):
    return schema_diff.compare_columns(t.db_columns, t.entity_columns)


@query("agg_9", """SELECT (SELECT count(*) FROM ck_tables) AS total_tables, (SELECT count(*) FROM ck_tables WHERE status='MATCHED') AS matched_tables,
   (SELECT count(*) FROM ck_tables WHERE status='ONLY_IN_DB') AS only_in_db, (SELECT count(*) FROM ck_tables WHERE status='ONLY_IN_NEO4J') AS only_in_neo4j,
   count(*) AS total_columns_compared, count_if(status='MATCHED') AS matched_columns, count_if(status='ONLY_IN_DB') AS columns_only_in_db,
   count_if(status='ONLY_IN_NEO4J') AS columns_only_in_neo4j, count_if(status='TYPE_MISMATCH') AS type_mismatches FROM ck_columns""")
def agg_9(t):
    return schema_diff.schema_summary(join_6(t), join_7(t))


@query("agg_28", "SELECT table_name, count_if(status='MATCHED') AS matched, count(*) AS total, count(*) - count_if(status='MATCHED') AS issues FROM ck_columns GROUP BY table_name")
def agg_28(t):
    return schema_diff.table_listing(join_7(t))


@query("fil_12", "SELECT * FROM ck_tables WHERE status <> 'MATCHED' OR table_key IN (SELECT table_key FROM ck_columns WHERE status <> 'MATCHED')")
def fil_12(t):
    return schema_diff.tables_with_issues(join_6(t), join_7(t)).select("table_key", "table_name", "status")


SCHEMA_TEXT = ["concat(' ', p_brand, ' ') AS table_name", "concat(p_type, ' ', p_partkey) AS column_name", "concat('T', p_size) AS data_type",
               "CASE WHEN p_size % 3 = 0 THEN ' YES' WHEN p_size % 3 = 1 THEN 'no' ELSE 'True' END AS is_nullable", "CASE WHEN p_size % 7 = 0 THEN '1' ELSE '' END AS is_primary_key"]


@query("src_21", """SELECT p_brand AS table_name, concat(p_type, ' ', p_partkey) AS column_name, concat('T', p_size) AS data_type, p_size % 3 <> 1 AS is_nullable, p_size % 7 = 0 AS is_primary_key FROM part""")
def src_21(t):
    path = shared_folder(t.spark, "schema-csv")
    exports.write_csv(t.part.selectExpr(*SCHEMA_TEXT), path)
    return schema_files.read_schema_csv(t.spark, path)


@query("src_22", """SELECT p_brand AS table_name, p_type AS column_name, CASE WHEN p_size % 5 = 0 THEN '' ELSE concat('T', p_size) END AS data_type, p_size % 3 <> 1 AS is_nullable, p_size % 7 = 0 AS is_primary_key FROM part""")
def src_22(t):
    col = """concat('{"name":"', p_type, '"', CASE WHEN p_size % 5 = 0 THEN '' ELSE concat(',"data_type":"T', p_size, '"') END,
      CASE WHEN p_size % 3 = 1 THEN ',"is_nullable":false' ELSE '' END, CASE WHEN p_size % 7 = 0 THEN ',"is_primary_key":true' ELSE '' END, '}')"""
    table = f"""concat('{{"name":"', p_brand, '","columns":[', {col}, ']}}')"""
    docs = t.part.selectExpr(f"""CASE WHEN p_partkey % 2 = 0 THEN concat('{{"tables":[', {table}, ']}}') ELSE concat(' [', {table}, ']') END AS value""")
    return schema_files.parse_schema_json(docs)


CATALOG = {
    "tables": "SELECT DISTINCT 'public' AS table_schema, p_brand AS table_name, CASE WHEN p_brand LIKE '%1' THEN 'VIEW' ELSE 'BASE TABLE' END AS table_type FROM part",
    "columns": "SELECT 'public' AS table_schema, p_brand AS table_name, concat(p_type, '_', CAST(p_partkey AS STRING)) AS column_name, concat('t', CAST(p_size AS STRING)) AS data_type, CASE WHEN p_size % 2 = 0 THEN 'YES' ELSE 'NO' END AS is_nullable, p_partkey AS ordinal_position FROM part",
    "constraints": "SELECT DISTINCT 'public' AS table_schema, p_brand AS table_name, concat('pk_', p_brand) AS constraint_name, 'PRIMARY KEY' AS constraint_type FROM part WHERE p_brand NOT LIKE '%2'",
    "key_usage": "SELECT 'public' AS table_schema, p_brand AS table_name, concat('pk_', p_brand) AS constraint_name, concat(p_type, '_', CAST(p_partkey AS STRING)) AS column_name FROM part WHERE p_size = 7",
}
for _name, _sql in CATALOG.items():
    def _make(sql):
        return lambda d: sql
    _fn = _make(_sql)
    _fn.__name__ = f"cat_{_name}"
    fixture(_fn)


@query("src_23", """SELECT c.table_name, c.column_name, c.data_type, c.is_nullable = 'YES' AS is_nullable, k.column_name IS NOT NULL AS is_primary_key, c.ordinal_position AS seq
   FROM cat_columns c JOIN cat_tables t ON t.table_name = c.table_name AND t.table_type = 'BASE TABLE'
   LEFT JOIN cat_constraints x ON x.table_name = c.table_name LEFT JOIN cat_key_usage k ON k.constraint_name = x.constraint_name AND k.table_name = c.table_name AND k.column_name = c.column_name""")
def src_23(t):
    return schema_diff.catalog_schema(t.cat_tables, t.cat_columns, t.cat_constraints, t.cat_key_usage, "public")


@query("join_20", """SELECT c.table_name, count(*) AS columns, count(k.column_name) AS key_columns FROM cat_columns c JOIN cat_tables t ON t.table_name = c.table_name AND t.table_type = 'BASE TABLE'
   LEFT JOIN cat_constraints x ON x.table_name = c.table_name LEFT JOIN cat_key_usage k ON k.constraint_name = x.constraint_name AND k.column_name = c.column_name GROUP BY c.table_name""")
def join_20(t):
    return src_23(t).groupBy("table_name").agg(F.count("column_name").alias("columns"), F.count_if("is_primary_key").alias("key_columns"))


# ------------------------------------------------------------------ coverage


def graph_nodes(t):
    return g.all_label_nodes(t.kg_nodes, *RUN)


@fixture
def ck_lookup(d):
    return f"""SELECT DISTINCT unnest([upper(trim(f)), {bare('upper(trim(f))')}]) AS k, label, key, upper(trim(coalesce(class_name,''))) AS cls, {nf("coalesce(nullif(file_path,''), file_name, '')")} AS file
      FROM (SELECT coalesce(nullif(function_name,''), name, '') AS f, unnest(labels) AS label, key, class_name, file_path, file_name FROM kg_nodes WHERE {SCOPE}) WHERE f <> ''"""


@fixture
def ck_coverage(d):
    return f"""WITH f AS (SELECT *, upper(trim(function_name)) AS n, upper(trim(class_name)) AS cls, {nf('file_path')} AS file FROM code_index),
      k AS (SELECT f.*, CASE WHEN n IN (SELECT k FROM ck_lookup) THEN n ELSE {bare('n')} END AS k FROM f),
      c AS (SELECT k.function_name, k.file_path, k.class_name, l.label, l.key, CASE WHEN l.k IS NULL THEN 4 WHEN l.file = k.file AND k.file <> '' AND l.cls = k.cls AND k.cls <> '' THEN 1 WHEN l.file = k.file AND k.file <> '' THEN 2 ELSE 3 END AS tier
            FROM k LEFT JOIN ck_lookup l ON l.k = k.k)
      SELECT function_name, file_path, class_name, CASE min(tier) WHEN 1 THEN 'full' WHEN 2 THEN 'name_file' WHEN 3 THEN 'name_only' ELSE 'none' END AS match_tier,
        CASE min(tier) WHEN 4 THEN 'uncovered' ELSE 'covered' END AS status, coalesce(arg_min(label, (tier, label, key)), '') AS matched_label FROM c GROUP BY ALL"""


@query("join_8", "SELECT * FROM ck_coverage")
def join_8(t):
    return coverage.match_functions(t.code_index.select("function_name", "file_path", "class_name").distinct(), graph_nodes(t))


@fixture
def ck_files(d):
    return f"""SELECT {nf('file_path')} AS file, min(file_path) AS file_path, count(*) AS functions, count_if(status='covered') AS covered, count_if(status<>'covered') AS uncovered,
      CASE WHEN bool_and(status='covered') THEN 'covered' WHEN bool_or(status='covered') THEN 'partial' ELSE 'uncovered' END AS status FROM ck_coverage GROUP BY 1"""


@query("agg_6", "SELECT * FROM ck_files")
def agg_6(t):
    return coverage.file_coverage(join_8(t))


@query("agg_6_summary", """SELECT *, round((covered_files + partial_files) / files * 100, 6) AS file_pct, round(covered_functions / functions * 100, 6) AS function_pct FROM (
   SELECT count(*) AS files, count_if(status='covered') AS covered_files, count_if(status='partial') AS partial_files, count_if(status='uncovered') AS uncovered_files,
   sum(functions)::BIGINT AS functions, sum(covered)::BIGINT AS covered_functions FROM ck_files)""")
def agg_6_summary(t):
    out = coverage.coverage_summary(agg_6(t))
    return out.withColumns({c: F.round(c, 6) for c in ("file_pct", "function_pct")})


@query("agg_7", f"""SELECT file, string_agg(concat(label,'=',n), ',' ORDER BY label) AS node_counts, sum(n)::BIGINT AS total_nodes FROM (
   SELECT {nf("coalesce(nullif(file_path,''), file_name, '')")} AS file, label, count(*) AS n FROM (SELECT *, unnest(labels) AS label FROM kg_nodes WHERE {SCOPE}) GROUP BY ALL) WHERE file <> '' GROUP BY file""")
def agg_7(t):
    pairs = F.transform(F.map_entries("node_counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return coverage.graph_inventory(graph_nodes(t)).withColumn("node_counts", F.array_join(F.array_sort(pairs), ","))


# ------------------------------------------------------------------ ground truth


@fixture
def truth(d):
    """Calls of the catalog as ground truth, one row per call site."""
    return """SELECT r.src_key AS snippet_key, coalesce(a.function_name, '') AS caller_func, coalesce(b.function_name, '') AS callee_func,
      coalesce(b.class_name, '') AS callee_class, coalesce(b.file_path, '') AS callee_file, b.key AS callee_key
      FROM kg_rels r JOIN kg_nodes a ON a.key = r.src_key JOIN kg_nodes b ON b.key = r.dst_key WHERE r.rel_type = 'CALLS'"""


@fixture
def ck_sites(d):
    return f"""SELECT upper(trim(list_last(p1))) AS caller, upper(trim(list_last(p2))) AS callee, {bare('upper(trim(list_last(p2)))')} AS cb, CASE WHEN len(p2) >= 3 THEN upper(trim(p2[2])) ELSE '' END AS callee_class,
      {nf('p2[1]')} AS callee_file FROM (SELECT string_split(caller,'::') AS p1, string_split(callee,'::') AS p2 FROM call_edges)"""


@fixture
def ck_truth(d):
    return f"""WITH u AS (SELECT * EXCLUDE (rn) FROM (SELECT *, upper(trim(callee_func)) AS callee_norm, row_number() OVER (PARTITION BY snippet_key, upper(trim(callee_func)) ORDER BY callee_key, callee_func, callee_class, callee_file) AS rn FROM truth) WHERE rn = 1),
      k AS (SELECT *, CASE WHEN upper(trim(caller_func)) IN (SELECT caller FROM ck_sites) THEN upper(trim(caller_func)) ELSE {bare('upper(trim(caller_func))')} END AS k, {bare('callee_norm')} AS eb, {nf('callee_file')} AS ef, upper(trim(callee_class)) AS ec FROM u),
      m AS (SELECT *, EXISTS (SELECT 1 FROM ck_sites s WHERE s.caller = k.k AND s.cb = k.eb) AS t3, EXISTS (SELECT 1 FROM ck_sites s WHERE s.caller = k.k AND s.cb = k.eb AND s.callee_file = k.ef AND k.ef <> '') AS t2,
        EXISTS (SELECT 1 FROM ck_sites s WHERE s.caller = k.k AND s.cb = k.eb AND s.callee_file = k.ef AND k.ef <> '' AND s.callee_class = k.ec AND k.ec <> '') AS t1 FROM k)
      SELECT snippet_key, caller_func, callee_func, callee_class, callee_file, callee_key, callee_norm,
        CASE WHEN t1 THEN 'full_match' WHEN t2 THEN 'name_file_match' WHEN t3 THEN 'name_only_match' ELSE 'none' END AS match_tier,
        CASE WHEN t1 OR t2 OR t3 THEN 'confirmed' WHEN callee_norm IN (SELECT upper(trim(function_name)) FROM code_index) OR eb IN (SELECT upper(trim(function_name)) FROM code_index) THEN 'missing_edge' ELSE 'missing_function' END AS status FROM m"""


def unique(t):
    return coverage.unique_truth(t.truth, ["callee_key", "callee_func", "callee_class", "callee_file"])


@query("join_9", "SELECT * FROM ck_truth")
def join_9(t):
    return coverage.match_truth(unique(t), coverage.stored_calls(t.call_edges), t.code_index)


@query("join_10", f"""WITH s AS (SELECT DISTINCT snippet_key, caller_func FROM truth), k AS (SELECT snippet_key, CASE WHEN upper(trim(caller_func)) IN (SELECT caller FROM ck_sites) THEN upper(trim(caller_func)) ELSE {bare('upper(trim(caller_func))')} END AS k FROM s),
   seen AS (SELECT DISTINCT snippet_key, upper(trim(callee_func)) AS n FROM truth), p AS (SELECT caller, callee, cb, count(*) AS sites FROM ck_sites GROUP BY ALL)
   SELECT k.snippet_key, p.callee, p.sites FROM k JOIN p ON p.caller = k.k WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.snippet_key = k.snippet_key AND seen.n IN (p.callee, p.cb))""")
def join_10(t):
    callers = t.truth.select("snippet_key", "caller_func").distinct()
    return coverage.extra_callees(t.truth, callers, coverage.stored_calls(t.call_edges))


@query("agg_21", """SELECT snippet_key, count(*) AS edges, count_if(status='confirmed') AS confirmed, count_if(match_tier='full_match') AS full_match, count_if(match_tier='name_file_match') AS name_file_match,
   count_if(match_tier='name_only_match') AS name_only_match, count_if(status='missing_edge') AS missing_edge, count_if(status='missing_function') AS missing_function,
   round(count_if(status='confirmed') / count(*) * 100, 6) AS coverage_pct FROM ck_truth GROUP BY ROLLUP (snippet_key)""")
def agg_21(t):
    return coverage.truth_totals(join_9(t)).withColumn("coverage_pct", F.round("coverage_pct", 6))


# ------------------------------------------------------------------ stored tables


@fixture
def definitions(d):
    return """SELECT CASE WHEN l_linenumber = 7 THEN '' ELSE fn END AS function_name, CASE WHEN l_linenumber IN (1,2) THEN '' ELSE cls END AS class_name, file_path,
      CASE WHEN l_linenumber = 3 THEN 'delphi' ELSE language END AS language, l_orderkey * 1000000 + l_linenumber * 100000 + l_suppkey AS seq FROM lineitem JOIN kg_part ON pk = l_partkey"""


@query("src_24", """SELECT fn AS function_name, file_path, arg_min(language, (seq, language, class_name)) AS language, coalesce(arg_min(class_name, (seq, language, class_name)) FILTER (class_name <> ''), '') AS class_name
   FROM (SELECT *, coalesce(nullif(function_name,''), nullif(class_name,'')) AS fn FROM definitions) WHERE fn IS NOT NULL GROUP BY 1, 2""")
def src_24(t):
    path = shared_folder(t.spark, "code-index")
    tables.replace_table(tables.build_code_index(t.definitions), path)
    return tables.read_table(t.spark, path)


@query("src_25", "SELECT caller, callee, confidence, seq FROM call_edges")
def src_25(t):
    path = shared_folder(t.spark, "call-edges")
    tables.replace_table(t.call_edges, path)
    return tables.read_table(t.spark, path)


@fixture
def cache_rows(d):
    return """SELECT md5(d.text) AS content_hash, CAST(min(l.quality) AS STRING) AS result_json, 'rules' AS model, min(d.doc_id) AS created_at
      FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY md5(d.text)"""


@query("src_26", """SELECT d.doc_id, md5(d.text) AS content_hash, c.result_json, c.content_hash IS NOT NULL AS cached FROM documents d LEFT JOIN cache_rows c ON c.content_hash = md5(d.text)""")
def src_26(t):
    items = t.documents.select("doc_id", F.md5("text").alias("content_hash"))
    return tables.split_by_cache(items, t.cache_rows, "content_hash")


@query("src_26_put", """SELECT content_hash, arg_max(result_json, (created_at, result_json)) AS result_json, max(created_at) AS created_at FROM
   (SELECT content_hash, result_json, created_at FROM cache_rows UNION ALL SELECT md5(text), lang, doc_id FROM documents) GROUP BY content_hash""")
def src_26_put(t):
    fresh = t.documents.select(F.md5("text").alias("content_hash"), F.col("lang").alias("result_json"), F.lit("rules").alias("model"), F.col("doc_id").alias("created_at"))
    return tables.put_cache(t.cache_rows, fresh, "content_hash").drop("model")


@fixture
def doc_chunks(d):
    return "SELECT md5(concat(source, '::', lang, '::', CAST(doc_id AS STRING))) AS chunk_key, md5(text) AS content_hash, text AS content, doc_id FROM documents"


@fixture
def edited_chunks(d):
    """Second version: labelled documents of low quality got an extra line."""
    return """SELECT md5(concat(source, '::', lang, '::', CAST(d.doc_id AS STRING))) AS chunk_key, md5(CASE WHEN l.quality = 0 THEN concat(text, ' v2') ELSE text END) AS content_hash,
      CASE WHEN l.quality = 0 THEN concat(text, ' v2') ELSE text END AS content, d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""


@query("src_27", "SELECT chunk_key, content_hash, doc_id FROM edited_chunks")
def src_27(t):
    changed = vectors.changed_chunks(t.edited_chunks, t.doc_chunks)
    path = shared_folder(t.spark, "chunks")
    tables.replace_table(tables.upsert(t.doc_chunks, changed, "chunk_key"), path)
    return tables.read_table(t.spark, path).select("chunk_key", "content_hash", "doc_id")


@query("sim_5", "SELECT doc_id, md5(concat(source, '::', lang, '::', doc_id, '::', n_chars)) AS chunk_key, md5(text) AS content_hash FROM documents")
def sim_5(t):
    return t.documents.select("doc_id", vectors.chunk_key("source", "lang", F.col("doc_id").cast("string"), "n_chars").alias("chunk_key"), vectors.content_hash("text").alias("content_hash"))


@query("sim_6", "SELECT e.chunk_key, e.content_hash, e.doc_id FROM edited_chunks e JOIN doc_chunks d ON d.chunk_key = e.chunk_key WHERE d.content_hash <> e.content_hash")
def sim_6(t):
    return vectors.changed_chunks(t.edited_chunks, t.doc_chunks).select("chunk_key", "content_hash", "doc_id")


@query("sim_6_counts", "SELECT count_if(d.content_hash <> e.content_hash) AS changed, count_if(d.content_hash = e.content_hash) AS unchanged FROM edited_chunks e JOIN doc_chunks d ON d.chunk_key = e.chunk_key")
def sim_6_counts(t):
    return vectors.change_counts(t.edited_chunks, t.doc_chunks)


def _lane(i):
    return f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT)::HUGEINT"


@query("sim_7", f"""SELECT lang, files, md5(concat_ws(':', files, s0, s1, s2, s3)) AS fingerprint FROM (SELECT lang, count(*) AS files, {', '.join(f'{_lane(i)} AS s{i}' for i in range(4))}
   FROM (SELECT lang, md5(concat(source, '/', doc_id, ':', n_chars)) AS h FROM documents) GROUP BY lang)""")
def sim_7(t):
    files = t.documents.select("lang", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size"))
    return vectors.fingerprint(files, ["lang"])


@query("sim_8", """SELECT doc_id, concat('language: ', lang, chr(10), 'file: ', source, chr(10), CASE WHEN doc_id % 2 = 0 THEN concat('class: ', 'C', chr(10)) ELSE '' END, 'function: ', doc_id, chr(10), chr(10), text) AS embedding_text FROM documents""")
def sim_8(t):
    chunks = t.documents.selectExpr("doc_id", "lang AS language", "source AS file_path", "CASE WHEN doc_id % 2 = 0 THEN 'C' END AS class_name", "CAST(doc_id AS STRING) AS function_name", "text AS content")
    return vectors.embedding_text(chunks).select("doc_id", "embedding_text")


@query("sim_9", "SELECT count(*) AS total_chunks FROM doc_chunks")
def sim_9(t):
    return vectors.index_status(t.doc_chunks)


@query("top_2", """SELECT e.vec_id, e.label, round(1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
   ORDER BY 1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), e.vec_id LIMIT 20""")
def top_2(t):
    vector = t.embeddings.where("vec_id = 0").first()["embedding"]
    return vectors.nearest(t.embeddings, F.array(*map(F.lit, vector)), 20).select("vec_id", "label", F.round("distance", 6).alias("distance"))


# ------------------------------------------------------------------ exports


@query("src_29", """SELECT concat(flow_key, '-', seq, '-', rf) AS snippet_key, caller AS caller_func, callee AS callee_func, callee_class, callee_file, 1 AS depth FROM pairs
   UNION ALL SELECT concat(flow_key, '-', seq, '-', rf), callee, concat('sub', x), '', '', 2 FROM pairs, (VALUES (1), (2)) v(x)
   UNION ALL SELECT concat(flow_key, '-', seq, '-', rf), 'sub1', 'leaf', '', 'f.pas', 3 FROM pairs""")
def src_29(t):
    doc = """concat('{"key":"', flow_key, '-', seq, '-', rf, '","function_name":"', caller, '","call_tree":[{"callee_function":"', callee, '","callee_class":"', callee_class, '","callee_file":"', callee_file,
      '","callees":[{"callee_function":"sub1","callees":[{"callee_function":"leaf","callee_file":"f.pas","callees":[]}]},{"callee_function":"sub2","callees":[]}]}]}') AS doc"""
    return exports.flatten_call_trees(t.pairs.selectExpr(doc), "doc").drop("caller_class", "caller_file", "position")


@query("src_30", f"SELECT key, coalesce(map_extract_value(props, 'tech'), '') AS tech, array_to_string(list_sort(map_keys(map_from_entries(list_filter(map_entries(props), lambda e: e.value IS NOT NULL)))), ',') AS present FROM kg_nodes WHERE {SCOPE}")
def src_30(t):
    props = exports.without_nulls("props")
    return g.run_nodes(t.kg_nodes, *RUN).select("key", fx.text(F.element_at("props", "tech")).alias("tech"), F.array_join(F.array_sort(F.map_keys(props)), ",").alias("present"))


@query("src_30_edges", "SELECT r.src_key, r.dst_key, a.name AS caller_name, b.name AS callee_name, r.execution_order FROM kg_rels r JOIN kg_nodes a ON a.key = r.src_key JOIN kg_nodes b ON b.key = r.dst_key WHERE r.rel_type = 'CALLS'")
def src_30_edges(t):
    path = shared_folder(t.spark, "edge-dump")
    exports.write_json(exports.edge_dump(t.kg_nodes, t.kg_rels), path)
    back = t.spark.read.schema("src_key STRING, dst_key STRING, json STRING").json(path)
    return back.select("src_key", "dst_key", F.get_json_object("json", "$.caller.name").alias("caller_name"), F.get_json_object("json", "$.callee.name").alias("callee_name"),
                       F.get_json_object("json", "$.edge.execution_order").cast("int").alias("execution_order"))


@fixture
def topic_changes(d):
    return """SELECT concat('S', CAST(user_id AS STRING)) AS node_key, 'Snippet' AS node_type, 'Snippet' AS node_label, concat('old ', CAST(event_id % 7 AS STRING)) AS old_topic, event_type AS new_topic,
      'user' AS changed_by, ts AS changed_at, concat('EF-', CAST(user_id % 9 AS STRING)) AS execution_flow_key, event_id % 13 = 0 AS is_undo, event_id AS seq FROM events"""


@query("src_31", "SELECT node_key, old_topic, new_topic, changed_by, execution_flow_key, is_undo, seq FROM topic_changes")
def src_31(t):
    path = shared_folder(t.spark, "audit-csv")
    exports.write_csv(t.topic_changes, path)
    back = t.spark.read.schema(t.topic_changes.schema).csv(path, header=True)
    return back.select("node_key", "old_topic", "new_topic", "changed_by", "execution_flow_key", "is_undo", "seq")


@query("src_31_json", "SELECT node_key, old_topic, new_topic, changed_by, execution_flow_key, is_undo, seq FROM topic_changes")
def src_31_json(t):
    path = shared_folder(t.spark, "audit-json")
    exports.write_json(t.topic_changes, path)
    back = t.spark.read.schema(t.topic_changes.schema).json(path)
    return back.select("node_key", "old_topic", "new_topic", "changed_by", "execution_flow_key", "is_undo", "seq")


@query("src_32", """SELECT flow_key, concat(CASE WHEN tier IN ('phantom','missing') THEN tier ELSE 'confirmed' END, '_edges') AS part, c AS caller, e AS callee, cf AS caller_file, ef AS callee_file, tier, round(trust_score, 6) AS score FROM verified
   UNION ALL SELECT flow_key, 'graph_a', c, e, cf, ef, NULL, NULL FROM norm_a UNION ALL SELECT flow_key, 'graph_b', c, e, cf, ef, NULL, NULL FROM norm_b
   UNION ALL SELECT DISTINCT flow_key, 'summary', NULL, NULL, NULL, NULL, NULL, NULL::DOUBLE FROM verified""")
def src_32(t):
    """Every entry of the nested records, taken out of their JSON again."""
    from kgaudit.operators import diff

    a, b = sides(t)
    verified, scores = diff.diff_flows(a, b)
    edges = a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b")))
    records = exports.flow_result_records(scores, verified, edges)
    entry = "array<struct<caller:string,callee:string,caller_file:string,callee_file:string,tier:string,trust_score:double>>"
    read = F.when(F.col("part") == "summary", F.from_json(F.lit("[{}]"), entry)).otherwise(F.from_json("json", entry))
    return records.select("flow_key", "part", F.inline(read)).withColumn("score", F.round("trust_score", 6)).drop("trust_score")


# ------------------------------------------------------------------ change log


@fixture
def topic_updates(d):
    return """SELECT event_id AS seq, concat('S', CAST(user_id AS STRING)) AS node_key, 'Snippet' AS node_label, concat('Review ', event_type) AS new_topic, ts AS changed_at,
      concat('EF-', CAST(user_id % 9 AS STRING)) AS execution_flow_key FROM events"""


@fixture
def ck_log(d):
    return """SELECT u.seq, u.node_key, coalesce(lag(u.new_topic) OVER (PARTITION BY u.node_key ORDER BY u.seq), n.topic, '') AS old_topic, u.new_topic, u.changed_at FROM topic_updates u JOIN kg_nodes n ON n.key = u.node_key AND list_contains(n.labels,'Snippet')"""


@query("chg_1", "SELECT seq, node_key, old_topic, new_topic FROM ck_log")
def chg_1(t):
    return changes.log_updates(t.kg_nodes, t.topic_updates).select("seq", "node_key", "old_topic", "new_topic")


@query("chg_1_nodes", "SELECT n.key, coalesce(l.topic, n.topic) AS topic FROM kg_nodes n LEFT JOIN (SELECT node_key, arg_max(new_topic, (changed_at, seq)) AS topic FROM ck_log GROUP BY 1) l ON l.node_key = n.key")
def chg_1_nodes(t):
    return changes.apply_log(t.kg_nodes, changes.log_updates(t.kg_nodes, t.topic_updates)).select("key", "topic")


@query("chg_2", "SELECT node_key, arg_min(old_topic, (changed_at, seq)) AS topic FROM topic_changes WHERE NOT is_undo GROUP BY node_key")
def chg_2(t):
    undone = changes.undo_all(t.topic_changes, F.lit("2030-01-01").cast("timestamp"))
    return changes.current_topics(t.topic_changes.unionByName(undone)).select("node_key", "topic").join(
        t.topic_changes.where("NOT is_undo").select("node_key").distinct(), "node_key", "left_semi")


@query("chg_2_net", "SELECT node_key, arg_min(old_topic, (changed_at, seq)) AS topic FROM topic_changes WHERE NOT is_undo GROUP BY node_key")
def chg_2_net(t):
    return changes.restored_topics(t.topic_changes)


@query("chg_3", "SELECT node_key, suggested_topic FROM (SELECT concat('S', c_custkey) AS node_key, concat('EF-', floor(c_custkey / 15)::BIGINT) AS execution_flow_key, CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE concat('Verify ', c_mktsegment) END AS suggested_topic FROM customer) WHERE trim(suggested_topic) <> '' AND execution_flow_key IN (SELECT execution_flow_key FROM topic_changes)")
def chg_3(t):
    offers = t.customer.selectExpr("concat('S', c_custkey) AS node_key", "concat('EF-', CAST(floor(c_custkey / 15) AS BIGINT)) AS execution_flow_key", "CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE concat('Verify ', c_mktsegment) END AS suggested_topic")
    return changes.select_updates(offers, t.topic_changes, on="execution_flow_key").select("node_key", "suggested_topic")


LATEST = "SELECT node_key, arg_max(new_topic, (changed_at, seq)) AS topic, max(changed_at) AS changed_at FROM topic_changes GROUP BY node_key"


@query("chg_4", LATEST)
def chg_4(t):
    return changes.current_topics(t.topic_changes)


# ------------------------------------------------------------------ streams


@query("str_1", "SELECT chunk_key, content_hash, CASE WHEN content_hash = md5(content) THEN 1 ELSE 0 END AS whole, 3 AS seq FROM edited_chunks")
def str_1(t):
    """Two versions of each chunk in one batch, and an old one that comes late."""
    spark, base = t.spark, shared_folder(t.spark, "reindex")
    at = lambda df, seq: df.drop("doc_id").withColumn("seq", F.lit(seq).cast("bigint"))
    stale = t.edited_chunks.withColumn("content", F.concat("content", F.lit(" stale"))).withColumn("content_hash", F.md5("content"))
    schema = "chunk_key STRING, content_hash STRING, content STRING, seq BIGINT"
    for version, rows in enumerate([at(t.doc_chunks, 1), at(t.edited_chunks, 3).unionByName(at(stale, 2)), at(stale, 0)], 1):
        rows.write.parquet(f"{base}/in/v{version}")
        feed = spark.readStream.schema(schema).parquet(f"{base}/in/*")
        reindex.start_reindex(feed, f"{base}/table", f"{base}/offsets").awaitTermination()
    whole = F.when(F.md5("content") == F.col("content_hash"), 1).otherwise(0).alias("whole")
    return reindex.current_index(spark, f"{base}/table").select("chunk_key", "content_hash", whole, F.col("seq").cast("int").alias("seq"))


@query("str_2", LATEST)
def str_2(t):
    spark, base = t.spark, shared_folder(t.spark, "changes")
    t.topic_changes.write.parquet(f"{base}/in")
    feed = spark.readStream.schema(t.topic_changes.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    change_log.start_state(feed, f"{base}/table", f"{base}/offsets").awaitTermination()
    return change_log.current_state(spark, f"{base}/table")
