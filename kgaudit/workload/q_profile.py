"""Corpus profile queries: TXT-13..16, TXT-23, FIL-7, FIL-9, AGG-11..14, TOP-1/3..7."""

from pyspark.sql import functions as F

from kgaudit.functions import fixed
from kgaudit.functions import scalars as fx
from kgaudit.operators import edge_audit, profile
from kgaudit.workload.registry import fixture, query

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@fixture
def doc_files(d):
    return """SELECT concat(source, '/', CASE WHEN doc_id % 9 = 0 THEN 'readme' ELSE concat('doc', CAST(doc_id AS STRING)) END,
      CASE WHEN doc_id % 9 = 0 THEN '' WHEN lang = 'en' THEN '.py' WHEN lang = 'de' THEN '.PAS' WHEN lang = 'fr' THEN '.json' ELSE '.xyz' END) AS path, text AS content, n_chars AS size, lang, doc_id FROM documents"""


@fixture
def ck_loc(d):
    return f"""SELECT *, len(list_filter(string_split_regex(content, '\\r?\\n'), lambda x: trim(x, {WS}) <> '')) AS loc, lower(regexp_extract(regexp_replace(path,'^.*/',''), '.(\\.[^.]*)$', 1)) AS ext FROM doc_files"""


def with_loc(t):
    return t.doc_files.withColumns({"loc": profile.loc("content"), "ext": fx.extension("path")})


@query("txt_16", "SELECT doc_id, len(l) - (l[-1] = '')::INT AS lines, loc FROM (SELECT doc_id, loc, string_split_regex(content, '\\r?\\n') AS l FROM ck_loc)")
def txt_16(t):
    return t.doc_files.select("doc_id", profile.line_count("content").alias("lines"), profile.loc("content").alias("loc"))


LANGS = "CASE ext " + " ".join(f"WHEN '{e}' THEN '{v}'" for e, v in fixed.EXTENSION_LANGUAGES.items()) + " END"


@query("txt_13", f"SELECT doc_id, {LANGS} AS language, CASE WHEN ext IN ('.py','.pas') THEN 'known' WHEN ext = '.json' OR ext = '' THEN 'skipped' ELSE 'unknown' END AS kind FROM ck_loc")
def txt_13(t):
    return t.doc_files.select("doc_id", profile.language_of("path").alias("language"), profile.file_kind("path").alias("kind"))


@fixture
def legacy_files(d):
    """Extensionless sources of four old languages made from line items."""
    return """SELECT concat('m', CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING)) AS path, concat(CASE l_linenumber % 4 WHEN 0 THEN 'define data local' WHEN 1 THEN 'IDENTIFICATION DIVISION.' WHEN 2 THEN 'dcl-proc x' ELSE 'table file y' END, ' ',
      CASE l_suppkey % 3 WHEN 0 THEN 'perform work' WHEN 1 THEN 'evaluate z move a' ELSE 'end-proc callnat' END) AS content FROM lineitem"""


def _hits(lang):
    return " + ".join(f"contains(upper(content), '{s}')::INT" for s in fixed.LANGUAGE_SIGNATURES[lang])


VOTES = " UNION ALL ".join(f"SELECT '{lang}' AS language, {_hits(lang)} AS hits FROM legacy_files" for lang in fixed.LANGUAGE_SIGNATURES)


@query("txt_14", f"SELECT language, sum(hits)::BIGINT AS votes, count(*) AS files FROM ({VOTES}) WHERE hits >= 2 GROUP BY language")
def txt_14(t):
    return profile.language_votes(t.legacy_files)


@query("txt_14_winner", f"SELECT language, sum(hits)::BIGINT AS votes, count(*) AS files FROM ({VOTES}) WHERE hits >= 2 GROUP BY language ORDER BY 2 DESC, 1 LIMIT 1")
def txt_14_winner(t):
    return profile.winning_language(profile.language_votes(t.legacy_files))


KEYWORDS, PATTERNS = ["the", "of"], [r"^\s*the\s+\w+", r"\bof\s+t\w*"]


@fixture
def ck_flags(d):
    return """SELECT doc_id, path, line_number, line, regexp_matches(concat(line, chr(10)), '(?i)(?:^|\\s)(?:the|of)\\s') AS keyword_hit, regexp_matches(line, '(?i)^\\s*the\\s+\\w+') OR regexp_matches(line, '(?i)\\bof\\s+t\\w*') AS pattern_hit
      FROM (SELECT doc_id, path, unnest(l) AS line, generate_subscripts(l, 1) AS line_number FROM (SELECT doc_id, path, string_split_regex(content, '\\r?\\n') AS l FROM doc_files))"""


@query("txt_15", "SELECT count_if(keyword_hit) AS keyword_lines, count_if(pattern_hit) AS pattern_lines, round(least(count_if(pattern_hit) / count_if(keyword_hit), 1), 6)::DOUBLE AS coverage FROM ck_flags")
def txt_15(t):
    flags = profile.pattern_flags(profile.file_lines(t.doc_files), KEYWORDS, PATTERNS)
    return profile.pattern_coverage(flags).withColumn("coverage", F.round("coverage", 6))


@query("txt_15_missed", f"SELECT path, line_number, trim(line, {WS}) AS line FROM ck_flags WHERE keyword_hit AND NOT pattern_hit AND trim(line, {WS}) <> ''")
def txt_15_missed(t):
    return profile.missed_lines(profile.pattern_flags(profile.file_lines(t.doc_files), KEYWORDS, PATTERNS))


@query("fil_7", f"SELECT path, line_number, trim(line, {WS}) AS line FROM ck_flags WHERE contains(lower(line), 'license')")
def fil_7(t):
    return profile.search_text(t.doc_files, "License")


@query("fil_9", """WITH r AS (SELECT doc_id, path, 2 + doc_id % 3 AS a, 4 + doc_id % 5 AS b FROM doc_files)
   SELECT r.doc_id, r.path, r.a AS start, r.b AS "end", f.line_number, f.line FROM r JOIN ck_flags f ON f.doc_id = r.doc_id WHERE f.line_number BETWEEN greatest(1, r.a - 1) AND r.b + 1 AND r.path NOT LIKE '%readme'""")
def fil_9(t):
    named = t.doc_files.where("path NOT LIKE '%readme'")
    ranges = named.selectExpr("doc_id", "path", "2 + doc_id % 3 AS start", "4 + doc_id % 5 AS end")
    return profile.slice_lines(named, ranges, buffer=1)


@query("agg_12", "SELECT ext, files, loc, round(loc / sum(loc) OVER (), 6) AS share FROM (SELECT ext, count(*) AS files, sum(loc)::BIGINT AS loc FROM ck_loc WHERE ext <> '' GROUP BY ext)")
def agg_12(t):
    return profile.loc_by_extension(with_loc(t)).withColumn("share", F.round("share", 6))


DBNAME = " OR ".join(f"contains(upper(function_name), '{k.upper()}')" for k in fixed.DB_NAME_PARTS)


@fixture
def db_index(d):
    return "SELECT CASE WHEN seq % 10 = 0 THEN concat('Execute', function_name) WHEN seq % 10 = 1 THEN concat('x_select_', function_name) ELSE function_name END AS function_name, file_path, class_name, language FROM code_index"


@query("agg_11", f"SELECT count(DISTINCT file_path) AS files, count(*) AS functions, count(DISTINCT nullif(class_name,'')) AS classes, count(DISTINCT CASE WHEN {DBNAME} THEN file_path END) AS db_files FROM db_index")
def agg_11(t):
    return profile.tear_sheet(t.db_index)


@query("agg_11_languages", "SELECT language, count(*) AS functions FROM definitions GROUP BY language")
def agg_11_languages(t):
    return profile.language_counts(t.definitions)


@query("txt_23", f"SELECT function_name, file_path, ({DBNAME}) AS db FROM db_index")
def txt_23(t):
    return t.db_index.select("function_name", "file_path", profile.is_db_name("function_name").alias("db"))


@query("agg_13", "SELECT function_name AS value, count(*) AS n FROM code_index GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, value LIMIT 10")
def agg_13(t):
    return profile.duplicate_names(t.code_index, "function_name", 10)


@query("agg_14", "SELECT count(DISTINCT CASE WHEN rel_type='PARTICIPATES_IN_FLOW' THEN src_key END) AS snippets, count(DISTINCT CASE WHEN rel_type='PARTICIPATES_IN_FLOW' THEN dst_key END) AS flows, count_if(rel_type='CALLS') AS calls FROM kg_rels")
def agg_14(t):
    member = F.col("rel_type") == "PARTICIPATES_IN_FLOW"
    return t.kg_rels.agg(F.count_distinct(F.when(member, F.col("src_key"))).alias("snippets"), F.count_distinct(F.when(member, F.col("dst_key"))).alias("flows"), F.count_if(F.col("rel_type") == "CALLS").alias("calls"))


@query("top_1", "SELECT 'callee' AS side, * FROM (SELECT callee AS value, count(*) AS n FROM call_edges GROUP BY 1 ORDER BY n DESC, value LIMIT 5) UNION ALL SELECT 'caller', * FROM (SELECT caller AS value, count(*) AS n FROM call_edges GROUP BY 1 ORDER BY n DESC, value LIMIT 5)")
def top_1(t):
    out = [profile.top_values(t.call_edges, c, 5).select(F.lit(c).alias("side"), "value", "n") for c in ("callee", "caller")]
    return out[0].unionByName(out[1])


@query("top_3", "SELECT bucket, k_caller_file, k_caller, k_callee, k_callee_file FROM ck_audit WHERE bucket IN ('missing','phantom')")
def top_3(t):
    from kgaudit.workload.q_sources import catalog_keyed, stored_keyed

    audit = edge_audit.audit_edges(catalog_keyed(t), stored_keyed(t)).where("bucket IN ('missing', 'phantom')")
    rank = F.when(F.col("bucket") == "missing", 0).otherwise(1)
    return audit.orderBy(rank, "k_caller_file", "k_caller", "k_callee", "k_callee_file")


@query("top_4", """SELECT flow_key, caller, callee, seq, position, more FROM (SELECT flow_key, caller, callee, seq, row_number() OVER (PARTITION BY flow_key ORDER BY caller, callee, seq, caller_file, callee_file) AS position,
   greatest(count(*) OVER (PARTITION BY flow_key) - 20, 0) AS more FROM edges_a) WHERE position <= 20""")
def top_4(t):
    return profile.head_with_more(t.edges_a, ["flow_key"], ["caller", "callee", "seq", "caller_file", "callee_file"], 20).select("flow_key", "caller", "callee", "seq", "position", "more")


@query("top_5", """WITH p AS (SELECT lang, path, row_number() OVER (PARTITION BY lang ORDER BY size, path) AS pos, count(*) OVER (PARTITION BY lang) AS n FROM (SELECT lang, path, max(size) AS size FROM doc_files GROUP BY ALL)),
   r AS (SELECT lang, path, CASE WHEN pos = 1 THEN 0 WHEN pos = n THEN 1 WHEN n > 2 AND pos = floor(n / 2) + 1 THEN 2 ELSE 3 END AS role FROM p)
   SELECT lang, path, role FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY role, md5(path)) AS rn FROM r) WHERE rn <= 8""")
def top_5(t):
    files = t.doc_files.groupBy("lang", "path").agg(F.max("size").alias("size"))
    return profile.sample_files(files, "lang", 8)


@query("top_6", "SELECT path, loc FROM ck_loc ORDER BY loc DESC, path LIMIT 15")
def top_6(t):
    return profile.largest_files(with_loc(t), 15)


@query("top_7", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS rn FROM (SELECT DISTINCT n_regionkey, n_name FROM nation)) WHERE rn <= 10 GROUP BY n_regionkey")
def top_7(t):
    head = profile.head_with_more(t.nation.select("n_regionkey", "n_name").distinct(), ["n_regionkey"], ["n_name"], 10)
    return head.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))
