"""Source-code queries: TXT-1..12, JOIN-11/13/15, WIN-1/2/4/5/14, AGG-22/27, SRC-20, FIL-15, GRA-14, UDF-1..4."""

from pyspark.sql import functions as F

from kgaudit.functions import profiles as pf
from kgaudit.functions import scalars as fx
from kgaudit.operators import calls as ca
from kgaudit.operators import chunking as ch
from kgaudit.operators import graph as gr
from kgaudit.operators import topics as tp
from kgaudit.operators.normalize import resolve_aliases
from kgaudit.plans.index_code import index_code
from kgaudit.session import checkpointed, shared_folder
from kgaudit.sources import files as sf
from kgaudit.workload.registry import fixture, query

Q, NL = "chr(39)", "chr(10)"
K = "CAST(o_orderkey AS STRING)"
C1 = "CAST(o_orderkey % 977 AS STRING)"
C2 = "CAST((o_orderkey * 7 + 3) % 14983 AS STRING)"
OWN = "CASE WHEN o_orderkey % 4 = 0 THEN concat('TK', CAST(o_custkey AS STRING), '.') ELSE '' END"
LINES = [
    f"'unit U', {K}, ';'",
    f"'{{ header F', {K}, ' }}'",
    "''",
    f"'procedure ', {OWN}, 'F', {K}, '(x: int);'",
    "'begin'",
    f"'  F', {C1}, '(1); // F', {C2}, '(2)'",
    f"'  s := ', {Q}, 'F', {C2}, '(9)', {Q}, ';'",
    f"'  call H', {C2}, ';'",
    "'end;'",
    "''",
    f"'TC', CAST(o_orderkey % 9 AS STRING), ' = class'",
    "'  name: string;'",
    f"'function H', {K}, ': int;'",
    "'begin'",
    f"'  F', {K}, '(3); F', {K}, '(4); F', {C2}, ' + H', {C1}, '-x'",
    "'end;'",
    "''",
]


@fixture
def code_files(d):
    """One small source file per order."""
    body = f", {NL}, ".join(LINES)
    return f"""SELECT o_orderkey AS k, o_custkey AS ck, concat('src/d', CAST(o_custkey % 50 AS STRING), '/u', {K}, '.pas') AS path, concat({body}, {NL}) AS content, 'pascal' AS language FROM orders"""


def chunks(t):
    return ch.chunk_definitions(t.code_files)


def chunk_table(t):
    """The chunks as a stored table, for queries that read them several times."""
    return checkpointed(chunks(t))


@fixture
def ck_chunks(d):
    """The expected chunks, from the file layout: four per file."""
    own = "CASE WHEN k % 4 = 0 THEN concat('TK', ck) ELSE '' END"
    lines = "string_split(content, chr(10))"

    def text(a, b):
        return f"array_to_string({lines}[{a}:{b}], chr(10))"

    def row(name, cls, a, b):
        return f"SELECT path, k, language, {name} AS function_name, {cls} AS class_name, {a} AS line_start, {b} AS line_end, {text(a, b)} AS content FROM code_files"

    rows = " UNION ALL ".join([
        row("concat('u', k)", "''", 1, 2), row("concat('F', k)", own, 4, 9),
        row("concat('TC', k % 9)", "''", 11, 12), row("concat('H', k)", "concat('TC', k % 9)", 13, 16)])
    return f"SELECT *, concat(path, '::', class_name, '::', function_name) AS chunk_id FROM ({rows})"


@query("txt_1", "SELECT path, language, function_name, class_name, line_start, line_end, content, chunk_id FROM ck_chunks")
def txt_1(t):
    return chunks(t)


@query("win_4", "SELECT path, function_name, line_start, line_end FROM ck_chunks")
def win_4(t):
    return chunks(t).select("path", "function_name", "line_start", "line_end")


@query("win_5", "SELECT class_name, count(*) AS functions FROM ck_chunks WHERE function_name LIKE 'H%' GROUP BY class_name")
def win_5(t):
    return chunks(t).where("function_name LIKE 'H%'").groupBy("class_name").agg(F.count(F.lit(1)).alias("functions"))


@query("win_1", "SELECT chunk_id, arg_min(seq, (caller_file, seq)) AS seq FROM (SELECT caller AS chunk_id, seq, string_split(caller,'::')[1] AS caller_file FROM call_edges) GROUP BY chunk_id")
def win_1(t):
    sites = t.call_edges.select(F.col("caller").alias("chunk_id"), fx.chunk_file("caller").alias("path"), F.col("seq").alias("line_start"))
    return ch.keep_first_chunks(sites).select("chunk_id", F.col("line_start").alias("seq"))


@query("win_2", "SELECT function_name, file_path, coalesce(arg_min(class_name, seq) FILTER (class_name <> ''), '') AS class_name, min(seq) AS seq FROM (SELECT function_name, file_path, min(class_name) AS class_name, seq FROM definitions GROUP BY ALL) GROUP BY function_name, file_path")
def win_2(t):
    rows = t.definitions.groupBy("function_name", "file_path", "seq").agg(F.min("class_name").alias("class_name"))
    return ch.backfilled_class(rows)


@fixture
def form_files(d):
    """One form file per customer with nested objects and event handlers."""
    ck = "CAST(c_custkey AS STRING)"
    return f"""SELECT concat('forms/f', {ck}, '.dfm') AS path, c_custkey AS k, concat('object Form', {ck}, ': TForm', CAST(c_custkey % 7 AS STRING), {NL}, '  Caption = 1', {NL}, '  OnCreate = H', {ck}, {NL}, '  object B: TButton', {NL},
      '    OnClick = H', CAST(c_custkey * 2 AS STRING), {NL}, '    OnHide = H', {ck}, {NL}, '  end', {NL}, 'end', {NL}, 'object Last: TPanel', {NL}, 'end', {NL}) AS content FROM customer"""


@query("txt_2", """SELECT path, concat('Form', k) AS function_name, concat('TForm', k % 7) AS class_name, 1 AS line_start, 8 AS line_end, CASE WHEN k = 0 THEN 'H0' ELSE concat('H', k, ',H', k * 2) END AS handlers FROM form_files
   UNION ALL SELECT path, 'Last', 'TPanel', 9, 10, '' FROM form_files""")
def txt_2(t):
    return ch.chunk_forms(t.form_files).select("path", "function_name", "class_name", "line_start", "line_end", F.array_join("event_handlers", ",").alias("handlers"))


@query("txt_3")
def txt_3(t):
    pages = t.pages.select(F.col("url").alias("path"), F.col("html").alias("content"), F.lit("html").alias("language"))
    return ch.chunk_blocks(pages).select("path", "block_type", "start", "part", "line_start", "chars", F.md5("text").alias("text_hash"))


@query("win_14", "SELECT path, len(regexp_extract_all(content, '(?im)^[ \\t]*(?:procedure|function)[ \\t]+[\\w.]+')) AS blocks FROM code_files")
def win_14(t):
    found = t.code_files.select("path", F.explode(ch.find_blocks(pf.DEFAULT_PROFILES)("content", "language")).alias("b"))
    return found.groupBy("path").agg(F.count(F.lit(1)).alias("blocks"))


CLEAN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '^[^\\n]*\\n?', chr(10)), '(?m)//.*$', '', 'g'), '\\{[\\s\\S]*?\\}', ' ', 'g'), '''[^'']*''', '''''', 'g')"


@fixture
def ck_clean(d):
    return f"SELECT *, {CLEAN} AS clean FROM ck_chunks"


@query("txt_4", "SELECT chunk_id, clean FROM ck_clean")
def txt_4(t):
    return chunks(t).select("chunk_id", ca.clean_code().alias("clean"))


@query("txt_5", r"""SELECT chunk_id, len(list_filter(regexp_extract_all(upper(clean), '[A-Z0-9_#$@\-]+'), lambda x: x = upper(function_name))) AS hits FROM ck_clean""")
def txt_5(t):
    return chunks(t).select("chunk_id", ca.times(ca.identifiers(ca.clean_code()), F.upper("function_name")).alias("hits"))


SKIP = ", ".join(f"'{s.upper()}'" for s in pf.PASCAL.skip_tokens)


@fixture
def ck_mentions(d):
    """Names per chunk by strategy; the look-ahead is a consuming group."""
    ids = r"regexp_extract_all(upper(clean), '([A-Z0-9_#$@\-]+)(\s*:)?', 1)"
    flags = r"list_transform(regexp_extract_all(upper(clean), '([A-Z0-9_#$@\-]+)(\s*:)?', 2), lambda x: coalesce(x, '') = '')"
    return rf"""WITH a AS (SELECT chunk_id, upper(function_name) AS me, regexp_extract_all(upper(clean), '\b([A-Z_]\w*)\s*\(', 1) AS p, regexp_extract_all(upper(content), '\bCALL\s+(\w+)', 1) AS kw, {ids} AS ids, {flags} AS free FROM ck_clean)
      SELECT DISTINCT chunk_id, 1 AS strategy, name FROM (SELECT chunk_id, me, p, unnest(p) AS name FROM a) WHERE name <> me OR len(list_filter(p, lambda x: x = me)) > 1
      UNION ALL SELECT DISTINCT chunk_id, 2, unnest(kw) FROM a
      UNION ALL SELECT DISTINCT chunk_id, 3, name FROM (SELECT chunk_id, me, ids, unnest(ids) AS name, unnest(free) AS ok FROM a) WHERE ok AND len(name) >= 3 AND name NOT IN ({SKIP}) AND (name <> me OR len(list_filter(ids, lambda x: x = me)) > 1)"""


FORMS = "(SELECT concat('FORM', k) AS name FROM form_files UNION SELECT 'LAST')"
KNOWN = "(SELECT DISTINCT upper(function_name) AS name FROM ck_chunks)"


@fixture
def ck_extracted(d):
    return f"""SELECT chunk_id, name AS callee, CASE min(strategy) WHEN 1 THEN 0.7 WHEN 2 THEN 0.8 ELSE 0.6 END::DOUBLE AS confidence FROM ck_mentions WHERE name IN {KNOWN} GROUP BY ALL"""


def known(t, parts):
    return ca.known_names(parts, ch.chunk_forms(t.form_files))


def extracted(t, parts):
    return ca.extract_calls(parts, known(t, parts))


@query("txt_6", "SELECT * FROM ck_extracted")
def txt_6(t):
    return extracted(t, chunk_table(t))


@query("join_15", f"SELECT chunk_id, name AS callee FROM ck_mentions WHERE strategy = 3 AND name IN {KNOWN}")
def join_15(t):
    parts = chunk_table(t)
    return ca.contained_names(parts, known(t, parts))


@fixture
def proposals(d):
    """Proposed calls of the F chunks: right, unknown, absent, repeated and unscored ones."""
    return f"""SELECT concat(path, '::', CASE WHEN k % 4 = 0 THEN concat('TK', CAST(ck AS STRING)) ELSE '' END, '::F', CAST(k AS STRING)) AS chunk_id, o_linenumber AS seq,
      CASE o_linenumber WHEN 1 THEN concat(' f', CAST(k % 977 AS STRING)) WHEN 2 THEN 'Nowhere' WHEN 3 THEN concat('H', CAST(k AS STRING)) WHEN 4 THEN concat('F', CAST(k % 977 AS STRING)) WHEN 5 THEN concat('F', CAST(k AS STRING)) ELSE concat('H', CAST((k * 7 + 3) % 14983 AS STRING)) END AS callee,
      CASE o_linenumber WHEN 1 THEN CAST(1.7 AS DOUBLE) WHEN 6 THEN NULL ELSE CAST(0.4 AS DOUBLE) END AS confidence
      FROM (SELECT c.*, l.l_linenumber AS o_linenumber FROM code_files c JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) l ON l.l_orderkey = c.k) x"""


@query("txt_7", rf"""WITH p AS (SELECT chunk_id, upper(trim(callee)) AS name, arg_min(trim(callee), seq) AS callee, arg_min(coalesce(confidence, 0.85), seq) AS confidence FROM proposals GROUP BY ALL),
   c AS (SELECT chunk_id, upper(function_name) AS me, regexp_extract_all(upper(content), '[A-Z0-9_#$@\-]+') AS ids, regexp_extract_all(upper(content), '\w+') AS w FROM ck_chunks)
   SELECT p.chunk_id, p.callee, greatest(0, least(1, p.confidence))::DOUBLE AS confidence FROM p JOIN c ON c.chunk_id = p.chunk_id
   WHERE name IN {KNOWN} AND list_contains(ids, name) AND (name <> me OR len(list_filter(w, lambda x: x = me)) > 1)""")
def txt_7(t):
    parts = chunk_table(t)
    return ca.validate_proposals(t.proposals, parts, known(t, parts))


@query("txt_8", f"""SELECT chunk_id, callee, confidence FROM ck_extracted WHERE confidence = 0.7 UNION ALL SELECT m.chunk_id, m.name, 0.55::DOUBLE FROM ck_mentions m
   WHERE m.strategy = 3 AND m.name IN {KNOWN} AND NOT EXISTS (SELECT 1 FROM ck_extracted e WHERE e.confidence = 0.7 AND e.chunk_id = m.chunk_id AND e.callee = m.name)""")
def txt_8(t):
    parts = chunk_table(t)
    return ca.supplemented_calls(ca.known_mentions(parts, known(t, parts)))


@query("txt_9", r"""WITH c AS (SELECT chunk_id, upper(function_name) AS me, regexp_extract_all(upper(content), '(\w+)\s*\(', 1) AS p, regexp_extract_all(upper(content), '\w+') AS w FROM ck_chunks),
   n AS (SELECT e.*, greatest(len(list_filter(p, lambda x: x = e.callee)) - (e.callee = me)::INT, 0) AS pc, greatest(len(list_filter(w, lambda x: x = e.callee)) - (e.callee = me)::INT, 1) AS bc FROM ck_extracted e JOIN c ON c.chunk_id = e.chunk_id)
   SELECT chunk_id, callee, confidence, unnest(range(1, CASE WHEN pc = 0 THEN bc ELSE pc END + 1)) AS site FROM n""")
def txt_9(t):
    parts = chunk_table(t)
    return ca.expand_sites(extracted(t, parts), parts)


@query("txt_10", r"""SELECT chunk_id, string_agg(DISTINCT name, ',' ORDER BY name) AS callees FROM (SELECT chunk_id, unnest(list_concat(list_concat(regexp_extract_all(content, '\b([A-Za-z_]\w*)\s*\(', 1), regexp_extract_all(content, 'from\s+([A-Za-z_]\w*)\s+import', 1)), regexp_extract_all(content, 'import\s+([A-Za-z_]\w*)', 1))) AS name FROM ck_chunks) WHERE len(name) > 1 GROUP BY chunk_id""")
def txt_10(t):
    names = chunks(t).select("chunk_id", ca.simple_callees(F.col("content"), F.col("language")).alias("n"))
    return names.where("size(n) > 0").select("chunk_id", F.array_join(F.array_sort("n"), ",").alias("callees"))


@fixture
def py_files(d):
    """Python and brace files for function finding, one per customer."""
    ck = "CAST(c_custkey AS STRING)"
    return f"""SELECT c_custkey AS k, concat('app/c', {ck}, CASE WHEN c_custkey % 2 = 0 THEN '.py' ELSE '.go' END) AS path, CASE WHEN c_custkey % 2 = 0 THEN
      concat('import os', {NL}, 'def run(a):', {NL}, '    x = 1', {NL}, {NL}, '    if x:', {NL}, '        go(x)', {NL}, '# note', {NL}, '    return x', {NL}, 'def tail():', {NL}, '    pass')
      ELSE concat('package p', {NL}, 'func run(a int) {{', {NL}, '  if a {{ b() }} else {{', {NL}, '    c()', {NL}, '  }}', {NL}, '}}', {NL}, 'func tail() {{ x() }}') END AS content FROM customer"""


@query("txt_11", "SELECT path, 2 AS line_number, CASE WHEN path LIKE '%.py' THEN 'def run(a):' ELSE 'func run(a int) {' END AS match FROM py_files")
def txt_11(t):
    return ca.find_function(t.py_files, "run")


@query("txt_12", """SELECT path, 'run' AS function_name, 2 AS line_start, CASE WHEN path LIKE '%.py' THEN 8 ELSE 6 END AS line_end, array_to_string(string_split(content, chr(10))[2:CASE WHEN path LIKE '%.py' THEN 8 ELSE 6 END], chr(10)) AS body FROM py_files
   UNION ALL SELECT path, 'tail', CASE WHEN path LIKE '%.py' THEN 9 ELSE 7 END, CASE WHEN path LIKE '%.py' THEN 10 ELSE 7 END, array_to_string(string_split(content, chr(10))[CASE WHEN path LIKE '%.py' THEN 9 ELSE 7 END:10], chr(10)) FROM py_files""")
def txt_12(t):
    wanted = t.py_files.select("path", F.explode(F.array(F.lit("run"), F.lit("tail"), F.lit("none"))).alias("function_name"))
    return ca.function_bodies(t.py_files, wanted)


# ------------------------------------------------------------------ resolution


@fixture
def candidates(d):
    return "SELECT concat(file_path, '::', class_name, '::', function_name) AS chunk_id, file_path AS path, function_name, seq FROM code_index"


@fixture
def open_calls(d):
    return "SELECT DISTINCT callee, CASE WHEN ln = 1 THEN upper(caller_file) WHEN ln = 2 THEN concat('lib/', caller_file) ELSE caller_file END AS caller_file FROM pairs"


@query("join_11", """WITH c AS (SELECT *, upper(function_name) AS n, string_split(upper(path),'/') AS parts, regexp_replace(regexp_replace(upper(path),'^.*/',''),'[.][^.]*$','') AS stem FROM candidates),
   w AS (SELECT callee, caller_file, upper(callee) AS n, string_split(upper(caller_file),'/') AS parts, regexp_replace(regexp_replace(upper(caller_file),'^.*/',''),'[.][^.]*$','') AS stem FROM open_calls)
   SELECT w.callee, w.caller_file, arg_min(c.chunk_id, (-(c.path = w.caller_file OR upper(c.path) = upper(w.caller_file))::INT,
      -(CASE WHEN c.parts[1] <> w.parts[1] THEN 0 WHEN c.parts[2] <> w.parts[2] THEN 1 WHEN c.parts[3] <> w.parts[3] THEN 2 ELSE 3 END), -(c.stem = w.stem)::INT, c.seq)) AS callee_chunk
   FROM w JOIN c ON c.n = w.n GROUP BY w.callee, w.caller_file""")
def join_11(t):
    return ca.resolve_callees(t.open_calls, t.candidates)


@query("join_13", """SELECT concat(f.path, '::TForm', f.k % 7, '::Form', f.k) AS caller, concat('src/d', h.ck % 50, '/u', h.k, '.pas::TC', h.k % 9, '::H', h.k) AS callee, 0.9::DOUBLE AS confidence
   FROM (SELECT path, k, unnest(CASE WHEN k = 0 THEN [0] ELSE [k, k * 2] END) AS hk FROM form_files) f JOIN code_files h ON h.k = f.hk""")
def join_13(t):
    code = chunks(t).select("chunk_id", "path", "function_name", F.col("line_start").alias("seq"))
    return ca.handler_edges(ch.chunk_forms(t.form_files), code)


@query("gra_14", r"""WITH RECURSIVE c AS (SELECT path, function_name, upper(function_name) AS n, upper(path) AS up, content FROM ck_chunks),
   f AS (SELECT n, min(path) AS path FROM (SELECT upper(function_name) AS n, path FROM ck_chunks UNION ALL SELECT upper(concat(class_name,'.',function_name)), path FROM ck_chunks WHERE class_name <> '') GROUP BY n),
   s AS (SELECT DISTINCT c.n, c.up, x.callee, upper(x.callee) AS cn, f.path AS cpath FROM (SELECT n, up, unnest(regexp_extract_all(content, '\b([A-Za-z_]\w*)\s*\(', 1)) AS callee FROM c) x JOIN c ON c.n = x.n AND c.up = x.up LEFT JOIN f ON f.n = upper(x.callee)),
   v(flow_key, n, path, depth) USING KEY (flow_key, n, path) AS (SELECT concat('F', r_regionkey), concat('H', r_regionkey), cf.path, 0 FROM region JOIN code_files cf ON cf.k = r_regionkey
     UNION SELECT DISTINCT v.flow_key, s.cn, s.cpath, v.depth + 1 FROM v JOIN s ON s.n = v.n AND s.up = upper(v.path) LEFT JOIN recurring.v r ON r.flow_key = v.flow_key AND r.n = s.cn AND r.path = s.cpath
       WHERE s.cpath IS NOT NULL AND s.cn <> s.n AND r.n IS NULL)
   SELECT flow_key, n AS node, path, depth FROM v""")
def gra_14(t):
    parts = chunk_table(t)
    index = parts.select("function_name", F.col("path").alias("file_path"), "class_name", "line_start")
    sites = checkpointed(gr.located_sites(ca.fresh_sites(parts), index))
    starts = t.region.join(t.code_files, F.col("r_regionkey") == F.col("k")).selectExpr("concat('F', r_regionkey) AS flow_key", "concat('H', r_regionkey) AS start", "path AS start_file", "'' AS prefix")
    edges = gr.traverse(starts, sites)
    seeds = starts.select("flow_key", F.col("start").alias("node"), F.col("start_file").alias("path"), F.lit(0).alias("depth"))
    reached = edges.where("resolved AND upper(callee) <> caller").select("flow_key", F.upper("callee").alias("node"), F.col("callee_file").alias("path"), "depth")
    return seeds.unionByName(reached).groupBy("flow_key", "node", "path").agg(F.min("depth").alias("depth"))


# ------------------------------------------------------------------ scan and reports


@query("src_20", "SELECT 'folder' AS top, sum(strlen(text) + 1)::BIGINT AS bytes, sum(strlen(text) + 1)::BIGINT AS decoded, count(*) AS lines FROM documents")
def src_20(t):
    """Documents written as source files; a scan leaves out one folder and other extensions."""
    root = shared_folder(t.spark, "tree")
    docs = t.documents.select(F.regexp_replace("text", "\r|\n", " ").alias("text"))
    docs.write.format("text").save(f"{root}/folder/plain")
    docs.write.json(f"{root}/folder/other")
    docs.write.format("text").save(f"{root}/node_modules/skipped")
    found = sf.scan_sources(t.spark, root, [".txt"])
    lines = F.sum(F.size(F.split("content", "\n")) - 1).cast("bigint").alias("lines")
    return found.groupBy(F.substring_index("path", "/", 1).alias("top")).agg(F.sum("size").alias("bytes"), F.sum(F.octet_length("content")).cast("bigint").alias("decoded"), lines)


# Source text of one routine in each language: {f} calls {g} of its own file, which calls {h} of another row.
ROUTINES = {
    "py": "def {f}(x):\n    # not_called({h})\n    return {g}(x)\n\n\ndef {g}(x):\n    return {h}(x)",
    "js": "function {f}(x) {{\n  return {g}(x); // {f}2(x)\n}}\nconst {g} = (x) => {{\n  return {h}(x);\n}};",
    "go": "func {f}(x int) int {{\n\treturn {g}(x)\n}}\nfunc (t *Table) {g}(x int) int {{\n\treturn {h}(x)\n}}",
    "cs": "  public static int {f}(int x)\n  {{\n    return {g}(x); /* {h}(x) */\n  }}\n  private int {g}(int x)\n  {{\n    return {h}(x);\n  }}",
    "kt": "fun {f}(x: Int): Int {{\n  return {g}(x)\n}}\nprivate fun Table.{g}(x: Int): Int {{\n  return {h}(x)\n}}",
    "pas": "function {f}(x: integer): integer;\nbegin\n  result := {g}(x); {{ {h}(x) }}\nend;\nfunction TTable.{g}(x: integer): integer;\nbegin\n  result := {h}(x);\nend;",
    "cob": "       {f} SECTION.\n           PERFORM {g}\n           EXIT SECTION.\n       {g} SECTION.\n           PERFORM {h}\n           EXIT SECTION.",
    "rpg": "dcl-proc {f};\n  exsr {g};\nend-proc;\nbegsr {g};\n  exsr {h};\nendsr;",
}
OWNED = "CASE WHEN k % 8 IN (2, 4, 5) AND part = 'g' THEN CASE WHEN k % 8 = 5 THEN 'TTable' ELSE 'Table' END ELSE '' END"


def scanned_tree(t):
    """A tree of source files of eight languages, written, scanned and indexed."""
    root, rows = shared_folder(t.spark, "sources"), t.part.select(F.col("p_partkey").alias("k"))
    for n, (extension, routine) in enumerate(ROUTINES.items()):
        text = F.lit(routine.replace("{{", "\x01").replace("}}", "\x02"))
        for name, value in (("f", F.concat(F.lit("fa"), F.col("k"))), ("g", F.concat(F.lit("ga"), F.col("k"))), ("h", F.concat(F.lit("fa"), F.col("k") + 1))):
            text = F.replace(text, F.lit("{" + name + "}"), value)
        text = F.translate(text, "\x01\x02", "{}")
        lines = rows.where(F.col("k") % len(ROUTINES) == n).select("k", F.posexplode(F.split(text, "\n")).alias("at", "line")).repartition(4, "k").sortWithinPartitions("k", "at")
        plain = {"extension": extension, "sep": "\x01", "quote": "", "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        # A larger tree has more files: none holds more than a thousand routines, cut between two of them.
        lines.select("line").write.options(maxRecordsPerFile=1000 * (routine.count("\n") + 1), **plain).csv(f"{root}/app/{extension}")
    files = sf.scan_sources(t.spark, root)
    return index_code(files, shared_folder(t.spark, "index"))


@query("src_20_index", f"""SELECT concat(part, 'a', k) AS function_name, {OWNED} AS class_name, ['python', 'javascript', 'go', 'csharp', 'kotlin', 'delphi', 'cobol', 'rpg'][k % 8 + 1] AS language
   FROM (SELECT p_partkey AS k, unnest(['f', 'g']) AS part FROM part)""")
def src_20_index(t):
    """UDF-1: functions of all eight languages, with the class that a receiver names."""
    return scanned_tree(t)["chunks"].where("function_name RLIKE '^[fg]a[0-9]+$'").select("function_name", "class_name", "language")


@query("src_20_calls", """SELECT upper(concat('fa', p_partkey)) AS caller, upper(concat('ga', p_partkey)) AS callee FROM part
   UNION ALL SELECT upper(concat('ga', p_partkey)), upper(concat('fa', p_partkey + 1)) FROM part WHERE p_partkey + 1 IN (SELECT p_partkey FROM part)""")
def src_20_calls(t):
    """Calls found in the scanned tree, none of them from comments or strings."""
    edges = scanned_tree(t)["call_edges"]
    last = lambda c: F.upper(F.element_at(F.split(c, "::"), -1)).alias(c)
    return edges.select(last("caller"), last("callee")).where("caller RLIKE '^[FG]A[0-9]+$'")


@query("fil_15", """SELECT 'Red_bolt' AS function_name, file_path, class_name, 1 AS line_start, 2 AS line_end, concat('procedure ', function_name) AS content, CAST(NULL AS VARCHAR) AS error FROM code_index WHERE upper(function_name) = 'RED_BOLT' ORDER BY file_path, class_name LIMIT 3""")
def fil_15(t):
    texts = t.code_index.selectExpr("file_path AS path", "function_name", "class_name", "1 AS line_start", "2 AS line_end", "concat('procedure ', function_name) AS content")
    return ch.function_chunks(t.code_index, texts, "Red_bolt", matches=3, size=3000)


@query("agg_22", "SELECT count(DISTINCT path) AS files, count(*) AS chunks, count(*) AS functions, (SELECT count(*) FROM ck_extracted) AS edges FROM ck_chunks")
def agg_22(t):
    parts = chunk_table(t)
    return ch.index_stats(parts, extracted(t, parts))


@query("agg_27", "SELECT 'definitions' AS method, count(*) AS chunks, floor(avg(len(content)))::BIGINT AS mean_chars FROM ck_chunks UNION ALL SELECT 'files', count(*), floor(avg(len(content)))::BIGINT FROM code_files")
def agg_27(t):
    both = chunks(t).select(F.lit("definitions").alias("method"), F.length("content").alias("chars")).unionByName(
        t.code_files.select(F.lit("files").alias("method"), F.length("content").alias("chars")))
    return ch.compare_chunkers(both)


# ------------------------------------------------------------------ extension points


@query("udf_1", "SELECT count(*) AS chunks, count_if(function_name LIKE 'H%') AS functions FROM (SELECT * FROM ck_chunks WHERE function_name LIKE 'H%' UNION ALL SELECT * FROM ck_chunks WHERE line_start = 1)")
def udf_1(t):
    table = t.spark.createDataFrame([("pascal", [r"^function[ \t]+(?P<name>\w+)", "(", "no_name_group"], "implementation")], "language STRING, function_patterns ARRAY<STRING>, implementation_keyword STRING")
    found = ch.chunk_definitions(t.code_files, pf.from_table(table))
    return found.agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("function_name").like("H%")).alias("functions"))


@query("udf_2", "SELECT path, len(regexp_extract_all(html, '<article\\b[^>]*>')) + len(regexp_extract_all(html, '<nav\\b[^>]*>')) >= 0 AS scanned FROM (SELECT url AS path, html FROM pages)")
def udf_2(t):
    ch.register_udtf(t.spark)
    # One row per page: pages may share a url, have no block or no text.
    blocks = t.spark.sql("SELECT p.page_id, b.start FROM {pages} p JOIN LATERAL code_blocks(p.html, 'html') b", pages=t.pages)
    found = blocks.groupBy("page_id").agg(F.count("start").alias("n"))
    scanned = F.when(F.col("html").isNotNull(), F.coalesce("n", F.lit(0)) >= 0)
    return t.pages.join(found, "page_id", "left").select(F.col("url").alias("path"), scanned.alias("scanned"))


@query("udf_3", "SELECT p_partkey, round(1 - levenshtein(p_name, lower(p_type)) / greatest(len(p_name), len(p_type), 1), 6) AS ratio FROM part")
def udf_3(t):
    return t.part.select("p_partkey", F.round(tp.edit_ratio(F.col("p_name"), F.lower("p_type")), 6).alias("ratio"))


@query("udf_4", "SELECT p_partkey AS pk, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE upper(concat('q_', p_name)) END AS name FROM part")
def udf_4(t):
    names = t.part.selectExpr("p_partkey AS pk", "CASE WHEN p_partkey % 2 = 0 THEN concat('a_', p_name) ELSE concat('q_', p_name) END AS name")
    return resolve_aliases(names, "name", t.aliases)
