"""Inventory, roadmap, parity, verdict and report queries: TXT-17..22/24..27, JOIN-17..19, AGG-5/15/16/18..20/24..26, QR-18..20/28..31, WIN-11/12, FIL-16, GRA-15."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from kgaudit.functions import scalars as fx
from kgaudit.operators import diff
from kgaudit.operators import inventory as inv
from kgaudit.operators import roadmap as rm
from kgaudit.operators import verdicts as vd
from kgaudit.session import checkpointed
from kgaudit.workload.q_flow import sides
from kgaudit.workload.registry import fixture, query

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

FOLDERS = "src Views data API common lib.d Service".split()
STEMS = "order Manager webpack user-list a.test a storage".split()
EXTS = ".cs .cshtml .ts .pas .designer.cs .config .Form.cs".split()


def _pick(values, expr):
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


@fixture
def app_files(d):
    """Application paths, one per order, with a line count."""
    return f"""SELECT o_orderkey AS k, concat({_pick(FOLDERS, 'o_custkey % 7')}, '/m', CAST(o_custkey % 40 AS STRING), '/', {_pick(STEMS, 'o_orderkey % 7')}, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey % 11 AS STRING) ELSE '' END,
      {_pick(EXTS, 'o_orderkey % 49 - o_orderkey % 7 + 0').replace('CASE o_orderkey % 49 - o_orderkey % 7 + 0', 'CASE CAST(floor(o_orderkey % 49 / 7) AS INT)')}) AS path, CAST(floor(o_totalprice / 300) AS INT) AS loc FROM orders"""


@fixture
def file_sizes(d):
    return "SELECT path, max(loc) AS loc FROM app_files GROUP BY path"


@fixture
def app_index(d):
    return """SELECT concat(CASE l.l_linenumber WHEN 1 THEN 'Get' WHEN 2 THEN 'do' ELSE 'X.' END, CAST(l.l_suppkey AS STRING), CASE WHEN l.l_linenumber = 4 THEN 'List' ELSE 'Item' END) AS function_name, f.path AS file_path,
      CASE WHEN l.l_linenumber = 5 THEN '' ELSE 'csharp' END AS language, '' AS class_name, l.l_orderkey * 1000000 + l.l_linenumber * 100000 + l.l_suppkey AS seq FROM lineitem l JOIN app_files f ON f.k = l.l_orderkey"""


def _in(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@fixture
def ck_layers(d):
    """Check-side layer rules over the distinct paths."""
    def name(x):
        return f"CASE WHEN {x} IN {_in(inv.DATA_NAMES)} THEN 'data_access' WHEN {x} IN {_in(inv.BUSINESS_NAMES)} THEN 'business_logic' WHEN {x} IN {_in(inv.CONFIG_NAMES)} THEN 'configuration' END"

    def has(v):
        return f"list_has_any(p, {_list(v)})"

    views = " OR ".join(f"ends_with(lo, '{s}')" for s in inv.VIEW_SUFFIXES)
    every = inv.DATA_NAMES + inv.BUSINESS_NAMES + inv.CONFIG_NAMES
    return f"""WITH a AS (SELECT DISTINCT path, lower(path) AS lo, string_split(lower(path), '/') AS p, regexp_replace(regexp_replace(lower(path), '^.*/', ''), '(.)[.][^.]*$', '\\1') AS stem, regexp_extract(lower(path), '[.][^./]*$') AS ext FROM app_files),
      b AS (SELECT *, coalesce(CASE WHEN p[1] IN {_in(inv.DATA_NAMES)} OR stem IN {_in(inv.DATA_NAMES)} THEN 'data_access' WHEN p[1] IN {_in(inv.BUSINESS_NAMES)} OR stem IN {_in(inv.BUSINESS_NAMES)} THEN 'business_logic' WHEN p[1] IN {_in(inv.CONFIG_NAMES)} OR stem IN {_in(inv.CONFIG_NAMES)} THEN 'configuration' END,
          {name(f"list_filter(p[2:], lambda x: x IN {_in(every)})[1]")},
          CASE WHEN {has(inv.PRESENTATION_FOLDERS)} THEN 'presentation' WHEN {has(inv.BUSINESS_FOLDERS)} THEN 'business_logic' WHEN {has(inv.DATA_FOLDERS)} THEN 'data_access' WHEN {has(inv.SHARED_FOLDERS)} THEN 'shared' END) AS bp FROM a)
      SELECT path, CASE WHEN ext IN {_in(inv.PRESENTATION_EXTENSIONS)} THEN 'presentation' WHEN ends_with(lo, '.cs') THEN CASE WHEN {views} OR {has(inv.PRESENTATION_FOLDERS)} THEN 'presentation' ELSE coalesce({name('stem')}, CASE WHEN {has(inv.DATA_FOLDERS)} THEN 'data_access' WHEN {has(inv.BUSINESS_FOLDERS)} THEN 'business_logic' WHEN {has(inv.SHARED_FOLDERS)} THEN 'shared' ELSE 'business_logic' END) END
        ELSE coalesce(bp, 'unknown') END AS layer, CASE WHEN ext IN {_in(inv.PRESENTATION_EXTENSIONS)} THEN 0.9 WHEN ends_with(lo, '.cs') THEN 0.7 WHEN bp IS NOT NULL THEN 0.75 ELSE 0.3 END::DOUBLE AS confidence FROM b"""


def layers(t):
    return t.app_files.select("path").distinct().select("path", inv.classify_layer("path").alias("c")).select("path", "c.layer", "c.confidence")


@query("txt_18", "SELECT * FROM ck_layers")
def txt_18(t):
    return layers(t)


@query("agg_16", "SELECT layer, count(*) AS files FROM ck_layers GROUP BY layer")
def agg_16(t):
    return layers(t).groupBy("layer").agg(F.count(F.lit(1)).alias("files"))


@query("txt_17", "SELECT k, CASE WHEN loc > 1000 OR k % 30 > 20 THEN 'very_high' WHEN loc > 500 OR k % 30 > 10 THEN 'high' WHEN loc > 150 OR k % 30 > 5 THEN 'medium' ELSE 'low' END AS complexity FROM app_files")
def txt_17(t):
    return t.app_files.select("k", inv.complexity("loc", F.col("k") % 30).alias("complexity"))


REL = "regexp_replace({x}, '^.*/', '')"


@fixture
def ck_related(d):
    return """WITH f AS (SELECT DISTINCT path, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_replace(path, '^.*/', '') AS nm, regexp_replace(regexp_replace(path, '^.*/', ''), '(.)[.][^.]*$', '\\1') AS stem FROM app_files)
      SELECT a.path, b.path AS related FROM f a JOIN f b ON a.dir = b.dir AND a.path <> b.path AND (b.stem = a.stem OR starts_with(b.stem, a.stem || '.') OR starts_with(b.path, a.path || '.'))"""


@query("join_19", "SELECT * FROM ck_related")
def join_19(t):
    return inv.related_files(t.app_files)


@query("gra_15", "SELECT path AS caller, related AS callee FROM ck_related")
def gra_15(t):
    return inv.related_files(t.app_files).select(F.col("path").alias("caller"), F.col("related").alias("callee"))


@fixture
def ck_inventory(d):
    return f"""WITH f AS (SELECT file_path AS path, count(*) AS n, max(nullif(language,'')) AS language FROM app_index GROUP BY 1), r AS (SELECT path, count(*) AS related FROM (SELECT * FROM ck_related WHERE path IN (SELECT path FROM f) AND related IN (SELECT path FROM f)) GROUP BY path)
      SELECT f.path, regexp_extract(lower(f.path), '[.][^./]*$') AS file_type, coalesce(f.language,'') AS language, l.layer, s.loc, f.n AS function_count,
        CASE WHEN s.loc > 1000 OR f.n > 20 THEN 'very_high' WHEN s.loc > 500 OR f.n > 10 THEN 'high' WHEN s.loc > 150 OR f.n > 5 THEN 'medium' ELSE 'low' END AS complexity,
        regexp_extract(lower(f.path), '[.][^./]*$') IN {_in(inv.MARKUP_EXTENSIONS)} AS has_ui_markup, concat(f.path,'.cs') IN (SELECT path FROM file_sizes) OR concat(f.path,'.vb') IN (SELECT path FROM file_sizes) AS has_code_behind, coalesce(r.related, 0) AS related,
        CASE layer WHEN 'presentation' THEN 'frontend' WHEN 'shared' THEN 'shared' ELSE 'backend' END AS side
      FROM f JOIN file_sizes s ON s.path = f.path JOIN ck_layers l ON l.path = f.path LEFT JOIN r ON r.path = f.path"""


def inventory(t):
    return inv.file_inventory(t.app_index, t.file_sizes, layers(t))


@query("txt_19", "SELECT * FROM ck_inventory")
def txt_19(t):
    return inventory(t)


@query("txt_20", f"SELECT concat(file_path, '::', function_name) AS endpoint FROM app_index WHERE regexp_matches(lower(function_name), '^({'|'.join(inv.ENDPOINT_WORDS)})|({'|'.join(inv.ENDPOINT_WORDS)})$') AND file_path IN (SELECT path FROM ck_inventory WHERE side = 'backend')")
def txt_20(t):
    return inv.api_endpoints(t.app_index, inventory(t))


STEM = "regexp_replace(regexp_replace(path, '^.*/', ''), '(.)[.][^.]*$', '\\1')"


@query("txt_21", f"SELECT DISTINCT path, array_to_string(list_transform(string_split(replace({STEM}, '-', '_'), '_'), lambda w: upper(w[1]) || lower(w[2:])), '') AS name FROM app_files")
def txt_21(t):
    return t.app_files.select("path").distinct().select("path", inv.component_name("path").alias("name"))


@query("fil_16", "SELECT i.function_name, i.file_path, i.class_name, l.layer FROM app_index i JOIN ck_layers l ON l.path = i.file_path WHERE l.layer IN ('business_logic','data_access','shared')")
def fil_16(t):
    return inv.layer_items(t.app_index, layers(t))


@fixture
def app_edges(d):
    return """SELECT CASE WHEN a.k % 50 = 0 THEN a.path ELSE concat(a.path, '::C::f') END AS caller, concat(b.path, '::C::g') AS callee FROM lineitem l JOIN app_files a ON a.k = l.l_orderkey JOIN app_files b ON b.k = l.l_partkey"""


@query("join_17", """WITH e AS (SELECT caller, callee, CASE WHEN contains(caller,'::') THEN string_split(caller,'::')[1] ELSE '' END AS f1, string_split(callee,'::')[1] AS f2 FROM app_edges)
   SELECT coalesce(a.layer,'unknown') AS caller_layer, coalesce(b.layer,'unknown') AS callee_layer, count(*) AS edges FROM e LEFT JOIN ck_layers a ON a.path = f1 LEFT JOIN ck_layers b ON b.path = f2 GROUP BY ALL""")
def join_17(t):
    return inv.edge_layers(t.app_edges, layers(t)).groupBy("caller_layer", "callee_layer").agg(F.count(F.lit(1)).alias("edges"))


@query("agg_15", """SELECT a.layer AS caller_layer, b.layer AS callee_layer, count(*) AS edges FROM app_edges e JOIN ck_layers a ON contains(e.caller,'::') AND a.path = string_split(e.caller,'::')[1] JOIN ck_layers b ON b.path = string_split(e.callee,'::')[1]
   WHERE a.layer <> b.layer AND a.layer <> 'unknown' AND b.layer <> 'unknown' GROUP BY ALL ORDER BY edges DESC, 1, 2 LIMIT 10""")
def agg_15(t):
    return inv.layer_coupling(inv.edge_layers(t.app_edges, layers(t)), 10)


# ------------------------------------------------------------------ parsing


@fixture
def new_sources(d):
    """New code with declarations, one file per part."""
    pk = "CAST(p_partkey AS STRING)"
    return f"""SELECT concat('web/n', {pk}, CASE WHEN p_partkey % 5 = 0 THEN '.md' ELSE '.ts' END) AS path, concat('import x', chr(10), '  export async function get', replace(p_name, ' ', ''), {pk}, '(a: int) {{', chr(10), 'class ', upper(substr(p_name, 1, 1)), replace(substr(p_name, 2), ' ', ''), 'Service<T> extends B', chr(10), 'const no = 1', chr(10), 'public static int ', p_type, '_', {pk}, ': y', chr(10), 'def a1') AS content FROM part"""


@query("txt_22", """WITH n AS (SELECT path, content, string_split(content, chr(10)) AS l FROM new_sources WHERE path LIKE '%.ts')
   SELECT upper(regexp_extract(trim(l[2]), 'function ([^(]*)', 1)) AS name, path FROM n UNION ALL SELECT upper(regexp_extract(l[3], 'class ([^<]*)', 1)), path FROM n UNION ALL SELECT upper(regexp_extract(l[5], 'int ([^:]*)', 1)), path FROM n""")
def txt_22(t):
    return inv.declared_names(t.new_sources)


@fixture
def replies(d):
    return """SELECT event_id AS key, concat('intro', chr(10), 'COMPONENT: Page', CAST(user_id AS STRING), ' | TYPE: Modal | SOURCES: a.cs, b', CAST(event_id AS STRING), '.cs,, | PROPS:', chr(10), 'TEST: t', CAST(event_id AS STRING), ' | category: ', event_type, ' | FUNCTION: f | FILE: x:y', chr(10), ' LEGACY: g | STATUS: Partial | NEW_FILE: n.ts | NOTES: ok') AS text FROM events"""


@query("txt_24", """SELECT event_id AS key, concat('Page', user_id) AS component_name, 'modal' AS component_type, concat('a.cs|b', event_id, '.cs') AS source_files, '' AS props, 'medium' AS reuse FROM events""")
def txt_24(t):
    return inv.parse_components(t.replies).withColumns({"source_files": F.array_join("source_files", "|"), "props": F.array_join("props", "|")})


@query("txt_24_tests", "SELECT event_id AS key, concat('t', event_id) AS test_name, 'functional' AS category, 'f' AS source_function, 'x:y' AS source_file, '' AS expected_behavior FROM events")
def txt_24_tests(t):
    return inv.parse_test_specs(t.replies, ["functional", "sanity", "integration", "unit"])


@query("txt_24_matches", "SELECT event_id AS key, 'g' AS legacy, 'partial' AS status, 'n.ts' AS new_file, 'ok' AS notes FROM events")
def txt_24_matches(t):
    return inv.parse_matches(t.replies)


@query("agg_25", "SELECT CASE event_id % 4 WHEN 0 THEN 'unit' WHEN 1 THEN 'sanity' WHEN 2 THEN 'functional' ELSE 'integration' END AS category, count(*) AS tests FROM events GROUP BY 1")
def agg_25(t):
    kind = F.element_at(F.array(*map(F.lit, ["Unit", "sanity", "odd", "Integration"])), (F.col("key") % 4 + 1).cast("int"))
    own = t.replies.withColumn("text", F.regexp_replace("text", r"category: \w+", F.concat(F.lit("category: "), kind)))
    return inv.spec_counts(inv.parse_test_specs(own, ["functional", "sanity", "integration", "unit"]))


@query("txt_25", """SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL ELSE props END AS json FROM events""")
def txt_25(t):
    text = F.expr("""CASE event_id % 5 WHEN 0 THEN concat('  ', props, ' ') WHEN 1 THEN concat('Here:\\n```json\\n', props, '\\n```\\ndone') WHEN 2 THEN concat('```\\n', props, '\\n```') WHEN 3 THEN concat('so ', props, ' end') ELSE concat('none ', substring(props, 2)) END""")
    return t.events.select("event_id", inv.salvage_json(text).alias("json"))


@query("txt_26", f"SELECT conv_id, turn, 1 AS n, trim(concat('x = ', turn), {WS}) AS code FROM conversations WHERE turn % 2 = 0 UNION ALL SELECT conv_id, turn, 2, 'y' FROM conversations WHERE turn % 2 = 0 UNION ALL SELECT conv_id, turn, 1, trim(text, {WS}) FROM conversations WHERE turn % 2 = 1")
def txt_26(t):
    text = F.expr("CASE WHEN turn % 2 = 0 THEN concat('a ```py\\nx = ', turn, '\\n``` b ```\\ny\\n``` c') ELSE text END")
    return t.conversations.select("conv_id", "turn", F.posexplode(inv.code_blocks(text)).alias("p", "code")).select("conv_id", "turn", (F.col("p") + 1).alias("n"), "code")


@query("txt_27", """WITH w AS (SELECT concat('C', p_partkey % 300) AS component, p_partkey AS position, concat('web/n', p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '.md' WHEN p_partkey % 7 = 0 THEN '.gone' ELSE '.ts' END) AS path FROM part),
   h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY position, path) AS rn FROM w) WHERE rn <= 5)
   SELECT component, string_agg(concat('=== ', h.path, ' ===', chr(10), coalesce(s.content, '(file not readable)')), chr(10) || chr(10) ORDER BY rn) AS bundle FROM h LEFT JOIN new_sources s ON s.path = h.path GROUP BY component""")
def txt_27(t):
    wanted = t.part.selectExpr("concat('C', p_partkey % 300) AS component", "p_partkey AS position", "concat('web/n', p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '.md' WHEN p_partkey % 7 = 0 THEN '.gone' ELSE '.ts' END) AS path")
    return inv.source_bundle(wanted, t.new_sources, 5, 8000)


@fixture
def test_log(d):
    return """SELECT user_id AS run, CASE event_id % 4 WHEN 0 THEN concat('  ', CAST(event_id % 50 AS STRING), ' Tests Passed') WHEN 1 THEN concat('suite: ', CAST(event_id % 9 AS STRING), ' failing now') WHEN 2 THEN 'test error' ELSE concat(CAST(event_id % 7 AS STRING), ' passing, 2 failed') END AS line FROM events"""


@query("agg_24", """SELECT run, sum(p + f)::BIGINT AS total, sum(p)::BIGINT AS passed, sum(f)::BIGINT AS failed FROM (SELECT user_id AS run, CASE event_id % 4 WHEN 0 THEN event_id % 50 WHEN 3 THEN event_id % 7 ELSE 0 END AS p, CASE event_id % 4 WHEN 1 THEN event_id % 9 ELSE 0 END AS f FROM events) GROUP BY run""")
def agg_24(t):
    return inv.test_output_totals(t.test_log)


@query("agg_26", """SELECT file_path, string_agg(function_name, ', ' ORDER BY rn) AS functions, any_value(greatest(n - 10, 0)) AS more FROM (SELECT file_path, function_name, row_number() OVER (PARTITION BY file_path ORDER BY seq, function_name) AS rn, count(*) OVER (PARTITION BY file_path) AS n FROM app_index) WHERE rn <= 10 GROUP BY file_path""")
def agg_26(t):
    return inv.functions_per_file(t.app_index, 10)


# ------------------------------------------------------------------ roadmap and parity


@fixture
def components(d):
    return "SELECT concat('Page', CAST(floor(k / 4) AS STRING)) AS component_name, CASE WHEN k % 10 = 9 THEN NULL ELSE path END AS path FROM app_files".replace("CAST(floor(k / 4) AS STRING)", "CAST(CAST(floor(k / 4) AS BIGINT) AS STRING)")


HOURS = "CASE {c} WHEN 'low' THEN 2 WHEN 'medium' THEN 6 WHEN 'high' THEN 16 WHEN 'very_high' THEN 40 ELSE 6 END"


@fixture
def ck_items(d):
    return f"""SELECT component_name AS name, n AS files, least(CASE WHEN n = 0 THEN 4 ELSE n * {HOURS.format(c='c')} END, 80)::DOUBLE AS hours, 'frontend' AS kind FROM (SELECT component_name, count(c.path) AS n, arg_min(i.complexity, i.path) AS c FROM components c LEFT JOIN ck_inventory i ON i.path = c.path GROUP BY component_name)
      UNION ALL SELECT concat('Backend: ', path), 1, {HOURS.format(c='complexity')}::DOUBLE, CASE WHEN contains(lower(path), 'shared') OR contains(lower(path), 'common') THEN 'foundation' ELSE 'backend' END FROM ck_inventory WHERE side = 'backend'"""


def items(t):
    stock = inventory(t)
    return rm.component_items(t.components, stock), rm.backend_items(stock)


@query("qr_28", "SELECT name, files, hours, kind FROM ck_items")
def qr_28(t):
    front, back = items(t)
    return front.unionByName(back).select("name", "files", "hours", "kind")


@query("qr_28_dependencies", """WITH s AS (SELECT DISTINCT component_name AS name, path FROM components WHERE path IS NOT NULL), d AS (SELECT DISTINCT s.name, r.related AS path FROM s JOIN ck_related r ON r.path = s.path WHERE (s.name, r.related) NOT IN (SELECT (name, path) FROM s))
   SELECT name, path AS dependency FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY path) AS rn FROM d) WHERE rn <= 10""")
def qr_28_dependencies(t):
    sources = t.components.where("path IS NOT NULL").select(F.col("component_name").alias("name"), "path").distinct()
    return rm.item_dependencies(sources, inv.related_files(t.app_files), 10)


BATCHED = """(SELECT *, floor((row_number() OVER (ORDER BY substr(name, 5)::BIGINT, name) - 1) / greatest(floor(count(*) OVER () / 3), 1))::BIGINT + 1 AS batch FROM ck_items WHERE kind = 'frontend')"""


def batched(t, front):
    return rm.batches(front.withColumn("seq", F.substring(F.col("name"), F.lit(5), F.lit(20)).cast("bigint")), "seq", ["name"])


@query("win_11", f"SELECT name, batch FROM {BATCHED}")
def win_11(t):
    return batched(t, items(t)[0]).select("name", "batch")


PHASES = f"""(WITH s AS (SELECT CASE kind WHEN 'foundation' THEN 0 ELSE 1 END AS slot, hours FROM ck_items WHERE kind <> 'frontend' UNION ALL SELECT batch + 1, hours FROM {BATCHED}), g AS (SELECT slot, count(*) AS items, sum(hours) AS hours FROM s GROUP BY slot),
   l AS (SELECT *, CASE slot WHEN 0 THEN 'foundation' WHEN 1 THEN 'backend' ELSE concat('frontend ', slot - 1) END AS name FROM g UNION ALL SELECT 1000000, 0, greatest(sum(hours) * 0.15, 8), 'integration' FROM g)
   SELECT row_number() OVER (ORDER BY slot) AS phase, name, items, hours FROM l)"""


@query("qr_29", f"SELECT phase, name, items, round(hours, 4)::DOUBLE AS hours FROM {PHASES}")
def qr_29(t):
    front, back = items(t)
    return rm.phases(back, batched(t, front)).withColumn("hours", F.round("hours", 4))


@query("win_12", f"SELECT phase, name, sum(items) OVER (ORDER BY phase)::BIGINT AS items_so_far FROM {PHASES}")
def win_12(t):
    so_far = F.sum("items").over(Window.orderBy("phase"))
    return qr_29(t).select("phase", "name", so_far.alias("items_so_far"))


@query("agg_19", f"SELECT count(*) AS phases, sum(items)::BIGINT AS items, round(sum(hours), 4)::DOUBLE AS total_hours FROM {PHASES}")
def agg_19(t):
    return rm.roadmap_totals(qr_29(t)).withColumn("total_hours", F.round("total_hours", 4))


@query("agg_20", """SELECT 'high_complexity' AS risk, count(*) AS amount FROM ck_inventory WHERE complexity IN ('high','very_high') HAVING count(*) > 10 UNION ALL SELECT 'unknown_layer', count(*) FROM ck_inventory WHERE layer = 'unknown' HAVING count(*) > 0
   UNION ALL SELECT 'large_code_base', sum(loc)::BIGINT FROM ck_inventory HAVING sum(loc) > 100000""")
def agg_20(t):
    stock = inventory(t)
    return rm.risks(stock, inv.api_endpoints(t.app_index, stock))


@fixture
def legacy_items(d):
    return """SELECT p_partkey AS pk, CASE p_partkey % 5 WHEN 0 THEN concat('get', replace(p_name, ' ', ''), CAST(p_partkey + 1 AS STRING)) WHEN 1 THEN concat(upper(substr(p_name, 1, 1)), replace(substr(p_name, 2), ' ', '')) WHEN 2 THEN concat('T.', p_type, '_', CAST(p_partkey AS STRING)) WHEN 3 THEN concat('old', replace(p_name, ' ', ''), 'Service') ELSE concat('zz', CAST(p_partkey AS STRING)) END AS function_name, p_brand AS file_path FROM part"""


@fixture
def ck_declared(d):
    return """SELECT upper(regexp_extract(trim(l[2]), 'function ([^(]*)', 1)) AS name, path FROM (SELECT path, string_split(content, chr(10)) AS l FROM new_sources WHERE path LIKE '%.ts')
      UNION ALL SELECT upper(regexp_extract(l[3], 'class ([^<]*)', 1)), path FROM (SELECT path, string_split(content, chr(10)) AS l FROM new_sources WHERE path LIKE '%.ts')
      UNION ALL SELECT upper(regexp_extract(l[5], 'int ([^:]*)', 1)), path FROM (SELECT path, string_split(content, chr(10)) AS l FROM new_sources WHERE path LIKE '%.ts')"""


@fixture
def ck_parity(d):
    tails = " ".join(f"WHEN k.name = n.name || '{s}' THEN {i + 1}" for i, s in enumerate(rm.NAME_SUFFIXES))
    return f"""WITH i AS (SELECT *, upper(function_name) AS f1, regexp_replace(upper(function_name), '^.*[.]', '') AS f2 FROM legacy_items), names AS (SELECT f1 AS name FROM i UNION SELECT f2 FROM i), keys AS (SELECT DISTINCT name FROM ck_declared),
      m AS (SELECT n.name, arg_min(k.name, (CASE WHEN k.name = n.name THEN 0 {tails} WHEN contains(k.name, n.name) THEN 100 ELSE 100000 - len(k.name) END, k.name)) AS hit FROM names n JOIN keys k ON contains(k.name, n.name) OR contains(n.name, k.name) GROUP BY n.name),
      fl AS (SELECT name, min(path) AS new_file, count(*) AS places FROM ck_declared GROUP BY name)
      SELECT i.pk, i.function_name, i.file_path, CASE WHEN coalesce(a.hit, b.hit) IS NULL THEN 'missing' ELSE 'migrated' END AS status, coalesce(fl.new_file, '') AS new_file, coalesce(fl.places, 0) AS places
      FROM i LEFT JOIN m a ON a.name = f1 LEFT JOIN m b ON b.name = f2 LEFT JOIN fl ON fl.name = coalesce(a.hit, b.hit)"""


def parity(t):
    return rm.check_parity(t.legacy_items, inv.declared_names(t.new_sources))


@query("join_18", "SELECT * FROM ck_parity")
def join_18(t):
    return parity(t)


@fixture
def parity_verdicts(d):
    return """SELECT function_name AS legacy, CASE pk % 3 WHEN 0 THEN 'partial' WHEN 1 THEN 'unclear' ELSE 'missing' END AS status, '' AS new_file FROM legacy_items WHERE pk % 5 = 0"""


@query("agg_18", """WITH v AS (SELECT legacy, max(status) AS s FROM parity_verdicts WHERE status IN ('migrated', 'partial', 'missing', 'not_applicable') GROUP BY legacy),
   p AS (SELECT coalesce(v.s, k.status) AS status FROM ck_parity k LEFT JOIN v ON v.legacy = k.function_name)
   SELECT count(*) AS total, count_if(status='migrated') AS migrated, count_if(status='partial') AS partial, count_if(status='missing') AS missing, round(count_if(status='migrated') / count(*) * 100, 6) AS coverage_pct FROM p""")
def agg_18(t):
    return rm.parity_summary(rm.apply_verdicts(parity(t), t.parity_verdicts)).withColumn("coverage_pct", F.round("coverage_pct", 6))


@query("qr_30", f"""SELECT concat('test_', regexp_replace(regexp_replace(path, '^.*/', ''), '(.)[.][^.]*$', '\\1'), '_sanity') AS test_name, '' AS source_function, path AS source_file, 'sanity' AS category FROM (SELECT path FROM ck_inventory WHERE side='backend' ORDER BY path LIMIT 20)
   UNION ALL SELECT concat('test_', component_name, '_renders'), component_name, '', 'sanity' FROM (SELECT DISTINCT component_name FROM components ORDER BY 1 LIMIT 20)""")
def qr_30(t):
    return inv.fallback_specs(inventory(t), t.components.select("component_name").distinct(), 20)


# ------------------------------------------------------------------ verdicts and reports


@fixture
def verdict_files(d):
    """Files that some snippets point to; every third snippet's file is absent."""
    return """SELECT key AS snippet_key, concat('v/', key, '.pas') AS path, concat('unit u;', chr(10), 'x', chr(10), CASE WHEN start_line_number % 3 = 0 THEN concat(chr(10), 'procedure ', coalesce(function_name, ''), ';') ELSE 'empty' END, chr(10), 'end') AS content
      FROM kg_nodes WHERE type IN ('ROOT', 'CHILD') AND start_line_number % 4 <> 3"""


@fixture
def verdict_snippets(d):
    return """SELECT key, coalesce(function_name, '') AS function_name, coalesce(class_name, '') AS class_name, concat('v/', key, '.pas') AS file_path, CASE WHEN start_line_number % 5 = 0 THEN '' ELSE snippet END AS snippet,
      CASE WHEN start_line_number % 2 = 0 THEN 1 ELSE start_line_number END AS start_line_number, CASE WHEN start_line_number % 2 = 0 THEN 4 ELSE end_line_number END AS end_line_number FROM kg_nodes WHERE type IN ('ROOT', 'CHILD')"""


@fixture
def ck_nodes_verdict(d):
    return """WITH x AS (SELECT s.*, f.content IS NOT NULL AS in_file, coalesce(contains(f.content, s.function_name), false) AS named,
        coalesce(start_line_number > 0 AND end_line_number > 0 AND contains(array_to_string(string_split(f.content, chr(10))[start_line_number:end_line_number], chr(10)), s.function_name), false) AS in_range,
        trim(coalesce(s.snippet,'')) <> '' AS stored, CASE WHEN s.class_name = '' THEN EXISTS (SELECT 1 FROM code_index c WHERE c.function_name = s.function_name) ELSE EXISTS (SELECT 1 FROM code_index c WHERE c.function_name = s.function_name AND c.class_name = s.class_name) END AS indexed
        FROM verdict_snippets s LEFT JOIN verdict_files f ON f.path = s.file_path)
      SELECT key, CASE WHEN in_file AND named THEN 'valid' WHEN in_file AND stored THEN 'drifted' WHEN in_file THEN 'missing' WHEN stored THEN 'valid' WHEN indexed THEN 'drifted' ELSE 'missing' END AS verdict,
        CASE WHEN in_file AND named AND in_range THEN 0.95 WHEN in_file AND named THEN 0.85 WHEN in_file AND stored THEN 0.7 WHEN in_file THEN 0.85 WHEN stored THEN 0.75 WHEN indexed THEN 0.6 ELSE 0.9 END::DOUBLE AS confidence FROM x"""


def node_table(t):
    return vd.node_verdicts(t.verdict_snippets, t.verdict_files, t.code_index)


@query("qr_18", "SELECT * FROM ck_nodes_verdict")
def qr_18(t):
    return node_table(t)


@fixture
def ck_code(d):
    return """SELECT s.key, CASE WHEN coalesce(s.snippet,'') <> '' THEN s.snippet WHEN start_line_number > 0 AND end_line_number > 0 THEN array_to_string(string_split(f.content, chr(10))[start_line_number:end_line_number], chr(10)) END AS code FROM verdict_snippets s LEFT JOIN verdict_files f ON f.path = s.file_path"""


@query("qr_20", "SELECT * FROM ck_code")
def qr_20(t):
    return vd.snippet_code(t.verdict_snippets, t.verdict_files)


@fixture
def external_edges(d):
    return "SELECT src_key AS caller_key, dst_key AS callee_key, CASE WHEN min(global_execution_order) % 3 = 0 THEN 'contradicted' ELSE 'confirmed' END AS verdict, CAST(0.9 AS DOUBLE) AS confidence FROM kg_rels WHERE rel_type = 'CALLS' AND global_execution_order IS NOT NULL GROUP BY src_key, dst_key"


@fixture
def snippet_calls(d):
    return "SELECT src_key AS caller_key, dst_key AS callee_key, CAST(count(*) AS BIGINT) AS sites FROM kg_rels WHERE rel_type = 'CALLS' GROUP BY src_key, dst_key"


@fixture
def ck_edge_verdicts(d):
    return """SELECT e.caller_key, e.callee_key, e.sites, CASE WHEN coalesce(n.verdict,'missing') = 'missing' OR b.key IS NULL OR coalesce(c.code,'') = '' THEN 'unconfirmed' WHEN NOT contains(c.code, b.function_name) THEN 'contradicted' ELSE coalesce(x.verdict,'unconfirmed') END AS verdict,
      CASE WHEN coalesce(n.verdict,'missing') = 'missing' OR b.key IS NULL OR coalesce(c.code,'') = '' THEN 0 WHEN NOT contains(c.code, b.function_name) THEN 0.85 ELSE coalesce(x.confidence, 0) END::DOUBLE AS confidence
      FROM snippet_calls e LEFT JOIN ck_nodes_verdict n ON n.key = e.caller_key LEFT JOIN verdict_snippets b ON b.key = e.callee_key LEFT JOIN ck_code c ON c.key = e.caller_key LEFT JOIN external_edges x ON x.caller_key = e.caller_key AND x.callee_key = e.callee_key"""


def edge_table(t):
    return vd.edge_verdicts(t.snippet_calls, t.verdict_snippets, node_table(t), vd.snippet_code(t.verdict_snippets, t.verdict_files), t.external_edges)


@query("qr_19", "SELECT * FROM ck_edge_verdicts")
def qr_19(t):
    return edge_table(t)


FLOW_OF = "concat('EF-', CAST(CAST(floor(CAST(substr({k}, 2) AS BIGINT) / 15) AS BIGINT) AS STRING))"


@query("agg_5", f"""WITH m AS (SELECT {FLOW_OF.format(k='key')} AS flow_key, concat('node_', verdict) AS v FROM ck_nodes_verdict UNION ALL SELECT {FLOW_OF.format(k='caller_key')}, concat('edge_', verdict) FROM ck_edge_verdicts)
   SELECT flow_key, count_if(v LIKE 'node%') AS nodes, count_if(v LIKE 'edge%') AS edges, {', '.join(f"count_if(v = '{k}') AS {k}" for k in ['node_valid', 'node_drifted', 'node_missing', 'edge_confirmed', 'edge_unconfirmed', 'edge_contradicted'])} FROM m GROUP BY ROLLUP (flow_key)""")
def agg_5(t):
    nodes = node_table(t).selectExpr(f"{FLOW_OF.format(k='key')} AS flow_key", "verdict")
    edges = edge_table(t).selectExpr(f"{FLOW_OF.format(k='caller_key')} AS flow_key", "verdict")
    return vd.verdict_summary(nodes, edges)


@query("qr_31", """WITH r AS (SELECT flow_key, CASE WHEN tier IN ('phantom','missing') THEN tier ELSE 'confirmed' END AS section, c AS caller, e AS callee, tier, trust_score FROM verified
     UNION ALL SELECT flow_key, 'gap', caller, callee, 'gap', trust_score FROM ck_gaps),
   k AS (SELECT *, row_number() OVER (PARTITION BY flow_key, section ORDER BY caller, callee, tier, trust_score DESC) AS position, count(*) OVER (PARTITION BY flow_key, section) AS n FROM r)
   SELECT flow_key, section, caller, callee, tier, position, greatest(n - CASE WHEN section IN ('confirmed','gap') THEN 30 ELSE 20 END, 0) AS more FROM k WHERE position <= CASE WHEN section IN ('confirmed','gap') THEN 30 ELSE 20 END""")
def qr_31(t):
    a, b = sides(t)
    shown = {"confirmed": 30, "phantom": 20, "missing": 20, "gap": 30}
    keys = diff.stored_keys(a, b)
    report = vd.flow_report_heads(checkpointed(diff.diff_edges(a, b, keys)), diff.first_gaps(a, b, t.call_edges, shown["gap"], keys), shown)
    return report.select("flow_key", "section", "caller", "callee", "tier", "position", "more")
