"""Topic queries: SIM-1..4, JOIN-14, QR-21..25, AGG-10, AGG-23, FIL-11."""

from pyspark.sql import functions as F

from kgaudit.operators import graph as gr
from kgaudit.operators import topics as tp
from kgaudit.session import checkpointed
from kgaudit.sources import graph as g
from kgaudit.workload.q_sources import RUN, snippets
from kgaudit.workload.registry import fixture, query


@fixture
def part_topics(d):
    return "SELECT concat('P', CAST(p_partkey AS STRING)) AS node_key, CASE WHEN p_partkey % 3 = 0 THEN concat(' ', upper(p_name)) ELSE p_name END AS topic, p_brand AS business_summary FROM part"


@fixture
def ck_keys(d):
    return "SELECT node_key, lower(trim(topic)) AS k FROM part_topics"


@query("sim_1", "SELECT k AS topic_key, node_key, count(*) OVER (PARTITION BY k) AS size FROM ck_keys QUALIFY size > 1")
def sim_1(t):
    return tp.duplicate_members(t.part_topics)


PAIRS = """(SELECT a.k AS topic_a, b.k AS topic_b, 1 - levenshtein(a.k, b.k) / greatest(len(a.k), len(b.k)) AS ratio FROM (SELECT DISTINCT k FROM ck_keys) a JOIN (SELECT DISTINCT k FROM ck_keys) b ON a.k < b.k)"""


@query("join_14", f"SELECT topic_a, topic_b, round(ratio, 6) AS ratio FROM {PAIRS} WHERE ratio >= 0.7")
def join_14(t):
    return tp.similar_topics(t.part_topics, 0.7).withColumn("ratio", F.round("ratio", 6))


@query("join_14_lower", f"SELECT topic_a, topic_b, round(ratio, 6) AS ratio FROM {PAIRS} WHERE ratio >= 0.7")
def join_14_lower(t):
    """The same join at a lower threshold, where single characters are the grams."""
    return tp.similar_topics(t.part_topics, 0.7).withColumn("ratio", F.round("ratio", 6))


@query("sim_2", f"""WITH p AS (SELECT topic_a, topic_b FROM {PAIRS} WHERE ratio >= 0.85)
   SELECT topic_a, topic_b, list_sort(list(node_key)) AS node_keys FROM p JOIN ck_keys ON k = topic_a OR k = topic_b GROUP BY ALL""")
def sim_2(t):
    """One group per pair, with the nodes of both topics."""
    pairs = tp.similar_topics(t.part_topics).select("topic_a", "topic_b", F.explode(F.array("topic_a", "topic_b")).alias("topic_key"))
    members = pairs.join(tp.with_topic_key(t.part_topics).select("topic_key", "node_key"), "topic_key")
    return members.groupBy("topic_a", "topic_b").agg(F.array_sort(F.collect_list("node_key")).alias("node_keys"))


@query("sim_3", f"""WITH p AS (SELECT * FROM {PAIRS} WHERE ratio >= 0.85), e AS (SELECT topic_a AS k, topic_a, topic_b FROM p UNION ALL SELECT topic_b, topic_a, topic_b FROM p),
   l AS (SELECT k, max((topic_a, topic_b)) AS pair FROM e GROUP BY k), n AS (SELECT k, count(*) AS c FROM ck_keys GROUP BY k)
   SELECT x.node_key, CASE WHEN l.k IS NOT NULL THEN 'similar' ELSE 'duplicate' END AS kind, CASE WHEN l.k IS NOT NULL THEN concat('sim_', md5(concat(l.pair[1], chr(10), l.pair[2]))) ELSE concat('dup_', md5(x.k)) END AS group_id
   FROM ck_keys x JOIN n ON n.k = x.k LEFT JOIN l ON l.k = x.k WHERE n.c > 1 OR l.k IS NOT NULL""")
def sim_3(t):
    pairs = tp.similar_topics(t.part_topics)
    return tp.node_groups(t.part_topics, tp.topic_groups(t.part_topics, pairs))


@query("sim_4", """WITH s AS (SELECT p_partkey, lower(p_name) AS a, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE lower(concat(p_name, ' ', lower(p_type))) END AS b FROM part),
   l AS (SELECT *, greatest(len(a), len(b), 1) AS n FROM s)
   SELECT p_partkey, CASE WHEN b <> '' THEN ((200 * (n - levenshtein(a, b)) + n) // (2 * n)) / 100 END AS similarity FROM l""")
def sim_4(t):
    rows = t.part.selectExpr("p_partkey", "p_name AS current", "CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat(p_name, ' ', lower(p_type)) END AS suggested")
    return rows.select("p_partkey", tp.suggestion_similarity(F.col("current"), F.col("suggested")).alias("similarity"))


GLUE = ", ".join(f"'{w}'" for w in tp.GLUE_WORDS)
VERBS = ", ".join(f"'{w}'" for w in tp.APPROVED_VERBS)
WORDS = "string_split_regex(lower(trim({c})), '\\s+')"


@fixture
def ck_rules(d):
    w = WORDS.format(c="topic")
    return f"""SELECT node_key, CASE WHEN trim(coalesce(topic,'')) = '' THEN ['topic_missing'] ELSE list_filter([CASE WHEN list_has_any({w}, [{GLUE}]) THEN 'technical_glue' END, CASE WHEN {w}[1] NOT IN ({VERBS}) THEN 'verb_noun' END], lambda x: x IS NOT NULL) END AS issues FROM ck_topic_nodes"""


def nodes(t):
    return g.topic_nodes(t.kg_nodes, t.kg_rels, *RUN)


@query("qr_21", "SELECT node_key, array_to_string(issues, ',') AS issues FROM ck_rules")
def qr_21(t):
    return nodes(t).select("node_key", F.array_join(tp.rule_issues("topic"), ",").alias("issues"))


@fixture
def alignment_scores(d):
    return """SELECT concat('S', CAST(doc_id AS STRING)) AS node_key, quality * CAST(0.5 AS DOUBLE) + toxic * CAST(0.3 AS DOUBLE) + CAST(0.25 AS DOUBLE) AS alignment_score, 'checked' AS explanation,
      CASE WHEN doc_id % 3 = 0 THEN concat('Verify ', CAST(doc_id AS STRING)) ELSE '' END AS suggested_topic, 'r' AS rationale, CAST(0.9 AS DOUBLE) AS confidence FROM labels"""


@fixture
def journey_suggestions(d):
    return "SELECT concat('S', CAST(c_custkey AS STRING)) AS node_key, CASE WHEN c_custkey % 4 = 0 THEN concat('validate ', lower(c_mktsegment), ' ', CAST(c_custkey % 40 AS STRING)) ELSE 'Assess Risk' END AS suggested FROM customer WHERE c_acctbal > 5000"


@fixture
def ck_similar(d):
    """Of each topic its last similar pair."""
    return """WITH k AS (SELECT DISTINCT lower(trim(topic)) AS k FROM ck_topic_nodes WHERE coalesce(topic,'') <> ''),
      p AS (SELECT a.k AS a, b.k AS b FROM k a JOIN k b ON a.k < b.k AND abs(len(a.k) - len(b.k)) <= 0.15 * greatest(len(a.k), len(b.k)) AND 1 - levenshtein(a.k, b.k) / greatest(len(a.k), len(b.k)) >= 0.85)
      SELECT k, max((a, b)) AS pair FROM (SELECT a AS k, a, b FROM p UNION ALL SELECT b, a, b FROM p) GROUP BY k"""


@fixture
def ck_analysis(d):
    return f"""WITH n AS (SELECT *, lower(trim(topic)) AS k FROM ck_topic_nodes), c AS (SELECT k, count(*) AS c FROM n WHERE coalesce(topic,'') <> '' GROUP BY k),
      x AS (SELECT n.*, r.issues AS rules, CASE WHEN l.k IS NOT NULL THEN 'similar' WHEN coalesce(n.topic,'') <> '' AND c.c > 1 THEN 'duplicate' END AS dup,
          CASE WHEN l.k IS NOT NULL THEN concat('sim_', md5(concat(l.pair[1], chr(10), l.pair[2]))) WHEN coalesce(n.topic,'') <> '' AND c.c > 1 THEN concat('dup_', md5(n.k)) ELSE '' END AS group_id,
          s.alignment_score, s.explanation, s.suggested_topic, s.rationale, s.confidence, j.suggested,
          CASE WHEN coalesce(n.topic,'') = '' AND n.business_summary = '' THEN 0.0 ELSE s.alignment_score END AS score,
          coalesce(n.topic,'') <> '' AND coalesce(j.suggested,'') <> '' AND lower(j.suggested) <> lower(n.topic) AS jb
        FROM n JOIN ck_rules r ON r.node_key = n.node_key LEFT JOIN c ON c.k = n.k LEFT JOIN ck_similar l ON l.k = n.k AND coalesce(n.topic,'') <> '' LEFT JOIN alignment_scores s ON s.node_key = n.node_key LEFT JOIN journey_suggestions j ON j.node_key = n.node_key),
      y AS (SELECT *, list_concat(rules, list_filter([dup, CASE WHEN jb THEN 'journey_break' END], lambda v: v IS NOT NULL)) AS early FROM x),
      z AS (SELECT *, len(early) > 0 OR (coalesce(topic,'') <> '' AND business_summary <> '') AS needs FROM y),
      i AS (SELECT *, list_concat(early, CASE WHEN needs AND coalesce(score, 1.0) < 0.7 THEN ['misaligned'] ELSE [] END) AS issues FROM z)
      SELECT node_key, node_type, ef_key, issues, needs, group_id,
        array_to_string(list_filter([
          CASE WHEN list_contains(issues, 'topic_missing') THEN 'topic is missing' END,
          CASE WHEN list_contains(issues, 'duplicate') THEN concat('exact duplicate in group ', group_id) END,
          CASE WHEN list_contains(issues, 'similar') THEN concat('similar topic in group ', group_id) END,
          CASE WHEN list_contains(issues, 'verb_noun') THEN 'first word is not an approved verb' END,
          CASE WHEN list_contains(issues, 'technical_glue') THEN 'contains a technical glue word' END,
          CASE WHEN list_contains(issues, 'misaligned') THEN concat('Alignment=', printf('%.2f', score), ': ', CASE WHEN coalesce(topic,'') = '' AND business_summary = '' THEN 'Both topic and business_summary missing' ELSE coalesce(explanation, '') END) END,
          CASE WHEN list_contains(issues, 'journey_break') THEN 'differs from the journey suggestion' END], lambda v: v IS NOT NULL), '; ') AS details,
        CASE WHEN needs AND coalesce(suggested_topic,'') <> '' THEN suggested_topic ELSE coalesce(suggested,'') END AS suggested_topic,
        CASE WHEN needs AND coalesce(suggested_topic,'') <> '' THEN rationale WHEN coalesce(suggested,'') <> '' THEN 'Suggested by journey chain analysis' ELSE '' END AS rationale,
        CASE WHEN needs AND coalesce(suggested_topic,'') <> '' THEN confidence WHEN coalesce(suggested,'') <> '' THEN 0.6 ELSE 0 END::DOUBLE AS confidence, k FROM i"""


def analysis(t):
    n = checkpointed(nodes(t))
    return tp.analyze_topics(n, tp.topic_groups(n, tp.similar_topics(n)), t.alignment_scores, t.journey_suggestions)


@query("qr_25", "SELECT node_key, node_type, array_to_string(issues, ',') AS issues, details, needs AS needs_review, suggested_topic, rationale, confidence, group_id FROM ck_analysis")
def qr_25(t):
    return analysis(t).select(
        "node_key", "node_type", F.array_join("issues", ",").alias("issues"), "details", "needs_review", "suggested_topic", "rationale", "confidence", "group_id")


@query("qr_22", "SELECT node_key FROM ck_analysis WHERE list_contains(issues, 'misaligned')")
def qr_22(t):
    return tp.filter_analysis(analysis(t), issue="misaligned").select("node_key")


@query("qr_23", "SELECT node_key FROM ck_analysis WHERE list_contains(issues, 'journey_break')")
def qr_23(t):
    return tp.filter_analysis(analysis(t), issue="journey_break").select("node_key")


@query("qr_24", "SELECT node_key FROM ck_analysis WHERE needs")
def qr_24(t):
    return analysis(t).where("needs_review").select("node_key")


@query("fil_11", "SELECT node_key, ef_key FROM ck_analysis WHERE node_type = 'Snippet' AND list_contains(issues, 'duplicate')")
def fil_11(t):
    return tp.filter_analysis(analysis(t), "Snippet", "duplicate").select("node_key", "ef_key")


@query("fil_11_similar", "SELECT node_key, ef_key, group_id FROM ck_analysis WHERE node_type = 'Snippet' AND list_contains(issues, 'similar')")
def fil_11_similar(t):
    return tp.filter_analysis(analysis(t), "Snippet", "similar").select("node_key", "ef_key", "group_id")


@query("agg_10", "SELECT issue, count(*) AS nodes FROM (SELECT unnest(issues) AS issue FROM ck_analysis) GROUP BY issue")
def agg_10(t):
    return tp.issue_breakdown(analysis(t))


@query("agg_10_types", "SELECT node_type, count(*) AS nodes, count_if(len(issues) > 0) AS with_issues, count_if(list_contains(issues,'topic_missing')) AS missing FROM ck_analysis GROUP BY ROLLUP (node_type)")
def agg_10_types(t):
    return tp.topic_summary(analysis(t))


@query("agg_23", "SELECT flow_key, parent_key, string_agg(DISTINCT child_key, ',' ORDER BY child_key) AS children FROM ck_children GROUP BY ALL")
def agg_23(t):
    kids = g.snippet_children(t.kg_nodes, t.kg_rels, snippets(t)).select("flow_key", "parent_key", "child_key").distinct().withColumn("_s", F.lit(0))
    return gr.list_parts(kids, ["flow_key", "parent_key"], F.col("child_key"), "_s", ["child_key"]).select("flow_key", "parent_key", F.array_join("items", ",").alias("children"))
