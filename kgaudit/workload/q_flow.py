"""Flow audit queries: JOIN-1..5, AGG-1..4, WIN-3, QR-26/27, edge audit."""

from pyspark.sql import functions as F

from kgaudit.operators import diff, edge_audit
from kgaudit.operators.normalize import normalize_edges
from kgaudit.workload.registry import fixture, query


def sides(t):
    return normalize_edges(t.edges_a), normalize_edges(t.edges_b)


def bare(x):
    return f"regexp_replace({x}, '^.*[.]', '')"


@fixture
def tier6(d):
    return """SELECT DISTINCT a.flow_key, a.c, a.cc, a.cf, a.e, a.ec, a.ef,
       EXISTS (SELECT 1 FROM norm_b b WHERE b.flow_key=a.flow_key AND b.c=a.c AND b.cc=a.cc AND b.cf=a.cf
               AND b.e=a.e AND b.ec=a.ec AND b.ef=a.ef) AS hit FROM norm_a a"""


@fixture
def verified(d):
    """Check-side cascade of the tiers, written as semi joins."""
    return f"""
    SELECT v.*, CASE WHEN tier = 'phantom' THEN 0.2 WHEN tier = 'missing' THEN 0.0 ELSE
        (CASE m.method WHEN 'neo4j' THEN 0.95 WHEN 'regex' THEN 0.9 ELSE 0.75 END)
        * (CASE tier WHEN 'full' THEN 1.0 WHEN 'name_file' THEN 0.95 WHEN 'bare_name_file' THEN 0.95 * 0.98 ELSE 0.8 END) END::DOUBLE AS trust_score
    FROM (
      WITH nf AS (SELECT DISTINCT flow_key, c, cf, e, ef FROM tier6 WHERE NOT hit),
      bnf AS (SELECT DISTINCT flow_key, c, cf, e, ef FROM norm_b),
      bbare AS (SELECT DISTINCT flow_key, {bare('c')} AS c, cf, {bare('e')} AS e, ef FROM norm_b),
      p2 AS (SELECT nf.*, (flow_key,c,cf,e,ef) IN (SELECT (flow_key,c,cf,e,ef) FROM bnf) AS exact,
                   (flow_key,{bare('c')},cf,{bare('e')},ef) IN (SELECT (flow_key,c,cf,e,ef) FROM bbare) AS loose FROM nf),
      conf AS (SELECT flow_key, c, cf, e, ef, 'full' AS tier FROM tier6 WHERE hit
               UNION ALL SELECT flow_key, c, cf, e, ef, CASE WHEN exact THEN 'name_file' ELSE 'bare_name_file' END FROM p2 WHERE exact OR loose),
      an AS (SELECT DISTINCT flow_key, c, e FROM norm_a), bn AS (SELECT DISTINCT flow_key, c, e FROM norm_b),
      bb AS (SELECT DISTINCT flow_key, {bare('c')} AS c, {bare('e')} AS e FROM norm_b),
      p3 AS (SELECT an.*, (flow_key,c,e) IN (SELECT (flow_key,c,e) FROM bn) AS exact,
                   (flow_key,{bare('c')},{bare('e')}) IN (SELECT (flow_key,c,e) FROM bb) AS loose
             FROM an WHERE (flow_key,c,e) NOT IN (SELECT (flow_key,c,e) FROM conf)),
      allconf AS (SELECT * FROM conf UNION ALL SELECT flow_key, c, '' AS cf, e, '' AS ef, CASE WHEN exact THEN 'name_only' ELSE 'bare_name_only' END AS tier FROM p3 WHERE exact OR loose)
      SELECT * FROM allconf
      UNION ALL SELECT flow_key, c, '', e, '', 'phantom' FROM an WHERE (flow_key,c,e) NOT IN (SELECT (flow_key,c,e) FROM allconf)
      UNION ALL SELECT flow_key, c, '', e, '', 'missing' FROM bn WHERE (flow_key,c,e) NOT IN (SELECT (flow_key,c,e) FROM allconf)
         AND (flow_key,{bare('c')},{bare('e')}) NOT IN (SELECT (flow_key,{bare('c')},{bare('e')}) FROM allconf)
    ) v LEFT JOIN (SELECT flow_key, c, e, max_by(method, seq * 10 + length(method)) AS method FROM norm_a GROUP BY ALL) m
      ON m.flow_key = v.flow_key AND m.c = v.c AND m.e = v.e"""


CLASS = "CASE WHEN tier IN ('phantom','missing') THEN tier ELSE 'confirmed' END"


def scored(t):
    return diff.diff_flows(*sides(t))[1]


@query("join_1", f"""SELECT flow_key, c AS caller, cf AS caller_file, e AS callee, ef AS callee_file,
   {CLASS} AS classification, tier, round(trust_score, 6) AS trust_score FROM verified""")
def join_1(t):
    return diff.diff_edges(*sides(t)).withColumn("trust_score", F.round("trust_score", 6))


@query("join_2", "SELECT flow_key, c AS caller, e AS callee FROM verified WHERE tier = 'phantom'")
def join_2(t):
    return diff.phantom_pairs(*sides(t))


@query("join_3", "SELECT flow_key, c AS caller, e AS callee FROM verified WHERE tier = 'missing'")
def join_3(t):
    return diff.missing_pairs(*sides(t))


LAST = "list_last(list_filter(list_transform(string_split({x}, '::'), lambda p: trim(p)), lambda p: p <> ''))"


@fixture
def ck_gaps(d):
    return f"""WITH sites AS (SELECT {LAST.format(x='caller')} AS caller, {LAST.format(x='callee')} AS callee,
     trim(string_split(caller,'::')[1]) AS caller_file, trim(string_split(callee,'::')[1]) AS callee_file, confidence AS trust_score, seq FROM call_edges),
   firsts AS (SELECT * EXCLUDE (rn) FROM (SELECT *, {bare('upper(caller)')} AS bc, {bare('upper(callee)')} AS be,
       row_number() OVER (PARTITION BY {bare('upper(caller)')}, {bare('upper(callee)')} ORDER BY seq, caller, callee, caller_file, callee_file, trust_score) AS rn FROM sites) WHERE rn = 1),
   names AS (SELECT flow_key, {bare('c')} AS bc FROM norm_a UNION SELECT flow_key, {bare('e')} FROM norm_a),
   known AS (SELECT flow_key, {bare('c')} AS bc, {bare('e')} AS be FROM norm_a UNION SELECT flow_key, {bare('c')}, {bare('e')} FROM norm_b)
   SELECT n.flow_key, f.caller, f.callee, f.caller_file, f.callee_file, f.trust_score FROM firsts f JOIN names n ON n.bc = f.bc
   WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.flow_key = n.flow_key AND k.bc = f.bc AND k.be = f.be)"""


@query("join_4", "SELECT * FROM ck_gaps")
def join_4(t):
    return diff.coverage_gaps(*sides(t), t.call_edges)


@query("agg_1", f"""SELECT flow_key, round(sum(trust_score * w) / sum(w), 6) AS graph_trust_score FROM
   (SELECT *, CASE {CLASS} WHEN 'confirmed' THEN 1.0 WHEN 'phantom' THEN 0.5 ELSE 0 END AS w FROM verified) GROUP BY flow_key""")
def agg_1(t):
    return scored(t).select("flow_key", F.round("graph_trust_score", 6).alias("graph_trust_score"))


SCORES = f"""(SELECT v.flow_key, count_if({CLASS}='confirmed') AS confirmed, count_if(tier='phantom') AS phantom, count_if(tier='missing') AS missing,
   count_if(tier='full') AS match_full, count_if(tier IN ('name_file','bare_name_file')) AS match_name_file,
   count_if(tier IN ('name_only','bare_name_only')) AS match_name_only,
   any_value(n.na) AS catalog_edges, any_value(n.nb) AS observed_edges,
   count_if({CLASS}='confirmed') / any_value(n.na) AS flow_trust_score
   FROM verified v JOIN (SELECT flow_key, count(DISTINCT (c,e)) FILTER (side='a') AS na, count(DISTINCT (c,e)) FILTER (side='b') AS nb FROM
      (SELECT flow_key, c, e, 'a' AS side FROM norm_a UNION ALL SELECT flow_key, c, e, 'b' FROM norm_b) GROUP BY flow_key) n ON n.flow_key = v.flow_key GROUP BY v.flow_key)"""


@query("agg_2", f"SELECT * EXCLUDE (flow_trust_score), round(flow_trust_score, 6) AS flow_trust_score FROM {SCORES}")
def agg_2(t):
    return scored(t).drop("graph_trust_score").withColumn("flow_trust_score", F.round("flow_trust_score", 6))


@query("agg_3", """SELECT extraction_method, tier, round(CASE extraction_method WHEN 'neo4j' THEN 0.95 WHEN 'regex' THEN 0.9 END *
   CASE tier WHEN 'full' THEN 1.0 WHEN 'name_file' THEN 0.95 WHEN 'bare_name_file' THEN 0.931 ELSE 0.8 END, 6)::DOUBLE AS trust, count(*) AS edges
   FROM edges_a JOIN (SELECT DISTINCT tier FROM verified WHERE tier NOT IN ('phantom','missing')) x ON true GROUP BY ALL""")
def agg_3(t):
    methods = t.edges_a.groupBy("extraction_method").agg(F.count(F.lit(1)).alias("edges"))
    tiers = F.explode(F.array(*[F.lit(x) for x in diff.CONFIRMED_TIERS]))
    return methods.withColumn("tier", tiers).select(
        "extraction_method", "tier",
        F.round(diff.edge_trust("extraction_method") * diff.tier_factor("tier"), 6).alias("trust"), "edges")


@query("agg_4", f"""SELECT count(*) AS flows, round(avg(flow_trust_score), 6) AS average_trust, sum(confirmed)::BIGINT AS confirmed,
   sum(phantom)::BIGINT AS phantom, sum(missing)::BIGINT AS missing, sum(confirmed+phantom+missing)::BIGINT AS total_edges,
   count_if(phantom > 0 OR missing > 0) AS needs_attention FROM {SCORES}""")
def agg_4(t):
    return diff.project_summary(scored(t)).withColumn("average_trust", F.round("average_trust", 6))


@query("fil_13", f"SELECT flow_key, phantom, missing FROM {SCORES} WHERE phantom > 0 OR missing > 0")
def fil_13(t):
    return diff.needs_attention(scored(t)).select("flow_key", "phantom", "missing")


@query("win_3", f"""WITH fa AS (SELECT flow_key, c, e, min(seq) AS sa FROM norm_a GROUP BY ALL), fb AS (SELECT flow_key, c, e, min(seq) AS sb FROM norm_b GROUP BY ALL),
   m AS (SELECT x.flow_key, x.c, CASE WHEN EXISTS (SELECT 1 FROM fb WHERE fb.flow_key=x.flow_key AND fb.c=x.c) THEN x.c
        WHEN EXISTS (SELECT 1 FROM fb WHERE fb.flow_key=x.flow_key AND fb.c={bare('x.c')}) THEN {bare('x.c')} END AS cb FROM (SELECT DISTINCT flow_key, c FROM fa) x),
   r AS (SELECT m.flow_key, m.c, row_number() OVER (PARTITION BY m.flow_key, m.c ORDER BY sa, fa.e) AS ra,
          row_number() OVER (PARTITION BY m.flow_key, m.c ORDER BY sb, fa.e) AS rb
        FROM m JOIN fa ON fa.flow_key=m.flow_key AND fa.c=m.c JOIN fb ON fb.flow_key=m.flow_key AND fb.c=m.cb AND fb.e=fa.e)
   SELECT m.flow_key, m.c AS caller, count(r.ra) AS common, coalesce(bool_and(ra = rb), true) AS in_order
   FROM m LEFT JOIN r ON r.flow_key = m.flow_key AND r.c = m.c WHERE m.cb IS NOT NULL GROUP BY ALL""")
def win_3(t):
    return diff.order_kept(*sides(t))


@query("qr_26", """SELECT flow_key, c AS caller, e AS callee, tier AS classification,
   CASE WHEN tier='phantom' AND q THEN 'qualified_name_in_catalog' WHEN tier='phantom' THEN 'absent_from_index' WHEN NOT q THEN 'bare_name_in_index' ELSE 'absent_from_flow' END AS reason,
   CASE WHEN tier='phantom' AND q THEN 'check_index_scope' WHEN tier='phantom' THEN 'rebuild_index' WHEN NOT q THEN 'check_flow_contents' ELSE 'confirm_expected_call' END AS remedy
   FROM (SELECT *, (c LIKE '%.%' OR e LIKE '%.%') AS q FROM verified WHERE tier IN ('phantom','missing'))""")
def qr_26(t):
    return diff.explain_discrepancies(diff.diff_edges(*sides(t)))


@query("qr_26_causes", """SELECT DISTINCT flow_key, CASE WHEN tier='missing' THEN 'index_only_edges' ELSE 'qualified_versus_bare_name' END AS cause
   FROM verified WHERE tier = 'missing' OR (tier = 'phantom' AND (c LIKE '%.%' OR e LIKE '%.%'))""")
def qr_26_causes(t):
    return diff.flow_causes(diff.explain_discrepancies(diff.diff_edges(*sides(t))))


@fixture
def verdicts(d):
    return """SELECT concat('EF-', CAST(l_suppkey AS STRING)) AS flow_key,
      CASE l_linenumber % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'phantom' ELSE 'conflicted' END AS classification,
      CASE WHEN l_quantity > 25 THEN l_discount * 5 END AS trust_score, CASE WHEN l_quantity > 10 THEN l_tax * 10 END AS confidence,
      CASE WHEN l_suppkey % 3 = 0 THEN CAST(0.4 AS DOUBLE) END AS flow_score, CASE WHEN l_suppkey % 4 = 0 THEN CAST(0.6 AS DOUBLE) END AS graph_score FROM lineitem"""


@query("qr_27", """SELECT flow_key, confirmed, phantom, missing, conflicted,
   round(CASE WHEN g <> 0 THEN g WHEN confirmed > 0 THEN (s + 0.5 * ps) / (confirmed + 0.5 * phantom) ELSE 0 END, 6)::DOUBLE AS graph_trust_score,
   round(CASE WHEN f <> 0 THEN f ELSE confirmed / (confirmed + phantom) END, 6)::DOUBLE AS flow_trust_score FROM
   (SELECT flow_key, count_if(classification='confirmed') AS confirmed, count_if(classification='phantom') AS phantom,
      count_if(classification='missing') AS missing, count_if(classification='conflicted') AS conflicted,
      sum(coalesce(trust_score, confidence, 0.85)) FILTER (classification='confirmed') AS s,
      sum(coalesce(trust_score, 0.2)) FILTER (classification='phantom') AS ps, max(graph_score) AS g, max(flow_score) AS f FROM verdicts GROUP BY flow_key)""")
def qr_27(t):
    out = diff.merge_external_verdicts(t.verdicts)
    return out.withColumns({c: F.round(c, 6) for c in ("graph_trust_score", "flow_trust_score")})
