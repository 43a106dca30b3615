"""Derived tables: the operator inputs expressed over the driver's tables.

Plain SQL that both Spark and DuckDB run; the few constructs that differ go through
the helpers below. Every table reads whole base tables.
"""

from __future__ import annotations

from kgaudit.workload.registry import fixture


def arr(d: str, *items: str) -> str:
    return ("array(%s)" if d == "spark" else "[%s]") % ", ".join(items)


def mapping(d: str, **items: str) -> str:
    if d == "spark":
        return "map(%s)" % ", ".join(f"'{k}', {v}" for k, v in items.items())
    return "MAP {%s}" % ", ".join(f"'{k}': {v}" for k, v in items.items())


def s(x: str) -> str:
    return f"CAST({x} AS STRING)"


# ---------------------------------------------------------------- functions and edges


@fixture
def kg_part(d):
    return """
    SELECT p_partkey AS pk,
      concat(upper(substr(p_name,1,1)), replace(substr(p_name,2),' ','_'),
             CASE WHEN p_partkey % 9 = 0 THEN CAST(p_partkey AS STRING) ELSE '' END) AS fn,
      concat('src/', replace(p_brand,'#','_'), '/', p_type, '.pas') AS file_path,
      CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat('T', p_type) END AS cls,
      'pascal' AS language, p_size AS psize
    FROM part"""


@fixture
def pairs(d):
    return """
    SELECT concat('EF-', CAST(CAST(floor(l.l_orderkey / 500) AS BIGINT) AS STRING)) AS flow_key,
      l.l_orderkey * 8 + l.l_linenumber AS seq, l.l_linenumber AS ln, l.l_returnflag AS rf,
      a.fn AS caller, a.cls AS caller_class, a.file_path AS caller_file,
      b.fn AS callee, b.cls AS callee_class, b.file_path AS callee_file
    FROM lineitem l
    JOIN kg_part a ON a.pk = l.l_partkey
    JOIN kg_part b ON b.pk = l.l_suppkey"""


@fixture
def edges_a(d):
    """Catalog edges as read from the graph store, before normalisation."""
    return """
    SELECT flow_key, seq,
      CASE WHEN ln = 2 THEN concat('T.', caller) ELSE caller END AS caller, callee,
      CASE WHEN ln = 4 THEN '' ELSE concat('C:\\mnt\\x\\', replace(caller_file, '/', '\\')) END AS caller_file,
      CASE WHEN ln = 4 THEN '' ELSE callee_file END AS callee_file,
      CASE WHEN ln IN (3,4) THEN '' ELSE caller_class END AS caller_class, callee_class,
      CASE WHEN ln = 5 THEN 'regex' ELSE 'neo4j' END AS extraction_method,
      CAST(1 AS INT) AS depth, CAST(1.0 AS DOUBLE) AS confidence
    FROM pairs WHERE rf <> 'N'""".replace("\\", "\\\\" if d == "spark" else "\\")


@fixture
def edges_b(d):
    return """
    SELECT flow_key, seq, caller, callee, caller_file, callee_file, caller_class, callee_class,
      'regex' AS extraction_method, CAST(1 AS INT) AS depth, CAST(0.9 AS DOUBLE) AS confidence
    FROM pairs WHERE rf <> 'A'"""


def _clean(c: str) -> str:
    return f"upper(trim({c}))"


def _file(c: str, d: str) -> str:
    return f"upper(trim(regexp_replace(translate({c}, '{chr(92) * (2 if d == 'spark' else 1)}', '/'), '^.*/', '')))"


@fixture
def norm_a(d):
    """Reference form of the normalised catalog edges, used by checks only."""
    return f"""SELECT flow_key, seq, {_clean('caller')} AS c, {_clean('caller_class')} AS cc, {_file('caller_file', d)} AS cf,
      {_clean('callee')} AS e, {_clean('callee_class')} AS ec, {_file('callee_file', d)} AS ef, extraction_method AS method
    FROM edges_a"""


@fixture
def norm_b(d):
    return f"""SELECT flow_key, seq, {_clean('caller')} AS c, {_clean('caller_class')} AS cc, {_file('caller_file', d)} AS cf,
      {_clean('callee')} AS e, {_clean('callee_class')} AS ec, {_file('callee_file', d)} AS ef, extraction_method AS method
    FROM edges_b"""


@fixture
def aliases(d):
    return """SELECT DISTINCT concat('a_', p_name) AS alias, p_name AS canonical FROM part"""


@fixture
def code_index(d):
    """Functions as the index scan meets them; ``seq`` is the walk order."""
    return """
    SELECT fn AS function_name, file_path, language, cls AS class_name, pk AS seq FROM kg_part"""


@fixture
def call_edges(d):
    """Stored call sites, a bag: one row per site."""
    return """
    SELECT seq, concat(caller_file, '::', caller_class, '::', caller) AS caller,
      CASE WHEN ln = 7 THEN callee_file ELSE concat(callee_file, '::', callee_class, '::', callee) END AS callee,
      CAST(0.5 + 0.05 * ln AS DOUBLE) AS confidence
    FROM pairs WHERE rf <> 'A'"""


# ---------------------------------------------------------------- property graph

NODE_COLUMNS = {
    "project_id": "INT", "run_id": "INT", "key": "STRING", "labels": None,
    "name": "STRING", "function_name": "STRING", "class_name": "STRING",
    "file_path": "STRING", "file_name": "STRING", "type": "STRING", "root_type": "STRING",
    "execution_order": "INT", "topic": "STRING", "business_summary": "STRING",
    "short_summary": "STRING", "description": "STRING", "snippet": "STRING",
    "meaning": "STRING", "visual_imagery_data": "STRING", "table_names": "STRING",
    "start_line_number": "INT", "end_line_number": "INT", "schema_name": "STRING",
    "schema_table": "STRING", "data_type": "STRING", "constraints": None, "props": None,
}


def _nodes(d: str, source: str, **given: str) -> str:
    out = []
    for name, typ in NODE_COLUMNS.items():
        if name in given:
            expr = f"CAST({given[name]} AS {typ})" if typ else given[name]
        elif typ:
            expr = f"CAST(NULL AS {typ})"
        elif name == "props":
            expr = mapping(d, tech="'delphi'", note="CAST(NULL AS STRING)")
        else:
            expr = arr(d, "CAST('' AS STRING)")
        out.append(f"{expr} AS {name}")
    return f"SELECT {', '.join(out)} {source}"


RUN = "CASE WHEN {k} % 10 = 9 THEN 2 ELSE 1 END"
FLOW_OF_CUST = "CAST(floor(c_custkey / 15) AS BIGINT)"


@fixture
def kg_nodes(d):
    supp_run = RUN.format(k="s_suppkey")
    cust_run = RUN.format(k=FLOW_OF_CUST)
    kind = "p_partkey % 6"
    parts = [
        _nodes(d, "FROM supplier", project_id="1", run_id=supp_run,
               key=f"concat('EF-', {s('s_suppkey')})", labels=arr(d, "'ExecutionFlow'"),
               name=f"concat('Flow ', {s('s_suppkey % 37')})", description="concat('Handles ', s_name)",
               topic="CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE concat('Validate Flow ', CAST(s_suppkey % 20 AS STRING)) END",
               execution_order="s_suppkey", props=mapping(d, module="'core'", complexity="CASE WHEN s_suppkey % 3 = 0 THEN 'high' END")),
        _nodes(d, "FROM customer LEFT JOIN kg_part ON pk = c_custkey", project_id="1", run_id=cust_run,
               key=f"concat('S', {s('c_custkey')})",
               labels=f"CASE WHEN c_custkey % 40 = 1 THEN {arr(d, chr(39) + 'Node' + chr(39), chr(39) + 'Snippet' + chr(39), chr(39) + 'Screen' + chr(39))} ELSE {arr(d, chr(39) + 'Snippet' + chr(39))} END",
               name="CASE WHEN c_custkey % 14 = 0 THEN ' ' ELSE c_name END",
               function_name="CASE WHEN c_custkey % 18 = 0 THEN concat('Other', CAST(c_custkey AS STRING)) WHEN c_custkey % 16 = 3 THEN NULL WHEN c_custkey % 6 = 0 THEN concat('TForm.', fn) ELSE fn END",
               class_name="CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE cls END",
               file_path="CASE WHEN c_custkey % 7 = 0 THEN concat('old/', file_path, 'x') WHEN c_custkey % 21 = 1 THEN NULL ELSE concat('D:/app/', file_path) END",
               file_name="CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'unit.pas' END",
               type="CASE WHEN c_custkey % 15 = 0 THEN 'ROOT' ELSE 'CHILD' END",
               root_type="CASE WHEN c_custkey % 30 = 0 THEN 'UI' END",
               execution_order="CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_custkey % 13 END",
               topic="CASE WHEN c_custkey % 11 = 0 THEN '  ' WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN concat('Process ', c_mktsegment, ' data') WHEN c_custkey % 7 = 1 THEN concat('fast ', lower(c_mktsegment), ' build') ELSE concat('Validate ', c_mktsegment, ' ', CAST(c_custkey % 40 AS STRING)) END",
               business_summary="CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE concat('Checks ', c_mktsegment) END",
               short_summary="CASE WHEN c_custkey % 19 = 0 THEN '' ELSE c_mktsegment END",
               snippet="CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE concat('procedure ', coalesce(fn, 'X'), '; begin Call', CAST(c_custkey % 3 AS STRING), '(1); end;') END",
               visual_imagery_data="CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE 'box' END",
               start_line_number="c_custkey % 50", end_line_number="c_custkey % 50 + 9"),
        _nodes(d, f"FROM part WHERE {kind} IN (0, 1, 2, 4)",
               project_id="CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 1 END", run_id="CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 1 END",
               key=f"concat('C', {s('p_partkey')})",
               labels=arr(d, f"CASE {kind} WHEN 0 THEN 'DBCall' WHEN 1 THEN 'Calculation' WHEN 2 THEN 'ServiceCall' ELSE 'Variable' END"),
               name="p_name", topic="CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE concat('Compute ', p_name) END",
               business_summary="p_brand", meaning="CASE WHEN p_partkey % 10 = 4 THEN ' ' ELSE p_type END",
               table_names="CASE WHEN p_partkey % 14 = 0 THEN NULL ELSE p_type END", execution_order="p_size"),
        _nodes(d, f"FROM part WHERE {kind} IN (3, 5)", project_id="1", run_id="1",
               key=f"concat('C', {s('p_partkey')})",
               labels=arr(d, "CASE p_partkey % 12 WHEN 3 THEN 'InputEntity' WHEN 9 THEN 'InputInterface' WHEN 5 THEN 'MapFile' ELSE 'DMN' END"),
               name="p_name", topic="concat('Route ', p_name)", execution_order="p_size"),
        _nodes(d, "FROM (SELECT p_brand, p_type, min(p_partkey) AS mk FROM part GROUP BY p_brand, p_type) g",
               project_id="1", run_id="1", key="concat('E-', p_brand, '-', p_type)",
               labels=arr(d, "'DatabaseEntity'"), name="p_brand", execution_order="1",
               schema_name="CASE WHEN p_type = 'SMALL' THEN NULL WHEN p_type = 'LARGE' THEN '' ELSE p_type END",
               schema_table="p_brand", description="concat('Table ', p_brand)",
               business_summary="CASE WHEN p_type = 'PROMO' THEN 'Promotions' ELSE '' END"),
        _nodes(d, "FROM part", project_id="1", run_id="1", key=f"concat('F', {s('p_partkey')})",
               labels=arr(d, "'DatabaseField'"), name="concat('f', CAST(p_size AS STRING))", execution_order="1",
               data_type="CASE WHEN p_size % 3 = 0 THEN 'INT' ELSE 'VARCHAR' END",
               constraints=f"CASE WHEN p_size % 4 = 0 THEN {arr(d, chr(39) + 'NOT NULL' + chr(39), chr(39) + 'PRIMARY KEY' + chr(39))} WHEN p_size % 4 = 1 THEN {arr(d, chr(39) + 'NOT NULL' + chr(39))} ELSE {arr(d, 'CAST(' + chr(39) * 2 + ' AS STRING)')} END"),
        _nodes(d, "FROM supplier", project_id="1", run_id=supp_run, key=f"concat('J', {s('s_suppkey')})",
               labels=arr(d, "'Job'"), name="s_name", topic="'Schedule Night Batch'", execution_order="1"),
        _nodes(d, "FROM customer WHERE c_custkey % 15 IN (2, 3)", project_id="1", run_id=cust_run,
               key=f"concat('T', {s('c_custkey')})", labels=arr(d, "'Step'"), name="c_name",
               topic="concat('Run Step ', c_mktsegment)", execution_order="c_custkey % 15",
               visual_imagery_data="CASE WHEN c_custkey % 15 = 3 THEN NULL ELSE 'arrow' END"),
    ]
    return " UNION ALL ".join(parts)


def _rels(source: str, src: str, typ: str, dst: str, eo: str = "NULL", geo: str = "NULL", start: str = "NULL") -> str:
    return (f"SELECT {src} AS src_key, {typ} AS rel_type, {dst} AS dst_key, CAST({eo} AS INT) AS execution_order, "
            f"CAST({geo} AS BIGINT) AS global_execution_order, CAST({start} AS BOOLEAN) AS starts_flow {source}")


@fixture
def kg_rels(d):
    base = "CAST(floor(o_custkey / 15) AS BIGINT)"
    k, nxt = "(o_custkey % 15)", "((o_custkey % 15) * 2 + o_orderkey % 3 + 1)"
    callee = f"""CASE
      WHEN o_orderkey % 97 = 0 THEN concat('S', CAST({base} * 15 + CAST(floor({k} / 2) AS BIGINT) AS STRING))
      WHEN {nxt} < 15 THEN concat('S', CAST({base} * 15 + {nxt} AS STRING))
      WHEN {base} % 2 = 0 AND o_orderkey % 5 = 0 THEN concat('S', CAST({base} * 15 + 15 + o_orderkey % 15 AS STRING))
      ELSE concat('X', CAST(o_orderkey % 1000 AS STRING)) END"""
    sk, ck = f"concat('S', {s('c_custkey')})", f"concat('C', {s('p_partkey')})"
    rel = ("CASE p_partkey % 6 WHEN 0 THEN 'CONTAINS_DB_CALLS' WHEN 1 THEN 'CONTAINS_CALCULATION' WHEN 2 THEN 'CONTAINS_SERVICE_CALLS' "
           "WHEN 3 THEN 'CONTAINS_INPUT' WHEN 4 THEN 'Contains_variable' ELSE CASE p_partkey % 12 WHEN 5 THEN 'CONTAINS_MAP_FILE' ELSE 'CONTAINS_DMN' END END")
    return " UNION ALL ".join([
        _rels("FROM customer WHERE c_custkey % 25 <> 7", sk, "'PARTICIPATES_IN_FLOW'", f"concat('EF-', CAST({FLOW_OF_CUST} AS STRING))",
              start="CASE WHEN c_custkey % 15 IN (0, 1) AND c_custkey % 9 <> 0 THEN TRUE ELSE FALSE END"),
        _rels("FROM supplier", f"concat('J', {s('s_suppkey')})", "'PARTICIPATES_IN_FLOW'", f"concat('EF-', {s('s_suppkey')})"),
        _rels("FROM orders", f"concat('S', {s('o_custkey')})", "'CALLS'", callee,
              eo="CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_orderkey % 1000 END",
              geo="CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey - o_orderkey % 20 END"),
        _rels("FROM part WHERE p_partkey % 8 <> 0", f"concat('S', CAST(p_partkey % 1700 AS STRING))", rel, ck),
        _rels("FROM part WHERE p_partkey % 9 = 0", f"concat('S', CAST(p_partkey + 1 AS STRING))", rel, ck),
        _rels("FROM part WHERE p_partkey % 6 = 0", ck, "CASE WHEN p_partkey % 12 = 0 THEN 'ACCESSES' ELSE 'REFERENCES' END", "concat('E-', p_brand, '-', p_type)"),
        _rels("FROM part", "concat('E-', p_brand, '-', p_type)", "'HAS_FIELD'", f"concat('F', {s('p_partkey')})"),
        _rels("FROM customer WHERE c_custkey % 15 IN (2, 3) AND CAST(floor(c_custkey / 15) AS BIGINT) % 12 <> 5",
              f"concat('J', CAST({FLOW_OF_CUST} AS STRING))", "'HAS_STEP'", f"concat('T', {s('c_custkey')})"),
        _rels("FROM part WHERE p_partkey % 6 = 4 AND p_partkey % 15 IN (2, 3)", f"concat('T', {s('p_partkey')})", "'Contains_variable'", ck),
    ])
