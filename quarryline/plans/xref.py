"""Cross-reference and graph queries: parts as blocks and tags, line items as uses, event transitions as navigation."""

from pyspark.sql import functions as F

from quarryline.operators import graphs as G
from quarryline.operators import xref as X
from quarryline.plans.registry import query
from quarryline.plans.tables import EDGES_SQL, NODES_SQL, TRANSITIONS_SQL, edges, nodes, table, transitions

_G = f"WITH {NODES_SQL}, {EDGES_SQL} "
_R = _G.replace("WITH ", "WITH RECURSIVE ", 1)


@query("b10_name_lookup", "SELECT p_partkey AS pos, p_name AS name FROM part WHERE lower(p_name) = 'red widget' ORDER BY p_name <> 'Red widget', p_partkey LIMIT 1")
def b10(spark, d):
    return X.find(table(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("name")), "Red widget")


@query("b11_dead_code", _G + "SELECT name, pos, type FROM nodes WHERE type NOT IN ('OB', 'DB', 'IDB') AND name NOT IN (SELECT dst FROM edges)")
def b11(spark, d):
    return G.uncalled(nodes(spark, d), edges(spark, d)).select("name", "pos", "type")


_NAV = f"WITH {TRANSITIONS_SQL}, links AS (SELECT DISTINCT user_id || '/' || src AS src, user_id || '/' || dst AS dst FROM transitions), screens AS (SELECT DISTINCT user_id || '/' || event_type AS name FROM events) "


def _nav(spark, d):
    t = transitions(spark, d)
    at = lambda c: F.concat(F.col("user_id").cast("string"), F.lit("/"), c)
    screens = table(spark, d, "events").select(at(F.col("event_type")).alias("name")).distinct()
    return screens, t.select(at(F.col("src")).alias("src"), at(F.col("dst")).alias("dst")).distinct()


@query("b12_orphan_screens", _NAV + "SELECT name FROM screens WHERE name NOT IN (SELECT dst FROM links)")
def b12(spark, d):
    return G.orphans(*_nav(spark, d))


_TAGS = "tags AS (SELECT p_name AS name, max(p_type) AS type, max(p_brand) AS tbl FROM part GROUP BY 1)"


@query(
    "b13_tag_resolution",
    f"""WITH {_TAGS}, refs AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_linenumber % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || '.x.y' ELSE 'q' || p_name END AS ref FROM lineitem JOIN part ON p_partkey = l_partkey)
        SELECT id, ref, coalesce(a.type, b.type, '?') AS type, coalesce(a.tbl, b.tbl, '(not in tag table)') AS "table" FROM refs LEFT JOIN tags a ON a.name = ref LEFT JOIN tags b ON b.name = split_part(ref, '.', 1)""",
)
def b13(spark, d):
    p = table(spark, d, "part")
    tags = p.groupBy(F.col("p_name").alias("name")).agg(F.max("p_type").alias("type"), F.max("p_brand").alias("table"))
    li = table(spark, d, "lineitem").join(p.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    k = F.col("l_linenumber") % 3
    ref = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat("p_name", F.lit(".x.y"))).otherwise(F.concat(F.lit("q"), "p_name"))
    return X.resolved(li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), ref.alias("ref")), tags)


@query("b14_screen_tags", "SELECT l_orderkey, l_linenumber, l_partkey AS hmi_tag, coalesce(n, '(not found in HMITags.xlsx)') AS plc_tag FROM lineitem LEFT JOIN (SELECT p_partkey, p_name AS n FROM part WHERE p_size < 25) ON p_partkey = l_partkey")
def b14(spark, d):
    tags = table(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("hmi_tag"), F.col("p_name").alias("plc_tag"))
    return X.screen_tags(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("hmi_tag")), tags)


@query("b15_merged_tag_tables", "SELECT p_name AS name, min(p_partkey) AS priority, arg_min(p_type, p_partkey) AS type FROM part GROUP BY 1")
def b15(spark, d):
    return X.merged_tables(table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("priority"), F.col("p_type").alias("type")))


@query(
    "b16_prefix_join",
    """WITH f AS (SELECT source || '_' || lang || '_' || doc_id AS function FROM documents), e AS (SELECT DISTINCT source AS element FROM documents UNION SELECT DISTINCT source || '_' || lang FROM documents)
       SELECT element, function FROM f JOIN e ON starts_with(function, element || '_')""",
)
def b16(spark, d):
    docs = table(spark, d, "documents")
    two = F.concat_ws("_", "source", "lang")
    names = docs.select(F.concat_ws("_", "source", "lang", "doc_id").alias("function"))
    return X.events_of_elements(names, docs.select(F.col("source").alias("element")).union(docs.select(two)))


@query("b17_tag_trace", "SELECT lower(coalesce(c_name, s_name)) AS key, CASE WHEN c_name IS NULL THEN 'hmi' WHEN s_name IS NULL THEN 'plc' ELSE 'both' END AS found FROM (SELECT DISTINCT replace(upper(c_name), 'CUSTOMER', 'X') AS c_name FROM customer) FULL JOIN (SELECT DISTINCT replace(lower(s_name), 'supplier', 'x') AS s_name FROM supplier) ON lower(c_name) = lower(s_name)")
def b17(spark, d):
    plc = table(spark, d, "customer").select(F.replace(F.upper("c_name"), F.lit("CUSTOMER"), F.lit("X")).alias("name")).distinct()
    hmi = table(spark, d, "supplier").select(F.replace(F.lower("s_name"), F.lit("supplier"), F.lit("x")).alias("name")).distinct()
    return X.trace(plc, hmi).select("key", "found")


@query(
    "b18_program_summary",
    _G + """SELECT (SELECT count(*) FROM nodes) AS blocks, (SELECT count(*) FROM nodes WHERE type = 'OB') AS n_ob, (SELECT count(*) FROM nodes WHERE type = 'FC') AS n_fc, (SELECT count(*) FROM nodes WHERE type = 'DB') AS n_db,
            (SELECT count(*) FROM nodes WHERE type = 'UDT') AS n_udt, (SELECT count(*) FROM lineitem) AS uses, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS tags""",
)
def b18(spark, d):
    return X.totals(nodes(spark, d), table(spark, d, "lineitem").select(F.col("l_partkey").alias("tag")))


@query("b19_screen_summary", f"WITH {TRANSITIONS_SQL} SELECT src, count(*) AS links, count(DISTINCT dst) AS targets FROM transitions GROUP BY src")
def b19(spark, d):
    return transitions(spark, d).groupBy("src").agg(F.count("*").alias("links"), F.countDistinct("dst").alias("targets"))


_KIND = "CASE WHEN p_size < 10 THEN 'button' WHEN p_size < 20 THEN 'io_field' WHEN p_size < 30 THEN 'bar_graph' WHEN p_size < 40 THEN 'switch' ELSE 'line' END"
_ROLE = f"""CASE {_KIND} WHEN 'button' THEN CASE WHEN p_type = 'SMALL' THEN 'navigation_button' WHEN p_partkey % 2 = 0 THEN 'control_button (writes to PLC)' ELSE 'button' END
  WHEN 'io_field' THEN CASE WHEN contains(p_name, 'Set') OR contains(p_name, 'Write') THEN 'input (writes to PLC)' ELSE 'output (reads from PLC)' END
  WHEN 'bar_graph' THEN 'output (visualizes PLC value)' WHEN 'switch' THEN 'input (writes to PLC)' ELSE 'display/static' END"""


def _elements(spark, d):
    size = F.col("p_size")
    kind = F.when(size < 10, "button").when(size < 20, "io_field").when(size < 30, "bar_graph").when(size < 40, "switch").otherwise("line")
    role = X.io_role(kind, F.col("p_type") == "SMALL", F.col("p_partkey") % 2 == 0, F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("screen"), kind.alias("type"), (F.col("p_partkey") % 3).alias("n_events"), (F.col("p_partkey") % 4).alias("n_tags"), role.alias("io_role"))


@query("b38_io_role", f"SELECT p_partkey, {_KIND} AS type, {_ROLE} AS io_role FROM part")
def b38(spark, d):
    return _elements(spark, d).select("p_partkey", "type", "io_role")


@query(
    "b20_element_summary",
    f"""WITH e AS (SELECT p_partkey, p_brand AS screen, {_KIND} AS type, {_ROLE} AS r FROM part)
        SELECT screen, what, count(*) AS n FROM (SELECT screen, type AS what FROM e UNION ALL SELECT screen, 'with_events' FROM e WHERE p_partkey % 3 > 0 UNION ALL SELECT screen, 'with_tag_bindings' FROM e WHERE p_partkey % 4 > 0
        UNION ALL SELECT screen, CASE WHEN contains(r, 'input') THEN 'inputs' WHEN contains(r, 'output') OR contains(r, 'display') THEN 'outputs' WHEN contains(r, 'control') OR contains(r, 'navigation') THEN 'controls' END FROM e)
        WHERE what IS NOT NULL GROUP BY ALL""",
)
def b20(spark, d):
    return X.element_summary(_elements(spark, d))


@query("b21_tag_xref", "SELECT l_partkey AS tag, string_agg(l_orderkey, ',' ORDER BY l_orderkey) AS users FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) GROUP BY 1")
def b21(spark, d):
    uses = table(spark, d, "lineitem").select(F.col("l_partkey").alias("tag"), F.col("l_orderkey").alias("pos"), F.col("l_orderkey").cast("string").alias("user"))
    return X.inverted(uses).select("tag", F.array_join("users", ",").alias("users"))


@query("b22_screen_tag_index", "SELECT event_type AS tag, string_agg(user_id, ',' ORDER BY first, user_id::VARCHAR) AS users FROM (SELECT event_type, user_id, min(event_id) AS first FROM events GROUP BY ALL) GROUP BY 1")
def b22(spark, d):
    uses = table(spark, d, "events").select(F.col("event_type").alias("tag"), F.col("event_id").alias("pos"), F.col("user_id").cast("string").alias("user"))
    return X.inverted(uses).select("tag", F.array_join("users", ",").alias("users"))


@query("b24_coverage_gap", "SELECT coalesce(a, b) AS name, CASE WHEN a IS NULL THEN 'hmi only' WHEN b IS NULL THEN 'plc only' ELSE 'bound' END AS state FROM (SELECT DISTINCT l_partkey AS a FROM lineitem WHERE l_returnflag = 'R') FULL JOIN (SELECT DISTINCT l_partkey AS b FROM lineitem WHERE l_returnflag = 'A') ON a = b")
def b24(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_partkey", "name")
    return X.coverage(li.where("l_returnflag = 'R'"), li.where("l_returnflag = 'A'"))


@query("b25_missing_servers", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def b25(spark, d):
    there = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"))
    return X.missing(table(spark, d, "nation"), there, "n_nationkey").select("n_nationkey", "n_name")


@query("b26_screen_targets", f"WITH {TRANSITIONS_SQL} SELECT user_id || '/' || src AS screen, string_agg(dst, ',' ORDER BY event_id) AS targets FROM transitions GROUP BY 1")
def b26(spark, d):
    t = transitions(spark, d).select(F.concat(F.col("user_id").cast("string"), F.lit("/"), "src").alias("screen"), F.col("event_id").alias("pos"), "dst")
    return X.ordered_targets(t).select("screen", F.array_join("targets", ",").alias("targets"))


@query("b27_reverse_call_tree", _G + "SELECT dst AS name, string_agg(src, ',' ORDER BY src) AS callers FROM edges GROUP BY 1")
def b27(spark, d):
    return G.callers(edges(spark, d)).select("name", F.array_join("callers", ",").alias("callers"))


@query("b28_calls_of_blocks", _NAV + "SELECT src AS name, string_agg(dst, ',' ORDER BY dst) AS callees FROM links GROUP BY 1")
def b28(spark, d):
    return G.callees(_nav(spark, d)[1]).select("name", F.array_join("callees", ",").alias("callees"))


@query(
    "b29_shortest_path_to_entry",
    _R + """, walk AS (SELECT name, 0 AS level FROM nodes WHERE name NOT IN (SELECT dst FROM edges) UNION SELECT dst, level + 1 FROM walk JOIN edges ON src = name WHERE level < 300)
           SELECT name, min(level)::INT AS level FROM walk GROUP BY name""",
)
def b29(spark, d):
    return G.entry_distance(nodes(spark, d), edges(spark, d))


@query(
    "b30_call_cycles",
    _R + """, r AS (SELECT src, dst FROM edges WHERE src <> dst UNION SELECT r.src, e.dst FROM r JOIN edges e ON r.dst = e.src WHERE e.src <> e.dst)
           SELECT a.src AS name, least(a.src, min(a.dst)) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src""",
)
def b30(spark, d):
    return G.cycles(edges(spark, d), nodes(spark, d))


@query("b30_self_loops", _NAV + "SELECT src AS name FROM links WHERE src = dst")
def b30b(spark, d):
    return G.self_loops(_nav(spark, d)[1])


@query(
    "b31_subgraph_from_roots",
    _R + """, walk AS (SELECT name FROM nodes WHERE type = 'OB' UNION SELECT dst FROM walk JOIN edges ON src = name) SELECT src, dst FROM edges WHERE src IN (SELECT name FROM walk) AND dst IN (SELECT name FROM walk)""",
)
def b31(spark, d):
    return G.subgraph(edges(spark, d), nodes(spark, d).where("type = 'OB'"), most=None)


@query("b32_diagram_lines", _G + "SELECT src, dst, '    ' || src || ' --> ' || dst AS line FROM edges")
def b32(spark, d):
    return G.mermaid(edges(spark, d))


@query(
    "g4_tool_catalog",
    """WITH live AS (SELECT r_name AS server, n_name AS tool FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name < 'B'), cached AS (SELECT r_name AS server, n_name || '2' AS tool FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name < 'F'),
       conf AS (SELECT r_name AS server FROM region), t AS (SELECT server, tool, true AS o FROM live UNION ALL SELECT server, tool, false FROM cached WHERE server NOT IN (SELECT server FROM live))
       SELECT coalesce(t.server, conf.server) AS server, coalesce(tool, '-') AS tool, coalesce(o AND tool NOT LIKE '%A', false) AS enabled, tool IS NULL AS stub FROM t FULL JOIN conf ON t.server = conf.server""",
)
def g4(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("server"), F.col("n_name").alias("tool"))
    ends = n.where("tool like '%A'").groupBy("server").agg(F.collect_set("tool").alias("excluded"))
    conf = table(spark, d, "region").select(F.col("r_name").alias("server")).join(ends, "server", "left")
    cached = n.where("server < 'F'").withColumn("tool", F.concat("tool", F.lit("2")))
    return X.outer_catalog(n.where("server < 'B'"), cached, conf).withColumn("tool", F.coalesce("tool", F.lit("-")))
