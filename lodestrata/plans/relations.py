"""Queries on the store's relations: look-ups, views, joins, set operations, risk, impact."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.operators import behavioral as B
from lodestrata.operators import risk as R
from lodestrata.operators import temporal as T
from lodestrata.plans.registry import register
from lodestrata.plans.views import CALLS, MODIFIES, calls, modifies, table, with_
from lodestrata.sources import files as SF
from lodestrata.sources import store as ST

NODES = """nd AS (SELECT s_suppkey::BIGINT AS id, 'File' AS kind, s_name AS name, s_acctbal AS score FROM supplier UNION ALL SELECT 1000000 + n_nationkey, 'Module', n_name, NULL FROM nation UNION ALL SELECT 2000000 + c_custkey, 'Contributor', c_name, c_acctbal FROM customer)"""
MEMBERS = """bs AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem),
mb AS (SELECT o AS edge, 'Modifies' AS kind, 3000000 + o AS node, 'commit' AS role, 0 AS position FROM (SELECT DISTINCT o FROM bs) UNION ALL SELECT o, 'Modifies', s, 'file', row_number() OVER (PARTITION BY o ORDER BY s) FROM bs
UNION ALL SELECT 100000000 + s_suppkey, 'BelongsTo', s_suppkey, 'member', 0 FROM supplier UNION ALL SELECT 100000000 + s_suppkey, 'BelongsTo', 1000000 + s_nationkey, 'container', 1 FROM supplier)"""


def nodes(spark, d):
    s, n, c = table(spark, d, "supplier"), table(spark, d, "nation"), table(spark, d, "customer")
    out = s.select(F.col("s_suppkey").alias("id"), F.lit("File").alias("kind"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("score"))
    out = out.unionByName(n.select((1_000_000 + F.col("n_nationkey")).cast("long").alias("id"), F.lit("Module").alias("kind"), F.col("n_name").alias("name"), F.lit(None).cast("double").alias("score")))
    return out.unionByName(c.select((2_000_000 + F.col("c_custkey")).alias("id"), F.lit("Contributor").alias("kind"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("score")))


def members(spark, d):
    """An order is an edge of one commit and its suppliers; a supplier belongs to its nation."""
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("edge"), F.col("l_suppkey").alias("node")).distinct()
    f = b.select("edge", F.lit("Modifies").alias("kind"), "node", F.lit("file").alias("role"), F.row_number().over(W.partitionBy("edge").orderBy("node")).alias("position"))
    c = b.select("edge").distinct().select("edge", F.lit("Modifies").alias("kind"), (3_000_000 + F.col("edge")).alias("node"), F.lit("commit").alias("role"), F.lit(0).alias("position"))
    s = table(spark, d, "supplier")
    e = (100_000_000 + F.col("s_suppkey")).alias("edge")
    m = s.select(e, F.lit("BelongsTo").alias("kind"), F.col("s_suppkey").alias("node"), F.lit("member").alias("role"), F.lit(0).alias("position"))
    k = s.select(e, F.lit("BelongsTo").alias("kind"), (1_000_000 + F.col("s_nationkey")).cast("long").alias("node"), F.lit("container").alias("role"), F.lit(1).alias("position"))
    return c.unionByName(f).unionByName(m).unionByName(k)


@register("f1_node_by_id", with_(NODES) + "SELECT id, kind, name FROM nd WHERE id = 1000003")
def f1(spark, d):
    return nodes(spark, d).filter("id = 1000003").select("id", "kind", "name")


@register("f2_node_by_name", with_(NODES) + "SELECT id, kind, name FROM nd WHERE kind = 'Module' AND name = 'NATION_3'")
def f2(spark, d):
    return ST.find_nodes(nodes(spark, d), kind="Module", strict=True).filter("name = 'NATION_3'").select("id", "kind", "name")


@register("f3_find_nodes", with_(NODES) + "SELECT id, kind, name FROM nd WHERE kind = 'Contributor' AND starts_with(lower(name), 'customer') AND contains(lower(name), '01') ORDER BY name LIMIT 50")
def f3(spark, d):
    return ST.find_nodes(nodes(spark, d), "Contributor", "CUSTOMER", "01", 50).select("id", "kind", "name")


@register("f4_edges_with_members", with_(MEMBERS) + "SELECT edge, string_agg(role || ':' || node, ',' ORDER BY position, role, node) AS members FROM mb WHERE kind = 'Modifies' GROUP BY edge")
def f4(spark, d):
    e = ST.with_members(members(spark, d).filter("kind = 'Modifies'"))
    return e.select("edge", F.array_join(F.transform("members", lambda m: F.concat(m["role"], F.lit(":"), m["node_id"].cast("string"))), ",").alias("members"))


@register("f7_json_predicate", "SELECT event_id, CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS INT) AS k FROM events WHERE CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS INT) > 50 AND ts < TIMESTAMP '2024-01-15'")
def f7(spark, d):
    e = table(spark, d, "events").withColumn("k", F.try_variant_get(F.parse_json("props"), "$.k", "int"))
    return e.filter("k > 50 AND ts < TIMESTAMP_NTZ '2024-01-15 00:00:00'").select("event_id", "k")


@register("f8_json_update", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'true' END AS stale FROM events")
def f8(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("props").alias("metadata"))
    return ST.mark_stale(e, e.filter("id % 3 = 0")).select(F.col("id").alias("event_id"), F.get_json_object("metadata", "$.stale").alias("stale"))


@register("f12_scope_then_top", with_(NODES) + "SELECT id, name, score FROM nd WHERE starts_with(name, 'Customer') AND score IS NOT NULL ORDER BY score DESC, name LIMIT 10")
def f12(spark, d):
    n = nodes(spark, d)
    return R.ranked_metric(n.filter("score IS NOT NULL").select(F.col("id").alias("node"), "score"), n.select("id", "name"), 10, "Customer")


@register("j1_call_graph_view", with_(CALLS) + "SELECT src * 1000000 + dst AS edge, src AS caller, dst AS callee FROM ca")
def j1(spark, d):
    e = calls(spark, d).select((F.col("src") * 1_000_000 + F.col("dst")).alias("edge"), F.explode(F.array(F.struct(F.lit("caller").alias("role"), F.col("src").alias("node")), F.struct(F.lit("callee").alias("role"), F.col("dst").alias("node")))).alias("m"))
    return ST.pairs_view(e.select("edge", F.lit("Calls").alias("kind"), "m.role", "m.node"), "call_graph")


@register("j3_commit_files_view", "SELECT DISTINCT l_orderkey AS edge, 3000000 + l_orderkey AS commit, l_suppkey AS file FROM lineitem")
def j3(spark, d):
    return ST.pairs_view(members(spark, d), "commit_files")


VIEW_ROWS = "SELECT CAST(s_suppkey AS BIGINT) AS edge, CAST(s_suppkey AS BIGINT) AS {a}, CAST(1000000 + s_nationkey AS BIGINT) AS {b} FROM supplier"


def _view(spark, d, view, role_a, role_b):
    """Each supplier on an edge with its nation, with the roles as they were once called."""
    kind, _ = ST.VIEWS[view]
    s = table(spark, d, "supplier")
    m = s.select(F.col("s_suppkey").alias("edge"), F.lit(kind).alias("kind"), F.explode(F.array(F.struct(F.lit(role_a).alias("role"), F.col("s_suppkey").alias("node")), F.struct(F.lit(role_b).alias("role"), (1_000_000 + F.col("s_nationkey")).cast("long").alias("node")), F.struct(F.lit("other").alias("role"), F.col("s_suppkey").alias("node")))).alias("m"))
    return ST.pairs_view(m.select("edge", "kind", "m.role", "m.node"), view)


@register("j2_import_graph_view", VIEW_ROWS.format(a="importer", b="imported"))
def j2(spark, d):
    return _view(spark, d, "import_graph", "source", "target")


@register("j4_document_references_view", VIEW_ROWS.format(a="document", b="code_entity"))
def j4(spark, d):
    return _view(spark, d, "document_references", "document", "entity")


@register("j5_prompt_modifications_view", VIEW_ROWS.format(a="session", b="file"))
def j5(spark, d):
    return _view(spark, d, "prompt_modifications", "prompt", "file")


@register("f10_directed_pairs", with_(MEMBERS) + "SELECT 3000000 + o AS src, min(s) AS dst, 1.0::DOUBLE AS weight FROM bs GROUP BY o UNION ALL SELECT s_suppkey, 1000000 + s_nationkey, 1.0 FROM supplier")
def f10(spark, d):
    """A commit's edge has no roles of a pair, so its first two members make one."""
    from lodestrata.operators.graph import directed

    return directed(ST.with_members(members(spark, d)).withColumn("confidence", F.lit(1.0)))


@register("j6_edges_of_nodes", with_(MEMBERS) + "SELECT DISTINCT edge, kind FROM mb WHERE node IN (3, 5, 1000002)")
def j6(spark, d):
    want = spark.range(1).select(F.explode(F.array(F.lit(3), F.lit(5), F.lit(1_000_002)).cast("array<long>")).alias("node"))
    return ST.edges_of(members(spark, d), want)


@register("j7_co_members", with_(MEMBERS) + "SELECT DISTINCT a.node, b.node AS other FROM mb a JOIN mb b ON a.edge = b.edge AND a.node <> b.node WHERE a.node IN (3, 5)")
def j7(spark, d):
    want = spark.range(1).select(F.explode(F.array(F.lit(3), F.lit(5)).cast("array<long>")).alias("node"))
    return ST.co_members(members(spark, d), want)


@register("j9_positional_zip", "SELECT o AS commit, f AS file, CASE WHEN i <= 2 THEN q ELSE 0 END AS added FROM (SELECT o, f, q, row_number() OVER (PARTITION BY o ORDER BY f, q) AS i FROM (SELECT DISTINCT l_orderkey AS o, l_suppkey AS f, l_quantity AS q FROM lineitem))")
def j9(spark, d):
    """The i-th file with the i-th entry of what was told of files; what isn't told counts 0."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("commit")).agg(F.array_sort(F.collect_set(F.struct(F.col("l_suppkey").alias("f"), F.col("l_quantity").alias("q")))).alias("m"))
    z = li.select("commit", F.posexplode(F.arrays_zip(F.transform("m", lambda x: x["f"]).alias("file"), F.slice(F.transform("m", lambda x: x["q"]), 1, 2).alias("added"))).alias("i", "z"))
    return z.select("commit", F.col("z.file").alias("file"), F.coalesce("z.added", F.lit(0.0)).alias("added"))


@register("j15_latest_by_key", "SELECT l_orderkey, l_linenumber, r.l_suppkey, r.l_partkey FROM (SELECT l_orderkey, l_linenumber, max({'l_shipdate': l_shipdate, 'l_suppkey': l_suppkey, 'l_partkey': l_partkey}) AS r FROM lineitem GROUP BY ALL)")
def j15(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("v"), "l_suppkey", "l_partkey")
    return ST.latest(li, ["l_orderkey", "l_linenumber"])


@register("j16_names", with_(NODES, MEMBERS) + "SELECT edge, node, coalesce(name, 'node:' || node) AS node_name FROM mb LEFT JOIN nd ON nd.id = mb.node")
def j16(spark, d):
    return ST.named(members(spark, d).select("edge", "node"), nodes(spark, d), "node")


@register("a1_counts_by_kind", with_(NODES, MEMBERS) + "SELECT 'node' AS what, kind, count(*) AS n FROM nd GROUP BY kind UNION ALL SELECT 'edge', kind, count(DISTINCT edge) FROM mb GROUP BY kind")
def a1(spark, d):
    return ST.counts_by_kind(nodes(spark, d), members(spark, d).select("edge", "kind").distinct())


RISK = """rf AS (SELECT s_suppkey AS file, s_suppkey % 10 / 10.0::DOUBLE AS pagerank, s_suppkey % 3 = 0 AS has_test, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey % 4 END AS bus_factor, CASE WHEN s_suppkey % 5 = 0 THEN 'ActiveCritical' ELSE 'Volatile' END AS stability, s_suppkey % 2 = 0 AS has_docs,
CASE WHEN s_suppkey % 7 = 0 THEN 'Rising' ELSE 'Stable' END AS trend, s_suppkey % 11 / 10.0::DOUBLE AS staleness, CASE WHEN s_suppkey % 6 > 1 THEN s_suppkey % 6 / 10.0::DOUBLE END AS correction_rate, s_suppkey % 13 AS prompt_refs FROM supplier),
rr AS (SELECT file, list_filter([CASE WHEN pagerank > 0.5 AND NOT has_test THEN 'high_centrality_low_tests' END, CASE WHEN coalesce(bus_factor <= 1, false) THEN 'knowledge_silo' END, CASE WHEN stability = 'ActiveCritical' THEN 'volatile_critical' END, CASE WHEN pagerank > 0.5 AND NOT has_docs THEN 'undocumented_critical' END,
CASE WHEN trend = 'Rising' THEN 'rising_importance' END, CASE WHEN staleness > 0.5 THEN 'stale_documentation' END, CASE WHEN correction_rate > 0.2 THEN 'agent_confusion_zone' END, CASE WHEN pagerank > 0.5 AND prompt_refs = 0 THEN 'underprompted' END], lambda x: x IS NOT NULL) AS rs FROM rf),
rs AS (SELECT file, array_to_string(rs, ',') AS reasons, round(least(1.0::DOUBLE, list_sum(list_transform(list_concat(rs, ['none']), lambda r: CASE r WHEN 'high_centrality_low_tests' THEN 0.3::DOUBLE WHEN 'knowledge_silo' THEN 0.2 WHEN 'volatile_critical' THEN 0.25 WHEN 'undocumented_critical' THEN 0.15 WHEN 'rising_importance' THEN 0.2 WHEN 'stale_documentation' THEN 0.15 WHEN 'agent_confusion_zone' THEN 0.15 WHEN 'underprompted' THEN 0.1 ELSE 0 END))), 2) AS score FROM rr)"""


@register("j17_risk_map", with_(RISK) + "SELECT file, reasons, score, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'none' END AS level FROM rs")
def j17(spark, d):
    k = F.col("s_suppkey")
    f = table(spark, d, "supplier").select(
        k.alias("file"), (k % 10 / 10).alias("pagerank"), (k % 3 == 0).alias("has_test"), F.when(k % 4 > 0, k % 4).alias("bus_factor"), F.when(k % 5 == 0, "ActiveCritical").otherwise("Volatile").alias("stability"), (k % 2 == 0).alias("has_docs"),
        F.when(k % 7 == 0, "Rising").otherwise("Stable").alias("trend"), (k % 11 / 10).alias("staleness"), F.when(k % 6 > 1, k % 6 / 10).alias("correction_rate"), (k % 13).alias("prompt_refs"),
    )
    return R.risk_map(f).select("file", F.array_join("reasons", ",").alias("reasons"), "score", "level")


TREE = "SELECT DISTINCT 'src/' || p_brand || '/m' || p_size || CASE WHEN p_partkey % 3 = 0 THEN '_test.go' ELSE '.go' END AS file FROM part"


def tree(spark, d):
    p = table(spark, d, "part")
    return p.select(F.concat(F.lit("src/"), "p_brand", F.lit("/m"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "_test.go").otherwise(".go")).alias("file")).distinct()


@register("j18_tested_files", f"WITH t AS ({TREE}) SELECT file, EXISTS (SELECT 1 FROM t q WHERE (contains(lower(q.file), 'test') OR contains(lower(q.file), 'spec')) AND contains(q.file, string_split(string_split(t.file, '/')[-1], '.')[1])) AS has_test FROM t")
def j18(spark, d):
    return R.tested(tree(spark, d))


@register("j20_directory_imports", "SELECT dir, array_to_string(list_sort(list(DISTINCT other)), ',') AS imports_from FROM (SELECT n1.n_name AS dir, n2.n_name AS other FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation n1 ON n1.n_nationkey = c_nationkey JOIN nation n2 ON n2.n_nationkey = s_nationkey) WHERE dir <> other GROUP BY dir")
def j20(spark, d):
    li, o, c, s, n = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "supplier", "nation"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey)
    a, b = n.select(F.col("n_nationkey").alias("ka"), F.col("n_name").alias("na")), n.select(F.col("n_nationkey").alias("kb"), F.col("n_name").alias("nb"))
    i = j.join(a, F.col("c_nationkey") == F.col("ka")).join(b, F.col("s_nationkey") == F.col("kb")).select(F.concat("na", F.lit("/x.go")).alias("importer"), F.concat("nb", F.lit("/y.go")).alias("imported"))
    return R.directory_imports(i).select("dir", F.array_join("imports_from", ",").alias("imports_from"))


SPANS = "sp AS (SELECT DISTINCT l_suppkey AS file, 'f' || l_partkey AS name, l_partkey AS start, l_partkey + CAST(l_quantity AS BIGINT) AS \"end\" FROM lineitem), rf AS (SELECT DISTINCT l_suppkey AS file, l_orderkey AS ref, l_partkey + 5 AS \"at\" FROM lineitem)"


@register("w6_enclosing_span", with_(SPANS) + "SELECT file, ref, \"at\", s.name, s.start, s.\"end\" FROM (SELECT rf.file, rf.ref, rf.\"at\", min({'size': sp.\"end\" - sp.start, 'start': sp.start, 'name': sp.name, 'end': sp.\"end\"}) AS s FROM rf JOIN sp ON sp.file = rf.file AND rf.\"at\" BETWEEN sp.start AND sp.\"end\" GROUP BY ALL)")
def w6(spark, d):
    li = table(spark, d, "lineitem")
    s = li.select(F.col("l_suppkey").alias("file"), F.concat(F.lit("f"), "l_partkey").alias("name"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end")).distinct()
    r = li.select(F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("ref"), (F.col("l_partkey") + 5).alias("at")).distinct()
    return R.enclosing(r, s)


@register("a20_doc_style", "WITH e AS (SELECT p_type AS style, CASE WHEN p_size % 3 > 0 THEN p_name || CASE WHEN p_size % 5 = 0 THEN ' @param x' ELSE '' END END AS doc FROM part) SELECT style, count(*) AS documented, (SELECT count(doc) FROM e) AS n_documented, (SELECT count(*) FROM e) AS total, round(count(*) / CAST((SELECT count(doc) FROM e) AS DOUBLE), 4) AS share, (SELECT bool_or(contains(doc, '@param')) FROM e) AS documents_params FROM e WHERE doc IS NOT NULL GROUP BY style")
def a20(spark, d):
    from lodestrata.operators import convention as V

    p = table(spark, d, "part")
    e = p.select(F.col("p_type").alias("style"), F.when(F.col("p_size") % 3 > 0, F.concat("p_name", F.when(F.col("p_size") % 5 == 0, " @param x").otherwise(""))).alias("doc"))
    return V.doc_style(e).select("style", "documented", "n_documented", "total", "share", "documents_params")


@register("a23_import_projection", "SELECT src, dst, array_to_string(list_sort(list(DISTINCT sym)), ',') AS symbols, min(conf) AS confidence FROM (SELECT o_custkey % 20 AS src, l_suppkey AS dst, l_returnflag AS sym, l_discount AS conf FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE src <> dst GROUP BY ALL")
def a23(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    r = li.join(o, li.l_orderkey == o.o_orderkey).select((F.col("o_custkey") % 20).alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("symbol"), F.col("l_discount").alias("confidence"))
    return R.import_projection(r).select("src", "dst", F.array_join("symbols", ",").alias("symbols"), "confidence")


@register("k2_top_missing_as_zero", with_(NODES) + "SELECT id, name, coalesce(score, 0) AS score FROM nd WHERE kind <> 'Contributor' ORDER BY coalesce(score, 0) DESC, name LIMIT 30")
def k2(spark, d):
    n = nodes(spark, d).filter("kind != 'Contributor'")
    return R.ranked_metric(n.filter("score IS NOT NULL").select(F.col("id").alias("node"), "score"), n.select("id", "name"), 30, missing=0.0)


@register("k7_semantic_candidates", with_(NODES) + "SELECT id, score FROM nd WHERE score >= 7000 ORDER BY score DESC, id LIMIT 25")
def k7(spark, d):
    return nodes(spark, d).filter("score >= 7000").select("id", "score").orderBy(F.desc("score"), "id").limit(25)


@register("k10_symmetric_pairs", with_(CALLS) + "SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM ca")
def k10(spark, d):
    return calls(spark, d).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


@register("u1_intersection", "SELECT l_suppkey AS node FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50 INTERSECT SELECT l_suppkey FROM lineitem WHERE l_discount < 0.01")
def u1(spark, d):
    from lodestrata.operators.graph import all_of

    li = table(spark, d, "lineitem").withColumn("node", F.col("l_suppkey"))
    return all_of([li.filter("l_returnflag = 'R'").select("node"), li.filter("l_quantity >= 50").select("node"), li.filter("l_discount < 0.01").select("node")], spark)


@register("u3_definition_changes", """WITH o AS (SELECT 'd' || p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN 'Function' ELSE 'Type' END AS kind, p_partkey * 100 AS s, p_partkey * 100 + 50 AS e FROM part WHERE p_partkey % 5 <> 0),
n AS (SELECT CASE WHEN p_partkey % 7 = 0 THEN 'r' ELSE 'd' END || p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN 'Function' ELSE 'Type' END AS kind, p_partkey * 100 + CASE WHEN p_partkey % 3 = 0 THEN 10 ELSE 0 END AS s, p_partkey * 100 + 50 AS e FROM part WHERE p_partkey % 11 <> 0),
g AS (SELECT o.* FROM o ANTI JOIN n USING (name, kind)), c AS (SELECT n.* FROM n ANTI JOIN o USING (name, kind)), rn AS (SELECT c.name, c.kind, g.name AS old_name FROM g JOIN c ON g.kind = c.kind AND least(g.e, c.e) > greatest(g.s, c.s))
SELECT 'renamed' AS change, name, kind, old_name FROM rn UNION ALL SELECT 'removed', name, kind, NULL FROM g WHERE name NOT IN (SELECT old_name FROM rn) UNION ALL SELECT 'added', name, kind, NULL FROM c WHERE name NOT IN (SELECT name FROM rn)
UNION ALL SELECT 'changed', name, kind, NULL FROM o JOIN n USING (name, kind) WHERE o.s <> n.s OR o.e <> n.e""")
def u3(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    kind = F.when(k % 2 == 0, "Function").otherwise("Type").alias("kind")
    o = p.filter(k % 5 != 0).select(F.concat(F.lit("d"), k).alias("name"), kind, (k * 100).alias("start"), (k * 100 + 50).alias("end"))
    n = p.filter(k % 11 != 0).select(F.concat(F.when(k % 7 == 0, "r").otherwise("d"), k.cast("string")).alias("name"), kind, (k * 100 + F.when(k % 3 == 0, 10).otherwise(0)).alias("start"), (k * 100 + 50).alias("end"))
    return T.definitions_diff(o, n)


@register("u6_shared_files", "WITH s AS (SELECT l_orderkey AS o, list(DISTINCT l_suppkey) AS f FROM lineitem GROUP BY 1) SELECT a.o AS a, b.o AS b, len(list_intersect(a.f, b.f)) AS shared FROM s a JOIN s b ON b.o = a.o + 1")
def u6(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("a")).agg(F.collect_set("l_suppkey").alias("f"))
    n = s.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), F.col("f").alias("g"))
    return s.join(n, "a").select("a", "b", F.size(F.array_intersect("f", "g")).cast("long").alias("shared"))


@register("q3_entity_lookup", with_(NODES) + "SELECT id, kind, name FROM nd WHERE contains(name, '00012') ORDER BY name = '00012' DESC, CASE kind WHEN 'File' THEN 0 WHEN 'Module' THEN 3 ELSE 5 END, name, id LIMIT 1")
def q3(spark, d):
    return R.entity_lookup(nodes(spark, d), "00012").select("id", "kind", "name")


@register("q11_impact", with_(MODIFIES, CALLS) + """, c AS (SELECT s_suppkey AS file FROM supplier), i AS (SELECT dst AS file, count(DISTINCT src) AS importers FROM ca GROUP BY dst), pr AS (SELECT p.file AS a, q.file AS b FROM (SELECT DISTINCT commit, file FROM m) p JOIN (SELECT DISTINCT commit, file FROM m) q ON p.commit = q.commit AND p.file <> q.file GROUP BY ALL HAVING count(*) >= 3), pn AS (SELECT a AS file, count(DISTINCT b) AS partners FROM pr GROUP BY a)
SELECT c.file, s_nationkey AS module, coalesce(importers, 0) AS importers, coalesce(partners, 0) AS partners, s_acctbal / 10000 > 0.3 AS high_salience, s_suppkey % 4 <= 1 AS single_owner FROM c JOIN supplier ON s_suppkey = c.file LEFT JOIN i ON i.file = c.file LEFT JOIN pn ON pn.file = c.file""")
def q11(spark, d):
    s = table(spark, d, "supplier").withColumn("file", F.col("s_suppkey"))
    return R.impact(s, s.select("file", F.col("s_nationkey").alias("module")), calls(spark, d), B.cochange_pairs(modifies(spark, d), 3, 0.0), s.select("file", (F.col("s_acctbal") / 10000).alias("score")), s.select("file", (F.col("s_suppkey") % 4).alias("bus_factor")))


@register("q12_root_module", "SELECT n_name AS name FROM nation ORDER BY length(n_name), n_name LIMIT 1")
def q12(spark, d):
    return R.root_module(table(spark, d, "nation").select(F.col("n_name").alias("name"), F.lit(None).cast("boolean").alias("is_root"))).select("name")


@register("i5_invalidated", "WITH ch AS (SELECT c_custkey AS n FROM customer WHERE c_acctbal < -900), e AS (SELECT DISTINCT date_trunc('day', o_orderdate) AS e, o_custkey AS n FROM orders), near AS (SELECT n FROM ch UNION SELECT b.n FROM e a JOIN e b USING (e) JOIN ch ON ch.n = a.n) SELECT c_custkey AS node_id FROM customer WHERE c_custkey NOT IN (SELECT n FROM near)")
def i5(spark, d):
    """Customers of a day's orders are on one edge."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("node_id"), "c_acctbal")
    m = table(spark, d, "orders").select(F.date_trunc("day", "o_orderdate").alias("hyperedge_id"), F.col("o_custkey").alias("node_id")).distinct()
    return T.invalidated(c.select("node_id"), c.filter("c_acctbal < -900").select("node_id"), m)


@register("r3_key_documents", "SELECT doc_id, n FROM (SELECT l_orderkey % 50 AS doc_id, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) ORDER BY n DESC, doc_id LIMIT 10")
def r3(spark, d):
    li = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 50).alias("doc_id")).agg(F.countDistinct("l_suppkey").alias("n"))
    return li.orderBy(F.desc("n"), "doc_id").limit(10)


@register("r7_confusion_zones", "SELECT file, rate FROM (SELECT event_id % 40 AS file, round(count_if(event_type = 'click') / CAST(count(*) AS DOUBLE), 6) AS rate, count_if(event_type = 'click') AS c FROM events GROUP BY 1) WHERE rate > 0.2 AND c >= 2 ORDER BY rate DESC, file LIMIT 10")
def r7(spark, d):
    from lodestrata.operators import sessions

    u = table(spark, d, "events").select((F.col("event_id") % 40).alias("file"), (F.col("event_type") == "click").cast("int").alias("corrections"), F.lit(1).alias("interactions"))
    return sessions.correction_hotspots(u).filter("is_confusion_zone").select("file", F.col("correction_rate").alias("rate")).orderBy(F.desc("rate"), "file").limit(10)


@register("r16_skills", """WITH f AS (SELECT l_orderkey AS s, list_sort(list(DISTINCT l_suppkey % 6)) AS files FROM lineitem GROUP BY 1), p AS (SELECT files, count(*) AS frequency FROM f GROUP BY files HAVING count(*) >= 2),
g AS (SELECT n_regionkey AS g, list_sort(list(DISTINCT CAST(n_nationkey * 3 % 10 AS BIGINT))) AS files, count(*) + n_regionkey AS frequency FROM nation GROUP BY n_regionkey),
k AS (SELECT * FROM g WHERE len(files) >= 3 AND frequency >= 3 AND NOT EXISTS (SELECT 1 FROM p WHERE len(list_intersect(p.files, g.files)) >= len(g.files) // 2 AND len(list_intersect(p.files, g.files)) > 0))
SELECT array_to_string(files, ',') AS files, frequency, 'task' AS kind FROM p UNION ALL SELECT array_to_string(files, ','), frequency, 'co_change' FROM k""")
def r16(spark, d):
    from lodestrata.operators import sessions

    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("session"), (F.col("l_suppkey") % 6).alias("file"), F.lit(True).alias("modified"))
    g = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_set((F.col("n_nationkey") * 3 % 10).cast("long"))).alias("members"), (F.count(F.lit(1)) + F.col("n_regionkey")).alias("co_occurrences"))
    return R.skills(sessions.task_patterns(r), g.select("members", F.size("members").alias("arity"), "co_occurrences")).select(F.array_join("files", ",").alias("files"), "frequency", "kind")


@register("src18_references", "SELECT p_partkey, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest(['src/' || p_size || '.go', 'lib/b' || (p_size % 7) || '.py', 'a/c.md']) AS t FROM part) GROUP BY p_partkey")
def src18(spark, d):
    p = table(spark, d, "part")
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit("See [x](src/"), size, F.lit(".go#L1), `lib/b"), (F.col("p_size") % 7).cast("string"), F.lit(".py` and ./a/c.md or https://e.org/x.html, then src/"), size, F.lit(".go"))
    return SF.references(p.select(F.col("p_partkey").cast("string").alias("path"), text.alias("content"))).filter("target NOT LIKE 'e.org%'").groupBy(F.col("path").cast("long").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
