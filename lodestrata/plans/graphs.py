"""Graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import centrality as C
from lodestrata.operators import community as K
from lodestrata.operators import graph as G
from lodestrata.operators import salience as S
from lodestrata.operators import temporal as T
from lodestrata.plans.registry import register
from lodestrata.plans.views import CALLS, IMPORTS, calls, imports, table, with_

@register("gr1_call_edges", with_(CALLS) + "SELECT * FROM ca")
def gr1(spark, d):
    return calls(spark, d)


@register("gr1_import_edges", with_(IMPORTS) + "SELECT * FROM im")
def gr1b(spark, d):
    return imports(spark, d)


@register("gr5_degrees", with_(CALLS) + "SELECT node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT src AS node, 0 AS i, 1 AS o FROM ca UNION ALL SELECT dst, 1, 0 FROM ca) GROUP BY node")
def gr5(spark, d):
    return G.degrees(calls(spark, d))


def _pagerank(e: str, k: int = 100) -> str:
    """PageRank over the edges e, each round a table."""
    out = f"v AS (SELECT src AS node FROM {e} UNION SELECT dst FROM {e}), o AS MATERIALIZED (SELECT node, count({e}.src) AS out FROM v LEFT JOIN {e} ON {e}.src = node GROUP BY node), c AS MATERIALIZED (SELECT count(*) AS n FROM v), p0 AS (SELECT node, out, 1.0::DOUBLE / n AS rank FROM o, c)"
    for i in range(k):
        out += f""",
s{i} AS (SELECT dst, sum(rank / out) AS got FROM {e} JOIN p{i} ON node = src GROUP BY dst),
p{i + 1} AS MATERIALIZED (SELECT node, out, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(got, 0) + (SELECT coalesce(sum(rank), 0) FROM p{i} WHERE out = 0) / n) AS rank FROM p{i} LEFT JOIN s{i} ON dst = node, c)"""
    return out + f" SELECT node, round(rank, 6) AS rank FROM p{k}"


@register("gr2_pagerank_imports", with_(IMPORTS.replace("im AS (", "im AS MATERIALIZED (")) + ", " + _pagerank("im"))
def gr2(spark, d):
    return C.pagerank(imports(spark, d)).withColumn("rank", F.round("rank", 6))


@register("gr2_pagerank_calls", with_(CALLS.replace("ca AS (", "ca AS MATERIALIZED (")) + ", " + _pagerank("ca"))
def gr2b(spark, d):
    return C.pagerank(calls(spark, d)).withColumn("rank", F.round("rank", 6))


def _hits(k: int) -> str:
    out = "v AS MATERIALIZED (SELECT src AS node FROM im UNION SELECT dst FROM im), h0 AS MATERIALIZED (SELECT node, 1 / sqrt((SELECT count(*) FROM v)) AS hub, 1 / sqrt((SELECT count(*) FROM v)) AS aut FROM v)"
    for i in range(k):
        out += f""",
r{i} AS MATERIALIZED (SELECT v.node, coalesce(x.h, 0) AS hub, coalesce(y.a, 0) AS aut FROM v LEFT JOIN (SELECT im.src AS node, sum(aut) AS h FROM im JOIN h{i} q ON q.node = im.dst GROUP BY 1) x ON x.node = v.node LEFT JOIN (SELECT im.dst AS node, sum(hub) AS a FROM im JOIN h{i} q ON q.node = im.src GROUP BY 1) y ON y.node = v.node),
h{i + 1} AS MATERIALIZED (SELECT node, hub / (SELECT sqrt(sum(hub * hub)) FROM r{i}) AS hub, aut / (SELECT sqrt(sum(aut * aut)) FROM r{i}) AS aut FROM r{i})"""
    return out


@register("gr4_hits_imports", with_(IMPORTS.replace("im AS (", "im AS MATERIALIZED ("), _hits(100)) + "SELECT node, round(hub / (SELECT max(hub) FROM h100), 6) AS hub, round(aut / (SELECT max(aut) FROM h100), 6) AS authority FROM h100")
def gr4(spark, d):
    return C.hits(imports(spark, d)).withColumns({"hub": F.round("hub", 6), "authority": F.round("authority", 6)})


@register("gr3_betweenness", with_(CALLS.replace("ca AS (", "ca AS MATERIALIZED (")) + """, e AS MATERIALIZED (SELECT DISTINCT src, dst FROM ca), v AS MATERIALIZED (SELECT src AS node FROM e UNION SELECT dst FROM e),
w AS (SELECT node AS s, node, 0 AS d FROM v UNION SELECT w.s, e.dst, w.d + 1 FROM w JOIN e ON e.src = w.node WHERE w.d < {k}),
dist AS MATERIALIZED (SELECT s, node, min(d) AS d FROM w GROUP BY s, node),
g0 AS MATERIALIZED (SELECT s, node, 1.0::DOUBLE AS sigma FROM dist WHERE d = 0)""".replace("{k}", "12") + "".join(f""",
g{k} AS MATERIALIZED (SELECT p.s, e.dst AS node, sum(p.sigma) AS sigma FROM g{k - 1} p JOIN e ON e.src = p.node JOIN dist q ON q.s = p.s AND q.node = e.dst AND q.d = {k} GROUP BY 1, 2)""" for k in range(1, 13)) + """,
b12 AS (SELECT s, node, 0.0::DOUBLE AS delta FROM g12)""" + "".join(f""",
b{k} AS MATERIALIZED (SELECT p.s, p.node, coalesce(x.delta, 0) AS delta FROM g{k} p LEFT JOIN (SELECT q.s, e.src AS node, sum(o.sigma / q.sigma * (1 + c.delta)) AS delta FROM g{k + 1} q JOIN b{k + 1} c ON c.s = q.s AND c.node = q.node JOIN e ON e.dst = q.node JOIN g{k} o ON o.s = q.s AND o.node = e.src GROUP BY 1, 2) x ON x.s = p.s AND x.node = p.node)""" for k in range(11, 0, -1)) + ", t AS MATERIALIZED (SELECT node, sum(delta) AS b FROM (" + " UNION ALL ".join(f"SELECT node, delta FROM b{k}" for k in range(1, 13)) + ") GROUP BY node)" + """
SELECT v.node, round(CASE WHEN (SELECT max(b) FROM t) > 0 THEN coalesce(b, 0) / (SELECT max(b) FROM t) ELSE 0 END, 6) AS betweenness FROM v LEFT JOIN t USING (node)""")
def gr3(spark, d):
    """The SQL goes 12 levels deep, which is further than any two nodes of the tables are apart."""
    return C.betweenness(calls(spark, d)).withColumn("betweenness", F.round("betweenness", 6))


@register("w2_degree_rank", with_(CALLS) + "SELECT node, w, CAST(row_number() OVER (ORDER BY w DESC, node) AS INT) AS rank FROM (SELECT dst AS node, round(sum(weight), 6) AS w FROM ca GROUP BY dst)")
def w2(spark, d):
    c = calls(spark, d)
    return C.ranked(c.groupBy(F.col("dst").alias("node")).agg(F.round(F.sum("weight"), 6).alias("w")), "w", c).select("node", "w", "rank")


REACH = """, q AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM {e} {back})),
b AS (SELECT CAST({s} AS BIGINT) AS node, 0 AS depth UNION SELECT q.dst, depth + 1 FROM b JOIN q ON q.src = b.node WHERE depth < {k})
SELECT node, CAST(min(depth) AS INT) AS depth FROM b GROUP BY node"""


@register("gr14_bfs_depth", with_(IMPORTS) + REACH.format(e="im", back="", s=1, k=3))
def gr14(spark, d):
    return G.bfs(imports(spark, d), spark.range(1, 2).withColumnRenamed("id", "node"), 3)


@register("g5_neighborhood", with_(CALLS) + REACH.format(e="ca", back="UNION ALL SELECT dst, src FROM ca", s=7, k=2))
def g5(spark, d):
    return G.neighborhood(calls(spark, d), spark.range(7, 8).withColumnRenamed("id", "node"), 2)


@register("g_filters", with_(CALLS) + "SELECT src, dst, weight FROM ca JOIN supplier a ON a.s_suppkey = src JOIN supplier b ON b.s_suppkey = dst WHERE a.s_nationkey < 12 AND b.s_nationkey < 12 AND a.s_acctbal >= 1000 AND b.s_acctbal >= 1000 AND a.s_name LIKE 'Supplier%' AND b.s_name LIKE 'Supplier%'")
def g_filters(spark, d):
    """G2, G3, G4, G6, G7 together."""
    s = table(spark, d, "supplier")
    nodes = s.select(F.col("s_suppkey").alias("node"), F.when(F.col("s_nationkey") < 12, "File").otherwise("Module").alias("kind"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("score"))
    keep = G.all_of([G.of_kind(nodes, ["File"]), G.of_module(nodes, "Supplier"), G.salient(nodes, 1000)], spark)
    return G.within(calls(spark, d), keep)


@register("gr8_file_projection", with_(IMPORTS, CALLS) + "SELECT src, dst, weight FROM im WHERE src <> dst UNION ALL SELECT a.s_nationkey::BIGINT, b.s_nationkey::BIGINT, weight FROM ca JOIN supplier a ON a.s_suppkey = src JOIN supplier b ON b.s_suppkey = dst WHERE a.s_nationkey <> b.s_nationkey")
def gr8(spark, d):
    parent = table(spark, d, "supplier").select(F.col("s_suppkey").alias("child"), F.col("s_nationkey").cast("long").alias("file"))
    return K.file_projection(imports(spark, d), calls(spark, d), parent)


@register("gr9_louvain")
def gr9(spark, d):
    """Rows only: rounds of moves whose number isn't known; tests hold it against planted communities, the modularity of a
    sequential version and its own steps as joins."""
    return K.communities(calls(spark, d))


REGION = "rg AS (SELECT s_suppkey AS node, n_regionkey::BIGINT AS community, n_name AS dir FROM supplier JOIN nation ON n_nationkey = s_nationkey)"


def regions(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("node"), F.col("n_regionkey").cast("long").alias("community"), F.col("n_name").alias("dir"))


@register("gr10_modularity", with_(CALLS, REGION) + """, j AS (SELECT a.community AS c1, b.community AS c2, weight FROM ca JOIN rg a ON a.node = src JOIN rg b ON b.node = dst)
SELECT community, round(sum(i), 6) AS internal, round(sum(w), 6) AS degree, round(sum(i) / (SELECT sum(weight) FROM ca) - power(sum(w) / (2 * (SELECT sum(weight) FROM ca)), 2), 6) AS contribution FROM (SELECT c1 AS community, weight AS w, CASE WHEN c1 = c2 THEN weight ELSE 0 END AS i FROM j UNION ALL SELECT c2, weight, 0 FROM j) GROUP BY community""")
def gr10(spark, d):
    return K.modularity(calls(spark, d), regions(spark, d))


@register("a22_coupling", with_(CALLS, REGION) + "SELECT count(*) AS total_edges, count_if(a.community <> b.community) AS cross_community_edges, round(count_if(a.community <> b.community) / CAST(count(*) AS DOUBLE), 4) AS coupling_ratio FROM ca JOIN rg a ON a.node = src JOIN rg b ON b.node = dst")
def a22(spark, d):
    return K.coupling(calls(spark, d), regions(spark, d))


@register("a29_directory_alignment", with_(REGION) + "SELECT node AS file, community, dir, count(*) OVER (PARTITION BY community, dir) / CAST(count(*) OVER (PARTITION BY community) AS DOUBLE) >= 0.5 AS directory_aligned FROM rg")
def a29(spark, d):
    return K.directory_alignment(regions(spark, d).withColumnRenamed("node", "file"))


FEATURES = """f AS (SELECT s_suppkey AS node, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 100 / 100 END AS pagerank, s_suppkey % 7 / 7 AS betweenness, s_suppkey % 5 / 5 AS authority, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey % 101 END AS cp, CASE WHEN s_suppkey % 6 > 0 THEN s_suppkey % 6 END AS bf, s_suppkey % 50 AS code_size, s_suppkey % 2 AS test_presence FROM supplier),
g AS (SELECT node, coalesce(pagerank, 0) AS pagerank, betweenness, authority, coalesce(cp, 0) / 100 AS cf, CASE WHEN bf IS NULL THEN 0 WHEN bf <= 1 THEN 1 ELSE 1.0::DOUBLE / bf END AS br, code_size / (SELECT greatest(1, max(code_size)) FROM f) AS sz, test_presence AS tp FROM f)"""


def features(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        k.alias("node"), F.when(k % 3 > 0, k % 100 / 100).alias("pagerank"), (k % 7 / 7).alias("betweenness"), (k % 5 / 5).alias("authority"), F.when(k % 4 > 0, k % 101).alias("change_percentile"), F.when(k % 6 > 0, k % 6).alias("bus_factor"), (k % 50).alias("code_size"), (k % 2).alias("test_presence")
    )


SALIENCE = with_(FEATURES) + """SELECT node, round(0.30::DOUBLE * pagerank + 0.15::DOUBLE * betweenness + 0.15::DOUBLE * authority + 0.15::DOUBLE * cf + 0.10::DOUBLE * br + 0.05::DOUBLE * sz + 0.10::DOUBLE * tp, 6) AS score,
CASE WHEN pagerank > 0.5 AND br >= 0.99 THEN 'CriticalSilo' WHEN pagerank > 0.5 AND cf > 0.5 THEN 'HotCritical' WHEN pagerank > 0.5 THEN 'FoundationalStable' WHEN cf > 0.5 THEN 'ActiveLocalized' ELSE 'Background' END AS classification FROM g"""


@register("gr6_salience", SALIENCE)
def gr6(spark, d):
    return S.salience(features(spark, d)).select("node", "score", "classification")


@register("gr11_stability", with_(FEATURES) + """SELECT node, cls AS classification, CASE WHEN node % 3 = 1 AND cls NOT IN ('ActiveCritical', 'Volatile') THEN 'Declining' ELSE cls END AS with_trend FROM (SELECT node, CASE WHEN pagerank > 0.5 AND cf <= 0.5 THEN 'StableCore' WHEN pagerank > 0.5 THEN 'ActiveCritical' WHEN cf <= 0.5 THEN 'ReliableBackground' ELSE 'Volatile' END AS cls FROM g)""")
def gr11(spark, d):
    f = S.salience(features(spark, d)).withColumn("classification", S.stability_class(F.col("pagerank"), F.col("change_frequency")))
    trend = F.when(F.col("node") % 3 == 1, "Falling").otherwise("Stable")
    return f.select("node", "classification", S.declining(F.col("classification"), trend).alias("with_trend"))


@register("n24_risk_scores", with_(FEATURES) + """SELECT node, round(least(1.0::DOUBLE, 0.4::DOUBLE * coalesce(pagerank, 0) + CASE WHEN bf <= 1 THEN 0.3::DOUBLE WHEN bf <= 2 THEN 0.15 ELSE 0 END + CASE WHEN cp > 20 THEN 0.3::DOUBLE WHEN cp > 10 THEN 0.2 WHEN cp > 5 THEN 0.1 ELSE 0 END), 6) AS gate_score,
CASE WHEN pts <= 1 THEN 'low' WHEN pts <= 3 THEN 'medium' WHEN pts <= 5 THEN 'high' ELSE 'critical' END AS risk_level FROM (SELECT *, CASE WHEN pagerank > 0.7 THEN 3 WHEN pagerank > 0.4 THEN 2 WHEN pagerank > 0.2 THEN 1 ELSE 0 END + CASE WHEN bf <= 1 THEN 2 ELSE 0 END + CASE WHEN cp > 20 THEN 2 WHEN cp > 10 THEN 1 ELSE 0 END AS pts FROM f)""")
def n24(spark, d):
    a = (F.col("pagerank"), F.col("bus_factor"), F.col("change_percentile"))
    return features(spark, d).select("node", S.gate_score(*a).alias("gate_score"), S.risk_level(*a).alias("risk_level"))


HIST = "hs AS (SELECT user_id AS node, date_trunc('day', ts) AS day_, avg(value) AS score FROM events GROUP BY ALL)"


@register("w4_score_trend", with_(HIST) + """, l AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY day_ DESC) AS back FROM hs)
SELECT node, round(coalesce(regr_slope(score, -back), 0), 4) AS slope, CASE WHEN coalesce(regr_slope(score, -back), 0) > 0.01 THEN 'Rising' WHEN coalesce(regr_slope(score, -back), 0) < -0.01 THEN 'Falling' ELSE 'Stable' END AS trend, round(arg_max(score, day_), 4) AS current_score, count(*) AS snapshots FROM l WHERE back <= 10 GROUP BY node""")
def w4(spark, d):
    h = table(spark, d, "events").groupBy(F.col("user_id").alias("node"), F.date_trunc("day", "ts").alias("at")).agg(F.avg("value").alias("score"))
    return T.trends(h).select("node", "slope", "trend", "current_score", "snapshots")


@register("u2_snapshot_diff", "WITH o AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderdate < TIMESTAMP '1998-04-16'), n AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderdate >= TIMESTAMP '1998-04-16') SELECT 'added' AS change, id FROM n WHERE id NOT IN (SELECT id FROM o) UNION ALL SELECT 'removed', id FROM o WHERE id NOT IN (SELECT id FROM n)")
def u2(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderdate")
    return T.difference(o.filter("o_orderdate < '1998-04-16'"), o.filter("o_orderdate >= '1998-04-16'"))


@register("i8_alias_chain", """WITH RECURSIVE a AS (SELECT p_partkey AS old, p_partkey + 1 AS new FROM part WHERE p_partkey % 5 > 0), r AS (SELECT old, new, 1 AS hops FROM a UNION ALL SELECT r.old, a.new, hops + 1 FROM r JOIN a ON a.old = r.new WHERE hops < 10)
SELECT old, arg_max(new, hops) AS current, CAST(max(hops) AS INT) AS hops FROM r GROUP BY old""")
def i8(spark, d):
    p = table(spark, d, "part").filter("p_partkey % 5 > 0")
    return T.resolve_aliases(p.select(F.col("p_partkey").alias("old"), (F.col("p_partkey") + 1).alias("new")))


@register("i4_changed_rows", "SELECT o_orderkey AS id, o_orderstatus AS content_hash FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0")
def i4(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("content_hash"))
    stored = o.filter("id % 3 = 0").withColumn("content_hash", F.when(F.col("id") % 2 == 0, F.lit("?")).otherwise(F.col("content_hash")))
    return T.changed(o, stored, "id")
