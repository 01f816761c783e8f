"""Behavioural queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.operators import behavioral as B
from lodestrata.operators.ranking import top_k
from lodestrata.plans.registry import register
from lodestrata.plans.views import BASKETS, MODIFIES, baskets, modifies, table, with_

NOW = "now_ AS (SELECT max(ts) AS as_of FROM m)"
FREQ = with_(MODIFIES, NOW) + """, t AS (SELECT file, count(*) AS total, count_if(ts >= as_of - INTERVAL 30 DAY) AS last_30d, count_if(ts >= as_of - INTERVAL 90 DAY) AS last_90d, count_if(ts >= as_of - INTERVAL 365 DAY) AS last_365d FROM m, now_ GROUP BY file)
SELECT *, round(CAST(row_number() OVER (ORDER BY total, file) - 1 AS DOUBLE) / count(*) OVER () * 100) AS percentile FROM t"""
MONTHS = "mo AS (SELECT file, (epoch_us(as_of) - epoch_us(ts)) // 86400000000 // 30 AS month, sum(added + deleted) AS churn, count(*) AS changes FROM m, now_ GROUP BY ALL)"


@register("a2_change_frequency", FREQ)
def a2(spark, d):
    return B.change_frequency(modifies(spark, d))


@register("a3_monthly_churn", with_(MODIFIES, NOW, MONTHS) + "SELECT file, CAST(month AS BIGINT) AS month, churn, changes FROM mo")
def a3(spark, d):
    return B.monthly_churn(modifies(spark, d))


@register(
    "a4_churn_velocity",
    with_(MODIFIES, NOW, MONTHS)
    + """SELECT file, round(slope, 6) AS slope, round(-slope, 6) AS slope_time_forward, CASE WHEN slope > 0.5 THEN 'increasing' WHEN slope < -0.5 THEN 'decreasing' ELSE 'stable' END AS trend, total_churn, data_points
FROM (SELECT file, coalesce(regr_slope(churn, month), 0) AS slope, sum(churn) AS total_churn, count(*) AS data_points, sum(changes) AS changes FROM mo GROUP BY file) WHERE changes >= 2 AND data_points >= 2""",
)
def a4(spark, d):
    def r(c):  # a slope that rounds to 0 keeps its sign, as in SQL
        return F.when(F.round(c, 6) == 0, F.col(c) * 0.0).otherwise(F.round(c, 6))

    return B.churn_velocity(modifies(spark, d)).withColumns({"slope": r("slope"), "slope_time_forward": r("slope_time_forward")})


BUS = with_(MODIFIES) + """, per AS (SELECT file, author, count(*) AS n FROM m GROUP BY ALL),
t AS (SELECT file, author, n, sum(n) OVER (PARTITION BY file) AS total, sum(n) OVER (PARTITION BY file ORDER BY n DESC, author ROWS UNBOUNDED PRECEDING) AS cum, row_number() OVER (PARTITION BY file ORDER BY n DESC, author) AS rank FROM per)
SELECT file, CAST(coalesce(min(CASE WHEN cum >= 0.8::DOUBLE * total THEN rank END), count(*)) AS INT) AS bus_factor, count(*) AS unique_authors, CAST(max(total) AS BIGINT) AS total_commits, round(max(n) / CAST(max(total) AS DOUBLE), 2) AS top_contributor_share FROM t GROUP BY file"""


@register("a5_bus_factor", BUS)
def a5(spark, d):
    return B.contributor_concentration(modifies(spark, d))


@register("a24_mean_bus_factor", f"SELECT round(avg(bus_factor), 6) AS mean_bus_factor, count_if(bus_factor <= 1) AS single_owner FROM ({BUS})")
def a24(spark, d):
    return B.contributor_concentration(modifies(spark, d)).agg(F.round(F.avg("bus_factor"), 6).alias("mean_bus_factor"), F.count_if(F.col("bus_factor") <= 1).alias("single_owner"))


PAIRS = BASKETS + """, each_ AS (SELECT file, count(*) AS n FROM bk GROUP BY file), tot AS (SELECT count(DISTINCT commit) AS commits FROM bk),
pr AS (SELECT x.a, x.b, x.co AS co_occurrences, x.co / CAST(least(ea.n, eb.n) AS DOUBLE) AS confidence, x.co / CAST(commits AS DOUBLE) AS support
FROM (SELECT p.file AS a, q.file AS b, count(*) AS co FROM bk p JOIN bk q ON p.commit = q.commit AND p.file < q.file GROUP BY ALL HAVING count(*) >= 3) x JOIN each_ ea ON ea.file = x.a JOIN each_ eb ON eb.file = x.b, tot WHERE x.co / CAST(least(ea.n, eb.n) AS DOUBLE) >= {c})"""


def pairs(spark, d, confidence=0.05):
    return B.cochange_pairs(baskets(spark, d), 3, confidence)


@register("a7_cochange_pairs", with_(PAIRS.replace("{c}", "0.05::DOUBLE")) + "SELECT a, b, co_occurrences, round(confidence, 6) AS confidence, round(support, 6) AS support FROM pr")
def a7(spark, d):
    return pairs(spark, d).withColumns({"confidence": F.round("confidence", 6), "support": F.round("support", 6)})


@register(
    "a10_cochange_partners",
    with_(PAIRS.replace("{c}", "0.05::DOUBLE"))
    + "SELECT * FROM (SELECT file, partner, co_occurrences, round(confidence, 6) AS confidence, CAST(row_number() OVER (PARTITION BY file ORDER BY confidence DESC, co_occurrences DESC, partner) AS INT) AS rank FROM (SELECT a AS file, b AS partner, co_occurrences, confidence FROM pr UNION ALL SELECT b, a, co_occurrences, confidence FROM pr)) WHERE rank <= 10",
)
def a10(spark, d):
    return B.cochange_partners(pairs(spark, d)).select("file", "partner", "co_occurrences", F.round("confidence", 6).alias("confidence"), "rank")


@register("a8_cochange_groups")
def a8(spark, d):
    """Greedy: no SQL; tests hold it against a brute-force version. Pairs of the strongest fifth, as the tables' baskets are near complete."""
    return B.cochange_groups(pairs(spark, d, 0.36))


@register("a9_group_cooccurrence", with_(BASKETS) + """, g AS (SELECT a.s_suppkey AS id, unnest([a.s_suppkey, b.s_suppkey]) AS file FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1)
SELECT CAST(id AS BIGINT) AS grp, count(*) AS co_occurrences FROM (SELECT g.id, commit, count(*) AS n FROM g JOIN bk USING (file) GROUP BY ALL) WHERE n = 2 GROUP BY id""")
def a9(spark, d):
    """Each supplier and the next one are a group."""
    s = table(spark, d, "supplier").select("s_suppkey")
    g = s.join(s.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("s_suppkey").alias("next")), "s_suppkey").select(F.col("s_suppkey").alias("grp"), F.array("s_suppkey", "next").alias("members"), F.lit(2).alias("arity"))
    return B.group_cooccurrence(baskets(spark, d), g).join(g, "members").select("grp", "co_occurrences")


@register("a11_doc_coverage", """WITH r AS (SELECT DISTINCT p_partkey % 1000 + 1 AS file FROM part WHERE p_size % 2 = 0)
SELECT s_suppkey AS file, CASE WHEN s_suppkey IN (SELECT file FROM r) THEN 'documented' ELSE 'undocumented' END AS status, s_suppkey IN (SELECT file FROM r) AS has_external_docs, s_acctbal > 0 AS has_doc_comments FROM supplier""")
def a11(spark, d):
    """Parts of an even size are documents on a supplier."""
    files = table(spark, d, "supplier").select(F.col("s_suppkey").alias("file"), F.when(F.col("s_acctbal") > 0, "rust").alias("language"))
    refs = table(spark, d, "part").select(F.col("p_partkey").alias("document"), F.when(F.col("p_size") % 2 == 0, F.col("p_partkey") % 1000 + 1).alias("file"))
    return B.doc_coverage(files, refs)


@register("a12_doc_freshness", with_(MODIFIES) + """, r AS (SELECT l_suppkey AS file, max(CASE WHEN l_quantity >= 50 - l_suppkey % 2 * 30 THEN o_orderdate END) AS doc_ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1 UNION ALL SELECT -1, TIMESTAMP '2000-01-01'),
n AS (SELECT m.file, count_if(m.ts > doc_ts) AS n FROM m JOIN r ON m.file = r.file WHERE doc_ts IS NOT NULL GROUP BY m.file)
SELECT n.file, n.n >= 3 AS is_stale, n.n AS commits_since_doc_update, CASE WHEN n.n >= 3 THEN round(least(1.0::DOUBLE, 0.3::DOUBLE * n.n + 0.7::DOUBLE * coalesce(s_suppkey % 10 / 10, 0)), 3) ELSE 0 END AS staleness_risk FROM n LEFT JOIN supplier ON s_suppkey = n.file AND s_suppkey % 3 > 0""")
def a12(spark, d):
    """A file that never changed (-1) is documented too; a third of the files has no salience."""
    m = modifies(spark, d)
    refs = m.filter(F.col("added") >= 50 - F.col("file") % 2 * 30).select("file", "ts")
    refs = refs.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("file"), F.lit("2000-01-01").cast(refs.schema["ts"].dataType).alias("ts")))
    sal = table(spark, d, "supplier").filter("s_suppkey % 3 > 0").select(F.col("s_suppkey").alias("file"), ((F.col("s_suppkey") % 10) / 10).alias("score"))
    return B.doc_freshness(m, refs, sal)


@register("k1_top_files", f"SELECT file, total, percentile FROM ({FREQ}) ORDER BY total DESC, file LIMIT 20")
def k1(spark, d):
    return top_k(B.change_frequency(modifies(spark, d)).select("file", "total", "percentile"), 20, F.desc("total"), F.col("file"))


@register("k3_top_pairs_of_file", with_(PAIRS.replace("{c}", "0.05::DOUBLE")) + "SELECT a, b, co_occurrences, round(confidence, 6) AS confidence FROM pr WHERE a = 3 OR b = 3 ORDER BY pr.confidence DESC, a, b LIMIT 10")
def k3(spark, d):
    return top_k(pairs(spark, d).filter("a = 3 OR b = 3"), 10, F.desc("confidence"), F.col("a"), F.col("b")).select("a", "b", "co_occurrences", F.round("confidence", 6).alias("confidence"))


@register("j10_pairs_in_commits", with_(MODIFIES) + "SELECT p.file AS a, q.file AS b, count(*) AS co_occurrences FROM (SELECT DISTINCT commit, file FROM m) p JOIN (SELECT DISTINCT commit, file FROM m) q ON p.commit = q.commit AND p.file < q.file GROUP BY ALL HAVING count(*) >= 2")
def j10(spark, d):
    return B.cochange_pairs(modifies(spark, d), 2, 0.0).select("a", "b", "co_occurrences")


@register("w3_cumulative_share", with_(MODIFIES) + """SELECT file, author, n, CAST(sum(n) OVER (PARTITION BY file ORDER BY n DESC, author ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY file) AS DOUBLE) AS share FROM (SELECT file, author, count(*) AS n FROM m GROUP BY ALL)""")
def w3(spark, d):
    w = W.partitionBy("file")
    g = modifies(spark, d).groupBy("file", "author").agg(F.count(F.lit(1)).alias("n"))
    return g.select("file", "author", "n", (F.sum("n").over(w.orderBy(F.desc("n"), "author").rowsBetween(W.unboundedPreceding, 0)) / F.sum("n").over(w)).alias("share"))


@register("j8_commit_author", "SELECT o_orderkey AS commit, c_name AS author FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def j8(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer").filter("c_acctbal > 0")
    return o.join(c, o.o_custkey == c.c_custkey, "left").select(F.col("o_orderkey").alias("commit"), F.col("c_name").alias("author"))
