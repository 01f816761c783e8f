"""The driver's tables seen as a repository: commits, files, imports, calls, documents, sessions. The same views in SQL stand in
front of each oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def modifies(spark: SparkSession, d: str) -> DataFrame:
    """(commit, file, author, ts, added, deleted): an order is a commit by its customer, its lines change suppliers."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_discount")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_orderkey").alias("commit"), F.col("l_suppkey").alias("file"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("ts"), F.col("l_quantity").alias("added"), F.round(F.col("l_discount") * 100).alias("deleted")
    )


MODIFIES = "m AS (SELECT o_orderkey AS commit, l_suppkey AS file, o_custkey AS author, o_orderdate AS ts, l_quantity AS added, round(l_discount * 100) AS deleted FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def baskets(spark: SparkSession, d: str) -> DataFrame:
    """(commit, file): a customer's suppliers as one commit, not distinct."""
    return modifies(spark, d).select(F.col("author").alias("commit"), "file")


BASKETS = MODIFIES + ", bk AS (SELECT DISTINCT author AS commit, file FROM m)"


def imports(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, weight): customers' nation to suppliers' nation, by revenue's share, to 6 places."""
    m = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    j = m.join(o, m.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey).join(s, F.col("l_suppkey") == s.s_suppkey)
    g = j.groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    top = g.agg(F.max("n").alias("top"))
    # only relations over three tenths of the strongest, so that the graph isn't complete
    return g.crossJoin(F.broadcast(top)).filter("n * 10 > top * 3").select("src", "dst", F.round(F.col("n") / F.col("top"), 6).alias("weight"))


IMPORTS = """im0 AS (SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
im AS (SELECT src, dst, round(n / (SELECT max(n) FROM im0), 6) AS weight FROM im0 WHERE n * 10 > (SELECT max(n) FROM im0) * 3)"""


def calls(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, weight): suppliers that follow each other in an order's lines, each pair once; weight 0.5 to 1 by how often."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice")
    from pyspark.sql import Window as W

    nxt = F.lead("l_suppkey").over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice"))
    p = li.select(F.col("l_suppkey").alias("src"), nxt.alias("dst")).filter("dst IS NOT NULL AND src != dst")
    g = p.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return g.select("src", "dst", F.least(F.lit(1.0), 0.5 + F.col("n") / 20).alias("weight"))


CALLS = """ca AS (SELECT src, dst, least(1.0::DOUBLE, 0.5::DOUBLE + count(*) / 20) AS weight FROM (SELECT l_suppkey AS src, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst HAVING count(*) >= 2)"""


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"
