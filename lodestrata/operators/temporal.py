"""Trends over snapshots, snapshot differences, aliases and incremental selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def trend_class(slope: Column) -> Column:
    return F.when(slope > 0.01, "Rising").when(slope < -0.01, "Falling").otherwise("Stable")


def trends(history: DataFrame, keep: int = 10) -> DataFrame:
    """History (node, at, score): of each node's last `keep` scores, in order, the slope over their index (0 for one score), its
    class, and the latest score, to 4 places."""
    last = history.withColumn("back", F.row_number().over(W.partitionBy("node").orderBy(F.desc("at")))).filter(F.col("back") <= keep)
    g = last.groupBy("node").agg(
        F.coalesce(F.regr_slope("score", -F.col("back")), F.lit(0.0)).alias("slope"),
        F.count(F.lit(1)).alias("snapshots"),
        F.max_by("score", F.col("at")).alias("current_score"),
        F.transform(F.array_sort(F.collect_list(F.struct("at", "score"))), lambda x: x["score"]).alias("score_history"),
    )
    return g.select("node", F.round("slope", 4).alias("slope"), trend_class(F.col("slope")).alias("trend"), F.round("current_score", 4).alias("current_score"), "score_history", "snapshots")


def difference(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """(change, id): what only one snapshot has. Two anti-joins."""
    a, b = old.select(key).distinct(), new.select(key).distinct()
    return b.join(a, key, "left_anti").select(F.lit("added").alias("change"), key).unionByName(a.join(b, key, "left_anti").select(F.lit("removed").alias("change"), key))


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of rows of one kind whose spans overlap (a: kind, o; b: kind, n; spans of whole numbers: start, end), each once. An
    equi-join on kind and block, the blocks as long as the longer span of a pair, to the next power of two: a span lies in two of its
    own, and of these or longer ones, as far as there are spans of that length, in two for each power."""
    def size(s: str) -> Column:
        return F.length(F.bin(F.col(f"{s}.end") - F.col(f"{s}.start") - 1))

    def blocks(x: DataFrame, s: str, sizes: Column) -> DataFrame:
        x = x.withColumn("size", F.explode(sizes))
        return x.withColumn("block", F.explode(F.expr(f"sequence(shiftright({s}.start, size), shiftright({s}.end - 1, size))")))

    def from_own(x: DataFrame, s: str, sizes: DataFrame, least: int) -> DataFrame:
        return blocks(x.crossJoin(F.broadcast(sizes)), s, F.filter("sizes", lambda z: z >= size(s) + least)).drop("sizes")  # one row

    a, b = a.filter("o.end > o.start"), b.filter("n.end > n.start")
    sizes_a, sizes_b = a.agg(F.collect_set(size("o")).alias("sizes")), b.agg(F.collect_set(size("n")).alias("sizes"))
    longer_a = blocks(a, "o", F.array(size("o"))).join(from_own(b, "n", sizes_a, 0), ["kind", "size", "block"])
    longer_b = from_own(a, "o", sizes_b, 1).join(blocks(b, "n", F.array(size("n"))), ["kind", "size", "block"])
    at = F.expr("shiftright(greatest(o.start, n.start), size)")
    return longer_a.unionByName(longer_b).filter((F.col("block") == at) & (F.least("o.end", "n.end") > F.greatest("o.start", "n.start"))).drop("size", "block")


def definitions_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Definitions (name, kind, start, end): added, removed, changed, or renamed where a removed one's span overlaps an added
    one's of the same kind (the greatest overlap, then the name)."""
    j = old.select("name", "kind", F.struct("start", "end").alias("o")).join(new.select("name", "kind", F.struct("start", "end").alias("n")), ["name", "kind"], "full")
    gone, come = j.filter("n IS NULL"), j.filter("o IS NULL")
    c = overlaps(gone.select("kind", F.col("name").alias("old_name"), "o"), come.select("kind", "name", "n")).withColumn("over", F.least("o.end", "n.end") - F.greatest("o.start", "n.start"))
    best = c.withColumn("r", F.row_number().over(W.partitionBy("old_name", "kind").orderBy(F.desc("over"), "name"))).withColumn("q", F.row_number().over(W.partitionBy("name", "kind").orderBy(F.desc("over"), "old_name"))).filter("r = 1 AND q = 1")
    renamed = best.select(F.lit("renamed").alias("change"), "name", "kind", "old_name")
    rest_gone = gone.join(renamed.select(F.col("old_name").alias("name"), "kind"), ["name", "kind"], "left_anti").select(F.lit("removed").alias("change"), "name", "kind", F.lit(None).cast("string").alias("old_name"))
    rest_come = come.join(renamed.select("name", "kind"), ["name", "kind"], "left_anti").select(F.lit("added").alias("change"), "name", "kind", F.lit(None).cast("string").alias("old_name"))
    same = j.filter("o IS NOT NULL AND n IS NOT NULL AND o != n").select(F.lit("changed").alias("change"), "name", "kind", F.lit(None).cast("string").alias("old_name"))
    return renamed.unionByName(rest_gone).unionByName(rest_come).unionByName(same)


def resolve_aliases(aliases: DataFrame, hops: int = 10) -> DataFrame:
    """I8: aliases (old, new): each old name's last successor within so many hops. Pointer doubling: jumps of 1, 2, 4 ... hops
    are joined with themselves, and those that the bits of `hops` name follow each other."""
    def then(x: DataFrame, y: DataFrame) -> DataFrame:
        y = y.select(F.col("old").alias("new"), F.col("new").alias("to"), F.col("n").alias("more"))
        return x.join(y, "new", "left").select("old", F.coalesce("to", "new").alias("new"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))

    jump, at = aliases.select("old", "new", F.lit(1).alias("n")), None
    while hops:
        if hops & 1:
            at = jump if at is None else then(at, jump)
        hops >>= 1
        jump = then(jump, jump) if hops else jump
    return at.select("old", F.col("new").alias("current"), F.col("n").alias("hops"))


def changed(current: DataFrame, stored: DataFrame, key: str = "name", digest: str = "content_hash") -> DataFrame:
    """I4, SRC16: rows that are new or whose hash differs from what is stored (null differs from all but null)."""
    s = stored.select(key, F.col(digest).alias("__old"), F.lit(True).alias("__there"))
    return current.join(s, key, "left").filter(F.col("__there").isNull() | ~F.col(digest).eqNullSafe(F.col("__old"))).drop("__old", "__there")


def invalidated(analyses: DataFrame, changed_nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Analyses left when those of changed nodes, and of nodes on an edge with one, are cleared."""
    c = changed_nodes.select("node_id").distinct()
    edges = members.join(c, "node_id", "left_semi").select("hyperedge_id").distinct()
    near = members.join(edges, "hyperedge_id", "left_semi").select("node_id").unionByName(c).distinct()
    return analyses.join(near, "node_id", "left_anti")
