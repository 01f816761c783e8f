"""Behavioural statistics over changes: (commit, file, author, ts, added, deleted), one row a file of a commit.

Times are relative to as_of, a one-row frame with the column as_of (by default the last change), never to the clock.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.operators.graph import components
from lodestrata.operators.ranking import numbered


def last_change(changes: DataFrame) -> DataFrame:
    return changes.agg(F.max("ts").alias("as_of"))


def _with_now(changes: DataFrame, as_of: DataFrame | None) -> DataFrame:
    return changes.crossJoin(F.broadcast(as_of if as_of is not None else last_change(changes)))  # one row


def change_frequency(changes: DataFrame, as_of: DataFrame | None = None) -> DataFrame:
    """Changes of each file in all and in the last 30, 90 and 365 days (both ends in), and the file's percentile:
    rank from 0 by total, ties by name, over the number of files, in percent, rounded half up."""
    c = _with_now(changes, as_of)
    within = [F.count_if(F.col("ts") >= F.col("as_of") - F.expr(f"INTERVAL {n} DAYS")).alias(f"last_{n}d") for n in (30, 90, 365)]
    totals = c.groupBy("file").agg(F.count(F.lit(1)).alias("total"), *within)
    ranked = numbered(totals, "rank", F.col("total"), F.col("file"))
    n = ranked.agg(F.count(F.lit(1)).alias("n_files"))
    return ranked.crossJoin(F.broadcast(n)).select("file", "total", "last_30d", "last_90d", "last_365d", F.round((F.col("rank") - 1) / F.col("n_files") * 100).alias("percentile"))


def monthly_churn(changes: DataFrame, as_of: DataFrame | None = None) -> DataFrame:
    """A3: lines added and deleted by file and month back from as_of, a month being 30 whole days."""
    c = _with_now(changes, as_of)
    days = F.expr("(unix_micros(CAST(as_of AS TIMESTAMP)) - unix_micros(CAST(ts AS TIMESTAMP))) div 86400000000")
    return c.groupBy("file", F.floor(days / 30).alias("month")).agg(F.sum(F.col("added") + F.col("deleted")).alias("churn"), F.count(F.lit(1)).alias("changes"))


def whole_slope(y: str, x: str) -> Column:
    """The least-squares slope of y over x, an aggregate; 0 where x doesn't vary. Sums of whole numbers are exact, so a slope of just
    0 or 0.5 comes out as that, whatever the order of the rows; others, and sums over 2^53, are left to regr_slope."""
    told = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(told, F.col(x)).cast("double"), F.when(told, F.col(y)).cast("double")
    n, sa, sb, sab, saa = F.count(a), F.sum(a), F.sum(b), F.sum(a * b), F.sum(a * a)
    large = F.greatest(n * F.sum(F.abs(a * b)), F.sum(F.abs(a)) * F.sum(F.abs(b)), n * saa, sa * sa)
    exact = F.every((a == F.floor(a)) & (b == F.floor(b))) & (large < 2.0**53)
    return F.coalesce(F.when(exact, F.try_divide(n * sab - sa * sb, n * saa - sa * sa)).otherwise(F.regr_slope(y, x)), F.lit(0.0))


def churn_velocity(changes: DataFrame, as_of: DataFrame | None = None) -> DataFrame:
    """A4: least-squares slope of monthly churn over months back. Files with under two changes or months have none; no
    variance gives 0. Over 0.5 "increasing", under -0.5 "decreasing", else "stable": as months count backwards, a positive
    slope means that older months saw more churn; slope_time_forward has the other sign."""
    m = monthly_churn(changes, as_of).groupBy("file").agg(
        whole_slope("churn", "month").alias("slope"), F.sum("churn").alias("total_churn"), F.count(F.lit(1)).alias("data_points"), F.sum("changes").alias("changes")
    )
    m = m.filter("changes >= 2 AND data_points >= 2")
    trend = F.when(F.col("slope") > 0.5, "increasing").when(F.col("slope") < -0.5, "decreasing").otherwise("stable")
    return m.select("file", "slope", (-F.col("slope")).alias("slope_time_forward"), trend.alias("trend"), "total_churn", "data_points")


def contributor_concentration(changes: DataFrame) -> DataFrame:
    """The fewest authors, by commits, that made 80 % of a file's changes, all changes counting (those without an
    author too); all authors where they fall short. Share of the busiest, to 2 places."""
    per = changes.groupBy("file", "author").agg(F.count(F.lit(1)).alias("n"))
    every = W.partitionBy("file")
    order = every.orderBy(F.desc("n"), "author")
    per = per.withColumn("total", F.sum("n").over(every)).filter("author IS NOT NULL")
    per = per.withColumn("cum", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("rank", F.row_number().over(order))
    return per.groupBy("file").agg(
        F.coalesce(F.min(F.when(F.col("cum") >= 0.8 * F.col("total"), F.col("rank"))), F.count(F.lit(1)).cast("int")).alias("bus_factor"),
        F.count(F.lit(1)).alias("unique_authors"),
        F.max("total").alias("total_commits"),
        F.round(F.max("n") / F.max("total"), 2).alias("top_contributor_share"),
    )


#: Rows to be made distinct, and pairs to be counted, by one task: what a task holds doesn't grow with the input.
ROWS, PAIRS = 500_000, 2_000_000


def _sizes(changes: DataFrame) -> tuple[int, int]:
    """The number of changes, and of pairs of changes of the same commit."""
    n = changes.groupBy("commit").agg(F.count(F.lit(1)).alias("n"))
    rows, pairs = n.agg(F.sum("n"), F.sum(F.expr("n * (n - 1) div 2"))).first()
    return rows or 0, pairs or 0


def _basket(changes: DataFrame, rows: int) -> DataFrame:
    """(commit, file), each once. The number of tasks is given, as by size alone it would be that of the cores for long."""
    return changes.select("commit", "file").repartition(rows // ROWS + 1, "commit").distinct()


def cochange_pairs(changes: DataFrame, min_count: int = 3, min_confidence: float = 0.3, most_files: int | None = None) -> DataFrame:
    """Pairs of files in the same commits: how many, that over the lesser file's commits (confidence) and over all
    commits (support). most_files leaves out commits of more files (none by default), whose pairs grow with their square."""
    rows, most = _sizes(changes)
    basket = _basket(changes, rows)
    if most_files is not None:
        basket = basket.withColumn("__k", F.count(F.lit(1)).over(W.partitionBy("commit"))).filter(F.col("__k") <= most_files).drop("__k")
    # one shuffle by commit gives the pairs, then counts are combined before the second; commits that begin alike come together, where
    # counts combine best, and those of very many files in pieces
    files = basket.groupBy("commit").agg(F.array_sort(F.collect_list("file")).alias("files"))
    files = files.withColumn("k", F.size("files").cast("long")).withColumn("pieces", F.expr(f"k * (k - 1) div {PAIRS} + 1")).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    files = files.repartitionByRange(most // PAIRS + 1, F.element_at("files", 1), "commit", "piece")
    left = files.select("files", "pieces", "piece", F.posexplode("files").alias("i", "a")).filter("i % pieces = piece")
    pairs = left.select("a", F.explode(F.slice("files", F.col("i") + 2, F.size("files"))).alias("b"))
    n = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("co")).filter(F.col("co") >= min_count)
    each = basket.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    total = basket.select("commit").distinct().agg(F.count(F.lit(1)).alias("commits"))
    j = n.join(each.select(F.col("file").alias("a"), F.col("n").alias("n_a")), "a").join(each.select(F.col("file").alias("b"), F.col("n").alias("n_b")), "b").crossJoin(F.broadcast(total))
    j = j.select("a", "b", F.col("co").alias("co_occurrences"), (F.col("co") / F.least("n_a", "n_b")).alias("confidence"), (F.col("co") / F.col("commits")).alias("support"))
    return j.filter(F.col("confidence") >= min_confidence)


def cochange_partners(pairs: DataFrame, k: int = 10) -> DataFrame:
    """A10: each file's k best partners by confidence, then count, then name."""
    both = pairs.select(F.col("a").alias("file"), F.col("b").alias("partner"), "co_occurrences", "confidence", "support").unionByName(
        pairs.select(F.col("b").alias("file"), F.col("a").alias("partner"), "co_occurrences", "confidence", "support")
    )
    order = W.partitionBy("file").orderBy(F.desc("confidence"), F.desc("co_occurrences"), "partner")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


GROUPS = "members array<long>,arity int,confidence double"


def grow_groups(pdf: pd.DataFrame, most: int = 8, loss: float = 0.05) -> pd.DataFrame:
    """A8 in one component: seeds by confidence (ties by names) grow by the neighbour common to all members whose weakest link
    is strongest, as long as the group's least confidence falls by no more than `loss`; pairs inside a group are used up."""
    link = {(a, b): c for a, b, c in zip(pdf["a"], pdf["b"], pdf["confidence"])}
    near: dict = {}
    for (a, b), c in link.items():
        near.setdefault(a, {})[b] = c
        near.setdefault(b, {})[a] = c
    used, out = set(), []
    for (a, b), c in sorted(link.items(), key=lambda x: (-x[1], x[0])):
        if (a, b) in used:
            continue
        group, least = [a, b], c
        while len(group) < most:
            common = set.intersection(*(set(near[m]) for m in group)) - set(group)
            best = min(((-min(near[m][x] for m in group), x) for x in common), default=None)
            if best is None or -best[0] < least - loss:
                break
            group.append(best[1])
            least = min(least, -best[0])
        group.sort()
        used.update((x, y) for i, x in enumerate(group) for y in group[i + 1 :])
        out.append((group, len(group), least))
    return pd.DataFrame(out, columns=["members", "arity", "confidence"])


def cochange_groups(pairs: DataFrame, most: int = 8, loss: float = 0.05) -> DataFrame:
    """Greedy groups. The greedy order matters only among files that are connected, so each component is a task's work."""
    parts = components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    c = pairs.join(parts.select(F.col("node").alias("a"), "root"), "a").select("root", "a", "b", "confidence")
    return c.groupBy("root").applyInPandas(lambda p: grow_groups(p, most, loss), GROUPS)


def group_cooccurrence(changes: DataFrame, groups: DataFrame) -> DataFrame:
    """Commits that hold all of a group's members."""
    g = groups.select("members", "arity", F.explode("members").alias("file"))
    n = changes.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    rows, met = n.join(g.groupBy("file").agg(F.count(F.lit(1)).alias("g")), "file", "left").agg(F.sum("n"), F.sum(F.col("n") * F.col("g"))).first()
    # hardly two rows of a task are of one group and commit, so they are counted after the shuffle only
    full = g.join(_basket(changes, rows or 0), "file").repartition((met or 0) // ROWS + 1, "commit").groupBy("members", "arity", "commit").agg(F.count(F.lit(1)).alias("n")).filter("n = arity")
    return full.groupBy("members").agg(F.count(F.lit(1)).alias("co_occurrences"))


def doc_coverage(files: DataFrame, references: DataFrame) -> DataFrame:
    """Files (file, language): "documented" if a document refers to them (references: document, file). has_doc_comments says
    whether the file has a language, the only sign of it that is kept, and doesn't count for the status."""
    hit = references.select("file").distinct().withColumn("__hit", F.lit(True))
    j = files.join(hit, "file", "left")
    ext, com = F.coalesce("__hit", F.lit(False)), F.col("language").isNotNull()
    return j.select("file", F.when(ext, "documented").otherwise("undocumented").alias("status"), ext.alias("has_external_docs"), com.alias("has_doc_comments"))


def doc_freshness(changes: DataFrame, references: DataFrame, salience: DataFrame) -> DataFrame:
    """Changes of a documented file since its last reference (references: file, ts); stale from 3 on; the risk of a stale one
    is min(1, 0.3 n + 0.7 salience) to 3 places, else 0. Files that never changed have no row."""
    last = references.groupBy("file").agg(F.max("ts").alias("doc_ts"))
    j = last.join(changes.select("file", F.col("ts").alias("change_ts")), "file")
    n = j.groupBy("file").agg(F.count_if(F.col("change_ts") > F.col("doc_ts")).alias("commits_since_doc_update"))
    s = n.join(salience.select("file", "score"), "file", "left")
    risk = F.round(F.least(F.lit(1.0), 0.3 * F.col("commits_since_doc_update") + 0.7 * F.coalesce("score", F.lit(0.0))), 3)
    stale = F.col("commits_since_doc_update") >= 3
    return s.select("file", stale.alias("is_stale"), "commits_since_doc_update", F.when(stale, risk).otherwise(0.0).alias("staleness_risk"))
