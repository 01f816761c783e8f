"""Agent sessions: interactions, corrections, reverts, hotspots, task patterns, commits near in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What says that the answer before was not what was wanted: in words, and by commands that take work back.
MARKERS = (*"actually|didn't work|doesn't work|go back|instead|no,|not right|not what i|revert|roll back|start over|that broke|that's not|try again|undo|wrong".split("|"),
           *"/undo|git checkout|git reset|git restore|git revert|git stash".split("|"))


def has_marker(text: Column, markers: tuple[str, ...] = MARKERS) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(F.lower(text), F.lit(m))
    return out


def corrections(turns: DataFrame, markers: tuple[str, ...] = MARKERS) -> DataFrame:
    """SRC21, W5: turns (session, pos, role, text, modified: names or null): each assistant turn, and whether the user turn right
    after it has a marker or names a file just modified, as it was named there."""
    w = W.partitionBy("session").orderBy("pos")
    t = turns.withColumn("next_role", F.lead("role").over(w)).withColumn("next_text", F.lead("text").over(w)).filter("role = 'assistant'")
    named = F.coalesce(F.exists("modified", lambda f: F.contains(F.col("next_text"), f)), F.lit(False))
    hit = (F.col("next_role") == "user") & (has_marker(F.col("next_text"), markers) | named)
    return t.select("session", "pos", F.coalesce(hit, F.lit(False)).alias("had_correction"))


def reverts(interactions: DataFrame, reach: int = 3) -> DataFrame:
    """SRC22: interactions (session, i, modified): those of which a later one in reach modifies a same file. Interactions that modify
    nothing are passed over; of the others those up to the first at a distance of `reach` or more are in reach (N17)."""
    w = W.partitionBy("session")
    f = interactions.filter(F.size("modified") > 0).withColumn("before", F.lag("i").over(w.orderBy("i")))
    f = f.select("session", "i", "before", F.explode(F.array_distinct("modified")).alias("file"))
    next_ = F.lead("before").over(W.partitionBy("session", "file").orderBy("i"))
    hit = f.withColumn("next", next_).filter(F.col("next") - F.col("i") < reach).select("session", "i").distinct().withColumn("reverted", F.lit(True))
    return interactions.join(hit, ["session", "i"], "left").select("session", "i", F.coalesce("reverted", F.lit(False)).alias("reverted"))


def rollup(interactions: DataFrame) -> DataFrame:
    """SRC23: interactions (session, ts, referenced, modified, had_correction, tool_uses) by session."""
    g = interactions.groupBy("session").agg(
        F.count(F.lit(1)).alias("interactions"),
        F.count_if("had_correction").alias("corrections"),
        F.sum("tool_uses").alias("tool_uses"),
        F.size(F.array_distinct(F.flatten(F.collect_list("referenced")))).alias("referenced_files"),
        F.size(F.array_distinct(F.flatten(F.collect_list("modified")))).alias("modified_files"),
        F.min("ts").alias("started"),
    )
    return g.withColumn("correction_rate", F.round(F.col("corrections") / F.col("interactions"), 6))


def near_commits(sessions: DataFrame, commits: DataFrame, hours: int = 24) -> DataFrame:
    """SRC24, J21: sessions (session, ts, file) and commits (commit, ts, file) that share files, the session up to so many hours
    before; confidence is shared files over the session's. An equi-join on file and block of time, so no nested loop: a session's rows
    meet the commits of its own block and of the next four only."""
    # a block is a quarter of the reach; the number of tasks is given, as by size alone it wouldn't go by the pairs
    wide, parts = 900 * hours, 200
    zoned = "timestamp" in (dict(sessions.dtypes)["ts"], dict(commits.dtypes)["ts"])

    def block(t: str) -> Column:
        x = F.col(t).cast("timestamp" if zoned else "timestamp_ntz")
        return F.floor((F.unix_seconds(x) if zoned else F.datediff(x, F.lit("1970-01-01")) * F.lit(86400).cast("long") + F.hour(x) * 3600 + F.minute(x) * 60 + F.second(x)) / wide)

    s = sessions.select("session", F.col("ts").alias("s_ts"), "file").filter("session IS NOT NULL").distinct()
    n = s.groupBy("session").agg(F.countDistinct("file").alias("n_files"), (F.min("s_ts") == F.max("s_ts")).alias("one_ts"))
    s = s.join(n, "session").withColumn("block", F.explode(F.sequence(block("s_ts"), block("s_ts") + 4)))
    c = commits.select("commit", F.col("ts").alias("c_ts"), "file").distinct().withColumn("rows", F.count(F.lit(1)).over(W.partitionBy("commit"))).withColumn("block", block("c_ts"))

    def meet(s: DataFrame, c: DataFrame) -> DataFrame:
        s, c = (x.repartition(parts, "file", "block") for x in (s, c))
        return s.join(c, ["file", "block"]).filter((F.col("c_ts") >= F.col("s_ts")) & (F.col("c_ts") <= F.col("s_ts") + F.expr(f"INTERVAL {hours} HOURS")))

    # a commit of one row and a session of one time meet once at most, so their pairs needn't be brought together
    once = meet(s.filter("one_ts"), c.filter("rows = 1")).select("session", "commit", "n_files", F.lit(1).cast("long").alias("shared"))
    again = meet(s, c.filter("rows > 1")).unionByName(meet(s.filter("NOT coalesce(one_ts, false)"), c.filter("rows = 1")))
    g = once.unionByName(again.groupBy("session", "commit", "n_files").agg(F.countDistinct("file").alias("shared")))
    return g.select("session", "commit", "shared", F.round(F.col("shared") / F.col("n_files"), 6).alias("confidence"))


def prompt_hotspots(refs: DataFrame) -> DataFrame:
    """Refs (session, file, modified): references, modifications and sessions of each file."""
    return refs.groupBy("file").agg(F.count(F.lit(1)).alias("reference_count"), F.count_if("modified").alias("modification_count"), F.countDistinct("session").alias("session_count"))


def correction_hotspots(uses: DataFrame) -> DataFrame:
    """Uses (file, corrections, interactions or null) by file, files with corrections only; a file of which no interactions
    are told has one. Confusion zone: over a fifth corrected, two at least."""
    g = uses.groupBy("file").agg(F.sum("corrections").alias("correction_count"), F.coalesce(F.sum("interactions"), F.lit(1)).alias("interaction_count")).filter("correction_count > 0")
    rate = F.coalesce(F.try_divide("correction_count", "interaction_count"), F.lit(0.0))
    return g.select("file", "correction_count", "interaction_count", F.round(rate, 6).alias("correction_rate"), ((rate > 0.2) & (F.col("correction_count") >= 2)).alias("is_confusion_zone"))


def task_patterns(refs: DataFrame, least: int = 2) -> DataFrame:
    """Sessions by the set of files they modified; sets of `least` sessions and more."""
    sets = refs.filter("modified").groupBy("session").agg(F.array_sort(F.collect_set("file")).alias("files"))
    return sets.groupBy("files").agg(F.count(F.lit(1)).alias("frequency")).filter(F.col("frequency") >= least)


def domain_vocabulary(refs: DataFrame, entities: DataFrame, least: int = 2) -> DataFrame:
    """Files referred to at least so often, and what is defined there (entities: file, name)."""
    n = refs.groupBy("file").agg(F.count(F.lit(1)).alias("reference_count")).filter(F.col("reference_count") >= least)
    e = entities.groupBy("file").agg(F.array_sort(F.collect_set("name")).alias("entities"))
    return n.join(e, "file").select("file", "entities", "reference_count")
