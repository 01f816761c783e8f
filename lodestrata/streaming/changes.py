"""The engine's incremental path as Structured Streaming: windowed change counts, contributor sessions, edges once each, score
history by state. State is bounded by watermarks, or forgotten in time; sinks write by batch id, so a batch that is repeated changes nothing."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCORE = "node long, at timestamp, score double"
TREND = "node long, slope double, trend string, current_score double, snapshots int"


def read(spark: SparkSession, path: str, schema, files_each: int = 1000) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)


def change_counts(changes: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """Changes by file and window (tumbling, or sliding if slide is told); rows later than the watermark are left out."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = changes.withWatermark("ts", late).groupBy(w.alias("w"), "file").agg(F.count(F.lit(1)).alias("changes"))
    return g.select("file", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "changes")


def contributor_sessions(events: DataFrame, gap: str = "12 hours", late: str = "2 days") -> DataFrame:
    """Events by contributor and session: a session ends with a gap."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "author").agg(F.count(F.lit(1)).alias("n"))
    return g.select("author", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def edges_once(edges: DataFrame, late: str = "2 days") -> DataFrame:
    """Each relation (identity_key) once within the watermark."""
    return edges.withWatermark("ts", late).dropDuplicatesWithinWatermark(["identity_key"])


def slope(scores: list[float]) -> float:
    """Least squares over the index; 0 for fewer than two."""
    n = len(scores)
    if n < 2:
        return 0.0
    mx, my = (n - 1) / 2, sum(scores) / n
    return sum((i - mx) * (s - my) for i, s in enumerate(scores)) / sum((i - mx) ** 2 for i in range(n))


def trend_of(x: float) -> str:
    return "Rising" if x > 0.01 else "Falling" if x < -0.01 else "Stable"


def score_trends(scores: DataFrame, keep: int = 10, forget_ms: int = 90 * 86_400_000) -> DataFrame:
    """W4 as it comes in: of (node, at, score) each node's last scores are its state; every batch in which it has new ones gives its
    trend. Order within a batch is by time; scores that are older than what a former batch brought stand behind it. A node of which
    nothing came for forget_ms is forgotten."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        new = pd.concat(list(parts)).sort_values(["at", "score"])
        held = (held + new["score"].tolist())[-keep:]
        state.update((held,))
        state.setTimeoutDuration(forget_ms)
        x = slope(held)
        yield pd.DataFrame({"node": [key[0]], "slope": [round(x, 6)], "trend": [trend_of(x)], "current_score": [held[-1]], "snapshots": [len(held)]})

    return scores.filter("node IS NOT NULL AND score IS NOT NULL").groupBy("node").applyInPandasWithState(step, TREND, "held array<double>", "update", GroupStateTimeout.ProcessingTimeTimeout)


def into_store(stream: DataFrame, store, table: str, checkpoint: str):
    """Each batch appended to a table of the store; keys keep their latest row, so a batch that comes again does no harm."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: store.append(table, df)).trigger(availableNow=True).start()
