"""Centralities over edges (src, dst, weight); loops write each few rounds to the shared folder.

PageRank comes by two rules: "standard" (dangling mass spread evenly) and "reference" (each round, a vertex takes d r(w)/out(w)
from a vertex that links to it, d r(w)/n from one without links, (1 - d) r(w)/n from any other, then the sum is made 1).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from lodestrata.operators.graph import degrees, vertices
from lodestrata.operators.ranking import Rounds, materialised, numbered

#: Vertices up to which betweenness starts a search from each; beyond, from the square root of their number.
ALL_SOURCES = 50_000
#: Edges of a graph that a task holds, or that is broadcast: 8 bytes each.
HELD_EDGES = 20_000_000


def held(e: DataFrame, run, ddl: str) -> DataFrame:
    """run(src, dst) over all edges at once, in one task: for graphs whose number of edges was checked. It gives columns of numpy."""
    schema = to_arrow_schema(_parse_datatype_string(ddl))

    def work(it):
        got = [[b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("src", "dst")] for b in it if b.num_rows]
        if got:
            cols = run(*[np.concatenate(c) for c in zip(*got)])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return e.select("src", "dst").repartition(1).mapInArrow(work, ddl)


def compressed(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    return nodes, at[: len(src)], at[len(src) :]


def ranks(src: np.ndarray, dst: np.ndarray, rounds: int, damping: float, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """pagerank() in memory."""
    nodes, s, d = compressed(src, dst)
    n = len(nodes)
    out = np.bincount(s, minlength=n)
    dangling = out == 0
    once = np.unique(s.astype(np.int64) * n + d) if rule != "standard" else None
    r = np.full(n, 1.0 / n)
    for _ in range(rounds):
        got = np.bincount(d, (r / np.maximum(out, 1))[s], minlength=n)
        loose = r[dangling].sum()
        if rule == "standard":
            r = (1 - damping) / n + damping * (got + loose / n)
        else:
            near = np.bincount(once % n, r[once // n], minlength=n)
            r = damping * got + damping * loose / n + (1 - damping) / n * (r.sum() - loose - near)
            r /= r.sum()
    return nodes, r


def pagerank(edges: DataFrame, rounds: int = 100, damping: float = 0.85, rule: str = "standard", every: int = 5, most_edges: int = HELD_EDGES) -> DataFrame:
    """GR2: (node, rank). Parallel edges count each. Up to most_edges edges a task holds all of them as compressed rows; beyond, a
    round is one join on the source and one aggregate by target, with the same result, written down each few rounds."""
    keep = Rounds(edges)
    e = keep.keep(edges.select("src", "dst"), "pr-edges")
    if e.count() <= most_edges:
        return held(e, lambda s, d: ranks(s, d, rounds, damping, rule), f"node {e.schema['src'].dataType.simpleString()}, rank double")
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    v = keep.keep(vertices(e).join(out, F.col("node") == F.col("src"), "left").select("node", F.coalesce("out", F.lit(0)).alias("out")), "pr-nodes")
    n = v.count()
    if n == 0:
        return v.select("node", F.lit(0.0).alias("rank"))
    r = v.withColumn("rank", F.lit(1.0 / n))
    for k in range(1, rounds + 1):
        sent = e.join(r.filter("out > 0").select(F.col("node").alias("src"), (F.col("rank") / F.col("out")).alias("share")), "src").groupBy("dst").agg(F.sum("share").alias("got"))
        sums = r.agg(F.coalesce(F.sum(F.when(F.col("out") == 0, F.col("rank"))), F.lit(0.0)).alias("dangling"), F.sum("rank").alias("all"))
        j = r.join(sent, F.col("node") == F.col("dst"), "left").crossJoin(F.broadcast(sums))  # one row
        got = F.coalesce("got", F.lit(0.0))
        if rule == "standard":
            new = (1 - damping) / n + damping * (got + F.col("dangling") / n)
        else:
            # every vertex's own neighbours aside: those with links that don't link here give (1 - d) r / n
            new = damping * got + damping * F.col("dangling") / n + (1 - damping) / n * (F.col("all") - F.col("dangling") - F.coalesce("from", F.lit(0.0)))
            who = e.distinct().join(r.filter("out > 0").select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("__d")).agg(F.sum("rank").alias("from"))
            j = j.join(who, F.col("node") == F.col("__d"), "left")
        r = j.select("node", "out", new.alias("rank"))
        if rule != "standard":
            r = keep.keep(r, "pr")
            r = r.crossJoin(F.broadcast(r.agg(F.sum("rank").alias("__s")))).select("node", "out", (F.col("rank") / F.col("__s")).alias("rank"))
        if k % every == 0 or k == rounds:
            r = keep.keep(r, "pr")
    keep.end("pr")
    return r.select("node", "rank")


def mutual(src: np.ndarray, dst: np.ndarray, rounds: int, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hits() in memory."""
    nodes, s, d = compressed(src, dst)
    n = len(nodes)
    hub = aut = np.full(n, 1 / math.sqrt(n))
    for _ in range(rounds):
        a, h = np.bincount(d, hub[s], minlength=n), np.bincount(s, aut[d], minlength=n)
        a, h = (x / (math.sqrt(float((x * x).sum())) or 1.0) for x in (a, h))
        done = np.abs(h - hub).sum() < tolerance and np.abs(a - aut).sum() < tolerance
        hub, aut = h, a
        if done:
            break
    return nodes, *(x / x.max() if x.max() > 0 else x for x in (hub, aut))


def hits(edges: DataFrame, rounds: int = 100, tolerance: float = 1e-10, most_edges: int = HELD_EDGES) -> DataFrame:
    """GR4: (node, hub, authority): both from the old values of the other, made of length 1, ended when both change by less than
    the tolerance in all, then divided by their maxima. Unweighted. Held by one task, or by joins, as pagerank() is."""
    keep = Rounds(edges)
    e = keep.keep(edges.select("src", "dst"), "hits-edges")
    if e.count() <= most_edges:
        return held(e, lambda s, d: mutual(s, d, rounds, tolerance), f"node {e.schema['src'].dataType.simpleString()}, hub double, authority double")
    v = keep.keep(vertices(e), "hits-nodes")
    n = v.count()
    s = v.select("node", F.lit(1.0 / math.sqrt(max(n, 1))).alias("hub"), F.lit(1.0 / math.sqrt(max(n, 1))).alias("authority"))
    for _ in range(rounds):
        a = e.join(s.select(F.col("node").alias("src"), "hub"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("hub").alias("a"))
        h = e.join(s.select(F.col("node").alias("dst"), "authority"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum("authority").alias("h"))
        j = keep.keep(s.join(a, "node", "left").join(h, "node", "left").select("node", "hub", "authority", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("h", F.lit(0.0)).alias("h")), "hits")
        z = j.agg(F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("za"), F.sqrt(F.sum(F.col("h") * F.col("h"))).alias("zh")).first()
        za, zh = z.za or 1.0, z.zh or 1.0
        s = j.select("node", (F.col("h") / zh).alias("hub"), (F.col("a") / za).alias("authority"), (F.abs(F.col("h") / zh - F.col("hub"))).alias("dh"), F.abs(F.col("a") / za - F.col("authority")).alias("da"))
        d = s.agg(F.sum("dh").alias("dh"), F.sum("da").alias("da")).first()
        s = s.select("node", "hub", "authority")
        if d.dh is None or (d.dh < tolerance and d.da < tolerance):
            break
    keep.end("hits", "hits-nodes")
    top = s.agg(F.max("hub").alias("mh"), F.max("authority").alias("ma"))
    out = s.crossJoin(F.broadcast(top))
    over = lambda x, m: F.when(F.col(m) > 0, F.col(x) / F.col(m)).otherwise(F.col(x))
    return out.select("node", over("hub", "mh").alias("hub"), over("authority", "ma").alias("authority"))


def hits_class(hub, authority):
    """Which of the two prevails."""
    return F.when((hub > 0.5) & (authority > 0.5), "Both").when(hub > 0.5, "Hub").when(authority > 0.5, "Authority").otherwise("Neither")


def brandes(n: int, start: np.ndarray, to: np.ndarray, sources: list[int]) -> np.ndarray:
    """Sum over sources of each vertex's dependency, on directed unweighted edges in compressed rows."""
    total = np.zeros(n)
    for s in sources:
        dist, sigma = np.full(n, -1), np.zeros(n)
        dist[s], sigma[s] = 0, 1
        front, layers = np.array([s]), []
        while len(front):
            lens = start[front + 1] - start[front]
            src = np.repeat(front, lens)
            at = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(start[front], lens)
            dst = to[at]
            dist[dst[dist[dst] < 0]] = dist[front[0]] + 1
            ok = dist[dst] == dist[front[0]] + 1
            np.add.at(sigma, dst[ok], sigma[src[ok]])
            layers.append((src[ok], dst[ok]))
            front = np.unique(dst[ok])
        delta = np.zeros(n)
        for src, dst in reversed(layers):
            np.add.at(delta, src, sigma[src] / sigma[dst] * (1 + delta[dst]))
        delta[s] = 0
        total += delta
    return total


def dependencies(e: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, b): Brandes as joins, for graphs that no machine holds: e (src, dst, distinct) and sources (node). Breadth first from
    all sources at once, a join and an anti-join a level; then back from the last level to the first."""
    levels = [materialised(sources.select(F.col("node").alias("s"), "node", F.lit(1.0).alias("sigma"), F.lit(0).alias("d")), "bc-level")]
    seen = levels[0]
    while levels[-1].take(1):
        front = levels[-1].select("s", F.col("node").alias("src"), "sigma")
        new = e.join(front, "src").groupBy("s", F.col("dst").alias("node")).agg(F.sum("sigma").alias("sigma"))
        levels.append(materialised(new.join(seen, ["s", "node"], "left_anti").select("s", "node", "sigma", F.lit(len(levels)).alias("d")), "bc-level"))
        seen = seen.unionByName(levels[-1])
    out, delta = None, None
    for k in range(len(levels) - 2, 0, -1):
        here = levels[k]
        here = here.withColumn("delta", F.lit(0.0)) if delta is None else here.join(delta, ["s", "node"], "left").withColumn("delta", F.coalesce("delta", F.lit(0.0)))
        here = materialised(here, "bc-delta")
        part = here.groupBy("node").agg(F.sum("delta").alias("b"))
        out = part if out is None else out.unionByName(part)
        share = here.select("s", F.col("node").alias("dst"), ((1 + F.col("delta")) / F.col("sigma")).alias("share"))
        back = levels[k - 1].select("s", F.col("node").alias("src"), "sigma")
        delta = e.join(share, "dst").join(back, ["s", "src"]).groupBy("s", F.col("src").alias("node")).agg(F.sum(F.col("sigma") * F.col("share")).alias("delta"))
    if out is None:
        return sources.select("node", F.lit(0.0).alias("b"))
    return out.groupBy("node").agg(F.sum("b").alias("b"))


def betweenness(edges: DataFrame, all_sources: int = ALL_SOURCES, most_edges: int = HELD_EDGES) -> DataFrame:
    """GR3: (node, betweenness), Brandes on distinct directed edges, divided by the greatest. The searches are spread over tasks,
    each with the whole graph in compressed rows, which a broadcast brings once to each machine: 8 bytes an edge, if they are
    no more than most_edges; a larger graph is searched by joins, with the same result. Beyond all_sources vertices, sources are
    every n / sqrt(n)-th vertex by id."""
    spark = edges.sparkSession
    e = materialised(edges.select("src", "dst").distinct(), "bc")
    v = numbered(vertices(e), "nr", F.col("node")).select("node", (F.col("nr") - 1).alias("nr"))
    v = materialised(v, "bc-nodes")
    n = v.count()
    if n == 0:
        return v.select("node", F.lit(0.0).alias("betweenness"))
    step = 1 if n <= all_sources else max(1, n // math.isqrt(n))
    chosen = v.filter(F.col("nr") % step == 0)
    if e.count() > most_edges:
        return normalised(v, dependencies(e, chosen), "node")
    coded = e.join(v.select(F.col("node").alias("src"), F.col("nr").alias("s")), "src").join(v.select(F.col("node").alias("dst"), F.col("nr").alias("d")), "dst")
    pairs = coded.select(F.col("s").cast("int"), F.col("d").cast("int")).orderBy("s", "d").toArrow()
    s, d = pairs.column(0).to_numpy(), pairs.column(1).to_numpy().astype(np.int64)
    start = np.searchsorted(s, np.arange(n + 1))
    graph = spark.sparkContext.broadcast((start, d))

    def run(it):
        start, to = graph.value
        total = np.zeros(n)
        for pdf in it:
            total += brandes(n, start, to, pdf["nr"].tolist())
        at = np.flatnonzero(total)
        yield pd.DataFrame({"nr": at, "b": total[at]})

    got = chosen.select("nr").repartition(max(1, min(n, spark.sparkContext.defaultParallelism * 2)), "nr").mapInPandas(run, "nr long, b double").groupBy("nr").agg(F.sum("b").alias("b"))
    return normalised(v, got, "nr")


def normalised(v: DataFrame, got: DataFrame, key: str) -> DataFrame:
    j = materialised(v.join(got, key, "left").select("node", F.coalesce("b", F.lit(0.0)).alias("b")), "bc-out")
    return j.crossJoin(F.broadcast(j.agg(F.max("b").alias("m")))).select("node", F.when(F.col("m") > 0, F.col("b") / F.col("m")).otherwise(0.0).alias("betweenness"))  # one row


def ranked(scores: DataFrame, score: str, edges: DataFrame) -> DataFrame:
    """W2, GR5: scores with rank 1..n (ties by node) and both degrees."""
    r = numbered(scores, "rank", F.desc(score), F.col("node"))
    return r.join(degrees(edges), "node", "left").select("node", score, F.col("rank").cast("int"), F.coalesce("in_degree", F.lit(0)).cast("int").alias("in_degree"), F.coalesce("out_degree", F.lit(0)).cast("int").alias("out_degree"))
