"""Communities of files: Louvain's moves and contraction at every size, modularity, coupling.

A level is a graph of weighted undirected edges, each vertex alone at first. A sweep goes through COLOURS classes of vertices,
told by a hash of their ids; the vertices of a class move at once, each to the neighbouring community of the greatest gain in
modularity, if that is over the gain of staying (to 12 places; equals: the least community). So few neighbours move together,
and what comes out depends on nothing but the graph. Sweeps end when nothing moves; the communities are the next level's
vertices, named by their least, until a level gains no modularity. Graphs of up to HELD_EDGES edges are held by one task; beyond,
the same steps are joins and aggregates, with the same result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.operators.centrality import HELD_EDGES
from lodestrata.operators.ranking import Rounds

COLOURS, SWEEPS, LEVELS = 8, 10, 12
#: Of the hash of a vertex.
_PRIME, _FACTOR = 1_000_003, 48_271
_LEAST_GAIN = 1e-9


def _best(u: np.ndarray, c: np.ndarray, l: np.ndarray, com: np.ndarray, k: np.ndarray, tot: np.ndarray) -> np.ndarray:
    """Communities after the moves of the vertices that occur in u, from their links l to communities c (own ones among them).
    All weights are shares of twice the total."""
    gain = np.round(l - k[u] * (tot[c] - np.where(c == com[u], k[u], 0.0)), 12)
    order = np.lexsort((c, -gain, u))
    first = order[np.flatnonzero(np.append(True, np.diff(u[order]) != 0))]
    stay = np.full(len(com), -np.inf)
    own = c == com[u]
    stay[u[own]] = gain[own]
    out = com.copy()
    up = first[gain[first] > stay[u[first]]]
    out[u[up]] = c[up]
    return out


def louvain(src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, community of each, named by its least node): parallel edges add up, weights of 0 and less count 1."""
    nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = at[: len(src)], at[len(src) :]
    w = np.where(w > 0, w, 1.0)
    w = w / (2 * w.sum())
    member = np.arange(len(nodes))  # of each node its vertex, which is called by its least node's place
    n, before = len(nodes), -np.inf
    for _ in range(LEVELS):
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        key, inv = np.unique(lo * n + hi, return_inverse=True)
        a, b, w = key // n, key % n, np.bincount(inv, w)
        k = np.bincount(a, w, minlength=n) + np.bincount(b, w, minlength=n)
        x = a != b
        u, v, l = np.concatenate([a[x], b[x]]), np.concatenate([b[x], a[x]]), np.concatenate([w[x], w[x]])
        own = np.unique(np.concatenate([a, b]))
        colour = np.mod(np.mod(nodes, _PRIME) * _FACTOR, _PRIME) % COLOURS
        com = np.arange(n)
        for _ in range(SWEEPS):
            moved = False
            for step in range(COLOURS):
                tot = np.bincount(com, k, minlength=n)
                on = colour[u] == step
                mine = own[colour[own] == step]
                if not len(mine):
                    continue
                pair, inv = np.unique(np.concatenate([u[on] * n + com[v[on]], mine * n + com[mine]]), return_inverse=True)
                sums = np.bincount(inv, np.concatenate([l[on], np.zeros(len(mine))]), minlength=len(pair))
                new = _best(pair // n, pair % n, sums, com, k, tot)
                moved |= bool((new != com).any())
                com = new
            if not moved:
                break
        inside = w[com[a] == com[b]].sum() * 2
        tot = np.bincount(com, k, minlength=n)
        q = inside - (tot * tot).sum()
        if q <= before + _LEAST_GAIN:
            break
        before = q
        least = np.full(n, n)
        np.minimum.at(least, com[own], own)
        name = least[com]
        member, a, b = name[member], name[a], name[b]
    return nodes, nodes[member]


def communities(edges: DataFrame, most_edges: int = HELD_EDGES) -> DataFrame:
    """GR9: (node, community), a community being named by its least node."""
    keep = Rounds(edges)
    e = keep.keep(edges.select("src", "dst", F.coalesce("weight", F.lit(1.0)).alias("weight")), "lv-edges")
    if e.count() > most_edges:
        return _by_joins(e, keep)

    def run(it):
        import pandas as pd

        parts = [p for p in it if len(p)]
        if parts:
            d = pd.concat(parts)
            nodes, com = louvain(d["src"].to_numpy(), d["dst"].to_numpy(), d["weight"].to_numpy(np.float64))
            yield pd.DataFrame({"node": nodes, "community": com})

    return e.repartition(1).mapInPandas(run, "node long, community long")


def _by_joins(e: DataFrame, keep: Rounds) -> DataFrame:
    w = F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0)
    m = e.agg(F.sum(w)).first()[0]
    if not m:
        return e.select(F.col("src").alias("node"), F.col("src").alias("community"))
    level = e.select("src", "dst", (w / (2 * m)).alias("w"))
    member = keep.keep(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("community", F.col("node")), "lv-member")
    before = float("-inf")
    for _ in range(LEVELS):
        g = level.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("w").alias("w"))
        g = keep.keep(g, "lv-level")
        ends = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v"), "w"), F.struct(F.col("b").alias("u"), F.col("a").alias("v"), "w"))).alias("x")
        both = keep.keep(g.select(ends).select("x.*").repartition("u"), "lv-both")
        links = both.filter("u != v")
        colour = F.pmod(F.pmod("u", F.lit(_PRIME)) * _FACTOR, F.lit(_PRIME)) % COLOURS
        com = keep.keep(both.groupBy("u").agg(F.sum("w").alias("k")).select("u", "k", colour.alias("colour"), F.col("u").alias("c")), "lv-com")
        for _ in range(SWEEPS):
            moved = 0
            for step in range(COLOURS):
                tot = com.groupBy("c").agg(F.sum("k").alias("tot"))
                mine = com.filter(F.col("colour") == step).select("u", "k", F.col("c").alias("own"))
                near = links.join(mine.select("u"), "u", "left_semi").join(com.select(F.col("u").alias("v"), "c"), "v").select("u", "c", "w")
                near = near.unionByName(mine.select("u", F.col("own").alias("c"), F.lit(0.0).alias("w"))).groupBy("u", "c").agg(F.sum("w").alias("l"))
                j = near.join(mine, "u").join(tot, "c")
                gain = F.round(F.col("l") - F.col("k") * (F.col("tot") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)), 12)
                best = j.withColumn("gain", gain).groupBy("u").agg(F.min(F.struct((-F.col("gain")).alias("g"), "c")).alias("b"), F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("stay"))
                best = best.filter(-F.col("b.g") > F.col("stay")).select("u", F.col("b.c").alias("to"))
                com = keep.keep(com.join(best, "u", "left").select("u", "k", "colour", F.coalesce("to", "c").alias("c"), F.col("to").isNotNull().alias("moved")), "lv-com")
                moved += com.filter("moved").count()
                com = com.drop("moved")
            if not moved:
                break
        names = com.groupBy("c").agg(F.min("u").alias("name"), F.sum("k").alias("tot"))
        name = keep.keep(com.join(names, "c").select("u", "name"), "lv-name")
        up = g.join(name.select(F.col("u").alias("a"), F.col("name").alias("src")), "a").join(name.select(F.col("u").alias("b"), F.col("name").alias("dst")), "b").select("src", "dst", "w")
        level = keep.keep(up, "lv-up")
        q = 2 * (level.filter("src = dst").agg(F.sum("w")).first()[0] or 0.0) - names.agg(F.sum(F.col("tot") * F.col("tot"))).first()[0]
        if q <= before + _LEAST_GAIN:
            break
        before = q
        member = keep.keep(member.join(name.withColumnRenamed("u", "community"), "community").select("node", F.col("name").alias("community")), "lv-member")
    keep.end("lv-member")
    return member


def modularity(edges: DataFrame, assigned: DataFrame, gamma: float = 1.0) -> DataFrame:
    """GR10: (community, internal, degree, contribution): share of the edge weight inside less the square of the share of degrees;
    their sum is Q. Two joins and two aggregates."""
    c1, c2 = (assigned.select(F.col("node").alias(x), F.col("community").alias(f"c_{x}")) for x in ("src", "dst"))
    j = edges.join(c1, "src").join(c2, "dst")
    rows = j.select(F.explode(F.array(F.struct(F.col("c_src").alias("c"), F.col("weight").alias("w"), F.when(F.col("c_src") == F.col("c_dst"), F.col("weight")).otherwise(0.0).alias("i")), F.struct(F.col("c_dst").alias("c"), F.col("weight").alias("w"), F.lit(0.0).alias("i")))).alias("x"))
    s = rows.groupBy(F.col("x.c").alias("community")).agg(F.sum("x.i").alias("internal"), F.sum("x.w").alias("degree"))
    t = edges.agg(F.sum("weight").alias("m"))
    return s.crossJoin(F.broadcast(t)).select("community", F.round("internal", 6).alias("internal"), F.round("degree", 6).alias("degree"), F.round(F.col("internal") / F.col("m") - gamma * F.pow(F.col("degree") / (2 * F.col("m")), 2), 6).alias("contribution"))


def directory_alignment(assigned: DataFrame) -> DataFrame:
    """Assigned (file, community, dir): whether half of a file's community, itself included, is in its directory; alone: yes."""
    both = assigned.withColumn("n_dir", F.count(F.lit(1)).over(W.partitionBy("community", "dir"))).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("community")))
    return both.select("file", "community", "dir", (F.col("n_dir") / F.col("n") >= 0.5).alias("directory_aligned"))


def coupling(edges: DataFrame, assigned: DataFrame) -> DataFrame:
    """Of edges whose ends both have a community, how many cross, to 4 places."""
    a = assigned.select("node", "community")
    j = edges.join(a.select(F.col("node").alias("src"), F.col("community").alias("c1")), "src").join(a.select(F.col("node").alias("dst"), F.col("community").alias("c2")), "dst")
    cross = F.count_if(F.col("c1") != F.col("c2"))
    return j.agg(F.count(F.lit(1)).alias("total_edges"), cross.alias("cross_community_edges"), F.round(F.coalesce(cross / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)), 4).alias("coupling_ratio"))


def file_projection(imports: DataFrame, calls: DataFrame, parent: DataFrame) -> DataFrame:
    """GR8, J11, U4: imports, and calls lifted to the files (parent: child, file) of both ends, without loops; parallel edges stay."""
    p1, p2 = (parent.select(F.col("child").alias(x), F.col("file").alias(f"f_{x}")) for x in ("src", "dst"))
    up = calls.join(p1, "src", "left").join(p2, "dst", "left").select(F.coalesce("f_src", "src").alias("src"), F.coalesce("f_dst", "dst").alias("dst"), "weight")
    return imports.select("src", "dst", "weight").unionByName(up).filter("src != dst")
