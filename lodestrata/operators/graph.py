"""Graphs as edges (src, dst, weight): build, filters, reach, degrees, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.ranking import Rounds

#: Edges of which a task holds all: 16 bytes each, and as much again for labels.
HELD_EDGES = 5_000_000
SOURCE_ROLES = ("caller", "importer", "source", "dependent", "member")
TARGET_ROLES = ("callee", "imported", "target", "dependency", "container")


def role_member(members, roles):
    """the first member, by position, with one of the roles, the roles' order before that of positions."""
    of = lambda role: F.filter(members, lambda m: m["role"] == role)
    found = [of(r) for r in roles]
    return F.coalesce(*[F.try_element_at(f, F.lit(1))["node_id"] for f in found])


def directed(edges: DataFrame) -> DataFrame:
    """F10, GR1: hyperedges (id, confidence, members: array<struct<position, role, node_id>>) as directed edges: by roles, else
    the first two members by position, else a loop."""
    m = F.array_sort("members")
    src = F.coalesce(role_member(m, SOURCE_ROLES), F.try_element_at(m, F.lit(1))["node_id"])
    dst = F.coalesce(role_member(m, TARGET_ROLES), F.try_element_at(m, F.lit(2))["node_id"], F.try_element_at(m, F.lit(1))["node_id"])
    return edges.filter(F.size("members") > 0).select(src.alias("src"), dst.alias("dst"), F.col("confidence").alias("weight"))


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """GR5: edges in and out of each vertex, in one shuffle."""
    both = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return both.groupBy(F.col("x.node").alias("node")).agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"))


def within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are among nodes."""
    n = nodes.select("node").distinct()
    return edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst", "weight")


def of_kind(nodes: DataFrame, kinds: list[str]) -> DataFrame:
    """G2."""
    return nodes.filter(F.col("kind").isin(kinds)).select("node")


def of_module(nodes: DataFrame, prefix: str) -> DataFrame:
    """By the beginning of the name."""
    return nodes.filter(F.col("name").startswith(prefix)).select("node")


def salient(scores: DataFrame, least: float) -> DataFrame:
    """G4."""
    return scores.filter(F.col("score") >= least).select("node")


def all_of(sets: list[DataFrame], spark) -> DataFrame:
    """Ids in every set; none where there is no set."""
    if not sets:
        return spark.createDataFrame([], "node long")
    out = sets[0].distinct()
    for s in sets[1:]:
        out = out.join(s, "node", "left_semi")
    return out


def bfs(edges: DataFrame, start: DataFrame, depth: int, directed_: bool = True) -> DataFrame:
    """GR14, G5: (node, depth) of what start (node) reaches in so many steps, at the first depth that reaches it. Each round
    joins the frontier only, and leaves out what is known."""
    step = edges.select("src", "dst")
    if not directed_:
        step = step.unionByName(step.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    step = step.distinct()
    rounds = Rounds(edges)
    seen = rounds.keep(start.select("node").distinct().withColumn("depth", F.lit(0)), "bfs")
    for d in range(1, depth + 1):
        front = seen.filter(F.col("depth") == d - 1).select(F.col("node").alias("src"))
        new = step.join(front, "src").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        seen = rounds.keep(seen.unionByName(new.withColumn("depth", F.lit(d))), "bfs")
    rounds.end("bfs")
    return seen


def neighborhood(edges: DataFrame, centers: DataFrame, hops: int) -> DataFrame:
    """Nodes within so many undirected hops of centers that are in the graph."""
    known = centers.join(vertices(edges), "node", "left_semi")
    return bfs(edges, known, hops, directed_=False)


def least_of_each(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least of each one's component), by labels that fall along edges and are looked up at their own labels."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    lab = np.arange(len(nodes))
    while True:
        low = np.minimum(lab[a], lab[b])
        new = lab.copy()
        for x in (a, b, lab[a], lab[b]):
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == lab).all():
            return nodes, nodes[lab]
        lab = new


def components(edges: DataFrame, most_edges: int = HELD_EDGES) -> DataFrame:
    """(node, root), root being the component's least node; nodes on loops only are left out. Up to most_edges edges a task holds
    all; beyond, large-star and small-star rounds, with the same result, each written to the shared folder. Least neighbours are
    pre-aggregated and joined, so the root of a large component is nobody's single task."""
    rounds = Rounds(edges)

    def least(e: DataFrame) -> DataFrame:
        return e.join(e.groupBy("u").agg(F.min("v").alias("m")).hint("shuffle_hash"), "u")

    e = rounds.keep(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u != v").distinct(), "cc")
    if e.count() <= most_edges:

        def run(it):
            got = [[b.column(b.schema.get_field_index(c)).to_numpy() for c in ("u", "v")] for b in it if b.num_rows]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in least_of_each(*(np.concatenate(c) for c in zip(*got)))], names=["node", "root"])

        return e.select(F.col("u").cast("long"), F.col("v").cast("long")).repartition(1).mapInArrow(run, "node long, root long")
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = least(both).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        small = least(large).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u != v").distinct()
        e = rounds.keep(small, "cc")
        got = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if got == mark:
            rounds.end("cc")
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        mark = got
