"""Scope graphs: references resolved to definitions across files.

scope_nodes(path, id, kind, symbol, parent): kinds root, scope, push (a reference), pop (a definition), import, export; scope_edges
(path, source, target) lead from where a name is looked up to where it may be found. Within a file, a reference is resolved by
a breadth-first walk that carries a stack of symbols; at an import the walk goes on, in Spark, at the exports of that symbol in
other files. So a file's graph is a task's work, and across files there is one equi-join a hop; hops end when they come to no
place, with no stack, that they haven't been at. Nothing else ends a walk but that a stack holds no more symbols than it began
with and the file has references, so that a circle of references isn't gone round for ever.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.ranking import materialised

HITS = "path string, ref_path string, ref long, found long, symbol string, rest string"


def walk(kinds: dict, near: dict, starts: list[tuple]) -> list[tuple]:
    """(origin, hit or None, symbol, stack that is left) from (origin, node, stack): a pop takes the symbol on top, a push adds one; a
    pop that empties the stack is a hit; an import with a stack gives what goes on elsewhere."""
    out = []
    pushes = sum(kind == "push" for kind, _ in kinds.values())
    for origin, node, stack in starts:
        seen, queue, deep = set(), deque([(node, stack)]), len(stack) + pushes
        while queue:
            at, st = queue.popleft()
            if (at, st) in seen:
                continue
            seen.add((at, st))
            kind, symbol = kinds.get(at, ("scope", None))
            if kind == "pop":
                if not st or st[-1] != symbol:
                    continue
                st = st[:-1]
                if not st:
                    out.append((origin, at, symbol, ""))
                    continue
            elif kind == "push":
                st = (*st, symbol)
                if len(st) > deep:
                    continue
            elif kind == "import" and st:
                out.append((origin, None, st[-1], "\x1f".join(st)))
                continue
            queue.extend((n, st) for n in near.get(at, ()))
    return out


def _search(key, nodes: pd.DataFrame, edges: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
    kinds = {i: (k, s) for i, k, s in zip(nodes["id"], nodes["kind"], nodes["symbol"])}
    near: dict = {}
    for s, t in zip(edges["source"], edges["target"]):
        near.setdefault(s, []).append(t)
    todo = [((p, r), n, tuple(st.split("\x1f")) if st else ()) for p, r, n, st in zip(starts["ref_path"], starts["ref"], starts["node"], starts["stack"])]
    rows = [(key[0], o[0], o[1], hit, sym, rest) for o, hit, sym, rest in walk(kinds, near, todo)]
    return pd.DataFrame(rows, columns=["path", "ref_path", "ref", "found", "symbol", "rest"]).astype({"found": "Int64"})


def resolve(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ref_path, ref, def_path, def): every definition that a reference may mean, through however many files."""
    starts = nodes.filter("kind = 'push'").select("path", F.col("path").alias("ref_path"), F.col("id").alias("ref"), F.col("id").alias("node"), F.lit("").alias("stack"))
    exports = nodes.filter("kind = 'export'").select(F.col("path").alias("to"), F.col("id").alias("node"), F.col("symbol"))
    out, been = None, starts
    while True:
        packed = nodes.groupBy("path").agg(F.collect_list(F.struct("id", "kind", "symbol")).alias("n")).join(edges.groupBy("path").agg(F.collect_list(F.struct("source", "target")).alias("e")), "path", "left")
        packed = packed.join(starts.groupBy("path").agg(F.collect_list(F.struct("ref_path", "ref", "node", "stack")).alias("s")), "path")

        def run(it):
            for b in it:
                for path, n, e, s in zip(b["path"], b["n"], b["e"], b["s"]):
                    frame = lambda rows, cols: pd.DataFrame([tuple(r[c] for c in cols) for r in (rows if rows is not None else [])], columns=cols)
                    yield _search((path,), frame(n, ["id", "kind", "symbol"]), frame(e, ["source", "target"]), frame(s, ["ref_path", "ref", "node", "stack"]))

        got = materialised(packed.mapInPandas(run, HITS), "scope")
        hits = got.filter("found IS NOT NULL").select("ref_path", "ref", F.col("path").alias("def_path"), F.col("found").alias("def"))
        out = hits if out is None else out.unionByName(hits)
        on = got.filter("found IS NULL").join(exports, "symbol").filter("to != path")
        on = on.select(F.col("to").alias("path"), "ref_path", "ref", "node", F.col("rest").alias("stack")).distinct()
        starts = materialised(on.join(been, ["path", "ref_path", "ref", "node", "stack"], "left_anti"), "scope-starts")
        if not starts.take(1):
            break
        been = been.unionByName(starts)
    return out.distinct()


def add_file(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GR16: both with the new files' rows in place of what they had of these files."""
    paths = new_nodes.select("path").distinct()
    return nodes.join(paths, "path", "left_anti").unionByName(new_nodes), edges.join(paths, "path", "left_anti").unionByName(new_edges)


def remove_file(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    return nodes.join(paths, "path", "left_anti"), edges.join(paths, "path", "left_anti")
