"""The hypergraph kept as Parquet logs in one folder.

A write appends a batch of a higher version to its table; a read keeps each key's latest row, by one aggregation that combines
before its shuffle. Nothing is rewritten in place, so a lost executor or a failed job leaves the store as it was; compact()
writes a table anew. Deletion appends rows that say so. Ids are hashes of the natural key, so tasks give them alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBERS = "array<struct<node_id:bigint,role:string,position:int>>"
TABLES = {
    "nodes": ("kind string, name string, content_hash bigint, last_extracted timestamp, metadata string", ["kind", "name"]),
    "hyperedges": (f"kind string, identity_key string, confidence double, last_updated timestamp, metadata string, members {MEMBERS}", ["identity_key"]),
    "analysis_results": ("node_id bigint, kind string, data string, input_hash bigint, computed_at timestamp", ["node_id", "kind"]),
    "checkpoints": ("kind string, value string, updated_at timestamp", ["kind"]),
    "text_documents": ("node_id bigint, content_type string, content string", []),
    "snapshots": ("label string, snapshot_at timestamp, node_count bigint, edge_count bigint", ["label"]),
    "snapshot_nodes": ("label string, id bigint", ["label", "id"]),
    "snapshot_edges": ("label string, id bigint", ["label", "id"]),
}
#: Views: the kind of edge, and the roles that become columns.
VIEWS = {
    "call_graph": ("Calls", {"caller": ["caller"], "callee": ["callee"]}),
    "import_graph": ("Imports", {"importer": ["importer", "source"], "imported": ["imported", "target"]}),
    "commit_files": ("Modifies", {"commit": ["commit"], "file": ["file"]}),
    "document_references": ("Documents", {"document": ["document", "subject"], "code_entity": ["code_entity", "entity"]}),
    "prompt_modifications": ("PromptModifiedFiles", {"session": ["session", "prompt"], "file": ["file"]}),
}


def node_id(kind: Column, name: Column) -> Column:
    return F.xxhash64(kind, name)


def identity_key(kind: Column, members: Column) -> Column:
    """SNK3: kind and the sorted roles with their nodes: the same relation has one key in whatever order its members come."""
    parts = F.array_sort(F.transform(members, lambda m: F.concat_ws(":", m["role"], m["node_id"].cast("string"))))
    return F.concat(kind, F.lit("|"), F.array_join(parts, ","))


def latest(rows: DataFrame, keys: list[str], version: str = "v") -> DataFrame:
    """SNK1-4, J15: of each key's rows the one of the highest version (of equals the greatest row), as one combined aggregation."""
    rest = [c for c in rows.columns if c not in keys and c != version]
    got = rows.groupBy(*keys).agg(F.max(F.struct(version, *rest)).alias("__r"))
    return got.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def find_nodes(nodes: DataFrame, kind: str | None = None, prefix: str | None = None, contains: str | None = None, limit: int | None = None, strict: bool = False) -> DataFrame:
    """Nodes by all that is given; names without regard to case unless strict; '%' and '_' are ordinary characters."""
    name = F.col("name") if strict else F.lower("name")
    fold = (lambda s: s) if strict else str.lower
    out = nodes
    if kind is not None:
        out = out.filter(F.col("kind") == kind)
    if prefix is not None:
        out = out.filter(name.startswith(fold(prefix)))
    if contains is not None:
        out = out.filter(F.contains(name, F.lit(fold(contains))))
    return out if limit is None else out.orderBy("name").limit(limit)


def exploded(edges: DataFrame) -> DataFrame:
    """A row a member: (edge, kind, node, role, position)."""
    return edges.select(F.col("id").alias("edge"), "kind", F.explode("members").alias("m")).select("edge", "kind", F.col("m.node_id").alias("node"), F.col("m.role").alias("role"), F.col("m.position").alias("position"))


def with_members(members: DataFrame) -> DataFrame:
    """edges with their members in order, from a row a member."""
    return members.groupBy("edge", "kind").agg(F.array_sort(F.collect_list(F.struct("position", "role", F.col("node").alias("node_id")))).alias("members"))


def pairs_view(members: DataFrame, view: str) -> DataFrame:
    """An edge's members of one role with those of the other. Both come from one grouping, not from a self-join."""
    kind, roles = VIEWS[view]
    (a, a_roles), (b, b_roles) = roles.items()
    m = members.filter((F.col("kind") == kind) & F.col("role").isin(*a_roles, *b_roles))
    pick = lambda names: F.collect_list(F.when(F.col("role").isin(*names), F.col("node")))
    g = m.groupBy("edge").agg(pick(a_roles).alias("__a"), pick(b_roles).alias("__b"))
    return g.select("edge", F.explode("__a").alias(a), "__b").select("edge", a, F.explode("__b").alias(b))


def edges_of(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges in which any of the nodes (node) takes part."""
    return members.join(nodes.select("node").distinct(), "node", "left_semi").select("edge", "kind").distinct()


def co_members(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, other): who shares an edge with each of the nodes, once."""
    mine = members.join(nodes.select("node").distinct(), "node", "left_semi").select("edge", F.col("node").alias("of"))
    return members.select("edge", "node").join(mine, "edge").filter("node != of").select(F.col("of").alias("node"), F.col("node").alias("other")).distinct()


def named(ids: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    """`column` with its node's name beside it, 'node:<id>' where there is none."""
    n = nodes.select(F.col("id").alias("__id"), F.col("name").alias("__name"))
    return ids.join(n, F.col(column) == F.col("__id"), "left").withColumn(f"{column}_name", F.coalesce("__name", F.concat(F.lit("node:"), F.col(column).cast("string")))).drop("__id", "__name")


def counts_by_kind(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A1."""
    n = nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("what"), "kind", "n")
    return n.unionByName(edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("what"), "kind", "n"))


def mark_stale(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """F8: metadata (JSON text) of these nodes with stale set."""
    hit = ids.select(F.col("id")).distinct().withColumn("__hit", F.lit(True))
    m = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    new = F.to_json(F.map_concat(F.map_filter(m, lambda k, _: k != "stale"), F.create_map(F.lit("stale"), F.lit("true"))))
    return nodes.join(hit, "id", "left").withColumn("metadata", F.when(F.col("__hit"), new).otherwise(F.col("metadata"))).drop("__hit")


def stale(nodes: DataFrame, before) -> DataFrame:
    """nodes whose metadata says stale and that were last extracted before."""
    return nodes.filter((F.get_json_object("metadata", "$.stale") == "true") & (F.col("last_extracted") < F.lit(before)))


class HypergraphStore:
    """A folder of tables. Only one writer at a time is provided for."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self, table: str) -> list[int]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        dirs = [s.getPath() for s in fs.listStatus(path)]
        return sorted(int(p.getName()[2:]) for p in dirs if p.getName().startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _schema(self, table: str) -> str:
        return TABLES[table][0] + ", deleted boolean"

    def append(self, table: str, rows: DataFrame, deleted: bool = False) -> None:
        names = [p.strip().split(" ")[0] for p in TABLES[table][0].replace(MEMBERS, "x").split(",")]
        v = (self._versions(table) or [0])[-1] + 1
        have = set(rows.columns)
        kinds = {f.name: f.dataType for f in self.spark.createDataFrame([], TABLES[table][0]).schema}
        cols = [(F.col(c) if c in have else F.lit(None)).cast(kinds[c]).alias(c) for c in names]
        rows.select(*cols, F.lit(deleted).alias("deleted")).write.parquet(f"{self.root}/{table}/v={v:08d}")

    def log(self, table: str) -> DataFrame:
        vs = self._versions(table)
        if not vs:
            return self.spark.createDataFrame([], self._schema(table) + ", v int")
        return self.spark.read.option("basePath", f"{self.root}/{table}").schema(self._schema(table) + ", v int").parquet(*[f"{self.root}/{table}/v={v:08d}" for v in vs])

    def read(self, table: str) -> DataFrame:
        keys = TABLES[table][1]
        rows = self.log(table)
        rows = (latest(rows, keys) if keys else rows.drop("v")).filter("NOT deleted").drop("deleted")
        if table == "nodes":
            rows = rows.withColumn("id", node_id(F.col("kind"), F.col("name")))
        elif table == "hyperedges":
            rows = rows.withColumn("id", F.xxhash64("identity_key"))
        return rows

    def compact(self, table: str) -> None:
        """One version in place of all. The new one is written before the old ones go; reading both gives the same."""
        old = self._versions(table)
        self.append(table, self.read(table))
        if TABLES[table][1] or old:
            jvm = self.spark._jvm
            for v in old:
                path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}/v={v:08d}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def upsert_nodes(self, rows: DataFrame) -> None:
        self.append("nodes", rows)

    def upsert_edges(self, rows: DataFrame) -> None:
        """rows: kind, members, confidence, last_updated, metadata."""
        self.append("hyperedges", rows.withColumn("identity_key", identity_key(F.col("kind"), F.col("members"))))

    def store_analyses(self, rows: DataFrame) -> None:
        self.append("analysis_results", rows)

    def index_text(self, rows: DataFrame) -> None:
        self.append("text_documents", rows)

    def set_checkpoint(self, kind: str, value: str) -> None:
        self.append("checkpoints", self.spark.range(1).select(F.lit(kind).alias("kind"), F.lit(value).alias("value"), F.current_timestamp().alias("updated_at")))

    def checkpoint(self, kind: str) -> str | None:
        r = self.read("checkpoints").filter(F.col("kind") == kind).first()
        return r.value if r else None

    def has_work(self, kind: str, head: str) -> bool:
        """Whether the source stands elsewhere than at its last checkpoint."""
        return self.checkpoint(kind) != head

    def clear_analyses(self, kinds: list[str] | None = None, keep: list[str] | None = None, nodes: DataFrame | None = None) -> None:
        """Analyses of these kinds, of all but those kept, of these nodes (node_id), or all."""
        gone = self.read("analysis_results")
        if kinds is not None:
            gone = gone.filter(F.col("kind").isin(kinds))
        if keep is not None:
            gone = gone.filter(~F.col("kind").isin(keep))
        if nodes is not None:
            gone = gone.join(nodes.select("node_id").distinct(), "node_id", "left_semi")
        self.append("analysis_results", gone, deleted=True)

    def create_snapshot(self, label: str) -> None:
        """The ids of all nodes and edges under a label."""
        n = self.read("nodes").select(F.lit(label).alias("label"), "id")
        e = self.read("hyperedges").select(F.lit(label).alias("label"), "id")
        self.append("snapshot_nodes", n)
        self.append("snapshot_edges", e)
        counts = n.agg(F.count(F.lit(1)).alias("node_count")).crossJoin(F.broadcast(e.agg(F.count(F.lit(1)).alias("edge_count"))))  # one row each
        self.append("snapshots", counts.select(F.lit(label).alias("label"), F.current_timestamp().alias("snapshot_at"), "node_count", "edge_count"))

    def delete_snapshot(self, label: str) -> None:
        for t in ("snapshots", "snapshot_nodes", "snapshot_edges"):
            self.append(t, self.read(t).filter(F.col("label") == label), deleted=True)

    def snapshots(self) -> DataFrame:
        """K9: by time."""
        return self.read("snapshots").orderBy("snapshot_at", "label")

    def snapshot_diff(self, old: str, new: str) -> DataFrame:
        """(what, change, id)."""
        from lodestrata.operators.temporal import difference

        out = None
        for what, t in (("node", "snapshot_nodes"), ("edge", "snapshot_edges")):
            s = self.read(t)
            d = difference(s.filter(F.col("label") == old), s.filter(F.col("label") == new)).withColumn("what", F.lit(what))
            out = d if out is None else out.unionByName(d)
        return out.select("what", "change", "id")

    def due_snapshots(self, every: int) -> list[str]:
        """Labels of snapshots to take: releases without one, and auto-<n> at each further `every` commits."""
        nodes, have = self.read("nodes"), self.read("snapshots").select("label")
        releases = nodes.filter("kind = 'Release'").select(F.col("name").alias("label")).join(have, "label", "left_anti")
        out = [r.label for r in releases.orderBy("label").collect()]  # as many as releases that are new
        n = nodes.filter("kind = 'Commit'").count() // every * every if every else 0
        auto = f"auto-{n}"
        return out + ([auto] if n and not have.filter(F.col("label") == auto).take(1) else [])

    def views(self) -> None:
        """The five pair views as temporary views."""
        m = exploded(self.read("hyperedges"))
        for name in VIEWS:
            pairs_view(m, name).createOrReplaceTempView(name)

    def stats(self) -> DataFrame:
        return counts_by_kind(self.read("nodes"), self.read("hyperedges"))
