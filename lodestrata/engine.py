"""From a work tree to its documents: extract, snapshot, analyse, render, and the read queries on what is stored.

Stages are objects with a name; what they need and give are tables of the store, so any of them can be replaced. An analyser runs
again where what it reads has changed since it last ran, which a fingerprint of counts and hashes in the checkpoints tells.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import behavioral as B
from lodestrata.operators import centrality as C
from lodestrata.operators import community as K
from lodestrata.operators import convention as V
from lodestrata.operators import guide as D
from lodestrata.operators import risk as R
from lodestrata.operators import salience as S
from lodestrata.operators.ranking import materialised
from lodestrata.sinks import render
from lodestrata.sources import code, files, history
from lodestrata.sources.store import HypergraphStore, node_id

Reporter = Callable[[str], None]


class Extractor(Protocol):
    name: str

    def has_work(self, engine: Engine) -> bool: ...

    def extract(self, engine: Engine) -> None: ...


@dataclass(frozen=True)
class Analyzer:
    """What it produces from which kinds of nodes, edges and analyses; run(engine) gives each kind's results, by node_id."""

    name: str
    produces: tuple[str, ...]
    reads: tuple[str, ...]
    run: Callable[[Engine], dict[str, DataFrame]]

    def fingerprint(self, engine: Engine) -> str:
        """Rows and hashes of what it reads."""
        s = engine.store
        rows = s.read("nodes").select("kind", F.xxhash64("name", "content_hash", "metadata").alias("h"))
        rows = rows.unionByName(s.read("hyperedges").select("kind", F.xxhash64("identity_key", "metadata").alias("h")))
        rows = rows.unionByName(s.read("analysis_results").select("kind", F.xxhash64("node_id", "data").alias("h"))).filter(F.col("kind").isin(*self.reads))
        r = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        return f"{r.n}:{r.h}"

    def needs_rerun(self, engine: Engine) -> bool:
        return engine.store.checkpoint(f"analysis:{self.name}") != self.fingerprint(engine)


@dataclass(frozen=True)
class Renderer:
    """render(engine, commit) gives its documents by their paths."""

    name: str
    render: Callable[[Engine, str], dict[str, str]]


def _member(kind: str, name, role: str, position: int):
    return F.struct(node_id(F.lit(kind), name).alias("node_id"), F.lit(role).alias("role"), F.lit(position).alias("position"))


class GitExtractor:
    name = "git"

    def has_work(self, engine: Engine) -> bool:
        return engine.store.has_work("git_last_sha", history.git(engine.repo, "rev-parse", "HEAD").strip())

    def extract(self, engine: Engine) -> None:
        head = history.git(engine.repo, "rev-parse", "HEAD").strip()
        h = materialised(history.history(engine.spark, engine.repo, engine.store.checkpoint("git_last_sha"), engine.max_commits), "history")
        s = engine.store
        commits = h.groupBy("commit", "author", "email", "ts").agg(F.first("subject").alias("subject"))
        s.upsert_nodes(commits.select(F.lit("Commit").alias("kind"), F.col("commit").alias("name"), F.col("ts").alias("last_extracted"), F.to_json(F.struct("subject", "author")).alias("metadata")))
        s.upsert_nodes(commits.select(F.lit("Contributor").alias("kind"), F.col("email").alias("name")).distinct())
        s.upsert_nodes(h.filter("path IS NOT NULL").select(F.lit("File").alias("kind"), F.col("path").alias("name")).distinct().join(s.read("nodes").select("kind", "name"), ["kind", "name"], "left_anti"))
        s.upsert_edges(commits.select(F.lit("Authored").alias("kind"), F.array(_member("Contributor", F.col("email"), "author", 0), _member("Commit", F.col("commit"), "commit", 1)).alias("members"), F.lit(1.0).alias("confidence"), F.col("ts").alias("last_updated")))
        g = h.filter("path IS NOT NULL").groupBy("commit", "ts").agg(F.array_sort(F.collect_list(F.struct("path", "status", "added", "deleted"))).alias("f"))
        m = F.concat(F.array(_member("Commit", F.col("commit"), "commit", 0)), F.transform("f", lambda x, i: F.struct(node_id(F.lit("File"), x["path"]).alias("node_id"), F.lit("file").alias("role"), (i + 1).cast("int").alias("position"))))
        s.upsert_edges(g.select(F.lit("Modifies").alias("kind"), m.alias("members"), F.lit(1.0).alias("confidence"), F.col("ts").alias("last_updated"), F.to_json(F.struct(F.col("f").alias("files"))).alias("metadata")))
        tags = materialised(history.tags(engine.spark, engine.repo), "tags")
        s.upsert_nodes(tags.select(F.lit("Release").alias("kind"), F.col("tag").alias("name"), F.col("ts").alias("last_extracted"), F.to_json(F.struct("commit")).alias("metadata")))
        names = [(c, n) for n, c in enumerate(history.git(engine.repo, "rev-list", "--first-parent", "--reverse", "HEAD").split())]
        r = history.release_commits(tags, engine.spark.createDataFrame(names, "commit string, n long"))
        s.upsert_edges(r.select(F.lit("Includes").alias("kind"), F.array(_member("Release", F.col("release"), "release", 0), _member("Commit", F.col("commit"), "commit", 1)).alias("members"), F.lit(1.0).alias("confidence")))
        s.set_checkpoint("git_last_sha", head)


class TreeExtractor:
    """Files, definitions, calls and imports, documents and what they refer to."""

    name = "tree"

    def has_work(self, engine: Engine) -> bool:
        return engine.store.has_work("structure_last_sha", history.git(engine.repo, "rev-parse", "HEAD").strip())

    def extract(self, engine: Engine) -> None:
        s, t = engine.store, materialised(files.tree(engine.spark, engine.repo), "tree")
        f = files.ingest(t)
        root = files.ci_commands(t).agg(F.array_sort(F.collect_set("command")).alias("ci_commands"))
        s.upsert_nodes(root.select(F.lit("Module").alias("kind"), F.lit(".").alias("name"), F.to_json(F.struct(F.lit(True).alias("is_root"), "ci_commands")).alias("metadata")))
        s.upsert_nodes(f.select(F.lit("File").alias("kind"), F.col("path").alias("name"), "content_hash", F.to_json(F.struct("language", "size_bytes", "lines")).alias("metadata")))
        mods = f.select("path", F.explode("modules").alias("m"))
        s.upsert_nodes(mods.select(F.lit("Module").alias("kind"), F.col("m").alias("name")).distinct())
        up = f.filter(F.size("modules") > 0).select("path", F.element_at("modules", -1).alias("m"))
        s.upsert_edges(up.select(F.lit("BelongsTo").alias("kind"), F.array(_member("File", F.col("path"), "member", 0), _member("Module", F.col("m"), "container", 1)).alias("members"), F.lit(1.0).alias("confidence")))
        p = materialised(code.parse(t), "parsed")
        d = code.definitions(p)
        s.upsert_nodes(d.select("kind", "name", F.to_json(F.struct("path", "start", "end", "doc")).alias("metadata")))
        s.upsert_edges(code.call_edges(p).select(F.lit("Calls").alias("kind"), F.array(_member("Function", F.col("caller"), "caller", 0), _member("Function", F.col("callee"), "callee", 1)).alias("members"), "confidence"))
        i = R.resolve_imports(p.filter("what = 'import'").select(F.col("path").alias("importer"), "target"), t.select("path")).filter("path IS NOT NULL AND path != importer")
        s.upsert_edges(i.select(F.lit("Imports").alias("kind"), F.array(_member("File", F.col("importer"), "importer", 0), _member("File", F.col("path"), "imported", 1)).alias("members"), "confidence"))
        docs = t.filter(F.col("path").rlike(r"\.(md|rst|txt)$"))
        s.upsert_nodes(files.documents(docs).select(F.lit("Document").alias("kind"), F.col("path").alias("name"), F.to_json(F.struct("title", "doc_type", "word_count")).alias("metadata")))
        r = files.references(docs).join(t.select(F.col("path").alias("target")), "target")
        s.upsert_edges(r.select(F.lit("Documents").alias("kind"), F.array(_member("Document", F.col("path"), "document", 0), _member("File", F.col("target"), "code_entity", 1)).alias("members"), "confidence"))
        s.index_text(docs.select(node_id(F.lit("Document"), F.col("path")).alias("node_id"), F.lit("markdown").alias("content_type"), "content"))
        s.set_checkpoint("structure_last_sha", history.git(engine.repo, "rev-parse", "HEAD").strip())


class Engine:
    """One repository's analyses in one folder."""

    def __init__(self, spark: SparkSession, repo: str, root: str, max_commits: int = 0, report: Reporter = lambda _: None):
        self.spark, self.repo, self.max_commits, self.report = spark, repo, max_commits, report
        self.store = HypergraphStore(spark, root)
        self.extractors: list[Extractor] = [GitExtractor(), TreeExtractor()]
        self.analyzers, self.renderers = list(ANALYZERS), list(RENDERERS)

    def update(self, force: bool = False, snapshot_every: int = 0) -> list[str]:
        """Runs the extractors that have work (all, if forced), takes the snapshots that are due, and stores analyses; returns what ran."""
        ran = []
        for e in self.extractors:
            if force or e.has_work(self):
                self.report(e.name)
                e.extract(self)
                ran.append(e.name)
        for label in self.store.due_snapshots(snapshot_every):
            self.store.create_snapshot(label)
        if ran:
            self.analyze(force)
        return ran

    def view(self, name: str) -> DataFrame:
        self.store.views()
        return self.spark.table(name)

    def changes(self) -> DataFrame:
        """(commit, file, author, ts, added, deleted), J3, J8, J9: of a commit's files the i-th with the i-th entry told of it."""
        e = self.store.read("hyperedges")
        m = e.filter("kind = 'Modifies'").withColumn("f", F.from_json(F.get_json_object("metadata", "$.files"), "array<struct<path:string,added:bigint,deleted:bigint>>"))
        role = lambda r: F.filter("members", lambda x: x["role"] == r)
        m = m.select(role("commit")[0]["node_id"].alias("commit"), F.col("last_updated").alias("ts"), F.explode(F.arrays_zip(F.transform(role("file"), lambda x: x["node_id"]).alias("file"), F.col("f").alias("f"))).alias("z"))
        a = e.filter("kind = 'Authored'").select(role("commit")[0]["node_id"].alias("commit"), role("author")[0]["node_id"].alias("author"))
        z = lambda c: F.coalesce(F.col(f"z.f.{c}"), F.lit(0))
        return m.join(a, "commit", "left").select("commit", F.col("z.file").alias("file"), "author", "ts", z("added").alias("added"), z("deleted").alias("deleted"))

    def analyze(self, force: bool = False) -> list[str]:
        """Runs the analysers, in their order, whose inputs changed; returns their names."""
        ran = []
        for a in self.analyzers:
            if force or a.needs_rerun(self):
                self.report(a.name)
                mark = a.fingerprint(self)
                for kind, df in a.run(self).items():
                    rest = [c for c in df.columns if c != "node_id"]
                    self.store.store_analyses(df.select("node_id", F.lit(kind).alias("kind"), F.to_json(F.struct(*rest)).alias("data")))
                self.store.set_checkpoint(f"analysis:{a.name}", mark)
                ran.append(a.name)
        return ran

    def nodes(self, *kinds: str) -> DataFrame:
        n = self.store.read("nodes")
        return n.filter(F.col("kind").isin(*kinds)) if kinds else n

    def meta(self, field: str, kind: str = "string"):
        return F.get_json_object("metadata", f"$.{field}").cast(kind)

    def graph(self, view: str, src: str, dst: str) -> DataFrame:
        return self.view(view).select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(1.0).alias("weight"))

    def call_graph(self) -> DataFrame:
        return self.graph("call_graph", "caller", "callee")

    def import_graph(self) -> DataFrame:
        return self.graph("import_graph", "importer", "imported")

    def result(self, kind: str, **fields: str) -> DataFrame:
        """A kind's results as columns: result('CompositeSalience', score='double')."""
        a = self.store.read("analysis_results").filter(F.col("kind") == kind)
        return a.select("node_id", *[F.get_json_object("data", f"$.{c}").cast(t).alias(c) for c, t in fields.items()])

    def status(self) -> DataFrame:
        return self.store.stats()

    def query(self, name: str) -> DataFrame:
        return R.entity_lookup(self.store.read("nodes"), name)

    def top(self, kind: str, field: str, k: int = 10, scope: str | None = None) -> DataFrame:
        return R.ranked_metric(self.result(kind, **{field: "double"}).select(F.col("node_id").alias("node"), F.col(field).alias("score")), self.store.read("nodes").select("id", "name"), k, scope)

    def named(self, kind: str, name: str = "file", **fields: str) -> DataFrame:
        """A kind's results with their nodes' names."""
        n = self.store.read("nodes").select(F.col("id").alias("node_id"), F.col("name").alias(name))
        return self.result(kind, **fields).join(n, "node_id").drop("node_id")

    def risks(self) -> DataFrame:
        n = self.nodes("File").select(F.col("id").alias("node_id"), F.col("name").alias("file"))
        j = n.join(self.result("CompositeSalience", pagerank="double"), "node_id", "left").join(self.result("ContributorConcentration", bus_factor="int"), "node_id", "left")
        j = j.join(self.result("StabilityClassification", classification="string").withColumnRenamed("classification", "stability"), "node_id", "left").join(R.tested(n), "file", "left")
        j = j.join(self.view("document_references").select(F.col("code_entity").alias("node_id"), F.lit(True).alias("has_docs")).distinct(), "node_id", "left")
        j = j.join(self.result("CentralityTrend", trend="string"), "node_id", "left").join(self.result("DocumentationFreshness", staleness_risk="double").withColumnRenamed("staleness_risk", "staleness"), "node_id", "left")
        j = j.join(self.result("CorrectionHotspot", correction_rate="double"), "node_id", "left").join(self.result("PromptHotspot", reference_count="int").withColumnRenamed("reference_count", "prompt_refs"), "node_id", "left")
        return R.risk_map(j.select("file", "pagerank", "has_test", "bus_factor", "stability", "has_docs", "trend", "staleness", "correction_rate", "prompt_refs"))

    def risk_check(self, threshold: float = 0.7, changed: DataFrame | None = None) -> DataFrame:
        """Q8: files (of the changed ones, if told) over the threshold by the gate's score; none means that the check passes."""
        n = self.nodes("File").select(F.col("id").alias("node_id"), F.col("name").alias("file"))
        n = n if changed is None else n.join(changed.select("file").distinct(), "file", "left_semi")
        j = n.join(self.result("CompositeSalience", score="double"), "node_id", "left").join(self.result("ContributorConcentration", bus_factor="int"), "node_id", "left").join(self.result("ChangeFrequency", total="int"), "node_id", "left")
        return j.select("file", S.gate_score(F.col("score"), F.col("bus_factor"), F.col("total")).alias("risk_score"), F.col("score").alias("salience"), "bus_factor", F.col("total").alias("change_frequency")).filter(F.col("risk_score") > threshold)

    # Q10: what the tools answer

    def tool_query(self, name: str, kind: str | None = None, k: int = 20) -> DataFrame:
        known = next((x for x, words in D.KINDS.items() if kind and kind.lower() in words.split()), kind)
        n = self.nodes(*([known] if known else [])).filter(F.contains(F.lower("name"), F.lit(name.lower())))
        j = n.join(self.result("CompositeSalience", score="double", classification="string").withColumnRenamed("node_id", "id"), "id", "left")
        return D.counted(j.select("id", "kind", "name", "score", "classification"), k, F.col("name"), F.col("id"))

    def tool_graph(self, metric: str = "pagerank", k: int = 10, scope: str | None = None) -> DataFrame:
        kind, field = {"pagerank": ("PageRank", "rank"), "betweenness": ("BetweennessCentrality", "betweenness"), "hits": ("HITSScore", "authority"), "salience": ("CompositeSalience", "score")}[metric]
        return self.top(kind, field, k, scope)

    def tool_risk(self, path: str) -> DataFrame:
        n = self.nodes("File").filter(F.col("name") == path).select(F.col("id").alias("node_id"), F.col("name").alias("file"))
        j = n.join(self.result("CompositeSalience", score="double"), "node_id", "left").join(self.result("ContributorConcentration", bus_factor="int"), "node_id", "left").join(self.result("ChangeFrequency", total="int"), "node_id", "left")
        return j.select("file", "score", "bus_factor", "total", S.risk_level(F.col("score"), F.col("bus_factor"), F.col("total")).alias("risk_level"))

    def tool_co_changes(self, path: str, k: int = 10) -> DataFrame:
        p = self.partners().filter(F.col("file") == path)
        return p.select("partner", "co_occurrences", "confidence", "rank").orderBy("rank").limit(k)

    def tool_conventions(self, category: str | None = None) -> DataFrame:
        kinds = {"naming": "NamingPattern", "testing": "TestingPattern", "error_handling": "ErrorHandlingPattern", "documentation": "DocumentationStylePattern"}
        a = self.store.read("analysis_results").filter(F.col("kind").isin(*([kinds[category]] if category else kinds.values())))
        return a.select("kind", "data")

    def diff(self, old: str, new: str) -> tuple[DataFrame, DataFrame]:
        """Q5, Q11: (counts by what happened, impact of each changed file) between two commits."""
        d = materialised(history.name_status(self.spark, self.repo, old, new), "diff")
        name = self.nodes("File").select(F.col("id").alias("node_id"), F.col("name").alias("file"))
        at = lambda df: df.join(name, "node_id").drop("node_id")
        imp = self.import_graph().join(name.select(F.col("node_id").alias("src"), F.col("file").alias("s")), "src").join(name.select(F.col("node_id").alias("dst"), F.col("file").alias("t")), "dst").select(F.col("s").alias("src"), F.col("t").alias("dst"))
        co = self.partners().select(F.col("file").alias("a"), F.col("partner").alias("b"))
        modules = self.nodes("File").select(F.col("name").alias("file"), D.dir_of(F.col("name")).alias("module"))
        impact = R.impact(d.select(F.col("path").alias("file")), modules, imp, co, at(self.result("CompositeSalience", score="double")), at(self.result("ContributorConcentration", bus_factor="int")))
        return D.topology(d), impact

    def partners(self) -> DataFrame:
        """(file, partner, co_occurrences, confidence, rank) by names, of what is stored with the change frequencies."""
        kind = "array<struct<file:string,co_occurrences:bigint,confidence:double,support:double,rank:int>>"
        a = self.store.read("analysis_results").filter("kind = 'ChangeFrequency'").select("node_id", F.explode(F.from_json(F.get_json_object("data", "$.co_change_partners"), kind)).alias("p"))
        n = self.store.read("nodes").select(F.col("id").alias("node_id"), "name")
        return a.join(n, "node_id").select(F.col("name").alias("file"), F.col("p.file").alias("partner"), "p.co_occurrences", "p.confidence", "p.rank")

    def render(self, folder: str, only: list[str] | None = None, leave: list[str] | None = None, merge: bool = True) -> list[str]:
        """Q6: writes the documents of these renderers (all by default) but those left out; returns those that changed."""
        head = history.git(self.repo, "rev-parse", "HEAD").strip()
        out = []
        for r in self.renderers:
            if (only is None or r.name in only) and r.name not in (leave or []):
                out += [n for n, text in r.render(self, head).items() if render.write(f"{folder}/{n}", text, merge)]
        return out


def _by_node(df: DataFrame, key: str = "file") -> DataFrame:
    return df.withColumnRenamed(key, "node_id")


def _behavioral(e: Engine) -> dict[str, DataFrame]:
    ch = materialised(e.changes(), "changes")
    n = e.store.read("nodes").select(F.col("id").alias("partner"), F.col("name").alias("partner_name"))
    p = B.cochange_partners(B.cochange_pairs(ch)).join(n, "partner")
    p = p.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("rank", F.struct(F.col("partner_name").alias("file"), "co_occurrences", "confidence", "support", "rank").alias("p")))).alias("ps"))
    freq = B.change_frequency(ch).join(p, "file", "left").withColumn("co_change_partners", F.transform("ps", lambda x: x["p"])).drop("ps")
    refs = materialised(e.view("document_references").join(e.store.read("hyperedges").select(F.col("id").alias("edge"), "last_updated"), "edge").select("document", F.col("code_entity").alias("file"), F.col("last_updated").alias("ts")), "doc-refs")
    files_ = e.nodes("File").select(F.col("id").alias("file"), e.meta("language").alias("language"))
    sal = e.result("CompositeSalience", score="double").withColumnRenamed("node_id", "file")
    return {
        "ChangeFrequency": _by_node(freq), "ChurnVelocity": _by_node(B.churn_velocity(ch)), "ContributorConcentration": _by_node(B.contributor_concentration(ch)),
        "DocumentationCoverage": _by_node(B.doc_coverage(files_, refs)), "DocumentationFreshness": _by_node(B.doc_freshness(ch, refs.filter("ts IS NOT NULL"), sal)),
    }


def _centrality(e: Engine) -> dict[str, DataFrame]:
    call, imp = materialised(e.call_graph(), "calls"), materialised(e.import_graph(), "imports")
    pr, hits, bc = (materialised(x, "centrality") for x in (C.pagerank(call), C.hits(call), C.betweenness(imp)))
    f = pr.withColumnRenamed("rank", "pagerank").join(hits, "node", "full").join(bc, "node", "full")
    sizes = e.nodes("File").select(F.col("name").alias("path"), F.coalesce(e.meta("size_bytes", "bigint"), F.lit(0)).alias("size"))
    own = D.size_and_tests(e.nodes("File", "Function").select("id", "kind", "name"), sizes).withColumnRenamed("id", "node")
    for kind, field in (("ChangeFrequency", "percentile"), ("ContributorConcentration", "bus_factor")):
        f = f.join(e.result(kind, **{field: "double"}).withColumnRenamed("node_id", "node"), "node", "left")
    # sizes come in [0, 1] already, and salience() divides by the greatest of 1 and the greatest of all
    f = f.join(own, "node", "left").select("node", "pagerank", "betweenness", "authority", F.col("percentile").alias("change_percentile"), "bus_factor", "code_size", "test_presence")
    sal = materialised(S.salience(f), "salience")
    return {
        "PageRank": _by_node(C.ranked(pr, "rank", call).toDF("node_id", "rank", "place", "in_degree", "out_degree"), "node_id"), "HITSScore": _by_node(hits.withColumn("classification", C.hits_class(F.col("hub"), F.col("authority"))), "node"),
        "BetweennessCentrality": _by_node(C.ranked(bc, "betweenness", imp), "node"), "CompositeSalience": _by_node(sal, "node"),
        "StabilityClassification": sal.select(F.col("node").alias("node_id"), S.stability_class(F.col("pagerank"), F.col("change_frequency")).alias("classification"), F.col("pagerank").alias("centrality"), F.col("change_frequency").alias("churn")),
    }


def _community(e: Engine) -> dict[str, DataFrame]:
    parent = e.nodes("Function").select(F.col("id").alias("child"), node_id(F.lit("File"), F.regexp_replace("name", "::[^:]*$", "")).alias("file"))
    g = materialised(K.file_projection(e.import_graph(), e.call_graph(), parent), "files-graph")
    com = materialised(K.communities(g), "communities")
    n = e.nodes("File").select(F.col("id").alias("node"), D.dir_of(F.col("name")).alias("dir"))
    at = K.directory_alignment(com.join(n, "node").withColumnRenamed("node", "file"))
    q = K.modularity(g, com).select("community", F.round("contribution", 3).alias("modularity_contribution"))
    out = {"CommunityAssignment": _by_node(at.join(q, "community", "left").select("file", F.col("community").alias("community_id"), "directory_aligned", "modularity_contribution"))}
    first = com.agg(F.min("node").alias("node_id")).filter("node_id IS NOT NULL")
    return out | {"ArchitecturalDrift": first.crossJoin(F.broadcast(K.coupling(g, com)))}  # one row each


def _convention(e: Engine) -> dict[str, DataFrame]:
    root = R.root_module(e.nodes("Module").select("id", "name", e.meta("is_root", "boolean").alias("is_root"))).select(F.col("id").alias("node_id"))
    one = lambda df: root.crossJoin(F.broadcast(df))  # noqa: E731  one row each
    nm = V.naming(e.nodes("Function", "Type").select("name"))
    ax = V.affixes(e.nodes("Function").select("name"))
    af = ax.agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("rank", "part", "count")))), lambda x: F.struct(x["part"].alias("part"), x["count"].alias("count"))).alias(f"common_{k}es") for k in ("prefix", "suffix")])
    conv = nm.agg(F.array_sort(F.collect_list(F.struct("rank", "convention", "count", "percentage"))).alias("conventions"), F.coalesce(F.max_by("convention", F.struct((-F.col("rank")).alias("r"))), F.lit("unknown")).alias("dominant"), F.coalesce(F.max_by("percentage", F.struct((-F.col("rank")).alias("r"))) / 100, F.lit(0.0)).alias("adherence_rate"))
    paths = e.nodes("File").select(F.col("name").alias("path"))
    src = materialised(files.tree(e.spark, e.repo).select("path", files.language(F.col("path")).alias("language"), "content"), "sources")
    errors = materialised(V.error_handling(src), "errors")
    marks = errors.groupBy("pattern").agg(F.sum("count").alias("count")).agg(F.collect_list(F.struct("pattern", "count")).alias("patterns"))
    ds = V.doc_style(e.nodes("Function", "Type").select(e.meta("doc").alias("doc"), F.lit("comment").alias("style")))
    return {
        "NamingPattern": one(conv.crossJoin(F.broadcast(af))), "TestingPattern": one(V.testing(paths).crossJoin(F.broadcast(V.test_framework(src.filter("path NOT LIKE '%/%'"))))),
        "ErrorHandlingPattern": one(V.error_approach(errors).crossJoin(F.broadcast(marks))), "DocumentationStylePattern": one(ds.agg(F.collect_list(F.struct("style", "documented")).alias("styles"), F.coalesce(F.max("n_documented"), F.lit(0)).alias("documented_count"), F.coalesce(F.max("total"), F.lit(0)).alias("total_entities"))),
    }


#: Each after what it reads.
ANALYZERS = (
    Analyzer("behavioral", ("ChangeFrequency", "ChurnVelocity", "ContributorConcentration", "DocumentationCoverage", "DocumentationFreshness"), ("Modifies", "Authored", "Documents", "File"), _behavioral),
    Analyzer("centrality", ("PageRank", "HITSScore", "BetweennessCentrality", "CompositeSalience", "StabilityClassification"), ("Calls", "Imports", "File", "Function", "ChangeFrequency", "ContributorConcentration"), _centrality),
    Analyzer("community", ("CommunityAssignment", "ArchitecturalDrift"), ("Calls", "Imports", "File"), _community),
    Analyzer("convention", ("NamingPattern", "TestingPattern", "ErrorHandlingPattern", "DocumentationStylePattern"), ("File", "Function", "Type", "Module"), _convention),
)


def _guide(e: Engine, head: str) -> dict[str, str]:
    f = e.nodes("File")
    commands = e.nodes("Module").select(F.explode(F.from_json(e.meta("ci_commands"), "array<string>")).alias("command"))
    com = e.named("CommunityAssignment", community_id="bigint").select(F.col("community_id").alias("community"), "file")
    docs = e.nodes("Document").select("name", e.meta("title").alias("title"))
    refs = e.view("document_references").groupBy("document").agg(F.count(F.lit(1)).alias("references"))
    entities = e.nodes("Function", "Type").select(F.regexp_replace("name", "::[^:]*$", "").alias("path"), "kind").unionByName(f.select(F.col("name").alias("path"), F.lit("File").alias("kind")))
    naming = e.tool_conventions()
    parts = {
        "Build and test commands": D.build_commands(commands, f.select(F.col("name").alias("path"))),
        "Architecture": R.cluster_labels(com).select("label", F.slice("files", 1, 5).alias("files")).orderBy("label"),
        "Key documents": e.nodes("Document").select(F.col("id").alias("document"), "name").join(refs, "document", "left").select("name", F.coalesce("references", F.lit(0)).alias("references")).orderBy(F.desc("references"), "name").limit(10),
        "Modules": D.module_map(entities).orderBy("module"),
        "Load-bearing code": D.load_bearing(e.named("CompositeSalience", "name", score="double", classification="string")),
        "Change patterns": e.top("ChangeFrequency", "total"),
        "Files that change together": D.strongest_partners(e.partners()),
        "Danger zones": D.danger_zones(e.named("ContributorConcentration", bus_factor="int", top_contributor_share="double"), e.named("ChangeFrequency", total="int")),
        "Languages": D.languages(f.select(e.meta("language").alias("language"))).orderBy(F.desc("files"), "language"),
        "Conventions": naming,
        "Design decisions": D.decisions(docs),
        "Contents": e.status(),
    }
    return {"AGENTS.md": render.sections("Repository guide", parts, head)}


def _modules(e: Engine, head: str) -> dict[str, str]:
    score = e.named("CompositeSalience", "name", score="double").select(F.regexp_replace("name", "::[^:]*$", "").alias("path"), "name", "score")
    rows = render.module_contexts(score, e.nodes("File").select(F.col("name").alias("path"))).collect()  # a row a directory of one work tree
    return {f"{'' if r.dir == '.' else r.dir + '/'}.context.md": r.text for r in rows}


def _topos(e: Engine, head: str) -> dict[str, str]:
    types = e.nodes("Type").select("id", "name", F.regexp_replace("name", "::[^:]*$", "").alias("file"), e.meta("doc").alias("doc"))
    issues = e.nodes("Issue").select(F.col("name").alias("issue"), e.meta("title").alias("title"), e.meta("state").alias("state"))
    com = e.named("CommunityAssignment", community_id="bigint").select(F.col("community_id").alias("community"), "file")
    parts = {
        "Principles": D.decisions(e.nodes("Document").select("name", e.meta("title").alias("title"))), "Design": R.cluster_labels(com).select("label", F.size("files").alias("files")).orderBy("label"),
        "Concepts": D.concepts(types, e.result("CompositeSalience", score="double").withColumnRenamed("node_id", "id")), "Requirements": D.requirements(issues, issues.select("issue", F.lit(None).cast("string").alias("request"))),
        "Tasks": e.nodes("PullRequest").select("name", e.meta("title").alias("title"), e.meta("state").alias("state")).orderBy("name").limit(20),
    }
    return {"spec.tps.md": render.sections("Specification", parts, head)}


def _report(e: Engine, head: str) -> dict[str, str]:
    parts = {
        "Summary": e.status(), "Hotspots": e.top("ChangeFrequency", "total", 20), "Coupling": D.strongest_partners(e.partners(), 3, 10), "Risk": e.risks().filter("score > 0").orderBy(F.desc("score"), "file").select("file", "level", "score"),
        "Documentation": e.named("DocumentationCoverage", status="string").groupBy("status").agg(F.count(F.lit(1)).alias("files")), "Team": e.named("ContributorConcentration", bus_factor="int", unique_authors="int").orderBy("bus_factor", "file"),
        "Drift": e.result("ArchitecturalDrift", coupling_ratio="double", cross_community_edges="int", total_edges="int").drop("node_id"), "Conventions": e.tool_conventions(),
    }
    return {"report.html": render.report("Repository report", parts)}


def _skills(e: Engine, head: str) -> dict[str, str]:
    ch = e.changes().join(e.nodes("File").select(F.col("id").alias("file"), "name"), "file").select("commit", F.col("name").alias("file"))
    groups = materialised(B.cochange_groups(B.cochange_pairs(ch)), "groups")
    g = groups.join(B.group_cooccurrence(ch, groups), "members")
    none = e.spark.createDataFrame([], "files array<string>, frequency bigint")
    return {f"skills/{n}.md": t for n, t in render.skill_documents(R.skills(none, g)).items()}


RENDERERS = (
    Renderer("agents_md", _guide), Renderer("risk_map", lambda e, head: {"risk-map.json": render.risk_map_json(e.risks(), head)}), Renderer("report", _report),
    Renderer("module_context", _modules), Renderer("topos_spec", _topos), Renderer("skills", _skills),
)
