"""What guides, module contexts, reports and specifications are made of: each part is a query of its own.

Paths, names and scores come as columns, so any part can be made from stored analyses or from tables; the parts that a reader
sees are the first k by a total order, which each task keeps for itself.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions.text import dir_of, directory, is_test_file, leaf_name, source_of_test

#: What a user may call a kind of node.
KINDS = {"Commit": "commit", "Contributor": "author contributor", "Document": "doc document", "ExternalDep": "dep dependency", "File": "file", "Function": "fn function", "Issue": "issue", "Module": "dir directory module", "PullRequest": "pr pullrequest", "Type": "class struct type"}
#: Names that say nothing of a module.
BOILERPLATE = ("clone", "default", "drop", "eq", "fmt", "from", "hash", "into", "new")
#: A word in a directory, its rank among such words, what a cluster there is called.
MEANINGS = {
    "bench": (15, "Benchmarks"), "commands": (5, "CLI Commands"), "config": (11, "Configuration"), "analyze": (1, "Analysis Engine"), "extract": (2, "Data Extraction"), "graph": (10, "Graph Engine"), "llm": (8, "LLM Integration"), "languages": (6, "Language Support"),
    "mcp": (9, "MCP Server"), "query": (13, "Query Engine"), "pipeline": (12, "Pipeline"), "render": (3, "Output Rendering"), "spec": (16, "Specification"), "store": (4, "Storage Layer"), "types": (14, "Type Definitions"), "test": (7, "Test Suite"),
}
#: Commands by the manifest at the root, where no commands were found.
DEFAULT_COMMANDS = {"Cargo.toml": ["cargo build", "cargo test"], "go.mod": ["go build ./...", "go test ./..."], "package.json": ["npm install", "npm test"], "pyproject.toml": ["pip install -e .", "pytest"]}


def kind_of(text: Column) -> Column:
    """the kind that a word means, whatever its case; null for another word."""
    return F.create_map(*[F.lit(x) for kind, words in KINDS.items() for w in words.split() for x in (w, kind)])[F.lower(text)]


def project(df: DataFrame, always: list[str], parts: dict[str, list[str]], include: list[str] | None = None) -> DataFrame:
    """the columns that are always told and those of the parts that are asked for (all by default); unknown parts are passed over."""
    return df.select(*always, *[c for name, cols in parts.items() if include is None or name in include for c in cols])


def counted(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """K4: the first k rows, each with how many there are in all."""
    return df.orderBy(*order).limit(k).crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("total"))))  # one row


def load_bearing(salience: DataFrame, k: int = 20) -> DataFrame:
    """K6: salience (name, score, classification): the k of the highest score, by leaf name."""
    return salience.orderBy(F.desc("score"), "name").limit(k).select(leaf_name(F.col("name")).alias("entity"), "name", F.round("score", 2).alias("score"), F.coalesce("classification", F.lit("Unknown")).alias("classification"))


def danger_zones(bus: DataFrame, changes: DataFrame, k: int = 10) -> DataFrame:
    """K6: bus (file, bus_factor, top_contributor_share) and changes (file, total): files of one contributor at most that changed three
    times and more, the most changed first."""
    j = bus.join(changes.select("file", "total"), "file", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    j = j.filter((F.coalesce("bus_factor", F.lit(0)) <= 1) & (F.col("total") >= 3))
    return j.orderBy(F.desc("total"), "file").limit(k).select("file", "total", "bus_factor", F.round(F.coalesce("top_contributor_share", F.lit(0.0)) * 100).alias("top_share"))


def strongest_partners(partners: DataFrame, each: int = 3, k: int = 5) -> DataFrame:
    """K6: partners (file, partner, confidence, rank): of each file's first ones every pair once, the k of the highest confidence."""
    p = partners.filter(F.col("rank") <= each).groupBy(F.least("file", "partner").alias("a"), F.greatest("file", "partner").alias("b")).agg(F.max("confidence").alias("confidence"))
    return p.orderBy(F.desc("confidence"), "a", "b").limit(k)


def concepts(types: DataFrame, salience: DataFrame, k: int = 20) -> DataFrame:
    """K8: types (id, name, file, doc) and salience (id, score): the k of the highest salience, with the first line that is told of
    each."""
    j = types.join(salience.select("id", "score"), "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return j.orderBy(F.desc("score"), "name").limit(k).select(leaf_name(F.col("name")).alias("concept"), "file", F.round("score", 2).alias("salience"), F.element_at(F.split("doc", "\n"), 1).alias("description"))


def modules_of(changed: DataFrame) -> DataFrame:
    """The directories of changed files (file), each once, in order; files at the root have none."""
    return changed.filter(F.contains("file", F.lit("/"))).select(directory(F.col("file")).alias("module")).distinct().orderBy("module")


def module_map(entities: DataFrame) -> DataFrame:
    """Entities (path, kind): files, functions and types by directory."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    return entities.groupBy(dir_of(F.col("path")).alias("module")).agg(F.countDistinct("path").alias("files"), n("Function").alias("functions"), n("Type").alias("types"))


def topology(entries: DataFrame) -> DataFrame:
    """Entries (status) of a diff by what happened, from the letters that git gives (R100 is a rename)."""
    s = F.upper(F.substring("status", 1, 1))
    return entries.agg(*[F.count_if(s.isin(*letters)).alias(name) for name, letters in (("added", "AC"), ("modified", "MT"), ("deleted", "D"), ("renamed", "R"))])


def build_commands(commands: DataFrame, files: DataFrame) -> DataFrame:
    """Commands (command), trimmed, longer than two letters, without pipes, each once; where there are none, those of the manifests
    at the root (files: path)."""
    c = commands.select(F.trim("command").alias("command")).filter((F.length("command") > 2) & ~F.contains("command", F.lit("|"))).distinct()
    default = files.filter(F.col("path").isin(*DEFAULT_COMMANDS)).select(F.explode(F.create_map(*[x for m, cs in DEFAULT_COMMANDS.items() for x in (F.lit(m), F.array(*map(F.lit, cs)))])[F.col("path")]).alias("command"))
    some = c.limit(1).select(F.lit(True).alias("some"))
    return c.unionByName(default.distinct().join(F.broadcast(some), F.lit(True), "left_anti"))  # a row or none


def languages(files: DataFrame) -> DataFrame:
    """Files by language (null left out), with their share in percent."""
    g = files.filter("language IS NOT NULL").groupBy("language").agg(F.count(F.lit(1)).alias("files"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("files").alias("n")))).select("language", "files", F.round(F.col("files") / F.col("n") * 100, 1).alias("percent"))


def task_name(files: Column) -> Column:
    """A15: "modify" with what the directories of all files (an array) begin with, letter by letter; else with the commonest extension
    (ties by name), else with their number."""
    dirs = F.transform(files, directory)
    first = F.element_at(dirs, 1)
    same = F.filter(F.transform(F.sequence(F.lit(0), F.length(first)), lambda n: F.substring(first, F.lit(1), n)), lambda x: F.forall(dirs, lambda d: d.startswith(x)))
    folder = F.regexp_replace(F.element_at(same, -1), "/+$", "")
    ends = F.filter(F.transform(files, lambda p: F.regexp_extract(p, r"[^/]\.([^./]+)$", 1)), lambda e: e != "")
    best = F.array_min(F.transform(F.array_distinct(ends), lambda e: F.struct((-F.size(F.filter(ends, lambda x: x == e))).alias("n"), e.alias("e"))))["e"]
    rest = F.when(F.size(files) == 0, "unknown task").when(F.size(ends) > 0, F.concat(F.lit("modify ."), best, F.lit(" files"))).otherwise(F.concat(F.lit("modify "), F.size(files).cast("string"), F.lit(" files")))
    return F.when((F.size(files) > 0) & (folder != ""), F.concat(F.lit("modify "), folder)).otherwise(rest)


def common_tasks(patterns: DataFrame, k: int = 10, n: int = 3) -> DataFrame:
    """Patterns (files, frequency): the k most frequent with their names and n files each."""
    return patterns.orderBy(F.desc("frequency"), F.array_join("files", "\n")).limit(k).select(task_name(F.col("files")).alias("task"), F.slice("files", 1, n).alias("files"), "frequency")


def vocabulary(terms: DataFrame, k: int = 20, n: int = 3) -> DataFrame:
    """Terms (file, entities, reference_count): the k most referred to, with n entities each by leaf name."""
    return terms.orderBy(F.desc("reference_count"), "file").limit(k).select("file", F.slice(F.transform("entities", leaf_name), 1, n).alias("entities"), "reference_count")


def decisions(documents: DataFrame) -> DataFrame:
    """Documents (name, title) whose name speaks of decisions."""
    return documents.filter(F.lower("name").rlike("adr|decision"))


def key_entities(entities: DataFrame, k: int = 20) -> DataFrame:
    """Entities (path, name, score): the k of a directory with the highest score, ties by name; none without salience, and none
    whose name says nothing."""
    e = entities.filter(F.col("score") > 0).withColumn("entity", leaf_name(F.col("name"))).filter(~F.col("entity").isin(*BOILERPLATE)).withColumn("module", dir_of(F.col("path")))
    return e.withColumn("rank", F.row_number().over(W.partitionBy("module").orderBy(F.desc("score"), "entity", "path"))).filter(F.col("rank") <= k).select("module", "entity", "path", "score", "rank")


def module_dependencies(imports: DataFrame) -> DataFrame:
    """Imports (importer, imported: paths): of each directory those that it imports from, and those that import from it."""
    d = imports.select(dir_of(F.col("importer")).alias("src"), dir_of(F.col("imported")).alias("dst")).filter("src != dst").distinct()
    both = d.select(F.col("src").alias("module"), F.col("dst").alias("to"), F.lit(None).cast("string").alias("from")).unionByName(d.select(F.col("dst").alias("module"), F.lit(None).cast("string").alias("to"), F.col("src").alias("from")))
    return both.groupBy("module").agg(F.array_sort(F.collect_set("to")).alias("imports_from"), F.array_sort(F.collect_set("from")).alias("imported_by"))


def module_profile(files: DataFrame, partners: DataFrame, k: int = 5) -> DataFrame:
    """Files (path, total, bus_factor, score, stability) and partners (path, partner: paths): of each directory the files, changes,
    their whole mean, the least bus factor, the peak salience, the commonest stability (ties by name) and k directories at most that
    change with it."""
    f = files.withColumn("module", dir_of(F.col("path")))
    g = f.groupBy("module").agg(F.count(F.lit(1)).alias("files"), F.sum("total").alias("changes"), F.expr("sum(total) div count(1)").alias("mean_changes"), F.min("bus_factor").alias("min_bus_factor"), F.max("score").alias("peak_salience"))
    s = f.filter("stability IS NOT NULL").groupBy("module", "stability").agg(F.count(F.lit(1)).alias("n"))
    s = s.groupBy("module").agg(F.min(F.struct((-F.col("n")).alias("n"), "stability"))["stability"].alias("stability"))
    p = partners.select(dir_of(F.col("path")).alias("module"), dir_of(F.col("partner")).alias("other")).filter("module != other")
    p = p.groupBy("module").agg(F.slice(F.array_sort(F.collect_set("other")), 1, k).alias("changes_with"))
    return g.join(s, "module", "left").join(p, "module", "left")


def recent_labels(changes: DataFrame, newest: int = 200, k: int = 5) -> DataFrame:
    """Changes (commit, ts, path, label): of the newest commits, up to k different labels a directory, the newest first."""
    last = changes.select("commit", "ts").distinct().orderBy(F.desc("ts"), F.desc("commit")).limit(newest)
    c = changes.join(F.broadcast(last.select("commit")), "commit", "left_semi")  # `newest` rows at most
    g = c.groupBy(dir_of(F.col("path")).alias("module"), "label").agg(F.max("ts").alias("ts"))
    return g.withColumn("rank", F.row_number().over(W.partitionBy("module").orderBy(F.desc("ts"), "label"))).filter(F.col("rank") <= k).select("module", "label", "rank")


def requirements(issues: DataFrame, resolved: DataFrame, k: int = 50) -> DataFrame:
    """Issues (issue, title, state) and resolved (issue, request): the first k issues by number, each with the least of the
    requests that resolve it."""
    by = resolved.groupBy("issue").agg(F.min("request").alias("resolved_by"))
    return issues.orderBy("issue").limit(k).join(by, "issue", "left")


def undocumented_prefixes(affixes: DataFrame, rules: DataFrame, least: int = 5) -> DataFrame:
    """Customary prefixes (kind, part, count) that names have `least` times and more and no rule file (content) mentions."""
    p = affixes.filter((F.col("kind") == "prefix") & (F.col("count") >= least)).select("part", "count")
    # as many prefixes as are customary, so the broadcast has a bound
    told = rules.select("content").join(F.broadcast(p.select(F.col("part").alias("told"))), F.contains("content", F.col("told"))).select(F.col("told").alias("part")).distinct()
    return p.join(told, "part", "left_anti")


def size_and_tests(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """GR7: nodes (id, kind, name) and files (path, size): each node's code size over the greatest, and 1.0 if its file is a test or a
    test is named for it. A function's file is what stands before the last '::'. Null where the file isn't known."""
    top = files.agg(F.greatest(F.lit(1), F.max("size")).cast("double").alias("top"))
    t = files.filter(is_test_file(F.col("path")))
    tests = t.select("path").unionByName(t.select(source_of_test(F.col("path")).alias("path"))).filter("path IS NOT NULL").distinct().withColumn("tested", F.lit(1.0))
    f = files.join(tests, "path", "full").crossJoin(F.broadcast(top)).select("path", (F.col("size") / F.col("top")).alias("code_size"), "tested")  # one row
    path = F.when(F.col("kind") == "Function", F.regexp_replace("name", "::[^:]*$", "")).otherwise(F.col("name"))
    return nodes.withColumn("path", path).join(f, "path", "left").select("id", "code_size", F.coalesce("tested", F.lit(0.0)).alias("test_presence"))


def cluster_name(folder: Column) -> Column:
    """What a directory's name means, by the first of the known words that it holds; else its last part in title case."""
    low = F.lower(folder)
    meant = F.coalesce(*[F.when(F.contains(low, F.lit(w)), F.lit(name)) for w, (_, name) in sorted(MEANINGS.items(), key=lambda x: x[1])])
    words = F.filter(F.split(F.element_at(F.split(folder, "/"), -1), "[_-]"), lambda w: w != "")
    title = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")
    return F.when(folder == "", "Root").otherwise(F.coalesce(meant, title))


#: Q13: exit codes by what an error says, the first that fits.
EXITS = [(10, "partial success"), (3, "not initialized|cannot resolve path"), (2, "config|unknown depth"), (4, "database|sqlite|parquet"), (5, "git(hub|lab) api|rate limit|api auth"), (6, "llm|api_key"), (7, "render"), (8, "mcp")]


def exit_code(error: str | None) -> int:
    """0 without an error, 1 for one of another kind."""
    return 0 if error is None else next((code for code, rx in EXITS if re.search(rx, error.lower())), 1)


def provenance(nodes: Column, model: str | None = None, template: str | None = None, input_hash: Column | None = None, confidence: str | None = None) -> Column:
    """What a result was made from, and by: computed from nodes (an array of ids), or told by a model."""
    return F.struct(F.lit("algorithmic" if model is None else "llm_derived").alias("kind"), nodes.cast("array<bigint>").alias("nodes"), F.lit(model).cast("string").alias("model_id"), F.lit(template).cast("string").alias("prompt_template"), (input_hash if input_hash is not None else F.lit(None)).cast("bigint").alias("input_hash"), F.lit(confidence).cast("string").alias("confidence"))
