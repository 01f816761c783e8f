"""Risk of files, impact of changes, entity look-up: the read queries of the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions.text import directory, is_test_file, mentions_test
from lodestrata.operators.guide import cluster_name

#: Reason, its part of the score, and what is advised for it.
REASONS = {
    "high_centrality_low_tests": (0.30, ["Add tests before a change", "Run all tests after a change"]),
    "knowledge_silo": (0.20, ["Ask the main contributor for a review", "Spread what is known by pairing"]),
    "volatile_critical": (0.25, ["Review with extra care: central and often changed"]),
    "undocumented_critical": (0.15, ["Document public entities before a change"]),
    "rising_importance": (0.20, ["Raise test coverage and documentation: growing more central"]),
    "stale_documentation": (0.15, ["Check the documents: they may be out of date"]),
    "agent_confusion_zone": (0.15, ["Look at past corrections of agents here"]),
    "underprompted": (0.10, ["Review by hand: agents have hardly worked here"]),
}
#: Letters by which stems and paths of tests meet.
GRAM = 4
KIND_ORDER = ("File", "Function", "Type", "Module", "Document")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def tested(files: DataFrame, rule: str = "reference") -> DataFrame:
    """(file, has_test). By the rule "reference": whether the file's stem, its name up to the first dot, stands anywhere in
    the path of a file that mentions tests (N41; an empty stem stands in each). Not by a nested loop: the first letters of a stem
    meet the runs of up to GRAM letters of the tests' paths, and a semi-join looks no further than the first path that holds the
    stem. By the rule "customs": whether a test is named for the file, as the languages' customs have it."""
    if rule == "reference":
        f = files.select("file", F.element_at(F.split(F.regexp_extract("file", r"([^/]*)$", 1), r"\."), 1).alias("stem"))
        s = f.select("stem").distinct().withColumn("head", F.substring("stem", 1, GRAM))
        t = files.filter(mentions_test(F.col("file"))).select(F.col("file").alias("test"))
        grams = F.flatten(F.transform(F.sequence(F.lit(1), F.length("test")), lambda i: F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: F.substring(F.col("test"), i, n))))
        t = t.select("test", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), grams))).alias("head"))
        hit = s.join(t.hint("shuffle_hash"), (s["head"] == t["head"]) & F.contains(F.col("test"), F.col("stem")), "left_semi").select("stem", F.lit(True).alias("has_test"))
        return f.join(hit, "stem", "left").select("file", F.coalesce("has_test", F.lit(False)).alias("has_test"))
    f = files.select("file", stem(F.col("file")).alias("stem"))
    t = files.filter(is_test_file(F.col("file"))).select(F.explode(test_stems(F.col("file"))).alias("stem")).distinct().withColumn("has_test", F.lit(True))
    return f.join(t, "stem", "left").select("file", F.coalesce("has_test", F.lit(False)).alias("has_test"))


def test_stems(path: Column) -> Column:
    """What a test file may be named for: its stem without each of the customary marks."""
    s = stem(path)
    return F.array_distinct(F.array(s, *[F.regexp_replace(s, rx, "") for rx in (r"^test_", r"_test$", r"_spec$", r"\.test$", r"\.spec$", r"Tests?$")]))


def risk_map(files: DataFrame) -> DataFrame:
    """J17, SNK9: files with pagerank, has_test, bus_factor, stability, has_docs, trend, staleness, correction_rate, prompt_refs
    (any but file null for unknown): reasons, score (their parts' sum, 1 at most, to 2 places), level and what is advised."""
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    central = z("pagerank") > 0.5
    hit = {
        "high_centrality_low_tests": central & ~F.coalesce("has_test", F.lit(False)),
        "knowledge_silo": F.coalesce(F.col("bus_factor") <= 1, F.lit(False)),
        "volatile_critical": F.coalesce(F.col("stability") == "ActiveCritical", F.lit(False)),
        "undocumented_critical": central & ~F.coalesce("has_docs", F.lit(False)),
        "rising_importance": F.coalesce(F.col("trend") == "Rising", F.lit(False)),
        "stale_documentation": z("staleness") > 0.5,
        "agent_confusion_zone": z("correction_rate") > 0.2,
        "underprompted": central & (z("prompt_refs") == 0),
    }
    reasons = F.array_compact(F.array(*[F.when(hit[r], F.lit(r)) for r in REASONS]))
    score = F.round(F.least(F.lit(1.0), sum((F.when(hit[r], w).otherwise(0.0) for r, (w, _) in REASONS.items()), F.lit(0.0))), 2)
    level = F.when(score >= 0.7, "high").when(score >= 0.4, "medium").when(score > 0, "low").otherwise("none")
    advice = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for r, (_, a) in REASONS.items() for x in (r, a)])
    out = files.select("file", reasons.alias("reasons"), score.alias("score"), level.alias("level"))
    return out.withColumn("recommendations", F.array_distinct(F.flatten(F.transform("reasons", lambda r: advice[r]))))


def entity_lookup(nodes: DataFrame, name: str) -> DataFrame:
    """Q3: one row: the node of exactly this name, kinds in their order; else the first whose name holds it, by kind and name."""
    rank = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(KIND_ORDER)], F.lit(len(KIND_ORDER)))
    hit = nodes.filter(F.contains("name", F.lit(name)))
    return hit.withColumn("exact", F.col("name") == name).withColumn("__r", rank).orderBy(F.desc("exact"), F.when(F.col("exact"), F.col("__r")), "__r", "name", "id").limit(1).drop("__r")


def impact(changed: DataFrame, belongs: DataFrame, imports: DataFrame, cochange: DataFrame, salience: DataFrame, bus: DataFrame) -> DataFrame:
    """Q5, Q11: changed (file): each with its module, importers, co-change partners, and whether it is salient (over 0.3) or has
    one contributor."""
    c = changed.select("file").distinct()
    imp = imports.join(c.withColumnRenamed("file", "dst"), "dst", "left_semi").groupBy(F.col("dst").alias("file")).agg(F.countDistinct("src").alias("importers"))
    co = cochange.select(F.explode(F.array(F.struct(F.col("a").alias("file"), F.col("b").alias("p")), F.struct(F.col("b").alias("file"), F.col("a").alias("p")))).alias("x")).select("x.*")
    co = co.join(c, "file", "left_semi").groupBy("file").agg(F.countDistinct("p").alias("partners"))
    j = c.join(belongs.select("file", "module"), "file", "left").join(imp, "file", "left").join(co, "file", "left").join(salience.select("file", "score"), "file", "left").join(bus.select("file", "bus_factor"), "file", "left")
    return j.select("file", "module", F.coalesce("importers", F.lit(0)).alias("importers"), F.coalesce("partners", F.lit(0)).alias("partners"), F.coalesce(F.col("score") > 0.3, F.lit(False)).alias("high_salience"), F.coalesce(F.col("bus_factor") <= 1, F.lit(False)).alias("single_owner"))


def ranked_metric(scores: DataFrame, nodes: DataFrame, k: int = 10, scope: str | None = None, missing: float | None = None) -> DataFrame:
    """K1, K2: the k best of nodes (id, name) within a scope by score; a node without one counts as `missing`, or is left out."""
    n = nodes if scope is None else nodes.filter(F.col("name").startswith(scope))
    j = n.join(scores.select(F.col("node").alias("id"), "score"), "id", "left" if missing is not None else "inner")
    return j.select("id", "name", F.coalesce("score", F.lit(missing)).alias("score")).orderBy(F.desc("score"), "name").limit(k)


def root_module(modules: DataFrame) -> DataFrame:
    """Q12: modules (name, is_root): the one marked, else '.', else the shortest name."""
    return modules.orderBy(F.desc(F.coalesce("is_root", F.lit(False))), F.desc(F.col("name") == "."), F.length("name"), "name").limit(1)


def enclosing(refs: DataFrame, spans: DataFrame, block: int = 64) -> DataFrame:
    """W6, GR18: refs (file, ref, at) and spans (file, name, start, end), ends in: each ref's innermost span (of equals the first
    by start, then name). Spans are cut into blocks, so the join is on file and block, and a file of many spans is no nested loop."""
    s = spans.filter("start <= `end`").withColumn("__b", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(F.col("end") / block))))
    r = refs.withColumn("__b", F.floor(F.col("at") / block))
    j = r.join(s, ["file", "__b"]).filter("at BETWEEN start AND `end`")
    best = F.min(F.struct((F.col("end") - F.col("start")).alias("size"), "start", "name", "end")).alias("s")
    return j.groupBy("file", "ref", "at").agg(best).select("file", "ref", "at", F.col("s.name").alias("name"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))


def import_projection(refs: DataFrame) -> DataFrame:
    """Refs (src, dst, symbol, confidence) between different files, by pair: symbols and the least confidence."""
    return refs.filter("src != dst").groupBy("src", "dst").agg(F.array_sort(F.collect_set("symbol")).alias("symbols"), F.min("confidence").alias("confidence"))


def directory_imports(imports: DataFrame) -> DataFrame:
    """Imports (importer, imported: paths) by directory, without those within one: directories imported from."""
    d = imports.select(directory(F.col("importer")).alias("dir"), directory(F.col("imported")).alias("other")).filter("dir != other")
    return d.groupBy("dir").agg(F.array_sort(F.collect_set("other")).alias("imports_from"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """GR19: imports (importer, target) and files (path): the explicit path, else the crate's or the parent's file, else the only
    file whose path holds the name. Candidates are found by equi-joins on the last part of the name; none: null, confidence 0.8,
    else 0.9."""
    leaf = lambda x: F.regexp_replace(F.element_at(F.split(x, r"::|/|\."), -1), r"\W", "")
    t = F.col("target")
    under = F.regexp_replace(F.regexp_replace(t, r"^(crate|super)::", ""), "::", "/")
    parent = F.regexp_replace(F.regexp_extract("importer", "^(.*)/[^/]*$", 1), "/[^/]*$", "")
    i = imports.withColumn("key", leaf(F.regexp_replace(t, r"\.(rs|py|ts|js|go)$", ""))).withColumn("__crate", F.when(t.startswith("crate::"), F.concat(F.lit("src/"), under))).withColumn("__super", F.when(t.startswith("super::"), F.concat_ws("/", parent, under)))
    f = files.select("path", stem(F.col("path")).alias("key"), F.regexp_replace("path", r"\.[^./]*$", "").alias("__base"))
    c = i.join(f, "key", "left").withColumn("n", F.count("path").over(W.partitionBy("importer", "target")))
    rank = F.when(F.col("path") == t, 1).when(F.col("__base") == F.col("__crate"), 2).when(F.col("__base") == F.col("__super"), 3).when((F.col("n") == 1) & F.col("path").isNotNull(), 4)
    g = c.withColumn("r", rank).groupBy("importer", "target").agg(F.min(F.when(F.col("r").isNotNull(), F.struct("r", "path"))).alias("b"))
    return g.select("importer", "target", F.col("b.path").alias("path"), F.when(F.col("b").isNull(), 0.8).otherwise(0.9).alias("confidence"))


def cluster_labels(members: DataFrame) -> DataFrame:
    """Members (community, file): each community by what its commonest directory (ties by name; files at the root don't
    count) means; those of one label as one, with their files."""
    d = members.select("community", directory(F.col("file")).alias("dir"), F.contains("file", F.lit("/")).alias("inner"))
    n = d.groupBy("community", F.when(F.col("inner"), F.col("dir")).alias("dir")).agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy("community").agg(F.min(F.when(F.col("dir").isNotNull(), F.struct((-F.col("n")).alias("n"), "dir")))["dir"].alias("dir"))
    label = top.select("community", cluster_name(F.coalesce("dir", F.lit(""))).alias("label"))
    return members.join(label, "community").groupBy("label").agg(F.array_sort(F.collect_set("community")).alias("communities"), F.array_sort(F.collect_list("file")).alias("files"))


def skills(patterns: DataFrame, groups: DataFrame) -> DataFrame:
    """(files, frequency, kind): task patterns of two and more, and co-change groups (members, arity, co_occurrences) of three
    and more files seen three times and more, unless a pattern covers half of its files or more."""
    p = patterns.filter("frequency >= 2").select("files", "frequency", F.lit("task").alias("kind"))
    g = groups.filter("arity >= 3 AND co_occurrences >= 3").withColumn("__g", F.xxhash64("members"))
    f = g.select("__g", "arity", F.explode("members").alias("file"))
    covered = f.join(p.select(F.xxhash64("files").alias("__p"), F.explode("files").alias("file")), "file").groupBy("__g", "arity", "__p").agg(F.countDistinct("file").alias("n")).filter("n >= arity div 2").select("__g").distinct()
    g = g.join(covered, "__g", "left_anti").select(F.col("members").alias("files"), F.col("co_occurrences").alias("frequency"), F.lit("co_change").alias("kind"))
    return p.unionByName(g)
