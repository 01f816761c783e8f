"""Conventions: naming, testing, error handling, documentation style, agent rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions.text import SOURCE_ENDS, has_test_mark, leaf_name, name_style, occurrences

#: What counts as a mark of how errors are handled: languages, name, literal.
ERROR_MARKS = [
    ("rust", "? operator", "?"), ("rust", ".unwrap()", ".unwrap()"), ("rust", ".expect()", ".expect("), ("rust", "Result<T, E>", "Result<"),
    ("python", "try/except", "except "), ("python", "raise", "raise "),
    ("csharp java javascript kotlin php typescript", "try/catch", "catch "), ("csharp java javascript kotlin php typescript", "throw", "throw "),
    ("go", "if err != nil", "if err != nil"), ("ruby", "rescue", "rescue "), ("ruby", "raise", "raise "),
    ("lean swift", "do/catch", "catch "), ("lean swift zig", "try", "try "), ("lean swift", "throw", "throw "), ("zig", "catch", "catch "),
]
PREFIXES = "create delete find from get handle has is new set test to update with".split()
SUFFIXES = "builder config error factory handler impl result service spec test utils".split()
#: Of a test framework: the manifest's name (a pattern), what it has to hold (one of them; nothing: its presence), its name. The first that fits.
FRAMEWORKS = [
    (r"^Cargo\.toml$", r"\[(dev-dependencies|package)\]", "cargo test"), (r"^package\.json$", '"jest"', "jest"), (r"^package\.json$", '"vitest"', "vitest"), (r"^package\.json$", '"mocha"', "mocha"),
    (r"^pyproject\.toml$", "pytest", "pytest"), (r"^go\.mod$", "", "go test"), ("^Gemfile$", "rspec", "rspec"), ("^Gemfile$", "minitest", "minitest"), (r"^Package\.swift$", "", "swift test"),
    (r"^build\.gradle(\.kts)?$", "junit|kotest", "junit"), (r"^[^/]*\.csproj$", "", "dotnet test"), (r"^composer\.json$", "phpunit", "phpunit"), (r"^composer\.json$", "pest", "pest"),
    (r"^build\.zig$", "", "zig test"), (r"^lakefile\.lean$", "", "lake test"),
]


def naming(entities: DataFrame) -> DataFrame:
    """(convention, count, percentage, rank) of entities' leaf names (name); percentage to 2 places; the first in rank, by
    count, then name, dominates, and its percentage is the adherence."""
    g = entities.groupBy(name_style(leaf_name(F.col("name"))).alias("convention")).agg(F.count(F.lit(1)).alias("count"))
    g = g.crossJoin(F.broadcast(g.agg(F.sum("count").alias("n"))))  # one row
    # as many rows as there are conventions
    return g.select("convention", "count", F.round(F.col("count") / F.col("n") * 100, 2).alias("percentage"), F.row_number().over(W.orderBy(F.desc("count"), "convention")).alias("rank"))


def affixes(entities: DataFrame, k: int = 10) -> DataFrame:
    """(kind, part, count, rank): how often functions' leaf names (name) begin or end with one of the customary parts; the k
    commonest, ties by name. A name has one of each kind at most, as none is another's end."""
    n = leaf_name(F.col("name"))
    found = F.array(*[F.struct(F.lit(kind).alias("kind"), F.regexp_extract(n, rx, 1).alias("part")) for kind, rx in (("prefix", f"^((?:{'|'.join(PREFIXES)})_)"), ("suffix", f"(_(?:{'|'.join(SUFFIXES)}))$"))])
    g = entities.select(F.explode(found).alias("x")).filter("x.part != ''").groupBy("x.kind", "x.part").agg(F.count(F.lit(1)).alias("count"))
    return g.withColumn("rank", F.row_number().over(W.partitionBy("kind").orderBy(F.desc("count"), "part"))).filter(F.col("rank") <= k)


def testing(files: DataFrame) -> DataFrame:
    """One row over files (path): tests, sources that aren't tests, tests per source (0 without sources), the pattern that
    prevails, and whether tests stand beside sources. What is a test is told by marks anywhere in a path (N40)."""
    p = F.col("path")
    t = has_test_mark(p)
    any_ = lambda c: F.coalesce(F.bool_or(t & c), F.lit(False))
    g = files.agg(
        F.count_if(t).alias("test_count"), F.count_if(~t & p.rlike(SOURCE_ENDS)).alias("source_count"),
        any_(p.rlike("/tests?/")).alias("in_dir"), any_(F.contains(p, F.lit("test_"))).alias("prefix"), any_(p.rlike(r"_test\.|\.test\.|\.spec\.")).alias("suffix"),
    )
    ratio = F.when(F.col("source_count") > 0, F.col("test_count") / F.col("source_count")).otherwise(0.0)
    pattern = F.when(F.col("in_dir"), "tests/ directory").when(F.col("suffix"), "*_test.* / *.test.* / *.spec.*").when(F.col("prefix"), "test_*").otherwise("unknown")
    return g.select("test_count", "source_count", ratio.alias("test_ratio"), pattern.alias("test_file_pattern"), (~F.col("in_dir") & (F.col("suffix") | F.col("prefix"))).alias("co_located"))


def test_framework(manifests: DataFrame) -> DataFrame:
    """One row over the manifests at the root (path, content): the framework of the first rule that fits, or null."""
    fits = [F.when(F.col("path").rlike(name) & (F.col("content").rlike(holds) if holds else F.lit(True)), F.struct(F.lit(i).alias("i"), F.lit(tool).alias("framework"))) for i, (name, holds, tool) in enumerate(FRAMEWORKS)]
    return manifests.select(F.least(*fits).alias("x")).agg(F.min("x").alias("x")).select(F.col("x.framework").alias("framework"))


def error_handling(sources: DataFrame) -> DataFrame:
    """(language, pattern, count) over sources (language, content), those that occur."""
    cols = [F.when(F.col("language").isin(langs.split()), F.struct(F.lit(name).alias("pattern"), occurrences(F.col("content"), mark).cast("long").alias("n"))) for langs, name, mark in ERROR_MARKS]
    x = sources.select("language", F.explode(F.array_compact(F.array(*cols))).alias("x"))
    return x.groupBy("language", F.col("x.pattern").alias("pattern")).agg(F.sum("x.n").alias("count")).filter("count > 0")


def error_approach(found: DataFrame) -> DataFrame:
    """One row over error_handling()'s: the pattern that dominates in all languages (ties by name), and what it stands for."""
    by = found.groupBy("pattern").agg(F.sum("count").alias("n"))
    top = by.agg(F.coalesce(F.min(F.struct((-F.col("n")).alias("n"), "pattern"))["pattern"], F.lit("unknown")).alias("dominant_pattern"))
    d = F.col("dominant_pattern")
    kind = F.when(d.rlike(r"Result|\?"), "Result/Option type").when(d.rlike("try|except"), "Exceptions").when(F.contains(d, F.lit("if err")), "Error return codes").otherwise("mixed")
    return top.select(d, kind.alias("approach"))


def doc_style(entities: DataFrame) -> DataFrame:
    """(style, documented, share) over entities (doc, style), and over all whether parameters, returns and examples are told."""
    d = entities.filter("doc IS NOT NULL")
    g = d.groupBy("style").agg(F.count(F.lit(1)).alias("documented"))
    flags = entities.agg(F.count("doc").alias("n_documented"), F.count(F.lit(1)).alias("total"), F.coalesce(F.bool_or(F.lower("doc").rlike(r"@param|:param|# arguments|args:")), F.lit(False)).alias("documents_params"), F.coalesce(F.bool_or(F.lower("doc").rlike(r"@return|:return|# returns|returns:")), F.lit(False)).alias("documents_returns"), F.coalesce(F.bool_or(F.lower("doc").rlike(r"@example|# example|>>>|```")), F.lit(False)).alias("documents_examples"))
    return g.crossJoin(F.broadcast(flags)).withColumn("share", F.round(F.col("documented") / F.col("n_documented"), 4))


def rule_validation(stated: DataFrame, found: DataFrame) -> DataFrame:
    """Stated (language, convention) by rules against what dominates (found: language, convention, count)."""
    top = found.withColumn("r", F.row_number().over(W.partitionBy("language").orderBy(F.desc("count"), "convention"))).filter("r = 1").select("language", F.col("convention").alias("dominant"))
    j = stated.join(top, "language", "left")
    return j.select("language", "convention", "dominant", F.when(F.col("dominant").isNull(), "unknown").when(F.col("dominant") == F.col("convention"), "validated").otherwise("drifted").alias("status"))
