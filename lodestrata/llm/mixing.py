"""Mixing sources to target weights by hierarchical budgeting (operator 1).

The token budget goes down a tree of domain, language and source. Each node shares its budget among its children by their
weights, but gives none more than its subtree can supply (its tokens times max_epochs); what one child can't take its
siblings get, by weight again. As a node is never given more than its subtree can supply, a shortage is made good among
siblings first and reaches an ancestor's siblings only where a whole family is exhausted. That is a water level in each
family: with children sorted by capacity over weight, those below the level are exhausted and form a prefix, so the level
comes from running sums.

A leaf's budget buys whole epochs first; the rest is a prefix of the next epoch, whose order is a seeded hash of epoch and
id. Prefix sums run in two steps, over 4096 ranges of the hash and within each, so no task has to walk through a whole
source, however large. Texts are read once, for their token counts; all else moves ids and counts.

Tokens are runs of non-blanks. Budgets are whole numbers, rounded down at every node.

Defined results: a null domain, language or source is a node "unknown" of weight 1; null, empty and blank texts have no
tokens and are not chosen; rows without an id can't be told apart and are not chosen; rows that repeat an id are mixed as
rows of their own (of equal hash, shorter first); an empty table gives no rows; columns beside the five are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.llm.common import fresh, pick, read_table, stored

DOMAIN_WEIGHTS = {"web": 4, "news": 2, "books": 3, "reference": 1}
LANG_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}
SOURCE_WEIGHTS = {"src0": 2}
FRACTION = 0.75
MAX_EPOCHS = 2
SEED = 17
TOKEN = "[^ \\t\\n\\r\\f]+"


def domain_of(source: Column) -> Column:
    """A source's domain by the number at its end."""
    n = F.regexp_extract(source, "([0-9]+)$", 1).try_cast("int")
    return F.when(source.isNull(), "unknown").when(n < 5, "web").when(n < 10, "news").when(n < 15, "books").otherwise("reference")


def weight(key: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for k, v in weights.items():
        out = F.when(key == k, v).otherwise(out)
    return out.cast("long")


def share_out(nodes: DataFrame, family: list[str], key: str) -> DataFrame:
    """nodes (family, key, cap, w, budget of the family) with `given`, each node's part of its family's budget."""
    order = W.partitionBy(*family).orderBy(F.col("cap") / F.col("w"), key)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    n = nodes.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("w_from", F.sum("w").over(W.partitionBy(*family)) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    n = n.withColumn("rank", F.row_number().over(order)).withColumn("level", (F.col("budget") - F.col("cap_before")).cast("double") / F.col("w_from"))
    open_ = F.when(F.col("cap") > F.col("w") * F.col("level"), F.struct("rank", "level"))
    n = n.withColumn("first_open", F.min(open_).over(W.partitionBy(*family)))
    given = F.when(F.col("first_open").isNull() | (F.col("rank") < F.col("first_open.rank")), F.col("cap")).otherwise(F.floor(F.col("first_open.level") * F.col("w")))
    return n.withColumn("given", given.cast("long"))


def leaf_budgets(units: DataFrame, fraction: float, max_epochs: int, domain_w: dict, lang_w: dict, source_w: dict) -> DataFrame:
    leaves = units.groupBy("domain", "lang", "source").agg(F.sum("n_tokens").alias("tokens")).withColumn("cap", F.col("tokens") * max_epochs)
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    domains = langs.groupBy("domain").agg(F.sum("cap").alias("cap"))
    every = F.sum("cap").over(W.partitionBy(F.lit(1)))
    domains = domains.withColumn("budget", F.floor(every / F.lit(max_epochs) * fraction)).withColumn("w", weight(F.col("domain"), domain_w)).withColumn("root", F.lit(1))
    domains = share_out(domains, ["root"], "domain").select("domain", F.col("given").alias("budget"))
    langs = share_out(langs.join(domains, "domain").withColumn("w", weight(F.col("lang"), lang_w)), ["domain"], "lang").select("domain", "lang", F.col("given").alias("budget"))
    leaves = share_out(leaves.join(langs, ["domain", "lang"]).withColumn("w", weight(F.col("source"), source_w)), ["domain", "lang"], "source")
    leaves = leaves.select("domain", "lang", "source", "tokens", F.col("given").alias("budget"))
    return leaves.withColumn("full", F.expr("budget div tokens")).withColumn("rest", F.col("budget") % F.col("tokens"))


def mixture(docs: DataFrame, fraction: float = FRACTION, max_epochs: int = MAX_EPOCHS, seed: int = SEED, domain_w: dict | None = None, lang_w: dict | None = None, source_w: dict | None = None) -> DataFrame:
    """One row for each document and epoch chosen, with the tokens of it that the budget covers (all but the last's of a leaf)."""
    d = pick(docs, "doc_id", "text", "lang", "source")
    units = d.select("doc_id", domain_of(F.col("source")).alias("domain"), F.coalesce("lang", F.lit("unknown")).alias("lang"), F.coalesce("source", F.lit("unknown")).alias("source"), F.regexp_count("text", F.lit(TOKEN)).cast("long").alias("n_tokens"))
    units = stored(units.filter("doc_id IS NOT NULL AND n_tokens > 0"), "units")
    leaf = ["domain", "lang", "source"]
    budgets = stored(leaf_budgets(units, fraction, max_epochs, domain_w or DOMAIN_WEIGHTS, lang_w or LANG_WEIGHTS, source_w or SOURCE_WEIGHTS), "budgets")
    rows = units.join(budgets, leaf)
    whole = rows.filter("full > 0").select("doc_id", *leaf, F.explode(F.sequence(F.lit(0), (F.col("full") - 1).cast("int"))).alias("epoch"), "n_tokens", F.col("n_tokens").alias("take_tokens"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), F.col("doc_id").cast("string")))
    part = rows.filter("rest > 0").withColumn("key", key).withColumn("range", F.substring("key", 1, 3))
    sums = part.groupBy(*leaf, "range").agg(F.sum("n_tokens").alias("sum"))
    sums = sums.withColumn("base", F.sum("sum").over(W.partitionBy(*leaf).orderBy("range")) - F.col("sum")).select(*leaf, "range", "base")
    part = part.join(sums, [*leaf, "range"]).filter("base < rest")
    order = W.partitionBy(*leaf, "range").orderBy("key", "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, W.currentRow)
    part = part.withColumn("before", F.col("base") + F.sum("n_tokens").over(order) - F.col("n_tokens")).filter("before < rest")
    part = part.select("doc_id", *leaf, F.col("full").cast("int").alias("epoch"), "n_tokens", F.least("n_tokens", F.col("rest") - F.col("before")).alias("take_tokens"))
    return whole.unionByName(part)


def mixed(docs: DataFrame, **how) -> DataFrame:
    """docs' rows as often as they were chosen, whole."""
    key, times, copy = (fresh(docs, x) for x in ("chosen_id", "times", "copy"))
    chosen = mixture(docs, **how).select(F.col("doc_id").alias(key), "epoch").distinct().groupBy(key).agg(F.count(F.lit(1)).cast("int").alias(times))
    chosen = stored(chosen, "chosen")
    both = docs.join(chosen.hint("shuffle_hash"), F.col("doc_id") == F.col(key))
    both = both.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(times))))
    return both.select(*[docs[f"`{c}`"] for c in docs.columns])


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(read_table(spark, sf_dir, "documents"))


def _case(col: str, weights: dict[str, int]) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


def _share(src: str, family: str, key: str, w: str) -> str:
    return f"""
  SELECT *, CASE WHEN rank < coalesce(k, 1099511627776) THEN cap ELSE CAST(floor(lvl * {w}) AS BIGINT) END AS given FROM (
   SELECT *, min(CASE WHEN cap > {w} * level THEN rank END) OVER (PARTITION BY {family}) AS k, arg_min(level, rank) FILTER (cap > {w} * level) OVER (PARTITION BY {family}) AS lvl FROM (
    SELECT *, CAST(budget - coalesce(sum(cap) OVER b, 0) AS DOUBLE) / CAST(sum({w}) OVER (PARTITION BY {family}) - coalesce(sum({w}) OVER b, 0) AS DOUBLE) AS level,
      row_number() OVER (PARTITION BY {family} ORDER BY CAST(cap AS DOUBLE) / {w}, {key}) AS rank
    FROM {src} WINDOW b AS (PARTITION BY {family} ORDER BY CAST(cap AS DOUBLE) / {w}, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""


ORACLE = f"""
WITH u AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'unknown' WHEN TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) < 5 THEN 'web' WHEN TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) < 10 THEN 'news' WHEN TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) < 15 THEN 'books' ELSE 'reference' END AS domain,
  coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source, CAST(len(regexp_extract_all(text, '{TOKEN}')) AS BIGINT) AS n_tokens FROM documents),
units AS (SELECT * FROM u WHERE doc_id IS NOT NULL AND n_tokens > 0),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) AS BIGINT) * {MAX_EPOCHS} AS cap FROM units GROUP BY ALL),
langs AS (SELECT domain, lang, CAST(sum(cap) AS BIGINT) AS cap FROM leaves GROUP BY ALL),
domains AS (SELECT 1 AS root, domain, CAST(sum(cap) AS BIGINT) AS cap, CAST(floor(CAST(sum(sum(cap)) OVER () AS DOUBLE) / {MAX_EPOCHS} * {FRACTION}) AS BIGINT) AS budget FROM langs GROUP BY domain),
d AS ({_share("domains", "root", "domain", _case("domain", DOMAIN_WEIGHTS))}),
l0 AS (SELECT langs.*, d.given AS budget FROM langs JOIN d USING (domain)),
l AS ({_share("l0", "domain", "lang", _case("lang", LANG_WEIGHTS))}),
s0 AS (SELECT leaves.*, l.given AS budget FROM leaves JOIN l USING (domain, lang)),
s AS ({_share("s0", "domain, lang", "source", _case("source", SOURCE_WEIGHTS))}),
b AS (SELECT domain, lang, source, given // tokens AS f, given % tokens AS rest FROM s),
r AS (SELECT units.*, b.f, b.rest FROM units JOIN b USING (domain, lang, source)),
p AS (SELECT *, CAST(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}:' || f || ':' || doc_id), doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS BIGINT) - n_tokens AS before FROM r WHERE rest > 0)
SELECT doc_id, domain, lang, source, CAST(e AS INT) AS epoch, n_tokens, n_tokens AS take_tokens FROM (SELECT *, unnest(range(CAST(f AS BIGINT))) AS e FROM r WHERE f > 0)
UNION ALL
SELECT doc_id, domain, lang, source, CAST(f AS INT) AS epoch, n_tokens, least(n_tokens, rest - before) AS take_tokens FROM p WHERE before < rest
"""
