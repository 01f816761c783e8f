"""Full-text search: an inverted index and BM25 on DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.ranking import materialised

K1, B = 1.2, 0.75


def terms(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf, len): folded runs of letters and digits."""
    t = docs.select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)).alias("t")).withColumn("len", F.size("t"))
    return t.select("doc_id", "len", F.explode("t").alias("term")).groupBy("doc_id", "term", "len").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, query: list[str], k: int | None = 20) -> DataFrame:
    """(doc_id, score), higher is better, to 6 places: for a document's query terms, idf tf (k1 + 1) / (tf + k1 (1 - b + b len / mean)),
    idf = ln(1 + (N - n + 0.5) / (n + 0.5)). Only the query's terms are counted; none of the others is shuffled."""
    words = sorted({w.lower() for w in query})

    def count(word: str) -> Column:
        return F.size(F.filter("t", lambda x: x == word))

    base = docs.select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)).alias("t"))
    base = base.select("doc_id", F.size("t").alias("len"), *[count(w).alias(f"tf{i}") for i, w in enumerate(words)])
    base = materialised(base, "bm25")  # texts are read and taken apart once
    stats = base.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))])
    hit = base.filter(sum((F.col(f"tf{i}") for i in range(len(words))), F.lit(0)) > 0).crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(words)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    out = hit.select("doc_id", F.round(score, 6).alias("score"))
    return out if k is None else out.orderBy(F.desc("score"), "doc_id").limit(k)
