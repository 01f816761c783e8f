"""Pieces of two documents brought together by links between word positions, for chaining and suffix arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import U64, WordHashes, arrow_schema, pick

#: What a link asks of a document: words [b_from, b_to) of doc_b and [a_from, a_to) of doc_a; `anchors` goes with doc_b.
LINK = "doc_b long,doc_a long,b_from int,b_to int,a_from int,a_to int,anchors binary"

#: Bytes of slices in one batch.
SENT = 1 << 22


def word_hashes(text: str, words: WordHashes) -> np.ndarray:
    return (words.of(text.split()) >> U64(32)).astype(np.uint32)


#: Asks for one document in one row.
CHUNK = 512


def together(docs: DataFrame, links: DataFrame, fold: bool, compare, out_ddl: str) -> DataFrame:
    """For each link, both slices' 32-bit word hashes are sent to one place, where compare(link row as a dict, b words,
    a words) gives result rows. The texts are shuffled once, by id; what is sent on are the slices only. A link's row also
    has b_len and a_len, its documents' words. Where an id is on several rows, the first row met with words speaks for it."""
    one = links.withColumn("link", F.xxhash64("doc_b", "doc_a", "b_from", "b_to", "a_from", "a_to"))
    rest = ["doc_b", "doc_a", "b_from", "b_to", "a_from", "a_to", "anchors"]
    side_b = one.select(F.col("doc_b").alias("id_"), F.struct("link", F.lit(1).alias("side"), F.col("b_from").alias("lo"), F.col("b_to").alias("hi"), *rest).alias("ask"))
    nothing = [F.lit(None).cast(one.schema[c].dataType).alias(c) for c in rest]  # side b's rows tell it
    side_a = one.select(F.col("doc_a").alias("id_"), F.struct("link", F.lit(0).alias("side"), F.col("a_from").alias("lo"), F.col("a_to").alias("hi"), *nothing).alias("ask"))
    # rows of up to CHUNK asks on the whole, so that a text isn't repeated for each of its slices; a document that many others
    # resemble has many rows
    many = one.groupBy(F.col("doc_a").alias("id_")).agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") > CHUNK)
    side_a = side_a.join(many.hint("shuffle_hash"), "id_", "left").select("id_", "ask", F.coalesce(F.pmod(F.col("ask.link"), F.ceil(F.col("many") / CHUNK)), F.lit(0)).alias("row"))
    asks = side_b.withColumn("row", F.lit(0).cast("long")).unionByName(side_a).groupBy("id_", "row").agg(F.collect_list("ask").alias("asks"))
    texts = pick(docs, "doc_id", "text").withColumnRenamed("doc_id", "id_").filter("id_ IS NOT NULL AND text IS NOT NULL")
    sent_ddl = "link long,side int,n int," + LINK + ",words binary"
    schema = arrow_schema(sent_ddl)
    names = [f.name for f in schema]

    def send(it):
        words = WordHashes(fold=fold)
        for b in it:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                asks = part.column(part.schema.get_field_index("asks"))
                flat = asks.flatten()
                lo, hi = flat.field("lo").to_pylist(), flat.field("hi").to_pylist()
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                got, ns, size, begin, at = [], [], 0, 0, 0
                for t, k in zip(texts, asks.value_lengths().to_pylist()):
                    h = word_hashes(t, words)
                    for at in range(at, at + k):
                        got.append(h[max(0, lo[at]) : hi[at]].tobytes())
                        ns.append(len(h))
                        size += len(got[-1]) + 100
                        if size > SENT:
                            yield out(flat.slice(begin, len(got)), ns, got)
                            begin, size = begin + len(got), 0
                            got, ns = [], []
                    at += 1
                if got:
                    yield out(flat.slice(begin, len(got)), ns, got)

    def out(rows, ns, got):
        known = {"n": pa.array(ns, pa.int32()), "words": pa.array(got, pa.binary())}
        return pa.RecordBatch.from_arrays([known[c] if c in known else rows.field(c).cast(schema.field(c).type) for c in names], schema=schema)

    # shuffled at every size: what is asked for grows with the texts, so a broadcast would work for small tables only
    sent = asks.hint("shuffle_hash").join(texts, "id_").select("id_", "text", "asks").mapInArrow(send, sent_ddl)
    out_schema = arrow_schema(out_ddl)
    out_names = [f.name for f in out_schema]

    def meet(it):
        link, a = None, None
        done = False
        for b in it:
            cols = {c: b.column(b.schema.get_field_index(c)) for c in names}
            heads = list(zip(*[cols[c].to_pylist() for c in ("link", "side", "n")]))
            out: dict[str, list] = {c: [] for c in out_names}
            for j, (at, side, n) in enumerate(heads):
                if at != link:
                    link, a, done = at, None, False
                if side == 0:
                    if a is None:
                        a, a_len = np.frombuffer(cols["words"][j].as_py(), np.uint32), n
                elif a is not None and not done:
                    done = True
                    row = {c: cols[c][j].as_py() for c in names if c != "words"} | {"b_len": n, "a_len": a_len}
                    w = np.frombuffer(cols["words"][j].as_py(), np.uint32)
                    for r in compare(row, w, a):
                        for c, v in zip(out_names, r):
                            out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=out_schema)

    return sent.repartition("link").sortWithinPartitions("link", "side").mapInArrow(meet, out_ddl)
