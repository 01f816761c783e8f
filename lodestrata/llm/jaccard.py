"""N-gram Jaccard join by MinHash banding (operator 7).

Each text becomes the set of its word n-grams (folded; a text of fewer words is one n-gram). Bands and rows are chosen for
the wanted recall at the threshold (common.bands_for). What is shuffled on the way to candidates are band hashes with an id;
what verifies them are the full sets of n-grams, hashed to 32 bits.

Texts with the same set form one class of equals, which is compared once: each task makes the bands of an equal set once, so
that copies are folded before the first shuffle. All pairs of the classes that share a bucket are candidates, with no cap:
large buckets are cut into blocks by a hash of their members, and a pair of blocks is a row's work, so no bucket, however
large, is in one task. For the comparison, classes that fall into buckets together are put into blocks too, and a set is sent
once to each pair of blocks in which it has a candidate, not once a pair.

Results: near_pairs() has the verified pairs of classes by their least ids, and each other member with its class's least id.
near_documents() has one row for each document that is alike to another: doc_id; class_id, the least id that it hangs together
with by links; and links, the number of other documents that are alike to it (for an id with several texts, the sum over its
different texts, its own others among them). Equal texts are counted, not listed as pairs. A document without a row is a class of its own, with no links.

Defined results: a null, empty or wordless text has no set and no partner; a null id is left out; rows that repeat an id
count as one document, whose likeness to another is that of its most alike row; pairs come once, the lesser id first;
columns beside doc_id and text are not looked at; an empty table gives no pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import U64, WordHashes, arrow_schema, bands_for, batches, fresh, kgrams, pick, read_table, ship, signed, stored, trim
from lodestrata.llm.passages import SENT
from lodestrata.operators.graph import components

N = 3
THRESHOLD = 0.6
RECALL = 0.95
MOST_HASHES = 128
#: Classes in a block.
BLOCK = 128
_P = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F))


def gram_set(text: str | None, n: int, words: WordHashes) -> np.ndarray:
    return np.unique(kgrams(words.of(text.split()), n)) if text else np.zeros(0, U64)


def set_hash(s: np.ndarray) -> int:
    """A set's 64-bit hash, signed."""
    h = xxhash.xxh3_64_intdigest(s.tobytes())
    return h - (1 << 64) if h >> 63 else h


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """Band hashes, one row a set; none of the sets is empty."""
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    rng = np.random.default_rng(20_240_607)
    odd = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | U64(1)
    add = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    out = np.empty((len(sets), bands), U64)
    for b in range(bands):
        acc = np.full(len(sets), (b + 1) * int(_P[1]) % (1 << 64), U64)
        for r in range(b * rows, (b + 1) * rows):
            acc = (acc ^ np.minimum.reduceat(flat * odd[r] + add[r], at)) * _P[0]
            acc ^= acc >> U64(29)
        out[:, b] = acc
    return out


def sign(docs: DataFrame, n: int, bands: int, rows: int, most: int = 200_000) -> DataFrame:
    """(doc_id, node, bands) of each text that has a set; node is its set's hash. A task makes the bands of an equal set once
    (twice, if it has met `most` others between), and leaves them null for the copies."""
    ddl = "doc_id long,node long,bands array<long>"
    schema = arrow_schema(ddl)

    def run(it):
        trim()
        words, seen = WordHashes(fold=True), set()
        for ids, texts in batches(it, "doc_id", "text"):
            for i in range(0, len(ids), 256):
                got = [(d, s, set_hash(s)) for d, t in zip(ids[i : i + 256], texts[i : i + 256]) if d is not None and len(s := gram_set(t, n, words))]
                if not got:
                    continue
                if len(seen) > most:
                    seen.clear()
                new = {}
                for _, s, h in got:
                    if h not in seen and h not in new:
                        new[h] = s
                seen.update(new)
                lists = pa.array([None] * len(got), schema.field("bands").type)
                if new:
                    sig = signed(signatures(list(new.values()), bands, rows).reshape(-1))
                    made = pa.ListArray.from_arrays(pa.array(np.arange(0, len(sig) + 1, bands), pa.int32()), pa.array(sig))
                    nth = {h: k for k, h in enumerate(new)}
                    lists = made.take(pa.array([nth.pop(h, None) for _, _, h in got], pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _, _ in got], pa.int64()), pa.array([h for _, _, h in got], pa.int64()), lists], schema=schema)

    return pick(docs, "doc_id", "text").mapInArrow(run, ddl)


def part_of(x: Column, size: Column) -> Column:
    """One of the blocks, of BLOCK members each on the whole, that a group of this size is cut into."""
    return F.pmod(F.xxhash64(x), F.ceil(size / BLOCK)).cast("int")


def buckets(classes: DataFrame) -> DataFrame:
    """(h, size, me) for the classes in buckets of two or more, from (rep, node, bands). me is rep, node and home, the block of
    classes that a class is compared in: those that meet the same first class are put into blocks together."""
    b = classes.select("rep", "node", F.explode("bands").alias("h"))
    met = b.groupBy("h").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("first")).filter("size > 1")
    b = stored(b.join(met.hint("shuffle_hash"), "h"), "buckets")
    home = b.groupBy("node").agg(F.min("first").alias("loc"))
    sizes = home.groupBy("loc").agg(F.count(F.lit(1)).alias("many"))
    home = home.join(sizes.hint("shuffle_hash"), "loc").select("node", F.xxhash64("loc", part_of(F.col("node"), F.col("many"))).alias("home"))
    return b.join(home.hint("shuffle_hash"), "node").select("h", "size", F.struct("rep", "node", "home").alias("me"))


def candidates(classes: DataFrame) -> DataFrame:
    """(a, b) with a < b for each two classes that share a bucket, from (rep, node, bands): each once."""
    blocks = buckets(classes).withColumn("blk", part_of(F.col("me.node"), F.col("size"))).groupBy("h", "blk", "size").agg(F.collect_list("me").alias("all"))
    own = blocks.select("all", F.posexplode("all").alias("at", "a")).select("a", F.explode(F.expr("slice(all, at + 2, size(all))")).alias("b"))
    # blocks of a large bucket meet two by two
    last = (F.ceil(F.col("size") / BLOCK) - 1).cast("int")
    large = blocks.filter(F.col("size") > BLOCK).select("h", "blk", "all", F.explode(F.sequence(F.lit(0), last)).alias("x")).filter("x != blk")
    large = large.select("h", F.least("blk", "x").alias("i"), F.greatest("blk", "x").alias("j"), "blk", "all").groupBy("h", "i", "j")
    both = large.agg(*[F.first(F.when(F.col("blk") == F.col(c), F.col("all")), ignorenulls=True).alias(f"all_{c}") for c in ("i", "j")])
    both = both.filter("all_i IS NOT NULL AND all_j IS NOT NULL").select(F.explode("all_i").alias("a"), "all_j").select("a", F.explode("all_j").alias("b"))
    return own.unionByName(both).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(docs: DataFrame, pairs: DataFrame, n: int, threshold: float) -> DataFrame:
    """(node_a, node_b, jaccard) of the pairs whose sets are alike enough."""
    where = [F.col("a.home").alias("home_a"), F.col("b.home").alias("home_b")]
    asks = pairs.select(*where, F.explode(F.array("a", "b")).alias("x")).select("home_a", "home_b", F.col("x.rep").alias("id_"), F.col("x.node").alias("node")).distinct()
    asks = asks.groupBy("id_").agg(F.collect_list(F.struct("home_a", "home_b", "node")).alias("to"))
    texts = pick(docs, "doc_id", "text").withColumnRenamed("doc_id", "id_")
    sent_ddl = "home_a long,home_b long,node_a long,node_b long,grams binary"
    sent_schema = arrow_schema(sent_ddl)

    def send(it):
        trim()
        words = WordHashes(fold=True)
        for b in it:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                out, size = ([], [], [], [], []), 0
                for t, to in zip(*[part.column(part.schema.get_field_index(c)).to_pylist() for c in ("text", "to")]):
                    full = gram_set(t, n, words)
                    if not len(full):
                        continue
                    own = set_hash(full)
                    s = np.unique((full >> U64(32)).astype(np.uint32)).tobytes()
                    for x in to:
                        if x["node"] == own:  # else another row of the id has it
                            for c, v in zip(out, (x["home_a"], x["home_b"], own, None, s)):
                                c.append(v)
                            size += len(s)
                            if size > SENT:
                                yield pa.RecordBatch.from_pydict(dict(zip(sent_schema.names, out)), schema=sent_schema)
                                out, size = ([], [], [], [], []), 0
                if out[0]:
                    yield pa.RecordBatch.from_pydict(dict(zip(sent_schema.names, out)), schema=sent_schema)

    # shuffled at every size: what is asked for grows with the texts, so a broadcast would work for small tables only
    sent = asks.hint("shuffle_hash").join(texts, "id_").select("id_", "text", "to").mapInArrow(send, sent_ddl)
    sent = sent.unionByName(pairs.select(*where, F.col("a.node").alias("node_a"), F.col("b.node").alias("node_b"), F.lit(None).cast("binary").alias("grams")))
    out_ddl = "node_a long,node_b long,jaccard double"
    out_schema = arrow_schema(out_ddl)

    def compare(it):
        trim()
        now, sets = None, {}
        for cols in batches(it, "home_a", "home_b", "node_a", "node_b", "grams"):
            out = ([], [], [])
            for ha, hb, x, y, g in zip(*cols):
                if (ha, hb) != now:
                    now, sets = (ha, hb), {}
                if y is None:
                    sets[x] = np.frombuffer(g, np.uint32)
                    continue
                c, s = sets[x], sets[y]
                if min(len(c), len(s)) >= threshold * max(len(c), len(s)):
                    at = np.searchsorted(c, s)
                    both = int((c[np.minimum(at, len(c) - 1)] == s).sum())
                    like = both / (len(c) + len(s) - both)
                    if like >= threshold:
                        for col, v in zip(out, (x, y, like)):
                            col.append(v)
            yield pa.RecordBatch.from_pydict(dict(zip(out_schema.names, out)), schema=out_schema)

    # node_b is null in the rows of sets, which so come first
    return sent.repartition("home_a", "home_b").sortWithinPartitions("home_a", "home_b", F.asc_nulls_first("node_b")).mapInArrow(compare, out_ddl)


def near_classes(docs: DataFrame, n: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node, doc_id) of the members of classes of equal sets, (node, rep, size) of the classes, and (rep_a, size_a, rep_b,
    size_b, node_a, node_b, jaccard) of classes that are alike."""
    bands, rows = bands_for(threshold, recall, MOST_HASHES)
    s = stored(sign(docs, n, bands, rows), "signatures")
    members = s.select("node", "doc_id").distinct()
    classes = members.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"))
    made = s.filter("bands IS NOT NULL").groupBy("node").agg(F.first("bands").alias("bands"))
    classes = stored(classes.join(made.hint("shuffle_hash"), "node"), "classes")
    pairs = stored(candidates(classes.select("rep", "node", "bands")), "candidates")
    near = verified(docs, pairs, n, threshold)
    known = classes.select("node", "rep", "size")
    for c in ("a", "b"):
        near = near.hint("shuffle_hash").join(known.select(*[F.col(x).alias(f"{x}_{c}") for x in known.columns]), f"node_{c}")
    return members, known, stored(near, "near")


def near_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_a, doc_b, jaccard: all pairs of different texts at or above the threshold, by the least ids that hold them, and
    each other holder of a text with its least one."""
    members, classes, near = near_classes(docs, n, threshold, recall)
    same = members.join(classes.filter("size > 1").hint("shuffle_hash"), "node").filter("doc_id != rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"), F.lit(1.0).alias("jaccard"))
    both = same.unionByName(near.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"), "jaccard")).filter("a != b")
    return both.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"), "jaccard").groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))


def near_documents(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, links of every document that is alike to another one (see the module's text)."""
    members, classes, near = near_classes(docs, n, threshold, recall)
    edges = near.select(F.col("rep_a").alias("doc_a"), F.col("rep_b").alias("doc_b"))
    # an id with several texts holds their classes together
    many = members.join(classes.hint("shuffle_hash"), "node").select("doc_id", "rep")
    first = many.groupBy("doc_id").agg(F.min("rep").alias("doc_a"), F.max("rep").alias("last"), F.min("rep").alias("least")).filter("last != least").select("doc_id", "doc_a")
    edges = edges.unionByName(many.join(first.hint("shuffle_hash"), "doc_id").select("doc_a", F.col("rep").alias("doc_b")))
    roots = components(edges.select(F.col("doc_a").alias("src"), F.col("doc_b").alias("dst"))).select(F.col("node").alias("rep"), "root")
    others = near.select(F.col("node_a").alias("node"), F.col("size_b").alias("k")).unionByName(near.select(F.col("node_b").alias("node"), F.col("size_a").alias("k")))
    others = others.groupBy("node").agg(F.sum("k").alias("others"))
    known = classes.join(others.hint("shuffle_hash"), "node", "left").join(roots.hint("shuffle_hash"), "rep", "left")
    known = known.select("node", F.coalesce("root", "rep").alias("class_id"), (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("links")).filter("links > 0")
    got = members.join(known.hint("shuffle_hash"), "node").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("links").alias("links"))
    return got.select("doc_id", "class_id", "links")


def one_of_each(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """docs without those that have a near copy of a lesser id: one document of each group stays. Rows without an id or
    without words stay; rows that repeat an id stay or go together."""
    gone = fresh(docs, "gone")
    out = stored(near_documents(docs, n, threshold, recall).filter("doc_id != class_id").select(F.col("doc_id").alias(gone)), "gone")
    return docs.join(out.hint("shuffle_hash"), docs["doc_id"] == F.col(gone), "left_anti")


def op7_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_documents(read_table(spark, sf_dir, "documents"))
