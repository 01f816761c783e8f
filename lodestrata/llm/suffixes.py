"""Exact substring dedup by suffix arrays (operator 10).

Texts are sequences of words (as written). Each task builds suffix arrays over shards of SHARD words:

1. Suffix array by Larsson-Sadakane refinement: suffixes are sorted by their first word, then, doubling, those that are still
   in a group with others are sorted by the group of the suffix h words on. Refinement stops at DEPTH words, as a longer
   common prefix is seen from the suffixes after it. Every text ends in a word of its own, so no match runs across texts.
2. Kasai's common prefixes, up to DEPTH, in text order, over the positions that share 32 words with their neighbour; in
   suffix order each position then has the nearest predecessor of another document, with what it shares with it, and, among
   all that share MIN_WORDS with it, the place of the least id. Those of MIN_WORDS and more, joined along diagonals, are the
   shard's repeats.
3. Across shards: winnowing samples positions such that MIN_WORDS common words hold a sampled position with KEY common words
   behind it. Each shard's samples are a run sorted by the hash of these KEY words. A task takes all runs of a part of the
   hashes, one shard after the other, and looks each up by binary search in the merged runs before it (kept as arrays of
   doubling sizes, so that merging stays n log n). A find is linked with the place of the least id and with the latest one of its hash
   in other shards: linear in the finds, without a cap.
4. Linked places' surroundings are brought together once and compared word by word, which gives the exact ends.

Result: one row a pair of places, document doc_id's words [start_word, end_word) being those of source_id from source_start to
source_end, source_id being the lesser. Each copy of a passage, but that of the least id, is doc_id in a row; not each copy is
in a row with each other. Within this module the two sides are called b and a.

Defined results: null ids and null, blank or short texts take no part; an id on several rows counts as one document; passages
repeated only within one document are not told, and of a passage that an earlier holder has many times one place; columns
beside doc_id and text are not looked at; an empty table has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W_
from pyspark.sql import functions as F

from lodestrata.llm.common import BASE, U64, WordHashes, arrow_schema, batches, kgrams, mix, pick, read_table, ship, signed, stored, winnow
from lodestrata.llm.passages import together

MIN_WORDS = 50
DEPTH = 64
GRAM = 10
SHARD = 1 << 20
#: Positions turned into Python numbers at a time.
CHUNK = 1 << 14
FLANK = 64
ROWS = "kind int,shard long,key long,doc_b long,b_start int,doc_a long,a_start int,n_words int"
OUT = "doc_b long,b_start int,doc_a long,a_start int,n_words int"


def suffix_array(seq: np.ndarray, depth: int = DEPTH, at: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order of their first `depth` words, each position's group at `at` words). The greatest values of seq, one
    at each text's end, must be unique, and the last one must be among them."""
    n = len(seq)
    sa = np.argsort(seq, kind="stable").astype(np.int32)
    v = seq[sa]
    new = np.ones(n, bool)
    new[1:] = v[1:] != v[:-1]
    del v
    rank = np.empty(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), np.int32(0)))
    slots = np.flatnonzero(~(new & np.append(new[1:], True))).astype(np.int32)
    h, groups = 1, None
    while h < depth:
        if h == at:
            groups = rank.copy()
        if not len(slots):
            break
        p = sa[slots]
        key = rank[p].astype(np.int64)
        key *= n
        key += rank[np.minimum(p + h, n - 1)]
        order = np.argsort(key, kind="stable")
        p, key = p[order], key[order]
        del order
        sa[slots] = p
        new = np.ones(len(p), bool)
        new[1:] = key[1:] != key[:-1]
        del key
        rank[p] = slots[np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))]
        slots = slots[~(new & np.append(new[1:], True))]
        h *= 2
    return sa, rank if groups is None else groups


def common_prefixes(seq: np.ndarray, sa: np.ndarray, groups: np.ndarray, at: int, depth: int) -> np.ndarray:
    """By slot, words (up to depth) shared with the slot before; 0 where it is under `at`. Kasai's order: by position, so that
    what p shares is at least what p - 1 shares less one."""
    n = len(seq)
    out = np.zeros(n, np.int32)
    g = groups[sa]
    slots = np.flatnonzero(np.append(False, g[1:] == g[:-1]))
    p = sa[slots]
    order = np.argsort(p)
    slots, p = slots[order], p[order]
    q = sa[slots - 1]
    have, before, beside = at, -2, -2
    s = memoryview(seq)
    for i in range(0, len(p), CHUNK):
        res = []
        for x, y in zip(p[i : i + CHUNK].tolist(), q[i : i + CHUNK].tolist()):
            # suffixes that share `depth` words are in no order, so from them only the same pair, one on, is known to share as much
            l = max(have - 1, at) if x == before + 1 and (have < depth or y == beside + 1) else at
            while l < depth and s[x + l] == s[y + l]:
                l += 1
            res.append(l)
            have, before, beside = l, x, y
        out[slots[i : i + CHUNK]] = res
    return out


def to_least(sa: np.ndarray, slots: np.ndarray, shared: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, position of the least id, words shared) for what shares its slot's words (shared, by slot, for the slots that
    share enough with the slot before) with a position of a lesser id. who tells each position's id."""
    first = np.flatnonzero(np.append(True, np.diff(slots) != 1))
    run = np.cumsum(np.append(True, np.diff(slots) != 1)) - 1
    # a run's positions are its slots' and that of the slot before the first one
    lead, rest = first + np.arange(len(first)), np.arange(len(slots)) + run + 1
    n = len(slots) + len(first)
    pos, group, with_last = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
    pos[lead], pos[rest] = sa[slots[first] - 1], sa[slots]
    group[lead], group[rest] = np.arange(len(first)), run
    most = int(shared.max()) + 1
    with_last[lead], with_last[rest] = most, shared
    ids = who[pos]
    least = np.minimum.reduceat(ids, lead)[group]
    hit = np.flatnonzero(ids == least)
    at = hit[np.unique(group[hit], return_index=True)[1]][group]
    here, fall = np.arange(n), 2 * most
    after = np.minimum.accumulate(np.where(here > at, with_last, most) - group * fall) + group * fall
    back = (len(first) - 1 - group)[::-1] * fall
    before = (np.minimum.accumulate(np.where(here < at, np.append(with_last[1:], most), most)[::-1] - back) + back)[::-1]
    keep = ids != least
    return pos[keep], pos[at[keep]], np.minimum(after, before)[keep]


def in_shard(seq: np.ndarray, doc: np.ndarray, start: np.ndarray, ids: np.ndarray, min_words: int, depth: int) -> tuple[np.ndarray, ...]:
    """Repeats within a shard, as columns of OUT. doc numbers each position's text, start is where a text begins."""
    at = 1 << (min(32, min_words).bit_length() - 1)
    sa, groups = suffix_array(seq, depth, at)
    shared = common_prefixes(seq, sa, groups, at, depth)
    slots = np.flatnonzero(shared >= min_words)
    if not len(slots):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    # a slot whose neighbour before is of another document begins a stretch; those of the same document that follow it share
    # with that neighbour the least that any of them shares
    b, q = sa[slots].astype(np.int64), sa[slots - 1]
    own = ids[doc[b]]
    begins = own != ids[doc[q]]
    joined = np.append(False, np.diff(slots) == 1)
    stretch = np.cumsum(begins | ~joined)
    first = np.flatnonzero(begins | ~joined)
    known = begins[first][stretch - 1]
    fall = 2 * (depth + 1)
    ln = np.minimum.accumulate(shared[slots].astype(np.int64) - stretch * fall) + stretch * fall
    a = q[first].astype(np.int64)[stretch - 1]
    b, a, ln, own = b[known], a[known], ln[known], own[known]
    if not len(b):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    # the later id holds the copy
    swap = own < ids[doc[a]]
    b, a = np.where(swap, a, b), np.where(swap, b, a)
    # neighbours alone would leave out, as doc_b, a copy between two of greater ids
    b, a, ln = (np.append(x, y) for x, y in zip((b, a, ln), to_least(sa, slots, shared[slots].astype(np.int64), ids[doc])))
    order = np.lexsort((b, b - a))
    b, a, ln = b[order], a[order], ln[order]
    reach = np.maximum.accumulate(np.where(True, b + ln, 0) + (np.cumsum(np.append(True, np.diff(b - a) != 0)) << 40)) & ((1 << 40) - 1)
    new = np.ones(len(b), bool)
    new[1:] = (np.diff(b - a) != 0) | (b[1:] > reach[:-1]) | (doc[b[1:]] != doc[b[:-1]]) | (doc[a[1:]] != doc[a[:-1]])
    f = np.flatnonzero(new)
    e = np.append(f[1:], len(b)) - 1
    db, da = doc[b[f]], doc[a[f]]
    return ids[db], b[f] - start[db], ids[da], a[f] - start[da], reach[e] - b[f]


def samples(h: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes of the key's words from there) of one text."""
    w = max(1, min_words // 3)
    gram = min(GRAM, min_words - w + 1)
    key = min_words - w + 1
    if len(h) < min_words:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    at = winnow(kgrams(h, gram), w)
    at = at[at + key <= len(h)]
    power = U64(pow(int(BASE), key, 1 << 64))
    # prefix hashes: c[i + key] - c[i] * BASE^key is the key's polynomial
    c = np.zeros(len(h) + 1, U64)
    acc, base, m = 0, int(BASE), (1 << 64) - 1
    out = []
    for v in h.tolist():
        acc = (acc * base + v) & m
        out.append(acc)
    c[1:] = out
    return at, mix(c[at + key] - c[at] * power)


def shards(docs: DataFrame, min_words: int, depth: int, size: int) -> DataFrame:
    """Of each shard, its repeats (kind 0) and its samples' run (kind 1)."""
    schema = arrow_schema(ROWS)

    def work(ids, hs, number):
        ids = np.array(ids, np.int64)
        got = [samples(h, min_words) for h in hs]
        at = np.concatenate([g[0] for g in got])
        key = np.concatenate([g[1] for g in got])
        who = np.repeat(ids, [len(g[0]) for g in got])
        del got
        order = np.argsort(key, kind="stable")
        at, key, who = at[order], key[order], who[order]
        lens = np.array([len(h) for h in hs])
        n = int((lens + 1).sum())
        start = np.cumsum(lens + 1) - (lens + 1)
        end = start + lens
        body = np.ones(n, bool)
        body[end] = False
        flat = np.concatenate(hs)
        hs.clear()
        full = np.empty(n, np.int32)
        full[body] = np.unique(flat, return_inverse=True)[1]
        del flat, body
        full[end] = n + np.arange(len(lens))  # a word of its own at each text's end
        doc = np.repeat(np.arange(len(lens), dtype=np.int32), lens + 1)
        cols = in_shard(full, doc, start, ids, min_words, depth)
        del full, doc
        m, k = len(cols[0]), len(at)
        nul = np.zeros(k, np.int64)
        data = [np.append(np.zeros(m, np.int32), np.ones(k, np.int32)), np.full(m + k, number), np.append(np.zeros(m, np.int64), signed(key))]
        data += [np.append(x, y) for x, y in zip(cols, (who, at, nul, nul, nul))]
        for i in range(0, m + k, 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 50_000]).cast(f.type) for x, f in zip(data, schema)], schema=schema)

    def run(it):
        words = WordHashes(fold=False)
        ids, hs, n, part, count = [], [], 0, TaskContext.get().partitionId(), 0
        for a, texts in batches(it, "doc_id", "text"):
            for d, t in zip(a, texts):
                if d is None or not t or len(h := words.of(t.split())) < min_words:
                    continue
                ids.append(d)
                hs.append(h)
                n += len(h) + 1
                if n >= size:
                    yield from work(ids, hs, part * 1_000_000 + count)
                    ids, hs, n, count = [], [], 0, count + 1
        if ids:
            yield from work(ids, hs, part * 1_000_000 + count)

    return pick(docs, "doc_id", "text").mapInArrow(run, ROWS)


class Merged:
    """Merged runs: sorted distinct keys with the least id's and the latest place of each, in arrays of doubling sizes."""

    def __init__(self):
        self.runs: list[list[np.ndarray]] = []

    def find(self, key: np.ndarray):
        """For each key the run and index where it is, or -1."""
        run, at = np.full(len(key), -1), np.zeros(len(key), np.int64)
        for r, (k, *_) in enumerate(self.runs):
            i = np.minimum(np.searchsorted(k, key), len(k) - 1)
            hit = k[i] == key
            run[hit], at[hit] = r, i[hit]
        return run, at

    def add(self, cols: list[np.ndarray]) -> None:
        self.runs.append(cols)
        while len(self.runs) > 1 and len(self.runs[-1][0]) * 2 > len(self.runs[-2][0]):
            x, y = self.runs.pop(), self.runs.pop()
            both = [np.concatenate([p, q]) for p, q in zip(y, x)]
            order = np.argsort(both[0], kind="stable")
            self.runs.append([c[order] for c in both])


def across(samples_: DataFrame) -> DataFrame:
    """(doc_b, b_start, doc_a, a_start) of sampled places with equal keys in different shards."""
    ddl = "doc_b long,b_start int,doc_a long,a_start int"
    schema = arrow_schema(ddl)

    def merge(merged: Merged, key, doc, pos):
        order = np.lexsort((doc, key))
        key, doc, pos = key[order], doc[order], pos[order]
        run, at = merged.find(key)
        out = []
        for r in np.unique(run[run >= 0]):
            sel = np.flatnonzero(run == r)
            i = at[sel]
            _, fd, fp, ld, lp = merged.runs[r]
            out.append((doc[sel], pos[sel], fd[i], fp[i]))
            other = (ld[i] != fd[i]) | (lp[i] != fp[i])
            out.append((doc[sel][other], pos[sel][other], ld[i][other], lp[i][other]))
            ld[i], lp[i] = doc[sel], pos[sel]
            less = np.flatnonzero(doc[sel] < fd[i])[::-1]  # of a key's places the least id's is written last
            fd[i[less]], fp[i[less]] = doc[sel][less], pos[sel][less]
        fresh = np.flatnonzero(run < 0)
        if len(fresh):
            k, first = np.unique(key[fresh], return_index=True)
            d, p = doc[fresh][first], pos[fresh][first]
            merged.add([k, d, p, d.copy(), p.copy()])
        return out

    def run(it):
        merged, now, held = Merged(), None, []

        def flush():
            if held:
                key, doc, pos = (np.concatenate(x) for x in zip(*held))
                got = merge(merged, key, doc, pos)
                if got:
                    b, bp, a, ap = (np.concatenate(x) for x in zip(*got))
                    keep = a != b
                    b, bp, a, ap = b[keep], bp[keep], a[keep], ap[keep]
                    swap = b < a
                    yield pa.RecordBatch.from_arrays([pa.array(np.where(swap, a, b)), pa.array(np.where(swap, ap, bp), pa.int32()), pa.array(np.where(swap, b, a)), pa.array(np.where(swap, bp, ap), pa.int32())], schema=schema)

        for batch in it:
            shard, key, doc, pos = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("shard", "key", "doc_b", "b_start"))
            cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])).tolist() + [len(shard)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    if shard[lo] != now:
                        yield from flush()
                        now, held = shard[lo], []
                    held.append((key[lo:hi], doc[lo:hi], pos[lo:hi].astype(np.int64)))
        yield from flush()

    return samples_.select("shard", "key", "doc_b", "b_start").repartition("key").sortWithinPartitions("shard", "key").mapInArrow(run, ddl)


def regions(links: DataFrame, min_words: int) -> DataFrame:
    """Links of two documents on one diagonal, near each other, as one stretch to compare."""
    by = ["doc_b", "doc_a", "diag"]
    order = W_.partitionBy(*by).orderBy("b_start")
    d = links.withColumn("diag", F.col("b_start") - F.col("a_start"))
    d = d.withColumn("new", F.coalesce((F.col("b_start") - F.lag("b_start").over(order) > FLANK).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(order))
    d = d.groupBy(*by, "run").agg(F.min("b_start").alias("lo"), F.max("b_start").alias("hi"))
    # as far to the left as both texts go, so that both slices begin on the diagonal
    left = F.least(F.lit(FLANK), F.col("lo"), F.col("lo") - F.col("diag"))
    d = d.withColumn("b_from", F.col("lo") - left).withColumn("b_to", F.col("hi") + min_words + FLANK)
    return d.select("doc_b", "doc_a", F.col("b_from").cast("int").alias("b_from"), F.col("b_to").cast("int").alias("b_to"), (F.col("b_from") - F.col("diag")).cast("int").alias("a_from"), (F.col("b_to") - F.col("diag")).cast("int").alias("a_to"), F.lit(None).cast("binary").alias("anchors"))


def compare(link: dict, b: np.ndarray, a: np.ndarray, min_words: int) -> list[tuple]:
    m = min(len(b), len(a))
    edge = np.diff(np.concatenate([[0], (b[:m] == a[:m]).astype(np.int8), [0]]))
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return [(link["doc_b"], link["b_from"] + int(s), link["doc_a"], link["a_from"] + int(s), int(e - s)) for s, e in zip(lo, hi) if e - s >= min_words]


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, depth: int = DEPTH, shard: int = SHARD) -> DataFrame:
    """doc_id, start_word, end_word, source_id, source_start, source_end of places that hold the same min_words words or more
    (see the module's text)."""
    if depth < min_words:
        raise ValueError("depth has to reach min_words")
    rows = stored(shards(docs, min_words, depth, shard), "shards")
    inside = rows.filter("kind = 0").select("doc_b", "b_start", "doc_a", "a_start", "n_words")
    links = stored(regions(across(rows.filter("kind = 1")), min_words), "links")
    outside = together(docs, links, False, lambda link, b, a: compare(link, b, a, min_words), OUT)
    both = inside.unionByName(outside)
    ends = [(F.col(f"{x}_start") + F.col("n_words")).alias(e) for x, e in (("b", "end_word"), ("a", "source_end"))]
    return both.select(F.col("doc_b").alias("doc_id"), F.col("b_start").alias("start_word"), ends[0], F.col("doc_a").alias("source_id"), F.col("a_start").alias("source_start"), ends[1])


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return repeats(read_table(spark, sf_dir, "documents"))
