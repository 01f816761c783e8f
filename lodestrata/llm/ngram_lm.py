"""LM scoring with an n-gram trie in Elias-Fano levels (operator 4).

A model over the tokens of a public byte-level vocabulary (every text has tokens, none is unknown; BOS and EOS are two numbers
beyond them), of order 3, interpolated by Witten-Bell: P(w | c) = a(c, w) + g(c) P(w | c') with a(c, w) = n(c, w) / (n(c) +
t(c)), g(c) = t(c) / (n(c) + t(c)), t(c) the number of different continuations and c' the context without its first token;
under the unigrams lies the uniform distribution.

Counting. Each task counts the n-grams of its texts as numbers of 16 bits a token and sends each distinct one on with its
count, as packed arrays by shards of the context; shorter n-grams are prefixes, so one pass gives all orders. All documents are
counted. A context's different n-grams are no more than the vocabulary, and the hash of the context tells the shard, so that a
frequent first token is spread over all shards; there are as many as shuffle partitions.

Trie. A shard is one task's work, written to the shared folder as one file: for each level the symbols as the monotone
sequence (parent's pointer + symbol), the first-child pointers as another, both in Elias-Fano form, and log a and log g in 8
bits each by a quantiser of equal-mass bins per level (its levels stand in the file). A first token's totals are spread over
shards: the level of pairs holds log n, and the totals, one row a token of the vocabulary, are summed by Spark and kept beside
the files. Workers map the files into memory and share the pages. Looking up w after c is a search for the successor of c's
range start + w: the bucket of high bits meets the range of c's children, and low bits are searched within.

Scores. The distinct n-grams of a batch are looked up once, each distinct context before them once, and their
log-probabilities are gathered over the texts; what a worker has looked up it keeps for its next tasks.

The folder in spark.checkpoint.dir has to be a path that every machine has mounted, as the files are mapped into memory; a
folder that only Hadoop can read is refused.

Defined results: a null text has a null score; an empty text is scored by its end alone; null ids are carried along; rows
are scored each, repeated ones too, and counted each; whole texts count and are scored, however long; the model of an empty
table is the uniform distribution; columns beside doc_id and text are not looked at.
"""

from __future__ import annotations

import json
import mmap
import os
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import U64, arrow_schema, batches, local_path, mix, pick, read_table, shared_dir, ship, stored
from lodestrata.llm.fertility import Vocabularies

#: 2 or 3.
ORDER = 3
EOS, BOS = 50_256, 50_257
VOCABULARY = 50_258
BINS = 256
#: Characters of text made into tokens at a time, and held for one look-up.
SLICE, HELD = 1 << 19, 1 << 23
#: N-grams that a task gathers before it sends them.
GATHERED = 6_000_000
#: N-grams whose probabilities a worker keeps.
MOST_KEPT = 1_500_000
SCHEMA = "doc_id long,n_tokens long,log2_prob double,bits_per_token double,perplexity double"


#: Of each byte, how many bits are set, and where its n-th set bit is.
_ONES = np.array([x.bit_count() for x in range(256)], np.uint8)
_PLACE = np.array([([k for k in range(8) if x >> k & 1] + [0] * 8)[:8] for x in range(256)], np.int64)


# ---- Elias-Fano -------------------------------------------------------------------------------------------------------


class EliasFano:
    """A sequence of numbers that never falls: low bits packed, high bits in unary, with a rank sample per 512 high bits."""

    def __init__(self, n: int, low: int, top: int, lows: np.ndarray, highs: np.ndarray, ones: np.ndarray):
        self.n, self.low, self.top, self.lows, self.highs, self.ones = n, low, top, lows, highs.reshape(-1, 8), ones
        self.zeros = np.arange(len(ones), dtype=np.int64) * 512 - ones

    @staticmethod
    def build(v: np.ndarray, top: int) -> bytes:
        n = len(v)
        low = max(0, int(np.log2(max(1, (top + 1) / max(1, n)))))
        v = v.astype(U64)
        bits = np.zeros(n + (top >> low) + 2, np.uint8)
        bits[(v >> U64(low)).astype(np.int64) + np.arange(n)] = 1
        bits = np.append(bits, np.zeros(-len(bits) % 512, np.uint8))
        highs = np.packbits(bits, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(bits.reshape(-1, 512).sum(1, dtype=np.int64))]).astype(np.int64)
        if low:
            lo = ((v[:, None] >> np.arange(low, dtype=U64)) & U64(1)).astype(np.uint8).reshape(-1)
            lows = np.packbits(np.append(lo, np.zeros(64 - len(lo) % 64 + 64, np.uint8)), bitorder="little")
        else:
            lows = np.zeros(16, np.uint8)
        lows = np.append(lows, np.zeros(-len(lows) % 8, np.uint8))
        return struct.pack("<QQQQQQ", n, low, top, len(lows), len(highs), len(ones)) + lows.tobytes() + highs.tobytes() + ones.tobytes()

    @classmethod
    def read(cls, buf: memoryview, at: int) -> tuple[EliasFano, int]:
        n, low, top, a, b, c = struct.unpack_from("<QQQQQQ", buf, at)
        at += 48
        lows = np.frombuffer(buf, np.uint8, a, at)
        highs = np.frombuffer(buf, np.uint64, b // 8, at + a)
        ones = np.frombuffer(buf, np.int64, c, at + a + b)
        return cls(n, low, top, lows, highs, ones), at + a + b + 8 * c

    def low_of(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.int64)
        bit = i * self.low
        word = np.zeros(len(i), U64)
        for k in range((self.low + 7) // 8 + 1):
            word |= self.lows[np.minimum((bit >> 3) + k, len(self.lows) - 1)].astype(U64) << U64(8 * k)
        return ((word >> (bit & 7).astype(U64)) & U64((1 << self.low) - 1)).astype(np.int64)

    def select(self, i: np.ndarray, bit: int) -> np.ndarray:
        """Place of the i-th (from 0) high bit of this value."""
        before = self.ones if bit else self.zeros
        block = np.minimum(np.searchsorted(before, i, side="right") - 1, len(self.ones) - 2)
        rest = (i - before[block]).astype(np.int16)
        rows = self.highs[block]
        if not bit:
            rows = ~rows
        # the word that holds it, then the byte
        nth = np.arange(len(i))
        upto = np.cumsum(np.bitwise_count(rows), axis=1, dtype=np.int16)
        word = (upto > rest[:, None]).argmax(1)
        rest = rest - np.where(word > 0, upto[nth, word - 1], 0)
        some = rows[nth, word].view(np.uint8).reshape(-1, 8)
        upto = np.cumsum(_ONES[some], axis=1, dtype=np.int16)
        byte = (upto > rest[:, None]).argmax(1)
        left = rest - np.where(byte > 0, upto[nth, byte - 1], 0)
        return block * 512 + word * 64 + byte * 8 + _PLACE[some[nth, byte], left]

    def get(self, i: np.ndarray) -> np.ndarray:
        out = np.empty(len(i), np.int64)
        for s in range(0, len(i), 8192):
            j = i[s : s + 8192]
            out[s : s + 8192] = ((self.select(j, 1) - j) << self.low) | self.low_of(j)
        return out

    def find(self, v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Index of v in [lo, hi), or -1: the successor of v, which lies in the bucket of its high bits if it is v itself."""
        out = np.full(len(v), -1)
        could = np.flatnonzero((lo < hi) & (v <= self.top))
        for s in range(0, len(could), 8192):
            c = could[s : s + 8192]
            h, want = v[c] >> self.low, v[c] & ((1 << self.low) - 1)
            # ones before the zeros that end this bucket and the one before it
            ends = self.select(np.concatenate([h, np.maximum(h - 1, 0)]), 0)
            start = np.where(h > 0, ends[len(h) :] - (h - 1), 0)
            a, b = np.maximum(lo[c], start), np.minimum(hi[c], ends[: len(h)] - h)
            end, live = b.copy(), np.flatnonzero(a < b)
            while len(live):
                mid = (a[live] + b[live]) >> 1
                less = self.low_of(mid) < want[live]
                a[live] = np.where(less, mid + 1, a[live])
                b[live] = np.where(less, b[live], mid)
                live = live[a[live] < b[live]]
            some = np.flatnonzero(a < end)
            hit = some[self.low_of(a[some]) == want[some]]
            out[c[hit]] = a[hit]
        return out


# ---- counting ---------------------------------------------------------------------------------------------------------


def tokens_of(text: str, folder: str) -> np.ndarray:
    core = Vocabularies.get(folder).bytes_bpe._core_bpe
    try:
        ids = core.encode_ordinary(text)
    except UnicodeEncodeError:
        ids = core.encode_ordinary(text.encode("utf-16", "surrogatepass").decode("utf-16", "replace"))
    return np.array(ids, np.uint16)


def windows(texts: list[np.ndarray], order: int) -> np.ndarray:
    """N-grams as numbers, one for each place of BOS + text + EOS, padded behind by EOS."""
    begin, end = np.array([BOS], np.uint16), np.full(order, EOS, np.uint16)
    flat = np.concatenate([x for t in texts for x in (begin, t, end)]).astype(U64)
    acc = np.zeros(len(flat) - order + 1, U64)
    for k in range(order):
        acc = (acc << U64(16)) | flat[k : len(flat) - order + 1 + k]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1 + order)
    keep = np.ones(len(flat), bool)
    for k in range(1, order):
        keep[ends - k] = False
    return acc[keep[: len(acc)]]


def fold(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    g, c = np.concatenate(grams), np.concatenate(counts)
    order = np.argsort(g, kind="stable")
    g, c = g[order], c[order]
    at = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    return g[at], np.add.reduceat(c, at) if len(g) else c


def distinct(parts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(the distinct numbers of all parts, sorted; for each part, the places of its numbers among them), by one sort: np.unique
    would hash them, and the places be searched for."""
    if not parts:
        return np.zeros(0, U64), []
    flat = np.concatenate(parts)
    order = np.argsort(flat)
    flat = flat[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    place = np.empty(len(flat), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return flat[new], np.split(place, np.cumsum([len(x) for x in parts])[:-1])


def shard_of(ctx: np.ndarray, shards: int) -> np.ndarray:
    """The shard of the n-grams that begin with this context (of one token less)."""
    return ((mix(ctx.astype(U64)) >> U64(48)) * U64(shards) >> U64(16)).astype(np.int64)


#: Sorted n-grams and counts as planes of 16 bits, of which the high ones are nearly constant.
COUNTS = "shard int,data binary"


def planes(g: np.ndarray, c: np.ndarray) -> bytes:
    parts = [(g >> U64(16 * k)).astype(np.uint16) for k in range(3)] + [(c >> (16 * k)).astype(np.uint16) for k in range(3)]
    return b"".join(x.tobytes() for x in parts)


def unplanes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(data, np.uint16).reshape(6, -1)
    g = flat[0].astype(U64) | flat[1].astype(U64) << U64(16) | flat[2].astype(U64) << U64(32)
    return g, flat[3].astype(np.int64) | flat[4].astype(np.int64) << 16 | flat[5].astype(np.int64) << 32


def count(docs: DataFrame, order: int, shards: int, folder: str) -> DataFrame:
    """Each task's distinct n-grams with their counts, by shard."""
    schema = arrow_schema(COUNTS)

    def send(gs, cs):
        g, c = fold(gs, cs)
        at = shard_of(g >> U64(16), shards)
        by = np.argsort(at, kind="stable")
        cuts = np.searchsorted(at[by], np.arange(shards + 1)).tolist()
        rows = [(k, planes(g[by[lo:hi]], c[by[lo:hi]])) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if hi > lo]
        for i in range(0, len(rows), 256):
            yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows[i : i + 256]), schema)], schema=schema)

    def run(it):
        gs, cs, size, held, chars = [], [], 0, [], 0

        def taken():
            g, c = np.unique(windows(held, order), return_counts=True)
            gs.append(g)
            cs.append(c)
            held.clear()
            return len(g)

        for (texts,) in batches(it, "text"):
            for t in texts:
                if t is None:
                    continue
                held.append(tokens_of(t, folder))
                chars += len(t)
                if chars > 4 * SLICE:
                    size, chars = size + taken(), 0
                    if size > GATHERED:
                        g, c = fold(gs, cs)
                        gs, cs, size = [g], [c], len(g)
                        if size > GATHERED // 2:  # so many different ones are sent on as they are
                            yield from send(gs, cs)
                            gs, cs, size = [], [], 0
        if held:
            taken()
        if gs:
            yield from send(gs, cs)

    return pick(docs, "text").mapInArrow(run, COUNTS)


# ---- the trie ---------------------------------------------------------------------------------------------------------


def quantiser(v: np.ndarray, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """(bin's value each, bin of each v): bins of equal mass, each one standing for its mean; few values stand as they are."""
    u = np.unique(v)
    if len(u) <= bins:
        book = np.append(u, np.full(bins - len(u), u[-1] if len(u) else 0.0))
        return book.astype(np.float32), np.searchsorted(u, v).astype(np.uint8)
    s = np.sort(v)
    cut = np.unique(s[np.arange(1, bins) * len(s) // bins])
    code = np.searchsorted(cut, v, side="right")
    n = np.bincount(code, minlength=bins)
    book = np.bincount(code, v, minlength=bins) / np.maximum(n, 1)
    return book.astype(np.float32), code.astype(np.uint8)


def build(g: np.ndarray, counts: np.ndarray, order: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(a shard's file, its first tokens, their counts and different continuations here), from sorted distinct n-grams."""
    out, size = [], []
    for k in range(1, order + 1):
        key = g >> U64(16 * (order - k))
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        n = np.add.reduceat(counts, at).astype(np.float64)
        key = key[at]
        if k == 1:
            parent, first = np.zeros(len(at), np.int64), np.array([0, len(at)])
        else:
            before = size[-1][0]
            parent = np.searchsorted(before, key >> U64(16))
            first = np.append(np.searchsorted(parent, np.arange(len(before))), len(at))
        size.append((key, n, parent, first))

    def coded(v: np.ndarray) -> bytes:
        book, code = quantiser(v)
        return book.tobytes() + struct.pack("<Q", len(code)) + code.tobytes() + b"\0" * (-len(code) % 8)

    for k, (key, n, parent, _) in enumerate(size, 1):
        v = (parent << 16) + (key & U64(0xFFFF)).astype(np.int64)
        out.append(EliasFano.build(v, int(v[-1])))
        if k == 2:
            out.append(coded(np.log2(n)))  # the first token's totals lie in other shards too
        elif k > 2:
            t = np.diff(size[k - 1][3])
            out.append(coded(np.log2(n / (size[k - 2][1] + t)[parent])))
        if k < order:
            first = size[k][3]
            out.append(EliasFano.build(first, int(first[-1])))
            if k > 1:
                t = np.diff(first)
                out.append(coded(np.log2(t / (n + t))))
    return struct.pack("<Q", order) + b"".join(out), size[0][0], size[0][1], np.diff(size[1][3])


class Level:
    pass


class SubTrie:
    def __init__(self, path: str):
        f = os.open(path, os.O_RDONLY)
        self.map = mmap.mmap(f, 0, prot=mmap.PROT_READ)
        os.close(f)
        buf = memoryview(self.map)
        (self.order,) = struct.unpack_from("<Q", buf, 0)
        at, self.levels = 8, []

        def coded(at):
            book = np.frombuffer(buf, np.float32, BINS, at)
            (n,) = struct.unpack_from("<Q", buf, at + 4 * BINS)
            at += 4 * BINS + 8
            return (book, np.frombuffer(buf, np.uint8, n, at)), at + n + -n % 8

        for k in range(1, self.order + 1):
            lv = Level()
            lv.keys, at = EliasFano.read(buf, at)
            if k > 1:
                lv.alpha, at = coded(at)
            if k < self.order:
                lv.first, at = EliasFano.read(buf, at)
                if k > 1:
                    lv.gamma, at = coded(at)
            self.levels.append(lv)

    def children(self, node: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Range of the children of nodes of level k, which is empty for -1."""
        lo, hi = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
        there = np.flatnonzero(node >= 0)
        if len(there):
            pair = self.levels[k - 1].first.get(np.concatenate([node[there], node[there] + 1]))
            lo[there], hi[there] = pair[: len(there)], pair[len(there) :]
        return lo, hi

    def pairs(self, key: np.ndarray) -> np.ndarray:
        """Nodes of distinct pairs of tokens, or -1; each distinct first token is looked up once."""
        up, inv = np.unique(key >> U64(16), return_inverse=True)
        top = self.levels[0].keys
        above = top.find(up.astype(np.int64), np.zeros(len(up), np.int64), np.full(len(up), top.n))
        lo, hi = self.children(above, 1)
        return self.levels[1].keys.find((above[inv] << 16) + (key & U64(0xFFFF)).astype(np.int64), lo[inv], hi[inv])


class Model:
    _one: dict[str, Model] = {}

    def __init__(self, folder: str):
        with open(f"{folder}/manifest.json") as f:
            m = json.load(f)
        self.order, self.shards = m["order"], m["shards"]
        self.tries = {int(b): SubTrie(f"{folder}/{name}") for b, name in m["files"].items()}
        self.n, self.t = np.load(f"{folder}/totals.npy")
        n, kinds = self.n.sum(), (self.n > 0).sum()
        self.keys, self.vals = np.full(1, (1 << 64) - 1, U64), np.zeros(1)
        self.unigram = (self.n + kinds / VOCABULARY) / (n + kinds) if n else np.full(1 << 16, 1 / VOCABULARY)

    @classmethod
    def get(cls, folder: str) -> Model:
        if folder not in cls._one:
            cls._one.clear()
            cls._one[folder] = cls(folder)
        return cls._one[folder]

    def known_logs(self, key: np.ndarray) -> np.ndarray:
        """log2 of the probabilities of distinct grams (with how much of the context is there above them). What was asked before
        is kept by the worker from task to task, MOST_KEPT at most."""
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        val = self.vals[at]
        new = np.sort(key[~hit])
        if len(new):
            logs = np.log2(self.prob(new & U64((1 << 48) - 1), (new >> U64(48)).astype(np.int64)))
            val[~hit] = logs[np.searchsorted(new, key[~hit])]
            if len(self.keys) > MOST_KEPT:
                self.keys, self.vals = new, logs
            else:
                both = np.concatenate([self.keys, new])
                order = np.argsort(both, kind="stable")
                self.keys, self.vals = both[order], np.concatenate([self.vals, logs])[order]
        return val

    def prob(self, grams: np.ndarray, known: np.ndarray) -> np.ndarray:
        """P of each n-gram's last token after its `known` tokens before."""
        p = self.unigram[(grams & U64(0xFFFF)).astype(np.int64)].copy()
        last, ctx = grams & U64(0xFFFFFFFF), grams >> U64(16)
        full = np.flatnonzero(known >= 2) if self.order > 2 else np.zeros(0, np.int64)
        pairs, inv = np.unique(np.concatenate([last, ctx[full]]), return_inverse=True)
        if self.order > 2:
            shard = shard_of(pairs, self.shards)
        else:
            shard = shard_of(pairs >> U64(16), self.shards)
        number, alpha, gamma = np.zeros(len(pairs)), np.zeros(len(full)), np.ones(len(full))
        by = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[by], np.arange(self.shards + 1)).tolist()
        mine = inv[len(last) :]
        of = np.argsort(shard[mine], kind="stable")
        parts = np.searchsorted(shard[mine][of], np.arange(self.shards + 1)).tolist()
        place = np.zeros(len(pairs), np.int64)
        for s, t in self.tries.items():
            some = by[cuts[s] : cuts[s + 1]]
            if not len(some):
                continue
            node = t.pairs(pairs[some])
            there = np.flatnonzero(node >= 0)
            book, code = t.levels[1].alpha
            number[some[there]] = np.exp2(book[code[node[there]]].astype(np.float64))
            sel = of[parts[s] : parts[s + 1]]
            if not len(sel):
                continue
            place[some] = np.arange(len(some))
            lo, hi = t.children(node, 2)
            j = place[mine[sel]]
            there = np.flatnonzero(node[j] >= 0)
            sel, j = sel[there], j[there]
            book, code = t.levels[1].gamma
            gamma[sel] = np.exp2(book[code[node[j]]].astype(np.float64))
            at = t.levels[2].keys.find((node[j] << 16) + (grams[full[sel]] & U64(0xFFFF)).astype(np.int64), lo[j], hi[j])
            book, code = t.levels[2].alpha
            alpha[sel[at >= 0]] = np.exp2(book[code[at[at >= 0]]].astype(np.float64))
        one = np.flatnonzero(known >= 1)
        before = (last[one] >> U64(16)).astype(np.int64)
        n, t = self.n[before], self.t[before]
        seen = n > 0
        total = np.where(seen, n + t, 1.0)
        p[one] = np.where(seen, number[inv[: len(last)][one]] / total + t / total * p[one], p[one])
        p[full] = alpha + gamma * p[full]
        return p


def train(docs: DataFrame, order: int = ORDER, folder: str = "/opt/tokenizers") -> str:
    """The place of the model's files in the shared folder. A shard is one task's work; what is brought to the driver are the
    shards' file names and, for each token of the vocabulary, its totals. Tasks that are repeated write files of other names;
    the one that is reported counts."""
    if not 2 <= order <= 3:
        raise ValueError("order is 2 or 3")
    spark = docs.sparkSession
    uri = f"{shared_dir(spark)}/trie-{uuid.uuid4().hex}"
    to = local_path(uri)
    os.makedirs(to, exist_ok=True)
    shards = min(1 << 16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    out_ddl = "shard long,name string,token array<long>,n array<long>,t array<long>"
    out_schema = arrow_schema(out_ddl)

    def run(it):
        def flush():
            g, c = fold(*zip(*held))
            data, token, n, t = build(g, c, order)
            name = f"{now}-{uuid.uuid4().hex}.ef"
            with open(f"{to}/{name}", "wb") as f:
                f.write(data)
            yield pa.RecordBatch.from_pydict({"shard": [now], "name": [name], "token": [token.astype(np.int64)], "n": [n.astype(np.int64)], "t": [t.astype(np.int64)]}, schema=out_schema)

        now, held = None, []
        for shard, data in batches(it, "shard", "data"):
            for s, d in zip(shard, data):
                if s != now:
                    if held:
                        yield from flush()
                    now, held = s, []
                held.append(unplanes(d))
        if held:
            yield from flush()

    made = stored(count(docs, order, shards, folder).repartition("shard").sortWithinPartitions("shard").mapInArrow(run, out_ddl), "shards")
    files = made.select("shard", "name").collect()
    totals = made.select(F.explode(F.arrays_zip("token", "n", "t")).alias("x")).groupBy("x.token").agg(F.sum("x.n").alias("n"), F.sum("x.t").alias("t")).toPandas()
    both = np.zeros((2, 1 << 16))
    both[:, totals["token"].to_numpy(np.int64)] = totals[["n", "t"]].to_numpy(np.float64).T
    np.save(f"{to}/totals.npy", both)
    with open(f"{to}/manifest.json", "w") as f:
        json.dump({"order": order, "shards": shards, "files": {r.shard: r.name for r in files}}, f)
    return to


def score(docs: DataFrame, model: str, folder: str = "/opt/tokenizers") -> DataFrame:
    schema = arrow_schema(SCHEMA)

    def grams_of(some: list[np.ndarray], order: int) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The texts' n-grams, by hashing (np.unique would sort), and how many each text has."""
        lens = np.fromiter(map(len, some), np.int64, len(some)) + 1
        # BOS stands in front; the number above the n-gram is what of the context is there
        front, end = np.append(np.zeros(order - 2, np.uint16), np.uint16(BOS)), np.array([EOS], np.uint16)
        flat = np.concatenate([x for t in some for x in (front, t, end)])
        acc = np.zeros(len(flat) - order + 1, U64)
        for k in range(order):
            acc <<= U64(16)
            acc |= flat[k : len(flat) - order + 1 + k]
        first = np.cumsum(lens) - lens
        nth = np.arange(int(lens.sum())) - np.repeat(first, lens)
        # acc[j] ends at place j + order - 1; a text's tokens begin order - 1 places after it does
        grams = acc[nth + np.repeat(np.cumsum(lens + order - 1) - (lens + order - 1), lens)]
        grams |= np.minimum(nth + 1, order - 1).astype(U64) << U64(48)
        return pa.array(grams).dictionary_encode(), lens

    def run(it):
        m = Model.get(model)
        held, size = [], 0

        def flush():
            """Scores what is held: all its distinct n-grams are looked up together."""
            key, places = distinct([c.dictionary.to_numpy() for _, _, c, _ in held if c is not None])
            val, places = m.known_logs(key), iter(places)
            for ids, some, coded, lens in held:
                lp = []
                if coded is not None:
                    own = val[next(places)]
                    lp = np.add.reduceat(own[coded.indices.to_numpy()], np.cumsum(lens) - lens).tolist()
                rows, j = {c: [] for c in schema.names}, 0
                for d, n in zip(ids, some):
                    if n is None:
                        v = (d, None, None, None, None)
                    else:
                        x = lp[j]
                        v = (d, n, x, -x / (n + 1), 2.0 ** (-x / (n + 1)))
                        j += 1
                    for c, y in zip(rows.values(), v):
                        c.append(y)
                yield pa.RecordBatch.from_pydict(rows, schema=schema)
            held.clear()

        for ids, texts in batches(it, "doc_id", "text"):
            i = 0
            while i < len(ids):
                part, n, at = [], 0, i
                while i < len(ids) and n < SLICE:
                    part.append(None if texts[i] is None else tokens_of(texts[i], folder))
                    n += len(texts[i] or "")
                    i += 1
                some = [t for t in part if t is not None]
                coded, lens = grams_of(some, m.order) if some else (None, None)
                held.append((ids[at:i], [None if t is None else len(t) for t in part], coded, lens))
                size += n
                if size >= HELD:
                    yield from flush()
                    size = 0
        yield from flush()

    return pick(docs, "doc_id", "text").mapInArrow(run, SCHEMA)


def lm_scores(docs: DataFrame, order: int = ORDER, folder: str = "/opt/tokenizers") -> DataFrame:
    """Each document's log-probability under the model of all documents."""
    return score(docs, train(docs, order, folder), folder)


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return lm_scores(read_table(spark, sf_dir, "documents"))
