"""Word hashing, packing and table plumbing shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import math
import os
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Odd multiplier of the polynomial over word hashes.
BASE = U64(0x9E3779B97F4A7C15)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def has_table(spark: SparkSession, sf_dir: str, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, set here only where it is unset (tests on one machine)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        at = spark.sparkContext.getCheckpointDir()
        path = at or "file:/tmp/lodestrata-shared"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, and outlives any executor."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def local_path(uri: str) -> str:
    """A shared folder's path for Python's own file calls; the folder has to be mounted on every machine."""
    path = uri.removeprefix("file://").removeprefix("file:") if uri.startswith("file:") else uri
    if "://" in path or not path.startswith("/"):
        raise ValueError(f"files that are mapped into memory need a mounted folder as spark.checkpoint.dir, not {uri}")
    return path


def trim() -> None:
    """Gives what a worker has freed since its former tasks back to the system: workers are used again, and keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


class WordHashes(dict):
    """Word -> 64-bit hash; emptied when it has grown large, so that long tasks keep to their memory."""

    def __init__(self, fold: bool, most: int = 200_000):
        self.fold, self.most = fold, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        w = (word.casefold().strip(".,;:!?\"'()[]{}*#%$&|") or word) if self.fold else word
        h = self[word] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=U64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads a polynomial's low bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def kgrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k words running; one hash of all words where there are fewer than k."""
    n = len(h)
    if n == 0:
        return h
    if n < k:
        k = n
    acc = h[: n - k + 1].copy()
    for j in range(1, k):
        acc *= BASE
        acc += h[j : n - k + 1 + j]
    return mix(acc)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def batches(it: Iterable[pa.RecordBatch], *cols: str) -> Iterator[tuple[list, ...]]:
    """Columns as lists, few rows at a time, so that of a large batch no second copy is made."""
    for b in it:
        at = [b.schema.get_field_index(c) for c in cols]
        for i in range(0, b.num_rows, 1024):
            yield tuple(b.column(k).slice(i, 1024).to_pylist() for k in at)


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_(), "float": pa.float32()}
    out = []
    for part in ddl.split(","):
        name, kind = part.split()
        out.append(pa.field(name, pa.list_(kinds[kind[6:-1]]) if kind.startswith("array<") else kinds[kind]))
    return pa.schema(out)


def pick(df: DataFrame, *cols: str) -> DataFrame:
    """Only these columns, whatever else the table has: of several that differ in case the one written so, else the first."""
    have = df.columns
    if len({c.lower() for c in have}) < len(have):
        at = [next((i for i, x in enumerate(have) if x == c), next((i for i, x in enumerate(have) if x.lower() == c.lower()), None)) for c in cols]
        if None not in at:
            return df.toDF(*[f"c{i}" for i in range(len(have))]).select(*[F.col(f"c{i}").alias(c) for i, c in zip(at, cols)])
    return df.select(*[F.col(f"`{c}`") for c in cols])


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of df has, in either case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def winnow(g: np.ndarray, w: int) -> np.ndarray:
    """Positions of the least hash in every window of w k-grams (the rightmost of equals): what two texts share over
    w + k - 1 words is sampled alike in both."""
    n = len(g)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    if n <= w:
        return np.array([n - 1 - int(np.argmin(g[::-1]))], dtype=np.int64)
    # sliding minimum by doubling: value and rightmost position packed together (52 bits of hash, 12 bits of place in block)
    key = g & ~U64(0xFFF)
    pos = np.arange(n, dtype=np.int64)
    best, span = pos, 1
    while span * 2 <= w:
        a, b = best[:-span], best[span:]
        best = np.where(key[b] <= key[a], b, a)
        span *= 2
    rest = w - span
    if rest:
        a, b = best[:-rest], best[rest:]
        best = np.where(key[b] <= key[a], b, a)
    keep = np.ones(len(best), dtype=bool)
    keep[1:] = best[1:] != best[:-1]
    return best[keep]


def spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end, in characters, of each of text.split()'s words."""
    starts, ends, at = [], [], 0
    for w in text.split():
        at = text.index(w, at)
        starts.append(at)
        at += len(w)
        ends.append(at)
    return np.array(starts, dtype=np.int64), np.array(ends, dtype=np.int64)


def bands_for(threshold: float, recall: float, most: int = 512) -> tuple[int, int]:
    """(bands, rows): of all settings within `most` hashes that reach the recall at the threshold, the one that lets the
    fewest dissimilar pairs through (least chance at half the threshold), then the fewest hashes."""
    best = None
    for rows in range(1, 17):
        p = threshold**rows
        bands = 1 if p >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))
        if bands * rows <= most:
            low = 1 - (1 - (threshold / 2) ** rows) ** bands
            key = (round(low, 3), bands * rows)
            if best is None or key < best[0]:
                best = (key, bands, rows)
    if best is None:
        raise ValueError("no setting within that number of hashes reaches the recall")
    return best[1], best[2]


def ship(spark: SparkSession) -> None:
    """Python workers find this package where the driver found it (on a cluster it comes with --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in have.split(":"):
        env["PYTHONPATH"] = f"{root}:{have}" if have else root
