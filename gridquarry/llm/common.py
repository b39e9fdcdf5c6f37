"""Shared pieces of the training-data operators: word hashing, scratch tables, connected components.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D of the UTF-8 text, A-Z lower-cased.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridquarry.sources.scratch import scratch_path

#: Bytes of one hashing step; longer words are hashed one by one.
CHUNK = 1 << 16
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
WORD_SPACE = np.zeros(256, bool)
WORD_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, stream: int = 0) -> np.ndarray:
    """n fixed odd multipliers."""
    with np.errstate(over="ignore"):
        return splitmix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(stream)) | np.uint64(1)


_BYTE = seeds(256, 7)


def _powers(base: int) -> np.ndarray:
    out = np.empty(CHUNK + 1, np.uint64)
    out[0] = 1
    n = 1
    while n <= CHUNK:  # doubling: base**(n+i) = base**n * base**i
        m = min(n, CHUNK + 1 - n)
        out[n : n + m] = out[:m] * np.uint64(pow(base, n, 1 << 64))
        n += m
    return out


_POW = _powers(_BASE)
_INV = _powers(pow(_BASE, -1, 1 << 64))


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words in a byte array."""
    inside = np.empty(len(buf) + 2, np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(WORD_SPACE[buf], out=inside[1:-1].view(bool))
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of data, in order; memory is a few bytes per byte of data."""
    buf = np.frombuffer(data, np.uint8)
    starts, ends = word_bounds(buf)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        s0 = starts[i]
        j = int(np.searchsorted(ends, s0 + CHUNK, "right"))
        if j <= i:
            word = data[s0 : ends[i]]
            out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
            i += 1
            continue
        part = buf[s0 : ends[j - 1]]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[part] * _POW[: len(part)], out=sums[1:])
        s, e = starts[i:j] - s0, ends[i:j] - s0
        out[i:j] = splitmix((sums[e] - sums[s]) * _INV[s] + (e - s).astype(np.uint64))
        i = j
    return out


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word shingles in order; with fewer words, of the whole sequence; none without words."""
    n = len(words)
    if n == 0:
        return words
    size = min(n, k)
    h = words[: n - size + 1].copy()
    for i in range(1, size):
        h = h * np.uint64(_BASE) + words[i : n - size + 1 + i]
    return splitmix(h + np.uint64(size))


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; null, empty and blank texts have none."""
    return np.unique(shingle_hashes(word_hashes((text or b"").lower()), k))


def minima(hashes: np.ndarray, mult: np.ndarray, block: int = 512) -> np.ndarray:
    """For each multiplier the least 32-bit value of (hash * multiplier) >> 32, over a non-empty array."""
    best = np.full(len(mult), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(hashes), block):
        part = hashes[None, i : i + block] * mult[:, None]
        np.minimum(best, (part >> np.uint64(32)).min(1).astype(np.uint32), out=best)
    return best


#: What this worker keeps for later tasks, and the keys that its present task has asked for.
_KEPT: dict = {}
_ASKED: set = set()


def kept(key, make):
    """make(), once in each Python worker: it stays until a frugal task that did not ask for it ends."""
    _ASKED.add(key)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def asked_anew() -> None:
    _ASKED.clear()


def unasked_dropped() -> None:
    for key in _KEPT.keys() - _ASKED:
        del _KEPT[key]


def sliced(batches, most: int = 1 << 21):
    """The rows of Arrow batches in order, in slices of about `most` bytes, so that what is made of a slice is small beside its batch."""
    for b in batches:
        step = max(1, b.num_rows * most // max(1, b.nbytes))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def frugal(run):
    """A mapInArrow function that gives free memory, and what other operators keep, back to the system when its task ends, as its worker lives on."""

    def wrapped(batches):
        import ctypes

        import pyarrow

        asked_anew()
        try:
            yield from run(batches)
        finally:
            unasked_dropped()
            pyarrow.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: its lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes what written() has written; df must not be read afterwards."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of (u long, v long) links: rows (v, root) for each vertex but the roots, root the least vertex.

    Alternates large-star and small-star steps, each a min by vertex (combined before the shuffle) joined back to
    the links, until a step changes nothing. Every round is written to the shared folder. Self links are ignored.
    """
    cur = written(
        edges.where("u <> v").select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("root")).distinct(), name
    )

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("v", "root").cast("decimal(20,0)"))).first())

    seen = mark(cur)
    while seen[0]:
        both = cur.select("v", F.col("root").alias("w")).union(cur.select(F.col("root").alias("v"), F.col("v").alias("w")))
        least = both.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("m"))
        large = both.join(least, "v").where("w > v").select(F.col("w").alias("v"), F.col("m").alias("root")).where("v <> root").distinct()
        least = large.groupBy("v").agg(F.min("root").alias("m"))
        small = large.join(least, "v")
        small = (
            small.select(F.col("root").alias("v"), F.col("m").alias("root"))
            .where("v <> root")
            .union(least.select("v", F.col("m").alias("root")))
            .distinct()
        )
        nxt = written(small, name)
        now = mark(nxt)
        dropped(cur)
        cur = nxt
        if now == seen:
            break
        seen = now
    return cur
