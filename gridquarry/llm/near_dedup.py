"""MinHash near-duplicate groups with b-bit signatures (operator 3).

1. A sketch of every text: distinct k-word shingles, 128 MinHash minima, their low 4 bits packed into 64 bytes, and
   32 band keys of 4 minima. Two sets with Jaccard 0.8 miss every band with probability (1-0.8^4)^32 = 5e-8.
2. Texts with one and the same shingle set become one class (min of doc_id, combined before the shuffle), so groups
   of exact copies cost nothing afterwards, however large.
3. Classes that meet in a band are compared by their packed bits: equal nibbles, corrected for chance collisions.
   Of the pairs at 0.6 and more (five standard deviations under 0.8) only a spanning forest of each bucket leaves the task.
4. The components of those forests are clusters of candidates. Each is confirmed on full shingle sets of the whole
   texts; again only a spanning forest of the confirmed links is emitted, so rows stay linear in the input.
5. Components of confirmed links give each document its group.

Buckets and clusters above a size limit are dealt as pairs of blocks over many tasks: every pair of members still
meets in exactly one task, none is dropped, and no task holds more than two blocks.

Nulls: a null, empty or blank text has no shingles and is linked with nothing. A row without doc_id is
kept if no row with an id has its set. Ties go to the smallest doc_id. Repeated rows are copies of each other; doc_id
names one text (where it names several, any one of them stands for it). Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridquarry.llm.common import components, dropped, frugal, minima, seeds, shingle_set, splitmix, written

HASHES, ROWS, BITS = 128, 4, 4
BANDS = HASHES // ROWS
_MULT = seeds(HASHES)
#: Estimated similarity from which a pair is confirmed on full sets; links need 0.8.
ESTIMATE = 0.6
#: Most members of a bucket block, and most shingles of a cluster block.
BUCKET_BLOCK, CLUSTER_BLOCK = 2048, 4_000_000


def signature(hashes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Packed low bits and band keys of a non-empty shingle set."""
    low = minima(hashes, _MULT)
    nibbles = (low & np.uint32((1 << BITS) - 1)).astype(np.uint8)
    packed = (nibbles[0::2] | (nibbles[1::2] << np.uint8(4))).tobytes()
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(ROWS):
        key = splitmix(key + low[i::ROWS].astype(np.uint64) + np.uint64(1))
    return packed, key.view(np.int64)


def similarity(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Collision-corrected estimates from packed bits: one row of 8-byte words against many."""
    x = one[None, :] ^ many
    x = x | (x >> np.uint64(1))
    x = (x | (x >> np.uint64(2))) & np.uint64(0x1111111111111111)
    equal = 1 - np.bitwise_count(x).sum(1) / HASHES
    return (equal - 2.0**-BITS) / (1 - 2.0**-BITS)


def _sketch(k: int):
    def run(batches):
        for b in batches:
            ids, ns, fps, sigs, keys = [], [], [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = shingle_set(text, k)
                sig, key = signature(s) if len(s) else (None, [])
                ids.append(i)
                ns.append(len(s))
                fps.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(sig)
                keys.append(key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(fps, pa.binary()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "fp", "sig", "bands"],
            )

    return run


def sketches(docs: DataFrame, k: int) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        frugal(_sketch(k)), "doc_id long, n_shingles long, fp binary, sig binary, bands array<long>"
    )


class Forest:
    """Union-find over 0..n-1 that keeps the links which joined two trees."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.trees = n
        self.links: list[tuple[int, int]] = []

    def join(self, a: int, b: int) -> None:
        p, q = sorted((self.label[a], self.label[b]))
        if p != q:
            self.label[self.label == q] = p
            self.trees -= 1
            self.links.append((a, b))


def _grouped(batches, width: int):
    """Lists of rows (as column lists) with equal values in the first `width` columns; the input is sorted by them."""
    held, key = None, None
    for b in batches:
        cols = [c.to_pylist() for c in b.columns]
        heads = list(zip(*cols[:width]))
        i = 0
        while i < len(heads):
            j = i + 1
            while j < len(heads) and heads[j] == heads[i]:
                j += 1
            part = [c[i:j] for c in cols[width:]]
            if heads[i] == key:
                for have, more in zip(held, part):
                    have.extend(more)
            else:
                if held:
                    yield key, held
                key, held = heads[i], part
            i = j
    if held:
        yield key, held


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _bucket_forest(batches):
    """Rows key, lo, hi, rep, n_shingles, sig by bucket and block pair -> a spanning forest of the pairs estimated as similar."""
    out: list[tuple[int, int]] = []
    for _, (reps, sizes, sigs) in _grouped(batches, 3):
        m = len(reps)
        words = np.frombuffer(b"".join(sigs), np.uint64).reshape(m, -1)
        n = np.array(sizes, np.int64)
        f = Forest(m)
        for a in range(m):
            if f.trees == 1:
                break
            rest = np.flatnonzero(f.label != f.label[a])
            rest = rest[np.minimum(n[rest], n[a]) * 100 >= 80 * np.maximum(n[rest], n[a])]
            if len(rest):
                for b in rest[similarity(words[a], words[rest]) >= ESTIMATE]:
                    f.join(a, int(b))
        out += [(reps[a], reps[b]) for a, b in f.links]
        if len(out) > 50_000:
            yield _edges(out)
            out = []
    yield _edges(out)


def exact_forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links with 100 * intersection >= percent * union, over every pair of sets."""
    m = len(sets)
    n = np.array([len(s) for s in sets], np.int64)
    if m == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if 100 * common >= percent * (n.sum() - common) else []
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), n)
    order = np.argsort(flat, kind="stable")
    owner_by = owner[order]
    flat = flat[order]
    first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    last = np.r_[first[1:], len(flat)]
    values = flat[first]
    f = Forest(m)
    for a in range(m):
        if f.trees == 1:
            break
        at = np.searchsorted(values, sets[a])
        lens = last[at] - first[at]
        pos = np.repeat(first[at] - np.r_[0, np.cumsum(lens)[:-1]], lens) + np.arange(lens.sum())
        common = np.bincount(owner_by[pos], minlength=m)
        hit = np.flatnonzero((100 * common >= percent * (n + n[a] - common)) & (f.label != f.label[a]))
        for b in hit:
            f.join(a, int(b))
    return f.links


def _confirmed(k: int, percent: int):
    def run(batches):
        """Rows cluster, lo, hi, rep, text by cluster and block pair -> a spanning forest of the confirmed links."""
        out: list[tuple[int, int]] = []
        for _, (reps, texts) in _grouped(batches, 3):
            if len(reps) > 1:
                out += [(reps[a], reps[b]) for a, b in exact_forest([shingle_set(t, k) for t in texts], percent)]
            if len(out) > 50_000:
                yield _edges(out)
                out = []
        yield _edges(out)

    return run


def _dealt(df: DataFrame, blocks: str, key: str, member: str) -> DataFrame:
    """df with lo and hi, the block pairs that a row belongs to: (0, 0) alone for a group of one block."""
    own = F.pmod(F.xxhash64(member), F.col(blocks))
    return (
        df.withColumn("own", own)
        .withColumn("other", F.explode(F.expr(f"sequence(0L, cast({blocks} AS BIGINT) - 1)")))
        .withColumn("lo", F.least("own", "other"))
        .withColumn("hi", F.greatest("own", "other"))
    )


def groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text); see the module's text."""
    own = written(sketches(docs, k), "dedup-sketch")
    classes = written(own.where("fp IS NOT NULL AND doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")), "dedup-classes")
    reps = own.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    rows = reps.select(F.explode("bands").alias("key"), F.col("doc_id").alias("rep"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = written(rows.join(shared, "key").withColumn("blocks", F.ceil(F.col("n") / BUCKET_BLOCK)).drop("n"), "dedup-buckets")
    near = _dealt(met, "blocks", "key", "rep").join(
        own.select(F.col("doc_id").alias("rep"), "n_shingles", "sig").dropDuplicates(["rep"]), "rep"
    )
    forest = (
        near.select("key", "lo", "hi", "rep", "n_shingles", "sig")
        .repartition("key", "lo", "hi")
        .sortWithinPartitions("key", "lo", "hi", "rep")
        .mapInArrow(frugal(_bucket_forest), "u long, v long")
    )
    cluster = components(forest, "dedup-clusters")
    members = cluster.union(cluster.select(F.col("root").alias("v"), "root").distinct())
    sized = members.join(own.select(F.col("doc_id").alias("v"), "n_shingles").dropDuplicates(["v"]), "v")
    blocks = sized.groupBy("root").agg(F.ceil(F.sum("n_shingles") / CLUSTER_BLOCK).alias("blocks"))
    listed = written(members.join(blocks, "root"), "dedup-members")  # its size is known, so that a short one is broadcast and the texts stay where they are
    texts = docs.select(F.col("doc_id").alias("v"), F.col("text").cast("binary").alias("text")).join(listed, "v").dropDuplicates(["v"])
    links = (
        _dealt(texts, "blocks", "root", "v")
        .select("root", "lo", "hi", "v", "text")
        .repartition("root", "lo", "hi")
        .sortWithinPartitions("root", "lo", "hi", "v")
        .mapInArrow(frugal(_confirmed(k, percent)), "u long, v long")
    )
    linked = components(links, "dedup-links")
    named = classes.join(linked.select(F.col("v").alias("rep"), "root"), "rep", "left").select(
        "fp", F.coalesce("root", "rep").alias("component_id")
    )
    out = own.select("doc_id", "n_shingles", "fp").join(named, "fp", "left")
    component = F.coalesce("component_id", "doc_id")
    out = written(out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")), "dedup-groups")
    for done in (own, classes, met, cluster, listed, linked):
        dropped(done)
    return out


#: groups(k=4) in DuckDB, by brute force.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(ws, i, i + 3) AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM c JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id AS u, doc_id AS x FROM documents UNION SELECT e.v, r.x FROM r JOIN e ON r.u = e.u)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.x AS component_id, d.doc_id = m.x AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT u, min(x) AS x FROM r GROUP BY u) m ON m.u = d.doc_id
"""
