"""Benchmark decontamination by size-partitioned MinHash containment search (operator 4).

Items are short, documents long, so a whole document's MinHash says nothing about one item. Items are partitioned by
their number of k-word shingles (powers of two). For the partition of size g, a document is cut into windows of 2g
shingles that start every g: an occurrence of an item then fills at least about a third of some window, whose Jaccard
similarity with the item is bounded from below. A window and an item are candidates when any of 96 minima agree, so an
item of 17 shingles or more with 80 % of them in a document in one piece is missed with a probability under 1e-8. All windows of a
document come from one pass: minima of blocks of g shingles, of which windows and larger partitions take minima.
Smaller items are found exactly: a document with c of an item's n shingles has one of any n - c + 1 of them, which are
looked up among all shingles of the document.

Candidates are verified exactly: distinct item shingles found in the set of the whole document, as words, against
`percent` of the item's. Items are a query set: they are sent to the tasks in blocks of at most BLOCK items, one pass
over the documents for each block, so what a task holds has a fixed bound however large the benchmark is.

Null, empty and blank texts have no shingles and are in no pair; fewer than k words are one shingle, which only a text of the same words holds. Equal items each
give their own rows, repeated documents too; extra columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridquarry.llm.common import frugal, kept, seeds, shingle_hashes, word_hashes

HASHES = 96
#: Items of at most so many shingles are looked up by shingles, not by minima.
SMALL = 16
#: Items sent to a task at a time, and most bytes of their texts.
BLOCK, BLOCK_BYTES = 50_000, 64 << 20
_MULT = (seeds(HASHES, 11) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # bytes: ASCII letters and the six ASCII spaces


def shingles_of(text: bytes, k: int) -> set[tuple[bytes, ...]]:
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


class Index:
    """Signatures of one block of items, by size partition."""

    def __init__(self, items: list[tuple[int, bytes]], k: int, percent: int):
        self.k, self.percent = k, percent
        self.items = [(i, t) for i, t in items if words_of(t)]
        self.sets = [shingles_of(t, k) for _, t in self.items]
        self.ids = [i for i, _ in self.items]
        parts: dict[int, list[int]] = {}
        probes: list[tuple[np.ndarray, int]] = []
        for n, s in enumerate(self.sets):
            if len(s) <= SMALL:  # of any so many shingles one is in every document with enough of them
                own = np.unique(hashes_of(self.items[n][1], k))
                probes.append((own[: max(1, len(s) - -(-percent * len(s) // 100) + 1)], n))
            else:
                parts.setdefault(int(len(s) - 1).bit_length(), []).append(n)
        keys = np.concatenate([h for h, _ in probes]).astype(np.uint64) if probes else np.empty(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.small = keys[order], np.repeat([n for _, n in probes], [len(h) for h, _ in probes]).astype(int)[order] if probes else np.empty(0, int)
        self.slots = _filter(keys)
        self.parts = []
        for bits, members in sorted(parts.items()):
            sig = np.stack([block_minima(hashes_of(self.items[n][1], k), 1 << 40)[:, 0] for n in members], axis=1)
            # all minima, tagged by their hash and sorted, and a filter by which most windows are told apart at once
            keys = _tagged(sig).ravel()
            order = np.argsort(keys, kind="stable")
            self.parts.append((bits, keys[order], np.tile(np.array(members), HASHES)[order], *_filter(keys)))

    def candidates(self, hashes: np.ndarray) -> set[int]:
        """Items of which some minimum agrees with that of a window, and small ones of which a probe is there."""
        out: set[int] = set()
        if len(self.small[0]):
            seen, shift = self.slots
            tags = hashes.astype(np.uint64)
            out.update(_matches(*self.small, np.unique(tags[seen[_slot(tags, shift)]])))
        level, blocks = None, None
        for bits, keys, members, seen, shift in self.parts:
            if level is None:
                blocks = block_minima(hashes, 1 << bits)
            else:
                for _ in range(bits - level):  # twice the block: minima of neighbours
                    if blocks.shape[1] > 1:
                        even = blocks.shape[1] // 2 * 2
                        blocks = np.concatenate([np.minimum(blocks[:, 0:even:2], blocks[:, 1:even:2]), blocks[:, even:]], axis=1)
            level = bits
            wide = np.minimum(blocks[:, :-1], blocks[:, 1:]) if blocks.shape[1] > 1 else blocks
            tags = _tagged(wide)
            out.update(_matches(keys, members, np.unique(tags[seen[_slot(tags, shift)]])))
        return out

    def found(self, text: bytes) -> list[tuple[int, int, int]]:
        """(item_id, shingles found, shingles of the item) of the items contained in the text."""
        hashes = hashes_of(text, self.k)
        if not len(hashes) or not self.items:
            return []
        hits = self.candidates(hashes)
        if not hits:
            return []
        have = shingles_of(text, self.k)
        rows = []
        for n in sorted(hits):
            s = self.sets[n]
            common = len(s & have)
            if 100 * common >= self.percent * len(s):
                rows.append((self.ids[n], common, len(s)))
        return rows


def hashes_of(text: bytes, k: int) -> np.ndarray:
    """32-bit hashes of a text's shingles in order."""
    return (shingle_hashes(word_hashes(text.lower()), k) >> np.uint64(32)).astype(np.uint32)


def _tagged(minima: np.ndarray) -> np.ndarray:
    """Minima (HASHES x n) with the number of their hash in the upper half."""
    return (np.arange(HASHES, dtype=np.uint64)[:, None] << np.uint64(32)) | minima


def _slot(tags: np.ndarray, shift: int) -> np.ndarray:
    return (tags * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(shift)


def _filter(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """A table of the slots that keys take, and the shift that gives a slot."""
    shift = 64 - min(26, max(12, int(16 * len(keys)).bit_length()))
    seen = np.zeros(1 << (64 - shift), bool)
    seen[_slot(keys, shift)] = True
    return seen, shift


def _matches(keys: np.ndarray, members: np.ndarray, tags: np.ndarray) -> list[int]:
    """The members of the sorted keys that are among the tags."""
    lo, hi = np.searchsorted(keys, tags, "left"), np.searchsorted(keys, tags, "right")
    return [n for a, b in zip(lo[hi > lo], hi[hi > lo]) for n in members[a:b].tolist()]


def _index(name: str, block: list[tuple[int, bytes]], k: int, percent: int) -> Index:
    """The index of a block: tasks that follow in the same worker do not build it anew."""
    return kept(("benchmark", name), lambda: Index(block, k, percent))


def block_minima(hashes: np.ndarray, size: int) -> np.ndarray:
    """HASHES x blocks: the minima of each run of `size` hashes, the last run being shorter."""
    n = len(hashes)
    size = min(size, n)
    out = np.empty((HASHES, -(-n // size)), np.uint32)
    step = max(1, 512 // size) * size  # whole blocks, small enough for the cache
    for i in range(0, n, step):
        part = hashes[i : i + step]
        whole = len(part) // size
        if whole == 1:
            out[:, i // size] = (part[None, :size] * _MULT[:, None]).min(1)
        elif whole:
            turned = np.ascontiguousarray(part[: whole * size].reshape(whole, size).T)
            best = turned[0][None, :] * _MULT[:, None]
            for row in turned[1:]:
                np.minimum(best, row[None, :] * _MULT[:, None], out=best)
            out[:, i // size : i // size + whole] = best
        if whole * size < len(part):
            out[:, i // size + whole] = (part[None, whole * size :] * _MULT[:, None]).min(1)
    return out


def _search(shared):
    def run(batches):
        index = _index(*shared.value)
        for b in batches:
            rows = [(i, *hit) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for hit in index.found(t)]
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "n_found", "n_shingles"])

    return run


def _blocks(items: DataFrame):
    """Lists of (item_id, text), none above BLOCK items or about BLOCK_BYTES, in order of item_id."""
    held, size = [], 0
    for r in items.orderBy("item_id", "text").toLocalIterator():
        held.append((r[0], bytes(r[1])))
        size += len(r[1])
        if len(held) == BLOCK or size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def contained(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, item_id, n_found, n_shingles of each pair where the document (doc_id, text) contains the item (item_id, text)."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    schema = "doc_id long, item_id long, n_found long, n_shingles long"
    out = None
    for block in _blocks(items.where("text IS NOT NULL").select(F.col("item_id").cast("long"), F.col("text").cast("binary").alias("text"))):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, block, k, percent))
        part = own.mapInArrow(frugal(_search(shared)), schema)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out


#: contained() in DuckDB, over the documents and benchmark tables.
SQL = r"""
WITH t AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM t),
s AS (SELECT DISTINCT kind, id, list_slice(ws, i, i + 4) AS g FROM (SELECT kind, id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT id, count(*) AS n FROM s WHERE kind = 1 GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_found, any_value(n.n) AS n_shingles
FROM s d JOIN s b ON d.g = b.g AND d.kind = 0 AND b.kind = 1 JOIN n ON n.id = b.id
GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * any_value(n.n)
"""
