"""Toxicity by cumulative-link ordinal regression (operator 8).

A proportional-odds model grades a text: P(grade > j) = sigmoid(w . x - t_j), one weight vector w for all thresholds
t_1 < t_2 < ..., x the presence of words (runs of letters, ASCII lower-cased) and of their first 4, 5 and 6 bytes, known
by 64-bit hashes, scaled by nothing, so that one insult counts alike in a short and a very long text. The result is the expected severity
sum_j P(grade > j), the most likely grade, and whether grade 1 or more is likelier than grade 0.

Training runs on the driver over a bounded sample of labelled texts (SAMPLE a grade at most, by hash of doc_id), on features that occur in LEAST of its
distinct texts and whose chi-square with toxicity is CHI2 or more; scoring covers every whole text. Null and empty texts have no words and get the severity of
no evidence. Unlabelled or null-labelled rows are not trained on; with fewer than two grades the model scores 0
everywhere. Grades may be any numbers from 0 on, but few, as each is a threshold. Repeated texts count once in training; repeated rows are scored alike. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridquarry.llm.common import frugal, seeds, splitmix, word_bounds, word_hashes

SAMPLE, LEAST = 2000, 4
#: Least chi-square of a feature with toxic and other sampled texts.
CHI2 = 15.0
PREFIXES = (4, 5, 6)
_WEIGHT, _PLACE = seeds(256, 21), seeds(8, 22)
#: Bytes that are not part of a word: ASCII but letters.
_STRIP = bytes(c if c > 127 or chr(c).isalpha() else 0x20 for c in range(256))


def words_of(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's words and of their first 4, 5 and 6 bytes (inflected words share those)."""
    data = (text or "").encode().lower().translate(_STRIP)
    if len(data) > 1 << 20:
        cuts = [0, *(data.find(b" ", i) for i in range(1 << 20, len(data), 1 << 20)), len(data)]
        cuts = sorted({c if c >= 0 else len(data) for c in cuts})
        return np.unique(np.concatenate([_features(data[i:j]) for i, j in zip(cuts, cuts[1:])]))
    return _features(data)


def _features(data: bytes) -> np.ndarray:
    buf = np.frombuffer(data, np.uint8)
    starts, ends = word_bounds(buf)
    parts = [word_hashes(data)]
    for n in PREFIXES:
        at = starts[ends - starts > n]
        if len(at):
            parts.append(splitmix((_WEIGHT[buf[at[:, None] + np.arange(n)]] * _PLACE[:n]).sum(1, dtype=np.uint64) + np.uint64(n)))
    return np.unique(np.concatenate(parts))


class Ordinal:
    """vocab: sorted word hashes; weights: one each; cuts: rising thresholds, one under each grade but 0."""

    def __init__(self, vocab: np.ndarray, weights: np.ndarray, cuts: np.ndarray):
        self.vocab, self.weights, self.cuts = vocab, weights, cuts

    def score(self, words: np.ndarray) -> float:
        if not len(self.vocab) or not len(words):
            return 0.0
        at = np.minimum(np.searchsorted(self.vocab, words), len(self.vocab) - 1)
        return float(self.weights[at[self.vocab[at] == words]].sum())

    def above(self, words: np.ndarray) -> np.ndarray:
        """P(grade > j) for each threshold."""
        return 1 / (1 + np.exp(-np.clip(self.score(words) - self.cuts, -60, 60)))


def _chi2(hits: np.ndarray, counts: np.ndarray, positive: int, total: int) -> np.ndarray:
    """Chi-square of each feature: hits of counts texts are among the positive ones of total."""
    a, b, c = hits.astype(float), counts - hits.astype(float), positive - hits.astype(float)
    d = total - positive - b
    return total * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * (a + c) * (b + d), 1e-9)


def slopes(w: np.ndarray, gap: np.ndarray, cols: np.ndarray, owner: np.ndarray, y: np.ndarray, share: np.ndarray, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the penalised log-likelihood by the weights and by the gaps between cuts (the first cut as it is, then logarithms of gaps); text owner[i] has feature cols[i], grade y and weight share."""
    n, top = len(y), len(gap)
    cuts = np.cumsum(np.r_[gap[:1], np.exp(gap[1:])])
    s = np.bincount(owner, w[cols], n)
    edge = np.c_[np.ones(n), 1 / (1 + np.exp(-np.clip(s[:, None] - cuts[None, :], -60, 60))), np.zeros(n)]
    at, slope = np.arange(n), edge * (1 - edge)
    p = np.maximum(edge[at, y] - edge[at, y + 1], 1e-12)
    ds = share * (slope[at, y] - slope[at, y + 1]) / p
    dc = np.zeros(top)
    np.add.at(dc, y[y > 0] - 1, -(share * slope[at, y] / p)[y > 0])
    np.add.at(dc, y[y < top], (share * slope[at, y + 1] / p)[y < top])
    dg = np.cumsum(dc[::-1])[::-1] * np.r_[1.0, np.exp(gap[1:])]
    return np.bincount(cols, ds[owner], len(w)) - l2 * w, dg


def fitted(sample: list[tuple[np.ndarray, int]], rounds: int = 300, l2: float = 2e-4, rate: float = 0.2) -> Ordinal:
    """Penalised maximum likelihood by full-batch Adagrad; a grade weighs as the square root of its texts."""
    once: dict[tuple[bytes, int], tuple[np.ndarray, int]] = {(w.tobytes(), g): (w, g) for w, g in sample}
    rows = [once[k] for k in sorted(once)]
    grades = sorted({g for _, g in rows})
    top = grades[-1] if grades else 0
    if len(grades) < 2:
        return Ordinal(np.empty(0, np.uint64), np.empty(0), np.full(max(top, 1), 60.0))
    every, counts = np.unique(np.concatenate([w for w, _ in rows]), return_counts=True)
    y = np.array([g for _, g in rows])
    bad = np.concatenate([w for w, g in rows if g > 0] or [every[:0]])
    vocab = every[counts >= LEAST]
    counts = counts[counts >= LEAST]
    vocab = vocab[_chi2(np.bincount(np.searchsorted(vocab, bad[np.isin(bad, vocab)]), minlength=len(vocab)), counts, (y > 0).sum(), len(y)) >= CHI2]
    cols, owner = [], []
    for i, (w, _) in enumerate(rows):
        at = np.searchsorted(vocab, w)
        at = at[(at < len(vocab)) & (vocab[np.minimum(at, len(vocab) - 1)] == w)] if len(vocab) else at[:0]
        cols.append(at)
        owner.append(np.full(len(at), i))
    cols, owner = np.concatenate(cols), np.concatenate(owner)
    share = np.array([1 / np.sqrt(max(1, (y == g).sum())) for g in range(top + 1)])[y]
    share /= share.sum()
    w, gap = np.zeros(len(vocab)), np.full(top, 1.0)  # cuts are cumulative sums: the first free, then positive gaps
    gw, gg = np.full(len(vocab), 1e-8), np.full(top, 1e-8)
    for _ in range(rounds):
        dw, dg = slopes(w, gap, cols, owner, y, share, l2)
        gw += dw * dw
        gg += dg * dg
        w += rate * dw / np.sqrt(gw)
        gap += rate * dg / np.sqrt(gg)
    return Ordinal(vocab, w, np.cumsum(np.r_[gap[:1], np.exp(gap[1:])]))


def _words(batches):
    for b in batches:
        rows = [words_of(t).tobytes() for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), b.column(1)], ["words", "grade"])


def trained(docs: DataFrame, grades: DataFrame) -> Ordinal:
    """A model of docs (doc_id, text) and grades (doc_id, grade int from 0), on at most SAMPLE texts a grade."""
    known = grades.where("grade IS NOT NULL AND grade >= 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    counts = [r[0] for r in known.select("grade").distinct().orderBy("grade").collect()]
    picked = None
    for g in counts:
        part = known.where(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        picked = part if picked is None else picked.union(part)
    if picked is None:
        return fitted([])
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "grade")  # SAMPLE ids a grade
    rows = texts.mapInArrow(frugal(_words), "words binary, grade int").collect()
    return fitted([(np.frombuffer(r[0], np.uint64), r[1]) for r in rows])


def _grade(shared):
    def run(batches):
        model = shared.value
        for b in batches:
            p = np.array([model.above(words_of(t)) for t in b.column(1).to_pylist()]).reshape(b.num_rows, -1)
            each = np.c_[np.ones(len(p)), p] - np.c_[p, np.zeros(len(p))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(p.sum(1)), pa.array(each.argmax(1).astype(np.int32)), pa.array(p[:, 0] >= 0.5)],
                ["doc_id", "severity", "grade", "toxic"],
            )

    return run


def graded(docs: DataFrame, model: Ordinal) -> DataFrame:
    """doc_id, severity, grade, toxic for each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # words of LEAST sampled texts
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(frugal(_grade(shared)), "doc_id long, severity double, grade int, toxic boolean")
