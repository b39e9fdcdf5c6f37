"""Token-id files (operator 7): Parquet with one row a document, ids as a list column.

Documents are dealt by ranges of doc_id and sorted in them, so files and rows follow ascending doc_id. Ids are small
integers of few distinct values: the id column is dictionary-encoded, or delta-encoded (writer version 2) on request,
in row groups of a stated size, with page indexes that let a reader skip to single documents; metadata columns are
read without the ids. `start`, the number of ids of all documents before, needs no pass over the ids and no single
task: every file carries running sums of its own, and one number a file is summed over the files.

Every whole text is encoded, null as empty; an end id is appended to each, so an empty text has one id. Repeated
doc_ids keep all their rows, in order of text; rows without doc_id come first. Extra columns are not written.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridquarry.llm.common import frugal, kept, sliced
from gridquarry.llm.pretokens import Splitter, is_latin

#: Bytes of a row group and of a page.
ROW_GROUP, PAGE = 32 << 20, 64 << 10
#: Bytes of ids after which a batch ends, and words whose ids a worker keeps.
BYTES, KNOWN = 4 << 20, 400_000
#: Bytes of the input, as Spark knows it, for each file, beyond one for each shuffle partition.
FILE_BYTES = 1 << 29
SCHEMA = "doc_id long, file int, local_start long, n_tokens long, ids array<int>"


class Words:
    """The tokenizers library with a memory of words.

    Its BPE works within the words of its split, so the ids of a Latin-1 text are those of its words one after
    another; each word is encoded by the library once in a worker. In that range the file's normalisation is lower
    case and nothing else. Other texts, and files that normalise or split otherwise, go to the library whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.known: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.splitter = self._splitter(made)
        self.plain = self._plain(made) if self.splitter else self.library
        suffix, vocab = made["model"].get("end_of_word_suffix") or "\0", self.library.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for piece, i in vocab.items() if piece.endswith(suffix)]] = True

    @staticmethod
    def _splitter(made: dict):
        """The file's split, if the file normalises and splits as this class assumes."""
        steps = [x["type"] for x in (made.get("normalizer") or {}).get("normalizers", ())]
        first = ((made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        if steps != ["NFC", "Replace", "Lowercase"] or first.get("type") != "Split" or not first.get("invert") or first.get("behavior") != "Removed":
            return None
        return Splitter(first["pattern"]["Regex"])

    @staticmethod
    def _plain(made: dict):
        """The same tokenizer for words that are normalised and split already, with one space between two."""
        from tokenizers import Tokenizer

        steps = [{"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}, *made["pre_tokenizer"]["pretokenizers"][1:]]
        tokens = [x for x in made.get("added_tokens") or () if not x["special"]]  # special ones are not looked for in texts
        out = Tokenizer.from_str(json.dumps({**made, "normalizer": None, "pre_tokenizer": {**made["pre_tokenizer"], "pretokenizers": steps}, "added_tokens": tokens}))
        out.encode_special_tokens = True
        return out

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, words: list[str]) -> list[bytes]:
        """The ids of each word, from one text of all: a word's last piece ends in the file's suffix."""
        ids = np.array(self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return self._whole(words)
        raw, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [raw[i:j] for i, j in zip(cuts, cuts[1:])]

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if self.splitter is None or not (text.isascii() or is_latin(text)):
            return self._whole([text])[0]
        out = []
        for words in self.splitter.slices(text.lower()):
            if len(self.known) > KNOWN:
                self.known.clear()
            fresh = list(set(words).difference(self.known))
            if fresh:
                self.known.update(zip(fresh, self._each(fresh)))
            out += map(self.known.__getitem__, words)
        return b"".join(out)


def tokenizer(path: str) -> Words:
    """The tokenizer of a file, built once in each Python worker as long as its tasks use it."""
    return kept(("token files", path), lambda: Words(path))


def _encode(path: str, end: int):
    def run(batches):
        from pyspark import TaskContext

        own, at, start, tail = tokenizer(path), TaskContext.get().partitionId(), 0, np.uint32(end).tobytes()

        def flush(ids, lists):
            nonlocal start
            ns = np.array([len(x) // 4 for x in lists], np.int64)
            starts = start + np.r_[0, np.cumsum(ns)[:-1]].astype(np.int64)
            start += int(ns.sum())
            offsets = np.r_[0, np.cumsum(ns)].astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(np.full(len(ids), at, np.int32)), pa.array(starts), pa.array(ns), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(lists), np.int32)))],
                ["doc_id", "file", "local_start", "n_tokens", "ids"],
            )

        ids, lists, size = [], [], 0
        for b in sliced(batches):
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                lists.append(own.encode(t or "") + tail)
                size += len(lists[-1])
                if size > BYTES:
                    yield flush(ids, lists)
                    ids, lists, size = [], [], 0
        if ids:
            yield flush(ids, lists)

    return run


def write(docs: DataFrame, path: str, tokenizer_path: str, end: int = 1, encoding: str = "dictionary", files: int | None = None) -> None:
    """Writes the ids of docs (doc_id, text) to the folder path; tokenizer_path must exist on every executor."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"no such encoding: {encoding}")
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    by_size = size // FILE_BYTES if size < 1 << 56 else 0  # beyond that Spark does not know the size
    n = files or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), by_size)
    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    rows = dealt.mapInArrow(frugal(_encode(tokenizer_path, end)), SCHEMA)
    (
        rows.write.option("parquet.block.size", str(ROW_GROUP))
        .option("parquet.page.size", str(PAGE))
        .option("parquet.page.row.count.limit", "1000")
        .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("parquet.writer.version", "v1" if encoding == "dictionary" else "v2")
        .option("compression", "zstd")
        .mode("overwrite")
        .parquet(path)
    )


def read(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "start", "n_tokens", "ids")) -> DataFrame:
    """Documents of a folder with global starts; only the columns that are asked for are read."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    if "start" in columns:
        sizes = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))  # one row a file
        before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = rows.join(F.broadcast(sizes.select("file", before.alias("before"))), "file").withColumn("start", F.col("before") + F.col("local_start"))
    return rows.select(*columns)


def _crc(batches):
    for b in sliced(batches):
        ids = b.column(3)
        off = ids.offsets.to_numpy()
        flat, off = ids.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]].astype("<u4"), off - off[0]
        crcs = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(off[:-1], off[1:])]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of a folder, from its files."""
    return read(spark, path).mapInArrow(frugal(_crc), "doc_id long, start long, n_tokens long, ids_crc32 long")
