"""Token counts in delta-maintained rollups (operator 5).

A ledger folder holds one sub-folder a batch with signed rows: an insert adds a document's count, a delete takes its
current one back, a revision does both. Totals by source, language and tokenizer version are sums of signed rows, so
they are maintained by adding each batch's own sums. Commits are idempotent: a batch's rows are written under its name
by overwriting, and a marker file names it as committed; committing it again changes nothing, and a batch that failed half-way is invisible until it is
committed again. Only committed batches are read.

Changes are rows (doc_id, op, source, lang, tokenizer, n_tokens). op is 'upsert' (insert or revise) or 'delete'.
Within a batch the last change of a (doc_id, tokenizer) wins by `seq`, ties by the largest count. A delete of an unknown document changes nothing.
Null source or language are groups of their own; null counts are 0; rows without doc_id, op or tokenizer are ignored.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridquarry.llm.byte_bpe import loaded
from gridquarry.llm.common import frugal

LEDGER = "doc_id long, tokenizer string, source string, lang string, d_docs long, d_tokens long"
GROUP = ("source", "lang", "tokenizer")


class Rollup:
    """The rollup in a folder that the driver and the executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._root = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def batches(self) -> list[str]:
        """Committed batches in order of their names."""
        at = self._at("_commits")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _read(self, folder: str, schema: str, batches: list[str]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{folder}/{b}" for b in batches))

    def ledger(self) -> DataFrame:
        return self._read("ledger", LEDGER, self.batches())

    def current(self, batches: list[str] | None = None) -> DataFrame:
        """doc_id, tokenizer, source, lang, n_tokens of the documents that count now."""
        rows = self._read("ledger", LEDGER, self.batches() if batches is None else batches)
        sums = rows.groupBy("doc_id", "tokenizer", "source", "lang").agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("n_tokens"))
        return sums.where("d_docs > 0").drop("d_docs")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies a batch; False if it was committed before."""
        done = self.batches()
        if batch in done:
            return False
        last = Window.partitionBy("doc_id", "tokenizer").orderBy(F.desc("seq"), F.desc("n_tokens"), "source", "lang", "op")
        seq = F.col("seq") if "seq" in changes.columns else F.lit(0)
        new = (
            changes.where("doc_id IS NOT NULL AND tokenizer IS NOT NULL AND op IN ('upsert', 'delete')")
            .select("doc_id", "tokenizer", "source", "lang", "op", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), seq.alias("seq"))
            .withColumn("n", F.row_number().over(last))
            .where("n = 1")
        )
        signed = new.where("op = 'upsert'").select("doc_id", "tokenizer", "source", "lang", F.lit(1).cast("long").alias("d_docs"), F.col("n_tokens").alias("d_tokens"))
        if done:
            old = self.current(done).join(new.select("doc_id", "tokenizer"), ["doc_id", "tokenizer"], "left_semi")
            signed = signed.union(
                old.select("doc_id", "tokenizer", "source", "lang", F.lit(-1).cast("long"), (-F.col("n_tokens")))
            )
        signed.write.mode("overwrite").parquet(f"{self.path}/ledger/{batch}")
        own = self._read("ledger", LEDGER, [batch])
        sums = own.groupBy(*GROUP).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))
        sums.where("d_docs <> 0 OR d_tokens <> 0").write.mode("overwrite").parquet(f"{self.path}/sums/{batch}")
        out = self._fs.create(self._at(f"_commits/{batch}"), True)
        out.write(bytearray(json.dumps({"batch": batch, "after": done[-1:]}).encode()))
        out.close()
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens of all committed batches, groups without documents left out."""
        sums = self._read("sums", "source string, lang string, tokenizer string, d_docs long, d_tokens long", self.batches())
        return (
            sums.groupBy(*GROUP)
            .agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
            .where("n_docs <> 0 OR n_tokens <> 0")
        )


def _count(path: str, pattern: str):
    def run(batches):
        codec = loaded(path, pattern)
        for b in batches:
            ns = [len(codec.encode(t or "")) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ns, pa.int64())], [*b.schema.names[:-1], "n_tokens"])

    return run


def counted(docs: DataFrame, path: str, pattern: str, version: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, tokenizer: tokens of every whole text by the rank file at path; null texts have none."""
    return (
        docs.select(F.col("doc_id").cast("long"), "source", "lang", "text")
        .mapInArrow(frugal(_count(path, pattern)), "doc_id long, source string, lang string, n_tokens long")
        .withColumn("tokenizer", F.lit(version))
    )


def words_counted(docs: DataFrame, version: str = "words-1") -> DataFrame:
    """The same for a tokenizer of words (runs outside 0x20 and 0x09-0x0D), in DataFrame functions."""
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    return docs.select(F.col("doc_id").cast("long"), "source", "lang", n.alias("n_tokens"), F.lit(version).alias("tokenizer"))
