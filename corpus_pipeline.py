"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, secret scans, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and gives the next one's documents, with the columns of documents; the last
gives token ids. Every stage works on all rows that its predecessor kept. Empty tables pass through all stages.
Within a stage rows are told apart by a number, so null and repeated doc_ids neither save nor lose a row.
Lists of rows that go are written first, so that Spark knows their size: short ones are broadcast and the texts stay
where they are, long ones are joined by a shuffle.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridquarry.llm import byte_bpe, decontam, near_dedup, quality, secrets
from gridquarry.llm.common import dropped, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: A number of each row within a stage, as doc_id may be null or repeated.
ROW = "__row"


def _keyed(docs: DataFrame, name: str) -> DataFrame:
    """The columns of docs with a number for each row, written so that every reading sees the same numbers."""
    return written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias(ROW)), name)


def _using(out: DataFrame, *tables: DataFrame) -> DataFrame:
    """out, which names the written tables that it reads, so that run() can delete them once out is written."""
    out.uses = tables
    return out


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or their host's verdict rejects go."""
    return quality.judged(docs).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) one row stays: that of the least doc_id, null ids last."""
    rows = _keyed(docs, "pipeline-rows")
    groups = near_dedup.groups(rows.select(F.col(ROW).alias("doc_id"), "text"), k=5, percent=80)
    # row numbers stand for rows in the groups; which one stays is decided by doc_id, as a number's order says nothing
    members = groups.select(F.col("doc_id").alias(ROW), F.col("component_id").alias("group"), "kept")
    shared = members.where("NOT kept").select("group").distinct()
    near = members.join(shared, "group").join(rows.select(ROW, "doc_id"), ROW)
    stays = near.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW))[ROW].alias("stays"))
    gone = written(near.join(stays, "group").where(f"{ROW} <> stays").select(ROW), "pipeline-copies")
    dropped(groups)
    return _using(rows.join(gone, ROW, "left_anti").select(*COLUMNS), rows, gone)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text contains an item of the benchmark go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = _keyed(docs, "pipeline-rows")
    leaks = written(decontam.contained(rows.select(F.col(ROW).alias("doc_id"), "text"), items, k=5, percent=80).select(F.col("doc_id").alias(ROW)).distinct(), "pipeline-leaks")
    return _using(rows.join(leaks, ROW, "left_anti").select(*COLUMNS), rows, leaks)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; n_chars follows."""
    out = secrets.redacted(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the whole texts."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = byte_bpe.encoded(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN)
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scan", secret_scan),
    ("byte-level BPE", encoding),
]

#: Conditional random fields and BPE are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each one's rows written as Parquet and read by the next; what a stage has read and written besides is deleted when it is done."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done: tuple[DataFrame, ...] = ()
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        docs = written(out, f"pipeline-{name.replace(' ', '-')}")
        for table in (*done, *getattr(out, "uses", ())):
            dropped(table)
        done = (docs,)
    return STAGES[-1][1](spark, docs, sf_dir)
