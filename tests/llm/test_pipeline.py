"""The corpus pipeline against brute force, stage by stage."""

from __future__ import annotations

import corpus_pipeline
import duckdb
from pyspark.sql import functions as F

from gridquarry.llm import decontam, quality
from llm_cases import DOCS, ODD, brute_groups, brute_spans, reference_encoding

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({quality.SQL}) WHERE kept").fetchall()}
    out = corpus_pipeline.quality_rules(spark, docs, SF)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == kept

    groups = brute_groups([(i, texts[i]) for i in kept], k=5)
    left = {i for i, (_, _, k) in groups.items() if k}
    out = corpus_pipeline.near_duplicates(spark, out, SF)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == left < kept

    items = [decontam.shingles_of(r["text"].encode(), 5) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i in left if not any(100 * len(s & decontam.shingles_of(texts[i].encode(), 5)) >= 80 * len(s) for s in items)}
    out = corpus_pipeline.decontamination(spark, out, SF)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == clean < left

    out = corpus_pipeline.secret_scan(spark, out, SF)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == docs.columns and set(rows) == clean
    for i, r in rows.items():
        assert r["n_chars"] == len(r["text"])
        assert not any(texts[i][a:b] in r["text"] for a, _, b in brute_spans(texts[i]))
        if not any(c.isdigit() for c in texts[i]) and not brute_spans(texts[i]):
            assert r["text"] == texts[i]

    enc = reference_encoding()
    for r in corpus_pipeline.encoding(spark, out, SF).collect():
        assert list(r["ids"]) == enc.encode_ordinary(rows[r["doc_id"]]["text"]) and r["n_tokens"] == len(r["ids"])


def test_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "decontamination", "secret scan", "byte-level BPE"]
    out = corpus_pipeline.run(spark, SF)
    assert out.count() and set(out.columns) == {"doc_id", "lang", "source", "n_tokens", "ids"}


def test_odd_rows(spark):
    odd = spark.createDataFrame(ODD + [(None, None, None, None, None), (11, "a b c d e " * 9, None, None, None)], DOCS)
    for extra in (odd, odd.withColumn("kept", F.lit("x")).withColumn("n_words", F.lit(1)).withColumn("ids", F.lit(1)), odd.limit(0)):
        docs, before = extra, None
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            n = out.count()
            assert before is None or n <= before
            docs, before = out, n
    for name, stage in corpus_pipeline.STAGES[1:]:  # odd rows themselves, at every stage
        assert stage(spark, odd, SF).count() > 0


def test_rows_of_one_id(spark):
    """Null and repeated doc_ids: just one row of a group stays, and no row is lost for another's sake."""
    a, u, v = (" ".join(f"{w}{i}" for i in range(40)) for w in "auv")
    rows = [(5, a), (None, a), (5, a), (3, a), (3, a), (7, a), (7, u), (None, v), (None, v), (9, ""), (9, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    out = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()), key=key)
    assert out == sorted([(3, a), (7, u), (None, v), (9, ""), (9, ""), (None, None)], key=key)

    leak = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    rows = [(None, leak), (4, f"{u} {leak} {v}"), (4, u), (4, u), (None, v), (8, leak), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    out = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.decontamination(spark, docs, SF).collect()), key=key)
    assert out == sorted([(4, u), (4, u), (None, v), (None, None)], key=key)
