"""Manifest rows, file names and writers."""

from __future__ import annotations

import csv
import io
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridquarry.sources.schemas import MANIFEST, MANIFEST_COLUMNS

# ---- fixed values: reasons of rows without a table -----------------------------------------------------------------
PIXELS = "pixel table region (no text layer inside): use --mode figure for this one"
EMPTY = "docling located the table but its row export came back empty; check the page"
PREPRINT = "document looks like a preprint; tables may differ from the published version"
NO_MATCH = "grid present but neither caption nor in-image text matched the keywords, skipped"
# -------------------------------------------------------------------------------------------------------------------


def slug(key: Column) -> Column:
    """A label's key as a file name part."""
    return F.regexp_replace(F.regexp_replace(key, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def table_id(key: Column, page: Column, seq: Column) -> Column:
    return F.when(key.isNotNull(), slug(key)).otherwise(F.format_string("p%02d_t%d", page, seq))


def csv_name(table_id: Column, page: Column) -> Column:
    return F.format_string("p%02d_%s.csv", page, table_id)


def sanitized(name: Column) -> Column:
    """A name that is fit for a directory."""
    s = F.regexp_replace(F.regexp_replace(name, r"(?U)^\s+|\s+$", ""), r"(?U)[^\w.\-]+", "_")
    s = F.regexp_replace(F.regexp_replace(s, "_{2,}", "_"), r"^[._\-]+|[._\-]+$", "")
    return F.when(s == "", "output").otherwise(s)


def outdir(root: str | None, prefix: str | None, stem: str) -> str:
    """The folder of one document."""
    s = re.sub(r"_{2,}", "_", re.sub(r"[^\w.\-]+", "_", (prefix or stem).strip())).strip("._-")
    return f"{(root or '.').rstrip('/')}/{s or 'output'}"


def two_digits(x: Column) -> Column:
    """A number with two decimals, as the nearest binary fraction rounds; '' for null."""
    return F.when(x.isNull(), "").otherwise(F.replace(F.format_number(x, 2), F.lit(","), F.lit("")))


def manifest_rows(tables: DataFrame, query: str, run_at: str) -> DataFrame:
    """Manifest rows of exported tables (raw, key, page, seq, text, extractor, source_type, matched_on, hits array,
    n_rows, n_cols, coverage, plumber_cols, confidence, grid_status, notes array)."""
    own = tables.withColumn("table_id", table_id(F.col("key"), F.col("page"), F.col("seq")))
    out = {
        "query": F.lit(query),
        "run_at": F.lit(run_at),
        "label": F.coalesce("raw", F.lit("")),
        "caption": F.left(F.coalesce("text", F.lit("")), F.lit(200)),
        "csv_path": csv_name(F.col("table_id"), F.col("page")),
        "matched_keywords": F.array_join("hits", ";"),
        "coverage": two_digits(F.col("coverage")),
        "plumber_cols": F.coalesce(F.col("plumber_cols").cast("string"), F.lit("")),
        "notes": F.array_join("notes", "; "),
    }
    extra = [c for c in ("doc_id",) if c in tables.columns]
    return own.select(*extra, *(out.get(c, F.col(c)).cast(MANIFEST[c].dataType).alias(c) for c in MANIFEST_COLUMNS))


def failure_rows(rows: DataFrame, query: str, run_at: str) -> DataFrame:
    """Manifest rows without a table: rows (table_id, raw, page, text, source_type, reason)."""
    out = {
        "query": F.lit(query),
        "run_at": F.lit(run_at),
        "table_id": F.col("table_id"),
        "label": F.coalesce("raw", F.lit("")),
        "page": F.col("page"),
        "caption": F.left(F.coalesce("text", F.lit("")), F.lit(200)),
        "source_type": F.coalesce("source_type", F.lit("")),
        "notes": F.col("reason"),
        "n_rows": F.lit(0),
        "n_cols": F.lit(0),
    }
    extra = [c for c in ("doc_id",) if c in rows.columns]
    return rows.select(*extra, *(out.get(c, F.lit("")).cast(MANIFEST[c].dataType).alias(c) for c in MANIFEST_COLUMNS))


def upserted(old: DataFrame, new: DataFrame, query: str) -> DataFrame:
    """old rows of other queries, then the new ones; columns that old lacks are ''."""
    kept = old.where(F.coalesce(F.col("query"), F.lit("")) != query)
    missing = [c for c in new.columns if c not in kept.columns]
    return kept.withColumns({c: F.lit("").cast(new.schema[c].dataType) for c in missing}).select(*new.columns).unionByName(new)


def write_manifest(new: DataFrame, path: str) -> None:
    """Replaces the rows of the queries in new and leaves others: one folder a query, written dynamically."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("query").parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(path).select(*MANIFEST_COLUMNS)


def summary(rows: DataFrame, keys: tuple[str, ...] = ("query",)) -> DataFrame:
    """Exported and failed rows, unnamed charts and low confidences."""
    ok = F.col("csv_path") != ""
    chart = ~ok & F.contains("notes", F.lit("no table grid")) & (F.col("label") == "")
    return rows.groupBy(*keys).agg(
        F.count_if(ok).alias("exported"),
        F.count_if(~ok).alias("not_exported"),
        F.count_if(chart).alias("unnamed_charts"),
        F.array_sort(F.collect_set(F.when(chart, F.col("page")))).alias("chart_pages"),
        F.count_if(ok & (F.col("confidence") == "low")).alias("low_confidence"),
    )


def zero_hit_hint(captions: DataFrame) -> DataFrame:
    """What a document has, where no keyword matched: captions, tables first, by page."""
    bare = F.trim("text") == F.col("raw")
    head = F.when(bare, F.concat("raw", F.lit(" (caption has no description)"))).otherwise(F.left("text", F.lit(74)))
    return captions.select("doc_id", "raw", "kind", "page", head.alias("head")).orderBy("doc_id", F.col("kind") != "table", "page")


def csv_text(rows: list[list[str]]) -> str:
    """Rows as CSV: CRLF, doubled quotes, nothing for an empty cell."""
    out = io.StringIO(newline="")
    csv.writer(out).writerows(rows)
    return out.getvalue()


def csv_files(grid: DataFrame, value: str = "value") -> DataFrame:
    """doc_id, table_no, content: the CSV of each table in one string; ragged rows keep their own width."""
    quoted = F.when(F.col(value).rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(F.col(value), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(value, F.lit("")))
    rows = grid.groupBy("doc_id", "table_no", "i").agg(F.array_sort(F.collect_list(F.struct("j", quoted.alias("q")))).alias("cells"))
    line = F.array_join(F.transform("cells", lambda c: c["q"]), ",")
    line = F.when((F.size("cells") == 1) & (line == ""), '""').otherwise(line)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("line")))), lambda x: F.concat(x["line"], F.lit("\r\n")))
    return rows.groupBy("doc_id", "table_no").agg(F.array_join(lines, "").alias("content"))


def write_csv(files: DataFrame, root: str) -> None:
    """Writes files (path, content) under root, one file each, from the executors; root is a folder they all share."""

    def put(rows):
        import os

        for r in rows:
            at = os.path.join(root, r["path"])
            os.makedirs(os.path.dirname(at), exist_ok=True)
            with open(at + ".tmp", "w", newline="", encoding="utf-8") as f:
                f.write(r["content"])
            os.replace(at + ".tmp", at)  # a task that runs again leaves the same file

    files.select("path", "content").foreachPartition(put)
