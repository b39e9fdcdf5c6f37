"""Reliability of extracted tables. grid: doc_id, table_no, i, j, value (row 0 is the header)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridquarry.functions.text import strip
from gridquarry.operators.regions import inside

# ---- fixed values -------------------------------------------------------------------------------------------------
LOW_COVERAGE = 0.35
TALL, EVEN, COLUMN_CELLS, EVEN_CELLS, BAND_GAP, WRAPPED = 1.5, 0.30, 6, 4, 3.0, 2
MERGED_NOTE = "merged_row?="
# -------------------------------------------------------------------------------------------------------------------
TABLE = ("doc_id", "table_no")


def measures(grid: DataFrame) -> DataFrame:
    """doc_id, table_no, n_rows, n_cols, cell_chars, content_text."""
    cells = F.transform(F.array_sort(F.collect_list(F.when(F.col("value") != "", F.struct("i", "j", "value")))), lambda x: x["value"])
    return grid.groupBy(*TABLE).agg(
        (F.max("i") + 1).alias("n_rows"),
        (F.max("j") + 1).alias("n_cols"),
        F.sum(F.length(strip(F.col("value")))).alias("cell_chars"),
        F.array_join(cells, " ").alias("content_text"),
    )


def coverage(cell_chars: Column, region_chars: Column) -> Column:
    return F.when(region_chars > 0, cell_chars / region_chars)


def suspect_minus(grid: DataFrame) -> DataFrame:
    """doc_id, table_no, i, j, note: negative numbers in columns of '<' numbers, where '<' may have been read as '-'."""
    col = Window.partitionBy(*TABLE, "j")
    cells = grid.withColumn("rows", F.max("i").over(Window.partitionBy(*TABLE)) + 1).where("value <> ''")
    cells = cells.withColumn("n", F.count("*").over(col)).withColumn("lt", F.count_if(F.col("value").rlike(r"(?U)^\s*<")).over(col))
    odd = (F.col("rows") >= 3) & (F.col("n") >= 3) & (F.col("lt") >= F.greatest(F.lit(2), F.floor(F.col("n") / 3))) & F.col("value").rlike(r"(?U)^\s*-\s*\d")
    text = strip(F.col("value"))
    quoted = F.when(F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"')), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    )
    note = F.concat(F.format_string("suspect_lt_as_minus(R%dC%d=", F.col("i"), F.col("j")), quoted, F.lit(")"))
    return cells.where(odd).select(*TABLE, "i", "j", note.alias("note"))


def tall_rows(cells: DataFrame) -> DataFrame:
    """doc_id, table_no, r0, n_cols: rows with two or more cells far taller than an otherwise even column.

    cells: doc_id, table_no, r0, c0, row_span, column_header, bbox (null allowed). Evenness leaves the row itself out;
    that needs only the two largest and two smallest heights of a column and its median without the row."""
    rows = cells.withColumn("head", F.bool_or("column_header").over(Window.partitionBy(*TABLE, "r0")))
    own = rows.where("bbox IS NOT NULL AND row_span = 1 AND NOT head").withColumn("h", F.abs(F.col("bbox.y1") - F.col("bbox.y0"))).where("h > 0")
    col = Window.partitionBy(*TABLE, "c0")
    own = own.withColumn("n", F.count("*").over(col)).where(F.col("n") >= COLUMN_CELLS)
    own = own.withColumn("all", F.collect_list(F.struct("h", "r0")).over(col)).withColumn("med", F.median("h").over(col))
    others = F.array_sort(F.transform(F.filter("all", lambda x: x["r0"] != F.col("r0")), lambda x: x["h"]))
    tall = own.where((F.col("med") > 0) & (F.col("h") > TALL * F.col("med"))).withColumn("hs", others).where(F.size("hs") >= EVEN_CELLS)
    k = F.size("hs")
    mid = (F.element_at("hs", F.floor((k + 1) / 2).cast("int")) + F.element_at("hs", F.floor((k + 2) / 2).cast("int"))) / 2
    even = tall.withColumn("mid", mid).where((F.col("mid") > 0) & ((F.element_at("hs", -1) - F.col("hs")[0]) / F.col("mid") <= EVEN))
    return even.groupBy(*TABLE, "r0").agg(F.count("*").alias("n_cols")).where("n_cols >= 2")


def banded_cells(cells: DataFrame, words: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, table_no, r0, n: of the given rows, cells whose words stand in two bands of y or more. A range join
    of words (doc_id, page, word_no, x0, y0, x1, y1) with cells (with page) on one page."""
    own = cells.join(rows.select(*TABLE, "r0"), [*TABLE, "r0"], "left_semi").where("bbox IS NOT NULL").select(*TABLE, "page", "r0", "c0", "bbox")
    w = words.select("doc_id", "page", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    cell = Window.partitionBy(*TABLE, "r0", "c0").orderBy("cy")
    hit = own.join(w, ["doc_id", "page"]).where(inside(F.col("bbox"), F.col("cx"), F.col("cy"), 1.0))
    split = hit.withColumn("gap", F.col("cy") - F.lag("cy").over(cell)).groupBy(*TABLE, "r0", "c0").agg(F.max("gap").alias("gap"))
    return split.where(F.col("gap") > BAND_GAP).groupBy(*TABLE, "r0").agg(F.count("*").alias("n"))


def output_rows(cells: DataFrame, grid: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, table_no, r0, i: the grid row that shares most texts with a cell row, the first of equals."""
    bare = lambda c: F.lower(F.regexp_replace(c, r"(?U)\s+", ""))
    want = cells.join(rows.select(*TABLE, "r0"), [*TABLE, "r0"], "left_semi").select(*TABLE, "r0", bare(F.col("text")).alias("t")).where("t <> ''").distinct()
    have = grid.select(*TABLE, "i", bare(F.col("value")).alias("t")).where("t <> ''").distinct()
    n = want.join(have, [*TABLE, "t"]).groupBy(*TABLE, "r0", "i").agg(F.count("*").alias("n"))
    return n.groupBy(*TABLE, "r0").agg(F.max(F.struct("n", (-F.col("i")).alias("i"))).alias("best")).select(*TABLE, "r0", (-F.col("best.i")).alias("i"))


def merged_rows(cells: DataFrame, grid: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, table_no, i, note: output rows into which two rows were merged."""
    tall = tall_rows(cells)
    sure = banded_cells(cells, words, tall).where(F.col("n") > WRAPPED)
    at = output_rows(cells, grid, sure)
    texts = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("c0", strip(F.col("text")).alias("t")))), 1, 4), lambda x: F.left(x["t"], F.lit(24)))
    note = F.concat(F.lit(f"{MERGED_NOTE}row"), F.first("i").cast("string"), F.lit(": "), F.array_join(texts, " | "))
    return cells.join(at, [*TABLE, "r0"]).where(strip(F.col("text")) != "").groupBy(*TABLE, "r0").agg(F.first("i").alias("i"), note.alias("note")).select(*TABLE, "i", "note")


def confidence(source_type: Column, ocr_page: Column, grid_status: Column, cover: Column, plumber_cols: Column, n_cols: Column, notes: Column) -> Column:
    """low, medium or high: the first rule that applies."""
    return (
        F.when((source_type == "image") | F.coalesce(ocr_page, F.lit(False)), "low")
        .when(grid_status != "ok", "medium")
        .when(cover.isNull() | (cover < LOW_COVERAGE), "medium")
        .when(plumber_cols.isNull() | (F.abs(plumber_cols - n_cols) > 1), "medium")
        .when(F.exists(notes, lambda n: n.startswith(MERGED_NOTE)), "medium")
        .otherwise("high")
    )


def audited(tables: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """tables (doc_id, table_no, source_type, cell_chars, chars_in_rect, n_cols, plumber_cols, grid_status, ocr_page,
    notes array) with coverage, confidence and the audit's notes; hints: suspect_minus() rows."""
    cover = F.when(F.col("source_type") == "text", coverage(F.col("cell_chars"), F.col("chars_in_rect")))
    own = tables.withColumn("coverage", cover)
    if hints is None:
        own = own.withColumn("hints", F.array().cast("array<string>"))
    else:
        listed = F.transform(F.array_sort(F.collect_list(F.struct("j", "i", "note"))), lambda x: x["note"])
        own = own.join(hints.groupBy(*TABLE).agg(listed.alias("hints")), list(TABLE), "left")
    low = F.when(F.col("coverage") < LOW_COVERAGE, F.concat(F.lit("coverage_low="), F.bround(F.col("coverage") * 100, 0).cast("int").cast("string"), F.lit("%")))
    cols = F.when(
        (F.col("n_cols") > 0) & (F.abs(F.col("plumber_cols") - F.col("n_cols")) > 1),
        F.format_string("col_mismatch(docling=%d,plumber=%d)", F.col("n_cols"), F.col("plumber_cols")),
    )
    notes = F.concat("notes", F.filter(F.array(low, cols), lambda n: n.isNotNull()), F.coalesce("hints", F.array().cast("array<string>")))
    own = own.withColumn("notes", notes).drop("hints")
    grade = confidence(*(F.col(c) for c in ("source_type", "ocr_page", "grid_status", "coverage", "plumber_cols", "n_cols", "notes")))
    return own.withColumn("confidence", grade)


def hyphens_rejoined(cells: DataFrame, counts: DataFrame) -> DataFrame:
    """cells (doc_id, cell_id, value) with value mended and n_joined: a break 'cyclophos- phamide' is joined if the
    whole word occurs twice or more in the document; counts: doc_id, word, n.

    Only cells with a break look words up, and only words that a break would make; the result is rebuilt in order."""
    cut = r"(?U)(?<=[a-z])-\s+(?=[a-z])"
    parts = cells.where(F.col("value").rlike(cut)).select("doc_id", "cell_id", F.posexplode(F.split("value", cut)).alias("k", "part"), F.regexp_extract_all("value", F.lit(r"(?U)([a-z]-\s+)(?=[a-z])"), F.lit(1)).alias("seps"))
    order = Window.partitionBy("doc_id", "cell_id").orderBy("k")
    left = F.regexp_extract(F.lower("part"), r"([a-z]+)$", 1)
    right = F.regexp_extract(F.lower(F.lead("part").over(order)), r"^([a-z]+)", 1)
    words = parts.withColumn("word", F.concat(left, right))
    looked = words.join(counts.where("n >= 2").select("doc_id", "word", F.lit(True).alias("known")), ["doc_id", "word"], "left")
    last = F.lead("k").over(order).isNull()
    sep = F.when(last, "").when(F.col("known"), "").otherwise(F.substring(F.get("seps", F.col("k")), 2, 1 << 20))
    built = looked.withColumn("last", last).withColumn("piece", F.concat("part", sep)).groupBy("doc_id", "cell_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "piece"))), lambda x: x["piece"]), "").alias("mended"),
        F.count_if(F.col("known") & ~F.col("last")).alias("n_joined"),
    )
    out = cells.join(built, ["doc_id", "cell_id"], "left")
    return out.withColumn("value", F.coalesce("mended", "value")).withColumn("n_joined", F.coalesce("n_joined", F.lit(0).cast("long"))).drop("mended")


def word_counts(texts: DataFrame) -> DataFrame:
    """doc_id, word, n: runs of a-z of the lower-cased text."""
    words = texts.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return words.groupBy("doc_id", "word").agg(F.count("*").alias("n"))
