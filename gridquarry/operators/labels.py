"""Captions and references of tables and figures, as DataFrame operators over text lines.

lines: doc_id, page, block_no, line_no, line_text. Every group here is one block of one page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridquarry.functions import text as T

#: Characters of a caption that are kept.
LEGEND_CHARS = 3000
BLOCK = ("doc_id", "page", "block_no")
COLUMNS = ("doc_id", "page", "block_no", "pos", "raw", "key", "kind", "is_caption", "text")


def _joined(rows: Column) -> Column:
    """One text of struct(line_no, text) in order of line_no."""
    return T.collapse_ws(F.array_join(F.transform(F.array_sort(rows), lambda x: x["flat"]), " "))


def caption_lines(lines: DataFrame, core: str = T.LABEL) -> DataFrame:
    """lines with flat text, raw (the label of a caption line, else null) and segment (captions so far in the block)."""
    order = Window.partitionBy(*BLOCK).orderBy("line_no")
    flat = lines.withColumn("flat", T.collapse_ws(F.col("line_text")))
    label = T.caption_label(F.col("flat"), core)
    own = flat.withColumn("raw", F.when(T.ends_sentence(F.lag("flat").over(order)), label))
    return own.withColumn("segment", F.count("raw").over(order))


def scan_labels(lines: DataFrame, core: str = T.LABEL) -> DataFrame:
    """All labels (COLUMNS): captions with their legend up to the block's next caption, then the block's references
    whose key is no caption of this block nor of an earlier one on the page; a reference carries its block's text."""
    marked = caption_lines(lines, core)
    captions = (
        marked.where("segment > 0")
        .groupBy(*BLOCK, "segment")
        .agg(F.min(F.struct("line_no", "raw"))["raw"].alias("raw"), _joined(F.collect_list(F.struct("line_no", "flat"))).alias("text"))
        .select(*BLOCK, F.col("segment").cast("int").alias("pos"), T.collapse_ws(F.col("raw")).alias("raw"), F.left("text", F.lit(LEGEND_CHARS)).alias("text"))
        .withColumn("key", T.normalize_label(F.col("raw")))
    )
    blocks = marked.groupBy(*BLOCK).agg(_joined(F.collect_list(F.struct("line_no", "flat"))).alias("text"))
    refs = blocks.select(*BLOCK, "text", F.posexplode(T.loose_labels(F.col("text"), core)).alias("pos", "raw")).withColumn(
        "key", T.normalize_label(F.col("raw"))
    )
    first = captions.groupBy("doc_id", "page", "key").agg(F.min("block_no").alias("cap_block"))
    refs = refs.join(first, ["doc_id", "page", "key"], "left").where("cap_block IS NULL OR cap_block > block_no").drop("cap_block")
    both = captions.withColumn("is_caption", F.lit(True)).unionByName(refs.withColumn("raw", T.collapse_ws(F.col("raw"))).withColumn("is_caption", F.lit(False)))
    return both.withColumn("kind", T.label_kind(F.col("key"))).select(*COLUMNS)


def captions_of(labels: DataFrame) -> DataFrame:
    return labels.where("is_caption")


def referenced_only(labels: DataFrame) -> DataFrame:
    """References whose key has no caption in the document, the first of each key in reading order."""
    keys = labels.where("is_caption").select("doc_id", "key").distinct()
    order = Window.partitionBy("doc_id", "key").orderBy("page", "block_no", "pos")
    return labels.where("NOT is_caption").join(keys, ["doc_id", "key"], "left_anti").withColumn("n", F.row_number().over(order)).where("n = 1").drop("n").select(*COLUMNS)


def scan_legends(lines: DataFrame, core: str = T.LABEL) -> DataFrame:
    """scan_labels() with the legends that go on in later blocks, for lines with the rectangle of their block (bx0, by0, bx1, by1); others are scanned as they are.

    The last caption of a block takes them, as its text reaches the block's end."""
    if not {"bx0", "by0", "bx1", "by1"} <= set(lines.columns):
        return scan_labels(lines, core)
    marked = caption_lines(lines, core)
    rect = [F.first(f"b{c}").alias(c) for c in ("x0", "y0", "x1", "y1")]
    blocks = marked.groupBy(*BLOCK).agg(
        *rect, _joined(F.collect_list(F.struct("line_no", "flat"))).alias("text"), F.max(F.length("flat")).alias("longest"), F.coalesce(F.bool_or(F.col("raw").isNotNull()), F.lit(False)).alias("has_caption")
    )
    found = scan_labels(lines, core)
    last = found.where("is_caption").groupBy(*BLOCK).agg(F.max("pos").alias("end"))
    captions = found.where("is_caption").join(last, list(BLOCK)).join(blocks.select(*BLOCK, "x0", "y0", "x1", "y1"), list(BLOCK)).withColumn("at_end", F.col("pos") == F.col("end"))
    return absorb_legends(captions, blocks).select(*COLUMNS).unionByName(found.where("NOT is_caption").select(*COLUMNS))


def absorb_legends(captions: DataFrame, blocks: DataFrame) -> DataFrame:
    """captions (doc_id, page, block_no, text, x0, y0, x1, y1 of their block, at_end) with the legend that follows in
    later blocks (doc_id, page, block_no, x0, y0, x1, y1, text, longest, has_caption).

    Blocks are walked in order of (y0, x0) from the caption's block on: those above the legend's bottom or beside it
    are skipped; the first that holds a caption or is no prose close by ends the legend. The fold is per caption over
    the blocks of one page."""
    walk = blocks.groupBy("doc_id", "page").agg(
        F.array_sort(F.collect_list(F.struct("y0", "x0", "x1", "y1", "block_no", "text", "longest", "has_caption"))).alias("walk")
    )
    start = F.struct(F.col("y1").alias("bottom"), F.lit(False).alias("over"), F.col("text").alias("text"))

    def step(s: Column, b: Column) -> Column:
        apart = (b["y0"] < s["bottom"] - 1) | (F.least(F.col("x1"), b["x1"]) - F.greatest(F.col("x0"), b["x0"]) <= 0)
        ends = b["has_caption"] | ~T.is_legend_continuation(b["y0"] - s["bottom"], b["longest"])
        grown = F.struct(b["y1"].alias("bottom"), F.lit(False).alias("over"), T.collapse_ws(F.concat_ws(" ", s["text"], b["text"])).alias("text"))
        over = F.struct(s["bottom"].alias("bottom"), F.lit(True).alias("over"), s["text"].alias("text"))
        return F.when(s["over"] | apart, s).when(ends, over).otherwise(grown)

    later = F.filter("walk", lambda b: (b["y0"] > F.col("y0")) | ((b["y0"] == F.col("y0")) & (b["x0"] > F.col("x0"))))
    legend = F.when(F.col("at_end") & F.col("walk").isNotNull(), F.aggregate(later, start, step)["text"]).otherwise(F.col("text"))
    return captions.join(walk, ["doc_id", "page"], "left").withColumn("text", F.left(legend, F.lit(LEGEND_CHARS))).drop("walk")


def inventory(labels: DataFrame, keywords=()) -> DataFrame:
    """Rows of the list mode: captions, then labels that are cited but absent."""
    from gridquarry.functions.keywords import keyword_hits

    hits = F.array_join(keyword_hits(F.col("text"), list(keywords)), ";")
    caps = captions_of(labels).select(
        "doc_id", F.col("raw").alias("label"), "kind", "page", F.lit("yes").alias("present_in_pdf"), F.length("text").alias("n_chars"), hits.alias("matched_keywords"), F.col("text").alias("caption_legend")
    )
    refs = referenced_only(labels).select(
        "doc_id", F.col("raw").alias("label"), "kind", "page", F.lit("no").alias("present_in_pdf"), F.lit(0).alias("n_chars"), hits.alias("matched_keywords"), F.lit("").alias("caption_legend")
    )
    return caps.union(refs)
