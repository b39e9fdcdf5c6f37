"""Classification of pages and documents.

pages: doc_id, page, vert_lines, horiz_lines, has_table_label, dominant_dy, n_chars, images array<struct<cover_w,cover_h,...>>, page_text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------------------------------
VERTICAL_LINES, VERTICAL_SHARE = 30, 0.5
FULL_COVER, SCANNED_SHARE, OCR_CHARS = 0.95, 0.8, 1000
DECORATIVE_COVER, PREPRINT_SHARE, WATERMARK_EDGE = 0.08, 0.4, 0.08
PREPRINT_MARKERS = ("bioRxiv", "medRxiv", "preprint", "peer review", "peer-review")
WATERMARK = r"(?i)(?:arXiv|bioRxiv|medRxiv|Research\s*Square|SSRN|ChemRxiv)\s*:?\s*\d{4}\.\d{4,5}"
# -------------------------------------------------------------------------------------------------------------------


def line_directions(lines: DataFrame) -> DataFrame:
    """doc_id, page, vert_lines, horiz_lines, dominant_dy, has_table_label of lines (doc_id, page, line_no, dir_x, dir_y, line_text)."""
    from gridquarry.functions.text import caption_label, collapse_ws, label_kind, normalize_label

    vertical = (F.col("dir_x") == 0) & (F.abs("dir_y") == 1)
    label = normalize_label(caption_label(collapse_ws(F.col("line_text"))))
    down, up = F.count_if(vertical & (F.col("dir_y") == 1)), F.count_if(vertical & (F.col("dir_y") == -1))
    first = F.min(F.when(vertical, F.struct("line_no", "dir_y")))["dir_y"]
    return lines.groupBy("doc_id", "page").agg(
        F.count_if(vertical).alias("vert_lines"),
        F.count_if((F.col("dir_x") == 1) & (F.col("dir_y") == 0)).alias("horiz_lines"),
        F.coalesce(F.when(down > up, 1).when(up > down, -1).otherwise(first), F.lit(-1)).alias("dominant_dy"),
        F.coalesce(F.bool_or(vertical & (label_kind(label) == "table")), F.lit(False)).alias("has_table_label"),
    )


def rotations(pages: DataFrame) -> DataFrame:
    """pages with needs_rotation: 270 or 90 degrees for a sideways table page, else 0.

    A page qualifies by its vertical lines, and by a table label or a rotated page before it; so in each island of
    consecutive qualifying pages all pages from the first label on are rotated."""
    total = F.col("vert_lines") + F.col("horiz_lines")
    strong = (F.col("vert_lines") >= VERTICAL_LINES) & ((total == 0) | (F.col("vert_lines") / total >= VERTICAL_SHARE))
    doc = Window.partitionBy("doc_id").orderBy("page")
    own = pages.withColumn("strong", strong).withColumn("island", F.count_if(~F.col("strong")).over(doc))
    labelled = F.bool_or(F.col("strong") & F.col("has_table_label")).over(Window.partitionBy("doc_id", "island").orderBy("page"))
    turn = F.when(F.col("dominant_dy") == 1, 270).otherwise(90)
    return own.withColumn("needs_rotation", F.when(F.col("strong") & labelled, turn).otherwise(0)).drop("strong", "island")


def has_full_page_image(images: Column) -> Column:
    return F.coalesce(F.exists(images, lambda im: (im["cover_w"] >= FULL_COVER) & (im["cover_h"] >= FULL_COVER)), F.lit(False))


def is_decorative(cover_h: Column) -> Column:
    return cover_h < DECORATIVE_COVER


def dominant_raster(images: Column) -> Column:
    """The image of largest area that is not decorative, or null; the first of equals. images has width, height."""
    held = F.filter(images, lambda im: ~is_decorative(im["cover_h"]))
    return F.aggregate(
        held,
        F.lit(None).cast("struct<width:double,height:double,cover_w:double,cover_h:double>"),
        lambda best, im: F.when(best.isNull() | (im["width"] * im["height"] > best["width"] * best["height"]), im).otherwise(best),
    )


def image_cover(width: Column, height: Column, page_w: Column, page_h: Column) -> Column:
    return F.struct(
        F.when(page_w > 0, width / page_w).otherwise(0.0).alias("cover_w"), F.when(page_h > 0, height / page_h).otherwise(0.0).alias("cover_h")
    )


def marker_counts(text: Column) -> Column:
    """Map of preprint marker to its count, case ignored."""
    return F.create_map(*[x for m in PREPRINT_MARKERS for x in (F.lit(m), F.regexp_count(text, F.lit(f"(?i){m}")))])


def watermark(lines: DataFrame) -> DataFrame:
    """doc_id, watermark: the first vertical line of page 1 at the left edge that names a preprint server and number."""
    found = lines.where((F.col("page") == 1) & (F.col("dir_x") == 0) & (F.abs("dir_y") == 1) & (F.col("x1") <= WATERMARK_EDGE * F.col("page_width")))
    return found.where(F.col("line_text").rlike(WATERMARK)).groupBy("doc_id").agg(F.min_by("line_text", "line_no").alias("watermark"))


def preprints(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, preprint_pages, watermark (null if none), is_preprint of each document: markers on enough pages, or a watermark on page 1."""
    marked = documents(pages).select("doc_id", "preprint_pages", "is_preprint")
    return marked.join(watermark(lines), "doc_id", "left").select("doc_id", "preprint_pages", "watermark", (F.col("is_preprint") | F.col("watermark").isNotNull()).alias("is_preprint"))


def documents(pages: DataFrame) -> DataFrame:
    """doc_id, n_pages, total_chars, n_full, preprint_pages, is_scanned, is_preprint (without a watermark; see preprints())."""
    marked = F.exists(F.map_values(marker_counts(F.col("page_text"))), lambda n: n > 0)
    n, full = F.count("*"), F.count_if(has_full_page_image(F.col("images")))
    chars, hits = F.sum("n_chars"), F.count_if(marked)
    return pages.groupBy("doc_id").agg(
        n.alias("n_pages"),
        chars.alias("total_chars"),
        full.alias("n_full"),
        hits.alias("preprint_pages"),
        ((full / n >= SCANNED_SHARE) & (chars / n >= OCR_CHARS)).alias("is_scanned"),
        (hits / n >= PREPRINT_SHARE).alias("is_preprint"),
    )


def ocr_pages(pages: DataFrame) -> DataFrame:
    """pages with ocr_text_layer: the document is scanned and this page is covered by a bitmap."""
    scanned = documents(pages).select("doc_id", "is_scanned")
    return pages.join(scanned, "doc_id").withColumn("ocr_text_layer", F.col("is_scanned") & has_full_page_image(F.col("images"))).drop("is_scanned")
