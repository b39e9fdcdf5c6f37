"""The three modes over ingested tables: list, table and figure.

Inputs are DataFrames of the schemas in gridquarry.sources.schemas, for any number of documents at once; results are
manifest rows with doc_id, and the grids to be written.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridquarry.functions import keywords as K
from gridquarry.functions import text as T
from gridquarry.operators import audit, dual_read, labels, manifest, pages, panel, regions, stitch
from gridquarry.sources.scratch import staged

ABSENT, DOUBTFUL = "label_referenced_but_absent: the body cites it", "caption words do not match header/first column; ownership doubtful"


@dataclass
class Result:
    """rows: manifest rows with doc_id; grids: doc_id, table_no, i, j, value, name; exit_codes: doc_id, code (4: no captions)."""

    rows: DataFrame
    grids: DataFrame
    exit_codes: DataFrame


def _stamp(run_at: str | None) -> str:
    return run_at or datetime.now().strftime("%Y-%m-%d %H:%M:%S")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _failure(rows: DataFrame, reason: Column, query: str, run_at: str, source_type: str = "", key: str | None = "key") -> DataFrame:
    tid = manifest.slug(F.col(key)) if key else F.col("table_id")
    raw = F.col("raw") if "raw" in rows.columns else F.lit(None).cast("string")
    text = F.col("text") if "text" in rows.columns else F.lit("")
    return manifest.failure_rows(
        rows.select("doc_id", tid.alias("table_id"), raw.alias("raw"), "page", text.alias("text"), F.lit(source_type).alias("source_type"), reason.alias("reason")), query, run_at
    )


def list_mode(lines: DataFrame, keywords=()) -> DataFrame:
    """The caption inventory of every document."""
    return labels.inventory(labels.scan_legends(lines), K.deduped(keywords))


def _absent(scanned: DataFrame, keywords: list[str], query: str, run_at: str) -> DataFrame:
    refs = labels.referenced_only(scanned)
    if not keywords:
        return _failure(refs, F.lit(f"{ABSENT} but it is not in this PDF; probably a separate supplementary file"), query, run_at)
    hits = K.cooccurring(F.col("text"), F.col("raw"), keywords)
    kept = refs.withColumn("hits", hits).where(F.size("hits") > 0)
    reason = F.concat(F.lit(f"{ABSENT} (same sentence as ["), F.array_join("hits", ";"), F.lit("]) but it is not in this PDF; probably a separate supplementary file"))
    return _failure(kept, reason, query, run_at)


def _exit_codes(docs: DataFrame, caps: DataFrame) -> DataFrame:
    has = caps.select("doc_id", F.lit(0).alias("code")).distinct()
    return docs.select("doc_id").distinct().join(has, "doc_id", "left").select("doc_id", F.coalesce("code", F.lit(4)).alias("code"))


def table_mode(
    lines: DataFrame,
    page_rows: DataFrame,
    tables: DataFrame,
    grid: DataFrame,
    spans: DataFrame,
    cells: DataFrame,
    words: DataFrame,
    caption_rects: DataFrame,
    keywords=(),
    run_at: str | None = None,
) -> Result:
    """Text tables: dispatch, captions, repairs, audit, stitching, keywords, and a row for what was not exported.

    tables: doc_id, table_no, page, rect, caption, plumber_cols; grid: doc_id, table_no, i, j, value; caption_rects:
    doc_id, page, key, rect of caption lines. Documents without a caption get no rows, and exit code 4.
    """
    keywords = K.deduped(keywords)
    query, run_at = K.describe_query("table", keywords), _stamp(run_at)
    scanned = staged(labels.scan_legends(lines), "labels")
    caps = labels.captions_of(scanned)
    codes = _exit_codes(page_rows, caps)
    live = codes.where("code = 0").select("doc_id")
    tables = tables.join(live, "doc_id", "left_semi")

    region = regions.region_chars(tables.withColumnRenamed("table_no", "cand_no"), spans)
    pixel = region.where("source_type = 'image'").select("doc_id", "page", F.format_string("p%02d_t%d", "page", "cand_no").alias("table_id"))
    text_tables = region.where("source_type = 'text'")

    order = Window.partitionBy("doc_id", "page").orderBy("block_no", "pos")
    caps = caps.withColumn("cap_no", F.row_number().over(order)).join(caption_rects.dropDuplicates(["doc_id", "page", "key"]), ["doc_id", "page", "key"], "left")
    pairs = regions.attached_twice(text_tables.select("doc_id", "page", "cand_no", "rect"), caps)
    named = text_tables.join(pairs, ["doc_id", "page", "cand_no"], "left").join(
        caps.select("doc_id", "page", "cap_no", "raw", "key", "kind", "text"), ["doc_id", "page", "cap_no"], "left"
    ).withColumnRenamed("cand_no", "table_no")
    named = staged(named, "named-tables")

    clean = grid.withColumn("value", T.strip_glyph_names(F.col("value"))).withColumn("cell_id", F.struct("table_no", "i", "j"))
    broken = clean.where(T.has_hyphen_break(F.col("value"))).select("doc_id").distinct()
    texts = lines.join(broken, "doc_id", "left_semi").select("doc_id", F.col("line_text").alias("text"))
    mended = audit.hyphens_rejoined(clean.select("doc_id", "cell_id", "value"), audit.word_counts(texts))
    fixed = staged(mended.select("doc_id", "cell_id.*", "value", "n_joined"), "grid")
    joins = fixed.groupBy("doc_id", "table_no").agg(F.sum("n_joined").alias("n_joined"))
    fixed = fixed.drop("n_joined")

    measures = audit.measures(fixed)
    empty = named.join(measures.select("doc_id", "table_no"), ["doc_id", "table_no"], "left_anti")
    full = named.join(measures, ["doc_id", "table_no"])
    merged = audit.merged_rows(cells, fixed, words).groupBy("doc_id", "table_no").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "note"))), lambda x: x["note"]).alias("merged")
    )
    head = lambda cond, by: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct(by, "value")))), lambda x: x["value"])
    edges = fixed.groupBy("doc_id", "table_no").agg(head(F.col("i") == 0, "j").alias("header"), head(F.col("j") == 0, "i").alias("side"))
    full = full.join(edges, ["doc_id", "table_no"]).join(merged, ["doc_id", "table_no"], "left").join(joins, ["doc_id", "table_no"], "left")
    full = full.withColumn("own_caption", F.coalesce("text", "caption")).withColumn("own_kind", F.coalesce("kind", F.lit("table")))
    judged = regions.ownership(
        full.select("doc_id", "table_no", F.col("own_kind").alias("kind"), F.col("own_caption").alias("caption"), regions.haystack(F.col("header"), F.col("side")).alias("hay")), caps
    ).select("doc_id", "table_no", F.coalesce(F.col("belongs") | (F.coalesce("caption", F.lit("")) == ""), F.lit(True)).alias("belongs"))
    ocr = pages.ocr_pages(page_rows).select("doc_id", "page", F.col("ocr_text_layer").alias("ocr_page"))
    full = full.join(judged, ["doc_id", "table_no"]).join(ocr, ["doc_id", "page"], "left").withColumn("ocr_page", F.coalesce("ocr_page", F.lit(False)))
    none = F.array().cast("array<string>")
    first = F.when(F.col("n_joined") > 0, F.array(F.concat(F.lit("hyphen_rejoined="), F.col("n_joined").cast("string")))).otherwise(none)
    doubt = F.when(F.col("belongs"), none).otherwise(F.array(F.lit(DOUBTFUL)))
    full = full.withColumn("notes", F.concat(first, F.coalesce("merged", none), doubt)).withColumn("grid_status", F.when(F.col("belongs"), "ok").otherwise("grid_mismatch"))
    graded = audit.audited(full, audit.suspect_minus(fixed))
    graded = graded.withColumn("notes", F.concat("notes", F.when(F.col("ocr_page"), F.array(F.lit("ocr_text_layer_page"))).otherwise(none)))
    graded = staged(graded, "graded-tables")

    chained = staged(stitch.chains(graded.select("doc_id", "table_no", "page", F.col("rect.y0").alias("y0"), "header", F.coalesce("text", F.lit("")).alias("caption"))), "chains")
    whole = staged(stitch.stitched(chained, fixed), "stitched")
    spans_of = stitch.span_notes(chained).groupBy("doc_id", "table_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "note"))), lambda x: x["note"]).alias("spans"))
    size = audit.measures(whole)
    heads = graded.drop("n_rows", "n_cols", "content_text", "cell_chars").join(chained.where("seq = 0").select("doc_id", "table_no"), ["doc_id", "table_no"], "left_semi")
    out = heads.join(size, ["doc_id", "table_no"]).join(spans_of, ["doc_id", "table_no"], "left").withColumn("notes", F.concat("notes", F.coalesce("spans", none)))
    m = K.match_hits(F.coalesce(F.col("text"), F.lit("")), F.col("content_text"), keywords)
    out = out.withColumn("m", m).select("*", "m.hits", "m.matched_on").drop("m")
    if keywords:
        out = out.where(F.size("hits") > 0)
    out = out.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "rect.y0", "table_no"))).withColumn("extractor", F.lit("docling"))
    out = staged(out, "exported-tables")

    parts = [
        _failure(pixel, F.lit(manifest.PIXELS), query, run_at, "image", key=None),
        _failure(empty.withColumn("table_id", manifest.table_id(F.col("key"), F.col("page"), F.lit(0))), F.lit(manifest.EMPTY), query, run_at, key=None),
        manifest.manifest_rows(out, query, run_at),
        _absent(scanned.join(live, "doc_id", "left_semi"), keywords, query, run_at),
    ]
    if keywords:
        missed = regions.unmatched_captions(caps, out.where("key IS NOT NULL")).withColumn("hits", K.keyword_hits(F.col("text"), keywords)).where(F.size("hits") > 0)
        reason = F.concat(
            F.lit("caption/legend matched ["), F.array_join("hits", ";"),
            F.lit("] but no text-layer table was extracted there - it may be a figure panel (try --mode figure) or a pure chart; check the page"),
        )
        parts.append(_failure(missed, reason, query, run_at))
    known = pages.preprints(page_rows, lines) if {"dir_x", "dir_y", "x1", "page_width"} <= set(lines.columns) else pages.documents(page_rows)
    preprints = known.where("is_preprint").join(live, "doc_id", "left_semi").select("doc_id", F.lit("preprint_check").alias("table_id"), F.lit(1).alias("page"))
    parts.append(_failure(preprints, F.lit(manifest.PREPRINT), query, run_at, key=None))
    names = out.select("doc_id", "table_no", manifest.csv_name(manifest.table_id(F.col("key"), F.col("page"), F.col("seq")), F.col("page")).alias("name"))
    return Result(_union(parts), whole.join(names, ["doc_id", "table_no"]), codes)


def figure_mode(lines: DataFrame, page_rows: DataFrame, boxes: DataFrame, reads: DataFrame, page_texts: DataFrame, keywords=(), run_at: str | None = None) -> Result:
    """Tables set as figure panels: gates, grid geometry, two reads of each cell, merge, flags.

    boxes: doc_id, page, box_no, x1, y1, x2, y2, score, swatch; reads: doc_id, page, box_no, conservative, enhanced
    (the texts read in each box); page_texts: doc_id, page, text of the whole image; page_rows has native_px, the
    native pixels of a cell (null without a raster)."""
    keywords = K.deduped(keywords)
    query, run_at = K.describe_query("figure", keywords), _stamp(run_at)
    scanned = staged(labels.scan_legends(lines), "labels")
    caps = labels.captions_of(scanned)
    codes = _exit_codes(page_rows, caps)
    figs = caps.where("kind = 'figure'")
    order = Window.partitionBy("doc_id", "page").orderBy("block_no", "pos")
    first = figs.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n", "is_caption", "kind")
    all_text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "pos", "text"))), lambda x: x["text"]), " ")
    per_page = figs.groupBy("doc_id", "page").agg(all_text.alias("legend"), F.count("*").alias("n_caps")).join(first, ["doc_id", "page"])
    counts = boxes.groupBy("doc_id", "page").agg(F.count("*").alias("n_cells"))
    gated = (
        per_page.join(counts, ["doc_id", "page"], "left")
        .join(page_rows.select("doc_id", "page", "native_px"), ["doc_id", "page"], "left")
        .join(page_texts.withColumnRenamed("text", "image_text"), ["doc_id", "page"], "left")
        .withColumn("n_cells", F.coalesce("n_cells", F.lit(0).cast("long")))
        .withColumn("caption_hits", K.keyword_hits(F.col("legend"), keywords))
        .withColumn("image_hits", F.when(F.size("caption_hits") > 0, F.array().cast("array<string>")).otherwise(K.keyword_hits(F.coalesce("image_text", F.lit("")), keywords)))
        .withColumn("searched", F.lit(bool(keywords)))
    )
    gated = staged(panel.page_gates(gated), "gated-pages")
    reason = (
        F.when(F.col("gate") == "chart", F.format_string(f"no table grid in the image (%d cells < {panel.MIN_CELLS}), judged a pure chart, skipped", "n_cells"))
        .when(
            F.col("gate") == "low_resolution",
            F.concat(
                F.lit("low_resolution_llm_only: ~"), F.replace(F.format_number("native_px", 1), F.lit(","), F.lit("")),
                F.lit(f" native px per cell (<{panel.MIN_NATIVE_PX}); the image itself is the information ceiling, read it with an LLM/vision pass"),
            ),
        )
        .otherwise(manifest.NO_MATCH)
    )
    ok = gated.where("gate = ''").withColumn("panel_id", F.struct("doc_id", "page"))
    wanted = boxes.join(ok.select("doc_id", "page"), ["doc_id", "page"], "left_semi").withColumn("panel_id", F.struct("doc_id", "page"))
    pages_ = F.concat_ws("/", F.col("panel_id.doc_id").cast("string"), F.col("panel_id.page").cast("string"))
    named = wanted.select("panel_id", pages_.alias("name"), "box_no", "x1", "y1", "x2", "y2", "score")
    kept = panel.suppress(named.drop("panel_id").withColumnRenamed("name", "panel_id")).join(named.select("panel_id", "name").distinct().withColumnRenamed("panel_id", "pair"), F.col("panel_id") == F.col("name"))
    split = staged(panel.split_panel(kept.select(F.col("pair").alias("panel_id"), "box_no", "x1", "y1", "x2", "y2", "score")), "panel-boxes")
    cut = split.groupBy("panel_id").agg(F.count_if("dropped").alias("cut"))
    kept = panel.drop_giants(split.where("NOT dropped").drop("dropped"))
    geo = staged(panel.geometry(kept), "panel-grids")
    placed = panel.snapped(kept, geo).join(wanted.select("panel_id", "box_no", "swatch"), ["panel_id", "box_no"]).join(
        reads.select(F.struct("doc_id", "page").alias("panel_id"), "box_no", "conservative", "enhanced"), ["panel_id", "box_no"], "left"
    )
    placed = staged(placed, "placed-boxes")
    coloured = placed.join(panel.swatch_columns(placed).withColumn("is_swatch", F.lit(True)), ["panel_id", "j"], "left")
    probe = F.first("swatch").over(Window.partitionBy("panel_id", "i", "j").orderBy(F.desc("box_no")))
    coloured = coloured.withColumn("probe", probe).withColumn("enhanced", F.when(F.col("is_swatch") & (F.coalesce("probe", F.lit("")) != ""), F.col("probe")).otherwise(F.col("enhanced")))
    grid_of = lambda col: panel.filled(coloured, col).withColumnRenamed("panel_id", "grid_id")
    cells = dual_read.joined(grid_of("conservative"), grid_of("enhanced"))
    merged = staged(dual_read.merge(cells), "merged-grids")
    sizes = merged.groupBy("grid_id").agg((F.max("i") + 1).alias("n_rows"))
    found = ok.join(sizes, ok["panel_id"] == sizes["grid_id"], "left").join(dual_read.conflicts(merged).withColumnRenamed("grid_id", "g2"), F.col("panel_id") == F.col("g2"), "left")
    found = found.join(geo.select("panel_id", F.size("rows").alias("det_rows"), F.size("cols").alias("det_cols")), "panel_id", "left").join(cut, "panel_id", "left")
    found = staged(found, "found-grids")
    out = found.where("n_rows IS NOT NULL").withColumn("n_cols", F.col("det_cols"))
    mismatch = panel.shape_mismatch(F.col("det_rows"), F.col("det_cols"), F.col("n_rows"), F.col("n_cols"))
    notes = F.filter(
        F.array(
            F.format_string("conflicts=%d(unresolved=%d)", "conflicts", "unresolved"),
            F.when(F.col("n_caps") > 1, F.format_string("page has %d figure captions; single grid attributed to %s, check manually", "n_caps", "raw")),
            F.when(F.col("cut") > 0, F.format_string("panel_split_dropped=%d boxes (side panel, e.g. a bar chart)", "cut")),
            mismatch,
        ),
        lambda n: n.isNotNull(),
    )
    hits = F.when(F.size("caption_hits") > 0, F.col("caption_hits")).otherwise(F.col("image_hits"))
    null = F.lit(None)
    out = out.select(
        "doc_id", "panel_id", "raw", "key", "page", F.lit(0).alias("seq"), "text", F.lit("dual_ocr").alias("extractor"), F.lit("image").alias("source_type"), "matched_on", hits.alias("hits"), "n_rows", "n_cols",
        null.cast("double").alias("coverage"), null.cast("int").alias("plumber_cols"), F.lit("low").alias("confidence"), F.when(mismatch.isNull(), "ok").otherwise("shape_disagree").alias("grid_status"), notes.alias("notes"),
    )
    blank = F.format_string("%d cells detected but the merged grid came out empty", "n_cells")
    live = codes.where("code = 0").select("doc_id")
    parts = [
        _failure(gated.where("gate <> ''"), reason, query, run_at, "image"),
        _failure(found.where("n_rows IS NULL"), blank, query, run_at, "image"),
        manifest.manifest_rows(out, query, run_at),
        _absent(scanned.join(live, "doc_id", "left_semi"), keywords, query, run_at),
    ]
    name = manifest.csv_name(manifest.slug(F.col("key")), F.col("page"))
    grids = merged.join(out.select(F.col("panel_id").alias("grid_id"), name.alias("name")), "grid_id").select("grid_id.doc_id", "grid_id.page", "i", "j", "value", "flag", "name")
    return Result(_union(parts), grids, codes)
