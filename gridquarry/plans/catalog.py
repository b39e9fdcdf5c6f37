"""One query for each operator or group of operators, over the fixture relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridquarry.functions import keywords as K
from gridquarry.functions import text as T
from gridquarry.operators import audit, dual_read, labels, manifest, pages, panel, regions, stitch
from gridquarry.sources.fixtures import fixture, table
from gridquarry.sources.scratch import staged

#: Rows for text functions that no table exercises.
SAMPLES = """VALUES (1, 'Supplementary Table S3'), (2, 'TABLE  I.'), (3, 'Tab. II'), (4, 'Supplementary Data Figure 2:'), (5, 'Figs. 4'), (6, 'Extended Data Table 1'),
(7, '/emspaceMean (SD)'), (8, '/no-breakspace  12 %'), (9, 'cyclophos- phamide'), (10, 'p-value  of  PD-L1'), (11, ' 12.5 (3-4) mg/kg '), (12, '−0.5 A'),
(13, 'Table 2 ( Continued )'), (14, 'Summary of the Results for Xenograft PDX-12 and in vivo data'), (15, ''), (16, 'Fig 3 shows. The end'), (17, 'tables and figures'), (18, 'TABS. 1') AS t(id, s)"""
TEXTS = """VALUES (1, 'Smith et al. Then Fig. 1 shows the response. A dose of 3.5 mg (Table 1) caused relapse. Remission, cf. Table 10 was seen. (EFS rose).', 'Table 1'),
(2, 'PR-104 and PR. Remission in vivo followed Table 2. The xenografts of Table 2 relapsed', 'Table 2'), (3, '', 'Table 3'), (4, 'No. 5 vs. Table 4 remissions', 'Table 4') AS t(id, s, label)"""
WORDS = [*K.RESPONSE, *K.XENOGRAFT, "PR"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "fx_lines").withColumn("block_no", F.lit(0))


def list_mode_inventory(spark, sf_dir):
    """The list mode: captions, absent labels and keyword hits of every document."""
    return labels.inventory(staged(labels.scan_labels(_lines(spark, sf_dir)), "labels"), WORDS)


def scan_labels(spark, sf_dir):
    return labels.scan_labels(_lines(spark, sf_dir)).select("doc_id", "page", "raw", "key", "kind", "is_caption", "text")


def referenced_only(spark, sf_dir):
    return labels.referenced_only(labels.scan_labels(_lines(spark, sf_dir))).select("doc_id", "page", "raw", "key", "kind")


def keyword_hits(spark, sf_dir):
    hits = K.keyword_hits(F.col("line_text"), WORDS)
    return fixture(spark, sf_dir, "fx_lines").select("doc_id", "page", "line_no", F.array_join(hits, ";").alias("hits"))


def match_table(spark, sf_dir):
    rows = fixture(spark, sf_dir, "fx_lines").join(fixture(spark, sf_dir, "fx_grid").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("value")), " ").alias("content")), "doc_id")
    m = K.match_hits(F.col("line_text"), F.col("content"), WORDS)
    return rows.select("doc_id", "page", "line_no", F.array_join(m["hits"], ";").alias("hits"), m["matched_on"].alias("matched_on"))


def split_sentences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("pos", "sentence"))


def cooccurrence(spark, sf_dir):
    """The literal cases and every line, with a label given by its page."""
    lines = fixture(spark, sf_dir, "fx_lines").select(F.col("doc_id").alias("id"), F.col("line_text").alias("s"), F.concat(F.lit("Table "), (1 + F.col("page") % 4).cast("string")).alias("label"))
    t = spark.sql(f"SELECT * FROM {TEXTS}").unionByName(lines)
    return t.select("id", F.size(T.split_sentences(F.col("s"))).alias("n_sentences"), F.array_join(K.cooccurring(F.col("s"), F.col("label"), WORDS), ";").alias("hits"))


def _samples(spark, sf_dir):
    """The literal cases and the text of every line."""
    return spark.sql(f"SELECT * FROM {SAMPLES}").unionByName(fixture(spark, sf_dir, "fx_lines").select(F.col("doc_id").alias("id"), F.col("line_text").alias("s")))


def label_keys(spark, sf_dir):
    t = _samples(spark, sf_dir)
    key = T.normalize_label(F.col("s"))
    return t.select("id", key.alias("key"), T.label_kind(key).alias("kind"), T.is_supplementary(key).alias("supplementary"), F.coalesce(T.caption_label(F.col("s")), F.lit("")).alias("caption_label"))


def text_norms(spark, sf_dir):
    t = spark.sql(f"SELECT * FROM {SAMPLES}").unionByName(fixture(spark, sf_dir, "fx_grid").select(F.lit(0).alias("id"), F.col("value").alias("s")))
    s = F.col("s")
    return t.select(
        "id", "s", T.collapse_ws(s).alias("collapsed"), T.strip_glyph_names(s).alias("glyphs"), T.cell_norm(s).alias("norm"), T.format_signature(s).alias("signature"),
        T.has_hyphen_break(s).alias("broken"), T.says_continued(s).alias("continued"), F.array_join(F.array_sort(T.caption_words(s)), " ").alias("words"),
    )


def word_counts(spark, sf_dir):
    return audit.word_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def hyphen_rejoin(spark, sf_dir):
    """Cells with breaks, joined where the whole word stands twice in the document; half of the documents know it."""
    grid = fixture(spark, sf_dir, "fx_grid").where("value <> ''")
    cells = grid.withColumn("cell_id", F.concat_ws("-", "table_no", "i", "j")).select("doc_id", "cell_id", "value")
    texts = grid.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "cyclophosphamide Cyclophosphamide").otherwise("relapse cyclophosphamide relapse").alias("text")).distinct()
    return audit.hyphens_rejoined(cells, audit.word_counts(texts))


def page_rotation(spark, sf_dir):
    return pages.rotations(fixture(spark, sf_dir, "fx_pages")).select("doc_id", "page", "needs_rotation")


def _imaged(spark, sf_dir):
    p = fixture(spark, sf_dir, "fx_pages")
    im = F.struct(F.lit(500.0).alias("width"), (F.col("cover_h") * 800).alias("height"), "cover_w", "cover_h")
    return p.withColumn("images", F.array(im, F.struct(F.lit(40.0).alias("width"), F.lit(30.0).alias("height"), F.lit(0.1).alias("cover_w"), F.lit(0.04).alias("cover_h"))))


def document_features(spark, sf_dir):
    return pages.documents(_imaged(spark, sf_dir))


def ocr_pages(spark, sf_dir):
    p = pages.ocr_pages(_imaged(spark, sf_dir))
    best = pages.dominant_raster(F.col("images"))
    return p.select("doc_id", "page", "ocr_text_layer", best["height"].alias("raster_height"), pages.marker_counts(F.col("page_text"))["preprint"].alias("n_preprint"))


def preprint_documents(spark, sf_dir):
    """Documents that their pages or a line at the left edge of page 1 name a preprint."""
    lines = fixture(spark, sf_dir, "fx_lines").select(
        F.col("doc_id") % 1500 + 1, "page", "line_no", F.lit(0).alias("dir_x"), F.when(F.col("line_no") % 2 == 1, 1).otherwise(0).alias("dir_y"),
        (F.length("line_text") + F.lit(0.0)).alias("x1"), F.lit(600.0).alias("page_width"), F.when(F.col("line_text").like("Table 1%"), F.concat(F.lit("arXiv: 2101.0"), (1000 + F.col("page")).cast("string"))).otherwise(F.col("line_text")).alias("line_text"),
    ).toDF("doc_id", "page", "line_no", "dir_x", "dir_y", "x1", "page_width", "line_text")
    return pages.preprints(_imaged(spark, sf_dir), lines).select("doc_id", "preprint_pages", F.coalesce("watermark", F.lit("")).alias("watermark"), "is_preprint")


def page_gates(spark, sf_dir):
    """Why the figure panel of a page is skipped, and what its keywords matched; pages as panels."""
    p = fixture(spark, sf_dir, "fx_pages")
    panels = p.select(
        "doc_id", "page", F.col("vert_lines").alias("n_cells"), F.when(F.col("horiz_lines") > 9, F.col("horiz_lines") / 2.0).alias("native_px"),
        K.keyword_hits(F.col("page_text"), ["journal"]).alias("caption_hits"), K.keyword_hits(F.col("page_text"), ["preprint"]).alias("image_hits"), (F.col("page") % 2 == 0).alias("searched"),
    )
    return panel.page_gates(panels.withColumn("image_hits", F.when(F.col("n_cells") % 2 == 0, F.col("image_hits")).otherwise(F.array().cast("array<string>")))).select("doc_id", "page", "gate", "matched_on")


def absent_labels(spark, sf_dir):
    """Labels that a document cites without a caption, with the keywords of the sentences that cite them."""
    refs = labels.referenced_only(labels.scan_labels(_lines(spark, sf_dir)))
    hits = K.cooccurring(F.col("text"), F.col("raw"), WORDS)
    return refs.select("doc_id", "page", "key", F.array_join(hits, ";").alias("hits")).where("hits <> ''")


def line_directions(spark, sf_dir):
    k = F.col("page") + F.length("line_text")
    lines = fixture(spark, sf_dir, "fx_lines").withColumn("dir_x", F.when(k % 3 == 0, 1).otherwise(0)).withColumn("dir_y", F.when(k % 3 == 0, 0).when(k % 3 == 1, 1).otherwise(-1))
    return pages.line_directions(lines.withColumn("line_no", F.col("line_no") + 100 * k).withColumn("page", F.lit(1)))


def nms(spark, sf_dir):
    return panel.suppress(fixture(spark, sf_dir, "fx_boxes")).select("panel_id", "box_no")


def split_panel(spark, sf_dir):
    return panel.split_panel(fixture(spark, sf_dir, "fx_boxes")).select("panel_id", "box_no", "dropped")


def drop_giants(spark, sf_dir):
    return panel.drop_giants(fixture(spark, sf_dir, "fx_boxes")).select("panel_id", "box_no")


def bands(spark, sf_dir):
    b = fixture(spark, sf_dir, "fx_boxes").select("panel_id", ((F.col("x1") + F.col("x2")) / 2).alias("c"), F.lit(1.5).alias("tol"))
    return panel.bands(b).select("panel_id", "band", F.round("center", 6).alias("center"))


def panel_grid(spark, sf_dir):
    """Boxes of a figure panel on their grid: suppression, side panel, giants, geometry and snapping."""
    kept = staged(panel.suppress(fixture(spark, sf_dir, "fx_boxes")), "panel-kept")
    boxes = staged(panel.drop_giants(panel.split_panel(kept).where("NOT dropped").drop("dropped")), "panel-boxes")
    return panel.snapped(boxes, panel.geometry(boxes)).select("panel_id", "box_no", "i", "j")


def panel_fill(spark, sf_dir):
    """Texts of a simple grid's boxes, colour words in swatch columns."""
    b = fixture(spark, sf_dir, "fx_boxes").withColumn("i", F.floor(F.col("y1") / 20).cast("int")).withColumn("j", F.floor(F.col("x1") / 60).cast("int"))
    means = F.array(F.col("score") * 250, (F.col("y1") % 200), (F.col("x1") % 220))
    b = b.withColumn("swatch", panel.swatch_word(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), means, F.array(F.lit(5.0), F.col("score") * 40, F.lit(1.0))))
    cols = panel.swatch_columns(b).withColumn("is_swatch", F.lit(True))
    b = b.join(cols, ["panel_id", "j"], "left").withColumn("text", F.when(F.col("is_swatch") & F.col("swatch").isNotNull(), F.col("swatch")).otherwise(F.concat(F.lit("t"), F.col("box_no") % 7)))
    return panel.filled(b)


def grid_shapes(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 4).cast("int").alias("a"), (F.col("l_suppkey") % 4).cast("int").alias("b"), F.col("l_linenumber").cast("int").alias("c")).distinct()
    note = panel.shape_mismatch(F.col("a"), F.col("b"), F.col("c"), F.col("c") - 1)
    return n.select("a", "b", "c", F.coalesce(note, F.lit("")).alias("note"))


def dual_read_merge(spark, sf_dir):
    return dual_read.merge(fixture(spark, sf_dir, "fx_reads"))


def dual_read_conflicts(spark, sf_dir):
    return dual_read.conflicts(dual_read.merge(fixture(spark, sf_dir, "fx_reads")))


def table_measures(spark, sf_dir):
    return audit.measures(fixture(spark, sf_dir, "fx_grid"))


def suspect_minus(spark, sf_dir):
    return audit.suspect_minus(fixture(spark, sf_dir, "fx_grid"))


def _boxed(df: DataFrame, flag: str | None = None) -> DataFrame:
    r = F.struct("x0", "y0", "x1", "y1")
    return df.withColumn("rect", F.when(~F.col(flag), r) if flag else r)


def _candidates(spark, sf_dir):
    return _boxed(fixture(spark, sf_dir, "fx_candidates")).select("doc_id", "page", "cand_no", "rect")


def _captions(spark, sf_dir):
    c = fixture(spark, sf_dir, "fx_captions").withColumn("x0", F.lit(0.0)).withColumn("x1", F.lit(100.0))
    return _boxed(c, "no_rect").select("doc_id", "page", "cap_no", "kind", "key", "text", "rect")


def region_chars(spark, sf_dir):
    spans = _boxed(fixture(spark, sf_dir, "fx_spans")).select("doc_id", "page", "rect", "text")
    return regions.region_chars(_candidates(spark, sf_dir), spans).select("doc_id", "page", "cand_no", "chars_in_rect", "source_type")


def nearest_regions(spark, sf_dir):
    return regions.nearest(_captions(spark, sf_dir), _candidates(spark, sf_dir))


def attached_captions(spark, sf_dir):
    return regions.attached_twice(_candidates(spark, sf_dir), _captions(spark, sf_dir))


def unmatched_captions(spark, sf_dir):
    return _unmatched(_captions(spark, sf_dir))


def _unmatched(caps: DataFrame) -> DataFrame:
    exported = caps.where("cap_no = 1").select("doc_id", "key")
    hits = F.array_join(K.keyword_hits(F.col("text"), WORDS), ";")
    return regions.unmatched_captions(caps, exported).select("doc_id", "page", "cap_no", "key", hits.alias("hits")).where("hits <> ''")


def _haystacks(spark, sf_dir):
    grid = fixture(spark, sf_dir, "fx_grid")
    arr = lambda cond, by: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct(by, "value")))), lambda x: x["value"])
    return grid.groupBy("doc_id", "table_no").agg(regions.haystack(arr(F.col("i") == 0, "j"), arr(F.col("j") == 0, "i")).alias("hay"))


def caption_ownership(spark, sf_dir):
    """Every table with its document's first caption on any page; belongs is null for tables of documents without captions."""
    caps = _captions(spark, sf_dir)
    first = caps.groupBy("doc_id").agg(F.min_by(F.struct("kind", F.col("text").alias("caption")), F.struct("page", "cap_no")).alias("c")).select("doc_id", "c.*")
    named = _haystacks(spark, sf_dir).join(first, "doc_id", "left")
    return regions.ownership(named, caps).select("doc_id", "table_no", F.when(F.col("caption").isNotNull(), F.col("belongs")).alias("belongs"))


def _cells(spark, sf_dir):
    return _boxed(fixture(spark, sf_dir, "fx_cells"), "no_box").withColumnRenamed("rect", "bbox").drop("x0", "y0", "x1", "y1")


def tall_rows(spark, sf_dir):
    return audit.tall_rows(_cells(spark, sf_dir))


def banded_cells(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    return audit.banded_cells(cells, fixture(spark, sf_dir, "fx_words"), cells.select("doc_id", "table_no", "r0").distinct())


def _cell_grid(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_cells").select("doc_id", "table_no", (F.col("r0") + 2).alias("i"), F.col("c0").alias("j"), F.lower("text").alias("value"))


def output_rows(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    return audit.output_rows(cells, _cell_grid(spark, sf_dir), cells.select("doc_id", "table_no", "r0").distinct())


def merged_rows(spark, sf_dir):
    return audit.merged_rows(_cells(spark, sf_dir), _cell_grid(spark, sf_dir), fixture(spark, sf_dir, "fx_words"))


def _tables(spark, sf_dir):
    t = fixture(spark, sf_dir, "fx_tables")
    return t.withColumn("header", F.split("header", r"\|")).withColumn("notes", F.array("note")).drop("note")


def table_audit(spark, sf_dir):
    out = audit.audited(_tables(spark, sf_dir))
    return out.select("doc_id", "table_no", manifest.two_digits(F.col("coverage")).alias("coverage"), "confidence", F.array_join("notes", "; ").alias("notes"))


def stitched_tables(spark, sf_dir):
    out = stitch.chains(_tables(spark, sf_dir))
    return out.select("doc_id", "table_no", "head_no", "seq", F.coalesce("reason", F.lit("")).alias("reason"), "drop_header")


def output_names(spark, sf_dir):
    t = _samples(spark, sf_dir)
    key = F.when(F.col("id") % 3 != 0, T.normalize_label(F.col("s")))
    tid = manifest.table_id(key, F.col("id"), F.col("id") * 2)
    return t.select("id", tid.alias("table_id"), manifest.csv_name(tid, F.col("id")).alias("csv"), manifest.sanitized(F.col("s")).alias("folder"))


def _manifest(spark, sf_dir, query: str) -> DataFrame:
    t = audit.audited(_tables(spark, sf_dir))
    m = K.match_hits(F.col("caption"), F.array_join("header", " "), WORDS)
    label = T.caption_label(F.col("caption"))
    rows = t.select(
        "doc_id", label.alias("raw"), T.normalize_label(label).alias("key"), "page", F.col("table_no").alias("seq"), F.col("caption").alias("text"), F.lit("docling").alias("extractor"), "source_type",
        m["matched_on"].alias("matched_on"), m["hits"].alias("hits"), F.col("cell_chars").cast("int").alias("n_rows"), "n_cols", "coverage", "plumber_cols", "confidence", "grid_status", "notes",
    )
    return manifest.manifest_rows(rows, query, "2024-01-01 00:00:00")


def manifest_rows(spark, sf_dir):
    return _manifest(spark, sf_dir, K.describe_query("table", WORDS))


def manifest_upsert(spark, sf_dir):
    """Two runs, one of them again with fewer rows."""
    a, b = _manifest(spark, sf_dir, "table:a"), _manifest(spark, sf_dir, "table:b")
    out = manifest.upserted(manifest.upserted(a, b, "table:b"), a.where("page > 2"), "table:a")
    return out.select("query", "doc_id", "table_id", "page")


def manifest_summary(spark, sf_dir):
    rows = _manifest(spark, sf_dir, "table:all")
    failed = rows.where("page = 1").select("doc_id", "table_id", F.lit(None).cast("string").alias("raw"), "page", F.lit("").alias("text"), F.lit("image").alias("source_type"), F.lit("no table grid in the image").alias("reason"))
    both = rows.unionByName(manifest.failure_rows(failed, "table:all", "2024-01-01 00:00:00"))
    return manifest.summary(both, ("query", "doc_id")).withColumn("chart_pages", F.array_join("chart_pages", ","))


def csv_files(spark, sf_dir):
    return manifest.csv_files(fixture(spark, sf_dir, "fx_grid"))


QUERIES = {
    f.__name__: f
    for f in (
        list_mode_inventory, scan_labels, referenced_only, keyword_hits, match_table, split_sentences, cooccurrence, label_keys, text_norms, word_counts, hyphen_rejoin,
        page_rotation, document_features, ocr_pages, line_directions, nms, split_panel, drop_giants, bands, panel_grid, panel_fill, grid_shapes, dual_read_merge, dual_read_conflicts,
        table_measures, suspect_minus, region_chars, nearest_regions, attached_captions, unmatched_captions, caption_ownership, tall_rows, banded_cells, output_rows, merged_rows,
        table_audit, stitched_tables, output_names, manifest_rows, manifest_upsert, manifest_summary, csv_files,
        preprint_documents, page_gates, absent_labels,
    )
}
