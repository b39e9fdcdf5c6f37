"""Schemas of the tables that the operators take and give."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType()}


def _struct(**fields: str) -> T.StructType:
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in fields.items()])


RECT = _struct(x0="double", y0="double", x1="double", y1="double")
_KINDS |= {
    "rect": RECT,
    "images": T.ArrayType(_struct(width="double", height="double", cover_w="double", cover_h="double")),
    "texts": T.MapType(T.StringType(), T.StringType()),
    "counts": T.MapType(T.StringType(), T.IntegerType()),
}


def _table(columns: str) -> T.StructType:
    """A schema from 'name kind, name kind, ...'."""
    return _struct(**dict(c.split() for c in columns.split(", ")))


LINES = _table("doc_id bigint, page int, block_no int, line_no int, y0 double, dir_x int, dir_y int, line_text string")
SPANS = _table("doc_id bigint, page int, span_no int, rect rect, text string")
WORDS = _table("doc_id bigint, page int, word_no int, x0 double, y0 double, x1 double, y1 double, text string")
IMAGES = _table("doc_id bigint, page int, xref int, rect rect, px_width int, px_height int, cover_w double, cover_h double")
PAGES = _table(
    "doc_id bigint, page int, width double, height double, n_chars int, vert_lines int, horiz_lines int, "
    "images images, ocr_text_layer boolean, needs_rotation int"
)
DOCS = _table("doc_id bigint, path string, n_pages int, metadata texts, preprint_markers counts, preprint_pages int, p1_watermark string")
LABELS = _table("doc_id bigint, page int, raw string, key string, kind string, is_caption boolean, text string, rect rect")
CANDIDATES = _table("doc_id bigint, page int, cand_no int, rect rect, source_type string, chars_in_rect int")
CELLS = _table("doc_id bigint, table_no int, page int, text string, r0 int, c0 int, row_span int, col_span int, column_header boolean, bbox rect")
GRID = _table("doc_id bigint, table_no int, i int, j int, value string, flag string")
BOXES = _table("panel_id bigint, box_no int, x1 double, y1 double, x2 double, y2 double, score double")
KEYWORDS = _table("pos int, keyword string")
#: Output columns, in order.
MANIFEST_COLUMNS = (
    "query run_at table_id label page caption csv_path extractor source_type matched_on matched_keywords n_rows n_cols coverage plumber_cols confidence grid_status notes"
).split()
MANIFEST = _table(", ".join(f"{c} {'int' if c in ('page', 'n_rows', 'n_cols') else 'string'}" for c in MANIFEST_COLUMNS))
CAPTION_COLUMNS = "label kind page present_in_pdf n_chars matched_keywords caption_legend".split()
