"""The catalog's queries as DuckDB statements, written apart from the operators.

Folds that depend on all choices before them are recursive queries or list reductions here.
"""

from __future__ import annotations

from gridquarry.functions import keywords as K
from gridquarry.functions import text as T
from gridquarry.operators.panel import SWATCHES
from gridquarry.plans.catalog import SAMPLES, TEXTS, WORDS
from gridquarry.sources.fixtures import with_fixtures

WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def put(template: str, x: str) -> str:
    return template.replace("{0}", x)


def flat(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def hit(x: str, k: str) -> str:
    return f"regexp_matches({x}, {_q('(?i)(?:^|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_-])' + K.body(k) + '(?:$|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_-])')})"


def hits(x: str, words=WORDS) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {hit(x, k)} THEN {_q(k)} END" for k in words) + "], lambda k: k IS NOT NULL)"


def joined(xs: str, sep: str = ";") -> str:
    return f"coalesce(array_to_string({xs}, '{sep}'), '')"


def norm_label(x: str) -> str:
    s = f"lower({flat(x)})"
    for a in ("supplementary data ", "supplementary ", "supplemental "):
        s = f"replace({s}, '{a}', 'supp ')"
    for p, to in ((r"\btabs?\.", "table"), (r"\btables\b", "table"), (r"\bfigures?\b", "fig"), (r"\bfigs?\.", "fig"), (r"\bfigs\b", "fig"), (r"[.:,;]+$", "")):
        s = f"regexp_replace({s}, '{p}', '{to}', 'g')"
    return rf"regexp_replace(trim({s}), '^supp (table|fig) (s\d)', '\1 \2')"


CAPTION = f"nullif(regexp_extract({{0}}, '^({T.LABEL})(?:[.:\\s]|$)', 1), '')"
LABELS = f"""
t AS (SELECT *, {flat('line_text')} AS f FROM fx_lines),
p AS (SELECT *, lag(f) OVER (PARTITION BY doc_id, page ORDER BY line_no) AS prev FROM t),
c AS (SELECT *, CASE WHEN prev IS NULL OR prev = '' OR regexp_matches(prev, '[.!?:]["'')\\]]*$') THEN {put(CAPTION, 'f')} END AS raw FROM p),
s AS (SELECT *, count(raw) OVER (PARTITION BY doc_id, page ORDER BY line_no) AS seg FROM c),
caps AS (SELECT doc_id, page, CAST(seg AS INT) AS pos, max(raw) AS raw, left({flat("string_agg(f, ' ' ORDER BY line_no)")}, 3000) AS text FROM s WHERE seg > 0 GROUP BY doc_id, page, seg),
capk AS (SELECT *, {norm_label('raw')} AS key FROM caps),
blk AS (SELECT doc_id, page, {flat("string_agg(f, ' ' ORDER BY line_no)")} AS text FROM t GROUP BY doc_id, page),
rf0 AS (SELECT doc_id, page, text, regexp_extract_all(text, '({T.LABEL})\\b', 1) AS ls FROM blk),
rf1 AS (SELECT doc_id, page, text, unnest(ls) AS raw, unnest(range(len(ls))) AS pos FROM rf0),
refs AS (SELECT doc_id, page, CAST(pos AS INT) AS pos, raw, text, {norm_label('raw')} AS key FROM rf1),
refk AS (SELECT * FROM refs r WHERE NOT EXISTS (SELECT 1 FROM capk c WHERE c.doc_id = r.doc_id AND c.page = r.page AND c.key = r.key)),
lab AS (SELECT doc_id, page, pos, raw, key, true AS is_caption, text FROM capk UNION ALL SELECT doc_id, page, pos, raw, key, false, text FROM refk),
absent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY page, pos) AS n FROM lab l WHERE NOT is_caption
           AND NOT EXISTS (SELECT 1 FROM capk c WHERE c.doc_id = l.doc_id AND c.key = l.key)) WHERE n = 1)"""
KIND = "CASE WHEN contains(key, 'table') THEN 'table' ELSE 'figure' END"
SENT = f"list_filter(list_transform(string_split(regexp_replace({{0}}, '\\.(\\s+)([A-Z(])', chr(1) || '\\1\\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"
#: Sentences without lookbehind: protect abbreviations, cut, and put the periods back.
_ABBR = "|".join(a.replace(".", r"\.") for a in T.ABBREVIATIONS)
PROTECTED = f"regexp_replace(regexp_replace({{0}}, '(^|[^A-Za-z.])((?i:{_ABBR}))\\.(\\s)', '\\1\\2' || chr(2) || '\\3', 'g'), '(^|[^A-Za-z.])((?i:{_ABBR}))\\.(\\s)', '\\1\\2' || chr(2) || '\\3', 'g')"


def sentences(x: str) -> str:
    return f"list_transform({put(SENT, put(PROTECTED, flat(x)))}, lambda s: replace(s, chr(2), '.'))"


STRIP = f"regexp_replace({{0}}, '^{WS}+|{WS}+$', '', 'g')"
NORM = f"replace(lower(regexp_replace({{0}}, '{WS}+', '', 'g')), chr(8722), '-')"
SIG = f"regexp_replace(regexp_replace({put(STRIP, '{0}')}, '[0-9]+', '9', 'g'), '[A-Za-z]+', 'A', 'g')"
STOP = ", ".join(map(_q, T.STOPWORDS))
CAPWORDS = f"list_filter(list_distinct(regexp_extract_all(lower({flat('{0}')}), '[A-Za-z][A-Za-z0-9\\-]{{2,}}')), lambda w: NOT list_contains([{STOP}], w))"
ROTATION = """
s AS (SELECT *, vert_lines >= 30 AND (vert_lines + horiz_lines = 0 OR vert_lines / (vert_lines + horiz_lines) >= 0.5) AS strong FROM fx_pages),
r AS (SELECT s.*, strong AND has_table_label AS rot FROM s WHERE page = 1
      UNION ALL SELECT s.*, s.strong AND (s.has_table_label OR r.rot) FROM r JOIN s ON s.doc_id = r.doc_id AND s.page = r.page + 1)"""
IOU_FOLD = """
b AS (SELECT panel_id, list(struct_pack(x1 := x1, y1 := y1, x2 := x2, y2 := y2, n := box_no) ORDER BY score DESC, box_no) AS bs FROM fx_boxes GROUP BY panel_id),
k AS (SELECT panel_id, list_reduce(list_transform(bs, lambda b: [b]), lambda k, c: CASE WHEN len(list_filter(k, lambda a:
        least(a.x2, c[1].x2) > greatest(a.x1, c[1].x1) AND least(a.y2, c[1].y2) > greatest(a.y1, c[1].y1)
        AND (least(a.x2, c[1].x2) - greatest(a.x1, c[1].x1)) * (least(a.y2, c[1].y2) - greatest(a.y1, c[1].y1))
            / ((a.x2 - a.x1) * (a.y2 - a.y1) + (c[1].x2 - c[1].x1) * (c[1].y2 - c[1].y1)
               - (least(a.x2, c[1].x2) - greatest(a.x1, c[1].x1)) * (least(a.y2, c[1].y2) - greatest(a.y1, c[1].y1))) > 0.5)) > 0
        THEN k ELSE list_concat(k, c) END) AS kept FROM b)"""
SPLIT = """
e AS (SELECT *, max(x2) OVER (PARTITION BY panel_id ORDER BY x1, box_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM fx_boxes),
g AS (SELECT *, x1 - ended AS gap, (x1 + ended) / 2 AS cut FROM e),
m AS (SELECT panel_id, median(x2 - x1) AS w FROM fx_boxes GROUP BY panel_id),
w AS (SELECT panel_id, gap, cut FROM (SELECT *, row_number() OVER (PARTITION BY panel_id ORDER BY gap DESC, x1, box_no) AS n FROM g WHERE gap > 0) WHERE n = 1)"""
MERGE = f"""
f AS (SELECT grid_id, i, j, conservative AS a, enhanced AS b, {put(NORM, 'conservative')} AS na, {put(NORM, 'enhanced')} AS nb FROM fx_reads),
g AS (SELECT grid_id, j, {put(SIG, 'b')} AS sig, count(*) AS n FROM f WHERE a <> '' AND b <> '' AND na = nb GROUP BY ALL),
maj AS (SELECT grid_id, j, arg_max(sig, n) AS sig FROM g GROUP BY grid_id, j HAVING sum(n) >= 3 AND max(n) * 2 > sum(n)),
x AS (SELECT f.*, {put(SIG, 'a')} = sig AS fa, {put(SIG, 'b')} = sig AS fb FROM f LEFT JOIN maj USING (grid_id, j)),
y AS (SELECT grid_id, i, j,
        CASE WHEN na <> '' AND nb <> '' AND na <> nb THEN CASE WHEN fa AND NOT fb THEN a ELSE b END WHEN nb <> '' THEN b ELSE a END AS value,
        CASE WHEN na <> '' AND nb <> '' AND na <> nb THEN CASE WHEN coalesce(fa <> fb, false) THEN 'conflict_format' ELSE 'conflict_unresolved' END
             WHEN nb <> '' THEN CASE WHEN na <> '' THEN 'agree' ELSE 'b3_only' END WHEN na <> '' THEN 'b2_only' ELSE '' END AS flag FROM x),
z AS (SELECT * FROM y WHERE (grid_id, i) IN (SELECT (grid_id, i) FROM y WHERE trim(value) <> '' GROUP BY grid_id, i HAVING count(*) >= 2)),
merged AS (SELECT grid_id, CAST(dense_rank() OVER (PARTITION BY grid_id ORDER BY i) - 1 AS INT) AS i, j, value, flag FROM z)"""
RANKED = """
n AS (SELECT c.doc_id, c.page, c.cap_no, d.cand_no, row_number() OVER (PARTITION BY c.doc_id, c.page, c.cap_no ORDER BY
        CASE WHEN no_rect THEN 0 WHEN kind = 'table' THEN CASE WHEN d.y0 >= c.y1 - 4 THEN 0 ELSE 1 END ELSE CASE WHEN d.y1 <= c.y0 + 4 THEN 0 ELSE 1 END END,
        CASE WHEN no_rect THEN 0 WHEN kind = 'table' THEN abs(d.y0 - c.y1) ELSE abs(c.y0 - d.y1) END, d.cand_no) AS n
      FROM fx_captions c JOIN fx_candidates d ON c.doc_id = d.doc_id AND c.page = d.page)"""
CONFIDENCE = """CASE WHEN source_type = 'image' OR ocr_page THEN 'low' WHEN grid_status <> 'ok' THEN 'medium' WHEN cov IS NULL OR cov < 0.35 THEN 'medium'
  WHEN plumber_cols IS NULL OR abs(plumber_cols - n_cols) > 1 THEN 'medium' WHEN note LIKE 'merged_row?=%' THEN 'medium' ELSE 'high' END"""
AUDIT = f"""
v AS (SELECT *, CASE WHEN source_type = 'text' AND chars_in_rect > 0 THEN cell_chars / chars_in_rect END AS cov FROM fx_tables),
au AS (SELECT *, {CONFIDENCE} AS confidence,
        array_to_string(list_filter([note, CASE WHEN cov < 0.35 THEN 'coverage_low=' || CAST(CAST(round_even(cov * 100, 0) AS INT) AS VARCHAR) || '%' END,
          CASE WHEN abs(plumber_cols - n_cols) > 1 THEN 'col_mismatch(docling=' || n_cols || ',plumber=' || plumber_cols || ')' END], lambda x: x IS NOT NULL), '; ') AS notes,
        CASE WHEN cov IS NULL THEN '' ELSE printf('%.2f', cov) END AS coverage FROM v)"""
SLUG = "trim(regexp_replace({0}, '[^a-z0-9]+', '_', 'g'), '_')"
MAN = f"""{AUDIT},
mh AS (SELECT *, {put(CAPTION, flat('caption'))} AS raw, {hits('caption')} AS ch, {hits("replace(header, '|', ' ')")} AS bh FROM au),
mr AS (SELECT *, {norm_label('raw')} AS key, list_filter([{', '.join(map(_q, WORDS))}], lambda k: list_contains(ch, k) OR list_contains(bh, k)) AS hs FROM mh),
ms AS (SELECT *, CASE WHEN key IS NOT NULL THEN {put(SLUG, 'key')} ELSE printf('p%02d_t%d', page, table_no) END AS table_id FROM mr)"""
MANIFEST = """SELECT doc_id, 'table:' || {0} AS query, '2024-01-01 00:00:00' AS run_at, table_id, coalesce(raw, '') AS label, page, left(caption, 200) AS caption, printf('p%02d_%s.csv', page, table_id) AS csv_path,
  'docling' AS extractor, source_type, CASE WHEN len(hs) = 0 THEN '' WHEN len(ch) > 0 AND len(bh) > 0 AND list_sort(ch) <> list_sort(bh) THEN 'caption+cell' WHEN len(ch) > 0 THEN 'caption' ELSE 'cell' END AS matched_on,
  coalesce(array_to_string(hs, ';'), '') AS matched_keywords, CAST(cell_chars AS INT) AS n_rows, n_cols, coverage, coalesce(CAST(plumber_cols AS VARCHAR), '') AS plumber_cols, confidence, grid_status, notes FROM ms"""

_SQL = {
    "list_mode_inventory": f"WITH {LABELS} SELECT doc_id, raw AS label, {KIND} AS kind, page, 'yes' AS present_in_pdf, CAST(length(text) AS INT) AS n_chars, {joined(hits('text'))} AS matched_keywords, text AS caption_legend FROM capk "
    f"UNION ALL SELECT doc_id, raw, {KIND}, page, 'no', 0, {joined(hits('text'))}, '' FROM absent",
    "scan_labels": f"WITH {LABELS} SELECT doc_id, page, raw, key, {KIND} AS kind, is_caption, text FROM lab",
    "referenced_only": f"WITH {LABELS} SELECT doc_id, page, raw, key, {KIND} AS kind FROM absent",
    "keyword_hits": f"SELECT doc_id, page, line_no, {joined(hits('line_text'))} AS hits FROM fx_lines",
    "match_table": f"""WITH g AS (SELECT doc_id, string_agg(value, ' ' ORDER BY value) AS content FROM fx_grid GROUP BY doc_id),
m AS (SELECT doc_id, page, line_no, {hits('line_text')} AS a, {hits('content')} AS b FROM fx_lines JOIN g USING (doc_id)),
u AS (SELECT *, list_filter([{', '.join(map(_q, WORDS))}], lambda k: list_contains(a, k) OR list_contains(b, k)) AS h FROM m)
SELECT doc_id, page, line_no, {joined('h')} AS hits, CASE WHEN len(h) = 0 THEN '' WHEN len(a) > 0 AND len(b) > 0 AND a <> b THEN 'caption+cell' WHEN len(a) > 0 THEN 'caption' ELSE 'cell' END AS matched_on FROM u""",
    "split_sentences": f"WITH s AS (SELECT doc_id, {sentences('text')} AS xs FROM documents) SELECT doc_id, CAST(unnest(range(len(xs))) AS INT) AS pos, unnest(xs) AS sentence FROM s",
    "cooccurrence": f"""WITH t AS (SELECT * FROM ({TEXTS.rsplit(' AS t(', 1)[0]}) AS t(id, s, label) UNION ALL SELECT doc_id, line_text, 'Table ' || (1 + page % 4) FROM fx_lines), x AS (SELECT id, {sentences('s')} AS xs, lower(label) AS lab FROM t)
SELECT id, CAST(len(xs) AS INT) AS n_sentences, coalesce(array_to_string(list_sort(list_distinct(flatten(list_transform(list_filter(xs, lambda s: contains(lower(s), lab)), lambda q: {hits('q')})))), ';'), '') AS hits FROM x""",
    "absent_labels": f"""WITH {LABELS}, x AS (SELECT doc_id, page, key, {sentences('text')} AS xs, lower(raw) AS lab FROM absent),
y AS (SELECT doc_id, page, key, coalesce(array_to_string(list_sort(list_distinct(flatten(list_transform(list_filter(xs, lambda s: contains(lower(s), lab)), lambda q: {hits('q')})))), ';'), '') AS hits FROM x)
SELECT * FROM y WHERE hits <> ''""",
    "preprint_documents": r"""WITH l AS (SELECT doc_id % 1500 + 1 AS doc_id, line_no, CASE WHEN line_text LIKE 'Table 1%' THEN 'arXiv: 2101.0' || (1000 + page) ELSE line_text END AS t FROM fx_lines WHERE page = 1 AND line_no % 2 = 1 AND length(line_text) <= 0.08 * 600.0),
w AS (SELECT doc_id, arg_min(t, line_no) AS watermark FROM l WHERE regexp_matches(t, '(?i)(?:arXiv|bioRxiv|medRxiv|Research\s*Square|SSRN|ChemRxiv)\s*:?\s*[0-9]{4}\.[0-9]{4,5}') GROUP BY doc_id),
p AS (SELECT doc_id, count(*) AS n, count(*) FILTER (regexp_matches(page_text, '(?i)bioRxiv|medRxiv|preprint|peer review|peer-review')) AS k FROM fx_pages GROUP BY doc_id)
SELECT p.doc_id, k AS preprint_pages, coalesce(watermark, '') AS watermark, k / n >= 0.4 OR watermark IS NOT NULL AS is_preprint FROM p LEFT JOIN w ON w.doc_id = p.doc_id""",
    "page_gates": """WITH g AS (SELECT doc_id, page, page % 2 = 0 AS searched, page_text LIKE '%journal%' AS c, page_text LIKE '%preprint%' AND vert_lines % 2 = 0 AS i,
  CASE WHEN vert_lines < 20 THEN 'chart' WHEN horiz_lines > 9 AND horiz_lines / 2.0 < 10.5 THEN 'low_resolution' WHEN page % 2 = 0 AND NOT page_text LIKE '%journal%' AND NOT (page_text LIKE '%preprint%' AND vert_lines % 2 = 0) THEN 'no_match' ELSE '' END AS gate FROM fx_pages)
SELECT doc_id, page, gate, CASE WHEN NOT searched OR gate <> '' THEN '' WHEN c THEN 'caption' ELSE 'image_text' END AS matched_on FROM g""",
    "label_keys": f"WITH t AS (SELECT id, s, {norm_label('s')} AS key FROM (SELECT * FROM ({SAMPLES.rsplit(' AS t(', 1)[0]}) AS t(id, s) UNION ALL SELECT doc_id, line_text FROM fx_lines)) SELECT id, key, {KIND} AS kind, starts_with(key, 'supp ') AS supplementary, coalesce({put(CAPTION, flat('s'))}, '') AS caption_label FROM t",
    "text_norms": f"""WITH t AS (SELECT * FROM ({SAMPLES.rsplit(' AS t(', 1)[0]}) AS t(id, s) UNION ALL SELECT 0, value FROM fx_grid)
SELECT id, s, {flat('s')} AS collapsed, regexp_replace(s, '(?i)^/(?:{'|'.join(T.SPACE_GLYPHS)})space{WS}*', '') AS glyphs, {put(NORM, 's')} AS norm, {put(SIG, 's')} AS signature,
  regexp_matches(s, '[a-z]-{WS}+[a-z]') AS broken, regexp_matches(s, '(?i)\\({WS}*continued{WS}*\\)') AS continued, coalesce(array_to_string(list_sort({put(CAPWORDS, 's')}), ' '), '') AS words FROM t""",
    "word_counts": "SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY doc_id, word",
    "hyphen_rejoin": """SELECT doc_id, concat_ws('-', table_no, i, j) AS cell_id,
  CASE WHEN doc_id % 2 = 0 THEN replace(value, 'cyclophos- phamide', 'cyclophosphamide') ELSE replace(value, 'relap- se', 'relapse') END AS value,
  CAST(CASE WHEN value LIKE '%- %e' AND value LIKE 'cyclo%' THEN 1 ELSE 0 END AS BIGINT) AS n_joined FROM fx_grid WHERE value <> ''""",
    "page_rotation": f"WITH RECURSIVE {ROTATION} SELECT doc_id, page, CASE WHEN NOT rot THEN 0 WHEN dominant_dy = 1 THEN 270 ELSE 90 END AS needs_rotation FROM r",
    "document_features": """SELECT doc_id, count(*) AS n_pages, CAST(sum(n_chars) AS BIGINT) AS total_chars, count(*) FILTER (cover_w >= 0.95 AND cover_h >= 0.95) AS n_full,
  count(*) FILTER (regexp_matches(page_text, '(?i)bioRxiv|medRxiv|preprint|peer review|peer-review')) AS preprint_pages,
  n_full / n_pages >= 0.8 AND total_chars / n_pages >= 1000 AS is_scanned, preprint_pages / n_pages >= 0.4 AS is_preprint FROM fx_pages GROUP BY doc_id""",
    "ocr_pages": """WITH d AS (SELECT doc_id, avg(CASE WHEN cover_w >= 0.95 AND cover_h >= 0.95 THEN 1.0 ELSE 0.0 END) >= 0.8 AND sum(n_chars) / count(*) >= 1000 AS sc FROM fx_pages GROUP BY doc_id)
SELECT doc_id, page, sc AND cover_w >= 0.95 AND cover_h >= 0.95 AS ocr_text_layer, CASE WHEN cover_h >= 0.08 THEN cover_h * 800 END AS raster_height,
  CASE WHEN page_text LIKE '%preprint%' THEN 1 ELSE 0 END AS n_preprint FROM fx_pages JOIN d USING (doc_id)""",
    "line_directions": f"""WITH l AS (SELECT doc_id, line_no + 100 * (page + length(line_text)) AS n, (page + length(line_text)) % 3 AS d, {put(CAPTION, flat('line_text'))} AS raw FROM fx_lines),
k AS (SELECT *, {norm_label('raw')} AS key FROM l)
SELECT doc_id, 1 AS page, count(*) FILTER (d > 0) AS vert_lines, count(*) FILTER (d = 0) AS horiz_lines,
  CASE WHEN count(*) FILTER (d = 1) > count(*) FILTER (d = 2) THEN 1 WHEN count(*) FILTER (d = 2) > count(*) FILTER (d = 1) THEN -1 ELSE coalesce(arg_min(CASE WHEN d = 1 THEN 1 ELSE -1 END, n) FILTER (d > 0), -1) END AS dominant_dy,
  coalesce(bool_or(d > 0 AND coalesce(contains(key, 'table'), false)), false) AS has_table_label FROM k GROUP BY doc_id""",
    "nms": f"WITH {IOU_FOLD} SELECT panel_id, unnest(list_transform(kept, lambda b: b.n)) AS box_no FROM k",
    "split_panel": f"WITH {SPLIT} SELECT b.panel_id, b.box_no, coalesce(w.gap > 2 * m.w AND (b.x1 + b.x2) / 2 >= w.cut, false) AS dropped FROM fx_boxes b JOIN m ON m.panel_id = b.panel_id LEFT JOIN w ON w.panel_id = b.panel_id",
    "drop_giants": "WITH a AS (SELECT panel_id, median((x2 - x1) * (y2 - y1)) AS m FROM fx_boxes GROUP BY panel_id) SELECT panel_id, box_no FROM fx_boxes JOIN a USING (panel_id) WHERE (x2 - x1) * (y2 - y1) < 6 * m",
    "bands": """WITH c AS (SELECT panel_id, (x1 + x2) / 2 AS c FROM fx_boxes), l AS (SELECT *, c - lag(c) OVER (PARTITION BY panel_id ORDER BY c) AS gap, row_number() OVER (PARTITION BY panel_id ORDER BY c) AS n FROM c),
s AS (SELECT panel_id, c, count(*) FILTER (gap > 1.5) OVER (PARTITION BY panel_id ORDER BY n) AS band FROM l) SELECT panel_id, CAST(band AS INT) AS band, round(avg(c), 6) AS center FROM s GROUP BY panel_id, band""",
    "grid_shapes": """WITH n AS (SELECT DISTINCT CAST(l_partkey % 4 AS INT) AS a, CAST(l_suppkey % 4 AS INT) AS b, CAST(l_linenumber AS INT) AS c FROM lineitem),
p AS (SELECT *, array_to_string(list_filter([CASE WHEN b <> c - 1 THEN 'cols detected=' || b || '/reconstructed=' || (c - 1) END, CASE WHEN abs(a - c) > 1 THEN 'rows detected=' || a || '/reconstructed=' || c END], lambda x: x IS NOT NULL), ', ') AS t FROM n)
SELECT a, b, c, CASE WHEN a > 0 AND b > 0 AND c > 1 AND t <> '' THEN 'grid_shape_mismatch(' || t || ')' ELSE '' END AS note FROM p""",
    "dual_read_merge": f"WITH {MERGE} SELECT * FROM merged",
    "dual_read_conflicts": f"WITH {MERGE} SELECT grid_id, count(*) FILTER (flag LIKE 'conflict%') AS conflicts, count(*) FILTER (flag = 'conflict_unresolved') AS unresolved FROM merged GROUP BY grid_id",
    "table_measures": f"SELECT doc_id, table_no, max(i) + 1 AS n_rows, max(j) + 1 AS n_cols, CAST(sum(length({put(STRIP, 'value')})) AS BIGINT) AS cell_chars, coalesce(string_agg(value, ' ' ORDER BY i, j) FILTER (value <> ''), '') AS content_text FROM fx_grid GROUP BY doc_id, table_no",
    "suspect_minus": rf"""WITH r AS (SELECT *, max(i) OVER (PARTITION BY doc_id, table_no) + 1 AS rows FROM fx_grid),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, table_no, j) AS n, count(*) FILTER (regexp_matches(value, '^{WS}*<')) OVER (PARTITION BY doc_id, table_no, j) AS lt FROM r WHERE value <> '')
SELECT doc_id, table_no, i, j, 'suspect_lt_as_minus(R' || i || 'C' || j || '=''' || {put(STRIP, 'value')} || ''')' AS note FROM c WHERE rows >= 3 AND n >= 3 AND lt >= greatest(2, n // 3) AND regexp_matches(value, '^{WS}*-{WS}*[0-9]')""",
    "region_chars": """WITH s AS (SELECT doc_id, page, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y, length(trim(text)) AS n FROM fx_spans)
SELECT c.doc_id, c.page, c.cand_no, CAST(coalesce(sum(n), 0) AS BIGINT) AS chars_in_rect, CASE WHEN coalesce(sum(n), 0) >= 30 THEN 'text' ELSE 'image' END AS source_type
FROM fx_candidates c LEFT JOIN s ON c.doc_id = s.doc_id AND c.page = s.page AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY ALL""",
    "nearest_regions": f"WITH {RANKED} SELECT doc_id, page, cap_no, cand_no FROM n WHERE n = 1",
    "unmatched_captions": f"WITH e AS (SELECT DISTINCT doc_id, key FROM fx_captions WHERE cap_no = 1), c AS (SELECT *, {joined(hits('text'))} AS hits FROM fx_captions) SELECT doc_id, page, cap_no, key, hits FROM c WHERE hits <> '' AND (doc_id, key) NOT IN (SELECT (doc_id, key) FROM e)",
    "caption_ownership": f"""WITH h AS (SELECT doc_id, table_no, lower({flat("coalesce(string_agg(value, ' ' ORDER BY j, value) FILTER (i = 0), '') || ' ' || coalesce(string_agg(value, ' ' ORDER BY i, value) FILTER (j = 0), '')")}) AS hay FROM fx_grid GROUP BY doc_id, table_no),
t AS (SELECT h.*, c.kind, c.text AS caption FROM h LEFT JOIN (SELECT * FROM fx_captions QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page, cap_no) = 1) c ON c.doc_id = h.doc_id),
w AS (SELECT DISTINCT doc_id, kind, text, {put(CAPWORDS, 'text')} AS ws FROM fx_captions),
o AS (SELECT t.doc_id, t.table_no, t.caption, w.text = t.caption AS own, len(list_filter(ws, lambda x: contains(hay, x))) AS n FROM t LEFT JOIN w ON w.doc_id = t.doc_id AND w.kind = t.kind)
SELECT doc_id, table_no, CASE WHEN bool_or(caption IS NOT NULL) THEN coalesce(max(n) FILTER (own), 0) > 0 OR coalesce(max(n) FILTER (NOT own), 0) < 2 END AS belongs FROM o GROUP BY doc_id, table_no""",
    "tall_rows": """WITH h AS (SELECT doc_id, table_no, r0, bool_or(column_header) AS head FROM fx_cells GROUP BY ALL),
c AS (SELECT doc_id, table_no, r0, c0, y1 - y0 AS h, row_number() OVER () AS id FROM fx_cells JOIN h USING (doc_id, table_no, r0) WHERE NOT no_box AND row_span = 1 AND NOT head AND y1 > y0),
m AS (SELECT doc_id, table_no, c0, median(h) AS med FROM c GROUP BY ALL HAVING count(*) >= 6),
t AS (SELECT c.* FROM c JOIN m USING (doc_id, table_no, c0) WHERE med > 0 AND h > 1.5 * med),
e AS (SELECT t.doc_id, t.table_no, t.c0, t.r0, t.id FROM t JOIN c o ON o.doc_id = t.doc_id AND o.table_no = t.table_no AND o.c0 = t.c0 AND o.r0 <> t.r0 GROUP BY ALL HAVING count(*) >= 4 AND median(o.h) > 0 AND (max(o.h) - min(o.h)) / median(o.h) <= 0.30)
SELECT doc_id, table_no, r0, count(*) AS n_cols FROM e GROUP BY ALL HAVING count(*) >= 2""",
    "banded_cells": """WITH w AS (SELECT doc_id, page, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM fx_words),
h AS (SELECT c.doc_id, c.table_no, c.r0, c.c0, cy FROM fx_cells c JOIN w ON w.doc_id = c.doc_id AND w.page = c.page AND NOT no_box AND cx BETWEEN x0 - 1 AND x1 + 1 AND cy BETWEEN y0 - 1 AND y1 + 1),
g AS (SELECT *, cy - lag(cy) OVER (PARTITION BY doc_id, table_no, r0, c0 ORDER BY cy) AS gap FROM h), b AS (SELECT DISTINCT doc_id, table_no, r0, c0 FROM g WHERE gap > 3.0)
SELECT doc_id, table_no, r0, count(*) AS n FROM b GROUP BY ALL""",
    "output_rows": """WITH a AS (SELECT DISTINCT doc_id, table_no, r0, replace(lower(text), ' ', '') AS t FROM fx_cells),
o AS (SELECT a.doc_id, a.table_no, a.r0, b.r0 + 2 AS i, count(*) AS n FROM a JOIN a b ON a.doc_id = b.doc_id AND a.table_no = b.table_no AND a.t = b.t GROUP BY ALL)
SELECT doc_id, table_no, r0, i FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, table_no, r0 ORDER BY n DESC, i) AS k FROM o) WHERE k = 1""",
    "table_audit": f"WITH {AUDIT} SELECT doc_id, table_no, coverage, confidence, notes FROM au",
    "stitched_tables": """WITH RECURSIVE o AS (SELECT doc_id, table_no, page, lower(header) AS h, regexp_matches(caption, '(?i)\\( *continued *\\)') AS said, row_number() OVER (PARTITION BY doc_id ORDER BY page, y0, table_no) AS n FROM fx_tables),
r AS (SELECT doc_id, n, table_no, table_no AS head_no, CAST(0 AS INT) AS seq, '' AS reason, false AS drop_header, page, h FROM o WHERE n = 1
  UNION ALL SELECT x.doc_id, x.n, x.table_no, CASE WHEN x.why <> '' THEN x.head_no ELSE x.table_no END, CASE WHEN x.why <> '' THEN x.seq + 1 ELSE 0 END, x.why, x.why <> '' AND x.same, x.page, CASE WHEN x.why <> '' THEN x.rh ELSE x.h END
  FROM (SELECT o.*, r.head_no, r.seq, r.h AS rh, r.h = o.h AS same, CASE WHEN o.page - r.page > 1 THEN '' WHEN o.said THEN 'caption_continued' WHEN r.h = o.h THEN 'same_columns' ELSE '' END AS why FROM r JOIN o ON o.doc_id = r.doc_id AND o.n = r.n + 1) x)
SELECT doc_id, table_no, head_no, seq, reason, drop_header FROM r""",
    "merged_rows": """WITH hd AS (SELECT doc_id, table_no, r0, bool_or(column_header) AS head FROM fx_cells GROUP BY ALL),
cc AS (SELECT doc_id, table_no, r0, c0, y1 - y0 AS h FROM fx_cells JOIN hd USING (doc_id, table_no, r0) WHERE NOT no_box AND row_span = 1 AND NOT head AND y1 > y0),
md AS (SELECT doc_id, table_no, c0, median(h) AS med FROM cc GROUP BY ALL HAVING count(*) >= 6),
tl AS (SELECT cc.* FROM cc JOIN md USING (doc_id, table_no, c0) WHERE med > 0 AND h > 1.5 * med),
ev AS (SELECT t.doc_id, t.table_no, t.c0, t.r0 FROM tl t JOIN cc o ON o.doc_id = t.doc_id AND o.table_no = t.table_no AND o.c0 = t.c0 AND o.r0 <> t.r0 GROUP BY ALL HAVING count(*) >= 4 AND median(o.h) > 0 AND (max(o.h) - min(o.h)) / median(o.h) <= 0.30),
su AS (SELECT doc_id, table_no, r0 FROM ev GROUP BY ALL HAVING count(*) >= 2),
wd AS (SELECT doc_id, page, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM fx_words),
hi AS (SELECT c.doc_id, c.table_no, c.r0, c.c0, cy FROM fx_cells c JOIN su USING (doc_id, table_no, r0) JOIN wd ON wd.doc_id = c.doc_id AND wd.page = c.page AND NOT no_box AND cx BETWEEN x0 - 1 AND x1 + 1 AND cy BETWEEN y0 - 1 AND y1 + 1),
gp AS (SELECT *, cy - lag(cy) OVER (PARTITION BY doc_id, table_no, r0, c0 ORDER BY cy) AS gap FROM hi),
bd AS (SELECT doc_id, table_no, r0 FROM (SELECT DISTINCT doc_id, table_no, r0, c0 FROM gp WHERE gap > 3.0) GROUP BY ALL HAVING count(*) > 2),
tx AS (SELECT DISTINCT doc_id, table_no, r0, replace(lower(text), ' ', '') AS t FROM fx_cells),
ov AS (SELECT a.doc_id, a.table_no, a.r0, b.r0 + 2 AS i, count(*) AS n FROM tx a JOIN bd USING (doc_id, table_no, r0) JOIN tx b ON a.doc_id = b.doc_id AND a.table_no = b.table_no AND a.t = b.t GROUP BY ALL),
bo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, table_no, r0 ORDER BY n DESC, i) AS k FROM ov) WHERE k = 1)
SELECT c.doc_id, c.table_no, bo.i, 'merged_row?=row' || bo.i || ': ' || array_to_string(list_slice(list(trim(c.text) ORDER BY c0), 1, 4), ' | ') AS note FROM fx_cells c JOIN bo USING (doc_id, table_no, r0) GROUP BY c.doc_id, c.table_no, c.r0, bo.i""",
    "panel_fill": f"""WITH b AS (SELECT panel_id, box_no, CAST(floor(y1 / 20) AS INT) AS i, CAST(floor(x1 / 60) AS INT) AS j, x2 - x1 AS w, y2 - y1 AS h, [score * 250, y1 % 200, x1 % 220] AS m, greatest(5.0, score * 40, 1.0) AS sd FROM fx_boxes),
a(word, n, r, g, bl) AS (VALUES {', '.join(f"('{w}', {n}, {r}, {g}, {b})" for n, (w, r, g, b) in enumerate(SWATCHES))}),
d AS (SELECT panel_id, box_no, word, row_number() OVER (PARTITION BY panel_id, box_no ORDER BY (r - m[1]) * (r - m[1]) + (g - m[2]) * (g - m[2]) + (bl - m[3]) * (bl - m[3]), n) AS k FROM b, a
      WHERE w >= 6 AND h >= 6 AND sd <= 30 AND (list_max(m) - list_min(m) >= 25 OR list_min(m) <= 170)),
s AS (SELECT b.*, d.word FROM b LEFT JOIN d ON d.panel_id = b.panel_id AND d.box_no = b.box_no AND d.k = 1),
p AS (SELECT *, first_value(word) OVER (PARTITION BY panel_id, i, j ORDER BY box_no DESC) AS probe FROM s),
c AS (SELECT panel_id, j FROM p GROUP BY panel_id, j HAVING avg(CASE WHEN probe IS NOT NULL THEN 1.0 ELSE 0.0 END) >= 0.5),
t AS (SELECT p.panel_id, i, p.j, box_no, CASE WHEN c.j IS NOT NULL AND word IS NOT NULL THEN word ELSE 't' || (box_no % 7) END AS t FROM p LEFT JOIN c ON c.panel_id = p.panel_id AND c.j = p.j)
SELECT panel_id, i, j, list_reduce(list(t ORDER BY box_no), lambda v, x: CASE WHEN contains(v, x) THEN v ELSE v || ' ' || x END) AS value FROM t GROUP BY panel_id, i, j""",
    "attached_captions": """WITH RECURSIVE cap AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY kind DESC, CASE WHEN no_rect THEN 0 ELSE y0 END, cap_no) AS n FROM fx_captions),
r AS (SELECT DISTINCT doc_id, page, CAST(0 AS BIGINT) AS n, CAST([] AS INT[]) AS used, CAST(NULL AS INT) AS cand_no, CAST(NULL AS INT) AS cap_no FROM fx_captions
  UNION ALL SELECT doc_id, page, n, CASE WHEN cand_no IS NULL THEN used ELSE list_append(used, cand_no) END, cand_no, cap_no FROM (
    SELECT r.doc_id, r.page, c.n, r.used, c.cap_no, d.cand_no, row_number() OVER (PARTITION BY r.doc_id, r.page ORDER BY
        CASE WHEN c.no_rect THEN 0 WHEN c.kind = 'table' THEN CASE WHEN d.y0 >= c.y1 - 4 THEN 0 ELSE 1 END ELSE CASE WHEN d.y1 <= c.y0 + 4 THEN 0 ELSE 1 END END,
        CASE WHEN c.no_rect THEN 0 WHEN c.kind = 'table' THEN abs(d.y0 - c.y1) ELSE abs(c.y0 - d.y1) END, d.cand_no) AS k
    FROM r JOIN cap c ON c.doc_id = r.doc_id AND c.page = r.page AND c.n = r.n + 1
    LEFT JOIN fx_candidates d ON d.doc_id = r.doc_id AND d.page = r.page AND NOT list_contains(r.used, d.cand_no)) WHERE k = 1)
SELECT doc_id, page, cand_no, cap_no FROM r WHERE cand_no IS NOT NULL""",
    "panel_grid": f"""WITH {IOU_FOLD}, nm AS (SELECT k.panel_id, unnest(list_transform(kept, lambda b: b.n)) AS box_no FROM k),
bx AS (SELECT f.* FROM fx_boxes f JOIN nm ON nm.panel_id = f.panel_id AND nm.box_no = f.box_no),
{SPLIT.replace('FROM fx_boxes', 'FROM bx').strip()},
kp AS (SELECT b.* FROM bx b JOIN m ON m.panel_id = b.panel_id LEFT JOIN w ON w.panel_id = b.panel_id WHERE NOT coalesce(w.gap > 2 * m.w AND (b.x1 + b.x2) / 2 >= w.cut, false)),
ar AS (SELECT panel_id, median((x2 - x1) * (y2 - y1)) AS a FROM kp GROUP BY panel_id),
fb AS (SELECT kp.*, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM kp JOIN ar USING (panel_id) WHERE (x2 - x1) * (y2 - y1) < 6 * a),
md AS (SELECT panel_id, median(x2 - x1) AS mw, median(y2 - y1) AS mh FROM fb GROUP BY panel_id),
xg AS (SELECT panel_id, cx, mw, cx - lag(cx) OVER (PARTITION BY panel_id ORDER BY cx) AS gap, row_number() OVER (PARTITION BY panel_id ORDER BY cx) AS n FROM fb JOIN md USING (panel_id)),
xb AS (SELECT panel_id, cx, count(*) FILTER (gap > mw * 0.6) OVER (PARTITION BY panel_id ORDER BY n) AS band FROM xg),
co AS (SELECT panel_id, list(c ORDER BY band) AS cols FROM (SELECT panel_id, band, avg(cx) AS c FROM xb GROUP BY ALL) GROUP BY panel_id),
yg AS (SELECT panel_id, cy, mh, cy - lag(cy) OVER (PARTITION BY panel_id ORDER BY cy) AS gap, row_number() OVER (PARTITION BY panel_id ORDER BY cy) AS n FROM fb JOIN md USING (panel_id)),
yb AS (SELECT panel_id, cy, count(*) FILTER (gap > mh * 0.6) OVER (PARTITION BY panel_id ORDER BY n) AS band FROM yg),
pr AS (SELECT panel_id, band, avg(cy) AS c FROM yb GROUP BY ALL),
pl AS (SELECT panel_id, list(c ORDER BY band) AS plain, median(g) AS pg FROM (SELECT *, c - lag(c) OVER (PARTITION BY panel_id ORDER BY band) AS g FROM pr) GROUP BY panel_id),
fc AS (SELECT fb.panel_id, cy, cy - lag(cy) OVER (PARTITION BY fb.panel_id ORDER BY cy) AS d FROM fb JOIN md USING (panel_id) JOIN co USING (panel_id) WHERE abs(cx - cols[1]) <= mw * 0.6),
yy AS (SELECT panel_id, list(cy ORDER BY cy) AS ys, median(d) FILTER (d > 1) AS p, count(*) FILTER (d > 1) AS n FROM fc GROUP BY panel_id),
rw AS (SELECT panel_id, n, p, list_reduce(list_transform(ys, lambda y: [y]), lambda r, y: CASE WHEN y[1] - r[-1] < 0.5 * p THEN r
         ELSE list_concat(r, list_transform(range(1, 1 + greatest(0, CAST(ceil((y[1] - r[-1]) / p - 1.5) AS BIGINT))), lambda q: r[-1] + q * p), y) END) AS made FROM yy),
ge AS (SELECT md.panel_id, mw, cols, CASE WHEN n < 2 THEN plain ELSE made END AS rws, CASE WHEN n < 2 THEN coalesce(pg, mh) ELSE p END AS pitch FROM md JOIN co USING (panel_id) JOIN pl USING (panel_id) JOIN rw USING (panel_id)),
rr AS (SELECT panel_id, CAST(unnest(range(len(rws))) AS INT) AS i, unnest(rws) AS ry FROM ge),
cl AS (SELECT panel_id, CAST(unnest(range(len(cols))) AS INT) AS j, unnest(cols) AS kx FROM ge),
ni AS (SELECT fb.panel_id, box_no, arg_min(i, abs(ry - cy) + i * 1e-12) AS i, min(abs(ry - cy)) AS dy FROM fb JOIN rr ON rr.panel_id = fb.panel_id GROUP BY ALL),
nj AS (SELECT fb.panel_id, box_no, arg_min(j, abs(kx - cx) + j * 1e-12) AS j, min(abs(kx - cx)) AS dx FROM fb JOIN cl ON cl.panel_id = fb.panel_id GROUP BY ALL)
SELECT ni.panel_id, ni.box_no, i, j FROM ni JOIN nj ON nj.panel_id = ni.panel_id AND nj.box_no = ni.box_no JOIN ge ON ge.panel_id = ni.panel_id WHERE dy <= 0.6 * pitch AND dx <= mw * 0.6""",
    "output_names": f"""WITH t AS (SELECT id, s, CASE WHEN id % 3 <> 0 THEN {norm_label('s')} END AS key FROM (SELECT * FROM ({SAMPLES.rsplit(' AS t(', 1)[0]}) AS t(id, s) UNION ALL SELECT doc_id, line_text FROM fx_lines)),
n AS (SELECT id, s, CASE WHEN key IS NOT NULL THEN {put(SLUG, 'key')} ELSE printf('p%02d_t%d', id, id * 2) END AS table_id FROM t)
SELECT id, table_id, printf('p%02d_%s.csv', id, table_id) AS csv, coalesce(nullif(trim(regexp_replace(regexp_replace(trim(s), '[^\\p{{L}}\\p{{N}}_.\\-]+', '_', 'g'), '_{{2,}}', '_', 'g'), '._-'), ''), 'output') AS folder FROM n""",
    "manifest_rows": f"WITH {MAN} {put(MANIFEST, _q(';'.join(sorted(WORDS))))}",
    "manifest_upsert": f"WITH {MAN} SELECT 'table:b' AS query, doc_id, table_id, page FROM ms UNION ALL SELECT 'table:a', doc_id, table_id, page FROM ms WHERE page > 2",
    "manifest_summary": f"""WITH {MAN} SELECT 'table:all' AS query, doc_id, count(*) AS exported, count(*) FILTER (page = 1) AS not_exported, count(*) FILTER (page = 1) AS unnamed_charts,
  CASE WHEN count(*) FILTER (page = 1) > 0 THEN '1' ELSE '' END AS chart_pages, count(*) FILTER (confidence = 'low') AS low_confidence FROM ms GROUP BY doc_id""",
    "csv_files": """WITH q AS (SELECT *, CASE WHEN regexp_matches(value, '[",\\r\\n]') THEN '"' || replace(value, '"', '""') || '"' ELSE value END AS v FROM fx_grid),
r AS (SELECT doc_id, table_no, i, string_agg(v, ',' ORDER BY j, v) AS line, count(*) AS n FROM q GROUP BY ALL)
SELECT doc_id, table_no, string_agg(CASE WHEN n = 1 AND line = '' THEN '""' ELSE line END || chr(13) || chr(10), '' ORDER BY i) AS content FROM r GROUP BY ALL""",
}
ORACLE_SQL = {name: with_fixtures(sql) for name, sql in _SQL.items()}
