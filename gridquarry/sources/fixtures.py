"""Deterministic relations over the star-schema tables that stand in for ingested documents.

The text of each runs alike in Spark and DuckDB. {name} stands for a table of the folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FX = {
    "fx_lines": """
SELECT l_orderkey AS doc_id, l_linenumber AS page,
       CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_tax) AS INT) AS line_no,
       CASE (l_partkey + l_suppkey) % 6
         WHEN 0 THEN 'Table ' || CAST(1 + l_partkey % 4 AS STRING) || '. Response of xenografts to drug.'
         WHEN 1 THEN 'Fig. ' || CAST(1 + l_partkey % 4 AS STRING) || ' Dosing schedule, in vivo panel'
         WHEN 2 THEN 'TABLE ' || CAST(1 + l_partkey % 4 AS STRING) || ' ( Continued )'
         WHEN 3 THEN 'as shown in Table ' || CAST(1 + l_partkey % 7 AS STRING) || ', the relapse was controlled.'
         WHEN 4 THEN 'see Supplementary Table S' || CAST(1 + l_partkey % 4 AS STRING) || ' for PR-104 and PR. Remission followed'
         ELSE 'Smith et al. Then EFS improved in 3.5 weeks.' END AS line_text
FROM {lineitem}""",
    "fx_pages": """
SELECT o_custkey AS doc_id,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS page,
       CAST(o_orderkey % 120 AS INT) AS vert_lines, CAST(o_orderkey % 70 AS INT) AS horiz_lines,
       o_orderpriority LIKE '1%' AS has_table_label,
       CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS dominant_dy,
       CAST(floor(o_totalprice) AS BIGINT) % 4000 AS n_chars,
       CASE WHEN o_custkey % 3 = 0 THEN CAST(0.97 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS cover_w,
       CASE WHEN o_orderstatus = 'P' THEN CAST(0.05 AS DOUBLE) ELSE CAST(0.96 AS DOUBLE) END AS cover_h,
       CASE WHEN o_orderkey % 5 = 0 THEN 'posted on bioRxiv preprint' ELSE 'journal text' END AS page_text
FROM {orders}""",
    "fx_boxes": """
SELECT l_suppkey AS panel_id,
       CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_tax) AS INT) AS box_no,
       CAST(l_linenumber * 60.0 + l_tax * 100.0 + CASE WHEN l_linenumber = 7 THEN 300.0 ELSE 0.0 END AS DOUBLE) AS x1,
       CAST((l_partkey % 30) * 20.0 + l_discount * 30.0 AS DOUBLE) AS y1,
       CAST(l_linenumber * 60.0 + l_tax * 100.0 + CASE WHEN l_linenumber = 7 THEN 300.0 ELSE 0.0 END + 40.0 AS DOUBLE) AS x2,
       CAST((l_partkey % 30) * 20.0 + l_discount * 30.0 + CASE WHEN l_quantity = 50 THEN 200.0 ELSE 12.0 END AS DOUBLE) AS y2,
       CAST(l_quantity / 50.0 AS DOUBLE) AS score
FROM {lineitem}""",
    "fx_reads": """
SELECT l_suppkey AS grid_id, CAST(l_partkey % 30 AS INT) AS i, l_linenumber AS j,
       min(CASE WHEN l_returnflag = 'A' THEN '' ELSE CAST(CAST(l_quantity AS INT) AS STRING) END) AS conservative,
       max(CASE WHEN l_linestatus = 'F' THEN '' ELSE CAST(CAST(l_quantity AS INT) AS STRING) || CASE WHEN l_discount > 0.05 THEN '%' ELSE '' END END) AS enhanced
FROM {lineitem} GROUP BY l_suppkey, CAST(l_partkey % 30 AS INT), l_linenumber""",
    # One table an order: a cell a line, some with '<' and '-' values, breaks, glyph names and other white space.
    "fx_grid": """
SELECT l_orderkey AS doc_id, CAST(l_partkey % 2 AS INT) AS table_no,
       CAST(row_number() OVER (PARTITION BY l_orderkey, l_partkey % 2, l_suppkey % 3 ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_tax) - 1 AS INT) AS i,
       CAST(l_suppkey % 3 AS INT) AS j,
       CASE (l_partkey + l_linenumber) % 9 WHEN 0 THEN ' <0.00' || CAST(l_partkey % 10 AS STRING) WHEN 1 THEN '<' || CAST(l_partkey % 50 AS STRING) WHEN 2 THEN '< 0.05'
         WHEN 3 THEN '-0.' || CAST(l_partkey % 100 AS STRING) WHEN 4 THEN ' - ' || CAST(l_suppkey % 10 AS STRING) || ' '
         WHEN 5 THEN '/emspaceMean ' || CAST(l_partkey % 5 AS STRING) WHEN 6 THEN 'cyclophos- phamide and relap- se' WHEN 7 THEN '' ELSE 'Obj. Response ' || l_returnflag END AS value
FROM {lineitem}""",
    "fx_candidates": """
SELECT o_custkey AS doc_id, CAST(o_orderkey % 3 AS INT) AS page,
       CAST(row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderkey) AS INT) AS cand_no,
       CAST((o_orderkey % 5) * 20 AS DOUBLE) AS x0, CAST((o_orderkey % 17) * 40 AS DOUBLE) AS y0,
       CAST((o_orderkey % 5) * 20 + 100 AS DOUBLE) AS x1, CAST((o_orderkey % 17) * 40 + 60 AS DOUBLE) AS y1
FROM {orders}""",
    "fx_spans": """
SELECT o_custkey AS doc_id, CAST(o_orderkey % 3 AS INT) AS page, l_linenumber AS span_no,
       CAST((l_partkey % 200) AS DOUBLE) AS x0, CAST((l_suppkey * 7 + l_partkey) % 720 AS DOUBLE) AS y0,
       CAST((l_partkey % 200) + 30 AS DOUBLE) AS x1, CAST((l_suppkey * 7 + l_partkey) % 720 + 10 AS DOUBLE) AS y1,
       '  ' || l_returnflag || ' cell text ' AS text
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    # Cells of a column of even height but for a few; three tables of a document.
    "fx_cells": """
SELECT doc_id, table_no, 1 AS page, r0, c0, CASE WHEN min(q) = 50 THEN 2 ELSE 1 END AS row_span, r0 = 0 AS column_header, max(p % 5) = 3 AND r0 = 5 AS no_box,
       CAST(r0 * 30 AS DOUBLE) AS y0, CAST(r0 * 30 + CASE WHEN r0 = 4 THEN 28 ELSE 12 + min(p % 3) END AS DOUBLE) AS y1,
       CAST(c0 * 50 AS DOUBLE) AS x0, CAST(c0 * 50 + 40 AS DOUBLE) AS x1, 'Val ' || CAST(min(p % 6) AS STRING) AS text
FROM (SELECT l_suppkey AS doc_id, CAST(l_orderkey % 8 AS INT) AS table_no, CAST(l_partkey % 9 AS INT) AS r0, CAST(l_linenumber % 5 AS INT) AS c0, l_quantity AS q, l_partkey AS p FROM {lineitem})
GROUP BY doc_id, table_no, r0, c0""",
    # Words lie in cells or beside them by their place.
    "fx_captions": """
SELECT o_custkey AS doc_id, CAST(o_orderkey % 3 AS INT) AS page,
       CAST(row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderkey DESC) AS INT) AS cap_no,
       CASE WHEN o_orderkey % 4 = 0 THEN 'figure' ELSE 'table' END AS kind,
       CASE WHEN o_orderkey % 4 = 0 THEN 'fig ' ELSE 'table ' END || CAST(o_orderkey % 9 AS STRING) AS key,
       CASE o_orderkey % 5 WHEN 0 THEN 'Response of tumours to Obj treatment' WHEN 1 THEN 'Mean survival by group' WHEN 2 THEN 'Summary of results' WHEN 3 THEN 'Cyclophosphamide dose in xenografts' ELSE 'Relapse and remission' END AS text,
       o_orderkey % 11 = 0 AS no_rect, CAST((o_orderkey % 13) * 50 AS DOUBLE) AS y0, CAST((o_orderkey % 13) * 50 + 12 AS DOUBLE) AS y1
FROM {orders}""",
    "fx_words": """
SELECT l_suppkey AS doc_id, 1 AS page, CAST((l_partkey * 7 + l_linenumber) % 250 + CASE WHEN l_quantity > 25 THEN 250 ELSE 0 END AS DOUBLE) AS x0, CAST((l_partkey * 3) % 270 AS DOUBLE) AS y0,
       CAST((l_partkey * 7 + l_linenumber) % 250 + CASE WHEN l_quantity > 25 THEN 250 ELSE 0 END + 6 AS DOUBLE) AS x1, CAST((l_partkey * 3) % 270 + 4 AS DOUBLE) AS y1
FROM {lineitem}""",
    # Extracted tables in reading order: header, caption and page of each.
    "fx_tables": """
SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS table_no,
       CAST(1 + floor((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) * (1 + o_custkey % 2) / 2) AS INT) AS page,
       CAST(o_orderkey % 700 AS DOUBLE) AS y0, 'Arm|' || CASE WHEN o_orderkey % 3 = 0 THEN 'n' ELSE 'Response' END AS header,
       CASE WHEN o_orderkey % 10 = 0 THEN 'Table 2 ( Continued )' WHEN o_orderkey % 2 = 0 THEN 'Table 1. Response to drug' ELSE 'Relapse table' END AS caption,
       CASE WHEN o_orderkey % 6 = 0 THEN 'image' ELSE 'text' END AS source_type,
       CAST(o_orderkey % 400 AS BIGINT) AS cell_chars, CAST(o_orderkey % 900 AS BIGINT) AS chars_in_rect, CAST(1 + o_orderkey % 6 AS INT) AS n_cols,
       CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE CAST(1 + o_orderkey % 7 AS INT) END AS plumber_cols,
       CASE WHEN o_orderkey % 12 = 1 THEN 'grid_mismatch' ELSE 'ok' END AS grid_status, o_orderkey % 25 = 0 AS ocr_page,
       CASE WHEN o_orderkey % 14 = 1 THEN 'merged_row?=row3: a | b' ELSE 'hyphen_rejoined=1' END AS note
FROM {orders}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A relation of FX over the tables of a folder."""
    sql = FX[name]
    used = {t: table(spark, sf_dir, t) for t in ("lineitem", "orders") if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def with_fixtures(sql: str) -> str:
    """A DuckDB statement preceded by the relations that it names."""
    need = [n for n in FX if n in sql]
    ctes = ", ".join(f"{n} AS ({FX[n].format(lineitem='lineitem', orders='orders')})" for n in need)
    body = sql.strip()
    if not need:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {body[14:].strip()}"
    return f"WITH {ctes}, {body[4:].strip()}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"
