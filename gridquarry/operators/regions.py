"""Regions and their captions: text in a region, pairing, ownership.

candidates: doc_id, page, cand_no, rect struct<x0,y0,x1,y1>; captions: doc_id, page, cap_no, kind, key, text, rect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridquarry.functions.text import caption_words, collapse_ws, strip

TEXT_CHARS, SLACK, RIVAL_WORDS = 30, 4, 2


def inside(rect: Column, x: Column, y: Column, margin: float = 0.0) -> Column:
    return x.between(rect["x0"] - margin, rect["x1"] + margin) & y.between(rect["y0"] - margin, rect["y1"] + margin)


def region_chars(candidates: DataFrame, spans: DataFrame) -> DataFrame:
    """candidates with chars_in_rect and source_type: characters of the page's spans (doc_id, page, rect, text) with
    their centre in the region; a range join within one page."""
    s = spans.select("doc_id", "page", F.col("rect").alias("r"), F.length(strip(F.col("text"))).alias("n"))
    x, y = (F.col("r.x0") + F.col("r.x1")) / 2, (F.col("r.y0") + F.col("r.y1")) / 2
    own = candidates.select("doc_id", "page", "cand_no", "rect")
    sums = own.join(s, ["doc_id", "page"]).where(inside(F.col("rect"), x, y)).groupBy("doc_id", "page", "cand_no").agg(F.sum("n").alias("n"))
    out = candidates.join(sums, ["doc_id", "page", "cand_no"], "left").withColumn("chars_in_rect", F.coalesce("n", F.lit(0).cast("long"))).drop("n")
    return out.withColumn("source_type", source_type(F.col("chars_in_rect")))


def source_type(chars: Column) -> Column:
    return F.when(chars >= TEXT_CHARS, "text").otherwise("image")


def to_top_left(rect: Column, page_height: Column, bottom_left: Column) -> Column:
    """A box with top-left origin and ordered sides."""
    a, b = F.when(bottom_left, page_height - rect["y0"]).otherwise(rect["y0"]), F.when(bottom_left, page_height - rect["y1"]).otherwise(rect["y1"])
    return F.struct(F.least(rect["x0"], rect["x1"]).alias("x0"), F.least(a, b).alias("y0"), F.greatest(rect["x0"], rect["x1"]).alias("x1"), F.greatest(a, b).alias("y1"))


def _rank(cap: Column, cand: Column) -> Column:
    """How well a region fits a caption, the least being best: on the wrong side, distance, order."""
    table = cap["kind"] == "table"
    edge = F.when(table, cand["rect"]["y0"]).otherwise(cand["rect"]["y1"])
    line = F.when(table, cap["rect"]["y1"]).otherwise(cap["rect"]["y0"])
    wrong = F.when(table, edge < line - SLACK).otherwise(edge > line + SLACK)
    free = cap["rect"].isNull()
    return F.struct(
        F.when(free, False).otherwise(wrong).alias("wrong"), F.when(free, 0.0).otherwise(F.abs(edge - line)).alias("far"), cand["cand_no"].alias("cand_no")
    )


def nearest(captions: DataFrame, candidates: DataFrame) -> DataFrame:
    """doc_id, page, cap_no, cand_no: for each caption its best region on the page, by itself."""
    c = captions.select("doc_id", "page", "cap_no", F.struct("kind", "rect").alias("cap"))
    d = candidates.select("doc_id", "page", F.struct("rect", "cand_no").alias("cand"))
    return c.join(d, ["doc_id", "page"]).groupBy("doc_id", "page", "cap_no").agg(F.min(_rank(F.col("cap"), F.col("cand")))["cand_no"].alias("cand_no"))


def attached(candidates: DataFrame, captions: DataFrame) -> DataFrame:
    """doc_id, page, cand_no, cap_no: captions from top to bottom each take the best region that is still free.

    The choice depends on those before it, so it is a fold over the captions of one page; both arrays hold one page."""
    caps = captions.groupBy("doc_id", "page").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("rect.y0"), F.lit(0.0)).alias("y"), "cap_no", "kind", "rect"))).alias("caps")
    )
    cands = candidates.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("cand_no", "rect"))).alias("cands"))

    def step(taken: Column, cap: Column) -> Column:
        free = F.filter("cands", lambda c: ~F.exists(taken, lambda t: t["cand_no"] == c["cand_no"]))
        best = F.array_min(F.transform(free, lambda c: _rank(cap, c)))["cand_no"]
        pair = F.struct(best.alias("cand_no"), cap["cap_no"].alias("cap_no"))
        return F.when(F.size(free) == 0, taken).otherwise(F.concat(taken, F.array(pair)))

    start = F.expr("cast(array() AS array<struct<cand_no:int,cap_no:int>>)")
    both = caps.join(cands, ["doc_id", "page"])
    return both.select("doc_id", "page", F.inline(F.aggregate("caps", start, step)))


def attached_twice(candidates: DataFrame, captions: DataFrame) -> DataFrame:
    """attached() for table captions, then for figure captions over the regions that are left."""
    tables = attached(candidates, captions.where("kind = 'table'"))
    left = candidates.join(tables.select("doc_id", "page", "cand_no"), ["doc_id", "page", "cand_no"], "left_anti")
    return tables.union(attached(left, captions.where("kind = 'figure'")))


def overlap(words: Column, hay: Column) -> Column:
    return F.size(F.filter(words, lambda w: F.contains(hay, w)))


def haystack(header: Column, first_column: Column) -> Column:
    """The text of a grid by which captions are told apart: header cells and first column (arrays)."""
    return F.lower(collapse_ws(F.concat_ws(" ", F.array_join(header, " "), F.array_join(first_column, " "))))


def ownership(tables: DataFrame, captions: DataFrame) -> DataFrame:
    """tables (doc_id, table_no, kind, caption, hay) with belongs: false if the caption has no word in the grid while
    another caption of the kind has RIVAL_WORDS. A join of captions within one document."""
    rivals = captions.select("doc_id", "kind", F.col("text").alias("other")).distinct()
    most = (
        tables.select("doc_id", "table_no", "kind", "caption", "hay")
        .join(rivals, ["doc_id", "kind"])
        .where("other <> caption")
        .groupBy("doc_id", "table_no")
        .agg(F.max(overlap(caption_words(F.col("other")), F.col("hay"))).alias("rival"))
    )
    own = overlap(caption_words(F.col("caption")), F.col("hay"))
    return tables.join(most, ["doc_id", "table_no"], "left").withColumn(
        "belongs", (own > 0) | (F.coalesce("rival", F.lit(0)) < RIVAL_WORDS)
    ).drop("rival")


def unmatched_captions(captions: DataFrame, exported: DataFrame) -> DataFrame:
    """Captions whose key was not exported in their document."""
    return captions.join(exported.select("doc_id", "key").distinct(), ["doc_id", "key"], "left_anti")


def same_columns(a: Column, b: Column) -> Column:
    """Whether two header arrays name the same columns."""
    norm = lambda xs: F.transform(xs, lambda x: F.lower(collapse_ws(x)))
    return F.coalesce((F.size(a) > 0) & (norm(a) == norm(b)), F.lit(False))
