"""Tables that continue over pages. tables: doc_id, table_no, page, y0, header array<string>, caption, n_body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridquarry.functions.text import says_continued
from gridquarry.operators.regions import same_columns


def chains(tables: DataFrame) -> DataFrame:
    """tables with head_no (the table a fragment continues, or itself), seq in the chain, reason and drop_header.

    A fragment continues the chain before it if its page is at most one after the chain's last, and its caption says so
    or its header equals the header of the chain's head. The head decides, so it is a fold over a document's tables in
    order of (page, y0)."""
    one = F.struct("page", "y0", "table_no", "header", F.coalesce(says_continued(F.col("caption")), F.lit(False)).alias("said"))
    docs = tables.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("ts"))
    kind = "array<struct<table_no:int,head_no:int,seq:int,reason:string,drop_header:boolean,page:int,header:array<string>>>"

    def step(done: Column, t: Column) -> Column:
        last = F.element_at(done, -1)
        same = same_columns(last["header"], t["header"])
        reason = F.when((F.size(done) == 0) | (t["page"] - last["page"] > 1), F.lit(None)).when(t["said"], "caption_continued").when(same, "same_columns")
        on = reason.isNotNull()
        row = F.struct(
            t["table_no"].alias("table_no"),
            F.when(on, last["head_no"]).otherwise(t["table_no"]).alias("head_no"),
            F.when(on, last["seq"] + 1).otherwise(0).alias("seq"),
            reason.alias("reason"),
            (on & same).alias("drop_header"),
            t["page"].alias("page"),
            F.when(on, last["header"]).otherwise(t["header"]).alias("header"),
        )
        return F.concat(done, F.array(row.cast(kind[6:-1])))

    folded = docs.select("doc_id", F.inline(F.aggregate("ts", F.expr(f"cast(array() AS {kind})"), lambda a, t: F.when(F.size(a) == 0, step(F.slice(a, 1, 0), t)).otherwise(step(a, t)))))
    return tables.join(folded.select("doc_id", "table_no", "head_no", "seq", "reason", "drop_header"), ["doc_id", "table_no"])


def stitched(chained: DataFrame, grid: DataFrame) -> DataFrame:
    """doc_id, table_no (of the head), i, j, value: the rows of each chain's fragments one under another."""
    own = grid.join(chained.select("doc_id", "table_no", "head_no", "seq", "drop_header"), ["doc_id", "table_no"])
    own = own.where("NOT (drop_header AND i = 0)")
    i = F.dense_rank().over(Window.partitionBy("doc_id", "head_no").orderBy("seq", "i")) - 1
    return own.select("doc_id", F.col("head_no").alias("table_no"), i.cast("int").alias("i"), "j", "value")


def span_notes(chained: DataFrame) -> DataFrame:
    """doc_id, table_no, note of every continuation: spans_pages=first-last(reason)."""
    head = chained.where("seq = 0").select("doc_id", F.col("table_no").alias("head_no"), F.col("page").alias("first"))
    own = chained.where("seq > 0").join(head, ["doc_id", "head_no"])
    return own.select("doc_id", F.col("head_no").alias("table_no"), "seq", F.format_string("spans_pages=%d-%d(%s)", "first", "page", "reason").alias("note"))
