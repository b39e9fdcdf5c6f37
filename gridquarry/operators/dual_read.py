"""Merge of two reads of one grid. reads: grid_id, i, j, conservative, enhanced (missing cells as '' or null)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridquarry.functions.text import cell_norm, format_signature, strip


def joined(conservative: DataFrame, enhanced: DataFrame) -> DataFrame:
    """Two grids (grid_id, i, j, value) cell by cell."""
    a = conservative.withColumnRenamed("value", "conservative")
    return a.join(enhanced.withColumnRenamed("value", "enhanced"), ["grid_id", "i", "j"], "full").select(
        "grid_id", "i", "j", F.coalesce("conservative", F.lit("")).alias("conservative"), F.coalesce("enhanced", F.lit("")).alias("enhanced")
    )


def majority_formats(reads: DataFrame) -> DataFrame:
    """grid_id, j, majority: the format of more than half of a column's agreeing cells, if it has three or more."""
    a, b = F.col("conservative"), F.col("enhanced")
    agreed = reads.where((a != "") & (b != "") & (cell_norm(a) == cell_norm(b)) & (strip(b) != ""))
    counts = agreed.groupBy("grid_id", "j", format_signature(b).alias("sig")).agg(F.count("*").alias("n"))
    best = counts.groupBy("grid_id", "j").agg(F.sum("n").alias("total"), F.max(F.struct("n", "sig")).alias("best"))
    return best.where((F.col("total") >= 3) & (F.col("best.n") * 2 > F.col("total"))).select("grid_id", "j", F.col("best.sig").alias("majority"))


def merge(reads: DataFrame) -> DataFrame:
    """grid_id, i, j, value, flag: rows with fewer than two filled cells go after merging, and i is packed anew."""
    own = reads.select("grid_id", "i", "j", F.coalesce("conservative", F.lit("")).alias("conservative"), F.coalesce("enhanced", F.lit("")).alias("enhanced"))
    a, b = F.col("conservative"), F.col("enhanced")
    na, nb = cell_norm(a), cell_norm(b)
    both = (na != "") & (nb != "")
    fits_a, fits_b = format_signature(a) == F.col("majority"), format_signature(b) == F.col("majority")
    clear = F.coalesce(fits_a != fits_b, F.lit(False))
    flag = (
        F.when(both & (na != nb), F.when(clear, "conflict_format").otherwise("conflict_unresolved"))
        .when(nb != "", F.when(na != "", "agree").otherwise("b3_only"))
        .otherwise(F.when(na != "", "b2_only").otherwise(""))
    )
    value = F.when(both & (na != nb), F.when(clear & fits_a, a).otherwise(b)).when(nb != "", b).otherwise(a)
    cells = own.join(majority_formats(own), ["grid_id", "j"], "left").select("grid_id", "i", "j", value.alias("value"), flag.alias("flag"))
    held = F.count_if(strip(F.col("value")) != "").over(Window.partitionBy("grid_id", "i"))
    kept = cells.withColumn("held", held).where("held >= 2").drop("held")
    return kept.withColumn("i", (F.dense_rank().over(Window.partitionBy("grid_id").orderBy("i")) - 1).cast("int"))


def conflicts(merged: DataFrame) -> DataFrame:
    """grid_id, conflicts, unresolved of merged grids."""
    return merged.groupBy("grid_id").agg(
        F.count_if(F.col("flag").startswith("conflict")).alias("conflicts"), F.count_if(F.col("flag") == "conflict_unresolved").alias("unresolved")
    )
