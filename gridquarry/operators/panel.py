"""Grid geometry of figure panels. boxes: panel_id, box_no, x1, y1, x2, y2 (and score for suppress()).

All operators are keyed by panel_id; a panel's boxes are a few hundred, so a panel may be one array or one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------------------------------
MIN_CELLS, MIN_NATIVE_PX = 20, 10.5
MAX_IOU, SIDE_GAP, GIANT, TOLERANCE = 0.5, 2, 6, 0.6
#: Colour words of swatches with their red, green and blue.
SWATCHES = (
    ("dark green", 0, 100, 0),
    ("green", 60, 170, 70),
    ("light green", 150, 220, 150),
    ("gray", 128, 128, 128),
    ("yellow", 235, 215, 60),
    ("orange", 245, 160, 40),
    ("red", 215, 45, 45),
    ("blue", 60, 90, 215),
)
# -------------------------------------------------------------------------------------------------------------------


def suppress(boxes: DataFrame) -> DataFrame:
    """Non-maximum suppression: by falling score (ties by box_no), boxes that overlap no kept one by more than MAX_IOU.

    The choice depends on all boxes kept before, so a panel is one group in numpy: linear steps over arrays."""

    def keep(pdf):
        import numpy as np

        pdf = pdf.sort_values(["score", "box_no"], ascending=[False, True], kind="stable")
        b = pdf[["x1", "y1", "x2", "y2"]].to_numpy(float)
        area = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
        kept: list[int] = []
        for i in range(len(b)):
            k = b[kept]
            w = np.minimum(b[i, 2], k[:, 2]) - np.maximum(b[i, 0], k[:, 0])
            h = np.minimum(b[i, 3], k[:, 3]) - np.maximum(b[i, 1], k[:, 1])
            both = w * h
            with np.errstate(divide="ignore", invalid="ignore"):
                over = both / (area[i] + area[kept] - both) > MAX_IOU
            if not (over & (w > 0) & (h > 0)).any():
                kept.append(i)
        return pdf.iloc[kept]

    return boxes.groupBy("panel_id").applyInPandas(keep, boxes.schema)


def suppress_sql(boxes: DataFrame) -> DataFrame:
    """suppress() as a fold over one array a panel; slower, for checks."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "box_no", "x1", "y1", "x2", "y2", "score")))
    area = lambda b: (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])

    def clash(a: Column, b: Column) -> Column:
        w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
        h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
        return (w > 0) & (h > 0) & (w * h / (area(a) + area(b) - w * h) > MAX_IOU)

    panels = boxes.groupBy("panel_id").agg(order.alias("bs"))
    kept = F.aggregate("bs", F.slice("bs", 1, 0), lambda k, b: F.when(F.exists(k, lambda a: clash(a, b)), k).otherwise(F.concat(k, F.array(b))))
    return panels.select("panel_id", F.inline(kept)).select(*boxes.columns)


def _middle(boxes: DataFrame, value: Column, name: str) -> DataFrame:
    return boxes.groupBy("panel_id").agg(F.median(value).alias(name))


def split_panel(boxes: DataFrame) -> DataFrame:
    """boxes with dropped: right of the widest gap, if that is wider than twice the median width."""
    order = Window.partitionBy("panel_id").orderBy("x1", "box_no")
    end = F.max("x2").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gaps = boxes.withColumn("end", end).withColumn("n", F.row_number().over(order)).withColumn("gap", F.col("x1") - F.col("end"))
    best = gaps.groupBy("panel_id").agg(
        F.median(F.col("x2") - F.col("x1")).alias("med_w"),
        F.max(F.when(F.col("gap") > 0, F.struct("gap", (-F.col("n")).alias("n"), ((F.col("end") + F.col("x1")) / 2).alias("cut")))).alias("best"),
    )
    side = (F.col("best.gap") > SIDE_GAP * F.col("med_w")) & ((F.col("x1") + F.col("x2")) / 2 >= F.col("best.cut"))
    return boxes.join(best, "panel_id").withColumn("dropped", F.coalesce(side, F.lit(False))).drop("med_w", "best")


def drop_giants(boxes: DataFrame) -> DataFrame:
    """Boxes of less than six times the panel's median area."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return boxes.join(_middle(boxes, area, "med_a"), "panel_id").where(area < GIANT * F.col("med_a")).drop("med_a")


def bands(points: DataFrame, group: str = "panel_id", value: str = "c", tol: str = "tol") -> DataFrame:
    """group, band (from 0), center: single-link clusters of values, a new one where the gap exceeds tol."""
    order = Window.partitionBy(group).orderBy(value)
    new = F.coalesce(F.col(value) - F.lag(value).over(order) > F.col(tol), F.lit(False)).cast("int")
    marked = points.withColumn("new", new).withColumn("band", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(group, F.col("band").cast("int").alias("band")).agg(F.avg(value).alias("center"))


def _ordered(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("panel_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "center"))), lambda x: x["center"]).alias(name))


def _row_anchors(ys: Column, pitch: Column) -> Column:
    """Rows of equal pitch from sorted first-column centres: near ones merge, gaps get synthetic anchors."""

    def step(rows: Column, y: Column) -> Column:
        last = F.element_at(rows, -1)
        missing = F.ceil((y - last) / pitch - 1.5).cast("int")
        # anchors are running sums of the pitch, as if each was added to the one before
        made = F.aggregate(
            F.when(missing > 0, F.sequence(F.lit(1), missing)).otherwise(F.array().cast("array<int>")),
            rows,
            lambda acc, _: F.concat(acc, F.array(F.element_at(acc, -1) + pitch)),
        )
        return F.when(F.size(rows) == 0, F.array(y)).when(y - last < 0.5 * pitch, rows).otherwise(F.concat(made, F.array(y)))

    return F.aggregate(ys, F.array().cast("array<double>"), step)


def geometry(boxes: DataFrame) -> DataFrame:
    """panel_id, rows, cols (arrays of centres), pitch, med_w."""
    b = boxes.withColumn("cx", (F.col("x1") + F.col("x2")) / 2).withColumn("cy", (F.col("y1") + F.col("y2")) / 2)
    mid = b.groupBy("panel_id").agg(F.median(F.col("x2") - F.col("x1")).alias("med_w"), F.median(F.col("y2") - F.col("y1")).alias("med_h"))
    b = b.join(mid, "panel_id")
    cols = _ordered(bands(b.select("panel_id", F.col("cx").alias("c"), (F.col("med_w") * TOLERANCE).alias("tol"))), "cols")
    lines = bands(b.select("panel_id", F.col("cy").alias("c"), (F.col("med_h") * TOLERANCE).alias("tol")))
    gap = F.col("center") - F.lag("center").over(Window.partitionBy("panel_id").orderBy("band"))
    plain = _ordered(lines, "plain").join(lines.withColumn("gap", gap).groupBy("panel_id").agg(F.median("gap").alias("plain_gap")), "panel_id")
    first = b.join(cols, "panel_id").where(F.abs(F.col("cx") - F.col("cols")[0]) <= F.col("med_w") * TOLERANCE)
    step = F.col("cy") - F.lag("cy").over(Window.partitionBy("panel_id").orderBy("cy"))
    ys = first.withColumn("step", step).groupBy("panel_id").agg(
        F.array_sort(F.collect_list("cy")).alias("ys"), F.median(F.when(F.col("step") > 1, F.col("step"))).alias("step"), F.count_if(F.col("step") > 1).alias("n")
    )
    all_ = mid.join(cols, "panel_id").join(plain, "panel_id").join(ys, "panel_id")
    few = F.col("n") < 2
    return all_.select(
        "panel_id",
        F.when(few, F.col("plain")).otherwise(_row_anchors(F.col("ys"), F.col("step"))).alias("rows"),
        "cols",
        F.when(few, F.coalesce("plain_gap", "med_h")).otherwise(F.col("step")).alias("pitch"),
        "med_w",
    )


def _nearest(centers: Column, at: Column) -> Column:
    return F.array_min(F.transform(centers, lambda c, i: F.struct(F.abs(c - at).alias("far"), i.alias("i"))))


def snapped(boxes: DataFrame, geo: DataFrame) -> DataFrame:
    """boxes with i, j of the grid; strays beyond the tolerance on either axis are left out."""
    own = boxes.join(geo, "panel_id").withColumn("r", _nearest(F.col("rows"), (F.col("y1") + F.col("y2")) / 2)).withColumn("c", _nearest(F.col("cols"), (F.col("x1") + F.col("x2")) / 2))
    near = (F.col("r.far") <= TOLERANCE * F.col("pitch")) & (F.col("c.far") <= F.col("med_w") * TOLERANCE)
    return own.where(near).select(*boxes.columns, F.col("r.i").alias("i"), F.col("c.i").alias("j"))


def swatch_word(width: Column, height: Column, means: Column, stds: Column) -> Column:
    """The nearest colour word of a solid swatch from its channel means and deviations, else null."""
    chroma = F.array_max(means) - F.array_min(means)
    solid = (width >= 6) & (height >= 6) & (F.array_max(stds) <= 30) & ((chroma >= 25) | (F.array_min(means) <= 170))
    far = lambda rgb: sum((F.lit(float(v)) - means[i]) * (F.lit(float(v)) - means[i]) for i, v in enumerate(rgb))
    near = F.array_min(F.array(*[F.struct(far(rgb).alias("d"), F.lit(n).alias("n"), F.lit(word).alias("word")) for n, (word, *rgb) in enumerate(SWATCHES)]))
    return F.when(solid, near["word"])


def swatch_columns(placed: DataFrame) -> DataFrame:
    """panel_id, j of columns where half of the placed boxes or more lie in a cell with a swatch; of the boxes of a cell the last one's probe counts."""
    last = Window.partitionBy("panel_id", "i", "j").orderBy(F.desc("box_no"))
    probe = placed.withColumn("probe", F.first("swatch").over(last))
    share = F.avg(F.when(F.coalesce("probe", F.lit("")) != "", 1.0).otherwise(0.0))
    return probe.groupBy("panel_id", "j").agg(share.alias("share")).where("share >= 0.5").select("panel_id", "j")


def filled(placed: DataFrame, text: str = "text") -> DataFrame:
    """panel_id, i, j, value: texts of a cell's boxes in order of box_no, each unless the value holds it already."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("box_no", F.coalesce(F.col(text), F.lit("")).alias("t")))), lambda x: x["t"])
    value = F.aggregate(texts, F.lit(""), lambda v, t: F.when(F.contains(v, t), v).otherwise(F.trim(F.concat(v, F.lit(" "), t))))
    return placed.groupBy("panel_id", "i", "j").agg(value.alias("value"))


def shape_mismatch(det_rows: Column, det_cols: Column, n_rows: Column, n_cols: Column) -> Column:
    """A note where the detected grid and the rebuilt one differ in columns, or by two rows or more; else null."""
    pair = lambda what, a, b: F.format_string(f"{what} detected=%d/reconstructed=%d", a, b)
    bad = F.concat_ws(", ", F.when(det_cols != n_cols, pair("cols", det_cols, n_cols)), F.when(F.abs(det_rows - n_rows) > 1, pair("rows", det_rows, n_rows)))
    known = (det_rows > 0) & (det_cols > 0) & (n_rows > 0) & (n_cols > 0)
    return F.when(known & (bad != ""), F.concat(F.lit("grid_shape_mismatch("), bad, F.lit(")")))


def native_cell_height(med_h: Column, native_px: Column, rect_h: Column, dpi: float = 300.0) -> Column:
    """Native pixels of a cell; under MIN_NATIVE_PX a panel cannot be read."""
    return med_h * native_px / (rect_h * dpi / 72)


def page_gates(panels: DataFrame) -> DataFrame:
    """panels (n_cells, native_px null without a raster, caption_hits, image_hits arrays, searched boolean) with gate:
    the first reason to skip the panel ('' if none) and matched_on."""
    gate = (
        F.when(F.col("n_cells") < MIN_CELLS, "chart")
        .when(F.col("native_px") < MIN_NATIVE_PX, "low_resolution")
        .when(F.col("searched") & (F.size("caption_hits") == 0) & (F.size("image_hits") == 0), "no_match")
        .otherwise("")
    )
    on = F.when(~F.col("searched") | (gate != ""), "").when(F.size("caption_hits") > 0, "caption").otherwise("image_text")
    return panels.withColumn("gate", gate).withColumn("matched_on", on)
