"""Detections: decoding of raw network outputs, filters, greedy suppression of overlapping boxes.

Relations are long: one row per box, with image_id and a unique det_id in the image. Boxes are half-open (x1, y1, x2, y2).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOX = ("x1", "y1", "x2", "y2")


def confident(dets: DataFrame, conf: float | None) -> DataFrame:
    """Scores of at least conf; NaN is below any. Only None, not 0.0, means no threshold."""
    return dets if conf is None else dets.where((F.col("score") >= conf) & ~F.isnan("score"))


def unletterboxed(dets: DataFrame) -> DataFrame:
    """Boxes in the original image: less the padding, by the ratio, at least 0; no upper bound. Wants ratio_* and pad_*."""
    moved = {b: F.greatest((F.col(b) - F.col(f"pad_{b[0]}")) / F.col(f"ratio_{b[0]}"), F.lit(0.0)) for b in BOX}
    return dets.withColumns(moved)


def finite_boxes(dets: DataFrame) -> DataFrame:
    """Without boxes that hold NaN or an infinity."""
    ok = F.lit(True)
    for b in BOX:
        ok = ok & ~F.isnan(b) & (F.abs(F.col(b)) < float("inf"))
    return dets.where(ok)


def clipped_at_zero(dets: DataFrame) -> DataFrame:
    return dets.withColumns({b: F.greatest(F.col(b), F.lit(0.0)) for b in BOX})


def decode_end_to_end(dets: DataFrame, conf: float | None = None) -> DataFrame:
    """Networks that give (x1, y1, x2, y2, score, class) rows in network coordinates."""
    return unletterboxed(confident(dets, conf))


def decode_counted(dets: DataFrame, conf: float | None = None) -> DataFrame:
    """As decode_end_to_end, but of each image only the first num_dets rows by pos count."""
    return decode_end_to_end(dets.where("pos < num_dets"), conf)


def decode_transformer(dets: DataFrame, conf: float | None = None) -> DataFrame:
    """Networks whose boxes are in original coordinates already."""
    return clipped_at_zero(finite_boxes(confident(dets, conf)))


def decode_concatenated(rows: DataFrame, counts: DataFrame, conf: float | None = None) -> DataFrame:
    """One tensor of all images' rows (batch_id, pos, box, score, class_id) and counts (batch_id, image_id, n): an image's
    rows begin where those of the images before it end."""
    before = F.coalesce(F.sum("n").over(Window.partitionBy("batch_id").orderBy("image_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = counts.withColumn("_from", before).where("n > 0")
    more = [c for c in counts.columns if c not in ("batch_id", "n")]
    marks = spans.select("batch_id", F.col("_from").alias("pos"), F.struct(*more, "n", "_from").alias("_span"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    # each row takes the span that began last; two cannot begin at one place
    last = F.last("_span", ignorenulls=True).over(Window.partitionBy("batch_id").orderBy("pos", F.col("_span").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    held = both.withColumn("_own", last).where("_span IS NULL AND pos < _own._from + _own.n")
    return decode_transformer(held.select(*rows.columns, *[F.col(f"_own.{c}").alias(c) for c in more]), conf)


def decode_query_logits(logits: DataFrame, boxes: DataFrame, n_classes: int, size: int = 640, conf: float | None = None) -> DataFrame:
    """Query-based networks: logits (image_id, query, class_slot, x) and normalised centre boxes (image_id, query, cx, cy,
    bw, bh, ratio_*, pad_*). As many (query, class) pairs as there are queries stay, by score, then by place, both from
    the greatest; class 0 is the background, so classes are one less."""
    flat = logits.select("image_id", "query", (F.col("query") * n_classes + F.col("class_slot")).alias("flat_idx"), (1 / (1 + F.exp(-F.col("x")))).alias("score"), F.col("class_slot"))
    queries = F.max("query").over(Window.partitionBy("image_id")) + 1
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("score"), F.desc("flat_idx")))
    top = flat.withColumn("_n", queries).withColumn("rank", rank).where("rank <= _n")
    top = confident(top, conf).select("image_id", "query", "rank", "score", (F.col("class_slot") - 1).alias("class_id"))
    whole = top.join(boxes, ["image_id", "query"])
    corners = {"x1": F.col("cx") - F.col("bw") / 2, "y1": F.col("cy") - F.col("bh") / 2, "x2": F.col("cx") + F.col("bw") / 2, "y2": F.col("cy") + F.col("bh") / 2}
    return unletterboxed(whole.withColumns({k: v * size for k, v in corners.items()}))


def as_integers(dets: DataFrame, conf: float | None = 0.0) -> DataFrame:
    """Final detections: scores of at least conf, coordinates cut towards zero."""
    return confident(dets, 0.0 if conf is None else conf).withColumns({b: F.col(b).cast("int") for b in BOX})


def overlap(a: Column, b: Column) -> tuple[Column, Column]:
    """(intersection, union) of two box structs."""
    w = F.greatest(F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1), F.lit(0.0))
    h = F.greatest(F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1), F.lit(0.0))
    area = lambda k: (k.x2 - k.x1) * (k.y2 - k.y1)
    return w * h, area(a) + area(b) - w * h


def nms(dets: DataFrame, iou: float = 0.5, agnostic: bool = False, top_k: int | None = None) -> DataFrame:
    """Greedy suppression: by score from the greatest, then by det_id; a box goes if it overlaps a kept one of its image and
    class by more than iou. A fold over each group's sorted array, without Python; a group is the boxes of one image."""
    key = ["image_id"] if agnostic else ["image_id", "class_id"]
    one = F.struct((-F.col("score")).alias("order"), "det_id", "class_id", "score", *BOX)
    groups = dets.groupBy(*key).agg(F.array_sort(F.collect_list(one)).alias("boxes"))

    def step(kept: Column, b: Column) -> Column:
        def hides(k: Column) -> Column:
            inter, union = overlap(k, b)
            return inter > iou * union

        return F.when(F.exists(kept, hides), kept).otherwise(F.concat(kept, F.array(b)))

    kept = F.aggregate("boxes", F.filter("boxes", lambda _: F.lit(False)), step)
    out = groups.select("image_id", F.explode(kept).alias("b")).select("image_id", "b.det_id", "b.class_id", "b.score", *[f"b.{b}" for b in BOX])
    if top_k is None:
        return out
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("score"), "det_id"))
    return out.withColumn("_rank", rank).where(F.col("_rank") <= top_k).drop("_rank")


def suppressed_outputs(raw: DataFrame, score_threshold: float = 0.25, iou: float = 0.5, top_k: int = 100, agnostic: bool = False, centre: bool = True) -> DataFrame:
    """What a graph with built-in suppression gives: raw (image_id, anchor, class_id, class_score, objectness or null, box);
    scores are objectness x class where there is an objectness; centre boxes become corners."""
    own = raw.withColumn("score", F.coalesce(F.col("objectness"), F.lit(1.0)) * F.col("class_score")).withColumn("det_id", F.col("anchor") * 1000 + F.col("class_id"))
    if centre:
        own = own.select("image_id", "det_id", "class_id", "score", (F.col("b0") - F.col("b2") / 2).alias("x1"), (F.col("b1") - F.col("b3") / 2).alias("y1"), (F.col("b0") + F.col("b2") / 2).alias("x2"), (F.col("b1") + F.col("b3") / 2).alias("y2"))
    else:
        own = own.select("image_id", "det_id", "class_id", "score", *[F.col(f"b{i}").alias(b) for i, b in enumerate(BOX)])
    return nms(confident(own, score_threshold), iou, agnostic, top_k)


def adapted_predictions(dets: DataFrame, threshold: float) -> DataFrame:
    """For an external slicing framework: boxes inside the full image, without empty ones, with a category name."""
    own = confident(dets, threshold)
    own = own.withColumns({b: F.greatest(F.lit(0.0), F.least(F.col(b), F.col("w" if b[0] == "x" else "h").cast("double"))) for b in BOX})
    return own.where("x2 > x1 AND y2 > y1").withColumn("category", F.col("class_id").cast("string"))


#: The tensor names by which a layout is known.
INPUT_NAMES = {
    ("images",): "YOLO",
    ("input",): "RF_DETR",
    ("images", "orig_target_sizes"): "RT_DETR",
    ("im_shape", "image", "scale_factor"): "RT_DETR_V3",
}
OUTPUT_NAMES = {
    ("num_dets", "det_boxes", "det_scores", "det_classes"): "EFFICIENT_NMS",
    ("num", "boxes", "scores", "classes"): "EFFICIENT_NMS",
    ("output0",): "YOLO_V10",
    ("dets", "labels"): "RF_DETR",
    ("scores", "labels", "boxes"): "DETR",
    ("labels", "boxes", "scores"): "DETR_LBS",
    ("save_infer_model/scale_0.tmp_0", "save_infer_model/scale_1.tmp_0"): "RT_DETR_V3",
}


def by_names(names: Column, table: dict[tuple[str, ...], str], otherwise: Column) -> Column:
    return F.coalesce(*[F.when(names == F.array(*map(F.lit, key)), F.lit(layout)) for key, layout in table.items()], otherwise)


def input_layout(names: Column) -> Column:
    """The layout of an engine's inputs, by exact names, else by their number; null if there are not 1 to 3."""
    n = F.size(names)
    return by_names(names, INPUT_NAMES, F.when(n == 1, "YOLO").when(n == 2, "RT_DETR").when(n == 3, "RT_DETR_V3"))


def output_layout(names: Column) -> Column:
    """The layout of an engine's outputs, by exact names, else by their number; null if there are not 1 to 4."""
    n = F.size(names)
    two = F.when(F.exists(names, lambda x: x.contains("scale")), "RT_DETR_V3").otherwise("RF_DETR")
    return by_names(names, OUTPUT_NAMES, F.when(n == 4, "EFFICIENT_NMS").when(n == 1, "YOLO_V10").when(n == 2, two).when(n == 3, "DETR"))


def engine_inputs(images: DataFrame, layout: str, size: int = 640, preprocessed: bool = False) -> DataFrame:
    """The extra inputs that transformer layouts want: the original height and width (the network's own size for images
    that come preprocessed), and the scale factors for RT_DETR_V3."""
    h, w = (F.lit(size), F.lit(size)) if preprocessed else (F.col("h"), F.col("w"))
    kind = "float" if layout == "RT_DETR_V3" else "int"
    out = images.select("image_id", F.array(h, w).cast(f"array<{kind}>").alias("orig_size"), F.array(F.lit(size) / F.col("h"), F.lit(size) / F.col("w")).alias("scale_factor"))
    if layout == "RT_DETR_V3":
        return out
    return out.drop("scale_factor") if layout == "RT_DETR" else out.select("image_id")


#: By layout: what turns its rows into detections.
DECODERS = {"YOLO_V10": decode_end_to_end, "EFFICIENT_NMS": decode_counted, "DETR": decode_transformer, "DETR_LBS": decode_transformer}
