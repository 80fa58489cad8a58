"""Queries over image operators: images of 4 x 6 pixels, and tiles and batches of the images table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detection, image
from . import views
from .detection_queries import nms_sql
from .registry import query


def resample_sql(out_w: int, out_h: int, w: int, h: int, new_w: int, new_h: int, pad_x: int, pad_y: int) -> str:
    """A resampled image in SQL: the four taps are joined one after another."""
    return f"""place AS (SELECT image_id, y, x, c, x >= {pad_x} AND x < {pad_x + new_w} AND y >= {pad_y} AND y < {pad_y + new_h} AS inside,
  greatest(0.0::DOUBLE, least((x - {pad_x} + 0.5::DOUBLE) * {w} / {new_w} - 0.5::DOUBLE, {w - 1})) AS sx, greatest(0.0::DOUBLE, least((y - {pad_y} + 0.5::DOUBLE) * {h} / {new_h} - 0.5::DOUBLE, {h - 1})) AS sy
  FROM (SELECT DISTINCT image_id FROM grid), (SELECT unnest(range({out_h})) AS y), (SELECT unnest(range({out_w})) AS x), (SELECT unnest([0, 1, 2]) AS c)),
taps AS (SELECT *, CAST(floor(sx) AS INT) AS x0, CAST(floor(sy) AS INT) AS y0, sx - floor(sx) AS fx, sy - floor(sy) AS fy FROM place),
small AS (SELECT t.image_id, t.y, t.x, t.c, CAST(CASE WHEN inside THEN floor(round((a.value * (1 - fx) + b.value * fx) * (1 - fy) + (d.value * (1 - fx) + e.value * fx) * fy, 6)) ELSE 114 END AS INT) AS value
  FROM taps t JOIN grid a ON a.image_id = t.image_id AND a.c = t.c AND a.y = y0 AND a.x = x0 JOIN grid b ON b.image_id = t.image_id AND b.c = t.c AND b.y = y0 AND b.x = least(x0 + 1, {w - 1})
  JOIN grid d ON d.image_id = t.image_id AND d.c = t.c AND d.y = least(y0 + 1, {h - 1}) AND d.x = x0 JOIN grid e ON e.image_id = t.image_id AND e.c = t.c AND e.y = least(y0 + 1, {h - 1}) AND e.x = least(x0 + 1, {w - 1}))"""


def unequal_sql(geometry: str) -> str:
    """Images of unequal sizes resampled, each to its own size: `geometry` selects image_id, w, h, nw, nh, px, py, ow, oh."""
    tap = lambda name, y, x: f"JOIN unequal {name} ON {name}.image_id = t.image_id AND {name}.c = t.c AND {name}.y = {y} AND {name}.x = {x}"
    return f"""geometry AS ({geometry}),
place AS (SELECT g.*, y, x, c, x >= px AND x < px + nw AND y >= py AND y < py + nh AS inside,
  greatest(0.0::DOUBLE, least((x - px + 0.5::DOUBLE) * w / nw - 0.5::DOUBLE, w - 1)) AS sx, greatest(0.0::DOUBLE, least((y - py + 0.5::DOUBLE) * h / nh - 0.5::DOUBLE, h - 1)) AS sy
  FROM (SELECT *, unnest(range(oh)) AS y FROM geometry) g, LATERAL (SELECT unnest(range(ow)) AS x), (SELECT unnest([0, 1, 2]) AS c)),
taps AS (SELECT *, CAST(floor(sx) AS INT) AS x0, CAST(floor(sy) AS INT) AS y0, sx - floor(sx) AS fx, sy - floor(sy) AS fy FROM place),
resized AS (SELECT t.image_id, t.y, t.x, t.c, CAST(CASE WHEN inside THEN floor(round((a.value * (1 - fx) + b.value * fx) * (1 - fy) + (d.value * (1 - fx) + e.value * fx) * fy, 6)) ELSE 114 END AS INT) AS value
  FROM taps t {tap("a", "y0", "x0")} {tap("b", "y0", "least(x0 + 1, w - 1)")} {tap("d", "least(y0 + 1, h - 1)", "x0")} {tap("e", "least(y0 + 1, h - 1)", "least(x0 + 1, w - 1)")})"""


LETTERBOXED = """SELECT *, (8 - nw) // 2 AS px, (8 - nh) // 2 AS py, 8 AS ow, 8 AS oh FROM (SELECT image_id, w, h, CAST(floor(w * least(8.0::DOUBLE / w, 8.0::DOUBLE / h)) AS INT) AS nw, CAST(floor(h * least(8.0::DOUBLE / w, 8.0::DOUBLE / h)) AS INT) AS nh FROM sizes)"""


@query(f"WITH {views.UNEQUAL}, {unequal_sql(LETTERBOXED)} SELECT image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(c AS INT) AS c, value FROM resized")
def letterbox_unequal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of four sizes in one batch, letterboxed."""
    rows, sizes = views.unequal(spark, sf_dir)
    geometry = image.letterbox_geometry(sizes, 8, 8).withColumns({"out_w": F.lit(8), "out_h": F.lit(8)})
    return image.pixels_of(image.resampled_rows(rows, geometry))


@query(f"WITH {views.UNEQUAL}, {unequal_sql('SELECT image_id, w, h, 7 AS nw, 5 AS nh, 0 AS px, 0 AS py, 7 AS ow, 5 AS oh FROM sizes')} SELECT image_id, CAST((2 - c) * 35 + y * 7 + x AS INT) AS idx, round(value / 255.0::DOUBLE, 6) AS value FROM resized")
def linear_unequal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of four sizes in one batch, stretched and as planes."""
    rows, sizes = views.unequal(spark, sf_dir)
    own = image.preprocessed(image.pixels_of(rows), sizes, 7, 5, "linear")
    return own.select("image_id", F.col("idx").cast("int").alias("idx"), F.round("value", 6).alias("value"))


PATCHES = f"""{views.UNEQUAL}, {unequal_sql("SELECT *, nw AS ow, nh AS oh FROM (SELECT image_id, w, h, 4 + 3 * CAST(ceil(greatest(w - 4, 0) / 3) AS INT) AS nw, 4 + 3 * CAST(ceil(greatest(h - 4, 0) / 3) AS INT) AS nh, 0 AS px, 0 AS py FROM sizes)")},
tiles AS (SELECT image_id, ty * ((nw - 4) // 3 + 1) + tx AS tile, tx * 3 AS x0, ty * 3 AS y0 FROM (SELECT *, unnest(range((nh - 4) // 3 + 1)) AS ty FROM geometry) g, LATERAL (SELECT unnest(range((nw - 4) // 3 + 1)) AS tx))"""


@query(f"WITH {PATCHES} SELECT t.image_id, CAST(tile AS INT) AS tile, CAST(y - y0 AS INT) AS y, CAST(x - x0 AS INT) AS x, CAST(c AS INT) AS c, value FROM tiles t JOIN resized r ON r.image_id = t.image_id AND y >= y0 AND y < y0 + 4 AND x >= x0 AND x < x0 + 4")
def image_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels of all patches of images of four sizes, each resized to what whole steps cover."""
    own = image.pixels_of(image.image_patches(*views.unequal(spark, sf_dir), 4, 4, 0.25, 0.25), "tile")
    return own.withColumn("y", F.col("y").cast("int"))


def small_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(4).alias("w"), F.lit(6).alias("h"))


@query(f"WITH {views.GRID}, {resample_sql(8, 8, 4, 6, 5, 8, 1, 0)} SELECT image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, c, value FROM small")
def letterbox_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    geometry = image.letterbox_geometry(small_images(spark, sf_dir), 8, 8)
    return image.resampled(views.grid(spark, sf_dir), geometry, 8, 8)


@query(f"WITH {views.GRID}, {resample_sql(6, 3, 4, 6, 6, 3, 0, 0)} SELECT image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, c, value FROM small")
def linear_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    geometry = image.linear_geometry(small_images(spark, sf_dir), 6, 3)
    return image.resampled(views.grid(spark, sf_dir), geometry, 6, 3)


@query(f"WITH {views.GRID} SELECT image_id, CAST((2 - c) * 24 + y * 4 + x AS INT) AS idx, round(value * (2.0::DOUBLE / 255) - 1, 6) AS value FROM grid")
def channels_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = image.channels_first(views.grid(spark, sf_dir), 4, 6, -1.0, 1.0)
    return own.select("image_id", F.col("idx").cast("int").alias("idx"), F.round("value", 6).alias("value"))


@query(f"WITH {views.GRID} SELECT image_id, CAST((2 - c) * 24 + y * 4 + x AS INT) AS idx, round((value / 255.0::DOUBLE - [0.485, 0.456, 0.406][3 - c]) / [0.229, 0.224, 0.225][3 - c], 6) AS value FROM grid")
def channel_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = image.normalised(views.grid(spark, sf_dir), 4, 6)
    return own.select("image_id", F.col("idx").cast("int").alias("idx"), F.round("value", 6).alias("value"))


@query(f"WITH {views.GRID}, {resample_sql(6, 6, 4, 6, 4, 6, 1, 0)} SELECT image_id, CAST(c * 36 + y * 6 + x AS INT) AS idx, round(value / 255.0::DOUBLE, 6) AS value FROM small")
def calibration_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preparation of calibration images, which keeps the channel order."""
    own = image.preprocessed(views.grid(spark, sf_dir), small_images(spark, sf_dir), 6, 6, swap_rb=False)
    return own.select("image_id", F.col("idx").cast("int").alias("idx"), F.round("value", 6).alias("value"))


@query("""WITH o AS (SELECT o_custkey AS stream_id, o_orderkey AS image_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders),
b AS (SELECT stream_id, image_id, CAST(n // 4 AS INT) AS batch_id, CAST(n % 4 AS INT) AS place, count(*) OVER (PARTITION BY stream_id, n // 4) AS c FROM o)
SELECT stream_id, image_id, batch_id, place FROM b WHERE c = 4""")
def image_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("stream_id"), F.col("o_orderkey").alias("image_id"))
    return image.batched(own, 4, "stream_id", "image_id").select("stream_id", "image_id", "batch_id", "place")


TILES = (
    views.IMAGES
    + """, ys AS (SELECT DISTINCT image_id, w, h, least(k * 512, greatest(h - 640, 0)) AS y0 FROM images, (SELECT unnest(range(8)) AS k) WHERE k * 512 <= greatest(h - 640, 0) + 511),
xs AS (SELECT DISTINCT image_id, least(k * 512, greatest(w - 640, 0)) AS x0 FROM images, (SELECT unnest(range(8)) AS k) WHERE k * 512 <= greatest(w - 640, 0) + 511),
tiles AS (SELECT ys.image_id, CAST(row_number() OVER (PARTITION BY ys.image_id ORDER BY y0, x0) - 1 AS INT) AS tile, CAST(x0 AS INT) AS x0, CAST(y0 AS INT) AS y0, CAST(least(640, w - x0) AS INT) AS tw, CAST(least(640, h - y0) AS INT) AS th FROM ys JOIN xs ON xs.image_id = ys.image_id)"""
)


@query(f"WITH {TILES} SELECT * FROM tiles")
def image_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image.tiles(views.images(spark, sf_dir)).withColumn("x0", F.col("x0").cast("int")).withColumn("y0", F.col("y0").cast("int"))


@query(f"""WITH RECURSIVE {views.RAW_DET}, {TILES},
found AS (SELECT t.image_id, CAST(tile * 10000 + det_id AS INT) AS det_id, CAST(trunc((x1 + x0) * 1.0) AS DOUBLE) AS x1, CAST(trunc((y1 + y0) * 1.0) AS DOUBLE) AS y1, CAST(trunc((x2 + x0) * 1.0) AS DOUBLE) AS x2, CAST(trunc((y2 + y0) * 1.0) AS DOUBLE) AS y2, score, class_id
  FROM raw_det r JOIN tiles t ON t.image_id = r.image_id WHERE score >= 0.6), {nms_sql("image_id, class_id", "found")}
SELECT image_id, det_id, class_id, score, x1, y1, x2, y2 FROM nms""")
def tile_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes found in every tile of their image, moved to the image and suppressed together."""
    tiles = image.tiles(views.images(spark, sf_dir)).withColumns({"sx": F.lit(1.0), "sy": F.lit(1.0)})
    own = views.raw_det(spark, sf_dir).where("score >= 0.6").join(tiles, "image_id").withColumn("det_id", (F.col("tile") * 10000 + F.col("det_id")).cast("int"))
    return detection.nms(image.tile_detections_moved(own), 0.5)


@query(f"""WITH RECURSIVE {views.RAW_DET}, {views.IMAGES},
grid AS (SELECT image_id, w, h, CAST(ceil(greatest(w - 640, 0) / 512) AS INT) AS nx, CAST(ceil(greatest(h - 480, 0) / 360) AS INT) AS ny FROM images),
tiled AS (SELECT r.*, nx, ny, w * 1.0::DOUBLE / (640 + nx * 512) AS sx, h * 1.0::DOUBLE / (480 + ny * 360) AS sy, det_id % ((nx + 1) * (ny + 1)) AS tile FROM raw_det r JOIN grid g ON g.image_id = r.image_id),
found AS (SELECT image_id, det_id, trunc((x1 + tile % (nx + 1) * 512) * sx) AS x1, trunc((y1 + tile // (nx + 1) * 360) * sy) AS y1, trunc((x2 + tile % (nx + 1) * 512) * sx) AS x2, trunc((y2 + tile // (nx + 1) * 360) * sy) AS y2, score, class_id FROM tiled), {nms_sql("image_id, class_id", "found")}
SELECT image_id, det_id, class_id, score, x1, y1, x2, y2 FROM nms""")
def patch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes found in one patch each, moved and scaled from the resized image back to the image, and suppressed together."""
    shape = (640, 480, 0.2, 0.25)
    own = image.patch_steps(views.raw_det(spark, sf_dir).join(views.images(spark, sf_dir), "image_id"), *shape)
    own = image.patch_placed(own.withColumn("tile", F.col("det_id") % ((F.col("_nx") + 1) * (F.col("_ny") + 1))), *shape)
    own = own.withColumns({"sx": F.col("w") / F.col("nw"), "sy": F.col("h") / F.col("nh")})
    return detection.nms(image.tile_detections_moved(own), 0.5)


@query(f"""WITH {views.GRID}, settings AS (SELECT s_suppkey % 8 AS model, s_suppkey AS version, CAST(-(s_suppkey % 2) AS DOUBLE) AS low, 1.0::DOUBLE AS high, CASE WHEN s_suppkey % 3 = 0 THEN [0.4, 0.5, s_suppkey / 2000.0::DOUBLE] END AS mean FROM supplier),
last_ AS (SELECT * FROM settings QUALIFY row_number() OVER (PARTITION BY model ORDER BY version DESC) = 1)
SELECT image_id, CAST((2 - c) * 24 + y * 4 + x AS INT) AS idx, round(CASE WHEN mean IS NULL THEN value * ((high - low) / 255) + low ELSE (value / 255.0::DOUBLE - mean[3 - c]) / 0.25::DOUBLE END, 6) AS value
FROM grid JOIN last_ ON model = image_id % 8""")
def reconfigured_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images prepared by their models' last settings: a range, or mean and deviation of each channel."""
    third = F.col("s_suppkey") % 3 == 0
    settings = views.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 8).alias("model"), F.col("s_suppkey").alias("version"), (-(F.col("s_suppkey") % 2)).cast("double").alias("low"), F.lit(1.0).alias("high"),
        F.when(third, F.array(F.lit(0.4), F.lit(0.5), F.col("s_suppkey") / 2000)).alias("mean"), F.when(third, F.array(F.lit(0.25), F.lit(0.25), F.lit(0.25))).alias("std"))
    own = views.grid(spark, sf_dir).withColumn("model", F.col("image_id") % 8)
    out = image.prepared(own, image.current_settings(settings), 4, 6)
    return out.select("image_id", F.col("idx").cast("int").alias("idx"), F.round("value", 6).alias("value"))
