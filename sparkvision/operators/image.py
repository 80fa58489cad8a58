"""Image preparation: geometry, resampling, channel order, normalisation, tiling and batching.

Pixels are long: (image_id, y, x, c, value), channel 0 to 2, value 0 to 255. Resampling and tiling
work on rows of pixels as arrays (image_id, y, row): a row of the result meets the two rows of the source above and below
it, so an image of any size is spread over tasks and no pixel is shuffled by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILL = 114
#: Fixed values of the common normalisation, in red, green, blue order.
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def letterbox_geometry(images: DataFrame, out_w: int = 640, out_h: int = 640) -> DataFrame:
    """Adds ratio_x/y, new_w/h and pad_x/y: one scale that fits both sides, cut to whole pixels, padding halved."""
    scale = F.least(F.lit(out_w) / F.col("w"), F.lit(out_h) / F.col("h"))
    own = images.withColumn("ratio_x", scale).withColumn("ratio_y", scale)
    own = own.withColumn("new_w", (F.col("w") * F.col("ratio_x")).cast("int")).withColumn("new_h", (F.col("h") * F.col("ratio_y")).cast("int"))
    return own.withColumn("pad_x", ((F.lit(out_w) - F.col("new_w")) / 2).cast("int")).withColumn("pad_y", ((F.lit(out_h) - F.col("new_h")) / 2).cast("int"))


def linear_geometry(images: DataFrame, out_w: int = 640, out_h: int = 640) -> DataFrame:
    """Adds ratio_x/y for each side by itself; the whole output is the image."""
    own = images.withColumn("ratio_x", F.lit(out_w) / F.col("w")).withColumn("ratio_y", F.lit(out_h) / F.col("h"))
    return own.withColumns({"new_w": F.lit(out_w), "new_h": F.lit(out_h), "pad_x": F.lit(0), "pad_y": F.lit(0)})


def pixel_rows(pixels: DataFrame) -> DataFrame:
    """(image_id, y, row): the values of each row of pixels, by x and channel."""
    at = F.col("x") * 3 + F.col("c")
    own = pixels.groupBy("image_id", "y").agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), "value"))).alias("row"))
    return own.select("image_id", "y", F.transform("row", lambda s: s["value"]).alias("row"))


def resampled_rows(rows: DataFrame, geometry: DataFrame, fill: int = FILL) -> DataFrame:
    """(image_id, y, row): each image resampled to its own size, bilinear at pixel centres inside the padded region, cut to
    whole numbers; else fill. A row of the result is one array, made from the two of the source that it lies between. What
    lies on a row that is missing from the source, or has not w x 3 values, is null.
    rows: as of pixel_rows; geometry: image_id, w, h, new_w, new_h, pad_x, pad_y, out_w, out_h."""

    def source(at: Column, axis: str, n: str, new: str) -> Column:
        place = (at - F.col(f"pad_{axis}") + 0.5) * F.col(n) / F.col(new) - 0.5
        return F.greatest(F.lit(0.0), F.least(place, (F.col(n) - 1).cast("double")))

    def within_pad(at: Column, axis: str, new: str) -> Column:
        return (at >= F.col(f"pad_{axis}")) & (at < F.col(f"pad_{axis}") + F.col(new))

    line = geometry.select("image_id", "w", "h", "new_w", "new_h", "pad_x", "pad_y", "out_w", F.explode(F.sequence(F.lit(0), F.col("out_h") - 1)).alias("y"))
    line = line.withColumn("_s", source(F.col("y"), "y", "h", "new_h")).withColumn("_y0", F.floor("_s").cast("int"))
    line = line.withColumns({"_y9": F.least(F.col("_y0") + 1, F.col("h") - 1), "_fy": F.col("_s") - F.col("_y0")})
    for name, y in (("_top", "_y0"), ("_low", "_y9")):
        line = line.join(rows.select("image_id", F.col("y").alias(y), F.col("row").alias(name)), ["image_id", y], "left")
    # what all values of a line, or of a pixel, share is worked out once for these: functions of array elements run uncompiled
    whole = {name: F.when(F.size(name) == F.col("w") * 3, F.col(name)) for name in ("_top", "_low")}
    line = line.withColumns(whole | {"_inside": within_pad(F.col("y"), "y", "new_h"), "_up": 1 - F.col("_fy")})

    def tap(x: Column) -> Column:
        s = source(x, "x", "w", "new_w")
        first = F.floor(s).cast("int")
        own = F.struct((first * 3).alias("first"), (F.least(first + 1, F.col("w") - 1) * 3).alias("second"), (s - first).alias("right"), (1 - (s - first)).alias("left"))
        return F.when(within_pad(x, "x", "new_w"), own)

    def value(t: Column, c: int) -> Column:
        along = lambda row: F.get(row, t["first"] + c) * t["left"] + F.get(row, t["second"] + c) * t["right"]
        mixed = F.floor(F.round(along("_top") * F.col("_up") + along("_low") * F.col("_fy"), 6))
        return F.when(t.isNotNull(), mixed).otherwise(fill).cast("int")

    taps = F.transform(F.sequence(F.lit(0), F.col("out_w") - 1), tap)
    row = F.flatten(F.transform(taps, lambda t: F.array(*[value(t, c) for c in range(3)])))
    row = F.when(F.col("_inside"), row).otherwise(F.array_repeat(F.lit(fill).cast("int"), F.col("out_w") * 3))
    return line.select("image_id", "y", row.alias("row"))


def pixels_of(rows: DataFrame, *also: str) -> DataFrame:
    """(image_id, also, y, x, c, value) of rows of pixels."""
    # of an array that is only a column Spark asks for the size first, and works out the whole row for that once more
    places = F.when(F.size("row") > 0, F.sequence(F.lit(0), F.size("row") - 1))
    own = rows.select("image_id", *also, "y", "row", F.explode(places).alias("_i"))
    return own.select("image_id", *also, "y", F.floor(F.col("_i") / 3).cast("int").alias("x"), (F.col("_i") % 3).alias("c"), F.get("row", F.col("_i")).alias("value"))


def resampled(pixels: DataFrame, geometry: DataFrame, out_w: int | str, out_h: int | str, fill: int = FILL) -> DataFrame:
    """(image_id, y, x, c, value): as resampled_rows, from and to the long form. out_w and out_h hold for all images, or name
    columns of geometry."""
    size = {name: F.col(v) if isinstance(v, str) else F.lit(v) for name, v in (("out_w", out_w), ("out_h", out_h))}
    return pixels_of(resampled_rows(pixel_rows(pixels), geometry.withColumns(size), fill))


def channels_first(pixels: DataFrame, w: int, h: int, low: float = 0.0, high: float = 1.0, swap_rb: bool = True) -> DataFrame:
    """(image_id, idx, value): blue-green-red rows to planes, scaled to low..high; idx is the place in the flat tensor.
    Calibration keeps the channel order (swap_rb=False)."""
    c = (2 - F.col("c")) if swap_rb else F.col("c")
    return pixels.select("image_id", (c * w * h + F.col("y") * w + F.col("x")).alias("idx"), (F.col("value") * ((high - low) / 255) + low).alias("value"))


def checked(mean: tuple | None, std: tuple | None) -> None:
    """Both or none, with a value for each channel."""
    if (mean is None) != (std is None):
        raise ValueError("mean and std must be given together")
    if mean is not None and not len(mean) == len(std) == 3:
        raise ValueError("mean and std need three values each")


def normalised(pixels: DataFrame, w: int, h: int, mean: tuple = MEAN, std: tuple = STD) -> DataFrame:
    """As channels_first, with (value / 255 - mean) / std of each channel."""
    checked(mean, std)
    c = 2 - F.col("c")
    pick = lambda v: F.element_at(F.array(*[F.lit(float(x)) for x in v]), c + 1)
    return pixels.select("image_id", (c * w * h + F.col("y") * w + F.col("x")).alias("idx"), ((F.col("value") / 255 - pick(mean)) / pick(std)).alias("value"))


def current_settings(settings: DataFrame) -> DataFrame:
    """Of each model's settings (model, version, low, high, mean, std) the last version, by which its images are prepared from
    then on. Both or none of mean and std, with three values each; else an error."""
    last = settings.groupBy("model").agg(F.max_by(F.struct("low", "high", "mean", "std"), "version").alias("s")).select("model", "s.*")
    bad = (F.col("mean").isNull() != F.col("std").isNull()) | F.coalesce((F.size("mean") != 3) | (F.size("std") != 3), F.lit(False))
    return last.withColumn("mean", F.when(bad, F.raise_error(F.concat(F.lit("mean and std need three values each: "), F.col("model").cast("string"))).cast("array<double>")).otherwise(F.col("mean")))


def prepared(pixels: DataFrame, settings: DataFrame, w: int, h: int) -> DataFrame:
    """(image_id, idx, value): as channels_first or normalised, by the settings of each image's model. pixels: with model;
    settings: as current_settings gives them, a row a model."""
    c = 2 - F.col("c")
    own = pixels.join(settings, "model")
    ranged = F.col("value") * ((F.col("high") - F.col("low")) / 255) + F.col("low")
    value = F.when(F.col("mean").isNull(), ranged).otherwise((F.col("value") / 255 - F.get("mean", c)) / F.get("std", c))
    return own.select("image_id", (c * w * h + F.col("y") * w + F.col("x")).alias("idx"), value.alias("value"))


def preprocessed(pixels: DataFrame, images: DataFrame, out_w: int, out_h: int, method: str = "letterbox", mean: tuple | None = None, std: tuple | None = None, low: float = 0.0, high: float = 1.0, swap_rb: bool = True) -> DataFrame:
    """Geometry, resampling and normalisation in one plan."""
    if method not in ("letterbox", "linear"):
        raise ValueError(f"unknown method {method}")
    checked(mean, std)
    geometry = (letterbox_geometry if method == "letterbox" else linear_geometry)(images, out_w, out_h)
    small = resampled(pixels, geometry, out_w, out_h)
    return normalised(small, out_w, out_h, mean, std) if mean else channels_first(small, out_w, out_h, low, high, swap_rb)


def batched(images: DataFrame, batch_size: int, group: str, order: str) -> DataFrame:
    """Adds batch_id and place for consecutive images of a group; an incomplete last batch is left out."""
    own = images.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1)
    own = own.withColumn("batch_id", (F.col("_n") / batch_size).cast("int")).withColumn("place", F.col("_n") % batch_size)
    full = F.count("*").over(Window.partitionBy(group, "batch_id")) == batch_size
    return own.withColumn("_full", full).where("_full").drop("_n", "_full")


def starts(total: Column, size: int, step: int) -> Column:
    """Where tiles of `size` begin along `total`; the last one is moved back to the edge."""
    last = F.greatest(total - size, F.lit(0))
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(step)), F.array(last)))


def tiles(images: DataFrame, size: int = 640, overlap: float = 0.2) -> DataFrame:
    """(image_id, tile, x0, y0, tw, th): overlapping tiles, cut to the image."""
    step = max(1, int(size * (1 - overlap)))
    own = images.withColumn("y0", F.explode(starts(F.col("h"), size, step))).withColumn("x0", F.explode(starts(F.col("w"), size, step)))
    number = F.row_number().over(Window.partitionBy("image_id").orderBy("y0", "x0")) - 1
    return own.select("image_id", number.alias("tile"), "x0", "y0", F.least(F.lit(size), F.col("w") - F.col("x0")).alias("tw"), F.least(F.lit(size), F.col("h") - F.col("y0")).alias("th"))


def tile_detections_moved(dets: DataFrame) -> DataFrame:
    """Boxes of tiles in the image: plus the tile's offset, scaled by sx and sy, cut to whole pixels."""
    scale = {"x": F.col("sx"), "y": F.col("sy")}
    moved = {b: ((F.col(b) + F.col(f"{b[0]}0")) * scale[b[0]]).cast("int").cast("double") for b in ("x1", "y1", "x2", "y2")}
    return dets.withColumns(moved)


def patch_grid(images: DataFrame, size_w: int = 640, size_h: int = 640, overlap_x: float = 0.2, overlap_y: float = 0.2) -> DataFrame:
    """(image_id, w, h, nw, nh, tile, x0, y0, tw, th): patches of one size that cover the image resized to (nw, nh), the least
    size not below its own (or a patch's) that a whole number of steps fills. Tiles are numbered by rows."""
    own = patch_steps(images.select("image_id", "w", "h"), size_w, size_h, overlap_x, overlap_y)
    own = own.withColumn("tile", F.explode(F.sequence(F.lit(0), (F.col("_nx") + 1) * (F.col("_ny") + 1) - 1)))
    return patch_placed(own, size_w, size_h, overlap_x, overlap_y).select("image_id", "w", "h", "nw", "nh", "tile", "x0", "y0", F.lit(size_w).alias("tw"), F.lit(size_h).alias("th"))


def patch_step(size: int, overlap: float) -> int:
    return max(1, int(size * (1 - overlap)))


def patch_steps(images: DataFrame, size_w: int, size_h: int, overlap_x: float, overlap_y: float) -> DataFrame:
    """Adds to images (w, h) how many steps patches take (_nx, _ny), and the size that these fill (nw, nh)."""
    sides = {"x": ("w", size_w, patch_step(size_w, overlap_x)), "y": ("h", size_h, patch_step(size_h, overlap_y))}
    own = images.withColumns({f"_n{k}": F.ceil(F.greatest(F.col(a) - size, F.lit(0)) / step).cast("int") for k, (a, size, step) in sides.items()})
    return own.withColumns({f"n{a}": size + F.col(f"_n{k}") * step for k, (a, size, step) in sides.items()})


def patch_placed(rows: DataFrame, size_w: int, size_h: int, overlap_x: float, overlap_y: float) -> DataFrame:
    """Adds x0 and y0 of a patch by its number, tile, to rows with the image's steps: no patch meets another."""
    across, down = F.pmod("tile", F.col("_nx") + 1), F.floor(F.col("tile") / (F.col("_nx") + 1)).cast("int")
    return rows.withColumns({"x0": across * patch_step(size_w, overlap_x), "y0": down * patch_step(size_h, overlap_y)})


#: Rows of pixels in a cell of the grid by which rows meet the tiles that hold them.
CELL = 64


def patches(rows: DataFrame, tiles_: DataFrame, cell: int = CELL) -> DataFrame:
    """(image_id, tile, y, row): the pixels of each tile, as rows of it. Rows and tiles meet by image and cell of `cell` rows;
    of a row, a tile takes a slice of the array. rows: as of pixel_rows; tiles_: image_id, tile, x0, y0, tw, th."""
    cells = F.sequence(F.floor(F.col("y0") / cell), F.floor((F.col("y0") + F.col("th") - 1) / cell))
    spread = tiles_.where("th > 0 AND tw > 0").select("image_id", "tile", "x0", "y0", "tw", "th", F.explode(cells).alias("_cell"))
    own = rows.withColumn("_cell", F.floor(F.col("y") / cell)).join(spread, ["image_id", "_cell"]).where("y >= y0 AND y < y0 + th")
    return own.select("image_id", "tile", (F.col("y") - F.col("y0")).alias("y"), F.slice("row", F.col("x0") * 3 + 1, F.col("tw") * 3).alias("row"))


def image_patches(rows: DataFrame, images: DataFrame, size_w: int = 640, size_h: int = 640, overlap_x: float = 0.2, overlap_y: float = 0.2) -> DataFrame:
    """(image_id, tile, y, row): images of any sizes resized to what patches of one size cover, and cut into these."""
    grid = patch_grid(images, size_w, size_h, overlap_x, overlap_y)
    sizes = grid.select("image_id", "w", "h", "nw", "nh").distinct()
    geometry = sizes.select("image_id", "w", "h", F.col("nw").alias("new_w"), F.col("nh").alias("new_h"), F.lit(0).alias("pad_x"), F.lit(0).alias("pad_y"), F.col("nw").alias("out_w"), F.col("nh").alias("out_h"))
    return patches(resampled_rows(rows, geometry), grid)
