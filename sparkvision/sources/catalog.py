"""The model catalogue, tables of models, and generated tensors."""

from __future__ import annotations

from collections.abc import Iterator
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Family, default size, input range, resize, mean/std normalisation, input and output layout, built-in suppression.
FAMILIES = (
    ("yolox", 640, "0:255", "letterbox", False, "YOLO", "EFFICIENT_NMS", True),
    ("yolov3", 640, "0:1", "letterbox", False, "YOLO", "EFFICIENT_NMS", True),
    ("yolov5", 640, "0:1", "letterbox", False, "YOLO", "EFFICIENT_NMS", True),
    ("yolov7", 640, "0:1", "letterbox", False, "YOLO", "EFFICIENT_NMS", False),
    ("yolov8", 640, "0:1", "letterbox", False, "YOLO", "EFFICIENT_NMS", True),
    ("yolov9", 640, "0:1", "letterbox", False, "YOLO", "EFFICIENT_NMS", False),
    ("yolov10", 640, "0:1", "letterbox", False, "YOLO", "YOLO_V10", False),
    ("yolov11", 640, "0:1", "letterbox", False, "YOLO", "EFFICIENT_NMS", True),
    ("yolov12", 640, "0:1", "letterbox", False, "YOLO", "EFFICIENT_NMS", True),
    ("yolov13", 640, "0:1", "letterbox", False, "YOLO", "EFFICIENT_NMS", True),
    ("yolov26", 640, "0:1", "letterbox", False, "YOLO", "YOLO_V10", False),
    ("deim", 640, "0:1", "letterbox", True, "RT_DETR", "DETR_LBS", False),
    ("deimv2", 640, "0:1", "letterbox", True, "RT_DETR", "DETR_LBS", False),
    ("rtdetrv1", 640, "0:255", "linear", False, "RT_DETR", "DETR_LBS", False),
    ("rtdetrv2", 640, "0:255", "linear", False, "RT_DETR", "DETR_LBS", False),
    ("rtdetrv3", 640, "0:255", "linear", False, "RT_DETR_V3", "RT_DETR_V3", False),
    ("dfine", 640, "0:1", "linear", True, "RT_DETR", "DETR_LBS", False),
    ("rfdetr", 576, "0:1", "letterbox", True, "RF_DETR", "RF_DETR", False),
)
#: Classifiers and depth estimators, and their default sizes; all take 0:1, linear and normalised input.
CLASSIFIERS = ("alexnet", "convnext", "densenet", "efficientnet", "efficientnetv2", "googlenet", "inception", "maxvit", "mnasnet", "mobilenetv2", "mobilenetv3", "regnet", "resnet", "resnext", "wideresnet", "shufflenetv2", "squeezenet", "swintransformer", "swintransformerv2", "vgg", "vit")
SIZES = {"inception": 299, "depth_anything_v2": 518}


def other_models(spark: SparkSession) -> DataFrame:
    """(family, task, imgsz) of classifiers and depth estimators."""
    rows = [(x, "classification", SIZES.get(x, 224)) for x in CLASSIFIERS] + [("depth_anything_v2", "depth", SIZES["depth_anything_v2"])]
    return spark.createDataFrame(rows, "family string, task string, imgsz int")


def model_families(spark: SparkSession) -> DataFrame:
    """One row for each model family's preset."""
    return spark.createDataFrame(list(FAMILIES), "family string, imgsz int, input_range string, resize string, normalised boolean, input_layout string, output_layout string, built_in_nms boolean")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(family, model, config): JSON files of model -> settings, one for each family, which is the file's name, or its folder's
    as write_catalog has it."""
    own = spark.read.text(path, wholetext=True)
    if "family" in own.columns:  # named, as its values could look like numbers
        own = spark.read.schema("value string, family string").text(path, wholetext=True)
    else:
        own = own.withColumn("family", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    return own.select("family", F.explode(F.from_json("value", "map<string, map<string, string>>")).alias("model", "config"))


def write_catalog(models: DataFrame, path: str) -> None:
    """(family, model, config) as one JSON file in a folder for each family."""
    own = models.groupBy("family").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("model", "config")))).alias("value"))
    own.write.mode("overwrite").partitionBy("family").text(path)


def supported_models(catalog: DataFrame) -> DataFrame:
    return catalog.select("model").distinct()


def merged_settings(base: Column, override: Column) -> Column:
    """Two maps of settings as one: the override's values count. Map columns of lists (hooks) are joined by appended()."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(override, k)), override)


def appended(base: Column, override: Column) -> Column:
    """Two maps of lists as one: lists under one key are joined, base first."""
    return F.map_zip_with(base, override, lambda _, a, b: F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))


def routed(name: Column, rules: list[tuple[str, str | None, str]]) -> Column:
    """The route of a model name: of the ordered rules (contains, but not, route) the first that fits; null if none."""
    out = [F.when(name.contains(a) & (~name.contains(b) if b else F.lit(True)), F.lit(route)) for a, b, route in rules]
    return F.coalesce(*out, F.lit(None).cast("string"))


MASK = np.uint64((1 << 32) - 1)
#: Elements of the tensors that a task makes at once; a single tensor may have more.
ELEMENTS = 1 << 20


def uniform(keys: np.ndarray, places: np.ndarray, seed: int) -> np.ndarray:
    """A number from 0 to below 1 for each key (0 to 2^31 - 1) and place, the same one each time: 24 bits of a 32-bit mixing of
    both with the seed, in whole numbers that any engine can follow."""
    u = np.uint64
    x = (keys.astype(u) * u(1103515245) + places.astype(u) * u(12345) + u(seed % (1 << 31) * 69069 + 1)) & MASK
    for _ in range(2):
        x = ((x ^ (x >> u(16))) * u(73244475)) & MASK
    return ((x ^ (x >> u(16))) >> u(8)) / float(1 << 24)


def whole(ids: DataFrame, key: str) -> Column:
    """The key that uniform() takes of an id."""
    own = F.col(key).cast("long") if ids.schema[key].dataType.typeName() in ("byte", "short", "integer", "long") else F.xxhash64(key)
    return F.pmod(own, F.lit(1 << 31))


def filled(rows: DataFrame, low: float = 0.0, high: float = 1.0, seed: int = 0) -> DataFrame:
    """rows without their last three columns _key, _n and _zero, with data: _n uniform values by _key and place, or zeros. Rows
    are few bytes and tensors many, so rows are dealt out anew before they are filled. A row with a null key has null values, one
    with a null number none."""
    kind = T.StructType([*rows.schema.fields[:-3], T.StructField("data", T.ArrayType(T.FloatType()))])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, n, zero = b.columns[-3:]
            null = ~key.is_valid().to_numpy(zero_copy_only=False)
            key, size, zero = (c.fill_null(0).to_numpy() for c in (key, n, zero.cast(pa.int8())))
            size = np.maximum(size, 0)
            end = np.cumsum(size)
            at = 0
            while at < len(size):
                to = max(at + 1, int(np.searchsorted(end, end[at] - size[at] + ELEMENTS, side="right")))
                own, first = size[at:to], end[at:to] - size[at:to]
                place = np.arange(own.sum()) - np.repeat(first - first[0], own)
                x = (uniform(np.repeat(key[at:to], own), place, seed) * (high - low) + low).astype(np.float32)
                zeros = zero[at:to] > 0
                x[np.repeat(zeros, own)] = 0
                values = pa.array(x, mask=np.repeat(null[at:to] & ~zeros, own)) if null[at:to].any() else pa.array(x)
                data = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(own)), pa.int32()), values)
                yield pa.RecordBatch.from_arrays([*b.slice(at, to - at).columns[:-3], data], names=kind.names)
                at = to

    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(parts).mapInArrow(fill, kind)


def uniform_sql(key: str, place: str, seed: int) -> str:
    """uniform() for DuckDB; key is an integer."""
    x = f"(({key} % 2147483648 + 2147483648) % 2147483648 * 1103515245 + {place} * 12345 + {seed % (1 << 31) * 69069 + 1} & 4294967295)"
    for _ in range(2):
        x = f"(xor({x}, {x} >> 16) * 73244475 & 4294967295)"
    return f"((xor({x}, {x} >> 16) >> 8) / 16777216.0::DOUBLE)"


def synthetic_batches(ids: DataFrame, shape: tuple[int, ...], low: float = 0.0, high: float = 1.0, seed: int = 0) -> DataFrame:
    """Adds shape and data: uniform values from the id, the place and the seed, the same ones each time."""
    n = prod(shape)
    if n < 1:
        raise ValueError("a batch needs at least one element")
    key = ids.columns[0]
    rows = ids.select(key, F.array(*map(F.lit, shape)).alias("shape"), whole(ids, key).alias("_key"), F.lit(n).cast("long").alias("_n"), F.lit(False).alias("_zero"))
    return filled(rows, low, high, seed)


def random_inputs(specs: DataFrame, seed: int = 0) -> DataFrame:
    """Adds data to (id, shape, dtype): 0 for whole-number types, else uniform values from 0 to 1 by the id, the place and the
    seed; so they are the same until another seed asks for new ones. The id is the first column."""
    key, n = specs.columns[0], F.aggregate("shape", F.lit(1).cast("long"), lambda a, d: a * d)
    zero = F.coalesce(F.col("dtype").rlike("^u?int"), F.lit(False))
    return filled(specs.select("*", whole(specs, key).alias("_key"), n.alias("_n"), zero.alias("_zero")), seed=seed)
