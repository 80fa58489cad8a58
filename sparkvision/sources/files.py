"""Files read and written: images, profiles, benchmark stores, calibration batches, report tables, keyed caches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.benchmarks import stored

IMAGE_ENDINGS = ("jpg", "jpeg", "png")
METRICS = "struct<mean: double, median: double, min: double, max: double>"
#: What write_profile writes, but for raw values.
PROFILE = "run_id long, layers array<struct<place: long, layer: string, mean: double, median: double, minimum: double, maximum: double>>, iterations long, total_time struct<mean: double, median: double>"


def image_files(spark: SparkSession, folder: str, max_images: int | None = None) -> DataFrame:
    """(path, content) of the folder's own images, in no order: contents are never sorted. Endings count as they are written.
    max_images, if given, must be over 1 and keeps the first ones by path."""
    if max_images is not None and max_images <= 1:
        raise ValueError("max_images must be greater than 1")
    own = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path", "content")
    own = own.where(F.substring_index("path", ".", -1).isin(*IMAGE_ENDINGS))
    if max_images is not None:  # paths alone are sorted and limited; only then are contents read
        own = own.join(own.select("path").orderBy("path").limit(max_images), "path", "left_semi")
    return own


def decoded_images(files: DataFrame, decode: Callable[[bytes], tuple[int, int, bytes]]) -> DataFrame:
    """(path, height, width, n_channels, data): each file through a user's decoder, which gives height, width and the bytes
    of height x width x 3 blue-green-red values; None is a file that cannot be read, and an error."""
    schema = "path string, height int, width int, n_channels int, data binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b.path, b.content, strict=True):
                found = decode(bytes(content))
                if found is None:
                    raise FileNotFoundError(path)
                rows.append((path, found[0], found[1], 3, found[2]))
            yield pd.DataFrame(rows, columns=["path", "height", "width", "n_channels", "data"])

    return files.select("path", "content").mapInPandas(run, schema)


def pixels(images: DataFrame, key: str = "path") -> DataFrame:
    """The long form of decoded images: (image_id, y, x, c, value)."""
    at = F.col("at")
    byte = F.conv(F.hex(F.substring("data", at + 1, F.lit(1))), 16, 10).cast("int")
    own = images.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("height") * F.col("width") * 3 - 1)))
    return own.select(F.col(key).alias("image_id"), (at / (F.col("width") * 3)).cast("int").alias("y"), (at / 3).cast("int").alias("_p"), (at % 3).alias("c"), byte.alias("value"), "width").select("image_id", "y", (F.col("_p") % F.col("width")).alias("x"), "c", "value")


def scored(rows: DataFrame, model: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: T.StructType | str) -> DataFrame:
    """The place of a network: a user's function on batches of rows."""
    return rows.mapInPandas(model, schema)


#: Names of what scored_or_failed adds to the model's columns.
ERROR, INPUT = "error", "input"


#: Different values that a column may have in a batch so that failures are guessed from it.
FEW = 32
#: Rows that a model gets at once at most, and of a task's first ones.
PORTION, FIRST = 1000, 64


class Guess:
    """Which rows of a batch are likely to fail: those with a value with which all rows before failed, in a column of few
    values. It decides in what portions rows are tried, never what comes of them."""

    def __init__(self, names: list[str]):
        self.names, self.failed, self.passed = names, {n: set() for n in names}, {n: set() for n in names}

    def likely(self, batch: pd.DataFrame) -> np.ndarray:
        out = np.zeros(len(batch), bool)
        for n in self.names:
            if sure := self.failed[n] - self.passed[n]:
                out |= batch[n].isin(sure).to_numpy(bool)
        return out

    def learn(self, batch: pd.DataFrame, bad: np.ndarray) -> None:
        for n in list(self.names):
            try:
                values = pd.unique(batch[n].dropna())
            except TypeError:  # arrays and the like
                values = range(FEW + 1)
            if len(values) > FEW:
                self.names.remove(n)
                continue
            self.failed[n] |= set(batch[n][bad].dropna())
            self.passed[n] |= set(batch[n][~bad].dropna())


def scored_or_failed(rows: DataFrame, model: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """As scored, but a row on which the model raises costs nothing else: its result is null, `error` holds the exception and
    `input` the row. A batch that fails is halved until the failing rows stand alone; rows that look like those that failed
    before are tried alone at once, so that most calls are for rows that fail. The model must give each row's result
    from that row, as it may see a row more than once."""
    kind = T.StructType.fromDDL(schema)
    names, columns = [f.name for f in kind], rows.columns
    out = T.StructType([*kind, T.StructField(ERROR, T.StringType()), T.StructField(INPUT, rows.schema)])

    def tried(batch: pd.DataFrame, good: list[pd.DataFrame], lost: list[tuple[str, int]], at: int) -> None:
        try:
            good.extend(list(model(iter([batch]))))
        except Exception as e:  # noqa: BLE001  whatever the model raises
            if len(batch) == 1:
                lost.append((f"{type(e).__name__}: {e}", at))
                return
            half = len(batch) // 2
            tried(batch.iloc[:half], good, lost, at)
            tried(batch.iloc[half:], good, lost, at + half)

    def portions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = FIRST  # from the first few rows the others are guessed
        for batch in batches:
            at = 0
            while at < len(batch):
                yield batch.iloc[at : at + size].reset_index(drop=True)
                at, size = at + size, PORTION

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        guess = Guess(columns)
        for batch in portions(batches):
            good: list[pd.DataFrame] = []
            lost: list[tuple[str, int]] = []
            alone = guess.likely(batch)
            order = np.argsort(alone, kind="stable")
            own = batch.iloc[order].reset_index(drop=True) if alone.any() else batch
            first = len(batch) - int(alone.sum())
            if first:
                tried(own.iloc[:first], good, lost, 0)
            for i in range(first, len(batch)):
                tried(own.iloc[i : i + 1], good, lost, i)
            bad = np.zeros(len(batch), bool)
            bad[[i for _, i in lost]] = True
            if lost or any(guess.failed.values()):
                guess.learn(own, bad)
            if good:
                yield pd.concat(good)[names].assign(**{ERROR: None, INPUT: None})
            if lost:
                yield pd.DataFrame({n: [None] * len(lost) for n in names} | {ERROR: [e for e, _ in lost], INPUT: own.iloc[[i for _, i in lost]].to_dict("records")})

    return rows.mapInPandas(run, out)


def survived(rows: DataFrame, model: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """(results, dead letters, counts): runs the model once over all rows into a table at path, which holds both. The dead
    letters are rows with their error; counts has the numbers of `results` and of `failures`."""
    seen = Observation("survived")
    own = scored_or_failed(rows, model, schema)
    bad = F.col(ERROR).isNotNull()
    own.observe(seen, F.count(F.when(~bad, 1)).alias("results"), F.count(F.when(bad, 1)).alias("failures")).write.mode("overwrite").parquet(path)
    both = rows.sparkSession.read.schema(own.schema).parquet(path)
    return both.where(~bad).drop(ERROR, INPUT), both.where(bad).select(f"{INPUT}.*", ERROR), seen.get


def write_profile(profile: DataFrame, totals: DataFrame, path: str, save_raw: bool = False) -> None:
    """One JSON line a run: iterations, total time and its layers in order, with their raw values only if asked for."""
    names = ["place", "layer", "mean", "median", "minimum", "maximum", *(["raw"] if save_raw else [])]
    layers = profile.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("layers"))
    whole = totals.groupBy("run_id").agg(F.count("*").alias("iterations"), F.struct(F.avg("total").alias("mean"), F.median("total").alias("median")).alias("total_time"))
    layers.join(whole, "run_id").write.mode("overwrite").json(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(framework, model, key, metrics) of a nested JSON store: framework -> model -> key -> metrics."""
    own = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, map<string, map<string, {METRICS}>>>").alias("m"))
    own = own.select(F.explode("m").alias("framework", "m")).select("framework", F.explode("m").alias("model", "m"))
    return own.select("framework", "model", F.explode("m").alias("key", "metrics"))


def store_text(rows: DataFrame) -> DataFrame:
    """(folder, value): of each framework the nested JSON of its (framework, model, key, metrics), as one row of text."""
    own = rows.groupBy("framework", "model").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "metrics")))).alias("m"))
    own = own.groupBy("framework").agg(F.map_from_entries(F.collect_list(F.struct("model", "m"))).alias("m"))
    return own.select(F.col("framework").alias("folder"), F.to_json(F.create_map("framework", "m")).alias("value"))


def write_store(rows: DataFrame, path: str) -> None:
    """A folder for each framework, with one JSON file."""
    store_text(rows).write.mode("overwrite").partitionBy("folder").text(path)


def write_batches(batches: DataFrame, path: str) -> int:
    """Calibration batches (batch_id, shape, data) as Parquet; none is an error. Gives their number."""
    batches.write.mode("overwrite").parquet(path)
    n = batches.sparkSession.read.parquet(path).count()
    if not n:
        raise ValueError("there are no batches")
    return n


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def rst_table(rows: DataFrame, title: str, headers: list[str], order: list[str]) -> DataFrame:
    """(line_no, value) of a csv-table directive with the rows (text column `row`) below; the table is as small as a report."""
    head = [f".. csv-table:: {title}", "   :header: " + ",".join(f'"{h}"' for h in headers), ""]
    number = F.row_number().over(Window.orderBy(*order)) + len(head) - 1
    body = rows.select(number.alias("line_no"), F.concat(F.lit("   "), "row").alias("value"))
    return body.sparkSession.createDataFrame(list(enumerate(head)), "line_no int, value string").unionByName(body)


def write_rst(lines: DataFrame, path: str) -> None:
    lines.coalesce(1).sortWithinPartitions("line_no").select("value").write.mode("overwrite").text(path)


def found_in_cache(cache: DataFrame, name: str, endings: tuple[str, ...] = ("engine", "onnx", "cache")) -> DataFrame:
    """Entries (name, ext, payload) of a name, by the order of the endings."""
    place = F.array_position(F.array(*map(F.lit, endings)), F.col("ext"))
    return cache.where((F.col("name") == name) & (place > 0)).withColumn("_p", place).orderBy("_p").drop("_p")


def put_in_cache(cache: DataFrame, entries: DataFrame, overwrite: bool = False) -> DataFrame:
    return stored(cache, entries, ["name", "ext"], overwrite)


def removed_from_cache(cache: DataFrame, name: str, ext: str) -> DataFrame:
    """Without the entry; that it is missing is an error when the result is computed. What is joined is a single flag."""
    hit = (F.col("name") == name) & (F.col("ext") == ext)
    found = cache.where(hit).agg((F.count("*") > 0).alias("_found"))
    checked = F.when(F.col("_found"), hit).otherwise(F.raise_error(F.lit(f"not in the cache: {name}.{ext}")).cast("boolean"))
    return cache.crossJoin(F.broadcast(found)).where(~checked).drop("_found")


def first_in_cache(cache: DataFrame, asked: DataFrame, endings: tuple[str, ...] = ("engine", "onnx", "cache")) -> DataFrame:
    """(name, ext, payload) of each asked name: the entry whose ending comes first; nulls where there is none."""
    place = F.array_position(F.array(*map(F.lit, endings)), F.col("ext"))
    best = cache.withColumn("_p", place).where("_p > 0").groupBy("name").agg(F.min_by(F.struct("ext", "payload"), "_p").alias("_e"))
    return asked.select("name").distinct().join(best, "name", "left").select("name", "_e.ext", "_e.payload")


def entries_removed(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """Without the entries (name, ext); that one is missing is an error when the result is computed."""
    missing = entries.select("name", "ext").join(cache, ["name", "ext"], "left_anti")
    error = F.raise_error(F.concat(F.lit("not in the cache: "), "name", F.lit("."), "ext"))
    raised = missing.select(*[error.cast(f.dataType).alias(f.name) for f in cache.schema])
    return cache.join(entries.select("name", "ext").distinct(), ["name", "ext"], "left_anti").select(*cache.columns).unionByName(raised)
