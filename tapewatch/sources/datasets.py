"""Stored window datasets, scalers, results and file manifests."""

from __future__ import annotations

import hashlib
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..config import DEFAULT, FEATURES, Settings
from ..operators.windows import fit_scaler, pretrain_pool, standardize, strided_windows, window_tensor


# ---------------------------------------------------------------- datasets
def write_dataset(win: DataFrame, stats: DataFrame | None, root: str) -> None:
    """Windows by mode and split, the train scaler of each mode, cleaning stats.

    Windows are written first and the scaler is fitted from the stored rows,
    so the tape is worked through once. Writing again replaces the splits that
    are written, so a repeated run changes nothing. ``stats`` has a row for
    each mode, told apart by ``mode``.
    """
    w = win.write.partitionBy("mode", "split").mode("overwrite").option("partitionOverwriteMode", "dynamic")
    w.parquet(f"{root}/windows")
    stored = win.sparkSession.read.parquet(f"{root}/windows")
    for m in [r["mode"] for r in stored.select("mode").distinct().collect()]:
        fit_scaler(stored.filter(F.col("mode") == m)).write.mode("overwrite").json(f"{root}/scaler/mode={m}")
    if stats is not None:
        s = stats.write.partitionBy("mode").mode("overwrite").option("partitionOverwriteMode", "dynamic")
        s.json(f"{root}/cleaning_stats")


def read_split(spark: SparkSession, root: str, mode: str, split: str) -> DataFrame:
    """One split of one mode; only its folder is opened."""
    w = spark.read.parquet(f"{root}/windows")
    return w.filter((F.col("mode") == mode) & (F.col("split") == split))


def read_stats(spark: SparkSession, root: str, mode: str) -> DataFrame:
    """Cleaning stats of one mode."""
    return spark.read.json(f"{root}/cleaning_stats").filter(F.col("mode") == mode)


def read_pool(spark: SparkSession, root: str, mode: str) -> DataFrame:
    return pretrain_pool(read_split(spark, root, mode, "train"))


def read_scaler(spark: SparkSession, root: str, mode: str) -> DataFrame:
    return spark.read.schema("feature string, mean double, std double").json(f"{root}/scaler/mode={mode}")


def scale_last(win: DataFrame, scaler: DataFrame) -> DataFrame:
    """End-bar features standardised with the train scaler."""
    w = win.select("pair", "end_ms", "y", "split", *[F.col(f"{x}_last").alias(x) for x in FEATURES])
    return standardize(w, scaler)


# ----------------------------------------------------------------- tensors
def write_tensors(feats: DataFrame, win: DataFrame, root: str, cfg: Settings = DEFAULT) -> None:
    """The tensor of each window of ``win``, beside its label: ``x`` holds bar after bar of ``FEATURES`` as floats.

    Every array has ``window_bars * len(FEATURES)`` values, so a reader can
    view a batch as one block. Stored by mode and split; the splits written
    are replaced. Only the bars of the windows are put into arrays.
    """
    kept = win.select("pair", "end_ms", "y", "mode", "split")
    place = strided_windows(feats, cfg).join(kept.select("pair", "end_ms"), ["pair", "end_ms"], "left_semi")
    x = window_tensor(feats, cfg, place).select("pair", "end_ms", F.flatten("x").alias("x"))
    w = kept.join(x, ["pair", "end_ms"]).select("pair", "end_ms", "y", "x", "mode", "split")
    w = w.write.partitionBy("mode", "split").mode("overwrite").option("partitionOverwriteMode", "dynamic")
    w.parquet(f"{root}/tensors")


def scale_tensors(tensors: DataFrame, scaler: DataFrame) -> DataFrame:
    """``x`` standardised: each value by the mean and deviation of its feature."""
    known = {r["feature"]: (r["mean"], r["std"]) for r in scaler.collect()}  # ten rows
    mean, std = (F.array(*[F.lit(known[f][i]) for f in FEATURES]) for i in (0, 1))
    at = lambda a, i: F.element_at(a, i % len(FEATURES) + 1)
    return tensors.withColumn("x", F.transform("x", lambda v, i: (v.cast("double") - at(mean, i)) / at(std, i)))


def read_tensors(spark: SparkSession, root: str, mode: str, split: str, scaled: bool = True) -> DataFrame:
    """Tensors of one split of one mode, standardised with the mode's train scaler; only their folder is opened."""
    x = spark.read.parquet(f"{root}/tensors").filter((F.col("mode") == mode) & (F.col("split") == split))
    return scale_tensors(x, read_scaler(spark, root, mode)) if scaled else x


def read_tensor_pool(spark: SparkSession, root: str, mode: str, scaled: bool = True) -> DataFrame:
    """Tensors of the unlabelled pool."""
    return pretrain_pool(read_tensors(spark, root, mode, "train", scaled)).drop("y")


def tensor_rows(tensors: DataFrame) -> DataFrame:
    """A row for each bar of each window: ``bar`` from 0 and a column for each feature."""
    n = len(FEATURES)
    keys = [c for c in tensors.columns if c != "x"]
    bars = F.transform(F.sequence(F.lit(0), (F.size("x") / n).cast("int") - 1), lambda i: F.slice("x", (i * n + 1).cast("int"), n))
    t = tensors.select(*keys, F.posexplode(bars).alias("bar", "v"))
    return t.select(*keys, "bar", *[F.col("v")[i].alias(f) for i, f in enumerate(FEATURES)])


# ----------------------------------------------------------------- results
def write_result(rows: DataFrame, root: str, mode: str) -> None:
    """One JSON file per run, in a folder named after its tag; a tag written again is replaced."""
    w = rows.withColumn("run", F.col("tag")).repartition("run").write.partitionBy("run")
    w.mode("overwrite").option("partitionOverwriteMode", "dynamic").json(f"{root}/{mode}")


def read_results(spark: SparkSession, root: str, mode: str) -> DataFrame:
    return spark.read.json(f"{root}/{mode}").drop("run")


def seed_tag(tag: Column) -> Column:
    """Tag without its ``_s<seed>`` end; fraction runs keep their name."""
    return F.regexp_replace(tag, r"_s\d+$", "")


def is_seed_run(tag: Column) -> Column:
    return tag.rlike(r"_s\d+$")


def latest_results(results: DataFrame) -> DataFrame:
    """Per base tag: the run of exactly that name, else the last seed in name order."""
    r = results.withColumn("base", seed_tag(F.col("tag")))
    exact = (F.col("tag") == F.col("base")).cast("int")
    w = W.partitionBy("base").orderBy(F.desc(exact), F.desc("tag"))
    return r.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


# ---------------------------------------------------------------- manifest
DIGEST_BYTES = 8 << 20  # of a file held at once
TASK_BYTES = 1 << 30  # of files to a task, about


def open_stream(path: str):
    """A file as Spark lists it, as a stream, through Arrow's file systems."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file" or not rest:
        return fs.LocalFileSystem().open_input_stream("/" + (rest or scheme).lstrip("/"))
    system, place = fs.FileSystem.from_uri(f"{scheme}:{quote(rest, safe='/:@')}")
    return system.open_input_stream(place)


def _digests(chunk: int):
    def run(batches):
        for b in batches:
            found = []
            for path in b.column(1).to_pylist():
                h = hashlib.sha256()
                with open_stream(path) as f:
                    while part := f.read(chunk):
                        h.update(part)
                found.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(found, pa.string())], ["grp", "path", "size", "sha256"])

    return run


def file_manifest(spark: SparkSession, groups: dict[str, str], chunk: int = DIGEST_BYTES) -> DataFrame:
    """(grp, path, size, sha256) of every file under each group's glob; ``path`` is the file's name.

    The listing is read without contents. Each file is digested as a stream,
    ``chunk`` bytes at a time, so its size is not limited; files are dealt by
    hash to as many tasks as their bytes need. Files without bytes are not
    listed by Spark and so not here.
    """
    parts = [spark.read.format("binaryFile").load(g).select(F.lit(n).alias("grp"), "path", F.col("length").alias("size")) for n, g in groups.items()]
    files = reduce(DataFrame.unionByName, parts)
    total = files.agg(F.sum("size")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    out = files.repartition(int(tasks), "path").mapInArrow(_digests(chunk), "grp string, path string, size bigint, sha256 string")
    return out.withColumn("path", F.regexp_extract("path", r"([^/]+)$", 1))


def manifest_diff(want: DataFrame, got: DataFrame) -> DataFrame:
    """Per group: missing, extra and changed files, and the verdict."""
    w = want.select("grp", "path", F.col("sha256").alias("a"))
    g = got.select("grp", "path", F.col("sha256").alias("b"))
    j = w.join(g, ["grp", "path"], "full_outer")
    n = lambda c: F.sum(c.cast("bigint"))
    out = j.groupBy("grp").agg(
        n(F.col("b").isNull()).alias("missing"),
        n(F.col("a").isNull()).alias("extra"),
        n(F.coalesce(F.col("a") != F.col("b"), F.lit(False))).alias("changed"),
    )
    bad = (F.col("missing") > 0) | (F.col("changed") > 0)
    return out.withColumn("status", F.when(bad, "MISMATCH").otherwise("OK"))


