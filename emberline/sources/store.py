"""Sinks and a keyed store of tiles, on files that Spark reads and writes."""

from __future__ import annotations

import json
import traceback
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberline.scratch import delete


def write_csv(df: DataFrame, path: str) -> None:
    """One folder of CSV files with a header, as for bins, profiles and statistics."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_by(df: DataFrame, path: str, *columns: str) -> None:
    """A data set partitioned by columns: bins of a raster, steps of a history."""
    df.write.mode("overwrite").partitionBy(*columns).parquet(path)


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """A small report (parameters, summary, benchmark)."""
    write_text(spark, json.dumps(value, indent=2, default=str), path)


def write_bytes(spark: SparkSession, content: bytes, path: str) -> None:
    """A small file through the file system of the path."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(content))
    out.close()


def write_text(spark: SparkSession, text: str, path: str) -> None:
    write_bytes(spark, text.encode(), path)


def write_readme(spark: SparkSession, folder: str, outputs: dict[str, str]) -> None:
    """README.txt in folder: each output and what it holds."""
    lines = ["Results of a run", "", *[f"{name}: {what}" for name, what in sorted(outputs.items())]]
    write_text(spark, "\n".join(lines) + "\n", f"{folder.rstrip('/')}/README.txt")


@contextmanager
def error_log(spark: SparkSession, folder: str, fallback: str | None = None):
    """Write what goes wrong inside to error_log.txt in folder, or else in the fallback folder, and raise it."""
    try:
        yield
    except Exception:
        told = traceback.format_exc()
        try:
            write_text(spark, told, f"{folder.rstrip('/')}/error_log.txt")
        except Exception:
            if fallback is None:
                raise
            write_text(spark, told, f"{fallback.rstrip('/')}/error_log.txt")
        raise


def write_history(snaps: DataFrame, path: str) -> None:
    """Snapshots (step, x, y, z, state, fuel) in one folder for each step; steps that are there are replaced."""
    snaps.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("step").parquet(path)


def write_compressed(history: DataFrame, path: str, every: int) -> None:
    """A compressed history (step, kind, x, y, z, state) in one folder for each keyframe, which are `every` steps apart.

    A folder holds a full state and the changes up to the next, in order of step, so a state
    is read from one folder, and of its files from the parts up to that step.
    """
    keyed = history.withColumn("keyframe", (F.col("step") - F.col("step") % every).cast("int"))
    dealt = keyed.repartition("keyframe", F.floor(F.col("x") / 256), F.floor(F.col("y") / 256)).sortWithinPartitions("keyframe", "step")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("keyframe").parquet(path)


def reopen(spark: SparkSession, path: str, step: int | None = None) -> tuple[int, DataFrame]:
    """A step of a stored history, the last one unless named, and its state (x, y, z, state, fuel).

    Only the folder of that step is read, after a listing of the steps there are.
    """
    snaps = spark.read.parquet(path)
    there = sorted(r["step"] for r in snaps.select("step").distinct().collect())  # a row for each step
    if not there or (step is not None and step not in there):
        raise FileNotFoundError(f"no step {'' if step is None else step} in {path}")
    at = there[-1] if step is None else step
    return at, snaps.where(F.col("step") == at).drop("step")


class TileStore:
    """Tiles in one folder each; only what a tile asks for is read."""

    def __init__(self, spark: SparkSession, root: str, on_load=None, on_unload=None):
        """on_load(tile_x, tile_y) is called for a tile that get has found, on_unload for one that remove has dropped."""
        self.spark, self.root, self.on_load, self.on_unload = spark, root.rstrip("/"), on_load, on_unload

    def put(self, tiles: DataFrame) -> None:
        """Store rows with tile_x, tile_y; tiles that are there are replaced, others stay."""
        tiles.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tile_x", "tile_y").parquet(self.root)

    def get(self, tile_x: int, tile_y: int) -> DataFrame | None:
        found = self.keys().where((F.col("tile_x") == tile_x) & (F.col("tile_y") == tile_y))
        if found.isEmpty():
            return None
        if self.on_load:
            self.on_load(tile_x, tile_y)
        return self.spark.read.parquet(self.root).where((F.col("tile_x") == tile_x) & (F.col("tile_y") == tile_y))

    def _files(self) -> DataFrame:
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(self.root)
        part = lambda n: F.regexp_extract("path", rf"{n}=(-?\d+)", 1).cast("int").alias(n)
        return files.select(part("tile_x"), part("tile_y"), "length")

    def keys(self) -> DataFrame:
        try:
            return self._files().select("tile_x", "tile_y").distinct()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], "tile_x int, tile_y int")

    def info(self) -> DataFrame:
        """(tiles, bytes) of the store."""
        return self._files().agg(F.countDistinct("tile_x", "tile_y").alias("tiles"), F.sum("length").alias("bytes"))

    def remove(self, tile_x: int, tile_y: int) -> None:
        delete(self.spark, f"{self.root}/tile_x={tile_x}/tile_y={tile_y}")
        if self.on_unload:
            self.on_unload(tile_x, tile_y)

    def clear(self) -> None:
        delete(self.spark, self.root)
