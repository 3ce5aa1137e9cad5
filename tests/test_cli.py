"""The command line on small inputs."""

import json
import os

from pyspark.sql import functions as F

from emberline import scratch
from emberline.__main__ import main
from emberline.sources import points


def test_density(spark, tmp_path):
    cloud = spark.range(3000).select((F.col("id") % 50).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"), (F.col("id") % 23).cast("double").alias("z"), (F.col("id") % 6).cast("int").alias("classification"))
    cloud.write.parquet(str(tmp_path / "cloud"))
    main(["density", str(tmp_path / "cloud"), "--out", str(tmp_path / "out")])
    pad = spark.read.parquet(str(tmp_path / "out/pad"))
    assert pad.where("pad < 0 OR pad > 10 OR nrd <= 0 OR nrd > 1").isEmpty()
    low = pad.groupBy("gx", "gy").agg(F.min_by("nrd", "bin").alias("nrd"))
    assert low.where("nrd <> 1").isEmpty()
    bins = spark.read.option("header", "true").option("inferSchema", "true").csv(str(tmp_path / "out/height_bins"))
    assert bins.agg(F.sum("n")).first()[0] == points.keep_classes(cloud, (3, 4, 5)).count()


def test_simulate_and_config(spark, tmp_path, capsys):
    main(["simulate", "--out", str(tmp_path / "s"), "--side", "10", "--steps", "1"])
    told = json.loads((tmp_path / "s/parameters.json").read_text())
    assert told["results"]["burned_percent"] > 0
    assert not spark.read.parquet(str(tmp_path / "s/history")).isEmpty()
    main(["config", "optimise", "--preset", "high_resolution", "--width", "50000", "--height-m", "50000", "--memory", "500", "--out", str(tmp_path / "c.json")])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["valid"]
    assert os.path.exists(tmp_path / "c.json")


def test_scratch_tables_can_be_dropped(spark):
    kept = scratch.stage(spark.range(3), "kept")
    gone = scratch.stage(spark.range(4), "gone")
    scratch.drop(gone)
    assert kept.count() == 3 and not os.path.exists(gone._scratch_path.removeprefix("file://"))
