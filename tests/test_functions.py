"""Closed-form values."""

import math

import pytest
from pyspark.sql import functions as F

from emberline.functions import fire, heights, rng


def values(spark, column, inputs):
    rows = spark.createDataFrame([(float(x),) for x in inputs], "x double")
    return [r[0] for r in rows.select(column(F.col("x"))).collect()]


def test_plant_area_density(spark):
    found = values(spark, heights.plant_area_density, [0, 0.05, 0.1, 0.25, 0.5, 0.9, 0.99995, 1])
    assert found == pytest.approx([0, 0.1, 0.1, 0.239735, 0.577623, 1.918821, 7.675284, 7.675284], abs=1e-6)


def test_sigmoid(spark):
    assert values(spark, fire.sigmoid, [0, 1, 2, 3, 4, 8]) == pytest.approx([0.182426, 0.5, 0.817574, 0.952574, 0.989013, 0.999972], abs=1e-6)


def test_connectivity(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (0.5, 0.5), (1.0, 1.0), (1.0, 0.0), (0.2, 0.4)], "a double, b double")
    found = [r[0] for r in rows.select(fire.connectivity(F.col("a"), F.col("b"))).collect()]
    assert found == pytest.approx([0.58, 0.74, 0.9, 0.100007, 0.518610], abs=1e-6)


def test_labels_with_negative_edges(spark):
    rows = spark.range(-2, 2).select(heights.bin_label(F.col("id")).alias("l"))
    assert [r[0] for r in rows.select(heights.label_low(F.col("l"))).collect()] == [-4.0, -2.0, 0.0, 2.0]


def test_top_edge_is_in_the_last_bin(spark):
    from emberline.operators.structure import height_bins

    found = height_bins(spark.createDataFrame([(0.0,), (1.9,), (4.0,)], "z double")).orderBy("bin").collect()
    assert [(r.bin, r.n) for r in found] == [(0, 2), (1, 1)]


def test_uniform_is_uniform_and_repeats(spark):
    a = [r[0] for r in spark.range(4000).select(rng.uniform(1, "k", F.col("id"))).collect()]
    b = [r[0] for r in spark.range(4000).repartition(7).select(rng.uniform(1, "k", F.col("id")).alias("u"), "id").orderBy("id").collect()]
    assert a == b and 0 <= min(a) and max(a) < 1
    assert sum(a) / 4000 == pytest.approx(0.5, abs=0.02)


def test_normal_has_mean_and_deviation(spark):
    r = spark.range(4000).select(rng.normal(1, F.col("id")).alias("n")).agg(F.avg("n"), F.stddev("n")).first()
    assert abs(r[0]) < 0.06 and abs(r[1] - 1) < 0.06


def test_compass_to_angle(spark):
    assert values(spark, fire.met_degrees_to_radians, [0, 90, 180]) == pytest.approx([math.pi / 2, 0, 1.5 * math.pi])
