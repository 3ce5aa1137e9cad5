"""Tables of the engine: column names, types and state constants."""

from __future__ import annotations

from pyspark.sql.types import ByteType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

UNBURNED, BURNING, BURNED = 0, 1, 2
GROUND_CLASS = 2
VEGETATION_CLASSES = (3, 4, 5)

POINTS = StructType([StructField("x", DoubleType()), StructField("y", DoubleType()), StructField("z", DoubleType()), StructField("classification", IntegerType())])
RASTER = StructType([StructField("raster_id", StringType()), StructField("band", IntegerType()), StructField("row", IntegerType()), StructField("col", IntegerType()), StructField("value", DoubleType())])
VOXELS = StructType([StructField("x", IntegerType()), StructField("y", IntegerType()), StructField("z", IntegerType()), StructField("state", ByteType()), StructField("fuel", DoubleType())])
STATS = StructType([StructField("step", IntegerType()), StructField("z", IntegerType()), StructField("unburned", LongType()), StructField("burning", LongType()), StructField("burned", LongType())])
