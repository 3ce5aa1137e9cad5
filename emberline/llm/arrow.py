"""Small helpers of the Arrow operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType, _parse_datatype_string


def widened(df: DataFrame, ddl: str) -> StructType:
    """The schema of df with further columns."""
    return StructType([*df.schema.fields, *_parse_datatype_string(ddl).fields])


def free(df: DataFrame, *names: str) -> list[str]:
    """These names, each with as many underscores as it takes to be none of df's, however they are written."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def own_partitions(spark: SparkSession, n: int) -> np.ndarray:
    """A number for each of n parts that hash partitioning into n sends to a partition of its own.

    The driver holds n numbers; where no number is found the part shares one.
    """
    number = F.col("id").cast("int")
    free = spark.range(24 * n).groupBy(F.pmod(F.hash(number), F.lit(n)).alias("p")).agg(F.min(number).alias("place")).collect()
    found, left = {r["p"]: r["place"] for r in free}, iter(range(24 * n, 25 * n))
    return np.array([found[p] if p in found else next(left) for p in range(n)], np.int32)
