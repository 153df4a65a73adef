"""Running sums and numbers over a whole table without sorting it in one task.

Rows are cut into ranges of the key at approximate quantiles; ranges are windows of their
own, and only one row of totals for each range (RANGES at most) is ordered as a whole.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import rng

RANGES = 256


def running(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Adds before_<c> for each numeric column: its sum over rows of a smaller key. Keys must be numbers, each on one row."""
    bounds = sorted(set(df.approxQuantile(key, [i / RANGES for i in range(1, RANGES)], 1 / (4 * RANGES))))
    cut = df.withColumn("__range", F.lit(0.0))
    if bounds:
        splits = [-float("inf"), *bounds, float("inf")]
        cut = Bucketizer(splits=splits, inputCol=key, outputCol="__range", handleInvalid="keep").transform(df)
    totals = cut.groupBy("__range").agg(*[F.sum(c).alias(f"__{c}") for c in columns])
    order = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__range", *[F.coalesce(F.sum(f"__{c}").over(order), F.lit(0)).alias(f"__{c}") for c in columns])
    within = Window.partitionBy("__range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.join(F.broadcast(starts), "__range")
    sums = {f"before_{c}": F.col(f"__{c}") + F.coalesce(F.sum(c).over(within), F.lit(0)) for c in columns}
    return out.withColumns(sums).drop("__range", *[f"__{c}" for c in columns])


def numbered(df: DataFrame, key: str) -> DataFrame:
    """Adds i, from 0 without gaps: the order is that of RANGES hash parts of the key, and of the key within."""
    cut = df.withColumn("__part", F.floor(rng.uniform("number", F.col(key)) * RANGES).cast("int"))
    order = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(order), F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(key)) - 1
    return cut.withColumn("__own", own).join(F.broadcast(starts), "__part").withColumn("i", (F.col("__start") + F.col("__own")).cast("int")).drop("__part", "__own", "__start")
