"""Domain tables made from the driver's tables by arithmetic alone (they hold no trajectories)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: 2024-01-01, and the length of a trajectory: ten days of a user.
ORIGIN_S, SPAN_S = 1_704_067_200, 864_000
BOX = (116.20, 39.75, 116.55, 40.05)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(traj_id, user_id, pos, t, lat, lon): the events as points, one trajectory a user and ten days."""
    events = table(spark, sf_dir, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    k = F.get_json_object("props", "$.k").cast("double")
    out = events.select(
        F.concat_ws("/", F.col("user_id").cast("string"), F.floor((t - ORIGIN_S) / SPAN_S).cast("string")).alias("traj_id"),
        "user_id",
        "ts",
        "event_id",
        t.alias("t"),
        (F.lit(39.75) + F.lit(0.30) * k / 100).alias("lat"),
        (F.lit(116.20) + F.lit(0.35) * F.least(F.col("value"), F.lit(200.0)) / 200).alias("lon"),
    )
    pos = F.row_number().over(Window.partitionBy("traj_id").orderBy("ts", "event_id")) - 1
    return out.withColumn("pos", pos).select("traj_id", "user_id", "pos", "t", "lat", "lon")


def as_arrays(long: DataFrame) -> DataFrame:
    """(traj_id, user_id, points): the working form, an ordered array of (lat, lon, t) for each trajectory."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "lat", "lon", "t")))
    return long.groupBy("traj_id", "user_id").agg(F.transform(ordered, lambda p: F.struct(p["lat"], p["lon"], p["t"])).alias("points"))


def as_long(arrays: DataFrame, column: str = "points") -> DataFrame:
    """The long form again."""
    return arrays.select("traj_id", "user_id", F.posexplode(column).alias("pos", "p")).select("traj_id", "user_id", "pos", "p.t", "p.lat", "p.lon")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, score, label): document lengths as scores of the quality label, with real ties."""
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return joined.select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("label"))
