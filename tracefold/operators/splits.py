"""Users in seeded order: subsamples and splits."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rng

SPLITS = ("train", "test", "shadow", "attack")


def largest_remainder(n: int, fractions: Mapping[str, float]) -> dict[str, int]:
    """Whole shares of n: floors, then one more to the largest remainders, earlier splits first among equals."""
    quota = {s: fractions.get(s, 0.0) * n for s in SPLITS}
    out = {s: int(q + 1e-9) for s, q in quota.items()}
    for s in sorted(SPLITS, key=lambda s: (-(quota[s] - out[s]), SPLITS.index(s)))[: n - sum(out.values())]:
        out[s] += 1
    return out


def ranked_users(df: DataFrame, seed: int, purpose: str) -> DataFrame:
    """(user_id, rank): every user once, ranked from 1 by a seeded hash.

    Ranks come in two steps so that no task sorts all users: counts of hash ranges are
    summed (256 rows), and each range ranks its own users.
    """
    users = df.select("user_id").distinct().withColumn("u", rng.uniform(seed, purpose, F.col("user_id"))).withColumn("part", F.floor(F.col("u") * 256).cast("int"))
    sizes = users.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("u", "user_id"))
    return users.withColumn("r", own).join(F.broadcast(before), "part").select("user_id", (F.col("r") + F.col("before")).alias("rank"))


def subsample_users(df: DataFrame, max_users: int, seed: int) -> DataFrame:
    """Rows of the first max_users users in seeded order; a larger number keeps the smaller one's users."""
    chosen = ranked_users(df, seed, "subsample").where(F.col("rank") <= max_users).select("user_id")
    return df.join(chosen, "user_id", "left_semi")


def split_by_user(df: DataFrame, fractions: Mapping[str, float], seed: int) -> DataFrame:
    """Adds split; all rows of a user share it. Unknown splits or fractions that don't sum to 1 are errors."""
    if unknown := sorted(set(fractions) - set(SPLITS)):
        raise ValueError(f"unknown splits {unknown}")
    if abs(sum(fractions.values()) - 1) > 1e-9:
        raise ValueError("fractions must sum to 1")
    ranked = ranked_users(df, seed, "split")
    shares = largest_remainder(ranked.count(), fractions)
    split, upto = F.lit(None).cast("string"), 0
    whens = []
    for s in SPLITS:
        upto += shares[s]
        whens.append((upto, s))
    for upto, s in reversed(whens):
        split = F.when(F.col("rank") <= upto, F.lit(s)).otherwise(split)
    return df.drop("split").join(ranked.select("user_id", split.alias("split")), "user_id")
