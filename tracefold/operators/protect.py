"""Privacy mechanisms: geo-indistinguishability, and local differential privacy over categories."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rng

METRES_PER_DEGREE = 111_320.0


def check_epsilon(epsilon: float) -> None:
    if not epsilon > 0:
        raise ValueError(f"epsilon must be positive, not {epsilon}")


def geoind(long: DataFrame, epsilon: float, unit_m: float = 100.0, seed: int = 0) -> DataFrame:
    """Planar Laplace noise on every point of the long form; times stay.

    The radius is Gamma(2, unit_m / epsilon), as the sum of two exponentials; the three
    uniforms of a point are keyed by seed, trajectory and position.
    """
    check_epsilon(epsilon)
    at = lambda k: rng.uniform(seed, "geoind", k, F.col("traj_id"), F.col("pos"))
    radius = -(F.log(1.0 - at("a")) + F.log(1.0 - at("b"))) * (unit_m / epsilon)
    angle = at("c") * (2 * math.pi)
    lat = F.col("lat") + radius * F.sin(angle) / METRES_PER_DEGREE
    lon = F.col("lon") + radius * F.cos(angle) / (METRES_PER_DEGREE * F.cos(F.radians("lat")))
    return long.withColumns({"lat": lat, "lon": lon})


def identity(long: DataFrame) -> DataFrame:
    """The points as they are; guarantee none, no budget."""
    return long


def geoind_budget(long: DataFrame, epsilon: float) -> DataFrame:
    """(traj_id, spent_budget): epsilon for every point."""
    check_epsilon(epsilon)
    return long.groupBy("traj_id").agg((F.count("*") * F.lit(float(epsilon))).alias("spent_budget"))


def grr_keep(k: int, epsilon: float) -> float:
    if k < 2:
        raise ValueError(f"a domain of {k} values can't be randomised")
    return math.exp(epsilon) / (math.exp(epsilon) + k - 1)


def grr(value: Column, k: int, epsilon: float, *key: Column | str | int) -> Column:
    """k-ary randomised response of a value 0 to k - 1: itself, or uniformly one of the others."""
    check_epsilon(epsilon)
    other = rng.index(k - 1, "grr-other", *key)
    return F.when(rng.uniform("grr-keep", *key) < grr_keep(k, epsilon), value).otherwise(other + F.when(other >= value, 1).otherwise(0)).cast("int")


def grr_estimate(count: Column, n: Column, k: int, epsilon: float) -> Column:
    """Unbiased count of a category from reports, 0 at least."""
    check_epsilon(epsilon)
    e = math.exp(epsilon)
    p, q = e / (e + k - 1), 1 / (e + k - 1)
    return F.greatest((count - n * q) / (p - q), F.lit(0.0))


def oue_flip(epsilon: float) -> float:
    check_epsilon(epsilon)
    return 1 / (math.exp(epsilon) + 1)


def oue(value: Column, size: int, epsilon: float, *key: Column | str | int) -> Column:
    """Optimised unary encoding: an array of size bits, the true one set with 1/2, others with 1 / (e^epsilon + 1)."""
    q = oue_flip(epsilon)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (rng.uniform("oue", *key, i) < F.when(i == value, 0.5).otherwise(q)).cast("int"))


def oue_estimate(ones: Column, n: Column, epsilon: float) -> Column:
    """Unbiased count of a position from summed bits, 0 at least."""
    q = oue_flip(epsilon)
    return F.greatest((ones - n * q) / (0.5 - q), F.lit(0.0))
