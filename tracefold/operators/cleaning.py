"""Cleaning of trajectories: order-dependent folds over each one's points.

A fold gets the coordinates as arrays of doubles in Arrow batches and returns the places of
the points it keeps, so all other columns stay in the JVM. One form serves every length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo

#: Points that are looked at in one step beyond an outlier.
AHEAD = 64


@dataclass(frozen=True)
class CleaningRules:
    max_speed_kmh: float = 200.0
    min_points: int = 20
    min_length_m: float = 500.0
    resample_s: float = 5.0


def _slow_enough(phi: np.ndarray, lam: np.ndarray, t: np.ndarray, a, b, limit: float) -> np.ndarray:
    """Whether points b come after points a and are no faster than the limit (km/h) from them."""
    dt = t[b] - t[a]
    s = np.sin((phi[b] - phi[a]) / 2) ** 2 + np.cos(phi[a]) * np.cos(phi[b]) * np.sin((lam[b] - lam[a]) / 2) ** 2
    metres = 2 * geo.EARTH_M * np.arcsin(np.sqrt(np.minimum(s, 1.0)))
    return (dt > 0) & (metres * 3.6 <= limit * dt)


def not_fast(lat: np.ndarray, lon: np.ndarray, t: np.ndarray, limit: float) -> np.ndarray:
    """Places of the points that follow the last kept one slowly enough; the first stays."""
    n, phi, lam = len(t), np.radians(lat), np.radians(lon)
    if not n:
        return np.zeros(0, np.int32)
    every = np.arange(n)
    breaks = np.flatnonzero(~_slow_enough(phi, lam, t, every[:-1], every[1:], limit)) + 1
    keep = np.ones(n, bool)
    done = 0  # all before is decided, and place done is kept
    while (k := np.searchsorted(breaks, done, "right")) < len(breaks):
        out = int(breaks[k])  # points up to here follow one another; this one doesn't
        last, found, step = out - 1, n, AHEAD
        ahead = out + 1
        while ahead < n:
            end = min(n, ahead + step)
            fit = np.flatnonzero(_slow_enough(phi, lam, t, last, every[ahead:end], limit))
            if len(fit):
                found = ahead + int(fit[0])
                break
            ahead, step = end, 2 * step
        keep[out:found] = False
        done = found
    return np.flatnonzero(keep).astype(np.int32)


def _spaced(t: np.ndarray, gap: float) -> np.ndarray:
    """Places of the points that are the gap or more after the last kept one; the first stays."""
    kept, last = [], 0.0
    for i, now in enumerate(t.tolist()):
        if not kept or now - last >= gap:
            kept.append(i)
            last = now
    return np.array(kept, np.int32)


def _at(places: str) -> Column:
    """The points of those places."""
    return F.transform(places, lambda i: F.element_at("points", i + 1))


def drop_fast(df: DataFrame, max_speed_kmh: float) -> DataFrame:
    """Drop points that don't come after the last kept one or are faster than the limit from it; adds outliers."""

    @F.pandas_udf("array<int>")
    def kept(lat: pd.Series, lon: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([not_fast(*p, max_speed_kmh) for p in zip(lat, lon, t)], dtype=object)

    found = df.withColumn("__kept", kept("points.lat", "points.lon", "points.t")).withColumn("outliers", F.size("points") - F.size("__kept"))
    return found.withColumn("points", _at("__kept")).drop("__kept")


def thin(df: DataFrame, resample_s: float) -> DataFrame:
    """Keep a point if it is resample_s or more after the last kept one; nothing is interpolated."""

    @F.pandas_udf("array<int>")
    def kept(t: pd.Series) -> pd.Series:
        return pd.Series([_spaced(p, resample_s) for p in t], dtype=object)

    return df.withColumn("__kept", kept("points.t")).withColumn("points", _at("__kept")).drop("__kept")


def geometry(df: DataFrame) -> DataFrame:
    """Adds n_points, start_t, end_t, duration_s, length_m, the box and mean_speed (0 without duration)."""
    p = F.col("points")
    lat, lon = F.transform(p, lambda x: x["lat"]), F.transform(p, lambda x: x["lon"])
    out = df.withColumns({"n_points": F.size(p), "start_t": F.try_element_at(p, F.lit(1))["t"], "end_t": F.try_element_at(p, F.lit(-1))["t"], "length_m": geo.length_m(p)})
    out = out.withColumn("duration_s", F.col("end_t") - F.col("start_t"))
    box = {"min_lon": F.array_min(lon), "min_lat": F.array_min(lat), "max_lon": F.array_max(lon), "max_lat": F.array_max(lat)}
    return out.withColumns(box | {"mean_speed": F.when(F.col("duration_s") > 0, F.col("length_m") / F.col("duration_s")).otherwise(F.lit(0.0))})


def clean(arrays: DataFrame, rules: CleaningRules | None = None) -> DataFrame:
    """Outliers out, thinned, too small ones rejected (judged on thinned points), geometry and flags added."""
    rules = rules or CleaningRules()
    kept = geometry(thin(drop_fast(arrays, rules.max_speed_kmh), rules.resample_s))
    flags = F.array(F.concat(F.lit("speed_outliers_dropped:"), F.col("outliers").cast("string")), F.lit(f"resampled:{rules.resample_s:g}s"))
    kept = kept.where((F.col("n_points") >= rules.min_points) & (F.col("length_m") >= rules.min_length_m))
    return kept.withColumn("cleaning_flags", flags).withColumn("split", F.lit(None).cast("string"))
