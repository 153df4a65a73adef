"""Stay points and the home and work places inferred from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo

STAY = "traj_id string, user_id {user}, stay int, lat double, lon double, t double, n int"
HOME_HOURS, WORK_HOURS, TZ_OFFSET_H = (22, 7), (9, 18), 8


def _stays(lat: np.ndarray, lon: np.ndarray, t: np.ndarray, radius_m: float, dwell_s: float) -> list[tuple]:
    """Anchored: from each anchor as far as points stay within the radius of it."""
    phi, lam = np.radians(lat), np.radians(lon)
    out, i, n = [], 0, len(t)
    while i < n:
        ahead, step = i + 1, 64
        j = n
        while ahead < n:  # in pieces, so that a long trajectory with short stays costs little
            end = min(n, ahead + step)
            s = np.sin((phi[ahead:end] - phi[i]) / 2) ** 2 + np.cos(phi[i]) * np.cos(phi[ahead:end]) * np.sin((lam[ahead:end] - lam[i]) / 2) ** 2
            far = np.flatnonzero(2 * geo.EARTH_M * np.arcsin(np.sqrt(s)) > radius_m)
            if len(far):
                j = ahead + int(far[0])
                break
            ahead, step = end, step * 2
        if t[j - 1] - t[i] >= dwell_s:
            out.append((float(lat[i:j].mean()), float(lon[i:j].mean()), float(t[i]), j - i))
            i = j
        else:
            i += 1
    return out


def stay_points(arrays: DataFrame, radius_m: float = 200.0, dwell_s: float = 300.0) -> DataFrame:
    """(traj_id, user_id, stay, lat, lon, t, n): one row a stay, in Arrow batches of whole trajectories."""

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for traj, user, lat, lon, t in zip(*(batch[c] for c in ("traj_id", "user_id", "lat", "lon", "t"))):
                rows += [(traj, user, k, *s) for k, s in enumerate(_stays(lat, lon, t, radius_m, dwell_s))]
            yield pd.DataFrame(rows, columns=["traj_id", "user_id", "stay", "lat", "lon", "t", "n"])

    return arrays.select("traj_id", "user_id", "points.lat", "points.lon", "points.t").mapInPandas(apply, STAY.format(user=arrays.schema["user_id"].dataType.simpleString()))


def local_hour(t: Column, tz_offset_h: float = TZ_OFFSET_H) -> Column:
    """Hour and minute of the day, local; seconds don't count."""
    minutes = F.floor(F.pmod(t, F.lit(86_400.0)) / 60)
    return F.pmod(F.floor(minutes / 60) + (minutes % 60) / 60.0 + tz_offset_h, F.lit(24.0))


def in_window(hour: Column, window: tuple[int, int]) -> Column:
    """Half open; a window that ends before it starts goes over midnight."""
    a, b = window
    return ((hour >= a) & (hour < b)) if a <= b else ((hour >= a) | (hour < b))


def home_work(arrays: DataFrame, stays: DataFrame, home: tuple = HOME_HOURS, work: tuple = WORK_HOURS, tz_offset_h: float = TZ_OFFSET_H) -> DataFrame:
    """(user_id, home_lat, home_lon, work_lat, work_lon): means of stays in the windows, weighted by points; null without any."""
    hour = local_hour(F.col("t"), tz_offset_h)
    columns = []
    for name, window in (("home", home), ("work", work)):
        n = F.when(in_window(hour, window), F.col("n"))
        columns += [(F.sum(F.col(c) * n) / F.sum(n)).alias(f"{name}_{c}") for c in ("lat", "lon")]
    return arrays.select("user_id").distinct().join(stays.groupBy("user_id").agg(*columns), "user_id", "left")


def place_errors(truth: DataFrame, estimate: DataFrame, threshold_m: float = 200.0) -> DataFrame:
    """(user_id, home_error_m, home_localised, work_...): null where the truth has no place; NaN errors for no estimate."""
    e = estimate.select("user_id", *[F.col(c).alias(f"est_{c}") for c in estimate.columns if c != "user_id"])
    both = truth.join(e, "user_id", "left")
    out = ["user_id"]
    for name in ("home", "work"):
        has, got = F.col(f"{name}_lat").isNotNull(), F.col(f"est_{name}_lat").isNotNull()
        d = geo.haversine(F.col(f"{name}_lat"), F.col(f"{name}_lon"), F.col(f"est_{name}_lat"), F.col(f"est_{name}_lon"))
        out += [F.when(has & got, d).alias(f"{name}_error_m"), F.when(has, F.coalesce((got & (d <= threshold_m)).cast("double"), F.lit(0.0))).alias(f"{name}_localised")]
    return both.select(*out)
