"""The stateful cleaning step over a stream of points: one state, the last kept point, for each trajectory."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.cleaning import not_fast

POINT = "traj_id string, t double, lat double, lon double"


def drop_fast(points: DataFrame, max_speed_kmh: float = 200.0) -> DataFrame:
    """(traj_id, t, lat, lon): the points kept, as the batch step keeps them for points that arrive in order.

    A point that isn't later than its trajectory's last kept one, or is faster from it than
    the limit, is dropped; late points are dropped by the same rule.
    """

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))[["traj_id", "t", "lat", "lon"]].sort_values("t", kind="stable")
        if state.exists:  # the last kept point goes first, and stays as a first point does
            rows = pd.concat([pd.DataFrame([(key[0], *state.get)], columns=rows.columns), rows])
        kept = rows.iloc[not_fast(*(rows[c].to_numpy(float) for c in ("lat", "lon", "t")), max_speed_kmh)]
        new = kept.iloc[1:] if state.exists else kept
        state.update(tuple(float(kept[c].iloc[-1]) for c in ("t", "lat", "lon")))
        yield new

    return points.groupBy("traj_id").applyInPandasWithState(keep, POINT, "t double, lat double, lon double", "append", GroupStateTimeout.NoTimeout)


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, event_type, n) of a stream with ts and event_type; events later than the watermark don't count."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return at.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))
