"""Map matching by a hidden Markov model (Newson and Krumm, 2009), with exact bounded routing between candidates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .zones import Router

RADIUS_M, GPS_ERROR_M, CANDIDATES = 50.0, 20.0, 8
MATCHED = "traj_id string, user_id {user}, edge_seq array<bigint>, matched_points array<struct<x:double,y:double,t:double,offset_m:double>>, match_score double, frac_matched double"


def near_edges(points: DataFrame, nodes: DataFrame, edges: DataFrame, radius_m: float = RADIUS_M) -> DataFrame:
    """(traj_id, pos, edge_id, offset_m): roads within the radius of points (traj_id, pos, x, y).

    A distance join as an equi-join: edges are dealt to all grid cells of the radius' size
    that their box, grown by the radius, touches; a point looks in its own cell only.
    """
    end = lambda n: nodes.select(F.col("node_id").alias(n), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y"))
    e = edges.select("edge_id", "u", "v").join(end("u"), "u").join(end("v"), "v")
    size = max(radius_m, 1.0)
    span = lambda c: F.sequence(F.floor((F.least(f"u{c}", f"v{c}") - radius_m) / size), F.floor((F.greatest(f"u{c}", f"v{c}") + radius_m) / size))
    e = e.withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y")))
    p = points.withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)})
    dx, dy = F.col("vx") - F.col("ux"), F.col("vy") - F.col("uy")
    along = ((F.col("x") - F.col("ux")) * dx + (F.col("y") - F.col("uy")) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-12))
    f = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
    offset = F.sqrt(F.pow(F.col("x") - F.col("ux") - f * dx, 2) + F.pow(F.col("y") - F.col("uy") - f * dy, 2))
    return p.join(e, ["cx", "cy"]).select("traj_id", "pos", "edge_id", offset.alias("offset_m")).where(F.col("offset_m") <= radius_m)


class Matcher:
    """A network's candidates and routes on one machine."""

    def __init__(self, nodes: list[tuple[int, float, float]], edges: list[tuple[int, int, int, float]], radius_m: float, gps_error_m: float, candidates: int):
        xy = {n: (x, y) for n, x, y in nodes}
        self.router = Router([(e, u, v, w, 0) for e, u, v, w in edges])
        kept = sorted(self.router.pair.values())
        self.ids = np.array(kept, np.int64)
        ends = [self.router.ends[e] for e in kept]
        self.a = np.array([xy[u] for u, _ in ends]).reshape(-1, 2)
        self.b = np.array([xy[v] for _, v in ends]).reshape(-1, 2)
        self.radius, self.error, self.width = radius_m, gps_error_m, candidates
        self.known: dict[int, tuple[float, dict, dict]] = {}
        self.cells: dict[tuple[int, int], list[int]] = {}
        self.size = max(radius_m, 1.0)
        low, high = np.minimum(self.a, self.b) - radius_m, np.maximum(self.a, self.b) + radius_m
        for i, (lo, hi) in enumerate(zip(np.floor(low / self.size).astype(int).tolist(), np.floor(high / self.size).astype(int).tolist())):
            for cx in range(lo[0], hi[0] + 1):
                for cy in range(lo[1], hi[1] + 1):
                    self.cells.setdefault((cx, cy), []).append(i)

    def near(self, p: np.ndarray) -> list[tuple[float, int, float, np.ndarray]]:
        """(offset, edge, share of it gone, projection): the nearest edges within the radius, both directions of a road."""
        found = self.cells.get((int(p[0] // self.size), int(p[1] // self.size)))
        if not found:
            return []
        at = np.array(found)
        d = self.b[at] - self.a[at]
        f = np.clip(((p - self.a[at]) * d).sum(1) / np.maximum((d * d).sum(1), 1e-12), 0, 1)
        on = self.a[at] + f[:, None] * d
        off = np.sqrt(((p - on) ** 2).sum(1))
        order = [i for i in np.lexsort((self.ids[at], off)) if off[i] <= self.radius][: self.width]
        return [(float(off[i]), int(self.ids[at[i]]), float(f[i]), on[i]) for i in order]

    def route(self, source: int, limit: float) -> tuple[dict, dict]:
        if source not in self.known or self.known[source][0] < limit:
            self.known[source] = (limit, *self.router.distances(source, limit))
        return self.known[source][1:]

    def match(self, xy: np.ndarray, t: list[float]) -> tuple[list[int], list[tuple], float, float]:
        """(edges, matched points, score, share matched). The longest stretch that a route explains is used."""
        best: list[dict[int, tuple[float, int | None]]] = []
        layers, at = [], []
        runs: list[tuple[list, list]] = []
        scale = 2 * self.error

        def close() -> None:
            if not best:
                return
            j = min(best[-1], key=lambda k: (best[-1][k][0], k))
            chain = []
            for i in range(len(best) - 1, -1, -1):
                chain.append(layers[i][j])
                j = best[i][j][1]
            runs.append((chain[::-1], list(at)))
            best.clear(), layers.clear(), at.clear()

        for i, p in enumerate(xy):
            found = self.near(p)
            if not found:
                continue
            cost = {}
            if best:
                gap = float(np.hypot(*(p - xy[at[-1]])))
                limit = 4 * gap + 8 * self.radius
                for j, (off, e, f, _) in enumerate(found):
                    choices = []
                    for k, (c, _) in best[-1].items():
                        d = self.between(layers[-1][k], (e, f), limit)
                        if d is not None:
                            choices.append((c + abs(d - gap) / scale, k))
                    if choices:
                        c, k = min(choices)
                        cost[j] = (c + off * off / (2 * self.error**2), k)
            if not cost:
                close()
                cost = {j: (off * off / (2 * self.error**2), None) for j, (off, *_) in enumerate(found)}
            best.append(cost)
            layers.append(found)
            at.append(i)
        close()
        if not runs:
            return [], [], 0.0, 0.0
        chain, which = max(runs, key=lambda r: len(r[0]))
        edges = [chain[0][1]]
        for a, b in zip(chain, chain[1:]):
            if b[1] != edges[-1] or b[2] < a[2] - 1e-6:
                u, v = self.router.ends[a[1]][1], self.router.ends[b[1]][0]
                if u != v:
                    _, back = self.route(u, self.radius)
                    if v not in back:
                        _, back = self.router.distances(u)
                    edges += self.router.path(back, u, v)
                edges.append(b[1])
        points = [(float(c[3][0]), float(c[3][1]), float(t[i]), c[0]) for c, i in zip(chain, which)]
        share = len(points) / len(xy)
        return edges, points, share * math.exp(-sum(p[3] for p in points) / len(points) / (2 * self.error)), share

    def between(self, a: tuple, b: tuple[int, float], limit: float) -> float | None:
        """Length of the route from one candidate to the next, if within the limit."""
        (_, e, f, _), (g, h) = a, b
        if e == g and h >= f - 1e-6:
            return (h - f) * self.router.length[e]
        rest = (1 - f) * self.router.length[e] + h * self.router.length[g]
        done, _ = self.route(self.router.ends[e][1], limit)
        d = done.get(self.router.ends[g][0])
        return None if d is None or d + rest > limit else d + rest


def match(arrays: DataFrame, nodes: DataFrame, edges: DataFrame, utm_zone: int = 50, radius_m: float = RADIUS_M, gps_error_m: float = GPS_ERROR_M, candidates: int = CANDIDATES) -> DataFrame:
    """Clean trajectories on the network: edge_seq, matched_points, match_score, frac_matched.

    The score is the share of matched points times exp(-mean offset / (2 gps_error_m)); a
    trajectory without candidates has no edges and score 0. The network of a region is a
    bounded table and goes to every worker once.
    """
    spark = arrays.sparkSession
    shared = spark.sparkContext.broadcast((
        [tuple(r) for r in nodes.select("node_id", "x", "y").collect()],
        [tuple(r) for r in edges.select("edge_id", "u", "v", "length_m").collect()],
    ))
    made: list[Matcher] = []
    x, y = geo.utm(F.col("p")["lon"], F.col("p")["lat"], utm_zone)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not made:
                made.append(Matcher(*shared.value, radius_m, gps_error_m, candidates))
            rows = []
            for traj, user, xs, ys, ts in zip(batch["traj_id"], batch["user_id"], batch["x"], batch["y"], batch["t"]):
                route, pts, score, share = made[0].match(np.stack([xs, ys], 1), list(ts)) if len(xs) else ([], [], 0.0, 0.0)
                rows.append((traj, user, route, [dict(zip(("x", "y", "t", "offset_m"), p)) for p in pts], score, share))
            yield pd.DataFrame(rows, columns=["traj_id", "user_id", "edge_seq", "matched_points", "match_score", "frac_matched"])

    projected = arrays.select("traj_id", "user_id", *[F.transform("points", f).alias(n) for n, f in (
        ("x", lambda p: geo.utm(p["lon"], p["lat"], utm_zone)[0]),
        ("y", lambda p: geo.utm(p["lon"], p["lat"], utm_zone)[1]),
        ("t", lambda p: p["t"]),
    )])
    return projected.mapInPandas(apply, MATCHED.format(user=arrays.schema["user_id"].dataType.simpleString()))


def quality(matched: DataFrame) -> DataFrame:
    """(traj_id, mean_offset_m, max_offset_m, frac_matched, match_score, n_edges); NaN offsets without points."""
    off = F.transform("matched_points", lambda p: p["offset_m"])
    n = F.size(off)
    mean = F.aggregate(off, F.lit(0.0), lambda s, x: s + x) / n
    nan = F.lit(float("nan"))
    return matched.select("traj_id", F.when(n > 0, mean).otherwise(nan).alias("mean_offset_m"), F.when(n > 0, F.array_max(off)).otherwise(nan).alias("max_offset_m"), "frac_matched", "match_score", F.size("edge_seq").alias("n_edges"))


def survivors(matched: DataFrame, min_score: float) -> DataFrame:
    """Those that match well enough."""
    return matched.where(F.col("match_score") >= min_score)
