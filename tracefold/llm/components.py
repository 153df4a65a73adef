"""Connected components: joined in memory within each task, then by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt_anew, forget, written

#: Edges that a task joins at once.
HELD = 1 << 20


def _star(edges: DataFrame) -> DataFrame:
    """edges: (a, b), b the neighbour of a. Adds the least of a's neighbours and itself; hot nodes combine before the shuffle."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(dealt_anew(least), "a").select("a", "b", F.least("a", "m").alias("m"))


def _both(edges: DataFrame, first: tuple[str, str], second: tuple[str, str], *names: str) -> DataFrame:
    """Two rows of each: a union would compute the edges twice."""
    return edges.select(F.inline(F.array(*[F.struct(*[F.col(c).alias(n) for c, n in zip(pair, names)]) for pair in (first, second)])))


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots): every node of an edge but the least of its component, and that least one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))  # larger roots go below smaller ones: some log n times
        while (root != (above := root[root])).any():
            root = above
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[below], nodes[root[below]]


def _joined(edges: DataFrame, tasks: int, held: int) -> DataFrame:
    """The forests of the edges that each task reads, `held` at a time and no more of them in memory than a batch above that."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for batch in batches:
            kept.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v")))
            if (n := n + batch.num_rows) > held:
                kept = [forest(*map(np.concatenate, zip(*kept)))]
                if (n := len(kept[0][0])) > held // 2:  # few of them met
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in kept[0]], ["u", "v"])
                    kept, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in forest(*map(np.concatenate, zip(*kept)))], ["u", "v"])

    return edges.coalesce(tasks).mapInArrow(apply, "u long, v long")


def components(edges: DataFrame, held: int = HELD) -> DataFrame:
    """(node, root): the least node of its component, for every node of an edge (u, v); nodes are 64-bit numbers.

    Each task joins the edges that it reads in memory, so that `held` edges or fewer are
    done by one task; of more, each task leaves a forest. Rounds follow there until nothing
    changes, some log n of them. Every round is two shuffles on node pairs and a written table, so a lost executor
    costs one round at most. Hot nodes are joined against one row each, which the
    adaptive skew join splits. Loops (u = u) and repeated edges are harmless; an empty
    table gives an empty table. Edges must not be null.
    """
    table = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    tasks = -(-table.count() // held)
    now = written(_joined(table, max(tasks, 1), held), "edges")
    forget(table)
    before = None
    while tasks > 1:
        large = _star(_both(now, ("u", "v"), ("v", "u"), "a", "b")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        following = written(_both(_star(large), ("b", "m"), ("a", "m"), "u", "v").where("u <> v").distinct(), "edges")
        mark = following.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        forget(now)
        now = following
        if mark == before or not mark[0]:
            break
        before = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
