"""Symbol sequences: views, and Markov models of them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rng
from ..functions.geo import Grid

#: Marks of a sequence's start and end; symbols are strings that differ from both.
START, END = "^", "$"


def as_gps(df: DataFrame) -> DataFrame:
    """The points of the clean form."""
    return df.select("traj_id", "user_id", "points")


def as_segments(df: DataFrame) -> DataFrame:
    """The edges of the matched form."""
    return df.select("traj_id", "user_id", "edge_seq")


def as_cells(arrays: DataFrame, grid: Grid) -> DataFrame:
    """The grid cell of every point, as strings."""
    return arrays.select("traj_id", "user_id", F.transform("points", lambda p: grid.cell(p["lat"], p["lon"]).cast("string")).alias("seq"))


def as_graph_path(df: DataFrame) -> DataFrame:
    """Not built: no operator reads node paths."""
    raise NotImplementedError("the graph path view is not built")


def as_poi_visits(df: DataFrame, layer: DataFrame) -> DataFrame:
    """Not built: there is no layer of points of interest."""
    raise NotImplementedError("the view of visits to points of interest is not built")


def collapse(df: DataFrame, column: str = "seq") -> DataFrame:
    """Without elements equal to the one before."""
    seq = F.col(column)
    return df.withColumn(column, F.filter(seq, lambda x, i: (i == 0) | (x != F.element_at(seq, F.greatest(i, F.lit(1))))))


def contexts(df: DataFrame, order: int = 1) -> DataFrame:
    """(traj_id, context, symbol): every symbol with the `order` before it, from START padding to END."""
    padded = F.concat(F.array_repeat(F.lit(START), order), F.col("seq"), F.array(F.lit(END)))
    pairs = F.transform(F.sequence(F.lit(order), F.size(padded) - 1), lambda i: F.struct(F.array_join(F.slice(padded, i - order + 1, order), ",").alias("context"), F.element_at(padded, i + 1).alias("symbol")))
    return df.select("traj_id", F.explode(pairs).alias("p")).select("traj_id", "p.context", "p.symbol")


def markov_counts(df: DataFrame, order: int = 1) -> DataFrame:
    """(context, symbol, n): the fitted model."""
    return contexts(df, order).groupBy("context", "symbol").agg(F.count("*").alias("n"))


def markov_log_prob(df: DataFrame, counts: DataFrame, order: int = 1, alpha: float = 1.0) -> DataFrame:
    """(traj_id, log_prob): additive smoothing over the vocabulary with END; a context never met is uniform."""
    totals = counts.groupBy("context").agg(F.sum("n").alias("total"))
    vocabulary = counts.agg(F.count_distinct("symbol").alias("v"))
    scored = contexts(df, order).join(totals, "context", "left").join(counts, ["context", "symbol"], "left").join(F.broadcast(vocabulary))
    p = (F.coalesce("n", F.lit(0)) + F.lit(alpha)) / (F.coalesce("total", F.lit(0)) + F.lit(alpha) * F.col("v"))
    return scored.groupBy("traj_id").agg(F.sum(F.log(p)).alias("log_prob"))


def markov_generate(counts: DataFrame, n: int, seed: int, order: int = 1, alpha: float = 1.0, max_len: int = 50) -> DataFrame:
    """(syn_id, seq): walks from the start until END or max_len; walks don't depend on one another.

    The fitted model is a table over seen contexts; it is broadcast, its size being that
    of the vocabulary's contexts.
    """
    spark = counts.sparkSession
    rows = counts.collect()
    vocabulary = sorted({r["symbol"] for r in rows})
    table: dict[str, dict[str, int]] = {}
    for r in rows:
        table.setdefault(r["context"], {})[r["symbol"]] = r["n"]
    shared = spark.sparkContext.broadcast((vocabulary, table))

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, table = shared.value
        for batch in batches:
            out = []
            for syn in batch["id"]:
                seq: list[str] = []
                context = [START] * order
                while len(seq) < max_len and vocabulary:
                    seen = table.get(",".join(context), {})
                    weights = [seen.get(s, 0) + alpha for s in vocabulary]
                    left = rng.draw(seed, "markov", syn, len(seq)) * sum(weights)
                    symbol = vocabulary[-1]
                    for s, w in zip(vocabulary, weights):
                        left -= w
                        if left < 0:
                            symbol = s
                            break
                    if symbol == END:
                        break
                    seq.append(symbol)
                    context = [*context, symbol][-order:]
                out.append(seq)
            yield pd.DataFrame({"syn_id": batch["id"], "seq": out})

    return spark.range(n).mapInPandas(apply, "syn_id long, seq array<string>")
