"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix is made of blocks of equally many words. Sources get blocks by highest
quotients of their targets, and each source's blocks go to its shards (hashed sets of
documents) by highest quotients of the shards' sizes, so every shard has an integer
quota. Within a shard the documents lie in seeded order on a circle of words; the quota
is a run of blocks from a seeded offset, which goes round the circle twice at most.
Nothing enumerates blocks, so their number costs nothing.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, written

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
BLOCK = 8
SEED = "mix"
#: Documents of a shard, and shards of a source at most (beyond, shards grow and their sort spills).
SHARD_DOCS, MAX_SHARDS = 4096, 1 << 16
#: A table of sources is a dimension: what is kept of each is one row, and there may be so many.
MAX_SOURCES = 200_000


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float = MOST) -> list[float]:
    """Shares of total by weight, none above most times its size; what is cut goes to the others by weight."""
    out, room, weight = [0.0] * len(sizes), total, float(sum(weights))
    for i in sorted(range(len(sizes)), key=lambda i: most * sizes[i] / weights[i]):
        out[i] = min(float(most * sizes[i]), room * weights[i] / weight)
        room -= out[i]
        weight -= weights[i]
    return out


def sainte_lague(votes: Sequence[float], seats: int, caps: Sequence[int] | None = None) -> list[int]:
    """Seats by highest quotients votes / (2 k - 1), the earlier party first among equals; no party above its cap."""
    n, total = len(votes), float(sum(votes))
    caps = [seats] * n if caps is None else list(caps)
    if not total:
        return [0] * n
    got = [min(int(v * seats / total + 0.5), c) for v, c in zip(votes, caps)]
    short = seats - sum(got)
    if short > 0:
        heap = [(-votes[i] / (2 * got[i] + 1), i) for i in range(n) if got[i] < caps[i] and votes[i]]
        heapq.heapify(heap)
        while short and heap:
            _, i = heapq.heappop(heap)
            got[i] += 1
            short -= 1
            if got[i] < caps[i]:
                heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    # rounding may also have seated a party before one with a higher quotient
    best = [(-votes[i] / (2 * got[i] + 1), i) for i in range(n) if got[i] < caps[i] and votes[i]]
    last = [(votes[i] / (2 * got[i] - 1), -i) for i in range(n) if got[i]]
    heapq.heapify(best)
    heapq.heapify(last)

    def move(i: int, by: int) -> None:
        got[i] += by
        if got[i] < caps[i] and votes[i]:
            heapq.heappush(best, (-votes[i] / (2 * got[i] + 1), i))
        if got[i]:
            heapq.heappush(last, (votes[i] / (2 * got[i] - 1), -i))

    while last:
        q, i = last[0][0], -last[0][1]
        if not got[i] or q != votes[i] / (2 * got[i] - 1):
            heapq.heappop(last)  # not its last seat any more
            continue
        if short < 0:
            move(i, -1)
            short += 1
            continue
        while best and (got[best[0][1]] >= caps[best[0][1]] or -best[0][0] != votes[best[0][1]] / (2 * got[best[0][1]] + 1)):
            heapq.heappop(best)
        if not best or (-best[0][0], -best[0][1]) <= (q, -i):
            break
        j = best[0][1]
        move(i, -1)
        move(j, 1)
    return got


def _quotas(rows: pd.DataFrame) -> pd.DataFrame:
    """Blocks of each shard of one source."""
    rows = rows.sort_values("shard", ignore_index=True)
    size = rows["shard_size"].tolist()
    rows["quota"] = np.array(sainte_lague(size, int(rows["blocks"].iloc[0]), [MOST * s // BLOCK for s in size]), np.int64)
    return rows[["party", "shard", "shard_size", "quota"]]


def mixed(df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: str = SEED) -> DataFrame:
    """(doc_id, copy, source, size, source_size, target, taken, spans), one row per input row.

    size: words of the text (null: 0). Sources in code point order, null last, weigh 5,
    2, 1, repeating. spans: the runs of words that the mix takes, one a lap; taken is
    their sum, at most twice the size. Equal seeds and rows give equal results at any
    partitioning; repeated rows (equal id) lie next to one another in the seeded order and
    may exchange their spans. A source of no words takes none. An empty table gives an
    empty table. More than MAX_SOURCES sources is an error. copy: a hash of the text, which
    tells rows of one id apart.
    """
    spark = df.sparkSession
    sized = written(df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("copy"), F.col(source).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    stats = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).limit(MAX_SOURCES + 1).collect()
    if len(stats) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    stats.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    size = [r["size"] for r in stats]
    weight = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(stats))]
    target = targets(size, weight, SHARE * sum(size))
    blocks = sainte_lague(target, int(sum(target) / BLOCK + 0.5), [MOST * s // BLOCK for s in size])
    parties = [(i, r["source"], r["size"], t, b, max(1, min(MAX_SHARDS, -(-r["docs"] // SHARD_DOCS)))) for i, (r, t, b) in enumerate(zip(stats, target, blocks))]
    table = spark.createDataFrame(parties, "party int, party_source string, source_size long, target double, blocks long, shards int")
    hashed = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    placed = sized.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("party_source"))).withColumn("key", hashed)
    placed = placed.withColumn("shard", (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % F.col("shards")).cast("int"))
    shards = placed.groupBy("party", "shard", "blocks").agg(F.sum("size").alias("shard_size"))
    quotas = shards.groupBy("party").applyInPandas(_quotas, "party int, shard int, shard_size long, quota long")  # MAX_SHARDS rows a group at most
    order = Window.partitionBy("party", "shard").orderBy("key", "doc_id", "size", "copy").rowsBetween(Window.unboundedPreceding, -1)
    laid = placed.withColumn("at", F.coalesce(F.sum("size").over(order), F.lit(0))).join(quotas, ["party", "shard"])
    turn = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit("offset"), F.col("party").cast("string"), F.col("shard").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    laid = laid.withColumn("begin", BLOCK * (turn % F.greatest(F.lit(1), F.ceil(F.col("shard_size") / BLOCK)))).withColumn("end", F.col("begin") + BLOCK * F.col("quota"))

    def lap(k: int):
        first = F.col("at") + k * F.col("shard_size")
        return F.struct((F.greatest("begin", first) - first).alias("from"), (F.least(F.col("end"), first + F.col("size")) - first).alias("to"))

    laid = laid.withColumn("spans", F.filter(F.array(*[lap(k) for k in range(4)]), lambda s: s["from"] < s["to"]))
    taken = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return laid.select("doc_id", "copy", "source", "size", "source_size", "target", taken.alias("taken"), "spans")
