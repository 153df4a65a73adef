"""Exact deduplication by a log-structured merge index, in DataFrame operations only.

Memtables: every task digests its rows and combines equal digests (partial aggregation)
before anything is written. Flush: the digests go out as sorted runs, each with a filter
(a bitmap sized from the number of digests). Compaction: a digest that no other run's
filter holds is settled as it is; the others merge, and the index has one row per digest
with the identifier to keep and the group's size. The index is a sorted run itself, so a
later batch is flushed and compacted with it (`extend`). Hits are digests met more than
once; a bitmap of them keeps the texts of other rows from travelling, or, where hits are
too many for one, a join by digest. The texts that remain are compared byte for byte by
grouping on digest and bytes together. Should one digest stand for different bytes, its
rows are told apart by bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import temporary, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A filter has some ten bits for each digest it holds, between these bounds; at most 8 MB are broadcast of one. Digests
#: beyond the bound pass more often, which costs their merge and nothing else.
LEAST_BITS, MOST_BITS, BITS_EACH = 1 << 16, 1 << 26, 10
PAGE_BITS = 8 * 4096
#: Bits a hit that the filter of hits must have; with fewer, texts are picked by a join.
BITS_PER_HIT = 4


def normalised(text: str) -> Column:
    """A-Z lower-cased, nothing else; null counts as empty."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)


def sha256(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


def filter_bits(n: int) -> int:
    """Bits of a filter of n digests."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * max(1, n) - 1).bit_length()))


def _slot(bits: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(bits))


def _pages(digests: DataFrame, bits: int, *by: str) -> DataFrame:
    """Pages (page, bits) of a bitmap of the digests; at most bits / PAGE_BITS rows for each value of `by`."""
    slot = _slot(bits)
    return digests.select(*by, F.bitmap_bucket_number(slot).alias("page"), F.bitmap_bit_position(slot).alias("bit")).groupBy(*by, "page").agg(F.bitmap_construct_agg("bit").alias("bits"))


def _holds(page: Column | str, bits: int) -> Column:
    """Whether the page has the row's digest's bit."""
    at = F.bitmap_bit_position(_slot(bits))
    byte = F.conv(F.hex(F.substring(page, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1


def flush(rows: DataFrame, runs: int) -> DataFrame:
    """Sorted runs of (run, digest, keep_id, n); the run goes by the row, so that every run spans the table."""
    combined = rows.select("digest", "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("int").alias("run")).groupBy("run", "digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    return written(combined.sortWithinPartitions("run", "digest"), "runs")


def compact(level: DataFrame) -> DataFrame:
    """Merge sorted runs into (digest, keep_id, n), one row per digest, sorted within its files.

    The filters are broadcast: 8 MB at most for each of a few runs. Digests that pass no
    other run's filter need no merge and are not shuffled.
    """
    bits = filter_bits(level.count())
    filters = _pages(level, bits, "run").groupBy("page").agg(F.collect_list(F.struct("run", "bits")).alias("filters"))  # a page of each run
    met = level.withColumn("page", F.bitmap_bucket_number(_slot(bits))).join(F.broadcast(filters), "page")
    elsewhere = F.exists("filters", lambda f: (f["run"] != F.col("run")) & _holds(f["bits"], bits))
    met = met.select("digest", "keep_id", "n", elsewhere.alias("elsewhere"))
    merged = met.where("elsewhere").groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    return merged.unionByName(met.where("NOT elsewhere").drop("elsewhere")).sortWithinPartitions("digest")


def extend(index: DataFrame | None, df: DataFrame, text: str = "text", doc_id: str = "doc_id", runs: int = 4, digest=None) -> DataFrame:
    """The written index (digest, keep_id, n) of `index` and a further batch of documents; None starts one.

    Nulls, repeated rows and empty batches count as in exact_duplicates. The batch alone
    is digested; the index takes part as one more run.
    """
    rows = df.select(F.col(doc_id).alias("doc_id"), (digest or sha256)(normalised(text)).alias("digest"))
    with temporary() as keep:
        level = flush(rows, runs)
        if index is not None:
            level = level.unionByName(index.withColumn("run", F.lit(-1)))
        return keep(written(compact(level), "index"))


def passes(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """The rows whose digest is a hit's, and with a filter perhaps a few more. hits: a written table of digests."""
    n = hits.count()
    bits = filter_bits(n)
    if n * BITS_PER_HIT > bits:
        return rows.join(hits.hint("merge"), "digest", "left_semi")
    kept = rows.withColumn("page", F.bitmap_bucket_number(_slot(bits))).join(F.broadcast(_pages(hits, bits)), "page")
    return kept.where(_holds("bits", bits)).drop("page", "bits")


def exact_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", runs: int = 4, digest=sha256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest), one row per input row.

    Texts are equal when their bytes are after lower-casing A-Z; null counts as empty.
    keep_id is the largest doc_id of the group (null only if all are null); repeated rows
    count in group_size each and, if theirs is the id to keep, are all kept. An empty
    table gives an empty table. Other columns are not read. digest: a function from the
    normalised text to its digest; tests pass a narrow one to force collisions.
    """
    texts = df.select(F.col(doc_id).alias("doc_id"), normalised(text).alias("norm")).withColumn("digest", digest(F.col("norm")))
    rows = written(texts.select("doc_id", "digest"), "digests")
    with temporary() as keep:
        index = keep(written(compact(flush(rows, runs)), "index"))
    suspects = passes(texts, index.where("n > 1").select("digest"))
    verified = written(suspects.groupBy("digest", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n")).select("digest", "keep_id", "n", F.sha2(F.col("norm"), 512).alias("bytes")), "verified")
    clashes = verified.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")
    result = rows.join(index, "digest").select("doc_id", "keep_id", F.col("n").alias("group_size"), "digest")
    if clashes.limit(1).count():
        told = texts.join(clashes, "digest", "left_semi").select("doc_id", "digest", F.sha2(F.col("norm"), 512).alias("bytes"))
        told = told.join(verified, ["digest", "bytes"]).select("doc_id", "keep_id", F.col("n").alias("group_size"), "digest")
        result = result.join(clashes, "digest", "left_anti").unionByName(told.select(*result.columns))
    return result.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")
