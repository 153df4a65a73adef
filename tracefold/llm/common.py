"""What the document operators share: written tables, Arrow batches, byte-level words and hashes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import forget, shared_dir, shuffles_removed  # noqa: F401

#: Bytes of text that one numpy pass holds; a longer document makes a pass of its own.
CHUNK_BYTES = 1 << 20

#: Words are runs of anything but these bytes (ASCII white space).
WORD = r"[^\x20\x09-\x0D]+"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True

#: Odd multiplier of the polynomial hashes, its inverse modulo 2**64, and two mixing constants (those of splitmix64).
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and lost executors lose nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracefold/{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    if _open:
        _open[-1].append(table)
    return table


_open: list[list[DataFrame]] = []


@contextmanager
def temporary() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside are deleted at the end, but for those passed to the function that this gives."""
    kept: list[DataFrame] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    _open.append([])
    try:
        yield keep
    finally:
        for table in _open.pop():
            if not any(table is k for k in kept):
                forget(table)
            elif _open:
                _open[-1].append(table)


def dealt_anew(df: DataFrame) -> DataFrame:
    """The rows of an aggregate, shuffled once more before a sort-merge join on its key.

    Adaptive execution splits a hot key's side of a join only where both sides come
    straight from a shuffle, which an aggregate on the same key would not. Neither is
    the aggregate broadcast: compressed shuffle files, by which that would be decided,
    can be a hundredth of its size in memory.
    """
    return df.hint("rebalance").hint("merge")


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about `limit` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64)
        large = sizes > limit  # stands alone
        group = np.cumsum(sizes) // limit + np.cumsum(large) + np.cumsum(np.concatenate([[False], large[:-1]]))
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; a run ends at a document's end too."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] = inside[tails]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the words."""
    starts, ends = runs(~IS_SPACE[data], offsets)
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose high bits depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, n + 1 of each; the last ones made are kept."""
    size = max(_powers, default=0)
    if size < n:
        size = max(n, CHUNK_BYTES)
        _powers.clear()
        made = []
        for base in (BASE, BASE_INVERSE):
            p = np.full(size + 1, base, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers[size] = made[0], made[1]
    p, q = _powers[size]
    return p[: n + 1], q[: n + 1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of the byte spans, mixed; equal spans have equal hashes.

    Different spans may well have equal ones too (such a hash modulo 2**64 takes some long
    words for equal whatever its base), so these choose buckets and bins, not equals.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    p, q = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:-1], out=total[1:])
    return mixed((total[ends] - total[starts]) * q[starts])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit XXH3 of the words, each distinct one of a slice hashed once."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    cuts = (np.append(starts, ends[-1]) - starts[0]).astype(np.int32)  # white space goes with the word before it
    column = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data[starts[0] : ends[-1]]))])
    coded = column.dictionary_encode()
    known = np.fromiter((xxhash.xxh3_64_intdigest(x.rstrip()) for x in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return known[coded.indices.to_numpy()]


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive values, in order."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out = out * BASE + h[j : j + len(out)]
    return mixed(out)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each span, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    step = np.ones(total, np.int64)
    step[0] = starts[0]
    at = np.cumsum(lengths)[:-1]
    step[at] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(step)


def map_text(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, columns: list[str], text: str = "text") -> DataFrame:
    """mapInArrow of `each` over slices of bounded text."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, text):
            if (out := each(chunk)) is not None:
                yield out

    return df.select(*columns).mapInArrow(apply, schema)


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 modulo 4 (null ids: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sampled(df: DataFrame, rows: int, doc_id: str = "doc_id", *columns: str) -> DataFrame:
    """About `rows` rows, those whose ids hash lowest: a bounded, repeatable sample for fitting a model.

    Ids are ranked alone; texts follow by a broadcast of `rows` ids. Twice as many rows at
    most, should ids repeat.
    """
    ids = df.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("__sampled")).orderBy(F.xxhash64("__sampled"), "__sampled").limit(rows).distinct()
    found = df.select(doc_id, *columns).join(F.broadcast(ids), F.col(doc_id) == F.col("__sampled")).drop("__sampled")
    return found.orderBy(F.xxhash64(doc_id), F.xxhash64(*columns)).limit(2 * rows)
