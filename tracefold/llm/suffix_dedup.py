"""Substring deduplication on bytes by merging shard Burrows-Wheeler transforms.

windows.py brings strings that may share windows together in buckets. There, shards of
strings are each suffix-sorted on their own and kept as a Burrows-Wheeler transform. The
shards' rows are then interleaved by refinement, without sorting suffixes across shards:
the interleave starts as one shard after the other; each round steps every row to its
predecessor (the transform's last-to-first mapping) in the stable order of the symbols
passed, which are one byte or two, and splits blocks where symbols or former blocks
differ. After h symbols a block holds the rows with a common prefix of h symbols, in
merged order. A row that is alone in its block has its longest common prefix and is left
out of later rounds; rows still in company at the window's length are the repeated
intervals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, flat
from .windows import Cut, covered, marked, removed_spans, with_spans

WIDTH, GRAM = 100, 32
#: Ends every string; not a byte of UTF-8.
END = 0xFF
SHARD_BYTES = 1 << 15
#: Bytes by which a shard's suffixes are first compared: one machine word.
FIRST = 8


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of one shard, cyclic, sorted by their first `depth` symbols at least (ties in any order)."""
    n = len(symbols)
    key = np.zeros(n, np.uint64)
    for j in range(FIRST):
        key = key << np.uint64(8) | np.roll(symbols, -j).astype(np.uint64)
    span = FIRST
    order = np.argsort(key)
    rank = _dense(key, order)
    while span < depth and rank[order[-1]] < n - 1:
        key = rank * n + np.roll(rank, -span)
        order = np.argsort(key)
        rank = _dense(key, order)
        span *= 2
    return order


def _dense(key: np.ndarray, order: np.ndarray) -> np.ndarray:
    rank = np.empty(len(key), np.int64)
    sorted_key = key[order]
    rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
    return rank


def transform(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The Burrows-Wheeler transform: the symbol before each suffix, in their order."""
    return symbols[order - 1]


def last_to_first(bwt: np.ndarray) -> np.ndarray:
    """The row of the suffix one symbol longer, for each row, from the transform alone."""
    out = np.empty(len(bwt), np.int64)
    out[np.argsort(bwt, kind="stable")] = np.arange(len(bwt))
    return out


def merge(transforms: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interleave the rows of all transforms by their first `width` symbols, as far as they are shared.

    Rows are numbered shard after shard; every shard is sorted by `width` symbols at
    least. Returns (rows, block, common): the rows whose first `width` symbols occur again,
    in merged order; their blocks, numbers that grow along it; and for every row the
    symbols compared while it still had company (a multiple of two, or width): its longest
    common prefix with any other, rounded down. No prefix goes beyond an END.
    """
    base = np.cumsum([0, *map(len, transforms)])
    before = np.concatenate(transforms)
    back = np.concatenate([last_to_first(b) + lo for b, lo in zip(transforms, base)])
    steps = {1: (before, back), 2: (before[back].astype(np.uint16) << np.uint16(8) | before, back[back])}
    ended = {1: before == END, 2: (before == END) | (before[back] == END)}
    common = np.zeros(len(before), np.int32)
    rows, block, done = np.arange(len(before)), np.zeros(len(before), np.int64), 0
    while done < width and len(rows):
        by = min(2, width - done)
        symbol, to = steps[by]
        live = ~ended[by][rows]
        rows, block = rows[live], block[live]
        key = symbol[rows]
        order = np.argsort(key, kind="stable")  # a counting sort: keys have 16 bits at most
        key, block = key[order], block[order]
        fresh = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])])[: len(key)])
        size = np.diff(np.append(fresh, len(key)))
        company = np.repeat(size > 1, size)
        rows, block = to[rows[order[company]]], np.repeat(np.arange(len(size)), size)[company]
        done += by
        common[rows] = done
    return rows, block, common


class MergeTransforms:
    """The bucket's kernel: marks windows that an earlier string of the bucket has too."""

    def __init__(self, width: int):
        self.width = width

    def __call__(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        packed = rows.column("packed").to_pylist()
        sizes = np.array([len(x) + 1 for x in packed], np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        symbols = np.frombuffer(bytes([END]).join(packed) + bytes([END]), np.uint8)
        group = begin[:-1] // min(SHARD_BYTES, max(1, len(symbols) // 2))
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(packed)]
        transforms, places = [], []
        for a, b in zip(cuts, cuts[1:]):
            shard = symbols[begin[a] : begin[b]]
            order = suffix_order(shard, self.width)
            transforms.append(transform(shard, order))
            places.append(order + begin[a])
        shared, block, _ = merge(transforms, self.width)
        place = np.concatenate(places)[shared]
        string = np.searchsorted(begin, place, "right") - 1
        offset = place - begin[string]
        doc, start = _order(rows)
        order = np.lexsort((start[string] + offset, doc[string], block))
        block, string, offset = block[order], string[order], offset[order]
        head = np.maximum.accumulate(np.where(np.concatenate([[True], block[1:] != block[:-1]])[: len(block)], np.arange(len(block)), 0))
        position = start[string] + offset
        again = (doc[string] != doc[string[head]]) | (position != position[head])  # a repeated row's copy of the first is no later one
        bounds = np.concatenate([[0], np.cumsum(sizes - self.width)])
        flags = np.zeros(int(bounds[-1]), bool)
        flags[bounds[string[again]] + offset[again]] = True
        return marked(rows, flags, bounds)


def _order(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Documents as ranks (null first), and starts."""
    ids = rows.column("doc").to_pylist()
    rank = {x: i for i, x in enumerate(sorted({x for x in ids if x is not None}), 1)}
    return np.array([rank.get(x, 0) for x in ids], np.int64), np.asarray(rows.column("start")).astype(np.int64)


def remove_repeated_bytes(df: DataFrame, width: int = WIDTH, gram: int = GRAM, text: str = "text", doc_id: str = "doc_id", with_bytes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per input row.

    Every byte of the UTF-8 text that is covered by a string of `width` bytes which also
    starts earlier (smaller id, or same document and earlier start) is removed; strings
    are judged on the input, never cross documents, and may overlap. A null text is
    empty. A null id counts as the smallest. Rows that repeat an id and a text are one
    document and get equal results; of equal id but different text, the row that is the
    least by (id, start) keeps a string they share at different starts. Other columns are
    not read. with_bytes adds the remaining bytes.
    """
    if width < FIRST:
        raise ValueError(f"width must be {FIRST} at least")
    spans = removed_spans(df, Cut(width, gram, False), MergeTransforms(width), True, text, doc_id)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            data, offsets = flat(batch.column(text))
            gone = covered(offsets, batch.column("spans"))
            head = gone.copy()
            head[1:] &= ~gone[:-1]
            firsts = offsets[:-1][np.diff(offsets) > 0]
            head[firsts] = gone[firsts]
            removed, spans_ = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, head))
            left = data[~gone].tobytes()
            ends = offsets - removed[offsets]
            kept = [left[a:b] for a, b in zip(ends, ends[1:])]
            columns = [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(np.diff(removed[offsets])), pa.array(np.diff(spans_[offsets])), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_bytes:
                columns.append(pa.array(kept, pa.binary()))
                names.append("kept_bytes")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {df.schema[doc_id].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_bytes binary" if with_bytes else "")
    return with_spans(df, spans, text, doc_id).mapInArrow(apply, schema)
