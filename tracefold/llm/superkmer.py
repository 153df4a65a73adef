"""Substring deduplication on words by super-k-mer partitioning.

Windows of words are partitioned by minimiser: consecutive windows that share one travel
as one packed string to its bucket, where sorting the windows counts them exactly. See
windows.py for the way there; this module has the bucket's sort and the removal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, flat, ragged, words_of
from .windows import Cut, covered, marked, removed_spans, with_spans

WIDTH, GRAM = 35, 8


def window_ranks(units: np.ndarray, width: int) -> np.ndarray:
    """Equal numbers for equal windows of `width` values: ranks of doubled lengths, each by one sort."""
    rank, span = units.astype(np.int64), 1
    while span < width:
        step = min(span, width - span)
        pair = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        span += step
    return rank


class CountWindows:
    """The bucket's kernel: marks windows that different packed strings share."""

    def __init__(self, width: int):
        self.width = width

    def __call__(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = [x.split(b" ") for x in rows.column("packed").to_pylist()]
        sizes = np.array([len(x) for x in texts], np.int64)
        number: dict[bytes, int] = {}
        units = np.fromiter((number.setdefault(w, len(number)) for x in texts for w in x), np.int64, int(sizes.sum()))
        windows = sizes - self.width + 1
        at = ragged(np.cumsum(sizes) - sizes, windows)
        ranks = window_ranks(units, self.width)[at]
        flags = np.bincount(ranks)[ranks] > 1
        return marked(rows, flags, np.concatenate([[0], np.cumsum(windows)]))


def remove_repeated_windows(df: DataFrame, width: int = WIDTH, gram: int = GRAM, text: str = "text", doc_id: str = "doc_id", with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row per input row.

    Every word covered by a window of `width` words whose words also start anywhere else,
    in the same document or another, is removed; windows are judged on the input. A null
    text has no words; shorter texts lose none. Rows that repeat an id and a text count as
    two occurrences; of equal id but different text, each row is judged by its own text.
    Other columns are not read. with_text adds the kept words joined by one space.
    """
    spans = removed_spans(df, Cut(width, gram, True), CountWindows(width), False, text, doc_id)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            data, offsets = flat(batch.column(text))
            starts, ends, _ = words_of(data, offsets)
            bounds = np.searchsorted(starts, offsets)
            gone = covered(bounds, batch.column("spans"))
            raw = data.tobytes()
            kept = []
            for a, b, lo, hi in zip(bounds, bounds[1:], offsets, offsets[1:]):
                if gone[a:b].any():
                    kept.append(b" ".join(raw[s:e] for s, e, g in zip(starts[a:b].tolist(), ends[a:b].tolist(), gone[a:b].tolist()) if not g))
                else:
                    kept.append(b" ".join(raw[lo:hi].split()))
            totals = np.concatenate([[0], np.cumsum(gone)])
            columns = [batch.column("doc_id"), pa.array(np.diff(bounds)), pa.array(totals[bounds[1:]] - totals[bounds[:-1]]), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns.append(pa.array([x.decode() for x in kept], pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {df.schema[doc_id].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return with_spans(df, spans, text, doc_id).mapInArrow(apply, schema)
