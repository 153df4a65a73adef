"""Repeated windows of a corpus, exactly, by minimisers: what the two substring operators share.

A window is `width` consecutive units (words or bytes) of one document. Its minimiser is
the leftmost least-ranked gram of some units in it, so equal windows have equal
minimisers at equal places. Consecutive windows that share a minimiser occurrence form a
run, which can travel as one packed string of its units (words: joined by one space).

1. cut: every document gives its runs as (minimiser hash, 128-bit digest of the packed
   string, document, start, windows). No text travels. Long documents are cut in slices
   that overlap by a window, so memory doesn't follow the longest document.
2. A window can only repeat if its minimiser occurs again, so only runs whose minimiser
   was met twice stay.
3. Copies of a packed string combine before they meet: one string with its least
   occurrence and a number of occurrences, map-side first. Equality of whole strings goes
   by a cryptographic digest of their bytes; equality of windows by the bytes themselves.
4. pack: where a minimiser has several different strings, the least occurrence of each
   meets its document's text and becomes a packed string, dealt to its minimiser's bucket.
5. There a kernel (given by the operator) compares the windows of different strings.

A minimiser with more than HOT different strings makes no bucket: its windows are cut anew
by a longer gram (up to the whole window, whose bucket holds one string), so every window
goes by the same method and no bucket is unbounded. Keys with very many rows are joined by
a broadcast of those keys, of which there can't be many (`join_known`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, chunks, dealt_anew, flat, forget, ragged, runs, span_hashes, temporary, words_of, written

#: Different strings of a minimiser beyond which its windows are cut by a longer gram.
HOT = 2000
#: A key is joined by broadcast if it has more rows than this and than one in MOST_KEYS of all: at most MOST_KEYS keys are.
MANY_ROWS, MOST_KEYS = 2000, 20_000
#: Bytes of text that numpy holds at a time where units are bytes, and bytes of strings packed at a time.
BYTES_AT_ONCE, PACKED_AT_ONCE = 1 << 19, 1 << 20
#: Units of a long document that are cut at a time.
SLICE = 1 << 19
#: Bytes of packed strings that a kernel takes at a time, whole buckets of them.
BUCKET_BYTES = 1 << 19


@dataclass(frozen=True)
class Cut:
    """How documents are cut: words of ASCII white space, or bytes."""

    width: int
    gram: int
    words: bool

    @property
    def grams(self) -> tuple[int, ...]:
        """Gram lengths of the first cut and of those of hot buckets; the last is a whole window."""
        return tuple(sorted({self.gram, (self.gram + self.width) // 2, self.width}))

    @property
    def at_once(self) -> int:
        return CHUNK_BYTES if self.words else BYTES_AT_ONCE


def units(data: np.ndarray, offsets: np.ndarray, cut: Cut) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None, np.ndarray]:
    """(bytes, starts, ends, documents' offsets in units); words stand joined by one space, bytes need no starts."""
    if not cut.words:
        return data, None, None, offsets
    raw = data.tobytes()
    joined = [b" ".join(raw[a:b].split()) + b" " for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
    at = np.concatenate([[0], np.cumsum([len(x) for x in joined])]).astype(np.int64)
    text = np.frombuffer(b"".join(joined), np.uint8)
    starts, ends, _ = words_of(text, at)
    return text, starts, ends, np.searchsorted(starts, at)


def minimisers(grams: np.ndarray, inside: np.ndarray, docs: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, place of the minimiser) of the runs of wanted windows; docs: the document of each window."""
    n = len(inside)
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    bits = np.uint64(max(1, int(len(grams)).bit_length()))
    key = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)  # rank, then the leftmost place
    span, least = 1, key
    while span * 2 <= places:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < places:
        extra = places - span
        least = np.minimum(least[:-extra], least[extra:])
    place = (least[:n] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    parted = ~inside[:-1] | ~inside[1:] | (place[1:] != place[:-1]) | (docs[1:] != docs[:-1])
    first, last = inside.copy(), inside.copy()
    first[1:] &= parted
    last[:-1] &= parted
    a = np.flatnonzero(first)
    return a, np.flatnonzero(last) + 1 - a, place[a]


def runs_of(data: np.ndarray, starts: np.ndarray | None, ends: np.ndarray | None, bounds: np.ndarray, wanted: np.ndarray | None, cut: Cut, gram: int) -> Iterator[tuple]:
    """(document, start, windows, minimiser hashes, digests of the packed strings as two columns), by slices of SLICE units."""
    total = int(bounds[-1])
    whole = memoryview(np.ascontiguousarray(data))
    for a in range(0, max(1, total - cut.width + 1), SLICE):
        b = min(total, a + SLICE + cut.width - 1)  # windows a .. b - width
        n = b - a - cut.width + 1
        if n <= 0:
            return
        docs = np.searchsorted(bounds, np.arange(a, b), "right") - 1
        inside = docs[:n] == docs[cut.width - 1 :]
        if wanted is not None:
            inside &= wanted[a : a + n]
        if starts is None:
            lo, text = a, data[a:b]
            from_, to = np.arange(b - a), np.arange(1, b - a + 1)
        else:
            lo = int(starts[a])
            text = data[lo : int(ends[b - 1])]
            from_, to = starts[a:b] - lo, ends[a:b] - lo
        grams = span_hashes(text, from_[: len(from_) - gram + 1], to[gram - 1 :])
        first, windows, place = minimisers(grams, inside, docs[:n], cut.width - gram + 1)
        digests = [hashlib.blake2b(whole[x:y], digest_size=16).digest() for x, y in zip((from_[first] + lo).tolist(), (to[first + windows + cut.width - 2] + lo).tolist())]
        s = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        own = docs[first]
        yield own, first + a - bounds[own], windows, grams[place].view(np.int64), s[:, 0], s[:, 1]


def cut_runs(df: DataFrame, cut: Cut, gram: int, kind: str) -> DataFrame:
    """(m, s, z, doc, copy, start, windows) of all windows of df (doc, copy, text), or of those listed where it has a column wanted."""
    listed = "wanted" in df.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", cut.at_once):
            data, starts, ends, bounds = units(*flat(batch.column("text")), cut)
            wanted = covered(bounds, batch.column("wanted")) if listed else None
            for own, start, windows, m, s, z in runs_of(data, starts, ends, bounds, wanted, cut, gram):
                at = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(m), pa.array(s), pa.array(z), batch.column("doc").take(at), batch.column("copy").take(at), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32))],
                    ["m", "s", "z", "doc", "copy", "start", "windows"],
                )

    return df.mapInArrow(apply, f"m long, s long, z long, doc {kind}, copy long, start int, windows int")


def _copy(text: str):
    """Tells rows of equal id but different text apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("copy")


def pack(texts: DataFrame, cut: Cut, kind: str) -> DataFrame:
    """(m, packed, doc, copy, start) of the listed runs (column runs: structs m, start, windows)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", cut.at_once):
            data, starts, ends, bounds = units(*flat(batch.column("text")), cut)
            listed = batch.column("runs")
            row = np.repeat(np.arange(len(listed)), np.asarray(pc.list_value_length(listed)))
            inner = listed.flatten()
            m, start, n = (np.asarray(inner.field(c)) for c in ("m", "start", "windows"))
            lo = bounds[row] + start
            hi = lo + n + cut.width - 1
            if starts is not None:
                lo, hi = starts[lo], ends[hi - 1]
            group = np.cumsum(hi - lo) // PACKED_AT_ONCE
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(m)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                size = hi[a:b] - lo[a:b]
                raw = data[ragged(lo[a:b], size)]
                packed = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])
                own = pa.array(row[a:b])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(m[a:b]), packed, batch.column("doc").take(own), batch.column("copy").take(own), pa.array(start[a:b].astype(np.int32))],
                    ["m", "packed", "doc", "copy", "start"],
                )

    return texts.select("doc", "copy", "text", "runs").mapInArrow(apply, f"m long, packed binary, doc {kind}, copy long, start int")


def in_buckets(strings: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch], kind: str) -> DataFrame:
    """Run the kernel on whole buckets; a task streams over its sorted rows and holds BUCKET_BYTES at a time."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column("packed").nbytes
            if size < BUCKET_BYTES:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            key = np.asarray(rows.column("m"))
            change = np.flatnonzero(key[1:] != key[:-1]) + 1
            if not len(change):
                continue
            weight = np.cumsum(np.asarray(pc.binary_length(rows.column("packed"))))
            begin = 0
            for c in change.tolist():
                if weight[c - 1] - (weight[begin - 1] if begin else 0) >= BUCKET_BYTES or c == change[-1]:
                    yield kernel(rows.slice(begin, c - begin).combine_chunks().to_batches()[0])
                    begin = c
            rest = rows.slice(begin).combine_chunks()
            held = rest.to_batches()
            size = rest.column("packed").nbytes
        if held:
            yield kernel(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return strings.mapInArrow(apply, f"doc {kind}, copy long, start int, marks array<int>")


def join_known(rows: DataFrame, known: DataFrame, keys: list[str], times: str, total: int) -> DataFrame:
    """rows joined with known, a written table of one row a key that has the number of the key's rows in `times`.

    Keys of more than MANY_ROWS rows, and more than one in MOST_KEYS of all `total` rows,
    come by broadcast (there can be MOST_KEYS of them at most) and their rows stay where
    they are; all others meet by sort-merge, in which no key has more than that.
    """
    often = F.col(times) > max(MANY_ROWS, total // MOST_KEYS)
    hot = known.where(often)
    if hot.isEmpty():
        return rows.join(dealt_anew(known), keys)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(dealt_anew(known.where(~often)), keys)
    return cold.unionByName(rows.join(F.broadcast(hot), keys))


def removed_spans(df: DataFrame, cut: Cut, kernel: Callable, first_stays: bool, text: str, doc_id: str) -> DataFrame:
    """(doc, copy, spans): for each document the covered unit ranges [from, to), not merged.

    first_stays: the least occurrence (document, start) of a window is not covered by it;
    otherwise every occurrence of a window met twice is.
    """
    with temporary() as keep:
        return keep(_removed_spans(df, cut, kernel, first_stays, text, doc_id))


def _removed_spans(df: DataFrame, cut: Cut, kernel: Callable, first_stays: bool, text: str, doc_id: str) -> DataFrame:
    spark, kind = df.sparkSession, df.schema[doc_id].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = df.select(F.col(doc_id).alias("doc"), _copy(text), F.col(text).alias("text"))
    place, string = F.struct("doc", "start", "copy"), ["m", "s", "z", "windows"]
    asked, spans = texts, []
    for gram in cut.grams:
        found = written(cut_runs(asked, cut, gram, kind), "runs")
        total = found.count()
        met = written(found.groupBy("m").agg(F.count("*").alias("times")).where("times > 1"), "met")
        again = written(join_known(found, met, ["m"], "times", total).drop("times"), "again")
        forget(found)
        forget(met)
        groups = written(again.groupBy(string).agg(F.min(place).alias("first"), F.count("*").alias("times")), "groups")
        whole = join_known(again, groups.where("times > 1"), string, "times", total)
        if first_stays:
            whole = whole.where(~place.eqNullSafe(F.col("first")))
        whole = whole.select("doc", "copy", "start", F.array(F.lit(0), F.col("windows")).alias("pair"))

        several = written(groups.groupBy("m").agg(F.count("*").alias("n")).where("n > 1"), "several")
        hot = F.col("n") > HOT if gram < cut.width else F.lit(False)
        meeting = join_known(groups, several, ["m"], "n", total).select("m", "first.doc", "first.copy", "first.start", "windows", hot.alias("hot"))
        run = F.struct("m", "start", "windows")
        by_doc = meeting.groupBy(F.col("doc").alias("doc_"), F.col("copy").alias("copy_")).agg(
            F.collect_list(F.when(~F.col("hot"), run)).alias("runs"), F.collect_list(F.when(F.col("hot"), F.struct(F.col("start").alias("from"), (F.col("start") + F.col("windows")).alias("to")))).alias("wanted")
        )
        listed = written(by_doc, "listed")
        own = F.col("doc").eqNullSafe(F.col("doc_")) & (F.col("copy") == F.col("copy_"))
        packed = written(pack(texts.join(listed.where("size(runs) > 0").drop("wanted"), own), cut, kind), "packed")
        marks = in_buckets(packed.repartition(parts, "m").sortWithinPartitions("m"), kernel, kind)
        pairs = F.transform(F.sequence(F.lit(0), (F.size("marks") / 2 - 1).cast("int")), lambda i: F.slice("marks", 2 * i + 1, 2))
        partial = marks.where("size(marks) > 0").select("doc", "copy", "start", F.explode(pairs).alias("pair"))
        span = F.struct((F.col("start") + F.col("pair")[0]).alias("from"), (F.col("start") + F.col("pair")[1] + cut.width - 1).alias("to"))
        spans.append(whole.unionByName(partial).select("doc", "copy", span.alias("span")))
        if several.where(F.col("n") > HOT).isEmpty():
            break
        # the least occurrences of the strings of hot buckets go by a longer gram
        asked = texts.join(listed.where("size(wanted) > 0").drop("runs"), own).select("doc", "copy", "text", "wanted")
    every = spans[0]
    for s in spans[1:]:
        every = every.unionByName(s)
    return written(every.groupBy("doc", "copy").agg(F.collect_list("span").alias("spans")), "spans")


def covered(bounds: np.ndarray, spans: pa.Array) -> np.ndarray:
    """Which units the documents' spans cover; bounds: the documents' offsets in units."""
    sizes = np.diff(bounds)
    shifted = bounds + np.arange(len(bounds))  # one more place a document, for spans that end with it
    change = np.zeros(int(shifted[-1]) + 1, np.int32)
    times = np.asarray(pc.fill_null(pc.list_value_length(spans), 0)).astype(np.int64)
    if times.sum():
        inner = spans.flatten()
        doc = np.repeat(np.arange(len(sizes)), times)
        for name, by in (("from", 1), ("to", -1)):
            np.add.at(change, shifted[doc] + np.minimum(np.asarray(inner.field(name)).astype(np.int64), sizes[doc]), np.int32(by))
    flags = np.cumsum(change, out=change) > 0
    return flags[: int(sizes[0])] if len(sizes) == 1 else flags[ragged(shifted[:-1], sizes)]


def with_spans(df: DataFrame, spans: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Every row of df with its spans (null: none)."""
    own = df.select(F.col(doc_id).alias("doc_id"), text, _copy(text))
    return own.join(spans.withColumnsRenamed({"copy": "copy_"}), F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("copy") == F.col("copy_")), "left").select("doc_id", text, "spans")


def marked(rows: pa.RecordBatch, flags: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    """(doc, copy, start, marks) of the strings with flagged windows: ranges [from, to) one after the other; bounds: the strings' offsets in windows."""
    starts, ends = runs(flags, bounds)
    own = np.searchsorted(bounds, starts, "right") - 1
    marks = np.stack([starts - bounds[own], ends - bounds[own]], 1).ravel().astype(np.int32)
    which, first = np.unique(own, return_index=True)
    at = np.append(2 * first, len(marks)).astype(np.int32)
    named = [rows.column(c).take(pa.array(which)) for c in ("doc", "copy", "start")]
    return pa.RecordBatch.from_arrays([*named, pa.ListArray.from_arrays(pa.array(at), pa.array(marks))], ["doc", "copy", "start", "marks"])
