"""Toxicity by a convolutional text classifier, trained in numpy.

Words (runs of letters, A-Z lower-cased) get the sum of hashed embeddings: two of the
word itself, so that a chance collision in one table moves a word half-way at most, and
one of each of its proper beginnings of three to eight bytes, so that a stem counts in
words that the sample lacks. Filters of several widths
run over the words of a whole document, each keeps its largest response, and a logistic
layer reads those. Documents are assigned a language by their text alone, and the
score's zero point is calibrated for each language so that 0.3 is its best threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, flat, held_out, mixed, ragged, runs, span_hashes
from .quality import FOLD, LETTER

BUCKETS, DIM = 1 << 16, 6
#: Proper beginnings of a word that have embeddings, in bytes; a shorter word has none (the last row, zero).
STEMS = (3, 4, 5, 6, 7, 8)
TABLES = 2 + len(STEMS)
WIDTHS, FILTERS = (1, 2, 3), 6
THRESHOLD = 0.3
#: Bound of the labelled sample, in rows; their texts are taken whole.
SAMPLE_ROWS = 4000
#: Bins of the words that tell languages apart, and toxic rows that a language needs for a calibration of its own.
LANGUAGE_BINS, LEAST_TOXIC = 4096, 10
EPOCHS, BATCH, RATE, TABLE_RATE, SEED = 4, 64, 0.02, 0.004, 11
#: Rows from which a word's log-odds count in full (a twelfth of the toxic rows, if fewer, 3 at least); one row in CALIBRATION is kept from the fit, to calibrate on.
SEEN, CALIBRATION = 15, 4


@dataclass
class Classifier:
    tables: np.ndarray = field(default_factory=lambda: np.zeros((TABLES, BUCKETS + 1, DIM), np.float32))
    filters: list[np.ndarray] = field(default_factory=lambda: [np.zeros((w * DIM, FILTERS), np.float32) for w in WIDTHS])
    offsets: list[np.ndarray] = field(default_factory=lambda: [np.zeros(FILTERS, np.float32) for _ in WIDTHS])
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    bias: float = -2.0
    languages: np.ndarray = field(default_factory=lambda: np.zeros((LANGUAGE_BINS, 1), np.float32))
    zeros: np.ndarray = field(default_factory=lambda: np.zeros(1))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hashes, places in the tables, document offsets) of the words of a slice."""
    starts, ends = runs(LETTER[data], offsets)
    text = FOLD[data]
    h = span_hashes(text, starts, ends)
    at = [h % np.uint64(BUCKETS), mixed(h) % np.uint64(BUCKETS)]
    for size in STEMS:
        longer = ends - starts > size
        place = np.full(len(h), BUCKETS, np.uint64)
        place[longer] = span_hashes(text, starts[longer], starts[longer] + size) % np.uint64(BUCKETS)
        at.append(place)
    return h, np.stack(at).astype(np.int32), np.searchsorted(starts, offsets)


def embed(model: Classifier, at: np.ndarray) -> np.ndarray:
    out = model.tables[0][at[0]]
    for table, place in zip(model.tables[1:], at[1:]):
        out += table[place]
    return out


def responses(model: Classifier, x: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """Responses of the k-th width at each first word; windows don't cross documents."""
    w = WIDTHS[k]
    n = len(x) - w + 1
    out = np.full((len(x), FILTERS), -np.inf, np.float32)
    if n > 0:
        total = x[:n] @ model.filters[k][:DIM]
        for j in range(1, w):
            total += x[j : j + n] @ model.filters[k][j * DIM : (j + 1) * DIM]
        out[:n] = total + model.offsets[k]
        for j in range(1, w):  # windows that would end in a later document
            last = bounds[1:] - j
            out[last[last >= bounds[:-1]]] = -np.inf
    return out


def pooled(model: Classifier, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The largest responses, 0 at least, by document."""
    n = len(bounds) - 1
    out = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
    some = np.flatnonzero(np.diff(bounds) > 0)
    if len(some):
        for k in range(len(WIDTHS)):
            out[some, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(responses(model, x, bounds, k), bounds[some], axis=0)
    return np.maximum(out, 0)


def language_bins(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(LANGUAGE_BINS)).astype(np.int16)


def language_of(model: Classifier, bins: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The likeliest language by the words' bins; the first for a document without words."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    totals = np.stack([np.bincount(doc, model.languages[bins, j], len(bounds) - 1) for j in range(model.languages.shape[1])], 1)
    return totals.argmax(1)


def raw_scores(model: Classifier, at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return pooled(model, embed(model, at), bounds) @ model.weights + model.bias


def predict(model: Classifier, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    h, at, bounds = words(data, offsets)
    _, first, back = np.unique(h, return_index=True, return_inverse=True)  # a word is looked up once
    z = pooled(model, embed(model, at[:, first])[back], bounds) @ model.weights + model.bias - model.zeros[language_of(model, language_bins(h), bounds)] + np.log(THRESHOLD / (1 - THRESHOLD))
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _encoded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language bins, places in the tables, document offsets) of the sample's words, made in slices."""
    parts, sizes = [], []
    for batch in chunks([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])], limit=1 << 19):
        h, at, bounds = words(*flat(batch.column("text")))
        parts.append((language_bins(h), at))
        sizes.append(np.diff(bounds))
    return np.concatenate([b for b, _ in parts]), np.concatenate([a for _, a in parts], 1), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def _rows(values: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words [.., word] of some documents, and their offsets."""
    sizes = np.diff(bounds)[which]
    return values[:, ragged(bounds[which], sizes)], np.concatenate([[0], np.cumsum(sizes)])


def _best_zero(z: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the gap that separates the two labels with fewest errors."""
    order = np.argsort(z, kind="stable")
    z, toxic = z[order], toxic[order]
    errors = np.concatenate([[0], np.cumsum(toxic)]) + np.concatenate([np.cumsum((1 - toxic)[::-1])[::-1], [0]])
    best = np.flatnonzero(errors == errors.min())
    edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    gap = np.concatenate([[0], np.diff(z), [0]])
    return float(edges[best[np.argmax(gap[best])]])


def train(texts: list[str], toxic: list[int], langs: list[str | None]) -> Classifier:
    """Fit by Adam on the logistic loss; the first embedding coordinate starts from the words' log-odds."""
    rng = np.random.default_rng(SEED)
    model = Classifier()
    y = np.array(toxic, np.float32)
    if not len(y) or y.min() == y.max():
        model.bias = 4.0 if len(y) and y[0] else -4.0
        return model
    names = sorted({x for x in langs if x is not None}, key=lambda x: (-langs.count(x), x))
    bins, at, bounds = _encoded(texts)
    if names:
        doc = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(bounds))
        of_word = np.array([names.index(x) if x in names else -1 for x in langs], np.int16)[doc]
        counts = np.stack([np.bincount(bins[of_word == j], minlength=LANGUAGE_BINS) for j in range(len(names))], 1) + 0.1
        model.languages = np.log(counts / counts.sum(0)).astype(np.float32)
    apart = np.arange(len(y)) % CALIBRATION == 0
    if min(y[~apart].max(), y[apart].max()) == 0:  # too few toxic rows to keep any apart
        apart[:] = False
    kept = np.flatnonzero(~apart)
    _start(model, *_rows(at, bounds, kept), y[kept], rng)
    _descend(model, *_rows(at, bounds, kept), y[kept], rng)
    check = np.flatnonzero(apart) if apart.any() else kept
    bins, _ = _rows(bins[None], bounds, check)
    at, bounds = _rows(at, bounds, check)
    z, y = raw_scores(model, at, bounds), y[check]
    model.zeros = np.full(max(1, len(names)), _best_zero(z, y))
    found = language_of(model, bins[0], bounds)
    for j in range(len(names)):
        own = found == j
        if y[own].sum() >= LEAST_TOXIC and (1 - y[own]).sum() >= LEAST_TOXIC:
            model.zeros[j] = _best_zero(z[own], y[own])
    return model


def _start(model: Classifier, at: np.ndarray, bounds: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
    """First weights; the first coordinate of an embedding is the shrunken log-odds of its words."""
    seen = min(SEEN, max(3, float(y.sum()) / 12))
    doc = np.repeat(np.arange(len(y)), np.diff(bounds))
    model.tables = rng.normal(0, 0.01, model.tables.shape).astype(np.float32)
    for k in range(TABLES):
        pairs = np.unique(doc * (BUCKETS + 1) + at[k])
        bucket, label = pairs % (BUCKETS + 1), y[pairs // (BUCKETS + 1)]
        bad, good = np.bincount(bucket, label, BUCKETS + 1), np.bincount(bucket, 1 - label, BUCKETS + 1)
        odds = np.log((bad + 0.5) / (y.sum() + 1)) - np.log((good + 0.5) / ((1 - y).sum() + 1))
        model.tables[k, :, 0] = 0.25 * np.where(bad + good > 0, np.clip(odds, -4, 6) * np.minimum(1, (bad + good) / seen), 0)
    model.tables[:, BUCKETS] = 0
    for k, (w, f) in enumerate(zip(WIDTHS, model.filters)):
        f[...] = rng.normal(0, 0.1, f.shape)
        f[0::DIM, :] += 1.0 / w
        model.offsets[k][...] = -0.5
    model.weights[...] = 0.3


def _descend(model: Classifier, at: np.ndarray, bounds: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
    dense = [*model.filters, *model.offsets, model.weights]
    first, second = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense]
    table_second = np.full(model.tables.shape, 1e-6, np.float32)
    bias, step = np.zeros(3), 0
    sizes = np.diff(bounds)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for begin in range(0, len(order), BATCH):
            docs = order[begin : begin + BATCH]
            some = docs[sizes[docs] > 0]
            if not len(some):
                continue
            pick = np.concatenate([np.arange(bounds[d], bounds[d + 1]) for d in some])
            b = np.concatenate([[0], np.cumsum(sizes[some])])
            place = at[:, pick]
            x = embed(model, place)
            tops, values = [], np.zeros((len(some), len(WIDTHS) * FILTERS), np.float32)
            for k in range(len(WIDTHS)):
                r = responses(model, x, b, k)
                top = np.stack([lo + r[lo:hi].argmax(0) for lo, hi in zip(b, b[1:])])
                tops.append(top)
                values[:, k * FILTERS : (k + 1) * FILTERS] = np.take_along_axis(r, top, 0)
            active = values > 0
            values = np.where(active, values, 0)
            z = values @ model.weights + model.bias
            weight = np.where(y[some] > 0, 2.0, 1.0)
            slope = (weight * (1 / (1 + np.exp(-z)) - y[some]) / len(some)).astype(np.float32)
            grads = [np.zeros_like(p) for p in dense]
            grads[-1] = slope @ values + 1e-4 * model.weights
            back = slope[:, None] * model.weights[None, :] * active
            table_slope = np.zeros((len(pick), DIM), np.float32)
            for k, w in enumerate(WIDTHS):
                g, top = back[:, k * FILTERS : (k + 1) * FILTERS], tops[k]
                grads[len(WIDTHS) + k] = g.sum(0)
                for j in range(w):
                    here = np.minimum(top + j, len(pick) - 1)
                    grads[k][j * DIM : (j + 1) * DIM] = np.einsum("nf,nfd->df", g, x[here])
                    np.add.at(table_slope, here, g[:, :, None] * model.filters[k][j * DIM : (j + 1) * DIM].T[None])
            step += 1
            for p, g, m, v in zip(dense, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            g = float(slope.sum())
            bias += [0.1 * (g - bias[0]), 0.001 * (g * g - bias[1]), 0]
            model.bias -= RATE * (bias[0] / (1 - 0.9**step)) / (np.sqrt(bias[1] / (1 - 0.999**step)) + 1e-8)
            moved = np.flatnonzero(np.abs(table_slope).sum(1) > 0)
            for k in range(TABLES):
                rows = place[k, moved]
                np.add.at(table_second[k], rows, table_slope[moved] ** 2)
                np.add.at(model.tables[k], rows, -TABLE_RATE * table_slope[moved] / np.sqrt(table_second[k][rows]))
            model.tables[:, BUCKETS] = 0


def fit(df: DataFrame, labels: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Classifier:
    """A classifier fitted on SAMPLE_ROWS labelled rows that aren't held out, those whose ids hash lowest.

    Null texts count as empty, of repeated labels the highest counts; without labels, or
    with labels all alike, the classifier gives every text one score.
    """
    known = labels.where(~held_out(doc_id) & F.col("toxic").isNotNull()).groupBy(F.col(doc_id).alias("__labelled")).agg(F.max("toxic").alias("__toxic"))
    chosen = known.orderBy(F.xxhash64("__labelled"), "__labelled").limit(SAMPLE_ROWS)
    rows = df.select(doc_id, F.coalesce(F.col(text), F.lit("")).alias("__text"), F.col(lang).cast("string").alias("__lang"))
    rows = rows.join(F.broadcast(chosen), F.col(doc_id) == F.col("__labelled")).select("__labelled", "__text", "__lang", "__toxic")
    rows = rows.orderBy(F.xxhash64("__labelled"), "__labelled", F.xxhash64("__text", "__lang")).limit(2 * SAMPLE_ROWS).collect()
    rows.sort(key=lambda r: (str(r[0]), r[1], r[2] or ""))
    return train([r["__text"] for r in rows], [int(r["__toxic"] > 0) for r in rows], [r["__lang"] for r in rows])


def score_toxicity(df: DataFrame, model: Classifier | None = None, labels: DataFrame | None = None, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row, over whole texts.

    predicted is 1 where score is 0.3 or more. A null or empty text, or one without
    letters, has the score of no response at all. Labels without a document and rows
    without a label are harmless; of repeated labels the highest counts; if the labels are
    all alike, so are the scores. Only the text is read for a score.
    """
    if model is None:
        model = fit(df, labels, text, lang, doc_id)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            score = predict(shared.value, *flat(batch.column(text)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score.astype(float)), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    schema = f"doc_id {df.schema[doc_id].dataType.simpleString()}, held_out boolean, score double, predicted int"
    return df.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), text).mapInArrow(apply, schema)
