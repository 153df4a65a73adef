"""Quality rules: counts of the text, and its divergence from language references.

References are the character-class and common-word histograms of each language over the
whole corpus. A document long enough is held against them by Jensen-Shannon distance;
one that is far from every language in either histogram is rejected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, chunks, flat, gram_hashes, mixed, runs, span_hashes, words_of

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Character classes: lower case, upper case, digit, white space, symbol, other ASCII, and
#: non-ASCII by the length of its UTF-8 form; continuation bytes count nowhere.
CLASSES, NO_CLASS = 9, 9
CLASS = np.full(256, 5, np.uint8)
CLASS[ord("a") : ord("z") + 1] = 0
CLASS[ord("A") : ord("Z") + 1] = 1
CLASS[ord("0") : ord("9") + 1] = 2
CLASS[IS_SPACE] = 3
CLASS[list(SYMBOLS)] = 4
CLASS[0xC0:0xE0], CLASS[0xE0:0xF0], CLASS[0xF0:] = 6, 7, 8
CLASS[0x80:0xC0] = NO_CLASS
LETTER = (CLASS <= 1) | (np.arange(256) >= 0x80)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
#: Words fall into so many hashed bins; a language's common words are its heaviest bins.
BINS, COMMON = 4096, 64


@dataclass
class Rules:
    min_words: int = 20
    max_repeat: float = 0.30
    #: Documents of fewer words are not held against the references.
    guard_words: int = 50
    #: Jensen-Shannon distance (0 to 1) of classes above which a document is unlike every language.
    max_class_distance: float = 0.29
    #: The same of words, as a share of the distance that a text without any common word of the language has.
    max_word_share: float = 0.93
    class_refs: np.ndarray = field(default_factory=lambda: np.zeros((0, CLASSES)))
    word_refs: np.ndarray = field(default_factory=lambda: np.zeros((0, COMMON + 1)))
    common: np.ndarray = field(default_factory=lambda: np.zeros((0, COMMON), np.int64))


def class_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    docs = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return np.bincount(docs * (CLASSES + 1) + CLASS[data], minlength=(len(offsets) - 1) * (CLASSES + 1)).reshape(-1, CLASSES + 1)[:, :CLASSES]


def word_bins(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bin) of each run of letters, A-Z lower-cased."""
    starts, ends = runs(LETTER[data], offsets)
    return np.searchsorted(offsets, starts, "right") - 1, (span_hashes(FOLD[data], starts, ends) % np.uint64(BINS)).astype(np.int64)


def histograms(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, kind, bin, n): counts of the whole corpus; one row per task, language and bin is shuffled."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in chunks(batches, text):
            names = batch.column(lang).to_pylist()
            code = {x: i for i, x in enumerate(dict.fromkeys(names))}
            which = np.array([code[x] for x in names])
            data, offsets = flat(batch.column(text))
            by_class = class_counts(data, offsets)
            doc, bins = word_bins(data, offsets)
            by_bin = np.bincount(which[doc] * BINS + bins, minlength=len(code) * BINS).reshape(-1, BINS) if len(doc) else np.zeros((len(code), BINS), np.int64)
            for name, i in code.items():
                if name is not None:
                    total[name] = total.get(name, 0) + np.concatenate([by_class[which == i].sum(0), by_bin[i]])
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], ["lang", "bin", "n"])

    counted = df.select(F.col(lang).cast("string").alias(lang), text).mapInArrow(apply, "lang string, bin int, n long")
    return counted.groupBy("lang", "bin").agg(F.sum("n").alias("n"))


def fit(df: DataFrame, text: str = "text", lang: str = "lang", **rules) -> Rules:
    """References of all languages from all rows; what comes to the driver is a fixed number of bins each. Without a language there are none."""
    table: dict[str, np.ndarray] = {}
    for r in histograms(df, text, lang).toLocalIterator():
        table.setdefault(r["lang"], np.zeros(CLASSES + BINS))[r["bin"]] = r["n"]
    found = Rules(**rules)
    names = sorted(table)
    if names:
        n = np.stack([table[x] for x in names])
        found.class_refs = n[:, :CLASSES] / np.maximum(1, n[:, :CLASSES].sum(1, keepdims=True))
        words = n[:, CLASSES:]
        found.common = np.argsort(-words, axis=1, kind="stable")[:, :COMMON]
        top = np.take_along_axis(words, found.common, 1)
        found.word_refs = np.concatenate([top, (words.sum(1) - top.sum(1))[:, None]], 1) / np.maximum(1, words.sum(1, keepdims=True))
    return found


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Square root of the Jensen-Shannon divergence in bits, along the last axis."""
    m = (p + q) / 2

    def kl(x: np.ndarray) -> np.ndarray:
        return np.sum(np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0), -1)

    return np.sqrt(np.maximum(0, (kl(p) + kl(q)) / 2))


def repeated_words(texts: list[bytes], hashes: np.ndarray, docs: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words in WINDOW-word windows that a document has twice or more. Hashes find the documents; the words decide."""
    out = np.zeros(len(texts), np.int64)
    h = gram_hashes(hashes, WINDOW)
    if not len(h):
        return out
    own = docs[: len(h)]
    inside = own == docs[WINDOW - 1 :]
    h, own = mixed(h[inside] ^ own[inside].astype(np.uint64)), own[inside]
    order = np.argsort(h)
    twice = h[order[1:]] == h[order[:-1]]
    for d in np.unique(own[order[1:][twice]]):
        words = texts[d].split()
        windows = [tuple(words[i : i + WINDOW]) for i in range(len(words) - WINDOW + 1)]
        seen = Counter(windows)
        reach = total = 0
        for i, w in enumerate(windows):
            if seen[w] > 1:
                total += i + WINDOW - max(i, reach)
                reach = i + WINDOW
        out[d] = total
    return out


def measure(batch: pa.RecordBatch, rules: Rules, text: str) -> dict[str, np.ndarray]:
    """All counts, distances and verdicts of a slice of rows."""
    data, offsets = flat(batch.column(text))
    n = len(offsets) - 1
    raw = data.tobytes()
    texts = [raw[a:b] for a, b in zip(offsets, offsets[1:])]
    starts, ends, docs = words_of(data, offsets)
    bounds = np.searchsorted(starts, offsets)
    n_words = np.diff(bounds)
    counts = class_counts(data, offsets)
    out = {"n_words": n_words, "word_chars": counts.sum(1) - counts[:, 3], "n_symbols": counts[:, 4]}
    dup = np.zeros(n, np.int64)
    for i, t in enumerate(texts):
        if b"\n" in t:
            lines = [x for x in t.split(b"\n") if x.strip()]
            dup[i] = len(lines) - len(set(lines))
    out["n_dup_lines"] = dup
    out["n_repeat_words"] = repeated_words(texts, span_hashes(data, starts, ends), docs, bounds)
    out["base_failed"] = (n_words < rules.min_words) | (100 * out["n_repeat_words"] > round(100 * rules.max_repeat) * n_words)
    far_class, far_word, far_share = np.zeros(n), np.zeros(n), np.zeros(n)
    if len(rules.class_refs):
        p = counts / np.maximum(1, counts.sum(1, keepdims=True))
        far_class = js_distance(p[:, None, :], rules.class_refs[None]).min(1)
        doc, bins = word_bins(data, offsets)
        total = np.bincount(doc, minlength=n)
        best, share = np.full(n, np.inf), np.full(n, np.inf)
        none = np.eye(COMMON + 1)[-1]
        for common, ref in zip(rules.common, rules.word_refs):
            slot = np.full(BINS, COMMON)
            slot[common] = np.arange(COMMON)
            q = np.bincount(doc * (COMMON + 1) + slot[bins], minlength=n * (COMMON + 1)).reshape(n, COMMON + 1) / np.maximum(1, total)[:, None]
            distance = js_distance(q, ref[None])
            best, share = np.minimum(best, distance), np.minimum(share, distance / js_distance(none, ref))
        far_word, far_share = np.where(total > 0, best, 1.0), np.where(total > 0, share, 1.0)
    out["class_distance"], out["word_distance"] = far_class, far_word
    unlike = (n_words >= rules.guard_words) & ((far_class > rules.max_class_distance) | (far_share > rules.max_word_share))
    out["kept"] = ~out["base_failed"] & ~unlike
    return out


COLUMNS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "class_distance": "double", "word_distance": "double"}


def quality_report(df: DataFrame, rules: Rules | None = None, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """Counts, distances and the verdict, one row per input row, for whole texts.

    A null text counts as empty: no words, base_failed. Texts under the guard length pass
    the divergence rule. Rows without a language are judged like others, but don't enter
    a reference; without any reference only the base rules hold. Repeated rows get equal
    results. Other columns are not read.
    """
    rules = rules or fit(df, text, lang)
    shared = df.sparkSession.sparkContext.broadcast(rules)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            found = measure(batch, shared.value, text)
            yield pa.RecordBatch.from_arrays([batch.column(doc_id), *(pa.array(found[c].astype({"long": np.int64, "boolean": bool, "double": float}[t])) for c, t in COLUMNS.items())], ["doc_id", *COLUMNS])

    schema = f"doc_id {df.schema[doc_id].dataType.simpleString()}, " + ", ".join(f"{c} {t}" for c, t in COLUMNS.items())
    return df.select(doc_id, text).mapInArrow(apply, schema)


def keep_good(df: DataFrame, rules: Rules | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows whose verdict is kept, with all their columns; no shuffle but the references'."""
    rules = rules or fit(df, text, lang)
    shared = df.sparkSession.sparkContext.broadcast(rules)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            yield batch.filter(pa.array(measure(batch, shared.value, text)["kept"]))

    return df.mapInArrow(apply, df.schema)
