"""Secret scanning: base patterns, and a linear-chain conditional random field over tokens.

Tokens are words. Each is described by its shape, its neighbours' shapes and its
document's shape; the field tags it begin, inside or outside, and Viterbi decoding finds
the best tags of a whole document. Where the outside score leads by more than all
transitions together could return, the best path must pass through outside, so that
decoding splits there and stays exact while most tokens cost a comparison.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, chunks, flat, runs, sampled, words_of

#: The base patterns, fixed values.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "crf")

BEGIN, INSIDE, OUTSIDE = range(3)
#: Rows of the sample that the field is fitted on, whole texts.
SAMPLE_ROWS = 800
#: Share of its own passages and of the other rows' passages that get a made-up secret or something that only looks like one.
PUT = 0.4
#: Characters stripped from the ends of a tagged span.
EDGES = "\"'.,;:()[]{}<>"

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_DIGIT, _UPPER, _LETTER, _WORDLIKE = (np.zeros(256, bool) for _ in range(4))
_DIGIT[48:58] = True
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_WORDLIKE[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")] = True
_WORDLIKE[0x80:] = True
_ASSIGNS = np.zeros(256, bool)
_ASSIGNS[list(b"=:")] = True
LENGTHS = np.array([4, 8, 16, 24, 40])
#: length, digits, upper case, hexadecimal, changes of kind, a sign of assignment, only punctuation, a key word.
SHAPES = 6 * 3 * 3 * 2 * 2 * 2 * 2 * 2
#: Changes between small letters, capitals and digits within a token that words and numbers seldom have.
CHANGES = 4
_KIND = np.zeros(256, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
FILES = 3 * 3


def _find_all(raw: bytes, what: bytes) -> list[int]:
    found, at = [], raw.find(what)
    while at >= 0:
        found.append(at)
        at = raw.find(what, at + 1)
    return found


def token_shapes(data: np.ndarray, raw_lower: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The shape number of each word."""
    size = ends - starts

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask[data], dtype=np.int32)])
        return total[ends] - total[starts]

    digits, upper, letters = count(_DIGIT), count(_UPPER), count(_LETTER)
    plain = count(_WORDLIKE)
    shape = np.searchsorted(LENGTHS, size, "right").astype(np.int32)
    shape = shape * 3 + np.where(digits == 0, 0, np.where(2 * digits < size, 1, 2))
    shape = shape * 3 + np.where(upper == 0, 0, np.where((upper == letters) & (letters > 1), 2, 1))
    hexes = count(_HEX)
    kind = _KIND[data]
    change = np.zeros(len(data) + 1, np.int32)
    change[2:] = np.cumsum((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0))
    shape = shape * 2 + (change[ends] - change[np.minimum(starts + 1, ends)] >= CHANGES)
    shape = shape * 2 + (10 * hexes >= 8 * size)
    shape = shape * 2 + (count(_ASSIGNS) > 0)
    shape = shape * 2 + (plain == 0)
    key = np.zeros(len(starts), np.int32)
    hits = [h for k in KEYWORDS for h in _find_all(raw_lower, k)]
    if hits:
        key[np.searchsorted(starts, np.array(hits), "right") - 1] = 1
    return shape * 2 + key


def file_shapes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A document's number by line length and density of signs."""
    lines = np.concatenate([[0], np.cumsum(data == 10)])[offsets]
    signs = np.concatenate([[0], np.cumsum(~_WORDLIKE[data] & ~IS_SPACE[data])])[offsets]
    size = np.maximum(1, np.diff(offsets))
    return np.searchsorted([60, 300], size / (np.diff(lines) + 1)) * 3 + np.searchsorted([0.03, 0.1], np.diff(signs) / size)


@dataclass
class Field:
    """Weights of own shape, the shape before, the shape after, the file; and of transitions [from, to]."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    file: np.ndarray
    step: np.ndarray

    def scores(self, shape: np.ndarray, doc: np.ndarray, files: np.ndarray) -> np.ndarray:
        """Emission scores [token, tag]; the outermost neighbours of a document have no shape."""
        out = self.own[shape] + self.file[files[doc]]
        if len(shape) > 1:
            same = (doc[1:] == doc[:-1])[:, None]
            out[1:] += np.where(same, self.before[shape[:-1]], 0)
            out[:-1] += np.where(same, self.after[shape[1:]], 0)
        return out


def viterbi(scores: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The best tags of one chain that stands between outside tags."""
    best, back = scores[0] + step[OUTSIDE], []
    for s in scores[1:]:
        via = best[:, None] + step
        back.append(via.argmax(0))
        best = via.max(0) + s
    tag = int((best + step[:, OUTSIDE]).argmax())
    tags = [tag]
    for b in reversed(back):
        tag = int(b[tag])
        tags.append(tag)
    return np.array(tags[::-1])


def decode(scores: np.ndarray, step: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The best tags of all documents. Documents stand between outside tags."""
    tags = np.full(len(scores), OUTSIDE)
    if not len(scores):
        return tags
    lead = scores[:, OUTSIDE] - scores[:, :OUTSIDE].max(1)
    unsure = lead <= 2 * (step.max() - step.min())
    bounds = np.searchsorted(doc, np.arange(int(doc[-1]) + 2))
    starts, ends = runs(unsure, bounds)
    for a, b in zip(starts.tolist(), ends.tolist()):
        tags[a:b] = viterbi(scores[a:b], step)
    return tags


def synthetic(rng: np.random.Generator) -> list[str]:
    """A made-up secret in one of several customary forms, as tokens."""

    def draw(letters: str, least: int, most: int) -> str:
        return "".join(rng.choice(list(letters), int(rng.integers(least, most))))

    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    value = [draw("0123456789abcdef", 32, 65), draw(lower + upper + digit, 24, 48), "AKIA" + draw(upper + digit, 16, 17), draw(lower + upper + digit + "+/", 40, 60) + "=", draw(upper + digit, 20, 40)][int(rng.integers(5))]
    key = ["password", "token", "secret", "api_key", "passwd"][int(rng.integers(5))]
    return [[key, "=", f'"{value}"'], [f"{key}:", value], [f"{key}={value}"], [value], ["Bearer", value][1:]][int(rng.integers(5))]


def lookalike(rng: np.random.Generator, words: list[str]) -> list[str]:
    """Something long that is no secret, made of the text's own words and of numbers: run-together words, addresses, paths, numbers, identifiers."""
    some = [words[int(rng.integers(len(words)))] for _ in range(int(rng.integers(2, 6)))]
    number = "".join(rng.choice(list("0123456789"), int(rng.integers(2, 20))))
    joined = "".join(some)
    forms = [joined, joined.capitalize(), joined.upper(), "".join(w.capitalize() for w in some), "_".join(some), "-".join(some), ".".join(some), "/".join(["https:/", *some]), f"{some[0]}.{number[:2]}@{some[1]}.example.com", number, f"{some[0]}{number[:4]}", f"{joined}###", joined + "&&&"]
    return [forms[int(rng.integers(len(forms)))]]


def train(texts: list[str], seed: int = 7, rounds: int = 80, rate: float = 0.4, decay: float = 1e-4) -> Field:
    """Fit on pieces of the texts, tagged by the base patterns, with made-up secrets and things that only look like them put in."""
    rng = np.random.default_rng(seed)
    length, pieces, golds = 24, [], []
    for text in sorted(texts):
        words = text.split()
        tags = [OUTSIDE] * len(words)
        joined = " ".join(words)
        begins = np.cumsum([0, *(len(w) + 1 for w in words)])[:-1]
        for _, a, b in base_spans(joined):
            i, j = np.searchsorted(begins, a, "right") - 1, np.searchsorted(begins, b, "left")
            tags[i:j] = [BEGIN] + [INSIDE] * (j - i - 1)
        shown = []
        for _ in range(4):
            at = int(rng.integers(len(words) + 1))
            if rng.random() >= PUT or (0 < at < len(words) and tags[at] != OUTSIDE):
                continue
            if words and rng.random() < 0.5:
                put, tag = lookalike(rng, words), [OUTSIDE]
            else:
                put = synthetic(rng)
                tag = [BEGIN] + [INSIDE] * (len(put) - 1)
            words[at:at] = put
            tags[at:at] = tag
            shown = [x + len(put) * (x >= at) for x in shown] + [at]
        marked = [max(0, i - length // 2) for i, t in enumerate(tags) if t == BEGIN]
        near = [max(0, at - length // 2) for at in shown]
        for a in sorted({*marked[:4], *near, int(rng.integers(max(1, len(words) - length)))}):
            if words[a : a + length]:
                pieces.append(words[a : a + length])
                golds.append(tags[a : a + length])
    zero = lambda n: np.zeros((n, 3))
    field = Field(zero(SHAPES), zero(SHAPES), zero(SHAPES), zero(FILES), zero(3))
    field.own[:, OUTSIDE] = 1.0  # shapes that the sample lacks are outside
    if not pieces:
        return field
    data, offsets = flat(pa.array([" ".join(p) for p in pieces]))
    starts, ends, doc = words_of(data, offsets)
    shape = token_shapes(data, data.tobytes().lower(), starts, ends)
    files = file_shapes(data, offsets)
    n, sizes = len(pieces), np.array([len(p) for p in pieces])
    at = np.arange(len(doc)) - (np.cumsum(sizes) - sizes)[doc]
    gold = np.full((n, length), OUTSIDE)
    gold[doc, at] = np.array([t for g in golds for t in g])
    real = np.zeros((n, length), bool)
    real[doc, at] = True
    same = np.append(doc[1:] == doc[:-1], False)
    sums = {k: np.full_like(getattr(field, k), 1e-8) for k in ("own", "before", "after", "file", "step")}
    one_hot = np.eye(3)[gold]
    true_steps = np.zeros((3, 3))
    padded_from = np.concatenate([np.full((n, 1), OUTSIDE), gold[:, :-1]], 1)
    np.add.at(true_steps, (padded_from[real], gold[real]), 1)
    for _ in range(rounds):
        e = np.zeros((n, length, 3))
        e[doc, at] = field.scores(shape, doc, files)
        alpha, beta = np.zeros((n, length, 3)), np.zeros((n, length, 3))
        alpha[:, 0] = e[:, 0] + field.step[OUTSIDE]
        for t in range(1, length):
            via = alpha[:, t - 1, :, None] + field.step
            new = np.logaddexp.reduce(via, axis=1) + e[:, t]
            alpha[:, t] = np.where(real[:, t, None], new, alpha[:, t - 1])
        for t in range(length - 2, -1, -1):
            via = field.step + (e[:, t + 1] + beta[:, t + 1])[:, None, :]
            beta[:, t] = np.where(real[:, t + 1, None], np.logaddexp.reduce(via, axis=2), beta[:, t + 1])
        total = np.logaddexp.reduce(alpha[:, 0] + beta[:, 0], axis=1)
        p = np.exp(alpha + beta - total[:, None, None])
        pairs = alpha[:, :-1, :, None] + field.step + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]
        got = np.exp(pairs)[real[:, 1:]].sum(0)
        got[OUTSIDE] += p[:, 0].sum(0)
        slope = (one_hot - p)[doc, at]

        def gathered(index: np.ndarray, rows: int, values: np.ndarray) -> np.ndarray:
            return np.stack([np.bincount(index, values[:, k], rows) for k in range(3)], 1)

        slopes = {
            "own": gathered(shape, SHAPES, slope),
            "before": gathered(shape[:-1][same[:-1]], SHAPES, slope[1:][same[:-1]]),
            "after": gathered(shape[1:][same[:-1]], SHAPES, slope[:-1][same[:-1]]),
            "file": gathered(files[doc], FILES, slope),
            "step": true_steps - got,
        }
        for k, g in slopes.items():
            g = g / n - decay * getattr(field, k)
            sums[k] += g * g
            getattr(field, k)[...] += rate * g / np.sqrt(sums[k])
    return field


def fit(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> Field:
    """A field fitted on SAMPLE_ROWS rows, those whose ids hash lowest. Null texts count as empty; without rows every token is outside."""
    rows = sampled(df.select(doc_id, F.coalesce(F.col(text), F.lit("")).alias("__text")), SAMPLE_ROWS, doc_id, "__text").collect()
    return train([r["__text"] for r in rows])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by start, then kind."""
    found = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    found += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(2, m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]
    return sorted(found, key=lambda x: (x[1], x[0]))


def _as_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def scan(field: Field, data: np.ndarray, offsets: np.ndarray) -> list[tuple[list, list]]:
    """(base spans, all spans) of each document of a slice, in code points."""
    n = len(offsets) - 1
    raw = data.tobytes()
    lower = raw.lower()
    asked: set[int] = set()
    for what, where in [*((k, lower) for k in KEYWORDS), (b"AKIA", raw)]:
        asked.update((np.searchsorted(offsets, np.array(_find_all(where, what), np.int64), "right") - 1).tolist())
    starts, ends = runs(_HEX[data], offsets)
    asked.update((np.searchsorted(offsets, starts[ends - starts >= LEAST_HEX], "right") - 1).tolist())
    starts, ends, doc = words_of(data, offsets)
    shape = token_shapes(data, lower, starts, ends)
    tags = decode(field.scores(shape, doc, file_shapes(data, offsets)), field.step, doc)
    tagged: dict[int, list[tuple[int, int]]] = {}
    open_ = None
    for i in np.flatnonzero(tags != OUTSIDE).tolist():
        if open_ is not None and tags[i] == INSIDE and open_[2] == i - 1 and open_[0] == doc[i]:
            open_[2] = i
            tagged[open_[0]][-1] = (tagged[open_[0]][-1][0], int(ends[i]))
        else:
            open_ = [int(doc[i]), i, i]
            tagged.setdefault(int(doc[i]), []).append((int(starts[i]), int(ends[i])))
    out: list[tuple[list, list]] = [([], [])] * n
    for d in asked | tagged.keys():
        lo, hi = int(offsets[d]), int(offsets[d + 1])
        text = raw[lo:hi].decode()
        base = base_spans(text) if d in asked else []
        more = []
        for a, b in tagged.get(d, ()):
            a_ = len(raw[lo:a].decode())
            piece = raw[a:b].decode()
            b_ = a_ + len(piece.rstrip(EDGES))
            a_ += len(piece) - len(piece.lstrip(EDGES))
            if a_ < b_ and not any(x < b_ and a_ < y for _, x, y in base):
                more.append((3, a_, b_))
        out[d] = base, sorted(base + more, key=lambda x: (x[1], x[0]))
    return out


def find_secrets(df: DataFrame, field: Field | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans), one row per input row, over whole texts.

    Spans are code points, end exclusive. A null text is empty and has no spans (the digest
    is that of an empty string). Tagged spans that overlap a base span are left out, base
    spans always stay. Repeated rows get equal results. No shuffle but the sample's.
    """
    field = field or fit(df, text, doc_id)
    shared = df.sparkSession.sparkContext.broadcast(field)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            found = scan(shared.value, *flat(batch.column(text)))
            counts = [pa.array([sum(k == kind for k, _, _ in base) for base, _ in found], pa.int64()) for kind in range(3)]
            digests = pa.array([hashlib.sha256(_as_text(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(doc_id), *counts, digests, pa.array([_as_text(every) for _, every in found], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    schema = f"doc_id {df.schema[doc_id].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return df.select(doc_id, text).mapInArrow(apply, schema)
