"""Language identification by cross-parsing entropy.

A suffix automaton of each language's labelled text gives longest matches: a document is
cut greedily into the longest phrases that occur in the labelled text. The language that
needs the fewest phrases, normalised by its text's length, wins (Ziv and Merhav's
cross-parsing estimate of relative entropy). Symbols are the bytes of lower-cased letters
and one gap between words, so no letter is left out of any alphabet.

All documents of a slice walk an automaton together, one symbol a step. For that they are
cut in pieces that start as if a phrase did; then each piece is walked again from where the
piece before it really ends, until both walks start a phrase at the same symbol, from
which on they agree. The phrases are those of the whole document, whatever its length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import LETTER, classes
from .common import chunks, flat, held_out, ragged

#: Bounds of the labelled sample of a language: rows, and symbols of those taken. Texts are taken whole, in the order of
#: their ids' hashes, while they fit; the first one always is.
SAMPLE_ROWS, SAMPLE_SYMBOLS = 200, 24_000
GAP = 0x20
#: Symbols of a piece, and pieces that walk together.
PIECE, AT_ONCE = 256, 16384
UNKNOWN = "und"


@dataclass
class Languages:
    names: list[str]
    column: np.ndarray  # column of every byte in the tables; bytes that no sample has share the last but one
    table: np.ndarray  # [state, column] -> 2 * next state + whether the symbol starts a phrase; the last column stays
    starts: np.ndarray  # state of each automaton's root
    bits: np.ndarray  # log2 of the labelled text's length


def automaton(text: list[int], width: int) -> np.ndarray:
    """Transitions of the suffix automaton of a text: [state, symbol], -1 where there is none."""
    go, link, length = [{}], [-1], [0]
    last = 0
    for c in text:
        now = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = now
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    table = np.full((len(go), width), -1, np.int64)
    for s, edges in enumerate(go):
        for c, t in edges.items():
            table[s, c] = t
    return table


_lower: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Lower-case form of every letter's code point, a gap for others."""
    global _lower
    if _lower is None:
        is_letter = classes() == LETTER
        lower = np.where(is_letter, np.arange(len(is_letter)), GAP).astype(np.uint32)
        for c in np.flatnonzero(is_letter).tolist():
            low = chr(c).lower()
            if len(low) == 1:
                lower[c] = ord(low)
        _lower = lower
    return _lower


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, documents' offsets in them): bytes of lower-cased letters; what stands between words is one gap, none at a document's start."""
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    points = _letters()[np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)]
    gap = points == GAP
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    firsts = heads[:-1][np.diff(heads) > 0]
    keep[firsts] = ~gap[firsts]
    points = points[keep]
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    at = np.concatenate([[0], np.cumsum(width)])
    return np.frombuffer(points.tobytes().decode("utf-32-le").encode(), np.uint8), at[np.concatenate([[0], np.cumsum(keep)])[heads]]


def fit(df: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Languages:
    """Automata of a bounded sample of labelled rows that aren't held out, for every language."""
    rows = df.where(~held_out(doc_id) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(doc_id, F.col(lang).cast("string").alias("lang"), F.col(text).alias("t"))
    rows = rows.select(F.col(doc_id).alias("id"), "lang", "t", F.xxhash64("t").alias("h"), F.octet_length("t").alias("size"))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "h")
    listed = rows.select("id", "lang", "h", "size").withColumn("r", F.row_number().over(first)).where(F.col("r") <= SAMPLE_ROWS)
    taken, size = [], Counter()
    for r in sorted(listed.select("lang", "r", "id", "h", "size").collect(), key=lambda r: (r["lang"], r["r"])):
        if not size[r["lang"]] or size[r["lang"]] + r["size"] <= SAMPLE_SYMBOLS:
            size[r["lang"]] += max(1, r["size"])
            taken.append((r["id"], r["lang"], r["h"], r["r"]))
    if not taken:
        return train({})
    asked = df.sparkSession.createDataFrame(taken, f"__id {df.schema[doc_id].dataType.simpleString()}, __lang string, __h long, r int")
    found = rows.join(F.broadcast(asked), (F.col("id") == F.col("__id")) & (F.col("lang") == F.col("__lang")) & (F.col("h") == F.col("__h"))).select("lang", "r", "t").distinct()
    by: dict[str, list[str]] = {}
    for r in sorted(found.collect()):
        by.setdefault(r["lang"], []).append(r["t"])
    return train(by)


def train(by: dict[str, list[str]]) -> Languages:
    """Automata of labelled texts."""
    texts = {}
    for name in sorted(by):
        s, _ = symbols(*flat(pa.array(["\n".join(by[name])])))
        if len(s):
            texts[name] = s
    seen = sorted({b for s in texts.values() for b in np.unique(s).tolist()})
    column = np.full(256, len(seen), np.uint8)
    column[seen] = np.arange(len(seen))
    width = len(seen) + 1  # of known bytes and all others
    tables, starts, base = [], [], 0
    for s in texts.values():
        step = automaton(column[s].tolist(), width)
        root = step[0]
        begun = np.where(root >= 0, root, 0)  # an unknown symbol is a phrase of its own
        missing = step < 0
        fresh = missing.copy()
        fresh[0] = True
        stay = 2 * (np.arange(len(step)) + base)
        tables.append(np.concatenate([2 * (np.where(missing, begun[None, :], step) + base) + fresh, stay[:, None]], 1).astype(np.int32))
        starts.append(base)
        base += len(step)
    table = np.concatenate(tables) if tables else np.zeros((0, width + 1), np.int32)
    return Languages(list(texts), column, table, np.array(starts, np.int64), np.array([np.log2(len(s) + 1) for s in texts.values()]))


def _walk(table: np.ndarray, grid: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(states at the end, [step, piece] whether a phrase starts)."""
    flat_table, width = table.ravel(), table.shape[1]
    fresh = np.empty(grid.shape, bool)
    for t in range(len(grid)):
        hit = flat_table[state * width + grid[t]]
        fresh[t] = hit & 1
        state = (hit >> 1).astype(np.int64)
    return state, fresh


def parse(table: np.ndarray, grid: np.ndarray, start: int, entry: int, follows: np.ndarray) -> tuple[np.ndarray, int]:
    """(phrases that start in each piece, state at the last one's end), of documents parsed as a whole.

    grid: [step, piece] columns; start: the root; entry: the state in which the first piece
    begins; follows: whether a piece goes on with the document of the piece before it. A
    piece is first walked as if a phrase started with it. From its true entry it is walked
    until both walks start a phrase at one symbol; a walk that never does changes the entry
    of the next piece, which is then walked again.
    """
    flat_table, width = table.ravel(), table.shape[1]
    entries = np.full(grid.shape[1], start, np.int64)
    entries[0] = entry
    ends, fresh = _walk(table, grid, entries)
    again = np.flatnonzero(follows)
    again = again[again > 0]
    while len(again := again[entries[again] != ends[again - 1]]):
        entries[again] = ends[again - 1]
        on, state = again, entries[again]
        changed = on[:0]
        for t in range(len(grid)):
            hit = flat_table[state * width + grid[t, on]]
            starts, state = (hit & 1).astype(bool), (hit >> 1).astype(np.int64)
            open_ = ~(starts & fresh[t, on])
            fresh[t, on] = starts
            on, state = on[open_], state[open_]
            if not len(on):
                break
        else:
            changed = on[state != ends[on]]
            ends[on] = state
        again = changed[changed + 1 < len(follows)] + 1
        again = again[follows[again]]
    return fresh.sum(0), int(ends[-1])


def phrases(model: Languages, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrases by document and language, symbols by document)."""
    n = len(offsets) - 1
    s, own = symbols(data, offsets)
    sizes = np.diff(own)
    pieces = -(-sizes // PIECE)
    doc = np.repeat(np.arange(n), pieces)
    at = ragged(np.zeros(n, np.int64), pieces)
    begin = own[doc] + PIECE * at
    length = np.minimum(PIECE, own[doc + 1] - begin)
    total = np.zeros((n, len(model.names)), np.int64)
    ends = model.starts.tolist()
    for a in range(0, len(doc), AT_ONCE):
        part = slice(a, a + AT_ONCE)
        size, follows = length[part], at[part] > 0
        grid = np.full((int(size.max()), len(size)), model.table.shape[1] - 1, np.uint8)
        cells = ragged(np.zeros(len(size), np.int64), size)
        where = np.repeat(np.arange(len(size)), size)
        grid[cells, where] = model.column[s[begin[part][where] + cells]]
        for j, start in enumerate(model.starts.tolist()):
            fresh, ends[j] = parse(model.table, grid, start, ends[j] if follows[0] else start, follows)
            total[:, j] += np.bincount(doc[part], fresh, n).astype(np.int64)
    return total, sizes


def predict(model: Languages, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each document of a slice."""
    if not model.names:
        return [UNKNOWN] * (len(offsets) - 1), np.zeros(len(offsets) - 1)
    total, sizes = phrases(model, data, offsets)
    known = sizes > 0
    cost = total * model.bits[None, :] / np.maximum(1, sizes)[:, None]
    best = cost.argmin(1)
    low = cost[np.arange(len(best)), best]
    others = cost.copy()
    others[np.arange(len(best)), best] = np.inf
    second = others.min(1) if len(model.names) > 1 else np.full(len(best), np.inf)
    with np.errstate(invalid="ignore"):
        score = np.where(np.isinf(second), 1.0, second / np.maximum(low + second, 1e-300))
    return [model.names[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, score, 0.0)


def identify(df: DataFrame, model: Languages | None = None, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per input row, over whole texts.

    A null text, an empty one and one without a letter give 'und' and score 0; so does
    everything where no row is labelled. score: the runner-up's share of the two least
    costs (0.5: a tie, won by the first in code point order; 1: a single language). Only
    the text is read for a prediction. Repeated rows get equal results.
    """
    model = model or fit(df, text, lang, doc_id)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            names, score = predict(shared.value, *flat(batch.column(text)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    schema = f"doc_id {df.schema[doc_id].dataType.simpleString()}, held_out boolean, lang_pred string, score double"
    return df.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), text).mapInArrow(apply, schema)
