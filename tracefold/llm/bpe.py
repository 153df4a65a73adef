"""Byte-level BPE encoding and decoding.

Pre-tokenisation needs no regular expression. Every code point becomes one of a few
symbols (its class and what the next two code points say about it), every symbol is a
transition function over eight automaton states, and function composition is
associative: the finitely many functions that compositions reach are numbered once, so
that a scan over a text is a scan over small integers. The scan is blocked: columns
first within rows, then row totals, then both together.

The slices found are dictionary-encoded by Arrow; each distinct slice is merged once,
lowest rank first, and kept in a bounded cache. Token lengths are known per slice, so
offsets of tokens in the text follow by prefix sums, and decoding is a gather.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import chunks, flat, ragged

#: Symbols: letter, number, other, a white-space run's inner part, its last space (joins
#: what follows), its last other white space, an apostrophe that opens a contraction of
#: one or two letters.
LETTER, NUMBER, OTHER, BLANK, LAST_SPACE, LAST_BLANK, CONTRACT_1, CONTRACT_2 = range(8)
#: States: what the code point before belongs to, or what it demands of the next one.
IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_BLANKS, JOIN, FRESH, INSIDE_1, INSIDE_2 = range(8)
STATES = 8
#: The letters that may follow an apostrophe: fixed values of the pre-tokenisation pattern.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: White space as Unicode's White_Space property lists it.
WHITE_SPACE = (9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

CACHE_ENTRIES = 300_000
#: Slices up to so many bytes are merged by scanning a list, longer ones with a heap.
SHORT = 32
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """Letter, number, other or blank for every code point."""
    global _classes
    if _classes is None:
        table = np.full(0x110000, OTHER, np.uint8)
        try:  # the Unicode version of this library is nearer to the tokenizer's
            import regex

            for symbol, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
                everything = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
                for m in regex.finditer(pattern, everything):
                    a, b = ord(everything[m.start()]), ord(everything[m.end() - 1])
                    table[a : b + 1] = symbol
        except ImportError:
            for c in range(0x110000):
                table[c] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER)
        table[0xD800:0xE000] = OTHER
        table[list(WHITE_SPACE)] = BLANK
        _classes = table
    return _classes


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a slice starts at this code point."""
    if state in (INSIDE_1, INSIDE_2):
        return (FRESH if state == INSIDE_1 else INSIDE_1), False
    if symbol == BLANK:
        return IN_BLANKS, state != IN_BLANKS
    if symbol == LAST_SPACE:
        return JOIN, True
    if symbol == LAST_BLANK:
        return FRESH, True
    if symbol in (CONTRACT_1, CONTRACT_2) and state not in (JOIN, IN_OTHER):
        return (INSIDE_1 if symbol == CONTRACT_1 else INSIDE_2), True
    kind = min(symbol, OTHER)
    return kind, state not in (JOIN, kind)


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Composition table of the reachable transition functions, the symbols' functions, function results, slice starts."""
    start_over = len(range(8))  # one more symbol a class: the first code point of a document, whatever came before
    functions = [tuple(_step(s, x)[0] for s in range(STATES)) for x in range(8)]
    functions += [(_step(FRESH, x)[0],) * STATES for x in range(start_over)]
    starts = np.array([[_step(s, x)[1] for s in range(STATES)] for x in range(8)] + [[True] * STATES] * 8)
    known = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(STATES)), *functions]))}
    grew = True
    while grew:
        grew = False
        for f in list(known):
            for g in functions:
                fg = tuple(g[x] for x in f)
                if fg not in known:
                    known[fg] = len(known)
                    grew = True
    every = list(known)
    table = np.array([[known[tuple(g[x] for x in f)] for g in every] for f in every], np.uint16)
    return table, np.array([known[f] for f in functions], np.uint16), np.array(every, np.uint8), starts


MONOID, OF_SYMBOL, RESULT, STARTS = _monoid()
WIDTH = 128


def scan(functions: np.ndarray) -> np.ndarray:
    """Exclusive scan under composition: the function of everything before each position."""
    n, k = len(functions), len(MONOID)
    compose = MONOID.ravel()
    identity = 0
    rows = -(-n // WIDTH)
    padded = np.full(rows * WIDTH, identity, np.uint16)
    padded[:n] = functions
    grid = np.ascontiguousarray(padded.reshape(rows, WIDTH).T)
    inner = np.empty_like(grid)
    so_far = np.full(rows, identity, np.uint16)
    for j in range(WIDTH):
        inner[j] = so_far
        so_far = compose[so_far.astype(np.int64) * k + grid[j]]
    if rows > 1:
        before = scan(so_far) if rows > WIDTH else _serial(so_far)
        inner = compose[before.astype(np.int64)[None, :] * k + inner]
    return np.ascontiguousarray(inner.T).ravel()[:n]


def _serial(functions: np.ndarray) -> np.ndarray:
    out, now = np.empty_like(functions), 0
    for i, f in enumerate(functions.tolist()):
        out[i] = now
        now = int(MONOID[now, f])
    return out


def symbols(points: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """points: code points of all documents; heads: indices of documents' first code points."""
    kind = classes()[points]
    out = kind.copy()
    n = len(points)
    ends = np.zeros(n + 1, bool)  # no document goes on at this index
    ends[heads] = True
    ends[n] = True
    blank = kind == BLANK
    follows = np.zeros(n, bool)  # a non-blank of the same document comes next
    follows[:-1] = ~blank[1:] & ~ends[1:n]
    last = blank & follows
    out[last] = np.where(points[last] == 0x20, LAST_SPACE, LAST_BLANK)
    marks = np.flatnonzero(points == ord("'"))
    if len(marks):
        one, two = np.zeros(len(marks), np.uint32), np.zeros(len(marks), np.uint32)
        in_1 = ~ends[marks + 1]
        one[in_1] = points[marks[in_1] + 1]
        in_2 = in_1.copy()
        in_2[in_1] = ~ends[np.minimum(marks[in_1] + 2, n)]
        two[in_2] = points[marks[in_2] + 2]
        for c in CONTRACTIONS:
            hit = one == ord(c[0])
            if len(c) == 2:
                hit &= two == ord(c[1])
            out[marks[hit]] = CONTRACT_1 if len(c) == 1 else CONTRACT_2
    return out


def slice_starts(points: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Indices of the code points at which slices start."""
    if not len(points):
        return np.zeros(0, np.int64)
    symbol = symbols(points, heads).astype(np.int64)
    symbol[heads] += 8
    state = RESULT[scan(OF_SYMBOL[symbol]), FRESH]
    return np.flatnonzero(STARTS[symbol, state])


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The lowest-ranked pair first, leftmost among equals."""
    if piece in ranks:
        return [ranks[piece]]
    return _merge_short(piece, ranks) if len(piece) <= SHORT else _merge_long(piece, ranks)


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """By scanning a list of pair ranks."""
    none, rank_of = len(ranks) + 1, ranks.get
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [rank_of(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs:
        best = min(pairs)
        if best == none:
            break
        i = pairs.index(best)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i < len(pairs):
            pairs[i] = rank_of(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = rank_of(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """By a heap over a linked list: n log n for any length."""
    n = len(piece)
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, size = heapq.heappop(heap)
        left = parts[i]
        if left is None or (j := after[i]) >= n or len(left) + len(parts[j]) != size or ranks[left + parts[j]] != rank:
            continue
        parts[i], parts[j] = left + parts[j], None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(parts[i] + parts[k])) is not None:
                heapq.heappush(heap, (r, i, len(parts[i]) + len(parts[k])))
        if (h := before[i]) >= 0 and (r := ranks.get(parts[h] + parts[i])) is not None:
            heapq.heappush(heap, (r, h, len(parts[h]) + len(parts[i])))
    return [ranks[p] for p in parts if p is not None]


class Tokenizer:
    """Encoder and decoder for a rank file's vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.cache = ranks, {}
        size = max(ranks.values()) + 1
        pieces = [b""] * size
        for piece, rank in ranks.items():
            pieces[rank] = piece
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def slices(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Byte offsets at which slices start, and the end of the data."""
        is_head = (data & 0xC0) != 0x80
        at = np.flatnonzero(is_head)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        firsts = offsets[:-1][np.diff(offsets) > 0]
        return np.append(at[slice_starts(points, np.searchsorted(at, firsts))], len(data))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents one after the other, and each document's offset in them."""
        cuts = self.slices(data, offsets)
        if len(cuts) == 1:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        column = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = column.dictionary_encode()
        cache, ranks = self.cache, self.ranks
        found = []
        for piece in coded.dictionary.to_pylist():
            ids = cache.get(piece)
            if ids is None:
                ids = merge(piece, ranks)
                if len(cache) >= CACHE_ENTRIES:
                    cache.clear()
                cache[piece] = ids
            found.append(ids)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        begin = np.cumsum(sizes) - sizes
        table = np.fromiter((i for ids in found for i in ids), np.uint32, int(sizes.sum()))
        which = coded.indices.to_numpy()
        ids = table[ragged(begin[which], sizes[which])]
        ends = np.concatenate([[0], np.cumsum(sizes[which])])
        return ids, ends[np.searchsorted(cuts, offsets)]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids."""
        return self.bytes[ragged(self.offsets[ids], self.lengths[ids])]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


_made: dict[str, Tokenizer] = {}


def encode_documents(df: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Encode each whole text, decode the ids again, and return digests of both.

    vocabulary: path of a rank file on the driver; its table (a fixed size) is broadcast.
    Result: doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit
    integers), decoded_sha256, and with with_ids the ids as an array. One row per input
    row; a null text counts as empty and has no tokens; repeated rows give repeated
    results; other columns are not read. No shuffle.
    """
    spark: SparkSession = df.sparkSession
    shared = spark.sparkContext.broadcast(load_ranks(vocabulary))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _made:
            _made.clear()
            _made[vocabulary] = Tokenizer(shared.value)
        tokenizer = _made[vocabulary]
        for batch in chunks(batches, text):
            data, offsets = flat(batch.column(text))
            ids, ends = tokenizer.encode(data, offsets)
            raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            decoded = tokenizer.decode(ids)
            sizes = np.concatenate([[0], np.cumsum(tokenizer.lengths[ids])])[ends]
            back = memoryview(np.ascontiguousarray(decoded))
            id_digests = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(ends, ends[1:])]
            text_digests = [hashlib.sha256(back[a:b]).hexdigest() for a, b in zip(sizes, sizes[1:])]
            columns = [batch.column(doc_id), pa.array(np.diff(ends)), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = df.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return df.select(doc_id, text).mapInArrow(apply, schema)
