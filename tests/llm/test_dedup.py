"""Exact, substring and near-duplicate operators against plain versions."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tracefold.llm import common, exact_dedup, simhash, suffix_dedup, superkmer, windows
from tracefold.llm import components as components_module
from tracefold.llm.common import flat
from tracefold.llm.components import components


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return (t or "").encode().split()


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.substring(exact_dedup.sha256(c), 1, 1)])
def test_exact(make, corpus, digest):
    """The narrow digest lets different texts collide: bytes must tell them apart."""
    groups = defaultdict(list)
    for i, t, *_ in corpus:
        groups[lower(t)].append(i)
    want = Counter((i, max(groups[lower(t)]), len(groups[lower(t)]), i == max(groups[lower(t)])) for i, t, *_ in corpus)
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(make(corpus), digest=digest).collect())
    assert got == want
    assert exact_dedup.exact_duplicates(make([]), digest=digest).count() == 0


def test_hits_beyond_the_filter(make, corpus, monkeypatch):
    """With too few bits for the hits, texts are picked by a join: equal results."""
    plain = sorted(map(str, exact_dedup.exact_duplicates(make(corpus)).collect()))
    monkeypatch.setattr(exact_dedup, "BITS_PER_HIT", 1 << 20)
    assert sorted(map(str, exact_dedup.exact_duplicates(make(corpus)).collect())) == plain


def test_index_by_batches(make, corpus):
    """Batches one after the other give the index of all rows."""
    index = None
    for batch in (corpus[:9], [], corpus[9:50], corpus[50:]):
        index = exact_dedup.extend(index, make(batch))
    groups = defaultdict(list)
    for i, t, *_ in corpus:
        groups[hashlib.sha256(lower(t).encode()).hexdigest()].append(i)
    assert sorted(map(tuple, index.select("digest", "keep_id", "n").collect())) == sorted((d, max(ids), len(ids)) for d, ids in groups.items())


def test_null_ids(make):
    got = exact_dedup.exact_duplicates(make([(None, "a", None, None), (None, "A", None, None), (3, "b", None, None)])).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in got) == [("3", "3", 1, True), ("None", "None", 2, True), ("None", "None", 2, True)]


def brute_bytes(rows, width):
    """By (doc_id, text): rows that repeat both are one document."""
    docs = {}
    for i, t, *_ in rows:
        docs[i, (t or "").encode()] = (t or "").encode()
    first = {}
    for key in sorted(docs, key=lambda k: (k[0] is not None, k[0] or 0)):
        b = docs[key]
        for p in range(len(b) - width + 1):
            w = b[p : p + width]
            first[w] = min(first.get(w, (key[0], p)), (key[0], p))
    out = {}
    for key, b in docs.items():
        gone = [False] * len(b)
        for p in range(len(b) - width + 1):
            if first[b[p : p + width]] < (key[0], p):
                gone[p : p + width] = [True] * width
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[key] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("hot, many", [(2000, 2000), (2, 1)])
def test_bytes(make, corpus, monkeypatch, hot, many):
    """Low bounds cut the windows of most buckets anew by longer grams, and join most keys by broadcast: equal results."""
    monkeypatch.setattr(windows, "HOT", hot)
    monkeypatch.setattr(windows, "MANY_ROWS", many)
    want = brute_bytes(corpus, 24)
    got = suffix_dedup.remove_repeated_bytes(make(corpus), 24, 8, with_bytes=True).collect()
    rows = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)
    assert rows == Counter((i, *want[i, (t or "").encode()]) for i, t, *_ in corpus)
    assert suffix_dedup.remove_repeated_bytes(make([]), 24, 8).count() == 0


def test_merge_against_sorting():
    """Interleaved transforms: the repeated prefixes in sorted order, in blocks of equal ones, and every row's longest common prefix."""
    rng = np.random.default_rng(2)
    for width in (8, 13):
        texts = [[bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in sizes] for sizes in ((30, 9, 1), (80,), (25, 0, 13))]
        shards = [np.frombuffer(b"".join(x + bytes([suffix_dedup.END]) for x in part), np.uint8) for part in texts]
        orders = [suffix_dedup.suffix_order(s, width) for s in shards]
        rows, block, common = suffix_dedup.merge([suffix_dedup.transform(s, o) for s, o in zip(shards, orders)], width)
        tops = [bytes(np.roll(s, -p)).split(bytes([suffix_dedup.END]))[0] for s, o in zip(shards, orders) for p in o]
        seen = Counter(t[:width] for t in tops if len(t) >= width)
        merged = [tops[r][:width] for r in rows]
        assert merged == sorted(t[:width] for t in tops if len(t) >= width and seen[t[:width]] > 1)
        assert len({*zip(merged, block.tolist())}) == len(set(merged)) == len(set(block.tolist()))
        times = Counter(t[:k] for t in tops for k in range(1, len(t) + 1))
        for t, c in zip(tops, common.tolist()):
            longest = max((k for k in range(1, min(width, len(t)) + 1) if times[t[:k]] > 1), default=0)
            assert c == (longest if longest == width else longest // 2 * 2)


@pytest.mark.parametrize("words", [False, True])
def test_long_documents_in_slices(monkeypatch, words):
    """The slices of a document have all its windows once, whatever their length."""
    rng = random.Random(12)
    texts = [" ".join("".join(rng.choice("abé") for _ in range(rng.randint(1, 4))) for _ in range(n)) for n in (0, 3, 200, 1, 90)]
    data, offsets = flat(pa.array(texts))
    cut = windows.Cut(9, 3, words)

    def found():
        text, starts, ends, bounds = windows.units(data, offsets, cut)
        parts = [(int(d), int(a) + k) for own, start, n, *_ in windows.runs_of(text, starts, ends, bounds, None, cut, 3) for d, a, c in zip(own, start, n) for k in range(c)]
        sizes = np.diff(bounds)
        return sorted(parts), [(d, k) for d, size in enumerate(sizes) for k in range(max(0, size - 8))]

    whole, want = found()
    monkeypatch.setattr(windows, "SLICE", 16)
    assert found()[0] == whole == want


def test_similarity_of_words_that_a_polynomial_hash_takes_for_equal(make):
    one = thue_morse(1024)
    other = one.translate(str.maketrans("ab", "ba"))
    rows = [(k, " ".join([w, f"v{k}", w, w, f"u{k}", w, w, w, w, w, w]), None, None) for k, w in enumerate((one, other))]
    assert simhash.similar_documents(make(rows)).count() == 0


def thue_morse(n):
    return "".join("ab"[k.bit_count() % 2] for k in range(n))


def test_words_that_a_polynomial_hash_takes_for_equal(make):
    """A Thue-Morse word and its complement have one polynomial hash modulo 2**64; no window of the two documents is shared."""
    one = thue_morse(1024)
    words = [f"w{k}" for k in range(40)]
    rows = [(k, " ".join([*words[:20], w, *words[20:]]), "en", "a") for k, w in enumerate((one, one.translate(str.maketrans("ab", "ba"))))]
    assert {(r.doc_id, r.n_words, r.n_removed) for r in superkmer.remove_repeated_windows(make(rows)).collect()} == {(0, 41, 0), (1, 41, 0)}
    want = brute_bytes(rows, 24)
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeated_bytes(make(rows), 24, 8).collect()} == {(i, *want[i, t.encode()]) for i, t, *_ in rows}


def brute_words(rows, width):
    seen = Counter()
    for _, t, *_ in rows:
        w = words(t)
        seen.update(tuple(w[p : p + width]) for p in range(len(w) - width + 1))
    out = []
    for i, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if seen[tuple(w[p : p + width])] > 1:
                gone[p : p + width] = [True] * width
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("hot, many", [(2000, 2000), (2, 1)])
def test_words(make, corpus, monkeypatch, hot, many):
    monkeypatch.setattr(windows, "HOT", hot)
    monkeypatch.setattr(windows, "MANY_ROWS", many)
    got = superkmer.remove_repeated_windows(make(corpus), 9, 3).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_words(corpus, 9)
    assert superkmer.remove_repeated_windows(make([]), 9, 3).count() == 0


def brute_fingerprint(t):
    w = lower(t).encode().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash(make, corpus):
    fps = {(i, t): brute_fingerprint(t) for i, t, *_ in corpus}
    close = [(a[0], b[0]) for a in fps for b in fps if (fps[a] ^ fps[b]).bit_count() <= 2]
    root = roots({i for i, *_ in corpus}, close)
    got = Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(make(corpus)).collect())
    assert got == Counter((i, fps[i, t], root[i]) for i, t, *_ in corpus)
    assert simhash.near_duplicates(make([])).count() == 0


def test_links_lose_none(spark):
    """Fingerprints one and two bits apart, in a chain and around a centre, some in the same blocks."""
    base = 0x123456789ABCDEF0
    fps = {base, *(base ^ 1 << b for b in range(0, 64, 5)), *(base ^ 1 << b ^ 1 << b + 1 for b in range(0, 60, 7)), base ^ 7, base ^ 31, 0, 3, 1 << 63, (1 << 63) | 12}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = roots({signed(x) for x in fps}, [(signed(x), signed(y)) for x in fps for y in fps if (x ^ y).bit_count() <= 2])
    edges = simhash.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long"))
    assert all((r.u ^ r.v).bit_count() <= 2 or ((r.u ^ r.v) & (1 << 64) - 1).bit_count() <= 2 for r in edges.collect())
    got = {r.node: r.root for r in components(edges).collect()}
    assert all(got.get(n, n) == r for n, r in want.items())


@pytest.mark.parametrize("held", [7, 60, 1 << 20])
def test_components_held(spark, held):
    """Chains, a hub, and random edges give the same roots whether a task holds few of the edges or all of them."""
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 180)] + [(500, k) for k in range(501, 560)] + [(-(2**62), 2**62), (3, 3), (2**62, 9)]
    edges += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long").repartition(5), held).collect()}
    met = [(u, v) for u, v in edges if u != v]
    assert got == roots({x for e in met for x in e}, met)


def test_components_take_no_rounds(spark, monkeypatch):
    """Edges that one task can hold are written once and joined once, however long their paths."""
    made = []
    monkeypatch.setattr(components_module, "written", lambda df, name: made.append(name) or common.written(df, name))
    got = {r.node: r.root for r in components(spark.createDataFrame([(k, k + 1) for k in range(300)], "u long, v long")).collect()}
    assert got == dict.fromkeys(range(301), 0) and len(made) == 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 9), (9, 7), (7, 7), (200, 201), (160, 90)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 90 for i in range(100, 161)}, 90: 90, 5: 5, 9: 5, 7: 5, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_similar_documents(make):
    import random

    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows, want = [], set()
    for k in range(20):
        w = [rng.choice(vocabulary) for _ in range(300)]
        rows.append((10 * k, " ".join(w), None, None))
        for c in range(1, 4):
            v = list(w)
            for _ in range(4):  # some twenty of about three hundred shingles
                v[rng.randrange(300)] = "edited"
            rows.append((10 * k + c, " ".join(v).upper() if c == 2 else " ".join(v), None, None))
            want.add((10 * k + c, 10 * k))
    rows += [(1000, None, None, None), (1001, "", None, None), (None, "w1 w2 w3", None, None), (10, rows[4][1], None, None)]
    got = {(r.doc_id, r.component_id) for r in simhash.similar_documents(make(rows)).collect() if r.doc_id != r.component_id}
    assert got <= want and len(got) >= 0.95 * len(want)
    assert simhash.similar_documents(make([])).count() == 0


def brute_links(rows, shingle=5, similarity=0.8):
    sets = []
    for _, t, *_ in rows:
        w = lower(t or "").split()
        sets.append({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
    pairs = [(a, b) for b in range(len(rows)) for a in range(b) if sets[a] and sets[b]]
    return [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]


def test_similar_documents_at_the_bound(make):
    """Isolated pairs of a Jaccard similarity of 0.80 to 0.85, one passage replaced: none is lost."""
    rng = random.Random(4)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows = []
    for k in range(60):
        w, at, n = text(300), rng.randrange(250), rng.randint(22, 28)
        rows += [(2 * k, " ".join(w), None, None), (2 * k + 1, " ".join(w[:at] + text(n) + w[at + n :]), None, None)]
    rows += [(200 + k, t, None, None) for k, t in enumerate(["one two", "ONE two", "one", "a b c d e f", "a b c d e f g", "a b c d e f x"])]
    root = roots({i for i, *_ in rows}, [(rows[a][0], rows[b][0]) for a, b in brute_links(rows)])
    want = {(i, r) for i, r in root.items() if i != r}
    assert len(want) > 45
    assert {(r.doc_id, r.component_id) for r in simhash.similar_documents(make(rows)).collect() if r.doc_id != r.component_id} == want


def test_similar_documents_beside_a_hub(make):
    """Chains of sliding windows, similar to the next only: pairs of which neither is a shingle's hub or first."""
    rng = random.Random(6)
    rows = []
    for k in range(6):
        w, step = [f"w{rng.randrange(5000)}" for _ in range(1000)], rng.randint(18, 20)
        order = rng.sample(range(40), 40)
        rows += [(1000 * k + i, " ".join(w[step * at : step * at + 204]), None, None) for at, i in enumerate(order)]
    root = roots({i for i, *_ in rows}, [(rows[a][0], rows[b][0]) for a, b in brute_links(rows)])
    want = {(i, r) for i, r in root.items() if i != r}
    assert {(r.doc_id, r.component_id) for r in simhash.similar_documents(make(rows)).collect() if r.doc_id != r.component_id} == want
