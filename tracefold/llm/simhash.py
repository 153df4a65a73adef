"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints are cut into d + 4 blocks; two that differ in at most d bits agree on four
whole blocks at least, so the join key is every choice of four blocks (42 bits or more
for d = 2, 15 choices). Of 10^10 fingerprints that are spread evenly some 3 % meet a
stranger by chance; the share grows in proportion to their number. A block group that
holds two or more different fingerprints is verified without forming its pairs: two
fingerprints differ in at most two bits exactly when flipping at most one bit of each can
give the same value, so every member is dealt to its one-flip neighbourhood and linked to
the least fingerprint that meets it there. Copies share a fingerprint and are one node
from the start.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, dealt_anew, flat, gram_hashes, map_text, shuffles_removed, temporary, word_hashes, words_of, written
from .components import components

SEED = 42
BITS = 64
SHARED_BLOCKS = 4
#: Bytes of hash bits that one pass of counting expands.
PASS = 1 << 16

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(words: list[bytes], shingle: int) -> int:
    """The SimHash of the words' shingles, repeats included; 0 without words."""
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), "<u8")
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(h), PASS):
        ones += np.unpackbits(h[a : a + PASS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, shingle: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp): fp as a signed 64-bit number. A-Z are lower-cased; null counts as empty, whose fingerprint is 0."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = flat(batch.column(text))
        raw = data.tobytes().translate(_LOWER)
        fps = [fingerprint(raw[a:b].split(), shingle) for a, b in zip(offsets, offsets[1:])]
        return pa.RecordBatch.from_arrays([batch.column(doc_id), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return map_text(df, each, f"doc_id {df.schema[doc_id].dataType.simpleString()}, fp long", [doc_id, text], text)


def blocks(distance: int) -> list[int]:
    """Masks of the bits that a choice of blocks holds fixed."""
    n = distance + SHARED_BLOCKS
    edges = [BITS * i // n for i in range(n + 1)]
    single = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    return [sum(x) for x in combinations(single, SHARED_BLOCKS)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """(u, v): star links whose components are those of all pairs of fingerprints within `distance` (0 or 2) bits.

    fps: one row per different fingerprint, column fp. No pair of a group is formed: k
    fingerprints that share a block with another give 65 k rows.
    """
    if distance not in (0, 2):
        raise ValueError("distance must be 0 or 2")
    masks = blocks(distance)
    dealt = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")) for m in masks])).alias("choice", "key"))
    groups = dealt.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    members = dealt.join(dealt_anew(groups), ["choice", "key"]).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << b)).cast("long") for b in range(BITS)])
    meets = F.transform(flips, lambda b: F.col("fp").bitwiseXOR(b)) if distance else F.array("fp")
    at = members.select("fp", F.explode(meets).alias("z"))
    least = at.groupBy("z").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = at.join(dealt_anew(least), "z").where("fp <> v").select(F.col("fp").alias("u"), "v").distinct()
    return pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance)


def near_duplicates(df: DataFrame, shingle: int = 3, distance: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links, the document itself included.

    One row per input row. A null or empty text has fingerprint 0 and links like any
    other; a text of fewer words than a shingle is one shingle; repeated rows share
    their fingerprint and so their component; a null doc_id is linked but is never the
    smallest unless its component has no other; an empty table gives an empty table.
    """
    docs = written(fingerprints(df, shingle, text, doc_id), "fingerprints")
    with temporary() as keep:
        nodes = docs.groupBy("fp").agg(F.min("doc_id").alias("least"))
        roots = components(links(nodes.select("fp"), distance)).withColumnsRenamed({"node": "fp"})
        labelled = keep(written(nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "roots"))
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = labelled.join(dealt_anew(smallest), "root").select("fp", "component_id")
    return docs.join(dealt_anew(of_fp), "fp").select("doc_id", "fp", "component_id")


_FOLD = np.frombuffer(_LOWER, np.uint8)


def row_node(doc_id: str = "doc_id", text: str = "text"):
    """What a row is known by: a hash of its id and text."""
    return F.xxhash64(F.col(doc_id).isNull(), doc_id, text)


def shingle_sets(df: DataFrame, shingle: int, text: str = "text", node: str = "node") -> DataFrame:
    """(node, grams): the hashes of each document's different word shingles."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = flat(batch.column(text))
        low = _FOLD[data]
        starts, ends, _ = words_of(low, offsets)
        bounds = np.searchsorted(starts, offsets).tolist()
        h = word_hashes(low, starts, ends)
        sets = [np.unique(gram_hashes(h[a:b], min(shingle, b - a))) if b > a else h[:0] for a, b in zip(bounds, bounds[1:])]
        ends_ = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column(node), pa.ListArray.from_arrays(pa.array(ends_), pa.array(np.concatenate(sets).view(np.int64)))], ["node", "grams"])

    return map_text(df, each, "node long, grams array<long>", [node, text], text)


def _prefix(share: float):
    """Shingles that a document must be searched by, where `share` of its `size` must be met: one more than may be missed."""
    return F.col("size") - F.ceil(share * F.col("size") - 1e-9) + 1


def prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """(node, gram, size, at, n, low): the shingles of each document's prefix that other documents have too.

    A document's shingles are ordered by the documents n that have them (then by hash), so
    the prefix holds the rarest; at is a shingle's place in the order. Of two documents of
    the similarity, the prefix of the larger and the low part of the smaller's share a
    shingle: none is lost. Shingles of one document take the first places and meet nothing.
    """
    held = sets.select("node", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    shared = held.withColumn("n", F.count("*").over(Window.partitionBy("gram"))).where("n > 1")
    own = Window.partitionBy("node")
    at = F.col("size") - F.count("*").over(own) + F.row_number().over(own.orderBy("n", "gram")) - 1
    return shared.withColumn("at", at).where(F.col("at") < _prefix(similarity)).withColumn("low", F.col("at") < _prefix(2 * similarity / (1 + similarity)))


def star_pairs(met: DataFrame, similarity: float) -> DataFrame:
    """(u, v): the documents of each shingle with two of them, the one of most company and the first."""
    degree = met.groupBy("node").agg(F.sum("n").alias("degree"))
    ranked = met.join(dealt_anew(degree), "node")
    hub = ranked.groupBy("gram").agg(F.max(F.struct("degree", "node", "size")).alias("hub"), F.min(F.struct("node", "size")).alias("first"))
    ends = dealt_anew(hub).select("gram", F.array(F.struct("hub.node", "hub.size"), F.struct("first.node", "first.size")).alias("ends"))
    sides = met.select("gram", "node", "size").join(ends, "gram").select("node", "size", F.inline("ends").alias("v", "size_v"))
    sides = sides.where("node <> v").where(F.least("size", "size_v") >= similarity * F.greatest("size", "size_v") - 1e-9)
    return sides.select(F.greatest("node", "v").alias("u"), F.least("node", "v").alias("v")).distinct()


def open_pairs(met: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """(u, v): all documents of a shingle that are not known to be of one component, as far as their sizes and places allow.

    A shingle's most frequent component is never paired with itself, so a large group that
    the stars have linked costs its size, not its square.
    """
    members = met.join(roots.select(F.col("node").alias("__node"), "root"), F.col("node") == F.col("__node"), "left").select("gram", "node", "size", "at", "low", F.coalesce("root", "node").alias("root"))
    members = written(members, "members")
    kinds = members.groupBy("gram", "root").agg(F.count("*").alias("n"), F.max("low").alias("low"))
    # "open" where several components meet and one document of the low part does
    several = kinds.groupBy("gram").agg(F.max(F.struct("n", "root")).alias("major"), F.count("*").alias("kinds"), F.max("low").alias("any")).where("kinds > 1 AND any")
    several = dealt_anew(several.select("gram", F.col("major.root").alias("major")))
    members = written(members.join(several, "gram").select("gram", "node", "size", "at", "low", "root", (F.col("root") != F.col("major")).alias("rest")), "open")
    u = members.where("low").select("gram", *[F.col(c).alias(f"{c}_u") for c in ("node", "size", "at", "root", "rest")])
    v = members.select("gram", *[F.col(c).alias(f"{c}_v") for c in ("node", "size", "at", "root", "rest")])
    # the smaller is u; at their first common shingle no more than what follows on either side can be shared
    fit = (F.col("size_u") <= F.col("size_v")) & (F.col("size_u") >= similarity * F.col("size_v") - 1e-9) & (F.col("root_u") != F.col("root_v"))
    fit &= F.least(F.col("size_u") - F.col("at_u"), F.col("size_v") - F.col("at_v")) >= similarity / (1 + similarity) * (F.col("size_u") + F.col("size_v")) - 1e-6
    met_by = [x.hint("merge").join(y.hint("merge"), "gram").where(fit).select("node_u", "node_v") for x, y in ((u.where("rest_u"), v), (u.where("NOT rest_u"), v.where("rest_v")))]
    return met_by[0].union(met_by[1]).select(F.greatest("node_u", "node_v").alias("u"), F.least("node_u", "node_v").alias("v")).distinct()


def similar_pairs(keyed: DataFrame, pairs: DataFrame, shingle: int, similarity: float, text: str = "text") -> DataFrame:
    """The pairs (u, v) whose shingles have the Jaccard similarity. keyed: (node, text)."""
    with temporary() as keep:
        pairs = written(pairs, "pairs")
        # written, so that the planner knows its size before it decides whether the texts must travel
        asked = written(pairs.select(F.col("u").alias("__node")).union(pairs.select(F.col("v").alias("__node"))).distinct(), "asked")
        sets = written(shingle_sets(keyed.join(asked, F.col("node") == F.col("__node"), "left_semi"), shingle, text).dropDuplicates(["node"]), "sets")
        a, b = (sets.select(F.col("node").alias(c), F.col("grams").alias(f"g{c}")) for c in ("u", "v"))
        shared = F.size(F.array_intersect("gu", "gv"))
        close = pairs.join(a, "u").join(b, "v").where(shared >= similarity * (F.size("gu") + F.size("gv") - shared)).select("u", "v")
        return keep(written(close, "links"))


def simhash_links(keyed: DataFrame, shingle: int = 3, distance: int = 2, text: str = "text") -> DataFrame:
    """(u, v): links whose components are those of all documents within `distance` bits. keyed: (node, text).

    The method of near_duplicates: fingerprints, blocks, fingerprints within `distance`
    bits. Documents of one fingerprint are linked to the least of them, the least ones of
    linked fingerprints to each other; their components are left to the caller, who joins
    them with other links. Documents without word are linked to nothing.
    """
    with temporary() as keep:
        worded = keyed.where(F.col(text).rlike(WORD))
        prints = written(fingerprints(worded, shingle, text, "node").withColumnRenamed("doc_id", "node").distinct(), "fingerprints")
        least = written(prints.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("n")), "least")
        copies = prints.join(dealt_anew(least.where("n > 1")), "fp").where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
        of_u, of_v = (least.select(F.col("fp").alias(c), F.col("least").alias(f"least_{c}")) for c in ("u", "v"))
        across = links(least.select("fp"), distance).join(of_u, "u").join(of_v, "v").select(F.col("least_u").alias("u"), F.col("least_v").alias("v"))
        return keep(written(copies.union(across), "links"))


def linked_documents(df: DataFrame, shingle: int = 5, similarity: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, node, component_id, kept), as similar_documents, of documents linked by SimHash or by the similarity of their shingles.

    SimHash (fingerprints of three-word shingles within two bits) joins first, all pairs of
    it. Two bits are far less than texts at the least similarity differ by, so an exact
    search for the rest follows; what SimHash has joined is not compared again there but
    with each shingle's two.
    """
    return _grouped(df, lambda keyed: simhash_links(keyed, text=text), shingle, similarity, text, doc_id)


def similar_documents(df: DataFrame, shingle: int = 5, similarity: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, node, component_id, kept) of the rows linked to others; component_id is the smallest id reachable, kept marks its row.

    Links are pairs whose sets of word shingles (A-Z lower-cased) have a Jaccard similarity
    of `similarity` or more. Candidates come from prefixes of rare shingles, which lose no
    pair, and are verified by all their shingles. A shingle's documents are first compared
    with two of them, the one of most company and the first; whatever those comparisons
    did not join is then compared in pairs, so that the components are those of all pairs.
    A row is known by its node (`row_node`), so rows without id are linked like others, and
    rows that repeat an id with different texts are searched each; of the smallest id's rows
    one is kept, and an id of null counts as the largest. Repeated rows (same id and text)
    are one node; rows without word are not linked. Texts may be of any length.
    """
    return _grouped(df, None, shingle, similarity, text, doc_id)


def _grouped(df: DataFrame, before: Callable[[DataFrame], DataFrame] | None, shingle: int, similarity: float, text: str, doc_id: str) -> DataFrame:
    """similar_documents, with the links (u, v) that another method finds before."""
    keyed = df.select(row_node(doc_id, text).alias("node"), text)
    with temporary() as keep, shuffles_removed(df.sparkSession):
        known = before and before(keyed)
        met = written(prefixes(shingle_sets(keyed, shingle, text), similarity), "prefixes")
        close = similar_pairs(keyed, star_pairs(met, similarity), shingle, similarity, text)
        close = close if known is None else close.union(known)
        others = similar_pairs(keyed, open_pairs(met, components(close), similarity), shingle, similarity, text)
        roots = components(close.union(others))
        ids = df.select(F.col(doc_id).alias("doc_id"), row_node(doc_id, text).alias("node")).join(roots, "node").distinct()
        ids = keep(written(ids.select("doc_id", "node", "root"), "rows"))
    least = ids.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "node")).alias("least"))
    found = ids.join(dealt_anew(least), "root")
    return found.select("doc_id", "node", F.col("least.doc_id").alias("component_id"), (F.col("node") == F.col("least.node")).alias("kept"))
