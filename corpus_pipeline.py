"""A corpus pipeline of five stages, each over the table that the stage before it wrote.

Quality rules drop documents; exact deduplication keeps the row of the largest id of
equal texts; near-deduplication keeps one document of each group; mixing repeats or cuts
documents to what the mix takes of them; encoding returns token counts and digests.
All but the last return the columns of documents. Rows are kept whole: no stage samples.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracefold.llm import bpe, exact_dedup, mixing, quality, simhash
from tracefold.llm.common import WORD, documents, forget, temporary, written
from tracefold.llm.queries import vocabulary_path

#: Words of a shingle and least similarity of the near-duplicate stage.
SHINGLE, SIMILARITY = 5, 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; references come from the documents given.

    Null and empty texts have no words and go. Rows without a language are judged by the
    references of all others; without any reference only the counts decide. Repeated rows
    are judged alike, an empty table stays empty, further columns are kept.
    """
    return quality.keep_good(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts; among repeated rows (same id and text) one stays.

    Null and empty texts are equal texts; a null id stays only in a group without any
    other. An empty table stays empty; further columns, of any name, are kept.
    """
    found = exact_dedup.exact_duplicates(docs)
    # written, so that the planner knows its size before it decides whether the texts must travel
    gone = written(found.where("NOT kept").select(F.col("doc_id").alias("__gone"), F.xxhash64("digest").alias("__digest")), "gone")
    left = docs.withColumn("__digest", F.xxhash64(exact_dedup.sha256(exact_dedup.normalised("text"))))
    left = left.join(gone, (F.col("doc_id").eqNullSafe(F.col("__gone"))) & (left["__digest"] == gone["__digest"]), "left_anti").drop("__digest")
    repeated = found.where("kept").groupBy("digest").count().where("count > 1")
    return left if repeated.isEmpty() else left.dropDuplicates(["doc_id", "text"])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group linked by SimHash, or by an exact search for similar texts that follows.

    Rows are known by id and text, ids may be of any type: a null id counts as the largest,
    rows that repeat an id with different texts are judged each, repeated rows (same id and
    text) stay or go together. Null, empty and blank texts are linked to nothing and stay.
    An empty table stays empty; further columns, of any name, are kept.
    """
    with temporary() as keep:
        found = simhash.linked_documents(docs, SHINGLE, SIMILARITY)
        # written, so that the planner knows its size before it decides whether the texts must travel
        gone = keep(written(found.where("NOT kept").select(F.col("node").alias("__gone")), "gone"))
    return docs.withColumn("__node", simhash.row_node()).join(gone, F.col("__node") == F.col("__gone"), "left_anti").drop("__node")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row for each lap that takes words of a document, whole where the lap takes all of it.

    Part of a text is its words joined by one space. Rows without words (null, empty and
    blank texts) are not taken; a null source is a source of its own, null ids are ids.
    Rows that repeat an id with different texts are known by their text, repeated rows (same
    id and text) by number, each with its own laps. An empty table stays empty; further
    columns, of any name, are kept.
    """
    spans = mixing.mixed(docs).where("taken > 0").select(F.col("doc_id").alias("__id"), F.col("copy").alias("__text"), F.col("size").alias("__size"), F.col("spans").alias("__spans"))
    key = [F.col("__id"), F.col("__text")]
    docs_ = docs.withColumn("__copy", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    by = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__copy") == F.col("__text"))
    if not spans.groupBy(*key).count().where("count > 1").isEmpty():
        number = F.row_number().over(Window.partitionBy("doc_id", "__copy").orderBy(F.lit(0)))
        spans = spans.withColumn("__place", F.row_number().over(Window.partitionBy(*key).orderBy("__spans")))
        docs_, by = docs_.withColumn("__number", number), by & (F.col("__number") == F.col("__place"))
    got = docs_.join(spans.withColumn("__span", F.explode("__spans")), by)
    first, last = F.col("__span")["from"], F.col("__span")["to"]
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), (first + 1).cast("int"), (last - first).cast("int"))
    whole = (first == 0) & (last == F.col("__size"))
    return got.withColumn("text", F.when(whole, F.col("text")).otherwise(F.array_join(words, " "))).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row, by the vocabulary of the document queries.

    A null text counts as empty (no tokens), repeated rows give repeated results, an empty
    table an empty one; other columns are not read.
    """
    return bpe.encode_documents(docs, vocabulary_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: The stages hash with XXH64 and merge byte pairs, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for i, (name, stage) in enumerate(STAGES):
        with temporary() as keep:
            docs = keep(written(stage(spark, docs, sf_dir), f"stage-{i}"))
        if before is not None:
            forget(before)
        before = docs
    return docs
