"""The pipeline's stages, one after the other, against plain counterparts of their decisions."""

import random
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tracefold.llm import common, quality, simhash


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    common = ["the", "of", "and", "house", "garden", "tree", "river"]
    text = lambda n: " ".join(rng.choice(common) + (str(rng.randrange(50)) if rng.random() < 0.3 else "") for _ in range(n))
    rows = [(k, text(rng.randint(60, 200)), "en", rng.choice("ab"), k) for k in range(60)]
    rows += [(100, rows[0][1].upper().lower(), "en", "a", 1), (101, rows[1][1].replace("the", "THE"), "en", "a", 1)]
    edited = rows[2][1].split()
    edited[5] = "changed"
    rows += [(200, " ".join(edited), "en", "b", 1), (300, "## $$ %% " * 60, "en", "a", 1), (301, "short", "en", "a", 1), (302, None, None, None, None), (5, rows[5][1], "en", rows[5][3], 5)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{path}/documents.parquet")
    return f"file://{path}"


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    steps = dict(P.STAGES)
    kept = steps["quality rules"](spark, docs, folder).cache()
    assert kept.columns == columns and not {300, 301, 302} & {r.doc_id for r in kept.collect()}
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.quality_report(docs).where("kept").collect()}
    once = steps["exact dedup"](spark, kept, folder).cache()
    ids = [r.doc_id for r in once.collect()]
    assert once.columns == columns and len(ids) == len(set(ids)) and 100 in ids and 101 in ids and 0 not in ids and 1 not in ids and 5 in ids
    near = steps["near dedup"](spark, once, folder).cache()
    ids = {r.doc_id for r in near.collect()}
    assert near.columns == columns and 2 in ids and 200 not in ids
    assert len(ids) == once.count() - 1
    mixed = steps["mixing"](spark, near, folder).cache()
    words = sum(len(r.text.split()) for r in mixed.collect())
    total = sum(len(r.text.split()) for r in near.collect())
    assert mixed.columns == columns and abs(words - 1.5 * total) <= 32
    encoded = steps["encoding"](spark, mixed, folder)
    assert encoded.count() == mixed.count()
    assert P.run(spark, folder).count() == mixed.count()


def test_empty(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, folder).cache()
        assert docs.count() == 0


def test_near_rows_of_one_id(make):
    """Rows without id and rows that repeat an id are searched each, and only the near copy goes."""
    rng = random.Random(8)
    text = lambda: [f"w{rng.randrange(5000)}" for _ in range(200)]
    a, b, c, d = text(), text(), text(), text()
    edited = lambda w: " ".join([*w[:50], "edited", *w[51:]])
    rows = [(1, " ".join(a)), (None, edited(a)), (2, " ".join(b)), (7, edited(b)), (7, " ".join(c)), (None, " ".join(d)), (None, edited(d))]
    kept = P.near_stage(None, make([(*r, "en", "a") for r in rows]), "").collect()
    left = [(r.doc_id, r.text) for r in kept]
    assert len(left) == 4 and all(r in left for r in (rows[0], rows[2], rows[4])) and left.count(rows[5]) + left.count(rows[6]) == 1


def test_near_stage_is_simhash_and_more(make):
    """A pair within two bits of SimHash whose shingle sets are far apart goes by SimHash alone, a pair of many bits by the exact search."""
    rng = random.Random(12)
    same = [f"s{k}" for k in range(3)]
    often = same * 400  # its shingles repeat: a set of few shingles, a fingerprint of many
    far = [*often, *(f"x{rng.randrange(10**6)}" for _ in range(12))]
    near = [f"n{rng.randrange(10**6)}" for _ in range(200)]
    edited = [w if k not in (40, 90, 140) else "edited" for k, w in enumerate(near)]
    other = [f"o{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(i, " ".join(w), "en", "a") for i, w in enumerate((often, far, near, edited, other), 1)] + [(6, "", "en", "a"), (7, None, "en", "a"), (8, " \n", "en", "a")]
    fps = [simhash.fingerprint([w.encode() for w in words], 3) for words in (often, far, near, edited)]
    assert (fps[0] ^ fps[1]).bit_count() <= 2 < ((fps[2] ^ fps[3]) & (2**64 - 1)).bit_count()
    docs = make(rows)
    assert {r.doc_id for r in simhash.similar_documents(docs).where("NOT kept").collect()} == {4}
    assert sorted(r.doc_id for r in P.near_stage(None, docs, "").collect()) == [1, 3, 5, 6, 7, 8]


def test_near_stage_tasks(spark, make):
    """Few tasks, each of which leaves files and log entries on disk: chains of near copies, by SimHash and by shingles, take no rounds."""
    rng = random.Random(15)
    rows = []
    for i in range(6):
        words = [f"c{i}x{rng.randrange(10**6)}" for _ in range(300)]
        for k in range(12):  # each of a chain is near to the next ones only
            rows.append((100 * i + k, " ".join(words), "en", "a"))
            for at in rng.sample(range(300), 6):
                words[at] = f"e{rng.randrange(10**6)}"
    docs = make(rows)
    spark.sparkContext.setJobGroup("near stage", "")
    left = P.near_stage(spark, docs, "").collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    status = spark.sparkContext.statusTracker()
    stages = {s for j in status.getJobIdsForGroup("near stage") for s in status.getJobInfo(j).stageIds}
    tasks = sum(info.numCompletedTasks for s in stages if (info := status.getStageInfo(s)))
    assert sorted(r.doc_id for r in left) == [0, 100, 200, 300, 400, 500]
    assert 0 < tasks < 200


def test_near_stage_removes_shuffles(spark, make, monkeypatch):
    """Every table of the exact search is written with its shuffle files removed; none of such a table's stays."""
    key, seen = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    monkeypatch.setattr(simhash, "written", lambda df, name: seen.append(spark.conf.get(key, None)) or common.written(df, name))
    rows = [(k, " ".join(f"v{k}x{j}" for j in range(80)), "en", "a") for k in range(9)]
    assert P.near_stage(spark, make(rows), "").count() == 9
    assert len(seen) > 8 and set(seen) == {"true"} and spark.conf.get(key, None) != "true"
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {f.apply(i).getName() for f in [manager.getAllFiles()] for i in range(f.size()) if f.apply(i).getName().startswith("shuffle_")}
    before = held()
    with common.shuffles_removed(spark):
        common.written(spark.range(10**4).groupBy((F.col("id") % 99).alias("k")).count(), "counts")
    for _ in range(50):  # they are removed in the background
        if not (more := held() - before):
            break
        time.sleep(0.1)
    assert not more


@pytest.mark.parametrize("ids", ["long", "string"])
def test_stages_keep_clashing_columns(make, ids):
    """Every stage on rows with columns of the names used inside, nulls, repeated ids and rows, and ids of either type."""
    rng = random.Random(10)
    text = lambda n: " ".join(rng.choice(["the", "of", "and", "house", "garden"]) + (f" w{rng.randrange(300)}" if rng.random() < 0.4 else "") for _ in range(n))
    rows = [(k, text(rng.randint(60, 120)), rng.choice(["en", None]), rng.choice(["a", "b", None])) for k in range(30)]
    rows += [(3, text(70), "en", "a"), (None, text(80), "en", "b"), (None, None, None, None), (40, "", "en", "a"), (41, rows[5][1], "en", "a"), rows[6], rows[6]]
    docs = make(rows)
    docs = docs.withColumn("doc_id", docs["doc_id"].cast(ids))
    for name, stage in P.STAGES[:-1]:
        got = stage(docs.sparkSession, docs, "")
        assert got.schema.names == docs.schema.names and got.count() > 25, name
    mixed = P.mixing_stage(docs.sparkSession, docs, "").collect()
    total = sum(len((t or "").split()) for _, t, *_ in rows)
    assert abs(sum(len(r.text.split()) for r in mixed) - 1.5 * total) <= 8 * 4
    whole = {(None if i is None else str(i), t) for i, t, *_ in rows}
    assert all(any(r.text == t or r.text in " ".join(t.split()) for i, t in whole if t and i == (None if r.doc_id is None else str(r.doc_id))) for r in mixed)
    assert P.encoding_stage(docs.sparkSession, docs, "").count() == len(rows)
