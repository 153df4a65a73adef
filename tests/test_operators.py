"""Trajectory operators on values that can be worked out by hand."""

import datetime
import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracefold.functions import geo, rng
from tracefold.operators import attacks, cleaning, matching, metrics, protect, reporting, sequences, splits, stays, zones
from tracefold.plans import catalogue
from tracefold.session import shared_dir

POINTS = "array<struct<lat:double,lon:double,t:double>>"
PATH = "array<struct<x:double,y:double>>"


def trajectories(spark, rows):
    return spark.createDataFrame([(t, u, [tuple(map(float, p)) for p in pts]) for t, u, pts in rows], f"traj_id string, user_id string, points {POINTS}")


def paths(spark, rows):
    return spark.createDataFrame([(t, u, [tuple(map(float, p)) for p in pts]) for t, u, pts in rows], f"traj_id string, user_id string, path {PATH}")


def l_shape():
    """A hundred points two seconds apart: fifty north, fifty east, some ten metres a second."""
    lat, lon, out = 39.983, 116.305, []
    for i in range(100):
        out.append((lat, lon, 1000.0 + 2 * i))
        if i < 50:
            lat += 1.8e-4
        else:
            lon += 2.35e-4
    return out


def test_uniform_twin(spark):
    got = spark.range(5).select(rng.uniform(7, "x", F.col("id")).alias("u")).collect()
    assert [r.u for r in got] == [rng.draw(7, "x", i) for i in range(5)]


def test_cleaning(spark):
    spiked = l_shape()
    for i in (20, 60, 80):
        spiked[i] = (spiked[i][0] + 0.1, spiked[i][1], spiked[i][2])
    late = l_shape()
    late.insert(10, (late[9][0], late[9][1], late[9][2] - 5))
    rows = [("l", "a", l_shape()), ("spiked", "a", spiked), ("few", "b", l_shape()[:5]), ("short", "b", [(39.9, 116.3, float(6 * i)) for i in range(30)]), ("late", "c", late), ("none", "c", [])]
    got = {r.traj_id: r for r in cleaning.clean(trajectories(spark, rows)).collect()}
    assert set(got) == {"l", "spiked", "late"}
    l = got["l"]
    assert l.n_points == 34 and l.duration_s == 198 and abs(l.length_m - 1960) < 40 and abs(l.mean_speed - 9.9) < 0.25
    assert list(l.cleaning_flags) == ["speed_outliers_dropped:0", "resampled:5s"]
    assert got["spiked"].outliers == 3 and got["late"].outliers == 1


def test_cleaning_by_plain_folds(monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(cleaning, "AHEAD", 2)  # several steps beyond each outlier

    def metres(a, b):
        s = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * geo.EARTH_M * math.asin(math.sqrt(s))

    def plain(points, follows):
        kept = []
        for i, p in enumerate(points):
            if not kept or follows(points[kept[-1]], p):
                kept.append(i)
        return kept

    for n in (0, 1, 2, 40, 40, 40, 3000):
        jumps = np.where(rng.random(n) < 0.2, 0.05, 0.0003)
        lat, lon = 39.9 + rng.normal(0, 1, n) * jumps, 116.3 + rng.normal(0, 1, n) * jumps
        t = np.cumsum(rng.choice([-4.0, 0.0, 2.0, 6.0], n, p=[0.1, 0.1, 0.4, 0.4]))
        points = list(zip(lat.tolist(), lon.tolist(), t.tolist()))
        slow = plain(points, lambda a, b: b[2] > a[2] and metres(a, b) / (b[2] - a[2]) * 3.6 <= 150)
        assert cleaning.not_fast(lat, lon, t, 150.0).tolist() == slow
        assert cleaning._spaced(t, 5.0).tolist() == plain(points, lambda a, b: b[2] - a[2] >= 5)


def test_split(spark):
    users = spark.createDataFrame([(f"u{k}", f"t{k}{j}") for k in range(7) for j in range(3)], "user_id string, traj_id string")
    fractions = {"train": 0.5, "test": 0.2, "shadow": 0.2, "attack": 0.1}
    got = splits.split_by_user(users, fractions, 3)
    of = {(r.user_id, r.split) for r in got.collect()}
    assert len(of) == 7 and {s: sum(x == s for _, x in of) for s in fractions} == {"train": 4, "test": 1, "shadow": 1, "attack": 1}
    assert {(r.user_id, r.split) for r in splits.split_by_user(users.repartition(9), fractions, 3).collect()} == of
    small, large = ({r.user_id for r in splits.subsample_users(users, n, 1).collect()} for n in (2, 5))
    assert len(small) == 2 and len(large) == 5 and small < large
    for bad in ({"train": 0.5}, {"train": 0.5, "other": 0.5}):
        with pytest.raises(ValueError):
            splits.split_by_user(users, bad, 3)
    assert splits.largest_remainder(7, fractions) == {"train": 4, "test": 1, "shadow": 1, "attack": 1}


def test_grid_and_views(spark):
    grid = geo.Grid(116.30, 39.98, 116.32, 39.995, 3, 4)
    rows = spark.createDataFrame([(39.981, 116.311), (30.0, 110.0), (50.0, 120.0)], "lat double, lon double")
    assert [r.c for r in rows.select(grid.cell(F.col("lat"), F.col("lon")).alias("c")).collect()] == [2, 0, 11] and grid.cells == 12
    seqs = spark.createDataFrame([("t", [1, 1, 2, 2, 1])], "traj_id string, seq array<int>")
    assert list(sequences.collapse(seqs).first().seq) == [1, 2, 1]


@pytest.mark.parametrize(("k", "n", "want"), [(1, 5, [0]), (3, 3, [0, 1, 2]), (9, 3, [0, 1, 2]), (5, 23, [0, 6, 11, 16, 22]), (4, 10, [0, 3, 6, 9])])
def test_evenly_spaced(spark, k, n, want):
    assert list(spark.range(1).select(geo.evenly_spaced(F.sequence(F.lit(0), F.lit(n - 1)), k).alias("s")).first().s) == want == (sorted({round(x) for x in np.linspace(0, n - 1, min(k, n)).round()}) if k > 1 else [0])


def plain_dtw(a, b):
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0
    for i, p in enumerate(a, 1):
        for j, q in enumerate(b, 1):
            d[i, j] = math.dist(p, q) + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
    return d[-1, -1]


def test_distances(spark):
    r = np.random.default_rng(1)
    pairs = [(r.normal(size=(n, 2)), r.normal(size=(m, 2))) for n, m in ((1, 1), (3, 7), (5, 20), (8, 2))]
    frame = spark.createDataFrame([([tuple(map(float, p)) for p in a], [tuple(map(float, p)) for p in b]) for a, b in pairs], f"a {PATH}, b {PATH}")
    got = frame.select(geo.dtw(F.col("a"), F.col("b")).alias("dtw"), geo.hausdorff(F.col("a"), F.col("b")).alias("h"), attacks.path_dtw(F.col("a"), F.col("b")).alias("long")).collect()
    for (a, b), g in zip(pairs, got):
        d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
        assert g.dtw == pytest.approx(plain_dtw(a, b)) and g.long == pytest.approx(g.dtw) and g.h == pytest.approx(max(d.min(1).max(), d.min(0).max()))
        assert attacks.dtw_matrix([a], [b, a])[0] == pytest.approx([plain_dtw(a, b), 0])
    empty = spark.createDataFrame([([], [(0.0, 0.0)])], f"a {PATH}, b {PATH}").select(geo.dtw(F.col("a"), F.col("b")).alias("d"), geo.hausdorff(F.col("a"), F.col("b")).alias("h")).first()
    assert empty.d == empty.h == math.inf
    assert spark.createDataFrame([([], [(0.0, 0.0)]), ([(0.0, 0.0)], [])], f"a {PATH}, b {PATH}").select(attacks.path_dtw(F.col("a"), F.col("b"))).collect() == [(math.inf,), (math.inf,)]


def test_utm(spark):
    row = spark.range(1).select(*geo.utm(F.lit(117.0), F.lit(0.0)), *geo.utm(F.lit(117.0), F.lit(40.0))).first()
    assert row[0] == pytest.approx(500_000) and row[1] == pytest.approx(0, abs=1e-6) and row[3] == pytest.approx(4_427_757.219, abs=1e-2)


def test_reidentification(spark):
    line = lambda x0, y0, dx, dy, n: [(x0 + dx * i, y0 + dy * i) for i in range(n)]
    pool = paths(spark, [("A1", "A", line(0, 0, 1, 0, 4)), ("A2", "A", line(0, 0.1, 1, 0, 4)), ("B1", "B", line(0, 10, 0, 1, 4)), ("B2", "B", line(0.1, 10, 0, 1, 4)), ("C1", "C", line(5, 5, 0, 1, 3))])
    ranking = attacks.dtw_ranking(pool, pool, 4)
    probes = pool.where("user_id <> 'C'")
    hits = attacks.top_k(ranking, probes, 1).collect()
    assert len(hits) == 4 and all(h.hit == 1 for h in hits)
    assert {r.true_user for r in ranking.collect()} == {"A", "B"}
    nobody = attacks.dtw_ranking(pool.limit(0), pool, 4)
    assert [h.hit for h in attacks.top_k(nobody, probes, 1).collect()] == [0.0] * 4


@pytest.fixture
def crowd(spark, monkeypatch):
    """Users of one to nine trajectories, some with equal paths, in many small blocks; users of more than two are cut."""
    monkeypatch.setattr(attacks, "USER_TRAJECTORIES", 2)
    monkeypatch.setattr(attacks, "BLOCK_POINTS", 40)
    monkeypatch.setattr(attacks, "KEPT", 100)
    r = np.random.default_rng(5)
    known = [(f"{u}/{i}", f"u{u}", [tuple(map(float, p)) for p in r.integers(0, 6, (r.integers(1, 12), 2))]) for u, n in enumerate((1, 2, 3, 9, 2, 4, 2)) for i in range(n)]
    known += [("7/0", "u7", known[3][2]), ("7/1", "u7", known[8][2])]
    return paths(spark, known), known


def plain_ranking(known, k):
    users = [u for _, u, _ in known]
    for t, u, p in known:
        if users.count(u) > 1:
            at = sorted({round(x) for x in np.linspace(0, len(p) - 1, min(k, len(p))).round()})
            best = {}
            for g, v, q in known:
                if g != t:
                    best[v] = min(best.get(v, math.inf), plain_dtw([p[i] for i in at], q))
            yield from ((t, u, v, d, i) for i, (d, v) in enumerate(sorted((d, v) for v, d in best.items()), 1))


def test_ranking_leaves_tasks_ranked(crowd):
    """The whole ranking, and no pair of probe and user is shuffled after the tasks that compare them."""
    pool, known = crowd
    ranking = attacks.dtw_ranking(pool, pool, 4)
    got = sorted(tuple(r) for r in ranking.collect())
    want = sorted(plain_ranking(known, 4))
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want] and [r[3] for r in got] == pytest.approx([r[3] for r in want])
    plan = ranking._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapIn")]


def test_ranking_computes_its_source_once(crowd, spark):
    """Neither counting nor ranking computes the source anew, and no table stays but those that the ranking reads."""
    pool, known = crowd
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    folder = Path(shared_dir(spark).removeprefix("file://"), "tracefold")
    before = {p.name for p in folder.glob("*")}
    source = pool.mapInArrow(counted, pool.schema)
    ranking = attacks.dtw_ranking(source, source, 4)
    assert len(ranking.collect()) == len(list(plain_ranking(known, 4)))
    assert seen.value == len(known)
    made = {p.name for p in folder.glob("*")} - before
    assert sorted(t.split("-")[0] for t in made) == ["gallery", "probes"] and {Path(f).parent.name for f in ranking.inputFiles()} == made


def test_ranking_keeps_its_tasks(crowd, spark):
    """As many shuffle partitions as tasks are asked do not take their place, which would be coalesced into one task."""
    pool, _ = crowd
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(2 * spark.sparkContext.defaultParallelism))
    try:
        plan = attacks.dtw_ranking(pool, pool, 4)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert plan.count("REPARTITION_BY_NUM") == 2


def test_hits_without_ranking(crowd):
    """Hits by counting the users before the true one are those of the ranking: equal distances, users in several blocks, unasked users."""
    pool, known = crowd
    want = list(plain_ranking(known, 4))
    for k in (1, 2, 4):
        got = {r.probe_id: r.hit for r in attacks.top_k_hits(pool, pool, k, 4).collect()}
        assert got == {t: float(any(r[0] == t and r[2] == r[1] and r[4] <= k for r in want)) for t, *_ in want}
    assert 0 < sum(got.values()) < len(got)
    assert {r.hit for r in attacks.top_k_hits(pool.limit(0), pool, 1, 4).collect()} == {0.0}


def _run_without_ranking(monkeypatch, query, tmp_path, spark):
    """Rows of a catalogue query over some events, the whole ranking being out of reach."""
    r = np.random.default_rng(6)
    rows = [(i, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=int(r.integers(700))), int(r.integers(5)), "a", float(r.uniform(0, 200)), f'{{"k": {r.integers(100)}}}') for i in range(300)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"file://{tmp_path}/events.parquet")
    monkeypatch.setattr(attacks, "dtw_ranking", None)
    return catalogue.QUERIES[query](spark, f"file://{tmp_path}").collect()


def test_linkage_rate_makes_no_ranking(spark, monkeypatch, tmp_path):
    assert 0 <= _run_without_ranking(monkeypatch, "linkage_rate", tmp_path, spark)[0].linkage_rate <= 1


def test_topk_accuracy_makes_no_ranking(spark, monkeypatch, tmp_path):
    found = _run_without_ranking(monkeypatch, "topk_accuracy", tmp_path, spark)[0]
    assert found.top5_acc == 1 and found.n_probes > 0  # five users: each is among the first five


def test_whittaker():
    r = np.random.default_rng(2)
    for n in (3, 4, 5, 40):
        y, lam = r.normal(size=(n, 2)) * 50, None
        got = attacks.whittaker(y, 9.0, 2.0)
        d = np.zeros((n - 2, n))
        for i in range(n - 2):
            d[i, i : i + 3] = 1, -2, 1
        assert got == pytest.approx(np.linalg.solve(np.eye(n) + 9.0 / 4.0 * d.T @ d, y))
    assert attacks.whittaker(np.zeros((2, 2)), 1.0) == pytest.approx(np.zeros((2, 2)))
    straight = np.array([(4.0 * i, 3.0 * i) for i in range(60)])
    noisy = straight + r.normal(size=straight.shape) * 10
    err = lambda x: np.hypot(*(x - straight).T).mean()
    assert err(attacks.whittaker(noisy, 100.0)) < 0.6 * err(noisy)


def test_second_difference(spark):
    got = paths(spark, [("t", "u", [(0, 0), (1, 1), (4, 0), (9, 5)])]).select(attacks.second_difference(F.col("path")).alias("d")).first().d
    assert [tuple(x) for x in got] == [(2, -2), (2, 6)]


def test_stays_and_places(spark):
    night, noon = 18 * 3600.0, 4 * 3600.0  # 02 and 12 hours local
    stay = lambda lat, t0: [(lat, 116.3, t0 + 60 * i) for i in range(8)]
    walk = [(39.95 + 0.01 * i, 116.3, noon + 3000 + 60 * i) for i in range(5)]
    rows = [("1", "A", stay(39.9, night)), ("2", "A", stay(39.99, noon) + walk), ("3", "B", stay(39.8, night)), ("4", "C", walk)]
    arrays = trajectories(spark, rows)
    found = stays.stay_points(arrays, 200, 300)
    got = sorted((r.traj_id, r.n, round(r.lat, 4)) for r in found.collect())
    assert got == [("1", 8, 39.9), ("2", 8, 39.99), ("3", 8, 39.8)]
    places = {r.user_id: r for r in stays.home_work(arrays, found).collect()}
    assert places["A"].home_lat == pytest.approx(39.9) and places["A"].work_lat == pytest.approx(39.99) and places["B"].work_lat is None and places["C"].home_lat is None
    same = {r.user_id: r for r in stays.place_errors(stays.home_work(arrays, found), stays.home_work(arrays, found)).collect()}
    assert same["A"].home_error_m == 0 and same["A"].home_localised == 1 and same["C"].home_localised is None
    lost = stays.place_errors(stays.home_work(arrays, found), stays.home_work(arrays, found.limit(0))).where("user_id = 'A'").first()
    assert lost.home_error_m is None and lost.home_localised == 0


def test_mechanisms(spark):
    n, eps = 20_000, 1.0
    long = spark.range(n).select(F.lit("t").alias("traj_id"), F.col("id").alias("pos"), F.lit(39.9).alias("lat"), F.lit(116.3).alias("lon"))
    moved = protect.geoind(long, eps, 100.0, 1)
    radius = moved.agg(F.avg(geo.haversine(F.lit(39.9), F.lit(116.3), F.col("lat"), F.col("lon")))).first()[0]
    assert radius == pytest.approx(200, rel=0.03)
    assert protect.geoind_budget(long, eps).first().spent_budget == n
    k = 4
    said = spark.range(n).select(protect.grr(F.lit(2), k, eps, 5, F.col("id")).alias("r")).groupBy("r").count().collect()
    share = {r.r: r["count"] / n for r in said}
    assert share[2] == pytest.approx(math.e / (math.e + k - 1), abs=0.012) and all(share[c] == pytest.approx(1 / (math.e + k - 1), abs=0.012) for c in (0, 1, 3))
    bits = spark.range(n).select(protect.oue(F.lit(1), 6, eps, 5, F.col("id")).alias("b")).select(*[F.avg(F.col("b")[i]) for i in range(6)]).first()
    assert bits[1] == pytest.approx(0.5, abs=0.012) and all(bits[i] == pytest.approx(1 / (math.e + 1), abs=0.012) for i in (0, 2, 3, 4, 5))
    est = spark.range(1).select(protect.grr_estimate(F.lit(share[2] * n), F.lit(n), k, eps)).first()[0]
    assert est == pytest.approx(n, rel=0.04)
    for bad in (0, -1, float("nan")):
        with pytest.raises(ValueError):
            protect.check_epsilon(bad)
    with pytest.raises(ValueError):
        protect.grr_keep(1, 1.0)


def scored(spark, scores, labels):
    return spark.createDataFrame(list(zip(range(len(scores)), map(float, scores), labels)), "id long, score double, label int")


@pytest.mark.parametrize(("scores", "labels", "auc"), [([3, 2, 1, 0], [1, 1, 0, 0], 1), ([0, 1, 2, 3], [1, 1, 0, 0], 0), ([1, 1, 1, 1], [1, 0, 1, 0], 0.5), ([1, 2], [1, 1], 0.5), ([3, 1, 2, 2], [1, 0, 1, 0], 0.875)])
def test_auc(spark, scores, labels, auc):
    assert metrics.roc_auc(scored(spark, scores, labels)).first().auc == auc


def test_tpr(spark):
    s = scored(spark, [5, 4, 4, 3, 2, 1], [1, 1, 0, 1, 0, 0])
    got = {r.fpr_target: r.tpr for r in metrics.tpr_at_fpr(s, (0.0, 0.34, 1.0)).collect()}
    assert got == {0.0: pytest.approx(1 / 3), 0.34: pytest.approx(1.0), 1.0: pytest.approx(1.0)}
    assert all(math.isnan(r.tpr) for r in metrics.tpr_at_fpr(scored(spark, [1, 2], [1, 1])).collect())
    assert [r.avg_rank for r in metrics.average_ranks(scored(spark, [7, 7, 9], [1, 0, 1])).orderBy("id").collect()] == [1.5, 1.5, 3]


def test_divergences(spark):
    counts = spark.createDataFrame([(0, 5, 0), (1, 0, 3)], "cell int, a int, b int")
    assert metrics.js_divergence(counts, "cell", "a", "b").first().jsd == pytest.approx(1)
    assert metrics.js_divergence(counts, "cell", "a", "a").first().jsd == 0
    r = np.random.default_rng(3)
    a, b = r.normal(size=7), r.normal(size=12)
    grid = np.unique(np.concatenate([a, b]))
    area = sum(abs((a <= x).mean() - (b <= x).mean()) * (y - x) for x, y in zip(grid, grid[1:]))
    values = spark.createDataFrame([(float(x), 0) for x in a] + [(float(x), 1) for x in b], "x double, side int")
    assert metrics.w1(values).first().w1 == pytest.approx(area)
    pairs = spark.createDataFrame([(0, 800.0, 1300.0), (1, 1200.0, 1700.0), (2, 2000.0, 2500.0)], "i int, a double, b double")
    got = metrics.paired_length_bootstrap(pairs, 30).first()
    assert (got.value, got.ci_low, got.ci_high) == pytest.approx((500, 500, 500))


def test_bootstrap(spark):
    sample = spark.createDataFrame([(i, float(i % 2)) for i in range(200)], "i int, x double")
    got = metrics.bootstrap_ci(sample, 200).first()
    assert got.mean == 0.5 and 0.40 < got.ci_low < 0.48 and 0.52 < got.ci_high < 0.60
    assert metrics.bootstrap_ci(sample, 0).first() == (0.5, 0.5, 0.5)
    assert all(math.isnan(x) for x in metrics.bootstrap_ci(sample.limit(0), 10).first())


def test_markov(spark):
    corpus = [["1", "2", "3"], ["1", "2", "3", "4"], ["2", "3", "4"], ["1", "2", "3"]]
    seqs = spark.createDataFrame([(f"t{i}", s) for i, s in enumerate(corpus)], "traj_id string, seq array<string>")
    counts = sequences.markov_counts(seqs)
    assert {(r.context, r.symbol): r.n for r in counts.collect()}["2", "3"] == 4
    asked = spark.createDataFrame([("like", ["1", "2", "3"]), ("unlike", ["4", "1", "4"]), ("new", ["9"])], "traj_id string, seq array<string>")
    lp = {r.traj_id: r.log_prob for r in sequences.markov_log_prob(asked, counts).collect()}
    # vocabulary 1, 2, 3, 4 and the end: five symbols; 9 after the start is unseen, the end after 9 uniform
    assert lp["like"] > lp["unlike"] and lp["new"] == pytest.approx(math.log(1 / 9) + math.log(1 / 5))
    made = sequences.markov_generate(counts, 50, 1).collect()
    assert len(made) == 50 and all(len(r.seq) <= 50 and set(r.seq) <= set("1234") for r in made)
    assert sorted(made) == sorted(sequences.markov_generate(counts, 50, 1).repartition(3).collect())


def test_membership(spark):
    seqs = spark.createDataFrame([(f"t{i:02d}", [str(100 * i + j) for j in range(4)]) for i in range(12)], "traj_id string, seq array<string>")
    members = attacks.shadow_members(seqs, 16, 0.5, 2)
    assert {r["count"] for r in members.groupBy("shadow").count().collect()} == {6}
    target = seqs.where("traj_id < 't06'")
    observed = sequences.markov_log_prob(seqs, sequences.markov_counts(target))
    got = attacks.membership_scores(seqs, members, observed).withColumn("label", (F.col("traj_id") < "t06").cast("int")).withColumnRenamed("traj_id", "id")
    assert metrics.roc_auc(got).first().auc >= 0.75
    everywhere = seqs.select("traj_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("shadow"))
    assert {r.score for r in attacks.membership_scores(seqs, everywhere, observed).collect()} == {0.0}


def city(spark, n=6, step=200.0):
    """A grid of two-way streets."""
    nodes = [(i * n + j, 450_000.0 + step * j, 4_420_000.0 + step * i) for i in range(n) for j in range(n)]
    pairs = [(a, b) for i in range(n) for j in range(n) for a, b in (((i * n + j), (i * n + j + 1)), ((i * n + j), ((i + 1) * n + j))) if (b < n * n and (b != a + 1 or j + 1 < n))]
    edges = [(k, u, v, step) for k, (u, v) in enumerate([p for a, b in pairs for p in ((a, b), (b, a))])]
    return spark.createDataFrame(nodes, "node_id long, x double, y double"), spark.createDataFrame(edges, "edge_id long, u long, v long, length_m double")


def test_zones(spark):
    nodes, edges = city(spark)
    zoned = zones.edge_zones(nodes, edges, 3, 3)
    assert {r.zone for r in zoned.collect()} == set(range(9))
    arcs = zones.zone_arcs(zoned)
    assert arcs.where("i = j").isEmpty()
    hops = {(r.src, r.dst): r.hops for r in zones.hops(arcs).collect()}
    assert len(hops) == 81 and hops[0, 0] == 0 and hops[0, 1] == 1 and hops[0, 8] >= 2
    twice = edges.union(spark.createDataFrame([(999, 0, 1, 50.0), (1000, 0, 1, 50.0)], edges.schema))
    assert zones.shortest_edges(twice).where("u = 0 AND v = 1").first().edge_id == 999
    routes = spark.createDataFrame([("t", [0, 1, 0])], "traj_id string, edge_seq array<long>")
    assert zones.zone_sequence(routes, zoned).first().traj_id == "t"
    with pytest.raises(Exception, match="unknown edge"):
        zones.zone_sequence(spark.createDataFrame([("t", [12345])], "traj_id string, edge_seq array<long>"), zoned).collect()


def test_generator(spark):
    nodes, edges = city(spark)
    zoned = zones.edge_zones(nodes, edges, 3, 3).cache()
    arcs = zones.zone_arcs(zoned).orderBy("i", "j")
    numbered = spark.createDataFrame([(k, r.i, r.j) for k, r in enumerate(arcs.collect())], "arc int, i int, j int").cache()
    seqs = spark.createDataFrame([(f"t{i}", [0, 1, 2]) for i in range(400)] + [("one", [4])], "traj_id string, seq array<int>")
    model = zones.estimates(zones.reports(seqs, numbered, 9, 8.0, 24, seed=1), numbered, 401, 9, 8.0).cache()
    sums = {(r.stage): r["sum(p)"] for r in model.where("stage <> 'step'").groupBy("stage").sum("p").collect()}
    assert all(v == pytest.approx(1) for v in sums.values())
    start = {r.category: r.p for r in model.where("stage = 'start'").collect()}
    assert start[0] > 0.7 and len(start) == 9
    asked = spark.createDataFrame([("like", [0, 1, 2]), ("unlike", [8, 7, 6])], "traj_id string, seq array<int>")
    lp = {r.traj_id: r.log_prob for r in zones.log_prob(asked, model, numbered).collect()}
    assert lp["like"] > lp["unlike"]
    made = zones.generate(model, numbered, zoned, zones.hops(arcs), 20, 3).collect()
    ends = {r.edge_id: (r.u, r.v) for r in edges.collect()}
    assert len(made) == 20 and all(ends[a][1] == ends[b][0] for r in made for a, b in zip(r.edge_seq, r.edge_seq[1:]))


def test_zone_walks():
    """Walks keep to arcs, reach their aim while it is in time, stop without arcs, and choose in proportion."""
    arcs = np.zeros((5, 5), bool)
    for a, b in ((0, 1), (1, 2), (2, 3), (3, 0), (0, 2), (3, 4)):  # nothing leaves 4
        arcs[a, b] = True
    hops = np.full((5, 5), np.inf)
    np.fill_diagonal(hops, 0)
    for k in range(1, 6):
        for a, b in zip(*np.nonzero(np.linalg.matrix_power(arcs.astype(int), k))):
            hops[a, b] = min(hops[a, b], k)
    n = 4000
    u = np.random.default_rng(3).random((n, 8))
    only = lambda z: np.eye(5)[z]
    walks = zones.zone_walks(np.full(n, 3), only(0), only(3), arcs, np.where(arcs, 0.5, 0), hops, u)
    assert set(map(tuple, walks.tolist())) == {(0, 1, 2, 3), (0, 2, 3, 0), (0, 2, 3, 4)}  # too late for 3 at the end, any arc will do
    assert abs(np.mean(walks[:, 1] == 1) - 0.5) < 0.05
    assert set(zones.zone_walks(np.arange(n) % 3, only(4), only(0), arcs, np.where(arcs, 1.0, 0), hops, u)[:, 1]) == {-1}
    massless = zones.zone_walks(np.ones(n, int), np.zeros(5), only(0), arcs, np.zeros((5, 5)), hops, u)
    assert np.allclose(np.bincount(massless[:, 0]) / n, 0.2, atol=0.03) and set(massless[massless[:, 0] == 3, 1]) == {0}


def test_matching(spark):
    nodes, edges = city(spark)
    xy = {r.node_id: (r.x, r.y) for r in nodes.collect()}
    ids = {(r.u, r.v): r.edge_id for r in edges.collect()}
    walk = [0, 1, 2, 8, 14, 15, 16]
    r = np.random.default_rng(4)
    pts = [(xy[a][0] + f * (xy[b][0] - xy[a][0]) + r.normal() * 3, xy[a][1] + f * (xy[b][1] - xy[a][1]) + r.normal() * 3) for a, b in zip(walk, walk[1:]) for f in np.arange(0.1, 1.0, 0.2)]
    m = matching.Matcher([(n, *p) for n, p in xy.items()], [(i, u, v, 200.0) for (u, v), i in ids.items()], 50, 20, 8)
    route, points, score, share = m.match(np.array(pts), list(range(len(pts))))
    assert route == [ids[a, b] for a, b in zip(walk, walk[1:])] and share == 1 and score > 0.8
    assert np.mean([p[3] for p in points]) < 10
    off = m.match(np.array([(451_000.0 + 7 * i, 4_500_000.0) for i in range(9)]), list(range(9)))
    assert off == ([], [], 0.0, 0.0)
    p = spark.createDataFrame([("t", i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "traj_id string, pos int, x double, y double")
    near = matching.near_edges(p, nodes, edges, 50).collect()
    for i, q in enumerate(pts):
        want = {e for (u, v), e in ids.items() if _to_segment(q, xy[u], xy[v]) <= 50}
        assert {n.edge_id for n in near if n.pos == i} == want


def _to_segment(p, a, b):
    p, a, b = map(np.array, (p, a, b))
    f = np.clip((p - a) @ (b - a) / ((b - a) @ (b - a)), 0, 1)
    return float(np.hypot(*(p - a - f * (b - a))))


def test_student(spark):
    rows = spark.createDataFrame([("a", 0.4), ("a", 0.5), ("a", 0.6), ("a", float("nan")), ("b", 1.0), ("c", None)], "result_id string, value double")
    got = {r.result_id: r for r in reporting.student(rows, ["result_id"]).collect()}
    half = 4.303 * 0.1 / math.sqrt(3)
    assert got["a"].mean == pytest.approx(0.5) and got["a"].ci_high - got["a"].mean == pytest.approx(half) and got["a"].n_repetitions == 3
    assert (got["b"].ci_low, got["b"].ci_high) == (1, 1) and got["c"].mean is None
    assert [r[0] for r in spark.createDataFrame([(11,), (200,)], "d int").select(reporting.t_975(F.col("d"))).collect()] == [2.228, 1.98]


RESULT = "exp_id string, config_hash string, seed int, family string, scope string, arm_id string, target_ref string, known_points int, metric string, value double, ci_low double, ci_high double, attack_runtime_s double, n_nonmembers int, n_pool int, n_probes int, result_id string"


def result(family, target, k, metric, value, exp="e", seed=1, n=None, h="h"):
    return (exp, h, seed, family, target.split(":")[0], "", target, k, metric, value, None, None, 1.0, n, 5, seed, f"{family}:{target}" + (f":k{k}" if k else ""))


def test_reporting(spark):
    rows = spark.createDataFrame([
        result("reidentification", "raw", 3, "top1_acc", 0.4), result("reidentification", "raw", 10, "top1_acc", 0.6), result("reidentification", "raw", 10, "linkage_rate", 0.1),
        result("membership_inference", "synthetic:markov", None, "auc", 0.9), result("membership_inference", "synthetic:markov", None, "tpr@fpr=0.01", 0.5, n=10),
        result("utility", "protected:none", None, "cell_js_divergence", 0.0), result("own", "raw", None, "b", 1.0), result("own", "raw", None, "a", 2.0),
    ], RESULT)
    matrix = {r.target_ref: r for r in reporting.risk_matrix(rows).collect()}
    assert matrix["raw"]["reidentification"] == 0.6 and matrix["raw"]["own"] == 2.0 and matrix["synthetic:markov"]["membership_inference"] == 0.9 and "protected:none" not in matrix
    assert {r.family: r.value for r in reporting.headline_rows(rows).collect()}["reidentification"] == 0.6
    masked = {r.metric: r for r in reporting.mask_unmeasurable(rows).collect()}
    assert math.isnan(masked["tpr@fpr=0.01"].value) and "cannot" in masked["tpr@fpr=0.01"].warning and masked["auc"].warning is None
    clash = rows.union(spark.createDataFrame([result("reidentification", "raw", 10, "top1_acc", 0.7, exp="f")], RESULT))
    with pytest.raises(Exception, match="conflicting"):
        reporting.risk_matrix(clash).collect()
    seeds = spark.createDataFrame([result("own", "raw", None, "a", v, seed=s) for s, v in ((1, 0.4), (2, 0.6))], RESULT)
    folded = reporting.over_seeds(seeds).first()
    assert folded.value == pytest.approx(0.5) and folded.n_pool == 5 and folded.n_probes is None
    with pytest.raises(Exception, match="twice"):
        reporting.over_seeds(seeds.union(seeds)).collect()
    with pytest.raises(ValueError):
        reporting.union_results([rows, rows.drop("value")])


def test_parsers(spark):
    f = spark.createDataFrame([("reidentification:protected:geo:epsilon=1.0:k5",), ("own:raw",)], "r string")
    got = f.select(*reporting.parse_result_id(F.col("r"))).collect()
    assert [tuple(r) for r in got] == [("reidentification", "protected:geo:epsilon=1.0", 5), ("own", "raw", None)]
    t = spark.createDataFrame([("raw",), ("protected:geo:a=1,b=x",)], "t string")
    assert [tuple(r) for r in t.select(*reporting.parse_target(F.col("t"))).collect()] == [("raw", "", ""), ("protected", "geo", "a=1,b=x")]
    key = t.select(reporting.params_key(reporting.parse_target(F.col("t"))[2]).alias("k")).collect()[1].k
    assert [tuple(x) for x in key] == [("a", 1.0), ("b", math.inf)]
    with pytest.raises(Exception, match="not a target"):
        spark.createDataFrame([("nonsense",)], "t string").select(reporting.parse_target(F.col("t"))[0]).collect()
