"""Sources, configuration, whole experiments and reports, on files made here."""

import copy
import glob
import json
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.test_operators import city
from tracefold.plans import catalogue, config, evidence, experiment, registry, report
from tracefold.sources import results, trajectories

SMALL = "/root/testdata/sf0.001"


def inverse(x, y):
    """Degrees of grid metres near the tests' city (39.93 N, 116.41 E), good to a metre there."""
    lat = 39.92888 + (y - 4_420_000) / 111_033
    return lat, 116.41493 + (x - 450_000) / (111_320 * math.cos(math.radians(lat)))


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """A city's network and PLT files of users who drive its streets."""
    root = tmp_path_factory.mktemp("world")
    nodes, edges = city(spark, 6)
    folder = root / "maps/beijing"
    trajectories.write_network(nodes, edges, str(folder))
    (folder / "meta.json").write_text("{}")
    r = np.random.default_rng(1)
    for user in range(10):
        for trip in range(3):
            at, line, t = (user % 6, 0), [], 0
            for _ in range(18):
                step = (0, 1) if at[1] < 5 and (r.random() < 0.6 or at[0] in (0, 5)) else (1 if at[0] < 5 else -1, 0)
                for f in np.arange(0, 1, 0.25):
                    x, y = 450_000 + 200 * (at[1] + f * step[1]), 4_420_000 + 200 * (at[0] + f * step[0])
                    lat, lon = inverse(x + r.normal() * 2, y + r.normal() * 2)
                    line.append(f"{lat:.7f},{lon:.7f},0,100,39744.1,2008-10-2{trip + 3},{2 + t // 3600:02d}:{t // 60 % 60:02d}:{t % 60:02d}")
                    t += 6
                at = (at[0] + step[0], at[1] + step[1])
                if at[1] == 5:
                    at = (at[0], 5)
                    if at[0] in (0, 5):
                        break
            path = root / f"raw/Data/{user:03d}/Trajectory/2008102{trip + 3}020000.plt"
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text("\r\n".join(["head"] * 6 + line + ["broken,line", "x,y,0,1,2,2008-01-01,00:00:00"]) + "\r\n")
    empty = root / "raw/Data/000/Trajectory/20090101000000.plt"
    empty.write_text("head\n" * 6)
    return root


def raw_config(root):
    return {
        "experiment": {"id": "x", "seed": 1, "output_dir": f"{root}/out/x", "cache_dir": f"{root}/cache"},
        "map": {"source": "osm", "region": "beijing", "bbox": [116.40, 39.92, 116.44, 39.95], "crs": "EPSG:32650", "dir": f"{root}/maps"},
        "dataset": {"id": "geolife", "path": f"{root}/raw", "native_region": "beijing"},
        "cleaning": {"max_speed_kmh": 200, "min_points": 8, "min_length_m": 300, "resample_s": 5},
        "map_matching": {"matcher": "leuven", "min_match_score": 0.05},
        "split": {"scheme": "by_user", "fractions": {"train": 0.4, "test": 0.4, "shadow": 0.2}},
        "privacy_mechanisms": [{"id": "none"}, {"id": "geo_indistinguishability", "params": {"epsilon": [10]}}],
        "synthetic_generators": [{"id": "markov"}, {"id": "rn_ldp_synth", "params": {"n_rows": 3, "n_cols": 3}}],
        "attacks": [
            {"type": "reidentification", "attacker": {"known_points": [3]}, "target_scope": ["raw", "protected"]},
            {"type": "reconstruction", "target_scope": ["protected"]},
            {"type": "poi_inference", "target_scope": ["protected"], "attacker": {"dwell_s": 20, "radius_m": 100}},
            {"type": "membership_inference", "target_scope": ["synthetic"], "attacker": {"n_shadow": 2}},
        ],
        "metrics": {"privacy": ["top1_acc", "topk_acc", "linkage_rate"], "utility": ["cell_js_divergence", "length_dist_error"], "bootstrap": {"n": 20}},
        "reporting": {"plots": ["tradeoff", "by_epsilon", "by_knowledge"]},
    }


def test_plt(spark, world):
    got = trajectories.read_plt(spark, str(world / "raw"))
    rows = {r.traj_id: r for r in got.collect()}
    assert len(rows) == 30 and "geolife/000/20090101000000" not in rows
    one = rows["geolife/003/20081023020000"]
    assert one.user_id == "003" and one.start_t == 1224727200.0 and one.points[1].t == one.start_t + 6 and one.n_points == len(one.points)


def test_graphml(spark, tmp_path):
    keys = "".join(f'<key id="d{i}" for="{f}" attr.name="{n}" attr.type="string"/>' for i, (f, n) in enumerate([("node", "y"), ("node", "x"), ("node", "lon"), ("node", "lat"), ("edge", "length"), ("edge", "oneway")]))
    nodes = "".join(f'<node id="{k}"><data key="d0">{k}.5</data><data key="d1">2</data><data key="d2">116.3</data><data key="d3">39.9</data></node>' for k in (7, 8))
    edges = '<edge source="8" target="7" id="0"><data key="d4">12.5</data><data key="d5">True</data></edge><edge source="7" target="8" id="1"><data key="d4">13</data></edge>'
    (tmp_path / "graph.graphml").write_text(f'<?xml version="1.0" encoding="utf-8"?><graphml>{keys}<graph edgedefault="directed">{nodes}{edges}</graph></graphml>')
    with pytest.raises(FileNotFoundError):
        trajectories.read_network(spark, str(tmp_path))
    (tmp_path / "meta.json").write_text("{}")
    n, e = trajectories.read_network(spark, str(tmp_path))
    assert sorted((r.node_id, r.x, r.y, r.lon) for r in n.collect()) == [(7, 2.0, 7.5, 116.3), (8, 2.0, 8.5, 116.3)]
    assert [(r.edge_id, r.u, r.v, r.key, r.length_m, r.oneway) for r in e.orderBy("edge_id").collect()] == [(0, 8, 7, 0, 12.5, True), (1, 7, 8, 1, 13.0, False)]
    meta = trajectories.build_network(spark, str(tmp_path / "graph.graphml"), str(tmp_path / "maps/here"), "here")
    built = trajectories.read_network(spark, str(tmp_path / "maps/here"))
    assert (meta["n_nodes"], meta["n_edges"]) == (2, 2) == tuple(t.count() for t in built) and (tmp_path / "maps/here/graph.graphml").exists()
    assert meta["network_hash"] == trajectories.network_hash(n.repartition(3), e.select(*reversed(e.columns))) == json.loads((tmp_path / "maps/here/meta.json").read_text())["network_hash"]
    assert meta["network_hash"] != trajectories.network_hash(n, e.where("u = 8"))
    outside = trajectories.build_network(spark, str(tmp_path / "graph.graphml"), str(tmp_path / "maps/there"), "there", (0.0, 0.0, 1.0, 1.0))
    assert (outside["n_nodes"], outside["n_edges"]) == (0, 0)


def test_experiment(spark, world):
    cfg = config.parse(raw_config(world))
    rows = {(r.result_id, r.metric): r for r in experiment.run(spark, cfg).collect()}
    raw, same = rows["reidentification:raw:k3", "top1_acc"], rows["reidentification:protected:none:k3", "top1_acc"]
    assert raw.value == same.value and raw.ci_low <= raw.value <= raw.ci_high and raw.n_probes > 0
    assert rows["poi_inference:protected:none", "home_error_m"].value in (0, None) or math.isnan(rows["poi_inference:protected:none", "home_error_m"].value)
    assert rows["utility:protected:none", "cell_js_divergence"].value == 0
    assert 0 <= rows["membership_inference:synthetic:markov", "auc"].value <= 1
    assert "reconstruction:protected:geo_indistinguishability:epsilon=10.0" in {k for k, _ in rows}
    assert all(r.peak_memory_mb > 0 for r in rows.values())
    assert same.n_rematch_dropped == 0 and raw.n_rematch_dropped is None
    files = glob.glob(f"{world}/out/x/results.csv/*.csv")
    again = results.read_results(spark, files)
    assert again.count() == len(rows) and set(again.columns) >= set(results.NAMES)
    record = json.loads(open(glob.glob(f"{world}/out/x/run.json/part*")[0]).read())
    assert record["n_matched"] > 0 and record["exp_id"] == "x" and record["warnings"]
    page = report.generate(spark, f"{world}/out", f"{world}/report")
    text = "\n".join(r[0] for r in spark.read.text(page, wholetext=True).collect())
    assert "# Risk report" in text and "reidentification" in text and "non-members" in text
    assert "## Risk against utility" in text and "| experiment | seeds |" in text and "plots/mechanisms_reidentification.svg" in text
    asked = {p.rsplit("/", 1)[1] for p in glob.glob(f"{world}/out/x/plots/*.svg")}
    assert "tradeoff_reidentification.svg" in asked and "by_epsilon_reidentification.svg" in asked and not any(p.startswith(("runtime", "mechanisms")) for p in asked)
    loaded = report.load(spark, f"{world}/out")
    points = {r.target_ref: r for r in report.tradeoff_points(loaded, "reidentification").collect()}
    assert points["raw"].x == 0 and points["protected:none"].x == 0
    assert report.epsilon_points(loaded).count() and report.knowledge_points(loaded).count() and report.runtime_bars(loaded).count()


def test_evidence(spark):
    nodes, edges = city(spark, 5)
    routes = evidence.seed_population(spark, edges, 8, 3, 1).collect()
    ends = {r.edge_id: (r.u, r.v) for r in edges.collect()}
    assert len(routes) == 8 and all(len(r.edge_seq) >= 3 and all(ends[a][1] == ends[b][0] for a, b in zip(r.edge_seq, r.edge_seq[1:])) for r in routes)
    with pytest.raises(ValueError):
        evidence.seed_population(spark, edges, 3, 99, 1, tries=2)
    rows = evidence.evidence(spark, nodes, edges, [8.0], shadows=4, population=8, min_edges=3, grid=3, rounds=50)
    by = {r.arm: r for r in rows.collect()}
    assert set(by) == {"rn_ldp_synth", "markov"} and all(0 <= r.auc <= 1 and 0 <= r.jsd <= 1 and 0 <= r.jsd_low <= r.jsd_high <= 1 and 0 <= r.length_low <= r.length_high for r in by.values())
    assert evidence.evidence_table(rows).count("|") == 24


def test_hashes(world):
    raw = raw_config(world)
    a = config.parse(raw)
    raw2 = copy.deepcopy(raw)
    raw2["experiment"] |= {"seed": 2, "split_seed": 1}
    b = config.parse(raw2)
    assert config.pipeline_hash(a) == config.pipeline_hash(b) and config.release_hash(a, a.mechanisms[1]) != config.release_hash(b, b.mechanisms[1])
    assert config.pipeline_hash(a, "one map") != config.pipeline_hash(a, "another")
    assert [m.ref for m in a.mechanisms] == ["none", "geo_indistinguishability:epsilon=10.0"]


def change(path, value):
    def apply(raw):
        at = raw
        for k in path[:-1]:
            at = at[k]
        at[path[-1]] = value
    return apply


@pytest.mark.parametrize("spoil", [
    change(["split", "fractions"], {"train": 0.5}), change(["split", "scheme"], "by_trip"), change(["split", "fractions"], {"train": 0.5, "rest": 0.5}),
    change(["map", "bbox"], [1, 2, 3]), change(["map", "crs"], "EPSG:4326"), change(["reporting", "export"], ["xlsx"]), change(["reporting", "plots"], ["pie"]),
    change(["metrics", "utility"], []), change(["metrics", "privacy"], ["f1"]), change(["metrics", "attack_time_budget_s"], 0), change(["dataset", "max_users"], 0),
    change(["attacks"], []), change(["attacks", 0, "attacker"], {"known_points": []}), change(["attacks", 0, "attacker"], {"known_points": [3], "distance": "edr"}),
    change(["attacks", 1, "target_scope"], ["raw"]), change(["attacks", 1, "attacker"], {"known_points": [3]}), change(["attacks", 2, "threshold_m"], 0), change(["attacks", 2, "attacker"], {"home_hours": [1]}),
    change(["attacks", 3, "attacker"], {"n_shadow": 1}), change(["attacks", 3, "fprs"], [2]), change(["synthetic_generators"], []), change(["privacy_mechanisms"], []),
    change(["privacy_mechanisms", 1, "params"], {"epsilon": -1}), change(["privacy_mechanisms", 1, "params"], {"epsilon": 1, "sigma": 2}), change(["experiment", "output_dir"], "data/raw/x"), lambda raw: raw.pop("cleaning"),
])
def test_bad_configurations_fail_before_any_job(world, spoil):
    raw = raw_config(world)
    spoil(raw)
    with pytest.raises(ValueError):
        config.parse(raw)


def test_names_and_regions(spark, world):
    raw = raw_config(world)
    raw["map"]["region"] = "paris"
    with pytest.raises(config.ConsistencyError):
        experiment.Experiment(spark, config.parse(raw))
    for kind, name in (("attack", "nothing"), ("dataset", "nothing")):
        with pytest.raises(KeyError):
            registry.get(kind, name)
    with pytest.raises(ValueError):
        registry.register("attack", "reidentification")(print)
    with pytest.raises(ValueError):
        registry.register("spell", "x")
    with pytest.raises(ValueError):
        experiment.repeat(spark, config.parse(raw_config(world)), [1])


def test_results_header(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        results.read_results(spark, [str(tmp_path / "bad.csv")])
    with pytest.raises(FileNotFoundError):
        report.discover(spark, str(tmp_path))


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("nation", "customer", "orders", "lineitem", "events", "documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def same(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)):
        return a == pytest.approx(float(b), rel=1e-6, abs=2e-3) or (math.isnan(a) and b is None)
    return a == b


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_sql(spark, con, name):
    """Every query and its SQL on the smallest tables."""
    found = catalogue.QUERIES[name](spark, SMALL)
    told = con.execute(catalogue.SQL[name])
    columns = [c[0] for c in told.description]
    assert sorted(found.columns) == sorted(columns)
    key = lambda row: tuple(str(round(x, 1)) if isinstance(x, float) else str(x) for x in row)
    ours, theirs = sorted((tuple(r) for r in found.select(*columns).collect()), key=key), sorted(told.fetchall(), key=key)
    assert len(ours) == len(theirs) and all(same(x, y) for a, b in zip(ours, theirs) for x, y in zip(a, b))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_rows_only(spark, name):
    assert catalogue.QUERIES[name](spark, SMALL).count() > 0


def test_partitioning_does_not_matter(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for name in ("geoind_release", "rnldp_reports", "lira_scores", "bootstrap_ci"):
            seen = []
            for n in ("1", "8"):
                spark.conf.set("spark.sql.shuffle.partitions", n)
                seen.append(sorted(map(str, catalogue.QUERIES[name](spark, SMALL).collect())))
            assert seen[0] == seen[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
