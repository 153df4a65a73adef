"""Experiments end to end: pool, arms, attacks, utility, result rows and files."""

from __future__ import annotations

import datetime
import json
import subprocess
import time
from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo, order
from ..operators import attacks, cleaning, metrics, protect, reporting, sequences, splits, stays, zones
from ..sources import adapters, results, trajectories
from . import registry, report
from .config import GENERATORS, MECHANISMS, Arm, ConsistencyError, RunConfig, pipeline_hash, release_hash

COLUMNS = dict(results.COLUMNS)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at path; made and written first where it isn't there as a whole (Spark's _SUCCESS marks that)."""
    results.refuse_raw(path)
    if not _exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def heap_peak_mb(spark: SparkSession) -> float:
    """The largest heap use of the driver's machine since the last call; in local mode that is where the work is."""
    pools = [p for p in spark._jvm.java.lang.management.ManagementFactory.getMemoryPoolMXBeans() if p.getType().toString() == "Heap memory"]
    peak = sum(p.getPeakUsage().getUsed() for p in pools) / 2**20
    for p in pools:
        p.resetPeakUsage()
    return peak


class Experiment:
    """Lazy tables of a run; each is read from the cache if an earlier run made it."""

    def __init__(self, spark: SparkSession, cfg: RunConfig):
        self.spark, self.cfg = spark, cfg
        native = registry.NATIVE_REGION.get(cfg.dataset)
        registry.get("dataset", cfg.dataset), registry.get("matcher", cfg.matcher)
        if cfg.map_region != native:
            raise ConsistencyError(f"the map is of {cfg.map_region}, the dataset of {native}")
        if cfg.native_region and cfg.native_region != native:
            raise ConsistencyError(f"{cfg.dataset} is of {native}, not of {cfg.native_region}")
        self._network = None
        self.snapshot = trajectories.network_hash(*self.network())  # a map built anew makes a pool of its own
        self.hash = pipeline_hash(cfg, self.snapshot)
        self.base = f"{cfg.cache_dir}/{self.hash}"

    def network(self) -> tuple[DataFrame, DataFrame]:
        if self._network is None:
            self._network = tuple(t.cache() for t in trajectories.read_network(self.spark, f"{self.cfg.map_dir}/{self.cfg.map_region}"))
        return self._network

    def clean(self) -> DataFrame:
        """Clean trajectories of the sampled users, with their splits."""
        cfg = self.cfg

        def make() -> DataFrame:
            raw = registry.get("dataset", cfg.dataset)(self.spark, cfg.dataset_path)
            kept = cleaning.clean(raw.select("traj_id", "user_id", "points"), cfg.cleaning)
            if cfg.max_users is not None:
                kept = splits.subsample_users(kept, cfg.max_users, cfg.split_seed)
            return splits.split_by_user(kept, cfg.fractions, cfg.split_seed)

        return cached(self.spark, f"{self.base}/clean", make)

    def _match(self, arrays: DataFrame, path: str) -> DataFrame:
        every = cached(self.spark, path, lambda: registry.get("matcher", self.cfg.matcher)(arrays, *self.network(), self.cfg.utm_zone, **self.cfg.matching))
        return every

    def matched(self) -> DataFrame:
        """Those of the clean trajectories that match well enough, with their splits."""
        every = self._match(self.clean(), f"{self.base}/matched")
        return every.where(F.col("match_score") >= self.cfg.min_match_score).join(self.clean().select("traj_id", "split"), "traj_id")

    def release(self, arm: Arm) -> DataFrame:
        """What a mechanism publishes of the matched pool's trajectories, as arrays."""
        pool = self.clean().join(self.matched().select("traj_id"), "traj_id", "left_semi").select("traj_id", "user_id", "points")
        if arm.name == "none":
            return pool
        noisy = lambda: adapters.as_arrays(protect.geoind(adapters.as_long(pool), arm.get("epsilon", MECHANISMS), arm.get("unit_m", MECHANISMS), self.cfg.seed))
        return cached(self.spark, f"{self.base}/release-{release_hash(self.cfg, arm, self.snapshot)}", noisy)

    def rematched(self, arm: Arm) -> DataFrame:
        """The release on the network again; the identity arm is the pool itself."""
        if arm.name == "none":
            return self.matched()
        every = self._match(self.release(arm), f"{self.base}/rematched-{release_hash(self.cfg, arm, self.snapshot)}")
        return every.where(F.col("match_score") >= self.cfg.min_match_score)

    def rematch_dropped(self, arm: Arm | None) -> int | None:
        """Trajectories of a release that don't match well enough; none are counted without a release."""
        return None if arm is None else self.release(arm).count() - self.rematched(arm).count()

    def paths(self, arrays: DataFrame) -> DataFrame:
        def xy(p):
            x, y = geo.utm(p["lon"], p["lat"], self.cfg.utm_zone)
            return F.struct(x.alias("x"), y.alias("y"))

        return arrays.select("traj_id", "user_id", F.transform("points", xy).alias("path"))

    # -- result rows ----------------------------------------------------------------------

    def rows(self, values: DataFrame, family: str, scope: str, arm: Arm | None, began: float, **more) -> DataFrame:
        """metric, value, ci_low, ci_high as rows of the results table."""
        ref = "raw" if scope == "raw" else f"{scope}:{arm.ref}"
        level = more.get("known_points")
        fixed = {"family": family, "scope": scope, "arm_id": "" if arm is None else arm.name, "target_ref": ref, "result_id": f"{family}:{ref}" + (f":k{level}" if level else ""), "n_bootstrap": self.cfg.bootstrap}
        if arm is not None:
            fixed |= {k: dict(arm.params)[k] for k in ("epsilon", "unit_m") if k in dict(arm.params)}
            if arm.name == "geo_indistinguishability":
                fixed.setdefault("unit_m", MECHANISMS[arm.name]["unit_m"])
        fixed |= more
        made = values.collect()  # a handful of metrics; the attack runs here
        fixed["attack_runtime_s"] = time.perf_counter() - began
        fixed["peak_memory_mb"] = heap_peak_mb(self.spark)
        kinds = {"int": int, "double": float, "string": str}
        told = [tuple(None if x is None else kinds[t](x) for x, t in ((r[n] if n in r else fixed.get(n), t) for n, t in COLUMNS.items())) for r in made]
        return self.spark.createDataFrame(told, results.SCHEMA)

    def _means(self, frame: DataFrame, columns: dict[str, str], key: str) -> DataFrame:
        """Means with bootstrap intervals of columns; null values don't count."""
        out = []
        for column, name in columns.items():
            sample = metrics.indexed(frame.where(F.col(column).isNotNull()), key, F.col(column).cast("double")).cache()
            ci = metrics.bootstrap_ci(sample, self.cfg.bootstrap, self.cfg.ci, self.cfg.seed, name)
            out.append(ci.select(F.lit(name).alias("metric"), F.col("mean").alias("value"), "ci_low", "ci_high"))
        return reduce(DataFrame.unionByName, out)

    def reidentification(self, plan) -> list[DataFrame]:
        out = []
        probes = self.matched_paths(self.matched())
        arms = [(None, "raw")] * ("raw" in plan.scopes) + [(a, "protected") for a in self.cfg.mechanisms] * ("protected" in plan.scopes)
        for arm, scope in arms:
            gallery = probes if arm is None else self.matched_paths(self.rematched(arm))
            for k in plan.options["known_points"]:
                began = time.perf_counter()
                ranking = attacks.dtw_ranking(gallery, probes, k).cache()
                several = probes.withColumn("n", F.count("*").over(Window.partitionBy("user_id"))).where("n >= 2")
                columns = {"top1_acc": 1, "topk_acc": self.cfg.top_k, "linkage_rate": 1}
                hits = reduce(lambda a, b: a.join(b, "probe_id"), [attacks.top_k(ranking, several, columns[m]).withColumnRenamed("hit", m) for m in self.cfg.metrics]).cache()
                values = self._means(hits, {m: m for m in self.cfg.metrics}, "probe_id")
                out.append(self.rows(values, "reidentification", scope, arm, began, known_points=int(k), n_probes=hits.count(), n_pool=gallery.count(), n_gallery_users=gallery.select("user_id").distinct().count(), n_rematch_dropped=self.rematch_dropped(arm)))
        return out

    def matched_paths(self, matched: DataFrame) -> DataFrame:
        return matched.select("traj_id", "user_id", F.transform("matched_points", lambda p: F.struct(p["x"], p["y"])).alias("path"))

    def reconstruction(self, plan) -> list[DataFrame]:
        out = []
        for arm in self.cfg.mechanisms:
            if arm.name != "geo_indistinguishability":
                continue
            began = time.perf_counter()
            made = attacks.reconstruct(self.paths(self.release(arm)), arm.get("epsilon", MECHANISMS), arm.get("unit_m", MECHANISMS), plan.options["motion_m"])
            truth = self.paths(self.release(Arm("none"))).select("traj_id", F.col("path").alias("truth"))
            both = made.join(truth, "traj_id")
            e, t = F.col("estimate"), F.col("truth")
            scored = both.select("traj_id", geo.hausdorff(e, t).alias("mean_hausdorff_m"), attacks.path_dtw(e, t).alias("mean_dtw_m"), geo.mean_spatial_error(e, t).alias("mean_spatial_error_m")).cache()
            out.append(self.rows(self._means(scored, {c: c for c in scored.columns[1:]}, "traj_id"), "reconstruction", "protected", arm, began, n_pool=scored.count()))
        return out

    def poi_inference(self, plan) -> list[DataFrame]:
        o, out = plan.options, []

        def places(arrays: DataFrame) -> DataFrame:
            found = stays.stay_points(arrays, float(o["radius_m"]), float(o["dwell_s"]))
            return stays.home_work(arrays, found, tuple(o["home_hours"]), tuple(o["work_hours"]), float(o["tz_offset_h"]))

        truth = places(self.release(Arm("none"))).cache()
        for arm in self.cfg.mechanisms:
            began = time.perf_counter()
            errors = stays.place_errors(truth, places(self.release(arm)), float(o["threshold_m"])).cache()
            values = self._means(errors, {c: c for c in errors.columns[1:]}, "user_id")
            spent = None if arm.name == "none" else self.release(arm).agg(F.sum(F.size("points"))).first()[0] * arm.get("epsilon", MECHANISMS)
            out.append(self.rows(values, "poi_inference", "protected", arm, began, spent_budget=spent, n_pool=errors.count()))
        return out

    def membership_inference(self, plan) -> list[DataFrame]:
        """Members are train trajectories, others test ones; shadows draw from shadow, train and test together."""
        o, out = plan.options, []
        pool = self.matched().where("split IN ('shadow', 'train', 'test')").select("traj_id", "split", "edge_seq").cache()
        counts = {r["split"]: r["count"] for r in pool.groupBy("split").count().collect()}
        if not counts.get("train") or not counts.get("test"):
            raise ValueError("membership inference needs matched train and test trajectories")
        for arm in self.cfg.generators:
            began = time.perf_counter()
            score = self._markov_scores if arm.name == "markov" else self._zone_scores
            scored = score(arm, pool, int(o["n_shadow"]), float(o["subsample"])).join(pool.where("split <> 'shadow'"), "traj_id")
            labelled = scored.select("traj_id", "score", F.when(F.col("split") == "train", 1).otherwise(0).alias("label")).cache()
            rates = metrics.tpr_at_fpr(labelled, tuple(o["fprs"])).select(F.concat(F.lit("tpr@fpr="), F.col("fpr_target").cast("string")).alias("metric"), F.col("tpr").alias("value"))
            values = metrics.roc_auc(labelled).select(F.lit("auc").alias("metric"), F.col("auc").alias("value")).unionByName(rates)
            out.append(self.rows(values, "membership_inference", "synthetic", arm, began, n_shadow=int(o["n_shadow"]), n_members=counts["train"], n_nonmembers=counts["test"], n_bootstrap=None))
        return out

    def _markov_scores(self, arm: Arm, pool: DataFrame, shadows: int, subsample: float) -> DataFrame:
        order, alpha = arm.get("order", GENERATORS), float(arm.get("alpha", GENERATORS))
        seqs = pool.select("traj_id", "split", F.transform("edge_seq", lambda e: e.cast("string")).alias("seq"))
        observed = sequences.markov_log_prob(seqs, sequences.markov_counts(seqs.where("split = 'train'"), order), order, alpha)
        return attacks.membership_scores(seqs, attacks.shadow_members(seqs, shadows, subsample, self.cfg.seed), observed, order, alpha)

    def zones(self, arm: Arm) -> tuple[DataFrame, DataFrame, int]:
        zoned = zones.edge_zones(*self.network(), arm.get("n_rows", GENERATORS), arm.get("n_cols", GENERATORS)).cache()
        arcs = zones.zone_arcs(zoned).select((F.row_number().over(Window.orderBy("i", "j")) - 1).alias("arc"), "i", "j").cache()
        if arcs.isEmpty():
            raise ValueError("the network is a single zone: more rows or columns are needed")
        return zoned, arcs, zoned.agg(F.count_distinct("zone")).first()[0]

    def zone_model(self, arm: Arm, seqs: DataFrame, arcs: DataFrame, n_zones: int, seed: int) -> DataFrame:
        n = seqs.count()
        if not n:
            raise ValueError("there is no trajectory to fit on")
        epsilon, l_max, split = float(arm.get("epsilon", GENERATORS)), arm.get("l_max", GENERATORS), arm.get("budget_split", GENERATORS)
        return zones.estimates(zones.reports(seqs, arcs, n_zones, epsilon, l_max, split, seed).cache(), arcs, n, n_zones, epsilon, l_max, split)

    def _zone_scores(self, arm: Arm, pool: DataFrame, shadows: int, subsample: float) -> DataFrame:
        zoned, arcs, n_zones = self.zones(arm)
        l_max = arm.get("l_max", GENERATORS)
        seqs = zones.zone_sequence(pool, zoned).join(pool.select("traj_id", "split"), "traj_id").cache()
        members = attacks.shadow_members(seqs, shadows, subsample, self.cfg.seed).cache()
        observed = zones.log_prob(seqs, self.zone_model(arm, seqs.where("split = 'train'"), arcs, n_zones, self.cfg.seed), arcs, l_max)
        asked = []
        for s in range(shadows):  # a shadow is a fit of its own reports; a dozen or two of them
            own = seqs.join(members.where(F.col("shadow") == s), "traj_id", "left_semi")
            asked.append(zones.log_prob(seqs, self.zone_model(arm, own, arcs, n_zones, self.cfg.seed + 1000 + s), arcs, l_max).select("traj_id", F.lit(s).alias("shadow"), F.col("log_prob").alias("lp")))
        return attacks.likelihood_ratios(reduce(DataFrame.unionByName, asked), members, observed)

    def utility(self) -> list[DataFrame]:
        """Raw against release, of the whole release, also where it no longer matches."""
        cfg, out = self.cfg, []
        grid = geo.Grid(*cfg.map_bbox, *cfg.utility_grid)
        raw = self.release(Arm("none"))
        cell = lambda arrays: arrays.select(F.explode("points").alias("p")).groupBy(grid.cell(F.col("p.lat"), F.col("p.lon")).alias("cell")).count()
        for arm in cfg.mechanisms:
            noisy, parts = self.release(arm), []
            if "cell_js_divergence" in cfg.utility:
                both = cell(raw).withColumnRenamed("count", "a").join(cell(noisy).withColumnRenamed("count", "b"), "cell", "full").fillna(0, ["a", "b"])
                parts.append(metrics.js_divergence(both, "cell", "a", "b").select(F.lit("cell_js_divergence").alias("metric"), F.col("jsd").alias("value"), F.lit(None).cast("double").alias("ci_low"), F.lit(None).cast("double").alias("ci_high")))
            if "length_dist_error" in cfg.utility:
                lengths = cleaning.geometry(raw).select("traj_id", F.col("length_m").alias("a")).join(cleaning.geometry(noisy).select("traj_id", F.col("length_m").alias("b")), "traj_id")
                pairs = order.numbered(lengths, "traj_id").select("i", "a", "b").cache()
                parts.append(metrics.paired_length_bootstrap(pairs, cfg.bootstrap, cfg.ci, cfg.seed).select(F.lit("length_dist_error").alias("metric"), "value", "ci_low", "ci_high"))
            if parts:
                out.append(self.rows(reduce(DataFrame.unionByName, parts), "utility", "protected", arm, time.perf_counter()))
        return out

    def all_rows(self) -> DataFrame:
        parts = [r for plan in self.cfg.attacks for r in getattr(self, plan.family)(plan)] + self.utility()
        return reduce(DataFrame.unionByName, parts)


def git_commit() -> str:
    done = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True)
    return done.stdout.strip() if not done.returncode else ""


def run(spark: SparkSession, cfg: RunConfig) -> DataFrame:
    """Run a configuration; writes results.csv, metrics.csv, matrix.csv, run.json and the plots asked for to its folder, and returns the rows."""
    began = time.perf_counter()
    e = Experiment(spark, cfg)
    provenance = {"exp_id": cfg.exp_id, "config_hash": e.hash, "git_commit": git_commit(), "seed": cfg.seed, "split_seed": cfg.split_seed, "max_users": cfg.max_users, "created_at": datetime.datetime.now(datetime.UTC).isoformat()}
    rows = e.all_rows().withColumns({k: F.lit(v).cast(COLUMNS[k]) for k, v in provenance.items()}).cache()
    seconds = time.perf_counter() - began
    masked = reporting.mask_unmeasurable(rows.withColumn("run_runtime_s", F.lit(seconds)))
    warnings = [r[0] for r in masked.where("warning IS NOT NULL").select("warning").distinct().orderBy("warning").collect()]
    rows = masked.drop("warning")
    out = cfg.output_dir
    results.write_results(rows, f"{out}/results.csv")
    finite = rows.withColumns({c: results.finite(c) for c in ("value", "ci_low", "ci_high")})
    one = lambda df, name: df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{out}/{name}")
    one(finite.select("result_id", "metric", "value", "ci_low", "ci_high", "n_bootstrap"), "metrics.csv")
    one(reporting.risk_matrix(finite), "matrix.csv")
    report.write_plots(rows, cfg.plots, out)
    matched, clean = e.matched(), e.clean()
    record = provenance | {
        "n_matched": matched.count(), "n_dropped": clean.count() - matched.count(),
        "split_counts": {r["split"]: r["count"] for r in matched.groupBy("split").count().collect()},
        "over_budget": [r.asDict() for r in reporting.over_budget(rows, cfg.budget_s).collect()],
        "warnings": warnings,
        "runtime_s": seconds,
        "metrics": [{k: str(v) for k, v in r.asDict().items() if v is not None} for r in finite.select("result_id", "metric", "value", "ci_low", "ci_high").collect()],
    }
    spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/run.json")
    return rows


def repeat(spark: SparkSession, cfg: RunConfig, seeds: Sequence[int]) -> DataFrame:
    """One run for each of two or more different seeds, over the same pool, and t-intervals over them."""
    if len(set(seeds)) < 2 or len(set(seeds)) < len(seeds):
        raise ValueError("two different seeds at least are needed")
    rows = [run(spark, replace(cfg, seed=s, output_dir=f"{cfg.output_dir}/seed{s}")) for s in seeds]
    summary = reporting.student(reporting.union_results(rows), ["result_id", "metric"])
    summary.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{cfg.output_dir}/repetitions.csv")
    return summary
