"""Reports over results folders: merged tables, risk matrix, plot points and a Markdown page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reporting
from ..sources import results
from . import plots
from .config import PLOTS
from .plots import cell

LONG = ("exp_id", "config_hash", "seed", "family", "target_ref", "known_points", "metric", "value", "ci_low", "ci_high", "n_bootstrap")


def discover(spark: SparkSession, folder: str) -> list[str]:
    """Results files of a folder: <exp>/results.csv or <exp>/seed*/results.csv, not both; none at all is an error."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(conf)
    listed = lambda pattern: [s.getPath().toString() for s in (fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")) or [])]
    flat, seeded = listed("*/results.csv"), listed("*/seed*/results.csv")
    both = {p.rsplit("/", 2)[0] + "/" + p.rsplit("/", 2)[1] for p in flat} & {p.rsplit("/", 2)[0] for p in seeded}
    if both:
        raise ValueError(f"{sorted(both)} have a run of their own and runs by seed")
    if not flat + seeded:
        raise FileNotFoundError(f"{folder} has no results")
    return sorted(flat + seeded)


def load(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of a folder; seeds of one pipeline are folded, unmeasurable rates masked."""
    rows = results.read_results(spark, discover(spark, folder))
    many = rows.groupBy("exp_id").agg(F.count_distinct("seed").alias("seeds"), F.count_distinct("config_hash").alias("pipelines"))
    if bad := many.where("seeds > 1 AND pipelines > 1").select("exp_id").first():
        raise ValueError(f"{bad[0]} has seeds of different pipelines")
    stats = [n for n, _ in results.COLUMNS if n.startswith("n_") or n in ("family", "scope", "arm_id", "target_ref", "epsilon", "unit_m", "known_points", "spent_budget", "split_seed", "max_users")]
    seeded = rows.join(many.where("seeds > 1").select("exp_id"), "exp_id", "left_semi")
    single = rows.join(many.where("seeds > 1").select("exp_id"), "exp_id", "left_anti")
    folded = reporting.over_seeds(seeded, stats).drop("n_repetitions")
    return reporting.mask_unmeasurable(single.unionByName(folded, allowMissingColumns=True), also_undefined=True)


def merge(spark: SparkSession, folder: str, out: str) -> DataFrame:
    """results_master.csv: all results files one after the other."""
    every = results.read_results(spark, discover(spark, folder)).drop("metric_id")
    results.write_results(every, f"{out}/results_master.csv")
    return every


def export(rows: DataFrame, out: str, formats: Sequence[str] = ("csv", "parquet")) -> list[str]:
    """metrics_long in each format."""
    results.refuse_raw(out)
    made = []
    tidy = rows.select(*LONG).withColumns({c: results.finite(c) for c in ("value", "ci_low", "ci_high")})
    for f in formats:
        if f not in ("csv", "parquet"):
            raise ValueError(f"no such format: {f}")
        getattr(tidy.coalesce(1).write.mode("overwrite").option("header", True), f)(path := f"{out}/metrics_long.{f}")
        made.append(path)
    return made


def tradeoffs(rows: DataFrame) -> DataFrame:
    """(family, metric, share, target_ref, x, y): the trade-off points of every attack family."""
    heads = reporting.headline_rows(rows.where("family <> 'utility'")).select("family", "metric", "target_ref", "scope", F.col("value").alias("y"))
    x = rows.where("family = 'utility' AND metric = 'cell_js_divergence'").groupBy("target_ref").agg(F.min_by("value", "exp_id").alias("jsd"))
    x_ = F.when(F.col("scope") == "raw", 0.0).otherwise(F.coalesce("jsd", F.lit(float("nan"))))
    return heads.join(x, "target_ref", "left").select("family", "metric", reporting.is_share(F.col("metric")).alias("share"), "target_ref", x_.alias("x"), "y")


def tradeoff_points(rows: DataFrame, family: str) -> DataFrame:
    """(target_ref, x, y): the arm's cell divergence (0 for raw) against the family's headline."""
    return tradeoffs(rows).where(F.col("family") == family).select("target_ref", "x", "y")


def epsilon_points(rows: DataFrame) -> DataFrame:
    """Headlines by epsilon for each arm, unit and level."""
    return rows.join(F.broadcast(reporting.headline_metrics(rows)), ["family", "metric"]).where("epsilon IS NOT NULL").select("family", "metric", "arm_id", "unit_m", "known_points", "epsilon", "value", "ci_low", "ci_high")


def knowledge_points(rows: DataFrame) -> DataFrame:
    """Headlines by known points for each target."""
    return rows.join(F.broadcast(reporting.headline_metrics(rows)), ["family", "metric"]).where("known_points IS NOT NULL").select("family", "metric", "target_ref", "known_points", "value", "ci_low", "ci_high")


def mechanism_bars(rows: DataFrame) -> DataFrame:
    """The headline of each arm, in display order."""
    return reporting.headline_rows(rows).orderBy("family", *reporting.display_order()).select("family", "metric", "target_ref", "value", "ci_low", "ci_high", reporting.is_share(F.col("metric")).alias("share"))


def runtime_bars(rows: DataFrame) -> DataFrame:
    """One runtime for each result."""
    return rows.groupBy("result_id").agg(F.min_by("attack_runtime_s", "metric").alias("attack_runtime_s"))


def _by(rows: Sequence, *keys: str) -> dict[tuple, list]:
    groups: dict[tuple, list] = {}
    for r in rows:
        groups.setdefault(tuple(r[k] for k in keys), []).append(r)
    return dict(sorted(groups.items(), key=lambda kv: [str(x) for x in kv[0]]))


def draw(rows: DataFrame, wanted: Sequence[str]) -> dict[str, str]:
    """File names and SVG texts of the plots asked for, one for each attack family; a plot without any defined point is left out."""
    made: dict[str, str] = {}
    attacks = rows.where("family <> 'utility'")
    if "tradeoff" in wanted:
        for (family, metric, share), points in _by(tradeoffs(rows).collect(), "family", "metric", "share").items():
            made[f"tradeoff_{family}"] = plots.lines(f"{family}: risk against utility", {metric: [(p["x"], p["y"], None, None, p["target_ref"]) for p in points]}, "cell divergence (bits)", metric, share=share, joined=False)
    if "by_epsilon" in wanted:
        for (family, metric), points in _by(epsilon_points(attacks).collect(), "family", "metric").items():
            series = {", ".join([p[0] or "raw", *([f"unit {p[1]:g} m"] if p[1] is not None else []), *([f"k={p[2]}"] if p[2] is not None else [])]): [(r["epsilon"], r["value"], r["ci_low"], r["ci_high"], f"{p[0] or 'raw'}, epsilon {r['epsilon']:g}") for r in g] for p, g in _by(points, "arm_id", "unit_m", "known_points").items()}
            made[f"by_epsilon_{family}"] = plots.lines(f"{family}: {metric} by epsilon", series, "epsilon (logarithmic)", metric, log=True)
    if "by_knowledge" in wanted:
        for (family, metric), points in _by(knowledge_points(attacks).collect(), "family", "metric").items():
            series = {t: [(r["known_points"], r["value"], r["ci_low"], r["ci_high"], f"{t}, k={r['known_points']}") for r in g] for (t,), g in _by(points, "target_ref").items()}
            made[f"by_knowledge_{family}"] = plots.lines(f"{family}: {metric} by known points", series, "known points", metric)
    if "mechanisms" in wanted:
        for (family, metric, share), points in _by(mechanism_bars(attacks).collect(), "family", "metric", "share").items():
            made[f"mechanisms_{family}"] = plots.bars(f"{family}: {metric}", [(p["target_ref"], p["value"], p["ci_low"], p["ci_high"]) for p in points], metric, share)
    if "runtime" in wanted:
        items = sorted((r["result_id"], r["attack_runtime_s"], None, None) for r in runtime_bars(attacks).collect())
        made["runtime"] = plots.bars("attack runtime", items, "seconds") if items else ""
    return {f"{name}.svg": svg for name, svg in made.items() if svg}


def run_labels(runs: DataFrame) -> DataFrame:
    """(exp_id, seeds, split_seeds, users, bootstrap): how each experiment's results rows were made, as text; "–" where nothing is known."""
    def listed(c: str, missing: str = "–"):
        said = F.array_join(F.transform(F.array_sort(F.collect_set(c)), lambda v: v.cast("string")), ", ")
        return F.when(said == "", missing).otherwise(said)

    return runs.groupBy("exp_id").agg(listed("seed").alias("seeds"), listed("split_seed").alias("split_seeds"), listed("max_users", "all").alias("users"), listed("n_bootstrap").alias("bootstrap"))


def markdown(rows: DataFrame, runs: DataFrame | None = None, images: Sequence[str] = ()) -> str:
    """The report page: experiments (of the results rows `runs`), risk matrices, headlines by attack, trade-offs, plots, warnings."""
    lines = ["# Risk report", ""]
    if runs is not None:
        lines += ["| experiment | seeds | split seeds | users | bootstrap rounds |", "| --- | --- | --- | --- | --- |"]
        lines += [f"| {' | '.join(r)} |" for r in run_labels(runs).orderBy("exp_id").collect()] + [""]
    for r in rows.groupBy("config_hash").agg(F.collect_set("exp_id").alias("e")).orderBy("config_hash").collect():
        lines += [f"## Pipeline {r['config_hash']}", "", f"Experiments: {', '.join(sorted(r['e']))}", ""]
        cells = reporting.risk_cells(rows.where(F.col("config_hash") == r["config_hash"])).collect()
        families = sorted({c["family"] for c in cells})
        heads = {c["family"]: c["metric"] for c in cells}
        lines += ["| target | " + " | ".join(f"{f}: {heads[f]}" for f in families) + " |", "|" + " --- |" * (len(families) + 1)]
        for t in sorted({c["target_ref"] for c in cells}):
            by = {c["family"]: c for c in cells if c["target_ref"] == t}
            lines.append(f"| {t} | " + " | ".join(cell(by[f]["value"], k=by[f]["known_points"]) if f in by else "–" for f in families) + " |")
        lines.append("")
    lines += ["## Headlines", "", "| family | target | metric | value |", "| --- | --- | --- | --- |"]
    lines += [f"| {r['family']} | {r['target_ref']} | {r['metric']} | {cell(r['value'], r['ci_low'], r['ci_high'])} |" for r in mechanism_bars(rows).collect()]
    if points := tradeoffs(rows).orderBy("family", "x", "target_ref").collect():
        lines += ["", "## Risk against utility", "", "| family | target | cell divergence (bits) | metric | value |", "| --- | --- | --- | --- | --- |"]
        lines += [f"| {p['family']} | {p['target_ref']} | {cell(p['x'])} | {p['metric']} | {cell(p['y'])} |" for p in points]
    if images:
        lines += ["", "## Plots", "", *[f"![{name.removesuffix('.svg')}](plots/{name})" for name in images]]
    if warnings := [r[0] for r in rows.where("warning IS NOT NULL").select("warning").distinct().orderBy("warning").collect()]:
        lines += ["", "## Warnings", "", *[f"- {w}" for w in warnings]]
    return "\n".join(lines) + "\n"


def write_plots(rows: DataFrame, wanted: Sequence[str], out: str) -> list[str]:
    """The plots as files of out/plots; returns their names."""
    made = draw(rows, wanted)
    for name, svg in made.items():
        results.write_text(rows.sparkSession, f"{out}/plots/{name}", svg)
    return sorted(made)


def generate(spark: SparkSession, folder: str, out: str) -> str:
    """Merged table, tidy export, risk matrix, plots and page; returns the page's path."""
    results.refuse_raw(out)
    rows = load(spark, folder).cache()
    try:
        merged = merge(spark, folder, out)
        export(rows, out)
        reporting.risk_matrix(rows).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{out}/risk_matrix.csv")
        results.write_text(spark, f"{out}/report.md", markdown(rows, merged, write_plots(rows, PLOTS, out)))
    finally:
        rows.unpersist()
    return f"{out}/report.md"
