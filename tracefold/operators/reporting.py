"""Aggregation and pivots of result rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.results import finite
from .metrics import measurable

#: Two-sided 95 % points of Student's t by degrees of freedom: fixed values.
T_975 = {
    1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228,
    12: 2.179, 14: 2.145, 16: 2.120, 18: 2.101, 20: 2.086, 25: 2.060, 30: 2.042, 40: 2.021, 60: 2.000, 120: 1.980,
}
#: The headline metric of each attack family: fixed values.
HEADLINES = {"reidentification": "top1_acc", "membership_inference": "auc", "reconstruction": "mean_spatial_error_m", "poi_inference": "home_error_m"}
SCOPES = ("raw", "protected", "synthetic")


def t_975(df: Column) -> Column:
    """The tabulated point of the largest df not above; an error below 1."""
    out = F.when(df < 1, F.raise_error(F.lit("degrees of freedom must be 1 at least")).cast("double"))
    for d in sorted(T_975, reverse=True):
        out = out.when(df >= d, F.lit(T_975[d]))
    return out


def student(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """(keys, n_repetitions, mean, ci_low, ci_high) over finite values: a t-interval; degenerate for one, null for none."""
    x = finite(value)
    stats = df.groupBy(*keys).agg(F.count(x).cast("int").alias("n_repetitions"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("__sd"))
    n = F.col("n_repetitions")
    half = F.when(n > 1, t_975(F.greatest(n - 1, F.lit(1))) * F.col("__sd") / F.sqrt(n)).otherwise(F.lit(0.0))
    return stats.select(*keys, "n_repetitions", "mean", (F.col("mean") - half).alias("ci_low"), (F.col("mean") + half).alias("ci_high"))


def identical(c: str) -> Column:
    """The value where all are equal (null counts as one), else null."""
    return F.when((F.count_distinct(c) == 1) & (F.count(c) == F.count("*")), F.min(c))


SEED_KEYS = ("exp_id", "config_hash", "result_id", "metric")


def over_seeds(rows: DataFrame, stats: Sequence[str] = ("n_pool", "n_probes"), runtime: str = "attack_runtime_s") -> DataFrame:
    """Seeds of a run folded: t-interval of the value, mean runtime, statistics kept where identical. A seed twice is an error."""
    extra = rows.groupBy(*SEED_KEYS).agg(
        *[identical(c).alias(c) for c in stats],
        F.avg(finite(runtime)).alias(runtime),
        F.when(F.count_distinct("seed") < F.count("*"), F.raise_error(F.lit("a seed occurs twice")).cast("int")).alias("__seeds"),
    )
    folded = student(rows, SEED_KEYS).withColumnRenamed("mean", "value")
    return folded.join(extra, list(SEED_KEYS)).where("__seeds IS NULL").drop("__seeds")


def headline(family: str, present: Sequence[str]) -> str:
    if not present:
        raise ValueError(f"{family} has no metric")
    ordered = sorted(set(present))
    return HEADLINES[family] if HEADLINES.get(family) in ordered else ordered[0]


def headline_metrics(rows: DataFrame) -> DataFrame:
    """(family, metric): each family's headline, or else its first metric in order."""
    pairs = F.create_map(*[F.lit(x) for kv in HEADLINES.items() for x in kv])
    wanted = rows.withColumn("__wanted", F.try_element_at(pairs, F.col("family")))
    return wanted.groupBy("family").agg(F.coalesce(F.max(F.when(F.col("metric") == F.col("__wanted"), F.col("metric"))), F.min("metric")).alias("metric"))


def headline_rows(rows: DataFrame) -> DataFrame:
    """Each family's headline at the largest known_points of each target."""
    chosen = rows.join(F.broadcast(headline_metrics(rows)), ["family", "metric"])
    order = Window.partitionBy("family", "target_ref").orderBy(F.coalesce("known_points", F.lit(-1)).desc(), "exp_id")
    return chosen.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def display_order() -> list[Column]:
    """Raw, identity, then mechanisms by parameters; missing parameters last."""
    scope = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SCOPES]), F.col("scope")), F.lit(0))
    inf = F.lit(float("inf"))
    return [F.when(scope == 0, len(SCOPES) + 1).otherwise(scope), F.when(F.col("arm_id").isin("", "none"), 0).otherwise(1), F.col("arm_id"), F.coalesce("epsilon", inf), F.coalesce("unit_m", inf), F.col("target_ref")]


def risk_cells(rows: DataFrame) -> DataFrame:
    """(config_hash, target_ref, family, metric, value, known_points): risk matrix cells; rows of a cell that disagree are an error."""
    attacks = rows.where(F.col("family") != "utility")
    keys = ["config_hash", "family"]
    names = F.create_map(*[F.lit(x) for kv in HEADLINES.items() for x in kv])
    best = attacks.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("metric") == F.try_element_at(names, F.col("family")), F.col("metric"))), F.min("metric")).alias("metric"))
    chosen = attacks.join(F.broadcast(best), [*keys, "metric"]).withColumn("k", F.coalesce("known_points", F.lit(-1)))
    top = chosen.groupBy(*keys, "metric", "target_ref").agg(F.max("k").alias("k"))
    cells = chosen.join(top, [*keys, "metric", "target_ref", "k"]).groupBy(*keys, "metric", "target_ref", "k").agg(F.count_distinct("value").alias("n"), F.min_by("value", "exp_id").alias("value"))
    value = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("conflicting values for "), F.col("target_ref"))).cast("double")).otherwise(F.col("value"))
    return cells.select("config_hash", "target_ref", "family", "metric", value.alias("value"), F.nullif("k", F.lit(-1)).alias("known_points"))


def risk_matrix(rows: DataFrame, families: Sequence[str] | None = None) -> DataFrame:
    """One row a pipeline and target, one column a family."""
    cells = risk_cells(rows)
    pivot = cells.groupBy("config_hash", "target_ref")
    return (pivot.pivot("family", list(families)) if families else pivot.pivot("family")).agg(F.first("value"))


def attack_summary(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Metrics as columns for each run, attack, target and level."""
    return rows.groupBy("exp_id", "family", "target_ref", "known_points").pivot("metric", list(metrics)).agg(F.first("value"))


def over_budget(rows: DataFrame, budget_s: float) -> DataFrame:
    """(result_id, attack_runtime_s) above the budget; a result's first runtime (by metric) counts."""
    first = rows.groupBy("result_id").agg(F.min_by("attack_runtime_s", "metric").alias("attack_runtime_s"))
    return first.where(F.col("attack_runtime_s") > budget_s).orderBy(F.desc("attack_runtime_s"), "result_id")


def mask_unmeasurable(rows: DataFrame, also_undefined: bool = False) -> DataFrame:
    """True-positive rates that too few non-members can resolve become NaN without interval; adds warning (also_undefined: for those that are NaN already, too)."""
    fpr = F.regexp_extract("metric", r"^tpr@fpr=([0-9.eE+-]+)$", 1)
    rate = F.nullif(fpr, F.lit("")).try_cast("double")
    bad = (F.col("family") == "membership_inference") & rate.isNotNull() & (F.lit(also_undefined) | finite("value").isNotNull()) & ~measurable(F.coalesce("n_nonmembers", F.lit(0)), rate)
    bad = F.coalesce(bad, F.lit(False))
    return rows.withColumns({
        "warning": F.when(bad, F.format_string("%s %s: %d non-members cannot resolve it", "result_id", "metric", F.coalesce("n_nonmembers", F.lit(0)))),
        "value": F.when(bad, F.lit(float("nan"))).otherwise(F.col("value")),
        "ci_low": F.when(~bad, F.col("ci_low")),
        "ci_high": F.when(~bad, F.col("ci_high")),
    })


def merge_arms(arms: DataFrame) -> DataFrame:
    """(target_ref, stat, value): statistics of arms over seeds, kept where all seeds agree."""
    return arms.groupBy("target_ref", "stat").agg(identical("value").alias("value"))


def union_results(tables: Sequence[DataFrame]) -> DataFrame:
    """Result tables one after the other; other columns are an error."""
    out = tables[0]
    for t in tables[1:]:
        if t.columns != out.columns:
            raise ValueError("result tables differ in their columns")
        out = out.union(t)
    return out


def is_share(metric: Column) -> Column:
    """Whether the metric is a share of one: auc, tpr@..., ..._acc, ..._localised, ..._rate."""
    return metric.rlike(r"^auc$|^tpr@|(_acc|_localised|_rate)$")


def parse_target(ref: Column) -> tuple[Column, Column, Column]:
    """(scope, mechanism, params) of raw or scope:mechanism[:params]; anything else is an error."""
    raw, shaped = ref == "raw", ref.rlike(r"^[^:]+:[^:]+(:.*)?$")
    bad = F.raise_error(F.concat(F.lit("not a target: "), ref)).cast("string")
    scope = F.when(raw, ref).when(shaped, F.regexp_extract(ref, r"^([^:]+):", 1)).otherwise(bad)
    return scope, F.when(raw, "").otherwise(F.regexp_extract(ref, r"^[^:]+:([^:]+)", 1)), F.when(raw, "").otherwise(F.regexp_extract(ref, r"^[^:]+:[^:]+:(.*)$", 1))


def parse_result_id(rid: Column) -> tuple[Column, Column, Column]:
    """(family, target, known points or null) of family:target[:k<n>]."""
    k = F.nullif(F.regexp_extract(rid, r":k(\d+)$", 1), F.lit("")).cast("int")
    rest = F.regexp_replace(rid, r":k\d+$", "")
    return F.regexp_extract(rest, r"^([^:]+):", 1), F.regexp_extract(rest, r"^[^:]+:(.*)$", 1), k


def params_key(params: Column) -> Column:
    """Sort key of a=1,b=x: (name, number or infinity) pairs."""
    parts = F.filter(F.split(params, ","), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("name"), F.coalesce(F.split_part(p, F.lit("="), F.lit(2)).try_cast("double"), F.lit(float("inf"))).alias("number")))
