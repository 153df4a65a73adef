"""Metrics over scores, distributions and indicators, with bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import order, rng


def score_groups(scores: DataFrame) -> DataFrame:
    """(score, pos, neg, below, tp, fp, p, n): tie groups with running counts."""
    groups = scores.groupBy("score").agg(F.sum("label").cast("double").alias("pos"), F.sum(1 - F.col("label")).cast("double").alias("neg"))
    totals = groups.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    out = order.running(groups, "score", ["pos", "neg"]).join(F.broadcast(totals))
    below = F.col("before_pos") + F.col("before_neg")
    return out.select("score", "pos", "neg", below.alias("below"), (F.col("p") - F.col("before_pos")).alias("tp"), (F.col("n") - F.col("before_neg")).alias("fp"), "p", "n")


def average_ranks(scores: DataFrame) -> DataFrame:
    """(id, score, avg_rank): ranks from 1, the mean rank for ties."""
    groups = score_groups(scores).select("score", (F.col("below") + (F.col("pos") + F.col("neg") + 1) / 2).alias("avg_rank"))
    return scores.select("id", "score").join(groups, "score").select("id", "score", "avg_rank")


def roc_auc(scores: DataFrame) -> DataFrame:
    """One row, auc: the Mann-Whitney form with mean ranks; 0.5 where a class is empty."""
    r = F.sum(F.col("pos") * (F.col("below") + (F.col("pos") + F.col("neg") + 1) / 2))
    p, n = F.sum("pos"), F.sum("neg")
    return score_groups(scores).agg(F.coalesce(F.when((p > 0) & (n > 0), (r - p * (p + 1) / 2) / (p * n)), F.lit(0.5)).alias("auc"))


def tpr_at_fpr(scores: DataFrame, targets: tuple[float, ...] = (0.001, 0.01)) -> DataFrame:
    """(fpr_target, tpr): the best true-positive rate at a tie group's border; NaN where a class is empty."""
    groups = score_groups(scores)
    rates = []
    for target in targets:
        best = F.max(F.when(F.col("fp") / F.when(F.col("n") > 0, F.col("n")) <= target, F.col("tp") / F.when(F.col("p") > 0, F.col("p"))))
        empty = (F.max("p") == 0) | (F.max("n") == 0) | (F.count("*") == 0)
        rates.append(F.struct(F.lit(target).alias("fpr_target"), F.when(empty, F.lit(float("nan"))).otherwise(F.coalesce(best, F.lit(0.0))).alias("tpr")))
    return groups.agg(F.array(*rates).alias("r")).select(F.inline("r"))


def measurable(n_nonmembers: Column, fpr: Column | float) -> Column:
    """Whether so many non-members can resolve the false-positive rate."""
    return n_nonmembers * fpr >= 1 - 1e-9


def js_divergence(counts: DataFrame, key: str, left: str, right: str, *by: str) -> DataFrame:
    """(by, jsd), one row without `by`: bits between two count columns over the key; null where a side is empty."""
    totals = counts.groupBy(*by).agg(F.sum(left).cast("double").alias("__l"), F.sum(right).cast("double").alias("__r"))
    both = counts.join(totals, list(by)) if by else counts.join(F.broadcast(totals))
    p, q = F.col(left) / F.when(F.col("__l") > 0, F.col("__l")), F.col(right) / F.when(F.col("__r") > 0, F.col("__r"))
    m = (p + q) / 2
    term = F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)
    return both.groupBy(*by).agg(F.when((F.max("__l") > 0) & (F.max("__r") > 0), F.sum(term) / 2).alias("jsd"))


def w1(values: DataFrame, value: str = "x", side: str = "side", *by: str) -> DataFrame:
    """(by, w1): first Wasserstein distance of sides 0 and 1, as the area between their distribution functions.

    Each value's share of the area reaches from zero to it, so neighbours need not be
    known: the area is a sum over values of the change of |F - G| there, times the value.
    """
    groups = values.groupBy(*by, value).agg(*[F.sum(F.when(F.col(side) == s, 1.0).otherwise(0.0)).alias(f"n{s}") for s in (0, 1)])
    if by:
        run, every = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
        before = [F.coalesce(F.sum(f"n{s}").over(run), F.lit(0.0)) / F.sum(f"n{s}").over(every) for s in (0, 1)]
        after = [b + F.col(f"n{s}") / F.sum(f"n{s}").over(every) for s, b in enumerate(before)]
    else:
        totals = groups.agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"))
        groups = order.running(groups, value, ["n0", "n1"]).join(F.broadcast(totals))
        before = [F.col(f"before_n{s}") / F.col(f"t{s}") for s in (0, 1)]
        after = [(F.col(f"before_n{s}") + F.col(f"n{s}")) / F.col(f"t{s}") for s in (0, 1)]
    change = F.abs(before[0] - before[1]) - F.abs(after[0] - after[1])
    return groups.select(*by, (change * F.col(value)).alias("part")).groupBy(*by).agg(F.sum("part").alias("w1"))


def resampled(n: int, rounds: int, seed: int, purpose: str, spark) -> DataFrame:
    """(b, i): n draws with replacement from 0 to n - 1 for each of the rounds."""
    grid = spark.range(rounds * n)
    b, k = F.floor(F.col("id") / n).cast("int"), (F.col("id") % n).cast("int")
    return grid.select(b.alias("b"), rng.index(n, seed, purpose, b, k).alias("i"))


def interval(means: DataFrame, column: str, ci: float = 0.95) -> DataFrame:
    """(ci_low, ci_high): percentiles by linear interpolation."""
    low = (1 - ci) / 2
    return means.agg(F.percentile(column, F.lit(low)).alias("ci_low"), F.percentile(column, F.lit(1 - low)).alias("ci_high"))


def bootstrap_ci(indexed: DataFrame, rounds: int, ci: float = 0.95, seed: int = 0, purpose: str = "bootstrap") -> DataFrame:
    """(mean, ci_low, ci_high) of indexed (i from 0, x); NaN where empty, the mean itself without rounds."""
    spark = indexed.sparkSession
    n = indexed.count()
    if not n:
        return spark.sql("SELECT double('NaN') AS mean, double('NaN') AS ci_low, double('NaN') AS ci_high")
    mean = indexed.agg(F.avg("x").alias("mean"))
    if rounds <= 0:
        return mean.select("mean", F.col("mean").alias("ci_low"), F.col("mean").alias("ci_high"))
    means = resampled(n, rounds, seed, purpose, spark).join(indexed, "i").groupBy("b").agg(F.avg("x").alias("m"))
    return mean.crossJoin(interval(means, "m", ci))  # a row each


def indexed(df: DataFrame, key: str, value: Column) -> DataFrame:
    """(i, x): values numbered from 0, in an order of the key (see order.numbered)."""
    return order.numbered(df.select(F.col(key).alias("__key"), value.alias("x")), "__key").select("i", "x")


def sorted_distance(pairs: DataFrame, *by: str) -> DataFrame:
    """(by, d): mean distance of the sorted columns a and b, which is W1 of samples of equal size."""
    long = pairs.select(*by, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("x")), F.struct(F.lit(1).alias("side"), F.col("b").alias("x")))).alias("v"))
    return w1(long.select(*by, "v.side", "v.x"), "x", "side", *by).withColumnRenamed("w1", "d")


def paired_length_bootstrap(pairs: DataFrame, rounds: int, ci: float = 0.95, seed: int = 0) -> DataFrame:
    """(value, ci_low, ci_high) of the sorted distance of pairs (i, a, b); both sides draw the same indices."""
    drawn = resampled(pairs.count(), rounds, seed, "paired", pairs.sparkSession).withColumnRenamed("b", "round").join(pairs, "i")
    return sorted_distance(pairs).select(F.col("d").alias("value")).crossJoin(interval(sorted_distance(drawn, "round"), "d", ci))


def two_sample_w1_bootstrap(left: DataFrame, right: DataFrame, rounds: int, ci: float = 0.95, seed: int = 0) -> DataFrame:
    """(value, ci_low, ci_high) of W1 between (i, x) samples; each side draws its own indices."""
    spark = left.sparkSession
    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    drawn = []
    for side, sample in ((0, left), (1, right)):
        drawn.append(resampled(sample.count(), rounds, seed, f"side{side}", spark).join(sample, "i").select("b", "x", F.lit(side).alias("side")))
    return w1(both).select(F.col("w1").alias("value")).crossJoin(interval(w1(drawn[0].unionByName(drawn[1]), "x", "side", "b"), "w1", ci))


def unpaired_jsd_bootstrap(left: DataFrame, right: DataFrame, rounds: int, ci: float = 0.95, seed: int = 0) -> DataFrame:
    """(value, ci_low, ci_high) of the divergence of two samples' visits (i, cell, n); each side draws its own members i from 0.

    A round adds up what its members visited, times the number of their draws, so a
    round's rows are cells and not members. Null where a sample is empty.
    """
    spark = left.sparkSession
    whole, drawn = [], []
    for side, sample in enumerate((left, right)):
        n = sample.agg(F.max("i") + 1).first()[0] or 0
        times = resampled(n, rounds, seed, f"side{side}", spark).groupBy("b", "i").agg(F.count("*").alias("times"))
        drawn.append(times.join(sample, "i").groupBy("b", "cell").agg(F.sum(F.col("times") * F.col("n")).alias(f"n{side}")))
        whole.append(sample.groupBy("cell").agg(F.sum("n").alias(f"n{side}")))
    value = js_divergence(whole[0].join(whole[1], "cell", "full").fillna(0, ["n0", "n1"]), "cell", "n0", "n1")
    each = js_divergence(drawn[0].join(drawn[1], ["b", "cell"], "full").fillna(0, ["n0", "n1"]), "cell", "n0", "n1", "b")
    return value.select(F.col("jsd").alias("value")).crossJoin(interval(each, "jsd", ci))  # a row each
