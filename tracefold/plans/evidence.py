"""Evidence for the route generators on a network alone: membership risk against utility, by epsilon."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import order, rng
from ..operators import attacks, metrics, sequences, zones
from .plots import cell


def seed_population(spark: SparkSession, edges: DataFrame, n: int, min_edges: int, seed: int, tries: int = 200) -> DataFrame:
    """(traj_id, edge_seq): n shortest routes of min_edges edges or more between random nodes of the largest strong component.

    A public network of one region is bounded and is read as a whole; too few routes after
    `tries` draws for each are an error.
    """
    router = zones.Router([(r["edge_id"], r["u"], r["v"], r["length_m"], 0) for r in edges.collect()])
    core = sorted(router.strong_component())
    routes: list[tuple[str, list[int]]] = []
    for k in range(tries * n):
        a, b = (core[int(rng.draw(seed, "population", k, end) * len(core))] for end in ("from", "to"))
        if a != b:
            route = router.path(router.distances(a)[1], a, b)
            if len(route) >= min_edges:
                routes.append((f"p{len(routes):04d}", route))
        if len(routes) == n:
            return spark.createDataFrame(routes, "traj_id string, edge_seq array<bigint>")
    raise ValueError(f"the network gave {len(routes)} of {n} routes with {min_edges} edges")


def visits(routes: DataFrame, nodes: DataFrame, edges: DataFrame, rows: int = 10, cols: int = 10) -> DataFrame:
    """(traj_id, cell, n, length_m): each route's visits of edges' midpoints over a grid of the network, and its metres there."""
    celled = zones.edge_zones(nodes, edges, rows, cols).select("edge_id", "length_m", F.col("zone").alias("cell"))
    spread = routes.select("traj_id", F.explode("edge_seq").alias("edge_id")).join(F.broadcast(celled), "edge_id")
    return spread.groupBy("traj_id", "cell").agg(F.count("*").alias("n"), F.sum("length_m").alias("length_m"))


def features(routes: DataFrame, nodes: DataFrame, edges: DataFrame, rows: int = 10, cols: int = 10) -> tuple[DataFrame, DataFrame]:
    """((cell, n), (traj_id, length_m)): visits over a grid of the network, and routes' lengths."""
    spread = visits(routes, nodes, edges, rows, cols)
    return spread.groupBy("cell").agg(F.sum("n").alias("n")), spread.groupBy("traj_id").agg(F.sum("length_m").alias("length_m"))


def numbered_visits(spread: DataFrame) -> DataFrame:
    """(i, cell, n): the visits of routes with the routes numbered from 0."""
    return spread.join(order.numbered(spread.select("traj_id").distinct(), "traj_id"), "traj_id").select("i", "cell", "n")


def _utility(real: DataFrame, made: DataFrame, nodes: DataFrame, edges: DataFrame, rounds: int, seed: int) -> list[float]:
    """Divergence and length distance of the routes, each with its two-sample interval."""
    spread = [visits(r, nodes, edges).cache() for r in (real, made)]
    cells = [numbered_visits(v) for v in spread]
    lengths = [metrics.indexed(v.groupBy("traj_id").agg(F.sum("length_m").alias("length_m")), "traj_id", F.col("length_m")) for v in spread]
    found = [*metrics.unpaired_jsd_bootstrap(*cells, rounds, seed=seed).first(), *metrics.two_sample_w1_bootstrap(*lengths, rounds, seed=seed).first()]
    for v in spread:
        v.unpersist()
    return found


def evidence(spark: SparkSession, nodes: DataFrame, edges: DataFrame, epsilons: Sequence[float], shadows: int = 16, population: int = 20, min_edges: int = 4, grid: int = 12, seed: int = 0, rounds: int = 1000) -> DataFrame:
    """(arm, epsilon, auc, jsd, length_w1_m), the last two with their intervals (jsd_low, jsd_high, ...): the private generator at each epsilon, and the Markov model as a ceiling.

    The first half of the population are members; every shadow trains on half of all.
    """
    pool = seed_population(spark, edges, population, min_edges, seed).withColumn("label", (F.col("traj_id") < f"p{population // 2:04d}").cast("int")).cache()
    member = pool.where("label = 1")
    members = attacks.shadow_members(pool, shadows, 0.5, seed).cache()
    auc = lambda scored: metrics.roc_auc(scored.join(pool.select("traj_id", "label"), "traj_id").withColumnRenamed("traj_id", "id")).first()["auc"]
    zoned = zones.edge_zones(nodes, edges, grid, grid).cache()
    arcs = order_arcs(zones.zone_arcs(zoned)).cache()
    hops = zones.hops(arcs).cache()
    n_zones = zoned.agg(F.count_distinct("zone")).first()[0]
    seqs = zones.zone_sequence(pool, zoned).cache()
    out = []

    def fitted(own: DataFrame, epsilon: float, key: int) -> DataFrame:
        return zones.estimates(zones.reports(own, arcs, n_zones, epsilon, seed=key).cache(), arcs, own.count(), n_zones, epsilon).cache()

    for epsilon in epsilons:
        target = fitted(seqs.join(member, "traj_id", "left_semi"), epsilon, seed)
        asked = None
        for s in range(shadows):
            model = fitted(seqs.join(members.where(F.col("shadow") == s), "traj_id", "left_semi"), epsilon, seed + 1000 + s)
            scored = spark.createDataFrame(zones.log_prob(seqs, model, arcs).withColumnRenamed("log_prob", "lp").withColumn("shadow", F.lit(s)).collect(), "traj_id string, lp double, shadow int")
            asked = scored if asked is None else asked.unionByName(scored)
        score = attacks.likelihood_ratios(asked, members, zones.log_prob(seqs, target, arcs))
        made = zones.generate(target, arcs, zoned, hops, population, seed).withColumn("traj_id", F.col("syn_id").cast("string"))
        out.append(("rn_ldp_synth", float(epsilon), auc(score), *_utility(member, made, nodes, edges, rounds, seed)))
    named = pool.select("traj_id", F.transform("edge_seq", lambda e: e.cast("string")).alias("seq"))
    counts = sequences.markov_counts(named.join(member, "traj_id", "left_semi"))
    score = attacks.membership_scores(named, members, sequences.markov_log_prob(named, counts))
    made = sequences.markov_generate(counts, population, seed).select(F.col("syn_id").cast("string").alias("traj_id"), F.transform("seq", lambda e: e.cast("bigint")).alias("edge_seq"))
    out.append(("markov", None, auc(score), *_utility(member, made, nodes, edges, rounds, seed)))
    return spark.createDataFrame(out, "arm string, epsilon double, auc double, jsd double, jsd_low double, jsd_high double, length_w1_m double, length_low double, length_high double")


def order_arcs(arcs: DataFrame) -> DataFrame:
    """(arc, i, j): the arcs of a grid's zones numbered from 0."""
    return arcs.select((F.row_number().over(Window.orderBy("i", "j")) - 1).alias("arc"), "i", "j")


def evidence_table(rows: DataFrame) -> str:
    """The evidence as a Markdown table."""
    lines = ["| arm | epsilon | AUC | JSD (bits) | length W1 (m) |", "| --- | --- | --- | --- | --- |"]
    for r in rows.orderBy(F.col("epsilon").asc_nulls_last()).collect():
        lines.append(f"| {r['arm']} | {'–' if r['epsilon'] is None else format(r['epsilon'], 'g')} | {r['auc']:.3f} | {cell(r['jsd'], r['jsd_low'], r['jsd_high'])} | {r['length_w1_m']:.0f} [{r['length_low']:.0f}, {r['length_high']:.0f}] |")
    return "\n".join(lines)
