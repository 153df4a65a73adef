"""Experiment configuration: parsed and checked as a whole before any Spark job."""

from __future__ import annotations

import hashlib
import itertools
import json
from dataclasses import dataclass, field
from typing import Any

from ..operators.cleaning import CleaningRules
from ..operators.splits import SPLITS
from ..operators.stays import HOME_HOURS, TZ_OFFSET_H, WORK_HOURS
from ..sources.results import refuse_raw

PLOTS = ("tradeoff", "by_epsilon", "by_knowledge", "mechanisms", "runtime")
UTILITY = ("cell_js_divergence", "length_dist_error")
PRIVACY = ("top1_acc", "topk_acc", "linkage_rate")
#: Parameters that an arm may have, with defaults (None: required).
MECHANISMS: dict[str, dict[str, Any]] = {"none": {}, "geo_indistinguishability": {"epsilon": None, "unit_m": 100.0}}
GENERATORS: dict[str, dict[str, Any]] = {
    "markov": {"order": 1, "alpha": 1.0, "max_len": 50},
    "rn_ldp_synth": {"epsilon": 1.0, "n_rows": 12, "n_cols": 12, "l_max": 24, "budget_split": (0.15, 0.15, 0.2, 0.5)},
}
#: For each attack its scopes, attacker's keys with defaults, and further keys.
ATTACKS: dict[str, tuple[tuple[str, ...], dict[str, Any], dict[str, Any]]] = {
    "reidentification": (("raw", "protected"), {"known_points": None, "distance": "dtw"}, {}),
    "reconstruction": (("protected",), {"motion_m": None}, {}),
    "poi_inference": (("protected",), {"dwell_s": 300.0, "radius_m": 200.0, "home_hours": HOME_HOURS, "work_hours": WORK_HOURS, "tz_offset_h": TZ_OFFSET_H}, {"threshold_m": 200.0}),
    "membership_inference": (("synthetic",), {"n_shadow": 16, "subsample": 0.5}, {"fprs": (0.001, 0.01)}),
}


class ConsistencyError(ValueError):
    """Map and dataset are of different regions."""


@dataclass(frozen=True)
class Arm:
    name: str
    params: tuple[tuple[str, Any], ...] = ()

    @property
    def ref(self) -> str:
        return self.name + (":" + ",".join(f"{k}={v}" for k, v in self.params) if self.params else "")

    def get(self, key: str, table: dict) -> Any:
        return dict(self.params).get(key, table[self.name].get(key))


@dataclass(frozen=True)
class AttackPlan:
    family: str
    scopes: tuple[str, ...]
    options: dict[str, Any]


@dataclass
class RunConfig:
    exp_id: str
    seed: int
    split_seed: int
    output_dir: str
    cache_dir: str
    map_region: str
    map_bbox: tuple[float, float, float, float]
    map_dir: str
    utm_zone: int
    dataset: str
    dataset_path: str
    native_region: str
    max_users: int | None
    cleaning: CleaningRules
    matcher: str
    matching: dict[str, float]
    min_match_score: float
    fractions: dict[str, float]
    mechanisms: list[Arm]
    generators: list[Arm]
    attacks: list[AttackPlan]
    metrics: list[str]
    top_k: int
    utility: list[str]
    utility_grid: tuple[int, int]
    bootstrap: int
    ci: float
    budget_s: float
    plots: list[str] = field(default_factory=list)


def _need(section: dict, key: str, where: str) -> Any:
    if not isinstance(section, dict) or key not in section:
        raise ValueError(f"config: {where or 'the top level'} lacks {key}")
    return section[key]


def _only(given, allowed, what: str) -> None:
    if extra := sorted(set(given) - set(allowed)):
        raise ValueError(f"config: {what} has {extra}; it may have {sorted(allowed)}")


def _positive(x: float, what: str) -> float:
    if not x > 0:
        raise ValueError(f"config: {what} must be positive, not {x}")
    return x


def arms(entries: list[dict], table: dict[str, dict[str, Any]], what: str, as_float: bool) -> list[Arm]:
    """Each entry once for every combination of its listed values, keys in order; numbers of mechanisms are floats in labels."""
    out = []
    for e in entries:
        name = str(_need(e, "id", what))
        if name not in table:
            raise KeyError(f"config: no {what} {name}; there are {sorted(table)}")
        params = e.get("params", {})
        _only(params, table[name], f"{what} {name}")
        for key, default in table[name].items():
            if default is None and key not in params:
                raise ValueError(f"config: {what} {name} needs {key}")
        keys = sorted(params)
        listed = [v if isinstance(v, list) and k != "budget_split" else [v] for k, v in ((k, params[k]) for k in keys)]
        for combination in itertools.product(*listed):
            value = [float(v) if as_float and isinstance(v, (int, float)) and not isinstance(v, bool) else tuple(v) if isinstance(v, list) else v for v in combination]
            arm = Arm(name, tuple(zip(keys, value)))
            for k, v in arm.params:
                if k in ("epsilon", "unit_m", "alpha", "order", "max_len", "n_rows", "n_cols", "l_max"):
                    _positive(v, f"{arm.ref} {k}")
            out.append(arm)
    if len({a.ref for a in out}) < len(out):
        raise ValueError(f"config: {what} lists an arm twice")
    return out


def _attack(entry: dict, where: str) -> AttackPlan:
    family = str(_need(entry, "type", where))
    if family not in ATTACKS:
        raise KeyError(f"config: {where}: no attack {family}; there are {sorted(ATTACKS)}")
    scopes, attacker, more = ATTACKS[family]
    chosen = tuple(entry.get("target_scope", ["raw"]))
    _only(chosen, scopes, f"{where} target_scope")
    given = entry.get("attacker", {})
    _only(given, attacker, f"{where} attacker")
    _only(set(entry) - {"type", "attacker", "target_scope"}, more, where)
    o = {**attacker, **given, **more, **{k: entry[k] for k in more if k in entry}}
    if family == "reidentification":
        if not o["known_points"] or any(int(k) < 1 for k in o["known_points"]):
            raise ValueError(f"config: {where} needs attacker.known_points")
        if o["distance"] != "dtw":
            raise ValueError(f"config: {where}: the distance can only be dtw")
    if family == "poi_inference":
        for key in ("dwell_s", "radius_m", "threshold_m"):
            _positive(float(o[key]), f"{where} {key}")
        for key in ("home_hours", "work_hours"):
            if len(o[key]) != 2:
                raise ValueError(f"config: {where} {key} must be a start and an end")
    if family == "membership_inference":
        if int(o["n_shadow"]) < 2 or not 0 < float(o["subsample"]) < 1:
            raise ValueError(f"config: {where} needs two shadows and a subsample between 0 and 1")
        if not o["fprs"] or any(not 0 < f < 1 for f in o["fprs"]):
            raise ValueError(f"config: {where} fprs must lie between 0 and 1")
    return AttackPlan(family, chosen, o)


def parse(raw: dict[str, Any]) -> RunConfig:
    """A checked configuration; whatever isn't supported is an error here."""
    if not isinstance(raw, dict):
        raise ValueError("config: the top level must be a mapping")
    exp, mp, ds, cl, mm, sp, me = (_need(raw, k, "") for k in ("experiment", "map", "dataset", "cleaning", "map_matching", "split", "metrics"))
    box = tuple(float(x) for x in _need(mp, "bbox", "map"))
    if len(box) != 4:
        raise ValueError("config: map.bbox must have four numbers")
    crs = str(_need(mp, "crs", "map"))
    if not (crs.startswith("EPSG:326") and crs[8:].isdigit() and 1 <= int(crs[8:]) <= 60):
        raise ValueError(f"config: map.crs {crs} is not a northern UTM zone")
    if sp.get("scheme", "by_user") != "by_user":
        raise ValueError("config: split.scheme can only be by_user")
    fractions = {str(k): float(v) for k, v in _need(sp, "fractions", "split").items()}
    _only(fractions, SPLITS, "split.fractions")
    if abs(sum(fractions.values()) - 1) > 1e-9:
        raise ValueError("config: split.fractions must sum to 1")
    reporting = raw.get("reporting", {})
    _only(reporting.get("export", ["csv"]), ("csv",), "reporting.export")
    plots = list(reporting.get("plots", []))
    _only(plots, PLOTS, "reporting.plots")
    privacy, utility = list(_need(me, "privacy", "metrics")), list(me.get("utility", []))
    _only(privacy, PRIVACY, "metrics.privacy")
    _only(utility, UTILITY, "metrics.utility")
    mechanisms = arms(raw.get("privacy_mechanisms", []), MECHANISMS, "mechanism", True)
    generators = arms(raw.get("synthetic_generators", []), GENERATORS, "generator", False)
    plans = [_attack(a, f"attacks[{i}]") for i, a in enumerate(_need(raw, "attacks", ""))]
    if not plans:
        raise ValueError("config: there is no attack")
    for p in plans:
        if p.family == "reconstruction" and not any(m.name == "geo_indistinguishability" for m in mechanisms):
            raise ValueError("config: reconstruction needs a geo_indistinguishability arm")
        if p.family == "poi_inference" and not mechanisms:
            raise ValueError("config: poi_inference needs a mechanism")
        if p.family == "membership_inference":
            if not generators:
                raise ValueError("config: membership_inference needs a generator")
            if not fractions.get("train") or not fractions.get("test"):
                raise ValueError("config: membership_inference needs train and test users")
    if "tradeoff" in plots and "cell_js_divergence" not in utility:
        raise ValueError("config: the tradeoff plot needs cell_js_divergence")
    if "by_knowledge" in plots and not any(p.family == "reidentification" for p in plans):
        raise ValueError("config: the by_knowledge plot needs known_points")
    if {"by_epsilon", "mechanisms"} & set(plots) and not mechanisms + generators:
        raise ValueError("config: the plots by_epsilon and mechanisms need an arm")
    seed = int(_need(exp, "seed", "experiment"))
    max_users = ds.get("max_users")
    if max_users is not None:
        _positive(int(max_users), "dataset.max_users")
    boot = _need(me, "bootstrap", "metrics")
    out = RunConfig(
        exp_id=str(_need(exp, "id", "experiment")), seed=seed, split_seed=int(exp.get("split_seed", seed)),
        output_dir=str(exp.get("output_dir", f"results/{exp['id']}")), cache_dir=str(exp.get("cache_dir", "data/processed")),
        map_region=str(_need(mp, "region", "map")), map_bbox=box, map_dir=str(mp.get("dir", "maps")), utm_zone=int(crs[8:]),
        dataset=str(_need(ds, "id", "dataset")), dataset_path=str(_need(ds, "path", "dataset")), native_region=str(ds.get("native_region", "")), max_users=max_users,
        cleaning=CleaningRules(*(kind(_need(cl, k, "cleaning")) for k, kind in (("max_speed_kmh", float), ("min_points", int), ("min_length_m", float), ("resample_s", float)))),
        matcher=str(_need(mm, "matcher", "map_matching")), matching={"radius_m": float(mm.get("radius_m", 50)), "gps_error_m": float(mm.get("gps_error_m", 20)), "candidates": int(mm.get("k_candidates", 8))}, min_match_score=float(_need(mm, "min_match_score", "map_matching")),
        fractions=fractions, mechanisms=mechanisms, generators=generators, attacks=plans,
        metrics=privacy, top_k=int(me.get("top_k", 5)), utility=utility, utility_grid=tuple(int(me.get("utility_grid", {}).get(k, 20)) for k in ("n_rows", "n_cols")),
        bootstrap=int(boot.get("n", 1000)), ci=float(boot.get("ci", 0.95)), budget_s=_positive(float(me.get("attack_time_budget_s", 300)), "metrics.attack_time_budget_s"), plots=plots,
    )
    for path in (out.output_dir, out.cache_dir):
        refuse_raw(path)
    return out


def load(path: str) -> RunConfig:
    """A configuration file, YAML or JSON."""
    with open(path) as file:
        text = file.read()
    if path.endswith(".json"):
        return parse(json.loads(text))
    import yaml

    return parse(yaml.safe_load(text))


def digest(value: Any) -> str:
    """First 16 hex digits of the SHA-256 of JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()[:16]


def pipeline_hash(cfg: RunConfig, snapshot: str = "") -> str:
    """Of all that the matched pool depends on, the network's own hash (snapshot) included; the run's seed is no part of it."""
    return digest([snapshot, cfg.map_region, cfg.map_bbox, cfg.utm_zone, cfg.dataset, cfg.dataset_path, vars(cfg.cleaning), cfg.matcher, cfg.matching, cfg.min_match_score, cfg.max_users, cfg.fractions, cfg.split_seed])


def release_hash(cfg: RunConfig, arm: Arm, snapshot: str = "") -> str:
    """Of a mechanism's release: the pipeline, the arm and the run's seed."""
    return digest([pipeline_hash(cfg, snapshot), arm.name, arm.params, cfg.seed])
