"""Named implementations by kind."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from ..operators import attacks, matching, protect, sequences, stays, zones
from ..sources import trajectories

KINDS = ("dataset", "matcher", "mechanism", "generator", "attack", "metric")
_known: dict[tuple[str, str], Any] = {}


def register(kind: str, name: str) -> Callable[[Any], Any]:
    """Decorator: an implementation under a name that its kind doesn't have yet."""
    if kind not in KINDS:
        raise ValueError(f"no such kind: {kind}")

    def keep(made: Any) -> Any:
        if not callable(made):
            raise ValueError(f"{kind} {name} can't be called")
        if (kind, name) in _known:
            raise ValueError(f"{kind} {name} is there already")
        _known[kind, name] = made
        return made

    return keep


def get(kind: str, name: str) -> Any:
    if (kind, name) not in _known:
        raise KeyError(f"no {kind} {name}; there are {sorted(n for k, n in _known if k == kind)}")
    return _known[kind, name]


for _kind, _name, _made in (
    ("dataset", "geolife", trajectories.read_plt),
    ("matcher", "leuven", matching.match),
    ("mechanism", "none", protect.identity),
    ("mechanism", "geo_indistinguishability", protect.geoind),
    ("generator", "markov", sequences.markov_counts),
    ("generator", "rn_ldp_synth", zones.reports),
    ("attack", "reidentification", attacks.dtw_ranking),
    ("attack", "membership_inference", attacks.membership_scores),
    ("attack", "reconstruction", attacks.reconstruct),
    ("attack", "poi_inference", stays.place_errors),
):
    register(_kind, _name)(_made)

#: The region of each dataset.
NATIVE_REGION = {"geolife": "beijing"}
