"""Plots as SVG: every defined point has its mark, the others are named."""

import math
from xml.etree import ElementTree

import pytest

from tracefold.plans import plots

NS = "{http://www.w3.org/2000/svg}"


def marks(svg, kind):
    return [m for m in ElementTree.fromstring(svg).iter(NS + kind) if m.find(NS + "title") is not None]


@pytest.mark.parametrize("low, high", [(0, 1), (0.5, 0.5), (0, 0), (-3, 1e-9), (12, 98_000), (-2.5, -2.5), (1e-7, 3e-7)])
def test_ticks(low, high):
    at = plots.ticks(low, high)
    assert len(at) >= 2 and at == sorted(set(at)) and at[0] <= low + 1e-9 and at[-1] >= high - 1e-9 and len(at) <= 9


def test_lines():
    series = {f"arm <{k}>": [(0.1, k / 12, None, None, f"a{k}"), (10.0, 0.5, 0.4, 0.6, f"b{k}"), (0.0, 0.5, None, None, "zero"), (1.0, math.nan, None, None, f"c{k}")] for k in range(10)}
    svg = plots.lines("risk & use", series, "x", "y", log=True)
    assert len(marks(svg, "circle")) == 20 and svg.count("<polyline") == 10 and svg.count("risk &amp; use") == 2
    assert "zero" in svg and "c3" in svg and "arm &lt;9&gt;" in svg
    assert plots.lines("none", {"a": [(1.0, math.nan, None, None, "a")]}, "x", "y") == ""
    assert len(marks(plots.lines("one", {"a": [(1.0, 0.5, None, None, "p"), (1.0, 0.5, 0.1, None, "q")]}, "x", "y", joined=False), "circle")) == 2


def test_bars():
    svg = plots.bars("errors", [("raw", 0.0, None, None), ("none", -2.0, -3.0, 1.5), ("gone", math.nan, None, None)], "m")
    assert len(marks(svg, "rect")) == 2 and "not defined" in svg and "-2.000" in svg
    assert plots.bars("errors", [("gone", None, None, None)], "m") == ""
