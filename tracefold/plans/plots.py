"""Line and bar plots as SVG. Points are result rows, a dimension, and are drawn on the driver."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from xml.sax.saxutils import escape

WIDTH, HEIGHT, LEFT, RIGHT, TOP, BOTTOM, BAR, LINE = 720, 360, 72, 24, 40, 56, 28, 18
SURFACE, INK, SOFT, GRID, AXIS = "#fcfcfb", "#0b0b0b", "#52514e", "#e1e0d9", "#c3c2b7"
#: Series colours in fixed order; a panel holds as many series, further ones go to a panel of their own.
COLOURS = ("#2a78d6", "#eb6834", "#1baf7a", "#eda100", "#e87ba4", "#008300", "#4a3aa7", "#e34948")

#: x, y, interval (or None) and what the mark is called.
Point = tuple[float, float, float | None, float | None, str]


def number(x: float | None) -> str:
    return "–" if x is None or not math.isfinite(x) else f"{x:.3f}"


def cell(value: float | None, low: float | None = None, high: float | None = None, k: int | None = None) -> str:
    """A value with its interval and level, as far as there are any."""
    out = number(value)
    if _finite(low) and _finite(high):
        out += f" [{number(low)}, {number(high)}]"
    return out + (f" @k={k}" if k is not None else "")


def _finite(x: float | None) -> bool:
    return x is not None and math.isfinite(x)


def ticks(low: float, high: float, most: int = 6) -> list[float]:
    """Round numbers that cover low to high."""
    span = (high - low) or abs(high) or 1.0
    unit = 10.0 ** math.floor(math.log10(span / most))
    step = next(unit * k for k in (1, 2, 5, 10, 20) if span / (unit * k) <= most)
    first = math.floor(low / step + 1e-9)
    last = max(first + 1, math.ceil(high / step - 1e-9))
    return [round(k * step, 12) for k in range(first, last + 1)]


def _text(x: float, y: float, words: str, anchor: str = "start", colour: str = SOFT, size: int = 12) -> str:
    return f'<text x="{x:.1f}" y="{y:.1f}" text-anchor="{anchor}" fill="{colour}" font-size="{size}">{escape(words)}</text>'


def _stroke(x1: float, y1: float, x2: float, y2: float, colour: str, width: int = 1) -> str:
    return f'<line x1="{x1:.1f}" y1="{y1:.1f}" x2="{x2:.1f}" y2="{y2:.1f}" stroke="{colour}" stroke-width="{width}"/>'


def _page(parts: Iterable[str], height: float) -> str:
    frame = f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{height:.0f}" viewBox="0 0 {WIDTH} {height:.0f}" font-family="sans-serif">'
    return "\n".join([frame, f'<rect width="100%" height="100%" fill="{SURFACE}"/>', *parts, "</svg>"]) + "\n"


def lines(title: str, series: dict[str, list[Point]], x_label: str, y_label: str, log: bool = False, share: bool = False, joined: bool = True) -> str:
    """Series of finite points in panels of eight, each point with its interval as a whisker; undefined points are named below."""
    shown = {name: sorted((p for p in points if _finite(p[0]) and _finite(p[1]) and (p[0] > 0 or not log)), key=lambda p: p[:2]) for name, points in series.items()}
    left_out = sorted({p[4] for name, points in series.items() for p in points if p not in shown[name]})
    shown = {name: points for name, points in shown.items() if points}
    if not shown:
        return ""
    every = [p for points in shown.values() for p in points]
    ys = [0.0, 1.0] if share else [v for p in every for v in p[1:4] if _finite(v)]
    y_ticks, xs = ticks(min(ys), max(ys)), sorted({p[0] for p in every})
    x_ticks = (xs if len(xs) <= 8 else xs[:: math.ceil(len(xs) / 8)]) if log else ticks(xs[0], xs[-1])
    place = math.log10 if log else float
    x0, x1 = (place(xs[0]), place(xs[-1])) if log else (x_ticks[0], x_ticks[-1])
    names, parts, top = list(shown), [], 0.0
    for start in range(0, len(names), len(COLOURS)):
        panel = names[start : start + len(COLOURS)]
        bottom = top + HEIGHT - BOTTOM
        at_x = lambda v: LEFT + (0.5 if x1 == x0 else (place(v) - x0) / (x1 - x0)) * (WIDTH - LEFT - RIGHT)
        at_y = lambda v: bottom - (v - y_ticks[0]) / (y_ticks[-1] - y_ticks[0]) * (bottom - top - TOP)  # noqa: E731, B023
        parts.append(_text(LEFT, top + 22, title, colour=INK, size=15))
        for t in y_ticks:
            parts += [_stroke(LEFT, at_y(t), WIDTH - RIGHT, at_y(t), GRID), _text(LEFT - 8, at_y(t) + 4, f"{t:g}", "end")]
        parts += [_text(at_x(t), bottom + 18, f"{t:g}", "middle") for t in x_ticks]
        parts += [_stroke(LEFT, bottom, WIDTH - RIGHT, bottom, AXIS), _text((LEFT + WIDTH - RIGHT) / 2, bottom + 40, x_label, "middle")]
        parts.append(f'<g transform="translate(18 {(top + TOP + bottom) / 2:.1f}) rotate(-90)">{_text(0, 0, y_label, "middle")}</g>')
        for colour, name in zip(COLOURS, panel):
            points = shown[name]
            if joined and len(points) > 1:
                path = " ".join(f"{at_x(p[0]):.1f},{at_y(p[1]):.1f}" for p in points)
                parts.append(f'<polyline points="{path}" fill="none" stroke="{colour}" stroke-width="2" stroke-linejoin="round"/>')
            for x, y, low, high, called in points:
                if _finite(low) and _finite(high):
                    parts.append(_stroke(at_x(x), at_y(low), at_x(x), at_y(high), colour, 2))
                note = f"<title>{escape(called)}: {cell(y, low, high)}</title>"
                parts.append(f'<circle cx="{at_x(x):.1f}" cy="{at_y(y):.1f}" r="5" fill="{colour}" stroke="{SURFACE}" stroke-width="2">{note}</circle>')
                if not joined:
                    parts.append(_text(at_x(x) + 8, at_y(y) - 8, called) if at_x(x) < WIDTH / 2 else _text(at_x(x) - 8, at_y(y) - 8, called, "end"))
        top += HEIGHT
        if len(names) > 1:
            for k, (colour, name) in enumerate(zip(COLOURS, panel)):
                parts += [f'<circle cx="{LEFT + 5}" cy="{top + LINE * k + 4:.1f}" r="5" fill="{colour}"/>', _text(LEFT + 16, top + LINE * k + 8, name)]
            top += LINE * len(panel) + 8
    if left_out:
        parts.append(_text(LEFT, top + 14, "not defined: " + ", ".join(left_out)))
        top += 24
    return _page(parts, top)


def bars(title: str, items: Sequence[tuple[str, float, float | None, float | None]], x_label: str, share: bool = False) -> str:
    """Horizontal bars in the order given, with their intervals as whiskers; undefined values have a row without bar."""
    ends = [0.0, 1.0] if share else [0.0, *(v for item in items for v in item[1:] if _finite(v))]
    if not any(_finite(item[1]) for item in items):
        return ""
    x_ticks = ticks(min(ends), max(ends))
    left = min(WIDTH // 2, LEFT + 7 * max(len(item[0]) for item in items))
    at = lambda v: left + (v - x_ticks[0]) / (x_ticks[-1] - x_ticks[0]) * (WIDTH - left - RIGHT - 48)
    bottom = TOP + BAR * len(items)
    parts = [_text(16, 22, title, colour=INK, size=15)]
    for t in x_ticks:
        parts += [_stroke(at(t), TOP, at(t), bottom, GRID), _text(at(t), bottom + 18, f"{t:g}", "middle")]
    for k, (name, value, low, high) in enumerate(items):
        y = TOP + BAR * k + BAR / 2
        parts.append(_text(left - 8, y + 4, name, "end"))
        if not _finite(value):
            parts.append(_text(at(0.0) + 6, y + 4, "not defined"))
            continue
        a, b = sorted((at(0.0), at(value)))
        parts.append(f'<rect x="{a:.1f}" y="{y - 8:.1f}" width="{max(b - a, 1):.1f}" height="16" fill="{COLOURS[0]}"><title>{escape(name)}: {cell(value, low, high)}</title></rect>')
        if _finite(low) and _finite(high):
            parts.append(_stroke(at(low), y, at(high), y, INK, 2))
        parts.append(_text(max(b, at(high) if _finite(high) else b) + 6, y + 4, number(value), colour=INK))
    parts += [_stroke(at(0.0), TOP, at(0.0), bottom, AXIS), _text((left + WIDTH - RIGHT) / 2, bottom + 40, x_label, "middle")]
    return _page(parts, bottom + BOTTOM)
