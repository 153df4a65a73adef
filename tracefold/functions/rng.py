"""Portable random numbers: a uniform is a function of a key, so results don't depend on partitioning or order."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hex digits of the key's MD5 that make a uniform: 52 bits, exact in a double.
DIGITS = 13
SCALE = float(1 << (4 * DIGITS))


def key(*parts: Column | str | int | float) -> Column:
    """The parts joined by '|'; strings and numbers are literals."""
    return F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def uniform(*parts: Column | str | int | float) -> Column:
    """Uniform in [0, 1) for the key."""
    return F.conv(F.substring(F.md5(key(*parts).cast("binary")), 1, DIGITS), 16, 10).cast("bigint") / F.lit(SCALE)


def index(n: Column | int, *parts: Column | str | int) -> Column:
    """Uniform integer from 0 to n - 1 for the key."""
    return F.floor(uniform(*parts) * n).cast("int")


def draw(*parts: object) -> float:
    """The driver's and the workers' twin of uniform()."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:DIGITS], 16) / SCALE
