"""Small helpers that the other builders share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII word boundaries; the engine's own \b knows all of Unicode.
START = r"(?<![A-Za-z0-9_])"


def bounded(pattern: str) -> str:
    """A pattern whose \\b match between ASCII word characters and others only.

    A leading one stands before word characters in all our patterns, so it only looks back.
    """
    if pattern.startswith(r"\b"):
        pattern = START + pattern[2:]
    return pattern.replace(r"\b", r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")


def matches(text: Column, pattern: str, any_case: bool = False) -> Column:
    return text.rlike(("(?i)" if any_case else "") + bounded(pattern))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def bind(x: Column, f) -> Column:
    """f(x) with x computed once; a chain of steps that name their input twice would double at each step."""
    return F.transform(F.array(x), f)[0]


def weighted(terms: list[tuple[Column, float]]) -> Column:
    """Sum of the weights whose condition holds, left to right."""
    return reduce(lambda a, b: a + b, [F.when(c, F.lit(float(w))).otherwise(F.lit(0.0)) for c, w in terms], F.lit(0.0))


def filled(x: Column) -> Column:
    """The empty string counts as missing."""
    return F.when(x != "", x)


def uniform(seed: Column | str, id_: Column) -> Column:
    """A number in (0, 1) that the seed and the id fix: reruns and other engines draw the same."""
    text = F.concat(F.lit(seed) if isinstance(seed, str) else seed, F.lit(":"), id_.cast("string"))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % 1000000 + 1) / F.lit(1000001.0)
