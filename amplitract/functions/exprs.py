"""Column expressions that several operators share. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RTOL = 1e-5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def close(a: Column, b: Column | float, atol: float, rtol: float = RTOL) -> Column:
    """|a - b| <= atol + rtol * |b|; not symmetric in a and b."""
    b = b if isinstance(b, Column) else F.lit(float(b))
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def framed(seq: Column) -> Column:
    """Triplets from the first base on, each followed by a blank; a short tail is dropped."""
    whole = F.substring(seq, F.lit(1), (F.length(seq) - F.length(seq) % 3).cast("int"))
    return F.regexp_replace(whole, "(...)", "$1 ")


def mask_flags(frames: Column, mask: str) -> Column:
    """A string with 1 for each triplet that is the mask and 0 for each other."""
    return F.regexp_replace(F.replace(frames, F.lit(f"{mask} "), F.lit("1")), "[A-Z]{3} ", "0")


def hamming(a: Column, b: Column) -> Column:
    """How many characters differ, of two strings of one length."""
    at = F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1)))
    return F.size(F.filter(at, lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))


def rotation_match(s: Column, target: str, most: int = 1) -> Column:
    """Whether some rotation of s is target but for `most` substitutions."""
    twice = F.concat(s, s)
    turn = F.sequence(F.lit(0), F.lit(len(target) - 1))
    return (F.length(s) == len(target)) & F.exists(turn, lambda k: hamming(F.substring(twice, k + 1, F.lit(len(target))), F.lit(target)) <= most)


def t_quantile(df: Column) -> Column:
    """The 0.975 quantile of Student's t, by the series in 1 / df around the normal quantile."""
    z = 1.959964
    first, second = (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96
    return F.lit(z) + F.lit(first) / df + F.lit(second) / (df * df)


def joined_label(*parts: Column) -> Column:
    return F.concat_ws("_", *[p.cast("string") for p in parts])
