"""Column expressions shared by the operators.  All of them stay inside codegen."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, reduce
from math import exp, isqrt, lgamma, log

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_finite(c: Column | str) -> Column:
    c = _c(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def in_range_or_null(c: Column | str, low: float, high: float) -> Column:
    c = _c(c)
    return F.when(is_finite(c) & c.between(low, high), c)


def below_or_null(c: Column | str, limit: float) -> Column:
    c = _c(c)
    return F.when(is_finite(c) & (F.abs(c) < limit), c)


def out_of_range(c: Column | str, low: float, high: float) -> Column:
    """TRUE for a missing, non-finite or out-of-range value (never NULL)."""
    c = _c(c)
    return ~F.coalesce(is_finite(c) & c.between(low, high), F.lit(False))


def epoch_second(ts: Column | str) -> Column:
    """Whole seconds since 1970 of a zone-less timestamp, independent of the session zone."""
    return F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), _c(ts))


def ratio(numerator: Column | str, denominator: Column | str, scale: float = 1.0) -> Column:
    """scale*n/d, NULL unless d > 0."""
    n, d = _c(numerator), _c(denominator)
    return F.when(d > 0, F.lit(scale) * n / d)


def zero(c: Column | str) -> Column:
    """NULL and non-finite values count as 0.0."""
    if isinstance(c, str):
        return F.expr(f"if(abs(cast({c} as double)) < double('Infinity'), cast({c} as double), 0D)")
    c = c.cast("double")
    return F.when(is_finite(c), c).otherwise(F.lit(0.0))


def counted_sql(name: str) -> str:
    """SQL text of an integer count as a double, NULL as 0 (text keeps wide plans cheap to build)."""
    return f"coalesce(cast({name} as double), 0D)"


def counted(name: str) -> Column:
    return F.expr(counted_sql(name))


def signed_log(c: Column | str) -> Column:
    c = _c(c).cast("double")
    return F.when(is_finite(c), F.signum(c) * F.log1p(F.abs(c)))


def clip(c: Column | str, low: Column | float, high: Column | float) -> Column:
    """Bounded value; a NULL input stays NULL (greatest/least would skip it)."""
    c = _c(c)
    lo = low if isinstance(low, Column) else F.lit(float(low))
    hi = high if isinstance(high, Column) else F.lit(float(high))
    return F.when(c.isNotNull(), F.least(F.greatest(c, lo), hi))


def magnitude(x: Column | str, y: Column | str, z: Column | str) -> Column:
    x, y, z = _c(x), _c(y), _c(z)
    return F.sqrt(x * x + y * y + z * z)


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius: float = 6371.0) -> Column:
    half = (F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0))
            + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
            * F.pow(F.sin(F.radians(lng2 - lng1) / 2), F.lit(2.0)))
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(F.lit(1.0), half)))


def circular_degrees(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.least(d, F.lit(360.0) - d)


def horizon_probability(hazard: Column | str, days: Column | str | int) -> Column:
    """1-(1-q)^d without cancellation."""
    d = F.lit(days) if isinstance(days, int) else _c(days)
    return -F.expm1(d * F.log1p(-_c(hazard)))


def sum_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0.0))


def seeded_hex(seed: int | str, *parts: Column | str) -> Column:
    """Hex text that orders or thresholds rows reproducibly on any engine with md5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[_c(p).cast("string") for p in parts]))


#: a draw for n entities is put together from draws for 512, 256, ..., 1 of them and for as many whole blocks as there are
POISSON_BLOCK = 1024


@cache
def poisson_steps(mean: int) -> tuple[int, tuple[str, ...]]:
    """Inverse Poisson distribution on eight hex digits: the least draw, and the digits from which on each further one counts."""
    total, first, steps = 0.0, 0, []
    for k in range(mean + 12 * isqrt(mean) + 10):
        total += exp(k * log(mean) - mean - lgamma(k + 1))
        step = int(total * 2**32)
        if step == 0:
            first = k + 1
        elif step < 2**32 - 1:
            steps.append(f"{step:08x}")
    return first, tuple(steps)


def poisson_draw(mean: int, hex_text: Column) -> Column:
    """Poisson(mean) from the first eight hex digits.

    The steps at or below them are counted by halving strides; the digits are bound once, since a hash inside the
    inner function would be taken again for every step.
    """
    first, steps = poisson_steps(mean)
    table = F.split(F.lit(",".join(steps)), ",")
    strides = F.array(*[F.lit(1 << k) for k in reversed(range(len(steps).bit_length()))])
    below = lambda head: F.aggregate(strides, F.lit(0), lambda at, s: at + F.when(F.get(table, at + s - 1) <= head, s).otherwise(0))
    return F.lit(first) + F.transform(F.array(F.substring(hex_text, 1, 8)), below)[0]


def poisson_one(hex_text: Column) -> Column:
    """Poisson(1) from the first eight hex digits, by comparisons alone."""
    _, steps = poisson_steps(1)
    head = F.substring(hex_text, 1, 8)
    return reduce(lambda rest, k: F.when(head < steps[k], k).otherwise(rest), reversed(range(len(steps))), F.lit(len(steps)))


def poisson_of(n: Column, hex_of: Callable[..., Column]) -> Column:
    """Poisson(n) for whole n >= 0, as the sum of independent draws whose means add up to n; exact for any n.

    ``hex_of()`` is the hash of a single entity's draw, ``hex_of(size)`` and ``hex_of(size, i)`` those of larger ones.
    """
    n = n.cast("long")
    draws = [F.when(n.bitwiseAND(size) > 0, poisson_draw(size, hex_of(F.lit(size)) if size > 1 else hex_of())).otherwise(0)
             for size in (1 << j for j in range(POISSON_BLOCK.bit_length() - 1))]
    blocks = F.shiftright(n, POISSON_BLOCK.bit_length() - 1)
    whole = F.aggregate(F.sequence(F.lit(1), blocks), F.lit(0).cast("long"),
                        lambda acc, i: acc + poisson_draw(POISSON_BLOCK, hex_of(F.lit(POISSON_BLOCK), i)).cast("long"))
    return reduce(lambda a, b: a + b, draws).cast("long") + F.when(blocks > 0, whole).otherwise(0)
