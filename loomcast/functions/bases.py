"""Feature bases as Column expressions.  All stay in the JVM; arrays are array<double>."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomcast.config import SeasonalPeriod


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use refers to it."""
    return F.transform(F.array(value), use)[0]


def doubles(*values: Column | float) -> Column:
    return F.array(*((v if isinstance(v, Column) else F.lit(v)).cast("double") for v in values))


def scale(n: Column) -> Column:
    """What t is divided by: n - 1, or 1 for a series of one row."""
    return F.greatest(n - 1, F.lit(1)).cast("double")


def polynomial(u: Column, degree: int) -> Column:
    """1, u, ..., u^degree."""
    return doubles(1.0, *(F.pow(u, F.lit(float(d))) for d in range(1, degree + 1)))


def tree_trend(u: Column) -> Column:
    return doubles(u, u * u)


def knots(lo: Column, hi: Column, count: int, degree: int) -> Column:
    """count evenly spaced knots from lo to hi, with both ends repeated degree more times."""
    step = (hi - lo) / float(max(count - 1, 1))
    inner = [lo + step * float(k) for k in range(count - 1)] + [hi] if count > 1 else [lo]
    return doubles(*[lo] * degree, *inner, *[hi] * degree)


def bspline(x: Column, at: Column, count: int, degree: int) -> Column:
    """The count + degree - 1 B-spline values of x clamped to the knots `at`, by the Cox-de Boor recursion.

    The last interval is closed, so the values sum to 1 at the right end too.
    """
    total = count + 2 * degree
    last = F.element_at(at, -1)

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b == 0.0, 0.0).otherwise(a / b)

    def recurse(u: Column) -> Column:
        def level(d: int, below: Column) -> Column:
            if d > degree:
                return below

            def value(i: Column) -> Column:
                left = ratio(u - F.get(at, i), F.get(at, i + d) - F.get(at, i)) * F.get(below, i)
                right = ratio(F.get(at, i + d + 1) - u, F.get(at, i + d + 1) - F.get(at, i + 1)) * F.get(below, i + 1)
                return left + right

            return let(F.transform(F.sequence(F.lit(0), F.lit(total - d - 2)), value), lambda b: level(d + 1, b))

        def inside(i: Column) -> Column:
            open_ = (u >= F.get(at, i)) & (u < F.get(at, i + 1))
            end = (u == last) & (F.get(at, i) < F.get(at, i + 1)) & (F.get(at, i + 1) == last)
            return F.when(open_ | end, 1.0).otherwise(0.0)

        return let(F.transform(F.sequence(F.lit(0), F.lit(total - 2)), inside), lambda b: level(1, b))

    return let(F.least(F.greatest(x, at[0]), last), recurse)


def spline_trend(u: Column, at: Column, count: int, degree: int) -> Column:
    """1, u and the B-splines but the first."""
    splines = bspline(u, at, count, degree)
    return F.concat(doubles(1.0, u), F.slice(splines, 2, count + degree - 2))


def fourier(t: Column, periods: Sequence[SeasonalPeriod]) -> Column:
    """sin and cos of each harmonic of each period over the row number, to 12 digits.

    Rows that are whole periods apart then have the same value, so that trees don't split on rounding noise.
    """
    angles = [t.cast("double") * F.lit(2.0 * math.pi * k / p.period) for p in periods for k in range(1, p.harmonics + 1)]
    return doubles(*(F.round(f(a), 12) for a in angles for f in (F.sin, F.cos)))


def fourier_names(periods: Sequence[SeasonalPeriod]) -> list[str]:
    return [f"{f}_p{p.period:g}_k{k}" for p in periods for k in range(1, p.harmonics + 1) for f in ("sin", "cos")]


#: Calendar fields; weeks begin on Monday, which is day 0, and are numbered as in ISO 8601.
CALENDAR: dict[str, Callable[[Column], Column]] = {
    "month": F.month,
    "dayofweek": F.weekday,
    "hour": F.hour,
    "quarter": F.quarter,
    "dayofyear": F.dayofyear,
    "week": F.weekofyear,
}


def one_hot(value: Column, levels: Column) -> Column:
    """A 0/1 double for each of the sorted levels but the last; all zeros for a level not among them."""
    return F.transform(F.slice(levels, 1, F.greatest(F.size(levels) - 1, F.lit(0))), lambda v: (value == v).cast("double"))


def centred(x: Column, means: Column) -> Column:
    return F.zip_with(x, means, lambda a, m: a - m)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)


# Trees are arrays of nodes: struct<feat int, thresh double, left int, right int, value double>; feat -1 marks a leaf and
# node 0 is the root.
NODE = "struct<feat:int,thresh:double,left:int,right:int,value:double>"


def tree_value(nodes: Column, x: Column) -> Column:
    """The leaf value that x reaches, going left where x[feat] <= thresh."""

    def step(at: Column, _: Column) -> Column:
        return let(F.get(nodes, at), lambda n: F.when(n["feat"] < 0, at).when(F.get(x, n["feat"]) <= n["thresh"], n["left"]).otherwise(n["right"]))

    leaf = F.aggregate(nodes, F.lit(0), step)  # as many steps as nodes are enough; leaves stay where they are
    return F.get(nodes, leaf)["value"]


def forest_value(trees: Column, x: Column) -> Column:
    return F.aggregate(trees, F.lit(0.0), lambda s, nodes: s + tree_value(nodes, x))


def split_count(trees: Column, feature: Column) -> Column:
    """How often the trees split on a feature."""
    each = lambda s, nodes: s + F.size(F.filter(nodes, lambda n: n["feat"] == feature))
    return F.aggregate(trees, F.lit(0), each)
