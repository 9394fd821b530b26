"""Filter and smoother of linear Gaussian states over series of any length, by an associative scan.

A Kalman filter goes from row to row.  Written as products of elements that may be grouped at will (Sarkka and
Garcia-Fernandez, 2021), the rows of a range partition are first multiplied to one element, the elements of the partitions
are multiplied from left to right on the driver (one for each partition, a few numbers each), and then each partition goes
on from what lies before it.  The first row of a series forgets what came before, so that many short series share
partitions.  The moments are those of the sequential recursions.

The state of a row is coef[t] = phi coef[t - 1] + noise of variance q; it is seen as y = x . coef + noise of variance v.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomcast.operators.order_stats import with_facts
from loomcast.operators.ranges import PART, Ranges
from loomcast.sources.shared import stored

#: A sequence of elements: arrays whose first axis is the row.
Elements = tuple[np.ndarray, ...]
Join = Callable[[Elements, Elements], Elements]


def flipped(m: np.ndarray) -> np.ndarray:
    return np.swapaxes(m, -1, -2)


def times(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (m @ v[..., None])[..., 0]


def filter_elements(y: np.ndarray, x: np.ndarray, v: np.ndarray, q: np.ndarray, first: np.ndarray, phi: float, start: np.ndarray) -> Elements:
    """(A, b, C, eta, J) of each row; `start` is the variance of the state that the first row of a series is seen against
    (its mean is 0)."""
    d = x.shape[1]
    prior = np.where(first, start, q)[:, None]
    s = (prior * x * x).sum(1) + v
    gain = prior * x / s[:, None]
    left = np.eye(d) - gain[:, :, None] * x[:, None, :]
    go_on = np.where(first, 0.0, phi)
    a, b, c = go_on[:, None, None] * left, gain * y[:, None], left * prior[:, :, None]
    return a, b, (c + flipped(c)) / 2.0, (go_on * y / s)[:, None] * x, (go_on**2 / s)[:, None, None] * x[:, :, None] * x[:, None, :]


def filter_join(i: Elements, j: Elements) -> Elements:
    """Elements of rows i followed by those of rows j."""
    (ai, bi, ci, ei, ji), (aj, bj, cj, ej, jj) = i, j
    m = np.linalg.inv(np.eye(ai.shape[-1]) + ci @ jj)
    through, back = aj @ m, flipped(ai) @ flipped(m)
    c, both = through @ ci @ flipped(aj) + cj, back @ jj @ ai + ji
    return through @ ai, times(through, bi + times(ci, ej)) + bj, (c + flipped(c)) / 2.0, times(back, ej - times(jj, bi)) + ei, (both + flipped(both)) / 2.0


def smoother_elements(mean: np.ndarray, var: np.ndarray, q: np.ndarray, last: np.ndarray, phi: float) -> Elements:
    """(E, g, L) of each row from its filtered moments; q is the variance of the step that follows."""
    d = mean.shape[1]
    e = phi * var @ np.linalg.inv(phi * phi * var + q[:, None, None] * np.eye(d))
    e[last] = 0.0
    rest = var - phi * e @ var
    return e, mean - phi * times(e, mean), (rest + flipped(rest)) / 2.0


def smoother_join(later: Elements, row: Elements) -> Elements:
    """Elements of later rows, to which an earlier one is added; rows come in reverse order."""
    (ej, gj, lj), (ei, gi, li) = later, row
    return ei @ ej, times(ei, gj) + gi, ei @ lj @ flipped(ei) + li


def scanned(e: Elements, join: Join) -> Elements:
    """Products of the first row, the first two, and so on, in about log(n) vectorised steps and 2 n products."""
    n = len(e[0])
    if n == 1:
        return e
    pairs = scanned(join(tuple(x[0 : n - 1 : 2] for x in e), tuple(x[1::2] for x in e)), join)
    out = tuple(np.empty_like(x) for x in e)
    for o, x, p in zip(out, e, pairs):
        o[0], o[1::2] = x[0], p
    if n > 2:
        rest = join(tuple(p[: (n - 1) // 2] for p in pairs), tuple(x[2::2] for x in e))
        for o, r in zip(out, rest):
            o[2::2] = r
    return out


def total(e: Elements, join: Join) -> Elements:
    """The product of all rows, as one."""
    while len(e[0]) > 1:
        n = len(e[0])
        pairs = join(tuple(x[0 : n - 1 : 2] for x in e), tuple(x[1::2] for x in e))
        e = tuple(np.concatenate([p, x[n - 1 :]]) if n % 2 else p for p, x in zip(pairs, e))
    return e


Read = Callable[[pa.RecordBatch], Elements]
Give = Callable[[pa.RecordBatch, Elements], list[pa.Array]]


def runs_of(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """A batch in slices of one partition each."""
    part = batch.column(batch.schema.get_field_index("_part")).to_numpy()
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), len(part)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield int(part[a]), batch.slice(a, b - a)


def over(rows: DataFrame, read: Read, join: Join, give: Give, schema: T.StructType) -> DataFrame:
    """rows (with _part and _at) in order, each with the product of all elements up to its own, as `give` makes of it."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Elements] = {}
        for batch in batches:
            for part, run in runs_of(batch):
                e = total(read(run), join)
                held[part] = join(held[part], e) if part in held else e
        for part, e in held.items():
            columns = [pa.array([part], pa.int64()), pa.array([e[0].shape[-1]], pa.int32()), pa.array([[x.ndim - 1 for x in e]], pa.list_(pa.int32())), pa.array([np.concatenate([x.ravel() for x in e])], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["_part", "d", "ranks", "e"])

    ordered = rows.repartition("_part").sortWithinPartitions("_part", "_at")
    found = sorted(ordered.mapInArrow(totals, "_part long, d int, ranks array<int>, e array<double>").collect())  # a row for each partition
    before: dict[int, Elements] = {}
    state: Elements | None = None
    for part, d, ranks, flat in found:
        if state is not None:
            before[part] = state
        ends = np.cumsum([d**rank for rank in ranks])
        e = [x.reshape((1, *(d,) * rank)) for x, rank in zip(np.split(np.array(flat), ends[:-1]), ranks)]
        state = tuple(e) if state is None else join(state, tuple(e))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: dict[int, Elements] = {}
        for batch in batches:
            for part, rows_of in runs_of(batch):
                e = scanned(read(rows_of), join)
                state = here.get(part, before.get(part))
                if state is not None:
                    e = join(tuple(np.repeat(x, len(e[0]), axis=0) for x in state), e)
                here[part] = tuple(x[-1:] for x in e)
                yield pa.RecordBatch.from_arrays(give(rows_of, e), schema=arrow)

    return ordered.mapInArrow(run, schema)


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def listed(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """An array column as a matrix."""
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def arrays(m: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(m.reshape(len(m), -1))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))


def kalman_filter(rows: DataFrame, by: Sequence[str], order: Sequence[str], y: Column, x: Column, v: Column, q: Column, phi: float = 1.0, start: Column | float = 100.0, part: int = PART) -> DataFrame:
    """by, t, x, q, mean and var: the filtered moments of every row, var by rows of the matrix.

    x is an array of the same width in all rows; q may depend on the series only; `start` is the variance of each
    coefficient that the first row of a series is seen against.  t is the place of a row in its series.
    """
    start = start if isinstance(start, Column) else F.lit(float(start))
    places = [f"_order{k}" for k in range(len(order))]
    facts = rows.select(*by, *(F.col(c).alias(p) for c, p in zip(order, places)), y.cast("double").alias("y"), x.cast("array<double>").alias("x"), v.cast("double").alias("v"), q.cast("double").alias("q"), start.cast("double").alias("start"))
    ready = stored(Ranges(facts, by, places, part).ranked("t", places=True))
    schema = T.StructType([*(facts.schema[c] for c in by), T.StructField("t", T.LongType()), facts.schema["x"], facts.schema["q"], T.StructField("mean", T.ArrayType(T.DoubleType())), T.StructField("var", T.ArrayType(T.DoubleType()))])

    def read(b: pa.RecordBatch) -> Elements:
        return filter_elements(column(b, "y"), listed(b, "x"), column(b, "v"), column(b, "q"), column(b, "t") == 0, phi, column(b, "start"))

    def give(b: pa.RecordBatch, e: Elements) -> list[pa.Array]:
        return [*(b.column(b.schema.get_field_index(c)) for c in by), pa.array(column(b, "t")), b.column(b.schema.get_field_index("x")), pa.array(column(b, "q")), arrays(e[1]), arrays(e[2])]

    return over(ready.select(*by, "t", "y", "x", "v", "q", "start", "_part", "_at"), read, filter_join, give, schema)


def smoother(filtered: DataFrame, by: Sequence[str], phi: float = 1.0, part: int = PART) -> DataFrame:
    """by, t, x, mean and var: the moments of every row given all rows of its series, from those of kalman_filter."""
    fixed = stored(filtered)
    last = fixed.groupBy(*by).agg(F.max("t").alias("_last"))
    turned = with_facts(fixed, last, by).withColumn("_back", F.col("_last") - F.col("t")).drop("_last")
    ready = stored(Ranges(turned, by, ["_back"], part).ranked("_rank", places=True))
    schema = T.StructType([*(fixed.schema[c] for c in by), T.StructField("t", T.LongType()), fixed.schema["x"], T.StructField("mean", T.ArrayType(T.DoubleType())), T.StructField("var", T.ArrayType(T.DoubleType()))])

    def read(b: pa.RecordBatch) -> Elements:
        m = listed(b, "mean")
        return smoother_elements(m, listed(b, "var").reshape(len(m), m.shape[1], -1), column(b, "q"), column(b, "_back") == 0, phi)

    def give(b: pa.RecordBatch, e: Elements) -> list[pa.Array]:
        return [*(b.column(b.schema.get_field_index(c)) for c in by), pa.array(column(b, "t")), b.column(b.schema.get_field_index("x")), arrays(e[1]), arrays(e[2])]

    return over(ready.select(*by, "t", "x", "q", "mean", "var", "_back", "_part", "_at"), read, smoother_join, give, schema)
