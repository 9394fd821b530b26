"""Where queries are registered with their SQL, and how both sides tidy their results.

Doubles are rounded on both sides, after aggregation; counts are long; times are text.  A mean of short decimals may lie
half-way between two rounded values, where the order of a sum decides, so both sides first move it up by NUDGE.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
NUDGE = 1e-9
FOUND: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        FOUND[f.__name__] = (f, sql)
        return f

    return add


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, whole numbers long, times as text."""

    def one(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind == "double":
            return (F.round(c + F.lit(NUDGE), digits) + F.lit(0.0)).alias(name)
        if kind in ("int", "bigint", "smallint", "tinyint"):
            return c.cast("long").alias(name)
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name) if kind.startswith("timestamp") else c

    return df.select(*(one(n, k) for n, k in df.dtypes))


def sql(inner: str, text: str = "", whole: str = "", real: str = "", time: str = "", digits: int = 6) -> str:
    """A statement whose last SELECT is `FROM x`: its columns by kind, tidied as in tidy()."""
    columns = [*text.split(), *(f"CAST({c} AS BIGINT) AS {c}" for c in whole.split()), *(f"round({c} + {NUDGE!r}, {digits}) + 0e0 AS {c}" for c in real.split())]
    columns += [f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in time.split()]
    return f"WITH {inner} SELECT {', '.join(columns)} FROM x"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in FOUND.items() if text}
