"""Queries over runs that were saved and loaded again, and over series with calendar steps."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomcast.operators import design as designs
from loomcast.plans.forecast_moments import DRAWS, drawn
from loomcast.plans.queries import _STEP, PANEL, SCALED, config, panel
from loomcast.plans.registry import query, read, sql, tidy
from loomcast.sources import artifacts, shared
from loomcast.sources import series as sources


@query(sql(f"""{PANEL}, {SCALED}, x AS (SELECT unique_id, any_value(n) AS n, any_value(y_mean) AS y_mean, sum(y) / count(*) AS mean, {DRAWS} AS draws, {sum(0.1 + 0.05 * d for d in range(DRAWS))!r} AS level FROM z GROUP BY 1)""",
    "unique_id", "n draws", "y_mean mean level", digits=4))
def q_saved_run(spark, sf_dir):
    """A run of every nation, saved twice (the second save takes the first one's place) and loaded again."""
    cfg = config()
    rows = panel(spark, sf_dir)
    state = designs.feature_state(rows, cfg)
    path = f"{shared.shared_dir(spark)}/run-{uuid.uuid4().hex}"
    artifacts.save(artifacts.Run(cfg, drawn(state).withColumn("beta", F.array(F.lit(0.0), F.lit(0.0))), state, rows), path)
    artifacts.save(artifacts.Run(cfg, drawn(state), state, rows), path, "overwrite")
    run = artifacts.load(spark, path)
    draws = run.posterior.groupBy("unique_id").agg(F.count("*").alias("draws"), F.sum(F.col("beta")[0]).alias("level"))
    means = run.series.groupBy("unique_id").agg(F.avg("y").alias("mean"))
    return tidy(run.state.select("unique_id", "n", "y_mean").join(draws, "unique_id").join(means, "unique_id"), 4)


_ENDS = """m AS (SELECT o_orderpriority AS unique_id, last_day(o_orderdate::DATE)::TIMESTAMP AS ds, sum(o_totalprice) AS y FROM orders GROUP BY ALL),
s AS (SELECT unique_id, row_number() OVER (PARTITION BY unique_id ORDER BY ds) - 1 AS t, ds, y FROM m)"""
_WORKING = """od AS (SELECT o_totalprice AS y, o_orderdate::DATE - greatest(isodow(o_orderdate) - 5, 0)::INT AS day FROM orders),
cal AS (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM od),
m AS (SELECT 'days' AS unique_id, day::TIMESTAMP AS ds, coalesce(sum(y), 0) AS y FROM cal LEFT JOIN od USING (day) WHERE isodow(day) < 6 GROUP BY ALL),
s AS (SELECT unique_id, row_number() OVER (PARTITION BY unique_id ORDER BY ds) - 1 AS t, ds, y FROM m)"""
_AHEAD = _STEP.replace("x AS (SELECT u.unique_id", "fq AS (SELECT u.unique_id")
STEPS = 30


def month_ends(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    sums = orders.groupBy(F.col("o_orderpriority").alias("unique_id"), F.last_day("o_orderdate").cast("timestamp").alias("ds")).agg(F.sum("o_totalprice").alias("y"))
    return sources.series(sums)


def working_days(spark, sf_dir):
    """Orders of each day from Monday to Friday, 0 where there are none; those of a weekend fall on the Friday before it."""
    day = F.date_sub(F.to_date("o_orderdate"), F.greatest(F.weekday("o_orderdate") - 4, F.lit(0)))
    sums = read(spark, sf_dir, "orders").groupBy(F.lit("days").alias("unique_id"), day.cast("timestamp").alias("ds")).agg(F.sum("o_totalprice").alias("y"))
    every = sources.densified(sums, step="INTERVAL 1 DAY").where(F.weekday("ds") < 5)
    return sources.series(every.fillna(0.0, ["y"]))


@query(sql(f"{_ENDS}, {_STEP}", "unique_id unit", "months seconds"))
def q_frequency_month_end(spark, sf_dir):
    return tidy(sources.frequency(month_ends(spark, sf_dir)))


@query(sql(f"{_WORKING}, {_STEP}", "unique_id unit", "months seconds"))
def q_frequency_business_day(spark, sf_dir):
    return tidy(sources.frequency(working_days(spark, sf_dir)))


def ahead(rows):
    steps = sources.frequency(rows)
    return tidy(designs.future_times(designs.feature_state(rows, config()), STEPS, steps).select("unique_id", "h", "ds"))


@query(sql(f"{_ENDS}, {_AHEAD}, k AS (SELECT unique_id, max(ds) AS ds FROM s GROUP BY 1), x AS (SELECT unique_id, h, last_day((date_trunc('month', ds) + to_months(((h + 1) * months)::INT))::DATE)::TIMESTAMP AS ds FROM k JOIN fq USING (unique_id), range({STEPS}) r(h))", "unique_id", "h", "", "ds"))
def q_future_month_ends(spark, sf_dir):
    return ahead(month_ends(spark, sf_dir))


@query(sql(f"""{_WORKING}, k AS (SELECT unique_id, max(ds)::DATE AS ds FROM s GROUP BY 1), a AS (SELECT unique_id, unnest(generate_series(ds + 1, ds + {2 * STEPS}, INTERVAL 1 DAY)) AS ds FROM k),
x AS (SELECT unique_id, row_number() OVER (PARTITION BY unique_id ORDER BY ds) - 1 AS h, ds::TIMESTAMP AS ds FROM a WHERE isodow(ds) < 6 QUALIFY h < {STEPS})""", "unique_id", "h", "", "ds"))  # fmt: skip
def q_future_business_days(spark, sf_dir):
    return ahead(working_days(spark, sf_dir))
