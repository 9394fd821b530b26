"""Every registered query that has SQL against DuckDB, on the smallest tables; the others run and have rows."""

import os

import duckdb
import pandas as pd
import pytest

from loomcast.plans import closed_forms, forecast_moments, long_series, registry, state_space, stored_runs, studies, tree_search  # noqa: F401
from loomcast.plans import queries as series_queries

SQL = registry.oracle_sql()


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)].astype(object)
    clean = [tuple(None if x is None or x != x else x.item() if hasattr(x, "item") else x for x in r) for r in frame.itertuples(index=False, name=None)]
    return sorted(repr(tuple(x + 0.0 if isinstance(x, float) else x for x in r)) for r in clean)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(sf):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(name, spark, sf, duck):
    ours, theirs = registry.queries()[name](spark, sf).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", ["fit_trend_panel", "forecast_panel_full", "girf_monthly", "importance_panel", "synthetic_trials"])
def test_runs(name, spark, sf, monkeypatch):
    monkeypatch.setattr(series_queries, "SCHEDULE", {"num_gfr": 2, "num_burnin": 5, "num_mcmc": 10})  # the plans, in short
    assert registry.queries()[name](spark, sf).head(1)


def test_recovery_study_has_all_scores(spark):
    got = studies.recovery(spark, trials=1, schedule=(1, 2, 8)).toPandas()
    assert sorted(zip(got["process"], got["component"])) == sorted((k, c) for k in range(1, 7) for c in ("forecast", "trend", "seasonal", "generic"))
    assert got["rmse"].notna().all() and got.loc[got.component == "forecast", "crps"].between(0, 20).all()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).head(1)


def test_entry_without_text_operators(monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    class Hidden:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("loomcast.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    gone = [m for m in sys.modules if m.startswith("loomcast.llm")]
    for m in gone:
        monkeypatch.delitem(sys.modules, m)
    import loomcast

    monkeypatch.delattr(loomcast, "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Hidden(), *sys.meta_path])
    entry = importlib.reload(__spark_entry__)
    assert entry.queries() and not any(k.startswith("op") for k in entry.queries())
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
