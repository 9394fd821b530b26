"""The run store: versions, failed saves, pruned loads."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomcast.config import GenericConfig, ModelConfig, TrendConfig
from loomcast.sources import artifacts

CONFIG = ModelConfig(TrendConfig("linear"), generic=GenericConfig(()))


def run_of(spark, value, names=("a", "b", None, "ü/ä=1")):
    ids = spark.createDataFrame([(n,) for n in names], "unique_id string")
    posterior = ids.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("beta", F.array(F.lit(float(value))))
    return artifacts.Run(CONFIG, posterior, ids.withColumn("n", F.lit(3)), ids.withColumn("t", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("y", F.lit(float(value))))


def values(run):
    return {r[0] for r in run.series.select("y").distinct().collect()} | {r[0] for r in run.posterior.select(F.col("beta")[0]).distinct().collect()}


def test_versions(spark, tmp_path):
    path = str(tmp_path / "run")
    artifacts.save(run_of(spark, 1), path)
    with pytest.raises(FileExistsError):
        artifacts.save(run_of(spark, 2), path)
    artifacts.save(run_of(spark, 2), path, "ignore")
    old = artifacts.load(spark, path)
    assert values(old) == {1.0} and old.config == CONFIG and old.series.count() == 8 and set(old.posterior.columns) == {"unique_id", "draw", "beta"}
    artifacts.save(run_of(spark, 3), path, "overwrite")
    assert values(old) == {1.0}  # a reader keeps what it began with
    assert values(artifacts.load(spark, path)) == {3.0} and values(artifacts.load(spark, path, number=1)) == {1.0}
    with pytest.raises(FileNotFoundError):
        artifacts.load(spark, path, number=7)
    assert artifacts.vacuum(spark, path) == [1] and values(artifacts.load(spark, path)) == {3.0}
    assert len(list((tmp_path / "run/version").iterdir())) == 1
    with pytest.raises(ValueError, match="unknown mode"):
        artifacts.save(run_of(spark, 1), path, "append")


@pytest.mark.parametrize("table", ["posterior", "series"])
def test_a_failed_save_leaves_the_old_run(spark, tmp_path, table):
    path = str(tmp_path / "run")
    artifacts.save(run_of(spark, 1), path)
    bad = run_of(spark, 2)
    broken = getattr(bad, table).withColumn("unique_id", F.when(F.col("unique_id") == "b", F.raise_error(F.lit("lost"))).otherwise(F.col("unique_id")))
    with pytest.raises(Exception, match="lost"):
        artifacts.save(artifacts.Run(**{**bad.__dict__, table: broken}), path, "overwrite")
    assert values(artifacts.load(spark, path)) == {1.0} and len(artifacts.manifests(spark, path)) == 1
    artifacts.save(run_of(spark, 4), path, "overwrite")
    assert values(artifacts.load(spark, path)) == {4.0}


def test_a_first_save_that_fails_leaves_nothing_to_load(spark, tmp_path):
    bad = run_of(spark, 2)
    with pytest.raises(Exception, match="lost"):
        artifacts.save(artifacts.Run(bad.config, bad.posterior, bad.state, bad.series.withColumn("y", F.raise_error(F.lit("lost")).cast("double"))), str(tmp_path / "run"))
    assert artifacts.manifests(spark, str(tmp_path / "run")) == []


def test_two_saves_of_one_number_conflict(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "run")
    artifacts.save(run_of(spark, 1), path)
    monkeypatch.setattr(artifacts, "manifests", lambda *_: [])  # both began before either had committed
    with pytest.raises(Exception, match="(?i)already exists"):
        artifacts.save(run_of(spark, 2), path, "overwrite")
    monkeypatch.undo()
    assert values(artifacts.load(spark, path)) == {1.0}


def test_a_load_of_one_series_opens_its_files_only(spark, tmp_path):
    path = str(tmp_path / "run")
    names = [f"s{k}" for k in range(300)]
    artifacts.save(run_of(spark, 1, names), path)
    one = artifacts.load(spark, path, ["s7", "no such series"])
    mine = {Path(r[0].removeprefix("file:")).parent.name for r in one.series.select(F.input_file_name()).distinct().collect()}
    assert len(mine) == 1 and one.series.count() == 2
    lost = {f"{artifacts.BUCKET}={r[0]}" for r in spark.createDataFrame([("no such series",)], "s string").select(artifacts.bucket_of(F.col("s"), 10)).collect()}
    for folder in Path(path).glob(f"version/*/*/{artifacts.BUCKET}=*"):
        if folder.name not in mine | lost:
            for file in folder.glob("*.parquet"):
                file.write_bytes(b"not parquet")
    again = artifacts.load(spark, path, ["s7", "no such series"])
    assert again.posterior.count() == 3 and again.state.count() == 1 and values(again) == {1.0}
    with pytest.raises(Exception, match="(?i)parquet"):
        artifacts.load(spark, path).series.collect()


def test_empty_tables_and_the_earlier_layout(spark, tmp_path):
    empty = run_of(spark, 1)
    empty = artifacts.Run(CONFIG, empty.posterior.limit(0), empty.state.limit(0), empty.series.limit(0))
    artifacts.save(empty, str(tmp_path / "empty"))
    back = artifacts.load(spark, str(tmp_path / "empty"))
    assert back.posterior.count() == 0 and back.series.dtypes == empty.series.dtypes
    run, path = run_of(spark, 5), str(tmp_path / "plain")
    for name in artifacts.TABLES:
        getattr(run, name).write.parquet(f"{path}/{name}")
    from loomcast import config as settings

    spark.createDataFrame([(settings.to_json(CONFIG),)], "value string").coalesce(1).write.text(f"{path}/config")
    assert values(artifacts.load(spark, path)) == {5.0} and artifacts.load(spark, path, ["a"]).series.count() == 2
