"""A store of fitted runs: versions of Parquet tables, of which a manifest makes one current.

A save writes its tables to a folder of a new version, which nobody reads yet.  Writing the manifest, one small file, is the
commit: readers take the manifest with the highest number.  A save that fails on the way leaves the runs before it as they
were, and a reader keeps the version that it began with.  Tables are partitioned by a hash of the series, so that a load of
a few series opens their files only.  Any store that Spark reaches will do.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomcast import config as settings

TABLES = ("posterior", "state", "series")
BUCKET = "_bucket"
#: Series in a bucket, and buckets at most.
SERIES_IN_BUCKET, BUCKETS = 32, 4096


@dataclass(frozen=True)
class Run:
    config: settings.ModelConfig
    posterior: DataFrame
    state: DataFrame
    series: DataFrame


def bucket_of(unique_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(unique_id), F.lit(buckets)).cast("int")


def manifests(spark: SparkSession, path: str) -> list[dict]:
    """The committed versions below path, the current one last."""
    try:
        rows = spark.read.text(f"{path}/manifest/*", wholetext=True).collect()  # a short text for each version
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted((json.loads(r.value) for r in rows), key=lambda m: m["number"])


def save(run: Run, path: str, mode: str = "errorifexists") -> None:
    """Write posterior (forests included), state, series and config as a new version below path, and make it the current one.

    mode: errorifexists (a run there is an error), overwrite (it becomes an old version), ignore (it is left as it is).
    """
    if mode not in ("error", "errorifexists", "overwrite", "ignore"):
        raise ValueError(f"unknown mode {mode!r}")
    spark = run.state.sparkSession
    before = manifests(spark, path)
    if before and mode == "ignore":
        return
    if before and mode != "overwrite":
        raise FileExistsError(f"there is a run at {path}")
    version, number = uuid.uuid4().hex, before[-1]["number"] + 1 if before else 1
    buckets = max(1, min(BUCKETS, math.ceil(run.state.count() / SERIES_IN_BUCKET)))
    entry = {"number": number, "version": version, "buckets": buckets, "config": settings.to_json(run.config), "schemas": {}}
    for name in TABLES:
        table: DataFrame = getattr(run, name)
        entry["schemas"][name] = table.schema.json()
        dealt = table.withColumn(BUCKET, bucket_of(F.col("unique_id"), buckets))
        dealt.repartition(BUCKET, F.pmod(F.xxhash64("unique_id"), F.lit(SERIES_IN_BUCKET))).write.partitionBy(BUCKET).parquet(f"{path}/version/{version}/{name}")
    manifest = spark.createDataFrame([(json.dumps(entry),)], "value string").coalesce(1)
    manifest.write.text(f"{path}/manifest/{number:09d}")  # the commit; fails if another save has taken the number


def load(spark: SparkSession, path: str, series: Sequence[str] | None = None, number: int | None = None) -> Run:
    """The current run below path, or that of a number; of some series only, if they are given."""
    known = manifests(spark, path)
    if not known:
        return _plain(spark, path, series)
    entry = known[-1] if number is None else next((m for m in known if m["number"] == number), None)
    if entry is None:
        raise FileNotFoundError(f"there is no version {number} at {path}")
    wanted = None
    if series is not None:
        names = spark.createDataFrame([(s,) for s in dict.fromkeys(series)], "unique_id string")
        wanted = sorted({r[0] for r in names.select(bucket_of(F.col("unique_id"), entry["buckets"])).collect()})

    def read(name: str) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(entry["schemas"][name]))
        table = spark.read.schema(T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(f"{path}/version/{entry['version']}/{name}")
        if wanted is not None:
            table = table.where(F.col(BUCKET).isin(wanted) & F.col("unique_id").isin(list(series)))
        return table.drop(BUCKET)

    return Run(settings.from_json(entry["config"]), *map(read, TABLES))


def _plain(spark: SparkSession, path: str, series: Sequence[str] | None) -> Run:
    """A run of the earlier layout, without versions."""
    text = spark.read.text(f"{path}/config", wholetext=True).first()[0]
    tables = [spark.read.parquet(f"{path}/{name}") for name in TABLES]
    return Run(settings.from_json(text.strip()), *(t if series is None else t.where(F.col("unique_id").isin(list(series))) for t in tables))


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[int]:
    """Delete all but the last `keep` committed versions; their numbers.  Nobody should be reading them."""
    old = manifests(spark, path)[: -keep if keep else None]
    for m in old:  # the manifest first, so that no reader begins with what is about to go
        for folder in (f"{path}/manifest/{m['number']:09d}", f"{path}/version/{m['version']}"):
            where = spark._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return [m["number"] for m in old]
