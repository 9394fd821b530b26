"""Helpers that the text operators share: tables, lineage cuts, Arrow batches, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def return_memory() -> None:
    """Have freed blocks of 4 MB or more go back to the system at once, Arrow's too.

    Spark keeps Python workers for later tasks.  By default each keeps some dozens of MB of the largest arrays that it
    has ever held.  Modules with functions for workers import this one, so that every worker has it.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such settings
        trim_threshold, mmap_threshold = -1, -3
        ctypes.CDLL(None).mallopt(mmap_threshold, 4 << 20)
        ctypes.CDLL(None).mallopt(trim_threshold, 32 << 20)


return_memory()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with underscores behind it until no column has it (whatever the case of letters)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def whole_key(df: DataFrame, key: str) -> Column:
    """The key as a long; a column that doesn't hold whole numbers is refused."""
    if not isinstance(df.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} must be a column of whole numbers, not {df.schema[key].dataType.simpleString()}")
    return F.col(key).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode (tests) one of our own."""
    here = spark.sparkContext.getCheckpointDir()
    if here is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomcast-ck-"))
        here = spark.sparkContext.getCheckpointDir()
    return here


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df written once as Parquet in the shared folder and read back, and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame) -> DataFrame:
    """df written once and read back: it survives lost executors and isn't computed twice.

    The shuffles behind it are then of no more use; a collection of garbage on the driver lets Spark delete their files.
    """
    out, _ = written(df)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that stores frames as `stored` does; at the end of the block their tables are deleted."""
    paths: list[str] = []

    def put(df: DataFrame) -> DataFrame:
        out, path = written(df)
        paths.append(path)
        return out

    try:
        yield put
    finally:
        for path in paths:
            forget(spark, path)
        spark.sparkContext._jvm.System.gc()


def forget(spark: SparkSession, path: str) -> None:
    """Delete a written folder through Hadoop, so that it works on any store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def short_batches(df: DataFrame) -> DataFrame:
    """df, after telling the session to send rows to Python in batches that stay small though texts be long."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return df


def slices(batches: Iterator[pa.RecordBatch], column: int, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `size` bytes of the text column, so that a task's memory stays flat."""
    for batch in batches:
        per_row = max(1, batch.column(column).nbytes // max(1, batch.num_rows))
        step = max(1, size // per_row)
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


EDGES = 500_000


def contracted(edges: DataFrame, tasks: int) -> DataFrame:
    """hi, lo: for the edges of each of so many tasks, every node with the smallest that it reaches by them."""

    def contract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = [f.to_numpy(np.int64) for f in frames]
        if pairs:
            e = np.concatenate(pairs)
            nodes, at = np.unique(e, return_inverse=True)
            at = at.reshape(e.shape)
            parts = Connected(len(nodes))
            parts.add(at[:, 0], at[:, 1])
            low = nodes[parts.root]
            yield pd.DataFrame({"hi": nodes[low < nodes], "lo": low[low < nodes]})

    return edges.coalesce(tasks).mapInPandas(contract, "hi long, lo long")


def components(edges: DataFrame, rounds: int = 60, keep: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """(node, root) for every node of edges(src, dst), root being the smallest node reachable; kept by `keep`.

    Edges are first contracted in blocks of about EDGES, one task for each.  If that takes several blocks, large-star and
    small-star passes over the edge list follow; both only group by node and take minima, which Spark combines before the
    shuffle, so a node with very many neighbours is no hot task.  Each pass is a table in the shared folder, which takes
    the place of the one before; once a table fits in a block, that block settles it.
    """
    spark = edges.sparkSession
    e, path = written(edges.where("src <> dst").select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).distinct())
    before = None
    for _ in range(rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        blocks = max(1, -(-now[0] // EDGES))
        one = contracted(e, blocks)
        if blocks == 1 or now == before:
            roots = (one if blocks == 1 else e.groupBy("hi").agg(F.min("lo").alias("lo"))).select(F.col("hi").alias("node"), F.col("lo").alias("root"))
            out = keep(roots.union(roots.select(F.col("root").alias("node"), "root").distinct()))
            forget(spark, path)
            return out
        before = now
        one, first = written(one)
        both = one.select(F.col("hi").alias("n"), F.col("lo").alias("m")).union(one.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        least = both.groupBy("n").agg(F.min("m").alias("x")).select("n", F.least("n", "x").alias("x"))
        large = both.join(least, "n").where("m > n").select(F.col("m").alias("hi"), F.col("x").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("x"))
        small = large.join(least, "hi").select(F.when(F.col("lo") == F.col("x"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("x").alias("lo"))
        e, last = written(small.where("hi <> lo").distinct())
        forget(spark, path)
        forget(spark, first)
        path = last
    raise RuntimeError("components: not settled")


def forest(link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of links that connect whatever all links connect; at most as many as rows and columns."""
    if link.sum() <= sum(link.shape):
        return np.nonzero(link)
    rows_left, cols_left = link.any(1), link.any(0)
    out_r, out_c = [], []
    while rows_left.any():
        front = np.array([rows_left.argmax()])
        rows_left[front] = False
        while len(front):
            sub = link[front]
            new = np.flatnonzero(sub.any(0) & cols_left)
            cols_left[new] = False
            out_r.append(front[sub[:, new].argmax(0)])
            out_c.append(new)
            sub = link[:, new]
            front = np.flatnonzero(sub.any(1) & rows_left) if len(new) else new
            rows_left[front] = False
            out_r.append(front)
            out_c.append(new[sub[front].argmax(1)] if len(front) else front)
    return np.concatenate(out_r), np.concatenate(out_c)


class Connected:
    """Which of n nodes are connected so far."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def add(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Connect u[k] with v[k]; the numbers k of links that do, one for each pair of parts that they join."""
        a, b = self.root[u], self.root[v]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        used = np.unique(lo * len(self.root) + hi, return_index=True)[1]
        used = used[lo[used] != hi[used]]
        while True:
            a, b = self.root[u], self.root[v]
            apart = a != b
            if not apart.any():
                return used
            np.minimum.at(self.root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = up


BROADCAST_ROWS = 500_000


def join_few(big: DataFrame, few: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """big joined with a stored frame of short rows: by broadcast up to BROADCAST_ROWS rows, else by a shuffle."""
    return big.join(F.broadcast(few) if few.count() <= BROADCAST_ROWS else few, key, how)


def join_hot(big: DataFrame, few: DataFrame, keys: list[str], rows: str) -> DataFrame:
    """big joined with few on keys, where few (a stored frame) has one row for each key and in `rows` how many of big have it.

    Keys that hold more than a fourth of an average partition's rows go by broadcast: by that share, they are at most four
    for each shuffle partition.  The others meet in a shuffle, in which no key is hot.  Null keys match nothing.
    """
    parts = 4 * int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = few.agg(F.sum(rows)).first()[0] or 0
    hot = F.col(rows) > max(1000, total / parts)
    frequent = F.broadcast(few.where(hot))
    cold = big.join(F.broadcast(few.where(hot).select(*keys)), keys, "left_anti").join(few.where(~hot), keys)
    return big.join(frequent, keys).unionByName(cold)
