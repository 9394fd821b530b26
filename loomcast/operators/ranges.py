"""Order within groups of any size: range partitions, places from their sizes, and halos between neighbours.

A window over a group puts the whole group into one task.  Here rows are sorted by (group, order) over range partitions, so
that a group of any size lies in as many partitions as it needs.  What a partition has to know of those before it is one
row (its first place, where its first group begins, the totals of that group so far); the driver works these out from a
row for each partition, and they go back by broadcast.  Lags reach back over a halo: copies of the last rows before a
partition.  No task holds more than a partition and its halo.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomcast.sources.shared import stored

#: Rows of a partition, on average; and so many are worth one of the session's partitions.
PART, WORTH = 1 << 20, 4096
INDEX = (1 << 33) - 1  # monotonically_increasing_id holds the partition above its lower 33 bits


class Ranges:
    """Rows sorted by (by, order) over range partitions: `rows` with _part and _at, the place in the whole order from 0."""

    def __init__(self, df: DataFrame, by: Sequence[str], order: Sequence[str], part: int = PART) -> None:
        """order: columns, ascending with nulls first.  Rows that are equal in by and order follow each other in any order.

        Equal rows don't pile up in one partition: a number of their own breaks ties last.
        """
        spark = df.sparkSession
        self.by, self.columns = list(by), df.columns
        numbered = df.withColumn("_tie", F.monotonically_increasing_id())
        rows = df.count()
        n = max(1, math.ceil(rows / part), min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / WORTH)))
        keys = [*by, *order, "_tie"]
        laid = numbered.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("_tie")
        self._laid = stored(laid.withColumn("_id", F.monotonically_increasing_id()))
        self._laid = self._laid.withColumn("_part", F.shiftright("_id", 33)).withColumn("_index", F.col("_id").bitwiseAND(F.lit(INDEX)))
        ends, at, self._parts = self.totals({}), 0, []
        for e in ends:  # one row for each partition
            self._parts.append({"part": e["_part"], "first": at, "stop": at + e["n"]})
            at += e["n"]
        self.count = at
        begin, last = 0, None
        for p, e in zip(self._parts, ends):
            p["begin"] = begin if e["head"] == last else p["first"]
            begin = p["begin"] if e["tail"]["key"] == e["head"] and e["tail"]["a"] == 0 else p["first"] + e["tail"]["a"]
            last = e["tail"]["key"]
        firsts = spark.createDataFrame([(p["part"], p["first"]) for p in self._parts], "_part long, _first long")
        self.rows = self._laid.join(F.broadcast(firsts), "_part").select(*self.columns, "_part", (F.col("_first") + F.col("_index")).alias("_at"))

    def _key(self) -> Column:
        return F.struct(*self.by) if self.by else F.struct(F.lit(0).alias("one"))

    def totals(self, aggregates: Mapping[str, Column]) -> list:
        """Of each partition, in order: its rows (n), its first group (head), and of its last group (tail) the key, where
        it begins in the partition (a) and the aggregates of its rows.  One row for each partition comes to the driver."""
        each = self._laid.groupBy("_part", self._key().alias("key")).agg(F.min("_index").alias("a"), F.count("*").alias("c"), *(v.alias(k) for k, v in aggregates.items()))
        ends = each.groupBy("_part").agg(F.sum("c").alias("n"), F.min_by("key", "a").alias("head"), F.max_by(F.struct("key", "a", *aggregates), "a").alias("tail"))
        return sorted(ends.collect(), key=lambda r: r["_part"])

    def carried(self, aggregates: Mapping[str, Column], join: Callable[[list, list], list], start: list) -> dict[int, list]:
        """For each partition, what the rows of its first group in earlier partitions amount to: their aggregates put
        together from left to right by `join`, which must be associative; `start` where there are none."""
        found, total, last = {}, start, None
        for e in self.totals(aggregates):
            found[e["_part"]] = total if e["head"] == last else start
            own = [e["tail"][k] for k in aggregates]
            goes_on = e["tail"]["key"] == e["head"] and e["tail"]["a"] == 0
            total, last = join(found[e["_part"]], own) if goes_on else join(start, own), e["tail"]["key"]
        return found

    def with_halo(self, rows: DataFrame, most: int) -> DataFrame:
        """rows with _halo false, and copies of the `most` rows before each partition, moved to it, with _halo true."""
        following, parts = [], self._parts
        for k, p in enumerate(parts):  # mostly the next partition alone; more where partitions have fewer rows than most
            for q in parts[k + 1 :]:
                if q["first"] - most >= p["stop"]:
                    break
                following.append((p["part"], q["part"], q["first"]))
        own = rows.withColumn("_halo", F.lit(False))
        if not following or not most:
            return own
        to = rows.sparkSession.createDataFrame(following, "_part long, _to long, _before long")
        copies = rows.join(F.broadcast(to), "_part").where(F.col("_at") >= F.col("_before") - most)
        return own.unionByName(copies.select(*(F.col("_to").alias("_part") if c == "_part" else F.col(c) for c in rows.columns), F.lit(True).alias("_halo")))

    def ranked(self, rank: str = "t", lags: Mapping[str, tuple[str, int]] | None = None, places: bool = False) -> DataFrame:
        """The columns with `rank`, the place of a row in its group from 0, and each of lags: a column so many rows back
        in the group, null where there is none.  With places, _part and _at too."""
        lags = lags or {}
        rows = self.with_halo(self.rows, max((k for _, k in lags.values()), default=0))
        begins = rows.sparkSession.createDataFrame([(p["part"], p["begin"]) for p in self._parts], "_part long, _begin long")
        w = Window.partitionBy("_part").orderBy("_at")
        key, before = self._key(), F.lag(self._key()).over(w)
        marked = rows.select("*", F.when(before.isNotNull() & ~key.eqNullSafe(before), F.col("_at")).alias("_new"), *(F.lag(c, k).over(w).alias(f"_lag_{name}") for name, (c, k) in lags.items()))
        marked = marked.withColumn("_new", F.max("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(~F.col("_halo"))
        t = F.col("_at") - F.coalesce("_new", "_begin")
        back = [F.when(t >= k, F.col(f"_lag_{name}")).alias(name) for name, (_, k) in lags.items()]
        return marked.join(F.broadcast(begins), "_part").select(*self.columns, t.alias(rank), *back, *(("_part", "_at") if places else ()))

    def running(self, sums: Mapping[str, Column], rank: str = "t") -> DataFrame:
        """The columns, rank, and for each of sums its total over the rows of the group up to this one."""
        names = list(sums)
        before = self.carried({k: F.sum(v) for k, v in sums.items()}, lambda a, b: [x + (y or 0.0) for x, y in zip(a, b)], [0.0] * len(names))
        facts = [(p["part"], p["begin"], *map(float, before[p["part"]])) for p in self._parts]
        carry = self.rows.sparkSession.createDataFrame(facts, ", ".join(["_part long, _begin long", *(f"_before_{k} double" for k in names)]))
        w = Window.partitionBy("_part").orderBy("_at")
        key, last = self._key(), F.lag(self._key()).over(w)
        marked = self.rows.withColumn("_new", F.when(last.isNotNull() & ~key.eqNullSafe(last), F.col("_at")))
        marked = marked.withColumn("_new", F.max("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        inner = Window.partitionBy("_part", "_new").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        totals = marked.select("*", *(F.sum(v).over(inner).alias(f"_sum_{k}") for k, v in sums.items())).join(F.broadcast(carry), "_part")
        first = F.col("_new").isNull()
        full = [(F.coalesce(f"_sum_{k}", F.lit(0.0)) + F.when(first, F.col(f"_before_{k}")).otherwise(0.0)).alias(k) for k in names]
        return totals.select(*self.columns, (F.col("_at") - F.coalesce("_new", "_begin")).alias(rank), *full)


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], rank: str = "t", part: int = PART) -> DataFrame:
    """df with the place of each row in its group, from 0.  A group may be of any size."""
    return Ranges(df, by, order, part).ranked(rank)
