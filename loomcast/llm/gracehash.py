"""Exact duplicates by Grace hash: records go to buckets until each fits a table that compares complete contents.

A task first runs its own rows through an open-addressing table of bounded size, so that a group of copies leaves one
record for each table, however many copies there are.  Those records are dealt to buckets by their hash.  A bucket that
fits in a table is settled there; one that doesn't is dealt again by the next hash, and its records also by a number of
their own, so that the records of one content are merged by several tables before they meet.  What decides is always the
comparison of complete contents; hashes only say where to look.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcast.llm.common import scratch, short_batches, slices, stored, whole_key

BLANKS = b" \t\n\x0b\x0c\r"
HELD = 32 << 20  # bytes of contents in a table
RECORD = 64  # bytes that count for a record besides its content
Digest = Callable[[bytes], bytes]


def sha256(content: bytes) -> bytes:
    return hashlib.sha256(content).digest()


class Table:
    """Distinct contents by open addressing with linear probing; entries are compared in full."""

    def __init__(self) -> None:
        self.slots, self.mask = [-1] * 64, 63
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.held = 0

    def find(self, h: int, content: bytes) -> int:
        """The number of the content's entry, which is added if there is none."""
        at = h & self.mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                return entry
            at = (at + 1) & self.mask
        entry = self.slots[at] = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.held += len(content) + RECORD
        if 3 * len(self.hashes) > 2 * len(self.slots):
            self._grow()
        return entry

    def _grow(self) -> None:
        self.mask = 2 * len(self.slots) - 1
        self.slots = [-1] * (self.mask + 1)
        for entry, h in enumerate(self.hashes):
            at = h & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = entry


def address(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little")


#: How rows of one content are ranked: most code points, then the smallest key (null last), then the first row.
Best = tuple[int, bool, int, int]


def best(chars: int, key: int | None, row: int) -> Best:
    return -chars, key is None, key or 0, row


ROWS = pa.schema([("row", pa.int64()), ("key", pa.int64()), ("chars", pa.int64()), ("sha", pa.binary()), ("token", pa.int64()), ("digest", pa.binary()), ("content", pa.binary()), ("n", pa.int64())])
ROWS_SQL = "row long, key long, chars long, sha binary, token long, digest binary, content binary, n long"
FOUND = pa.schema([("token", pa.int64()), ("up", pa.int64()), ("key", pa.int64()), ("chars", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("content", pa.binary())])
FOUND_SQL = "token long, up long, key long, chars long, row long, n long, digest binary, content binary"


def batch_of(schema: pa.Schema, columns: dict[str, list]) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * size), f.type) for f in schema], schema=schema)


def merged(digest: Digest, held: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (key, chars, text as bytes) to a row for each, with the token of its content in the task's table, and a record
    for each content of a table: its best row, how many it has, and the content.  A table that is full is handed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        table, tokens, tops, counts, marks = Table(), [], [], [], []

        def records() -> Iterator[pa.RecordBatch]:
            step = max(1, len(tokens) * (4 << 20) // max(1, table.held))
            for at in range(0, len(tokens), step):
                part = slice(at, at + step)
                yield batch_of(ROWS, {"token": tokens[part], "digest": marks[part], "content": table.contents[part], "n": counts[part], "chars": [-t[0] for t in tops[part]], "key": [None if t[1] else t[2] for t in tops[part]], "row": [t[3] for t in tops[part]]})

        for batch in slices(batches, 2):
            keys, lengths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: dict[str, list] = {"row": [], "key": keys, "chars": lengths, "sha": [], "token": []}
            for key, chars, text in zip(keys, lengths, batch.column(2).to_pylist()):
                content = text.translate(None, BLANKS)
                sha = sha256(content)
                mark = sha if digest is sha256 else digest(content)
                entry, top = table.find(address(mark), content), best(chars, key, row)
                if entry == len(tokens):
                    tokens.append(row)
                    tops.append(top)
                    counts.append(1)
                    marks.append(mark)
                else:
                    counts[entry] += 1
                    tops[entry] = min(tops[entry], top)
                for name, value in (("row", row), ("sha", sha), ("token", tokens[entry])):
                    out[name].append(value)
                row += 1
                if table.held >= held:
                    yield from records()
                    table, tokens, tops, counts, marks = Table(), [], [], [], []
            yield batch_of(ROWS, out)
        yield from records()

    return run


def settled(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of a bucket, or of one of the deals of a bucket that is too large: a row for each with the token (up)
    of the content it was merged into, and what is known of that; in deals that merge only, contents go on once each."""
    last = key[-1].as_py()
    table, tops, counts, ups, tokens, entries, marks = Table(), [], [], [], [], [], []
    for batch in batches:
        cols = {c: batch.column(c).to_pylist() for c in ("token", "digest", "content", "n", "chars", "key", "row")}
        for token, mark, content, n, chars, k, row in zip(*cols.values()):
            entry, top = table.find(address(mark), content), best(chars, k, row)
            if entry == len(ups):
                ups.append(token)
                tops.append(top)
                counts.append(n)
                marks.append(mark)
            else:
                counts[entry] += n
                tops[entry] = min(tops[entry], top)
            tokens.append(token)
            entries.append(entry)
    step = 50_000 if last else max(1, len(tokens) * (4 << 20) // max(1, table.held))
    for at in range(0, len(tokens), step):
        e, t = entries[at : at + step], tokens[at : at + step]
        top = [tops[x] for x in e]
        carry = [not last and ups[x] == token for x, token in zip(e, t)]
        yield batch_of(FOUND, {
            "token": t, "up": [ups[x] for x in e], "n": [counts[x] for x in e], "chars": [-x[0] for x in top], "key": [None if x[1] else x[2] for x in top], "row": [x[3] for x in top],
            "digest": [marks[x] if c else None for x, c in zip(e, carry)], "content": [table.contents[x] if c else None for x, c in zip(e, carry)],
        })


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", digest: Digest = sha256, held: int = HELD) -> DataFrame:
    """key, keep, group_size, kept and sha256 for every row of df; texts are equal when they are without their blanks.

    Blanks are the space and U+0009 to U+000D; a null text counts as an empty one.  Of equal texts the row with the most
    code points stays, then the one with the smallest key (null after all others), then any one; group_size counts rows.
    sha256 is that of the text without blanks, in lower-case hexadecimals.  Repeated rows are rows of their own, of which
    one is kept.  An empty table gives an empty one.  digest says where contents are looked for; held bounds the bytes of
    contents in a table (a single content may be larger).
    """
    length = F.octet_length("content") + RECORD
    rows = short_batches(df.select(whole_key(df, key).alias("key"), F.length(F.coalesce(text, F.lit(""))).cast("long").alias("chars"), F.coalesce(text, F.lit("")).cast("binary").alias("text")))
    with scratch(df.sparkSession) as put:
        first = put(rows.mapInArrow(merged(digest, held), ROWS_SQL))
        members = first.where("sha IS NOT NULL").select("row", "key", "sha", "token")
        left = first.where("content IS NOT NULL").select("token", "digest", "content", "n", "chars", "key", "row")
        size = lambda: left.agg(F.coalesce(F.sum(length), F.lit(0)).alias("bytes"), F.count("*").alias("c")).first()
        levels: list[DataFrame] = []
        (most, records), idle = size(), 0
        while most:
            level, fan = len(levels), math.ceil(most / held)
            dealt = left.withColumn("bucket", F.pmod(F.xxhash64("digest", F.lit(level)), F.lit(fan)))
            sizes = put(dealt.groupBy("bucket").agg(F.sum(length).alias("bytes"), F.count("*").alias("c")))
            # A bucket that doesn't fit is merged by so many tables first, each with four records or more; but where two
            # deals have merged nothing, different contents share a hash, and a larger table has to tell them apart.
            deals = F.when((F.col("bytes") <= 2 * held) | F.lit(idle >= 2), 1).otherwise(F.least(F.ceil(F.col("bytes") / held), F.ceil(F.col("c") / 4)))
            split = put(sizes.withColumn("deals", deals).where("deals > 1"))
            hot = split.first() is not None
            if hot:
                dealt = dealt.join(split.select("bucket", "deals"), "bucket", "left")
            deal = F.pmod(F.xxhash64("token", F.lit(level)), F.col("deals")) if hot else F.lit(0)
            last = F.col("deals").isNull() if hot else F.lit(True)
            cells = dealt.select("token", "digest", "content", "n", "chars", "key", "row", "bucket", F.coalesce(deal, F.lit(0)).alias("deal"), last.alias("last"))
            found = put(cells.groupBy("bucket", "deal", "last").applyInArrow(settled, FOUND_SQL))
            levels.append(found)
            if not hot:
                break
            left = found.where("content IS NOT NULL").select(F.col("up").alias("token"), "digest", "content", "n", "chars", "key", "row")
            before = records
            most, records = size()
            idle = idle + 1 if records == before else 0
        result = None
        for found in reversed(levels):  # the last level's tokens are settled; those before lead to them
            own = found.select("token", "up", F.col("key").alias("keep"), F.col("row").alias("keep_row"), F.col("n").alias("group_size"))
            if result is None:
                result = own.drop("up")
            else:
                later = result.withColumnRenamed("token", "up").select("up", *(F.col(c).alias(f"l_{c}") for c in ("keep", "keep_row", "group_size")))
                known = F.col("l_keep_row").isNotNull()
                result = own.join(later, "up", "left").select("token", *(F.when(known, F.col(f"l_{c}")).otherwise(F.col(c)).alias(c) for c in ("keep", "keep_row", "group_size")))
        if result is None:
            result = members.sparkSession.createDataFrame([], "token long, keep long, keep_row long, group_size long")
        return stored(members.join(result, "token").select(F.col("key").alias(key), "keep", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("sha256")))


ORACLE = r"""WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
  FROM n WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM r"""
