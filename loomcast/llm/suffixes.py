"""Suffix-array dedup: sparse suffix arrays over words.

Suffixes are retained at content-selected positions: the leftmost smallest hash of a short run of words in every window
of positions.  Each passage of `least` words has such a position, its anchor, among its first `window` words; two equal
passages have it at the same word, and agree for at least `seed` = least - window + 1 words from there.  Suffixes are
sorted by those words, each with the hashes of the passages that it anchors, one for each word of the document.  Every
passage is laid to its head: its first place in the document with the smallest key that holds all of it.  Passages that
follow each other in both documents are joined, so the result is a function of the table, however it is partitioned.

A batch of documents compares its own passages first and passes on only the first of each, so that a passage which very
many documents share is no long run anywhere; where that first one turns out to have a head elsewhere, so have the rest.
A seed which very many documents share, with other words after it, is split: its passages are sorted by all their words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcast.llm.common import scratch, short_batches, slices, stored, unused, whole_key
from loomcast.llm.words import hashes, mixed, runs, split

_GRAM = 8
_BYTES = 6  # of a passage: 44 bits of its hash, 4 of the distance from its anchor
_ROWS = 20_000
_WORD = re.compile(rb"[^ \t-\r]+")


def positions(h: np.ndarray, window: int) -> np.ndarray:
    """Word positions of the leftmost smallest run hash of every window of `window` positions."""
    grams = runs(h, min(_GRAM, len(h)))
    if len(grams) <= window:
        return np.array([int(grams.argmin())]) if len(grams) else np.empty(0, int)
    own = np.lib.stride_tricks.sliding_window_view(grams, window).argmin(1)
    return np.unique(own + np.arange(len(own)))


def passages(h: np.ndarray, least: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each passage of `least` words: the hash of the seed at its anchor, the anchor, the passage's own hash."""
    grams = runs(h, min(_GRAM, least - window + 1))[: len(h) - least + window]
    anchor = np.lib.stride_tricks.sliding_window_view(grams, window).argmin(1) + np.arange(len(h) - least + 1)
    return runs(h, least - window + 1)[anchor], anchor, runs(h, least)


def heads(v: np.ndarray) -> np.ndarray:
    """For each value the number of the first row that has it."""
    order = np.argsort(v, kind="stable")
    ordered = v[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]][: len(v)]
    out = np.empty(len(v), int)
    out[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))]
    return out


def islands(doc: np.ndarray, other: np.ndarray, diag: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """doc, other, diag, lo, hi: equal stretches joined where one begins before another ends on the same diagonal."""
    order = np.lexsort((lo, diag, other, doc))
    doc, other, diag, lo, hi = (x[order] for x in (doc, other, diag, lo, hi))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (other[1:] != other[:-1]) | (diag[1:] != diag[:-1])
    line = np.cumsum(new) << 32
    end = np.maximum.accumulate(line + hi)  # a stretch may lie within one before it
    new[1:] |= (line + lo)[1:] > end[:-1]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(doc)][: len(first)] - 1
    return doc[first], other[first], diag[first], lo[first], (end - line)[last]


def stretches(doc: np.ndarray, other: np.ndarray, diag: np.ndarray, at: np.ndarray, upto: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """doc, other, diag, first, last: passages (or stretches at .. upto of them) joined where one follows another."""
    upto = at if upto is None else upto
    order = np.lexsort((at, diag, other, doc))
    doc, other, diag, at, upto = (x[order] for x in (doc, other, diag, at, upto))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (other[1:] != other[:-1]) | (diag[1:] != diag[:-1]) | (at[1:] != upto[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(doc)][: len(first)] - 1
    return doc[first], other[first], diag[first], at[first], upto[last]


#: A stretch of a document: the id of the other, how many words before it has the passages, the words where they begin.
STRETCH = np.dtype([("id", "<i8"), ("diag", "<i4"), ("first", "<i4"), ("last", "<i4")])


def binary(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    """A binary column whose row k holds values[ends[k] : ends[k + 1]]."""
    ends = (ends * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values).view(np.uint8))])


def unbinary(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """How many values of `size` bytes each row has, and the bytes of all; nulls have none."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1] if ends else np.zeros(1, np.int32)
    return np.diff(ends) // size, np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.empty(0, np.uint8)


def gathered(owner: np.ndarray, *fields: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The owners, ascending, and the stretches (id, diag, first, last) of each as bytes."""
    order = np.argsort(owner, kind="stable")
    owners, counts = np.unique(owner, return_counts=True)
    packed = np.empty(len(order), STRETCH)
    for name, x in zip(STRETCH.names, fields):
        packed[name] = x[order]
    return owners, binary(np.r_[0, np.cumsum(counts)], packed)


def spread(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """The row that each stretch is from, and the fields of all stretches."""
    sizes, raw = unbinary(column, STRETCH.itemsize)
    packed = raw.view(STRETCH)
    return np.repeat(np.arange(len(column)), sizes), [packed[n].astype(np.int64) for n in STRETCH.names]


def retained(docs: DataFrame, least: int, window: int, split_up: np.ndarray) -> DataFrame:
    """The suffixes of docs (id long, t): key, data (the passages that it anchors), of (its document), at (its word).  Passages
    whose seed is in split_up are suffixes of their own, by the hash of all their words.

    Rows with at = -1 hold what a batch settles by itself: data has the stretches of other documents whose passages have
    their first place within the batch in `of`.
    """
    split_up = np.sort(split_up)
    names = ["key", "data", "of", "at"]

    def retain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 4 << 20):
            parts, shared = [], False
            for doc, text in sorted(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), key=lambda r: r[0]):
                h = hashes(split(text))
                if len(h) >= least:
                    shared = shared or bool(parts and parts[-1][3][0] == doc)
                    key, anchor, own = passages(h, least, window)
                    parts.append((key, anchor, own, np.full(len(own), doc, np.int64), np.arange(len(own))))
            if not parts:
                continue
            key, anchor, own, doc, at = (np.concatenate(x) for x in zip(*parts))
            if shared:  # rows with the same key: the first place comes first
                order = np.lexsort((at, doc))
                key, anchor, own, doc, at = (x[order] for x in (key, anchor, own, doc, at))
            head = heads(own)
            on = head == np.arange(len(head))
            again = np.flatnonzero(~on)
            who, of, *where = stretches(doc[again], doc[head[again]], at[again] - at[head[again]], at[again])
            of, near = gathered(of, who, *where)
            key, anchor, own, doc, at = (x[on] for x in (key, anchor, own, doc, at))
            if len(split_up):
                apart = split_up[np.minimum(np.searchsorted(split_up, key), len(split_up) - 1)] == key
                key = np.where(apart, mixed(own), key)
            first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])][: len(doc)])
            code = ((own >> np.uint64(20)) << np.uint64(4)) | (anchor - at).astype(np.uint64)
            grams = code.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_BYTES]
            data = binary(np.r_[first, len(doc)] * _BYTES, grams.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), data, pa.array(doc[first]), pa.array(anchor[first], pa.int32())], names=names)
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), near, pa.array(of, pa.int64()), pa.array(np.full(len(of), -1), pa.int32())], names=names)

    return docs.select("id", "t").mapInArrow(retain, "key long, data binary, of long, at int")


SAMPLE = 32  # one in so many documents shows which seeds are frequent
FREQUENT = 16  # as many suffixes of the sample have a frequent seed, at least


def frequent_seeds(docs: DataFrame, least: int, window: int) -> np.ndarray:
    """Keys of seeds that very many suffixes share, by a sample; as many as four for each shuffle partition at most.

    They are only sorted by more words, so results don't depend on which are found.
    """
    most = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = docs.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0)
    counts = retained(some, least, window, np.empty(0, np.uint64)).where("at >= 0").groupBy("key").count().where(F.col("count") >= FREQUENT)
    return np.array([r["key"] for r in counts.orderBy(F.desc("count"), "key").limit(most).collect()], np.int64).view(np.uint64)


def matches(docs: DataFrame, least: int, window: int) -> DataFrame:
    """of, near, m: the stretches of a document (of) and the documents in which all their passages have their heads; or, if
    near, stretches of other documents that are in `of` too, where a batch of documents has them first."""
    if not 0 < window <= min(16, least):
        raise ValueError("window must be 1 to 16 and at most least")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)]

        def settle(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            """Matches of the next rows.  Of the last run, which may go on, the first of each passage are kept."""
            t = pa.Table.from_batches(parts).combine_chunks()
            key = t.column("key").to_numpy().view(np.uint64)
            same = key[1:] == key[:-1]
            run = np.r_[same, True] | np.r_[False, same]
            if len(kept[0]):
                run |= key == kept[0][0]
            t = t.filter(pa.array(run)).combine_chunks()
            n, raw = unbinary(t.column("data").combine_chunks(), _BYTES)
            wide = np.zeros((len(raw) // _BYTES, 8), np.uint8)
            wide[:, :_BYTES] = raw.reshape(-1, _BYTES)
            code = wide.view("<u8").ravel()
            new = [np.repeat(key[run], n), code, np.repeat(t.column("of").to_numpy(), n), np.repeat(t.column("at").to_numpy().astype(np.int64), n) - (code & np.uint64(15)).astype(np.int64)]
            old = len(kept[0])
            k, code, doc, at = (np.concatenate(x) for x in zip(kept, new))
            head = heads(mixed(k) + code)
            late = np.flatnonzero((np.arange(len(k)) >= old) & (doc[head] != doc))
            of, m = gathered(*stretches(doc[late], doc[head[late]], at[late] - at[head[late]], at[late]))
            stay = (k == key[-1]) & (head == np.arange(len(k)))
            kept[:] = k[stay], code[stay], doc[stay], at[stay]
            return pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(np.zeros(len(of), bool)), m], names=["of", "near", "m"])

        parts, n = [], 0
        for batch in batches:
            done = pc.less(batch.column("at"), 0)
            near = batch.filter(done)
            yield pa.RecordBatch.from_arrays([near.column("of"), pa.array(np.ones(len(near), bool)), near.column("data")], names=["of", "near", "m"])
            parts.append(batch.filter(pc.invert(done)))
            n += parts[-1].num_rows
            if n >= max(_ROWS, len(kept[0]) // 8):
                yield settle(parts)
                parts, n = [], 0
        if n:
            yield settle(parts)

    every = retained(docs, least, window, frequent_seeds(docs, least, window))
    return every.repartition("key").sortWithinPartitions("key", "of", "at").mapInArrow(compare, "of long, near boolean, m binary")


def laid(ids: np.ndarray, of: np.ndarray, doc: np.ndarray, diag: np.ndarray, first: np.ndarray, last: np.ndarray, known: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """doc, other, diag, first, last: near matches laid to their heads.

    of: the number (in ids) of the document that has a stretch.  known: of, other, diag, first, last of stretches of those
    documents and where their passages have their heads, ascending by of and first.  Passages of which nothing is known
    are heads themselves.
    """
    home, far, by, a, b = known
    line = lambda k, x: (k.astype(np.int64) << 32) + x
    lo, hi = first - diag, last - diag
    start = np.searchsorted(line(home, b), line(of, lo))  # the first known stretch that ends behind lo
    counts = np.maximum(np.searchsorted(line(home, a), line(of, hi), side="right") - start, 0)
    row = np.repeat(np.arange(len(doc)), counts)
    k = np.repeat(start - np.cumsum(counts) + counts, counts) + np.arange(len(row))
    left, right = np.maximum(a[k], lo[row]), np.minimum(b[k], hi[row])
    # What no known stretch holds lies between the end of one and the start of the next.
    who, begin, end = np.r_[np.arange(len(doc)), row], np.r_[lo - 1, left], np.r_[lo - 1, right]
    order = np.lexsort((begin, who))
    who, begin, end = who[order], begin[order], end[order]
    up = np.r_[begin[1:], 0][: len(who)]
    final = np.r_[who[1:] != who[:-1], True][: len(who)]
    up[final] = hi[who[final]] + 1
    gap = end + 1 < up
    who, begin, up = who[gap], end[gap] + 1, up[gap] - 1
    return np.r_[doc[row], doc[who]], np.r_[far[k], ids[of[who]]], np.r_[diag[row] + by[k], diag[who]], np.r_[left + diag[row], begin + diag[who]], np.r_[right + diag[row], up + diag[who]]


def cover(rows: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of one document's stretches (lo, hi, other, diag) those that cover what all cover: the longest from each start of
    what is covered, then of those that begin within it the one that reaches furthest."""
    out: list[tuple[int, int, int, int]] = []
    end, best = -1, None
    for r in [*sorted(rows, key=lambda r: (r[0], -r[1], *r[2:])), None]:
        if best is not None and (r is None or r[0] > end):
            out.append(best)
            end, best = best[1], None
        if r is None:
            break
        if r[0] > end:
            out.append(r)
            end = r[1]
        elif r[1] > end and (best is None or r[1] > best[1]):
            best = r
    return out


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 50, window: int = 16) -> DataFrame:
    """id, start, stop, other, diag: the passages of at least `least` words that a document shares with an earlier one.

    start and stop count words; the passage begins at start - diag in the document `other`, which has a smaller key; each
    passage of `least` words is laid to the document with the smallest key that has it, at its first place there.  A
    stretch that no one document shares is given in overlapping pieces.  Every word of every such passage lies in one
    that is given, and rows don't depend on partitions.

    Null texts and texts of fewer words have none; a text that repeats itself isn't matched with itself; rows that share
    a key are one document here; rows with a null key have none; keys must be whole numbers; an empty table gives none.
    """
    named = short_batches(docs).select(whole_key(docs, key).alias("id"), F.col(text).alias("t")).where("id IS NOT NULL")
    kind = "of long, m binary"

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pack, fields = spread(batch.column(1).flatten())
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(1)).to_numpy())[pack]
            owner, *joined = stretches(row, *fields)
            order = np.lexsort((joined[2], owner))  # by first word, as passages have one head each
            _, m = gathered(owner[order], *(x[order] for x in joined))
            yield pa.RecordBatch.from_arrays([batch.column(0), m], names=["of", "m"])

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, own = spread(batch.column(1))
            home, known = spread(batch.column(2))
            doc, other, *where = laid(batch.column(0).to_numpy(), of, *own, (home, *known))
            apart = doc != other
            owners, m = gathered(doc[apart], other[apart], *(x[apart] for x in where))
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), m], names=["of", "m"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, packs in zip(batch.column(0).to_pylist(), batch.column(1)):
                other, diag, first, last = spread(packs.values)[1]
                _, other, diag, lo, hi = islands(np.zeros(len(first), int), other, diag, first, last + least)
                out += [(i, *r) for r in cover(list(zip(lo.tolist(), hi.tolist(), other.tolist(), diag.tolist())))]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
            columns = zip(*out) if out else ((),) * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["id", "start", "stop", "other", "diag"])

    with scratch(docs.sparkSession) as put:
        found = put(matches(named, least, window))
        settled = put(found.where("NOT near").groupBy("of").agg(F.collect_list("m").alias("m")).mapInArrow(join_up, kind))
        near = found.where("near").select("of", "m").join(settled.select("of", F.col("m").alias("far")), "of", "left").mapInArrow(lay, kind)
        grouped = settled.union(near).groupBy("of").agg(F.collect_list("m").alias("m"))
        return stored(grouped.mapInArrow(choose, "id long, start int, stop int, other long, diag int"))


def without(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """text without the words of the spans (word numbers); the blanks around a cut become those after it."""
    if text is None or not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw)]
    out, end, keep = [], 0, 0
    for start, stop in sorted(spans):
        start, stop = max(start, keep), min(stop, len(at))
        if start < stop:
            out.append(raw[end : at[start][0]])
            end, keep = (at[stop][0] if stop < len(at) else len(raw)), stop
    return b"".join([*out, raw[end:]]).decode("utf-8", "surrogatepass")


def cut(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the spans (id, start, stop) of each document cut from its text; n_chars, if there is one, follows.

    Documents of which no word is left are dropped if a span took their words; rows that share a key are cut alike.
    """
    whose, where, new = unused(docs.columns, "_cut_id", "_cut_spans", "_cut_text")
    grouped = spans.groupBy(F.col("id").alias(whose)).agg(F.collect_list(F.struct("start", "stop")).alias(where))
    joined = short_batches(docs).join(grouped, F.col(key).cast("long") == F.col(whose), "left")

    @F.pandas_udf("string")
    def shortened(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        return pd.Series([t if c is None else without(t, [(s["start"], s["stop"]) for s in c]) for t, c in zip(texts, cuts)], dtype=object)

    left = joined.withColumn(new, shortened(text, where)).where(F.col(where).isNull() | F.col(new).rlike(r"[^\x20\x09-\x0D]"))
    columns = [F.col(new).alias(c) if c == text else F.length(new).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return left.select(*columns)
