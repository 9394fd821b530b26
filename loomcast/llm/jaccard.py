"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, then exact sorted-array intersection.

Equal shingle sets are one class, which its smallest document stands for.  A class that links shares that share of its own
shingles with another class, so one that has too few shingles in common with all others together is left out: shingles
meet once, by their hashes, which is linear in the texts.  The other classes lie in bands by set size; only bands
whose sizes can reach the threshold meet, tile by tile.  A class has a bitmap: each shingle flips one bit.  Two bitmaps
differ in no more bits than the sets differ in shingles, so the bit count bounds the overlap from above, and most pairs
end there.  What is left groups the classes into small clusters (a tile yields the pairs that hold a cluster together,
not all of them).  In a cluster the sorted shingle arrays are intersected, unless two classes are known to be connected.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcast.llm.common import Connected, components, forest, join_few, join_hot, scratch, short_batches, slices, stored, whole_key
from loomcast.llm.words import shingles

TILE = 4096  # classes in a tile, on average
TILE_BYTES = 32 << 20  # bytes of bitmaps in a tile, on average; at least one class
ROWS, COLS = 64, 1024  # the part of a pair of tiles that is compared at once: its matrices stay in a core's cache
CHUNK = 200_000  # shingles of a cluster that one task holds, on average
BANDS = 4  # bands in which a size grows by 1 / threshold
BLOCK = 2_000_000  # shingles of the rows that are hashed at once
BLOCK_ROWS = 1 << 16  # rows of a block at most: places in it are two bytes
BUCKETS = 2048  # buckets of hashes, by their top bits: a power of two
MEET = 125_000  # shingles that meet in one call, on average; at least a bucket


def width(n: int) -> int:
    """Bits of the bitmap for n shingles: a power of two of at least 1.5 n.

    Unrelated sets, which differ by 2 n shingles, then differ by some 0.69 n bits or more, eight standard deviations above
    the 0.29 n that link; with half as many bits it is under three, and chance pairs chain all documents of a size.
    """
    return 1 << max(7, math.ceil(math.log2(max(1.0, 1.5 * n))))


def bitmap(h: np.ndarray, bits: int) -> np.ndarray:
    """Bit k tells whether an odd number of shingles falls on k.  The top bits of a hash are used: halving the width
    folds neighbouring bits."""
    at = (h >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little")


def folded(bytes_: np.ndarray, bits: int) -> np.ndarray:
    """Bitmaps (rows of bytes) narrowed to `bits` by adding neighbouring bits modulo two."""
    while bytes_.shape[1] * 8 > bits:
        b = np.unpackbits(bytes_, axis=1, bitorder="little")
        bytes_ = np.packbits(b[:, 0::2] ^ b[:, 1::2], axis=1, bitorder="little")
    return bytes_


def band(n: object, percent: int) -> object:
    return F.floor(F.log(n) / math.log(100 / percent) * BANDS + 1e-9).cast("int")


def reachable(small: np.ndarray, large: np.ndarray, percent: int) -> np.ndarray:
    return 100 * small >= percent * large


def most_apart(total: np.ndarray, percent: int) -> np.ndarray:
    """The largest symmetric difference of two sets with these summed sizes that link: 100 i >= p (total - i)."""
    return total - 2 * -(-percent * total // (100 + percent))


def close(na: np.ndarray, a: np.ndarray, nb: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of classes the sizes and bitmaps (uint64 words) don't rule out."""
    apart = np.zeros((len(a), len(b)), np.uint16 if a.shape[1] < 1024 else np.uint32)
    for w in range(a.shape[1]):
        apart += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    ok = apart <= most_apart(na[:, None] + nb[None, :], percent)
    return ok & reachable(np.minimum(na[:, None], nb[None, :]), np.maximum(na[:, None], nb[None, :]), percent)


def sets(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """A row for each whole text and rows for their shingles, in one pass; the others' columns are null.

    id, n, f1, f2 and bits: the key, size, two fingerprint halves and bitmap of the text's shingle set; block and place:
    where the row lies; shared: how many of its shingles another set of the block has too; late: how many of the others lie
    in the upper half of the buckets.  Of equal sets in a block only one with the smallest key has counts and shingles.

    block, bucket: a block's hashes with these top bits, by their next 32 bits and ascending.  once and places: those that
    one set has, and its place; often: those of several sets.
    """

    def rows_of(kept: list[tuple[int, np.ndarray]], block: int) -> Iterator[pa.RecordBatch]:
        prints = [xxhash.xxh3_128_intdigest(h.tobytes()) for _, h in kept]
        first: dict[int, int] = {}
        for k, f in enumerate(prints):
            if len(kept[k][1]) and (f not in first or kept[k][0] < kept[first[f]][0]):
                first[f] = k
        once, places, often, shared = split_block([h for _, h in kept], list(first.values()))
        maps = [bitmap(h, width(len(h))).tobytes() if len(h) else None for _, h in kept]
        count = len(kept)
        yield of(
            count,
            id=[i for i, _ in kept], n=[len(h) for _, h in kept], f1=[(f >> 64) - (1 << 63) for f in prints], f2=[(f & ((1 << 64) - 1)) - (1 << 63) for f in prints],
            bits=maps, block=[block] * count, place=range(count), shared=shared, late=np.bincount(places[np.searchsorted(once, np.uint64(1 << 63)) :], minlength=count),
        )
        edges = np.arange(1, BUCKETS, dtype=np.uint64) << np.uint64(64 - shift)
        a, b = (np.concatenate([[0], np.searchsorted(h, edges), [len(h)]]) for h in (once, often))
        full = np.flatnonzero((np.diff(a) > 0) | (np.diff(b) > 0))
        once, often = ((h >> np.uint64(32 - shift)).astype(np.uint32) for h in (once, often))
        cut = lambda h, at: [h[at[k] : at[k + 1]].tobytes() for k in full]
        yield of(len(full), block=[block] * len(full), bucket=full, once=cut(once, a), places=cut(places, a), often=cut(often, b))

    def of(count: int, **columns: object) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(count, f.type) for f in form], schema=form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, kept, held = TaskContext.get().partitionId() << 32, [], 0
        for batch in slices(batches, 1):
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                kept.append((i, shingles(t, size)))
                held += len(kept[-1][1])
                if held >= BLOCK or len(kept) == BLOCK_ROWS:
                    yield from rows_of(kept, block)
                    block, kept, held = block + 1, [], 0
        if kept:
            yield from rows_of(kept, block)

    shift = BUCKETS.bit_length() - 1
    form = pa.schema([(c, pa.binary()) if c in ("bits", "once", "places", "often") else (c, pa.int32() if c in ("place", "shared", "late", "bucket") else pa.int64()) for c in ("id", "n", "f1", "f2", "bits", "block", "place", "shared", "late", "bucket", "once", "places", "often")])
    named = "id long, n long, f1 long, f2 long, bits binary, block long, place int, shared int, late int, bucket int, once binary, places binary, often binary"
    return docs.select(whole_key(docs, key).alias("id"), F.col(text).alias("t")).where("id IS NOT NULL").mapInArrow(run, named)


def split_block(sets_: list[np.ndarray], used: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The hashes that one of the used sets has, its number, the hashes of several, and how many of those each set has."""
    h = np.concatenate([sets_[k] for k in used]) if used else np.zeros(0, np.uint64)
    at = np.repeat(np.array(used, np.uint16), [len(sets_[k]) for k in used])
    order = np.argsort(h, kind="stable")
    h, at = h[order], at[order]
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    alone = first & np.append(first[1:], True)[: len(h)]
    return h[alone], at[alone], h[first & ~alone], np.bincount(at[~alone], minlength=len(sets_))


def sharing(classes: DataFrame, whole: DataFrame, percent: int, put: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """id, n and bits of the classes (id, n, bits, block, place, shared, late) that share enough shingles to link.

    whole holds their shingles, as `sets` makes them.  100 i >= p u for an intersection i and a union u, so 100 i >= p n.
    Hashes meet by the 32 bits after the bucket's, which can only count too many as shared.  First the lower half of the
    buckets meets; classes that the upper half can't save have no part in it, as none that links is among them.  put stores
    tables.
    """

    def mark(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        on = np.zeros(BLOCK_ROWS, np.uint8)
        on[f["place"].to_numpy()] = 1
        return pd.DataFrame({"block": [key[0]], "stand": [np.packbits(on[: f["place"].max() + 1]).tobytes()]})

    def standing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Without the rows that stand for no class."""
        last, on = None, None
        for batch in batches:
            once, places = [], []
            for block, h, at, stand in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 5))):
                if block != last:
                    last, on = block, np.zeros(BLOCK_ROWS, bool)
                    bits = np.unpackbits(np.frombuffer(stand, np.uint8))
                    on[: len(bits)] = bits[:BLOCK_ROWS]
                at = np.frombuffer(at, np.uint16)
                keep = on[at]
                once.append(np.frombuffer(h, np.uint32)[keep].tobytes())
                places.append(at[keep].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(once, pa.binary()), pa.array(places, pa.binary()), batch.column(4)], names=["block", "bucket", "once", "places", "often"])

    def meet(_: tuple, f: pd.DataFrame) -> pd.DataFrame:
        found: dict[int, list[bytes]] = {}
        for _, g in f.groupby("bucket", sort=False):
            once, often = (np.frombuffer(b"".join(g[c]), np.uint32) for c in ("once", "often"))
            h = np.sort(np.concatenate([once, often]), kind="stable")
            again = h[1:][h[1:] == h[:-1]]
            if len(again):
                at = np.searchsorted(again, once)
                at[at == len(again)] = 0
                hit, start = again[at] == once, 0
                for block, places in zip(g["block"], g["places"]):
                    places = np.frombuffer(places, np.uint16)
                    found.setdefault(block, []).append(places[hit[start : start + len(places)]].tobytes())
                    start += len(places)
        return pd.DataFrame({"block": pd.Series(list(found), dtype=np.int64), "places": [b"".join(p) for p in found.values()]})

    def add(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        more = np.bincount(np.frombuffer(b"".join(f["places"]), np.uint16))
        place = np.flatnonzero(more)
        return pd.DataFrame({"block": key[0], "place": place, "more": more[place]})

    left = classes.withColumn("sure", F.col("shared").cast("long"))
    for start, stop, open_ in ((0, BUCKETS // 2, F.col("late")), (BUCKETS // 2, BUCKETS, F.lit(0))):
        stand = put(left.groupBy("block").applyInPandas(mark, "block long, stand binary"))  # a bit for each document
        calls = min(stop - start, max(1, -(-(left.agg(F.sum("n")).first()[0] or 0) // (2 * MEET))))
        dealt = whole.where((F.col("bucket") >= start) & (F.col("bucket") < stop)).select("block", "bucket", "once", "places", "often").join(F.broadcast(stand), "block")
        dealt = dealt.mapInArrow(standing, "block long, bucket int, once binary, places binary, often binary")
        met = dealt.groupBy(F.floor(F.col("bucket") % (stop - start) * calls / (stop - start))).applyInPandas(meet, "block long, places binary")
        more = met.groupBy("block").applyInPandas(add, "block long, place int, more long")
        counted = left.join(more, ["block", "place"], "left").withColumn("sure", F.col("sure") + F.coalesce("more", F.lit(0))).drop("more")
        left = put(counted.where(100 * (F.col("sure") + open_) >= percent * F.col("n")))
    return left.select("id", "n", "bits")


def arrays(docs: DataFrame, size: int) -> DataFrame:
    """docs (text, then other columns) with the sorted shingle array in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            made = pa.array([shingles(t, size).tobytes() for t in batch.column(0).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], made], names=[*batch.schema.names[1:], "h"])

    return docs.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in docs.dtypes[1:]) + ", h binary")


def candidate_edges(classes: DataFrame, percent: int, put: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """src, dst that connect whatever the pairs of classes (id, n, bits) not ruled out connect.  put stores tables."""
    banded = classes.withColumn("band", band(F.col("n"), percent))
    counts = put(banded.groupBy("band").agg(F.count("*").alias("c"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum(F.length("bits")).alias("bytes")))
    counts = counts.withColumn("parts", F.greatest(F.ceil(F.col("c") / TILE), F.least(F.col("c"), F.ceil(F.col("bytes") / TILE_BYTES))).cast("int"))
    bands = counts.collect()  # a few for each doubling of the largest set
    parts = F.lit(1)
    for r in bands:
        parts = F.when(F.col("band") == r["band"], r["parts"]).otherwise(parts)
    tiled = banded.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))

    def pack(tile: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("n", kind="stable")
        bits = width(int(f["n"].iloc[0]))
        maps = np.concatenate([folded(np.frombuffer(b, np.uint8)[None], bits) for b in f["bits"]])
        return pd.DataFrame({"band": [tile[0]], "part": [tile[1]], "ids": [f["id"].to_numpy(np.int64).tobytes()], "n": [f["n"].to_numpy(np.int64).tobytes()], "bits": [maps.tobytes()]})

    tiles = put(tiled.groupBy("band", "part").applyInPandas(pack, "band int, part int, ids binary, n binary, bits binary"))
    # The other band of a pair and its number of tiles: as many rows as bands times bands within reach.
    meets = [(a["band"], b["band"], a["parts"], b["parts"]) for a in bands for b in bands if a["band"] <= b["band"] and a["most"] * 100 >= b["least"] * percent]
    if not meets:
        return classes.sparkSession.createDataFrame([], "src long, dst long")
    met = F.broadcast(classes.sparkSession.createDataFrame(meets, "ba int, bb int, pa int, pb int"))
    low = tiles.join(met, F.col("band") == F.col("ba")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pb") - 1))).where((F.col("ba") < F.col("bb")) | (F.col("part") <= F.col("other")))
    low = low.select("ba", F.col("part").alias("pa"), "bb", F.col("other").alias("pb"), F.lit(0).alias("side"), "ids", "n", "bits")
    high = tiles.join(met, F.col("band") == F.col("bb")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pa") - 1))).where((F.col("ba") < F.col("bb")) | (F.col("other") < F.col("part")))
    high = high.select("ba", F.col("other").alias("pa"), "bb", F.col("part").alias("pb"), F.lit(1).alias("side"), "ids", "n", "bits")

    def compare(_: tuple, f: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for row in f.sort_values("side").itertuples():
            ids = np.frombuffer(row.ids, np.int64)
            sides.append((ids, np.frombuffer(row.n, np.int64), np.frombuffer(row.bits, np.uint8).reshape(len(ids), -1)))
        (ia, na, a), (ib, nb, b) = sides[0], sides[-1]
        same = len(sides) == 1
        bits = 8 * min(a.shape[1], b.shape[1])
        a, b = folded(a, bits).view(np.uint64), folded(b, bits).view(np.uint64)
        src, dst = [], []
        known, shift = Connected(len(ia) + (0 if same else len(ib))), 0 if same else len(ia)
        for p in range(0, len(ia), ROWS):
            small, large = na[p], na[min(p + ROWS, len(na)) - 1]
            first = int(np.searchsorted(nb, -(-int(small) * percent // 100)))
            last = int(np.searchsorted(nb, int(large) * 100 // percent, side="right"))
            for q in range(max(first, p) if same else first, last, COLS):
                to = min(q + COLS, last)
                ok = close(na[p : p + ROWS], a[p : p + ROWS], nb[q:to], b[q:to], percent)
                ok &= known.root[p : p + len(ok), None] != known.root[None, shift + q : shift + to]
                if ok.any():
                    i, j = forest(ok)
                    new = known.add(p + i, shift + q + j)
                    src.append(ia[p + i[new]])
                    dst.append(ib[q + j[new]])
        return pd.DataFrame({"src": np.concatenate(src), "dst": np.concatenate(dst)}) if src else pd.DataFrame({"src": [], "dst": []}).astype(np.int64)

    return put(low.union(high).groupBy("ba", "pa", "bb", "pb").applyInPandas(compare, "src long, dst long"))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common values of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def united(ids: np.ndarray, sets_: list[np.ndarray], labels: np.ndarray, percent: int, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Exact links that join classes with different labels; a pair that labels already join isn't intersected.

    With sides, only pairs of different sides are looked at.
    """
    order = np.argsort([len(s) for s in sets_], kind="stable")
    ids, labels = ids[order], labels[order].copy()
    sets_ = [sets_[k] for k in order]
    sides = None if sides is None else sides[order]
    n = np.array([len(s) for s in sets_])
    out = []
    by_bits: dict[int, np.ndarray] = {}
    for i in range(len(ids)):
        last = int(np.searchsorted(n, n[i] * 100 // percent, side="right"))
        left = np.flatnonzero(labels[i + 1 : last] != labels[i]) + i + 1
        if sides is not None:
            left = left[sides[left] != sides[i]]
        if not len(left):
            continue
        bits = width(int(n[i]))
        if bits not in by_bits:
            by_bits[bits] = np.array([bitmap(s, bits) for s in sets_]).view(np.uint64)
        maps = by_bits[bits]
        left = left[close(n[i : i + 1], maps[i : i + 1], n[left], maps[left], percent)[0]]
        for j in left:
            if labels[i] == labels[j]:
                continue
            common = overlap(sets_[i], sets_[j])
            if 100 * common >= percent * (n[i] + n[j] - common):
                out.append((int(ids[i]), int(ids[j])))
                labels[labels == labels[j]] = labels[i]
    return out


def resolve(members: DataFrame, percent: int, by: list[str], sided: bool = False) -> DataFrame:
    """Exact links src, dst within each group named by `by` of members (id, label, h, and side where sided).

    Groups are dealt to tasks in buckets, so that small ones don't cost a call each.
    """

    def run(_: tuple, f: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in f.groupby(by, sort=False):
            if len(g) > 1:
                out += united(g["id"].to_numpy(np.int64), [np.frombuffer(h, np.uint64) for h in g["h"]], g["label"].to_numpy(np.int64), percent, g["side"].to_numpy() if sided else None)
        return pd.DataFrame(out, columns=["src", "dst"], dtype=np.int64)

    return members.groupBy("bucket").applyInPandas(run, "src long, dst long")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """key, n_shingles and component_id for each row of docs.

    Two documents link when 100 * intersection >= percent * union of their sets of distinct runs of `size` words;
    component_id is the smallest key that links reach, the row's own included.  A text with fewer words is one run; null
    texts and those without words have no shingle and link with nothing.  Rows that share a key are one document if their
    sets are equal.  Rows with a null key are left out; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    with scratch(spark) as put:
        whole = put(sets(short_batches(docs), key, text, size))
        some = whole.where("n > 0").select("id", "n", "f1", "f2", "bits", "block", "place", "shared", "late")
        named = put(some.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.count("*").alias("members")))
        met = join_hot(some, named, ["f1", "f2"], "members").select("id", "n", "rep", F.when(F.col("id") == F.col("rep"), F.col("bits")).alias("bits"), "block", "place", "shared", "late")
        empty = whole.where("n = 0").select("id", "n", F.col("id").alias("rep"), "bits", "block", "place", "shared", "late")
        known = stored(met.union(empty))
        classes = sharing(known.where("n > 0 AND id = rep"), whole, percent, put)
        roots = stored(class_roots(docs.select(whole_key(docs, key).alias("id"), F.col(text).alias("t")), classes, size, percent, put))
    joined = known.where("n > 0").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("id", "n", F.coalesce("root", "rep").alias("component_id"))
    return joined.union(known.where("n = 0").select("id", "n", "id")).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def class_roots(docs: DataFrame, classes: DataFrame, size: int, percent: int, put: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """node and root, the smallest class that links reach, of the classes (id, n, bits) that have links; docs (id, t) has
    their texts.  put stores tables of the way."""
    clusters = components(candidate_edges(classes, percent, put), keep=put).select(F.col("node").alias("id"), F.col("root").alias("cluster"))
    sized = clusters.join(classes.select("id", "n"), "id")
    totals = sized.groupBy("cluster").agg(F.ceil(F.sum("n") / CHUNK).cast("int").alias("chunks"))
    placed = put(sized.join(totals, "cluster").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).select("id", "cluster", "chunks", "chunk", "n"))
    buckets = max(1, math.ceil((placed.agg(F.sum("n")).first()[0] or 0) / CHUNK))
    dealt = lambda df, *by: df.withColumn("bucket", F.pmod(F.xxhash64(*by), F.lit(buckets)))

    def with_arrays(rows: DataFrame) -> DataFrame:
        return arrays(join_few(docs, rows, "id").select("t", "id", "cluster", "chunks", "chunk"), size)

    members = with_arrays(placed)
    links = put(resolve(dealt(members.withColumn("label", F.col("id")), "cluster", "chunk"), percent, ["cluster", "chunk"]))

    # Clusters too large for one task: links between their chunks.  First one class for each connected part, which joins
    # groups of near copies at once; then every pair of chunks of the clusters that still have several parts.
    roots = components(links, keep=put)
    many = placed.where("chunks > 1")
    if not many.head(1):
        return roots
    large = put(with_arrays(many).select("id", "h"))

    def unsettled() -> DataFrame:
        """The classes, with their parts, of large clusters that have more than one part."""
        labelled = many.join(roots.select(F.col("node").alias("id"), F.col("root").alias("label")), "id", "left").withColumn("label", F.coalesce("label", "id"))
        parts = labelled.groupBy("cluster").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("cluster")
        return put(labelled.join(parts, "cluster"))

    open_ = unsettled()
    for attempt in range(3):
        heads = open_.where("id = label")
        count = heads.groupBy("cluster").agg(F.ceil(F.sum("n") / (8 * CHUNK)).cast("int").alias("groups"))
        heads = put(heads.join(count, "cluster").withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(attempt)), F.col("groups")).cast("int")).drop("groups"))
        more = put(resolve(dealt(join_few(large, heads, "id"), "cluster", "chunk"), percent, ["cluster", "chunk"]))
        if not more.head(1):
            break
        links = links.union(more)
        roots = components(links, keep=put)
        open_ = unsettled()
    if open_.head(1):
        crossed = join_few(large, open_, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where("other <> chunk")
        crossed = crossed.select("id", "label", "h", "cluster", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), F.col("chunk").alias("side"))
        last = put(resolve(dealt(crossed, "cluster", "lo", "hi"), percent, ["cluster", "lo", "hi"], sided=True))
        if last.head(1):
            roots = components(links.union(last), keep=put)
    return roots
