"""Language identification by the nearest of several centroids for each language.

A text is the vector of its letter n-grams (1 to 3 letters, words padded by a blank), hashed to a fixed number of
dimensions, weighted by the logarithm of their count and their inverse document frequency, and normalised.  Each
language has several centroids, found by spherical k-means.  The nearest centroid by cosine names the language; a text
too far from every centroid is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomcast.llm.common import scratch, short_batches, slices, unused
from loomcast.operators import order_stats

_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """max_langs bounds the languages that a fit learns, so that a column of dirty values can't make the model large: the
    most frequent are learned, each from all of its texts.

    A text is rejected where its distance (1 - cosine) is more than `slack` times the distance that `quantile` of the
    training texts of about its length and its language keep within.  Lengths are bands of distinct n-grams, so that a text
    which repeats itself counts as a short one, each band twice as wide as the one before.  A band with fewer than `enough`
    texts of a language takes those of all languages, one with fewer of all the limit of the band before.

    Distances up to `near` are never rejected, and up to `floor` not in texts of fewer than `few` distinct ones: clean texts of
    a few words lie that far from any centroid.
    """

    dims: int = 4096
    max_langs: int = 500
    clusters: int = 4
    passes: int = 8
    quantile: float = 0.999
    slack: float = 1.1
    floor: float = 0.95
    few: int = 64
    near: float = 0.6
    enough: int = 50


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    names: list[str]  # of each centroid
    centroids: np.ndarray
    reach: np.ndarray  # largest distance that each centroid accepts, by band of length
    few: int = Settings.few  # n-grams with which the second band begins


BANDS = 16


def band(size: float, few: int) -> int:
    """0 for texts of fewer than `few` distinct n-grams, then one more for each doubling, up to the last of BANDS."""
    return min(BANDS - 1, max(0, int(np.floor(np.log2(max(size, 1) / few))) + 1))


def limits(far: pd.DataFrame, names: list[str], settings: Settings) -> np.ndarray:
    """The largest accepted distance for each name and band, from far (l, band, far: their quantile, n: their number); rows
    of all languages have a null l."""
    s, out = settings, np.empty((len(names), BANDS))
    own = {(None if pd.isna(r.l) else r.l, r.band): r.far * s.slack for r in far.itertuples() if r.n >= s.enough}
    for i, name in enumerate(names):
        limit = s.floor
        for k in range(BANDS):
            limit = own.get((name, k), own.get((None, k), limit))
            out[i, k] = max(limit, s.near if k else s.floor)
    return out


def gram_counts(text: str | None, dims: int) -> np.ndarray | None:
    """Counts of a whole text's hashed n-grams; None if it has no letter."""
    words = _OTHER.sub(" ", text or "").lower()
    if not _LETTER.search(words):
        return None
    c = np.frombuffer(f" {words} ".encode("utf-32-le", "replace"), np.uint32)
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (c[1:] * np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35)
    three = (two[:-1] ^ (c[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
    shift = np.uint32(32 - int(dims).bit_length() + 1)
    return np.bincount(np.concatenate([one >> shift, two >> shift, three >> shift]), minlength=dims).astype(np.float32)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def packed(counts: np.ndarray) -> tuple[bytes, bytes]:
    """The places of the counts that aren't zero, and these counts: a byte for each where that is enough, else four."""
    at = np.flatnonzero(counts)
    n = counts[at]
    return at.astype(place_type(len(counts))).tobytes(), n.astype(np.uint8 if n.max() < 256 else np.uint32).tobytes()


def place_type(dims: int) -> type:
    return np.uint16 if dims <= 1 << 16 else np.uint32


def unpacked(at: list[bytes], n: list[bytes], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What `vectors` makes of packed counts, a row for each text, and the number of distinct n-grams of each."""
    places = [np.frombuffer(b, place_type(len(idf))) for b in at]
    sizes = np.array([len(p) for p in places])
    counts = np.concatenate([np.frombuffer(b, np.uint8 if len(b) == k else np.uint32) for b, k in zip(n, sizes)])
    flat, row = np.concatenate(places), np.repeat(np.arange(len(places)), sizes)
    w = np.log1p(counts.astype(np.float32)) * idf[flat]
    length = np.sqrt(np.add.reduceat(w * w, np.cumsum(sizes) - sizes))
    out = np.zeros((len(places), len(idf)), np.float32)
    out[row, flat] = w / np.maximum(length, 1e-12)[row]
    return out, sizes


CELLS = 1 << 21  # of the rows that a task unpacks at once


def unpacked_batches(batches: Iterator[pa.RecordBatch], idf: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch of packed counts in pieces, with their vectors and numbers of distinct n-grams."""
    step = max(1, CELLS // len(idf))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            b = batch.slice(start, step)
            yield b, *unpacked(b.column("at").to_pylist(), b.column("n").to_pylist(), idf)


def by_language(batches: Iterator[pa.RecordBatch], idf: np.ndarray, learned: Iterable[str]) -> Iterator[tuple[str, list, np.ndarray]]:
    """The language, keys and vectors of the rows of each of the languages, batch by batch."""
    for b, v, _ in unpacked_batches(batches, idf):
        names, keys = np.array(b.column("l").to_pylist(), object), b.column("k").to_pylist()
        for name in set(names) & set(learned):
            own = np.flatnonzero(names == name)
            yield name, [keys[i] for i in own], v[own]


Centroids = dict[str, np.ndarray]  # of each language


def nearest_sums(counted: DataFrame, idf: np.ndarray, centroids: Centroids) -> tuple[Centroids, Centroids]:
    """For each centroid, the sum of the vectors of its language that are nearest to it, and their number.

    Tasks send a sum for each centroid that they have met, which are added up for each centroid before the driver has them.
    """
    sent = counted.sparkSession.sparkContext.broadcast((idf, centroids))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, chosen = sent.value
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for name, _, v in by_language(batches, weights, chosen):
            own = np.eye(len(chosen[name]), dtype=np.float32)[(v @ chosen[name].T).argmax(1)]
            s, n = sums.setdefault(name, (np.zeros(chosen[name].shape), np.zeros(len(chosen[name]))))
            s += own.T @ v
            n += own.sum(0)
        for name, (s, n) in sums.items():
            met = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(met)), pa.array(met, pa.int32()), pa.array(n[met].astype(np.int64)), pa.array([x.tobytes() for x in s[met]], pa.binary())], names=["l", "c", "n", "s"])

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(b) for b in frame["s"]], axis=0)
        return pd.DataFrame({"l": frame["l"].iloc[:1].to_numpy(), "c": frame["c"].iloc[:1].to_numpy(), "n": [frame["n"].sum()], "s": [total.tobytes()]})

    kind = "l string, c int, n long, s binary"
    found = counted.mapInArrow(add, kind).groupBy("l", "c").applyInPandas(whole, kind).toPandas()
    sent.destroy()
    sums, sizes = {name: np.zeros(c.shape) for name, c in centroids.items()}, {name: np.zeros(len(c)) for name, c in centroids.items()}
    for r in found.itertuples():
        sums[r.l][r.c], sizes[r.l][r.c] = np.frombuffer(r.s), r.n
    return sums, sizes


def farthest(counted: DataFrame, idf: np.ndarray, centroids: Centroids) -> Centroids:
    """The vector of each language whose largest cosine with its centroids is least; ties (of 6 digits) to the smaller key."""
    sent = counted.sparkSession.sparkContext.broadcast((idf, centroids))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, chosen = sent.value
        best: dict[str, tuple] = {}
        for name, keys, v in by_language(batches, weights, chosen):
            near = np.round((v @ chosen[name].T).max(1).astype(float), 6)
            for i in np.flatnonzero(near == near.min()):
                mine = (near[i], keys[i] is not None, keys[i])
                if name not in best or mine[:2] < best[name][0][:2] or (mine[:2] == best[name][0][:2] and mine[1] and mine[2] < best[name][0][2]):
                    best[name] = mine, v[i].tobytes()
        if best:
            rows = [(name, near, key, v) for name, ((near, _, key), v) in best.items()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), arrow.types)], names=arrow.names)

    schema = T.StructType([T.StructField("l", T.StringType()), T.StructField("near", T.DoubleType()), T.StructField("k", counted.schema["k"].dataType), T.StructField("v", T.BinaryType())])
    arrow = to_arrow_schema(schema)
    found = counted.mapInArrow(find, schema).groupBy("l").agg(F.min_by("v", F.struct("near", "k")).alias("v")).toPandas()
    sent.destroy()
    return {r.l: np.frombuffer(r.v, np.float32) for r in found.itertuples()}


def clustered(counted: DataFrame, idf: np.ndarray, clusters: int, passes: int) -> Centroids:
    """Centroids of unit length by spherical k-means over all rows, started from the texts that lie farthest from those
    chosen.  Every step is a pass of all tasks over the packed counts; the driver holds the centroids only."""
    names = [r["l"] for r in counted.select("l").distinct().collect()]
    sums, sizes = nearest_sums(counted, idf, {name: np.zeros((1, len(idf)), np.float32) for name in names})
    rows = {name: int(n[0]) for name, n in sizes.items()}
    chosen = {name: (s / rows[name]).astype(np.float32) for name, s in sums.items()}
    for k in range(1, clusters):
        more = {name: c for name, c in chosen.items() if rows[name] > k}
        if not more:
            break
        for name, v in farthest(counted, idf, more).items():
            chosen[name] = np.vstack([chosen[name], v])
    for _ in range(passes):
        sums, sizes = nearest_sums(counted, idf, chosen)
        before, chosen = chosen, {}
        for name, c in before.items():
            moved = np.where(sizes[name][:, None] > 0, sums[name], c)
            chosen[name] = (moved / np.maximum(np.linalg.norm(moved, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        if all(np.array_equal(chosen[name], c) for name, c in before.items()):
            break
    return chosen


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", settings: Settings = Settings()) -> Model:
    """Centroids from the rows with a language and a letter; others teach nothing.  Without such rows, no centroids.

    Every such row of the languages that are learned counts, for the document frequencies, the centroids and the limits.
    The n-grams of their texts are counted once, in parallel, and kept in the shared folder during the fit, some 3 bytes for
    each distinct one of a text; the passes of the k-means read those.
    """
    s, spark = settings, docs.sparkSession
    known = short_batches(docs).where(F.col(lang).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    most = known.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(s.max_langs).collect()
    nothing = Model(np.ones(s.dims, np.float32), [], np.zeros((0, s.dims), np.float32), np.zeros((0, BANDS)), s.few)
    if not most:
        return nothing
    taught = known.join(F.broadcast(spark.createDataFrame([(r["l"],) for r in most], "l string")), "l").select("k", "t", "l")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            made = [gram_counts(t, s.dims) for t in b.column(1).to_pylist()]
            has = pa.array([x is not None for x in made], pa.bool_())
            at, n = zip(*(packed(x) for x in made if x is not None)) if any(x is not None for x in made) else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(has), b.column(2).filter(has), pa.array(at, pa.binary()), pa.array(n, pa.binary())], names=["k", "l", "at", "n"])

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(s.dims, np.int64), 0
        for b in batches:
            for x in b.column("at").to_pylist():
                total[np.frombuffer(x, place_type(s.dims))] += 1
            n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()], pa.binary())], names=["n", "df"])

    with scratch(spark) as keep:
        schema = T.StructType([T.StructField("k", docs.schema[key].dataType), T.StructField("l", T.StringType()), T.StructField("at", T.BinaryType()), T.StructField("n", T.BinaryType())])
        counted = keep(taught.mapInArrow(count, schema))
        sums = counted.mapInArrow(seen, "n long, df binary").toPandas()
        n = int(sums["n"].sum())
        if not n:
            return nothing
        df = np.sum([np.frombuffer(b, np.int64) for b in sums["df"]], axis=0)
        idf = (np.log((1 + n) / (1 + df)) + 0.1).astype(np.float32)
        found = clustered(counted, idf, s.clusters, s.passes)
        names = [name for name in sorted(found) for _ in found[name]]
        centroids = np.concatenate([found[name] for name in sorted(found)])
        sent = spark.sparkContext.broadcast((idf, names, centroids))

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, called, c = sent.value
            for _, v, sizes in unpacked_batches(batches, weights):
                cos = v @ c.T
                own = pa.array([called[i] for i in cos.argmax(1)], pa.string())
                bands = pa.array([band(k, s.few) for k in sizes], pa.int32())
                yield pa.RecordBatch.from_arrays([own, bands, pa.array(1.0 - cos.max(1).astype(float))], names=["l", "band", "far"])

        measured = keep(counted.mapInArrow(measure, "l string, band int, far double"))
        both = measured.select(F.explode(F.array(F.col("l"), F.lit(None).cast("string"))).alias("l"), "band", "far")
        far = order_stats.summary(both, ["l", "band"], "far", [s.quantile], {"n": F.count("*")}).select("l", "band", F.col("q")[0].alias("far"), "n").toPandas()
    return Model(idf, names, centroids, limits(far, names, s), s.few)


def identify(df: DataFrame, model: Model, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """df with lang_pred, score (cosine, 0 to 1) and rejected (or so named); columns so named in df are replaced.

    Whole texts are read, each row by itself.  A null text and one without letters is `und` with score 0 and rejected;
    with an empty model other texts are `und` with score 0 and not rejected.  Ties go to the first name in the alphabet.
    """
    kept = [c for c in short_batches(df).columns if c not in names]
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def named(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for texts in batches:
            out = []
            for at in range(0, len(texts), 256):
                made = [gram_counts(t, len(m.idf)) for t in texts.iloc[at : at + 256]]
                some = [x for x in made if x is not None]
                cosines = iter(vectors(np.array(some), m.idf) @ m.centroids.T if some and m.names else [])
                for x in made:
                    if x is None or not m.names:
                        out.append((UNKNOWN, 0.0, x is None))
                        continue
                    cos = next(cosines)
                    k = int(cos.argmax())
                    out.append((m.names[k], float(min(1.0, max(0.0, cos[k]))), bool(1.0 - cos[k] > m.reach[k, band(np.count_nonzero(x), m.few)])))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])

    fields = zip(("lang_pred", "score", "rejected"), names)
    (found,) = unused(kept, "_named")
    return df.select(*kept, named(text).alias(found)).select(*kept, *(F.col(f"{found}.{a}").alias(b) for a, b in fields))
