"""Best-two-fit packing of token pieces into sequences of a fixed length.

Pieces differ for packing only by their length, so the plan is made on the histogram of lengths (at most `size` counts,
whatever the input): a sequence is filled greedily with the longest pieces that fit, then its smallest piece gives way
to the two unpacked pieces that fit the gap so widened more tightly.  A pattern found so is repeated while the counts
last, hence the plan is short too.  Each piece then takes its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from loomcast.llm.bpe import BYTE_LEVEL_SPLIT, byte_letters
from loomcast.llm.common import short_batches, slices, stored, unused

#: What keeps a text from the fast encoder: letters outside the scripts and signs that every Unicode table of the last
#: ten years has alike, and runs of blanks that its regular expressions can't go back over.
_UNUSUAL = regex.compile(r"[^\x00-\u052f\u2010-\u2027\u2030-\u205e\u20a0-\u20bd\u2190-\u23f3]|\s{5000}")


def ranked_encoder(path: str) -> tiktoken.Encoding:
    """An encoder with the ids of a byte-level tokenizers file.

    Such a file numbers its tokens in the order of its merges, so the ids are the ranks; a file that doesn't is refused.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    vocab = spec["model"]["vocab"]
    pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
    order = [vocab[a + b] for a, b in pairs]
    if order != sorted(order) or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel":
        raise ValueError(f"not a plain byte-level file: {path}")
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in special}
    return tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens=special)


def library(path: str) -> Tokenizer:
    """The tokenizers library's own encoder of a file, without truncation and padding."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task for each core
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


_encoders: dict[str, tuple[tiktoken.Encoding, Tokenizer]] = {}


def text_ids(text: str | None, path: str) -> bytes:
    """The ids of a whole text as little-endian unsigned 32-bit numbers, as the tokenizers library gives them; a special
    token in the text is itself.

    The library encodes what is _UNUSUAL.  Other texts go through the same vocabulary and splits as ranks, which yields
    the same ids at some five times the speed.
    """
    if not text:
        return b""
    if path not in _encoders:
        _encoders[path] = ranked_encoder(path), library(path)
    ranks, exact = _encoders[path]
    if _UNUSUAL.search(text):
        return np.array(exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    return ranks.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()


def token_pieces(df: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 0, text: str = "text") -> DataFrame:
    """A row for each piece: df's other columns, piece, start, length and ids (little-endian unsigned 32-bit).

    A document is its ids and then end_id; null and empty texts are end_id alone.  Only documents longer than size are
    cut, into pieces of size tokens of which the first may be shorter.
    """
    out = ["piece", "start", "length", "ids"]
    kept = [c for c in df.columns if c not in (text, *out)]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, 0, 4 << 20):
            row, piece, start, ids = [], [], [], []
            for k, text_ in enumerate(batch.column(0).to_pylist()):
                whole = text_ids(text_, vocabulary) + end
                n, at, p = len(whole) // 4, 0, 0
                while at < n:
                    to = at + ((n - at) % size or size)
                    row.append(k)
                    piece.append(p)
                    start.append(at)
                    ids.append(whole[4 * at : 4 * to])
                    at, p = to, p + 1
            rest = batch.select(range(1, batch.num_columns)).take(pa.array(row, pa.int32())) if batch.num_columns > 1 else None
            made = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(rest.columns if rest else []), *made], names=[f.name for f in schema])

    return short_batches(df).select(text, *kept).mapInArrow(run, schema)


def best_two(counts: np.ndarray, gap: int) -> tuple[int, int]:
    """The two lengths left (counts by length) whose sum is the largest up to gap; (0, 0) if no two fit."""
    lengths = np.flatnonzero(counts)
    if not len(lengths):
        return 0, 0
    k = np.searchsorted(lengths, gap - lengths, side="right") - 1  # for each, the longest partner
    own = (k >= 0) & (lengths[k] == lengths) & (counts[lengths] < 2)
    k = np.where(own, k - 1, k)
    sums = np.where(k >= 0, lengths + lengths[k], 0)
    best = int(sums.argmax())
    return (int(lengths[best]), int(lengths[k[best]])) if sums[best] else (0, 0)


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """(how many sequences, the lengths in each of them) that use up the histogram of lengths."""
    counts = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    out: list[tuple[int, list[int]]] = []
    longest = size
    while True:
        while longest and not counts[longest]:
            longest -= 1
        if not longest:
            return out
        left, gap, chosen = counts.copy(), size, []
        while gap:
            fits = np.flatnonzero(left[: gap + 1])
            if not len(fits):
                break
            chosen.append(int(fits[-1]))
            left[chosen[-1]] -= 1
            gap -= chosen[-1]
        if gap and len(chosen) > 1:
            small = chosen[-1]
            a, b = best_two(left, gap + small)
            if a + b > small:
                chosen[-1:] = [a, b]
        used = Counter(chosen)
        times = int(min(counts[n] // k for n, k in used.items()))
        for n, k in used.items():
            counts[n] -= times * k
        out.append((times, chosen))


def pack(pieces: DataFrame, size: int = 2048, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """pieces, which has a long column length of 1 to size, with sequence_id and offset (gapless from 0).

    Rows are used as they are, repeated ones too; an empty table gives an empty one.  Ranks within a length are made in
    two steps: within buckets that hold a share of each length, then by the buckets' offsets, so that no length, however
    frequent, lies in one task.  Columns named sequence_id or offset are replaced; others keep their names and values.
    """
    pieces = stored(pieces.drop("sequence_id", "offset"))
    spark = pieces.sparkSession
    bucket, within, many, start_of, at = unused(pieces.columns, "_bucket", "_in", "_n", "_from", "_at")
    buckets = 4 * max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bucketed = pieces.withColumn(bucket, F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    order = [c for c in pieces.columns if c not in keys and c != "length"]
    ranked = bucketed.withColumn(within, F.row_number().over(Window.partitionBy(bucket, "length").orderBy(*keys, *order)) - 1)
    counts = stored(bucketed.groupBy(bucket, "length").agg(F.count("*").alias(many)))
    before = F.sum(many).over(Window.partitionBy("length").orderBy(bucket)) - F.col(many)
    offsets = counts.select(bucket, "length", before.alias(start_of))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum(many).alias("n")).collect()}

    # For each length, the patterns that hold it: the rank of its first piece, how many a sequence has, the first
    # sequence, and where the pieces lie in it.
    use: dict[int, list[tuple[int, int, int, list[int]]]] = {}
    sequence, taken = 0, Counter()
    for times, chosen in plan(histogram, size):
        places: dict[int, list[int]] = {}
        offset = 0
        for n in chosen:
            places.setdefault(n, []).append(offset)
            offset += n
        for n, where in places.items():
            use.setdefault(n, []).append((taken[n], len(where), sequence, where))
            taken[n] += times * len(where)
        sequence += times

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        out = np.empty((len(length), 2), np.int64)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        for n in np.unique(lengths):
            patterns, which = use[int(n)], np.flatnonzero(lengths == n)
            base, many, first = np.array([p[:3] for p in patterns]).T
            start = np.cumsum(many) - many
            k = np.searchsorted(base, ranks[which], side="right") - 1
            past = ranks[which] - base[k]
            out[which, 0] = first[k] + past // many[k]
            out[which, 1] = np.concatenate([p[3] for p in patterns])[start[k] + past % many[k]]
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    placed = ranked.join(offsets, [bucket, "length"]).withColumn(at, place("length", F.col(within) + F.col(start_of)))
    return placed.select(*pieces.columns, f"{at}.*")
