"""Exact duplicates, the prefix trie and hard negatives against brute force."""

import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomcast.llm import gracehash, negatives, queries, trie

BLANKS = re.compile(r"[\x20\x09-\x0D]")
TEXTS = [None, "", " \t\n", "a b c", "abc", "a  bc ", "ABC", "\x0ba\x0cb\rc", "a bc", "x" * 300_000, "x" * 299_999 + " x", "é́ z", "é́z", "tail"]


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def plain_copies(rows):
    """(doc_id, keep, size, kept, hash) by grouping in memory."""
    groups = {}
    for n, (key, text) in enumerate(rows):
        text = text or ""
        groups.setdefault(BLANKS.sub("", text), []).append((-len(text), key is None, key or 0, n))
    out = []
    for norm, members in groups.items():
        first = min(members)
        out += [(None if m[1] else m[2], None if first[1] else first[2], len(members), m[2:3] == first[2:3] and m[0] == first[0], hashlib.sha256(norm.encode()).hexdigest()) for m in members]
    return out


def listed(found):
    return sorted(((r.doc_id, r.keep, r.group_size, r.kept, r.sha256) for r in found.collect()), key=repr)


def weak(content):
    return bytes([len(content) % 2]) * 8


@pytest.mark.parametrize(("digest", "held"), [(gracehash.sha256, gracehash.HELD), (gracehash.sha256, 2_000), (weak, 60_000)])
def test_copies(spark, digest, held):
    r = random.Random(1)
    rows = list(enumerate(TEXTS)) + [(100 + k, r.choice(TEXTS[2:9])) for k in range(120)] + [(300 + k, f"text {k} {'y ' * r.randrange(99)}") for k in range(60)]
    r.shuffle(rows)
    got = gracehash.deduplicate(documents(spark, rows).repartition(7), digest=digest, held=held)
    assert listed(got) == sorted(plain_copies(rows), key=repr)


def test_copies_of_one_content_over_very_many_tables(spark):
    rows = [(k, "one text that is everywhere " * 40) for k in range(400)] + [(1000 + k, f"own {k}") for k in range(20)]
    got = listed(gracehash.deduplicate(documents(spark, rows).repartition(80), held=3_000))
    assert got == sorted(plain_copies(rows), key=repr)


def test_copies_with_repeated_rows_null_keys_and_clashing_columns(spark):
    rows = [(1, "a a"), (1, "a a"), (None, "a a"), (2, "aa"), (None, "b"), (None, "b"), (1 << 60, "c"), (-5, "c")]
    names = ("token", "row", "key", "content", "n", "digest", "bucket", "keep", "kept")
    got = gracehash.deduplicate(documents(spark, rows).select("*", *(F.lit(0).alias(c) for c in names)))
    found = got.toPandas()
    assert len(found) == 8 and found["kept"].sum() == 3 and list(found.columns) == ["doc_id", "keep", "group_size", "kept", "sha256"]
    assert listed(got)[:1] == listed(got.where("doc_id = -5")) and {(r.keep, r.group_size) for r in got.where("doc_id IN (1, 2)").collect()} == {(1, 4)}
    assert got.where("doc_id IS NULL AND keep IS NULL").count() == 2 and got.where("sha256 IS NULL").count() == 0
    assert gracehash.deduplicate(documents(spark, rows).limit(0)).count() == 0
    with pytest.raises(TypeError):
        gracehash.deduplicate(documents(spark, rows), key="text")


def test_open_addressing_tells_equal_hashes_apart():
    table = gracehash.Table()
    assert [table.find(7, b"%d" % k) for k in range(200)] == list(range(200))
    assert [table.find(7, b"%d" % k) for k in range(200)] == list(range(200)) and table.find(8, b"0") == 200


# ---- the trie -------------------------------------------------------------------------------------------------------

TURN = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    by = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in by.items()}
    nodes = {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = int(c - np.fmod(c, 20))
        whole = tuple(by.get(base, [])[:h] + own[h:])
        for d in range(len(whole) + 1):
            nodes.setdefault(whole[:d], ([], []))[0].append(c)
        nodes[whole][1].append(c)
    children = {}
    for key in nodes:
        if key:
            children.setdefault(key[:-1], []).append(key)
    out = []

    def fold(key):
        members, ends = nodes[key]
        saved = (len(members) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0
        leaves = 0
        for k in children.get(key, []):
            a, b = fold(k)
            leaves, saved = leaves + a, saved + b
        leaves = leaves or 1
        hashed = hashlib.sha256(",".join(map(str, sorted(ends))).encode()).hexdigest()
        out.append((min(members), len(key), min(nodes[key[:-1]][0]) if key else None, len(members), len(children.get(key, [])), leaves, saved, hashed))
        return leaves, saved

    if nodes:
        fold(())
    return sorted(out, key=repr)


def conversations(seed):
    r = random.Random(seed)
    rows = []
    for c in [*range(45), -40, -37, 10**12, 205, 206]:
        n = r.choice([1, 1, 2, 3, 5, 8, 30 if seed else 3])
        for t in range(n):  # equal turns would have no order of their own
            rows.append((c, None if t == 0 and r.random() < 0.2 else t, r.choice(["user", "assistant", None]) if t % 3 else "user", r.choice(["hello there", "a b  c", "", None, "  x\ty"]) if r.random() < 0.7 or t > 3 else f"text {r.randrange(3)}"))
    rows += [(None, 1, "user", "lost")]
    same = [(500 + k, t, "user", f"shared {t}") for k in range(3, 12) for t in range(90)]  # a long chain of one class
    return rows + (same if seed else [])


@pytest.mark.parametrize("seed", [0, 1])
def test_trie(spark, seed):
    rows = conversations(seed)
    df = spark.createDataFrame(rows, TURN).repartition(5)
    found = trie.prefix_trie(df.select("*", *(F.lit(3).alias(c) for c in ("depth", "label", "n", "pos", "digest", "words", "own"))))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_trie(rows)


def test_trie_of_odd_tables(spark):
    empty = spark.createDataFrame([], TURN)
    assert trie.prefix_trie(empty).count() == 0
    short = [c for c in range(21, 400) if zlib.crc32(str(c).encode()) % 4 == 3][0]
    one = trie.prefix_trie(spark.createDataFrame([(short, 0, "user", "x y")], TURN)).collect()  # its turn gives way to a conversation that isn't there
    assert [tuple(r) for r in one] == [(short, 0, None, 1, 0, 1, 0, hashlib.sha256(str(short).encode()).hexdigest())]
    twice = spark.createDataFrame([(0, 0, "user", "x"), (0, 0, "user", "x"), (1, 5, "user", "y")], TURN)
    assert sorted((r.depth, r.n_convs) for r in trie.prefix_trie(twice, rebuilt=False).collect()) == [(0, 2), (1, 1), (1, 1), (2, 1)]


def test_joined_ids_are_hashed_in_order_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 50)
    ids = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(b"a")).otherwise(F.lit(b"b")).alias("label"), (F.col("id") - 900).alias("conv_id")).repartition(9)
    got = {bytes(r.label): r.ends_sha256 for r in trie.joined_ids(ids).collect()}
    for label, keep in ((b"a", lambda k: k % 3 == 0), (b"b", lambda k: k % 3)):
        assert got[label] == hashlib.sha256(",".join(str(k - 900) for k in range(3000) if keep(k)).encode()).hexdigest()


# ---- hard negatives -------------------------------------------------------------------------------------------------


def plain_negatives(rows, anchors, scale, k=(5, 10)):
    best = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            best[i] = min(best.get(i, (label, v)), (label, v))
    width = max((len(v) for _, v in best.values()), default=0)
    whole = {i: ([int(np.floor(scale * x)) for x in v] + [0] * (width - len(v)), label) for i, (label, v) in best.items()}
    out = []
    for a in sorted(whole):
        if anchors(a):
            score = {i: sum(x * y for x, y in zip(whole[a][0], v)) for i, (v, _) in whole.items() if i != a}
            same = sorted((-s, i) for i, s in score.items() if whole[i][1] == whole[a][1])[: k[0]]
            for s, p in same:
                fit = sorted((-n, i) for i, n in score.items() if whole[i][1] != whole[a][1] and 30 * -s <= 100 * n <= 90 * -s)[: k[1]]
                out += [(a, p, rank, i, -s, -n) for rank, (n, i) in enumerate(fit, 1)]
    return sorted(out)


def vectors(spark, rows, kind=T.FloatType):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(kind())), T.StructField("label", T.IntegerType())])
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize(("kind", "scale"), [(T.FloatType, 256.0), (T.DoubleType, 1e5), (T.DoubleType, 3e8)])
def test_negatives(spark, kind, scale):
    g = np.random.default_rng(7)
    m = g.normal(size=(1500, 6))
    m[::3] = m[0] / 2  # a third of the rows are copies, so that scores tie
    m = (m / np.linalg.norm(m, axis=1, keepdims=True) * 0.5 + 0.3).astype(np.float32).astype(float)
    rows = [(k if k != 11 else 10**15, [float(x) for x in v], int(c)) for k, (v, c) in enumerate(zip(m, g.integers(0, 3, len(m))))]
    rows += [(2000, None, 1), (2001, [None, 1.0], 1), (2002, [float("nan")], 1), (2003, [1.0, float("inf")], 0), (2004, [0.5], None), (None, [0.5], 1), (2100, [0.5, 0.1], 2), (2100, [0.5, 0.1], 2), (2100, [0.9], 3)]
    found = negatives.mine(vectors(spark, rows, kind), F.col("vec_id") % 100 == 0, F.col("label"), scale=scale, sizes=(6, 700))
    got = sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in found.collect())
    assert len(got) > 300 and got == plain_negatives(rows, lambda a: a % 100 == 0, scale)


def test_negatives_of_odd_tables(spark):
    anchor = F.col("vec_id") % 100 == 0
    assert negatives.mine(vectors(spark, []), anchor, F.col("label")).count() == 0
    alone = [(0, [1.0], 1), (1, [1.0], 2), (100, [-1.0], 2)]
    assert negatives.mine(vectors(spark, alone), anchor, F.col("label")).count() == 0  # no positive, or one that is no window
    few = [(0, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2), (3, [0.95], 2)]
    df = vectors(spark, few).select("*", *(F.lit(1).alias(c) for c in ("id", "extra", "v", "block", "score", "rank", "anchor", "other")))
    assert [tuple(r)[:4] for r in negatives.mine(df, anchor, F.col("label")).collect()] == [(0, 1, 1, 2)]
    with pytest.raises(ValueError, match="fit in a long"):
        negatives.mine(vectors(spark, [(0, [1e300], 1)], T.DoubleType), anchor, F.col("label"))


# ---- the queries ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op12_prefix_trie", "op13_hard_negatives"])
def test_queries_against_sql(spark, sf, name):
    c = duckdb.connect()
    for file in os.listdir(sf):
        c.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{file}'")
    want = c.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, sf).toPandas()
    assert set(got.columns) == set(want.columns)

    def told(frame: pd.DataFrame) -> list[str]:
        plain = lambda x: None if pd.isna(x) else int(x) if isinstance(x, (int, float, np.number)) and x == int(x) else x  # noqa: E731  nulls make longs floats
        return sorted(repr([plain(x) for x in row]) for row in frame[sorted(want.columns)].astype(object).itertuples(index=False))

    assert told(got) == told(want) and len(got)
