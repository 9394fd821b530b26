"""The text operators on Spark: planted cases, odd rows, empty tables, clashing columns."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomcast.llm import bpe, jaccard, langid, packing, pages, queries, suffixes, toxicity, urls, vectors
from loomcast.llm.common import components

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n, stock=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(stock)}" for _ in range(n))


def documents(spark, texts, extra=False):
    rows = [(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC)
    return df.select("*", *(F.lit(1).alias(c) for c in ("id", "t", "n", "h", "score", "predicted", "label", "piece", "key", "ids", "rep"))) if extra else df


BASE = prose(1, 120)
NEAR = " ".join(["changed", *BASE.split()[1:]])
ODD = [None, "", "  \n ", "one", "one two", BASE, BASE, NEAR, BASE.upper(), prose(2, 9000), prose(3, 200), "x" * 20000]


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (7, 9), (3, 3), (1, 1)], "src long, dst long")
    assert {(r.node, r.root) for r in components(e).collect()} == {(5, 3), (4, 3), (3, 3), (9, 7), (8, 7), (7, 7)}
    chain = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert components(chain).where("root <> 0").count() == 0
    assert components(e.limit(0)).count() == 0


@pytest.mark.parametrize("extra", [False, True])
def test_jaccard_odd_rows(spark, extra):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(documents(spark, ODD, extra)).collect()}
    assert len(got) == len(ODD)
    assert [got[k][0] for k in range(5)] == [0, 0, 0, 1, 1] and [got[k][1] for k in range(5)] == list(range(5))
    assert [got[k][1] for k in (5, 6, 7, 8)] == [5] * 4 and got[9][1] == 9 and got[11] == (1, 11)


def test_jaccard_against_brute_force_with_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 16)
    monkeypatch.setattr(jaccard, "CHUNK", 600)
    r = random.Random(5)
    texts = []
    for g in range(12):
        words = prose(100 + g, r.randrange(6, 90)).split()
        for _ in range(r.randrange(1, 12)):
            new = list(words)
            for _ in range(r.randrange(0, 3)):
                new[r.randrange(len(new))] = f"e{r.randrange(10**6)}"
            texts.append(" ".join(new))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {x.doc_id: x.component_id for x in jaccard.join(documents(spark, texts)).collect()}
    assert got == {k: find(k) for k in range(len(texts))}


def test_jaccard_tiles_are_bounded_by_bytes(spark, monkeypatch):
    """Long texts make large bitmaps: with a bound of two of them to a tile, all links are found still."""
    monkeypatch.setattr(jaccard, "TILE_BYTES", 4096)
    texts = [prose(200 + k // 3, 4000 + k % 3, stock=10**6) for k in range(24)]
    packed = []
    plain = jaccard.candidate_edges

    def watched(classes, percent, put):
        def kept(df):
            out = put(df)
            if out.columns == ["band", "part", "ids", "n", "bits"]:
                packed.extend(out.agg(F.count("*"), F.max(F.length("bits"))).collect())
            return out

        return plain(classes, percent, kept)

    monkeypatch.setattr(jaccard, "candidate_edges", watched)
    got = {r.doc_id: r.component_id for r in jaccard.join(documents(spark, texts)).collect()}
    assert got == {k: k - k % 3 for k in range(24)}
    assert packed[0][0] > 5 and packed[0][1] <= 6 * 2048


def test_jaccard_leaves_texts_that_share_little_out_of_the_tiles(spark, monkeypatch):
    """Whatever the blocks and buckets, only classes that share enough shingles are compared pair by pair; no link is lost."""
    monkeypatch.setattr(jaccard, "BLOCK", 700)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 9)
    monkeypatch.setattr(jaccard, "BUCKETS", 8)
    monkeypatch.setattr(jaccard, "MEET", 400)
    r = random.Random(8)
    line = prose(900, 20)
    texts = [prose(300 + k, r.randrange(30, 90), stock=10**6) + " " + line for k in range(90)]
    texts += texts[:30] + [t.upper() for t in texts[10:20]]
    for words in (t.split() for t in texts[40:60]):
        for _ in range(r.randrange(1, 4)):
            words[r.randrange(len(words))] = f"e{r.randrange(10**6)}"  # about the threshold: up to 15 shingles of 46 to 106 change
            texts.append(" ".join(words))
    texts += ["one", "one two", "one", "a b c d e", "a b c d e f", "a b c d e f g", "", None]
    r.shuffle(texts)
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    different = {frozenset(s) for s in sets if s}
    often = {x for x, k in Counter(x for s in different for x in s).items() if k > 1}
    met = []
    plain = jaccard.candidate_edges
    monkeypatch.setattr(jaccard, "candidate_edges", lambda classes, percent, put: met.extend(x.id for x in classes.collect()) or plain(classes, percent, put))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.join(documents(spark, texts).repartition(5)).collect()}
    assert got == {k: (len(sets[k]), root[k]) for k in range(len(texts))}
    linked = {root[k] for k in range(len(texts)) if len({frozenset(sets[j]) for j in range(len(texts)) if root[j] == root[k]}) > 1}
    assert len(linked) > 10 and linked <= {root[k] for k in met}
    assert len(met) == len(set(met)) < len(different) / 2
    assert all(100 * len(sets[k] & often) >= 75 * len(sets[k]) for k in met)


def test_jaccard_empty(spark):
    assert jaccard.join(documents(spark, [])).count() == 0


def test_suffixes_find_planted_passages(spark):
    passage = prose(7, 55)
    texts = [prose(10, 80) + " " + passage + " " + prose(11, 30), prose(12, 60), passage + " " + prose(13, 70), prose(14, 70) + " " + passage.upper(), prose(15, 40) + " " + " ".join(passage.split()[:40]), *ODD]
    got = {}
    for r in suffixes.repeated(documents(spark, texts, True)).collect():
        got.setdefault(r.id, set()).update(range(r.start, r.stop))
        a, b = texts[r.id].lower().split(), texts[r.other].lower().split()
        assert a[r.start : r.stop] == b[r.start - r.diag : r.stop - r.diag] and r.other < r.id
    assert got[2] >= set(range(55)) and got[3] >= set(range(70, 125))
    assert not {0, 1, 4} & set(got) and {11, 12, 13} <= set(got)


def covered(spark, texts):
    """The words that suffixes.repeated marks, and those of passages of 50 words in an earlier text."""
    got, want, seen = set(), set(), {}
    for r in suffixes.repeated(documents(spark, texts)).collect():
        a, b = texts[r.id].split(), texts[r.other].split()
        assert r.other < r.id and a[r.start : r.stop] == b[r.start - r.diag : r.stop - r.diag]
        got |= {(r.id, w) for w in range(r.start, r.stop)}
    for k, t in enumerate(texts):
        w = t.split()
        for x in range(len(w) - 49):
            if seen.setdefault(tuple(w[x : x + 50]), k) < k:
                want |= {(k, y) for y in range(x, x + 50)}
    return got, want


def test_suffixes_cover_overlapping_passages_of_several_documents(spark):
    texts, late, r = [], [], random.Random(3)
    for k in range(60):
        words = prose(500 + k, 400, 10**6).split()
        late.append(" ".join(words))
        at = 0
        while at < 330:
            n = r.randrange(50, 70)
            texts.append(" ".join([prose(r.random(), 20, 10**6), *words[at : at + n], prose(r.random(), 20, 10**6)]))
            at += r.randrange(1, 60)
    got, want = covered(spark, texts + late)
    assert got == want and len(want) > 10_000


def test_suffixes_of_one_lead_with_several_endings(spark):
    texts = []
    for k in range(40):
        lead = prose(900 + k, 49, 10**6)
        for ending in ("a", "b", "b", "c", "b", "c"):
            texts.append(f"{prose(len(texts), 30, 10**6)} {lead} {prose(f"{k}{ending}", 6, 10**6)} {prose(-1 - len(texts), 30, 10**6)}")
    got, want = covered(spark, texts)
    assert got == want and {k for k, _ in want} == {6 * g + e for g in range(40) for e in (2, 4, 5)}


def repeats_by_force(texts, least=50):
    """The rows of suffixes.repeated: passages by their first place in the smallest document, joined, then a cover."""
    heads, out = {}, []
    for k, t in enumerate(texts):
        w, found = (t or "").lower().split(), {}
        for p in range(len(w) - least + 1):
            other, at = heads.setdefault(tuple(w[p : p + least]), (k, p))
            if other != k:
                found.setdefault((other, p - at), []).append(p)
        spans = []
        for (other, diag), starts in found.items():
            lo = last = starts[0]
            for p in [*starts[1:], 10**9]:
                if p > last + least:
                    spans.append((lo, last + least, other, diag))
                    lo = p
                last = p
        end = -1
        while left := [s for s in spans if s[1] > end]:
            within = [s for s in left if s[0] <= end]
            best = max(within, key=lambda s: (s[1], -s[0], -s[2], -s[3])) if within else min(left, key=lambda s: (s[0], -s[1], s[2], s[3]))
            out.append((k, *best))
            end = best[1]
    return sorted(out)


def shuffled_stock(seed):
    """Texts with shared leads, quotes of quotes, copies, inner repeats and odd ones."""
    r, texts = random.Random(seed), []
    leads = [prose(f"{seed}{k}", r.randrange(30, 49), 10**6) for k in range(3)]
    for k in range(70):
        parts = [prose(f"{seed}-{k}", r.randrange(5, 60), 10**6)]
        for _ in range(r.randrange(3)):
            w = r.choice(texts or ["none"]).split()
            at = r.randrange(len(w))
            parts.append(" ".join(w[at : at + r.randrange(40, 150)]))
        if r.random() < 0.5:
            parts.append(f"{r.choice(leads)} {prose(r.randrange(9), 20, 10**6)}")
        r.shuffle(parts)
        texts.append(r.choice(texts) if texts and r.random() < 0.15 else " ".join(parts))
    chorus = prose(f"{seed}c", 60, 10**6)
    return [*texts, texts[3] + " " + texts[3], f"{chorus} {prose(seed, 9)} {chorus} {chorus}", f"a {chorus} {chorus} b {chorus}", None, ""]


@pytest.mark.parametrize("split", [False, True])
def test_suffixes_are_a_function_of_the_table(spark, monkeypatch, split):
    if split:  # every seed counts as frequent
        monkeypatch.setattr(suffixes, "SAMPLE", 1)
        monkeypatch.setattr(suffixes, "FREQUENT", 1)
    texts = shuffled_stock(4)
    want = repeats_by_force(texts)
    assert len(want) > 50
    docs = documents(spark, texts)
    for n in (1, 4, 16):
        got = sorted((r.id, r.start, r.stop, r.other, r.diag) for r in suffixes.repeated(docs.repartition(n, F.xxhash64("doc_id", F.lit(n)))).collect())
        assert got == want


def test_suffixes_cut(spark):
    passage = prose(7, 60)
    docs = documents(spark, [prose(8, 60) + " " + passage, passage, passage + " tail", None, ""], True)
    out = {r.doc_id: r for r in suffixes.cut(docs, suffixes.repeated(docs)).collect()}
    assert out[2].text == "tail" and out[2].n_chars == 4 and 1 not in out and out[3].text is None and out[4].text == ""
    assert out[0].text == prose(8, 60) + " " + passage
    assert suffixes.cut(docs, suffixes.repeated(docs)).columns == docs.columns
    assert suffixes.repeated(documents(spark, [])).count() == 0


VECTORS = "vec_id long, embedding array<{}>, label int"


def linked_by_force(x, least=0.95):
    """Links and smallest reachable row of each row of x."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= least
    root = list(range(len(x)))
    for _ in range(len(x)):
        new = [min(root[j] for j in np.flatnonzero(link[i])) for i in range(len(x))]
        if new == root:
            return link.sum(1) - 1, root
        root = new


@pytest.mark.parametrize(("width", "kind"), [(1, "double"), (8, "float"), (16, "double"), (17, "float"), (64, "double")])
def test_vectors_in_several_blocks_against_brute_force(spark, width, kind):
    rng = np.random.default_rng(width)
    x = rng.normal(size=(150, width))
    for k in range(30, 120):  # chains and groups
        x[k] = x[rng.integers(30)] + rng.choice([0.05, 0.12, 0.2]) * rng.normal(size=width)
    x[140:145] = x[0]
    x = x.astype(np.float32).astype(float)
    ids = rng.permutation(150) * 7
    df = spark.createDataFrame([(int(i), [float(c) for c in r], 1) for i, r in zip(ids, x)], VECTORS.format(kind)).select("*", F.lit(1).alias("id"), F.lit(2).alias("v"), F.lit(3).alias("extra"))
    order = np.argsort(ids)
    links, root = linked_by_force(x[order])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df, block=40, steps=(5, 9)).collect()}
    assert got == {int(ids[order[k]]): (links[k], ids[order[root[k]]], root[k] == k) for k in range(150)}
    z = {int(i): np.floor(64 * r) for i, r in zip(ids, x)}
    best = {}
    for r in vectors.top_k(df, F.col("vec_id") % 20 == 0, k=6, sizes=(3, 20, 2)).orderBy("query_id", "rank").collect():
        best.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    assert set(best) == {i for i in z if i % 20 == 0}
    for q in best:
        want = sorted(((int(z[q] @ z[i]), i) for i in z if i != q), key=lambda p: (-p[0], p[1]))[:6]
        assert best[q] == [(n, *w) for n, w in enumerate(want, 1)]


def test_vectors_odd_rows_and_large_keys(spark):
    far = 2**60
    rows = [(far, [1.0, 0.0], 1), (far + 1, [1.0, 0.0], 1), (far + 2, [0.9, 0.1, 0.0], 1), (60, None, 1), (61, [0.0, 0.0], 1), (62, [float("nan"), 1.0], 1), (63, [1.0, None], 1), (64, [], 1), (65, [float("inf"), 1.0], 1), (None, [1.0, 0.0], 1), (7, [1e-200, 1e-200], 1), (8, [1e200, 1e200], 1)]
    df = spark.createDataFrame(rows, VECTORS.format("double"))
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df).collect()}
    assert got == {far: (2, far), far + 1: (2, far), far + 2: (2, far), 7: (1, 7), 8: (1, 7)} | {k: (0, k) for k in (60, 61, 62, 63, 64, 65)}
    top = [(r.query_id, r.rank, r.vec_id, r.score) for r in vectors.top_k(df.where("vec_id <> 8"), F.col("vec_id") >= far, k=3).orderBy("query_id", "rank").collect()]
    assert top[:3] == [(far, 1, far + 1, 4096), (far, 2, far + 2, 64 * 57), (far, 3, 7, 0)] and [t[2] for t in top[3:6]] == [far, far + 2, 7]
    empty = df.limit(0)
    assert vectors.near_duplicates(empty).count() == 0 and vectors.top_k(empty, F.lit(True)).count() == 0
    with pytest.raises(TypeError):
        vectors.near_duplicates(df.withColumn("vec_id", F.col("vec_id").cast("string")))


def test_packing_ids_are_the_librarys(spark, small):
    """Every document of a table, and texts that other encoders fail on: ids, checksums, pieces."""
    t = packing.library(queries.public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    odd = [None, "", "a" + " " * 2_000_000 + "b", "x" * 300_000, "\n \n" * 40_000, "<|endoftext|> a", "\u1c89 \U0001fae9 \u4e00", prose(2, 9000)]
    docs = docs.union(spark.createDataFrame([(10**9 + k, x) for k, x in enumerate(odd)], "doc_id long, text string"))
    got = queries.packed(docs).toPandas()
    want = {}
    for r in docs.collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r.doc_id, p] = (a, b - a, zlib.crc32(ids[a:b].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["length"].sum() <= 2048 and (g["offset"].to_numpy() == np.cumsum(g["length"]) - g["length"]).all()
    assert got["sequence_id"].nunique() <= got["length"].sum() / 2048 + 2


def test_packing_leaves_other_columns_alone(spark):
    names = ("_bucket", "_in", "_n", "_from", "_at", "offset", "Sequence_ID")
    docs = documents(spark, ODD).select("doc_id", "text", *(F.lit(77).alias(c) for c in names))
    got = packing.pack(packing.token_pieces(docs, queries.public_tokenizers.path("byte_bpe_50k.json"))).collect()
    assert got and all(r[c] == 77 for r in got for c in names[:5]) and all(0 <= r.offset < 2048 for r in got)


def test_packing_is_whole_and_gapless(spark):
    vocabulary = queries.public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack(packing.token_pieces(documents(spark, ODD).select("doc_id", "text"), vocabulary, size=256), size=256).toPandas()
    for _, g in got.groupby("doc_id"):
        g = g.sort_values("piece")
        assert (g["length"].iloc[1:] == 256).all() and (g["start"].to_numpy() == np.cumsum(g["length"]) - g["length"]).all()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["length"].sum() <= 256 and (g["offset"].to_numpy() == np.cumsum(g["length"]) - g["length"]).all()
    assert set(got["doc_id"]) == set(range(len(ODD))) and got[got.doc_id == 0]["length"].tolist() == [1]
    assert got["sequence_id"].nunique() <= got["length"].sum() / 256 + 2
    assert packing.pack(packing.token_pieces(documents(spark, []), vocabulary)).count() == 0


def test_bpe_frames(spark):
    path = queries.public_tokenizers.path("word_bpe_49k.json")
    got = {r.doc_id: r for r in bpe.encode_decode(documents(spark, ODD, True), path).collect()}
    assert got[0].ids == [] and got[0].decoded == "" and got[3].decoded == "one</w>" and len(got) == len(ODD)


def test_pages_and_urls_frames(spark):
    df = spark.createDataFrame([(1, "http://a.net/x", "<p>Hi, <b>you</b></p>"), (2, None, None), (2, None, None), (3, "https://m.example.net/en/1", "")], "page_id long, url string, html string").withColumn("text", F.lit("old"))
    assert {(r.page_id, r.text, r.n_chars) for r in pages.extract(df).collect()} == {(1, "Hi, you", 7), (2, "", 0), (3, "", 0)}
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(df).where("page_id <> 2").collect()) == [(1, "a.net", "/x", "net/", "block"), (3, "m.example.net", "/en/1", "example.net/en/", "allow")]
    assert urls.filter_urls(df).count() == 4 and urls.filter_urls(df.limit(0)).count() == 0 and pages.extract(df.limit(0)).count() == 0
    bad = spark.createDataFrame([("https://www.cheap-pills.org/de/1",)], "url string")
    assert urls.filter_urls(bad).first().verdict == "block"


def labelled(spark, n=300):
    texts = [prose(1000 + k, 30, 60) + (" you moron idiot" if k % 3 == 0 else "") for k in range(n)]
    return documents(spark, texts), spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(n)] + [(None, 1), (5, None)], "doc_id long, toxic int")


def test_toxicity_learns(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert np.mean([got[k].predicted == (k % 3 == 0) for k in got]) > 0.97
    odd = toxicity.score(documents(spark, ODD, True), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd) and odd[0].score == odd[1].score
    none = toxicity.score(docs, toxicity.fit(docs, labels.limit(0)))
    assert none.where("predicted = 1").count() == 0


def test_language_learns(spark):
    rows = [(k, t, lang, "s", len(t)) for k, (t, lang) in enumerate((" ".join(random.Random(k).choices(v, k=12)), lang) for k in range(120) for lang, v in (("xx", ["abba", "bela", "cabo", "dalia"]), ("yy", ["tschu", "krott", "pfuz", "schnir"])))]
    docs = spark.createDataFrame(rows, DOC)
    model = langid.fit(docs)
    got = langid.identify(docs, model)
    assert got.where("lang <> lang_pred OR rejected").count() == 0
    odd = {r.doc_id: r for r in langid.identify(documents(spark, [None, "", "12 !", "ЖЖЖЖ ЩЩЩ", "abba bela"], True), model).collect()}
    assert [odd[k].lang_pred for k in range(3)] == ["und"] * 3 and all(odd[k].rejected and odd[k].score == 0 for k in range(3))
    assert odd[3].rejected and odd[4].lang_pred == "xx" and not odd[4].rejected
    empty = langid.identify(docs, langid.fit(docs.limit(0)))
    assert empty.where("lang_pred <> 'und' OR rejected").count() == 0


def test_language_learns_from_every_row(spark):
    """Document frequencies, centroids and limits against plain ones over all rows of a language, of which a sample was taken
    beyond 1,500."""
    stock = [("".join(random.Random(f"{lang}{k}").choices(letters, k=3 + k % 5)), lang) for lang, letters in (("xx", "abdeilmno"), ("yy", "ghkpruwyz")) for k in range(60)]
    rows = [(k, " ".join(random.Random(k).choices([w for w, x in stock if x == lang], k=2 + k % 40)), lang) for k in range(3600) for lang in ("xx" if k % 12 else "yy",)]
    docs = spark.createDataFrame(rows + [(None, None, "xx"), (9999, "12 !", "yy"), (9998, "abba", None)], "doc_id long, text string, lang string").repartition(7)
    s = langid.Settings(dims=1024)
    model = langid.fit(docs, settings=s)
    counts = np.array([langid.gram_counts(t, s.dims) for _, t, _ in rows])
    assert model.idf == pytest.approx(np.log((1 + len(rows)) / (1 + (counts > 0).sum(0))) + 0.1, rel=1e-6)
    v, langs, whole = langid.vectors(counts, model.idf), np.array([r[2] for r in rows]), []
    for lang in ("xx", "yy"):
        x = v[langs == lang]
        c = [x.mean(0)]
        for _ in range(s.clusters - 1):
            c.append(x[np.round((x @ np.array(c).T).max(1).astype(float), 6).argmin()])
        for _ in range(s.passes):
            own = (x @ np.array(c).T).argmax(1)
            c = [x[own == k].sum(0) if (own == k).any() else c[k] for k in range(len(c))]
            c = [r / np.linalg.norm(r) for r in c]
        whole += c
    assert model.names == ["xx"] * 4 + ["yy"] * 4 and model.centroids == pytest.approx(np.array(whole), abs=1e-4)
    cos = v @ model.centroids.T
    named, far = np.array(model.names)[cos.argmax(1)], 1.0 - cos.max(1)
    bands = np.array([langid.band(np.count_nonzero(c), s.few) for c in counts])
    for k in set(bands):
        own = far[(named == "xx") & (bands == k)]
        assert len(own) >= s.enough and model.reach[0, k] == pytest.approx(max(np.quantile(own, s.quantile) * s.slack, s.near if k else s.floor), abs=1e-5)


def test_nearest_centroid_by_brute_force(spark, sf):
    """Weights and decisions of the model against plain loops over the n-grams of whole texts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    settings = langid.Settings(dims=1 << 16)  # few n-grams share a dimension
    model = langid.fit(docs, settings=settings)
    counts, df, texts = {}, {}, {r.doc_id: r for r in docs.collect()}

    def dimension(gram):
        h = 0
        for c, (mix, odd) in zip(gram, ((None, 0x9E3779B1), (0x85EBCA6B, 0xC2B2AE35), (0x27D4EB2F, 0x165667B1))):
            h = (ord(c) * odd if mix is None else (h ^ ord(c) * mix & 0xFFFFFFFF) * odd) & 0xFFFFFFFF
        return h >> 16

    for r in texts.values():
        letters = "".join(c if c.isalpha() or unicodedata.category(c)[0] == "M" else " " for c in r.text or "").lower()
        words = " " + re.sub(" +", " ", letters) + " "
        if any(c.isalpha() for c in letters):
            own = counts[r.doc_id] = {}
            for n in (1, 2, 3):
                for at in range(len(words) - n + 1):
                    d = dimension(words[at : at + n])
                    own[d] = own.get(d, 0) + 1
            if r.lang is not None:
                for d in own:
                    df[d] = df.get(d, 0) + 1
    n = sum(texts[k].lang is not None for k in counts)
    for d in random.Random(1).sample(sorted(df), 500):
        assert model.idf[d] == pytest.approx(np.log((1 + n) / (1 + df[d])) + 0.1, rel=1e-5)
    wrong = 0
    for r in langid.identify(docs, model).collect():
        own = counts.get(r.doc_id)
        if own is None:
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        weights = {d: np.log1p(c) * float(model.idf[d]) for d, c in own.items()}
        length = sum(w * w for w in weights.values()) ** 0.5
        cosines = [sum(w * float(c[d]) for d, w in weights.items()) / length for c in model.centroids]
        best = max(cosines)
        assert r.score == pytest.approx(max(0.0, best), abs=1e-4) and r.lang_pred in {name for name, c in zip(model.names, cosines) if c > best - 1e-4}
        wrong += r.lang_pred != texts[r.doc_id].lang
    assert wrong < 0.05 * len(counts)


def test_only_the_most_frequent_languages_are_learned(spark):
    rows = [(k, prose(k, 30), "en" if k % 2 else "de" if k % 4 else f"junk {k}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(langid.fit(docs, settings=langid.Settings(max_langs=2)).names) == {"de", "en"}


def test_language_rejects_foreign_and_junk_texts_of_any_length(spark):
    def text(seed, letters, n):
        r = random.Random(seed)
        stock = ["".join(random.Random(f"{letters}{k}").choices(letters, k=3 + k % 6)) for k in range(300)]
        return " ".join(r.choices(stock, k=n))

    sizes = (6, 12, 30, 100, 400, 900)
    clean = [(text(f"{lang}{k}", lang, sizes[k % 6]), lang) for k in range(600) for lang in ("abdeilmnorst", "aeghkmpruwyz")]
    docs = spark.createDataFrame([(k, t, lang, "s", len(t)) for k, (t, lang) in enumerate(clean)], DOC)
    model = langid.fit(docs.where("doc_id % 3 <> 1"))
    assert langid.identify(docs, model).where("rejected OR lang <> lang_pred").count() == 0
    foreign = [text(f"f{k}", letters, n) for k in range(5) for n in (30, 100, 400) for letters in ("абвгдежзиклмнопрст", "αβγδεζηθικλμνξοπ", "bcdfghjklmnpqrstvwxz", "".join(map(chr, range(0x4E00, 0x4F00))))]
    # random strings of the learned letters are another matter; these share none or few of the n-grams
    assert langid.identify(documents(spark, foreign), model).where("NOT rejected").count() == 0


def test_contract_queries_on_small_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    three = queries.op3_toxicity(spark, sf).toPandas()
    assert len(three) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in three.itertuples())
    four = queries.op4_language(spark, sf).toPandas().merge(docs[["doc_id", "lang"]], on="doc_id")
    held = four[four["held_out"] & (four["lang_pred"] != "und")]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in four.itertuples()) and (held["lang"] == held["lang_pred"]).mean() > 0.95
    ten = queries.op10_bpe(spark, sf).toPandas().set_index("doc_id")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.public_tokenizers.path("word_bpe_49k.json"))
    for r in docs.head(40).itertuples():
        e = t.encode(r.text, add_special_tokens=False)
        assert ten.loc[r.doc_id, "n_tokens"] == len(e.ids)
        assert ten.loc[r.doc_id, "ids_sha256"] == hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest()
        assert ten.loc[r.doc_id, "decoded_sha256"] == hashlib.sha256(t.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()


def test_url_query_against_sql(spark, sf):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = c.execute(urls.ORACLE).fetchall()
    got = [tuple(r) for r in queries.op7_url_filters(spark, sf).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_thousands_of_url_rules_against_a_scan_of_all(spark):
    r = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    rules = [urls.site_rule(r.choice(("allow", "block")), f"{r.choice(words)}.{r.choice(('net', 'org'))}/{r.choice(('', 'w1/', 'w2'))}") for _ in range(1500)]
    rules += [urls.pattern_rule("block", p) for p in (rf"[/.]{a}-{b}/" for a, b in (r.sample(words, 2) for _ in range(800)))] + [urls.pattern_rule("allow", rf"/{w[:-1]}\d?/") for w in words[:300]]
    links = [f"https://{r.choice(('', 'm.', 'W3.'))}{r.choice(words)}.{r.choice(('net', 'org', 'com'))}/{r.choice(words)}{r.choice('/-')}{r.choice(words)}/{r.choice(words)}" for _ in range(1500)] + [None, "", "x"]
    got = urls.filter_urls(spark.createDataFrame(list(enumerate(links)), "id long, url string").withColumn("_judged", F.lit(1)), rules).collect()
    named, compiled = 0, [re.compile(rule.pattern) for rule in rules]
    for row in got:
        host, path = urls.parts(links[row.id])
        fit = [k for k, p in enumerate(compiled) if host and p.search(host + path)]
        best = max(fit, key=lambda k: (rules[k].rank, -k), default=None)
        assert (row.rule, row.verdict, row._judged) == ((rules[best].name, rules[best].verdict, 1) if best is not None else (None, "allow", 1))
        named += best is not None
    assert len(got) == len(links) and 200 < named < 1500


def test_pipeline_stages(spark, tmp_path):
    docs, labels = labelled(spark, 120)
    passage = prose(7, 60, 50)
    more = [prose(50, 70, 60), prose(50, 70, 60), prose(51, 40, 60) + " " + passage, prose(52, 40, 60) + " " + passage, "12 34", None]
    docs = docs.union(documents(spark, more).withColumn("doc_id", F.col("doc_id") + 1000))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        new = stage(spark, now, str(tmp_path))
        if k < 4:
            assert new.columns == now.columns
        new.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r.doc_id for r in now.select("doc_id").collect()})
    assert {1000, 1001, 1002, 1003, 1004, 1005} <= kept[0] and len(kept[0] & set(range(0, 120, 3))) <= 2
    assert not {1004, 1005} & kept[1] and {1000, 1001} <= kept[1]
    assert 1000 in kept[2] and 1001 not in kept[2] and {1002, 1003} <= kept[2]
    cut = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/3").collect()}
    assert passage in cut[1002] and passage not in cut[1003] and cut[1003].startswith(prose(52, 40, 60))
    assert kept[4] == kept[3] and corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()


def test_pipeline_stages_against_brute_force(spark):
    """Near copies by all pairs, then repeats among what is left, cut by word numbers."""
    texts = shuffled_stock(11)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in texts]
    link = [[bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b) for b in sets] for a in sets]
    root = list(range(len(texts)))
    for _ in texts:
        root = [min([root[i], *(root[j] for j in range(len(texts)) if link[i][j])]) for i in range(len(texts))]
    kept = [k for k in range(len(texts)) if root[k] == k]
    assert len(kept) < len(texts) - 3
    docs = documents(spark, texts)
    left = corpus_pipeline.near_copies_out(spark, docs, "")
    assert sorted(r.doc_id for r in left.collect()) == kept
    cuts = {}
    for k, start, stop, *_ in repeats_by_force([texts[k] for k in kept]):
        cuts.setdefault(kept[k], set()).update(range(start, stop))
    want = {}
    for k in kept:
        words = [w for n, w in enumerate((texts[k] or "").split()) if n not in cuts.get(k, ())]
        if words or k not in cuts:
            want[k] = words
    got = {r.doc_id: r for r in corpus_pipeline.repeats_out(spark, left, "").collect()}
    assert {k: (r.text or "").split() for k, r in got.items()} == want and len(cuts) > 20
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got.values())


def test_pipeline_of_empty_tables_and_clashing_columns(spark, tmp_path):
    docs, labels = labelled(spark, 60)
    names = ("_score", "_toxic", "_lang", "_rejected", "_again", "_number", "_named", "_cut_id", "_cut_spans", "_cut_text", "id", "t", "of", "key")
    docs = docs.union(documents(spark, [prose(70, 60), prose(71, 60)]).withColumn("doc_id", F.lit(5).cast("long")))
    docs = docs.select("*", *(F.lit(f"own {c}").alias(c) for c in names))
    for rows, path in ((docs, tmp_path / "some"), (docs.limit(0), tmp_path / "none")):
        rows.write.parquet(f"{path}/documents.parquet")
        labels.where("doc_id IS NOT NULL" if rows is docs else "false").write.parquet(f"{path}/labels.parquet")
        now = spark.read.parquet(f"{path}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            new = stage(spark, now, str(path))
            assert new.columns == docs.columns
            now = new
        for r in now.collect():
            assert all(r[c] == f"own {c}" for c in names)
        assert (corpus_pipeline.run(spark, str(path)).count() > 0) == (rows is docs)


def test_near_copies_of_repeated_rows_and_shared_ids(spark):
    a, b, c, d = (prose(seed, 80, 10**6) for seed in (61, 62, 63, 64))
    rows = [(1, a), (2, b), (2, b), (3, c), (3, a), (4, d), (4, c + " more"), (5, None), (None, a)]
    docs = spark.createDataFrame([(k, t, "en", "s", None) for k, t in rows], DOC)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_copies_out(spark, docs, "").collect()), key=repr)
    assert got == sorted([(1, a), (2, b), (3, c), (4, d), (5, None), (None, a)], key=repr)
