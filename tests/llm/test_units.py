"""The text operators' parts without Spark, against brute force or the libraries they must agree with."""

import re
import unicodedata
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomcast.llm import bpe, jaccard, langid, packing, pages, suffixes, toxicity, urls, vectors, words
from loomcast.llm.common import Connected, forest

ODD = ["", " ", "a", "ÀÉÎ ΣΑΣ Σ İstanbul", "hi<|endoftext|> you <|startoftext|>", "don't we'll 123 ½ ²", "日本語 テキスト", "a\u200bb\u3000c\x85d\x1ce", "x" * 1500, "ab" * 300 + " \n\n z", "👍🏽 ok!!!", " \t\n lead \n"]
FILES = {n: public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}


def library(name):
    t = Tokenizer.from_file(FILES[name])
    t.no_truncation()
    t.no_padding()
    return t


LIBRARY = {n: library(n) for n in FILES}
CODEC = {n: bpe.Codec(FILES[n]) for n in FILES}


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("text", ODD)
def test_bpe_equals_the_library(name, text):
    want = LIBRARY[name].encode(text, add_special_tokens=False).ids
    assert CODEC[name].encode(text).tolist() == want
    assert CODEC[name].decode(want) == LIBRARY[name].decode(want, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_bpe_equals_the_library_on_any_text(text):
    for name in FILES:
        assert CODEC[name].encode(text).tolist() == LIBRARY[name].encode(text, add_special_tokens=False).ids


def test_bpe_equals_the_library_for_every_code_point():
    """Code points that Python's table knows, and those that it doesn't, each between letters and by itself."""
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for odd in (False, True):
        of = [c for c in every if (unicodedata.category(c) == "Cn") == odd]
        of = [c for c in of if not odd or regex.match(r"\P{Cn}", c) or ord(c) % 97 == 0]  # of what nobody knows, some
        texts = ["".join(f"a{c}b {c} 1{c}" for c in of[at : at + 40]) for at in range(0, len(of), 40)]
        for name in FILES:
            for text, want in zip(texts, LIBRARY[name].encode_batch(texts, add_special_tokens=False)):
                assert CODEC[name].encode(text).tolist() == want.ids


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cn", "Cs"]), max_size=60))
def test_packing_ids_equal_the_library_on_any_text(text):
    assert np.frombuffer(packing.text_ids(text, FILES["byte_bpe_50k.json"]), "<u4").tolist() == LIBRARY["byte_bpe_50k.json"].encode(text, add_special_tokens=False).ids


def test_long_words_merge_as_short_ones(monkeypatch):
    word = "thanedbleation" * 30
    long_ = CODEC["word_bpe_49k.json"]._merge(word)
    monkeypatch.setattr(bpe, "SHORT", 10**6)
    assert CODEC["word_bpe_49k.json"]._merge(word) == long_


def test_byte_bpe_round_trip():
    c = CODEC["byte_bpe_50k.json"]
    assert all(c.decode(c.encode(t).tolist()) == t for t in ODD)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_plan_uses_each_piece_once_and_is_tight(lengths):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    made = packing.plan(histogram, 40)
    used = [n for times, chosen in made for n in chosen * times]
    assert sorted(used) == sorted(lengths) and all(sum(chosen) <= 40 for _, chosen in made)
    bins = sum(times for times, _ in made)
    assert bins <= -(-11 * -(-sum(lengths) // 40) // 9) + 1 or bins <= sum(n > 20 for n in lengths) + 2


def test_second_fit_replaces_the_smallest():
    assert packing.best_two(np.bincount([4, 4, 5, 7], minlength=11), 9) == (4, 5)
    assert packing.best_two(np.bincount([4], minlength=11), 9) == (0, 0)
    # 7 + 2 leaves a gap of 1 in 10; 2 gives way to 2 more fitting pieces only if there are two
    assert sorted(packing.plan({7: 1, 2: 1, 1: 0}, 10)[0][1]) == [2, 7]


def test_run_hashes_are_of_the_run_alone():
    h = words.hashes([b"w%d" % k for k in range(60)])
    for size in (1, 2, 5, 8, 35, 50, 60):
        r = words.runs(h, size)
        assert len(r) == 61 - size == len(set(r.tolist())) and (words.runs(h[5:], size) == r[5:]).all()


@pytest.mark.parametrize("n", [1, 6, 60, 400, 3000])
def test_bitmaps_bound_the_difference(n):
    rng = np.random.default_rng(n)
    a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
    b = np.unique(np.r_[a[: int(n * 0.9)], rng.integers(0, 2**63, n // 20 + 1).astype(np.uint64) * np.uint64(2)])
    bits = jaccard.width(n)
    x, y = jaccard.bitmap(a, bits), jaccard.bitmap(b, bits)
    assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
    assert (jaccard.folded(jaccard.bitmap(a, 4 * bits)[None], bits)[0] == x).all()
    assert jaccard.overlap(a, b) == len(np.intersect1d(a, b))


def test_shingles_of_short_texts():
    assert len(words.shingles(None)) == len(words.shingles(" \n")) == 0
    assert len(words.shingles("One two")) == 1 == len(words.shingles("a b c d e"))
    assert (words.shingles("A b\tC") == words.shingles("a\x0bb c")).all() and (words.shingles("a\xa0b") != words.shingles("a b")).all()


def test_forest_and_connected():
    rng = np.random.default_rng(0)
    for _ in range(20):
        link = rng.random((30, 40)) < rng.choice([0.02, 0.3])
        i, j = forest(link)
        assert link[i, j].all() and len(i) <= max(70, link.sum())

        def parts(pairs):
            c = Connected(70)
            c.add(*pairs)
            return c.root

        assert (parts((i, 30 + j)) == parts((np.nonzero(link)[0], 30 + np.nonzero(link)[1]))).all()


@pytest.mark.parametrize("width", [1, 8, 16, 17, 64])
def test_linked_equals_the_plain_product(width):
    rng = np.random.default_rng(width)
    a = rng.normal(size=(200, width))
    a[100:150] = a[:50] + 0.05 * rng.normal(size=(50, width))
    a = vectors.unit(a)
    axes = np.linalg.qr(rng.normal(size=(width, width)))[0]
    stops = sorted({min(width, s) for s in (16, 32)} | {width})
    assert (vectors.linked(a, a, a @ axes, a @ axes, stops, 0.95) == (a @ a.T >= 0.95)).all()
    near = vectors.unit(a[:1] + 1e-3 * rng.normal(size=(80, width)))
    assert (vectors.linked(near, near, near @ axes, near @ axes, stops, 0.95) == (near @ near.T >= 0.95)).all()


def test_linked_just_below_and_at_the_threshold():
    for width in (2, 8, 64):
        u, v = np.zeros((40, width)), np.zeros((3, width))
        v[:, 0] = 1.0
        cosines = 0.95 + np.linspace(-9e-6, 9e-6, 40)
        u[:, 0], u[:, 1] = cosines, np.sqrt(1 - cosines**2)
        axes = np.linalg.qr(np.random.default_rng(0).normal(size=(width, width)))[0]
        assert (vectors.linked(u, v, u @ axes, v @ axes, sorted({min(width, 16), width}), 0.95) == (u @ v.T >= 0.95)).all()


def test_lists_keep_the_best_and_resolve_few_rows():
    rng = np.random.default_rng(2)
    x, q = np.floor(64 * rng.normal(size=(2000, 16)) / 4), np.floor(64 * rng.normal(size=(9, 16)) / 4)
    q[8] = 0.0
    floors = np.full(9, -np.inf)
    for depths in (vectors.DEPTHS, (0.1, 1.0), (1.0,)):
        lists = vectors.Lists(x)
        i, j, score = lists.search(q[:8], 5, floors[:8], depths)
        assert lists.resolved == len(i) < 0.02 * 8 * len(x) and (score == (q[i] * x[j]).sum(1)).all()
        for k in range(8):
            s = x @ q[k]
            assert set(np.flatnonzero(s >= np.sort(s)[-5])) <= set(j[i == k])
    i, j, _ = vectors.Lists(x).search(q, 5, floors)
    assert (i == 8).sum() == len(x)  # all tie at 0
    upper, lower, exact = vectors.Lists(x).upper(q, 0.3), vectors.Lists(x).lower(q, 0.3), q @ x.T
    assert (upper >= exact).all() and (lower <= exact).all()
    assert (vectors.Lists(x).upper_of(q, i, j, 0.3) == upper[i, j]).all()
    assert len(vectors.Lists(x[:3]).search(q, 5, floors)[0]) == 27


PAGE = """<html><head><title>t</title></head><body class=home><header><h1>Site</h1></header><div id="cookie-notice">We use cookies, ok.</div>
<nav><a href=x>Menu</a></nav><div class="layout"><div class="content"><h1>Title &amp; more</h1><p>First, with commas, and <a href="y">a link</a> &copy; 2020.
<p>Second&nbsp;para<br>line.</p><ul><li>one<li>two</ul><script>if(a<b){x("</div>")}</script><form><input name=q>Search</form>
<div class="share">Share this</div></div><div class="sidebar"><p>Popular posts, lots, of, commas, here, yes.</p></div></div>
<section id="comments"><p>Reader says, blah, blah, long long text here for all.</p></section><footer>c</footer></body></html>"""


def test_main_text_of_a_page():
    assert pages.main_text(PAGE) == "Title & more\nFirst, with commas, and a link © 2020.\nSecond para line.\none\ntwo"
    article = "<body><div class=ad>Buy, buy</div><article><header><h1>Head</h1><span>by me</span></header><p>Body text.</p><aside>More</aside></article><p>Else</p>"
    assert pages.main_text(article) == "Head\nBody text."


@pytest.mark.parametrize(("source", "text"), [(None, ""), ("", ""), ("plain", "plain"), ("<p>a", "a"), ('<p title="x>y">q</p>', "q"), ("<p it's>hello 'w'</p><p>z</p>", "hello 'w'\nz"), ("<!-- x", ""), ("&#x41;&eacute; b", "Aé b"), ("<script>x", ""), ("<b>" * 3000 + "x", "x")])
def test_main_text_of_odd_sources(source, text):
    assert pages.main_text(source) == text


def test_letters_that_grow_in_lower_case():
    text = "İ" * 30
    assert pages.main_text(f"<article><p>{text}</p><script>x = 1</script><p>This is a long first paragraph.</p></article>") == f"{text}\nThis is a long first paragraph."
    assert pages.main_text("<p>a</p><SCRIPT>b</scriptx></Script ><p>c</p>") == "a\nc"
    assert pages.main_text("<p>" + "word, " * 200_000 + "</p>") == ("word, " * 200_000).strip()


class Plain(HTMLParser):
    """The text of articles without unwanted elements, by Python's own parser: an independent reading of plain pages."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.lines = [], [[]]

    def kept(self):
        return any(t == "article" for t, _ in self.open) and not any(bad for _, bad in self.open)

    def handle_starttag(self, tag, attrs):
        if tag not in pages.INLINE:
            self.lines.append([])
        if tag in pages.VOID:
            if tag in pages.INLINE and self.kept():
                self.lines[-1].append(" ")
            return
        named = " ".join((dict(attrs).get(k) or "") for k in ("class", "id")).lower()
        self.open.append((tag, tag in pages.DROPPED or tag != "article" and not pages.UNWANTED.isdisjoint(re.findall("[a-z]+", named))))

    def handle_endtag(self, tag):
        if tag not in pages.INLINE:
            self.lines.append([])
        at = [k for k, (t, _) in enumerate(self.open) if t == tag]
        if at:
            del self.open[at[-1] :]

    def handle_data(self, data):
        if self.kept():
            self.lines[-1].append(data)


def test_main_text_equals_another_reading_of_whole_tables(small):
    import pyarrow.parquet as pq

    for html in pq.read_table(f"{small}/pages.parquet").column("html").to_pylist():
        p = Plain()
        p.feed(html or "")
        p.close()
        assert pages.main_text(html) == "\n".join(t for line in p.lines if (t := " ".join("".join(line).split())))


def test_url_parts_and_index():
    assert urls.parts("https://Www.Example.NET/en/x?q=/de/#f") == ("www.example.net", "/en/x")
    assert urls.parts(None) == urls.parts("no scheme/x") == ("", "") and urls.parts("a://h") == ("h", "")
    index = urls.rule_index(urls.SITE_RULES, {"net": 9, "example": 20, "en": 1, "com": 5, "de": 2, "org": 3, "fr": 3})
    assert index == {"net": [0], "en": [1], "de": [2], "fr": [3]}
    assert urls.site_rule("block", "a.com/x/pre").tokens == ("a", "com", "x")


@pytest.mark.parametrize(
    ("pattern", "tokens"),
    [(r"^ads\.", ("ads",)), (r"ads\.", ()), (r"/ads/", ("ads",)), (r"/ads?/", ()), (r"/a|/b/", ()), (r"/(?:x|y)/track/", ("track",)), (r"/ad[sx]/pixel\.gif$", ("pixel", "gif")), (r"\.Foo\.com/.*/bar-", ("foo", "com", "bar")), (r"/.*/bar-", ("bar",)), (r"-b{2}-", ()), (r"-\d+-x-", ("x",)), (r"^(a)b-", ())],
)
def test_tokens_of_patterns(pattern, tokens):
    assert urls.tokens_of(pattern) == tokens


def test_cut_texts():
    text = "One  two\nthree four\tfive"
    assert suffixes.without(text, [(1, 3)]) == "One  four\tfive"
    assert suffixes.without(text, [(0, 2), (1, 3)]) == "four\tfive" and suffixes.without(text, [(3, 9)]) == "One  two\nthree "
    assert suffixes.without(None, [(0, 1)]) is None and suffixes.without(text, []) == text


def test_positions_depend_on_content_only():
    h = words.hashes([b"w%d" % (k * k % 97) for k in range(300)])
    p = suffixes.positions(h, 16)
    assert np.diff(p).max() <= 16 and set(suffixes.positions(h[40:], 16) + 40) - set(p) <= set(range(40, 56))


def test_cover_covers():
    rng = np.random.default_rng(3)
    for _ in range(50):
        rows = [(int(a), int(a) + 50 + int(rng.integers(30)), k, 0) for k, a in enumerate(rng.integers(0, 600, 12))]
        got = suffixes.cover(rows)
        spots = lambda rs: {w for r in rs for w in range(r[0], r[1])}
        assert spots(got) == spots(rows) and got == suffixes.cover(rows[::-1]) and set(got) <= set(rows)
        assert all(a[1] < c[0] for a, c in zip(got, got[2:]))


def test_near_matches_are_laid_to_their_heads():
    # Document 9 has words 10 .. 59 of number 0 five words before; that has its words 0 .. 9 and 30 .. 34 from elsewhere.
    ids, of, doc, diag, first, last = (np.array(x) for x in ([5, -7], [0, 1], [9, 8], [5, 0], [10, 3], [59, 4]))
    known = tuple(np.array(x) for x in ([0, 0, 0], [2, 3, 1], [100, -7, 0], [0, 30, 70], [9, 34, 80]))
    got = sorted(zip(*(x.tolist() for x in suffixes.laid(ids, of, doc, diag, first, last, known))))
    assert got == [(8, -7, 0, 3, 4), (9, 2, 105, 10, 14), (9, 3, -2, 35, 39), (9, 5, 5, 15, 34), (9, 5, 5, 40, 59)]
    none = tuple(np.empty(0, int) for _ in range(5))
    assert [x.tolist() for x in suffixes.laid(ids, of, doc, diag, first, last, none)] == [[9, 8], [5, -7], [5, 0], [10, 3], [59, 4]]
    assert all(not len(x) for x in suffixes.laid(none[0], *none, none))


def test_gram_counts_and_features():
    assert langid.gram_counts(None, 64) is None and langid.gram_counts("12 !?", 64) is None
    assert langid.gram_counts("ab", 64).sum() == 4 + 3 + 2
    assert len(toxicity.features(None, 20)) == 0 == len(toxicity.features("", 20))
    assert (toxicity.features("Bad, word", 20) == toxicity.features("bad word", 20)).all()


def test_ftrl_equals_a_plain_version():
    """Per-coordinate rates, L1 and L2 in plain loops."""
    s = toxicity.Settings(bits=6, epochs=2, l1=0.3)
    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 64, rng.integers(0, 12))).astype(np.int32) for _ in range(60)]
    y = rng.integers(0, 2, 60)
    z, n = [0.0] * 65, [0.0] * 65

    def weight(k):
        l1 = 0.0 if k == 64 else s.l1
        return 0.0 if abs(z[k]) <= l1 else ((1 if z[k] > 0 else -1) * l1 - z[k]) / ((s.beta + n[k] ** 0.5) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for row, label in zip(rows, y):
            w = {k: weight(k) for k in [*row.tolist(), 64]}
            g = (1 / (1 + np.exp(-sum(w.values()))) - label) * (s.positive if label else 1.0)
            for k in w:
                z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / s.alpha * w[k]
                n[k] += g * g
    assert np.allclose(toxicity.ftrl(rows, y, s), [weight(k) for k in range(65)])


def test_ftrl_finds_the_telling_feature():
    rng = np.random.default_rng(4)
    rows, y = [], []
    for k in range(400):
        bad = k % 4 == 0
        rows.append(np.unique(np.r_[rng.integers(100, 1000, 20), [7] if bad else []]).astype(np.int32))
        y.append(int(bad))
    w = toxicity.ftrl(rows, np.array(y), toxicity.Settings(bits=10))
    assert w[7] > 1 and (w != 0).sum() < 200
    right = [(w[r].sum() + w[-1] >= 0) == bool(t) for r, t in zip(rows, y)]
    assert np.mean(right) > 0.98


def test_islands_hold_stretches_that_lie_within_others():
    one = np.zeros(4, np.int64)
    got = suffixes.islands(one, one, one, np.array([0, 120, 10, 500]), np.array([200, 170, 60, 550]))
    assert got[3].tolist() == [0, 500] and got[4].tolist() == [200, 550]
