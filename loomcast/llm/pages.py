"""Main text of HTML pages by tree scoring.

Paragraphs pass points for their length and commas to the containers around them, which are discounted by the share of
their text that lies in links.  The best container and those of its siblings that read like it are kept.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARKUP = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</(?=[^a-zA-Z])[^>]*+(?:>|\Z)
    |<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'\s])))*+|[^>]*+)(?:>|\Z)""",
    re.S | re.X,
)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)

# Element names of HTML by what they do to text, and names that sites give to what isn't the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I | re.A) for tag in RAW}
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("head nav footer aside form button select option input dialog menu svg math canvas object embed audio video template map script style textarea title noscript iframe xmp noembed noframes".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WHOLE = frozenset("article main".split())
WEIGHT = {"article": 3.0, "main": 2.0}  # what pages themselves mark as their content
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("table td th ul ol dl div section article aside main nav header footer form blockquote body html".split())
UNWANTED = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense adslot adbox sponsor sponsored sponsors promo promoted promotion banner banners"
    " sidebar sidebars rail widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar masthead topbar"
    " footer header notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login paywall"
    " comment comments commentlist respond reply replies disqus discussion share sharing social related recommended recommendations"
    " search skip tags taglist copyright legal disclaimer hidden".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form note".split())


COMMENTS = frozenset("comment comments commentlist respond reply replies disqus discussion".split())
# Words beside an unwanted one that don't make the name mean something else, words that turn it round, words for the state
# or place of something that lies elsewhere, and words that name the article.
BESIDE = frozenset("list lists area wrapper wrap box section item items block container inner outer group panel bar zone slot unit primary secondary posts articles stories news links link site page global module region".split())
TURNED = frozenset("no not non without has have with is hide".split())
STATES = frozenset("open opened closed enabled disabled on off fixed sticky left right top bottom layout width full".split())
CONTENT = frozenset("content article post entry story body text prose blog hentry".split())
NONE, DOUBTFUL, UNLIKELY, REMARKS = range(4)
SHARES = {DOUBTFUL: 0.5, UNLIKELY: 0.7, REMARKS: 0.95}  # of a page's points, above which an element is kept nevertheless
LOWERED = {NONE: 1.0, DOUBTFUL: 0.7, UNLIKELY: 0.5, REMARKS: 0.5}  # what its name leaves of a container's score


def named(value: str) -> int:
    """What the names of an element (its class or id) say against its being part of the article."""
    found, content = NONE, False
    for token in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split():
        pieces = re.findall(r"[a-z]+", token)
        content = content or not CONTENT.isdisjoint(pieces)
        if UNWANTED.isdisjoint(pieces) or pieces[0] in TURNED:
            continue
        rest = [x for x in pieces if x not in UNWANTED and x not in BESIDE]
        if not STATES.isdisjoint(rest):
            found = max(found, DOUBTFUL)
        elif not COMMENTS.isdisjoint(pieces):
            found = REMARKS
        else:
            found = max(found, DOUBTFUL if rest else UNLIKELY)
    return DOUBTFUL if content and found == UNLIKELY else found


def judged(tag: str, attributes: str) -> tuple[bool, int]:
    """Whether an element is no part of any article by its kind, and what its names say."""
    if tag in DROPPED:
        return True, NONE
    if not attributes or tag in ("html", "body"):
        return False, NONE
    if _HIDDEN.search(attributes):
        return True, NONE
    says = NONE
    for name, a, b, c in _NAMED.findall(attributes):
        value = html.unescape(a or b or c)
        if name.lower() == "role":
            if value.strip().lower() in ROLES:
                return True, NONE
        else:
            says = max(says, named(value))
    if tag in WHOLE and says != REMARKS:  # such elements are the article more often than their names tell
        says = DOUBTFUL if says == UNLIKELY else NONE
    return False, says


class Tree:
    """The elements of a page in the order in which they begin, and its texts in order."""

    def __init__(self, source: str) -> None:
        self.parent, self.tags, self.out, self.says = [-1], ["#"], [False], [NONE]
        self.events: list[tuple[int, str | None]] = []  # a node with text, or None where a block begins or ends
        self.stack = [0]
        self.places: dict[str, list[int]] = {}  # where on the stack each tag is open
        self.blocks, self.scopes = [0], [0]  # where on the stack blocks and scopes are open
        self._read(source)
        self.leave(1)

    def leave(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag = self.tags[self.stack.pop()]
            self.places[tag].pop()
            if tag in SCOPE:
                self.scopes.pop()
            if tag not in INLINE:
                self.blocks.pop()
                self.events.append((0, None))

    def last(self, tag: str) -> int:
        """Where on the stack the innermost open element of a tag is; 0 if there is none."""
        found = self.places.get(tag)
        return found[-1] if found else 0

    def enter(self, tag: str, attributes: str) -> None:
        above = self.stack[-1]
        out, says = judged(tag, attributes)
        if tag == "header":
            out = out or not any(self.last(t) for t in WHOLE)
        if tag == "article" and self.last("article"):  # an article in an article is a remark on it
            says = max(says, DOUBTFUL)
        self.parent.append(above)
        self.tags.append(tag)
        self.out.append(self.out[above] or out)
        self.says.append(says)
        if attributes.endswith("/") and tag in ("path", "circle", "rect", "g", "use"):
            return
        place = len(self.stack)
        self.stack.append(len(self.tags) - 1)
        self.places.setdefault(tag, []).append(place)
        if tag in SCOPE:
            self.scopes.append(place)
        if tag not in INLINE:
            self.blocks.append(place)
            self.events.append((0, None))

    def end_implied(self, tag: str) -> None:
        """Elements that end where another begins: of those in the innermost scope, the last p, or all list items alike."""
        ends = IMPLIED.get(tag, {"p"})
        while (place := max(map(self.last, ends))) and place >= self.scopes[-1]:
            self.leave(place)
            if tag not in IMPLIED:
                break

    def _read(self, source: str) -> None:
        at = 0
        while True:
            m = _MARKUP.search(source, at)
            end = m.start() if m else len(source)
            if end > at:
                self.events.append((self.stack[-1], source[at:end]))
            if not m:
                break
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                place = self.last(tag)
                if place and (tag not in INLINE or place > self.blocks[-1]):
                    self.leave(place)
                continue
            if tag in CLOSES_P or tag in IMPLIED:
                self.end_implied(tag)
            if tag in RAW:
                close = _RAW_END[tag].search(source, at)
                at = close.start() if close else len(source)
            elif tag in VOID:
                self.events.append((self.stack[-1], " ") if tag in INLINE else (0, None))
            else:
                self.enter(tag, m[3])


def sums(values: list, parent: list[int]) -> list:
    """The values of each node with those of all nodes below it."""
    out = list(values)
    for k in range(len(out) - 1, 0, -1):
        out[parent[k]] += out[k]
    return out


def refused(tree: Tree, won: list[float]) -> list[bool]:
    """Which nodes are left out: those that can't be part of an article, and those whose names speak against them and that
    hold no more than a share of the page's points.  Remarks go first, so that others are held to what is left."""
    gone = list(tree.out)
    for kinds in ((REMARKS,), (DOUBTFUL, UNLIKELY)):
        held = sums([0.0 if g else w for g, w in zip(gone, won)], tree.parent)
        for k in range(1, len(gone)):
            says = tree.says[k]
            gone[k] = gone[k] or gone[tree.parent[k]] or (says in kinds and held[k] <= SHARES[says] * held[0])
    return gone


def main_text(source: str | None) -> str:
    """The article of a whole page, a line for each block; "" where nothing is left.

    Blocks of text win points for length and commas, less by their links, and pass them to the containers around them.
    Names of classes lower a container's score, and take it out only where the bulk of the points lies elsewhere.
    """
    if not source:
        return ""
    tree = Tree(source)
    tags, parent = tree.tags, tree.parent
    n = len(tags)
    in_link, block, in_head, around = [False] * n, [0] * n, [False] * n, [0] * n
    for k in range(1, n):
        p = parent[k]
        in_link[k] = in_link[p] or tags[k] == "a"
        around[k] = block[p]  # the nearest block that the node lies in
        block[k] = k if tags[k] not in INLINE else block[p]
        in_head[k] = (in_head[p] or tags[k] == "header") and tags[k] not in HEADINGS and not (tags[p] in HEADINGS)
    length, links, commas = [0] * n, [0] * n, [0] * n
    texts: list[tuple[int, str | None]] = []
    for k, raw in tree.events:
        if raw is None:
            texts.append((0, None))
        elif not tree.out[k] and not in_head[k]:
            text = html.unescape(raw) if "&" in raw else raw
            texts.append((k, text))
            size = len(text.strip())
            length[block[k]] += size
            commas[block[k]] += text.count(",")
            if in_link[k]:
                links[block[k]] += size
    won = [(1.0 + commas[k] + length[k] / 100.0) * (1.0 - links[k] / length[k]) if length[k] and k == block[k] else 0.0 for k in range(n)]
    gone = refused(tree, won)
    won, length, links = ([0 if g else v for g, v in zip(gone, values)] for values in (won, length, links))
    points = [0.0] * n
    for k in range(1, n):
        if won[k]:
            up, share = (around[k] if tags[k] in ("p", "pre", "li", "td", "blockquote", "dd") or tags[k] in HEADINGS else k), 1.0
            while up > 0 and share > 0.2:
                points[up] += won[k] * share
                share /= 2
                up = around[up]
    held, length, links = sums(won, parent), sums(length, parent), sums(links, parent)

    def scored(k: int) -> float:
        if not points[k] or not length[k]:
            return 0.0
        mark = WEIGHT.get(tags[k], 1.0) if 2 * held[k] >= held[0] else 1.0  # a small article among paragraphs isn't the article
        return points[k] * mark * LOWERED[tree.says[k]] * (1.0 - links[k] / length[k])

    score = [scored(k) for k in range(n)]
    best = max(range(n), key=lambda k: (score[k], -k))
    top = best
    up = best
    while up > 0:
        if tags[up] == "article" or tags[up] == "main" and tags[top] != "article":
            top = up
        up = parent[up]
    kept = [False] * n
    kept[top] = True
    if top > 0 and tags[top] not in WHOLE:
        for k in range(1, n):
            if parent[k] == parent[top] and not gone[k]:
                dense = links[k] / length[k] if length[k] else 1.0
                kept[k] = kept[k] or score[k] >= max(2.0, 0.2 * score[top]) or (tags[k] in ("p", "pre", "blockquote") or tags[k] in HEADINGS) and dense < 0.25
    for k in range(1, n):
        kept[k] = (kept[k] or kept[parent[k]]) and not gone[k]

    blocks: list[str] = []
    line: list[str] = []
    for k, text in [*texts, (0, None)]:
        if text is not None:
            if kept[k]:
                line.append(text)
        elif line:
            if one := " ".join("".join(line).split()):
                blocks.append(one)
            line = []
    return "\n".join(blocks)


def extract(df: DataFrame, source: str = "html") -> DataFrame:
    """df without its markup, with text ("" if none) and n_chars (code points); columns so named are replaced.

    Each page is read whole and by itself; null and empty pages have no text.  Broken markup is read as browsers do in
    the main: paragraphs, list items and cells end where the next begins, unclosed elements end with the page.
    """
    kept = [c for c in df.columns if c not in (source, "text", "n_chars")]

    @F.pandas_udf("string")
    def read(pages: pd.Series) -> pd.Series:
        return pages.map(main_text)

    out = df.select(*kept, read(F.coalesce(F.col(source), F.lit(""))).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
