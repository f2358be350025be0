"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element is a variable: main text or not. Its own features (tag, class and id words, words, links, stops)
give a potential for each state, and each pair of parent and child has a potential for their two states. Messages
passed from the leaves up and from the root down (sum-product) give each block's exact marginal; text runs in blocks
whose marginal exceeds one half are kept. All potentials are learned from labelled pages.
"""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duowave.llm.tables import slices, table

# Fixed values of HTML: elements without an end, elements whose text is never shown, inline elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style noscript template svg iframe object audio video canvas select textarea button title "
                   "annotation annotation-xml".split())
# Elements that can stand in a head; any other ends one whose end is left out.
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript noframes template head".split())
# Formulas are text of the block they are in; annotations repeat them in another notation.
MATH = frozenset("math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace "
                 "msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
                   "strong sub sup time tt u var wbr".split()) | MATH
# An element that starts ends an open one of these kinds, up to the nearest of the limits.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
         "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
_LIMITS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",)}
_SPACE = re.compile(r"[ \t\n\r\f\v ]+")
_NAMES = re.compile(r"[a-z]+")
TRAINING_PAGES = 400
SEED = 20250903


class Page(HTMLParser):
    """Block elements of a page in document order and the runs of text directly in them."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.names, self.label = [-1], ["html"], [()], [None]
        self.words, self.linked, self.stops = [0], [0], [0]
        self.runs: list[tuple[int, list[str]]] = []
        # Open elements: name and block they are in.
        self.open: list[tuple[str, int]] = [("html", 0)]
        # Places in ``open``, by name, of all but the root.
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.hidden = self.links = 0
        self.joined = False
        self.feed(html)
        self.close()
        for i in range(len(self.parent) - 1, 0, -1):
            for counts in (self.words, self.linked, self.stops):
                counts[self.parent[i]] += counts[i]

    def _push(self, name: str, node: int) -> None:
        self.places[name].append(len(self.open))
        self.open.append((name, node))

    def _pop(self) -> None:
        name, _ = self.open.pop()
        self.places[name].pop()
        self.hidden -= name in HIDDEN
        self.links -= name == "a"
        if name not in INLINE and name not in HIDDEN:
            self.joined = False

    def _nearest(self, names) -> int:
        """Place of the innermost open element of these names, 0 if there is none."""
        return max((self.places[n][-1] for n in names if self.places[n]), default=0)

    def _close(self, place: int) -> None:
        while len(self.open) > place:
            self._pop()

    def _end(self, kinds, limits) -> None:
        place = self._nearest(kinds)
        if place and place >= self._nearest(limits):
            self._close(place)

    def _end_head(self, inner: bool) -> None:
        """Close a head that is still open; with ``inner`` also from inside one of its elements."""
        place = self._nearest(("head",))
        if place and (inner or place == len(self.open) - 1):
            self._close(place)

    def handle_starttag(self, name: str, attrs) -> None:
        if name not in IN_HEAD and name != "html":
            self._end_head(name == "body")
        if name in ("html", "body") and len(self.open) == 1:
            return
        if name == "br":
            self._text(" ")
        if name in VOID:
            if name not in INLINE:
                self.joined = False
            return
        if name not in INLINE and name not in HIDDEN:
            self._end(("p",), ("table", "td", "th", "caption"))
            if name in _ENDS:
                self._end(_ENDS[name], _LIMITS.get(name, ("table",)))
            values = {k: v or "" for k, v in attrs}
            self.parent.append(self.open[-1][1])
            self.tag.append(name)
            self.names.append(tuple(sorted(set(_NAMES.findall(
                " ".join(values.get(k, "") for k in ("class", "id", "role", "itemprop", "aria-label")).lower())))))
            self.label.append(values.get("data-main"))
            for counts in (self.words, self.linked, self.stops):
                counts.append(0)
            self.joined = False
            self._push(name, len(self.parent) - 1)
        else:
            self._push(name, self.open[-1][1])
        self.hidden += name in HIDDEN
        self.links += name == "a"

    def handle_endtag(self, name: str) -> None:
        if name not in ("html", "body"):
            self._end((name,), ("table",) if name not in ("table", "html") and name not in _ENDS and name != "p" else ())

    def handle_startendtag(self, name: str, attrs) -> None:
        self.handle_starttag(name, attrs)

    def _text(self, text: str) -> None:
        node = self.open[-1][1]
        if not self.joined or self.runs[-1][0] != node:
            self.runs.append((node, []))
            self.joined = True
        self.runs[-1][1].append(text)

    def handle_data(self, text: str) -> None:
        if self.hidden and self.open[-1][0] == "head" and text.strip():
            self._end_head(False)
        if self.hidden:
            return
        self._text(text)
        node, n = self.open[-1][1], len(text.split())
        self.words[node] += n
        self.stops[node] += text.count(".") + text.count(",")
        if self.links:
            self.linked[node] += n


def features(page: Page, i: int) -> list[str]:
    """Names of the features of block ``i``."""
    words = page.words[i]
    size = "none" if not words else "few" if words < 5 else "some" if words < 15 else "many" if words < 60 else "long"
    linked = page.linked[i] / words if words else 0.0
    links = "no" if not linked else "low" if linked < 0.2 else "half" if linked < 0.5 else "most"
    stops = page.stops[i] / words if words else 0.0
    return [f"tag={page.tag[i]}", f"words={size}", f"links={links}", f"stops={'no' if not stops else 'low' if stops < 0.04 else 'high'}",
            f"size={size}/{links}", *[f"name={n}" for n in page.names[i]]]


def marginals(page: Page, model: dict) -> list[float]:
    """Probability of being main text for each block, by messages up and down the tree."""
    weights, pair = model["weights"], model["pair"]
    n = len(page.parent)
    own = []
    for i in range(n):
        score = model["bias"] + sum(weights.get(f, 0.0) for f in features(page, i))
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, score))))
        own.append([1 - p, p])
    up, inward = [(0.5, 0.5)] * n, [list(o) for o in own]
    for i in range(n - 1, 0, -1):
        a, b = inward[i]
        m0, m1 = pair[0][0] * a + pair[0][1] * b, pair[1][0] * a + pair[1][1] * b
        up[i] = (m0 / (m0 + m1), m1 / (m0 + m1))
        at = inward[page.parent[i]]
        at[0] *= up[i][0]
        at[1] *= up[i][1]
        # Only the ratio matters; a block with many children must not run out of range.
        total = at[0] + at[1]
        at[0], at[1] = max(at[0] / total, 1e-290), max(at[1] / total, 1e-290)
    belief = [inward[0]] + [None] * (n - 1)
    for i in range(1, n):
        # The parent's belief without what came from here.
        at = belief[page.parent[i]]
        c0, c1 = at[0] / max(up[i][0], 1e-290), at[1] / max(up[i][1], 1e-290)
        total = c0 + c1
        c0, c1 = c0 / total, c1 / total
        a = inward[i][0] * (c0 * pair[0][0] + c1 * pair[1][0])
        b = inward[i][1] * (c0 * pair[0][1] + c1 * pair[1][1])
        belief[i] = [max(a / (a + b), 1e-290), max(b / (a + b), 1e-290)]
    return [b[1] / (b[0] + b[1]) for b in belief]


def main_text(html: str, model: dict) -> str:
    """Kept runs with white space (that of Unicode) inside as one space, trimmed, one to a line."""
    page = Page(html)
    chance = marginals(page, model)
    runs = (" ".join("".join(parts).split()) for node, parts in page.runs if chance[node] > 0.5)
    return "\n".join(r for r in runs if r)


def labelled_pages(n: int = TRAINING_PAGES, seed: int = SEED) -> list[str]:
    """Training pages in many layouts; ``data-main`` tells whether a block is main text (1) or not (0)."""
    rng = random.Random(seed)

    def words(low: int, high: int) -> list[str]:
        return ["".join(rng.choice("aeioun") + rng.choice("rstlmdkpv") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high))]

    def prose(low: int, high: int) -> str:
        out = words(low, high)
        for k in range(rng.randint(3, 9), len(out), rng.randint(6, 14)):
            out[k] += rng.choice([",", ".", "."])
        return (" ".join(out) + rng.choice([".", ".", ""])).capitalize()

    def block(tag: str, main: int, inner: str, names: str = "") -> str:
        mark = f' {rng.choice(["class", "class", "id"])}="{names}"' if names else ""
        return f'<{tag}{mark} data-main="{main}">{inner}</{tag}>'

    def link(low: int = 1, high: int = 3) -> str:
        return f'<a href="/x">{" ".join(words(low, high))}</a>'

    def links(low: int, high: int, main: int = 0) -> str:
        return block("ul", main, "".join(block("li", main, link()) for _ in range(rng.randint(low, high))))

    def either(share: float, plain: str, named: str, names: str) -> tuple[str, str]:
        return (plain, rng.choice(["", *names.split()])) if rng.random() < share else (named, rng.choice(names.split()))

    def paragraph() -> str:
        kind, text = rng.random(), prose(*rng.choice([(1, 4), (3, 12), (10, 40), (30, 120), (100, 260)]))
        if kind < 0.08:
            return block("blockquote", 1, block("p", 1, text))
        if kind < 0.14:
            return block("ul", 1, "".join(block("li", 1, prose(3, 25)) for _ in range(rng.randint(2, 5))))
        if kind < 0.17:
            return block("pre", 1, text)
        if kind < 0.24:
            return block(rng.choice(["h2", "h3"]), 1, " ".join(words(2, 7)))
        if kind < 0.30:
            return block("p", 1, text.replace(" ", f" {link()} ", 1))
        return block("p", 1, f"<b>{text}</b>" if kind > 0.95 else text)

    def article() -> str:
        body = block("h1", 1, " ".join(words(1, 10))) * (rng.random() < 0.8)
        # One in five articles is a note of a few words.
        body += block("p", 1, prose(1, 8)) if rng.random() < 0.2 else "".join(paragraph() for _ in range(rng.randint(1, 9)))
        if rng.random() < 0.25:
            body += block(rng.choice(["div", "aside"]), 0, link() + " " + link(), rng.choice(["share", "social", "related", "tags", "byline meta"]))
        tag, names = either(0.55, rng.choice(["article", "main"]), rng.choice(["div", "section"]),
                            "content post-body entry article-body main-content story text")
        inner = block("div", 1, body, rng.choice(["", "entry-content", "body"])) if rng.random() < 0.3 else body
        return block(tag, 1, inner, names)

    def header() -> str:
        tag, names = either(0.5, "header", "div", "header masthead site-header top banner")
        return block(tag, 0, block("div", 0, " ".join(words(1, 4)), "logo") + (block("p", 0, prose(3, 9)) if rng.random() < 0.4 else ""), names)

    def menu() -> str:
        tag, names = either(0.6, "nav", "div", "nav menu navbar navigation breadcrumb")
        return block(tag, 0, links(2, 9), names)

    def advert() -> str:
        return block(rng.choice(["div", "div", "aside", "section"]), 0, rng.choice([prose(3, 40), block("p", 0, prose(3, 40)), link(3, 9)]),
                     rng.choice("ad ads advert sponsored promo banner-ad advertisement".split()))

    def notice() -> str:
        return block("div", 0, block("p", 0, prose(5, 30)) + "<button>ok</button>",
                     rng.choice("cookie cookie-notice consent notice alert gdpr popup modal".split()))

    def sidebar() -> str:
        tag, names = either(0.5, "aside", "div", "sidebar widget related side-column rail")
        return block(tag, 0, block("h3", 0, " ".join(words(1, 3))) + rng.choice([links(2, 8), block("p", 0, prose(4, 40))]), names)

    def form() -> str:
        tag, names = either(0.7, "form", "div", "newsletter subscribe signup search login")
        return block(tag, 0, block("p", 0, prose(3, 14)) + '<label>e</label><input name="e"><button>go</button>', names)

    def comments() -> str:
        each = [block(rng.choice(["div", "li", "article", "p"]), 0, rng.choice([prose(3, 60), block("p", 0, prose(3, 60))]), "comment")
                for _ in range(rng.randint(1, 5))]
        return block(rng.choice(["section", "div", "ul", "ol"]), 0, block("h2", 0, " ".join(words(1, 2))) + "".join(each),
                     rng.choice("comments comment-list discussion responses reader-comments".split()))

    def footer() -> str:
        tag, names = either(0.7, "footer", "div", "footer site-footer bottom copyright colophon")
        return block(tag, 0, rng.choice([f"&copy; {prose(3, 20)}", links(2, 5) + block("p", 0, prose(3, 15))]), names)

    pages = []
    for _ in range(n):
        before = [f() for f in (header, menu, notice, advert, form) if rng.random() < 0.5]
        after = [f() for f in (advert, sidebar, comments, form, footer, footer, notice) if rng.random() < 0.5]
        rng.shuffle(before)
        main = article()
        if rng.random() < 0.15:
            # A page without an article, as an index.
            main = block("div", 0, "".join(block("div", 0, link(3, 8), "teaser") for _ in range(rng.randint(2, 8))), "list")
        inner = "".join(before) + main + "".join(after)
        if rng.random() < 0.4:
            mostly = int(len(re.findall(r'data-main="1"', main)) > 0 and len(main) > len("".join(before + after)))
            inner = block("div", mostly, inner, rng.choice(["wrapper", "page", "container", "site"]))
        pages.append(f"<html><body>{inner}</body></html>")
    return pages


def train(pages: list[str], steps: int = 300, ridge: float = 0.02) -> dict:
    """Potentials from labelled pages.

    A block's potential is a logistic regression on its features, fitted to all labelled blocks; a pair's is how much
    more often two states stand together than their shares would give.
    """
    rows, labels, places = [], [], {}
    pair, single = np.ones((2, 2)), np.ones((2, 2))
    for html in pages:
        page = Page(html)
        y = [int(x or 0) for x in page.label]
        for i in range(1, len(y)):
            rows.append([places.setdefault(f, len(places)) for f in features(page, i)])
            labels.append(y[i])
            if page.parent[i]:
                pair[y[page.parent[i]], y[i]] += 1
    indices = np.concatenate([np.array(r) for r in rows])
    owners = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    y, weights, bias = np.array(labels, dtype=float), np.zeros(len(places)), 0.0
    seen = np.bincount(indices, minlength=len(places)) + ridge * len(rows) / 10
    for _ in range(steps):
        score = bias + np.bincount(owners, weights[indices], minlength=len(rows))
        gap = y - 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        # Steps scaled by how often a feature is seen; the ridge holds rare ones near zero.
        weights += 0.5 * (np.bincount(indices, gap[owners], minlength=len(places)) - ridge * weights) / seen * 4 / 6
        bias += 0.5 * gap.mean()
    share = pair / pair.sum()
    single = share.sum(axis=1)[:, None] * share.sum(axis=0)[None, :]
    return {"weights": {f: float(weights[k]) for f, k in places.items()}, "bias": float(bias), "pair": (share / single).tolist()}


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: dict | None = None) -> DataFrame:
    """``id``, ``url``, ``text`` and ``n_chars`` (code points) per row.

    Null or empty pages and pages without main text have an empty text. Rows are independent: repeated rows get equal
    results, nothing is shuffled, and the model, a few hundred weights, goes along with the job. Empty tables give no
    rows; other columns are not read. Without ``model`` one is trained on :func:`labelled_pages`.
    """
    model = train(labelled_pages()) if model is None else model
    rows = df.select(df[id_col].alias("id"), df[url_col].alias("url"), df[html_col].cast("string").alias("html"))

    def compute(batches):
        for batch in slices(batches):
            texts = [main_text(h.as_py() or "", model) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], ["id", "url", "text"])

    kinds = dict(rows.dtypes)
    found = rows.mapInArrow(compute, f"id {kinds['id']}, url {kinds['url']}, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op5(spark, sf_dir: str) -> DataFrame:
    """``op5_dom_model``: main text of every page."""
    return extract(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")
