"""Main text of web pages by a tree-structured graphical model.

Every block element and every run of text in it is a node with a hidden label, content or not. A node's potential
comes from its tag, the words of its class, id and role, its depth, and the length, link share and share of the page of
the text in it; a pair potential ties each node to its parent. Both are estimated from labelled pages by counting.
Sum-product messages pass up the tree and down again, which gives the exact marginal of each text; texts likelier
content than not are kept. A source of a single block, as one without tags, is that block; where no text is likelier
content than not, those inside an article or main element are taken.

Labelled pages are made by `labelled_page` from a seed: LABELLED of them, the documented bound of the training sample.
In half of them no part has a name that says what it is, and some are bare fragments.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter, defaultdict
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import table, text_slices

LABELLED, SMOOTHING, LIMIT = 900, 0.5, 30.0
#: Share of their log-odds that features of texts keep: texts of one parent are alike, so they don't count as independent.
TEXT_SHARE = 0.5
#: The same for the features of elements that come from the text below them, which the texts show too.
TREE_SHARE = 0.1

BLOCKS = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption header footer nav aside form fieldset address details summary center hr".split())
#: Elements that hold no content by their own meaning.
ASIDES = frozenset("header footer nav aside form".split())
CONTENT = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose whole content is no page text: plain text up to their end tag (or the end of the source), and others.
RAW = frozenset("script style title textarea".split())
DROPPED = frozenset("noscript template select button svg iframe object".split())
_DROPPED_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<({'|'.join(sorted(RAW))})\b[^>]*>.*?(?:</\1\b|\Z)|<(/?)({'|'.join(sorted(DROPPED))})\b[^>]*?(/?)>", re.S | re.I)
#: An opening tag ends the open elements named here, up to the elements of its scope.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")


class Page:
    """Nodes of a page in document order: parent, features, and for texts the text itself (else None) and how many of its
    characters are in links."""

    def __init__(self):
        self.parent: list[int] = []
        self.linked: list[int] = []
        self.features: list[list[str]] = []
        self.kind: list[str] = []
        self.text: list[str | None] = []

    def add(self, parent: int, kind: str, features: list[str], text: str | None = None, linked: int = 0) -> int:
        self.parent.append(parent)
        self.linked.append(linked)
        self.kind.append(kind)
        self.features.append(features)
        self.text.append(text)
        return len(self.parent) - 1

    def describe(self) -> None:
        """Adds the features that need the whole tree: depth, and how much text a node has and how much of it is linked."""
        n = len(self.parent)
        size, linked, depth = [len(t) if t else 0 for t in self.text], list(self.linked), [0] * n
        for i in range(n - 1, 0, -1):
            size[self.parent[i]] += size[i]
            linked[self.parent[i]] += linked[i]
        for i in range(1, n):
            depth[i] = depth[self.parent[i]] + 1
            share = int(4 * size[i] / max(size[0], 1))
            if self.text[i] is None:
                self.features[i] += [f"@size:{min(size[i].bit_length(), 12) // 2}", f"@linked:{round(3 * linked[i] / max(size[i], 1))}", f"@depth:{min(depth[i], 6)}"]
            if share >= 2:  # having most of the text speaks for content; having little of it says nothing
                self.features[i].append(f"{'@' if self.text[i] is None else '#'}share:{share}")


def dropped_ends(source: str) -> dict[int, int]:
    """Where the content of dropped elements starts, and where their end tags end. An end tag belongs to the last open
    element of its name; elements without one are not in the result."""
    ends: dict[int, int] = {}
    open_: dict[str, list[int]] = defaultdict(list)
    for m in _DROPPED_TAG.finditer(source):
        if m[3]:
            name = m[3].lower()
            if m[2]:
                if open_[name]:
                    ends[open_[name].pop()] = m.end()
            elif m[4]:
                ends[m.end()] = m.end()
            else:
                open_[name].append(m.end())
    return ends


def parse(source: str) -> Page:
    """The block tree of an html source of any kind; unclosed and stray tags are tolerated.

    Of a dropped element that is never closed only the text up to the next block goes.
    """
    page = Page()
    open_: list[tuple[str, int]] = [("#root", page.add(-1, "#root", []))]
    run: list[str] = []
    linked, link_depth, mute = 0, 0, False
    ends = dropped_ends(source)

    def flush():
        nonlocal linked, mute
        if run:
            raw = html.unescape("".join(run))
            words = raw.split()
            if words:
                text = " ".join(words)
                share = linked / max(len("".join(run)), 1)
                features = [f"#size:{min(len(words), 63).bit_length()}", f"#linked:{round(share * 3)}", f"#stop:{text[-1] in '.!?…:'}"]
                page.add(open_[-1][1], "#text", features, text, round(share * len(text)))
            run.clear()
        linked, mute = 0, False

    def close_until(names: set, scope: set):
        at = len(open_) - 1
        last = None
        while at > 0 and open_[at][0] not in scope:
            if open_[at][0] in names:
                last = at
            at -= 1
        if last is not None:
            del open_[last:]

    at, end = 0, len(source)
    while at < end:
        m = _TOKEN.match(source, at)
        at = m.end()
        name = m[2]
        if name is None:
            if (m[0][0] != "<" or m[0] == "<") and not mute:
                run.append(m[0])
                linked += len(m[0]) if link_depth else 0
            continue
        name = name.lower()
        if name in RAW:
            if not m[1] and not m[3].rstrip().endswith("/"):
                stop = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at)
                at = stop.end() if stop else end
        elif name in DROPPED:
            if not m[1]:
                at = ends.get(at, at)
                mute = at == m.end() and not m[3].rstrip().endswith("/")
        elif name == "head" or name == "body" and m[1]:
            flush()
        elif name == "a":
            link_depth = 0 if m[1] else 1
        elif name not in BLOCKS:
            if name in VOID:
                run.append(" ")
        elif m[1]:
            flush()
            for k in range(len(open_) - 1, 0, -1):
                if open_[k][0] == name:
                    del open_[k:]
                    break
        else:
            flush()
            link_depth = 0
            if name in CLOSES:
                close_until(*CLOSES[name])
            if open_[-1][0] == "p":
                open_.pop()
            words = [w for a in _ATTRIBUTE.finditer(m[3]) for w in _WORDS.findall((a[2] or a[3] or a[4] or "").lower())] if m[3] else []
            node = page.add(open_[-1][1], name, [f"<{name}>", *sorted({f".{w}" for w in words})])
            if name not in VOID:
                open_.append((name, node))
    flush()
    page.describe()
    return page


def marginals(page: Page, model: dict) -> list[float]:
    """Probability of content of every node: messages up the tree, then down."""
    n = len(page.parent)
    weight, pair, other = model["weight"], model["pair"], model["pair"]["?"]
    own = [math.exp(max(-LIMIT, min(LIMIT, sum(weight.get(f, 0.0) for f in fs)))) for fs in page.features]
    below0, below1 = [1.0] * n, [1.0] * n  # product of a node's potential and the messages from its children, by label
    up0, up1 = [1.0] * n, [1.0] * n  # message of a node to its parent
    for i in range(n):
        below1[i] = own[i]
        s = 1.0 + own[i]
        below0[i], below1[i] = 1.0 / s, own[i] / s
    for i in range(n - 1, 0, -1):
        (a00, a01), (a10, a11) = pair.get(page.kind[i], other)
        m0 = a00 * below0[i] + a01 * below1[i]
        m1 = a10 * below0[i] + a11 * below1[i]
        p = page.parent[i]
        up0[i], up1[i] = m0, m1
        x0, x1 = below0[p] * m0, below1[p] * m1
        s = x0 + x1
        below0[p], below1[p] = x0 / s, x1 / s
    down0, down1 = [1.0] * n, [0.0] * n
    out = [0.0] * n
    for i in range(1, n):
        p = page.parent[i]
        # what the parent believes without this child's message
        q0 = down0[p] * below0[p] / max(up0[i], 1e-300)
        q1 = down1[p] * below1[p] / max(up1[i], 1e-300)
        s = q0 + q1 or 1.0
        q0, q1 = q0 / s, q1 / s
        (a00, a01), (a10, a11) = pair.get(page.kind[i], other)
        down0[i], down1[i] = q0 * a00 + q1 * a10, q0 * a01 + q1 * a11
        y0, y1 = down0[i] * below0[i], down1[i] * below1[i]
        out[i] = y1 / (y0 + y1) if y0 + y1 else 0.0
    return out


def main_text(source: str | None, model: dict) -> str:
    page = parse(source or "")
    if len(page.parent) < 2:
        return ""
    texts = [i for i, t in enumerate(page.text) if t is not None]
    if len(texts) == 1 and not page.linked[texts[0]]:  # one block, and nothing says that it is not content
        around = [i for i in range(1, texts[0]) if page.text[i] is None]
        if not any(page.kind[i] in ASIDES or any(f[0] == "." for f in page.features[i]) for i in around):
            return page.text[texts[0]]
    chance = marginals(page, model)
    kept = [i for i in texts if chance[i] > 0.5]
    if not kept:  # nothing looks like content: what the page itself calls so
        inside = [False] * len(page.parent)
        for i in range(1, len(inside)):
            inside[i] = (inside[page.parent[i]] or page.kind[i] in CONTENT) and page.kind[i] not in ASIDES
        kept = [i for i in texts if inside[i]]
    return "\n".join(page.text[i] for i in kept)


# --- labelled pages -------------------------------------------------------------------------------------------------

#: Class and id names that pages commonly give to their parts (fixed values).
NAMES = {
    "content": "content article post entry story main body text article-body post-content entry-content main-content page-content story-body",
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs main-menu topnav pagination",
    "header": "header masthead site-header banner top logo branding page-header",
    "footer": "footer site-footer colophon bottom copyright page-footer",
    "sidebar": "sidebar side rail widget related aside widgets right-rail more-stories recommended",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adsbox ad-slot",
    "notice": "cookie notice consent gdpr alert cookie-banner notice-bar popup modal message warning",
    "form": "search newsletter subscribe signup login search-form contact-form form",
    "comments": "comments comment replies discussion responses comment-list reader-comments disqus respond",
    "share": "share social sharing tags meta byline social-links",
}
NEUTRAL = "wrapper container row col page outer inner section block wrap layout grid clearfix".split()


def labelled_page(seed: int, named: bool | None = None) -> tuple[str, set[str]]:
    """A page made of common parts in varied order and markup, and its content texts (each text of it is unique).

    named: whether the parts' names say what they are; by default in half of the pages.
    """
    rng = random.Random(seed)
    content: set[str] = set()
    number = iter(range(10**6))
    telling = (rng.random() < 0.5) if named is None else named

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high))).capitalize() + f" {seed}x{next(number)}" + rng.choice(["", ".", ".", "."])

    def said(low: int, high: int) -> str:
        text = words(low, high)
        content.add(text)
        return text

    def name(kind: str, chance: float = 0.85) -> str:
        if rng.random() > chance:
            return ""
        word = rng.choice(NAMES[kind].split()) if telling else "".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiouy") for _ in range(rng.randint(2, 4)))
        return f' {rng.choice(["class", "class", "id"])}="{word}"'

    def links(n: int) -> str:
        tag = rng.choice(["ul", "ul", "div"])
        item = "li" if tag == "ul" else rng.choice(["span", "p"])
        return f"<{tag}>" + "".join(f'<{item}><a href="/{k}">{words(1, 3)}</a></{item}>' for k in range(n)) + f"</{tag}>"

    def box(tags: list[str], kind: str, inner: str) -> str:
        tag = rng.choice(tags)
        return f"<{tag}{name(kind, 1.0 if tag in ('div', 'section', 'p') else 0.5)}>{inner}</{tag}>"

    def para(low=6, high=90) -> str:
        low, high = (2, 8) if rng.random() < 0.2 else (low, high)
        return f"<p>{said(low, high)}</p>" if rng.random() < 0.9 else f"<p>{said(low, high)}"

    def ad() -> str:
        return box(["div", "div", "aside", "section"], "ad", words(3, 18) if rng.random() < 0.7 else f"<p>{words(4, 30)}</p>")

    def article() -> str:
        parts = [f"<h1>{said(2, 10)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.randint(2, 9)):
            r = rng.random()
            if r < 0.62:
                parts.append(para())
            elif r < 0.70:
                level = rng.choice("2234")
                parts.append(f"<h{level}>{said(1, 7)}</h{level}>")
            elif r < 0.76:
                parts.append("<ul>" + "".join(f"<li>{said(2, 20)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif r < 0.80:
                parts.append(f"<blockquote>{said(5, 40)}</blockquote>")
            elif r < 0.83:
                parts.append(f"<pre>{said(3, 20)}</pre>")
            elif r < 0.86:
                parts.append("<table>" + "".join("<tr>" + "".join(f"<td>{said(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>")
            elif r < 0.89:
                parts.append(f"<figure><figcaption>{said(3, 14)}</figcaption></figure>")
            elif r < 0.92:
                parts.append(f"<div>{said(8, 60)}</div>")
            elif r < 0.95:
                parts.append(ad())
            elif r < 0.97:
                parts.append(box(["div", "ul"], "share", links(3)))
            else:
                parts.append(box(["aside", "div"], "sidebar", links(3)))
        body = "".join(parts)
        tag = rng.choice(["article", "article", "main", "div", "div", "section"])
        body = f"<{tag}{name('content', 0.4 if tag in ('article', 'main') else 1.0)}>{body}</{tag}>"
        if rng.random() < 0.4:
            outer = rng.choice(["main", "div", "div", "section"])
            body = f'<{outer} class="{rng.choice(NEUTRAL)}">{body}</{outer}>'
        return body

    def comments() -> str:
        one = lambda: "<{0}{1}><p>{2}</p></{0}>".format(rng.choice(["div", "li", "article"]), name("comments", 0.6), words(3, 50))
        return box(["section", "div", "div"], "comments", (f"<h3>{words(1, 3)}</h3>" if rng.random() < 0.6 else "") + "".join(one() for _ in range(rng.randint(1, 4))))

    def form() -> str:
        return f"<form{name('form', 0.6)}><label>{words(1, 5)}</label><input name='q'>" + (f"<p>{words(3, 15)}</p>" if rng.random() < 0.5 else "") + "<button>ok</button></form>"

    if rng.random() < 0.1:  # a fragment: nothing but content, with or without the elements around it
        inner = "".join(para(2, 60) for _ in range(rng.randint(1, 6))) if rng.random() < 0.6 else article()
        inner = rng.choice(["{}", "<div>{}</div>", "<body>{}</body>", "<html><body><div>{}</div></body></html>"]).format(inner)
        return inner, content

    before = [lambda: box(["header", "header", "div"], "header", "<{0}>{1}</{0}>".format(rng.choice(["h1", "h2", "div", "p"]), words(1, 5)) + (links(4) if rng.random() < 0.5 else "")), lambda: box(["nav", "nav", "div"], "nav", links(rng.randint(3, 8))), lambda: box(["div", "div", "section", "aside"], "notice", f"<p>{words(5, 40)}</p>" if rng.random() < 0.7 else words(5, 40)), ad, form, lambda: box(["aside", "div"], "sidebar", f"<h3>{words(1, 3)}</h3>" + links(4))]
    after = [comments, comments, lambda: box(["aside", "aside", "div"], "sidebar", f"<h3>{words(1, 3)}</h3>" + (links(4) if rng.random() < 0.6 else f"<p>{words(5, 40)}</p>")), ad, form, lambda: box(["div", "section"], "share", links(3))]
    top = [f() for f in before if rng.random() < 0.5]
    rest = [f() for f in after if rng.random() < 0.45]
    foot = [box(["footer", "footer", "div"], "footer", (links(3) if rng.random() < 0.5 else "") + (f"<p>{words(3, 25)}</p>" if rng.random() < 0.6 else words(3, 25)))] if rng.random() < 0.9 else []
    inner = "".join(top) + article() + "".join(rest) + "".join(foot)
    if rng.random() < 0.3:
        inner = f'<div class="{rng.choice(NEUTRAL)}">{inner}</div>'
    return f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head><body>{inner}</body></html>", content


@lru_cache(maxsize=1)
def fit() -> dict:
    """Log-odds of each feature and, by kind of node, the chance of each label given the parent's, from labelled pages."""
    seen = [Counter(), Counter()]
    total = [0, 0]
    moves: dict[str, list[list[float]]] = defaultdict(lambda: [[SMOOTHING * 2, SMOOTHING], [SMOOTHING, SMOOTHING * 2]])
    for seed in range(LABELLED):
        source, content = labelled_page(seed)
        page = parse(source)
        n = len(page.parent)
        label = [int(t in content) if t is not None else -1 for t in page.text]
        # an element is content if most of the text below it is
        good, all_ = [0] * n, [0] * n
        for i in range(n - 1, 0, -1):
            if label[i] >= 0:
                good[i], all_[i] = label[i] * len(page.text[i]), len(page.text[i])
            else:
                label[i] = int(page.kind[i] not in ("html", "body") and 2 * good[i] > all_[i])
            good[page.parent[i]] += good[i]
            all_[page.parent[i]] += all_[i]
        label[0] = 0
        for i in range(1, n):
            y = label[i]
            total[y] += 1
            seen[y].update(page.features[i])
            for kind in (page.kind[i], "?"):
                moves[kind][label[page.parent[i]]][y] += 1
    weight = {f: math.log((seen[1][f] + SMOOTHING) / (total[1] + 2 * SMOOTHING)) - math.log((seen[0][f] + SMOOTHING) / (total[0] + 2 * SMOOTHING)) for f in seen[0] | seen[1]}
    weight = {f: w * (TEXT_SHARE if f[0] == "#" else TREE_SHARE if f[0] == "@" else 1) for f, w in weight.items()}
    pair = {k: tuple(tuple(x / sum(row) for x in row) for row in m) for k, m in moves.items()}
    return {"weight": weight, "pair": pair}


def extract(pages: DataFrame, model: dict | None = None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """All columns of (page_id, url) with text and n_chars: the main text of each page, its blocks joined by line breaks.

    Null html counts as empty and gives an empty text, as does a page without content. A source of one block
    with no name or tag against it, as one without tags, gives that block. A script, style, title or text area that is never closed takes the rest of the source. Repeated rows give repeated rows; other columns are ignored.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model or fit())

    def run(batches):
        for part in text_slices(batches, "html"):
            texts = [main_text(x, sent.value) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
