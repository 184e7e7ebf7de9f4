"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element and text of a page is a node that is content or not. A node's own potential is a logistic regression over
its tag, words of the class, id and role of itself and of what it lies in, its share of linked text and its length;
parent-child potentials are learnt joint frequencies by kind of child. Names that say what an element has, and names of
furniture on elements that hold most of a page and what it is about, do not count. Messages go from the leaves up and from the root down once each; texts whose marginal
is at least one half make the main text.

Potentials are fitted on labelled pages: the small ones that labelled() builds from pieces of every kind, and at most about
TRAIN_PAGES pages of the input. Of these, what lies outside the one article or main element is not content; inside it,
elements whose names tell of furniture, and all that they hold, have no label, so that only the built pages teach what a
name inside an article means. Tasks count equal nodes; the driver sees counts of feature patterns, never pages. A page is
handled inside its row, so nothing but counts is shuffled.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspan.llm.common import small_batches

#: Bound of the input pages that the model is fitted on, drawn by chance, and the weight of a built page beside them.
TRAIN_PAGES, WEIGHT = 400, 10.0
#: Words of class, id and role, by what they tell of an element.
FAMILIES = {
    "menu": "nav navigation navbar menu menus breadcrumb breadcrumbs pagination pager toc tabs",
    "head": "header masthead topbar logo banner",
    "foot": "footer foot copyright colophon contentinfo imprint",
    "side": "sidebar aside side rail widget widgets related recommended recommendations complementary trending",
    "advert": "ad ads advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promotion taboola outbrain adsbygoogle",
    "notice": "cookie cookies consent cookieconsent notice alert popup modal newsletter subscribe subscription gdpr paywall",
    "remark": "comment comments commentlist reply replies disqus discussion respond responses feedback opinions",
    "share": "share sharing social follow",
    "form": "form search login signup",
    "main": "article main content post entry story",
}
#: Families that tell of furniture.
FURNITURE = frozenset(FAMILIES) - {"main", "head"}
_FAMILY = {w: k for k, ws in FAMILIES.items() for w in ws.split()}
#: These also tell as the beginning or end of a longer word, such as usercomments.
STEMS = "comments comment sidebar cookies cookie consent gdpr newsletter advert sponsored breadcrumbs breadcrumb navbar footer paywall popup widget pagination taboola outbrain".split()
#: With one of these a name says what its element has or allows, such as has-sidebar, and not what it is.
_STATES = frozenset("has have with without no not is enable enabled disable disabled open opened closed allow allowed hide hidden show on off support supports".split())
#: Tags that mark what a page is about.
_CORE = frozenset(("article", "main", "h1"))
#: Families of tags that say the same.
_TAG_FAMILY = {"nav": ("menu",), "menu": ("menu",), "footer": ("foot",), "aside": ("side",), "form": ("form",)}
TAGS = "#text a abbr article aside b blockquote body button code dd details div dl dt em fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header html i iframe input label li main nav noscript ol option p pre q s section select small span strong sub summary sup table tbody td textarea tfoot th thead title tr u ul".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
BLOCKS = frozenset("address article aside blockquote body br button caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav noscript ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
#: An opening tag of the first kind closes open elements of the second, up to one of the third.
_PARAGRAPH_ENDS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_SCOPE = frozenset("article aside blockquote body button div fieldset figure footer form header html li main nav section td th table ul ol".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>|[^<]++|<", re.S)
_NAMED = re.compile(r"(?<![\w-])(class|id|role|y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_WHITE = re.compile(r"\s+")
_ENDS = (".", "!", "?", "…", "\"", "”", "»")

#: Pieces of small labelled pages. y is 1 for content, 0 for the rest, and holds for what lies inside; {t} is a sentence.
_SENTENCES = (
    "The valley woke slowly under the rain, and the mill began to turn again after many weeks of silence.", "Read it again tomorrow!", "Das Tal erwachte langsam im Regen, und die Mühle drehte sich wieder.",
    "La vallée se réveillait lentement sous la pluie, et le moulin tournait de nouveau.", "Nobody had seen it",
)
_SHELLS = (
    "<article y=1>{}</article>", "<main y=1>{}</main>", "<main y=1><article>{}</article></main>", '<div id=content y=1 class="post entry">{}</div>', "<section y=1>{}</section>",
    "<div><div class=story y=1>{}</div></div>", "{}", "<table><tr><td class=main y=1>{}</td></tr></table>", "<div y=1>{}</div>",
)
_BODIES = (
    ("<h1 y=1>{t}</h1>", "<p y=1>{t}</p>", "<p y=1>{t} <a href=c>mill</a> {t}</p>", "<ul y=1><li>{t}</li><li>one item</li></ul>"),
    ("<header y=1><h1>Head</h1></header>", "<div y=1><p>{t}</p><blockquote><p>{t}</p></blockquote></div>", "<pre y=1>code here</pre>", "<p y=1>Short.</p>"),
    ('<div y=1 class="article-header"><h2>Mill turns</h2></div>', "<p y=1><b>{t}</b><br>{t}</p>", "<table y=1><tr><th>Name</th><td>12</td></tr></table>", "<figure y=1><figcaption>{t}</figcaption></figure>"),
    ("<h2 y=1>More</h2>", "<p y=1>{t} <em>Turn</em> again.</p>", "<ol y=1><li>first</li><li><p>{t}</p></li></ol>", '<div y=1 class="content"><div>{t}</div></div>'),
    ("<p y=1>{t}</p>", "<p y=1>{t}</p>", "<h3 y=1>{t}</h3>", "<dl y=1><dt>Mill</dt><dd>{t}</dd></dl>"),
)
_OUTER = (
    "<header y=0><a href=x>Site</a><nav><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul></nav></header>", "<div id=header y=0><span>Daily Mill</span><p>{t}</p></div>", "<div class=masthead y=0><h1>Daily Mill</h1></div>",
    "<footer y=0><p>All rights held, 2020.</p></footer>", "<footer y=0>&copy; mill.example &middot; {t}</footer>", '<div class="topbar logo" y=0>Mill</div>', "<div y=0><a href=a>World</a> <a href=b>Sport</a></div>",
)
_PIECES = (
    "<nav y=0><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul></nav>", '<div class="menu top" y=0><a href=a>World</a> <a href=b>Sport</a></div>', "<div class=breadcrumb y=0><a href=x>Up</a> &gt; <span>{t}</span></div>", "<div role=navigation y=0><p>{t}</p></div>", "<ul class=toc y=0><li>{t}</li></ul>",
    "<div class=ad y=0><p>{t}</p></div>", "<div class=ad y=0>{t}</div>", "<div class=advert y=0><p>{t}</p><p>{t}</p></div>", "<section class=adverts y=0><h3>{t}</h3><p>{t}</p></section>", "<div class=sponsor y=0><span>{t}</span></div>", "<p class=promo y=0>{t}</p>", "<aside class=advert y=0><p>{t}</p></aside>",
    "<div class=cookie-notice y=0><p>{t}</p><button>Accept</button></div>", "<div class=notice y=0><p>{t}</p></div>", "<p class=notice y=0>{t}</p>", '<div class="newsletter popup" y=0><p>{t}</p><form><input><button>Go</button></form></div>', "<div id=consent y=0>{t}</div>", '<section class="alert" y=0><p>{t}</p></section>', "<div class=subscribe y=0><h4>{t}</h4><p>{t}</p></div>",
    "<div id=comments y=0><h3>Comments</h3><ul class=commentlist><li><p>{t}</p></li><li>{t}</li></ul></div>", "<section class=comments y=0><div class=comment><p>{t}</p></div></section>", "<div class=comments y=0><p>{t}</p><p>{t}</p></div>", "<ol class=replies y=0><li><div>{t}</div></li></ol>", "<div id=respond y=0><p>{t}</p></div>", "<article class=comment y=0><p>{t}</p></article>",
    '<div class="share social" y=0><a href=s>Share</a></div>', "<div class=share y=0><p>{t}</p></div>", "<ul class=social y=0><li>{t}</li></ul>",
    "<aside y=0><h3>Related</h3><p>{t}</p><ul><li><a href=d>Other</a></li></ul></aside>", "<div class=sidebar y=0><p>{t}</p><p>{t}</p></div>", "<div id=sidebar y=0><h3>{t}</h3><ul><li>{t}</li></ul></div>", "<div class=related y=0><ul><li><a href=x>{t}</a></li></ul></div>", "<div class=widget y=0>{t}</div>", "<section class=recommended y=0><h3>{t}</h3><p>{t}</p></section>",
    "<form y=0><label>Name</label><textarea>{t}</textarea><select><option>{t}</option></select><button>Send</button></form>", "<form class=search y=0><p>{t}</p><input></form>", "<div class=login y=0><p>{t}</p></div>",
    "<footer y=0><p>{t}</p></footer>", "<div id=footer y=0><p>{t}</p></div>", "<div role=contentinfo y=0>{t}</div>", "<noscript y=0>{t}</noscript>", "<button y=0>{t}</button>", "<iframe y=0>{t}</iframe>",
)


def labelled() -> Iterator[str]:
    """Small labelled pages: every piece of furniture between, after and around the blocks of an article, in turn with all
    shells, articles and outer parts."""
    said = lambda x, k: x.replace("{t}", _SENTENCES[k % len(_SENTENCES)])
    for n, piece in enumerate(_PIECES):
        for k in range(4):
            body = [said(x, n + j + k) for j, x in enumerate(_BODIES[(n + k) % len(_BODIES)])]
            other = said(_PIECES[(n * 5 + k * 11 + 3) % len(_PIECES)], k)
            inside = [*body[:2], said(piece, n + k), *body[2:], other] if k < 2 else [*body, said(piece, n + k)] if k == 2 else body
            around = (said(piece, n), other) if k == 3 else ("", "")
            outer = [said(_OUTER[(n + j) % len(_OUTER)], n) for j in (k, k + 3)]
            yield "<html y=0><head><title>T</title></head><body>" + outer[0] + around[0] + _SHELLS[(n + 2 * k) % len(_SHELLS)].format("".join(inside)) + around[1] + outer[1] + "</body></html>"


class Node:
    """An element or text: tag, families of its own names and of those around it, parent, text, length, and y."""

    __slots__ = ("tag", "key", "under", "parent", "text", "length", "linked", "y")

    def __init__(self, tag: str, key: tuple, under: frozenset, parent: int, text: str = "", y: int | None = None):
        self.tag, self.key, self.under, self.parent, self.text, self.length, self.linked, self.y = tag, key, under, parent, text, 0, 0, y


@lru_cache(maxsize=1 << 14)
def families(name: str) -> tuple:
    """Families that the words of one name tell of. Where it says what its element has, furniture does not count."""
    parts = [w.lower() for w in _PART.findall(name)]
    found = {f for w in parts if (f := _FAMILY.get(w) or _stem(w))}
    return tuple(sorted(found - FURNITURE if len(parts) > 1 and not _STATES.isdisjoint(parts) else found))


def _stem(word: str) -> str | None:
    return next((_FAMILY[w] for w in STEMS if word.startswith(w) or word.endswith(w)), None)


@lru_cache(maxsize=4096)
def _within(under: frozenset, key: tuple) -> frozenset:
    return under | frozenset(key)


class _Open:
    """The open elements. How many of a tag are open is counted, so that nothing is searched for in vain."""

    def __init__(self, nodes: list[Node]):
        self.nodes, self.stack, self.tags = nodes, [0], Counter()

    def push(self, i: int) -> None:
        self.stack.append(i)
        self.tags[self.nodes[i].tag] += 1

    def close(self, closes: set | frozenset, until: set | frozenset = frozenset()) -> None:
        """Closes the innermost element of closes, if none of until is inside it."""
        if not any(self.tags[t] for t in closes):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.nodes[self.stack[k]].tag
            if tag in closes:
                for i in self.stack[k:]:
                    self.tags[self.nodes[i].tag] -= 1
                del self.stack[k:]
                return
            if tag in until:
                return


def parse(page: str) -> list[Node]:
    """Nodes in page order, parents before children; node 0 is the page. Texts of scripts, styles and comments are left out."""
    nodes, at, end = [Node("html", (), frozenset(), -1)], 0, len(page)
    opened = _Open(nodes)
    stack = opened.stack
    while at < end:
        m = _TOKEN.match(page, at)
        at, name = m.end(), m[2]
        up = nodes[stack[-1]]
        if name is None:
            text = m[0]
            if text[0] != "<" or len(text) == 1:
                last = nodes[-1]
                if last.tag == "#text" and last.parent == stack[-1]:
                    last.text += text
                else:
                    nodes.append(Node("#text", (), frozenset(), stack[-1], text, up.y))
            continue
        name = name.lower()
        if m[1]:
            opened.close({name})
            continue
        if name in RAW:
            close = re.compile(f"</{name}\\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if name == "html":
            words = {a.lower(): b or c or d for a, b, c, d in _NAMED.findall(m[3])}
            nodes[0].y = int(words["y"]) if words.get("y", "").isdigit() else None
            continue
        closes, until = _CLOSES.get(name, ((), ()))
        if name in _PARAGRAPH_ENDS:
            closes, until = {"p"}, _SCOPE
        if closes:
            opened.close(closes, until)
            up = nodes[stack[-1]]
        y, found = up.y, _TAG_FAMILY.get(name, ())
        if m[3] and not m[3].isspace():
            words = {a.lower(): b or c or d for a, b, c, d in _NAMED.findall(m[3])}
            y = int(words.pop("y")) if words.get("y", "").isdigit() else y
            if name != "body":
                found = tuple(sorted({*found, *(f for v in words.values() for w in v.split() for f in families(w))}))
        nodes.append(Node(name, found, frozenset(), stack[-1], y=y))
        if name not in VOID and not m[3].endswith("/"):
            opened.push(len(nodes) - 1)
    for i in range(len(nodes) - 1, 0, -1):
        n = nodes[i]
        if n.tag == "#text":
            n.length = len(n.text.strip())
        up = nodes[n.parent]
        up.length += n.length
        up.linked += n.length if n.tag == "a" else n.linked
    _settle(nodes)
    return nodes


def _settle(nodes: list[Node]) -> None:
    """Drops names of furniture from elements that hold most of the page's plain text and something that a page is about, not
    inside other furniture: such names speak of a layout, and the form about a whole page is none. Then notes for each
    node the families that it lies in."""
    core, most = [False] * len(nodes), (nodes[0].length - nodes[0].linked) / 2
    for i in range(len(nodes) - 1, 0, -1):
        n = nodes[i]
        if core[i] and n.length - n.linked >= most and not FURNITURE.isdisjoint(n.key):
            n.key = tuple(f for f in n.key if f not in FURNITURE)
        if (core[i] or n.tag in _CORE or "main" in n.key) and FURNITURE.isdisjoint(n.key):
            core[n.parent] = True
    for n in nodes[1:]:
        up = nodes[n.parent]
        n.under = _within(up.under, up.key)


_COLUMN = {("tag", t): k for k, t in enumerate([*TAGS, "other"])}
for _name in (*(("family", f) for f in FAMILIES), *(("under", f) for f in FAMILIES), ("length", 0), ("length", 1), ("length", 2), ("length", 3), "linked", "sentence", "bias"):
    _COLUMN[_name] = len(_COLUMN)
KINDS = ("text", "inline", "block")


def columns(n: Node) -> list[int]:
    """Places of a node's features that hold."""
    out = [_COLUMN.get(("tag", n.tag), _COLUMN["tag", "other"]), _COLUMN["bias"], _COLUMN["length", (n.length > 0) + (n.length > 25) + (n.length > 120)]]
    if n.key:
        out += [_COLUMN["family", f] for f in n.key]
    if n.under:
        out += [_COLUMN["under", f] for f in n.under]
    if n.length and n.linked * 2 > n.length:
        out.append(_COLUMN["linked"])
    if n.tag == "#text" and n.text.rstrip().endswith(_ENDS):
        out.append(_COLUMN["sentence"])
    return out


def kind(n: Node) -> int:
    return 0 if n.tag == "#text" else 2 if n.tag in BLOCKS else 1


def tallied(pages: Iterator[list[Node]], weight: float = 1.0) -> Counter:
    """How often each pattern of features stands with each label, as 'own y columns', and each pair of labels of a child and its
    parent, as 'pair kind y parent's y'. Nodes without a label count nowhere."""
    out: Counter = Counter()
    for nodes in pages:
        for n in nodes:
            if n.y is None:
                continue
            out[f"own {n.y} {' '.join(map(str, sorted(columns(n))))}"] += weight
            if n.parent >= 0 and nodes[n.parent].y is not None:
                out[f"pair {kind(n)} {n.y} {nodes[n.parent].y}"] += weight
    return out


def fitted(counts: Counter) -> tuple[list[float], list]:
    """Logistic weights of the features, and the potentials psi[kind][child][parent], from tallied nodes."""
    own = sorted((k.split()[1:], n) for k, n in counts.items() if k.startswith("own"))
    x, joint = np.zeros((len(own), len(_COLUMN))), np.full((3, 2, 2), 0.5)
    for row, (parts, _) in enumerate(own):
        x[row, list(map(int, parts[1:]))] = 1
    y, n = np.array([float(p[0]) for p, _ in own]), np.array([m for _, m in own], float)
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - y)) + 0.3 * w
        w -= np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 0.3 * np.eye(len(w)), grad)
    for key, m in counts.items():
        if key.startswith("pair"):
            joint[tuple(map(int, key.split()[1:]))] += m
    joint /= joint.sum((1, 2), keepdims=True)
    return w.tolist(), (joint / (joint.sum(1, keepdims=True) * joint.sum(2, keepdims=True))).tolist()


def marginals(nodes: list[Node], model: tuple) -> list[float]:
    """Probability of content of each node: messages up, then down."""
    weights, psi = model
    n = len(nodes)
    own = [0.0] * n
    for i, node in enumerate(nodes):
        s = sum([weights[c] for c in columns(node)])
        own[i] = 1 / (1 + np.exp(-s)) if -500 < s < 500 else float(s > 0)
    one, zero = own[:], [1 - x for x in own]
    up = [(1.0, 1.0)] * n
    for i in range(n - 1, 0, -1):
        t, a, b = psi[kind(nodes[i])], zero[i], one[i]
        m0, m1 = a * t[0][0] + b * t[1][0], a * t[0][1] + b * t[1][1]
        up[i] = m0, m1
        k = nodes[i].parent
        z, o = zero[k] * m0, one[k] * m1
        total = z + o or 1.0
        zero[k], one[k] = z / total, o / total
    for i in range(1, n):
        k, t, (m0, m1) = nodes[i].parent, psi[kind(nodes[i])], up[i]
        a, b = zero[k] / (m0 or 1e-300), one[k] / (m1 or 1e-300)
        z, o = zero[i] * (t[0][0] * a + t[0][1] * b), one[i] * (t[1][0] * a + t[1][1] * b)
        total = z + o or 1.0
        zero[i], one[i] = z / total, o / total
    return one


def main_text(page: str, model: tuple) -> str:
    """Content texts in page order: references decoded, white space collapsed, blocks joined by a space."""
    nodes = parse(page)
    content = marginals(nodes, model)
    parts: list[str] = []
    for i, n in enumerate(nodes):
        if n.tag != "#text":
            if n.tag in BLOCKS:
                parts.append(" ")
        elif content[i] >= 0.5:
            parts.append(_after(nodes, i) + html.unescape(n.text))
    return _WHITE.sub(" ", "".join(parts)).strip()


def _after(nodes: list[Node], i: int) -> str:
    """A space if a block closed between the text's parent and what came before it."""
    return " " if i and nodes[i - 1].parent != nodes[i].parent and _closed(nodes, i) else ""


def _closed(nodes: list[Node], i: int) -> bool:
    k, above = i - 1, nodes[i].parent
    while k > above:
        if nodes[k].tag in BLOCKS:
            return True
        k = nodes[k].parent
    return False


def article_labels(page: str) -> list[Node] | None:
    """A parsed page with labels from its one article or main element; None if it has not exactly one. What lies outside is not
    content. Inside it, menus, forms, side notes and the like are not; what bears a name of furniture, with all that it
    holds, has no label; the rest is content."""
    nodes = parse(page)
    marked = [i for i, n in enumerate(nodes) if n.tag in ("article", "main")]
    if len(marked) != 1:
        return None
    for i, n in enumerate(nodes):
        up = nodes[n.parent].y if i else 0
        if i == marked[0]:
            n.y = 1
        elif up != 1:
            n.y = up
        elif n.tag in ("nav", "aside", "form", "footer", "button", "noscript"):
            n.y = 0
        else:
            n.y = None if FURNITURE.intersection(n.key) else 1
    return nodes


def trained(pages: DataFrame, html_col: str = "html") -> tuple:
    """The model, fitted on built pages and on a bounded sample of pages that mark their article."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (article_labels(x) for x in batch.column(0).to_pylist() if x)
            counts = tallied(p for p in found if p)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.float64())], ["what", "n"])

    drawn = pages.select(F.col(html_col).cast("string").alias("html")).filter(F.pmod(F.xxhash64("html"), F.lit(1_000_000)) < 1_000_000 * TRAIN_PAGES / max(1, pages.count()))
    counts = tallied(map(parse, labelled()), WEIGHT)
    for row in drawn.mapInArrow(run, "what string, n double").groupBy("what").agg(F.sum("n").alias("n")).collect():
        counts[row["what"]] += row["n"]
    return fitted(counts)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: tuple | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of each page, by itself. Null and empty pages, and pages without content, give an empty
    text. Ids and urls may be null or repeat; equal pages give equal texts; pages of any length are read whole. An empty
    table gives an empty one. Other columns are ignored, whatever their names."""
    small_batches(pages.sparkSession)
    model = model or trained(pages, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                part = batch.slice(k, 100)
                texts = [main_text(x, model) if x else "" for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")
