"""Main text of web pages: a tree-structured graphical model over the DOM, with sum-product message passing."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table

# HTML's void, raw-text and block elements, and what ends an open paragraph or item.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template svg math iframe object canvas audio video head title select option textarea button datalist".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tfoot tr td th", "table")}
_ENDED = {tag: (frozenset(ends.split()), frozenset(scope.split())) for tag, (ends, scope) in CLOSES.items()}
SCOPES = frozenset("html body article aside section div table td th li dl ul ol main nav header footer form blockquote fieldset figure".split())

#: Elements that an inline end tag does not reach out of.
FENCES = frozenset({"table", "article", "body"})

# Words in tags, classes, ids and roles that tell content from the rest.
BOILER = re.compile(r"(?:^|[-_ ])(?:ad|ads|adv|advert|advertisement|sponsor(?:ed)?|promo(?:tion)?|banner|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|foot|copyright|legal|sidebar|side|aside|widget|related|recommended|more|share|sharing|social|follow|subscribe|newsletter|signup|login|search|form|cookie|cookies|consent|gdpr|notice|alert|popup|modal|overlay|comment|comments|disqus|respond|reply|replies|discussion|pagination|pager|tags|toolbar|skip|hidden|outbrain|taboola)(?:$|[-_ 0-9])", re.I)
CONTENT = re.compile(r"(?:^|[-_ ])(?:article|content|main|post|entry|story|body|text|prose)(?:$|[-_ 0-9])", re.I)
COMMENTS = re.compile(r"(?:^|[-_ ])(?:comment|comments|disqus|respond|reply|replies|discussion)(?:$|[-_ 0-9])", re.I)
TAGS = ("html", "body", "article", "main", "section", "div", "p", "h1", "h2-6", "ul", "li", "a", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "pre", "figure", "inline", "other")
_TAG_OF = {**{t: i for i, t in enumerate(TAGS)}, **{f"h{k}": TAGS.index("h2-6") for k in range(2, 7)}, "ol": TAGS.index("ul"), "menu": TAGS.index("ul"), "dl": TAGS.index("ul"), "dt": TAGS.index("li"), "dd": TAGS.index("li"), "th": TAGS.index("td"), "tr": TAGS.index("table"), "tbody": TAGS.index("table"), "figcaption": TAGS.index("figure")}
_TAG_OF |= {t: TAGS.index("inline") for t in "b i em strong span u s small sub sup code q cite abbr mark time font kbd var br".split()}
#: Unary features of a node: its tag, words of its names, shares of text in links, sizes, and its place.
WIDTH = len(TAGS) + 14


class Node:
    __slots__ = ("tag", "names", "parent", "children", "parts", "hidden", "label")

    def __init__(self, tag: str, names: str, parent: int, hidden: bool, label: int = -1):
        self.tag, self.names, self.parent, self.children, self.parts, self.hidden, self.label = tag, names, parent, [], [], hidden, label


class Tree(HTMLParser):
    """Nodes in page order, the root first. Ends of paragraphs, items and the head that a page leaves out are put in; an end
    tag without its start is left out. Each start tag looks at open elements of its own scope alone, and `counts` holds how
    many of each name are open, so that a page's cost grows with its length."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.open = [Node("html", "", -1, False)], [0]
        self.counts: Counter[str] = Counter()
        self.fenced: list[Counter[str]] = [Counter()]  # open elements by name, since each open fence
        self.runs: list[tuple[int, str]] = []

    def _pop_to(self, depth: int) -> None:
        for i in reversed(self.open[depth:]):
            tag = self.nodes[i].tag
            self.counts[tag] -= 1
            if tag in FENCES:
                self.fenced.pop()
            else:
                self.fenced[-1][tag] -= 1
        del self.open[depth:]

    def _push(self, tag: str) -> None:
        """Open the last node."""
        self.open.append(len(self.nodes) - 1)
        self.counts[tag] += 1
        if tag in FENCES:
            self.fenced.append(Counter())
        else:
            self.fenced[-1][tag] += 1

    def _end_head(self) -> None:
        """Close the head: an element that no head holds has begun."""
        for depth in range(1, len(self.open)):
            if self.nodes[self.open[depth]].tag == "head":
                self._pop_to(depth)
                return

    def _begin_body(self) -> None:
        """Put in the body that a page leaves out."""
        if not self.counts["body"] and not self.counts["frameset"]:
            self.nodes.append(Node("body", "", 0, False))
            self.nodes[0].children.append(len(self.nodes) - 1)
            self._pop_to(1)
            self._push("body")

    def _end_omitted(self, tag: str) -> None:
        """Close what a start tag ends: an open paragraph, item, cell or row of the same scope."""
        ends, scope = _ENDED.get(tag, (frozenset(), frozenset()))
        ends = ends | {"p"} if tag in BLOCK else ends
        if not any(self.counts[e] for e in ends):
            return
        for depth in range(len(self.open) - 1, 0, -1):
            at = self.nodes[self.open[depth]].tag
            if at in ends:
                self._pop_to(depth)
                if at != "p" or not (ends - {"p"}):
                    return
            elif at in scope or (at in SCOPES and not (scope and at not in scope and ends - {"p"})):
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "head", "body") and self.counts[tag] or tag == "html":
            return  # a second one is left out
        if self.counts["head"] and tag not in HEAD:
            self._end_head()
        if tag not in HEAD and tag not in ("head", "body", "frameset"):
            self._begin_body()
        self._end_omitted(tag)
        names = " ".join(str(v) for k, v in attrs if k in ("class", "id", "role", "aria-label") and v)
        hidden = tag in HIDDEN or any(k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and v and "display:none" in v.replace(" ", "")) for k, v in attrs)
        parent = self.open[-1]
        node = Node(tag, names, parent, hidden or self.nodes[parent].hidden, next((int(v) for k, v in attrs if k == "data-content" and v in ("0", "1")), -1))
        self.nodes.append(node)
        self.nodes[parent].children.append(len(self.nodes) - 1)
        if tag in VOID:
            self.runs.append((len(self.nodes) - 1, " "))
        else:
            self._push(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if not self.counts[tag] or (tag not in BLOCK and not self.fenced[-1][tag]):
            return
        for depth in range(len(self.open) - 1, 0, -1):
            if self.nodes[self.open[depth]].tag == tag:
                self._pop_to(depth)
                return

    def handle_data(self, data: str) -> None:
        if self.counts["head"] and not data.isspace() and self.nodes[self.open[-1]].tag == "head":
            self._end_head()  # text is no part of a head
        if len(self.open) == 1 and not data.isspace():
            self._begin_body()
        at = self.open[-1]
        if not self.nodes[at].hidden:
            self.runs.append((at, data))


_OPENING = re.compile("<[A-Za-z/!?]")


def parse(html: str) -> Tree:
    """The tree of a page. A tag that the page's end cuts off is left out with all that follows, as it can have no end there."""
    tree = Tree()
    cut = _OPENING.search(html, html.rfind(">") + 1)
    tree.feed(html[: cut.start()] if cut else html)
    tree.close()
    return tree


@lru_cache(maxsize=10_000)
def _named(names: str) -> tuple[bool, bool, bool]:
    return bool(BOILER.search(names)), bool(CONTENT.search(names)), bool(COMMENTS.search(names))


def features(tree: Tree) -> np.ndarray:
    """(nodes, WIDTH) of 0/1 and bounded features; text sizes count a node's whole subtree."""
    nodes = tree.nodes
    n = len(nodes)
    size, linked, stops, in_link, depth = [0] * n, [0] * n, [0] * n, [False] * n, [0] * n
    for i in range(1, n):
        p = nodes[i].parent
        in_link[i] = in_link[p] or nodes[i].tag == "a"
        depth[i] = depth[p] + 1
    for i, text in tree.runs:
        k = len(text.strip())
        size[i] += k
        if in_link[i]:
            linked[i] += k
        stops[i] += text.count(". ") + text.count(", ")
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        size[p] += size[i]
        linked[p] += linked[i]
        stops[p] += stops[i]
    out = np.zeros((n, WIDTH))
    out[np.arange(n), [_TAG_OF.get(x.tag, len(TAGS) - 1) for x in nodes]] = 1
    total, other = max(1, size[0]), len(TAGS)
    out[:, other:] = [
        (*_named(x.names), x.hidden, s == 0, s > 60, s > 200, s / total, k / max(1, s), k > 0.5 * s, min(1.0, 40 * t / max(40, s)), d <= 2, s < 25, 1)
        for x, s, k, t, d in zip(nodes, size, linked, stops, depth, strict=True)
    ]
    return out


def marginals(parents: list[int], unary: list[float], pair: list[list[float]], with_pairs: bool = False) -> tuple[list[float], np.ndarray]:
    """Sum-product on the tree. unary: log odds of state 1; pair: log potentials of (parent, child) states. Messages are log
    odds too: they pass upward from the leaves, then downward. Gives the marginal of state 1 of each node and, if asked
    for, the summed joint marginals of (parent, child)."""
    (a, b), (c, d) = pair
    exp, log = math.exp, math.log
    up, belief = [0.0] * len(parents), list(unary)
    for i in range(len(parents) - 1, 0, -1):
        e = exp(max(-500.0, min(500.0, belief[i])))
        up[i] = log(exp(c) + exp(d) * e) - log(exp(a) + exp(b) * e)
        belief[parents[i]] += up[i]
    full, joint = list(belief), np.zeros((2, 2))
    for i in range(1, len(parents)):
        rest = full[parents[i]] - up[i]
        e = exp(max(-500.0, min(500.0, rest)))
        full[i] = belief[i] + log(exp(b) + exp(d) * e) - log(exp(a) + exp(c) * e)
        if with_pairs:
            x = np.array([[a, b + belief[i]], [c + rest, d + rest + belief[i]]])
            x = np.exp(x - x.max())
            joint += x / x.sum()
    return [1 / (1 + exp(max(-500.0, min(500.0, -z)))) for z in full], joint


def _sentence(rng: np.random.Generator, n: int, style: int = 0) -> str:
    """Invented words: as sentences, without stops, as one repeated word, or with marks behind each word."""
    words = ["".join(rng.choice(list("abcdeilnorstu"), rng.integers(2, 9))) for _ in range(n)]
    if style == 2:
        words = words[:1] * n
    if style == 3:
        words = [w + "!!" for w in words]
    return " ".join(words).capitalize() + (". " if style == 0 else " ")


def labelled_pages(count: int = 160, seed: int = 4) -> list[str]:
    """Training pages of many layouts; data-content marks content (1) and the rest (0), inherited by what is inside."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    style = 0
    words = lambda a, b: _sentence(rng, int(rng.integers(a, b)), style)

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{words(1, 3)}</a></li>' for k in range(n)) + "</ul>"

    def para() -> str:
        body = "".join(words(4, 14) for _ in range(rng.integers(1, 7)))
        body = pick(body, body, f"<b>{words(3, 9)}</b>{body}", f'{body}<a href="/x">{words(1, 4)}</a> {words(3, 8)}', f"<em>{words(2, 5)}</em>{body}", f"<b>{words(3, 9)}<br>")
        return f"<p>{body}</p>" if rng.random() < 0.9 else f"<p>{body}"

    def extra() -> str:
        kind = rng.integers(8)
        if kind == 0:
            return f"<ul>{''.join(f'<li>{words(3, 12)}</li>' for _ in range(rng.integers(2, 6)))}</ul>"
        if kind == 1:
            return f"<h{rng.integers(2, 4)}>{words(2, 6)}</h2>"
        if kind == 2:
            return f"<blockquote>{para()}</blockquote>"
        if kind == 3:
            return f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>"
        if kind == 4:
            return f"<figure><img src=x><figcaption>{words(3, 8)}</figcaption></figure>"
        if kind == 5:
            return f"<pre>{words(4, 9)}</pre>"
        return para()

    def boiler(inside: bool) -> str:
        out = {
            "nav": lambda: f"<nav data-content=0>{links(rng.integers(3, 8))}</nav>",
            "menu": lambda: f'<div class="{pick("menu", "navbar", "breadcrumb", "main-nav")}" data-content=0>{links(rng.integers(3, 8))}</div>',
            "ad": lambda: f'<div class="{pick("ad", "advert", "ads-top", "sponsored", "promo", "banner")}" data-content=0>{pick("", "<p>")}{words(4, 30)}</div>',
            "aside": lambda: f"<aside data-content=0>{pick('', f'<h3>{words(1, 4)}</h3>')}{pick(links(rng.integers(2, 6)), f'<p>{words(6, 40)}</p>')}</aside>",
            "sidebar": lambda: f'<{pick("div", "section")} class="{pick("sidebar", "widget", "related", "side")}" data-content=0><h4>{words(1, 3)}</h4><p>{words(5, 30)}</p>{links(3)}</div>',
            "notice": lambda: f'<div {pick("class", "id")}="{pick("cookie-notice", "notice", "consent", "alert", "gdpr", "popup", "newsletter")}" data-content=0><p>{words(5, 30)}</p><button>{words(1, 2)}</button></div>',
            "form": lambda: f'<form data-content=0><label>{words(1, 4)}</label><input name=q>{pick("", f"<p>{words(3, 12)}</p>")}<button>{words(1, 2)}</button></form>',
            "share": lambda: f'<div class="{pick("share", "social", "follow-us", "tags")}" data-content=0>{words(1, 4)}{links(3)}</div>',
        }
        names = list(out) if not inside else ["ad", "share", "aside", "form", "notice"]
        return out[names[rng.integers(len(names))]]()

    def comments() -> str:
        each = "".join(f'<{t} class="{pick("comment", "reply", "")}"><b>{words(1, 3)}</b><p>{words(4, 40)}{words(4, 30)}</p></{t}>' for t in [pick("div", "li", "article")] for _ in range(rng.integers(1, 6)))
        return f'<{pick("div", "section")} {pick("class", "id")}="{pick("comments", "comment-list", "discussion", "replies", "reader-comments")}" data-content=0>{pick("", f"<h3>{words(1, 3)}</h3>")}{each}</div>'

    pages = []
    for _ in range(count):
        style = int(pick(0, 0, 0, 1, 2, 3))
        body = f"<h1>{words(3, 12)}</h1>" if rng.random() < 0.9 else ""
        for _ in range(rng.integers(1, 9)):
            body += para() if rng.random() < 0.75 else extra()
            if rng.random() < 0.08:
                body += boiler(True)
        tag, names = pick(("article", ""), ("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' id="main"'), ("section", ' class="entry-content"'), ("div", ' class="article-body"'))
        core = f"<{tag}{names} data-content=1>{body}</{tag}>"
        core = pick(core, core, f"<main>{core}</main>", f'<div class="wrapper">{core}</div>', f"<div><div>{core}</div></div>")
        head = pick("", f"<header data-content=0><a href=/>{words(1, 3)}</a>{pick('', links(3))}<p>{words(2, 8)}</p></header>", f'<div class="header" data-content=0>{words(1, 5)}</div>')
        foot = pick(f"<footer data-content=0>&copy; {words(2, 9)}&middot; {words(4, 30)}</footer>", f'<div class="footer" data-content=0><p>{words(3, 30)}</p>{links(3)}</div>', f"<footer data-content=0><p>{words(3, 40)}</p></footer>")
        before, after = "".join(boiler(False) for _ in range(rng.integers(0, 4))), "".join(boiler(False) for _ in range(rng.integers(0, 3)))
        pages.append(f"<html><head><title>{words(2, 8)}</title></head><body>{head}{before}{core}{comments() if rng.random() < 0.4 else ''}{after}{foot}</body></html>")
    return pages


@lru_cache(maxsize=1)
def trained(rounds: int = 120) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the unary features and pair potentials: gradient steps on the labelled pages' likelihood, whose gradient is
    observed less expected features. Both come from the marginals of one upward and one downward pass."""
    data = []
    for html in labelled_pages():
        tree = parse(html)
        labels = np.zeros(len(tree.nodes), int)
        known = [-1] * len(tree.nodes)
        for i, node in enumerate(tree.nodes):
            known[i] = node.label if node.label >= 0 else (known[node.parent] if i else -1)
        for i in range(len(tree.nodes) - 1, -1, -1):  # what holds content is content: html, body, wrappers
            labels[i] = known[i] if known[i] >= 0 else int(any(labels[c] for c in tree.nodes[i].children))
        data.append(([n.parent for n in tree.nodes], features(tree), labels))
    w, pair = np.zeros(WIDTH), np.zeros((2, 2))
    mw, vw, mp, vp = np.zeros(WIDTH), np.zeros(WIDTH), np.zeros((2, 2)), np.zeros((2, 2))
    rng, step = np.random.default_rng(0), 0
    for _ in range(rounds // 8):
        order = rng.permutation(len(data))
        for at in range(0, len(order), 15):
            gw, gp = 1e-3 * w, 1e-3 * pair
            for k in order[at : at + 15]:
                parents, x, y = data[k]
                p, joint = marginals(parents, (x @ w).tolist(), pair.tolist(), with_pairs=True)
                seen = np.zeros((2, 2))
                np.add.at(seen, (y[np.array(parents[1:], int)], y[1:]), 1)
                gw = gw + x.T @ (p - y) / len(x)
                gp = gp + (joint - seen) / len(x)
            step += 1
            for g, m, v, target in ((gw, mw, vw, w), (gp, mp, vp, pair)):
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                target -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w, pair


def extract(html: str, model: tuple[np.ndarray, np.ndarray]) -> str:
    """The blocks whose nodes are content at the marginals, in page order."""
    if not html or html.isspace():
        return ""
    tree = parse(html)
    nodes, (w, pair) = tree.nodes, model
    x = features(tree)
    keep, _ = marginals([n.parent for n in nodes], (x @ w).tolist(), pair.tolist())
    block = [0] * len(nodes)
    for i in range(1, len(nodes)):
        block[i] = i if nodes[i].tag in BLOCK else block[nodes[i].parent]
    out, last = [], None
    for i, text in tree.runs:
        # An inline node belongs to its block: markup within a sentence does not part it.
        home = block[i]
        if home != last:
            out.append([])
            last = home
        if keep[home] > 0.5 and not nodes[i].hidden:
            out[-1].append(text)
    texts = [" ".join("".join(parts).split()) for parts in out]
    return "\n\n".join(t for t in texts if t)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages. A null or empty html, or a page without content, has an empty text;
    the whole html is read, in time that grows with its length; equal pages get equal texts and repeated rows stay; other
    columns, also ones named text or n_chars, are ignored; no rows give no rows."""
    shared = pages.sparkSession.sparkContext.broadcast(trained())  # a few hundred bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html"):
                texts = [extract(h or "", shared.value) for h in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = pages.schema
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id'].dataType.simpleString()}, url {kinds['url'].dataType.simpleString()}, text string, n_chars long")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
