"""Main text of web pages: boosted trees over DOM nodes, and a hierarchical decoding of their scores.

A page becomes a tree of elements. Each element gets features: its tag and attribute tokens and those of what it stands
in, depth, density of its subtree (text, links, tags), and how it compares with its siblings. Boosted trees give the
log odds that its text is main text. The decoding picks whole subtrees: going down from the root a node is kept as a
whole, dropped as a whole, or left to its children, whichever gives the best sum of text-weighted log odds. So no
dropped node can have a kept descendant, nor a kept node a dropped one.

The trees are trained by the driver on pages that are written by a seeded generator with known main text, in
about two seconds; their size doesn't depend on the data.
"""

from __future__ import annotations

import html as entities
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import trimmed

TOKENS = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRS = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN_ATTR = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
# Names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe canvas select button".split())
UNPARSED = set("script style textarea title iframe".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "legend", "search"}
END = {tag: re.compile(rf"(?ai:</{tag})") for tag in UNPARSED}
SCOPE = {"td", "th", "table", "button", "caption"}  # an open p outside of these isn't closed from inside
SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
# Attribute tokens that speak against and for main text.
AGAINST = set("ad ads advert advertisement sponsor sponsored promo banner nav navbar navigation menu sidebar side aside footer foot header masthead topbar cookie cookies consent gdpr notice alert popup modal overlay comment comments disqus reply replies respond share sharing social related recommended more newsletter subscribe signup login search breadcrumb breadcrumbs pagination pager widget toolbar tags meta byline copyright legal disclaimer form contact".split())
FOR = set("article content post entry main body text story page blog single prose".split())
COMMENTS = set("comment comments disqus reply replies respond discussion".split())
TAG_GROUPS = ["p", "h", "li", "a", "div", "main", "nav", "aside", "form", "table", "quote", "list", "other"]
GROUP_OF = {"p": "p", "li": "li", "dd": "li", "dt": "li", "a": "a", "div": "div", "section": "div", "article": "main", "main": "main", "nav": "nav", "menu": "nav", "aside": "aside", "footer": "aside", "header": "aside", "form": "form", "fieldset": "form", "label": "form", "table": "table", "tr": "table", "td": "table", "th": "table", "blockquote": "quote", "pre": "quote", "figure": "quote", "ul": "list", "ol": "list", "dl": "list"} | {f"h{i}": "h" for i in range(1, 7)}


class Node:
    __slots__ = ("tag", "up", "kids", "tokens", "at")

    def __init__(self, tag, up, tokens, at=-1):
        self.tag, self.up, self.kids, self.tokens, self.at = tag, up, [], tokens, at


def parse(page: str) -> tuple[list[Node], list[tuple[int, int, str]]]:
    """Elements in document order, the first being the root, and pieces of text (node number, block number, text).

    Elements that aren't read (RAW, or hidden) are opened and closed by the same rules as others, but neither they nor
    what they hold gets a number. A head is no element here: what it may hold isn't read anyway, so a page whose head
    isn't closed is read like any other.
    """
    root = Node("html", None, (), 0)
    nodes, stack, pieces = [root], [root], []
    open_p = [-1]  # for each open element the place of the nearest open p in scope
    count: dict[str, int] = {}  # open elements by tag
    block, at, skip = 0, 0, None
    n = len(page)

    def text(a, b):
        if a < b and skip is None:
            s = page[a:b]
            if not s.isspace():
                pieces.append((stack[-1].at, block, s))
            elif pieces and pieces[-1][1] == block:
                pieces.append((stack[-1].at, block, " "))

    def opened(node):
        open_p.append(len(stack) if node.tag == "p" else -1 if node.tag in SCOPE else open_p[-1])
        stack.append(node)
        count[node.tag] = count.get(node.tag, 0) + 1

    def shut(k):
        nonlocal block, skip
        gone = stack[k:]
        for x in gone:
            count[x.tag] -= 1
            if x is skip:
                skip = None
        if skip is None and any(x.tag in BLOCK for x in gone):
            block += 1
        del stack[k:], open_p[k:]

    while at < n:
        m = TOKENS.search(page, at)
        if not m:
            # a tag cut off by the end of the page is no text
            cut = page.find("<", at)
            while cut >= 0 and not re.match(r"</?[a-zA-Z]|<!", page[cut : cut + 3]):
                cut = page.find("<", cut + 1)
            text(at, n if cut < 0 else cut)
            break
        text(at, m.start())
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "head":
            continue
        if m[1]:
            if tag in BLOCK and skip is None:
                block += 1
            if count.get(tag):
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                shut(k)
            continue
        if tag == "br" or tag in VOID:
            if skip is None:
                if tag == "hr":
                    block += 1
                elif tag == "br" and pieces:
                    pieces.append((stack[-1].at, block, " "))
            continue
        if tag in ("html", "body"):
            block += skip is None
            if tag == "html" or len(stack) > 1:
                continue
        if tag in CLOSES_P and open_p[-1] >= 0:
            shut(open_p[-1])
        if tag in SAME:
            like = ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)
            if any(count.get(x) for x in like):
                k = len(stack) - 1
                while k > 0 and stack[k].tag not in like and stack[k].tag not in SAME[tag]:
                    k -= 1
                if k > 0 and stack[k].tag in like:
                    shut(k)
        attrs = m[3]
        closed = attrs.rstrip().endswith("/") and tag not in BLOCK  # as in <path/>; of others the sign says nothing
        if tag in UNPARSED:
            end = END[tag].search(page, at)
            close = page.find(">", end.end()) if end else -1
            at = n if close < 0 else close + 1
            continue
        if skip is not None or tag in RAW or ("hidden" in attrs or "none" in attrs) and HIDDEN_ATTR.search(attrs):
            if not closed:
                node = Node(tag, None, ())
                if skip is None:
                    skip = node
                opened(node)
            continue
        found = []
        if "=" in attrs:
            for a in ATTRS.finditer(attrs):
                found += re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", a[1] or a[2] or a[3] or "").lower())
        node = Node(tag, stack[-1], tuple(found))
        if tag in BLOCK:
            block += 1
        stack[-1].kids.append(node)
        node.at = len(nodes)
        nodes.append(node)
        if not closed:
            opened(node)
    return nodes, pieces


def _traits(tag: str, tokens: tuple[str, ...]) -> tuple:
    """What an element says by itself: tag group, tokens against and for, and six flags."""
    g = GROUP_OF.get(tag, "other")
    bad, good = sum(t in AGAINST for t in tokens), sum(t in FOR for t in tokens)
    flags = (g == "nav", tag in ("aside", "footer"), tag == "header", g == "form", g == "main", any(t in COMMENTS for t in tokens))
    return TAG_GROUPS.index(g), bad, good, sum(1 << k for k, hit in enumerate(flags) if hit), tag == "a", tag.startswith("h") and tag[1:].isdigit()


_TRAITS: dict[tuple, tuple] = {}


def features(nodes: list[Node], pieces: list[tuple[int, int, str]]) -> np.ndarray:
    """One row for each node."""
    n = len(nodes)
    own, stops, linked = [0] * n, [0] * n, [0] * n
    inside_a, depth, against, for_, flags, group, heading, parent = [False] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [False] * n, [0] * n
    like, order, kids = [0.0] * n, [0.0] * n, [0] * n
    for i, x in enumerate(nodes):
        own_traits = (x.tag, x.tokens)
        found = _TRAITS.get(own_traits)
        if found is None:
            if len(_TRAITS) > 100_000:
                _TRAITS.clear()
            found = _TRAITS[own_traits] = _traits(*own_traits)
        group[i], bad, good, flag, link, heading[i] = found
        if i:
            p = parent[i] = x.up.at
            depth[i], inside_a[i] = depth[p] + 1, inside_a[p] or link
            against[i], for_[i], flags[i] = against[p] + bad, for_[p] + good, flags[p] | flag
        else:
            against[0], for_[0], flags[0] = bad, good, flag
        if x.kids:
            m = kids[i] = len(x.kids)
            count: dict[str, int] = {}
            for k in x.kids:
                count[k.tag] = count.get(k.tag, 0) + 1
            for at, k in enumerate(x.kids):
                like[k.at], order[k.at] = count[k.tag] / m, at / m
    for i, _, s in pieces:
        own[i] += len(s)
        stops[i] += s.count(".") + s.count(",") + s.count("!") + s.count("?")
        if inside_a[i]:
            linked[i] += len(s)
    text, links, tags, marks = own[:], linked[:], [1] * n, stops[:]
    for i in range(n - 1, 0, -1):  # children stand after their parents
        p = parent[i]
        text[p] += text[i]
        links[p] += links[i]
        tags[p] += tags[i]
        marks[p] += marks[i]
    out = np.zeros((n, len(TAG_GROUPS) + 23), np.float32)
    out[np.arange(n), group] = 1
    own, text, links, tags, marks, kids = (np.array(c, np.float64) for c in (own, text, links, tags, marks, kids))
    p = np.array(parent)
    sibling_text = (text[p] - own[p]) / np.maximum(1, kids[p])
    log, some = np.log1p, np.maximum(1, text)
    rest = out[:, len(TAG_GROUPS) :]
    rest[:, :3] = np.array([depth, against, for_]).T
    rest[:, 3:9] = (np.array(flags)[:, None] >> np.arange(6)) & 1
    for k, c in enumerate((log(own), log(text), links / some, log(tags), text / tags, marks / some * 100, text / some[0], log(kids), log(sibling_text), text / np.maximum(1, sibling_text), like, order, heading)):
        rest[:, 9 + k] = c
    return out


# ---------------------------------------------------------------- boosted trees


class Trees:
    """Gradient boosting of logistic loss with small regression trees over binned features."""

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 32, least: int = 20):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.column_stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T, strict=True)])
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, cuts, y - p, p * (1 - p))
            self.trees.append(tree)
            score += self._follow(tree, x)
        return self

    def _grow(self, b, cuts, g, h):
        size = 2 ** (self.depth + 1) - 1
        feature, threshold, value = np.full(size, -1), np.zeros(size, np.float32), np.zeros(size)
        rows = {0: np.arange(len(g))}
        for node in range(size):
            at = rows.pop(node, None)
            if at is None:
                continue
            gs, hs = g[at].sum(), h[at].sum()
            value[node] = self.rate * gs / (hs + 1.0)
            if node >= 2**self.depth - 1 or len(at) < 2 * self.least:
                continue
            best = (1e-6, None)
            for f, q in enumerate(cuts):
                if not len(q):
                    continue
                k = b[at, f]
                gc, hc, nc = (np.bincount(k, w, minlength=len(q) + 1).cumsum()[:-1] for w in (g[at], h[at], np.ones(len(at))))
                ok = (nc >= self.least) & (len(at) - nc >= self.least)
                gain = np.where(ok, gc**2 / (hc + 1) + (gs - gc) ** 2 / (hs - hc + 1) - gs**2 / (hs + 1), 0)
                top = int(gain.argmax())
                if gain[top] > best[0]:
                    best = (gain[top], (f, top))
            if best[1] is None:
                continue
            f, top = best[1]
            feature[node], threshold[node] = f, cuts[f][top]
            left = b[at, f] <= top
            rows[2 * node + 1], rows[2 * node + 2] = at[left], at[~left]
        return feature, threshold, value

    def _follow(self, tree, x):
        feature, threshold, value = tree
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            f = feature[node]
            inner = f >= 0
            node = np.where(inner, 2 * node + np.where(x[rows, np.maximum(f, 0)] <= threshold[node], 1, 2), node)
        return value[node]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((self._follow(t, x) for t in self.trees), np.zeros(len(x)))


# ---------------------------------------------------------------- training pages


def training_page(r: random.Random) -> str:
    """A page with main text marked by the attribute data-main, in one of many layouts."""

    def words(a, b):
        return " ".join("".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(1, 9))) for _ in range(r.randint(a, b)))

    def sentences(a, b):
        return " ".join(words(4, 18).capitalize() + r.choice(".!?,.....") for _ in range(r.randint(a, b)))

    def links(n, tag="ul"):
        return f"<{tag}>" + "".join(f'<li><a href="/{words(1, 1)}">{words(1, 3)}</a></li>' for _ in range(n)) + f"</{tag}>"

    def bad(tag, names, inner):
        name = r.choice(names)
        attr = r.choice([f' class="{name}"', f' id="{name}"', f' class="x {name}-box"', ""]) if tag not in ("div", "section", "ul", "p") else r.choice([f' class="{name}"', f' id="{name}"', f' class="{name}-wrap outer"'])
        return f"<{tag}{attr}>{inner}</{tag}>"

    def main():
        parts = [f"<h1>{words(2, 9)}</h1>"] if r.random() < 0.9 else []
        for _ in range(r.randint(1, 14)):
            k = r.random()
            if k < 0.62:
                parts.append(f"<p>{sentences(1, 7)}</p>")
            elif k < 0.70:
                parts.append(f"<p>{words(1, 4)}.</p>")
            elif k < 0.76:
                parts.append(f"<p><b>{words(2, 6)}<br><p>{sentences(1, 5)}</p>")
            elif k < 0.82:
                parts.append(f"<h{r.randint(2, 4)}>{words(1, 6)}</h2>")
            elif k < 0.87:
                parts.append("<ul>" + "".join(f"<li>{sentences(1, 1)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif k < 0.91:
                parts.append(f"<blockquote>{sentences(1, 3)}</blockquote>")
            elif k < 0.94:
                parts.append(f"<pre>{words(5, 30)}</pre>")
            elif k < 0.97:
                parts.append("<table>" + "".join(f"<tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>")
            else:
                parts.append(f'<p>{sentences(1, 2)} <a href="/x">{words(1, 4)}</a> {sentences(1, 2)}</p>')
        inner = "".join(parts)
        if r.random() < 0.25:
            inner = inner.replace("<p>", "<div>", 1).replace("</p>", "</div>", 1)
        if r.random() < 0.2:
            cut = inner.find("</p>") + 4
            inner = inner[:cut] + bad("div", ["ad", "advert", "promo", "related", "share", "newsletter"], sentences(1, 2)) + inner[cut:]
        tag = r.choice(["article", "article", "main", "div", "section"])
        attr = "" if tag in ("article", "main") and r.random() < 0.6 else r.choice([' class="post"', ' id="content"', ' class="entry-content"', ' class="story"', ' class="c12"'])
        return f"<{tag}{attr} data-main>{inner}</{tag}>"

    before = [
        lambda: bad("nav", ["menu", "nav", "top"], links(r.randint(2, 9))),
        lambda: bad("header", ["site-header", "masthead", "top"], f"<a>{words(1, 3)}</a><p>{words(2, 8)}</p>" + links(r.randint(0, 5))),
        lambda: bad("div", ["ad", "ads", "advert", "banner", "sponsored"], r.choice([sentences(1, 2), words(2, 9) + "."])),
        lambda: bad("div", ["cookie-notice", "consent", "notice", "alert", "gdpr"], f"<p>{sentences(1, 3)}</p><button>{words(1, 2)}</button>"),
        lambda: bad("ul", ["breadcrumb", "menu", "navbar"], "".join(f"<li><a>{words(1, 2)}</a></li>" for _ in range(r.randint(2, 5)))),
        lambda: bad("form", ["search", "login", "signup"], f"<label>{words(1, 2)}</label><input><p>{words(2, 8)}</p>"),
        lambda: bad("aside", ["sidebar", "side", "widget"], f"<h3>{words(1, 3)}</h3><p>{sentences(1, 3)}</p>" + links(r.randint(2, 7))),
        lambda: bad("div", ["sidebar", "widget", "related", "recommended"], f"<h3>{words(1, 3)}</h3>" + links(r.randint(2, 7)) + f"<p>{sentences(1, 2)}</p>"),
    ]
    after = [
        *before,
        lambda: bad("div", ["comments", "disqus", "comment-list", "replies"], "".join(f'<div class="{r.choice(["comment", "reply", "c"])}"><b>{words(1, 2)}</b><p>{sentences(1, 4)}</p></div>' for _ in range(r.randint(1, 6)))),
        lambda: bad("section", ["comments", "respond", "discussion"], f"<h2>{words(1, 2)}</h2>" + "".join(f"<p>{sentences(1, 3)}</p>" for _ in range(r.randint(1, 5)))),
    ]
    foot = lambda: bad("footer", ["footer", "site-footer", "bottom"], r.choice([f"&copy; {words(1, 5)} &middot; {sentences(1, 1)}", f"<p>{words(3, 12)}</p>" + links(r.randint(1, 6))]))
    body = "".join(r.choice(before)() for _ in range(r.randint(1, 4)))
    rest = "".join(r.choice(after)() for _ in range(r.randint(0, 3))) + (foot() if r.random() < 0.9 else bad("div", ["footer", "copyright", "legal"], words(3, 12)))
    middle = main()
    if r.random() < 0.4:
        middle = f"<div{r.choice(['', ' class=wrap', ' id=page'])}>{middle}{rest}</div>"
        rest = ""
    page = f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><script>var a='<p>';</script></head><body>{body}{middle}{rest}</body></html>"
    return page if r.random() < 0.9 else page[: int(len(page) * r.uniform(0.6, 0.98))]


_MAIN = re.compile(r"data-main")


def train(pages: int = 240, seed: int = 7) -> Trees:
    """Boosted trees from generated pages; a node is main text if it lies in the marked element, and in nothing bad there."""
    r = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        page = training_page(r)
        # the mark becomes a tag name of its own, which says where main text is, and is taken back before features are made
        marked = re.sub(r"<(article|main|div|section)([^<>]*) data-main>", r'<\1\2 role="qqmain">', page)
        nodes, pieces = parse(marked)
        y = np.zeros(len(nodes), bool)
        for i, x in enumerate(nodes):
            up = x.up.at if x.up is not None else -1
            if "qqmain" in x.tokens:
                y[i] = True
                x.tokens = tuple(t for t in x.tokens if t != "qqmain")
            elif up >= 0:
                y[i] = y[up] and not (x.up is not None and x.tag == "div" and any(t in AGAINST for t in x.tokens))
        xs.append(features(nodes, pieces))
        ys.append(y)
    return Trees().fit(np.concatenate(xs), np.concatenate(ys).astype(float))


# ---------------------------------------------------------------- decoding


def decode(nodes: list[Node], pieces: list[tuple[int, int, str]], odds: np.ndarray) -> np.ndarray:
    """True for nodes whose own text is kept: the best choice of whole subtrees."""
    n = len(nodes)
    weight = [1] * n
    for i, _, s in pieces:
        weight[i] += len(s)
    gain = (np.clip(odds, -6, 6) * np.log1p(weight)).tolist()
    keep, best, choice = gain[:], [0.0] * n, [0] * n
    below, each = [0.0] * n, [0.0] * n  # sums over the children
    for i in range(n - 1, -1, -1):
        keep[i] += below[i]
        # dropped as a whole: 0; kept as a whole: keep; left to the children, own text dropped: their best, at a price
        top, which = 0.0, 0
        if keep[i] > top:
            top, which = keep[i], 1
        if each[i] - 0.5 > top:
            top, which = each[i] - 0.5, 2
        best[i], choice[i] = top, which
        if i:
            p = nodes[i].up.at
            below[p] += keep[i]
            each[p] += top
    state = choice[:]
    for i in range(1, n):
        above = state[nodes[i].up.at]
        if above != 2:
            state[i] = above
    return np.array(state) == 1


def main_text(nodes, pieces, odds) -> str:
    kept = decode(nodes, pieces, odds)
    blocks: dict[int, list[str]] = {}
    for i, block, s in pieces:
        if kept[i]:
            blocks.setdefault(block, []).append(s)
    lines = (" ".join(entities.unescape("".join(x)).split()) for _, x in sorted(blocks.items()))
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, model: Trees | None = None, column: str = "html") -> DataFrame:
    """pages with text (main text, blocks joined by a line feed) and n_chars.

    Null or empty html gives empty text, and so does a page without main text. Cut-off pages are read to their end.
    Columns named text or n_chars are replaced; repeated rows give repeated results.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model or train())
    kept = pages.drop("text", "n_chars")
    at = kept.columns.index(column)

    def run(batches):
        trees = sent.value
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                parsed = [parse(x or "") for x in batch.column(at).to_pylist()]
                rows = [features(*p) for p in parsed]
                odds = trees.log_odds(np.concatenate(rows)) if rows else np.zeros(0)
                edge = np.cumsum([0, *map(len, rows)])
                texts = [main_text(*p, odds[edge[i] : edge[i + 1]]) for i, p in enumerate(parsed)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*batch.schema.names, "text", "n_chars"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(trimmed(run), f"{fields}, text string, n_chars long")


def op3(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages.select("page_id", "url", F.col("html").cast("string"))).drop("html")
