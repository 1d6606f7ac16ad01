"""Main text of web pages by minimum-cut labelling.

A page becomes a list of text blocks, each with its place in the document tree. A logistic model gives every block the
log-odds of being content; they are the capacities of its edges to the two terminals. Smoothness edges join blocks that
follow one another and blocks of one parent, the stronger the nearer they are in the tree. The minimum cut between the
terminals is the labelling of least cost: blocks on the content side are the text.

Blocks whose own odds outweigh all their smoothness edges have their label in every minimum cut; the flow is computed
over the others only, with the fixed ones folded into the terminals.

The model is trained in numpy, on the driver, on PAGES made-up pages of many layouts; no page of the data is used.

Defined results: a null or empty page, or one without content, has the text "" and n_chars 0; unclosed tags end where
HTML lets them; a page without markup is one block; rows that repeat have equal texts. Time and memory follow a page's
length, however deep it nests, and a very long page is one row of one task. An empty table gives an empty one; other
columns are not looked at, whatever their names.
"""

from __future__ import annotations

import html
import random
import re
from collections import deque
from collections.abc import Iterator
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewell.llm.common import table

PAGES = 400
FOLLOWS, SIBLINGS = 0.6, 0.9

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*+>?|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>?",
    re.S,
)
ATTR = re.compile(r"(class|id|role|style|hidden|aria-hidden|itemprop)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: Elements whose insides are no text of the page.
DROPPED = frozenset("script style template noscript iframe object svg math canvas audio video head title textarea select datalist button".split())
#: Of these everything up to the end tag is text, whatever it looks like.
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An element that ends open ones of these kinds, up to the nearest of the stops.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

GOOD = re.compile(r"article|content|post|entry|story|main|body|text|prose|lead|headline", re.I)
BAD = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|side-?bar|foot\w*|head(?:er)?|masthead|topbar|cookies?|consent|gdpr|notice|alert|pop-?up|modal|overlay|share|sharing|social|related|recommend\w*|more|breadcrumbs?|pag(?:er|ination)|tags?|subscribe|subscription|newsletter|log-?in|sign-?up|search|widget|copyright|legal|tool-?bar|comments?|disqus|repl(?:y|ies)|respond|rating|author-box|bio|outbrain|taboola)(?:$|[\s_-])",
    re.I,
)
COMMENT = re.compile(r"comment|disqus|repl(?:y|ies)|respond", re.I)


class Block:
    """Text that no block boundary parts, the element it stands in, and what is known of it."""

    __slots__ = ("chars", "link", "parts", "top")

    def __init__(self, top: Node):
        self.top, self.parts, self.chars, self.link = top, [], 0, 0

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


class Node:
    """An element: its parent, and what it or any element around it is."""

    __slots__ = ("depth", "n", "parent", "tag", "within")

    def __init__(self, n: int, tag: str, attrs: str, parent: Node | None):
        self.n, self.tag, self.parent = n, tag, parent
        self.depth = parent.depth + 1 if parent else 0
        if parent is None:
            self.within = (False,) * 10
            return
        name, role, hidden = "", "", False
        if attrs:
            for m in ATTR.finditer(attrs):
                key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if key in ("class", "id", "itemprop"):
                    name += f" {value}"
                elif key == "role":
                    role = value.lower()
                elif key == "style":
                    hidden |= "display:none" in value.replace(" ", "").lower()
                else:
                    hidden |= value.lower() != "false"
        spaced = re.sub(r"([a-z])([A-Z])", r"\1-\2", name)
        bad = bool(BAD.search(spaced)) or role in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert")
        good = bool(GOOD.search(name)) and not bad or role in ("main", "article")
        page = tag in ("html", "body")  # what these are called says nothing against what is in them
        mine = (tag in ("article", "main"), tag in ("nav", "menu"), tag == "footer", tag == "header", tag == "aside", tag in ("form", "fieldset", "dialog"), bad and not page, good, bool(COMMENT.search(name)) and not page, hidden)
        self.within = tuple(map(or_, mine, parent.within)) if any(mine) else parent.within


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page that have text, in page order."""
    root = Node(0, "#root", "", None)
    stack, dropped, links, count = [root], 0, 0, 1
    #: the places in the stack of the elements of each kind, and of those that are blocks
    places: dict[str, list[int]] = {}
    block_places: list[int] = []
    out: list[Block] = []
    now: Block | None = None
    at, n = 0, len(page)

    def pop_to(i: int) -> None:
        nonlocal dropped, links, now
        for node in stack[i:]:
            dropped -= node.tag in DROPPED
            links -= node.tag == "a"
            if node.tag in BLOCK:
                now = None
        while len(stack) > i:
            tag = stack.pop().tag
            places[tag].pop()
            if tag in BLOCK:
                block_places.pop()

    def last(*tags: str) -> int:
        """The place of the innermost open element of these kinds; 0 if there is none."""
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def add(text: str) -> None:
        nonlocal now
        if dropped or not text:
            return
        if "&" in text:
            text = html.unescape(text)
        if now is None:
            if not text.strip():
                return
            now = Block(stack[block_places[-1] if block_places else 0])
            out.append(now)
        now.parts.append(text)
        size = len(text)
        now.chars += size
        if links:
            now.link += size

    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            i = last(tag)
            if i and (tag in BLOCK or not block_places or i > block_places[-1]):
                pop_to(i)  # an inline end tag ends nothing around its block
            if tag in BLOCK:
                now = None
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCK:
            now = None
            kinds, stops = ENDS.get(tag, (set(), set()))
            i = last(*kinds)
            if i and i > last(*stops):
                pop_to(i)
            if block_places and stack[block_places[-1]].tag == "p":
                pop_to(block_places[-1])
        if tag in VOID:
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if attrs.endswith("/") and tag in ("svg", "math"):
            continue
        places.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            block_places.append(len(stack))
        stack.append(Node(count, tag, attrs, stack[-1]))
        count += 1
        dropped += tag in DROPPED
        links += tag == "a"
    return [b for b in out if b.text()]


FEATURES = 22


def features(blocks: list[Block]) -> np.ndarray:
    out = np.zeros((len(blocks), FEATURES))
    for row, b in zip(out, blocks):
        tag = b.top.tag
        row[:10] = b.top.within
        row[3] = row[3] and not row[0]  # the header of an article is its own
        row[10:15] = tag in HEADINGS, tag == "p", tag in ("li", "dd", "dt"), tag in ("td", "th"), tag in ("blockquote", "pre", "figcaption")
        text = b.text()
        words = text.count(" ") + 1
        row[15] = np.log1p(words) / 4
        row[16] = b.link / max(1, b.chars)
        row[17] = text[-1] in ".!?…\"'»”:"
        row[18] = min(3, text.count(",") + text.count(".")) / 3
        row[19] = "©" in text or "all rights reserved" in text.lower()
        row[20] = words <= 3
        row[21] = 1
    return out


def made_up_page(r: random.Random) -> str:
    """A page of some layout; U+E000 begins each block that is content."""
    word = lambda: "".join(r.choices("etaoinshrdlu", k=r.randint(1, 9)))
    some = lambda a, z: " ".join(word() for _ in range(r.randint(a, z)))
    sentences = lambda a, z: " ".join(some(3, 18).capitalize() + "." for _ in range(r.randint(a, z)))
    link = lambda t: f'<a href="/{word()}">{t}</a>'
    semantic = r.random() < 0.6

    def box(tag: str, names: list[str], inside: str) -> str:
        if semantic and r.random() < 0.8:
            return f"<{tag}>{inside}</{tag}>" if r.random() < 0.5 else f'<{tag} class="{r.choice(names)}">{inside}</{tag}>'
        return f'<div {r.choice(["class", "id"])}="{r.choice(names)}">{inside}</div>'

    menu = lambda: "<ul>" + "".join(f"<li>{link(some(1, 3))}</li>" for _ in range(r.randint(2, 9))) + "</ul>"
    content = "\ue000"
    parts = [f"<h1>{content}{some(2, 12)}</h1>"]
    for _ in range(r.randint(1, 9)):
        k = r.random()
        if k < 0.68:
            text = sentences(1, 6)
            parts.append(f"<p>{content}{text if r.random() < 0.7 else some(1, 4) + ' ' + link(some(1, 3)) + ' ' + text}</p>")
        elif k < 0.78:
            parts.append(f"<h2>{content}{some(1, 7)}</h2>")
        elif k < 0.84:
            parts.append("<ul>" + "".join(f"<li>{content}{some(2, 15)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
        elif k < 0.88:
            parts.append(f"<blockquote>{content}{sentences(1, 2)}</blockquote>")
        elif k < 0.92:
            parts.append(f"<p>{content}{some(1, 3)}{r.choice(['.', ''])}</p>")
        elif k < 0.95:
            parts.append("<table>" + "".join(f"<tr><td>{content}{some(1, 3)}</td><td>{content}{r.randint(1, 999)}</td></tr>" for _ in range(3)) + "</table>")
        else:
            parts.append(box("aside", ["ad", "ads", "advert", "promo", "related", "newsletter", "share"], r.choice([sentences(1, 2), link(some(2, 6)), menu()])))
    body = "".join(parts)
    kind = r.random()
    body = f"<article>{body}</article>" if kind < 0.5 else f"<main>{body}</main>" if kind < 0.6 else f'<div class="{r.choice(["content", "post-body", "entry", "article-text", "story"])}">{body}</div>' if kind < 0.9 else f"<div>{body}</div>"
    before, after = [], []
    if r.random() < 0.5:
        before.append(box("header", ["header", "masthead", "topbar"], f"<div>{some(1, 4)}</div>" + (menu() if r.random() < 0.5 else f"<p>{some(2, 8)}</p>")))
    if r.random() < 0.8:
        before.append(box("nav", ["nav", "menu", "navbar", "breadcrumb"], menu()))
    for _ in range(r.randint(0, 2)):
        (before if r.random() < 0.5 else after).append(f'<div {r.choice(["class", "id"])}="{r.choice(["ad", "ads", "advert", "sponsored", "banner", "promo-box", "cookie-notice", "consent", "notice", "alert"])}">{r.choice([sentences(1, 2), "<p>" + sentences(1, 3) + "</p>", some(1, 9)])}</div>')
    if r.random() < 0.5:
        (before if r.random() < 0.3 else after).append(box("aside", ["sidebar", "side-bar", "related", "widget"], r.choice([menu(), f"<h3>{some(1, 3)}</h3>{menu()}", f"<p>{sentences(1, 3)}</p>"])))
    if r.random() < 0.4:
        after.append(f'<form {r.choice(["", "class=login", "id=subscribe"])}><p>{some(1, 9)}</p><label>{some(1, 2)}</label><input></form>')
    if r.random() < 0.5:
        after.append(box("section", ["comments", "comment-list", "replies"], f"<h3>{some(1, 3)}</h3>" + "".join(f'<div class="comment"><p>{sentences(1, 3)}</p></div>' for _ in range(r.randint(1, 4)))))
    if r.random() < 0.85:
        after.append(box("footer", ["footer", "foot", "copyright", "site-footer"], r.choice([f"&copy; {some(2, 9)}.", f"<p>{sentences(1, 2)}</p>", menu()])))
    return f"<html><head><title>{some(2, 5)}</title></head><body>{''.join(before)}{body}{''.join(after)}</body></html>"


_WEIGHTS: np.ndarray | None = None


def weights() -> np.ndarray:
    """The model's weights, trained once in a process."""
    global _WEIGHTS
    if _WEIGHTS is None:
        r = random.Random(12)
        x, y = [], []
        for _ in range(PAGES):
            blocks = blocks_of(made_up_page(r))
            y.extend("\ue000" in b.text() for b in blocks)
            x.append(features(blocks))
        x, y, w = np.concatenate(x), np.array(y, float), np.zeros(FEATURES)
        for _ in range(1500):
            p = 1 / (1 + np.exp(-x @ w))
            w -= 2.0 * (x.T @ (p - y) / len(y) + 2e-4 * w)
        _WEIGHTS = w
    return _WEIGHTS


def _distance(a: Node, b: Node) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: to the block before, and to the last block of the same parent."""
    out, last = [], {}
    for i, b in enumerate(blocks):
        top = b.top
        home = top.parent.n if top.parent else 0
        if i:
            out.append((i - 1, i, FOLLOWS / (1 + _distance(blocks[i - 1].top, top))))
        if home in last:
            out.append((last[home], i, SIBLINGS / 2))
        last[home] = i
    return out


def min_cut(odds: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """True where a node is on the source side: node i has capacity odds[i] from the source if positive, else -odds[i] to the sink."""
    n = len(odds)
    odds = odds.astype(float).copy()
    around = np.zeros(n)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, w in edges:
        around[a] += w
        around[b] += w
        near[a].append((b, w))
        near[b].append((a, w))
    label = np.where(np.abs(odds) >= around, np.where(odds > 0, 1, 0), -1)
    todo = deque(np.flatnonzero(label >= 0).tolist())
    while todo:  # a fixed label is a terminal to its neighbours, which may fix theirs
        i = todo.popleft()
        for j, w in near[i]:
            if label[j] < 0:
                odds[j] += w if label[i] else -w
                around[j] -= w
                if abs(odds[j]) >= around[j] - 1e-12:
                    label[j] = 1 if odds[j] > 0 else 0
                    todo.append(j)
    rest = np.flatnonzero(label < 0).tolist()
    if rest:
        number = {i: k for k, i in enumerate(rest)}
        s, t = len(rest), len(rest) + 1
        flow: list[dict[int, float]] = [{} for _ in range(len(rest) + 2)]
        for i in rest:
            k = number[i]
            flow[s][k], flow[k][s] = max(odds[i], 0.0), 0.0
            flow[k][t], flow[t][k] = max(-odds[i], 0.0), 0.0
            for j, w in near[i]:
                if j in number:
                    flow[k][number[j]] = flow[k].get(number[j], 0.0) + w
        side = _max_flow(flow, s, t)
        for i in rest:
            label[i] = 1 if number[i] in side else 0
    return label == 1


def _max_flow(left: list[dict[int, float]], s: int, t: int) -> set[int]:
    """What the source reaches once shortest paths have taken all the flow there is."""
    while True:
        back = {s: s}
        todo = deque([s])
        while todo and t not in back:
            u = todo.popleft()
            for v, c in left[u].items():
                if c > 1e-12 and v not in back:
                    back[v] = u
                    todo.append(v)
        if t not in back:
            return set(back)
        path, v = [], t
        while v != s:
            path.append((back[v], v))
            v = back[v]
        f = min(left[u][v] for u, v in path)
        for u, v in path:
            left[u][v] -= f
            left[v][u] = left[v].get(u, 0.0) + f


def main_text(page: str | None, w: np.ndarray | None = None) -> str:
    """The content blocks of a page, joined by an empty line."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    keep = min_cut(features(blocks) @ (weights() if w is None else w), edges_of(blocks))
    return "\n\n".join(b.text() for b, k in zip(blocks, keep) if k)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in keep with text and n_chars, one row for each row of pages."""
    held = pages.sparkSession.sparkContext.broadcast(weights())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), held.value) for x in batch.column(len(keep))]
            yield pa.record_batch([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select(*keep, html_col).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", text string, n_chars long")


def op3_html(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
