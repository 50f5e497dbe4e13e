"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read once into blocks: the texts between tags that begin or end a line. A logistic model gives each block's probability of
being content; its two costs are the capacities to the terminals. Blocks that follow one another, and the next ones under one
parent, are joined by edges that weigh more the nearer they are in the document's tree. The minimum cut is the labelling of
least total cost; the blocks on the source's side are the text.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from bisect import bisect_left
from collections import Counter, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carry, row_type, tidy

TAG_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
TAG_ENDS = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Elements whose content is no text, or a form's controls.
RAW = {"script", "style", "template", "textarea", "iframe", "title", "select", "option", "button"}
RAW_END = {t: re.compile(rf"</{t}\b", re.I) for t in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set("html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption legend".split())
#: Elements that an opening block element closes, if they are open in the same container.
CLOSED_BY = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
CONTAINER = {"html", "body", "article", "aside", "div", "footer", "form", "header", "main", "nav", "section", "table", "ul", "ol", "dl", "blockquote", "details", "dialog", "fieldset", "figure"}

#: Signs of a block's surroundings: tags, roles, and words of classes and ids.
SIGNS = {
    "menu": ({"nav", "menu"}, {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "tabs", "toolbar", "topbar", "sitemap", "toc", "skip"}),
    "header": ({"header", "hgroup"}, {"header", "masthead", "branding", "logo", "top"}),
    "footer": ({"footer"}, {"footer", "copyright", "legal", "bottom", "colophon", "contentinfo"}),
    "side": ({"aside"}, {"sidebar", "side", "aside", "widget", "related", "recommended", "recommendations", "trending", "popular", "more", "rail", "complementary", "teaser", "links"}),
    "notice": ({"dialog"}, {"cookie", "cookies", "consent", "notice", "notices", "alert", "banner", "popup", "modal", "overlay", "gdpr", "newsletter", "subscribe", "subscription", "signup", "paywall", "disclaimer", "warning"}),
    "advert": (set(), {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "sponsors", "promo", "promoted", "promotion", "adsense", "outbrain", "taboola"}),
    "form": ({"form", "fieldset", "label", "legend", "input"}, {"form", "login", "search", "register", "captcha", "searchbox"}),
    "comment": (set(), {"comment", "comments", "reply", "replies", "respond", "discussion", "disqus", "responses", "feedback", "reviews", "commentlist"}),
    "social": (set(), {"share", "sharing", "social", "follow", "tags", "tag", "byline", "meta", "author", "rating"}),
    "content": ({"article", "main"}, {"article", "post", "content", "entry", "story", "main", "text", "body"}),
    "hidden": (set(), {"hidden", "invisible", "sr", "none"}),
}
#: Words that say little: they count only on their own and on small elements.
WEAK = {"more", "side", "top", "bottom", "links", "tag", "tags", "meta", "author", "legal", "sr", "none", "logo", "follow", "skip", "tabs"}
#: What a class says after these words is about something else than its element.
ABOUT_OTHERS = {"with", "has", "no", "without", "non", "not"}
SURE, NAMED, HINTED = 3, 2, 1
NAMES = [*SIGNS, "heading", "paragraph", "item", "links", "length", "sentences", "caps", "first", "in_article", "share", "after_title", "bare", "bare_prose", "bare_links", "article_links", "unmarked_prose", "kin_share", "clear_article", "bare_elsewhere"]


class Block:
    """A block's text, how much of it is linked, its number of open block elements, how many of them the block before it had open as well, the number of its
    innermost element's parent, the signs of its surroundings, and its innermost block element's tag."""

    __slots__ = ("text", "links", "depth", "common", "parent", "signs", "tag")

    def __init__(self, *values):
        self.text, self.links, self.depth, self.common, self.parent, self.signs, self.tag = values


def signs_of(tag: str, attributes: str) -> dict[str, int]:
    """The signs of an element, and how far each can be trusted: SURE for tags and hidden ones, NAMED for words of classes, ids and roles, HINTED for weak words."""
    out = {k: SURE for k, (tags, _) in SIGNS.items() if tag in tags}

    def add(kind, trust):
        out[kind] = max(out.get(kind, 0), trust)

    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "style":
                if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    add("hidden", SURE)
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                add("hidden", SURE)
            elif tag not in ("body", "html"):
                for token in value.split():
                    found = set()
                    for w in WORD.findall(token):
                        if w.lower() in ABOUT_OTHERS:
                            break
                        found.add(w.lower())
                    mixed = found & SIGNS["content"][1]
                    for kind, (_, words) in SIGNS.items():
                        if found & words - WEAK:
                            add(kind, NAMED)
                        elif found & words and not mixed:
                            add(kind, HINTED)
        if re.search(r"(?:^|\s)hidden(?:\s|$)", attributes):
            add("hidden", SURE)
    return out


class Open:
    """The elements that are open, with counts of what the reader asks about them, so that each tag costs what it opens or closes."""

    def __init__(self):
        self.stack: list[tuple[str, dict, int]] = []  # tag, signs, number of blocks before it
        self.n, self.tags, self.found = 0, Counter(), 0
        self.closed: list[tuple[int, int, dict]] = []  # elements with signs: their first block, the block after their last, their signs
        self.ids, self.block_tags, self.low = [0], ["body"], 1  # open block elements; how many have stayed open since the last block
        self.inline = [Counter()]  # inline elements within each open block element
        self.direct = [Counter()]  # elements within each open container, up to the next container

    def push(self, tag: str, signs: dict[str, int]) -> None:
        self.n += 1
        self.stack.append((tag, signs, self.found))
        self.tags[tag] += 1
        self.direct[-1][tag] += 1
        if tag in BLOCK:
            self.ids.append(self.n)
            self.block_tags.append(tag)
            self.inline.append(Counter())
        else:
            self.inline[-1][tag] += 1
        if tag in CONTAINER:
            self.direct.append(Counter())

    def pop(self) -> str:
        tag, signs, first = self.stack.pop()
        self.tags[tag] -= 1
        if signs and first < self.found:
            self.closed.append((first, self.found, signs))
        if tag in CONTAINER:
            self.direct.pop()
        self.direct[-1][tag] -= 1
        if tag in BLOCK:
            self.ids.pop()
            self.block_tags.pop()
            self.inline.pop()
            self.low = min(self.low, len(self.ids))
        else:
            self.inline[-1][tag] -= 1
        return tag

    def close(self, tag: str) -> None:
        """An end tag. One of an inline element closes nothing outside its block."""
        if self.tags[tag] if tag in BLOCK else self.inline[-1][tag]:
            while self.pop() != tag:
                pass

    def make_way(self, tags: set[str]) -> None:
        """Closes the innermost open element of these tags in the same container."""
        if any(self.direct[-1][t] for t in tags):
            while self.pop() not in tags:
                pass


def tag_ends(page: str) -> tuple[list[int], list[int]]:
    """The places of ">" and quotes, and for each of them where a tag ends that is read from there on, quoted values skipped; -1 if a quote stays open."""
    places = [m.start() for m in TAG_ENDS.finditer(page)]
    ends = [-1] * (len(places) + 1)
    later: dict[str, int] = {}  # the next place of each kind of quote
    for i in range(len(places) - 1, -1, -1):
        c = page[places[i]]
        if c == ">":
            ends[i] = places[i]
        else:
            ends[i] = ends[later[c] + 1] if c in later else -1
            later[c] = i
    return places, ends


def spread(found: list[Block], closed: list[tuple[int, int, dict]]) -> None:
    """Gives the blocks the signs of the elements around them. What a name says of an element that has most of the page's unlinked text is overruled if it also has
    the title or the article, or nearly all of the text; weak words count on small elements only."""
    mass, titles = [0], [0]
    for i, b in enumerate(found):
        mass.append(mass[-1] + len(b.text) - b.links)
        starts = "in_article" in b.signs and (i == 0 or "in_article" not in found[i - 1].signs)
        titles.append(titles[-1] + (b.tag == "h1" or starts))
    every = max(mass[-1], 1)
    change = [Counter() for _ in range(len(found) + 1)]
    for first, end, signs in closed:
        share = (mass[end] - mass[first]) / every
        large = share > 0.5 and titles[end] > titles[first] or share > 0.9 and titles[end] - titles[first] == titles[-1]
        for kind, trust in signs.items():
            if trust == SURE or kind == "content" or trust == NAMED and not (large and (kind != "comment" or titles[end] > titles[first])) or trust == HINTED and share < 0.3 and not large:
                change[first][kind] += 1
                change[end][kind] -= 1
    now = Counter()
    for b, c in zip(found, change, strict=False):
        now.update(c)
        b.signs |= {k for k, n in now.items() if n > 0}


def blocks(page: str, known: dict | None = None) -> list[Block]:
    """The page's blocks in order, in time linear in the page. `known` holds the signs of tags of up to 200 characters, as pages repeat their names."""
    known = {} if known is None else known
    out: list[Block] = []
    now = Open()
    text: list[str] = []
    links = 0

    def flush():
        nonlocal links
        joined = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        if joined:
            signs = {"in_article"} if now.tags["article"] or now.tags["main"] else set()
            out.append(Block(joined, min(links, len(joined)), len(now.ids) - 1, now.low - 1, now.ids[-2] if len(now.ids) > 2 else 0, signs, now.block_tags[-1]))
            now.low = len(now.ids)
            now.found = len(out)
        links = 0

    def take(piece: str):
        nonlocal links
        if piece:
            text.append(piece)
            if now.tags["a"]:
                links += len(piece.strip())

    places, ends = tag_ends(page)
    at, last = 0, page.rfind(">")
    while (place := page.find("<", at)) >= 0:
        take(page[at:place])
        if page.startswith("<!--", place):
            end = page.find("-->", place + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        if page.startswith("<![CDATA[", place):
            end = page.find("]]>", place + 9)
            take(page[place + 9 : end if end >= 0 else len(page)].replace("&", "&amp;"))
            at = end + 3 if end >= 0 else len(page)
            continue
        if page[place + 1 : place + 2] in ("!", "?"):
            end = page.find(">", place) if place < last else -1
            at = end + 1 if end >= 0 else len(page)
            continue
        m = TAG_NAME.match(page, place, last) if place < last else None
        if not m:
            take("<")
            at = place + 1
            continue
        end = ends[bisect_left(places, m.end())]
        if end < 0:  # a quote that is never closed is a character as others are
            end = page.find(">", m.end())
        at = end + 1
        empty = page[end - 1] == "/"
        tag = m[1].lower()
        if page[place + 1] == "/":
            if tag in BLOCK:
                flush()
            now.close(tag)
            continue
        if tag in RAW:
            if not empty:
                end = RAW_END[tag].search(page, at)
                end = page.find(">", end.end()) if end else -1
                at = end + 1 if end >= 0 else len(page)
            continue
        if tag == "br":
            take("\n")
            continue
        if tag in BLOCK:
            flush()
            now.make_way(CLOSED_BY.get(tag, {"p"}))
        if tag not in VOID and not empty:
            given = page[m.end() : end]
            signs = known.get((tag, given))
            if signs is None:
                signs = signs_of(tag, given)
                if len(given) <= 200:
                    if len(known) >= 4096:
                        known.clear()
                    known[tag, given] = signs
            signs = dict(signs)
            if tag == "header" and (now.tags["article"] or now.tags["main"]):
                signs.pop("header", None)  # an article's own header has its title
            now.push(tag, signs)
    take(page[at:])
    flush()
    while now.stack:
        now.pop()
    spread(out, now.closed)
    return out


def features(found: list[Block]) -> np.ndarray:
    x = np.zeros((len(found), len(NAMES)))
    column = {n: i for i, n in enumerate(NAMES)}
    mass, kin, title = Counter(), Counter(), False  # text that is not linked, by parent and by what its blocks look like
    look = lambda b: (b.tag, b.depth, not b.signs)
    for b in found:
        mass[b.parent] += len(b.text) - b.links
        kin[look(b)] += len(b.text) - b.links
    every = max(sum(mass.values()), 1)
    marked = any(b.signs & {"in_article", "content"} for b in found)  # the page says where its article is
    for r, b in zip(x, found, strict=True):
        for s in b.signs:
            r[column[s]] = 1
        n, bare = len(b.text), not b.signs
        r[column["heading"]] = b.tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        r[column["paragraph"]] = b.tag in ("p", "blockquote", "pre", "figcaption", "article", "section")
        r[column["item"]] = b.tag in ("li", "td", "th", "dt", "dd")
        r[column["links"]] = b.links / n
        r[column["length"]] = math.log1p(n) / 5
        r[column["sentences"]] = min(1.0, sum(b.text.count(c) for c in ".!?") / 3)
        words = b.text.split(None, 50)[:50]
        r[column["caps"]] = sum(w[:1].isupper() for w in words) / len(words)
        title = title or b.tag == "h1"
        r[column["share"]] = mass[b.parent] / every
        r[column["kin_share"]] = bare * kin[look(b)] / every
        r[column["after_title"]] = title
        prose = r[column["sentences"]] * min(n / 200, 1) * (1 - b.links / n)
        r[column["bare"]], r[column["bare_prose"]], r[column["bare_links"]] = bare, bare * prose, bare * b.links / n
        r[column["bare_elsewhere"]] = bare and marked
        r[column["unmarked_prose"]] = bare * prose * (not marked)
        clear = "in_article" in b.signs and not b.signs - {"in_article", "content"}
        r[column["clear_article"]], r[column["article_links"]] = clear, clear * b.links / n
    if len(x):
        x[0, column["first"]] = 1
    return x


def practice_pages(n: int, seed: int) -> list[tuple[str, list[int]]]:
    """Made-up pages in many layouts, and for each block whether it is content. The classifier is trained on these alone."""
    rng = random.Random(seed)
    syllables = "ba co di fu ge ha lo mi ne pa ra su ti vo wen zar kel nor sta pri".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))

    def prose(lo, hi):
        out = [word() for _ in range(rng.randint(lo, hi))]
        return " ".join(w + ("." if rng.random() < 0.1 else "") for w in out).capitalize() + "."

    label = lambda: word().capitalize() + (" " + word() if rng.random() < 0.5 else "")
    made = []
    for _ in range(n):
        marks: list[int] = []

        def el(tag, inner, content, cls="", marks=marks):
            marks.append(content)
            return f"<{tag}{f' class="{cls}"' if cls else ''}>{inner}</{tag}>"

        def links(k, wrap=True, el=el):
            items = "".join(el("li" if wrap else "div", f"<a href='/x'>{label()}</a>", 0) for _ in range(k))
            return f"<ul>{items}</ul>" if wrap else items

        def boiler(kind, odd=0.25, el=el, links=links):
            cls = rng.choice(sorted(SIGNS[kind][1])) if kind in SIGNS else ""
            tags = sorted(SIGNS[kind][0] - {"label", "legend", "input", "menu", "hgroup"}) if kind in SIGNS else []
            tag = rng.choice([*tags, "div"]) if rng.random() < 0.6 and tags else "div"
            if rng.random() < odd and kind != "comment":
                cls = word()  # a name that says nothing
            attr = f' {rng.choice(["class", "id"])}="{cls}"' if tag == "div" or rng.random() < 0.4 else ""
            if kind in ("menu", "social"):
                body = links(rng.randint(2, 8), rng.random() < 0.7)
            elif kind in ("comment", "side", "advert", "notice"):
                body = "".join(el("p", prose(3, 40), 0) for _ in range(rng.randint(1, 4))) + (links(rng.randint(1, 5)) if rng.random() < 0.3 else "")
            elif kind == "form":
                body = el("p", label(), 0) + "<input type=text>"
            else:
                body = el(rng.choice(["p", "div", "h2"]), prose(1, 14), 0)
            return f"<{tag}{attr}>{body}</{tag}>"

        loose = rng.random() < 0.3  # an article whose paragraphs have no element of their own around them all, or one that says nothing

        def article(el=el, boiler=boiler, links=links, loose=loose):
            if loose:
                wrap = rng.choice(["{}", "<div>{}</div>", f'<div class="{word()}">{{}}</div>', "<section>{}</section>", "<table><tr><td>{}</td></tr></table>"])
                ads = rng.random() < 0.3  # one after each paragraph
                inner = [el("h1", prose(2, 9), 1)] if rng.random() < 0.4 else []
                for _ in range(rng.choice([rng.randint(2, 9), rng.randint(2, 9), 60])):
                    inner.append(el(rng.choice(["p", "p", "div"]), prose(15, 90), 1))
                    if ads:
                        inner[-1] += f'<div class="{rng.choice(["ad", "ads", "promo", "sponsored"])}">' + el("p", prose(3, 12), 0) + "</div>"
                return "".join(wrap.format(i) for i in inner) if rng.random() < 0.6 else wrap.format("".join(inner))
            body = [el("h1", prose(2, 9), 1)] if rng.random() < 0.8 else []
            short = rng.random() < 0.3
            for _ in range(rng.randint(1, 3) if short else rng.randint(2, 9)):
                r = rng.random()
                if r > 0.95:  # references to other pages
                    body.append("<ul>" + "".join(el("li", f"<a href='/x'>{label()}</a>", 1) for _ in range(rng.randint(1, 5))) + "</ul>")
                    continue
                body.append(el("h2", prose(1, 5), 1) if r < 0.1 else el("li", prose(3, 15), 1) if r < 0.15 else boiler(rng.choice(["advert", "social", "side"]), 0) if r < 0.22 else el("p", prose(1, 8 if short else 90), 1))
            kind = rng.random()
            return ("<article>{}</article>" if kind < 0.5 else "<main>{}</main>" if kind < 0.65 else f'<div class="{rng.choice(["content", "post", "entry", "story", "read-more-content", "content-with-sidebar", "top-story", "main-text"])}">' + "{}</div>" if kind < 0.85 else "<div>{}</div>").format("".join(body))

        # marks are appended in the order in which the parts are made, which is the order of the page
        above = rng.choice([0, 0.6, 0.6, 0.6])
        page = "<html><body>" + "".join(boiler(k) for k in ("notice", "header", "menu", "advert") if rng.random() < above) + article() + "".join(boiler(k) for k in ("social", "comment", "side", "form", "advert", "notice") if rng.random() < 0.45) + (boiler("footer") if rng.random() < 0.8 else "") + "</body></html>"
        made.append((page, marks))
    return made


def fit(pages: int = 600, seed: int = 3) -> np.ndarray:
    """Weights of the block classifier, the last one being its constant."""
    xs, ys = [], []
    for page, marks in practice_pages(pages, seed):
        found = blocks(page)
        if len(found) == len(marks):
            xs.append(features(found))
            ys += marks
    x, y = np.concatenate(xs), np.array(ys, float)
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton's method with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w)), x.T @ (y - p) - 0.5 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


#: Weights of the edges between blocks in sequence and between the next blocks under one parent.
SEQUENCE, SIBLING = 1.0, 0.6


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    out = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            out.append((i - 1, i, SEQUENCE / (1 + max(found[i - 1].depth, b.depth) - b.common) ** 2))
        parent = b.parent
        if parent in last and last[parent] != i - 1:
            out.append((last[parent], i, SIBLING))
        last[parent] = i
    return out


def min_cut(content: list[float], other: list[float], between: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling of least cost: content[i] is paid if i is content, other[i] if not, an edge's weight if its ends differ. Of several such
    labellings the one with the fewest content blocks."""
    n = len(content)
    excess = [o - c for c, o in zip(content, other, strict=True)]  # what the source still gives (+) or the sink still takes (-)
    flow: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in between:
        flow[a][b] = flow[a].get(b, 0.0) + w
        flow[b][a] = flow[b].get(a, 0.0) + w
    tiny = 1e-12
    shut = [False] * n  # blocks from which none that takes can be reached any more: nothing leads out of their set
    for s in range(n):
        while excess[s] > tiny and not shut[s]:  # shortest augmenting path from s to any block that takes
            came, queue, goal = {s: s}, deque([s]), -1
            while queue and goal < 0:
                u = queue.popleft()
                for v, c in flow[u].items():
                    if c > tiny and v not in came and not shut[v]:
                        came[v] = u
                        if excess[v] < -tiny:
                            goal = v
                            break
                        queue.append(v)
            if goal < 0:
                for u in came:
                    shut[u] = True
                break
            amount, v = min(excess[s], -excess[goal]), goal
            while v != s:
                amount = min(amount, flow[came[v]][v])
                v = came[v]
            v = goal
            while v != s:
                flow[came[v]][v] -= amount
                flow[v][came[v]] += amount
                v = came[v]
            excess[s] -= amount
            excess[goal] += amount
    side = [e > tiny for e in excess]
    queue = deque(i for i in range(n) if side[i])
    while queue:
        u = queue.popleft()
        for v, c in flow[u].items():
            if c > tiny and not side[v]:
                side[v] = True
                queue.append(v)
    return side


def main_text(page: str, weights: np.ndarray, known: dict | None = None) -> str:
    found = blocks(page, known)
    if not found:
        return ""
    z = np.clip(features(found) @ weights[:-1] + weights[-1], -12, 12)
    content, other = np.logaddexp(0, -z).tolist(), np.logaddexp(0, z).tolist()
    return " ".join(b.text for b, keep in zip(found, min_cut(content, other, edges(found)), strict=True) if keep)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Every row of `pages` without its html, with text and n_chars (code points) added.

    Null html counts as empty; a page without content has the empty text. Rows are independent: ties, repeated rows, null ids and other
    columns pass through, but columns named text or n_chars are replaced; an empty table gives an empty result.
    """
    weights = fit()
    row, cells, fields = carry(pages, [html_col, "text", "n_chars"])
    schema = T.StructType([T.StructField("row", row_type(fields))] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        known: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(h, weights, known) for h in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["row", "text", "n_chars"])

    found = pages.select(row, F.coalesce(F.col(html_col), F.lit("")).alias("html")).mapInArrow(tidy(run), schema)
    return found.select(*cells, "text", "n_chars")
