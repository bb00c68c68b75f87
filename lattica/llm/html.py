"""Main text of web pages by minimum-cut labelling.

A tolerant tokenizer cuts a page into blocks (runs of text between block-level tags), in time linear in the page.
A logistic classifier, trained here on generated pages of many layouts with known labels, gives each block a cost
of being called content or boilerplate; these become capacities from and to the terminals. Neighbours in page
order, closer in the tree bound more strongly, and neighbours under one parent get smoothness edges. The
minimum cut, found by augmenting shortest paths, separates content from boilerplate; content blocks are joined
by a space, each with its white space reduced to single spaces and its character references decoded.

What class and id names say is a feature of the nearest ancestor that says anything, no more: a name that tells of
a state (no-sidebar, has-comments, share-enabled) says nothing, and an element that holds most of the page's text
around a clean article, main part or first heading is a wrapper, whose names and whose being a form or an aside
count for nothing below it. Where no element says anything, the shares of the page's words that a block's parent
and grandparent hold tell the main column from others.

Head, scripts, styles, templates, drawings and form controls are never text. All pages are done whole.

Edge cases: a null or empty page, or one without content, gives the empty string; broken or unclosed markup
is read as far as tags can be told from text (a tag without its end is text, a quote without its end is a
character); very long pages and very deep nesting take time in proportion; text outside all tags is a block of its
own; a null id or url passes through; repeated rows give equal results; an empty table gives an empty result. Only
the id, url and html columns are read.
"""

from __future__ import annotations

import html as _html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard, and words that designers use in class and id names.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
UNSEEN = frozenset("head script style noscript template svg math canvas object audio video select option optgroup button textarea title iframe noembed noframes datalist".split())
CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
GOOD = frozenset("article articlebody body content contents entry main maincontent post postbody posttext story storybody text".split())
BAD = frozenset("ad ads adv advert advertisement advertising banner bottom breadcrumb breadcrumbs byline comment commentlist comments consent cookie cookies copyright disclaimer discussion disqus footer form gdpr header login masthead meta menu nav navbar navigation newsletter notice notification outbrain pager pagination paywall popular popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signin signup skip social sponsor sponsored subscribe subscription tags toolbar topbar trending warning widget widgets".split())
#: Words by which a name tells of a state of the page, not of what the element is.
STATE = frozenset("no not non has have having with without enabled disabled closed hidden off layout supports".split())
#: Words that adverts, forms and notices use more than articles do.
CUES = frozenset("accept advertisement buy click cookie cookies discount follow login offer offers policy privacy register rights reserved reply sale share shipping shop sign sponsored subscribe terms unsubscribe".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"""[>"']""")
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
_IMPLICIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

_FLAG = {"article": 1, "main": 2, "good": 4, "bad": 8, "nav": 16, "footer": 32, "header": 64, "aside": 128, "form": 256, "unseen": 512, "heading": 1024, "item": 2048, "link": 4096, "outer": 8192, "clean": 16384}
_INHERITED = ("article", "main", "nav", "footer", "header", "aside", "form")
_SAYS = _FLAG["article"] | _FLAG["main"] | _FLAG["good"] | _FLAG["bad"] | _FLAG["nav"] | _FLAG["footer"] | _FLAG["header"] | _FLAG["aside"] | _FLAG["form"]
FEATURES = ("bias", "article", "main", "good", "bad", "outer", "nav", "footer", "header", "aside", "form", "link", "words", "sentence", "heading", "item", "copyright", "cue", "bad_in_article", "lone", "lone_parent", "lone_grandparent", "lone_link", "lone_words")
NEAR, SIBLING, WRAPPER = 0.6, 0.4, 0.5


@dataclass
class Block:
    text: str
    flags: int
    link: float
    parent: int
    distance: int  # steps in the tree from the block before
    element: int = 0
    share: float = 0.0  # of the page's words, those below the parent
    grand: float = 0.0  # and below its parent


def _own(name: str, attributes: str, above: int) -> int:
    """What an element itself says."""
    f = 0
    if name in ("article", "main", "nav", "footer", "aside", "form"):
        f |= _FLAG[name]
    elif name == "header" and not above & (_FLAG["article"] | _FLAG["main"]):
        f |= _FLAG["header"]
    elif name == "li":
        f |= _FLAG["item"]
    elif len(name) == 2 and name[0] == "h" and name[1] in "123456":
        f |= _FLAG["heading"]
    if attributes and name not in ("html", "body"):
        for m in _NAMES.finditer(attributes):
            for token in m.group(1).strip("\"'").split():
                parts = {x.lower() for x in _IMPLICIT.findall(token)} | set(re.findall("[a-z]+", token.lower()))
                if parts & STATE:
                    continue
                if parts & BAD:
                    f |= _FLAG["bad"]
                if parts & GOOD:
                    f |= _FLAG["good"]
    if not f & _FLAG["bad"] and (name in ("main", "article", "h1") or f & _FLAG["good"]):
        f |= _FLAG["clean"]
    return f


class _Tags:
    """Finds where tags end, in one pass over the page: what was found ahead, or not at all, is remembered, and quotes
    count for nothing once a tag with quotes has run to the end of the page."""

    def __init__(self, page: str):
        self.page, self.known, self.loose = page, {}, False

    def find(self, what: str, at: int) -> int:
        since, found = self.known.get(what, (at + 1, 0))
        if since <= at and (found < 0 or at <= found):
            return found
        found = self.page.find(what, at)
        self.known[what] = at, found
        return found

    def read(self, at: int) -> tuple[int, bool, str, str] | None:
        """At a "<": end, whether it closes, name and attributes; an empty name for comments and declarations, None for text."""
        page = self.page
        if page.startswith("<!--", at):
            end = self.find("-->", at + 4)
            return (end + 3 if end >= 0 else len(page)), False, "", ""
        if page.startswith(("<!", "<?"), at):
            end = self.find(">", at)
            return (end + 1, False, "", "") if end >= 0 else None
        closing = page.startswith("/", at + 1)
        letter = page[at + 1 + closing : at + 2 + closing]
        if not (letter.isascii() and letter.isalpha()) or self.find(">", at) < 0:
            return None
        m = _NAME.match(page, at + 1 + closing)
        begin = stop = m.end()
        while True:
            x = _STOP.search(page, stop) if not self.loose else None
            if x is None:
                self.loose = True
                stop = self.find(">", begin) + 1
                return stop, closing, m[0].lower(), page[begin : stop - 1]
            stop = x.end()
            if x[0] == ">":
                return stop, closing, m[0].lower(), page[begin : stop - 1]
            before = x.start() - 1
            while before > begin and page[before] in " \t\r\n":
                before -= 1
            if page[before] == "=" and (end := self.find(x[0], stop)) >= 0:
                stop = end + 1


def blocks(page: str) -> list[Block]:
    """The page's blocks of visible text, in order."""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = [("", 0, 0)]  # name, flags, number of the element
    opened: dict[str, int] = {}
    above, own, size = [0], [0], [0]  # of each element: its parent, what it says, words right in it
    text: list[str] = []
    linked = 0
    lowest = 0
    depth_of_last = 0
    pos, n = 0, len(page)
    tags = _Tags(page)
    ends = {}

    def cut(k: int) -> None:
        nonlocal lowest
        for name, _, _ in stack[k:]:
            opened[name] -= 1
        del stack[k:]
        lowest = min(lowest, len(stack))

    def flush() -> None:
        nonlocal linked, lowest, depth_of_last
        if text:
            whole = "".join(text).split()
            if whole and not stack[-1][1] & _FLAG["unseen"]:
                joined = " ".join(whole)
                d = len(stack) - opened.get("a", 0)
                at = len(stack) - 1
                while stack[at][0] == "a":
                    at -= 1
                low = min(lowest, d)
                number = stack[at][2]
                size[number] += len(whole)
                out.append(Block(joined, stack[at][1], min(1.0, linked / max(1, len(joined))), above[number], depth_of_last + d - 2 * low, number))
                lowest = depth_of_last = d
            text.clear()
            linked = 0

    def say(piece: str) -> None:
        nonlocal linked
        if piece:
            if "&" in piece:
                piece = _html.unescape(piece)
            text.append(piece)
            if stack[-1][1] & _FLAG["link"]:
                linked += len(piece.strip())

    while pos < n:
        at = page.find("<", pos)
        if at < 0:
            say(page[pos:])
            break
        tag = tags.read(at)
        if tag is None:
            say(page[pos : at + 1])
            pos = at + 1
            continue
        say(page[pos:at])
        pos, closing, name, attributes = tag
        if not name:
            continue
        if closing:
            if name in BLOCKS or name in UNSEEN:
                flush()
            if opened.get(name) and (name in BLOCKS or name == "a" or name in UNSEEN):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        cut(k)
                        break
                    if name == "a" and stack[k][0] in BLOCKS:
                        break
            continue
        if name == "br":
            say(" ")
            continue
        if name in RAW:
            if name not in ends:
                ends[name] = re.compile(rf"</{name}[\s/>]", re.I)
            end = ends[name].search(page, pos) if name != "plaintext" else None
            stop = end.start() if end else n
            if name not in UNSEEN:
                flush()
                say(page[pos:stop])
                flush()
            close = tags.find(">", stop) if end else -1
            pos = close + 1 if close >= 0 else n
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name == "a":
            for k in range(len(stack) - 1, max(0, len(stack) - 4), -1):
                if stack[k][0] == "a":
                    opened["a"] -= 1
                    del stack[k]
                    break
            stack.append(("a", stack[-1][1] | _FLAG["link"], stack[-1][2]))
            opened["a"] = opened.get("a", 0) + 1
            continue
        if name in BLOCKS or name in UNSEEN:
            flush()
            if name in BLOCKS and stack[-1][0] != name and any(x[0] == "p" for x in stack[-2:]) and name not in ("button", "select", "option", "optgroup"):
                closes = frozenset(["p"])  # a paragraph cannot hold another block
            else:
                closes = CLOSES.get(name, frozenset())
            while len(stack) > 1 and stack[-1][0] in closes:
                cut(len(stack) - 1)
            if attributes.endswith("/") and name in UNSEEN and name not in BLOCKS:
                continue
            f = stack[-1][1]
            said = _own(name, attributes, f)
            above.append(stack[-1][2])
            own.append(said)
            size.append(0)
            stack.append((name, f & (_FLAG["unseen"] | _FLAG["link"] | _FLAG["article"] | _FLAG["main"]) | said & (_FLAG["article"] | _FLAG["main"]) | (_FLAG["unseen"] if name in UNSEEN else 0), len(own) - 1))
            opened[name] = opened.get(name, 0) + 1
    flush()
    _resolve(out, above, own, size)
    return out


def _resolve(bs: list[Block], above: list[int], own: list[int], size: list[int]) -> None:
    """Give each block what its ancestors say, and the shares of words about it."""
    n = len(own)
    clean = [False] * n  # a clean landmark stands below
    for k in range(n - 1, 0, -1):  # children come after their parents
        size[above[k]] += size[k]
        if clean[k] or own[k] & _FLAG["clean"]:
            clean[above[k]] = True
    total = max(1, size[0])
    flags = [0] * n
    for k in range(1, n):
        f, up = own[k], flags[above[k]]
        if clean[k] and size[k] >= WRAPPER * total:  # a wrapper
            f &= ~(_FLAG["bad"] | _FLAG["form"] | _FLAG["aside"])
        got = up & sum(_FLAG[x] for x in _INHERITED) | f & sum(_FLAG[x] for x in _INHERITED) | up & _FLAG["outer"] | f & (_FLAG["heading"] | _FLAG["item"])
        if f & _FLAG["bad"]:
            got |= _FLAG["bad"]
        elif f & (_FLAG["good"] | _FLAG["article"] | _FLAG["main"]):
            got |= f & _FLAG["good"] | (_FLAG["outer"] if up & _FLAG["bad"] else 0)
        else:
            got |= up & (_FLAG["bad"] | _FLAG["good"])
        flags[k] = got
    for b in bs:
        b.flags = b.flags & (_FLAG["unseen"] | _FLAG["link"]) | flags[b.element]
        b.share, b.grand = size[b.parent] / total, size[above[b.parent]] / total


def features(bs: list[Block]) -> np.ndarray:
    x = np.zeros((len(bs), len(FEATURES)))
    at = {name: c for c, name in enumerate(FEATURES)}
    for r, b in enumerate(bs):
        f, words = b.flags, b.text.count(" ") + 1
        x[r, 0] = 1
        for name in ("article", "main", "good", "bad", "outer", "nav", "footer", "header", "aside", "form"):
            x[r, at[name]] = bool(f & _FLAG[name])
        size = min(np.log1p(words), 5.0)
        x[r, at["link"]], x[r, at["words"]] = b.link, size
        x[r, at["sentence"]] = b.text[-1] in ".!?:\"'»”"
        x[r, at["heading"]], x[r, at["item"]] = bool(f & _FLAG["heading"]), bool(f & _FLAG["item"])
        start = b.text[:200].lower()
        x[r, at["copyright"]] = "©" in start or "copyright" in start
        x[r, at["bad_in_article"]] = bool(f & (_FLAG["article"] | _FLAG["main"])) and bool(f & (_FLAG["bad"] | _FLAG["nav"] | _FLAG["aside"] | _FLAG["form"] | _FLAG["footer"]))
        if not f & _SAYS:  # inside an article such words are as good as any
            if words <= 60:
                x[r, at["cue"]] = min(1.0, 4 * sum(w.strip(".,!?:") in CUES for w in b.text.lower().split()) / words)
            x[r, at["lone"]], x[r, at["lone_parent"]], x[r, at["lone_grandparent"]], x[r, at["lone_link"]], x[r, at["lone_words"]] = 1, b.share, b.grand, b.link, size
    return x


def generated(pages: int = 700, seed: int = 3) -> Iterator[tuple[str, list[bool]]]:
    """Pages of many layouts with the label of each block: what the classifier learns from."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    word = lambda: "".join(pick("abcdefghiklmnoprstuvwy") for _ in range(int(rng.integers(2, 9))))
    say = lambda a, b: " ".join(word() for _ in range(int(rng.integers(a, b))))
    cues = sorted(CUES)

    def prose(a: int, b: int) -> str:
        return ". ".join(say(1, 14).capitalize() for _ in range(int(rng.integers(a, b)))) + "."

    def pitch() -> str:
        return " ".join(pick(cues) if rng.random() < 0.3 else word() for _ in range(int(rng.integers(3, 20)))) + pick([".", "!", ""])

    for _ in range(pages):
        out, labels = [], []

        def add(markup: str, *content: bool) -> None:
            out.append(markup)  # noqa: B023
            labels.extend(content)  # noqa: B023

        def menu(tag: str) -> None:
            k = int(rng.integers(2, 8))
            add(f"<{tag}><ul>" + "".join(f'<li><a href="/{word()}">{say(1, 4)}</a></li>' for _ in range(k)) + f"</ul></{tag.split()[0]}>", *[False] * k)

        def aside() -> None:
            kind = pick(["ad", "advert", "sidebar", "widget", "related", "promo", "cookie-notice", "newsletter", "social-share", "sponsored", "comments", "notice"])
            tag = pick(["div", "section", "aside"])
            k = int(rng.integers(1, 4))
            add(f'<{tag} {pick(["class", "id"])}="{kind}">' + "".join(f"<p>{pick([prose(1, pick([2, 4])), pitch()])}</p>" for _ in range(k)) + f"</{tag}>", *[False] * k)

        def column() -> None:
            k = int(rng.integers(1, 4))
            add(f'<div{pick(["", " class=col-4", " class=right", " id=x2"])}>' + "".join(f"<p>{pick([pitch(), prose(1, 2)])}</p>" for _ in range(k)) + "</div>", *[False] * k)

        def part(bare: bool) -> None:
            add(f"<h1>{say(1, 9)}{pick(['', '.'])}</h1>", True)
            for _ in range(int(rng.integers(3 if bare else 1, 9))):
                r = rng.random()
                if r < 0.72:
                    add(f"<p>{prose(2 if bare else 1, 8)}</p>", True)
                elif r < 0.8:
                    add(f"<h2>{say(1, 6)}</h2>", True)
                elif r < 0.86:
                    k = int(rng.integers(1, 5))
                    add("<ul>" + "".join(f"<li>{say(2, 12)}</li>" for _ in range(k)) + "</ul>", *[True] * k)
                elif r < 0.9 and not bare:
                    add(f"<p>{word()}{pick(['', '.', '?'])}</p>", True)
                elif not bare:
                    aside()

        around = pick([("", "")] * 4 + [('<div class="page no-sidebar">', "</div>"), ('<div class="site-header-fixed">', "</div>"), ('<form id="aspnet"><div>', "</div></form>"), ('<div id="wrapper" class="has-comments">', "</div>"), ('<table><tr><td>', "</td></tr></table>")])
        add(around[0])
        if rng.random() < 0.5:
            add(f"<{pick(['header', 'header', 'div class=masthead'])}{pick(['', ' id=site'])}><h1>{say(1, 5)}</h1></header></div>", False)
        menu(pick(["nav", "nav", 'div class="menu"', 'div id="navigation"', "div", "div class=links"]))
        for _ in range(int(rng.integers(0, 3))):
            aside()
        style = rng.random()
        if style < 0.2:  # bare columns: the main one holds most words
            add(pick(["<div class=row>", "<div>", "<table><tr>"]))
            table = out[-1].startswith("<table")
            first = rng.random() < 0.3
            cell = "td" if table else "div"
            if first:
                add(f"<{cell}>")
                column()
                add(f"</{cell}>")
            add(f"<{cell}{pick(['', ' class=col-8', ' class=left'])}>")
            part(True)
            add(f"</{cell}>")
            if not first:
                add(f"<{cell}>")
                column()
                add(f"</{cell}>")
            add("</tr></table>" if table else "</div>")
        else:
            open_, close = pick([("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="main-content">', "</div>"), ('<div class="post-body">', "</div>"), ('<article class="post share-enabled">', "</article>"), ('<div class="main-banner"><article>', "</article></div>"), ("<article>", "</article>")])
            add(open_)
            part(False)
            if rng.random() < 0.25:
                add(f"<form><p>{pitch()}</p><label>{say(1, 3)}</label></form>", False, False)
            add(close)
            if rng.random() < 0.2:
                column()
        if rng.random() < 0.4:
            k = int(rng.integers(1, 5))
            inner = pick(["div class=comment", "div class=reply", 'article class="comment"'])
            add(f'<section class="{pick(["comments", "comment-list", "replies"])}">' + "".join(f"<{inner}><p>{prose(1, 4)}</p></{inner.split()[0]}>" for _ in range(k)) + "</section>", *[False] * k)
        if rng.random() < 0.3:
            add(f"<aside><p>{prose(1, 4)}</p></aside>", False)
        if rng.random() < 0.9:
            add(f"<{pick(['footer', 'div class=footer'])}>{pick(['&copy; ', 'Copyright ', ''])}{say(1, 8)} &middot; {prose(1, 2)}</footer></div>", False)
        add(around[1])
        yield "<html><body>" + "".join(out) + "</body></html>", labels


@lru_cache(maxsize=1)
def weights() -> np.ndarray:
    """Logistic weights by Newton's method with shrinkage, on generated pages."""
    xs, ys = [], []
    for page, labels in generated():
        bs = blocks(page)
        if len(bs) == len(labels):
            xs.append(features(bs))
            ys.append(labels)
    x, y = np.concatenate(xs), np.concatenate(ys).astype(float)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (p - y) + 0.5 * w
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 0.5 * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return w


def min_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source. source, sink: terminal capacities; edges: (a, b, capacity) both ways."""
    n = len(source)
    left = [a - b for a, b in zip(source, sink, strict=True)]  # what passes straight through is cut in any case
    supply = [max(x, 0.0) for x in left]
    demand = [max(-x, 0.0) for x in left]
    near: list[list[int]] = [[] for _ in range(n)]
    to, cap = [], []
    for a, b, c in edges:
        near[a].append(len(to))
        near[b].append(len(to) + 1)
        to += [b, a]
        cap += [c, c]
    tiny = 1e-12
    while True:
        level = [0 if supply[v] > tiny else -1 for v in range(n)]
        queue = deque(v for v in range(n) if level[v] == 0)
        reached = False
        while queue:
            v = queue.popleft()
            if demand[v] > tiny:
                reached = True
            for e in near[v]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if not reached:
            return [x >= 0 for x in level]
        at = [0] * n
        for s in range(n):
            while supply[s] > tiny:
                path, v = [], s
                while demand[v] <= tiny:
                    while at[v] < len(near[v]):
                        e = near[v][at[v]]
                        if cap[e] > tiny and level[to[e]] == level[v] + 1:
                            break
                        at[v] += 1
                    else:
                        if not path:
                            v = -1
                            break
                        e = path.pop()
                        v = to[e ^ 1]
                        at[v] += 1
                        continue
                    path.append(e)
                    v = to[e]
                if v < 0:
                    break
                flow = min(supply[s], demand[v], *(cap[e] for e in path)) if path else min(supply[s], demand[v])
                supply[s] -= flow
                demand[v] -= flow
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow


def label(bs: list[Block], w: np.ndarray) -> list[bool]:
    """Whether each block is content."""
    if not bs:
        return []
    z = np.clip(features(bs) @ w, -12, 12)
    cost = np.logaddexp(0, -z)  # of calling it content
    edges = [(k, k + 1, NEAR / (1 + bs[k + 1].distance)) for k in range(len(bs) - 1)]
    last: dict[int, int] = {}
    for k, b in enumerate(bs):
        if b.parent in last:
            edges.append((last[b.parent], k, SIBLING))
        last[b.parent] = k
    return min_cut(list(np.logaddexp(0, z)), list(cost), edges)


def main_text(page: str | None, w: np.ndarray) -> str:
    bs = blocks(page or "")
    return " ".join(b.text for b, keep in zip(bs, label(bs, w), strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row per page: id, url, text."""
    sent = pages.sparkSession.sparkContext.broadcast(weights())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for b in batches:
            for at in range(0, b.num_rows, 64):  # so that what is held is a few pages' text
                part = b.slice(at, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([main_text(x, w) for x in part.column(2).to_pylist()], pa.string())], [id_col, url_col, "text"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return pages.select(id_col, url_col, F.col(html_col).cast("string").alias("_ht_html")).mapInArrow(run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string")
