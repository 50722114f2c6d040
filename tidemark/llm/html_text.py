"""Main text of web pages by tree scoring.

A page becomes a tree of elements and a list of text blocks (what stands between boundaries of block elements).
Blocks inside elements that never hold an article (menus, page headers and footers, sidebars, scripts, hidden
parts) are set aside. Forms, and elements that class, id or role call a sidebar, advert, notice or reader comments,
are suspects: they count little in a first scoring, and all of them but those around its container and their like
beside them are set aside for the second. If almost nothing is left then, all suspects count. Every block of some length passes points, 1 and one per comma and up to 3 for length, to the ancestors of its paragraph: all
to the first, half to the second, less further up. An element's score is its points and a bonus or malus for
its tag and names, times one minus its link density. The best element is the container, widened to the
``article`` or ``main`` around it; siblings that score a fifth of it, and headings and paragraphs of prose
beside it, are kept with it. Points, bonuses and these limits are those of a widely published readability heuristic.

Character references are decoded, white space inside a block becomes one space, blocks are joined by a blank
line in page order. Nothing else is dropped or cut. Null and empty pages, and pages without text, give the
empty text. Unclosed and stray tags are repaired as browsers do in the common cases. Pages repeated in the
table get a row each; other columns than page_id, url and html are not read.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame

from tidemark.llm.common import map_rows

_TAG = re.compile(r"""<(?:!--(?P<comment>.*?)(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>"']+|"[^"]*"|'[^']*')*+)>|/?[a-zA-Z][^>]*(?P<odd>>|\Z))""", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"[a-zA-Z][a-z]*|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe xmp noembed noframes noscript".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody tfoot thead tr caption ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset(
    "head script style title noscript template iframe svg canvas object embed nav footer aside button select textarea "
    "input dialog menu datalist audio video map".split()
)
# Words of class, id and role that mark parts around an article.
AROUND = frozenset(
    "ad ads advert advertisement advertising adverts adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notification alert popup modal overlay newsletter subscribe subscription signup paywall comment comments "
    "disqus replies respond discussion sidebar aside nav navbar navigation menu breadcrumb breadcrumbs footer masthead toolbar "
    "pagination pager share sharing social related recommended trending widget complementary contentinfo search login skip".split()
)
# A word beside one of these tells of the page and not of the element: no-sidebar, with-sidebar, ad-free.
STATE = frozenset("no with without has free".split())
FOR_TEXT = frozenset("article body content entry hentry main page post text story blog".split())
CLOSES_P = BLOCK - {"html", "body"}
LEAST = 25
SUSPECT = 0.2


class Page:
    """Elements of a page (parent, tag, dropped, bonus) and its blocks (element, text, characters inside links, pieces).

    ``suspects`` has the names of each suspect, ``doubts`` how many suspects an element is inside that no name speaks
    for. Blocks with text inside suspects have their pieces (element, text, whether inside a link), others None.
    """

    def __init__(self, source: str):
        self.parent, self.tag, self.dropped, self.bonus = [-1], ["#root"], [False], [0.0]
        self.suspects: dict[int, frozenset] = {}
        self.suspected, self.doubts = [False], [0]
        self.blocks: list[tuple[int, str, int, list | None]] = []
        self._stack, self._open = [0], {"#root": 1}
        self._text: list[tuple[int, str, bool]] = []
        self._links = 0
        at = 0
        while m := _TAG.search(source, at):  # from behind a raw element on: what looks like a tag in it may reach beyond its end
            self._add(source[at : m.start()])
            at = m.end()
            name = m["name"]
            if not name:
                continue
            name = name.lower()
            if m["end"]:
                self._close(name)
            else:
                self._start(name, m["attrs"] or "")
                if name in RAW:
                    stop = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(source, at)
                    at = stop.start() if stop else len(source)
        self._add(source[at:])
        self._flush()

    def _add(self, raw: str) -> None:
        if raw and not self.dropped[self._stack[-1]]:
            self._text.append((self._stack[-1], html.unescape(raw), self._links > 0))

    def _flush(self) -> None:
        if self._text:
            text, links = read(self._text)
            if text:
                owner = next(e for e in reversed(self._stack) if e == 0 or self.tag[e] in BLOCK)
                self.blocks.append((owner, text, links, self._text if any(self.suspected[e] for e, _, _ in self._text) else None))
            self._text = []

    def _start(self, name: str, attrs: str) -> None:
        if name in BLOCK:
            self._flush()
        elif name in ("br", "td", "th"):
            self._text.append((self._stack[-1], " ", False))
        if name in CLOSES_P and self._open.get("p"):
            self._close("p", ("table", "div", "article", "section", "blockquote", "td"))
        elif name in ("li", "dd", "dt", "tr", "td", "th", "option"):
            self._close_within(name)
        if name == "li":
            self._close_within("li")
        if name in VOID:
            return
        top = self._stack[-1]
        element = len(self.parent)
        self.parent.append(top)
        self.tag.append(name)
        dropped, bonus, suspect, doubt = self._judge(name, attrs)
        self.dropped.append(self.dropped[top] or dropped)
        if suspect is not None:
            self.suspects[element] = suspect
        self.suspected.append(self.suspected[top] or suspect is not None)
        self.doubts.append(self.doubts[top] + doubt)
        self.bonus.append(bonus)
        self._stack.append(element)
        self._open[name] = self._open.get(name, 0) + 1
        self._links += name == "a"

    def _judge(self, name: str, attrs: str) -> tuple[bool, float, frozenset | None, bool]:
        bonus = {"article": 10.0, "main": 8.0, "div": 5.0, "section": 3.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0}.get(name, 0.0)
        bonus -= 5.0 if name in HEADING else 3.0 if name in ("ul", "ol", "dl", "li", "address") else 0.0
        dropped = name in DROPPED or name == "header" and not self._open.get("article") and not self._open.get("main")
        suspect, doubt = (frozenset(), True) if name == "form" else (None, False)
        if attrs and not attrs.isspace():
            found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTR.findall(attrs)}
            given = [{w.lower() for w in _NAME.findall(n)} for k in ("class", "id", "role") for n in found.get(k, "").split()]
            names = set().union(*given)
            around = set().union(*(n & AROUND for n in given if not n & STATE))
            whole = name in ("html", "body", "article", "main")
            if around and (not whole or around & {"comment", "comments", "related", "sponsored", "ad", "promo"}):
                # A name for text alone ("content") speaks for the element, one inside another ("comment-content") does not.
                suspect, doubt = frozenset(names), not any(n & FOR_TEXT and not n & AROUND for n in given)
            if names & FOR_TEXT and not doubt:
                bonus += 25.0
            style = found.get("style", "").replace(" ", "").lower()
            if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style:
                dropped = True
        return dropped, bonus, suspect, doubt

    def _close(self, name: str, stops: tuple = ()) -> None:
        if not self._open.get(name):
            if name == "p":
                self._flush()
            return
        if stops:
            for e in reversed(self._stack):
                if self.tag[e] == name:
                    break
                if self.tag[e] in stops:
                    return
        if name in BLOCK:
            self._flush()
        while True:
            tag = self.tag[self._stack.pop()]
            self._open[tag] -= 1
            self._links -= tag == "a"
            if tag == name:
                return

    def _close_within(self, name: str) -> None:
        """Ends an open item of the same list or table before the next one."""
        outer = ("ul", "ol", "menu", "dl", "table")
        same = ("dd", "dt") if name in ("dd", "dt") else ("td", "th") if name in ("td", "th") else (name,)
        if any(self._open.get(s) for s in same):
            for e in reversed(self._stack):
                if self.tag[e] in same:
                    self._close(self.tag[e])
                    return
                if self.tag[e] in outer:
                    return


def read(pieces: list) -> tuple[str, int]:
    """The text of pieces (element, text, whether inside a link) and its characters inside links."""
    return " ".join("".join(t for _, t, _ in pieces).split()), len(" ".join("".join(t for _, t, link in pieces if link).split()))


def main_blocks(page: Page) -> list[str]:
    """The kept blocks in page order."""
    every = [b[:3] for b in page.blocks]
    if not page.suspects:
        return container(page, every)[0]
    # Which suspects are around the article shows a look at all blocks, where those inside suspects count little.
    up = container(page, every, [SUSPECT if n else 1.0 for n in page.doubts])[1]
    spared, like = set(), set()
    while up > 0:
        if up in page.suspects:
            spared.add(up)
            like.add((page.parent[up], page.tag[up], page.suspects[up]))
        up = page.parent[up]
    out = [False]
    for e in range(1, len(page.parent)):
        names = page.suspects.get(e)
        own = names is not None and e not in spared and not (names and (page.parent[e], page.tag[e], names) in like)
        out.append(own or out[page.parent[e]])
    blocks = []
    for owner, text, links, pieces in page.blocks:
        if pieces and any(out[e] for e, _, _ in pieces):
            text, links = read([p for p in pieces if not out[p[0]]])
        if text:
            blocks.append((owner, text, links))
    kept = container(page, blocks)[0]
    if sum(map(len, kept)) < LEAST:
        return max(kept, container(page, every)[0], key=lambda found: sum(map(len, found)))
    return kept


def container(page: Page, blocks: list[tuple[int, str, int]], weights: list[float] | None = None) -> tuple[list[str], int]:
    """The blocks in and beside the best container, and the container. ``weights`` are what the points and the bonus of elements count."""
    parent, tag = page.parent, page.tag
    if not blocks:
        return [], 0
    points = [0.0] * len(parent)
    size, linked = [0] * len(parent), [0] * len(parent)
    for owner, text, links in blocks:
        size[owner] += len(text)
        linked[owner] += links
    for e in range(len(parent) - 1, 0, -1):  # children stand after their parents
        size[parent[e]] += size[e]
        linked[parent[e]] += linked[e]
    for least in (LEAST, 1):
        for owner, text, _ in blocks:
            if len(text) >= least and tag[owner] not in HEADING:
                given = 1 + text.count(",") + min(len(text) / 100, 3)
                given *= weights[owner] if weights else 1.0
                up = parent[owner] if tag[owner] in ("p", "pre", "li", "dd", "blockquote", "tr") and owner else owner
                for share in (1.0, 0.5, 1 / 6, 1 / 9, 1 / 12):
                    points[up] += given * share
                    if up == 0:
                        break
                    up = parent[up]
        if any(points):
            break
    if not any(points):
        return [text for _, text, _ in blocks], 0
    score = [
        (points[e] + page.bonus[e] * (weights[e] if weights else 1.0)) * (1 - linked[e] / size[e]) if points[e] and size[e] else float("-inf") for e in range(len(parent))
    ]
    best = max(range(len(parent)), key=score.__getitem__)  # the first of equal ones
    up = best
    while up > 0 and tag[up] not in ("article", "main"):
        up = parent[up]
    outer = up if up > 0 else best
    kept = {outer}
    least = max(10.0, score[outer] * 0.2)
    for e in range(1, len(parent)):
        if e != outer and parent[e] == parent[outer] and size[e]:
            prose = tag[e] == "p" and (linked[e] / size[e] < 0.25 and size[e] > 80 or linked[e] == 0)
            if score[e] >= least or tag[e] in HEADING or prose:
                kept.add(e)
    inside = [False] * len(parent)
    for e in range(len(parent)):
        # Unless the container is an article, whose links are its own, lists and boxes that are mostly links are menus.
        menu = tag[outer] != "article" and tag[e] in ("ul", "ol", "div", "section", "table", "dl") and e not in kept and size[e] and linked[e] > 0.5 * size[e]
        inside[e] = (e in kept or e > 0 and inside[parent[e]]) and not menu
    return [text for owner, text, _ in blocks if inside[owner]], outer


def main_text(source: str | None) -> str:
    return "\n\n".join(main_blocks(Page(source))) if source else ""


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(rows):
        texts = [main_text(h) for h in rows["html"]]
        return {"page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    return map_rows(pages, ["page_id", "url", "html"], f"page_id {kind}, url string, text string, n_chars bigint", run)
