"""Main-text extraction from HTML by tree scoring.

The tag stream of a page is read once into text blocks and containers.  Each
paragraph-like block gives points for its length and commas to its parent and
half of them to its grandparent; a container's points are discounted by its
link density.  The best container is kept with those of its siblings, and of
its ancestors' siblings, that look like content; chrome (menus, headers,
footers, asides, adverts, notices, forms, buttons, reader comments) is left out
wherever it stands.  Time is linear in the page, however deep its tree.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset "
                   "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
                   "optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object select".split())
TO_THE_END = frozenset("script style noscript textarea title iframe".split())     # when unclosed, the rest of the page is theirs
CHROME = frozenset("nav header footer aside form menu dialog button head noscript template script style iframe".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd div section article".split())
CLOSES_P = BLOCKS - {"html", "body", "button"}
ITEMS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",),
         "option": ("select",)}
SIBLING_SHARE, LEAST_CHARS, LINKED_SHARE = 0.2, 25, 0.25
# A quote opens a string only where a value begins; elsewhere, or without an end, it is a letter.
_VALUE = r"\"[^\"]*\"|'[^']*'|[^\s>]*"
_TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                  rf"|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]+|[^\s/>][^\s/>=]*(?:\s*=\s*(?:{_VALUE}))?)*)(?:>|\Z)", re.S)
_ATTR = re.compile(rf"([^\s/>][^\s/>=]*)(?:\s*=\s*({_VALUE}))?")
# Names of page furniture, and words that go with them in a class or id (``sidebar-left``, ``site_footer``).
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements adsense adslot banner sponsor sponsored promo promos promotion promotions nav navbar "
    "navigation menu menus breadcrumb breadcrumbs sidebar widget widgets footer foot masthead topbar toolbar cookie cookies consent gdpr "
    "notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommend recommended "
    "recommendations comment comments respond replies disqus pagination pager toc skip search form alert paywall".split())
_BESIDE = frozenset(
    "area bar block bottom box btn button buttons column container content fixed global group header icons inner item items left link links "
    "list main module outer page panel post posts primary right row secondary section site slot sticky top unit wrap wrapper".split())
_OF_ARTICLES = frozenset("comment comments ad ads related promo".split())
_CONTAINERS = frozenset("address article center dd details div dl dt fieldset figure li ol section table ul".split())   # judged by class inside an article
_ADVERTS = frozenset("ad ads advert adverts advertisement advertisements sponsor sponsored promo promos".split())   # classes of paragraphs
_READERS = frozenset("comment comments respond replies disqus".split())             # ids, also of sections inside an article
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_WHOLE = re.compile(r"side[-_]bar|sign[-_]up|(?:site|page)[-_]header|skip[-_]link", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar comment".split())
_SPACE = re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    parent: Node | None
    chrome: bool
    marked: bool = False                            # an article or main, or inside one
    score: float = 0.0                              # points of near paragraphs
    points: float = 0.0                             # points of all paragraphs inside
    chars: int = 0
    linked: int = 0
    kept: bool = False
    children: list[Node] = field(default_factory=list)

    def unlinked(self) -> float:
        return 1 - self.linked / max(self.chars, 1)


def names_chrome(token: str, names: frozenset[str] = _NAMES) -> bool:
    """Whether a whole class token or id names page furniture: such a name,
    alone or only with numbers and words like ``box`` or ``left``."""
    if names is _NAMES and _WHOLE.fullmatch(token):
        return True
    parts = [p.rstrip("0123456789") for p in re.split("[-_]+", token.lower())]
    return any(p in names for p in parts) and all(not p or p in _NAMES or p in _BESIDE for p in parts)


def is_chrome(tag: str, attrs: str, marked: bool = False) -> bool:
    """Whether an element holds page furniture, by tag, role, class or id;
    ``marked``: it stands inside an article or main.

    Headings are never judged by name, paragraphs only by a class of adverts
    or reader comments.  Inside an article only containers are, by a class
    token, or by an id that is one name and nothing else; ids of sections there
    are slugs of their titles and count only if they name reader comments.
    """
    if tag in CHROME:
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    found: dict[str, str] = {}
    for k, v in _ATTR.findall(attrs):
        if k:
            found.setdefault(k.lower(), v.strip("\"'"))
    if ("hidden" in found or found.get("aria-hidden", "").lower() == "true"
            or "display:none" in found.get("style", "").replace(" ", "").lower() or found.get("role", "").lower() in _ROLES):
        return True
    classes, own = found.get("class", "").split(), found.get("id", "").strip()
    if tag == "p":
        return any(c.lower() in _ADVERTS | _READERS for c in classes)
    if tag in _HEADINGS or marked and tag not in _CONTAINERS:
        return False
    names = _OF_ARTICLES if tag == "article" else _NAMES
    if any(names_chrome(c, names) for c in classes):
        return True
    if marked:
        return own.lower() in (_READERS if tag in ("section", "li", "dd", "dt") or "section" in classes else names)
    return names_chrome(own, names)


def read(page: str) -> tuple[list[tuple[str, Node, int]], list[Node]]:
    """``(blocks, nodes)``: text blocks ``(text, container, linked chars)`` in
    page order, and all containers.  Character references are decoded, white
    space is collapsed; unclosed and stray tags are tolerated."""
    opened: Counter[str] = Counter()                # tags on the stack
    endless: set[str] = set()                       # raw tags that nothing closes any more
    root = Node("#", None, False)
    stack, nodes, blocks = [root], [root], []
    text: list[str] = []
    state = {"at": 0, "a": 0, "linked": 0}

    def flush() -> None:
        s = _SPACE.sub(" ", unescape("".join(text))).strip()
        if s:
            blocks.append((s, stack[-1], min(state["linked"], len(s))))
        text.clear()
        state["linked"] = 0

    def put(s: str) -> None:
        if s:
            text.append(s)
            if state["a"]:
                state["linked"] += len(s.strip())

    def close(tag: str, walls: tuple[str, ...] = ()) -> None:
        for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
            if stack[k].tag == tag:
                flush()
                opened.subtract(x.tag for x in stack[k:])
                del stack[k:]
                return
            if stack[k].tag in walls:
                return

    pos, n = 0, len(page)
    while pos < n:
        m = _TAG.search(page, pos)
        if not m:
            put(page[pos:])
            break
        put(page[pos:m.start()])
        pos = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                put(m[0][9:].removesuffix("]]>"))
            continue
        if m[1]:
            if tag == "a":
                state["a"] = 0
            elif tag in BLOCKS:
                close(tag)
            continue
        if tag in RAW:
            if not m[0].endswith("/>"):
                end = None if tag in endless else re.compile(rf"</{re.escape(tag)}(?:\s[^>]*)?>", re.I).search(page, pos)
                if end:
                    pos = end.end()
                elif tag in TO_THE_END:
                    pos = n
                else:
                    endless.add(tag)
            text.append(" ")
        elif tag == "br":
            put(" ")
        elif tag == "a":
            state["a"] = 0 if m[0].endswith("/>") else 1
        elif tag in BLOCKS:
            state["a"] = 0
            if tag in CLOSES_P:
                close("p", ("table", "article", "div", "section", "li", "td"))
            if tag in ITEMS:
                for other in (("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)):
                    close(other, ITEMS[tag])
            flush()
            if tag not in VOID:
                top = stack[-1]
                stack.append(Node(tag, top, top.chrome or is_chrome(tag, m[3], top.marked), top.marked or tag in ("article", "main")))
                opened[tag] += 1
                top.children.append(stack[-1])
                nodes.append(stack[-1])
    flush()
    return blocks, nodes


def beside(x: Node, best: Node, near: bool) -> bool:
    """Whether a sibling of the best container (``near``), or of one of the
    containers around it, belongs to the article: few links, and a fair share
    of the points or, beside the best container itself, a heading or a
    paragraph of its own."""
    if x.chrome or not x.chars or x.linked > LINKED_SHARE * x.chars:
        return False
    if x.points >= SIBLING_SHARE * best.points > 0:
        return True
    if x.tag in _HEADINGS:
        return near and not x.linked
    return near and (x.chars > 80 if x.tag == "p" else any(c.tag in ("p", "blockquote", "pre") and c.points for c in x.children))


def main_text(page: str | None) -> str:
    """The article of a page as one line of text; empty if there is none."""
    blocks, nodes = read(page or "")
    good = [b for b in blocks if not b[1].chrome]
    for s, node, linked in good:
        node.chars += len(s)
        node.linked += linked
        if len(s) >= LEAST_CHARS and node.tag in PARAGRAPHS | {"#", "body"}:
            points = 1 + s.count(",") + min(len(s) / 100, 3)
            node.points += points
            home = node.parent if node.tag in ("p", "pre", "td", "blockquote", "li", "dd") and node.parent else node
            home.score += points
            if home.parent:
                home.parent.score += points / 2
    for x in reversed(nodes):                       # totals, children before parents
        if x.parent:
            x.parent.chars += x.chars
            x.parent.linked += x.linked
            x.parent.points += x.points
    ranked = [x for x in nodes if x.score > 0]
    if not ranked:
        marked = [x for x in nodes if x.tag in ("article", "main") and x.chars]
        if not marked:
            return " ".join(s for s, _, linked in good if linked < len(s) / 2)
        best = max(marked, key=lambda x: x.chars)
    else:
        best = max(ranked, key=lambda x: x.score * x.unlinked())
    up = best                                       # a marked article round the best container is the container
    while up and up.tag not in ("article", "main"):
        up = up.parent
    best = up or best
    best.kept = True
    if not up:
        at = best
        while at.parent:
            for x in at.parent.children:
                x.kept = x.kept or x is not at and beside(x, best, at is best)
            at = at.parent
    for x in nodes:                                 # parents before children
        x.kept = x.kept or x.parent is not None and x.parent.kept
    return " ".join(s for s, node, _ in good if node.kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row, in one map without a
    shuffle.  Null html gives an empty text; repeated rows and null ids are
    passed through; other columns are ignored; pages are never cut."""
    def run(batches):
        for batch in batches:
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])
    d = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"),
                     F.col(f"`{html_col}`").alias("html"))
    return d.mapInArrow(run, "page_id long, url string, text string, n_chars long")
