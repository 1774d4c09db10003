"""Landed HTML pages, parsed once each.

Every operator here is one ``mapInArrow`` pass over the pages (a bounded number
of characters of a batch at a time, one page after the other) and no shuffle: a page is one row, so the
element tree of a page, its main content, its markdown and its salary text are
found where the page is read.  ``page_blocks`` gives the element table itself
(own text and source span of each element, so it grows with the page, not with
its depth).
"""

from __future__ import annotations

import html as _html
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paygrid import rules as R
from paygrid.arrow import spans, text_sizes
from paygrid.functions import salary as SAL

# FIXED VALUES: elements without content, text-free elements, page chrome
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SILENT = {"script", "style", "template"}
CHROME = {"script", "style", "nav", "header", "footer", "noscript"}
ARROW = {"int": pa.int32(), "string": pa.string()}
CHUNK, CHUNK_PAGES = 4 << 20, 512      # bytes of HTML and pages whose rows a task holds at a time
_WS = re.compile(r"\s{2,}|[^\S ]")      # white space that is not one space already


class Node:
    """An element: place in the tree, source span, and its range of the page's text chunks."""

    __slots__ = ("id", "parent", "pos", "depth", "tag", "attrs", "start", "end", "first", "last", "own", "kids", "chrome", "silent")

    def __init__(self, id_, parent, tag, attrs, start, first):
        self.id, self.parent, self.tag, self.attrs, self.start, self.first = id_, parent, tag, attrs, start, first
        self.end = self.last = None
        self.own, self.kids = [], []
        self.pos = len(parent.kids) if parent else 0
        self.depth = parent.depth + 1 if parent else 0
        self.chrome = bool(parent and parent.chrome) or tag in CHROME
        self.silent = bool(parent and parent.silent) or tag in SILENT


class Tree(HTMLParser):
    """Elements of a page and its stripped text chunks in order."""

    def __init__(self, src: str, markdown: _Markdown | None = None):
        super().__init__(convert_charrefs=True)
        self.src, self.markdown = src, markdown          # a converter that sees the same parse
        self.line_starts = [0] + [m.end() for m in re.finditer("\n", src)]
        self.chunks: list[tuple[str, bool]] = []
        self.nodes = [Node(0, None, "[document]", {}, 0, 0)]
        self.stack = [self.nodes[0]]
        self.feed(src)
        self.close()
        for n in self.stack:
            self._end(n, len(src))

    def _offset(self) -> int:
        line, col = self.getpos()
        return self.line_starts[line - 1] + col

    def _end(self, node: Node, at: int) -> None:
        node.end, node.last = at, len(self.chunks)

    def handle_starttag(self, tag, attrs):
        if self.markdown:
            self.markdown.handle_starttag(tag, attrs)
        parent = self.stack[-1]
        node = Node(len(self.nodes), parent, tag, dict(attrs), self._offset(), len(self.chunks))
        parent.kids.append(node)
        self.nodes.append(node)
        if tag in VOID:
            self._end(node, node.start + len(self.get_starttag_text() or ""))
        else:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.markdown:
            self.markdown.handle_endtag(tag)
        if tag not in VOID:
            node = self.stack.pop()
            self._end(node, node.start + len(self.get_starttag_text() or ""))

    def handle_endtag(self, tag):
        if self.markdown:
            self.markdown.handle_endtag(tag)
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                end = self.src.find(">", self._offset())
                for node in self.stack[i:]:
                    self._end(node, len(self.src) if end < 0 else end + 1)
                del self.stack[i:]
                return

    def handle_data(self, data):
        if self.markdown:
            self.markdown.handle_data(data)
        piece, top = data.strip(), self.stack[-1]
        if piece and not top.silent:
            top.own.append(piece)
            self.chunks.append((piece, top.chrome))

    def text(self, node: Node, chrome: bool = True) -> str:
        """Text of an element and all below it, with or without page chrome."""
        got = self.chunks[node.first:node.last]
        return " ".join(" ".join(t for t, c in got if chrome or not c).split())


def parse(src: str | None, unescape: bool = False) -> Tree | None:
    return None if src is None else Tree(_html.unescape(src) if unescape else src)


def _map_pages(pages: DataFrame, html_col: str, keep: list[str], schema: str, rows) -> DataFrame:
    """``rows(html)`` yields tuples of ``schema``; the ``keep`` columns of the page stand before them."""
    src = pages.select(*keep, F.col(html_col).alias("_html"))
    new = T._parse_datatype_string(schema)
    out = T.StructType([f for f in src.schema.fields if f.name != "_html"] + new.fields)
    names, kinds, at = out.fieldNames(), [ARROW[f.dataType.simpleString()] for f in new], len(keep)

    def run(batches):
        for batch in batches:
            for i, j in spans(text_sizes(batch.column(at)), CHUNK, CHUNK_PAGES):
                part = batch.slice(i, j - i)
                got = [(n, *r) for n, h in enumerate(part.column(at).to_pylist()) for r in rows(h)]
                which, *columns = zip(*got) if got else [()] * (1 + len(kinds))
                which = pa.array(which, pa.int32())
                yield pa.RecordBatch.from_arrays([*(c.take(which) for c in part.columns[:at]), *map(pa.array, columns, kinds)], names=names)

    return src.mapInArrow(run, out)


def page_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", unescape: bool = False) -> DataFrame:
    """One row per element of every page (plus a ``[document]`` root, node 0);
    ``text`` is the element's own text, without that of its children."""
    def rows(src):
        t = parse(src, unescape)
        for n in t.nodes if t else []:
            yield (n.id, n.parent.id if n.parent else -1, n.pos, n.depth, n.tag, n.attrs.get("id"), n.attrs.get("class"),
                   " ".join(" ".join(n.own).split()), n.start, n.end)
    p = pages.withColumn("page_id", F.col(id_col).cast("long"))
    return _map_pages(p, html_col, ["page_id"], "node_id int, parent_id int, pos int, depth int, tag string, attr_id string, "
                      "attr_class string, text string, src_start int, src_end int", rows)


# ---------------------------------------------------------------- main content

def _tier(node: Node) -> int | None:
    cls = node.attrs.get("class") or ""
    if node.tag == "div":
        return (1 if node.attrs.get("id") == "content" else 2 if re.search(R.DESCRIPTION_CLASS, cls, re.I)
                else 3 if re.search(R.BODY_CLASS, cls, re.I) else 4 if node.attrs.get("id") == "app_body" else None)
    return {"main": 5, "article": 6, "body": 7}.get(node.tag)


def main_node(tree: Tree) -> tuple[int, Node] | None:
    """First hit wins: div#content, div.job-description, div.*body*,
    div#app_body, main, article, body (without chrome)."""
    return min(((t, n) for n in tree.nodes if (t := _tier(n))), key=lambda x: (x[0], x[1].id), default=None)


def main_content(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(page_id, tier, node_id, text, src_start, src_end, markdown)`` of each page; texts are '' without a hit."""
    def rows(src):
        t = parse(src)
        hit = main_node(t) if t else None
        if not hit:
            return [(None, None, "", None, None, "")]
        tier, n = hit
        return [(tier, n.id, t.text(n, chrome=tier != 7), n.start, n.end, to_markdown(src[n.start:n.end], tier == 7))]
    p = pages.withColumn("page_id", F.col(id_col).cast("long"))
    return _map_pages(p, html_col, ["page_id"], "tier int, node_id int, text string, src_start int, src_end int, markdown string", rows)


def main_content_markdown(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    return main_content(pages, id_col, html_col).select("page_id", "tier", "markdown")


# ---------------------------------------------------------------- markdown

_BLANKS = re.compile(r"\n{3,}")
_LINE_WS = re.compile(r"[ \t]+\n")


class _Markdown(HTMLParser):
    """Subset converter: headings, bullets, bold/italic, paragraphs, breaks;
    no links targets, no images, no wrapping."""

    BLOCK = {"p", "div", "section", "article", "main", "table", "tr", "ul", "ol", "body", "blockquote"}

    def __init__(self, drop_chrome: bool):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.drop = CHROME if drop_chrome else SILENT
        self.lists: list[int | None] = []        # next number of each open list; None: bullets

    def _nl(self, n: int):
        self.out.append("\n" * n)

    def handle_starttag(self, tag, attrs):
        if tag in self.drop:
            self.skip += 1
            return
        if self.skip:
            return
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self._nl(2)
            self.out.append("#" * int(tag[1]) + " ")
        elif tag == "li":
            self._nl(1)
            number = self.lists[-1] if self.lists else None
            self.out.append("  " * max(len(self.lists) - 1, 0) + ("* " if number is None else f"{number}. "))
            if number is not None:
                self.lists[-1] += 1
        elif tag in ("ul", "ol"):
            self.lists.append(1 if tag == "ol" else None)
            self._nl(1)
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("_")
        elif tag == "br":
            self._nl(1)
        elif tag in self.BLOCK:
            self._nl(2)

    def handle_endtag(self, tag):
        if tag in self.drop:
            self.skip = max(self.skip - 1, 0)
            return
        if self.skip:
            return
        if tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self._nl(1)
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6") or tag in self.BLOCK:
            self._nl(2)
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("_")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(_WS.sub(" ", data))

    def text(self) -> str:
        return _BLANKS.sub("\n\n", _LINE_WS.sub("\n", "".join(self.out)).strip())


def to_markdown(src: str | None, drop_chrome: bool = False) -> str:
    if not src:
        return ""
    m = _Markdown(drop_chrome)
    m.feed(_html.unescape(src))
    m.close()
    return m.text()


def html_to_markdown(df: DataFrame, html_col: str = "html", keep: list[str] | None = None,
                     drop_chrome: bool = False) -> DataFrame:
    """One pass: unescape, convert, collapse 3+ newlines to 2."""
    return _map_pages(df, html_col, keep or [], "markdown string", lambda h: [(to_markdown(h, drop_chrome),)])


# ---------------------------------------------------------------- salary block

_SENTENCE = re.compile(R.COMPENSATION_SENTENCE, re.I)
_HEADING = re.compile("|".join(f"(?:{p})" for p in R.SALARY_HEADINGS), re.I)
_MENTION = re.compile(R.SALARY_MENTION, re.I)
_RANGE = re.compile(SAL.RANGE)
_CODE = re.compile(R.CURRENCY_CODE)


def _looks(text: str) -> bool:
    return bool(text) and bool(_RANGE.search(text) or _CODE.search(text))


def salary_text(tree: Tree) -> str | None:
    """Salary text of a page, first stage that yields wins:

    1. the sentence ``Compensation will be ... $... .`` in the page text;
    2. for salary-heading elements in document order: the parent's text if it
       looks like salary, 3. else the parent's next <= 8 element siblings,
       joined until they do;
    4. 500 characters from the first salary mention, if they look like salary;
    5. +-80 characters around the first salary range.
    """
    plain = tree.text(tree.nodes[0])
    if m := _SENTENCE.search(plain):
        return m[0]
    for n in tree.nodes:
        if n.tag not in R.SALARY_BLOCK_TAGS or not _HEADING.search(tree.text(n)):
            continue
        text = tree.text(n.parent)
        if _looks(text):
            return text
        joined: list[str] = []
        for sibling in n.parent.parent.kids[n.parent.pos + 1:n.parent.pos + 1 + R.SALARY_SIBLINGS] if n.parent.parent else []:
            if text := tree.text(sibling):
                joined.append(text)
                if _looks(" ".join(joined)):
                    return " ".join(joined)
    if (m := _MENTION.search(plain)) and _looks(near := plain[m.start():m.start() + R.SALARY_WINDOW]):
        return near
    if m := _RANGE.search(plain):
        return plain[max(0, m.start() - R.SALARY_CONTEXT):m.end() + R.SALARY_CONTEXT]
    return None


def salary_block(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", unescape: bool = False) -> DataFrame:
    """``(page_id, salary_block)`` of each page."""
    def rows(src):
        t = parse(src, unescape)
        return [(salary_text(t) if t else None,)]
    p = pages.withColumn("page_id", F.col(id_col).cast("long"))
    return _map_pages(p, html_col, ["page_id"], "salary_block string", rows)


def board_content(jobs: DataFrame, html_col: str = "content_html") -> DataFrame:
    """All columns of ``jobs`` but the HTML, plus ``salary_block`` and
    ``description_md`` found in one parse of each body."""
    def rows(src):
        if src is None:
            return [(None, "")]
        md = _Markdown(False)
        return [(salary_text(Tree(_html.unescape(src), md)), md.text())]
    return _map_pages(jobs, html_col, [c for c in jobs.columns if c != html_col], "salary_block string, description_md string", rows)


def salary_pages(postings: DataFrame) -> DataFrame:
    """Salary texts wrapped in small page templates (test input)."""
    t = F.coalesce(F.col("salary_text"), F.lit(""))
    html = (F.when(F.col("k") % 3 == 0, F.concat(F.lit("<div><h3>Salary</h3><p>"), t, F.lit("</p></div>")))
            .when(F.col("k") % 3 == 1, F.concat(F.lit("<section><div>Pay: "), t, F.lit("</div></section>")))
            .otherwise(t))
    return postings.select(F.col("k").alias("page_id"), "job_id", html.alias("html"))
