"""Maximal periodic runs of words: suffix trees, constant-time LCE, Lyndon roots.

A run is a stretch of words with smallest period ``q`` that no neighbouring
word extends.  Its first Lyndon rotation, under one of the two orders of the
alphabet, is the longest Lyndon word at the place where it starts; so the
places ``i`` and the next smaller suffix ``j`` of both orders are candidates
with period ``j - i``, at most two per word.  Each is extended to both sides
by longest common extensions: string depths of lowest common ancestors in the
suffix tree of the words and in that of their reversal.

Trees are built (Ukkonen) only over words that can be in a run: a run of
length ``L >= max(least, times * q)`` has ``L - q >= least - least // times``,
so windows of that many words repeat inside the document and cover the run
without a gap.  Documents go through one pass without a shuffle; a task holds
one document's trees at a time (about 700 bytes per word of its longest
repeating stretch).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paygrid.llm.words import gram_hashes, mix, split

LEAST, TIMES = 24, 3           # words of a run at least, and periods
SLICE = 256 << 10              # bytes of text looked at together
_U = np.uint64


def suffix_tree(s: list[int]) -> tuple[np.ndarray, np.ndarray, list[int], list[int], list[int]]:
    """Ukkonen's tree of ``s``, whose last symbol 0 stands nowhere else.

    Returns keys ``node * width + symbol`` and the children they lead to, the
    edges' first and end places, and the suffix of each leaf (-1 inside).
    """
    n, width = len(s), max(s) + 1
    begin, end, link, leaf = [0], [0], [0], [-1]
    go: dict[int, int] = {}
    node = edge = length = remain = leaves = 0
    for i, c in enumerate(s):
        linked = 0
        remain += 1
        while remain:
            if not length:
                edge = i
            key = node * width + s[edge]
            child = go.get(key)
            if child is None:
                go[key] = len(begin)
                begin.append(i)
                end.append(n)
                link.append(0)
                leaf.append(leaves)
                leaves += 1
                if linked:
                    link[linked] = node
                linked = node
            else:
                at = begin[child]
                size = end[child] - at
                if length >= size:
                    node, edge, length = child, edge + size, length - size
                    continue
                if s[at + length] == c:
                    length += 1
                    if linked:
                        link[linked] = node
                    break
                inner = len(begin)
                go[key] = inner
                go[inner * width + c] = inner + 1
                begin += (at, i)
                end += (at + length, n)
                link += (0, 0)
                leaf += (-1, leaves)
                leaves += 1
                begin[child] = at + length
                go[inner * width + s[at + length]] = child
                if linked:
                    link[linked] = inner
                linked = inner
            remain -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - remain + 1
    return np.fromiter(go.keys(), np.int64, len(go)), np.fromiter(go.values(), np.int64, len(go)), begin, end, leaf


def tour(tree, width: int, falling: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Leaves in the order of the Euler tour, and the depth of the node at
    which the tour turns from the leaf before to each.  Children go by symbol,
    rising or ``falling``; the end of the string is least in both."""
    keys, child, begin, end, leaf = tree
    order = np.argsort(keys - keys % width + (width - keys % width) % width if falling else keys)
    parent, child = keys[order] // width, child[order]
    first = np.searchsorted(parent, np.arange(len(begin) + 1)).tolist()
    child = child.tolist()
    out, turns = [], []
    stack = [(0, 0, 0)]
    while stack:
        node, above, turn = stack.pop()
        if leaf[node] >= 0:
            out.append(leaf[node])
            turns.append(turn)
            continue
        depth = above + end[node] - begin[node]
        lo = first[node]
        for k in range(first[node + 1] - 1, lo, -1):
            stack.append((child[k], depth, depth))
        stack.append((child[lo], depth, turn))
    return np.array(out, np.int64), np.array(turns, np.int64)


class Extensions:
    """Longest common extensions in constant time: range minima over the
    turning depths of the tour, by a sparse table."""

    def __init__(self, leaves: np.ndarray, turns: np.ndarray):
        self.rank = np.empty(len(leaves), np.int64)
        self.rank[leaves] = np.arange(len(leaves))
        self.levels, span = [turns.astype(np.int32)], 1
        while 2 * span <= len(turns):
            t = self.levels[-1]
            self.levels.append(np.minimum(t[:-span], t[span:]))
            span *= 2

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common length of the suffixes at ``a`` and ``b`` (never equal)."""
        a, b = self.rank[a], self.rank[b]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((hi - lo).astype(float))[1] - 1
        out = np.empty(len(lo), np.int64)
        for k, t in enumerate(self.levels):
            m = level == k
            out[m] = np.minimum(t[lo[m]], t[hi[m] - (1 << k)])
        return out


def next_smaller(rank: list[int]) -> list[int]:
    """For each suffix but the last the next one of smaller rank: the end of
    the longest Lyndon word that starts there."""
    n = len(rank) - 1
    out, stack = [n] * n, [n]
    for i in range(n - 1, -1, -1):
        r = rank[i]
        while rank[stack[-1]] > r:
            stack.pop()
        out[i] = stack[-1]
        stack.append(i)
    return out


def runs(words: list, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of ``words`` with length at
    least ``least`` and ``times`` periods (two or more), by start, period."""
    n = len(words)
    if n < max(least, 2):
        return []
    number: dict = {}
    s = [number.setdefault(w, len(number) + 1) for w in words]
    width = len(number) + 1
    tree = suffix_tree([*s, 0])
    forward = Extensions(*tour(tree, width))
    fallen, _ = tour(tree, width, falling=True)
    del tree
    rank = np.empty(n + 1, np.int64)
    rank[fallen] = np.arange(n + 1)
    ends = np.array([next_smaller(forward.rank.tolist()), next_smaller(rank.tolist())], np.int64).ravel()
    backward = Extensions(*tour(suffix_tree([*s[::-1], 0]), width))
    i = np.tile(np.arange(n), 2)
    p = ends - i
    i, p, ends = (x[p <= n // times] for x in (i, p, ends))
    after = np.zeros(len(i), np.int64)
    inside = ends < n
    after[inside] = forward(i[inside], ends[inside])
    before = backward(n - i, n - ends)             # the reversal of the words before a place starts at n - place
    start, length = i - before, ends + after - i + before
    good = (length >= least) & (length >= times * p)
    return sorted(set(zip(start[good].tolist(), length[good].tolist(), p[good].tolist(), strict=True)), key=lambda r: (r[0], r[2]))


def repeating(h: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end places of the stretches of words that windows of ``size``
    words cover whose hashes repeat within their row."""
    n = len(h)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(np.arange(n) + size <= bounds[row + 1]) if n else np.zeros(0, np.int64)
    g = gram_hashes(h, size)[at] ^ mix(row[at].astype(np.uint64) + _U(1)) if len(at) else np.zeros(0, np.uint64)
    order = np.argsort(g)
    same = g[order][1:] == g[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, at[again], 1)
    np.add.at(cover, at[again] + size, -1)
    held = np.cumsum(cover)[:-1] > 0
    edge = np.ones(n + 1, bool)
    edge[1:n] = held[1:] != held[:-1]
    edge[bounds] = True
    places = np.flatnonzero(edge)
    lo, hi = places[:-1], places[1:]
    return (lo[held[lo]], hi[held[lo]]) if n else (lo[:0], hi[:0])


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact ratio of length to period; of equal
    ones the first by start, then period."""
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def collapsed(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay when each run keeps its first period."""
    d = np.zeros(n + 1, np.int64)
    for start, length, q in found:
        d[start + q] += 1
        d[start + length] -= 1
    return np.cumsum(d)[:-1] == 0


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Places of the words that a tenth of the documents repeat (all others,
    and null ids, keep their words: None)."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or not n or h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES,
                  places: Callable[[int | None, int], np.ndarray | None] | None = None, keep_text: bool = False) -> DataFrame:
    """One row per input row: ``(doc_id, n_runs, start, length, period,
    exponent_milli, runs_sha256, collapsed_sha256)``; with ``keep_text`` also
    ``runs`` (all of them) and ``collapsed`` (the kept words).

    Words are runs of characters other than ``[ \\t-\\r]``, numbered from 0;
    ``places(doc_id, n)`` may name the words to read in place of words 0 to
    n - 1.  The run shown is the one of greatest length / period (four nulls
    without a run).  ``runs_sha256`` covers the lines ``start,length,period``,
    ``collapsed_sha256`` the words left when each run keeps its first period.
    Null and blank texts have no words and no runs; repeated rows and null ids
    are passed through; an empty table gives no rows; other columns are
    ignored.
    """
    size = least - least // times

    def run(batches):
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for w in split(batch.column(1), size=SLICE):
                index = np.arange(len(w.hashes))
                for k, lo, hi in w.rows() if places else ():
                    at = places(ids[k], hi - lo)
                    if at is not None:
                        index[lo:hi] = lo + at
                first, end = repeating(w.hashes[index], w.bounds, size)
                begin = np.searchsorted(first, w.bounds)
                for r, (k, lo, hi) in enumerate(w.rows()):
                    words = w.joined(lo, hi).split()
                    if places:
                        words = [words[x] for x in (index[lo:hi] - lo).tolist()]
                    found = []
                    for a, b in zip(first[begin[r]:begin[r + 1]].tolist(), end[begin[r]:begin[r + 1]].tolist(), strict=True):
                        found += [(a - lo + x, y, q) for x, y, q in runs(words[a - lo:b - lo], least, times)]
                    best = strongest(found)
                    if found:
                        words = [x for x, stay in zip(words, collapsed(hi - lo, found).tolist(), strict=True) if stay]
                    text = b" ".join(words)
                    lines = "".join(f"{x},{y},{q}\n" for x, y, q in found)
                    row = (ids[k], len(found), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
                           hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest())
                    out.append((*row, [{"start": x, "length": y, "period": q} for x, y, q in found], text.decode()) if keep_text else row)
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], names=names)

    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    types = [*[pa.int64()] * 6, pa.string(), pa.string()]
    schema = ", ".join(f"{c} {'string' if c.endswith('sha256') else 'long'}" for c in names)
    if keep_text:
        names, schema = [*names, "runs", "collapsed"], schema + ", runs array<struct<start:long,length:long,period:long>>, collapsed string"
        types += [pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])), pa.string()]
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)
