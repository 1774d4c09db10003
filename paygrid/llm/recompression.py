"""Removal of long repeated word passages by recompression.

Every document is parsed in rounds.  A round names maximal runs of one symbol
and then pairs of neighbouring symbols whose name bits say (left, right).
Names are 64-bit hashes of what they stand for, so all tasks name alike
without a dictionary, and equal word sequences get equal symbols except near
their ends.  For each symbol the span of words that decided it is kept: a
window of ``size`` words that holds this span has the symbol wherever the
window occurs.  A window's anchor is the least such symbol (by hash), or the
window's own hash if it has none.

An anchor is named by its symbol and all words of that span.  Consecutive
windows with one anchor form a row ``(sym, span, lo, hi)``, about
one for 13 words; ``span`` is the hash of all words these windows cover.
Symbols that occur once end there.  Of the others, rows with an equal span
are repeats as a whole; where the spans of a symbol differ, the windows
themselves are compared by hash.  Counting is by grouped sums throughout.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paygrid.llm.filters import bitmap_of, may_hold
from paygrid.llm.words import mix, split
from paygrid.session import write_out

WINDOW = 35
ROUNDS = 2
_U = np.uint64
PRIME = _U((1 << 31) - 1)
BASES = (1_103_515_245, 48_271)


def parse(h: np.ndarray, bounds: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(symbols, first, last)`` of rows of words: the words that decided each
    symbol are ``first .. last``; an end of the row counts as the word outside."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    sym, lo, hi = h, np.arange(len(h)), np.arange(len(h))

    def neighbours(row, lo, hi):
        """First word of what decided the left neighbour, last of the right one."""
        left, right = np.empty_like(lo), np.empty_like(hi)
        if len(row):
            same = row[1:] == row[:-1]
            left[0], right[-1] = bounds[row[0]] - 1, bounds[row[-1] + 1]
            left[1:] = np.where(same, lo[:-1], bounds[row[1:]] - 1)
            right[:-1] = np.where(same, hi[1:], bounds[row[:-1] + 1])
        return left, right

    for r in range(rounds):
        # runs: a maximal run is known by the symbols beside it
        left, right = neighbours(row, lo, hi)
        new = np.ones(len(sym), bool)
        new[1:] = (sym[1:] != sym[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        end = np.append(at[1:], len(sym)) - 1
        times = (end - at + 1).astype(np.uint64)
        sym = np.where(times > 1, mix(sym[at] + times * _U(0xA24BAED4963EE407)), sym[at])
        row, lo, hi = row[at], left[at], right[end] if len(at) else right
        # pairs: a left symbol joins a right one that follows it
        left, right = neighbours(row, lo, hi)
        is_right = (mix(sym ^ _U(0x9FB21C651E98DF25 + r)) & _U(1)).astype(bool)
        joins = np.zeros(len(sym), bool)
        joins[:-1] = ~is_right[:-1] & is_right[1:] & (row[1:] == row[:-1])
        joined = np.zeros(len(sym), bool)
        joined[1:] = joins[:-1]
        at = np.flatnonzero(~joined)
        pair = joins[at]
        nxt = np.minimum(at + 1, max(len(sym) - 1, 0))
        first = np.where(pair | ~is_right[at], lo[at], left[at])
        last = np.where(pair, hi[nxt], np.where(is_right[at], hi[at], right[at]))
        sym = np.where(pair, mix(sym[at] * _U(0xD6E8FEB86659FD93) + sym[nxt]), sym[at])
        row, lo, hi = row[at], first, last
    return sym, lo, hi


class Spans:
    """Hashes of arbitrary word ranges from prefix sums: polynomials modulo the
    prime 2^31 - 1 at two bases (62 bits), whose sums and products fit 64 bits.
    A power of two as modulus would make patterns of long range collide."""

    def __init__(self, h: np.ndarray):
        self.sums, self.down = [], []
        for k, base in enumerate(BASES):
            part = (h >> _U(32 * k) & _U(0xFFFFFFFF)) % PRIME
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * powers(base, len(h)) % PRIME)]))
            self.down.append(powers(pow(base, -1, int(PRIME)), len(h) + 1))

    def hash(self, lo: np.ndarray, end: np.ndarray) -> np.ndarray:
        x, y = ((s[end] - s[lo]) % PRIME * d[lo] % PRIME for s, d in zip(self.sums, self.down, strict=True))
        return mix((x << _U(31) | y) ^ mix((end - lo).astype(np.uint64) * _U(0xA24BAED4963EE407)))


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo ``PRIME``."""
    out, size = np.ones(max(n, 1), np.uint64), 1
    while size < n:
        step = _U(pow(base, size, int(PRIME)))
        more = min(size, n - size)
        out[size:size + more] = out[:more] * step % PRIME
        size += more
    return out[:n]


def least_in(keys: np.ndarray, lo: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Index of the first least key in each range ``lo .. end - 1`` (not empty)."""
    table, span = [np.arange(len(keys))], 1
    width = int((end - lo).max()) if len(lo) else 0
    while 2 * span <= width:
        t = table[-1]
        a, b = t[:-span], t[span:]
        table.append(np.where(keys[a] <= keys[b], a, b))
        span *= 2
    level = np.frexp((end - lo).astype(float))[1] - 1
    out = np.empty(len(lo), np.int64)
    for k, t in enumerate(table):
        m = level == k
        a, b = t[lo[m]], t[end[m] - (1 << k)]
        out[m] = np.where(keys[a] <= keys[b], a, b)
    return out


def anchors(h: np.ndarray, bounds: np.ndarray, size: int, rounds: int):
    """``(row, sym, span, lo, hi)`` arrays; ``lo``/``hi`` are first words of windows."""
    sym, first, last = parse(h, bounds, rounds)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    s = np.flatnonzero(np.arange(len(h)) + size <= bounds[row + 1]) if len(h) else np.zeros(0, np.int64)
    a = np.searchsorted(first, s, "left")
    b = np.searchsorted(last, s + size - 1, "right")
    has = b > a
    pick = -1 - s                              # no symbol: the window stands for itself
    pick[has] = least_in(mix(sym), a[has], b[has])
    new = np.ones(len(s), bool)
    new[1:] = (pick[1:] != pick[:-1]) | (row[s[1:]] != row[s[:-1]])
    at = np.flatnonzero(new)
    lo = s[at]
    hi = s[np.append(at[1:], len(s)) - 1] if len(s) else lo
    own = pick[at]
    spans, sure = Spans(h), np.maximum(own, 0)
    span = spans.hash(lo, hi + size)
    if not len(at):
        return row[lo], span, span, lo, hi
    # named with all words that decided the symbol: a symbol of a few common words is no sign of a repeat
    inner = own >= 0
    name = np.where(inner, mix(sym[sure] ^ spans.hash(np.where(inner, first[sure], 0), np.where(inner, last[sure] + 1, 0))), ~span)
    return row[lo], name, span, lo, hi


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def read(docs: DataFrame, size: int, rounds: int) -> DataFrame:
    """``(doc_id, key, n_words, sha256, sym, span, lo, hi)`` of every row."""
    def run(batches):
        for batch in batches:
            n, sha, count, parts = [], [], [], []
            for w in split(batch.column(2)):
                for _, a, b in w.rows():
                    n.append(b - a)
                    sha.append(_sha(w.joined(a, b)))
                row, sym, span, lo, hi = anchors(w.hashes, w.bounds, size, rounds)
                count.append(np.bincount(row, minlength=len(w.bounds) - 1))
                start = w.bounds[row]
                parts.append((sym.view(np.int64), span.view(np.int64), (lo - start).astype(np.int32), (hi - start).astype(np.int32)))
            off = pa.array(np.cumsum(np.concatenate([[0], *count])).astype(np.int32))
            lists = [pa.ListArray.from_arrays(off, pa.array(np.concatenate(c))) for c in zip(*parts, strict=True)] if parts else [
                pa.array([], pa.list_(t)) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.string()), *lists],
                                             names=["doc_id", "key", "n_words", "sha256", "sym", "span", "lo", "hi"])
    return docs.select("doc_id", "key", "text").mapInArrow(
        run, "doc_id long, key long, n_words long, sha256 string, sym array<long>, span array<long>, lo array<int>, hi array<int>")


def kept(w, a: int, b: int, whole, at, size: int) -> tuple[int, bytes]:
    """Words removed from words ``a .. b - 1`` of a slice, and the others joined."""
    d = np.zeros(b - a + 1, np.int64)
    for p in whole or []:
        d[p["lo"]] += 1
        d[p["hi"] + size] -= 1
    s = np.array(at or [], np.int64)
    np.add.at(d, s, 1)
    np.add.at(d, s + size, -1)
    keep = np.cumsum(d)[:-1] == 0
    return int((~keep).sum()), w.joined(a, b, keep)


def window_hashes(texts: DataFrame, size: int, keep_text: bool) -> DataFrame:
    """``(key, text, whole, part)`` with the hashes of the windows in the
    ranges of ``part``, their places, and whether two places are known.  If
    all are, the result of the row stands there in place of its text."""
    def run(batches):
        for batch in batches:
            whole, part = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            hs, ss, ws, texts, results = [], [], [], batch.column(1).to_pylist(), []
            for w in split(batch.column(1)):
                spans = Spans(w.hashes)
                for k, a, b in w.rows():
                    s = np.concatenate([np.zeros(0, np.int64), *[np.arange(p["lo"], p["hi"] + 1) for p in part[k]]])
                    hs.append(spans.hash(s + a, s + a + size).view(np.int64))
                    ss.append(s)
                    ws.append(np.repeat([p["known"] for p in part[k]], [p["hi"] - p["lo"] + 1 for p in part[k]]).astype(bool))
                    if all(p["known"] for p in part[k]):
                        n, text = kept(w, a, b, whole[k], None, size)
                        results.append((n, _sha(text), text.decode() if keep_text else None))
                        texts[k] = None
                    else:
                        results.append((None, None, None))
            off = pa.array(np.cumsum([0, *map(len, hs)]).astype(np.int32))
            flat = lambda x, t: pa.ListArray.from_arrays(off, pa.array(np.concatenate(x) if x else [], t))
            done = list(zip(*results, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), batch.column(2), flat(hs, pa.int64()), flat(ss, pa.int32()), flat(ws, pa.bool_()),
                 pa.array(done[0], pa.int64()), pa.array(done[1], pa.string()), pa.array(done[2], pa.string())],
                names=["key", "text", "whole", "h", "s", "known", "n_removed", "kept_sha256", "kept_text"])
    return texts.mapInArrow(run, "key long, text string, whole array<struct<lo:int,hi:int>>, h array<long>, s array<int>, "
                                 "known array<boolean>, n_removed long, kept_sha256 string, kept_text string")


def cut(texts: DataFrame, size: int, keep_text: bool) -> DataFrame:
    """Words left in ``(key, text, whole, at)`` once the windows of the ranges
    ``whole`` and those starting at ``at`` are taken out."""
    def run(batches):
        for batch in batches:
            whole, at = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            removed, sha, left = [], [], []
            for w in split(batch.column(1)):
                for k, a, b in w.rows():
                    n, text = kept(w, a, b, whole[k], at[k], size)
                    removed.append(n)
                    sha.append(_sha(text))
                    left.append(text.decode() if keep_text else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(sha, pa.string()),
                                              pa.array(left, pa.string())], names=["key", "n_removed", "kept_sha256", "kept_text"])
    return texts.mapInArrow(run, "key long, n_removed long, kept_sha256 string, kept_text string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW,
                   rounds: int = ROUNDS, keep_text: bool = False) -> DataFrame:
    """One row per input row: ``(doc_id, n_words, n_removed, kept_sha256)``,
    with ``keep_text`` also the kept words of documents that lost some.

    Every word is removed that a window of ``size`` words covers whose
    sequence also starts at another place, in the same or another row; a
    document with a copy loses all its words if it has ``size`` or more.
    Null and blank texts have no words; repeated rows and null ids are passed
    through; other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).withColumn(
        "key", F.xxhash64("doc_id", "text"))
    base = write_out(read(docs, size, rounds), "anchors", compression="zstd")
    every = base.select("key", F.explode(F.arrays_zip("sym", "span", "lo", "hi")).alias("a")).select("key", "a.*")
    # merge joins where both sides grow with the documents: one plan at every size, hot keys can be split
    often = write_out(every.groupBy("sym").agg(F.count("*").alias("times")).where("times > 1").select("sym"), "shared-symbols")
    found = write_out(may_hold(every, "sym", bitmap_of(often, "sym")).join(often.hint("merge"), "sym"), "shared-anchors")

    kinds = found.groupBy("sym", "span").agg(F.count("*").alias("times"), F.min(F.struct("key", "lo")).alias("one"))
    mixed = kinds.groupBy("sym").agg((F.count("*") > 1).alias("mixed"))
    kinds = kinds.join(mixed, "sym").where("times > 1 or mixed")
    role = found.join(kinds.hint("merge"), ["sym", "span"])
    whole = F.when(F.col("times") > 1, F.struct("lo", "hi"))
    part = F.when(F.col("mixed") & (F.col("one") == F.struct("key", "lo")),
                  F.struct("lo", "hi", (F.col("times") > 1).alias("known")))
    ranges = write_out(role.groupBy("key").agg(F.collect_set(whole).alias("whole"), F.collect_set(part).alias("part")), "ranges")
    texts = may_hold(docs.select("key", "text"), "key", bitmap_of(ranges, "key")).join(ranges.hint("merge"), "key")
    # a document is settled if its windows are repeats as a whole; only the others wait for the counts
    held = write_out(window_hashes(texts.select("key", "text", "whole", "part"), size, keep_text), "window-hashes", compression="zstd")

    place = held.select("key", F.explode(F.arrays_zip("h", "s", "known")).alias("w")).select("key", "w.*")
    # places known twice over count double; a repeated row only has such places
    twice = place.groupBy("h").agg(F.sum(F.when(F.col("known"), 2).otherwise(1)).alias("times")).where("times > 1").select("h")
    at = place.where("not known").join(twice, "h").groupBy("key").agg(F.collect_set("s").alias("at"))
    late = cut(held.where("text is not null").select("key", "text", "whole").join(at.hint("merge"), "key", "left"), size, keep_text)
    done = held.where("text is null").select("key", "n_removed", "kept_sha256", "kept_text").union(late).dropDuplicates(["key"])
    return base.select("doc_id", "key", "n_words", "sha256").join(done, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"), *(["kept_text"] if keep_text else []))
