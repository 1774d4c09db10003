"""Benchmark decontamination by template canonicalisation.

Words become template symbols: numbers, names (capitalised inside a sentence)
and units turn into typed placeholders, everything else into its lower-case
form without outer punctuation.  Windows of template symbols of benchmark
items and documents meet in a hash join, so a question with other numbers,
names or units still matches.  Along one alignment of a document with an item
every benchmark value must then stand for one document value.  Windows of the
literal words are joined beside them, whatever the words are, so copies of
items that are mostly numbers or names count too, and so do the equal parts of
alignments whose values disagree.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paygrid.llm.cascade import words_of
from paygrid.llm.filters import BUCKET, bitmap_of, may_hold
from paygrid.llm.words import _LOWER, _power, gram_hashes, mix, split
from paygrid.session import write_out

WINDOW = 8
LITERALS = 5                  # plain words that a window of 8 needs (in proportion for shorter items, 3 at least)
COVERED, SHARE = 13, 0.5      # item words covered along one alignment: this many, or this share of a short item
BITS = 23                     # size of the filter that spares most windows the join (2^23 bits, 1 MB)
FLAGGED_BROADCAST = 500_000   # rows of (key) that may be broadcast when documents are dropped
# Unit words.
UNITS = ("mm cm m km in ft yd mi inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres "
         "kilometer kilometers centimetre centimetres mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces "
         "ton tons ml l litre litres liter liters gallon gallons cup cups s sec second seconds min minute minutes h hr hour hours "
         "day days week weeks month months year years km/h mph percent % $ € £ dollar dollars cent cents euro euros degree degrees "
         "°c °f watt watts kwh volt volts joule joules newton newtons").split()
NUMBER, NAME, UNIT, LITERAL = (np.uint64(x) for x in (0x6E756D, 0x6E616D65, 0x756E6974, 0x6C6974 << 32))
_U = np.uint64
_BYTES = np.arange(256)
_INNER = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_STOP = np.isin(_BYTES, np.frombuffer(b".!?:", np.uint8))


def _unit_hashes() -> np.ndarray:
    out = []
    for u in UNITS:
        raw = np.frombuffer(u.encode(), np.uint8)
        out.append((_LOWER[raw] * _power("up", len(raw) + 1)[:len(raw)]).sum(dtype=np.uint64) ^ (_U(len(raw)) << _U(48)))
    return np.sort(mix(np.array(out, np.uint64)))


_UNIT_SET = _unit_hashes()


def symbols(w) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(bounds, template, value, is_slot)`` of the words of a slice; words
    without a letter or digit are skipped unless they are units."""
    data = w.data
    inner = np.flatnonzero(_INNER[data])
    a = np.searchsorted(inner, w.starts)
    b = np.searchsorted(inner, w.ends) - 1
    solid = b >= a
    first = np.where(solid, inner[np.minimum(a, max(len(inner) - 1, 0))] if len(inner) else w.starts, w.starts)
    end = np.where(solid, (inner[np.maximum(b, 0)] if len(inner) else w.starts) + 1, w.ends)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LOWER[data] * _power("up", len(data) + 1)[:len(data)])])
    value = mix(((sums[end] - sums[first]) * _power("down", len(data) + 1)[first]) ^ ((end - first).astype(np.uint64) << _U(48)))
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    number = digits[end] > digits[first]
    unit = np.isin(value, _UNIT_SET)
    at = np.minimum(first + 1, max(len(data) - 1, 0))
    wide = np.minimum(first + 2, max(len(data) - 1, 0))
    if len(data):
        head, second, third = data[first], data[at], data[wide]
        upper = ((head >= 65) & (head <= 90) & (second >= 97)) | ((head == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (third >= 97))
        opens = np.ones(len(first), bool)
        opens[1:] = _STOP[data[w.ends[:-1] - 1]]
        lines = np.concatenate([[0], np.cumsum(data == 10)])
        opens[1:] |= lines[w.starts[1:]] > lines[w.ends[:-1]]
        opens[w.bounds[:-1][w.bounds[:-1] < len(first)]] = True
        name = upper & ~opens & (end - first > 1)
    else:
        name = np.zeros(0, bool)
    template = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, value)))
    keep = solid | unit
    kept = np.concatenate([[0], np.cumsum(keep)])
    return kept[w.bounds], template[keep], value[keep], (number | unit | name)[keep]


def least_literals(n: int) -> int:
    return max(3, -(-LITERALS * n // WINDOW))


def windows(column: pa.Array, sizes: list[int], only: np.ndarray | None = None, whole: bool = False):
    """Per slice ``(row, size, literal, pos, hash, slots, length)`` of template
    windows with enough plain words and of all literal windows; ``only``: bits
    of the hashes to keep; ``whole``: a row shorter than ``WINDOW`` gives one
    window of all its words."""
    for w in split(column):
        bounds, template, value, slot = symbols(w)
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        plain = np.concatenate([[0], np.cumsum(~slot)])
        length = np.diff(bounds)
        for size, literal in product(sizes, (False, True)):
            h = mix(gram_hashes(value if literal else template, size) + _U(size) + (LITERAL if literal else _U(0)))
            p = np.arange(len(h))
            ok = p + size <= bounds[row[:len(h)] + 1]
            if not literal:
                ok &= plain[p + size] - plain[p] >= least_literals(size)
            if whole and size < WINDOW:
                ok &= length[row[:len(h)]] == size
            if only is not None:
                bit = (h >> _U(64 - BITS)).astype(np.int64)
                ok &= (only[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
            p = p[ok]
            yield (w.first + row[p], size, literal, p - bounds[row[p]], h[p].view(np.int64),
                   [value[i:i + size][slot[i:i + size]].view(np.int64).tolist() for i in p.tolist()], length[row[p]])


def window_rows(texts: DataFrame, sizes: list[int], only: np.ndarray | None, whole: bool) -> DataFrame:
    """``(id, key, size, literal, pos, hash, slots, tokens)`` of ``(id, key, text)``."""
    shared = texts.sparkSession.sparkContext.broadcast(only)

    def run(batches):
        for batch in batches:
            for row, size, literal, pos, h, slots, length in windows(batch.column(2), sizes, shared.value, whole):
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(np.full(len(row), size, np.int32)),
                     pa.array(np.full(len(row), literal)), pa.array(pos.astype(np.int32)), pa.array(h), pa.array(slots, pa.list_(pa.int64())), pa.array(length.astype(np.int32))],
                    names=["id", "key", "size", "literal", "pos", "hash", "slots", "tokens"])
    return texts.mapInArrow(run, "id long, key long, size int, literal boolean, pos int, hash long, slots array<long>, tokens int")


def bitmap_rows(bits: DataFrame) -> DataFrame:
    """``(bucket, bytes)`` of all bits set: at most 2^BITS / BUCKET rows of 4 KB."""
    return bits.select(F.floor(F.col("bit") / BUCKET).alias("bucket"), (F.col("bit") % BUCKET).alias("at")).groupBy("bucket").agg(
        F.bitmap_construct_agg("at").alias("bytes"))


def bare(text: Column) -> Column:
    """Lower-case words of a text without outer punctuation, joined by one space."""
    return F.array_join(F.filter(F.transform(words_of(F.lower(text)), lambda w: F.regexp_replace(
        w, "^[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+|[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+$", "")), lambda w: w != ""), " ")


def short_items(items: DataFrame, windowed: DataFrame) -> DataFrame:
    """``(item_id, line, item_words)`` of items ``(id, key, text)`` with a word but without a window."""
    some = items.join(windowed.select(F.col("key")).distinct(), "key", "left_anti").select(
        F.col("id").alias("item_id"), bare(F.col("text")).alias("line")).where("line <> ''").distinct()
    return write_out(some.withColumn("item_words", F.size(F.split("line", " ")).cast("long")), "short-items")


def short_leaks(docs: DataFrame, short: DataFrame) -> DataFrame:
    """``(id, key, item_id, item_words)``: ``short`` items that are a whole line of ``docs (id, key, text)``."""
    lines = docs.select("id", "key", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).select(
        "id", "key", bare(F.col("line")).alias("line")).where("size(split(line, ' ')) <= 2 and line <> ''").distinct()
    # a bitmap of the items' lines first, so that other lines are not shuffled; AQE splits a line that many documents share
    return may_hold(lines, "line", bitmap_of(short, "line")).join(short, "line").select("id", "key", "item_id", "item_words")


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    d = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return d.select("id", F.xxhash64("id", "text").alias("key"), "text")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and benchmark item found in it:
    ``(doc_id, key, item_id, covered, item_words, n_slots, exact)``.

    ``covered`` counts item words along the best alignment: those of all
    windows where every item value stands for one document value, else those
    of the template windows if they agree among themselves, else those of the
    literal windows.  ``exact`` says that the covered words hold the same
    values too; ``key`` names the row by content.  Items of one or two words
    count where they are a whole line (case and outer punctuation apart); items
    of fewer than 3 plain words are searched only literally.  Null
    and empty texts match nothing; repeated rows give one row; other columns
    are ignored; empty tables give no rows.
    """
    items = write_out(window_rows(_rows(benchmark, item_col, item_text), list(range(3, WINDOW + 1)), None, True), "item-windows")
    sizes = [r[0] for r in items.select("size").distinct().orderBy("size").collect()]
    bits = np.zeros(1 << (BITS - 3), np.uint8)             # 2^BITS bits, whatever the benchmark
    for r in bitmap_rows(items.select(F.shiftrightunsigned("hash", 64 - BITS).alias("bit"))).collect():
        bits[r[0] * (BUCKET >> 3):(r[0] + 1) * (BUCKET >> 3)] = np.frombuffer(r[1], np.uint8)
    hits = window_rows(_rows(docs, id_col, text_col), sizes, bits, False)
    item = items.select("hash", "size", "literal", F.col("id").alias("item_id"), F.col("key").alias("item_key"), F.col("pos").alias("item_pos"),
                        F.col("slots").alias("item_slots"), F.col("tokens").alias("item_words"))
    met = hits.drop("tokens").join(item, ["hash", "size", "literal"]).where(
        F.col("literal") | (F.size("slots") == F.size("item_slots")))
    mine = F.when(F.col("literal"), F.col("item_slots")).otherwise(F.col("slots"))     # case and place decide what a slot is: equal words may differ
    met = met.withColumn("slots", mine)
    value = F.transform(F.arrays_zip("item_slots", "slots"), lambda z: F.struct(z["item_slots"].alias("a"), z["slots"].alias("b")))
    aligned = []
    for name, which in (("all", F.lit(True)), ("template", ~F.col("literal")), ("literal", F.col("literal"))):
        aligned += [F.sort_array(F.collect_set(F.when(which, F.col("item_pos")))).alias(f"{name}_at"),
                    F.array_distinct(F.flatten(F.collect_set(F.when(which, value)))).alias(f"{name}_pairs")]
    along = met.groupBy("id", "key", "item_id", "item_key", "item_words", "size", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(*aligned)

    def count(name: str):
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(f"{name}_at", start, lambda s, p: F.struct(
            (s["n"] + F.least(F.col("size"), p - s["last"])).alias("n"), p.alias("last")), lambda s: s["n"])

    def part(name: str):
        """Covered words and slot values of the windows of a kind, if they agree."""
        pairs = f"{name}_pairs"
        agree = F.size(F.array_distinct(F.transform(pairs, lambda z: z["a"]))) == F.size(pairs)
        return F.when(agree, F.struct(count(name).alias("covered"), F.size(pairs).alias("n_slots")))

    along = along.withColumn("part", F.greatest(part("all"), part("template"), part("literal"))).withColumn("equal", count("literal"))
    good = along.where(F.col("part.covered") >= F.least(F.lit(COVERED), F.ceil(SHARE * F.col("item_words"))))
    exact = F.col("part.covered") == F.col("equal")        # a word with another value is in no literal window
    best = F.max(F.struct("part.covered", "part.n_slots", exact.alias("exact"), "item_words"))
    short = short_items(_rows(benchmark, item_col, item_text), items)
    lines = None if short.isEmpty() else short_leaks(_rows(docs, id_col, text_col), short).select(
        F.col("id").alias("doc_id"), "key", "item_id", F.col("item_words").alias("covered"), "item_words",
        F.lit(0).cast("long").alias("n_slots"), F.lit(True).alias("exact"))
    found = good.groupBy("id", "key", "item_id").agg(best.alias("x")).select(
        F.col("id").alias("doc_id"), "key", "item_id", F.col("x.covered").cast("long").alias("covered"),
        F.col("x.item_words").cast("long").alias("item_words"), F.col("x.n_slots").cast("long").alias("n_slots"), F.col("x.exact").alias("exact"))
    return found if lines is None else found.unionByName(lines)


def drop_leaked(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` in which no benchmark item was found, columns unchanged."""
    bad = write_out(leaks(docs, benchmark, id_col, text_col).select(F.col("key").alias("_key")).distinct(), "leaked")
    if bad.count() <= FLAGGED_BROADCAST:
        bad = F.broadcast(bad)
    keyed = docs.withColumn("_key", F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")))
    return keyed.join(bad, "_key", "left_anti").drop("_key")
