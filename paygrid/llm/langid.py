"""Language identification by word-first backoff.

A model holds, per language, log frequencies of whole words and of character
n-grams of 5 down to 1 letters (word edges marked).  A word that the model
knows adds its log frequencies; an unseen word falls back to the longest
n-gram length of which it has known n-grams, and adds their mean.  Counts are
grouped sums in Spark over a bounded sample of labelled rows; the model is
cut to a fixed number of entries and shipped to the tasks.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paygrid.llm.words import slices
from paygrid.session import write_out

TRAIN_ROWS = 3_000            # labelled documents fitted, about
WORDS_KEPT, GRAMS_KEPT = 60_000, 60_000     # entries of the model: of words, and of each n-gram length
LONGEST_GRAM = 5
FOLDS, HELD_OUT = 4, 2
CACHE_WORDS = 300_000         # scored words kept by a Python worker
SLICE = 6 << 20
_LETTERS = re.compile(r"[^\W\d_]+")


def fold(id_col: str | Column) -> Column:
    """crc32 of the id as text, modulo ``FOLDS`` (null id: of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def grams(word: str, n: int) -> list[str]:
    w = f"\x02{word}\x03" if n > 1 else word
    return [w[i:i + n] for i in range(len(w) - n + 1)]


def word_counts(docs: DataFrame) -> DataFrame:
    """``(lang, n, unit, count)``: words (``n`` 0) and n-grams of labelled
    ``(text, lang)`` rows, combined in each batch before the shuffle."""
    def run(batches):
        for batch in batches:
            total: dict[tuple[str, int], Counter] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total.setdefault((lang, 0), Counter()).update(_LETTERS.findall(text.lower()))
            for lang, _ in list(total):
                for w, c in total[lang, 0].items():
                    for n in range(1, LONGEST_GRAM + 1):
                        g = total.setdefault((lang, n), Counter())
                        for x in grams(w, n):
                            g[x] += c
            for (lang, n), units in total.items():
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang] * len(units), pa.string()), "n": pa.array([n] * len(units), pa.int32()),
                    "unit": pa.array(list(units), pa.string()), "count": pa.array(list(units.values()), pa.int64())})
    return docs.mapInArrow(run, "lang string, n int, unit string, count long").groupBy("lang", "n", "unit").agg(
        F.sum("count").alias("count"))


@dataclass
class Model:
    """``langs`` in order; ``rows`` maps a unit, per length ``n`` (0: words),
    to its row in ``table``: log frequencies, one column per language."""
    langs: list[str]
    prior: np.ndarray
    rows: list[dict[str, int]]
    table: np.ndarray

    def units_of(self, word: str) -> list[list[int]]:
        """For each letter run of a word: rows of the word itself, or of its
        n-grams of the longest length that is known."""
        out = []
        for w in _LETTERS.findall(word.lower()):
            known = self.rows[0].get(w)
            if known is not None:
                out.append([known])
                continue
            for n in range(LONGEST_GRAM, 0, -1):
                find = self.rows[n].get
                got = [r for g in grams(w, n) if (r := find(g)) is not None]
                if got:
                    out.append(got)
                    break
        return out

    def score(self, words: list[str]) -> np.ndarray:
        """Log evidence of each word: the mean over the units of a letter run, summed over runs."""
        owner, flat, weight = [], [], []
        for k, word in enumerate(words):
            for run in self.units_of(word):
                owner += [k] * len(run)
                flat += run
                weight += [1 / len(run)] * len(run)
        out = np.zeros((len(words), len(self.langs)))
        if flat:
            values = self.table[flat] * np.array(weight)[:, None]
            for c in range(len(self.langs)):
                out[:, c] = np.bincount(owner, values[:, c], len(words))
        return out


def train(docs: DataFrame, sample_rows: int = TRAIN_ROWS) -> Model:
    """Fit on about ``sample_rows`` of ``docs (doc_id, text, lang)``, taken by a hash
    of id and text; rows without text or language are left out."""
    good = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    n = good.count()
    part = 1_000_000 if n <= sample_rows else max(1, sample_rows * 1_000_000 // n)
    sample = good.where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1_000_000)) < part)
    counts = write_out(word_counts(sample.select("text", "lang")), "language-counts")
    # of each length the most frequent units: a fixed number of rows for the driver
    unit = counts.groupBy("n", "unit").agg(F.sum("count").alias("total"), F.map_from_entries(
        F.collect_list(F.struct("lang", "count"))).alias("by_lang"))
    got = [r for n in range(LONGEST_GRAM + 1) for r in unit.where(f"n = {n}").orderBy(F.desc("total"), "unit").limit(
        GRAMS_KEPT if n else WORDS_KEPT).collect()]
    totals = {(r["lang"], r["n"]): (r["s"], r["k"]) for r in counts.groupBy("lang", "n").agg(
        F.sum("count").alias("s"), F.count("*").alias("k")).collect()}
    langs = sorted({lang for lang, _ in totals})
    rows: list[dict[str, int]] = [{} for _ in range(LONGEST_GRAM + 1)]
    table = np.zeros((len(got), len(langs)))
    for k, r in enumerate(got):
        size = [totals.get((lang, r["n"]), (0, 0)) for lang in langs]
        vocab = max(k for _, k in size)
        c = np.array([r["by_lang"].get(lang, 0) for lang in langs]) + 0.2
        rows[r["n"]][r["unit"]] = k
        table[k] = np.log(c / np.array([s + 0.2 * vocab for s, _ in size]))
    words = np.array([totals.get((lang, 0), (0, 0))[0] for lang in langs], float)
    return Model(langs, np.log((words + 1) / (words.sum() + len(langs))) if langs else words, rows, table)


_cache: dict = {}


def _word_table(model: Model, words: list[str]) -> np.ndarray:
    """Evidence of distinct words and, last, whether they have a letter.  The
    first ``CACHE_WORDS`` words that a worker meets keep their rows."""
    if _cache.get("model") is not model:
        _cache.update(model=model, rows={}, table=np.zeros((CACHE_WORDS, len(model.langs) + 1)))
    rows, kept = _cache["rows"], _cache["table"]
    at = np.array([rows.get(w, -1) for w in words], np.int64)
    table = kept[at]
    fresh = np.flatnonzero(at < 0)
    if len(fresh):
        new = [words[k] for k in fresh.tolist()]
        table[fresh, :-1] = model.score(new)
        table[fresh, -1] = [_LETTERS.search(w) is not None for w in new]
        for k, w in zip(fresh.tolist(), new, strict=True):
            if len(rows) == CACHE_WORDS:
                break
            if len(w) <= 40:
                kept[len(rows)] = table[k]
                rows[w] = len(rows)
    return table


def _evidence(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Log evidence per text and language, and whether it has a letter."""
    words = pc.ascii_split_whitespace(texts)
    bounds, coded = words.offsets.to_numpy(), words.flatten().dictionary_encode()
    index = coded.indices.to_numpy()
    if not len(index):
        return np.zeros((len(texts), len(model.langs))), np.zeros(len(texts), bool)
    some = bounds[1:] > bounds[:-1]
    out = np.zeros((len(texts), len(model.langs) + 1))
    table = _word_table(model, coded.dictionary.to_pylist())
    out[some] = np.add.reduceat(table[index], bounds[:-1][some], axis=0)
    return out[:, :-1], out[:, -1] > 0


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row, in one map.

    ``score`` is the posterior of the predicted language.  A null text, or one
    without a letter, is ``und`` with score 0; so is every row when nothing
    was learned.  Repeated rows and null ids are passed through.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = broadcast.value
        for batch in batches:
            texts = pc.fill_null(batch.column(2), "")
            off = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy())])
            pred, score = [], []
            for i, j in slices(off, SLICE):
                if not m.langs:
                    pred += ["und"] * (j - i)
                    score += [0.0] * (j - i)
                    continue
                v, has = _evidence(m, texts.slice(i, j - i))
                v = v + m.prior
                best = v.argmax(1)
                p = 1 / np.exp(v - v.max(1, keepdims=True)).sum(1)
                pred += [m.langs[b] if h else "und" for b, h in zip(best.tolist(), has.tolist(), strict=True)]
                score += np.where(has, p, 0.0).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()),
                                              pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])
    d = docs.withColumn("_fold", fold(f"`{id_col}`")).select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), (F.col("_fold") == HELD_OUT).alias("held_out"),
        F.col(f"`{text_col}`").alias("text"))
    return d.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the folds that are not held out, then predict every row."""
    learn = docs.where(fold(f"`{id_col}`") != HELD_OUT).select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    return predict(docs, train(learn), id_col, text_col)
