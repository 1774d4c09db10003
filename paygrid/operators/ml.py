"""Description clustering: TF-IDF as a relation, rank-2 SVD, k-means.

TF-IDF follows the common "smooth idf" convention: terms are ``\\w\\w+``
tokens of the lower-cased text minus English stop words, plus adjacent
pairs of the remaining tokens; the 3,000 most frequent terms with document
frequency >= 3 and <= 85 %; weight = count * (ln((1+n)/(1+df)) + 1); rows
L2-normalised.

The words of a text are written once, joined by spaces.  Terms that are
frequent in a sample and all single words are counted in all rows; that gives
a count below which no term is in the vocabulary, and only pairs that may reach
it are counted besides (``frequent_terms``; the result is exact).  The weights
of a row are looked up without a shuffle.  Rows ``(keys, idx, w)`` are written;
k-means packs them into bytes once, and every iteration of the fits is one pass
over a written table: a task returns partial sums, which are added up per cell
or per centre.  The driver holds the vocabulary, the
centres of all restarts (10 x 8 x 3,000 numbers) or a 3,000 x 12 block, never
rows; nothing is cached, so nothing has to be released.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paygrid import rules as R
from paygrid.arrow import list_sizes, spans, text_sizes
from paygrid.operators.common import median
from paygrid.session import write_out

CHUNK = 262_144                # words or stored weights that a task works on at a time
BLOCK_CELLS = 65_536           # numbers of a product that are in work at once: they stay in a core's cache
PAD = 4                        # rows are multiplied together with others of the same number of weights, rounded up to this
PACK = 256                     # weights in a row of bytes: Spark reads thousands of such rows at once
GUESS_ROWS = 20_000            # rows in which terms are looked for that are likely to be frequent
PIECE = 4_194_304              # words in which pairs are counted at once
DENSE, DENSE_ROWS = 16, 128    # rows with more than one weight in 16 terms are multiplied as dense rows, 128 at once
KMEANS_ITERATIONS, KMEANS_MOVE = 20, 1e-4
KMEANS_START_ROWS = 2_048      # rows (least hashes) on which the starting centres are chosen; all passes cover all rows
SVD_BLOCK, SVD_ITERATIONS, SVD_RESIDUAL = 12, 80, 1e-8


# --------------------------------------------------------------------------
# TF-IDF
# --------------------------------------------------------------------------

@dataclass
class Matrix:
    """``rows``: written table of key columns, ``idx array<int>`` (rising) and
    ``w array<double>``; ``vocab``: the term of each column; ``n`` rows."""
    rows: DataFrame
    vocab: list[str]
    n: int

    @property
    def keys(self) -> list[str]:
        return [c for c in self.rows.columns if c not in ("idx", "w")]


def terms_of(text: Column) -> Column:
    """Words that are no stop words, and pairs of those that are next to each
    other without them; as ``array<struct<first, n>>`` by term."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w\w+"), F.lit(0))
    return F.arrow_udf(counted, "array<struct<first:string,n:int>>")(words)


def counted(words: pa.Array) -> pa.Array:
    """The terms of every list of words, a bounded number of words at a time."""
    parts = [_counted(words.slice(i, j - i)) for i, j in spans(list_sizes(words), CHUNK)]
    return pa.concat_arrays(parts) if parts else _counted(words)


def _counted(words: pa.Array) -> pa.Array:
    """Words are numbered in byte order; a word is below its pairs and these are
    below any longer word, so the numbers of (row, word, next word or none)
    sort as the terms do."""
    coded = words.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    names, n = coded.dictionary.take(order), len(order)
    number = np.empty(n, np.int64)
    number[order.to_numpy()] = np.arange(n)
    code = number[coded.indices.to_numpy()]
    row = np.repeat(np.arange(len(words)), list_sizes(words))
    kept = ~pc.is_in(names, value_set=pa.array(R.SPARK_ENGLISH_STOPWORDS, names.type)).to_numpy(zero_copy_only=False)[code]
    code, row = code[kept], row[kept]
    one = (row * n + code) * (n + 1)
    cells = np.sort(np.concatenate([one, (one[:-1] + code[1:] + 1)[row[1:] == row[:-1]]]))
    starts = np.flatnonzero(np.diff(cells, prepend=-1))
    many, cells = np.diff(np.append(starts, len(cells))), cells[starts]
    word, after = np.divmod(cells, n + 1)
    row, word = np.divmod(word, max(n, 1))
    terms = pc.binary_join_element_wise(names.take(pa.array(word)), names.take(pa.array(after - 1, mask=after == 0)), " ", null_handling="skip")
    off = pa.array(np.searchsorted(row, np.arange(len(words) + 1)).astype(np.int32))
    pairs = pa.StructArray.from_arrays([terms, pa.array(many.astype(np.int32))], names=["first", "n"])
    return pa.ListArray.from_arrays(off, pairs, mask=words.is_null())


def vocabulary(terms: DataFrame, n: int, max_features: int) -> DataFrame:
    """``(term, total, df)`` of the most frequent terms, ties by term.  Terms
    are added up inside each task before they become rows."""
    def run(batches):
        for batch in batches:
            for i, j in spans(list_sizes(batch.column(0)), 4 * CHUNK):
                flat = batch.column(0).slice(i, j - i).flatten()
                each = pa.table({"term": flat.field("first"), "n": flat.field("n")})
                added = each.group_by("term", use_threads=False).aggregate([("n", "sum"), ("n", "count")])
                yield from added.select(["term", "n_sum", "n_count"]).rename_columns(["term", "n", "df"]).combine_chunks().to_batches()

    each = terms.select("_terms").mapInArrow(run, "term string, n long, df long")
    return each.groupBy("term").agg(F.sum("n").alias("total"), F.sum("df").alias("df")).where(
        (F.col("df") >= R.TFIDF_MIN_DF) & (F.col("df") <= R.TFIDF_MAX_DF * n)).orderBy(F.desc("total"), "term").limit(max_features)


def words_of(text: Column) -> Column:
    """The words of the lower-cased text, stop words too, with a space between."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w\w+"), F.lit(0)), " ")


def numbered(texts: pa.Array) -> Iterator[tuple[int, int, pa.Array, np.ndarray, np.ndarray]]:
    """``(first row, row after the last, names, code, row)`` of a bounded part of
    the texts: the number in ``names`` of each word that is no stop word, and its row."""
    for i, j in spans(text_sizes(texts), 8 * CHUNK):
        lists = pc.split_pattern(texts.slice(i, j - i), " ")
        coded = lists.flatten().dictionary_encode()
        code, row = coded.indices.to_numpy(), np.repeat(np.arange(j - i), list_sizes(lists))
        out = pc.is_in(coded.dictionary, value_set=pa.array(["", *R.SPARK_ENGLISH_STOPWORDS], pa.string()))
        kept = ~out.to_numpy(zero_copy_only=False)[code]
        yield i, j, coded.dictionary, code[kept].astype(np.int64), row[kept]


def numbers_in(names: pa.Array, values: list[str]) -> np.ndarray:
    """The place of each name in ``values``, or -1."""
    return pc.fill_null(pc.index_in(names, value_set=pa.array(values, pa.string())), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def neighbours(word: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``first * size + second`` and row of words next to each other that have numbers (not -1)."""
    ok = (word[:-1] >= 0) & (word[1:] >= 0) & (row[:-1] == row[1:])
    return word[:-1][ok] * size + word[1:][ok], row[1:][ok]


@dataclass
class Pairs:
    """Pairs of words as rising ``codes`` (``first * len(words) + second``), and
    the place that each has in the list they come from."""
    words: list[str]
    codes: np.ndarray
    place: np.ndarray

    @staticmethod
    def of(terms: list[str]) -> Pairs:
        pairs = [(t.split(" "), i) for i, t in enumerate(terms) if " " in t]
        number = {w: k for k, w in enumerate(dict.fromkeys(w for p, _ in pairs for w in p))}
        codes = np.array([number[a] * len(number) + number[b] for (a, b), _ in pairs], np.int64)
        order = np.argsort(codes)
        return Pairs(list(number), codes[order], np.array([i for _, i in pairs], np.int64)[order])

    def found(self, names: pa.Array, code: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(place, row)`` of each occurrence."""
        if not len(self.codes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cells, row = neighbours(numbers_in(names, self.words)[code], row, len(self.words))
        at = np.minimum(np.searchsorted(self.codes, cells), len(self.codes) - 1)
        same = self.codes[at] == cells
        return self.place[at[same]], row[same]


def counted_once(row: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
    """In how many rows each of ``size`` values is."""
    cells = np.sort(row * size + value)
    return np.bincount(cells[np.diff(cells, prepend=-1) != 0] % max(size, 1), minlength=size)


def count_terms(words: DataFrame, pairs: list[str], single: bool) -> DataFrame:
    """``(term, total, df)`` of the given pairs and, if ``single``, of all words;
    the null term has the number of words.  Words are added up inside a task."""
    shared, size = words.sparkSession.sparkContext.broadcast((Pairs.of(pairs), pairs)), len(pairs)

    def added(tables):
        return pa.concat_tables(tables).group_by("term", use_threads=False).aggregate([("n", "sum"), ("df", "sum")]).select(
            ["term", "n_sum", "df_sum"]).rename_columns(["term", "n", "df"])

    def table(terms, n, df):
        return pa.table({"term": terms.cast(pa.string()), "n": n.astype(np.int64), "df": df.astype(np.int64)})

    def run(batches):
        (known, pairs), held, rows, every = shared.value, [], 0, 0
        total, df = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            for _, _, names, code, row in numbered(batch.column(0)):
                every += len(code)
                place, of = known.found(names, code, row)
                total += np.bincount(place, minlength=size)
                df += counted_once(of, place, size)
                if not single:
                    continue
                n = np.bincount(code, minlength=len(names))
                has = np.flatnonzero(n)
                held.append(table(names.take(pa.array(has)), n[has], counted_once(row, code, len(names))[has]))
                rows += len(has)
                if rows > 4 * CHUNK:
                    held = [added(held)]
                    rows = len(held[0])
                    if rows > 2 * CHUNK:
                        yield from held[0].combine_chunks().to_batches()
                        held, rows = [], 0
        has = np.flatnonzero(total)
        held.append(table(pa.array([pairs[i] for i in has], pa.string()), total[has], df[has]))
        held.append(table(pa.array([None], pa.string()), np.array([every]), np.array([0])))
        yield from added(held).combine_chunks().to_batches()

    each = words.select("_words").mapInArrow(run, "term string, n long, df long")
    return each.groupBy("term").agg(F.sum("n").alias("total"), F.sum("df").alias("df"))


def likely_pairs(words: DataFrame, known: list[str], least: int, every: int) -> DataFrame:
    """All pairs of ``known`` words that may be in the texts ``least`` times:
    such a pair has, in some piece of the texts, that piece's share of ``least``."""
    shared, size = words.sparkSession.sparkContext.broadcast(known), len(known)

    def likely(held, here):
        codes = np.sort(np.concatenate(held))
        starts = np.flatnonzero(np.diff(codes, prepend=-1))
        many = np.diff(np.append(starts, len(codes)))
        first, second = np.divmod(codes[starts[many * float(every) >= least * float(here) * (1 - 1e-9)]], max(size, 1))
        names = pa.array(shared.value, pa.string())
        yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(names.take(pa.array(first)), names.take(pa.array(second)), " ")], names=["term"])

    def run(batches):
        held, here = [], 0
        for batch in batches:
            for _, _, names, code, row in numbered(batch.column(0)):
                held.append(neighbours(numbers_in(names, shared.value)[code], row, size)[0])
                here += len(code)
                if here > PIECE:
                    yield from likely(held, here)
                    held, here = [], 0
        if held:
            yield from likely(held, here)

    return words.select("_words").mapInArrow(run, "term string").distinct()


def frequent_terms(words: DataFrame, n: int, max_features: int, sample: int = GUESS_ROWS) -> tuple[list[str], list[int]]:
    """Terms and document frequencies of ``vocabulary`` over the rows of ``_words``.

    Terms frequent in a sample are counted in all rows, with all single words.
    The last of the ``max_features`` best so far is the least count that a term
    of the result can have: rarer words are in none, and a pair of the others is
    counted if some piece of the texts holds that count's share of it.  The
    sample decides on the time only."""
    def best(counts):
        return counts.where(F.col("term").isNotNull() & (F.col("df") >= R.TFIDF_MIN_DF) & (F.col("df") <= R.TFIDF_MAX_DF * n)).orderBy(
            F.desc("total"), "term").limit(max_features).collect()

    guess = words.sample(min(1.0, sample / max(n, 1)), R.KMEANS_SEED) if n > sample else words
    guess = vocabulary(guess.select(terms_of(F.col("_words")).alias("_terms")), n, max_features if n <= sample else 2 * max_features).collect()
    if n <= sample:
        return [r.term for r in guess], [r.df for r in guess]
    guess = [r.term for r in guess if " " in r.term]
    counts = write_out(count_terms(words, guess, single=True).where(F.col("term").isNull() | (F.col("df") >= R.TFIDF_MIN_DF)), "counts")
    found = best(counts)
    least = max(R.TFIDF_MIN_DF, found[-1].total if len(found) == max_features else 0)
    every = counts.where("term is null").collect()[0].total
    known = [r.term for r in counts.where(F.col("total") >= least).where(~F.col("term").contains(" ")).select("term").collect()]
    more = sorted({r.term for r in likely_pairs(words, known, least, every).collect()} - set(guess))
    if more:
        found = sorted(found + best(count_terms(words, more, single=False)), key=lambda r: (-r.total, r.term))[:max_features]
    return [r.term for r in found], [r.df for r in found]


def tfidf(df: DataFrame, text: str = "description_md", keep: list[str] | None = None,
          max_features: int = R.TFIDF_MAX_FEATURES, partitions: int | None = None) -> Matrix:
    """TF-IDF rows of all texts that are not null (a text without known terms
    is a row without weights).  ``partitions``: in how many parts the words are
    written, by default as many as shuffles."""
    keep = keep or []
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = write_out(df.where(F.col(text).isNotNull()).select(*keep, words_of(F.col(text)).alias("_words")).repartition(parts), "words", compression="zstd")
    n = words.count()
    vocab, dfs = frequent_terms(words, n, max_features)
    shared = spark.sparkContext.broadcast((vocab, Pairs.of(vocab), np.log((1 + n) / (1 + np.array(dfs, float))) + 1))

    def run(batches):
        vocab, pairs, idf = shared.value
        size = max(len(vocab), 1)
        by_term = np.array(sorted(range(len(vocab)), key=lambda i: vocab[i]), np.int64)
        rank = np.argsort(by_term)
        for batch in batches:
            for i, j, names, code, row in numbered(batch.column(len(keep))):
                col = numbers_in(names, vocab)[code]
                has = col >= 0
                second, of = pairs.found(names, code, row)
                cells = np.sort(np.concatenate([row[has], of]) * size + rank[np.concatenate([col[has], second])])
                starts = np.flatnonzero(np.diff(cells, prepend=-1))
                row, col = np.divmod(cells[starts], size)
                col = by_term[col]
                w = np.diff(np.append(starts, len(cells))) * idf[col] if len(col) else np.zeros(0)
                norm = np.sqrt(np.bincount(row, weights=w * w, minlength=j - i))
                order = np.argsort(row * size + col)
                off = pa.array(np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(i, j - i).columns[:len(keep)], pa.ListArray.from_arrays(off, pa.array(col[order].astype(np.int32))),
                     pa.ListArray.from_arrays(off, pa.array((w / norm[row])[order] if len(w) else w))], names=[*keep, "idx", "w"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema), "idx array<int>, w array<double>"])
    return Matrix(write_out(words.mapInArrow(run, schema), "tfidf"), vocab, n)


def tfidf_matrix(df: DataFrame, text: str = "description_md", key: str = "job_id",
                 max_features: int = R.TFIDF_MAX_FEATURES) -> DataFrame:
    """The matrix as a relation: ``(key, term, weight)``, one row per weight."""
    m = tfidf(df, text, [key], max_features)
    names = df.sparkSession.createDataFrame(list(enumerate(m.vocab)), "idx int, term string")       # at most max_features rows
    cells = m.rows.select(key, F.explode(F.arrays_zip("idx", "w")).alias("c")).select(key, F.col("c.idx").alias("idx"), F.col("c.w").alias("weight"))
    return cells.join(F.broadcast(names), "idx").select(key, "term", "weight")


# --------------------------------------------------------------------------
# passes over the row table
# --------------------------------------------------------------------------

def chunks(batch: pa.RecordBatch, idx: int, w: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(first row, row after the last, row of each weight, idx, w)``."""
    lists = batch.column(idx)
    off = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    col, val = lists.flatten().to_numpy(), batch.column(w).flatten().to_numpy()
    for i, j in spans(np.diff(off), CHUNK):
        yield i, j, np.repeat(np.arange(j - i), np.diff(off[i:j + 1])), col[off[i]:off[j]], val[off[i]:off[j]]


def times(rows: int, row: np.ndarray, col: np.ndarray, val: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Product of the rows of a chunk with a dense block.  Rows of like width
    (their weights filled up with zeros to a multiple of ``PAD``) are small
    products done together, rows with many weights are multiplied as dense rows."""
    out, width = np.zeros((rows, block.shape[1])), block.shape[1]
    many = np.bincount(row, minlength=rows)
    start = np.cumsum(many) - many
    size = -(-many // PAD) * PAD
    size[many * DENSE > len(block)] = -1
    order = np.argsort(size, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(size[order], prepend=-2)), rows)
    for i, j in zip(ends, ends[1:]):
        k = int(size[order[i]])
        if k == 0 or not width:
            continue
        step = DENSE_ROWS if k < 0 else max(1, BLOCK_CELLS // (k * width))
        for here in (order[x:min(x + step, j)] for x in range(i, j, step)):
            if k < 0:
                at = np.concatenate([np.arange(start[r], start[r] + many[r]) for r in here])
                cells = np.repeat(np.arange(len(here)) * len(block), many[here]) + col[at]
                out[here] = np.bincount(cells, weights=val[at], minlength=len(here) * len(block)).reshape(len(here), -1) @ block
                continue
            first, last = here[0], here[-1]
            if last - first + 1 == len(here) and start[last] + k - start[first] == len(here) * k and many[last] == k:   # side by side, as packed
                x, at = val[start[first]:start[last] + k].reshape(-1, k), col[start[first]:start[last] + k]
            else:
                at = start[here, None] + np.arange(k)
                x, at = np.where(np.arange(k) < many[here, None], val.take(at, mode="clip"), 0.0), col.take(at, mode="clip").ravel()
            part = block.take(at, axis=0, mode="clip").reshape(len(here), k, width)
            out[here] = np.matmul(x[:, None, :], part)[:, 0]
    return out


def each_row(m: Matrix, block: np.ndarray, columns: str, make: Callable[[np.ndarray], list]) -> DataFrame:
    """Key columns and ``make(rows x block)`` of every row."""
    shared, k = m.rows.sparkSession.sparkContext.broadcast(block), len(m.keys)
    names = [*m.keys, *[c.split(" ")[0] for c in columns.split(", ")]]

    def run(batches):
        for batch in batches:
            parts = [times(j - i, row, col, val, shared.value) for i, j, row, col, val in chunks(batch, k, k + 1)]
            got = make(np.concatenate([np.zeros((0, shared.value.shape[1])), *parts]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *map(pa.array, got)], names=names)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in m.rows.select(*m.keys).schema), columns])
    return m.rows.select(*m.keys, "idx", "w").mapInArrow(run, schema)


# --------------------------------------------------------------------------
# SVD
# --------------------------------------------------------------------------

def gram_times(m: Matrix, block: np.ndarray) -> np.ndarray:
    """``A' A block``: one pass, partial products per task, summed per term."""
    shared, size = m.rows.sparkSession.sparkContext.broadcast(block), len(m.vocab)
    names = [f"z{k}" for k in range(block.shape[1])]

    def run(batches):
        v = shared.value
        z = np.zeros((size, v.shape[1]))
        for batch in batches:
            for i, j, row, col, val in chunks(batch, 0, 1):
                y = times(j - i, row, col, val, v)
                for k in range(v.shape[1]):
                    z[:, k] += np.bincount(col, weights=val * y[row, k], minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), *[pa.array(z[:, k]) for k in range(v.shape[1])]],
                                         names=["term", *names])
    parts = m.rows.select("idx", "w").mapInArrow(run, ", ".join(["term int", *[f"{c} double" for c in names]]))
    got = parts.groupBy("term").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    shared.unpersist()
    out = np.zeros_like(block)
    out[got["term"].to_numpy()] = np.column_stack([got[c].to_numpy() for c in names])
    return out


def right_vectors(m: Matrix, rank: int = 2, seed: int = R.KMEANS_SEED) -> np.ndarray:
    """The first right singular vectors (terms x rank) by block power
    iteration, until the residuals of the wanted pairs are small."""
    size = len(m.vocab)
    width = min(size, max(SVD_BLOCK, rank))
    v = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0]
    for _ in range(SVD_ITERATIONS):
        z = gram_times(m, v)
        values, turn = np.linalg.eigh(v.T @ z)
        turn = turn[:, ::-1]
        z, v, values = z @ turn, v @ turn, values[::-1]
        gap = np.linalg.norm(z[:, :rank] - v[:, :rank] * values[:rank], axis=0)
        if (gap <= SVD_RESIDUAL * max(values[0], 1e-300)).all():
            break
        v = np.linalg.qr(z)[0]
    out = np.zeros((size, rank))
    out[:, :min(rank, width)] = v[:, :rank]
    sign = np.sign(out[np.abs(out).argmax(axis=0), np.arange(rank)]) if size else np.ones(rank)
    return out * np.where(sign == 0, 1.0, sign)


def svd_2d(df: DataFrame, text: str = "description_md", key: str = "job_id") -> DataFrame:
    """Rank-2 projection (not centred) ``(key, x, y, explained_ratio)``; signs
    are fixed so that the largest loading of each component is positive.
    Without terms all coordinates are 0."""
    m = tfidf(df, text, [key])
    v = right_vectors(m) if m.vocab else np.zeros((1, 2))
    out = each_row(m, v, "x double, y double", lambda y: [y[:, 0], y[:, 1]])
    cells = m.rows.select(F.explode(F.arrays_zip("idx", "w")).alias("c"))
    means = cells.groupBy("c.idx").agg(F.sum("c.w").alias("s")).agg(F.coalesce(F.sum(F.pow(F.col("s") / F.lit(max(m.n, 1)), 2)), F.lit(0.0)).alias("m2"))
    square = m.rows.agg(F.avg(F.when(F.size("idx") > 0, 1.0).otherwise(0.0)).alias("sq"))          # rows have norm 1 or 0
    share = out.agg((F.var_pop("x") + F.var_pop("y")).alias("v")).crossJoin(means).crossJoin(square).select(
        F.coalesce(F.try_divide("v", F.col("sq") - F.col("m2")), F.lit(0.0)).alias("explained_ratio"))
    return out.crossJoin(F.broadcast(share))                     # one row


# --------------------------------------------------------------------------
# k-means
# --------------------------------------------------------------------------

@dataclass
class Clusters:
    """Centres (k x terms) of the best restart, its cost, and the cost of each ``(seed, cost)``."""
    centers: np.ndarray
    cost: float
    costs: list[tuple[int, float]]


def distances(x2: np.ndarray, dots: np.ndarray, c2: np.ndarray) -> np.ndarray:
    out = dots * -2
    out += x2[:, None]
    out += c2
    return np.maximum(out, 0, out=out)


def starting_centers(m: Matrix, k: int, seeds: list[int]) -> np.ndarray:
    """``len(seeds) x k x terms`` centres: spread-out rows of a sample of
    ``KMEANS_START_ROWS`` rows, settled on that sample."""
    sample = m.rows.select("idx", "w").orderBy(F.xxhash64("idx", "w")).limit(KMEANS_START_ROWS).collect()
    x = np.zeros((max(len(sample), 1), len(m.vocab)))
    for r, (idx, w) in enumerate(sample):
        x[r, idx] = w
    x2, out = (x * x).sum(axis=1), []
    for seed in seeds:
        r = np.random.default_rng(seed)
        c = x[[r.integers(len(x))]]
        while len(c) < k:
            d = distances(x2, x @ c.T, (c * c).sum(axis=1)).min(axis=1)
            c = np.vstack([c, x[r.choice(len(x), p=d / d.sum() if d.sum() > 0 else None)]])
        for _ in range(KMEANS_ITERATIONS):
            label = distances(x2, x @ c.T, (c * c).sum(axis=1)).argmin(axis=1)
            c = np.array([x[label == j].mean(axis=0) if (label == j).any() else c[j] for j in range(k)])
        out.append(c)
    return np.array(out)


def packed(m: Matrix) -> DataFrame:
    """The weights of a few rows as one row of bytes (sizes, idx, w): Spark hands
    them to the tasks as they are, number by number it takes longer.  Rows are
    filled up to a multiple of ``PAD`` with weights of 0, those of like width next to each other."""
    def run(batches):
        for batch in batches:
            for i, j, row, col, val in chunks(batch, 0, 1):
                many = np.bincount(row, minlength=j - i)
                size = -(-many // PAD) * PAD
                order = np.argsort(size, kind="stable")
                off = np.concatenate([[0], np.cumsum(size[order])])
                start = np.empty_like(many)
                start[order] = off[:-1]
                at = np.repeat(start - np.cumsum(many) + many, many) + np.arange(len(col))
                size, idx, w = size[order].astype(np.int32), np.zeros(off[-1], np.int32), np.zeros(off[-1])
                idx[at], w[at] = col, val
                parts = list(spans(size, PACK))
                yield pa.RecordBatch.from_arrays([
                    pa.array([size[x:y].tobytes() for x, y in parts], pa.binary()),
                    *(pa.array([v[off[x]:off[y]].tobytes() for x, y in parts], pa.binary()) for v in (idx, w))], names=["sizes", "idx", "w"])
    return m.rows.select("idx", "w").mapInArrow(run, "sizes binary, idx binary, w binary")


def numbers_of(column: pa.Array, kind: type) -> np.ndarray:
    """The numbers of all rows of bytes, without a copy."""
    _, off, data = column.cast(pa.binary()).buffers()
    off = np.frombuffer(off, np.int32, len(column) + 1, column.offset * 4) if len(column) else [0, 0]
    return np.frombuffer(data, np.uint8)[off[0]:off[-1]].view(kind) if off[-1] > off[0] else np.zeros(0, kind)


def unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(weights of each row, idx, w)`` of a bounded part of packed rows."""
    many, col, val = (numbers_of(c, t) for c, t in zip(batch.columns, (np.int32, np.int32, np.float64)))
    off = np.concatenate([[0], np.cumsum(many, dtype=np.int64)])
    for i, j in spans(many, CHUNK):
        yield many[i:j], col[off[i]:off[j]], val[off[i]:off[j]]


def one_pass(m: Matrix, centers: np.ndarray, blocks: DataFrame | None = None, with_costs: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(sums, counts, costs)`` of all rows under all restarts at once (costs:
    zeros if not asked for).  ``blocks``: the written ``packed`` rows of ``m``."""
    runs, k, size = centers.shape
    shared = m.rows.sparkSession.sparkContext.broadcast(centers)

    def run(batches):
        c = shared.value
        flat, c2 = np.ascontiguousarray(c.reshape(runs * k, size).T), (c * c).sum(axis=2).ravel()
        sums, counts, costs = np.zeros((runs, k * size)), np.zeros((runs, k)), np.zeros(runs)
        for batch in batches:
            for many, col, val in unpacked(batch):
                row = np.repeat(np.arange(len(many)), many)
                x2 = np.bincount(row, weights=val * val, minlength=len(many))
                d = distances(x2, times(len(many), row, col, val, flat), c2).reshape(len(many), runs, k)
                label = d.argmin(axis=2).T
                if with_costs:
                    costs += d.min(axis=2).sum(axis=0)
                for r in range(runs):
                    counts[r] += np.bincount(label[r], minlength=k)
                    sums[r] += np.bincount(np.repeat(label[r] * size, many) + col, weights=val, minlength=k * size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(runs * k + 1, dtype=np.int32)),
             pa.array([*(np.append(s, n).tobytes() for s, n in zip(sums.reshape(runs * k, size), counts.ravel())), costs.tobytes()], pa.binary())], names=["cell", "s"])

    def add(batches):
        total = {}
        for batch in batches:
            for cell, s in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = np.frombuffer(s.as_buffer())
                total[cell] = total[cell] + s if cell in total else s
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([s.tobytes() for s in total.values()], pa.binary())], names=["cell", "s"])

    blocks = packed(m) if blocks is None else blocks
    got = blocks.mapInArrow(run, "cell int, s binary").repartition("cell").mapInArrow(add, "cell int, s binary").collect()
    shared.unpersist()
    sums, counts, costs = np.zeros((runs * k, size)), np.zeros(runs * k), np.zeros(runs)
    for cell, s in got:
        s = np.frombuffer(s)
        if cell == runs * k:
            costs += s
        else:
            sums[cell], counts[cell] = s[:-1], s[-1]
    return sums.reshape(runs, k, size), counts.reshape(runs, k), costs


def kmeans_best(m: Matrix, k: int = R.KMEANS_K, seed: int = R.KMEANS_SEED, restarts: int = R.KMEANS_RESTARTS) -> Clusters:
    """k-means from several starts, advanced together: one pass over the rows
    an iteration, for the restarts whose centres still move; the model of least
    cost stays."""
    seeds = [seed + i for i in range(restarts)]
    blocks = write_out(packed(m), "blocks")
    centers = starting_centers(m, k, seeds)
    moving = np.arange(restarts)
    for _ in range(KMEANS_ITERATIONS):
        sums, counts, _ = one_pass(m, centers[moving], blocks, with_costs=False)
        new = np.where(counts[:, :, None] > 0, sums / np.maximum(counts, 1)[:, :, None], centers[moving])
        step = np.linalg.norm(new - centers[moving], axis=2).max(axis=1)
        centers[moving] = new
        moving = moving[step > KMEANS_MOVE]
        if not len(moving):
            break
    costs = one_pass(m, centers, blocks)[2]
    best = int(costs.argmin())
    return Clusters(centers[best], float(costs[best]), list(zip(seeds, costs.tolist(), strict=True)))


def assign(m: Matrix, centers: np.ndarray) -> DataFrame:
    """Key columns and ``cluster``, the nearest centre of every row."""
    c2 = (centers * centers).sum(axis=1)
    return each_row(m, np.ascontiguousarray(centers.T), "cluster int", lambda dots: [(c2 - 2 * dots).argmin(axis=1).astype(np.int32)])


def kmeans_8(df: DataFrame, text: str = "description_md", key: str = "job_id",
             extra: list[str] | None = None) -> tuple[DataFrame, Clusters, list[str]]:
    m = tfidf(df, text, [key] + (extra or []))
    best = kmeans_best(m)
    return assign(m, best.centers), best, m.vocab


def cluster_profiles(df: DataFrame, text: str = "description_md", key: str = "job_id",
                     dept: str = "title_department", pay: str = "mid_usd") -> DataFrame:
    """Per cluster: size, median pay, top centre terms, top departments."""
    assigned, best, vocab = kmeans_8(df, text, key, [dept, pay])
    spark = df.sparkSession
    terms = [(i, ", ".join(vocab[j] for j in np.argsort(-c, kind="stable")[:R.CLUSTER_TOP_TERMS]))
             for i, c in enumerate(best.centers)]
    terms_df = spark.createDataFrame(terms, "cluster int, top_terms string")
    assigned = write_out(assigned, "clusters")
    size = assigned.groupBy("cluster").agg(F.count("*").alias("n"), median(pay).alias("median_pay"))
    d = assigned.groupBy("cluster", dept).agg(F.count("*").alias("dn"))
    w = Window.partitionBy("cluster").orderBy(F.desc("dn"), F.asc(dept))
    top = (d.withColumn("r", F.row_number().over(w)).where(F.col("r") <= R.CLUSTER_TOP_DEPTS)
            .groupBy("cluster").agg(F.array_join(F.transform(
                F.array_sort(F.collect_list(F.struct("r", F.concat(F.col(dept), F.lit(" ("), F.col("dn"),
                                                                   F.lit(")")).alias("s")))),
                lambda x: x["s"]), ", ").alias("top_depts")))
    return (size.join(F.broadcast(terms_df), "cluster", "left").join(top, "cluster", "left")
                .orderBy("cluster"))
