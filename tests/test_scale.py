"""Steps that work on a bounded part of a batch, read a text once, or add up inside a task."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paygrid import rules as R
from paygrid.arrow import list_sizes, spans, text_sizes
from paygrid.functions import classify as C
from paygrid.functions import salary as SAL
from paygrid.functions.regex import fold, lowered, search
from paygrid.operators import ml, nlp
from paygrid.sources import pages


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_spans_are_bounded_and_whole():
    sizes = np.array([3, 3, 0, 50, 0, 4, 4, 4])
    got = list(spans(sizes, 8, 3))
    assert [i for i, _ in got] + [8] == [0] + [j for _, j in got]
    assert all(j - i == 1 or (sizes[i:j].sum() <= 8 and j - i <= 3) for i, j in got)
    assert list(spans(np.zeros(0, int), 8)) == []
    assert list_sizes(pa.array([["a"], None, []])).tolist() == [1, 0, 0]
    assert text_sizes(pa.array(["été", None, ""])).tolist() == [5, 0, 0]


# F1, F2, F3, F5, F6

def test_terms_of_many_words(monkeypatch):
    monkeypatch.setattr(ml, "CHUNK", 40)
    r = np.random.default_rng(3)
    words = ["fox", "foxy", "red", "the", "été", "zz", "fo", "été_1"]
    rows = [None if n == 7 else [words[i] for i in r.integers(0, len(words), n)] for n in r.integers(0, 60, 50)]
    for row, got in zip(rows, ml.counted(pa.array(rows, pa.list_(pa.string()))).to_pylist(), strict=True):
        if row is None:
            assert got is None
            continue
        kept = [w for w in row if w not in R.SPARK_ENGLISH_STOPWORDS]
        want = Counter(kept) + Counter(f"{a} {b}" for a, b in zip(kept, kept[1:]))
        assert [(t["first"], t["n"]) for t in got] == sorted(want.items(), key=lambda x: x[0].encode())


def test_vocabulary_adds_up_in_tasks(spark):
    df = spark.createDataFrame([(i, "red fox" if i % 2 else "red red hen") for i in range(20)] + [(20, "")], "id int, t string")
    got = ml.vocabulary(df.select(ml.terms_of(F.col("t")).alias("_terms")), 21, 10)
    assert {r.term: (r.total, r.df) for r in got.collect()} == {
        "red fox": (10, 10), "fox": (10, 10), "hen": (10, 10), "red hen": (10, 10), "red red": (10, 10)}  # red: in more than 85 %
    assert "Generate" not in plan(got) and "MapInArrow" in plan(got)


@pytest.mark.parametrize("share", [0.005, 0.5])
def test_sparse_and_dense_products(share, monkeypatch):
    monkeypatch.setattr(ml, "BLOCK_CELLS", 100)
    r = np.random.default_rng(1)
    x = r.random((300, 200)) * (r.random((300, 200)) < share)
    x[5:140] = 0
    row, col = np.nonzero(x)
    block = r.random((200, 7))
    assert np.allclose(ml.times(300, row, col, x[row, col], block), x @ block)
    assert not ml.times(4, row[:0], col[:0], x[row, col][:0], block).any()


# round 4: F1, F2

def odd_texts(seed, rows):
    r = np.random.default_rng(seed)
    words = ["fox", "Foxy", "red", "the", "of", "été", "zz", "x", "été_1", "\U0001d54f", "\U0001d54f\U0001d550", "5", "55", "a\u0301b", *(f"w{i}" for i in range(40))]
    share = 1 / np.arange(1, len(words) + 1)
    texts = ["the Common  word, " + "; ".join(words[i] for i in r.choice(len(words), n, p=share / share.sum())) for n in r.integers(0, 40, rows)]
    return [*texts, "", " ", "the", "fox fox fox fox", "zz\nzz\tzz", None, None]


@pytest.mark.parametrize("most", [1, 7, 60, 5000])
def test_frequent_terms_are_those_of_the_vocabulary(spark, monkeypatch, most):
    monkeypatch.setattr(ml, "CHUNK", 1)           # words are handed on after a few
    monkeypatch.setattr(ml, "PIECE", 100)
    df = spark.createDataFrame([(t,) for t in odd_texts(most, 300)], "t string").where("t is not null").repartition(3)
    words = df.select(ml.words_of(F.col("t")).alias("_words")).localCheckpoint()
    n = words.count()
    want = [(r.term, r.df) for r in ml.vocabulary(df.select(ml.terms_of(F.col("t")).alias("_terms")), n, most).collect()]
    assert want
    for sample in (1, 40, n):
        terms, dfs = ml.frequent_terms(words, n, most, sample)
        assert list(zip(terms, dfs)) == want


def test_only_likely_pairs_leave_the_tasks(spark, monkeypatch):
    monkeypatch.setattr(ml, "PIECE", 500)
    r = np.random.default_rng(5)
    rows = [" ".join(["red fox", *(f"w{i}" for i in r.integers(0, 60, 20))]) for _ in range(400)]
    words = spark.createDataFrame([(t,) for t in rows], "_words string").repartition(4)
    known = ["red", "fox", *(f"w{i}" for i in range(60))]
    got = {x.term for x in ml.likely_pairs(words, known, 300, 400 * 22).collect()}
    assert "red fox" in got and len(got) < 10           # of about 3,600
    assert len({x.term for x in ml.likely_pairs(words, known, 1, 400 * 22).collect()}) > 3000


def test_rows_are_those_of_the_terms(spark):
    """TF-IDF of words and pairs against one row at a time."""
    texts = odd_texts(2, 120)
    df = spark.createDataFrame(list(enumerate(texts)), "job_id int, description_md string")
    m = ml.tfidf(df, keep=["job_id"], partitions=2)
    counts = {r.job_id: {x["first"]: x.n for x in r.t} for r in df.select("job_id", ml.terms_of(F.col("description_md")).alias("t")).collect() if r.t is not None}
    with_term = Counter(t for c in counts.values() for t in c)
    got = {r.job_id: (r.idx, r.w) for r in m.rows.collect()}
    assert set(got) == set(counts) and m.n == len(counts) and len(m.vocab) > 50
    for key, c in counts.items():
        w = np.array([c.get(t, 0) * (np.log((1 + m.n) / (1 + with_term[t])) + 1) for t in m.vocab])
        at = np.flatnonzero(w)
        assert got[key][0] == at.tolist() and np.allclose(got[key][1], w[at] / np.linalg.norm(w) if len(at) else [])


@pytest.mark.parametrize("columns", [1, 80])
def test_products_of_rows_of_any_width(columns):
    r = np.random.default_rng(4)
    many = np.concatenate([[0, 1, 8, 9, 16, 300, 0], r.integers(0, 60, 200), [299, 0]])
    col = np.concatenate([np.sort(r.choice(300, n, replace=False)) for n in many]).astype(np.int32)
    row, val, block = np.repeat(np.arange(len(many)), many), r.random(len(col)), r.random((300, columns))
    x = np.zeros((len(many), 300))
    x[row, col] = val
    assert np.allclose(ml.times(len(many), row, col, val, block), x @ block)


def test_passes_read_packed_rows(spark, monkeypatch):
    monkeypatch.setattr(ml, "PACK", 50)
    r = np.random.default_rng(6)
    x = r.random((150, 90)) * (r.random((150, 90)) < 0.2)
    x[[0, 7, 149]], x[60] = 0, 1
    rows = spark.createDataFrame([(np.flatnonzero(v).tolist(), v[v > 0].tolist()) for v in x], "idx array<int>, w array<double>").repartition(3)
    m = ml.Matrix(rows, [f"t{i}" for i in range(90)], len(x))
    blocks = ml.packed(m)
    assert dict(blocks.dtypes) == {"sizes": "binary", "idx": "binary", "w": "binary"} and 10 < blocks.count() < 150
    centers = r.random((2, 3, 90))
    sums, counts, costs = ml.one_pass(m, centers, blocks)
    for k in range(2):
        d = ((x[:, None] - centers[k]) ** 2).sum(axis=2)
        assert counts[k].tolist() == np.bincount(d.argmin(axis=1), minlength=3).tolist() and np.isclose(costs[k], d.min(axis=1).sum())
        assert all(np.allclose(sums[k, j], x[d.argmin(axis=1) == j].sum(axis=0)) for j in range(3))
    assert not ml.one_pass(m, centers, blocks, with_costs=False)[2].any()


# F7, F9

def test_text_is_lowered_once(spark):
    df = spark.createDataFrame([("Own the ROADMAP",), (None,), ("x",)], "description_md string")
    got = df.select(C.scope_score().alias("s"))
    assert [r.s for r in got.collect()] == [9, 5, 5]
    assert plan(got).count("lower(") == 1


def test_folded_text_has_folded_patterns(spark):
    assert lowered(r"\bPh\.?D\B|[A-C]\S\p{Lu}") == r"\bph\.?d\B|[a-c]\S\p{Lu}"
    df = spark.createDataFrame([(t,) for t in ("PYTHON", "ſql", "gİt", "Kotlin", "ruby", "RUBY_", "c++11", "", None)], "t string")
    every = [p for _, p in R.SKILL_KEYWORDS + R.EDU_PATTERNS]
    for row in df.select(*[F.struct(search(F.col("t"), p).alias("a"), search(F.col("t"), p, folded=fold(F.col("t"))).alias("b"))
                           for p in every]).collect():
        assert all(c.a == c.b for c in row)
    assert "(?iUd)" not in plan(nlp.skill_counts(df.withColumnRenamed("t", "description_md")))


# F4, F8

def test_board_content_parses_once(spark, monkeypatch):
    htmls = ["&lt;h3&gt;Salary&lt;/h3&gt;&lt;p&gt;$1,000 - $2,000&lt;/p&gt;&lt;ul&gt;&lt;li&gt;a  b&lt;/ul&gt;", "<br/><b>x</b> <p/>y<script>z</script>",
             "<div> a\n\n b <ol><li>1</li><li>2", "", None]
    for h in filter(None, htmls):
        md = pages._Markdown(False)
        pages.Tree(pages._html.unescape(h), md)
        assert md.text() == pages.to_markdown(h)
    got = pages.board_content(spark.createDataFrame(list(enumerate(htmls)), "k int, content_html string"))
    assert {r.k: r.description_md for r in got.collect()} == {k: pages.to_markdown(h) for k, h in enumerate(htmls)}


def test_pages_in_bounded_parts(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else f"<main>{i}</main>") for i in range(1300)], "page_id long, html string").coalesce(1)
    got = pages.main_content(df)
    assert "MapInArrow" in plan(got)
    assert {r.page_id: r.text for r in got.collect()} == {i: "" if i % 7 == 0 else str(i) for i in range(1300)}


def test_salary_patterns_run_once(spark):
    df = spark.createDataFrame([("$10 to $20/hr",), ("10 - 20 CAD",), ("from £30",), ("EUR",), ("",), (None,)], "t string")
    got = df.select(SAL.parse_salary("t").alias("s"))
    assert [(r.s.currency, r.s.salary_min, r.s.salary_max) for r in got.collect()] == [
        ("USD", 10, 20), ("CAD", 10, 20), ("GBP", 30, 30), ("EUR", None, None), (None, None, None), (None, None, None)]
    assert plan(got).count(SAL.RANGE) <= 4
