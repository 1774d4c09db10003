"""Periodic runs, license scans and importance resampling against brute force,
on odd rows, empty tables and the driver's documents."""

import random

import brute
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from paygrid.llm import jaccard, licenses, periodic, recompression, resampling, words

SF = "/root/testdata/sf0.001"


def by_repr(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def documents():
    d = pd.read_parquet(f"{SF}/documents.parquet")
    return list(zip(d.doc_id.tolist(), d.text.tolist(), strict=True))


# ---------------------------------------------------------------- periodic runs

@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_brute_force(seed):
    r = random.Random(seed)
    for _ in range(60):
        w = [r.randint(0, r.choice([1, 2, 3])) for _ in range(r.randint(0, 60))]
        if w and r.random() < 0.6:
            p, s = r.randint(1, max(1, len(w) // 3)), r.randint(0, len(w) - 1)
            w = [w[s + (i - s) % p] if s + p <= i < s + 4 * p else x for i, x in enumerate(w)]
        for least, times in ((2, 2), (6, 3), (24, 3)):
            assert periodic.runs(w, least, times) == brute.periodic(w, least, times)


def test_repeating_windows_cover_every_run():
    r = random.Random(5)
    for _ in range(40):
        q = r.randint(1, 30)
        run = [f"r{r.randint(0, 8)}" for _ in range(q)]
        w = [f"a{k}" for k in range(r.randint(0, 40))] + (run * 30)[:max(24, 3 * q) + r.randint(0, 9)] + [f"z{k}" for k in range(20)]
        h = next(iter(words.split(pa.array([" ".join(w)])))).hashes
        lo, hi = periodic.repeating(h, np.array([0, len(w)]), 16)
        for s, n, _ in brute.periodic(w):
            assert any(a <= s and s + n <= b for a, b in zip(lo.tolist(), hi.tolist(), strict=True))


def test_strongest_is_exact():
    assert periodic.strongest([(0, 24, 8), (5, 48, 16), (9, 25, 8)]) == (9, 25, 8)
    assert periodic.strongest([(0, 24, 8), (5, 48, 16)]) == (0, 24, 8) and periodic.strongest([]) is None
    assert periodic.strongest([(0, 3 * (1 << 60), 1 << 60), (1, 3 * (1 << 60) + 1, 1 << 60)]) == (1, 3 * (1 << 60) + 1, 1 << 60)


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_periodic_rows(spark, odd, odd_rows, table):
    rows = odd_rows if table == "odd" else documents()
    df = odd if table == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    for plant in (periodic.planted, None):
        got = periodic.periodic_runs(df, places=plant).collect()
        assert by_repr(got) == by_repr(brute.periodic_row(i, t, plant is not None) for i, t in rows)


def test_periodic_texts_and_long_documents(spark, empty):
    base = " ".join(f"w{k}" for k in range(30))
    long = " ".join([f"x{k % 977}" for k in range(60_000)])
    df = spark.createDataFrame([(1, f"head {base} {base} {base} tail"), (2, long), (3, "same " * 1000)], "doc_id long, text string")
    got = {r.doc_id: r for r in periodic.periodic_runs(df, keep_text=True).collect()}
    assert got[1].collapsed == f"head {base} tail" and [tuple(x) for x in got[1].runs] == [(1, 90, 30)]
    assert (got[2].start, got[2].length, got[2].period, got[2].exponent_milli) == (0, 60_000, 977, 61412)
    assert got[3].collapsed == "same" and got[3].period == 1
    assert periodic.periodic_runs(empty).count() == 0


# ---------------------------------------------------------------- license scans

def noisy(text, seed, rate):
    r = random.Random(seed)
    return " ".join(x for w in text.split() for x in ([w] if r.random() > rate else r.choice([["edited"], [], [w, "more"]])))


@pytest.mark.parametrize("table", ["odd", "documents", "licenses"])
def test_license_rows(spark, odd, odd_rows, table):
    if table == "licenses":
        body = {t.label: t.text for t in licenses.TEXTS}
        rows = [(k, t.text) for k, t in enumerate(licenses.TEXTS)]
        rows += [(100 + k, "code before " * 30 + noisy(t.text, k, 0.06) + " code after" * 30) for k, t in enumerate(licenses.TEXTS)]
        rows += [(200, body["mit"] + "\n" + body["apache"]), (201, "MIT  License, Apache\nLICENSE; CC-BY, cc by by cc by"), (202, "GNU General Public"),
                 (203, "mit license " * 50), (204, " ".join(body["mit"].split()[::-1])), (205, body["mit"][:120]), (206, "É mit licenseé mit license"),
                 (None, "gnu general public license"), (207, body["gpl"]), (207, body["gpl"])]
    else:
        rows = odd_rows if table == "odd" else documents()
    df = odd if table == "odd" else spark.createDataFrame(rows, "doc_id long, text string")
    want = [brute.license_row(i, t, licenses.PHRASES, licenses.TEXTS, licenses.SHARE, licenses.DRIFT, licenses.GAP, licenses.STRETCH) for i, t in rows]
    got = by_repr(licenses.license_scan(df).collect())
    assert got == by_repr(want)
    if table == "licenses":
        labels = {r[0]: set(r[6].split(",")) for r in got}
        assert all(t.label in labels[k] and t.label in labels[100 + k] for k, t in enumerate(licenses.TEXTS))
        assert labels[200] == {"mit", "apache"} and labels[204] == {""} and labels[205] == {""}


def test_license_spans_and_empty(spark, empty):
    df = spark.createDataFrame([(1, "x y " + licenses.TEXTS[5].text + " z under the MIT License")], "doc_id long, text string")
    row = licenses.license_scan(df, keep_spans=True).first()
    n = len(brute.plain_words(licenses.TEXTS[5].text))
    assert [tuple(s) for s in row.spans] == [(2, 2 + n, "isc", 1.0), (n + 5, n + 7, "mit", 1.0)] and row.base_labels == "mit"
    assert licenses.license_scan(empty).count() == 0
    assert [tuple(r) for r in licenses.license_scan(df, phrases=(), texts=()).collect()] == [(1, n + 7, 0, None, None, "", "", 0.0)]


# ---------------------------------------------------------------- resampling

@pytest.mark.parametrize("grams", [1, 2, 3])
def test_features_are_all_runs_of_words(grams):
    data = resampling.collapse("Été, x1--y2 z! \x00 É a")
    w = brute.plain_words("Été, x1--y2 z! \x00 É a")
    import zlib
    want = [zlib.crc32(" ".join(w[i:i + n]).encode()) for n in range(1, grams + 1) for i in range(len(w) - n + 1)]
    assert data.decode().split() == w and list(resampling.features(data, resampling.patterns(grams))) == want


@pytest.mark.parametrize("table", ["odd", "documents", "twins"])
@pytest.mark.parametrize("grams", [1, 2])
def test_resampled_rows(spark, odd, odd_rows, table, grams):
    rows = {"odd": odd_rows, "documents": documents(), "twins": [(k % 40, f"tie {'word ' * 25}") for k in range(200)]}[table]
    df = odd if table == "odd" else spark.createDataFrame(rows, "doc_id long, text string")
    target = pd.read_parquet(f"{SF}/benchmark.parquet").text.tolist()
    aims = spark.createDataFrame([(t, 1) for t in [*target, None, ""]], "text string, rank int")
    got = resampling.resample(df, aims, grams=grams, percent=30).collect()
    want = brute.resampled(rows, target, grams, percent=30)
    if table == "documents":
        assert by_repr(got) == by_repr(want)
    else:                               # equal rows take turns
        assert by_repr(r[:4] for r in got) == by_repr(r[:4] for r in want)
        assert sorted(r["rank"] for r in got if r["rank"]) == sorted(r[4] for r in want if r[4])
        assert by_repr((r["rank"], r.doc_id, r.score) for r in got if r["rank"]) == by_repr((r[4], r[0], r[3]) for r in want if r[4])


def test_resampling_empty_tables(spark, empty, odd):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(empty, none).count() == 0
    got = resampling.resample(odd, none)
    assert got.count() == odd.count() and got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    picked = resampling.drawn(odd.where("doc_id is not null"), got)
    assert picked.columns == odd.columns and picked.count() == got.where("rank is not null and doc_id is not null").count()


# ---------------------------------------------------------------- names of long words

def thue_morse(n, a, b):
    return "".join(b if bin(k).count("1") % 2 else a for k in range(n))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_long_words_have_their_own_names(spark, n):
    x, y = thue_morse(n, "a", "b"), thue_morse(n, "b", "a")
    h = next(iter(words.split(pa.array([f"{x} {y}"])))).hashes
    assert h[0] != h[1]
    filler = [f"f{k}" for k in range(40)]
    rows = [(1, x), (2, y), (3, " ".join([x, *filler, "end"])), (4, " ".join([y, *filler, "stop"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_repr(jaccard.similar_components(df).collect()) == by_repr(brute.components(rows))
    assert by_repr(recompression.remove_repeats(df).collect()) == by_repr(brute.removed(rows))


def test_spans_of_morse_patterns_differ():
    pair = np.array([0x1234567890ABCDEF, 0xFEDCBA0987654321], np.uint64)
    bits = np.array([bin(k).count("1") % 2 for k in range(4096)])
    h = np.concatenate([pair[bits], pair[1 - bits], pair[bits]])
    one = recompression.Spans(h).hash(np.array([0, 4096, 8192]), np.array([4096, 8192, 12288]))
    assert one[0] != one[1] and one[0] == one[2]
