"""Operators against brute force on a small fixture with odd rows, and on
empty tables."""

import random
import time
import zlib
from itertools import combinations_with_replacement

import brute
import numpy as np
import pandas as pd
import pytest
from paygrid.llm import (cascade, html, jaccard, langid, packing, quality, queries, recompression, secrets, sharding, templates, words)
from paygrid.session import write_out
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def by_repr(rows):
    return sorted(rows, key=repr)


def documents():
    d = pd.read_parquet(f"{SF}/documents.parquet")
    return list(zip(d.doc_id.tolist(), d.text.tolist(), strict=True))


# ---------------------------------------------------------------- secrets

def test_trigram_queries():
    q = {r.kind: secrets.trigram_query(r.regex) for r in (*secrets.BASE, *secrets.EXTRA)}
    assert q["hex"] == [] and q["access"] == [frozenset({"aki", "kia"})]
    assert len(q["assign"]) == 6 and all(len(b) <= secrets.BRANCH_TRIGRAMS for b in q["assign"])
    assert secrets.trigram_query("ab?c") == [] and secrets.trigram_query("xyz+") == [] and secrets.trigram_query("(foo|bar)x") != []


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_secret_scan(spark, odd, odd_rows, table):
    rows = odd_rows if table == "odd" else documents()
    df = odd if table == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    got = rows_of(secrets.report(df), "doc_id", "base_sha256", "n_assign", "n_access", "n_hex")
    want = [(i, brute.sha(s), *(s.count(k + ":") for k in ("assign", "access", "hex"))) for i, s in
            ((i, brute.secret_spans(t)) for i, t in rows)]
    assert got == by_repr(want)


def test_extra_rules_and_redaction(spark, odd):
    spans = {r.doc_id: r.spans for r in secrets.report(odd).collect()}
    assert "github:0:44" in spans[44] and "pem:45:76" in spans[44]
    red = secrets.redact(odd)
    assert red.columns == odd.columns and red.count() == odd.count()
    text = {r.doc_id: r.text for r in red.collect()}
    assert text[44] == "[SECRET] [SECRET]" and text[1] is None and "abcdef" not in text[40] and text[6] == "a b c d e"
    assert "token=abc " in text[40]


FORMATS = {                      # kind: (a match, texts without one)
    "pem": ("-----BEGIN EC PRIVATE KEY-----", ["-----BEGIN PUBLIC KEY-----"]),
    "github": ("gho_" + "a1B2" * 9, ["gho_" + "a1B2" * 8, "ghx_" + "a1B2" * 9]),
    "slack": ("xoxb-1234567890-ab", ["xoxb-123", "xoxz-1234567890"]),
    "jwt": ("eyJhbGci.eyJzdWIi.c2ln", ["eyJhbGci.c2ln", "eyJhbGci.eyJzdWIi"]),
    "aws_session": ("ASIA" + "A1" * 8, ["ASIA" + "A1" * 7, "asia" + "a1" * 8]),
    "google_api": ("AIza" + "x_-9a" * 7, ["AIza" + "x_-9" * 7]),
    "google_client": ("GOCSPX-" + "aB-1" * 7, ["GOCSPX-" + "aB" * 7]),
    "google_token": ("ya29." + "a0B_" * 5, ["ya29x" + "a0B_" * 5, "ya29.abc"]),
    "stripe": ("rk_live_" + "a1B2" * 4, ["rk_prod_" + "a1B2" * 4, "sk_live_a1"]),
    "square": ("sq0csp-" + "a1_B-" * 5, ["sq0abc-" + "a1_B-" * 5, "sq0csp-a1"]),
    "braintree": ("access_token$production$" + "a1b2" * 4 + "$" + "0f" * 16, ["access_token$sandbox$" + "a1b2" * 4 + "$" + "0f" * 16]),
    "shopify": ("shpss_" + "0F" * 16, ["shpss_" + "0G" * 16, "shpzz_" + "0F" * 16]),
    "npm": ("npm_" + "a1B2" * 9, ["npm_" + "a1B2" * 8]),
    "pypi": ("pypi-AgEI" + "a1B_-" * 10, ["pypi-AgEI" + "a1B_-" * 9, "pypi-" + "a1B_-" * 12]),
    "rubygems": ("rubygems_" + "0f" * 24, ["rubygems_" + "0f" * 23]),
    "gitlab": ("glpat-" + "a1_-B" * 4, ["glpat-a1", "glpas-" + "a1_-B" * 4]),
    "github_pat": ("github_pat_" + "a1B_" * 6, ["github_pat_a1B"]),
    "sendgrid": ("SG." + "a1B2" * 4 + "." + "c3D4" * 4, ["SG." + "a1B2" * 4, "sg." + "a1B2" * 4 + "." + "c3D4" * 4]),
    "mailgun": ("key-" + "0a" * 16, ["key-" + "0a" * 15, "key-" + "0z" * 16]),
    "mailchimp": ("0a" * 16 + "-us12", ["0a" * 16 + "-eu12", "0a" * 15 + "-us1"]),
    "telegram": ("123456789:AA" + "a1B" * 11, ["123456789:AB" + "a1B" * 11, "1234:AA" + "a1B" * 11]),
    "slack_hook": ("hooks.slack.com/services/T0/B0/" + "aB1c" * 5, ["hooks.slack.com/services/X0/B0/" + "aB1c" * 5]),
    "discord_hook": ("discordapp.com/api/webhooks/1234567890/" + "a_-1B" * 6, ["discord.com/api/webhooks/123/" + "a_-1B" * 6]),
    "huggingface": ("hf_" + "aB1" * 10, ["hf_" + "aB1" * 9]),
    "url_password": ("postgres://me:pa55@db.example.org", ["https://example.org:80/x", "https://example.org/a:b@c d"]),
    "azure_account": ("AccountKey=" + "aB1+/" * 8 + "==", ["AccountKey=abc", "Accountkey=" + "aB1+/" * 8]),
    "digitalocean": ("dop_v1_" + "0f" * 32, ["dop_v2_" + "0f" * 32]),
    "databricks": ("dapi" + "0f" * 16, ["dapi" + "0f" * 15]),
    "newrelic": ("NRAK-" + "A1B" * 9, ["NRAK-" + "A1B" * 8]),
    "doppler": ("dp.pt." + "aB1c" * 10, ["dp.st." + "aB1c" * 10]),
    "linear": ("lin_api_" + "aB1c" * 10, ["lin_api_" + "aB1c" * 9]),
    "postman": ("PMAK-" + "0f" * 12 + "-" + "0f" * 17, ["PMAK-" + "0f" * 12]),
    "vault": ("hvs." + "aB_-" * 6, ["hvs." + "aB_-" * 5, "hvx." + "aB_-" * 6]),
    "age": ("AGE-SECRET-KEY-1" + "QP" * 29, ["AGE-SECRET-KEY-1" + "QP" * 28]),
    "bearer": ("Bearer abc.def-" + "a1B2" * 4, ["Bearer of bad news", "bearer: " + "a1B2" * 5]),
}


def test_public_formats(spark):
    assert set(FORMATS) == {r.kind for r in secrets.EXTRA} and len(FORMATS) >= 25
    assert all(secrets.trigram_query(r.regex) for r in secrets.EXTRA)
    rows = [(f"{kind}+", f"été {hit} .") for kind, (hit, _) in FORMATS.items()]
    rows += [(f"{kind}-{k}", f"a {miss} .") for kind, (_, misses) in FORMATS.items() for k, miss in enumerate(misses)]
    got = {r.doc_id: r.spans.split(",") for r in secrets.report(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    for kind, (hit, misses) in FORMATS.items():
        assert f"{kind}:4:{4 + len(hit)}" in got[f"{kind}+"], kind
        assert not any(x.startswith(kind + ":") for k in range(len(misses)) for x in got[f"{kind}-{k}"]), kind


def test_redaction_of_overlapping_and_many_spans(spark):
    text = "é token=" + "0a" * 16 + "-us1 mid " + " ".join(f"secret=abcdef{k}" for k in range(300)) + " end é"
    got = secrets.redact(spark.createDataFrame([(1, text), (2, "AKIA" + "A" * 20)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == {1: "é [SECRET] mid " + " ".join(["[SECRET]"] * 300) + " end é", 2: "[SECRET]"}


# ---------------------------------------------------------------- rules

@pytest.mark.parametrize("table", ["odd", "documents"])
def test_quality_counts(spark, odd, odd_rows, table):
    rows = odd_rows if table == "odd" else documents()
    df = odd if table == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    got = rows_of(cascade.apply_rules(df), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = [(i, *c, c[0] < 20 or 100 * c[4] > 30 * c[0]) for i, c in ((i, brute.quality_counts(t)) for i, t in rows)]
    assert got == by_repr(want)


def test_rule_order_and_verdict(spark):
    docs = spark.createDataFrame([(1, "word " * 3 + "$$$ " * 40), (2, " ".join(f"plain{i} talk" for i in range(30))),
                                  (3, " ".join(f"LOUD{i}" for i in range(40)))], "doc_id long, text string")
    assert [tuple(r) for r in cascade.apply_rules(docs).orderBy("doc_id").select("doc_id", "kept").collect()] == [(1, False), (2, True), (3, False)]
    rules = cascade.default_rules(F.col("text"))
    ordered = cascade.order_rules(cascade.counts(docs), rules)
    assert {r.name for r in ordered} == {r.name for r in rules}
    seconds, fails = cascade.measure(cascade.counts(docs), rules)
    assert sum(fails.values()) == 3 and all(s > 0 for s in seconds.values())


def test_order_counts_what_is_left():
    seconds = {"a": 1.0, "b": 1.0, "c": 10.0}
    # a and b reject mostly the same rows: after a, b has 1 left and c 50 at ten times the cost
    assert cascade.greedy_order(["a", "b", "c"], seconds, {0: 900, 0b011: 60, 0b001: 10, 0b010: 1, 0b100: 50}) == ["a", "c", "b"]
    assert cascade.greedy_order(["c", "b", "a"], seconds, {0: 5}) == ["a", "b", "c"]


def test_long_clean_texts_stay(spark):
    r = random.Random(3)
    book = " ".join(f"w{min(int(r.paretovariate(0.7)), 40_000)}" for _ in range(120_000))        # few kinds for its length, as in a book
    junk = " ".join(f"w{r.randint(0, 300)}" for _ in range(60_000))
    got = cascade.apply_rules(spark.createDataFrame([(1, book), (2, junk)], "doc_id long, text string"))
    assert {x.doc_id: x.kept for x in got.collect()} == {1: True, 2: False}


def test_sample_spans_all_partitions(spark):
    docs = spark.range(40_000).selectExpr("if(id % 3 = 0, null, id) as doc_id", "'x' as text", "id").repartition(8)
    got = cascade.sample_of(docs, 1_000).select(F.spark_partition_id().alias("p")).toPandas()
    assert 700 < len(got) < 1_300 and got.p.nunique() == 8


# ---------------------------------------------------------------- shards

def test_minimax_equals_brute_force():
    r = random.Random(1)
    for _ in range(200):
        s, k = np.array([r.choice([1, 2, 5, 30]) for _ in range(r.randint(1, 9))]), r.randint(1, 4)
        best = min(max(int(s[a:b].sum()) for a, b in zip((0, *c), (*c, len(s)), strict=True))
                   for c in combinations_with_replacement(range(len(s) + 1), k - 1))
        cap, cuts = sharding.minimax_cuts(s, k)
        ends = [0, *cuts]
        assert cap == best == max(int(s[a:b].sum()) for a, b in zip(ends, ends[1:], strict=False)) and ends[-1] == len(s)


@pytest.mark.parametrize("bits, shards", [(1, 4), (3, 16), (18, 16), (5, 2)])
def test_capacity_is_that_of_single_texts(spark, monkeypatch, bits, shards):
    monkeypatch.setattr(sharding, "MORE", 2)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.union(docs.where("doc_id % 7 = 0")).union(docs.where("doc_id % 21 = 0"))
    got = sharding.assign_shards(docs, shards=shards, bits=bits).toPandas()
    units = docs.groupBy(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).agg(F.sum(sharding.text_size(F.col("text"))).alias("n")).toPandas()
    least, _ = sharding.minimax_cuts(units.sort_values("h").n.to_numpy(np.int64), shards)
    assert got.groupby("shard")["size"].sum().max() == least and got["size"].sum() == units.n.sum()
    assert got.groupby("text_crc32").shard.nunique().max() == 1 and len(got) == docs.count()


def test_ranges_are_split_only_where_it_matters():
    single = np.array([False] * 6)
    assert sharding.to_split(np.array([5, 5, 5, 5, 5, 5]), single, 2, 15).tolist() == []       # an even cut cannot be bettered
    assert sharding.to_split(np.array([5, 5, 9, 5, 5, 1]), single, 2, 19).tolist() == [2, 4]
    assert sharding.to_split(np.array([1, 9, 1]), np.array([True] * 3), 2, 10).tolist() == []


def test_shards(spark, odd, odd_rows):
    got = sharding.assign_shards(odd, shards=4).toPandas()
    assert sorted(got["size"]) == sorted(len((t or "").encode()) + 1 for _, t in odd_rows)
    assert sorted(got["text_crc32"]) == sorted(zlib.crc32((t or "").encode()) for _, t in odd_rows)
    assert got["grown_shard"].isna().all() and set(got["law"]) == {"bytes"} and set(got["shard"]) <= set(range(4))
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert (got.groupby("text_crc32")["shard"].nunique() == 1).all()


# ---------------------------------------------------------------- packing

def test_tokens_pieces_and_sequences(spark, odd, odd_rows):
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    cap = 256
    got = packing.pack(spark, odd, capacity=cap).toPandas()
    want = []
    for i, t in odd_rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, p, s, n, zlib.crc32(ids[s:s + n].tobytes())) for p, (s, n) in enumerate(packing.piece_bounds(len(ids), cap))]
    key = lambda x: repr(tuple(-1 if v is None or v != v else int(v) for v in x))
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(key, got[cols].itertuples(index=False))) == sorted(map(key, want))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= cap
    assert got["sequence_id"].nunique() <= packing.least_bins(np.bincount(got["length"], minlength=cap + 1), cap) + 1


def test_added_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"see {end} here", end, f"{end}{end}", f"{end} start", f"stop {end}", f"a  {end}  b", f"a{end}b\n\n{end}\n", f" {end} ",
             f"x \t{end}\u00a0y", "<|endoftext|", f"<{end}>", "<|ENDOFTEXT|>", "<| endoftext |>", f"it's{end}'s", "é" * 9 + end + "ß" * 9]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [3826, 220, 50256, 994]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = packing.pack(spark, docs, capacity=2048)
    assert rows_of(got, "doc_id", "length", "ids_crc32") == by_repr(
        (i, len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes())) for i, ids in enumerate(want))


@pytest.mark.parametrize("space", [" ", "\t", "\n", "\r\n", "\u00a0"])
def test_long_white_space(space):
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    path = public_tokenizers.path(packing.VOCABULARY)
    for text in (f"a{space * 1_000_000}b <|endoftext|> c", space * 1_000_000, f"x{space * 300_000}"):
        assert packing.token_ids(text, path) == tok.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_bin_completion(seed):
    r = np.random.default_rng(seed)
    counts = np.bincount(r.integers(*[(20, 40), (1, 101), (30, 60), (10, 35), (45, 55), (1, 30)][seed], 60), minlength=101)
    plan = packing.pack_histogram(counts, 100)
    used = np.zeros(101, int)
    for fill, times in plan:
        assert sum(fill) <= 100
        np.add.at(used, list(fill), times)
    assert (used == counts).all()
    n = sum(t for _, t in plan)
    assert packing.least_bins(counts, 100) <= n <= sum(t for _, t in packing.best_fit(counts, 100))


@pytest.mark.parametrize("copies", [1, 2, 7, 1000])
def test_bin_completion_tries_equal_totals(copies):
    counts = np.bincount([60, 52, 51, 39, 30, 25, 18, 15, 10], minlength=101) * copies
    assert sum(t for _, t in packing.best_fit(counts, 100)) > 3 * copies
    plan = packing.pack_histogram(counts, 100)
    used = np.zeros(101, int)
    for fill, times in plan:
        assert sum(fill) <= 100
        np.add.at(used, list(fill), times)
    assert (used == counts).all() and sum(t for _, t in plan) == 3 * copies


@pytest.mark.parametrize("seed", range(40))
def test_bin_completion_is_optimal(seed):
    r = random.Random(seed)
    pieces = tuple(sorted((r.randint(1, 18) for _ in range(r.randint(5, 10))), reverse=True))

    def least(k, bins):
        if k == len(pieces):
            return len(bins)
        tries = [least(k + 1, [*bins[:i], b + pieces[k], *bins[i + 1:]]) for i, b in enumerate(bins)
                 if b + pieces[k] <= 20 and b not in bins[:i]]
        return min([*tries, least(k + 1, [*bins, pieces[k]])])

    plan = packing.pack_histogram(np.bincount(pieces, minlength=21), 20)
    assert sorted((x for f, t in plan for x in f * t), reverse=True) == list(pieces)
    assert sum(t for _, t in plan) == least(0, [])


# ---------------------------------------------------------------- near copies and repeats

@pytest.mark.parametrize("table", ["odd", "documents"])
def test_jaccard_components(spark, odd, odd_rows, table):
    rows = odd_rows if table == "odd" else documents()
    df = odd if table == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    assert rows_of(jaccard.similar_components(df), "doc_id", "n_shingles", "component_id") == by_repr(brute.components(rows))


def test_jaccard_small_blocks(spark, odd_rows, odd, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 2)
    monkeypatch.setattr(jaccard, "COMMON_LEAST", 2)
    assert rows_of(jaccard.similar_components(odd), "doc_id", "n_shingles", "component_id") == by_repr(brute.components(odd_rows))


@pytest.mark.parametrize("size", [35, 7, 3])
def test_recompression_odd(spark, odd, odd_rows, size):
    got = rows_of(recompression.remove_repeats(odd, size=size), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == by_repr(brute.removed(odd_rows, size))


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_recompression_rounds(spark, rounds):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = rows_of(recompression.remove_repeats(df, rounds=rounds), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == by_repr(brute.removed(documents()))


def test_symbols_are_consistent():
    """A window's symbols do not depend on what stands around it."""
    r = np.random.default_rng(3)
    core = words.mix(r.integers(0, 4, 40).astype(np.uint64))
    seen = set()
    for _ in range(20):
        a, b = (words.mix(r.integers(0, 4, r.integers(0, 30)).astype(np.uint64)) for _ in range(2))
        h = np.concatenate([a, core, b])
        sym, lo, hi = recompression.parse(h, np.array([0, len(h)]), 3)
        m = (lo >= len(a)) & (hi < len(a) + 40)
        seen.add(tuple(zip(sym[m].tolist(), (lo[m] - len(a)).tolist(), (hi[m] - len(a)).tolist(), strict=True)))
    assert len(seen) == 1


# ---------------------------------------------------------------- benchmark, quality, language, pages

ITEMS = [(1, "A train leaves Boston at 9 and travels 120 miles in 3 hours so how fast does the train go if Boston is its start?"),
         (2, "tiny item here"), (3, None), (4, "12 13"), (5, "Many plain words make up this other benchmark item that nobody changed at all")]


def test_template_leaks(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    other = ITEMS[0][1].replace("Boston", "Oslo").replace("120", "80").replace(" 9 ", " 7 ").replace("3 h", "2 h")
    mixed = other.replace("if Oslo", "if Rome")
    docs = spark.createDataFrame([
        (1, "intro words. " + ITEMS[0][1]), (2, "Well. " + other), (3, "Well. " + mixed), (4, "nothing of it in this text"),
        (5, "so tiny item here it is"), (6, ITEMS[4][1].upper()), (7, None), (8, ""), (9, "12 13"), (9, "12 13"),
        (10, "x " + "\n".join(ITEMS[4][1].split()))], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.exact for r in templates.leaks(docs, items).collect()}
    assert got[1, 1] and got[2, 1] is False and got[5, 2] and got[6, 5] and got[10, 5]
    assert (3, 1) not in got and not {d for d, _ in got} & {4, 7, 8} and got[9, 4]
    assert sorted(r.doc_id for r in templates.drop_leaked(docs, items).collect()) == [3, 4, 7, 8]
    assert templates.leaks(docs, items.limit(0)).count() == 0


def test_short_items_are_whole_lines(spark):
    items = spark.createDataFrame([(1, "Who, me?"), (2, "Yes."), (3, "?!"), (4, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "first line\n  who  me \nlast"), (2, "who me or you"), (3, "YES!"), (3, "YES!"), (4, "yes\n\nno?\nyes"), (5, "?!"),
                                  (6, None), (7, "")], "doc_id long, text string")
    got = [(r.doc_id, r.item_id, r.covered, r.exact) for r in templates.leaks(docs, items).collect()]
    assert sorted(got) == [(1, 1, 2, True), (3, 2, 1, True), (4, 2, 1, True)]
    assert sorted(r.doc_id for r in templates.drop_leaked(docs, items).collect()) == [2, 5, 6, 7]


def test_literal_leaks(spark):
    words_ = [f"plain{i}" for i in range(60)]
    words_[5] = words_[50] = "77"
    items = [(1, "What is 23 plus 45?"), (2, "1914 1918 1939 1945 1950 1953 1955 1975 1979 1989"),
             (3, "Paris London Rome Madrid Vienna Berlin Oslo Lisbon Dublin Prague Warsaw Athens Helsinki Sofia"), (4, " ".join(words_)), (5, "12 13")]
    changed = words_[:50] + ["78"] + words_[51:]
    docs = [(1, "so, What is 23 plus 45? it asks"), (2, "years: " + items[1][1] + " and more"), (3, "we saw " + items[2][1] + " there"),
            (4, "well " + " ".join(changed)), (5, "What is 24 plus 45?"), (6, "1914 1918 1940 1945 1950 1954 1955 1975 1980 1989"), (7, "12 13"),
            (8, items[2][1].lower()), (9, "Rome Oslo Paris Madrid Vienna London Berlin Dublin Lisbon Prague")]
    got = {(r.doc_id, r.item_id): r for r in templates.leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                                                            spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 3), (4, 4), (7, 5), (8, 3)}
    assert all(r.exact for r in got.values())
    assert got[1, 1].covered == 5 and got[2, 2].covered == 10 and got[3, 3].covered == 14 and got[4, 4].covered == 59


def test_quality_classifier(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    judged = quality.classify(docs, labels.where("doc_id % 2 = 0"), F.col("source"), F.col("lang")).select("doc_id", "_kept", "_site")
    held = judged.join(labels, "doc_id").where("doc_id % 2 = 1").toPandas()
    clean = held[(held.quality == 1) & (held.toxic == 0)]
    bad = held[held.quality == 0]
    assert clean["_kept"].mean() > 0.97 and (~bad["_kept"]).mean() > 0.9
    assert judged.count() == docs.count()


def test_sites_shrink(spark):
    rows = [("big", "a", 0.9)] * 400 + [("bad", "a", 0.2)] * 400 + [("small", "a", 0.2)] * 2
    got = {r[0]: r[2] for r in quality.site_posteriors(spark.createDataFrame(rows, "_host string, _path string, _good double")).collect()}
    assert got["big"] > 0 > got["bad"] and got["bad"] < got["small"] < 0.2


def test_sites_equal_plain_sums(spark):
    r = random.Random(5)
    rows = [(f"h{r.randint(0, 9) ** 2 // 9}", f"p{r.randint(0, 3)}", round(r.uniform(0.01, 0.99), 3)) for _ in range(700)]
    rows += [("hot", "p0", round(r.betavariate(5, 2), 3)) for _ in range(300)] + [("lone", "", 0.5)]
    got = quality.site_posteriors(spark.createDataFrame(rows, "_host string, _path string, _good double")).collect()
    want = brute.site_log_odds(rows)
    assert len(got) == len(want) and all(abs(x["_site"] - want[x["_host"], x["_path"]]) < 1e-9 for x in got)


def test_posterior_is_evidence_times_site(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels, F.col("source"), F.col("lang")).toPandas()
    want = brute.site_log_odds(list(zip(got.source.fillna(""), got.lang.fillna(""), got["_good"], strict=True)))
    for host, path, good, site, post, kept in got[["source", "lang", "_good", "_site", "_posterior", "_kept"]].itertuples(index=False):
        assert abs(site - want[host or "", path or ""]) < 1e-9
        odds = good / (1 - good) * np.exp(site)
        assert abs(post - odds / (1 + odds)) < 1e-9 and kept == (post >= quality.KEEP_AT)


def test_quality_edge_rows(spark, odd, empty):
    labels = spark.createDataFrame([(6, 1, 0), (9, 1, 0), (10, 0, 0), (None, 1, 1), (15, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(odd, labels, F.col("source"), F.col("lang"))
    assert out.count() == odd.count() and out.where("_kept is null").count() == 0
    assert quality.classify(odd, labels.limit(0), F.col("source"), F.col("lang")).where("_kept").count() == odd.count()
    assert quality.classify(empty, labels, F.col("source"), F.col("lang")).count() == 0


def test_fits_read_a_small_written_table(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["good", "bad", "plain"]) + str(r.randint(0, 9)) for _ in range(12)), "h", "p") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(24)
    labels = spark.createDataFrame([(i, i % 2, i % 3 // 2) for i in range(200)], "doc_id long, quality int, toxic int")
    fitted, released, fit = [], [], quality.LogisticRegression.fit
    monkeypatch.setattr(quality.LogisticRegression, "fit", lambda self, d, *a: fitted.append(d) or fit(self, d, *a))
    monkeypatch.setattr(quality, "release", released.append)
    model = quality.fit(docs, labels, "doc_id", "text")
    assert len(fitted) == 2 and len(released) == 2 and model.models["quality"].numFeatures == 3 + len(quality.SHAPE)
    for d in fitted:
        plan = d._jdf.queryExecution().toString()
        assert d.rdd.getNumPartitions() == 1 and len(d.schema["_x"].metadata["ml_attr"]) == 1 and "split" not in plan


def test_sites_make_few_broadcasts(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(quality, "write_out", lambda d, name: plans.append(d._jdf.queryExecution().executedPlan().toString()) or write_out(d, name))
    rows = [("a", "x", 0.9)] * 30 + [("a", "y", 0.4)] * 20 + [("b", "x", 0.2)] * 10
    quality.site_posteriors(spark.createDataFrame(rows, "_host string, _path string, _good double"))
    assert not any("NestedLoopJoin" in p for p in plans) and plans[-1].count("BroadcastExchange") <= 1
    none = quality.site_posteriors(spark.createDataFrame([], "_host string, _path string, _good double"))
    assert none.count() == 0


def test_language_id(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(d).join(d.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98 and got.score.between(0, 1).all() and len(got) == d.count()
    assert set(got.held_out[got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)]) == {True}


def test_language_id_equals_plain_backoff(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    strange = [(10_002, "zzqxj qqkw éüß"), (10_003, "1234 ..."), (10_004, None), (10_005, "The, the; der?")]
    docs = d.union(spark.createDataFrame([(i, t, None) for i, t in strange], "doc_id long, text string, lang string"))
    rows = [tuple(r) for r in docs.collect()]
    want = brute.languages(rows)
    for r in langid.identify(docs).collect():
        lang, score, held = want[r.doc_id]
        assert (r.lang_pred, r.held_out) == (lang, held) and abs(r.score - score) < 1e-6


def test_language_edge_rows(spark, odd, empty):
    got = langid.identify(odd).toPandas()
    assert len(got) == odd.count() and set(got.lang_pred) <= {"en", "und"}
    assert set(got[got.doc_id.isin([1, 2, 3])].lang_pred) == {"und"}
    assert set(langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).toPandas().lang_pred) == {"und"}
    assert langid.identify(empty).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site name</h1></header>
<nav><ul><li><a href=/a>Menu</a><li><a href=/b>More</a></ul></nav><div class="sidebar"><p>Buy this, now, please, it is a long side text, really.</p></div>
<div id=content><h2>Title &amp; more</h2><p>First para, with commas, and a <a href=x>link</a> that goes on for a while, indeed.
<p>Second &#8212; caf&eacute;,  more&nbsp;text, and more commas, to be   the best.</p><script>var a="</p>";</script><!-- <p>no</p> -->
<ul><li>one<li>two<br>lines</ul></div><div class="comments"><p>I like this, very much, indeed, a comment, really long, with commas.</p></div>
<form><p>Sign up, now</p></form><div class="cookie-notice">We use cookies, a, b, c, d, e, f, g, and more of it.</div><footer><p>(c) x, y, z</p></footer>"""


def test_html(spark, empty):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "", "x"), (3, "w", "plain text only", "x"),
                                   (3, "w", "plain text only", "x"), (4, "z", "<nav><p>menu, a, b</p></nav>", "x")],
                                  "page_id long, url string, html string, text string")
    got = by_repr(tuple(r) for r in html.extract(pages).collect())
    text = ("Title & more First para, with commas, and a link that goes on for a while, indeed. Second — café, more text, "
            "and more commas, to be the best. one two lines")
    assert got == by_repr([(1, "u", text, len(text)), (2, None, "", 0), (None, "v", "", 0), (4, "z", "", 0),
                           (3, "w", "plain text only", 15), (3, "w", "plain text only", 15)])
    assert html.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("tag", [
    'section id="related-work"', 'h2 id="search-algorithms"', 'h2 id="login-flow"', 'p id="notices-2"', 'section title="The hidden cost of rent"',
    'div data-hidden="false"', 'div data-state="hidden"', 'section id="search"', 'h2 id="comments"', 'h3 class="alert"', 'li id="share"', 'div class="has-sidebar"',
    'div title="x" data-class="ad"', "div title='class=ad hidden'", 'div data-id=ads', 'td id=form', 'div class="section" id="notices"', 'pre class="toc"'])
@pytest.mark.parametrize("home", ["article", "main", "div id=content"])
def test_article_parts_stay(tag, home):
    by_name = home.startswith("div") and tag in (   # outside an article these are furniture
        'section id="search"', 'li id="share"', 'td id=form', 'div class="section" id="notices"', 'pre class="toc"')
    plain = "<p>Long text, with commas, that is the body of the page, and goes on.</p>"
    page = f"<body><nav>menu</nav><{home}>{plain}<{tag}>Kept words, of the part, which are long enough, really.</{tag.split()[0]}>{plain}</{home.split()[0]}></body>"
    assert ("Kept words" in html.main_text(page)) is not by_name
    assert "body of the page" in html.main_text(page) and "menu" not in html.main_text(page)


@pytest.mark.parametrize("tag", [
    'div class="x ad"', 'div class="share-buttons"', 'ul class="related_posts"', 'div id="comments"', "div hidden", "p HIDDEN=''", 'div aria-hidden=true',
    'div class="sidebar2"', 'div style="color:red; display : none"', 'section role="search"', 'div class="cookie-notice"', "div title='a'hidden",
    'section id="comments"', 'section class="comments"', 'section id=respond', 'li class="comment"', 'button', 'button type=button class=x', 'p class="advert"',
    'p class="x sponsored"', 'div role="comment"'])
def test_chrome_inside_article_goes(tag):
    plain = "<p>Long text, with commas, that is the body of the page, and goes on.</p>"
    page = f"<article>{plain}<{tag}>Lost words, of the part, which are long enough, really.</{tag.split()[0]}>{plain}</article>"
    assert "Lost" not in html.main_text(page) and "body of the page" in html.main_text(page)


LINE = "a plain line, of the article, that is long enough to count, and goes on."


@pytest.mark.parametrize("page, text", [
    (f'<article><p class=lead">One {LINE}</p><p>Two {LINE}</p></article>', f"One {LINE} Two {LINE}"),
    (f"<article><p title=John's>One {LINE}</p><p>It's two.</p></article>", f"One {LINE} It's two."),
    (f'<article><p title="a > b">One {LINE}<p title="open>Two {LINE}</article>', f"One {LINE} Two {LINE}"),
    (f"<article><p title='a' \"b>One {LINE}</p></article>", f"One {LINE}"),
    (f"<!--><article><p>One {LINE}</p><!-- no --><p>Two.</p></article>", f"One {LINE} Two."),
    (f"<body><nav>menu</nav><div><p>One {LINE}</p></div><div><p>Two {LINE}</p></div></body>", f"One {LINE} Two {LINE}"),
    (f"<body><div><p>One {LINE}</p><p>More {LINE}</p><p>And {LINE}</p></div><div><p>Two is short, but no menu.</p></div><div>(c) us</div></body>",
     f"One {LINE} More {LINE} And {LINE} Two is short, but no menu."),
    (f"<body><div><section><div><p>One {LINE}</p></div></section><section><div><p>Two {LINE}</p></div></section></div></body>",
     f"One {LINE} Two {LINE}"),
    (f"<body><div><p>One {LINE}</p></div><div><p><a href=x>A list of links, to other pages, and more of them</a></p></div></body>", f"One {LINE}"),
    (f"<article><p>One <button>Share this, now</button>{LINE}</p><p><button>Share<p>Two.</p></article>", f"One {LINE} Two."),
    (f"<article><p>One {LINE}</p><svg><path d=x><p>Two {LINE}</p></article>", f"One {LINE} Two {LINE}")])
def test_pages_as_found(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize("tag", ["div", "blockquote", "ul><li", "section", "button", "p"])
def test_deep_pages_take_linear_time(tag):
    began = time.perf_counter()
    assert ("Words" in html.main_text(f"<{tag}>" * 20_000 + f"Words {LINE}")) is (tag != "button")
    assert time.perf_counter() - began < 2


# ---------------------------------------------------------------- empty tables, entry, pipeline

@pytest.mark.parametrize("op", [
    lambda s, d: secrets.report(d), lambda s, d: secrets.redact(d), lambda s, d: cascade.apply_rules(d),
    lambda s, d: sharding.assign_shards(d), lambda s, d: packing.pack(s, d), lambda s, d: jaccard.similar_components(d),
    lambda s, d: recompression.remove_repeats(d)])
def test_empty_tables(spark, empty, op):
    assert op(spark, empty).count() == 0


def test_words_of_slices(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(words, "SLICE_BYTES", 4)
    texts = ["a b", None, "", " x\ny ", "longer words here", "é"]
    got = [(r, [w.word(i).decode() for i in range(a, b)]) for w in words.split(pa.array(texts)) for r, a, b in w.rows()]
    assert got == [(i, brute.words(t)) for i, t in enumerate(texts)]


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    import corpus_pipeline as cp
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = documents()
    lone = cp.drop_near_copies(spark, docs, SF)
    assert lone.columns == docs.columns
    assert {r.doc_id for r in lone.select("doc_id").collect()} == {c if n else d for d, n, c in brute.components(rows)}
    masked = {r.doc_id: r.text for r in cp.mask_secrets(spark, docs, SF).collect()}
    assert len(masked) == len(rows) and not any(brute.secret_spans(t) for t in masked.values())
    clean = {r.doc_id for r in cp.drop_benchmark(spark, docs, SF).collect()}
    items = pd.read_parquet(f"{SF}/benchmark.parquet").text
    squeeze = lambda t: f" {' '.join(brute.words(t))} "
    assert all(any(squeeze(x) in squeeze(t) for x in items) is False for d, t in rows if d in clean)
    out = cp.run(spark, SF).toPandas()
    assert 0 < out["doc_id"].nunique() <= lone.count() and (out.groupby("sequence_id")["length"].sum() <= 2048).all()


def test_rounds_release_the_driver(spark, monkeypatch):
    released = []
    monkeypatch.setattr(jaccard, "release", released.append)
    say = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(say)), (2, " ".join([*say, "end"])), (3, "other words here")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.similar_components(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3} and released


def test_near_copies_by_row(spark):
    import corpus_pipeline as cp
    say = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(1, say(1)), (1, say(1)), (None, say(2)), (None, say(2)), (3, say(3)), (4, say(3)), (4, say(4)), (5, say(5)), (None, say(5)),
            (6, None), (6, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = cp.drop_near_copies(spark, docs, SF)
    assert kept.columns == docs.columns
    assert rows_of(kept, "doc_id", "text") == by_repr(
        [(1, say(1)), (None, say(2)), (3, say(3)), (4, say(4)), (5, say(5)), (6, None), (6, None), (None, "")])
