"""Quality rules as a short-circuit cascade, in SQL functions only.

Counts (words, symbols, repeated lines, repeated 8-word windows) are array
expressions over one row.  The verdict is a ``CASE`` chain, which Spark
evaluates branch by branch, so a rule runs only on documents that every
earlier rule let through.  The order comes from a bounded sample of all files:
each rule's time is measured there over repeated rows, and the next rule is
always the one that rejects most per second of the rows that the rules before
it let through.  The order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paygrid.session import write_out

SPACE = " \t\n\x0b\f\r"
SPACES = "[ \\t\\n\\x0B\\f\\r]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
SAMPLE_ROWS = 1_000          # rows timed to order the rules, about; results do not depend on them
REPEATS = 5                  # times that each of them is judged in one timing


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def chars_in(text: Column, chars: str) -> Column:
    """How many code points of ``text`` are in ``chars``."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACE, "") != "")
    return let(lines, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long"))


def window_hashes(words: Column, n: int = WINDOW) -> Column:
    """Hash of the words of every window of ``n``; empty for shorter texts."""
    at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1)))
    return F.coalesce(F.transform(at, lambda i: F.xxhash64(F.slice(words, i, n))),
                      F.array().cast("array<bigint>"))


def covered_by_repeats(hashes: Column, n: int = WINDOW) -> Column:
    """Words inside windows whose hash occurs twice or more in the row."""
    def cover(z: Column) -> Column:
        same = lambda e, k: (F.get(z, k - 1)["h"] == e["h"]) | (F.get(z, k + 1)["h"] == e["h"])
        hit = F.filter(z, lambda e, k: F.coalesce(same(e, k), F.get(z, k - 1)["h"] == e["h"],
                                                  F.get(z, k + 1)["h"] == e["h"], F.lit(False)))
        at = F.sort_array(F.transform(hit, lambda e: e["i"]))
        return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-n).alias("last")),
                           lambda a, x: F.struct((a["n"] + F.least(F.lit(n), x - a["last"])).alias("n"), x.alias("last")),
                           lambda a: a["n"].cast("long"))
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(pairs, cover))


@dataclass(frozen=True)
class Rule:
    """``fails`` is true for documents to reject; it may use the count columns."""
    name: str
    fails: Column


def default_rules(text: Column) -> list[Rule]:
    """The rules beyond the base; thresholds are well outside plain prose."""
    n = F.col("n_words")
    upper = F.length(F.regexp_replace(text, "[^\\p{Lu}]+", ""))
    letters = F.length(F.regexp_replace(text, "[^\\p{L}]+", ""))
    kinds = F.size(F.array_distinct(F.col("words")))
    return [
        Rule("symbols", 100 * F.col("n_symbols") > 30 * n),
        Rule("long_words", (F.col("word_chars") > 15 * n) | (F.col("word_chars") < 2 * n)),
        Rule("dup_lines", 3 * F.col("n_dup_lines") > F.size(F.split(text, "\n")) + 2),
        Rule("shouting", 2 * upper > letters),
        Rule("marks", 2 * chars_in(text, "!?") > n),
        # distinct words grow about like the root of a long text's length
        Rule("few_kinds", F.when(n <= 4000, 100 * kinds < 6 * n).otherwise(10 * kinds.cast("long") * kinds < 144 * n)),
    ]


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, words`` and the base counts of every row."""
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    d = d.withColumn("words", words_of(F.col("text"))).withColumn("hashes", window_hashes(F.col("words")))
    text = F.col("text")
    d = d.select("doc_id", "text", "words", F.size("words").cast("long").alias("n_words"),
                 F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
                 chars_in(text, SYMBOLS).alias("n_symbols"), dup_lines(text).alias("n_dup_lines"),
                 covered_by_repeats(F.col("hashes")).alias("n_repeat_words"))
    return d.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def measure(sample: DataFrame, rules: list[Rule]) -> tuple[dict[str, float], dict[int, int]]:
    """Seconds that each rule takes on ``sample`` (rows of ``counts``), and the
    number of rows by the set of rules that they fail (bit k: rule k)."""
    again = sample.withColumn("_again", F.explode(F.array(*[F.lit(k) for k in range(REPEATS)])))

    def run(*cols: Column) -> float:
        began = time.perf_counter()
        again.agg(F.sum(F.length("text") + F.size("words")), *cols).collect()
        return time.perf_counter() - began

    run()
    base = min(run() for _ in range(3))
    seconds = {r.name: max(min(run(F.count_if(r.fails)) for _ in range(3)) - base, 1e-4) for r in rules}
    fails = sum((F.when(F.coalesce(r.fails, F.lit(False)), 1 << k).otherwise(0) for k, r in enumerate(rules)), F.lit(0))
    return seconds, {r["fails"]: r["count"] for r in sample.groupBy(fails.alias("fails")).count().collect()}


def greedy_order(names: list[str], seconds: dict[str, float], fails: dict[int, int]) -> list[str]:
    """Names by rejections per second among the rows that are left each time
    (ties: the cheaper rule, then the name)."""
    order, left = [], dict(fails)
    while len(order) < len(names):
        def key(k: int) -> tuple:
            rejected = sum(n for mask, n in left.items() if mask >> k & 1)
            return -rejected / seconds[names[k]], seconds[names[k]], names[k]
        best = min((k for k in range(len(names)) if names[k] not in order), key=key)
        order.append(names[best])
        left = {mask: n for mask, n in left.items() if not mask >> best & 1}
    return order


def order_rules(sample: DataFrame, rules: list[Rule]) -> list[Rule]:
    """Rules in the order in which they are tried, measured on ``sample`` (rows of ``counts``)."""
    by_name = {r.name: r for r in rules}
    return [by_name[n] for n in greedy_order(list(by_name), *measure(sample, rules))]


def sample_of(docs: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` of ``docs``, from all files, by a hash of id and place."""
    share = min(1.0, rows / max(docs.count(), 1))
    at = F.pmod(F.xxhash64(F.col(docs.columns[0]), F.monotonically_increasing_id()), F.lit(1 << 30))
    return docs.where(at < int(share * (1 << 30)))


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                rules: Callable[[Column], list[Rule]] = default_rules, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: counts, ``base_failed`` and ``kept``.

    Null text counts as empty (and so fails for having under 20 words); null
    and repeated ids are passed through; other columns are ignored; an empty
    table gives no rows.  No shuffle: one row is decided by itself.
    """
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    # filtered after it is written: a filter on counts would be pushed below them and split the text once per window
    sample = write_out(counts(sample_of(narrow, sample_rows)).drop("doc_id"), "rule-sample").where("not base_failed")
    ordered = order_rules(sample.coalesce(1), rules(F.col("text")))      # a bounded sample, timed in one task
    kept = F.when(F.col("base_failed"), False)
    for r in ordered:
        kept = kept.when(F.coalesce(r.fails, F.lit(False)), False)
    return counts(docs, id_col, text_col).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        kept.otherwise(True).alias("kept"))
