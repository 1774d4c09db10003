"""Secret scan over a trigram inverted index, in SQL functions only.

Every rule's regex is turned into a Boolean trigram query: an OR of sets of
three-character strings of which one set must occur whole in any match.  The
index lists, for each trigram of the query vocabulary, the rows that contain
it (ASCII case folded).  Intersecting the postings per row gives candidates;
only those are searched with the regex.  A rule without mandatory trigrams
(``hex``) scans every row.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paygrid.llm.cascade import let
from paygrid.session import write_out

MAX_STRINGS = 64             # longest list of alternative literals kept in one clause
BRANCH_TRIGRAMS = 3          # trigrams kept per branch, rarest letters first (any subset stays mandatory)
COMMON = " etaoinsrhdlu"     # letters that make a trigram a poor key, most common first
MARK, STAND_IN = "\ue000", "\ue001"      # private-use characters; no rule matches either


@dataclass(frozen=True)
class SecretRule:
    """A regex (same meaning in Java and Python), and the least length of its
    ``group`` (0: the whole match) for a match to count."""
    kind: str
    regex: str
    group: int = 0
    min_chars: int = 1


# The base kinds come first, in the order in which ties are listed.
BASE = (
    SecretRule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 20),
    SecretRule("hex", r"[0-9a-f]{24,}", 0, 24),      # equals runs of [0-9a-f]+ that have 24 characters or more
)
# Public formats of keys and tokens.
EXTRA = tuple(SecretRule(kind, regex) for kind, regex in (
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    ("aws_session", r"ASIA[A-Z0-9]{16}"),
    ("google_api", r"AIza[0-9A-Za-z_-]{35}"),
    ("google_client", r"GOCSPX-[A-Za-z0-9_-]{28}"),
    ("google_token", r"ya29\.[A-Za-z0-9_-]{20,}"),
    ("stripe", r"(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}"),
    ("square", r"sq0(?:atp|csp)-[A-Za-z0-9_-]{22,}"),
    ("braintree", r"access_token\$production\$[a-z0-9]{16}\$[a-f0-9]{32}"),
    ("shopify", r"shp(?:at|ca|pa|ss)_[a-fA-F0-9]{32}"),
    ("npm", r"npm_[A-Za-z0-9]{36}"),
    ("pypi", r"pypi-AgEI[A-Za-z0-9_-]{50,}"),
    ("rubygems", r"rubygems_[a-f0-9]{48}"),
    ("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    ("github_pat", r"github_pat_[A-Za-z0-9_]{22,}"),
    ("sendgrid", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"),
    ("mailgun", r"key-[0-9a-f]{32}"),
    ("mailchimp", r"[0-9a-f]{32}-us[0-9]{1,2}"),
    ("telegram", r"[0-9]{8,10}:AA[A-Za-z0-9_-]{33}"),
    ("slack_hook", r"hooks\.slack\.com/services/T[A-Za-z0-9]+/B[A-Za-z0-9]+/[A-Za-z0-9]{20,}"),
    ("discord_hook", r"discord(?:app)?\.com/api/webhooks/[0-9]{10,}/[A-Za-z0-9_-]{30,}"),
    ("huggingface", r"hf_[A-Za-z0-9]{30,}"),
    ("url_password", r"[a-z]{2,10}://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/@]+@[A-Za-z0-9.-]+"),
    ("azure_account", r"(?:AccountKey|SharedAccessKey)=[A-Za-z0-9+/=]{40,}"),
    ("digitalocean", r"do[oprt]_v1_[a-f0-9]{64}"),
    ("databricks", r"dapi[a-f0-9]{32}"),
    ("newrelic", r"NRAK-[A-Z0-9]{27}"),
    ("doppler", r"dp\.pt\.[A-Za-z0-9]{40,}"),
    ("linear", r"lin_api_[A-Za-z0-9]{40}"),
    ("postman", r"PMAK-[a-f0-9]{24}-[a-f0-9]{34}"),
    ("vault", r"hvs\.[A-Za-z0-9_-]{24,}"),
    ("age", r"AGE-SECRET-KEY-1[A-Z0-9]{58}"),
    ("bearer", r"[Bb]earer [A-Za-z0-9._~+/-]{20,}"),
))


# ------------------------------------------------------------ regex -> trigram query

def _alternatives(node) -> list[str] | None:
    """The strings that a parsed element can match, if they are few."""
    op, arg = node[0].name, node[1]
    if op == "LITERAL":
        return [chr(arg)]
    if op == "IN" and all(o.name in ("LITERAL", "RANGE") for o, _ in arg):
        got = [chr(c) for o, v in arg for c in ([v] if o.name == "LITERAL" else range(v[0], v[1] + 1))]
        return got if len(got) <= 8 else None
    if op == "SUBPATTERN":
        return _sequence(arg[3])
    if op == "BRANCH":
        parts = [_sequence(x) for x in arg[1]]
        return None if None in parts else [s for p in parts for s in p]
    if op == "MAX_REPEAT" and arg[1] <= 8:
        unit = _sequence(arg[2])
        if unit is not None:
            got = ["".join(p) for n in range(arg[0], arg[1] + 1) for p in product(unit, repeat=n)]
            return got if len(got) <= MAX_STRINGS else None
    return None


def _sequence(nodes) -> list[str] | None:
    out = [""]
    for n in nodes:
        alts = _alternatives(n)
        if alts is None or len(out) * len(alts) > MAX_STRINGS:
            return None
        out = [a + b for a in out for b in alts]
    return out


def _clauses(nodes) -> list[list[str]]:
    """Alternatives lists, each of which every match satisfies."""
    found, run = [], [""]
    for n in nodes:
        alts = _alternatives(n)
        if alts is not None and len(run) * len(alts) <= MAX_STRINGS:
            run = [a + b for a in run for b in alts]
            continue
        found.append(run)
        run = [""] if alts is None else alts
        if alts is None and n[0].name == "SUBPATTERN":
            found += _clauses(n[1][3])
    return [c for c in [*found, run] if min(map(len, c)) >= 3]


def trigram_query(regex: str) -> list[frozenset[str]]:
    """Trigram sets of which at least one occurs whole (ASCII lower case) in
    any text that the regex matches; ``[]`` if nothing is mandatory."""
    branches = [frozenset()]
    for clause in _clauses(_parser.parse(regex)):
        sets = {frozenset(s.lower()[i:i + 3] for i in range(len(s) - 2)) for s in clause}
        grown = {a | b for a in branches for b in sets}
        if len(grown) <= MAX_STRINGS:
            branches = [b for b in grown if not any(o < b for o in grown)]
    rarity = lambda t: (-sum(COMMON.index(c) if c in COMMON else len(COMMON) for c in t), t)
    branches = list({frozenset(sorted(b, key=rarity)[:BRANCH_TRIGRAMS]) for b in branches})
    return [] if frozenset() in branches else sorted(branches, key=sorted)


# ------------------------------------------------------------ index and candidates

def row_key(id_col: str, text_col: str) -> Column:
    """Name of a row by content: repeated rows share it, null ids are fine."""
    return F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))


def build_index(docs: DataFrame, trigrams: list[str], id_col: str, text_col: str) -> DataFrame:
    """Postings ``(trigram, key)`` of every row, written to the shared folder."""
    low = docs.select(row_key(id_col, text_col).alias("key"), F.lower(F.col(f"`{text_col}`")).alias("low"))
    hits = F.array_compact(F.array(*[F.when(F.col("low").contains(t), F.lit(t)) for t in trigrams]))
    return write_out(low.select("key", F.explode(hits).alias("trigram")), "trigrams")


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """``(key, kinds)``: rows whose postings satisfy a rule's trigram query.

    Postings meet per row as sets of bits (at most 63 trigrams a word), a
    grouped ``bit_or`` with map-side combine.
    """
    vocab = sorted({t for q in queries.values() for b in q for t in b})
    words = [vocab[i:i + 63] for i in range(0, len(vocab), 63)]
    masks = [F.bit_or(F.coalesce(*[F.when(F.col("trigram") == t, F.lit(1 << i)) for i, t in enumerate(w)],
                                 F.lit(0)).cast("long")).alias(f"m{k}") for k, w in enumerate(words)]

    def holds(branch: frozenset[str]) -> Column:
        need = [sum(1 << i for i, t in enumerate(w) if t in branch) for w in words]
        return F.expr(" and ".join(f"(m{k} & {n}L) = {n}L" for k, n in enumerate(need) if n))

    def any_of(branches):
        out = F.lit(False)
        for b in branches:
            out = out | holds(b)
        return out

    kinds = F.array_compact(F.array(*[F.when(any_of(q), F.lit(k)) for k, q in queries.items() if q]))
    return index.groupBy("key").agg(*masks).select("key", kinds.alias("kinds")).where(F.size("kinds") > 0)


# ------------------------------------------------------------ verification

def running(values: Column, join=lambda s, x: s + x) -> Column:
    """Sum (or another ``join`` with neutral 0) of all earlier entries, for
    each entry, in blocks of about the square root of the length (SQL arrays
    have no running sum)."""
    def blocks(a):
        return let(F.ceil(F.sqrt(F.size(a))).cast("int"), lambda b: let(
            F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / b).cast("int") - 1),
                        lambda k: F.aggregate(F.slice(a, k * b + 1, b), F.lit(0), join)),
            lambda sums: let(
                F.transform(sums, lambda _, k: F.aggregate(F.slice(sums, F.lit(1), k), F.lit(0), join)),
                lambda base: F.transform(a, lambda _, i: join(F.get(base, F.floor(i / b).cast("int")), F.aggregate(
                    F.slice(a, F.floor(i / b).cast("int") * b + 1, i % b), F.lit(0), join))))))
    return let(values, blocks)


def spans_of(text: Column, rule: SecretRule, rank: int) -> Column:
    """Spans ``(start, rank, kind, end)`` in code points of the rule's
    leftmost non-overlapping matches that are long enough."""
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    marked = F.regexp_replace(F.translate(text, MARK, STAND_IN), rule.regex, f"{MARK}$0{MARK}")
    value = (lambda m: F.regexp_extract(m, rule.regex, rule.group)) if rule.group else (lambda m: m)

    def cut(parts):
        return let(running(F.transform(parts, F.length)), lambda at: F.transform(
            F.filter(F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)),
                     lambda i: F.length(value(F.get(parts, i))) >= rule.min_chars),
            lambda i: F.struct(F.get(at, i).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"),
                               (F.get(at, i) + F.length(F.get(parts, i))).alias("end"))))
    return F.when(F.regexp_like(text, F.lit(rule.regex)), let(F.split(marked, MARK, -1), cut)).otherwise(none)


def spans_string(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, rules=(*BASE, *EXTRA), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` plus ``_spans``: an array of
    ``(start, rank, kind, end)`` by start, then kind in the order of ``rules``.

    Columns named ``_key``, ``_kinds`` or ``_spans`` are replaced.  Null and
    empty texts have no spans; rows are never dropped or merged; a
    repeated row gets the same spans each time.
    """
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    vocab = sorted({t for q in queries.values() for b in q for t in b})
    key = docs.withColumn("_key", row_key(id_col, text_col))
    found = candidates(build_index(docs, vocab, id_col, text_col), queries).withColumnRenamed("key", "_key")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    parts = []
    for rank, r in enumerate(rules):
        spans = spans_of(text, r, rank)
        parts.append(F.when(F.array_contains("_kinds", r.kind), spans).otherwise(
            F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")) if queries[r.kind] else spans)
    # one plan at every size: the candidates grow with the rows, so they are never broadcast
    return (key.join(found.withColumnRenamed("kinds", "_kinds").hint("merge"), "_key", "left")
            .withColumn("_spans", F.array_sort(F.concat(*parts))).drop("_key", "_kinds"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, the digest of the base spans and all spans, one row per row."""
    base = F.filter("_spans", lambda s: s["rank"] < len(BASE))
    n = lambda k: F.size(F.filter("_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return scan(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))).select(
        "doc_id", *[n(r.kind) for r in BASE], F.sha2(spans_string(base), 256).alias("base_sha256"),
        spans_string(F.col("_spans")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", put: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span in the text replaced by ``put``; overlapping
    spans give one replacement; null texts stay null; columns are unchanged."""
    text = F.col(f"`{text_col}`")
    ends = F.transform("_spans", lambda s: s["end"])

    def pieces(done):                               # done: where the spans before each one end
        kept = F.transform("_spans", lambda s, i: F.when(
            s["start"] >= F.get(done, i), F.concat(F.substring(text, F.get(done, i) + 1, s["start"] - F.get(done, i)), F.lit(put))).otherwise(""))
        return F.concat(F.array_join(kept, ""), F.substring(text, F.array_max(ends) + 1, F.length(text)))
    done = let(running(ends, lambda s, x: F.greatest(s, x)), pieces)
    return scan(docs, id_col=id_col, text_col=text_col).withColumn(
        text_col, F.when(F.size("_spans") > 0, done).otherwise(text)).select(*[F.col(f"`{c}`") for c in docs.columns])
