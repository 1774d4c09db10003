"""Best-fit packing of token sequences by bin completion.

Documents become pieces of at most ``capacity`` tokens (only longer ones are
cut; the first piece takes the remainder).  The packing problem depends only
on how many pieces there are of each length, a histogram of ``capacity``
entries whatever the data.  It is solved on that histogram by bin completion:
fill the bin of the longest piece with an undominated set of others, as often
as the counts allow, branch over the fillings, prune by the waste bound, and
keep best-fit solutions as incumbents.  Spark then ranks the pieces of each
length and looks up the bin of every rank.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paygrid.llm.words import slices
from paygrid.session import write_out

CAPACITY = 2048
VOCABULARY = "byte_bpe_50k.tiktoken"    # the ids of byte_bpe_50k.json, as ranks
NODES = 4_000                           # branch-and-bound nodes; beyond them the best incumbent stands
REOPENED = 64                           # kinds of wasteless bins that the search packs anew before it packs all
LOOKED_AT = 64                          # fillings generated per node, dominated ones among them, before the search ends
ROWS_PER_RUN = 1_000_000                # rows ranked by one sort
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# ------------------------------------------------------------ tokens

def added_tokens(path: str) -> dict[str, int]:
    """Added tokens of the tokenizer's JSON beside the rank file: found inside
    texts before anything else."""
    beside = os.path.splitext(path)[0] + ".json"
    if not os.path.exists(beside):
        return {}
    with open(beside, encoding="utf-8") as f:
        tokens = json.load(f).get("added_tokens") or []
    if odd := [t["content"] for t in tokens if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]:
        raise ValueError(f"added tokens that also take in what stands around them: {odd}")
    return {t["content"]: t["id"] for t in tokens}


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added_tokens(path))


@lru_cache(maxsize=2)
def slow_encoder(path: str):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(os.path.splitext(path)[0] + ".json")


def token_ids(text: str, path: str) -> list[int]:
    """Ids of a text.  The fast encoder's regex gives up on very long runs of
    white space; those texts go to ``tokenizers`` and the JSON beside the ranks."""
    try:
        return encoder(path).encode(text, allowed_special="all")
    except ValueError:
        return slow_encoder(path).encode(text, add_special_tokens=False).ids


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` tokens; the first is the shorter one."""
    head = n % capacity or capacity
    return [(0, min(n, head)), *((s, capacity) for s in range(head, n, capacity))]


def piece_table(docs: DataFrame, path: str, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """One row per piece of every document; a document's ids end with id 0."""
    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            off = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())])
            for i, j in slices(off):
                ids, rows = batch.column(0).slice(i, j - i), []
                for k, text in enumerate(texts.slice(i, j - i).to_pylist()):
                    tokens = np.array([*token_ids(text or "", path), 0], "<u4")
                    rows += [(k, p, s, n, zlib.crc32(tokens[s:s + n].tobytes()))
                             for p, (s, n) in enumerate(piece_bounds(len(tokens), capacity))]
                cols = [pa.array(c) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(cols[0]), cols[1].cast(pa.int32()), *(c.cast(pa.int64()) for c in cols[2:])],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, PIECES)


# ------------------------------------------------------------ bin completion on the histogram

def least_bins(counts: np.ndarray, capacity: int) -> int:
    """Lower bound: total length, and the pieces over half a bin together with
    what can't fit beside them (Martello and Toth's L2)."""
    size = np.arange(len(counts))
    best = -(-int((counts * size).sum()) // capacity)
    n_prefix, s_prefix = np.cumsum(counts), np.cumsum(counts * size)
    for k in range(capacity // 2 + 1):
        large = int(n_prefix[-1] - n_prefix[capacity - k])            # over capacity - k: alone
        mid_n = int(n_prefix[capacity - k] - n_prefix[capacity // 2])
        mid_s = int(s_prefix[capacity - k] - s_prefix[capacity // 2])
        low_s = int(s_prefix[capacity // 2] - (s_prefix[k - 1] if k else 0))
        best = max(best, large + mid_n + max(0, -(-(low_s - (mid_n * capacity - mid_s)) // capacity)))
    return best


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fillings with multiplicities: the longest piece, then always the
    longest that still fits, repeated while the counts allow."""
    left, plan = counts.copy(), []
    while (top := int(np.flatnonzero(left)[-1]) if left.any() else 0):
        fill, room, use = [top], capacity - top, left.copy()
        use[top] -= 1
        while room and (fits := np.flatnonzero(use[:room + 1])).size:
            fill.append(int(fits[-1]))
            use[fits[-1]] -= 1
            room -= int(fits[-1])
        plan.append((tuple(fill), repeat(left, fill)))
        take(left, fill, plan[-1][1])
    return plan


def repeat(left: np.ndarray, fill) -> int:
    size, n = np.unique(np.array(fill), return_counts=True)
    return int((left[size] // n).min())


def take(left: np.ndarray, fill, times: int) -> None:
    np.subtract.at(left, np.array(fill), times)


def dominated(left: np.ndarray, free: int, fill: tuple[int, ...], room: int) -> bool:
    """Whether a longer piece left over can stand for some pieces of ``fill``
    (or one of their length for several) and still fit; ``free``: bits of the
    lengths that ``left`` has."""
    slack = room - sum(fill)
    for size in set(fill):
        if fill.count(size) == left[size]:
            free &= ~(1 << size)
    if free & ((2 << slack) - 2):
        return True                                 # one more piece fits
    one, more = 0, 0                                # bits of the sums of one piece, of several
    for size in fill:
        more |= (one | more) << size
        one |= 1 << size
    reach = more
    for k in range(1, slack + 1):
        reach |= (one | more) << k
    return bool(free & reach)


def completions(left: np.ndarray, room: int) -> Iterator[tuple[int, ...] | None]:
    """All fillings of ``room`` that no other dominates piecewise, fullest
    first, with the longest pieces first among equally full ones, generated
    one by one; None stands for a filling that is dominated."""
    size = np.flatnonzero(left[:room + 1])[::-1].tolist()
    mask, free = (2 << room) - 1, sum(1 << x for x in size)
    reach = [1] * (len(size) + 1)                   # bits of the sums that sizes k and on can make
    for k in range(len(size) - 1, -1, -1):
        sums, n, step = reach[k + 1], min(int(left[size[k]]), room // size[k]), 1
        while n:
            step = min(step, n)
            sums |= sums << (step * size[k]) & mask
            n, step = n - step, 2 * step
        reach[k] = sums

    def fillings(k: int, total: int) -> Iterator[tuple[int, ...]]:
        if not total:
            yield ()
            return
        for j in range(k, len(size)):
            if not reach[j] >> total & 1:
                return
            for n in range(min(int(left[size[j]]), total // size[j]), 0, -1):
                if reach[j + 1] >> (total - n * size[j]) & 1:
                    for more in fillings(j + 1, total - n * size[j]):
                        yield (size[j],) * n + more

    for total in range(room, -1, -1):
        if reach[0] >> total & 1:
            for fill in fillings(0, total):
                yield None if dominated(left, free, fill, room) else fill


def branches(left: np.ndarray, capacity: int, single: bool) -> Iterator[tuple[tuple[int, ...], int] | None]:
    """Fillings of the bin of the longest piece: each as often as the counts
    allow, then, if ``single``, each once."""
    top = int(np.flatnonzero(left)[-1])
    others = left.copy()
    others[top] -= 1
    for once in (False, True)[:1 + single]:
        for more in completions(others, capacity - top):
            times = repeat(left, (top, *more)) if more is not None else 0
            yield ((top, *more), 1 if once else times) if times > once else None


def pack_histogram(counts: np.ndarray, capacity: int, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Fillings with multiplicities that hold every piece, in as few bins as
    the search finds; optimal when it meets ``least_bins`` or ends before its
    ``nodes``.

    Best fit is the first incumbent.  Where it misses the bound, its bins
    without waste are kept (but for the last ``REOPENED`` kinds) and the
    others are packed again by a depth-first branch and bound over the
    fillings of the bin of the longest piece left; if that leaves nodes, all
    bins are packed again.  A quarter of the nodes goes to plans that meet the
    bound, fillings repeated as often as the counts allow; then any better
    plan counts, and in the end fillings are repeated any number of times.
    """
    counts = counts.astype(np.int64)
    bound, best = least_bins(counts, capacity), best_fit(counts, capacity)
    looked = LOOKED_AT * nodes
    for reopened in (REOPENED, len(best)):
        full = [k for k, (f, _) in enumerate(best) if sum(f) == capacity]
        fixed = set(full[:max(0, len(full) - reopened)])
        if reopened != REOPENED and len(full) <= REOPENED or nodes <= 0 or looked <= 0:
            break
        kept = [best[k] for k in sorted(fixed)]
        best, goal = [x for k, x in enumerate(best) if k not in fixed], bound - sum(t for _, t in kept)
        for share, strict, single in ((4, True, False), (1, False, False), (1, False, True)):
            some, seen = nodes // share, looked // share
            best, n, m = search(best, capacity, goal, some, seen, strict, single)
            nodes, looked = nodes - some + n, looked - seen + m
        best = kept + best
    return best


def search(best: list[tuple[tuple[int, ...], int]], capacity: int, goal: int, nodes: int, looked: int,
           strict: bool, single: bool) -> tuple[list[tuple[tuple[int, ...], int]], int, int]:
    """``(plan, nodes, looked)``: the pieces of ``best`` in fewer bins
    (``strict``: in ``goal`` bins) if the search finds any, and what is left
    of its bounds."""
    left = np.zeros(capacity + 1, np.int64)
    for fill, times in best:
        take(left, fill, -times)
    total, least = int((left * np.arange(capacity + 1)).sum()), sum(t for _, t in best)
    if least <= goal:
        return best, nodes, looked
    least = goal + 1 if strict else least
    path, stack = [], [(left, branches(left, capacity, single), 0, 0)]      # pieces left, fillings to try, bins, tokens placed
    while stack and nodes > 0 and looked > 0 and least > goal:
        left, tries, used, placed = stack[-1]
        looked -= 1
        step = next(tries, ())
        if step == ():
            stack.pop()
            if path:
                path.pop()
            continue
        if step is None:
            continue
        nodes -= 1
        fill, times = step
        used, placed = used + times, placed + times * sum(fill)
        if -(-(total + used * capacity - placed) // capacity) >= least:           # waste bound
            continue
        if placed == total:
            least, best = used, [*path, step]
            continue
        nxt = left.copy()
        take(nxt, fill, times)
        path.append(step)
        stack.append((nxt, branches(nxt, capacity, single), used, placed))
    return best, nodes, looked


def slot_table(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """``(length, first_rank, last_rank, first_bin, per_bin, offset)``: the
    pieces of a length with ranks in the range go to consecutive bins,
    ``per_bin`` of them to each, the first at ``offset``."""
    rank: dict[int, int] = {}
    rows, bin_no = [], 0
    for fill, times in plan:
        at = 0
        for size in dict.fromkeys(fill):
            n = fill.count(size)
            r = rank.get(size, 0)
            rows.append((size, r, r + n * times - 1, bin_no, n, at))
            rank[size] = r + n * times
            at += n * size
        bin_no += times
    return rows


# ------------------------------------------------------------ the operator

def pack(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None,
         id_col: str = "doc_id", text_col: str = "text", nodes: int = NODES) -> DataFrame:
    """Every piece with its sequence and place:
    ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``.

    Null text counts as empty (one piece: the closing id 0).  Rows are packed
    one by one, so repeated rows and null ids each keep their place.  Added
    tokens of the vocabulary (``<|endoftext|>``) are one id wherever a text
    holds them, as in ``tokenizers``.  An empty table gives no rows.

    Plan: pieces are written once; their histogram (``capacity`` rows) is
    solved on the driver; ranks come from row numbers inside (length, salt)
    runs plus run offsets, so a length that holds a third of all rows is
    ranked by many tasks; the slot table (a few thousand ranges, bounded by
    ``capacity``) is broadcast.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    pieces = write_out(piece_table(docs, path, capacity, id_col, text_col), "pieces")
    pieces = pieces.withColumn("row", F.xxhash64("doc_id", "piece"))
    hist = pieces.groupBy("length").count().toPandas()
    counts = np.zeros(capacity + 1, np.int64)
    counts[hist["length"].to_numpy(np.int64)] = hist["count"].to_numpy(np.int64)
    slots = slot_table(pack_histogram(counts, capacity, nodes))

    salts = max(8, -(-int(counts.max()) // ROWS_PER_RUN))
    salted = pieces.withColumn("salt", F.pmod("row", F.lit(salts)).cast("int"))
    per_run = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.expr("sum(n) over (partition by length order by salt rows between unbounded preceding and 1 preceding)")
    offsets = per_run.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = salted.withColumn("r", F.expr(
        "row_number() over (partition by length, salt order by row, doc_id, piece, ids_crc32, start)"))
    ranked = ranked.join(offsets, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("r") - 1)
    plan = spark.createDataFrame(slots, "length long, lo long, hi long, bin long, per_bin long, at long")
    by_length = plan.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "bin", "per_bin", "at"))).alias("runs"))
    run = F.filter("runs", lambda x: (x["lo"] <= F.col("rank")) & (F.col("rank") <= x["hi"]))[0]
    placed = ranked.join(F.broadcast(by_length), "length").withColumn("run", run)
    nth = F.col("rank") - F.col("run.lo")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("run.bin") + F.floor(nth / F.col("run.per_bin"))).cast("long").alias("sequence_id"),
        (F.col("run.at") + F.pmod(nth, F.col("run.per_bin")) * F.col("length")).cast("long").alias("offset"))
