"""Minimax contiguous sharding.

Documents are put in the order of a hash of their text; documents with equal
text form one atomic unit, and a shard is a run of consecutive units.  The
smallest capacity for which ``shards`` runs suffice is found by binary search
with a greedy check, and the runs are cut there (law ``bytes``).

Only histograms reach the driver: first of 2^18 hash ranges, whatever the
data; then those ranges in which a cut may fall are split further, until the
cuts of every smaller capacity stand between single units, so the capacity is
the exact one.  Texts with one 64-bit hash count as one unit.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paygrid.session import write_out

BITS, MORE = 18, 8           # hash bits of the first ranges, and more bits each time a range is split
AT_ONCE = 512                # ranges split in one step, at most; the next step has the others
ROWS_PER_RUN = 1_000_000     # rows ranked by one sort when slots are numbered


def greedy_cuts(sizes: np.ndarray, capacity: int) -> list[int]:
    """Ends of the runs made by filling each up to ``capacity``."""
    prefix, cuts, at = np.concatenate([[0], np.cumsum(sizes)]), [], 0
    while at < len(sizes):
        at = int(np.searchsorted(prefix, prefix[at] + capacity, "right")) - 1
        cuts.append(at)
    return cuts


def minimax_cuts(sizes: np.ndarray, shards: int) -> tuple[int, list[int]]:
    """Smallest feasible capacity and the run ends of a partition that has it."""
    if not len(sizes):
        return 0, []
    lo = max(int(sizes.max()), -(-int(sizes.sum()) // shards))
    hi = int(sizes.sum())
    while lo < hi:
        mid = (lo + hi) // 2
        if len(greedy_cuts(sizes, mid)) <= shards:
            hi = mid
        else:
            lo = mid + 1
    return lo, balanced_cuts(sizes, shards, lo)


def balanced_cuts(sizes: np.ndarray, shards: int, capacity: int) -> list[int]:
    """Run ends within ``capacity``, each as near to an even share of what is
    left as feasibility of the remaining runs allows."""
    n = len(sizes)
    prefix = np.concatenate([[0], np.cumsum(sizes)])
    # least[k]: earliest start from which k runs reach the end (greedy from the right)
    least = [n]
    for _ in range(shards):
        least.append(int(np.searchsorted(prefix, prefix[least[-1]] - capacity, "left")))
    cuts, at = [], 0
    for left in range(shards, 0, -1):
        goal = prefix[at] + (prefix[n] - prefix[at]) / left
        k = int(np.searchsorted(prefix, goal, "left"))
        if k > at and (k > n or goal - prefix[k - 1] < prefix[min(k, n)] - goal):
            k -= 1
        far = int(np.searchsorted(prefix, prefix[at] + capacity, "right")) - 1
        at = min(max(k, least[left - 1], at), far)
        cuts.append(at)
    return cuts


def to_split(sizes: np.ndarray, single: np.ndarray, shards: int, capacity: int) -> np.ndarray:
    """Ranges to split before it is certain that no capacity below
    ``capacity`` (the least for whole ranges) serves; none: it is certain.
    ``single`` marks ranges of one unit."""
    big = sizes >= capacity
    if big.any():
        return np.flatnonzero(big & ~single) if not (big & single).any() else np.array([], int)
    least = max(-(-int(sizes.sum()) // shards), int(sizes.max()))
    if least >= capacity:
        return np.array([], int)
    far = [c for c in greedy_cuts(sizes, capacity - 1)[:shards] if c < len(sizes)]
    cut = [c for c in far if not single[c]]
    if not cut:
        return np.array([], int)                    # the greedy cuts below the capacity are those of single units
    near = greedy_cuts(sizes, least)
    held = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(near, far, strict=False)]))
    held = held[~single[held]]
    return held if len(held) <= AT_ONCE else np.array(cut)


def ranges(rows: DataFrame, bits: int) -> np.ndarray:
    """``(first hash, last hash, size, bits)`` of the hash ranges of so many bits that hold a row."""
    got = rows.groupBy(F.shiftright("hash", 64 - bits).alias("unit")).agg(
        F.min("hash").alias("a"), F.max("hash").alias("b"), F.sum("size").alias("size"))
    d = got.select("a", "b", "size").toPandas().to_numpy(np.int64).reshape(-1, 3)
    return np.column_stack([d, np.full(len(d), bits)])


def exact_ranges(rows: DataFrame, shards: int, bits: int) -> np.ndarray:
    """Ranges of ``rows (hash, size)`` in order, split where it matters: the
    least capacity for them is the least for units."""
    held = ranges(rows, bits)
    while True:
        held = held[np.argsort(held[:, 0])]
        sizes, single = held[:, 2], held[:, 0] == held[:, 1]
        split = to_split(sizes, single, shards, minimax_cuts(sizes, shards)[0]) if len(held) else []
        if not len(split):
            return held
        finer = []
        for b in np.unique(held[split, 3]):
            some = held[split][held[split, 3] == b]
            inside = " or ".join(f"hash between {_long(x)} and {_long(y)}" for x, y in some[:, :2].tolist())
            finer.append(ranges(rows.where(inside), int(min(b + MORE, 64))))
        held = np.concatenate([np.delete(held, split, 0), *finer])


def _long(x: int) -> str:
    return f"{x}L" if x > -(1 << 63) else "(-9223372036854775807L - 1L)"      # no literal for the least long


def text_size(text: str | Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def assign_shards(docs: DataFrame, shards: int = 16, bits: int = BITS, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with its shard and its place in it.

    Returns ``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``, one
    row per input row (null ids, null texts and repeated rows included; a null
    text counts as empty).  Equal texts share a shard.  ``slot`` counts from 0
    without gaps inside each shard; ``grown_shard`` is null under law
    ``bytes``.  An empty table gives no rows.  Other columns are ignored.

    Plan: one narrow table is written once; the histograms are grouped sums
    with map-side combine over it; slots come from row numbers inside (shard, salt)
    runs of about ``ROWS_PER_RUN`` rows plus the offsets of the runs, so no
    task ranks a whole shard and copies of one text spread over all salts.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = write_out(docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), text_size(text).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("hash"),
        F.monotonically_increasing_id().alias("row")), "shard-rows")

    held = exact_ranges(rows.select("hash", "size"), shards, bits)
    _, cuts = minimax_cuts(held[:, 2], shards)
    bounds = sorted({int(held[c, 0]) for c in cuts if c < len(held)})   # first hash of each later shard
    shard = sum(((F.col("hash") >= b).cast("int") for b in bounds), F.lit(0)) if bounds else F.lit(0)

    n = rows.count()
    salts = max(8, -(-n // (shards * ROWS_PER_RUN)))
    placed = rows.withColumn("shard", shard.cast("int")).withColumn(
        "salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    per_run = placed.groupBy("shard", "salt").agg(F.count("*").alias("n"))       # shards x salts rows
    run = F.expr("sum(n) over (partition by shard order by salt rows between unbounded preceding and 1 preceding)")
    offsets = per_run.select("shard", "salt", F.coalesce(run, F.lit(0)).alias("before"))
    # salts rows per shard: at most one per million input rows and shard, a few MB at 10^12 rows
    ranked = placed.withColumn("r", F.expr("row_number() over (partition by shard, salt order by row)"))
    return ranked.join(F.broadcast(offsets), ["shard", "salt"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("r") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
