"""Importance resampling towards a target distribution by hashed word n-grams.

One pass scans each text: A-Z are folded, separators become single spaces, and
an overlapped regex with boundary lookarounds finds the span of every n-gram,
whose CRC-32 names its bucket.  The buckets of each row are kept as written
lists; their counts over all rows of the corpus and of the target give one
gain per bucket, a row's weight is the sum of its gains, and Gumbel noise from
a hash of the id turns weights into draws without replacement.

What reaches the driver is one count per bucket and one row per partition of
the sorted draw; ranks come from partition offsets, not from a global window.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paygrid.session import write_out

GRAMS, BUCKETS = 1, 10_000
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
RANK_ROWS = 500_000              # rows that a partition of the sorted draw holds, about
_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or b in _KEPT else 32 for b in range(256))


def collapse(text: str) -> bytes:
    """UTF-8 bytes with A-Z folded and separators as single spaces."""
    return b" ".join(text.encode().translate(_TABLE).split())


def patterns(grams: int) -> list:
    """One pattern per length: whole words, between spaces or the ends."""
    return [regex.compile(rb"(?<![^ ])[^ ]+(?: [^ ]+){%d}(?![^ ])" % n) for n in range(grams)]


def features(data: bytes, found: list) -> Iterator[int]:
    """CRC-32 of every n-gram of collapsed ``data``, repeats included."""
    return (zlib.crc32(m[0]) for p in found for m in p.finditer(data, overlapped=True))


def gain(s: int, t: int, all_s: int, all_t: int, buckets: int) -> int:
    return math.floor(1000 * math.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets))))


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise of an id, in thousandths; a null id is hashed as empty."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scan(rows: DataFrame, grams: int, buckets: int) -> DataFrame:
    """``(doc_id, n_words, n_features, bucket)`` of ``(doc_id, text)``."""
    def run(batches):
        found = patterns(grams)
        for batch in batches:
            words, count, parts = [], [], []
            for text in batch.column(1):
                data = collapse(text.as_py() or "")
                at = np.fromiter(features(data, found), np.uint32) % np.uint32(buckets)
                words.append(data.count(b" ") + 1 if data else 0)
                count.append(len(at))
                parts.append(at.astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *count]).astype(np.int32)),
                                             pa.array(np.concatenate([np.zeros(0, np.int32), *parts])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(count, pa.int64()), lists],
                                             names=["doc_id", "n_words", "n_features", "bucket"])
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, bucket array<int>")


def bucket_counts(scanned: DataFrame, buckets: int) -> list[int]:
    """Features in each bucket over all rows (``buckets`` rows reach the driver)."""
    out = [0] * buckets
    for r in scanned.select(F.explode("bucket").alias("b")).groupBy("b").agg(F.count("*").alias("n")).toLocalIterator():
        out[r.b] = r.n
    return out


def weigh(scanned: DataFrame, gains: list[int], seed: int) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score)`` of scanned rows."""
    shared = scanned.sparkSession.sparkContext.broadcast(np.array(gains, np.int64))

    def run(batches):
        for batch in batches:
            at = batch.column(3)
            sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(shared.value[at.flatten().to_numpy()])])
            off = at.offsets.to_numpy() - at.offsets[0].as_py()
            weight = sums[off[1:]] - sums[off[:-1]]
            score = [w + noise(i, seed) for i, w in zip(batch.column(0).to_pylist(), weight.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight), pa.array(score, pa.int64())],
                                             names=["doc_id", "n_words", "n_features", "weight", "score"])
    return scanned.select("doc_id", "n_words", "n_features", "bucket").mapInArrow(
        run, "doc_id long, n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` (``n`` of them) with ``rank``: 1, 2, ... by falling score, then
    id (null ids last).  Rows are dealt by range, sorted inside partitions and
    written; the rows before a partition are its offset."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    parts = max(8, -(-n // RANK_ROWS))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = write_out(placed, "draw-order").withColumn("_part", F.shiftright("_at", 33))
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    before, offsets = 0, []
    for part in sorted(sizes):
        offsets.append((part, before))
        before += sizes[part]
    offset = rows.sparkSession.createDataFrame(offsets, "_part long, _before long")      # one row per partition
    return placed.join(F.broadcast(offset), "_part").withColumn(
        "rank", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_part", "_at", "_before")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
             grams: int = GRAMS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT,
             seed: int = SEED) -> DataFrame:
    """One row per input row: ``(doc_id, n_features, weight, score, rank)``.

    Features are all runs of 1 to ``grams`` words; of the rows with
    ``least_words`` words or more, ``percent`` in a hundred with the highest
    scores are drawn and ranked (ties: smaller id, null ids last; equal rows
    take turns); the others have a null rank.  Null and blank texts have no
    features and weight 0; an empty table gives no rows, an empty target
    counts 0 in every bucket; other columns are ignored.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    aims = target.select(F.lit(None).cast("long").alias("doc_id"), F.col(f"`{target_col}`").alias("text"))
    scanned = write_out(scan(rows, grams, buckets), "buckets", compression="zstd")
    s, t = bucket_counts(scanned, buckets), bucket_counts(scan(aims, grams, buckets), buckets)
    all_s, all_t = sum(s), sum(t)
    scored = write_out(weigh(scanned, [gain(x, y, all_s, all_t, buckets) for x, y in zip(s, t, strict=True)], seed), "scores")
    able = F.col("n_words") >= least_words
    n = scored.where(able).count()
    rank = F.when(F.col("rank") <= percent * n // 100, F.col("rank")).alias("rank")
    kept = ["doc_id", "n_features", "weight", "score"]
    return ranked(scored.where(able).select(*kept), n).select(*kept, rank).union(
        scored.where(~able).select(*kept, F.lit(None).cast("long").alias("rank")))


def drawn(docs: DataFrame, result: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id was drawn, for ids that are unique."""
    chosen = result.where("rank is not null").select(F.col("doc_id").alias(id_col))
    return docs.join(chosen.hint("merge"), id_col, "left_semi")
