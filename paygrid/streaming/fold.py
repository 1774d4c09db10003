"""Structured Streaming forms of the snapshot fold and snapshot dedup.

``fold_snapshots_stream`` follows every posting id through landed archive
bodies with ``transformWithState``: bodies are guarded, parsed and their
salaries read by the same column expressions as in the batch form, and a
stateful processor keeps one typed record per id - the first record, the first
one that states a salary, first and last date, number of records.  Records may
arrive in any order: each is compared by (time, position) with what the state
holds, so the drained stream equals the batch fold and no watermark is needed.
State lives in RocksDB under the query's checkpoint and survives a restart.

Each micro-batch writes the ids it changed into a folder of its own, so a batch
costs its own changes and not a rewrite of the history; ``read_folded`` takes
the latest version of every id.

``dedup_snapshots_stream`` keeps the first snapshot of every timestamp, for
good or within a stated watermark, and appends to a file sink.

All paths live under the shared checkpoint folder of the session.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from paygrid.operators.history import FIRST, SALARY, non_empty_id
from paygrid.session import ensure_checkpoint_dir
from paygrid.sources.boards import snapshot_bodies, snapshot_records

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BODIES = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("page", T.LongType()), T.StructField("url", T.StringType()),
                       T.StructField("body", T.StringType())])

_TYPES = {"salary_min": T.LongType(), "salary_max": T.LongType()}
_FIELDS = [T.StructField(c, _TYPES.get(c, T.StringType())) for c in (*FIRST, *SALARY)]
_ENDS = [T.StructField("first_seen", T.DateType()), T.StructField("last_seen", T.DateType()), T.StructField("n_snapshots", T.LongType())]
_PAID = [T.StructField(f"paid_{c}", _TYPES.get(c, T.StringType())) for c in SALARY]
#: (time, position) and fields of the first record, the same of the first with a salary, dates, count
STATE = T.StructType([T.StructField("t", T.LongType()), T.StructField("pos", T.LongType()), *_FIELDS,
                      T.StructField("paid_t", T.LongType()), T.StructField("paid_pos", T.LongType()), *_PAID, *_ENDS])
FOLDED = T.StructType([T.StructField("job_id", T.StringType()), *_FIELDS, *_ENDS])


class FoldProcessor(StatefulProcessor):
    """One posting id: see the module's docstring."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fold", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = self.state.get() if self.state.exists() else None
        s = dict(zip(STATE.fieldNames(), kept, strict=True)) if kept else dict.fromkeys(STATE.fieldNames())
        for r in rows:
            at, day = (r.t, r.pos), datetime.date(1970, 1, 1) + datetime.timedelta(days=r.day)
            if s["t"] is None or at < (s["t"], s["pos"]):
                s["t"], s["pos"] = at
                s.update({c: r[c] for c in (*FIRST, *SALARY)})
            if r.salary_min and (s["paid_t"] is None or at < (s["paid_t"], s["paid_pos"])):
                s["paid_t"], s["paid_pos"] = at
                s.update({f"paid_{c}": r[c] for c in SALARY})
            s["first_seen"] = min(day, s["first_seen"] or day)
            s["last_seen"] = max(day, s["last_seen"] or day)
            s["n_snapshots"] = (s["n_snapshots"] or 0) + 1
        self.state.update(tuple(s[c] for c in STATE.fieldNames()))
        salary = {c: s[c if s["paid_t"] is None else f"paid_{c}"] for c in SALARY}
        yield Row(**{c: s.get(c) for c in FOLDED.fieldNames()} | salary | {"job_id": key[0]})

    def close(self) -> None:
        pass


def scratch(spark: SparkSession, name: str) -> str:
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/paygrid-{name}-{uuid.uuid4().hex[:12]}"


def land_events(events: DataFrame, landing: str) -> None:
    """Land a table as many files (one folder per day), like arriving snapshots."""
    (events.withColumn("day", F.to_date(F.col("ts")))
           .write.mode("errorifexists").partitionBy("day").parquet(landing))


def _landed(spark: SparkSession, landing: str, schema, files_per_trigger: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(landing)


def fold_snapshots_stream(spark: SparkSession, landing: str, out: str, checkpoint: str, files_per_trigger: int | None = None):
    """Fold all bodies that have landed and stop; called again with the same
    ``checkpoint`` it goes on where it stopped.  ``files_per_trigger`` bounds a
    micro-batch; by default one takes all that has landed."""
    records = non_empty_id(snapshot_records(_landed(spark, landing, BODIES, files_per_trigger)))
    rows = records.select("job_id", F.unix_micros("ts").alias("t"), "pos", F.unix_date(F.to_date("ts")).alias("day"), *FIRST, *SALARY)
    folded = rows.groupBy("job_id").transformWithState(FoldProcessor(), FOLDED, "Update", "None")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKSDB)               # the only store that transformWithState takes
    try:
        q = (folded.writeStream.outputMode("update").foreachBatch(write)
                   .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        spark.conf.set(STORE, before)
    q.awaitTermination()
    return q


def read_folded(spark: SparkSession, out: str) -> DataFrame:
    """Latest version of every id across the per-epoch update folders."""
    d = spark.read.parquet(out)
    cols = [c for c in d.columns if c not in ("_epoch", "epoch", "job_id")]
    latest = d.groupBy("job_id").agg(F.max_by(F.struct(*cols), F.col("_epoch")).alias("s"))
    return latest.select("job_id", *[F.col(f"s.{c}").alias(c) for c in cols])


def dedup_snapshots_stream(spark: SparkSession, landing: str, schema, out: str, checkpoint: str,
                           delay: str | None, files_per_trigger: int | None = None) -> None:
    """First snapshot of every timestamp (to the second).

    ``delay`` is the contract on lateness: with an interval, repeats that
    arrive within it are dropped, state older than it is let go, and rows
    later than it are lost; with ``None`` every timestamp is remembered and
    the result equals a batch ``distinct`` whatever the order of arrival.
    """
    src = _landed(spark, landing, schema, files_per_trigger)
    snaps = src.select(F.date_trunc("second", F.col("ts").cast("timestamp")).alias("snap_ts"),
                       F.col("event_id").alias("pos"))
    dedup = (snaps.dropDuplicates(["snap_ts"]) if delay is None
             else snaps.withWatermark("snap_ts", delay).dropDuplicatesWithinWatermark(["snap_ts"]))
    q = (dedup.writeStream.format("parquet").option("path", out)
              .option("checkpointLocation", checkpoint).outputMode("append")
              .trigger(availableNow=True).start())
    q.awaitTermination()


def run_fold_stream(spark: SparkSession, jobs: DataFrame, files_per_trigger: int | None = None) -> DataFrame:
    """Land the bodies of ``jobs`` (``fixture.snapshot_jobs``) and drain the stream over them."""
    base = scratch(spark, "fold")
    snapshot_bodies(jobs).write.parquet(f"{base}/landing")
    fold_snapshots_stream(spark, f"{base}/landing", f"{base}/out", f"{base}/ckpt", files_per_trigger)
    return read_folded(spark, f"{base}/out")


def run_dedup_stream(spark: SparkSession, events: DataFrame, delay: str | None = None,
                     files_per_trigger: int | None = None) -> DataFrame:
    base = scratch(spark, "dedup")
    land_events(events, f"{base}/landing")
    schema = spark.read.parquet(f"{base}/landing").schema
    dedup_snapshots_stream(spark, f"{base}/landing", schema, f"{base}/out", f"{base}/ckpt", delay, files_per_trigger)
    return spark.read.parquet(f"{base}/out")
