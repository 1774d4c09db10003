"""Registered queries: streaming fold and dedup, checked after the stream
has drained (``availableNow``) against the batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from paygrid.plans.catalog import register
from paygrid.plans.q_history import FOLD_SQL
from paygrid.sources import fixture
from paygrid.streaming import fold as S

register("fold_snapshots_stream", FOLD_SQL)(
    lambda spark, sf: S.run_fold_stream(spark, fixture.snapshot_jobs(fixture.table(spark, sf, "events"))))

register("dedup_snapshots_stream",
         "select distinct strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') as snap_ts from events")(
    lambda spark, sf: S.run_dedup_stream(spark, fixture.table(spark, sf, "events")).select(
        F.date_format("snap_ts", "yyyy-MM-dd HH:mm:ss").alias("snap_ts")))
