"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paygrid.session import write_out

EDGES_PER_FILE = 250_000


def _toward_min(e: DataFrame, keep: str) -> DataFrame:
    """Link the neighbours ``v`` of every ``u`` that satisfy ``keep`` to the
    least of ``u`` and its neighbours."""
    least = e.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return e.where(keep).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` of every node with an edge; ``component`` is the
    least node reachable.

    Every round is two grouped minima joined back to the edges (a hub's edges
    can be split by AQE, since only the narrow edge list is moved), written to
    the shared folder; the number of rounds is logarithmic in the longest
    path.  Self loops and repeated edges are fine; no edges give no rows.
    """
    cur = write_out(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    mark, n = None, cur.count()
    while n:
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            cur.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _toward_min(both, "v > u").where("a <> b")                                  # larger neighbours to the least
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))                     # smaller neighbours and u
        files = max(8, n // EDGES_PER_FILE)                     # a round never makes more than two edges of one
        cur = write_out(small.where("a <> b").distinct().coalesce(files), "edges")
        now = cur.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == mark:
            break
        mark, n = now, now[0]
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).groupBy("node").agg(
        F.min("component").alias("component")).union(
        cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
