"""The snapshot fold, batch and stream, on hand-written records; history sinks."""

import os

import pytest
from fixture_paths import SF_SMALL
from pyspark.sql import functions as F

from paygrid.operators import common
from paygrid.operators import history as H
from paygrid.sources import boards, fixture, postings
from paygrid.streaming import fold

RECORDS = "job_id string, ts timestamp, pos long, " + ", ".join(
    f"{c} {'long' if c in ('salary_min', 'salary_max') else 'string'}" for c in (*H.FIRST, *H.SALARY))


def record(spark, rows):
    """``(id, time, place, title, minimum)``; the other fields are made of these."""
    full = [(i, t, p, title, f"at {title}", None, f"u{t}-{p}", None if m is None else f"pay {m}", None if m is None else "USD", m,
             None if m is None else m + 5, "annual" if m else None) for i, t, p, title, m in rows]
    return spark.createDataFrame(full, "job_id string, ts string, pos long, " + RECORDS.split("pos long, ")[1]).withColumn("ts", F.col("ts").cast("timestamp"))


def test_fold_takes_first_record_and_first_salary(spark):
    rows = [("a", "2024-01-03 10:00:00", 0, "late", 70), ("a", "2024-01-01 10:00:00", 5, "second", 0), ("a", "2024-01-01 10:00:00", 2, "first", None),
            ("a", "2024-01-02 23:59:59", 0, "third", 90), ("b", "2024-02-01 00:00:00", 1, "only", 0), ("c", "2024-02-01 00:00:00", 1, "no pay", None),
            ("", "2024-01-01 00:00:00", 0, "blank", 1), (None, "2024-01-01 00:00:00", 0, "none", 1)]
    got = {r.job_id: r for r in H.fold_snapshots(record(spark, rows)).collect()}
    assert set(got) == {"a", "b", "c"}
    a = got["a"]
    assert (a.title, a.location, a.snapshot_url, a.n_snapshots) == ("first", "at first", "u2024-01-01 10:00:00-2", 4)
    assert (a.salary_min, a.salary_max, a.currency, a.salary_unit, a.salary_text) == (90, 95, "USD", "annual", "pay 90")
    assert (str(a.first_seen), str(a.last_seen)) == ("2024-01-01", "2024-01-03")
    assert (got["b"].salary_min, got["b"].salary_text) == (0, "pay 0") and got["c"].salary_min is None
    assert H.fold_snapshots(record(spark, rows).limit(0)).count() == 0


def test_records_of_bodies(spark):
    jobs = spark.createDataFrame([(1, "2024-01-01 05:00:00", "x", "Dev", "Paris", "Eng", "Annual Salary: $10,000 - $20,000 USD"),
                                  (2, "2024-01-01 00:00:00", "y", "Ops", None, None, None)],
                                 "event_id long, ts string, job_id string, title string, location string, department string, pay string").withColumn(
        "ts", F.col("ts").cast("timestamp"))
    bodies = boards.snapshot_bodies(jobs)
    assert bodies.count() == 3                                   # one is an error page
    got = {r.job_id: r for r in boards.snapshot_records(bodies).collect()}
    assert set(got) == {"x", "y"} and (got["x"].salary_min, got["x"].salary_max, got["x"].currency, got["x"].salary_unit) == (10000, 20000, "USD", "annual")
    assert got["x"].salary_text == "About the Dev Annual Salary: $10,000 - $20,000 USD" and got["y"].salary_text is None
    assert got["x"].snapshot_url == "https://web.archive.org/web/20240101050000id_/boards.example.com/jobs"


def test_stream_goes_on_after_a_restart(spark):
    bodies = boards.snapshot_bodies(fixture.snapshot_jobs(fixture.table(spark, SF_SMALL, "events")))
    want = sorted(map(tuple, H.fold_snapshots(boards.snapshot_records(bodies)).collect()))
    base = fold.scratch(spark, "restart")
    late = F.dayofyear("ts") % 2 == 0                           # the second landing holds earlier days too
    bodies.where(~late).coalesce(2).write.parquet(f"{base}/landing")
    fold.fold_snapshots_stream(spark, f"{base}/landing", f"{base}/out", f"{base}/ckpt", files_per_trigger=1)
    half = fold.read_folded(spark, f"{base}/out").select(F.sum("n_snapshots")).first()[0]
    bodies.where(late).coalesce(2).write.mode("append").parquet(f"{base}/landing")
    fold.fold_snapshots_stream(spark, f"{base}/landing", f"{base}/out", f"{base}/ckpt")
    got = fold.read_folded(spark, f"{base}/out")
    columns = H.fold_snapshots(boards.snapshot_records(bodies)).columns
    assert sorted(map(tuple, got.select(*columns).collect())) == want
    assert 0 < half < sum(r[-1] for r in want)


def test_history_is_written_in_order(spark):
    rows = [(str(k), f"t{k}", 1, 2, f"2024-01-{1 + k * 7 % 9:02d}", "2024-02-01", True) for k in range(200)]
    df = spark.createDataFrame(rows, "job_id string, title string, salary_min int, salary_max int, first_seen string, last_seen string, is_active boolean")
    df = df.withColumns({c: F.col(c).cast("date") for c in ("first_seen", "last_seen")}).repartition(5, "job_id").sortWithinPartitions("job_id")
    path = fold.scratch(spark, "sorted-history")
    postings.sink_history(df, path)
    seen = []
    for part in sorted(f for f in os.listdir(path) if f.startswith("part-")):
        with open(f"{path}/{part}") as f:
            seen += [line.split(",") for line in f.read().splitlines()[1:]]
    assert len(seen) == 200 and [x[8] for x in seen] == sorted(x[8] for x in seen)
    place = {r.job_id: k for k, r in enumerate(df.collect())}
    assert all(place[a[0]] < place[b[0]] for a, b in zip(seen, seen[1:]) if a[8] == b[8])
    assert postings.scan_history(spark, path).count() == 200


def test_broken_build_is_redone(spark):
    rows = [("1", "t", 1, 2, "2024-01-01", "2024-02-01", True)]
    df = spark.createDataFrame(rows, "job_id string, title string, salary_min int, salary_max int, first_seen string, last_seen string, is_active boolean")
    df = df.withColumns({c: F.col(c).cast("date") for c in ("first_seen", "last_seen")})
    path = fold.scratch(spark, "broken")
    os.makedirs(f"{path}/_temporary/0")
    with open(f"{path}/part-00000-half.csv", "w") as f:
        f.write("job_id,title\n9,half\n")
    assert not postings.is_complete(spark, path) and postings.build_if_absent(df, path)
    assert [r.job_id for r in postings.scan_history(spark, path).collect()] == ["1"]
    assert postings.is_complete(spark, path) and not postings.build_if_absent(df.limit(0), path)
    assert postings.scan_history(spark, path).count() == 1


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_running_sum_in_two_levels(spark, groups):
    rows = [(k % 3, float((k * 37) % 101 - 20), k % 5 + 1) for k in range(101)]
    df = spark.createDataFrame(rows, "g int, v double, n int")
    got = common.running_sum(df, groups, "v", "n", common.magnitude(F.col("v")), "upto").collect()
    assert len(got) == 101
    assert all(r.upto == sum(n for g, v, n in rows if v <= r.v and (not groups or g == r.g)) for r in got)
