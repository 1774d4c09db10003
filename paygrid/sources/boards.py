"""Landed board payloads and archive indexes.

Network fetching is out of scope: jobs start from landed JSON bodies (one
row per fetched body).  Bodies are parsed with an explicit schema
(``from_json``), never inferred, and exploded into one row per job.

For tests and benches, ``*_payloads`` build bodies from the postings table
with ``to_json``: a board snapshot of one company and day comes in pages of at
most ``JOBS_PER_BODY`` consecutive keys, so no body grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paygrid.functions import classify as C
from paygrid.functions import urls as U
from paygrid.functions.salary import looks_like_salary, parse_salary
from paygrid.functions.text import html_to_text, let

BOARD_A_SCHEMA = T.StructType([T.StructField("jobs", T.ArrayType(T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("location", T.StructType([T.StructField("name", T.StringType())])),
    T.StructField("updated_at", T.StringType()),
    T.StructField("content", T.StringType()),
])))])

BOARD_B_SCHEMA = T.StructType([T.StructField("jobs", T.ArrayType(T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("publishedAt", T.StringType()),
    T.StructField("descriptionHtml", T.StringType()),
    T.StructField("department", T.StringType()),
    T.StructField("jobUrl", T.StringType()),
    T.StructField("isRemote", T.BooleanType()),
    T.StructField("workplaceType", T.StringType()),
])))])

INDEX_HEADER = ["timestamp", "original", "statuscode"]


def payload_guard(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Keep a body only if its first non-blank character is ``{``."""
    return bodies.where(F.regexp_replace(F.col(body), r"^(?U)\s+", "").startswith("{"))


def scan_board_nested(bodies: DataFrame, body: str = "body", keep: list[str] | None = None) -> DataFrame:
    """Board A: ``{jobs:[{id,title,location:{name},updated_at,content}]}``."""
    keep = keep or []
    j = bodies.select(*keep, F.posexplode(F.from_json(F.col(body), BOARD_A_SCHEMA)["jobs"]).alias("pos", "job"))
    return j.select(*keep, "pos", F.col("job.id").cast("string").alias("job_id"), F.col("job.title").alias("title"),
                    F.col("job.location.name").alias("location"), F.col("job.updated_at").alias("updated_at"),
                    F.col("job.content").alias("content_html"))


def scan_board_flat(bodies: DataFrame, body: str = "body", keep: list[str] | None = None) -> DataFrame:
    """Board B: flat job records with structured remote fields."""
    keep = keep or []
    j = bodies.select(*keep, F.posexplode(F.from_json(F.col(body), BOARD_B_SCHEMA)["jobs"]).alias("pos", "job"))
    return j.select(*keep, "pos", F.col("job.id").alias("job_id"), "job.title", "job.location",
                    F.col("job.publishedAt").alias("updated_at"), F.col("job.descriptionHtml").alias("content_html"),
                    F.col("job.department").alias("department_raw"), F.col("job.jobUrl").alias("url"),
                    "job.isRemote", "job.workplaceType",
                    C.work_mode_structured("job.isRemote", "job.workplaceType", "job.location").alias("work_mode"))


def scan_archive_index(bodies: DataFrame, body: str = "body", keep: list[str] | None = None) -> DataFrame:
    """Header-plus-rows JSON -> one record per row; a body with <= 1 row is empty."""
    keep = keep or []
    arr = F.from_json(F.col(body), T.ArrayType(T.ArrayType(T.StringType())))
    b = bodies.select(*keep, arr.alias("a")).where(F.size("a") > 1)
    rows = b.select(*keep, F.col("a")[0].alias("h"),
                    F.posexplode(F.slice("a", 2, F.size("a") - 1)).alias("pos", "row"))
    m = F.map_from_arrays("h", "row")
    return rows.select(*keep, "pos", *[m[c].alias(c) for c in INDEX_HEADER])


def http_ok_only(index: DataFrame) -> DataFrame:
    return index.where(F.col("statuscode") == "200")


def snapshot_union_anti(primary: DataFrame, alternate: DataFrame) -> DataFrame:
    """Primary index rows plus the first alternate row (by page and position)
    of every timestamp that the primary lacks, ordered by timestamp.  Anti
    join and union, both keyed by timestamp: no index is ever collected."""
    seen = primary.select("timestamp").distinct()
    alt = (alternate.groupBy("timestamp").agg(F.min_by("original", F.struct("page", "pos")).alias("original"))
                    .join(seen, "timestamp", "left_anti"))
    return (primary.select("timestamp", "original", F.lit("primary").alias("source"))
            .unionByName(alt.select("timestamp", "original", F.lit("alternate").alias("source"))).orderBy("timestamp"))


def postings_from_boards(jobs: DataFrame) -> DataFrame:
    """The 15-column postings table of parsed board jobs (``company, job_id,
    title, location, updated_at, salary_block, description_md``): salary from
    the block, department, seniority and work mode from title and location."""
    s = parse_salary("salary_block")
    return (jobs.withColumn("_s", s)
            .withColumn("url", U.posting_url())
            .withColumn("department_raw", C.title_department("title"))
            .select("company", "job_id", "title", "location", "url", "updated_at", "_s.salary_text", "_s.currency",
                    "_s.salary_min", "_s.salary_max", "_s.salary_unit", "department_raw",
                    C.normalize_department("department_raw").alias("department"), C.seniority("title").alias("seniority"),
                    C.work_mode("location").alias("work_mode"), "description_md"))


def snapshot_records(bodies: DataFrame) -> DataFrame:
    """Job records of landed archive bodies ``(ts, page, url, body)``, ready for
    the fold: ``(job_id, ts, pos, title, location, department, snapshot_url,
    salary_text, currency, salary_min, salary_max, salary_unit)``.

    Bodies that are no JSON object give nothing; ``pos`` is the place inside
    the snapshot, page by page.  Salary is read from the text of the
    description if it states one.  Row by row, for tables and streams alike.
    """
    jobs = scan_board_flat(payload_guard(bodies).withColumnRenamed("url", "snapshot_url"), keep=["ts", "page", "snapshot_url"])
    salary = let(html_to_text("content_html"), lambda text: parse_salary(F.when(looks_like_salary(text), text)))
    return jobs.withColumn("_s", salary).select(
        "job_id", "ts", (F.shiftleft("page", 32) + F.col("pos")).alias("pos"), "title", "location",
        F.col("department_raw").alias("department"), "snapshot_url", "_s.salary_text", "_s.currency", "_s.salary_min", "_s.salary_max",
        "_s.salary_unit")


# ---------------------------------------------------------------- builders

def _content_html(p: DataFrame) -> Column:
    """Escaped HTML body of a posting: salary block plus description."""
    inner = F.concat(F.lit("<h3>Salary</h3><p>"), F.coalesce("salary_text", F.lit("")), F.lit("</p><div>"),
                     F.coalesce("description_md", F.lit("")), F.lit("</div>"))
    for ch, ent in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        inner = F.replace(inner, F.lit(ch), F.lit(ent))
    return inner


JOBS_PER_BODY = 500


def _bodies(p: DataFrame, job: Column) -> DataFrame:
    """Bodies of at most ``JOBS_PER_BODY`` jobs (a page of consecutive keys of
    one company and day), and an HTML error page for fetches on the 1st of a month."""
    page = F.floor(F.col("k") / JOBS_PER_BODY).alias("page")
    g = p.groupBy("company", F.col("first_seen").alias("day"), page).agg(F.collect_list(job).alias("jobs"))
    errors = p.where(F.dayofmonth("first_seen") == 1).select("company", F.col("first_seen").alias("day")).distinct()
    return g.select("company", "day", "page", F.to_json(F.struct("jobs")).alias("body")).unionByName(
        errors.select("company", "day", F.lit(-1).cast("long").alias("page"), F.lit("<html><body>rate limited</body></html>").alias("body")))


def board_a_payloads(p: DataFrame) -> DataFrame:
    job = F.struct(F.col("k").alias("id"), F.col("title"),
                   F.when(F.col("location").isNotNull(), F.struct(F.col("location").alias("name"))).alias("location"),
                   F.col("first_seen").cast("string").alias("updated_at"), _content_html(p).alias("content"))
    return _bodies(p, job)


def board_b_payloads(p: DataFrame) -> DataFrame:
    job = F.struct(F.col("job_id").alias("id"), "title", "location",
                   F.col("first_seen").cast("string").alias("publishedAt"),
                   F.col("description_md").alias("descriptionHtml"), F.col("department_raw").alias("department"),
                   F.concat(F.lit("https://jobs.example.com/"), F.col("company"), F.lit("/"), F.col("job_id"))
                   .alias("jobUrl"),
                   F.coalesce(F.col("location").startswith("Remote"), F.lit(False)).alias("isRemote"),
                   F.when(F.col("location").isNull(), F.lit("Remote")).otherwise(F.lit("Hybrid")).alias("workplaceType"))
    return _bodies(p, job)


def index_rows_from_events(events: DataFrame) -> DataFrame:
    """Archive index rows: the 14-digit snapshot time, a board URL per event
    type, status 500 for errors."""
    return events.select(
        F.col("event_id"), F.col("event_type").alias("board"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyyMMddHHmmss").alias("timestamp"),
        F.concat(F.lit("boards.example.com/v1/boards/"), F.col("event_type"), F.lit("/jobs")).alias("original"),
        F.when(F.col("event_type") == "error", F.lit("500")).otherwise(F.lit("200")).alias("statuscode"))


def archive_index_bodies(events: DataFrame) -> DataFrame:
    """Index bodies of at most ``JOBS_PER_BODY`` rows (a page of consecutive
    event ids of one board and hour): a header row, then the records by id."""
    rows = index_rows_from_events(events)
    rec = F.array(F.col("timestamp"), F.col("original"), F.col("statuscode"))
    page = F.concat_ws("-", F.substring("timestamp", 1, 10), F.floor(F.col("event_id") / JOBS_PER_BODY))
    g = rows.groupBy("board", page.alias("page")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("event_id", rec.alias("rec")))), lambda x: x["rec"]).alias("recs"))
    header = F.array(*[F.array(*[F.lit(h) for h in INDEX_HEADER])])
    return g.select("board", "page", F.to_json(F.concat(header, F.col("recs"))).alias("body"))


def snapshot_bodies(jobs: DataFrame) -> DataFrame:
    """Landed archive bodies ``(ts, page, url, body)`` of job records: a
    snapshot comes in pages of at most ``JOBS_PER_BODY`` consecutive event
    ids, beside an HTML error page for every midnight."""
    html = F.concat(F.lit("<div><p>About the "), "title", F.lit("</p><p>"), F.coalesce("pay", F.lit("")), F.lit("</p></div>"))
    job = F.struct("event_id", F.struct(
        F.col("job_id").alias("id"), "title", "location", F.col("ts").cast("string").alias("publishedAt"), html.alias("descriptionHtml"),
        "department", F.lit(None).cast("string").alias("jobUrl"), F.lit(None).cast("boolean").alias("isRemote"),
        F.lit(None).cast("string").alias("workplaceType")).alias("job"))
    listed = F.transform(F.array_sort(F.collect_list(job)), lambda x: x["job"])
    page = F.floor(F.col("event_id") / JOBS_PER_BODY).alias("page")
    url = F.concat(F.lit("https://web.archive.org/web/"), F.date_format("ts", "yyyyMMddHHmmss"), F.lit("id_/boards.example.com/jobs")).alias("url")
    good = jobs.groupBy("ts", page).agg(listed.alias("jobs")).select("ts", "page", url, F.to_json(F.struct("jobs")).alias("body"))
    errors = jobs.where(F.hour("ts") == 0).select("ts").distinct().select(
        "ts", F.lit(-1).cast("long").alias("page"), url, F.lit("  <html><body>try later</body></html>").alias("body"))
    return good.unionByName(errors)
