"""Registered queries: landed payloads, archive indexes, URLs, backfill."""

from __future__ import annotations

from pyspark.sql import functions as F

from paygrid.functions import urls as U
from paygrid.operators import history as H
from paygrid.plans import oracle_rules as O
from paygrid.plans.catalog import register
from paygrid.plans.q_text import WS, unescape_sql
from paygrid.sources import boards as B
from paygrid.sources import fixture

PS = f"({fixture.POSTINGS_SQL})"


def raw(spark, sf):
    return fixture.postings(spark, sf)


def facts_raw(spark, sf):
    """Postings whose description is not read."""
    return fixture.postings(spark, sf, text=False).withColumn("description_md", F.lit(None).cast("string"))


register("payload_guard", f"select distinct company, first_seen as day, k // {B.JOBS_PER_BODY} as page from {PS}")(
    lambda spark, sf: B.payload_guard(B.board_a_payloads(facts_raw(spark, sf))).select("company", "day", "page"))

register("scan_board_nested", f"select job_id, title, location, cast(first_seen as varchar) as updated_at "
         f"from {PS}")(
    lambda spark, sf: B.scan_board_nested(B.payload_guard(B.board_a_payloads(raw(spark, sf)))).select(
        "job_id", "title", "location", "updated_at"))

_WMS = ("case when coalesce(starts_with(location, 'Remote'), false) then 'Remote-Friendly' "
        "when location is null then 'Remote-Friendly' " + O.work_mode_sql()[5:])

register("scan_board_flat", f"select job_id, title, location, cast(first_seen as varchar) as updated_at, "
         f"department_raw, 'https://jobs.example.com/' || company || '/' || job_id as url, {_WMS} as work_mode "
         f"from {PS}")(
    lambda spark, sf: B.scan_board_flat(B.payload_guard(B.board_b_payloads(raw(spark, sf)))).select(
        "job_id", "title", "location", "updated_at", "department_raw", "url", "work_mode"))

register("work_mode_structured", f"select job_id, {_WMS} as work_mode from {PS}")(
    lambda spark, sf: B.scan_board_flat(B.payload_guard(B.board_b_payloads(facts_raw(spark, sf)))).select(
        "job_id", "work_mode"))

_IDX = ("idx as (select event_type as board, strftime(ts, '%Y%m%d%H%M%S') as timestamp, "
        "'boards.example.com/v1/boards/' || event_type || '/jobs' as original, "
        "case when event_type = 'error' then '500' else '200' end as statuscode, event_id from events)")


def index(spark, sf):
    bodies = B.archive_index_bodies(fixture.table(spark, sf, "events"))
    return B.scan_archive_index(bodies, keep=["board", "page"])


register("scan_archive_index", f"with {_IDX} select timestamp, original, statuscode from idx")(
    lambda spark, sf: index(spark, sf).select("timestamp", "original", "statuscode"))

register("http_ok_only", f"with {_IDX} select timestamp, original, statuscode from idx where statuscode = '200'")(
    lambda spark, sf: B.http_ok_only(index(spark, sf)).select("timestamp", "original", "statuscode"))

register("snapshot_union_anti", f"with {_IDX}, prim as (select timestamp, original from idx where board = 'view' and statuscode = '200'), "
         "alt as (select timestamp, first(original order by event_id) as original from idx where board = 'click' and statuscode = '200' group by 1) "
         "select timestamp, original, 'primary' as source from prim union all select timestamp, original, "
         "'alternate' from alt where timestamp not in (select timestamp from prim)")(
    lambda spark, sf: _union_anti(spark, sf))


def _union_anti(spark, sf):
    idx = B.http_ok_only(index(spark, sf))
    return B.snapshot_union_anti(idx.where(F.col("board") == "view"), idx.where(F.col("board") == "click"))


# ------------------------------------------------------------ URLs

PAGE_BOARDS = [("example-com", "example.com", r"^([^/]+)/(\d+)"),
               ("example-net", "example.net", r"^([^/]+)/(\d+)"),
               ("example-org", "example.org", r"^([^/]+)/(\d+)")]
_HOST = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_PATH = ("regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), "
         "'^/+|/+$', '', 'g')")


def _key_sql() -> str:
    cases = {"board": [], "company": [], "job_id": []}
    for board, host, pat in PAGE_BOARDS:
        cond = f"contains(h, {O.q(host)}) and regexp_matches(pth, {O.q(pat)})"
        cases["board"].append(f"when {cond} then {O.q(board)}")
        cases["company"].append(f"when {cond} then lower(regexp_extract(pth, {O.q(pat)}, 1))")
        cases["job_id"].append(f"when {cond} then regexp_extract(pth, {O.q(pat)}, 2)")
    cols = ", ".join(f"case {' '.join(v)} end as {k}" for k, v in cases.items())
    return f"select page_id, {cols} from (select page_id, {_HOST} as h, {_PATH} as pth from pages)"


register("posting_key_from_url", _key_sql())(
    lambda spark, sf: fixture.table(spark, sf, "pages").select(
        "page_id", U.posting_key("url", PAGE_BOARDS).alias("key")).select(
        "page_id", "key.board", "key.company", "key.job_id"))

register("posting_url", f"select job_id, 'https://job-boards.greenhouse.io/' || company || '/jobs/' || job_id as url "
         f"from {PS}")(
    lambda spark, sf: facts_raw(spark, sf).select("job_id", U.posting_url().alias("url")))

register("ensure_query_param", "select page_id, case when contains(url, 'content=true') then url else "
         "regexp_replace(url, '/+$', '') || '?content=true' end as url from pages")(
    lambda spark, sf: fixture.table(spark, sf, "pages").select("page_id", U.ensure_query_param("url").alias("url")))

_SNAP = ("'https://web.archive.org/web/' || strftime(first_seen, '%Y%m%d') || '000000/' || "
         "'https://job-boards.greenhouse.io/' || company || '/jobs/' || job_id")

register("raw_snapshot_url", f"select job_id, regexp_replace({_SNAP}, '(web\\.archive\\.org/web/\\d+)/', "
         f"'\\1id_/', 'g') as raw_url from {PS}")(
    lambda spark, sf: facts_raw(spark, sf).select("job_id", U.raw_snapshot_url(F.concat(
        F.lit("https://web.archive.org/web/"), F.date_format("first_seen", "yyyyMMdd"), F.lit("000000/"),
        U.posting_url())).alias("raw_url")))

register("company_label", "select distinct company, array_to_string(list_transform(string_split(replace(replace("
         "regexp_extract('/data/' || replace(company, ' ', '_') || '_salaries.csv', '([^/]*?)(\\.[^./]*)?$', 1), "
         "'_salaries', ''), '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') as label "
         f"from {PS}")(
    lambda spark, sf: facts_raw(spark, sf).select("company", U.company_label(F.concat(
        F.lit("/data/"), F.replace("company", F.lit(" "), F.lit("_")), F.lit("_salaries.csv"))).alias("label")
    ).distinct())

# ------------------------------------------------------------ backfill

_PW = (f"pw as (select postings.*, pg.url as snapshot_url from ({fixture.POSTINGS_SQL}) postings "
       f"{fixture.PAGES_JOIN_SQL}), "
       f"nd as (select *, ({O.content_family_sql()}) and trim(coalesce(description_md, '')) = '' "
       f"and trim(coalesce(snapshot_url, '')) <> '' as need from pw)")

register("needs_description", f"with {_PW} select job_id from nd where need")(
    lambda spark, sf: fixture.postings_with_snapshots(spark, sf).where(H.needs_description(None)).select("job_id"))

# markdown of the driver's pages: an article of a heading, paragraphs, bold runs and breaks
_MD = f"regexp_replace({unescape_sql('html')}, '(?s)^.*<article>(.*)</article>.*$', '\\1')"
_MD = f"regexp_replace({_MD}, {O.q(WS + '+')}, ' ', 'g')"
for _tag, _md in (("<h1>", "chr(10) || chr(10) || '# '"), ("</h1>", "chr(10) || chr(10)"), ("<p>", "chr(10) || chr(10)"),
                  ("</p>", "chr(10) || chr(10)"), ("<b>", "'**'"), ("</b>", "'**'"), ("<br>", "chr(10)")):
    _MD = f"replace({_MD}, '{_tag}', {_md})"
_MD = f"regexp_replace(regexp_replace({_MD}, '[ \\t]+\\n', chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
_MD = f"regexp_replace({_MD}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
BACKFILL_SQL = (f"with {_PW}, txt as (select url, {_MD} as md from pages), filled as (select nd.job_id, title, case when need "
                "then coalesce(md, '') else description_md end as description_md from nd left join txt on nd.need and "
                "nd.snapshot_url = txt.url)")

register("backfill_description", f"{BACKFILL_SQL} select job_id, description_md from filled where {O.content_family_sql()}")(
    lambda spark, sf: _backfill(spark, sf))


def _backfill(spark, sf):
    from paygrid.functions.classify import is_content_family
    out = H.backfill_description(fixture.postings_with_snapshots(spark, sf), fixture.table(spark, sf, "pages"))
    return out.where(is_content_family("title")).select("job_id", "description_md")


# ------------------------------------------------------------ pages (rows-only checks)

from paygrid.functions import salary as SAL  # noqa: E402
from paygrid.sources import pages as PG  # noqa: E402

register("page_blocks")(lambda spark, sf: PG.page_blocks(fixture.table(spark, sf, "pages")))

register("main_content")(lambda spark, sf: PG.main_content(fixture.table(spark, sf, "pages")).drop("markdown"))

register("html_to_markdown", f"select page_id, 6 as tier, {_MD} as markdown from pages")(lambda spark, sf: PG.main_content_markdown(fixture.table(spark, sf, "pages")))



def _board_jobs(spark, sf):
    return PG.board_content(B.scan_board_nested(B.payload_guard(B.board_a_payloads(raw(spark, sf))), keep=["company"]))


register("html_to_markdown_board")(lambda spark, sf: _board_jobs(spark, sf).select("job_id", F.col("description_md").alias("markdown")))

register("postings_from_boards")(lambda spark, sf: B.postings_from_boards(_board_jobs(spark, sf)))


def _salary_block(spark, sf):
    p = raw(spark, sf)
    sb = PG.salary_block(PG.salary_pages(p))
    return sb.select("page_id", "salary_block", SAL.parse_salary("salary_block").alias("s")).select(
        "page_id", "salary_block", "s.currency", "s.salary_min", "s.salary_max", "s.salary_unit")


register("salary_block")(_salary_block)
