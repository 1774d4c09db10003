"""Driver tables and the ``postings`` view derived from them.

The driver ships TPC-H-like tables, not job postings.  ``POSTINGS_SQL`` maps
them onto the 15-column postings schema; the *same text* runs in Spark SQL
and in DuckDB (the oracle), so both sides start from identical input.  It is
input only: no operator logic lives here.

Every order becomes one posting; a posting's description carries the whole
text of the document whose ``doc_id`` equals the order key (no prefix, no id
subset; a thirteenth of the postings without a document have no description), followed by three bullet lines that exercise the rule tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

POSTINGS_SQL = """
select
  o.o_orderkey as k,
  cast(o.o_orderkey as varchar(20)) as job_id,
  lower(r.r_name) as company,
  case when o.o_orderkey % 997 = 0 then null else concat(
    split_part('Senior |Staff ||Lead |Junior |Head of ||Principal |Associate ', '|', cast(o.o_orderkey % 9 + 1 as int)),
    split_part('Software Engineer|Research Scientist|Product Manager|Recruiter|Account Executive|Commercial Counsel|Security Engineer|Data Center Technician|Marketing Specialist|Tax Accountant|Taxonomy Curator|Technical Program Manager|Policy Analyst|Communications Manager|Data Science Analyst|Inference Systems Developer|Safeguards Analyst|Design Engineer|Office Coordinator|Copywriter', '|', cast(o.o_custkey % 20 + 1 as int))) end as title,
  split_part('Software Engineering - Infrastructure|Engineering & Design - Product|AI Research & Engineering|Product Management, Support, & Operations|People|Finance|Legal|Sales|Communications|Safeguards (Trust & Safety)|AI Public Policy & Societal Impacts|Technical Program Management|Compute|Cloud Go-To-Market (GTM)|IT, Compliance, and Security|IT Helpdesk|Manufacturing (MFG)|Real Estate (DIG)|Something Totally New|', '|', cast(o.o_custkey % 20 + 1 as int)) as department_raw,
  case o.o_orderkey % 6 when 0 then n.n_name when 1 then concat(n.n_name, ' | ', r.r_name) when 2 then concat('Remote - ', n.n_name) when 3 then concat(n.n_name, '; ', r.r_name, ' | ') when 4 then null else '' end as location,
  split_part('USD|USD|EUR|GBP|CAD|AUD|JPY', '|', cast(o.o_orderkey % 7 + 1 as int)) as currency,
  case when o.o_orderkey % 17 = 0 then null else cast(floor(o.o_totalprice / 1000) as bigint) * 1000 end as salary_min,
  case when o.o_orderkey % 17 = 0 then null else cast(floor(o.o_totalprice / 1000) as bigint) * 1000 + (o.o_orderkey % 40 + 1) * 1000 end as salary_max,
  case o.o_orderkey % 8
    when 0 then concat('Annual Salary: $', cast(cast(floor(o.o_totalprice / 1000) as bigint) as varchar(20)), ',000 - $', cast(cast(floor(o.o_totalprice / 1000) as bigint) + 20 as varchar(20)), ',000 USD')
    when 1 then concat('€', cast(cast(floor(o.o_totalprice / 1000) as bigint) as varchar(20)), '.000 — €', cast(cast(floor(o.o_totalprice / 1000) as bigint) + 20 as varchar(20)), '.000')
    when 2 then concat(cast(cast(floor(o.o_totalprice / 1000) as bigint) as varchar(20)), ',000–', cast(cast(floor(o.o_totalprice / 1000) as bigint) + 20 as varchar(20)), ',000 CAD per year')
    when 3 then concat('$', cast(o.o_orderkey % 60 + 15 as varchar(20)), '/hr to $', cast(o.o_orderkey % 60 + 25 as varchar(20)), '/hr')
    when 4 then concat('£', cast(cast(floor(o.o_totalprice / 1000) as bigint) as varchar(20)), ',000 and £', cast(cast(floor(o.o_totalprice / 1000) as bigint) + 20 as varchar(20)), ',000')
    when 5 then concat('$1,', cast(o.o_orderkey % 900 + 100 as varchar(20)), '/per week')
    when 6 then 'Competitive pay in USD' else null end as salary_text,
  cast(o.o_orderdate as date) as first_seen,
  cast(o.o_orderdate as date) + cast(o.o_orderkey % 121 as int) as last_seen,
  o.o_orderstatus = 'O' as is_active,
  case when o.o_orderkey % 13 = 0 and d.doc_id is null then null else concat(coalesce(d.text || chr(10), ''), '* ',
    split_part('Build it from scratch and own the roadmap|Contribute to team goals and assist the lead|5+ years of experience in Python and SQL|3-5 years with Spark on AWS|PhD in physics or a BS in computer science|Hire and manage a founding team|JavaScript, TypeScript and C++11|At least 12 years of professional experience, 2 years in Go|Stakeholder work across cross-functional groups|Bachelor''s degree; set the vision', '|', cast(o.o_orderkey % 10 + 1 as int)), chr(10), '* ',
    split_part('Java, Kotlin and Scala services|PyTorch, TensorFlow or JAX for deep learning|LLMs, RLHF and fine-tuning of transformers|Kubernetes, Docker and Terraform on Linux|Snowflake, dbt and Postgres pipelines|Redis, GraphQL and REST APIs|React and Node.js front ends|Git, CI/CD and Agile habits|GCP or Azure; R programming|Ruby or Rust; NLP and RAG|Machine learning and AI safety research|MBA or Master''s degree|Law degree, JD and bar admission|Mathematics or statistics', '|', cast(o.o_orderkey % 14 + 1 as int)), chr(10), '- ',
    split_part('Greenfield build out|Ground up redesign|First hire here|Shape the plan|Lead the effort|Build a team and define the strategy|Manage a team|Grow the team|Join a team|Report to the head|Work under guidance; support the team; cross-functional leadership', '|', cast(o.o_orderkey % 11 + 1 as int))) end as description_md
from orders o
join customer c on o.o_custkey = c.c_custkey
join nation n on c.c_nationkey = n.n_nationkey
join region r on n.n_regionkey = r.r_regionkey
left join documents d on d.doc_id = o.o_orderkey
"""

# the same table without text: cut at the description column and the document join
FACTS_SQL = (POSTINGS_SQL[:POSTINGS_SQL.index(",\n  case when o.o_orderkey % 13 = 0")]
             + POSTINGS_SQL[POSTINGS_SQL.index("\nfrom orders o"):POSTINGS_SQL.index("left join documents")])

# one job record of an archived board snapshot per event: the snapshot of an
# hour lists its jobs by event id; some ids are blank or missing, some records
# state no pay, a pay of zero, or one amount
SNAPSHOTS_SQL = """
select
  e.event_id,
  date_trunc('hour', e.ts) as ts,
  case when e.user_id % 10 = 7 then '' when e.user_id % 10 = 8 then null else cast(e.user_id as varchar(20)) end as job_id,
  concat(e.event_type, ' role ', cast(e.event_id % 7 as varchar(20))) as title,
  case e.event_id % 4 when 0 then null when 1 then '' else concat('City ', cast(e.event_id % 9 as varchar(20))) end as location,
  case when e.event_type = 'view' then null else concat('Team ', e.event_type) end as department,
  case e.event_type
    when 'purchase' then concat('Annual Salary: $', cast(cast(floor(e.value) as bigint) + 1 as varchar(20)), ',000 - $', cast(cast(floor(e.value) as bigint) + 21 as varchar(20)), ',000 USD')
    when 'click' then concat('Pays €', cast(cast(floor(e.value) as bigint) + 1 as varchar(20)), ' EUR per hour')
    when 'signup' then '$0 - $0 CAD per year'
    when 'view' then 'Competitive pay' else null end as pay
from events e
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def postings(spark: SparkSession, sf_dir: str, text: bool = True) -> DataFrame:
    """The 15-column postings table (plus key ``k`` and history columns).

    ``text=False`` leaves out ``description_md`` and with it the join of the
    documents, which an engine cannot drop by itself."""
    register_tables(spark, sf_dir, ["orders", "customer", "nation", "region", *(["documents"] if text else [])])
    return spark.sql(POSTINGS_SQL if text else FACTS_SQL)


def snapshot_jobs(events: DataFrame) -> DataFrame:
    """Job records of archived snapshots, one per event (input only)."""
    return events.sparkSession.sql(SNAPSHOTS_SQL.replace("from events e", "from {events} e"), events=events)


PAGES_JOIN_SQL = ("left join pages pg on pg.page_id = "
                  "postings.k % (select count(*) from pages)")


def postings_with_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings with an archived page each (``page_id = k mod #pages``): the
    page URL is the posting's snapshot URL, its HTML the landed snapshot."""
    from pyspark.sql import functions as F
    p = postings(spark, sf_dir)
    pages = table(spark, sf_dir, "pages")
    n = pages.select(F.count("*")).scalar()
    return (p.withColumn("_page", F.pmod(F.col("k"), n))
             .join(pages.select(F.col("page_id").alias("_page"), F.col("url").alias("snapshot_url")), "_page", "left")
             .drop("_page"))
