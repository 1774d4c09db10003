"""Table-driven cases carried over from the reference's own tests, plus the
salary and experience cases of FIXTURES.md section 2."""

import pytest
from pyspark.sql import functions as F

from paygrid.functions import classify as C
from paygrid.functions import salary as SAL
from paygrid.functions import text as TX
from paygrid.functions import urls as U

DEPARTMENTS = [
    ("Software Engineering - Infrastructure", "Engineering"), ("Cloud Engineering", "Engineering"),
    ("Digital Infrastructure Group (DIG)", "Engineering"), ("Power Infrastructure", "Engineering"),
    ("Software", "Engineering"), ("Hardware", "Engineering"),
    ("Engineering & Design - Product", "Design"), ("Product and Design", "Design"),
    ("AI Research & Engineering", "Research"),
    ("Product Management, Support, & Operations", "Product"),
    ("People", "People"), ("Finance", "Finance"), ("Accounting and Finance", "Finance"),
    ("Strategic Finance and Corporate Development", "Finance"), ("Legal", "Legal"),
    ("Sales", "Sales & BD"), ("Sales and BD", "Sales & BD"), ("Cloud Go-To-Market (GTM)", "Sales & BD"),
    ("Marketing & Brand", "Marketing & Comms"), ("Communications", "Marketing & Comms"),
    ("Marketing", "Marketing & Comms"), ("Security", "Security & Compliance"),
    ("Safeguards (Trust & Safety)", "Security & Compliance"),
    ("IT, Compliance, and Security", "Security & Compliance"),
    ("AI Public Policy & Societal Impacts", "Public Policy"),
    ("Public Affairs and Sustainability", "Public Policy"), ("Manufacturing (MFG)", "Manufacturing"),
    ("Compute", "Operations"), ("Data Center Operations (DIG)", "Operations"),
    ("Business Operations", "Operations"), ("Procurement and Sourcing", "Operations"),
    ("Real Estate (DIG)", "Operations"), ("Technical Program Management", "Other"),
    ("Data Science & Analytics", "Other"), ("Energy Innovation and Commercialization", "Other"),
    ("Environmental, Health and Safety (EHS)", "Other"), ("Something Totally New", "Other"),
    ("Other", "Other"), ("", "Other"), (None, "Other"),
]


def test_normalize_department(spark):
    df = spark.createDataFrame(DEPARTMENTS, "raw string, want string")
    got = df.select("want", C.normalize_department("raw").alias("got")).collect()
    assert [(r.want, r.got) for r in got if r.want != r.got] == []


URLS = [
    ("https://jobs.ashbyhq.com/Crusoe/2689707b-7314-4246-ac95-1e6466970ba3",
     ("ashby", "crusoe", "2689707b-7314-4246-ac95-1e6466970ba3")),
    ("https://jobs.ashbyhq.com/Crusoe/2689707b-7314-4246-ac95-1e6466970ba3?departmentId=abc",
     ("ashby", "crusoe", "2689707b-7314-4246-ac95-1e6466970ba3")),
    ("https://job-boards.greenhouse.io/anthropic/jobs/5080929008", ("greenhouse", "anthropic", "5080929008")),
    ("https://linkedin.com/jobs/12345", None),
]


def test_posting_key_bulk(spark):
    df = spark.createDataFrame([(u,) for u, _ in URLS], "url string")
    got = [r.k for r in df.select(U.posting_key("url").alias("k")).collect()]
    assert [tuple(g) if g else None for g in got] == [w for _, w in URLS]


def test_posting_key_strict_raises(spark):
    df = spark.createDataFrame([("https://linkedin.com/jobs/12345",)], "url string")
    with pytest.raises(Exception, match="Unsupported job board URL"):
        df.select(U.posting_key("url", strict=True).alias("k")).collect()


SALARIES = [
    ("$172,300 — $222,800", 172300, 222800, "USD", None),
    ("$172,300 to $222,800 USD", 172300, 222800, "USD", None),
    ("$12 – 15/hr", 12, 15, "USD", "hourly"),
    ("$150K - $200K", 150, 150, "USD", None),
    ("$25.50 - $30.75 per hour", 25, 25, "USD", "hourly"),
    ("€155.000 — €205.000", 155, 155, "EUR", None),
    ("3-5 years", 3, 5, None, None),
    ("401 and 12", 401, 12, None, None),
    ("$0 - $0", 0, 0, "USD", None),
    ("Annual Salary: $120,000 - $140,000 USD", 120000, 140000, "USD", "annual"),
    ("$1,415/per week", 1415, 1415, "USD", "weekly"),
]


def test_parse_salary(spark):
    df = spark.createDataFrame([(s,) for s, *_ in SALARIES], "t string")
    got = df.select(SAL.parse_salary("t").alias("p")).select("p.*").collect()
    for (text, lo, hi, cur, unit), r in zip(SALARIES, got):
        assert (r.salary_min, r.salary_max, r.currency, r.salary_unit) == (lo, hi, cur, unit), text


def test_reparse_salary_dotted(spark):
    df = spark.createDataFrame([("€155.000 — €205.000",), ("131,040 – 165,000 USD",), ("",)], "t string")
    got = df.select(SAL.reparse_salary("t").alias("p")).select("p.*").collect()
    assert (got[0].salary_min, got[0].salary_max, got[0].currency) == (155000, 205000, "EUR")
    assert (got[1].salary_min, got[1].salary_max, got[1].currency) == (131040, 165000, "USD")
    assert got[2].salary_min is None


def test_experience(spark):
    df = spark.createDataFrame([("5+ years and 3-5 years, 100 years",), (None,)], "d string")
    got = df.select(TX.extract_yoe_max("d").alias("mx"), TX.extract_yoe_first("d").alias("first")).collect()
    assert (got[0].mx, got[0].first) == (5, 5)
    assert (got[1].mx, got[1].first) == (None, None)


TITLES = [
    ("Senior Manager, Finance", "Finance", "Senior"),
    ("Associate Director", "Other", "Junior"),
    ("Taxonomy Curator", "Other", "Mid-Level"),
    ("Tax Accountant", "Finance", "Mid-Level"),
    ("Offensive Security Research, Safeguards", "Safeguards (Trust & Safety)", "Mid-Level"),
    # 11 characters between "research" and "safeguards": falls through to research
    ("Offensive Security Research Engineer, Safeguards", "AI Research & Engineering", "Mid-Level"),
    ("Offensive Security Engineer", "Security", "Mid-Level"),
    ("Head of Communications", "Communications", "Director+"),
    ("Staff Software Engineer", "Engineering & Design - Product", "Staff / Principal"),
    (None, "Other", "Mid-Level"),
]


def test_title_rules(spark):
    df = spark.createDataFrame(TITLES, "t string, d string, s string")
    got = df.select("d", "s", C.title_department("t").alias("gd"), C.seniority("t").alias("gs")).collect()
    assert [(r.d, r.gd, r.s, r.gs) for r in got if (r.d, r.s) != (r.gd, r.gs)] == []


def test_scope_and_skills(spark):
    df = spark.createDataFrame([("Build it from scratch and own the roadmap; C++ and C++11",), (None,)], "d string")
    flags = C.skill_flags("d")
    got = df.select(C.scope_score("d").alias("s"), flags["skill_C_C__"].alias("cpp")).collect()
    # builder: "from scratch" +2, "build ... from" +2; owner: "own" +2, "roadmap" +2 -> 13, clamped to 10
    # "C++ and" has no word character after "++", "C++11" has
    assert got[0].s == 10 and got[0].cpp is True
    assert got[1].s == 5 and got[1].cpp is False


def test_work_mode(spark):
    df = spark.createDataFrame([("Remote - US",), ("",), (None,), ("London",)], "l string")
    assert [r.w for r in df.select(C.work_mode("l").alias("w")).collect()] == [
        "Remote-Friendly", "Office-Only", "Unknown", "Office-Only"]
