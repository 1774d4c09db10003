"""Character references, markup, salary text, main content: values written by hand."""

import html as stdlib_html

import pytest
from pyspark.sql import functions as F

from paygrid import rules as R
from paygrid.functions import regex, salary, text
from paygrid.sources import pages


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t"))).collect()]


def test_unescape(spark):
    values = ["a &amp; b", "&eacute;&#8217;&#x2014;", "&copy 2024 &notit; &amp;lt;", "&#128;&#0;&#xD800;&#99999999;", "& &; &# &#x; &nosuch; AT&T",
              "&#36;100", "no reference", "", None, "&NotEqualTilde;", "&ampamp;", "&#65x &#x41g", "&lt;p&gt;"]
    assert column(spark, values, text.html_unescape) == [None if v is None else stdlib_html.unescape(v) for v in values]


@pytest.mark.parametrize("src,want", [
    ("&lt;p&gt;Pay &amp;mdash; hi&lt;/p&gt;", "Pay — hi"),
    ("<p>Pay &mdash; hi</p>", "Pay — hi"),
    ("<div>a<br>b</div><script>x<y</script><!-- <b>no</b> --> c &amp; d", "a b c & d"),
    ("3 < 4 and 5 > 2", "3 < 4 and 5 > 2"),
])
def test_html_to_text(spark, src, want):
    assert column(spark, [src], text.html_to_text) == [want]


def test_salary_markup(spark):
    got = column(spark, ["&#36;100,000 &#8211; &#36;120,000"], salary.parse_salary)[0]
    assert (got.salary_min, got.salary_max, got.currency) == (100000, 120000, "USD")
    got = column(spark, ["<p>$100,000<b> - </b>$120,000</p>"], salary.reparse_salary)[0]
    assert (got.salary_min, got.salary_max, got.currency) == (100000, 120000, "USD")


def test_guarded_search_equals_plain(spark):
    """The literal prefilter never changes a match, letters that fold oddly included."""
    rules = [p for _, p in [*R.SKILL_KEYWORDS, *R.EDU_PATTERNS]]
    words = ["Lİnux admin", "LıNUX", "ſql ſpark", "K8s Kubernetes", "PYTHON, JAVA; c++ C++11", "PhD degree", "Bachelor's", "nothing", ""]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    cols = [(regex.matches(F.col("t"), p), F.coalesce(F.col("t").rlike(regex.jpat(p)), F.lit(False))) for p in rules]
    row = df.select(*[F.struct(a.alias("a"), b.alias("b")).alias(f"c{i}") for i, (a, b) in enumerate(cols)]).collect()
    assert all(c.a == c.b for r in row for c in r)


TIERS = [
    (1, "<body><main>m</main><div id=content><header>Head</header><p>one</p><footer>Foot</footer></div></body>", "Head one Foot"),
    (2, "<body><article>a</article><div class='x job-description y'>two</div></body>", "two"),
    (3, "<body><main>m</main><div class='page-body'>three</div></body>", "three"),
    (4, "<body><main>m</main><div id=app_body>four</div></body>", "four"),
    (5, "<body><article>a</article><main>five</main></body>", "five"),
    (6, "<body><p>p</p><article>six</article></body>", "six"),
    (7, "<html><body><nav>menu</nav><p>seven</p><footer>foot</footer></body></html>", "seven"),
    (None, "<p>none", ""),
]


def test_main_content_tiers(spark):
    df = spark.createDataFrame([(i, h) for i, (_, h, _) in enumerate(TIERS)] + [(99, None)], "page_id long, html string")
    got = {r.page_id: r for r in pages.main_content(df).collect()}
    assert [(got[i].tier, got[i].text) for i in range(len(TIERS))] == [(t, x) for t, _, x in TIERS]
    assert got[0].markdown == "Head\n\none\n\nFoot" and got[6].markdown == "seven" and got[99].text == ""
    assert pages.main_content(df)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0


def test_markdown_lists():
    assert pages.to_markdown("<ol><li>a<li>b<ul><li>c</ul><li>d</ol><ul><li>e</ul>") == "1. a\n2. b\n\n  * c\n\n3. d\n\n* e"


STAGES = [
    ("<p>x</p><p>Compensation will be paid in the range of $1 - $2. More.</p>", "Compensation will be paid in the range of $1 - $2."),
    ("<div><h3>Salary</h3><p>$10,000 - $20,000</p></div>", "Salary $10,000 - $20,000"),
    ("<article><section><h3>Pay</h3></section><p>see</p><p>$10,000 - $20,000</p><p>more</p></article>", "see $10,000 - $20,000"),
    ("<i>Salary is 10 USD</i>", "Salary is 10 USD"),
    ("<i>we give $10,000 - $20,000 a year</i>", "we give $10,000 - $20,000 a year"),
    ("<p>nothing here</p>", None),
]


def test_salary_block_stages(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(STAGES)] + [(9, None)], "page_id long, html string")
    got = {r.page_id: r.salary_block for r in pages.salary_block(df).collect()}
    assert [got[i] for i in range(len(STAGES))] == [w for _, w in STAGES] and got[9] is None


def test_blocks_hold_own_text_once(spark):
    df = spark.createDataFrame([(1, "<div>a<p>b <b>c</b></p>d</div>")], "page_id long, html string")
    got = [(r.tag, r.parent_id, r.pos, r.text) for r in pages.page_blocks(df).orderBy("node_id").collect()]
    assert got == [("[document]", -1, 0, ""), ("div", 0, 0, "a d"), ("p", 1, 0, "b"), ("b", 2, 0, "c")]


def test_boards_to_postings(spark):
    from paygrid.plans import load_all
    p = load_all()[0]["postings_from_boards"](spark, "/root/testdata/sf0.001")
    rows = {r.job_id: r for r in p.collect()}
    assert len(rows) == 1500 and p.columns[1:] == [f.name for f in __import__("paygrid.sources.postings", fromlist=["x"]).POSTINGS_SCHEMA.fields]
    r = rows["8"]
    assert r.salary_text.startswith("Salary Annual Salary: $") and r.salary_unit == "annual" and r.salary_min < r.salary_max


def test_dedup_stream_remembers_far_and_late_rows(spark):
    from paygrid.streaming.fold import run_dedup_stream
    rows = [(1, "2020-01-01 00:00:00"), (2, "2024-01-01 00:00:00"), (3, "2020-01-01 00:00:00"), (4, "2024-01-01 00:00:01"), (5, "2019-06-01 00:00:00")]
    events = spark.createDataFrame(rows, "event_id long, ts string").selectExpr("event_id", "cast(ts as timestamp) as ts")
    assert run_dedup_stream(spark, events, files_per_trigger=1).select("snap_ts").distinct().count() == 4
    assert run_dedup_stream(spark, events, files_per_trigger=1).count() == 4
