"""Postings and history tables: explicit schemas, scans, sinks, enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paygrid.functions import classify as C

POSTINGS_SCHEMA = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("updated_at", T.StringType()),
    T.StructField("salary_text", T.StringType()),
    T.StructField("currency", T.StringType()),
    T.StructField("salary_min", T.LongType()),
    T.StructField("salary_max", T.LongType()),
    T.StructField("salary_unit", T.StringType()),
    T.StructField("department_raw", T.StringType()),
    T.StructField("department", T.StringType()),
    T.StructField("seniority", T.StringType()),
    T.StructField("work_mode", T.StringType()),
    T.StructField("description_md", T.StringType()),
])

HISTORY_CSV_SCHEMA = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("department", T.StringType()),
    T.StructField("salary_min", T.DoubleType()),
    T.StructField("salary_max", T.DoubleType()),
    T.StructField("currency", T.StringType()),
    T.StructField("salary_unit", T.StringType()),
    T.StructField("first_seen", T.StringType()),
    T.StructField("last_seen", T.StringType()),
    T.StructField("is_active", T.StringType()),
    T.StructField("snapshot_url", T.StringType()),
    T.StructField("description_md", T.StringType()),
])

_CSV = dict(header=True, multiLine=True, quote='"', escape='"')
# the CSV writer trims values by default; postings keep their text as is
_CSV_WRITE = dict(_CSV, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def scan_postings(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Current postings; ``job_id`` always a string, never inferred."""
    if fmt == "csv":
        return spark.read.schema(POSTINGS_SCHEMA).options(**_CSV).csv(path)
    return spark.read.parquet(path).withColumn("job_id", F.col("job_id").cast("string"))


def scan_history(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Posting history: ``yyyyMMdd`` dates parsed, ``True/False`` flag to boolean."""
    if fmt != "csv":
        return spark.read.parquet(path)
    df = spark.read.schema(HISTORY_CSV_SCHEMA).options(**_CSV).csv(path)
    return df.withColumns({
        "first_seen": F.to_date("first_seen", "yyyyMMdd"),
        "last_seen": F.to_date("last_seen", "yyyyMMdd"),
        "is_active": F.lower(F.col("is_active")) == "true",
    })


def sink_postings(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet") -> None:
    cols = [f.name for f in POSTINGS_SCHEMA.fields]
    extra = ["company"] if "company" in df.columns else []
    w = df.select(*cols, *extra).write.mode(mode)
    if extra:
        w = w.partitionBy("company")
    if fmt == "csv":
        w.options(**_CSV_WRITE).csv(path)
    else:
        w.parquet(path)


def history_frame(df: DataFrame) -> DataFrame:
    """History as it is written: zero/absent salary blank, dates as yyyyMMdd,
    flag as True/False text, rows ordered by first_seen then job_id."""
    def opt(c):
        return F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c)
    return (df.select(
        F.col("job_id").cast("string").alias("job_id"), opt("title"), opt("location"), opt("department"),
        F.nullif(F.col("salary_min"), F.lit(0)).alias("salary_min"),
        F.nullif(F.col("salary_max"), F.lit(0)).alias("salary_max"),
        opt("currency"), opt("salary_unit"),
        F.date_format("first_seen", "yyyyMMdd").alias("first_seen"),
        F.date_format("last_seen", "yyyyMMdd").alias("last_seen"),
        F.when(F.col("is_active"), F.lit("True")).otherwise(F.lit("False")).alias("is_active"),
        opt("snapshot_url")))


def sink_history(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One sorted table: by first_seen, then as the rows came in.  Ranges of
    (date, input place) are dealt to tasks and sorted there, so the part files
    follow each other and a date with most of the rows is still split."""
    rows = history_frame(df).withColumn("_in", F.monotonically_increasing_id())
    rows.orderBy("first_seen", "_in").drop("_in").write.mode(mode).options(**_CSV_WRITE).csv(path)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a build of ``path`` was committed: Spark writes ``_SUCCESS`` last,
    after all parts have been moved into place."""
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def build_if_absent(df: DataFrame, path: str) -> bool:
    """Materialise once: a committed output is left untouched; the rest of a
    build that broke off is replaced.  Returns whether it was built now."""
    if is_complete(df.sparkSession, path):
        return False
    (history_frame(df).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true")
     .options(**_CSV_WRITE).csv(path))
    return True


def sink_backfill(df: DataFrame, path: str) -> None:
    """Write the backfilled history to a *new* path (never the one being read)."""
    df.write.mode("errorifexists").parquet(path)


def enrich(df: DataFrame) -> DataFrame:
    """Derived columns shared by the analyses.  Catalyst prunes the ones a
    query does not use, so unused regex chains cost nothing."""
    has_salary = F.col("salary_min").isNotNull() & F.col("salary_max").isNotNull()
    return (C.add_usd_salary(df)
            .withColumns({
                "title_department": C.title_department("title"),
                "department": C.normalize_department("department_raw"),
                "seniority": C.seniority("title"),
                "work_mode": C.work_mode("location"),
                "has_salary": has_salary,
                "salary_mid": C.salary_mid(),
                "range_usd": F.col("max_usd") - F.col("min_usd"),
            }))


def default_columns(df: DataFrame) -> DataFrame:
    """Classification, raw-department and USD columns, added only if absent
    (a driver-side check of the schema, no data pass)."""
    out = df
    if "department" not in out.columns:
        out = C.add_classifications(out).withColumn("department", F.col("title_department"))
    if "department_raw" not in out.columns:
        out = out.withColumn("department_raw", F.col("department"))
    if "min_usd" not in out.columns:
        out = C.add_usd_salary(out)
    return out
