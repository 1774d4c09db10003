"""Registered queries: TF-IDF against SQL; SVD, k-means and cluster profiles
have seeds and signs of their own, so tests compare them with dense algebra on
a small table."""

from __future__ import annotations

from pyspark.sql import functions as F

from paygrid import rules as R
from paygrid.operators import ml
from paygrid.plans import oracle_rules as O
from paygrid.plans.catalog import postings, r2, register
from paygrid.sources import fixture

_STOP = ", ".join(O.q(w) for w in sorted(R.SPARK_ENGLISH_STOPWORDS))
TFIDF_SQL = f"""with d as (select job_id, list_filter(regexp_extract_all(lower(description_md), '[\\p{{L}}\\p{{M}}\\p{{N}}_]{{2,}}'),
  lambda w: w not in ({_STOP})) as w from ({fixture.POSTINGS_SQL}) where description_md is not null),
t as (select job_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as term from d),
c as (select job_id, term, count(*) as n from t group by 1, 2),
v as (select term, count(*) as df from c group by 1 having count(*) >= {R.TFIDF_MIN_DF} and count(*) <= {R.TFIDF_MAX_DF} * (select count(*) from d)
  order by sum(n) desc, term limit {R.TFIDF_MAX_FEATURES}),
w as (select job_id, term, n * (ln((1 + (select count(*) from d)) / (1 + df)) + 1) as w from c join v using (term))
select job_id, term, {r2("w / sqrt(sum(w * w) over (partition by job_id))")} as weight from w"""

register("tfidf_matrix", TFIDF_SQL)(lambda spark, sf: ml.tfidf_matrix(postings(spark, sf)))
register("svd_2d")(lambda spark, sf: ml.svd_2d(postings(spark, sf)))
register("kmeans_8")(lambda spark, sf: ml.kmeans_8(postings(spark, sf))[0])
register("kmeans_8_documents")(
    lambda spark, sf: ml.kmeans_8(fixture.table(spark, sf, "documents").withColumn(
        "doc_id", F.col("doc_id").cast("string")), text="text", key="doc_id")[0])
register("cluster_profiles")(lambda spark, sf: ml.cluster_profiles(postings(spark, sf)))
