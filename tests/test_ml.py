"""TF-IDF, SVD and k-means against dense algebra on small tables."""

import numpy as np
import pytest
from fixture_paths import SF_SMALL
from pyspark.sql import functions as F

from paygrid.operators import ml
from paygrid.plans import load_all
from paygrid.plans.catalog import postings

QUERIES, _ = load_all()


@pytest.fixture(scope="module")
def matrix(spark):
    return ml.tfidf(postings(spark, SF_SMALL), keep=["job_id"], partitions=3)


@pytest.fixture(scope="module")
def dense(matrix):
    rows = matrix.rows.collect()
    x = np.zeros((len(rows), len(matrix.vocab)))
    for k, r in enumerate(rows):
        x[k, r.idx] = r.w
    return [r.job_id for r in rows], x


def test_rows_have_unit_norm(spark, matrix, dense):
    keys, x = dense
    norm = np.linalg.norm(x, axis=1)
    assert len(keys) == matrix.n == postings(spark, SF_SMALL).where("description_md is not null").count()
    assert np.all((abs(norm - 1) < 1e-9) | (norm == 0)) and len(matrix.vocab) <= 3000 and len(set(matrix.vocab)) == len(matrix.vocab)
    assert matrix.rows.rdd.getNumPartitions() >= 1 and all(list(r.idx) == sorted(r.idx) for r in matrix.rows.take(20))


def test_terms_are_counted_in_the_row(spark):
    df = spark.createDataFrame([(1, "The red fox, red FOX and été_1"), (2, ""), (3, None), (4, "the of"), (5, "one")], "id int, t string")
    got = {r.id: r.t and [(x["first"], x.n) for x in r.t] for r in df.select("id", ml.terms_of(F.col("t")).alias("t")).collect()}
    assert got[1] == [("fox", 2), ("fox red", 1), ("fox été_1", 1), ("red", 2), ("red fox", 2), ("été_1", 1)]
    assert got[2] == [] and got[4] == [] and got[5] == [("one", 1)]


def test_svd_equals_dense(spark, matrix, dense):
    keys, x = dense
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    got = {r.job_id: (r.x, r.y, r.explained_ratio) for r in ml.svd_2d(postings(spark, SF_SMALL)).collect()}
    assert set(got) == set(keys)
    for c in range(2):
        want = u[:, c] * s[c] * np.sign(vt[c][np.abs(vt[c]).argmax()])
        assert np.allclose([got[k][c] for k in keys], want, atol=1e-5)
    ratio = np.var(u[:, :2] * s[:2], axis=0).sum() / np.var(x, axis=0).sum()
    assert all(abs(v[2] - ratio) < 1e-6 for v in got.values())


def test_kmeans_assigns_to_nearest(spark, matrix, dense):
    keys, x = dense
    best = ml.kmeans_best(matrix, restarts=4)
    label = {r.job_id: r.cluster for r in ml.assign(matrix, best.centers).collect()}
    d = ((x[:, None, :] - best.centers[None]) ** 2).sum(axis=2)
    assert [label[k] for k in keys] == d.argmin(axis=1).tolist()
    assert abs(best.cost - d.min(axis=1).sum()) < 1e-6 * best.cost and best.cost == min(c for _, c in best.costs) and len(best.costs) == 4


def test_one_pass_equals_dense(matrix, dense):
    _, x = dense
    r = np.random.default_rng(3)
    centers = r.random((3, 8, x.shape[1])) * 0.01
    sums, counts, costs = ml.one_pass(matrix, centers)
    for k in range(3):
        d = ((x[:, None, :] - centers[k][None]) ** 2).sum(axis=2)
        label = d.argmin(axis=1)
        assert counts[k].tolist() == np.bincount(label, minlength=8).tolist() and abs(costs[k] - d.min(axis=1).sum()) < 1e-6 * costs[k]
        assert all(np.allclose(sums[k, j], x[label == j].sum(axis=0)) for j in range(8))


def test_cost_is_not_above_that_of_spark(spark, matrix):
    """Ten restarts of ours against three of Spark's own k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.linalg import Vectors
    rows = [(Vectors.sparse(len(matrix.vocab), list(map(int, r.idx)), list(r.w)),) for r in matrix.rows.collect()]
    feats = spark.createDataFrame(rows, ["features"]).cache()
    theirs = min(KMeans(k=8, seed=s).fit(feats).summary.trainingCost for s in (42, 43, 44))
    assert ml.kmeans_best(matrix).cost <= theirs * 1.01


def test_profiles_and_documents(spark):
    rows = QUERIES["cluster_profiles"](spark, SF_SMALL).collect()
    n = postings(spark, SF_SMALL).where("description_md is not null").count()
    assert sum(r.n for r in rows) == n and all(0 <= r.cluster <= 7 and len(r.top_terms.split(", ")) == 8 for r in rows)
    assert all(len(r.top_depts.split(", ")) <= 9 and r.median_pay > 0 for r in rows)
    docs = QUERIES["kmeans_8_documents"](spark, SF_SMALL)
    assert docs.count() == 200 and docs.where("cluster between 0 and 7").count() == 200


def test_empty_and_wordless_texts(spark):
    none = spark.createDataFrame([], "job_id string, description_md string")
    assert ml.tfidf_matrix(none).count() == 0 and ml.svd_2d(none).count() == 0 and ml.kmeans_8(none)[0].count() == 0
    bare = spark.createDataFrame([("a", ""), ("b", "the"), ("c", None)], "job_id string, description_md string")
    assert [tuple(r)[:3] for r in ml.svd_2d(bare).orderBy("job_id").collect()] == [("a", 0.0, 0.0), ("b", 0.0, 0.0)]
    assert ml.kmeans_8(bare)[0].count() == 2
