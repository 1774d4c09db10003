"""Quality classifier with hierarchical empirical Bayes over sites.

Two logistic models (good quality, toxic) over word presence and text shape
give each document's evidence.  Grouped sums of the evidence over all
documents give every host and every path of a host a mean, which is shrunk:
paths toward their host and hosts toward the global mean, the more the fewer
documents they have.  The strengths come from the spread between sites
(method of moments).  A document's posterior odds are its evidence odds times
the odds of its path over the global odds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paygrid.llm.cascade import SYMBOLS, chars_in, let
from paygrid.session import release, write_out

TRAIN_ROWS = 6_000            # labelled documents fitted (those with the least hash of the id)
VOCABULARY = 4_096            # words of the model
PART_ROWS = 1_500             # fitted rows in a task: every step of a fit is a job over all of them
SITES_BROADCAST = 200_000     # sites that may be broadcast; more are joined by shuffle, salted
SALTS = 16
KEEP_AT = 0.5
SHAPE = ["f_symbols", "f_upper", "f_marks", "f_kinds", "f_chars", "f_lines", "f_short"]
OWN = ("_good", "_site", "_posterior", "_kept", "_host", "_path", "_salt", "_text", "_all", "_words", "_has", "_x", "_id", *SHAPE)
NEVER = 1e-4                  # evidence is kept this far from 0 and 1


def features(docs: DataFrame, text: Column) -> DataFrame:
    """Adds ``_words`` (distinct lower-case words) and the shape columns."""
    d = docs.withColumn("_text", F.coalesce(text, F.lit("")))
    d = d.withColumn("_all", F.filter(F.split(F.lower("_text"), "[^\\p{L}]+"), lambda w: w != ""))
    t, n = F.col("_text"), F.greatest(F.size("_all"), F.lit(1))
    letters = F.greatest(F.aggregate("_all", F.lit(0), lambda s, w: s + F.length(w)), F.lit(1))
    ratio = lambda x: F.least(x.cast("double"), F.lit(10.0))
    d = d.withColumn("_words", F.array_distinct("_all"))
    return d.withColumns({
        "f_symbols": ratio(chars_in(t, SYMBOLS) / n),
        "f_upper": ratio((F.length(t) - F.length(F.regexp_replace(t, "\\p{Lu}+", ""))) / letters),
        "f_marks": ratio(chars_in(t, "!?") / n),
        "f_kinds": ratio(F.size("_words") / F.sqrt(n.cast("double"))),
        "f_chars": ratio(letters / n),
        "f_lines": let(F.split(t, "\n"), lambda a: ratio(1 - F.size(F.array_distinct(a)) / F.size(a))),
        "f_short": F.exp(-n / 20.0),
    })


@dataclass
class Classifier:
    """Fitted models; ``None`` where the labels had one class only, with its rate."""
    shape: PipelineModel | None
    models: dict[str, object]
    rates: dict[str, float]

    def evidence(self, docs: DataFrame, text: Column) -> DataFrame:
        """Adds ``_good``: probability of good quality and not toxic."""
        if self.shape is None:
            return docs.withColumn("_good", F.lit(0.5))
        names = docs.columns
        d = self.shape.transform(features(docs, text))
        p = {}
        for k, model in self.models.items():
            if model is None:
                p[k] = F.lit(self.rates[k])
                continue
            d = model.transform(d)
            p[k] = vector_to_array(F.col(f"_p_{k}"))[1]
        good = F.least(F.greatest(p["quality"] * (1 - p["toxic"]), F.lit(NEVER)), F.lit(1 - NEVER))
        return d.select(*[F.col(f"`{c}`") for c in names], good.alias("_good"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int = TRAIN_ROWS) -> Classifier:
    """Fit on a bounded sample of labelled rows: ``rows`` ids by hash."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(
        F.min("quality").cast("double").alias("_l_quality"), F.coalesce(F.max("toxic"), F.lit(0)).cast("double").alias("_l_toxic"))
    some = write_out(marks.orderBy(F.xxhash64("_id"), "_id").limit(rows), "labelled")       # at most `rows` rows of 24 bytes
    got = write_out(docs.join(F.broadcast(some), F.col(f"`{id_col}`") == F.col("_id")).select(
        F.col(f"`{text_col}`").alias("_t"), "_l_quality", "_l_toxic"), "training")
    n, *ones = got.agg(F.count("*"), F.sum("_l_quality"), F.sum("_l_toxic")).first()
    if not n:
        return Classifier(None, {}, {})
    train = features(got, F.col("_t"))
    shape = Pipeline(stages=[
        CountVectorizer(inputCol="_words", outputCol="_has", vocabSize=VOCABULARY, minDF=min(3.0, float(n)), binary=True),
        VectorAssembler(inputCols=["_has", *SHAPE], outputCol="_x")]).fit(train)
    # Each of the hundred jobs of a fit carries its plan and schema along: they read vectors from a written table, whose
    # schema has the vectors' size in place of a name for every word.
    x = F.col("_x").alias("_x", metadata={"ml_attr": {"num_attrs": len(shape.stages[0].vocabulary) + len(SHAPE)}})
    ready = write_out(shape.transform(train).select(x, "_l_quality", "_l_toxic").coalesce(-(-n // PART_ROWS)), "vectors")
    models, rates = {}, {}
    for k, one in zip(("quality", "toxic"), ones, strict=True):
        rates[k] = (one + 1) / (n + 2)
        models[k] = LogisticRegression(
            featuresCol="_x", labelCol=f"_l_{k}", probabilityCol=f"_p_{k}", rawPredictionCol=f"_r_{k}", predictionCol=f"_c_{k}",
            maxIter=60, regParam=0.002, elasticNetParam=0.5, aggregationDepth=2).fit(ready) if 0 < one < n else None
        release(docs.sparkSession)
    return Classifier(shape, models, rates)


def _odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def constants(row: DataFrame) -> dict[str, Column]:
    """The columns of a table of one row as literals."""
    values = row.first()
    return {f.name: F.lit(values[f.name]).cast(f.dataType) for f in row.schema}


def site_posteriors(scored: DataFrame) -> DataFrame:
    """``(_host, _path, _site)`` from ``(_host, _path, _good)``: log odds of
    the path's shrunk mean over those of the global mean."""
    sites = write_out(scored.groupBy("_host", "_path").agg(F.count("*").alias("n"), F.sum("_good").alias("s")), "sites")
    hosts = write_out(sites.groupBy("_host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.count("*").alias("paths")), "hosts")
    whole = hosts.agg(F.sum("hn").alias("gn"), F.sum("hs").alias("gs"), F.count("*").alias("hosts"),
                      F.sum(F.col("hs") * F.col("hs") / F.col("hn")).alias("sq"))
    mu = F.col("gs") / F.col("gn")
    within = mu * (1 - mu)

    def strength(spread: Column, groups: Column) -> Column:
        """Prior count of a beta law whose means vary by ``spread`` between groups."""
        between = F.greatest((spread - (groups - 1) * within) / F.col("gn"), within * 1e-4)
        return F.least(F.greatest(within / between - 1, F.lit(2.0)), F.lit(10_000.0))

    g = constants(whole.withColumn("hk", strength(F.col("sq") - F.col("gn") * mu * mu, F.col("hosts"))))
    h = hosts.withColumns(g).withColumn("hm", (F.col("hs") + F.col("hk") * mu) / (F.col("hn") + F.col("hk")))
    p = sites.join(h, "_host")
    k = constants(p.agg(F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("hs") / F.col("hn"), 2)).alias("psq"), F.count("*").alias("sites")))
    p = p.withColumns(k).withColumn("pk", strength(F.col("psq"), F.col("sites") - F.col("hosts") + 1))
    mean = (F.col("s") + F.col("pk") * F.col("hm")) / (F.col("n") + F.col("pk"))
    return write_out(p.select("_host", "_path", (_odds(mean) - _odds(mu)).alias("_site")), "site-posteriors")


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text",
             keep_at: float = KEEP_AT, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """All rows and columns of ``docs`` plus ``_good`` (evidence), ``_site``
    (log odds of the site), ``_posterior`` and ``_kept``.

    Columns of ``docs`` that have these names, or those of the features, are
    replaced.  Null host, path or text count as empty; repeated rows and null ids are
    judged like any other; without labels every row is kept; an empty table
    gives no rows.  Evidence is computed once for the sums and once for the
    verdict, so that no document is moved; sites are broadcast while they are
    few and joined by shuffle, salted for large sites, beyond that.
    """
    docs = docs.drop(*OWN)
    model = fit(docs, labels, id_col, text_col, train_rows)
    if model.shape is None:
        return docs.withColumns({"_good": F.lit(1.0), "_site": F.lit(0.0), "_posterior": F.lit(1.0), "_kept": F.lit(True)})
    named = docs.withColumns({"_host": F.coalesce(host.cast("string"), F.lit("")), "_path": F.coalesce(path.cast("string"), F.lit(""))})
    scored = model.evidence(named, F.col(f"`{text_col}`"))
    sites = site_posteriors(scored.select("_host", "_path", "_good"))
    if sites.count() <= SITES_BROADCAST:
        joined = scored.join(F.broadcast(sites), ["_host", "_path"], "left")
    else:
        many = sites.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = scored.withColumn("_salt", F.pmod(F.xxhash64(F.col(f"`{text_col}`"), F.col(f"`{id_col}`")), F.lit(SALTS)).cast("int")).join(
            many, ["_host", "_path", "_salt"], "left")
    posterior = 1 / (1 + F.exp(-(_odds(F.col("_good")) + F.col("_site"))))
    return joined.withColumn("_posterior", posterior).select(
        *[F.col(f"`{c}`") for c in docs.columns], "_good", "_site", "_posterior", (F.col("_posterior") >= keep_at).alias("_kept"))
