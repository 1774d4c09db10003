"""Role gap: scope scores, comparables, pay percentile, phrase overlap.

The role-gap frame holds salaried postings with a *native* midpoint
(currencies and units are not converted, as in the analysis being rebuilt),
the 15-bucket ``department`` and the 0..10 ``scope_score``.  ``company`` is
the analysis boundary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paygrid import rules as R
from paygrid.functions import classify as C
from paygrid.functions import text as TX
from paygrid.functions.text import let, neighbour_groups
from paygrid.operators.common import magnitude, median, running_sum
from paygrid.session import cut_lineage

KEY = ["company", "department", "scope_score", "mid"]


def role_frame(p: DataFrame) -> DataFrame:
    s = p.where(F.col("salary_min").isNotNull() & F.col("salary_max").isNotNull())
    return s.select(
        "job_id", "k", "company", "title", "salary_min", "salary_max", "description_md",
        C.normalize_department("department_raw").alias("department"),
        C.scope_score("description_md").alias("scope_score"),
        ((F.col("salary_min") + F.col("salary_max")) / 2).alias("mid"))


def scope_describe(r: DataFrame) -> DataFrame:
    q = F.percentile("scope_score", [0.25, 0.5, 0.75])
    return r.agg(F.count("scope_score").alias("count"), F.avg("scope_score").alias("mean"),
                 F.stddev_samp("scope_score").alias("std"), F.min("scope_score").cast("double").alias("min"),
                 q[0].alias("p25"), q[1].alias("p50"), q[2].alias("p75"),
                 F.max("scope_score").cast("double").alias("max"))


# --------------------------------------------------------------------------
# comparables for one target
# --------------------------------------------------------------------------

def _target(r: DataFrame, job_id: str) -> DataFrame:
    return r.where(F.col("job_id") == job_id).limit(1)


def comparables(r: DataFrame, job_id: str) -> DataFrame:
    """Ladder for one target: same company and department within +-2 scope;
    fewer than 5 -> +-3; still fewer -> +-3 across departments."""
    t = _target(r, job_id).select("company", F.col("department").alias("t_dept"),
                                  F.col("scope_score").alias("t_score"))
    cand = r.join(F.broadcast(t), "company").where(F.col("job_id") != job_id)
    gap = F.abs(F.col("scope_score") - F.col("t_score"))
    same = F.col("department") == F.col("t_dept")
    d1, d2, d3 = same & (gap <= R.SCOPE_TOLERANCE), same & (gap <= R.SCOPE_TOLERANCE_WIDE), \
        gap <= R.SCOPE_TOLERANCE_WIDE
    # both tier counts in one scalar subquery (one extra pass, not two)
    tier = cand.select(
        F.when(F.count_if(d1) >= R.MIN_COMPARABLES, F.lit(1))
         .when(F.count_if(d2) >= R.MIN_COMPARABLES, F.lit(2)).otherwise(F.lit(3))).scalar()
    keep = ((tier == 1) & d1) | ((tier == 2) & d2) | ((tier == 3) & d3)
    return cand.where(keep).select("job_id", "k", "title", "department", "scope_score", "mid",
                                   "salary_min", "salary_max", "description_md", tier.alias("tier"))


def comparables_summary(r: DataFrame, job_id: str) -> DataFrame:
    comps = comparables(r, job_id)
    t = _target(r, job_id).select(F.col("mid").alias("target_mid"))
    agg = comps.agg(F.count("*").alias("n"), F.min("mid").alias("comp_min"),
                    F.max("mid").alias("comp_max"), median("mid").alias("comp_median"),
                    F.max("tier").alias("tier"))
    return _gap(agg.withColumn("target_mid", t.scalar()), "target_mid", "comp_median")


def _gap(df: DataFrame, mid: str, med: str) -> DataFrame:
    gap = F.col(mid) - F.col(med)
    pct = F.when(F.col(med) == 0, F.lit(0.0)).otherwise(F.try_divide(gap * 100.0, F.col(med)))
    return df.withColumns({"gap": gap, "gap_pct": pct,
                           "direction": F.when(gap > 0, F.lit("above")).otherwise(F.lit("below"))})


def role_groups(r: DataFrame, job_id: str) -> DataFrame:
    """Label the target's company rows target / comparable / other."""
    comps = comparables(r, job_id).select(F.col("job_id").alias("_cid"))
    t = _target(r, job_id).select("company")
    rows = r.join(F.broadcast(t), "company", "left_semi")
    return (rows.join(comps, rows["job_id"] == comps["_cid"], "left")
                .select("job_id", "scope_score", "mid",
                        F.when(F.col("job_id") == job_id, F.lit("target"))
                        .when(F.col("_cid").isNotNull(), F.lit("comparable"))
                        .otherwise(F.lit("other")).alias("grp")))


def target_plus_comparables(r: DataFrame, job_id: str) -> DataFrame:
    cols = ["job_id", "k", "title", "mid", "salary_min", "salary_max", "description_md"]
    return (comparables(r, job_id).select(*cols, F.lit(False).alias("is_target"))
            .unionByName(_target(r, job_id).select(*cols, F.lit(True).alias("is_target"))))


def range_bars(r: DataFrame, job_id: str) -> DataFrame:
    u = target_plus_comparables(r, job_id)
    return u.select("job_id", "title", "mid", F.col("salary_min").alias("start"),
                    (F.col("salary_max") - F.col("salary_min")).alias("width"), "is_target"
                    ).orderBy("mid", "job_id")


def experience_bubbles(r: DataFrame, job_id: str, min_rows: int = 3) -> DataFrame:
    u = (target_plus_comparables(r, job_id)
         .withColumn("yoe", TX.extract_yoe_first("description_md"))
         .where(F.col("yoe").isNotNull()))
    n = u.select(F.count("*")).scalar()
    return u.where(n >= min_rows).select(
        "job_id", "yoe", "mid", ((F.col("salary_max") - F.col("salary_min")) / 500.0).alias("size"),
        "is_target")


def first_seen_wins(df: DataFrame, key: str, priority: str) -> DataFrame:
    """First occurrence per key after a union, by an explicit priority."""
    w = Window.partitionBy(key).orderBy(priority)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


# --------------------------------------------------------------------------
# comparables for every posting (linear form)
# --------------------------------------------------------------------------

def _band_stats(cells: DataFrame, keys: list[str], widths: dict[str, int]):
    """For every band centre c (0..10) and key group, summarise the multiset
    of mids with scores in [c-w, c+w] for each width w of ``widths``
    (tag -> w) in one pass: counts, cumulative counts and the values at the
    order positions a leave-one-out summary needs.

    ``cells`` is (keys, scope_score, mid, cnt).  Rows are exploded to the
    centres of the widest band, tagged with their distance to the centre,
    and re-aggregated, so band tables hold distinct mids, not postings.
    """
    wmax = max(widths.values())
    centres = F.sequence(F.greatest(F.col("scope_score") - wmax, F.lit(0)),
                         F.least(F.col("scope_score") + wmax, F.lit(10)))
    ex = cells.select(*keys, "scope_score", F.explode(centres).alias("c"), "mid", "cnt")
    dist = F.abs(F.col("scope_score") - F.col("c"))
    band = ex.groupBy(*keys, "c", "mid").agg(
        *[F.sum(F.when(dist <= w, F.col("cnt")).otherwise(F.lit(0))).alias(f"cnt{t}") for t, w in widths.items()])
    w = Window.partitionBy(*keys, "c").orderBy("mid").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys, "c")
    for t in widths:
        band = band.withColumns({f"cum{t}": F.sum(f"cnt{t}").over(w), f"nn{t}": F.sum(f"cnt{t}").over(whole)})
    aggs = []
    for t in widths:
        cnt, cum, n = F.col(f"cnt{t}"), F.col(f"cum{t}"), F.col(f"nn{t}")
        prev = cum - cnt

        def at(pos, cnt=cnt, cum=cum, prev=prev):
            return F.max(F.when((cnt > 0) & (prev <= pos) & (pos < cum), F.col("mid")))

        m = F.floor((n - 2) / 2)
        aggs += [F.first(n).alias(f"n{t}"), at(F.lit(0)).alias(f"v0{t}"), at(F.lit(1)).alias(f"v1{t}"),
                 at(n - 2).alias(f"vl2{t}"), at(n - 1).alias(f"vl1{t}"), at(m).alias(f"vm0{t}"),
                 at(m + 1).alias(f"vm1{t}"), at(m + 2).alias(f"vm2{t}")]
    stats = band.groupBy(*keys, "c").agg(*aggs)
    lookup = band.select(*keys, "c", "mid", *[F.col(f"cum{t}").alias(f"le{t}") for t in widths])
    return stats, lookup


def _loo(tag: str) -> dict[str, Column]:
    """Leave-one-out summary of a band: drop one copy of the target's mid.

    With n band values W[0..n-1] sorted and r = (values <= mid) - 1 the
    position of the removed copy, the others are o[p] = W[p] if p < r else
    W[p+1]; k = n - 1 others; median = (o[(k-1)//2] + o[k//2]) / 2.
    """
    n, r = F.col(f"n{tag}"), F.col(f"le{tag}") - 1
    k = n - 1
    m = F.floor((n - 2) / 2)
    pos_vals = {"0": F.col(f"v0{tag}"), "1": F.col(f"v1{tag}"), "l2": F.col(f"vl2{tag}"),
                "l1": F.col(f"vl1{tag}"), "m0": F.col(f"vm0{tag}"), "m1": F.col(f"vm1{tag}"),
                "m2": F.col(f"vm2{tag}")}

    def o(p: Column, here: Column, nxt: Column) -> Column:
        return F.when(p < r, here).otherwise(nxt)

    lo = o(F.lit(0), pos_vals["0"], pos_vals["1"])
    hi = o(k - 1, pos_vals["l2"], pos_vals["l1"])
    a = o(m, pos_vals["m0"], pos_vals["m1"])                      # o[(k-1)//2], (k-1)//2 == m
    b_pos = F.floor(k / 2)
    b = F.when(b_pos == m, a).otherwise(o(m + 1, pos_vals["m1"], pos_vals["m2"]))
    has = k > 0
    return {"n": k, "min": F.when(has, lo), "max": F.when(has, hi),
            "median": F.when(has, (a + b) / 2)}


def comparables_all(r: DataFrame) -> DataFrame:
    """The comparables ladder with every salaried posting as the target.

    Work is linear in the rows: postings collapse to distinct
    (company, department, score, mid) cells, bands of cells are summarised
    once per (group, centre), and each distinct cell looks up its own
    leave-one-out summary.  Postings sharing a cell share a result, so the
    final join back to postings is the only row-sized step.  No pair join,
    and no window or task ever holds more than one band's distinct mids.
    """
    # both the cell table and the final join read the role frame: checkpoint
    # its narrow projection once (scope regexes are not re-run; lineage cut)
    r = cut_lineage(r.select("job_id", *KEY))
    cells = r.groupBy(*KEY).agg(F.count("*").alias("cnt"))
    cells_co = cells.groupBy("company", "scope_score", "mid").agg(F.sum("cnt").alias("cnt"))
    # tiers 1 and 2 share their keys: one band pass serves both widths
    tiers = [(["company", "department"], {"1": R.SCOPE_TOLERANCE, "2": R.SCOPE_TOLERANCE_WIDE}, cells),
             (["company"], {"3": R.SCOPE_TOLERANCE_WIDE}, cells_co)]
    out = cells.select(*KEY)
    for keys, widths, src in tiers:
        stats, lookup = _band_stats(src, keys, widths)
        look = lookup.withColumnRenamed("c", "scope_score")
        st = stats.withColumnRenamed("c", "scope_score")
        out = (out.join(look, keys + ["scope_score", "mid"], "left")
                  .join(st, keys + ["scope_score"], "left"))
    s1, s2, s3 = _loo("1"), _loo("2"), _loo("3")
    tier = (F.when(s1["n"] >= R.MIN_COMPARABLES, F.lit(1))
            .when(s2["n"] >= R.MIN_COMPARABLES, F.lit(2)).otherwise(F.lit(3)))

    def pick(field: str) -> Column:
        return F.when(tier == 1, s1[field]).when(tier == 2, s2[field]).otherwise(s3[field])

    res = out.select(*KEY, tier.alias("tier"), pick("n").cast("bigint").alias("n_comparables"),
                     pick("min").alias("comp_min"), pick("median").alias("comp_median"),
                     pick("max").alias("comp_max"))
    res = _gap(res, "mid", "comp_median")
    return r.select("job_id", *KEY).join(res, KEY, "inner")


def pay_percentile(r: DataFrame) -> DataFrame:
    """Share (x100) of the company's salaried postings paid <= each posting.

    Same shape as ``cume_dist`` over the company, but computed on distinct
    (company, mid) counts, summed up inside ranges of pay and then across
    them: no window holds a whole company.
    """
    cnt = r.groupBy("company", "mid").agg(F.count("*").alias("cnt"))
    total = cnt.groupBy("company").agg(F.sum("cnt").alias("n"))
    cum = running_sum(cnt, ["company"], "mid", "cnt", magnitude(F.col("mid")), "le").join(total, "company")
    return (r.select("job_id", "company", "mid").join(cum, ["company", "mid"])
             .select("job_id", "company", "mid", (F.col("le") / F.col("n") * 100.0).alias("percentile")))


def posting_summary(r: DataFrame, job_id: str) -> DataFrame:
    """Everything known of one posting: title, company, range, scope, the share
    of its company's salaried postings that it is paid at least as much as, and
    how its pay lies against its comparables.  No row for an unknown id or one
    without a salary; null statistics where nothing compares."""
    t = _target(r, job_id).select("job_id", "title", "company", "department", "scope_score", "salary_min", "salary_max", "mid")
    near = comparables_summary(r, job_id).select(
        F.col("n").alias("n_comparables"), "tier", "comp_min", "comp_median", "comp_max", "gap", "gap_pct", "direction")
    peers = r.join(F.broadcast(t.select("company", F.col("mid").alias("_mid"))), "company")        # one row
    share = peers.agg(F.try_divide(F.count_if(F.col("mid") <= F.col("_mid")) * 100.0, F.count("*")).alias("percentile"))
    return t.join(F.broadcast(share)).join(F.broadcast(near))


# --------------------------------------------------------------------------
# phrases
# --------------------------------------------------------------------------

def _clean_words(desc: Column) -> Column:
    cleaned = F.regexp_replace(F.lower(desc), r"(?U)[^a-z\s-]", " ")
    words = F.filter(F.split(cleaned, r"(?U)\s+"), lambda w: w != "")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(R.PHRASE_STOPWORDS))


def skill_phrases(r: DataFrame, top: int = R.PHRASE_TOP_N) -> DataFrame:
    """Per posting: adjacent word pairs (after cleaning and stop-word removal)
    seen at least twice, the 12 most frequent, ties by first position.

    Pairs are sorted, counted and ranked inside their row: no exchange."""
    def pairs(w: Column) -> Column:
        places = F.when(F.size(w) > 1, F.sequence(F.lit(0), F.size(w) - 2)).otherwise(F.array().cast("array<int>"))
        return F.sort_array(F.transform(places, lambda i: F.struct(F.concat(F.get(w, i), F.lit(" "), F.get(w, i + 1)).alias("phrase"), i.alias("pos"))))

    found = F.filter(neighbour_groups(let(_clean_words(F.col("description_md")), pairs), lambda x: x["phrase"]),
                     lambda g: g["n"] >= R.PHRASE_MIN_COUNT)
    best = F.slice(F.sort_array(F.transform(found, lambda g: F.struct(
        (-g["n"]).alias("less"), g["first"]["pos"].alias("pos"), g["first"]["phrase"].alias("phrase")))), 1, top)
    return r.where(F.col("description_md").isNotNull()).select("job_id", F.posexplode(best).alias("at", "g")).select(
        "job_id", F.col("g.phrase").alias("phrase"), (-F.col("g.less")).cast("long").alias("n"), F.col("g.pos").alias("first_pos"),
        (F.col("at") + 1).alias("rank"))


def phrase_overlap(r: DataFrame, job_id: str, roles: int = R.OVERLAP_ROLES) -> DataFrame:
    """Literal, non-overlapping counts of the target's phrases in the raw
    lower-cased text of the target and its first comparables (file order);
    phrases never seen are dropped."""
    # at most PHRASE_TOP_N phrases: carried as one small array, not joined
    phrases = skill_phrases(r.where(F.col("job_id") == job_id)).agg(
        F.collect_list("phrase")).scalar()
    t = _target(r, job_id).select("job_id", "k", "description_md", F.lit(0).alias("_p"))
    comps = comparables(r, job_id).select("job_id", "k", "description_md", F.lit(1).alias("_p"))
    cast = (t.unionByName(comps).orderBy("_p", "k").limit(roles)
             .select("job_id", F.lower(F.coalesce("description_md", F.lit("nan"))).alias("d")))
    counts = cast.select("job_id", "d", F.explode(phrases).alias("phrase")).select(
        "job_id", "phrase",
        F.try_divide(F.length("d") - F.length(F.replace("d", F.col("phrase"), F.lit(""))),
                     F.length("phrase")).cast("bigint").alias("n"))
    seen = counts.groupBy("phrase").agg(F.sum("n").alias("t")).where(F.col("t") > 0).select("phrase")
    return counts.join(seen, "phrase", "left_semi")
