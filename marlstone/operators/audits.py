"""Audits of an evaluation: each returns (probe, observed, bound, passed)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from marlstone.operators.belief import LIK, POST, SEQ, evidence, likelihoods, log_likelihood, posterior_rows, priors, sequence_rows, softmax
from marlstone.operators.ordering import shuffled
from marlstone.operators.scoring import brier, r6, weight
from marlstone.plans.config import DEFAULT
from marlstone.plans.registry import query

HELD_OUT = (3, 4)
_W = DEFAULT.weight_sql("1 + truth % 4")


def _scored(p: DataFrame) -> DataFrame:
    """(key, truth, s): severity-weighted score of (key, truth, label, p)."""
    b = p.groupBy("key", "truth").agg(brier(F.col("p"), F.col("label") == F.col("truth")).alias("b"))
    return b.select("key", "truth", (F.col("b") * weight(1 + F.col("truth") % 4)).alias("s"))


def _probe(df: DataFrame, name: str, observed, bound, passed) -> DataFrame:
    return df.agg(observed.alias("o"), bound.alias("b")).select(F.lit(name).alias("probe"), r6("o").alias("observed"), r6("b").alias("bound"), passed(F.col("o"), F.col("b")).alias("passed"))


_SC = f"sc AS (SELECT key, truth, (0.9 - (sum(p * p) - 2 * max(CASE WHEN label = truth THEN p ELSE 0 END) + 1)) * max({_W}) AS s FROM post GROUP BY 1, 2)"
_BLANK = f"bl AS (SELECT ev.key, ev.truth, (0.9 - ((SELECT sum(prior * prior) FROM pri) - 2 * prior + 1)) * {_W} AS s FROM ev JOIN pri ON pri.label = ev.truth WHERE dim = 0)"


def _blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of reporting the prior."""
    return _scored(sequence_rows(spark, sf_dir).where("k = 0"))


@query(f"WITH {LIK}, {_BLANK} SELECT 'blank_floor' AS probe, round(avg(s), 6) AS observed, round((SELECT sum(prior * (0.9 - (s2 - 2 * prior + 1)) * {DEFAULT.weight_sql('1 + label % 4')}) FROM pri, (SELECT sum(prior * prior) AS s2 FROM pri)), 6) AS bound, abs(avg(s) - (SELECT sum(prior * (0.9 - (s2 - 2 * prior + 1)) * {DEFAULT.weight_sql('1 + label % 4')}) FROM pri, (SELECT sum(prior * prior) AS s2 FROM pri))) < 0.15 AS passed FROM bl")
def audit_blank_floor(spark, sf_dir):
    """The floor of a report without evidence against its analytic value."""
    p = priors(evidence(spark, sf_dir))
    s2 = F.sum(F.col("prior") ** 2).over(W.partitionBy())  # one row a label
    analytic = p.withColumn("x", F.col("prior") * (0.9 - (s2 - 2 * F.col("prior") + 1)) * weight(1 + F.col("label") % 4)).agg(F.sum("x").alias("b"))
    seen = _blank(spark, sf_dir).agg(F.avg("s").alias("o"))
    return seen.join(F.broadcast(analytic), F.lit(True)).select(F.lit("blank_floor").alias("probe"), r6("o").alias("observed"), r6("b").alias("bound"), (F.abs(F.col("o") - F.col("b")) < 0.15).alias("passed"))


@query(f"WITH {POST}, {_SC}, {_BLANK} SELECT 'no_test_ablation' AS probe, round((SELECT avg(s) FROM sc) - (SELECT avg(s) FROM bl), 6) AS observed, 0.2 AS bound, (SELECT avg(s) FROM sc) - (SELECT avg(s) FROM bl) > 0.2 AS passed")
def audit_no_tests(spark, sf_dir):
    """Evidence must be worth something: full reports against blank ones."""
    full = _scored(posterior_rows(spark, sf_dir))
    both = full.withColumn("x", F.lit(1)).unionByName(_blank(spark, sf_dir).withColumn("x", F.lit(0)))
    gap = F.avg(F.when(F.col("x") == 1, F.col("s"))) - F.avg(F.when(F.col("x") == 0, F.col("s")))
    return _probe(both, "no_test_ablation", gap, F.lit(0.2), lambda o, b: o > b)


_PERM = """sh AS (SELECT key, truth, row_number() OVER (ORDER BY md5('order:' || key), key) AS i, row_number() OVER (ORDER BY md5('shuffle:' || key), key) AS j FROM (SELECT DISTINCT key, truth FROM post)),
pm AS (SELECT a.key, b.truth AS other FROM sh a JOIN sh b ON a.i = b.j)"""


@query(f"WITH {POST}, {_SC}, {_PERM}, ss AS (SELECT post.key, (0.9 - (sum(p * p) - 2 * max(CASE WHEN label = other THEN p ELSE 0 END) + 1)) * max({DEFAULT.weight_sql('1 + other % 4')}) AS s FROM post JOIN pm USING (key) GROUP BY 1) SELECT 'shuffled_labels' AS probe, round((SELECT avg(s) FROM ss), 6) AS observed, round((SELECT avg(s) FROM sc), 6) AS bound, (SELECT avg(s) FROM ss) < 0.1 AND (SELECT avg(s) FROM sc) - (SELECT avg(s) FROM ss) > 0.5 AS passed")
def audit_shuffled(spark, sf_dir):
    """Truths dealt to other records must not score."""
    p = posterior_rows(spark, sf_dir)
    t = p.select("key", "truth").distinct()
    # two orders of the evaluation set, joined on their places
    order = lambda seed: shuffled(t, F.md5(F.concat(F.lit(seed), F.col("key").cast("string"))), "key")
    i, j = order("order:").select("key", "place"), order("shuffle:").select(F.col("truth").alias("other"), "place")
    s = _scored(p.drop("truth").join(i.join(j, "place").select("key", F.col("other").alias("truth")), "key"))
    both = s.withColumn("x", F.lit(0)).unionByName(_scored(p).withColumn("x", F.lit(1)))
    mean = lambda x: F.avg(F.when(F.col("x") == x, F.col("s")))
    return _probe(both, "shuffled_labels", mean(0), mean(1), lambda o, b: (o < 0.1) & (b - o > 0.5))


@query(f"""WITH {POST}, ph AS (SELECT dim, quantile_cont(mean, 0.98) AS x FROM lik WHERE dim = 0 GROUP BY 1),
dl AS (SELECT label, -0.5 * ((x - mean) / sd) ** 2 - ln(sd) AS l0 FROM lik JOIN ph USING (dim)), tl AS (SELECT label FROM (SELECT *, row_number() OVER (ORDER BY round(l0, 9) DESC, label) AS r FROM dl) WHERE r <= 3),
p2 AS (SELECT ll.key, ll.label, ll.ll - (-0.5 * ((value - mean) / sd) ** 2 - ln(sd)) + l0 + ln(prior) AS lp FROM ll JOIN ev ON ev.key = ll.key AND ev.dim = 0 JOIN lik ON lik.dim = 0 AND lik.label = ll.label JOIN dl ON dl.label = ll.label JOIN pri ON pri.label = ll.label),
e2 AS (SELECT *, exp(lp - max(lp) OVER (PARTITION BY key)) AS e FROM p2), q2 AS (SELECT key, sum(e) FILTER (label IN (SELECT label FROM tl)) / sum(e) AS m FROM e2 GROUP BY 1), q1 AS (SELECT key, sum(p) FILTER (label IN (SELECT label FROM tl)) AS m FROM post GROUP BY 1)
SELECT 'counterfactual' AS probe, round(avg((q2.m > q1.m)::INT), 6) AS observed, 0.99 AS bound, avg((q2.m > q1.m)::INT) > 0.99 AS passed FROM q1 JOIN q2 USING (key)""")
def audit_counterfactual(spark, sf_dir):
    """One value moved to the 98th percentile of the label means must raise the
    mass of the labels it favours."""
    ev = evidence(spark, sf_dir)
    lik, first = likelihoods(ev), F.col("dim") == 0
    to = lik.where(first).agg(F.percentile("mean", 0.98).alias("x"))
    moved = ev.join(F.broadcast(to), F.lit(True)).withColumn("value", F.when(first, F.col("x")).otherwise(F.col("value"))).drop("x")
    fav = lik.where(first).join(F.broadcast(to), F.lit(True)).withColumn("l", F.round(log_likelihood(F.col("x")), 9)).orderBy(F.desc("l"), "label").limit(3).select("label")
    both = ev.withColumn("w", F.lit(0)).unionByName(moved.withColumn("w", F.lit(1)))
    ll = both.join(F.broadcast(lik), "dim").groupBy("w", "key", "label").agg(F.sum(log_likelihood(F.col("value"))).alias("ll"))
    p = softmax(ll.join(F.broadcast(priors(ev)), "label").withColumn("lp", F.col("ll") + F.ln("prior")), ["w", "key"])
    m = p.join(F.broadcast(fav), "label").groupBy("key").agg(F.sum(F.when(F.col("w") == 1, F.col("p"))).alias("after"), F.sum(F.when(F.col("w") == 0, F.col("p"))).alias("before"))
    return _probe(m, "counterfactual", F.avg((F.col("after") > F.col("before")).cast("int")), F.lit(0.99), lambda o, b: o > b)


@query(f"WITH {POST}, {_SC} SELECT 'ceiling' AS probe, round(max(s), 6) AS observed, 5.4 AS bound, max(s) <= 5.4 + 1e-6 AS passed FROM sc")
def audit_ceiling(spark, sf_dir):
    return _probe(_scored(posterior_rows(spark, sf_dir)), "ceiling", F.max("s"), F.lit(0.9 * DEFAULT.weight_4), lambda o, b: o <= b + 1e-6)


@query(f"WITH {POST}, {_SC} SELECT 'held_out_gap' AS probe, round(avg(s) FILTER (truth % 5 NOT IN {HELD_OUT}) - avg(s) FILTER (truth % 5 IN {HELD_OUT}), 6) AS observed, 0.0 AS bound, true AS passed FROM sc")
def audit_held_out(spark, sf_dir):
    """Seen less held-out systems: reported, never gated."""
    held = (F.col("truth") % 5).isin(*HELD_OUT)
    gap = F.avg(F.when(~held, F.col("s"))) - F.avg(F.when(held, F.col("s")))
    return _probe(_scored(posterior_rows(spark, sf_dir)), "held_out_gap", gap, F.lit(0.0), lambda o, b: F.lit(True))


@query(f"WITH {LIK}, s AS (SELECT key, string_agg(dim, ',' ORDER BY dim) AS d FROM ev GROUP BY 1) SELECT 'presence' AS probe, count(DISTINCT d)::DOUBLE AS observed, 1.0 AS bound, count(DISTINCT d) = 1 AS passed FROM s")
def audit_presence(spark, sf_dir):
    """Every record must have the same observations: a gap would tell a label."""
    s = evidence(spark, sf_dir).groupBy("key").agg(F.array_join(F.sort_array(F.collect_set("dim")), ",").alias("d"))
    return _probe(s, "presence", F.count_distinct("d").cast("double"), F.lit(1.0), lambda o, b: o == b)


@query("WITH r AS (SELECT count(*) FILTER (event_type = 'purchase') AS raw, count(*) FILTER (event_type = 'purchase' AND event_type NOT IN ('purchase', 'error')) AS kept FROM events) SELECT 'leakage' AS probe, kept::DOUBLE AS observed, raw::DOUBLE AS bound, kept = 0 AND raw > 1 AS passed FROM r")
def audit_leakage(spark, sf_dir):
    """No event of a blocked type survives the filter; the control (the same
    count with the filter off) must find some, or the probe shows nothing."""
    from marlstone.sources.resources import BLOCKED, allowed_resources
    from marlstone.sources.views import table

    blocked = table(spark, sf_dir, "events").where(F.col("event_type").isin(*BLOCKED)).select("event_id")
    kept = allowed_resources(spark, sf_dir).select("event_id", F.lit(1).alias("kept"))
    j = blocked.join(kept, "event_id", "left")
    return _probe(j, "leakage", F.count("kept").cast("double"), F.count(F.lit(1)).cast("double"), lambda o, b: (o == 0) & (b > 1))


SPOTS = 6


@query(f"""WITH {POST}, ph AS (SELECT dim, quantile_cont(mean, 0.98) AS x FROM lik WHERE dim < {SPOTS} GROUP BY 1), dl AS (SELECT dim, label, -0.5 * ((x - mean) / sd) ** 2 - ln(sd) AS l0 FROM lik JOIN ph USING (dim)),
fv AS (SELECT dim, first(label ORDER BY round(l0, 9) DESC, label) AS fav FROM dl GROUP BY 1),
p2 AS (SELECT ll.key, dl.dim, ll.label, ll.ll - (-0.5 * ((value - mean) / sd) ** 2 - ln(sd)) + l0 + ln(prior) AS lp FROM ll JOIN dl ON dl.label = ll.label JOIN ev ON ev.key = ll.key AND ev.dim = dl.dim JOIN lik ON lik.dim = dl.dim AND lik.label = ll.label JOIN pri ON pri.label = ll.label),
e2 AS (SELECT *, exp(lp - max(lp) OVER (PARTITION BY key, dim)) AS e FROM p2), q2 AS (SELECT key, dim, max(CASE WHEN label = fav THEN e END) / sum(e) AS m FROM e2 JOIN fv USING (dim) GROUP BY 1, 2)
SELECT dim, fav, round(avg((q2.m > post.p)::INT), 6) AS rate FROM q2 JOIN fv USING (dim) JOIN post ON post.key = q2.key AND post.label = fav GROUP BY 1, 2""")
def audit_spot_checks(spark, sf_dir):
    """(dim, fav, rate): of each of the first tests, how often moving its value
    to the 98th percentile of the label means raises the label it favours."""
    ev = evidence(spark, sf_dir)
    lik = likelihoods(ev)
    some = lik.where(F.col("dim") < SPOTS)
    moved = some.join(some.groupBy("dim").agg(F.percentile("mean", 0.98).alias("x")), "dim").withColumn("l0", log_likelihood(F.col("x")))
    fav = moved.groupBy("dim").agg(F.min_by("label", F.struct(-F.round("l0", 9), F.col("label"))).alias("fav"))
    p = posterior_rows(spark, sf_dir).select("key", "label", "p")
    own = ev.where(F.col("dim") < SPOTS).join(F.broadcast(moved), "dim").select("key", "dim", "label", (F.col("l0") - log_likelihood(F.col("value"))).alias("change"))
    # the old belief times the change of one likelihood, normalised again
    w = own.join(p, ["key", "label"]).withColumn("w", F.ln(F.greatest("p", F.lit(1e-300))) + F.col("change"))
    after = softmax(w, ["key", "dim"], "w").select("key", "dim", "label", F.col("p").alias("after"))
    j = after.join(F.broadcast(fav), "dim").where("label = fav").join(p, ["key", "label"])
    return j.groupBy("dim", "fav").agg(r6(F.avg((F.col("after") > F.col("p")).cast("int"))).alias("rate"))


_SUITE = (audit_blank_floor, audit_no_tests, audit_shuffled, audit_counterfactual, audit_ceiling, audit_held_out, audit_presence, audit_leakage)


@query()
def audit_suite(spark, sf_dir):
    """All probes, with the overall verdict."""
    rows = reduce(DataFrame.unionByName, [f(spark, sf_dir) for f in _SUITE])
    return rows.withColumn("all_passed", F.bool_and("passed").over(W.partitionBy()))  # one row a probe
