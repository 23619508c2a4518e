"""Categorical evidence: likelihood tables with baseline, overrides and
smoothing, posteriors, exact expected entropies, and buckets by reference range.

A categorical observation is one row (key, dim, value).  Its likelihood table
has a row for every (dim, label, value); the table is complete by construction
and its completeness is checked, so a value that it lacks is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from marlstone.operators.belief import LIK, SEQ, evidence, likelihoods, log_likelihood, partial_rows, priors, softmax
from marlstone.operators.scoring import r6
from marlstone.plans.registry import query
from marlstone.sources.views import ctes, view

#: Fixed values.
EPS = 1e-4
VALUES = ("high", "low", "mid")
CUT = 0.5
#: Components that are read as categories; the others are numbers.
CATEGORICAL = (8, 9, 10, 11)


def category(value: Column) -> Column:
    return F.when(value < -CUT, "low").when(value > CUT, "high").otherwise("mid")


def categorical_evidence(ev: DataFrame) -> DataFrame:
    """(key, truth, dim, value) of the components that are categories."""
    return ev.where(F.col("dim").isin(*CATEGORICAL)).select("key", "truth", "dim", category(F.col("value")).alias("value"))


def smoothed(p: Column, k: Column, eps: float = EPS) -> Column:
    return (1 - eps) * p + eps / k


def baseline(ev: DataFrame) -> DataFrame:
    """(dim, value, p): how often each value occurs, whatever the label."""
    n = ev.groupBy("dim", "value").agg(F.count(F.lit(1)).alias("n"))
    return n.select("dim", "value", (F.col("n") / F.sum("n").over(W.partitionBy("dim"))).alias("p"))  # one row a value


def overrides(ev: DataFrame) -> DataFrame:
    """(dim, label, value, p) of the labels that have a table of their own."""
    n = ev.where("truth % 2 = 0").groupBy("dim", F.col("truth").alias("label"), "value").agg(F.count(F.lit(1)).alias("n"))
    return n.select("dim", "label", "value", (F.col("n") / F.sum("n").over(W.partitionBy("dim", "label"))).alias("p"))


def likelihood_table(dims: DataFrame, labels: DataFrame, values: DataFrame, base: DataFrame, own: DataFrame, eps: float = EPS) -> DataFrame:
    """(dim, label, value, p) of every combination: a label's own table where it
    has one (a value that it does not name has none of its mass), else the
    baseline, smoothed.  All inputs are dimensions."""
    full = dims.join(F.broadcast(labels), F.lit(True)).join(F.broadcast(values), F.lit(True))
    has = own.select("dim", "label").distinct().withColumn("has", F.lit(True))
    j = full.join(F.broadcast(has), ["dim", "label"], "left").join(F.broadcast(own.withColumnRenamed("p", "o")), ["dim", "label", "value"], "left").join(F.broadcast(base.withColumnRenamed("p", "b")), ["dim", "value"], "left")
    p = F.when(F.col("has"), F.coalesce("o", F.lit(0.0))).otherwise(F.coalesce("b", F.lit(0.0)))
    k = F.count(F.lit(1)).over(W.partitionBy("dim", "label"))
    return j.select("dim", "label", "value", smoothed(p, k, eps).alias("p"))


def categorical_likelihoods(ev: DataFrame) -> DataFrame:
    c = categorical_evidence(ev)
    spark = ev.sparkSession
    values = spark.createDataFrame([(v,) for v in VALUES], "value string")
    return likelihood_table(c.select("dim").distinct(), c.select(F.col("truth").alias("label")).distinct(), values, baseline(c), overrides(c))


def looked_up(c: DataFrame, lik: DataFrame) -> DataFrame:
    """``c`` (key, dim, value) with each label's likelihood; a value that the
    table lacks is an error."""
    per = lik.groupBy("dim", "value").agg(F.collect_list(F.struct("label", "p")).alias("l"))
    j = c.join(F.broadcast(per), ["dim", "value"], "left")
    l = F.when(F.col("l").isNull(), F.raise_error(F.concat(F.lit("unknown value "), F.coalesce("value", F.lit("null"))))).otherwise(F.col("l"))  # noqa: E741
    return j.select("key", "truth", "dim", "value", F.inline(l)).withColumn("ll", F.ln("p"))


def categorical_posteriors(ev: DataFrame) -> DataFrame:
    """(key, truth, label, p) from numbers and categories together."""
    c = looked_up(categorical_evidence(ev), categorical_likelihoods(ev)).select("key", "truth", "label", "ll")
    numeric = ev.where(~F.col("dim").isin(*CATEGORICAL))
    n = numeric.join(F.broadcast(likelihoods(numeric)), "dim").select("key", "truth", "label", log_likelihood(F.col("value")).alias("ll"))
    lp = c.unionByName(n).groupBy("key", "truth", "label").agg(F.sum("ll").alias("ll"))
    lp = lp.join(F.broadcast(priors(ev)), "label").withColumn("lp", F.col("ll") + F.ln("prior"))
    return softmax(lp, ["key"]).select("key", "truth", "label", "p")


_CATS = ", ".join(map(str, CATEGORICAL))
CAT = f"""{LIK},
ce AS (SELECT key, truth, dim, CASE WHEN value < -{CUT} THEN 'low' WHEN value > {CUT} THEN 'high' ELSE 'mid' END AS value FROM ev WHERE dim IN ({_CATS})),
cb AS (SELECT dim, value, count(*) * 1.0e0 / sum(count(*)) OVER (PARTITION BY dim) AS p FROM ce GROUP BY 1, 2),
co AS (SELECT dim, truth AS label, value, count(*) * 1.0e0 / sum(count(*)) OVER (PARTITION BY dim, truth) AS p FROM ce WHERE truth % 2 = 0 GROUP BY 1, 2, 3),
cl AS (SELECT d.dim, l.label, v.value, (1 - {EPS}) * CASE WHEN l.label % 2 = 0 THEN coalesce(co.p, 0) ELSE coalesce(cb.p, 0) END + {EPS} / 3 AS p
 FROM (SELECT DISTINCT dim FROM ce) d, (SELECT DISTINCT truth AS label FROM ce) l, (SELECT unnest({list(VALUES)}) AS value) v
 LEFT JOIN co ON co.dim = d.dim AND co.label = l.label AND co.value = v.value LEFT JOIN cb ON cb.dim = d.dim AND cb.value = v.value)"""


@query(f"WITH {CAT} SELECT dim, label, value, round(p, 9) AS p FROM cl")
def cat_likelihood(spark, sf_dir):
    return categorical_likelihoods(evidence(spark, sf_dir)).select("dim", "label", "value", F.round("p", 9).alias("p"))


@query(f"WITH {CAT} SELECT count(DISTINCT dim) AS dims, count(DISTINCT label) AS labels, count(*) AS rows, count(DISTINCT dim) * count(DISTINCT label) * 3 AS expected, (SELECT count(*) FROM (SELECT sum(p) AS s FROM cl GROUP BY dim, label) WHERE abs(s - 1) > 1e-9)::BIGINT AS unnormalised FROM cl")
def cat_complete(spark, sf_dir):
    """Whether the table has every combination and each label's row sums to 1."""
    lik = categorical_likelihoods(evidence(spark, sf_dir))
    per = lik.groupBy("dim", "label").agg(F.sum("p").alias("s"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.count_distinct("dim").alias("dims"), F.count_distinct("label").alias("labels"), F.sum("n").alias("rows"), (F.count_distinct("dim") * F.count_distinct("label") * len(VALUES)).alias("expected"), F.count_if(F.abs(F.col("s") - 1) > 1e-9).alias("unnormalised"))


@query(f"""WITH {CAT}, nl AS (SELECT key, ev.truth, label, -0.5 * ((value - mean) / sd) ** 2 - ln(sd) - 0.5 * ln(2 * pi()) AS ll FROM ev JOIN lik USING (dim) WHERE dim NOT IN ({_CATS})),
al AS (SELECT key, truth, label, sum(ll) AS ll FROM (SELECT key, truth, label, ll FROM nl UNION ALL SELECT key, truth, label, ln(p) FROM ce JOIN cl USING (dim, value)) GROUP BY 1, 2, 3),
cp AS (SELECT key, label, ll + ln(prior) AS lp FROM al JOIN pri USING (label)), cx AS (SELECT *, exp(greatest(lp - max(lp) OVER (PARTITION BY key), -700)) AS e FROM cp)
SELECT key, label, round(e / sum(e) OVER (PARTITION BY key), 6) AS p FROM cx""")
def cat_posterior(spark, sf_dir):
    """Beliefs from numbers and categories."""
    return categorical_posteriors(evidence(spark, sf_dir)).select("key", "label", r6("p").alias("p"))


def exact_entropies(belief: DataFrame, lik: DataFrame) -> DataFrame:
    """(key, dim, eig): expected entropy of a belief (key, label, p) after a
    categorical observation, exactly: over the values, weighted by how likely
    each is."""
    j = belief.select("key", "label", F.col("p").alias("b")).join(F.broadcast(lik), "label").withColumn("w", F.col("b") * F.col("p"))
    per = j.groupBy("key", "dim", "value").agg(F.sum("w").alias("s"), F.sum(F.when(F.col("w") > 0, F.col("w") * F.ln("w")).otherwise(0.0)).alias("wl"))
    return per.groupBy("key", "dim").agg(F.sum(F.when(F.col("s") > 0, F.col("s") * F.ln("s") - F.col("wl")).otherwise(0.0)).alias("eig"))


@query(f"{'WITH ' + SEQ}, {CAT.split(LIK + ',')[1].strip()}, bl AS (SELECT key, label, p AS b FROM seq WHERE k = 4), cw AS (SELECT key, dim, value, sum(b * p) AS s, sum(CASE WHEN b * p > 0 THEN b * p * ln(b * p) ELSE 0 END) AS wl FROM bl JOIN cl USING (label) GROUP BY 1, 2, 3) SELECT key, dim, round(sum(CASE WHEN s > 0 THEN s * ln(s) - wl ELSE 0 END), 6) AS eig FROM cw GROUP BY 1, 2")
def cat_eig(spark, sf_dir):
    ev = evidence(spark, sf_dir)
    return exact_entropies(partial_rows(spark, sf_dir), categorical_likelihoods(ev)).select("key", "dim", r6("eig").alias("eig"))


@query(f"WITH {CAT} SELECT dim, value AS bucket, round(sum(prior * p), 6) AS prior FROM cl JOIN pri USING (label) GROUP BY 1, 2")
def cat_bucket_prior(spark, sf_dir):
    """How likely each category is before anything is seen."""
    ev = evidence(spark, sf_dir)
    j = categorical_likelihoods(ev).join(F.broadcast(priors(ev)), "label")
    return j.groupBy("dim", F.col("value").alias("bucket")).agg(r6(F.sum(F.col("prior") * F.col("p"))).alias("prior"))


def reference_ranges(ev: DataFrame) -> DataFrame:
    """(dim, low, high): each number's own reference range."""
    return ev.groupBy("dim").agg(F.round(F.avg("value") - F.stddev_pop("value"), 6).alias("low"), F.round(F.avg("value") + F.stddev_pop("value"), 6).alias("high"))


@query(f"WITH {LIK}, rr AS (SELECT dim, round(avg(value) - stddev_pop(value), 6) AS low, round(avg(value) + stddev_pop(value), 6) AS high FROM ev WHERE dim NOT IN ({_CATS}) GROUP BY 1), b AS (SELECT dim, CASE WHEN value < low THEN 'low' WHEN value > high THEN 'high' ELSE 'normal' END AS bucket FROM ev JOIN rr USING (dim) UNION ALL SELECT dim, CASE WHEN value < -{CUT} THEN 'low' WHEN value > {CUT} THEN 'high' ELSE 'mid' END FROM ev WHERE dim IN ({_CATS})) SELECT dim, bucket, count(*) AS n FROM b GROUP BY 1, 2")
def dim_buckets(spark, sf_dir):
    """Values by their own reference range; categories are their own bucket."""
    ev = evidence(spark, sf_dir)
    numbers = ev.where(~F.col("dim").isin(*CATEGORICAL))
    v = F.col("value")
    b = numbers.join(F.broadcast(reference_ranges(numbers)), "dim").select("dim", F.when(v < F.col("low"), "low").when(v > F.col("high"), "high").otherwise("normal").alias("bucket"))
    c = categorical_evidence(ev).select("dim", F.col("value").alias("bucket"))
    return b.unionByName(c).groupBy("dim", "bucket").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ctes('charged', 'episode')}, br AS (SELECT 't' || t AS test_key, p AS pos, (t * (p + 2) + p) % 64 AS analyte FROM (SELECT unnest(range(73)) AS t), (SELECT unnest(range(3)) AS p)) SELECT episode_id, turn, string_agg(analyte, ',' ORDER BY pos) AS revealed FROM charged JOIN episode USING (episode_id) JOIN br USING (test_key) WHERE cost_charged > 0 AND analyte % 5 <> patient_id % 5 GROUP BY 1, 2")
def revealed(spark, sf_dir):
    """What each charged test reveals, in the order of its list; what a record
    does not have is left out."""
    tests = view(spark, sf_dir, "charged").select("test_key").distinct().withColumn("t", F.substring("test_key", 2, 9).cast("int"))
    bridge = tests.select("test_key", F.posexplode(F.array(*[(F.col("t") * (p + 2) + p) % 64 for p in range(3)])).alias("pos", "analyte"))
    s = view(spark, sf_dir, "charged").where("cost_charged > 0").join(F.broadcast(bridge), "test_key").join(view(spark, sf_dir, "episode").select("episode_id", "patient_id"), "episode_id")
    there = s.where(F.col("analyte") % 5 != F.col("patient_id") % 5)
    per = there.groupBy("episode_id", "turn").agg(F.array_sort(F.collect_list(F.struct("pos", "analyte"))).alias("x"))
    return per.select("episode_id", "turn", F.array_join(F.transform("x", lambda x: x["analyte"].cast("string")), ",").alias("revealed"))
