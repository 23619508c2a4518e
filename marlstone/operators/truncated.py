"""Normals truncated to an interval: densities, draws, and the priors of the
ranges that a value may fall into.  All of it is arithmetic inside the row."""

from __future__ import annotations

from math import log, pi

from pyspark.sql import Column, DataFrame, functions as F

from marlstone.functions.normal import normal_cdf, normal_cdf_sql, normal_quantile, normal_quantile_sql
from marlstone.operators.belief import FLOOR, LIK, evidence, likelihoods, log_likelihood, priors, softmax
from marlstone.operators.evaluation import uniform
from marlstone.operators.scoring import r6
from marlstone.plans.registry import query

#: The interval that every value lies in.
LO, HI = -0.6, 0.6


def with_mass(lik: DataFrame, lo: Column | float = LO, hi: Column | float = HI) -> DataFrame:
    """``lik`` (mean, sd) with below and mass: what a normal has below ``lo``,
    and between it and ``hi``.  A dimension, so this is done once a pair."""
    at = lambda x: normal_cdf(((x if isinstance(x, Column) else F.lit(x)) - F.col("mean")) / F.col("sd"))
    return lik.withColumn("below", at(lo)).withColumn("mass", at(hi) - F.col("below"))


def truncated_log_likelihood(value: Column) -> Column:
    """Log density of a truncated normal (mean, sd, mass); outside of the
    interval it is the untruncated tail's, as values there are kept."""
    return log_likelihood(value) - F.ln("mass")


def truncated_draw(u: Column, lo: float = LO, hi: float = HI) -> Column:
    """A draw of a truncated normal (mean, sd, below, mass) by inverse CDF from
    a uniform number; the bounds are hard."""
    x = F.col("mean") + F.col("sd") * normal_quantile(F.col("below") + u * F.col("mass"))
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def truncated_posteriors(ev: DataFrame) -> DataFrame:
    """(key, truth, label, p) with likelihoods that are truncated."""
    j = ev.join(F.broadcast(with_mass(likelihoods(ev))), "dim")
    ll = j.groupBy("key", "truth", "label").agg(F.sum(truncated_log_likelihood(F.col("value"))).alias("ll"))
    return softmax(ll.join(F.broadcast(priors(ev)), "label").withColumn("lp", F.col("ll") + F.ln("prior")), ["key"]).select("key", "truth", "label", "p")


def drawn_values(records: DataFrame, lik: DataFrame, seed: int, lo: float = LO, hi: float = HI) -> DataFrame:
    """(key, dim, value): for each record (key, truth) a value of every dim of
    its own label, each from a number that seed, key and dim give."""
    j = records.join(F.broadcast(with_mass(lik, lo, hi).withColumnRenamed("label", "truth")), "truth")
    return j.select("key", "dim", truncated_draw(uniform(seed, F.col("key"), F.col("dim")), lo, hi).alias("value"))


_LIM = f"""{LIK}, lm AS (SELECT *, {normal_cdf_sql(f'({LO} - mean) / sd')} AS below, {normal_cdf_sql(f'({HI} - mean) / sd')} AS above FROM lik), lw AS (SELECT dim, label, mean, sd, below, above - below AS mass FROM lm)"""
_TLL = f"-0.5 * ((value - mean) / sd) ** 2 - ln(sd) - {0.5 * log(2 * pi)!r}::DOUBLE - ln(mass)"


@query(f"WITH {_LIM} SELECT dim, label, round(0.5 * ln(2 * pi()) + ln(sd) + ln(mass), 6) AS log_norm FROM lw")
def bel_truncated(spark, sf_dir):
    """Constants of likelihoods truncated to the interval."""
    lik = with_mass(likelihoods(evidence(spark, sf_dir)))
    return lik.select("dim", "label", r6(0.5 * F.ln(F.lit(2 * pi)) + F.ln("sd") + F.ln("mass")).alias("log_norm"))


@query(f"""WITH {_LIM}, ll AS (SELECT key, truth, lw.label, sum({_TLL}) AS ll FROM ev JOIN lw USING (dim) GROUP BY 1, 2, 3), lp AS (SELECT key, label, ll + ln(prior) AS lp FROM ll JOIN pri USING (label)),
ex AS (SELECT *, exp(greatest(lp - max(lp) OVER (PARTITION BY key), {FLOOR})) AS e FROM lp) SELECT key, label, round(e / sum(e) OVER (PARTITION BY key), 6) AS p FROM ex""")
def bel_posterior_truncated(spark, sf_dir):
    return truncated_posteriors(evidence(spark, sf_dir)).select("key", "label", r6("p").alias("p"))


@query(f"""WITH {_LIM}, r AS (SELECT DISTINCT key, truth FROM ev), u AS (SELECT key, dim, mean, sd, below + ('0x' || substr(md5('17:' || key || ':' || dim), 1, 13))::BIGINT::DOUBLE / {2.0**52} * mass AS q FROM r JOIN lw ON lw.label = r.truth)
SELECT key, dim, round(least(greatest(mean + sd * {normal_quantile_sql('q')}, {LO}), {HI}), 6) AS value FROM u""")
def draw_values(spark, sf_dir):
    """A full panel of values for each record, from its own label's normals."""
    ev = evidence(spark, sf_dir)
    return drawn_values(ev.where("dim = 0").select("key", "truth"), likelihoods(ev), 17).select("key", "dim", r6("value").alias("value"))


@query(f"""WITH {LIK}, b AS (SELECT dim, prior, {normal_cdf_sql('(-0.5 - mean) / sd')} AS lo, {normal_cdf_sql('(0.5 - mean) / sd')} AS hi FROM lik JOIN pri USING (label)),
x AS (SELECT dim, prior, unnest(['low', 'normal', 'high']) AS bucket, unnest([lo, hi - lo, 1 - hi]) AS p FROM b) SELECT dim, bucket, round(sum(prior * p), 6) AS prior FROM x GROUP BY 1, 2""")
def bucket_prior_normal(spark, sf_dir):
    """(dim, bucket, prior) from the untruncated normals, weighted by label."""
    ev = evidence(spark, sf_dir)
    j = likelihoods(ev).join(F.broadcast(priors(ev)), "label")
    below = lambda x: normal_cdf((F.lit(x) - F.col("mean")) / F.col("sd"))
    j = j.select("dim", "prior", below(-0.5).alias("lo"), below(0.5).alias("hi"))
    parts = F.array(*[F.struct(F.lit(n).alias("bucket"), p.alias("p")) for n, p in (("low", F.col("lo")), ("normal", F.col("hi") - F.col("lo")), ("high", 1 - F.col("hi")))])
    x = j.select("dim", "prior", F.explode(parts).alias("x"))
    return x.groupBy("dim", "x.bucket").agg(r6(F.sum(F.col("prior") * F.col("x.p"))).alias("prior"))
