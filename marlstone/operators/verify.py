"""The verification term with priors of each test's own ranges.

A prediction of a test's range earns ``fraction * cost * (right - prior)``: what
it is worth beyond how often that range is met at all.  Priors are taken per test
from its likelihood table: for numbers the mass of the labels' normals between
the test's reference limits, for categories the labels' shares of the reference
value, both weighted by the labels' frequency.  A prediction that is no range of
the test's kind earns the penalty of the kind's first range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from marlstone.functions.normal import normal_cdf, normal_cdf_sql
from marlstone.operators.belief import MIN_SD
from marlstone.operators.scoring import r6
from marlstone.plans.config import DEFAULT, RewardConfig
from marlstone.plans.registry import query
from marlstone.sources.views import SQL, ctes, view

#: Ranges by kind of test; the first is the one whose prior an invalid prediction pays.
NUMBERS, CATEGORIES = ("low", "normal", "high"), ("normal_categorical", "abnormal_categorical")

# tests with reference limits of their own; every seventh is categorical, its reference value a number up to 25
SQL["test_ref"] = """SELECT DISTINCT test_key, CAST(substr(test_key, 2) AS INT) % 7 = 6 AS categorical, 8.0e0 + CAST(substr(test_key, 2) AS INT) % 9 AS ref_low, 30.0e0 + CAST(substr(test_key, 2) AS INT) % 13 AS ref_high FROM {step}"""
SQL["predicted"] = """SELECT s.episode_id, s.turn, s.test_key, s.value_number, s.price, s.cost_charged, e.condition,
 CASE WHEN CAST(substr(s.test_key, 2) AS INT) % 7 = 6 AND s.prediction = 'normal' THEN 'normal_categorical' WHEN s.turn % 3 = 0 THEN 'high' ELSE s.prediction END AS prediction
 FROM {charged} AS s JOIN {episode} AS e ON s.episode_id = e.episode_id WHERE s.kind = 'order_test'"""
#: Numbers up to this are the reference value of a categorical test.
REFERENCE = 25.0


def range_priors(results: DataFrame, refs: DataFrame) -> DataFrame:
    """(test_key, range, prior) from results (test_key, condition, value_number)
    and reference limits (test_key, categorical, ref_low, ref_high): every test
    has all ranges of its kind.  One aggregate over the results; the rest is a
    row for each test and label."""
    hit = F.avg((F.col("value_number") <= REFERENCE).cast("double")).alias("share")
    per = results.groupBy("test_key", "condition").agg(F.count(F.lit(1)).alias("n"), F.avg("value_number").alias("mean"), F.greatest(F.stddev_pop("value_number"), F.lit(MIN_SD)).alias("sd"), hit)
    labels = per.groupBy("condition").agg(F.sum("n").alias("n"))
    weights = labels.select("condition", (F.col("n") / F.sum("n").over(W.partitionBy())).alias("w"))  # a row a label
    j = per.drop("n").join(F.broadcast(weights), "condition").join(F.broadcast(refs), "test_key")
    below = lambda limit: normal_cdf((F.col(limit) - F.col("mean")) / F.col("sd"))
    mean = lambda x: F.sum(F.col("w") * x) / F.sum("w")  # noqa: E731 a test that no record of a label had says nothing of it
    t = j.groupBy("test_key", "categorical").agg(mean(below("ref_low")).alias("low"), mean(below("ref_high")).alias("to_high"), mean(F.col("share")).alias("ref"))
    ranges = lambda *parts: F.array(*[F.struct(F.lit(n).alias("range"), p.alias("prior")) for n, p in parts])
    low, to_high = F.col("low"), F.col("to_high")
    numbers = ranges(("low", low), ("normal", F.greatest(to_high - low, F.lit(0.0))), ("high", F.greatest(1 - to_high, F.lit(0.0))))
    return t.select("test_key", F.inline(F.when(F.col("categorical"), ranges(("normal_categorical", F.col("ref")), ("abnormal_categorical", 1 - F.col("ref")))).otherwise(numbers)))


def met_range() -> Column:
    """The range that a value of a test (categorical, ref_low, ref_high) is in."""
    v = F.col("value_number")
    number = F.when(v < F.col("ref_low"), "low").when(v > F.col("ref_high"), "high").otherwise("normal")
    return F.when(F.col("categorical"), F.when(v <= REFERENCE, "normal_categorical").otherwise("abnormal_categorical")).otherwise(number)


def verified(orders: DataFrame, refs: DataFrame, priors: DataFrame, cfg: RewardConfig = DEFAULT) -> DataFrame:
    """``orders`` (test_key, prediction, value_number, cost_charged) with valid
    and verify.  An order that was not charged (refused or repeated) reveals
    nothing and earns 0; a negative charge or an unknown test is an error."""
    if not 0 <= cfg.verify_fraction < 1:
        raise ValueError("the fraction must lie in [0, 1): at 1 a right prediction would pay for its test")
    per = priors.groupBy("test_key").agg(F.map_from_entries(F.collect_list(F.struct("range", "prior"))).alias("of"))
    tests = refs.join(per, "test_key", "left")
    j = orders.join(F.broadcast(tests), "test_key", "left")
    cost = F.when(F.col("of").isNull(), F.raise_error(F.concat(F.lit("no prior for test "), "test_key")).cast("double")).when(F.col("cost_charged") < 0, F.raise_error(F.lit("a negative charge")).cast("double")).otherwise(F.col("cost_charged"))
    kinds = F.when(F.col("categorical"), F.array(*map(F.lit, CATEGORIES))).otherwise(F.array(*map(F.lit, NUMBERS)))
    valid = F.coalesce(F.array_contains(kinds, F.col("prediction")), F.lit(False))
    worth = F.when(valid, (met_range() == F.col("prediction")).cast("double") - F.col("of")[F.col("prediction")]).otherwise(-F.col("of")[kinds[0]])
    earned = F.when((cost > 0) & F.col("value_number").isNotNull(), cfg.verify_fraction * cfg.lam * cost * worth).otherwise(0.0)
    return j.select(*orders.columns, valid.alias("valid"), earned.alias("verify"))


_PRIORS = f"""{ctes('predicted', 'test_ref')},
per AS (SELECT test_key, condition, count(*) AS n, avg(value_number) AS mean, greatest(stddev_pop(value_number), {MIN_SD}) AS sd, avg((value_number <= {REFERENCE})::INT) AS share FROM predicted GROUP BY 1, 2),
wt AS (SELECT condition, sum(n)::DOUBLE / sum(sum(n)) OVER () AS w FROM per GROUP BY 1),
pj AS (SELECT *, {normal_cdf_sql('(ref_low - mean) / sd')} AS lo, {normal_cdf_sql('(ref_high - mean) / sd')} AS hi FROM per JOIN wt USING (condition) JOIN test_ref USING (test_key)),
tp AS (SELECT test_key, categorical, sum(w * lo) / sum(w) AS low, sum(w * hi) / sum(w) AS to_high, sum(w * share) / sum(w) AS ref FROM pj GROUP BY 1, 2),
rp AS (SELECT test_key, unnest(CASE WHEN categorical THEN ['normal_categorical', 'abnormal_categorical'] ELSE ['low', 'normal', 'high'] END) AS range,
  unnest(CASE WHEN categorical THEN [ref, 1 - ref] ELSE [low, greatest(to_high - low, 0), greatest(1 - to_high, 0)] END) AS prior FROM tp),
vr AS (SELECT p.*, categorical, CASE WHEN categorical THEN CASE WHEN value_number <= {REFERENCE} THEN 'normal_categorical' ELSE 'abnormal_categorical' END WHEN value_number < ref_low THEN 'low' WHEN value_number > ref_high THEN 'high' ELSE 'normal' END AS met,
  prediction IN ('normal_categorical', 'abnormal_categorical') = categorical AND prediction IN ('low', 'normal', 'high', 'normal_categorical', 'abnormal_categorical') AS valid FROM predicted p JOIN test_ref USING (test_key)),
ve AS (SELECT vr.*, CASE WHEN cost_charged > 0 THEN {DEFAULT.verify_fraction * DEFAULT.lam} * cost_charged * CASE WHEN valid THEN (met = prediction)::INT - rp.prior ELSE -rp.prior END ELSE 0 END AS verify
  FROM vr JOIN rp ON rp.test_key = vr.test_key AND rp.range = CASE WHEN valid THEN prediction WHEN categorical THEN 'normal_categorical' ELSE 'low' END)"""


@query(f"WITH {_PRIORS} SELECT test_key, range, round(prior, 6) AS prior FROM rp")
def range_prior(spark, sf_dir):
    """How often each test's ranges are met, over all labels."""
    return range_priors(view(spark, sf_dir, "predicted"), view(spark, sf_dir, "test_ref")).select("test_key", "range", r6("prior").alias("prior"))


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, refs = view(spark, sf_dir, "predicted"), view(spark, sf_dir, "test_ref")
    return verified(orders, refs, range_priors(orders, refs))


@query(f"WITH {_PRIORS} SELECT episode_id, count(*) AS orders, count_if(NOT valid)::BIGINT AS invalid, round(sum(verify), 6) AS verify FROM ve GROUP BY 1")
def ep_verify_by_test(spark, sf_dir):
    """The verification term of each episode under its tests' own ranges."""
    return _verified(spark, sf_dir).groupBy("episode_id").agg(F.count(F.lit(1)).alias("orders"), F.count_if(~F.col("valid")).alias("invalid"), r6(F.sum("verify")).alias("verify"))


@query(f"WITH {_PRIORS} SELECT test_key, prediction, count(*) AS orders, round(sum(verify), 6) AS verify FROM ve WHERE NOT valid GROUP BY 1, 2")
def verify_invalid(spark, sf_dir):
    """What predictions cost that are no range of their test's kind."""
    return _verified(spark, sf_dir).where("NOT valid").groupBy("test_key", "prediction").agg(F.count(F.lit(1)).alias("orders"), r6(F.sum("verify")).alias("verify"))
