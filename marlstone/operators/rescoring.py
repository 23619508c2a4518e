"""Stored nested episodes scored again by a rule that the caller brings: a
function of (trajectory, truth), either of columns or of Arrow arrays."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from marlstone.operators.scoring import r6, rescored
from marlstone.plans.registry import query
from marlstone.sources.episode_log import stored_episodes
from marlstone.sources.views import ctes


def by_arrow(rule: Callable[[pa.StructArray, pa.StructArray], pa.Array]) -> Callable[[Column, Column], Column]:
    """A rule over whole Arrow batches, for what columns cannot say."""

    def of(trajectory: pa.Array, truth: pa.Array) -> pa.Array:
        return rule(trajectory, truth)

    return lambda trajectory, truth: F.arrow_udf(of, "double")(trajectory, truth)


def rescored_stored(stored: DataFrame, rule: Callable[[Column, Column], Column]) -> DataFrame:
    """``stored`` (trajectory, ground_truth, tags) as patient_id, seed, policy and
    score.  A score that is null or not finite is an error: an episode that a
    rule cannot score must not vanish from a mean.  One pass, no shuffle."""
    x = stored.select(F.col("trajectory.patient_id").alias("patient_id"), F.col("trajectory.seed").alias("seed"), F.col("tags")["policy"].alias("policy"), rule(F.col("trajectory"), F.col("ground_truth")).alias("s"))
    bad = F.raise_error(F.concat(F.lit("no score for seed "), F.col("seed").cast("string"))).cast("double")
    return x.select("patient_id", "seed", "policy", F.when(F.abs("s") < float("inf"), F.col("s")).otherwise(bad).alias("score"))


def frugal(trajectory: Column, truth: Column) -> Column:
    """A column rule: what a diagnosis is worth less what it spent, and less for
    each turn; a rare label is worth more."""
    spent = F.aggregate(trajectory["steps"], F.lit(0.0), lambda a, s: a + s["cost_charged"])
    worth = F.when(truth["condition"].isin("label_0", "label_9"), 2.0).otherwise(1.0)
    return F.when(trajectory["termination_reason"] == "diagnose", worth).otherwise(-0.1) - 0.01 * spent - 0.02 * F.size(trajectory["steps"])


def plain(trajectory: Column, truth: Column) -> Column:
    """A column rule: 1 for a diagnosis."""
    return (trajectory["termination_reason"] == "diagnose").cast("double")


@query(f"""WITH {ctes('charged', 'episode')}, s AS (SELECT episode_id, count(*) AS n, sum(cost_charged) AS spent FROM charged GROUP BY 1),
x AS (SELECT policy, (termination_reason = 'diagnose')::INT AS total, CASE WHEN termination_reason = 'diagnose' THEN CASE WHEN condition IN ('label_0', 'label_9') THEN 2.0 ELSE 1.0 END ELSE -0.1 END - 0.01 * coalesce(spent, 0) - 0.02 * coalesce(n, 0) AS again
  FROM episode LEFT JOIN s USING (episode_id)) SELECT policy, count(*) AS n, round(avg(again), 6) AS mean_rescored, round(avg(total), 6) AS mean_stored, round(avg(again - total), 6) AS mean_delta FROM x GROUP BY 1""")
def rescore_rule(spark, sf_dir):
    """A stored run under a rule of its nested episodes, against another's."""
    stored = stored_episodes(spark, sf_dir)
    both = stored.select(F.col("tags")["policy"].alias("policy"), plain(F.col("trajectory"), F.col("ground_truth")).alias("total"), frugal(F.col("trajectory"), F.col("ground_truth")).alias("again"))
    return rescored(both)


@query(f"""WITH {ctes('charged', 'episode')}, s AS (SELECT episode_id, count(*) AS n, sum(cost_charged) AS spent FROM charged GROUP BY 1)
SELECT patient_id, seed, policy, round(CASE WHEN termination_reason = 'diagnose' THEN CASE WHEN condition IN ('label_0', 'label_9') THEN 2.0 ELSE 1.0 END ELSE -0.1 END - 0.01 * coalesce(spent, 0) - 0.02 * coalesce(n, 0), 6) AS score FROM episode LEFT JOIN s USING (episode_id)""")
def rescore_stored(spark, sf_dir):
    return rescored_stored(stored_episodes(spark, sf_dir), frugal).withColumn("score", r6("score"))
