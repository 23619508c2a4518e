"""Groups of k episodes of one patient under one policy: statistics, pass@k,
advantages, rejection sampling and balancing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from marlstone.operators.scoring import N_LABELS, base, r6, scores, scores_sql, terms, totals, weight
from marlstone.plans.config import DEFAULT
from marlstone.plans.registry import query

BAR = 0.0
MIN_REWARD, MAX_TESTS, MIN_REPRODUCIBLE, KEEP, CAP = -0.6, 4, 2, 1, 40
GROUP = ["policy", "patient_id"]
_S = f"WITH {scores_sql()}"


def groups(s: DataFrame, bar: float = BAR) -> DataFrame:
    """One row a group: size, mean, population deviation, best, first sample
    (by seed) and whether any, and the first, reach the bar."""
    return s.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("k"), F.avg("total").alias("mean"), F.stddev_pop("total").alias("std"), F.max("total").alias("best"),
        F.min_by("total", "seed").alias("first"), F.bool_or(F.col("total") >= bar).alias("pass_k"), (F.min_by("total", "seed") >= bar).alias("pass_1"),
        F.count_if(F.col("termination_reason") == "diagnose").alias("diagnosed"),
    )


_G = f"{_S}, g AS (SELECT policy, patient_id, count(*) AS k, avg(total) AS mean, stddev_pop(total) AS std, max(total) AS best, min_by(total, seed) AS first, bool_or(total >= {BAR}) AS pass_k, min_by(total, seed) >= {BAR} AS pass_1 FROM scores GROUP BY ALL)"


@query(f"{_G} SELECT policy, patient_id, k, round(mean, 6) AS mean, round(std, 6) AS std, round(best, 6) AS best, round(first, 6) AS first FROM g")
def grp_stats(spark, sf_dir):
    return groups(totals(spark, sf_dir)).select(*GROUP, "k", *[r6(c).alias(c) for c in ("mean", "std", "best", "first")])


@query(f"{_G} SELECT policy, count(*) AS groups, round(avg(pass_1::INT), 6) AS pass_at_1, round(avg(pass_k::INT), 6) AS pass_at_k, round(avg(std), 6) AS mean_std, round(avg(best), 6) AS mean_best FROM g GROUP BY policy")
def grp_pass_at_k(spark, sf_dir):
    return groups(totals(spark, sf_dir)).groupBy("policy").agg(F.count(F.lit(1)).alias("groups"), r6(F.avg(F.col("pass_1").cast("int"))).alias("pass_at_1"), r6(F.avg(F.col("pass_k").cast("int"))).alias("pass_at_k"), r6(F.avg("std")).alias("mean_std"), r6(F.avg("best")).alias("mean_best"))


@query(f"{_G}, b AS (SELECT avg(mean) AS bar FROM g WHERE policy = '1') SELECT policy, round(avg((mean >= bar)::INT), 6) AS above_bar, round(avg(mean - bar), 6) + 0 AS margin FROM g, b GROUP BY policy")
def grp_against_baseline(spark, sf_dir):
    """Groups that reach the mean of a named baseline policy."""
    g = groups(totals(spark, sf_dir))
    bar = g.where("policy = '1'").agg(F.avg("mean").alias("bar"))
    j = g.join(F.broadcast(bar), F.lit(True))  # one row
    return j.groupBy("policy").agg(r6(F.avg((F.col("mean") >= F.col("bar")).cast("int"))).alias("above_bar"), (r6(F.avg(F.col("mean") - F.col("bar"))) + F.lit(0.0)).alias("margin"))


def advantages(s: DataFrame) -> DataFrame:
    """``s`` with advantage (less the group's mean) and scaled advantage."""
    w = W.partitionBy(*GROUP)
    a = F.col("total") - F.avg("total").over(w)
    return s.withColumns({"advantage": a, "scaled": a / (F.stddev_pop("total").over(w) + 1e-8)})


@query(f"{_S} SELECT episode_id, round(total - avg(total) OVER w, 6) AS advantage, round((total - avg(total) OVER w) / (stddev_pop(total) OVER w + 1e-8), 4) AS scaled FROM scores WINDOW w AS (PARTITION BY policy, patient_id)")
def grp_advantages(spark, sf_dir):
    return advantages(scores(spark, sf_dir)).select("episode_id", r6("advantage").alias("advantage"), F.round("scaled", 4).alias("scaled"))


@query(f"{_G} SELECT policy, count_if(std < 1e-6)::BIGINT AS flat_groups, count(*) AS groups FROM g GROUP BY policy")
def flat_groups(spark, sf_dir):
    """Groups whose rewards have no spread teach nothing."""
    return groups(totals(spark, sf_dir)).groupBy("policy").agg(F.count_if(F.col("std") < 1e-6).alias("flat_groups"), F.count(F.lit(1)).alias("groups"))


def verdicts(s: DataFrame) -> DataFrame:
    """``s`` with the reasons against each episode; none means accepted."""
    reasons = F.array_compact(F.array(
        F.when(F.col("termination_reason") != "diagnose", F.concat(F.lit("ended "), "termination_reason")),
        F.when(F.col("total") < MIN_REWARD, F.lit("reward low")),
        F.when(F.col("n_tests") > MAX_TESTS, F.concat(F.lit("tests "), F.col("n_tests").cast("string"))),
    ))
    return s.withColumn("reasons", reasons).withColumn("accepted", F.size("reasons") == 0)


_V = f"""{_S}, v AS (SELECT *, list_filter([CASE WHEN termination_reason <> 'diagnose' THEN 'ended ' || termination_reason END, CASE WHEN total < {MIN_REWARD} THEN 'reward low' END,
 CASE WHEN n_tests > {MAX_TESTS} THEN 'tests ' || n_tests END], lambda x: x IS NOT NULL) AS reasons FROM scores)"""


@query(f"{_V} SELECT episode_id, len(reasons) = 0 AS accepted, array_to_string(reasons, '; ') AS reasons FROM v")
def grp_verdicts(spark, sf_dir):
    return verdicts(scores(spark, sf_dir)).select("episode_id", "accepted", F.array_join("reasons", "; ").alias("reasons"))


@query(f"{_V}, x AS (SELECT unnest(reasons) AS r FROM v) SELECT split_part(r, ' ', 1) AS reason, count(*) AS n FROM x GROUP BY 1")
def grp_reject_stats(spark, sf_dir):
    v = verdicts(scores(spark, sf_dir)).select(F.explode("reasons").alias("r"))
    return v.groupBy(F.split("r", " ")[0].alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def kept_best(s: DataFrame, keep: int = KEEP) -> DataFrame:
    """The best accepted episodes of each group with enough of them."""
    w = W.partitionBy(*GROUP)
    v = verdicts(s).where("accepted").withColumn("passing", F.count(F.lit(1)).over(w))
    v = v.where(F.col("passing") >= MIN_REPRODUCIBLE)
    return v.withColumn("nth", F.row_number().over(w.orderBy(F.desc("total"), "seed"))).where(F.col("nth") <= keep)


_K = f"""{_V}, k AS (SELECT *, count(*) OVER w AS passing, row_number() OVER (w ORDER BY total DESC, seed) AS nth FROM v WHERE len(reasons) = 0 WINDOW w AS (PARTITION BY policy, patient_id)),
kept AS (SELECT * FROM k WHERE passing >= {MIN_REPRODUCIBLE} AND nth <= {KEEP})"""


@query(f"{_K} SELECT policy, patient_id, episode_id, passing, round(total, 6) AS total FROM kept")
def grp_keep_best(spark, sf_dir):
    return kept_best(scores(spark, sf_dir)).select(*GROUP, "episode_id", "passing", r6("total").alias("total"))


def balanced(kept: DataFrame, cap: int = CAP) -> DataFrame:
    """The best ``cap`` of each label; ranks inside labels, by score and seed."""
    w = W.partitionBy("condition").orderBy(F.desc("total"), "seed")
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)


_B = f"{_K}, bal AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY total DESC, seed) AS rank FROM kept) WHERE rank <= {CAP})"


@query(f"{_B} SELECT condition, episode_id, rank FROM bal")
def grp_balance(spark, sf_dir):
    return balanced(kept_best(scores(spark, sf_dir))).select("condition", "episode_id", "rank")


@query(f"{_B}, c AS (SELECT condition, count(*) AS n FROM bal GROUP BY 1), d AS (SELECT (SELECT count(*) FROM kept) - (SELECT count(*) FROM bal) AS dropped) SELECT condition, n, dropped, round(max(n) OVER () / avg(n) OVER (), 6) AS imbalance FROM c, d")
def grp_balance_report(spark, sf_dir):
    kept = kept_best(scores(spark, sf_dir))
    per = kept.groupBy("condition").agg(F.count(F.lit(1)).alias("all")).withColumn("n", F.least("all", F.lit(CAP)))
    w = W.partitionBy()  # one row a label
    return per.select("condition", "n", (F.sum("all").over(w) - F.sum("n").over(w)).alias("dropped"), r6(F.max("n").over(w) / F.avg("n").over(w)).alias("imbalance"))


@query(f"{_S} SELECT policy, budget, count(*) AS n, round(avg(total), 6) AS mean_total, round(quantile_cont(n_tests, 0.9), 6) AS p90_tests, round(avg((n_tests = 0)::INT), 6) AS zero_fraction FROM scores GROUP BY policy, budget")
def grp_step_report(spark, sf_dir):
    """Roll-up by policy and budget with exact (interpolated) percentiles."""
    return scores(spark, sf_dir).groupBy("policy", "budget").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("total")).alias("mean_total"), r6(F.percentile("n_tests", 0.9)).alias("p90_tests"), r6(F.avg((F.col("n_tests") == 0).cast("int"))).alias("zero_fraction"))


@query(f"{_S} SELECT budget, round(avg(total), 6) AS mean_total, round(avg(diagnosis), 6) AS mean_diagnosis, round(avg(n_tests), 6) AS mean_tests FROM scores GROUP BY budget")
def frontier(spark, sf_dir):
    return scores(spark, sf_dir).groupBy("budget").agg(*[r6(F.avg(c)).alias(f"mean_{c.removeprefix('n_')}") for c in ("total", "diagnosis", "n_tests")])


@query(f"{_S}, f AS (SELECT budget, avg(total) AS t FROM scores GROUP BY budget), l AS (SELECT t, lag(t) OVER (ORDER BY budget) AS before FROM f) SELECT bool_and(before IS NULL OR t >= before - 0.05) AS monotone, count(*) AS budgets FROM l")
def monotone(spark, sf_dir):
    """No budget scores worse than the one below it, within a tolerance."""
    f = scores(spark, sf_dir).groupBy("budget").agg(F.avg("total").alias("t"))
    lag = f.withColumn("before", F.lag("t").over(W.orderBy("budget")))  # one row a budget
    return lag.agg(F.bool_and(F.col("before").isNull() | (F.col("t") >= F.col("before") - 0.05)).alias("monotone"), F.count(F.lit(1)).alias("budgets"))


_VALID = "vl AS (SELECT e.policy, avg((r.episode_id IS NOT NULL)::INT) AS valid FROM episode e LEFT JOIN (SELECT DISTINCT episode_id FROM report) r USING (episode_id) WHERE termination_reason = 'diagnose' GROUP BY 1)"


@query(f"{_G}, {_VALID}, gp AS (SELECT policy, avg(mean) AS mean, avg(best) AS best, avg(first) AS first, avg(std) AS std FROM g GROUP BY 1), ep AS (SELECT policy, avg(n_tests) AS tests, avg(0.9 * {DEFAULT.weight_sql()}) AS ceiling, avg((termination_reason = 'diagnose')::INT) AS diagnose FROM scores JOIN label ON label = condition GROUP BY 1) SELECT policy, round(mean, 6) AS mean, round(best, 6) AS best_of_k, round(first, 6) AS first, round(std, 6) AS group_std, round(tests, 6) AS mean_tests, round(ceiling, 6) AS mean_ceiling, round(diagnose, 6) AS diagnose_fraction, round(coalesce(valid, 1), 6) AS schema_valid_fraction FROM gp JOIN ep USING (policy) LEFT JOIN vl USING (policy)")
def policy_report(spark, sf_dir):
    """A policy's row: means over its groups, then over its episodes, and how
    many of the reports it was asked for are there (1 if none was)."""
    b = base(spark, sf_dir)
    s = b.select("policy", "patient_id", "seed", "n_tests", "urgency", "termination_reason", (F.col("brier").isNotNull()).cast("int").alias("ok"), terms()["total"].alias("total"))
    asked = F.col("termination_reason") == "diagnose"
    g = s.groupBy(*GROUP).agg(
        F.avg("total").alias("mean"), F.max("total").alias("best"), F.min_by("total", "seed").alias("first"), F.stddev_pop("total").alias("std"), F.count(F.lit(1)).alias("k"), F.sum(F.coalesce("n_tests", F.lit(0))).alias("tests"),
        F.sum((1 - 1 / N_LABELS) * weight(F.col("urgency"))).alias("ceiling"), F.count_if(asked).alias("asked"), F.sum(F.when(asked, F.col("ok")).otherwise(0)).alias("valid"),
    )
    share = lambda top, below: F.sum(top) / F.sum(below)
    return g.groupBy("policy").agg(
        r6(F.avg("mean")).alias("mean"), r6(F.avg("best")).alias("best_of_k"), r6(F.avg("first")).alias("first"), r6(F.avg("std")).alias("group_std"), r6(share("tests", "k")).alias("mean_tests"), r6(share("ceiling", "k")).alias("mean_ceiling"),
        r6(share("asked", "k")).alias("diagnose_fraction"), r6(F.when(F.sum("asked") == 0, 1.0).otherwise(F.try_divide(F.sum("valid"), F.sum("asked")))).alias("schema_valid_fraction"),
    )


@query(f"{_S}, sp AS (SELECT episode_id, sum(CASE WHEN cost_charged > 0 THEN price ELSE 0 END) AS spent FROM charged GROUP BY 1) SELECT policy, budget, count(*) AS n, round(quantile_cont(n_tests, 0.9), 6) AS p90_tests, round(avg((n_tests = 0)::INT), 6) AS zero_fraction, round(avg((coalesce(spent, 0) >= budget - 1e-9)::INT), 6) AS capped_fraction, round(avg(0.9 * {DEFAULT.weight_sql()} - total), 6) AS ceiling_gap FROM scores JOIN label ON label = condition LEFT JOIN sp USING (episode_id) GROUP BY 1, 2")
def spend_report(spark, sf_dir):
    """Spending by policy and budget: tests, who spent nothing or all, and how
    far scores stay below the ceiling."""
    tests, spent = F.coalesce("n_tests", F.lit(0)), F.coalesce("paid", F.lit(0.0))
    s = base(spark, sf_dir).select("policy", "budget", tests.alias("tests"), (spent >= F.col("budget") - 1e-9).cast("int").alias("capped"), ((1 - 1 / N_LABELS) * weight(F.col("urgency")) - terms()["total"]).alias("gap"))
    return s.groupBy("policy", "budget").agg(F.count(F.lit(1)).alias("n"), r6(F.percentile("tests", 0.9)).alias("p90_tests"), r6(F.avg((F.col("tests") == 0).cast("int"))).alias("zero_fraction"), r6(F.avg("capped")).alias("capped_fraction"), r6(F.avg("gap")).alias("ceiling_gap"))


@query(f"{_S}, a AS (SELECT episode_id, total - avg(total) OVER (PARTITION BY policy, patient_id) AS advantage FROM scores) SELECT episode_id, turn, kind, round(advantage, 6) AS advantage FROM a JOIN step USING (episode_id)")
def turn_advantages(spark, sf_dir):
    """Each turn as a training sequence with its episode's advantage."""
    from marlstone.sources.views import view

    a = advantages(scores(spark, sf_dir)).select("episode_id", "advantage")
    # charged steps are laid out by episode for the scores already
    return view(spark, sf_dir, "charged").join(a, "episode_id").select("episode_id", "turn", "kind", r6("advantage").alias("advantage"))


MIN_PROCESS = 0.5


@query(f"{_S}, pf AS (SELECT episode_id, avg((CASE WHEN value_number < 15 THEN 'low' WHEN value_number > 35 THEN 'high' ELSE 'normal' END = prediction)::INT) AS f FROM charged WHERE cost_charged > 0 GROUP BY 1), v AS (SELECT episode_id, list_filter([CASE WHEN termination_reason <> 'diagnose' THEN 'ended' END, CASE WHEN total < {MIN_REWARD} THEN 'reward' END, CASE WHEN n_tests > {MAX_TESTS} THEN 'tests' END, CASE WHEN coalesce(f, 1) < {MIN_PROCESS} THEN 'process' END], lambda x: x IS NOT NULL) AS r FROM scores LEFT JOIN pf USING (episode_id)) SELECT episode_id, array_to_string(r, ',') AS reasons FROM v WHERE len(r) > 0")
def process_verdicts(spark, sf_dir):
    """Reasons against each episode, the share of right predictions included."""
    b = base(spark, sf_dir)
    right = F.when(F.col("n_tests") > 0, sum((F.col(c) for c in ("right_low", "right_normal")), F.col("right_high")) / F.col("n_tests"))
    s = b.select("episode_id", "termination_reason", terms()["total"].alias("total"), F.coalesce("n_tests", F.lit(0)).alias("n_tests"), F.coalesce(right, F.lit(1.0)).alias("process"))
    reasons = F.array_compact(F.array(F.when(F.col("termination_reason") != "diagnose", F.lit("ended")), F.when(F.col("total") < MIN_REWARD, F.lit("reward")), F.when(F.col("n_tests") > MAX_TESTS, F.lit("tests")), F.when(F.col("process") < MIN_PROCESS, F.lit("process"))))
    return s.select("episode_id", F.array_join(reasons, ",").alias("reasons")).where("reasons <> ''")
