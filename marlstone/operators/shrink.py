"""Stored reports mixed with the labels' prior: what a run would have scored had
it been more or less sure.

A report stays in closed form (named entries and one share for the rest), so its
score is a quadratic in alpha with coefficients from sums over its few entries,
and a policy's curve is the mean of coefficients; no report is multiplied by
labels or by the grid.  Only which label a mixed report declares first is asked
for each alpha, inside the row.  An episode without a report scores the same at
every alpha.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from marlstone.functions.normal import once
from marlstone.operators.evaluation import ALPHAS
from marlstone.operators.scoring import base, diagnosis, r6, scores_sql, step_terms, weight
from marlstone.plans.config import DEFAULT, RewardConfig
from marlstone.plans.registry import query
from marlstone.sources.views import view


def label_prior(episodes: DataFrame) -> DataFrame:
    """One row: pi (label -> share of the episodes) and pp, its sum of squares."""
    n = episodes.groupBy(F.col("condition").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    p = n.select("label", (F.col("n") / F.sum("n").over(W.partitionBy())).alias("p"))  # a row a label
    return p.agg(F.map_from_entries(F.collect_list(F.struct("label", "p"))).alias("pi"), F.sum(F.col("p") * F.col("p")).alias("pp"))


def _pi(label: Column) -> Column:
    return F.coalesce(F.col("pi")[label], F.lit(0.0))


def mixed_brier() -> dict[str, Column]:
    """Coefficients (a0, a1, a2) of the Brier score of a stated report that is
    mixed with the prior as (1 - alpha) pi + alpha p; and (m0, m1) of the mass on
    the truth."""
    total = lambda f: F.aggregate("named", F.lit(0.0), lambda a, x: a + f(x))
    pr = total(lambda x: x["p"] * _pi(x["label"])) + F.col("share") * (1.0 - total(lambda x: _pi(x["label"])))
    rr = total(lambda x: x["p"] * x["p"]) + F.col("unnamed") * F.col("share") * F.col("share")
    pp, truth, r = F.col("pp"), _pi(F.col("condition")), F.col("mass")
    floor = -1.0 / F.size("names")
    return {"a0": floor - pp + 2 * truth, "a1": 2 * pp - 2 * pr + 2 * r - 2 * truth, "a2": -(pp - 2 * pr + rr), "m0": truth, "m1": r - truth}


def declared_at(alphas: tuple[float, ...]) -> Column:
    """The label with most mass in a mixed report, for each alpha; of equals the
    first.  Of the labels not named only the likeliest can be it."""
    entry = lambda label, p: F.struct(label.alias("label"), p.alias("p"), _pi(label).alias("pi"))
    rest = F.filter("names", lambda n: ~F.exists("named", lambda x: x["label"] == n))
    first = F.array_min(F.transform(rest, lambda n: F.struct((-_pi(n)).alias("o"), n.alias("label"))))["label"]
    named = F.transform("named", lambda x: entry(x["label"], x["p"]))
    candidates = F.when(F.size(rest) > 0, F.concat(named, F.array(entry(first, F.col("share"))))).otherwise(named)
    best = lambda c, a: F.array_min(F.transform(c, lambda x: F.struct((-F.round((1 - a) * x["pi"] + a * x["p"], 12)).alias("o"), x["label"].alias("label"))))["label"]
    return once(candidates, lambda c: F.array(*[best(c, a) for a in alphas]))


def swept_reports(spark: SparkSession, sf_dir: str, cfg: RewardConfig = DEFAULT, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """(policy, alpha, n, mean_total, mean_diagnosis) of every stored episode."""
    prior = F.broadcast(label_prior(view(spark, sf_dir, "episode")))  # one row
    asked = F.col("named").isNotNull() & (F.col("termination_reason") == "diagnose")

    def mixed(j: DataFrame) -> DataFrame:
        zero = {k: F.when(F.col("reported"), c).otherwise(0.0) for k, c in mixed_brier().items()}
        said = F.when(F.col("reported") & (F.size("drugs") > 0), declared_at(alphas))
        return j.join(prior, F.lit(True)).withColumn("reported", asked).withColumns({**zero, "said": said}).drop("pi", "pp")

    b, reported = base(spark, sf_dir, mixed, len(alphas)), F.col("reported")
    w = weight(F.col("urgency"), cfg)
    steps = sum(step_terms(cfg).values(), F.lit(0.0))
    scale = cfg.correctness_scale * F.col("correctness")
    rest = steps - cfg.contraindication_penalty * F.col("contraindicated")
    # what does not depend on alpha, then the coefficients of alpha
    d = {"d0": F.when(reported, w * F.col("a0")).otherwise(diagnosis(cfg)), "d1": w * F.col("a1"), "d2": w * F.col("a2")}
    t = {"t0": d["d0"] + rest + scale * F.col("m0"), "t1": d["d1"] + scale * F.col("m1"), "t2": d["d2"]}
    x = b.select("policy", *[c.alias(k) for k, c in {**d, **t}.items()], *[f"told{i}" for i in range(len(alphas))])
    sums = x.groupBy("policy").agg(F.count(F.lit(1)).alias("n"), *[F.sum(k).alias(k) for k in (*d, *t)], *[F.coalesce(F.sum(f"told{i}"), F.lit(0.0)).alias(f"c{i}") for i in range(len(alphas))])
    at = lambda k, a: F.col(f"{k}0") + a * F.col(f"{k}1") + a * a * F.col(f"{k}2")
    grid = F.array(*[F.struct(F.lit(a).alias("alpha"), ((at("t", a) + cfg.coherence_scale * F.col(f"c{i}")) / F.col("n")).alias("mean_total"), (at("d", a) / F.col("n")).alias("mean_diagnosis")) for i, a in enumerate(alphas)])
    return sums.select("policy", "n", F.inline(grid))


_SQL = f"""{scores_sql()}, al AS (SELECT unnest([{', '.join(map(str, ALPHAS))}])::DOUBLE AS alpha),
pi AS (SELECT condition AS label, count(*)::DOUBLE / sum(count(*)) OVER () AS pi FROM episode GROUP BY 1),
mx AS (SELECT alpha, f.episode_id, f.label, (1 - alpha) * coalesce(pi, 0) + alpha * p AS m FROM full_report f LEFT JOIN pi ON pi.label = f.label, al),
sb AS (SELECT alpha, mx.episode_id, 0.9 - (sum(m * m) - 2 * sum(CASE WHEN label = condition THEN m ELSE 0 END) + 1) AS brier, sum(CASE WHEN label = condition THEN m ELSE 0 END) AS mass, first(label ORDER BY round(m, 12) DESC, label) AS said
  FROM mx JOIN episode e ON e.episode_id = mx.episode_id AND termination_reason = 'diagnose' GROUP BY 1, 2),
ch AS (SELECT alpha, gv.episode_id, avg(CASE WHEN d % 10 = substr(said, 7)::INT THEN 1.0 WHEN d % 5 = substr(said, 7)::INT % 5 THEN 0.5 ELSE 0 END) AS coh FROM gv JOIN sb ON sb.episode_id = gv.episode_id WHERE kind = 'prescribe' GROUP BY 1, 2),
ta AS (SELECT s.policy, al.alpha, CASE WHEN sb.brier IS NULL THEN s.diagnosis ELSE sb.brier * {DEFAULT.weight_sql('l.urgency')} END AS diagnosis, s.test_cost + s.turn_penalty + s.verify
   + CASE WHEN ap.episode_id IS NULL THEN 0 ELSE {DEFAULT.coherence_scale} * coalesce(ch.coh, 0) + {DEFAULT.correctness_scale} * coalesce(sb.mass, 0) * ap.cor - {DEFAULT.contraindication_penalty} * coalesce(vs.scale, 0) END AS rest
  FROM scores s CROSS JOIN al JOIN label l ON l.label = s.condition LEFT JOIN sb ON sb.episode_id = s.episode_id AND sb.alpha = al.alpha LEFT JOIN ch ON ch.episode_id = s.episode_id AND ch.alpha = al.alpha LEFT JOIN ap ON ap.episode_id = s.episode_id
  LEFT JOIN (SELECT episode_id, sum(scale) AS scale FROM vi GROUP BY 1) vs ON vs.episode_id = s.episode_id)"""


@query(f"WITH {_SQL} SELECT policy, alpha, count(*) AS n, round(avg(diagnosis + rest), 6) AS mean_total, round(avg(diagnosis), 6) AS mean_diagnosis FROM ta GROUP BY 1, 2")
def sweep_stored(spark, sf_dir):
    """The stored reports at every step of the grid, by policy."""
    return swept_reports(spark, sf_dir).select("policy", "alpha", "n", r6("mean_total").alias("mean_total"), r6("mean_diagnosis").alias("mean_diagnosis"))
