"""Run monitors over an ordered log, in batch: trailing-count windows per run.

A run's log is cut into chunks that carry the last rows of the one before, so a
long run is many window partitions.  ``streams`` has the same rules as stateful
queries.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from marlstone.operators.ordering import trailing
from marlstone.operators.scoring import r6
from marlstone.plans.registry import query
from marlstone.sources.views import ctes, table, view

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package

CEILING, COST, GROUPS, COMMIT = 512, 512, 128, 640
SLACK = 0.02
_E = f"WITH {ctes('run_event')}"


def _win(n: int) -> str:
    return f"(PARTITION BY run_id ORDER BY ts, event_id ROWS {n - 1} PRECEDING)"


@query(f"{_E} SELECT event_id, count(*) OVER w >= {CEILING // 2} AND avg(reward) OVER w > avg(expected_ceiling) OVER w + {SLACK} AS alert, round(sum(reward) OVER w, 4) AS total FROM run_event WINDOW w AS {_win(CEILING)}")
def mon_ceiling(spark, sf_dir):
    """Running mean reward above the running mean of the expected ceiling."""
    rows, w = trailing(view(spark, sf_dir, "run_event"), CEILING, "run_id", "ts", "event_id")
    mean = F.avg("reward").over(w)
    alert = (F.count(F.lit(1)).over(w) >= CEILING // 2) & (mean > F.avg("expected_ceiling").over(w) + SLACK)
    return rows.select("own", "event_id", alert.alias("alert"), F.round(F.sum("reward").over(w), 4).alias("total")).where("own").drop("own")


@query(f"{_E} SELECT event_id, count(*) OVER w >= {COST // 2} AND (avg((n_tests = 0)::INT) OVER w > 0.95 OR avg((n_tests >= 7)::INT) OVER w > 0.5) AS alert, round(avg((n_tests = 0)::INT) OVER w, 6) AS zero_fraction FROM run_event WINDOW w AS {_win(COST)}")
def mon_cost(spark, sf_dir):
    """Collapse of spending: nearly all without tests, or most at the cap."""
    rows, w = trailing(view(spark, sf_dir, "run_event"), COST, "run_id", "ts", "event_id")
    zero, capped = (F.avg(c.cast("int")).over(w) for c in (F.col("n_tests") == 0, F.col("n_tests") >= 7))
    alert = (F.count(F.lit(1)).over(w) >= COST // 2) & ((zero > 0.95) | (capped > 0.5))
    return rows.select("own", "event_id", alert.alias("alert"), r6(zero).alias("zero_fraction")).where("own").drop("own")


@query(f"{_E}, g AS (SELECT run_id, group_id, max(event_id) AS event_id, max(ts) AS ts, stddev_pop(reward) AS std FROM run_event GROUP BY 1, 2) SELECT run_id, group_id, count(*) OVER w >= {GROUPS // 2} AND avg((std < 1e-6)::INT) OVER w > 0.5 AS alert, round(avg((std < 1e-6)::INT) OVER w, 6) AS flat_fraction FROM g WINDOW w AS {_win(GROUPS)}")
def mon_degenerate(spark, sf_dir):
    """Most of the last groups have no spread."""
    g = view(spark, sf_dir, "run_event").groupBy("run_id", "group_id").agg(F.max("event_id").alias("event_id"), F.max("ts").alias("ts"), F.stddev_pop("reward").alias("std"))
    g, w = trailing(g, GROUPS, "run_id", "ts", "event_id")
    flat = F.avg((F.col("std") < 1e-6).cast("int")).over(w)
    return g.select("own", "run_id", "group_id", ((F.count(F.lit(1)).over(w) >= GROUPS // 2) & (flat > 0.5)).alias("alert"), r6(flat).alias("flat_fraction")).where("own").drop("own")


@query(f"{_E} SELECT event_id, count(*) OVER w >= {COMMIT // 2} AND avg((termination_reason = 'diagnose')::INT) OVER w < 0.1 AS alert, round(avg((termination_reason = 'diagnose')::INT) OVER w, 6) AS fraction FROM run_event WINDOW w AS {_win(COMMIT)}")
def mon_commit(spark, sf_dir):
    """Too few of the last episodes end in a diagnosis."""
    rows, w = trailing(view(spark, sf_dir, "run_event"), COMMIT, "run_id", "ts", "event_id")
    f = F.avg((F.col("termination_reason") == "diagnose").cast("int")).over(w)
    return rows.select("own", "event_id", ((F.count(F.lit(1)).over(w) >= COMMIT // 2) & (f < 0.1)).alias("alert"), r6(f).alias("fraction")).where("own").drop("own")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, step, reward): a run's log by day."""
    e = view(spark, sf_dir, "run_event")
    return e.groupBy("run_id", F.dayofmonth("ts").cast("long").alias("step")).agg(F.avg("reward").alias("reward"), F.count(F.lit(1)).alias("n"))


_STEPS = f"{_E}, st AS (SELECT run_id, day(ts) AS step, avg(reward) AS reward, count(*) AS n FROM run_event GROUP BY 1, 2)"


@query(f"{_STEPS} SELECT run_id, step, round(reward, 6) AS reward, n FROM st")
def step_metrics(spark, sf_dir):
    return steps(spark, sf_dir).select("run_id", "step", r6("reward").alias("reward"), "n")


@query(f"{_STEPS}, m AS (SELECT run_id, step, avg(reward) OVER w AS m, count(*) OVER w AS k FROM st WINDOW w AS (PARTITION BY run_id ORDER BY step ROWS 8 PRECEDING)) SELECT run_id, step, round(m, 6) AS smooth FROM m WHERE k = 9")
def moving_average(spark, sf_dir):
    """Means of nine steps, where there are nine."""
    w = W.partitionBy("run_id").orderBy("step").rowsBetween(-8, 0)
    s = steps(spark, sf_dir).select("run_id", "step", r6(F.avg("reward").over(w)).alias("smooth"), F.count(F.lit(1)).over(w).alias("k"))
    return s.where("k = 9").drop("k")


@query(f"{_STEPS}, p AS (SELECT *, max(reward) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM st) SELECT run_id, step, before IS NULL OR reward > before AS improved, round(greatest(reward, coalesce(before, reward)), 6) AS best FROM p")
def best_so_far(spark, sf_dir):
    w = W.partitionBy("run_id").orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    p = steps(spark, sf_dir).withColumn("before", F.max("reward").over(w))
    return p.select("run_id", "step", F.coalesce(F.col("reward") > F.col("before"), F.lit(True)).alias("improved"), r6(F.greatest("reward", F.coalesce("before", "reward"))).alias("best"))


STAGE_WINDOW, CRITERION, STAGES = 5, -0.52, 3


def advance(stage: int, recent: list[float], reward: float) -> tuple[int, list[float]]:
    """One step of the stage rule: a full window at the criterion moves one
    stage on and empties the window."""
    recent = [*recent, reward][-STAGE_WINDOW:]
    if stage < STAGES and len(recent) == STAGE_WINDOW and sum(recent) / STAGE_WINDOW >= CRITERION:
        return stage + 1, []
    return stage, recent


def _stages(pdf: pd.DataFrame) -> pd.DataFrame:
    out, stage, recent = [], 0, []
    for r in pdf.sort_values("step").itertuples():
        stage, recent = advance(stage, recent, r.reward)
        out.append((r.run_id, r.step, stage))
    return pd.DataFrame(out, columns=["run_id", "step", "stage"])


@query(f"""{_STEPS.replace('WITH', 'WITH RECURSIVE')}, nn AS (SELECT run_id, step, reward, row_number() OVER (PARTITION BY run_id ORDER BY step) AS i FROM st),
f AS (SELECT DISTINCT run_id, 0::BIGINT AS i, 0::BIGINT AS step, 0 AS stage, []::DOUBLE[] AS recent FROM nn UNION ALL
 SELECT run_id, i, step, CASE WHEN up THEN stage + 1 ELSE stage END, CASE WHEN up THEN [] ELSE recent END FROM (
  SELECT *, stage < {STAGES} AND len(recent) = {STAGE_WINDOW} AND list_sum(recent) / {STAGE_WINDOW} >= {CRITERION} AS up FROM (
   SELECT nn.run_id, nn.i, nn.step, f.stage, list_append(f.recent, nn.reward)[-{STAGE_WINDOW}:] AS recent FROM f JOIN nn ON nn.run_id = f.run_id AND nn.i = f.i + 1)))
SELECT run_id, step, stage FROM f WHERE i > 0""")
def stage_advance(spark, sf_dir):
    """The stage after each step.  The window empties when a stage is left, so
    the rule folds over a run's steps (one row a step: thousands at most)."""
    return steps(spark, sf_dir).groupBy("run_id").applyInPandas(_stages, "run_id int, step long, stage int")


_TOK = "t AS (SELECT event_id, CAST(user_id % 4 AS INT) AS run_id, -value / 100 AS lp, -(coalesce(json_extract_string(props, '$.k')::INT, 0) + 1) / 50.0 AS lr, 1 + coalesce(json_extract_string(props, '$.k')::INT, 0) AS n, value / 50 - 1 AS adv FROM events)"


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    return table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 4).cast("int").alias("run_id"), (-F.col("value") / 100).alias("lp"), (-(k + 1) / 50.0).alias("lr"), (1 + k).alias("n"), (F.col("value") / 50 - 1).alias("adv"))


@query(f"WITH {_TOK} SELECT run_id, round(avg(exp(lr - lp) - (lr - lp) - 1), 6) AS kl FROM t GROUP BY 1")
def token_kl(spark, sf_dir):
    r = F.col("lr") - F.col("lp")
    return tokens(spark, sf_dir).groupBy("run_id").agg(r6(F.avg(F.exp(r) - r - 1)).alias("kl"))


@query(f"WITH {_TOK} SELECT run_id, round(avg(least(exp(lp - lr) * adv, least(greatest(exp(lp - lr), 0.8), 1.2) * adv)), 6) AS surrogate FROM t GROUP BY 1")
def surrogate(spark, sf_dir):
    rho = F.exp(F.col("lp") - F.col("lr"))
    clipped = F.least(F.greatest(rho, F.lit(0.8)), F.lit(1.2))
    return tokens(spark, sf_dir).groupBy("run_id").agg(r6(F.avg(F.least(rho * F.col("adv"), clipped * F.col("adv")))).alias("surrogate"))


MAX_TOKENS = 80


@query(f"WITH {_TOK} SELECT run_id, round(sum(lp * n) FILTER (n <= {MAX_TOKENS}) / sum(n) FILTER (n <= {MAX_TOKENS}), 6) AS loss, count_if(n > {MAX_TOKENS})::BIGINT AS skipped, max(n)::INT AS longest FROM t GROUP BY 1")
def token_loss(spark, sf_dir):
    """Token-weighted loss of sequences within the length gate; those beyond it
    are counted."""
    fits = F.col("n") <= MAX_TOKENS
    return tokens(spark, sf_dir).groupBy("run_id").agg(r6(F.sum(F.when(fits, F.col("lp") * F.col("n"))) / F.sum(F.when(fits, F.col("n")))).alias("loss"), F.count_if(~fits).alias("skipped"), F.max("n").alias("longest"))
