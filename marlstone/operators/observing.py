"""What a reader of a record sees at each turn of an episode: the record's free
fields, the results that earlier turns revealed, and the budget that is left.
No field of the truth can enter: fields are allowed by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marlstone.operators.scoring import r6
from marlstone.plans.registry import query
from marlstone.sources.views import SQL, ctes, view

#: Fields of a record that may be shown: fixed values.
FREE = ("patient_id", "age_years", "sex", "complaint", "allergies")
TURNS = 20

SQL["record"] = """SELECT c_custkey AS patient_id, CAST(18 + c_custkey % 70 AS INT) AS age_years, CASE WHEN c_custkey % 2 = 0 THEN 'female' ELSE 'male' END AS sex, c_mktsegment AS complaint, concat('class_', CAST(c_custkey % 6 AS VARCHAR(20))) AS allergies FROM {customer}"""


def _revealing(steps: Column) -> Column:
    """States before each of an episode's steps, in their order: what was
    revealed (a test's later value wins) and what was spent."""
    start = F.struct(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")).alias("seen"), F.lit(0.0).alias("spent"), F.array().cast("array<struct<turn:int,seen:map<string,double>,spent:double>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        shows = (x["kind"] == "order_test") & x["value"].isNotNull()
        with_it = F.map_concat(F.map_filter(a["seen"], lambda k, v: k != x["test_key"]), F.create_map(x["test_key"], x["value"]))
        before = F.struct(x["turn"].alias("turn"), a["seen"].alias("seen"), a["spent"].alias("spent"))
        return F.struct(F.when(shows, with_it).otherwise(a["seen"]).alias("seen"), (a["spent"] + x["cost"]).alias("spent"), F.array_append(a["out"], before).alias("out"))

    return F.aggregate(steps, start, step)["out"]


def observations(steps: DataFrame, episodes: DataFrame, records: DataFrame, tests: DataFrame) -> DataFrame:
    """A row for each turn: episode_id, turn, the record's free fields, results
    (sorted structs of test_key and value), remaining and turns_left.

    ``steps``: episode_id, turn, kind, test_key, value_number, cost_charged;
    ``episodes``: episode_id, patient_id, budget; ``records``: the free fields.
    A record with any other field, a missing record or complaint, and a result
    of a test that is not in ``tests`` are errors.  An episode's steps (at most
    some tens) are folded in one row.
    """
    shown = set(records.columns) - set(FREE)
    if shown:
        raise ValueError(f"not to be shown: {sorted(shown)}")
    known = F.broadcast(tests.select("test_key", F.lit(True).alias("listed")).distinct())  # the catalogue
    s = steps.select("episode_id", "turn", "kind", "test_key", "value_number", "cost_charged").join(known, "test_key", "left")
    key = F.when(F.col("listed") | (F.col("kind") != "order_test"), F.col("test_key")).otherwise(F.raise_error(F.concat(F.lit("not in the catalogue: "), "test_key")))
    per = s.groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").cast("int").alias("turn"), "kind", key.alias("test_key"), F.col("value_number").alias("value"), F.col("cost_charged").alias("cost")))).alias("steps"))
    j = per.join(episodes.select("episode_id", "patient_id", "budget"), "episode_id").join(records.withColumn("found", F.lit(True)), "patient_id", "left")
    complaint = F.when(F.col("found") & F.col("complaint").isNotNull(), F.col("complaint")).otherwise(F.raise_error(F.concat(F.lit("no complaint: "), F.col("patient_id").cast("string"))))
    free = [complaint.alias(c) if c == "complaint" else F.col(c) for c in records.columns]
    x = j.select("episode_id", *free, "budget", F.explode(_revealing(F.col("steps"))).alias("x"))
    results = F.array_sort(F.transform(F.map_entries("x.seen"), lambda e: F.struct(e["key"].alias("test_key"), e["value"].alias("value"))))
    return x.select("episode_id", F.col("x.turn").alias("turn"), *records.columns, results.alias("results"), F.round(F.col("budget") - F.col("x.spent"), 4).alias("remaining"), (TURNS + 1 - F.col("x.turn")).alias("turns_left"))


@query(f"""WITH {ctes('charged', 'episode', 'record')}, o AS (SELECT * FROM charged WHERE kind = 'order_test'),
l AS (SELECT c.episode_id, c.turn, o.test_key, max_by(o.value_number, o.turn) AS value FROM charged c JOIN o ON o.episode_id = c.episode_id AND o.turn < c.turn GROUP BY 1, 2, 3),
r AS (SELECT episode_id, turn, count(*) AS n, string_agg(test_key || '=' || round(value, 2)::DECIMAL(12, 2), ',' ORDER BY test_key) AS results FROM l GROUP BY 1, 2),
b AS (SELECT episode_id, turn, coalesce(sum(cost_charged) OVER (PARTITION BY episode_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM charged)
SELECT b.episode_id, b.turn::INT AS turn, complaint, age_years, allergies, coalesce(n, 0)::INT AS n_results, coalesce(results, '') AS results, round(budget - spent, 4) AS remaining, ({TURNS} + 1 - b.turn)::INT AS turns_left
FROM b JOIN episode e ON e.episode_id = b.episode_id JOIN record ON record.patient_id = e.patient_id LEFT JOIN r ON r.episode_id = b.episode_id AND r.turn = b.turn""")
def observation_turns(spark, sf_dir):
    """What the policy saw before each of its turns."""
    steps = view(spark, sf_dir, "charged")
    o = observations(steps, view(spark, sf_dir, "episode"), view(spark, sf_dir, "record"), view(spark, sf_dir, "step").select("test_key"))
    shown = F.array_join(F.transform("results", lambda r: F.concat(r["test_key"], F.lit("="), F.round(r["value"], 2).cast("decimal(12,2)").cast("string"))), ",")
    return o.select("episode_id", "turn", "complaint", "age_years", "allergies", F.size("results").alias("n_results"), shown.alias("results"), r6("remaining").alias("remaining"), "turns_left")
