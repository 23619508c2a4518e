"""Labels drawn from each record's own belief, as the null of a leak check: a
truth that is named no more often than a draw from what could be seen was not
given away.  A draw is one uniform number against the belief's running sum,
inside the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marlstone.functions.normal import once
from marlstone.operators.belief import POST, belief_rows
from marlstone.operators.evaluation import uniform
from marlstone.operators.scoring import r6
from marlstone.plans.registry import query

#: Labels that a trace names: the first of the belief it was written from.
NAMED = 3


def drawn_from(belief: Column, u: Column) -> Column:
    """The label of a belief (an array of (label, p)) at which its running sum
    reaches ``u``; rounding at the end of the sum falls to the last label."""
    start = F.struct(F.lit(0.0).alias("c"), F.lit(None).cast("int").alias("label"))

    def step(a: Column, x: Column) -> Column:
        c = a["c"] + x["p"]
        return F.struct(c.alias("c"), F.coalesce(a["label"], F.when(c >= u, x["label"].cast("int"))).alias("label"))

    return once(belief, lambda b: F.coalesce(F.aggregate(b, start, step)["label"], F.element_at(b, -1)["label"].cast("int")))


def rank_of(belief: Column, label: Column) -> Column:
    """The place of a label in a belief by mass; of equals the smaller first."""
    mass = lambda b, c: F.round(F.get(F.filter(b, lambda x: x["label"] == c), F.lit(0))["p"], 12)
    ahead = lambda b, m: F.size(F.filter(b, lambda x: (F.round(x["p"], 12) > m) | ((F.round(x["p"], 12) == m) & (x["label"] < label))))
    return once(mass(belief, label), lambda m: ahead(belief, m)) + 1


def with_null(records: DataFrame, seed: int) -> DataFrame:
    """``records`` (key, truth, belief) with drawn, truth_rank and drawn_rank."""
    d = records.withColumn("drawn", drawn_from(F.col("belief"), uniform(seed, F.col("key"))))
    return d.withColumns({"truth_rank": rank_of(F.col("belief"), F.col("truth")), "drawn_rank": rank_of(F.col("belief"), F.col("drawn"))})


_NULL = f"""{POST}, rk AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round(p, 12) DESC, label) AS rank, sum(p) OVER (PARTITION BY key ORDER BY label) AS c FROM post),
u AS (SELECT DISTINCT key, ('0x' || substr(md5('19:' || key), 1, 13))::BIGINT::DOUBLE / {2.0**52} AS u FROM post),
dr AS (SELECT rk.key, truth, coalesce(min(label) FILTER (c >= u), max(label)) AS drawn FROM rk JOIN u USING (key) GROUP BY 1, 2),
nl AS (SELECT dr.*, t.rank AS truth_rank, d.rank AS drawn_rank FROM dr JOIN rk t ON t.key = dr.key AND t.label = dr.truth JOIN rk d ON d.key = dr.key AND d.label = dr.drawn)"""


@query(f"WITH {_NULL} SELECT key, truth, drawn::INT AS drawn, truth_rank::INT AS truth_rank, drawn_rank::INT AS drawn_rank FROM nl")
def posterior_null(spark, sf_dir):
    """A label from each record's own belief, and the places of both labels."""
    return with_null(belief_rows(spark, sf_dir), 19).select("key", "truth", "drawn", "truth_rank", "drawn_rank")


def label_blind(nulls: DataFrame, named: int = NAMED) -> DataFrame:
    """(truth, n, truth_rate, null_rate, gap): how often a trace that names the
    first ``named`` labels of its belief names the truth, and the drawn label."""
    rate = lambda c: F.avg((F.col(c) <= named).cast("double"))
    g = nulls.groupBy("truth").agg(F.count(F.lit(1)).alias("n"), rate("truth_rank").alias("a"), rate("drawn_rank").alias("b"))
    return g.select("truth", "n", r6("a").alias("truth_rate"), r6("b").alias("null_rate"), r6(F.col("a") - F.col("b")).alias("gap"))


@query(f"WITH {_NULL}, g AS (SELECT truth, count(*) AS n, avg((truth_rank <= {NAMED})::INT) AS a, avg((drawn_rank <= {NAMED})::INT) AS b FROM nl GROUP BY 1) SELECT truth, n, round(a, 6) AS truth_rate, round(b, 6) AS null_rate, round(a - b, 6) AS gap FROM g")
def deleak_posterior(spark, sf_dir):
    """The gap by label between what is named and what a belief would name."""
    return label_blind(with_null(belief_rows(spark, sf_dir), 19))


@query(f"WITH {_NULL} SELECT truth_rank::INT AS rank, count(*) AS truths, (SELECT count(*) FROM nl x WHERE x.drawn_rank = nl.truth_rank) AS draws FROM nl GROUP BY 1, nl.truth_rank")
def null_ranks(spark, sf_dir):
    """How many truths and how many draws hold each place: where they differ,
    beliefs are not calibrated by rank."""
    n = with_null(belief_rows(spark, sf_dir), 19)
    places = n.select(F.explode(F.array(*[F.struct(F.col(c).alias("rank"), F.lit(c == "truth_rank").alias("own")) for c in ("truth_rank", "drawn_rank")])).alias("x"))
    g = places.groupBy("x.rank").agg(F.count_if("x.own").alias("truths"), F.count_if(~F.col("x.own")).alias("draws"))
    return g.where("truths > 0")
