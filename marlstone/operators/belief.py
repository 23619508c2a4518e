"""Beliefs over labels from evidence: likelihood tables, posteriors, entropies,
ceilings, sequences and the choice of a next test.

A record whose evidence lies in one row (an array) gets its belief in one pass:
the fitted table (a number for each label and dim) goes to the tasks, which sum
and normalise whole Arrow batches; nothing is shuffled (:func:`beliefs`,
:func:`belief_sequences`).  Array functions would do the same inside the JVM, but
are interpreted, and took four times the CPU of a join.  Evidence that comes as
rows (key, dim, value) is joined with the table's rows and summed
(:func:`posteriors`, :func:`sequences`).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from math import pi
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from marlstone.functions.normal import once
from marlstone.operators.scoring import r6, weight
from marlstone.plans.config import DEFAULT
from marlstone.plans.registry import query
from marlstone.sources.views import table

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package

FLOOR = -700.0
MIN_SD = 0.001


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, truth, dim, value) of every component of each vector."""
    e = table(spark, sf_dir, "embeddings")
    parts = F.posexplode("embedding").alias("dim", "value")
    return e.select(F.col("vec_id").alias("key"), F.col("label").cast("int").alias("truth"), parts).withColumn("value", F.col("value").cast("double"))


def likelihoods(ev: DataFrame) -> DataFrame:
    """(dim, label, mean, sd) of every pair; deviations have a floor."""
    return ev.groupBy("dim", F.col("truth").alias("label")).agg(F.avg("value").alias("mean"), F.greatest(F.stddev_pop("value"), F.lit(MIN_SD)).alias("sd"))


def priors(ev: DataFrame) -> DataFrame:
    n = ev.where("dim = 0").groupBy(F.col("truth").alias("label")).agg(F.count(F.lit(1)).alias("k"))
    return n.select("label", (F.col("k") / F.sum("k").over(W.partitionBy())).alias("prior"))


def log_likelihood(value: Column) -> Column:
    z = (value - F.col("mean")) / F.col("sd")
    return -0.5 * z * z - F.ln("sd") - 0.5 * F.ln(F.lit(2 * pi))


def softmax(rows: DataFrame, keys: list[str], logit: str = "lp") -> DataFrame:
    """``rows`` with ``p``: the shifted, floored and normalised exponentials."""
    w = W.partitionBy(*keys)
    e = F.exp(F.greatest(F.col(logit) - F.max(logit).over(w), F.lit(FLOOR)))
    return rows.withColumn("e", e).withColumn("p", F.col("e") / F.sum("e").over(w)).drop("e")


def posteriors(ev: DataFrame) -> DataFrame:
    """(key, truth, label, p): log prior plus all log likelihoods."""
    j = ev.join(F.broadcast(likelihoods(ev)), "dim")
    ll = j.groupBy("key", "truth", "label").agg(F.sum(log_likelihood(F.col("value"))).alias("ll"))
    lp = ll.join(F.broadcast(priors(ev)), "label").withColumn("lp", F.col("ll") + F.ln("prior"))
    return softmax(lp, ["key"]).select("key", "truth", "label", "p")


def sequences(ev: DataFrame) -> DataFrame:
    """(key, truth, k, label, p) after k = 0, 1, ... observations; k = 0 is the
    prior.  One exchange by key serves both windows."""
    j = ev.join(F.broadcast(likelihoods(ev)), "dim").withColumn("ll", log_likelihood(F.col("value")))
    start = ev.where("dim = 0").select("key", "truth").join(F.broadcast(priors(ev)), F.lit(True)).select("key", "truth", "label", F.lit(0).alias("k"), F.ln("prior").alias("ll"))  # labels are a dimension
    rows = start.unionByName(j.select("key", "truth", "label", (F.col("dim") + 1).alias("k"), "ll")).repartition("key")
    lp = rows.withColumn("lp", F.sum("ll").over(W.partitionBy("key", "label").orderBy("k").rowsBetween(W.unboundedPreceding, 0)))
    return softmax(lp, ["key", "k"]).select("key", "truth", "k", "label", "p")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, truth, values): the same evidence as arrays."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("key"), F.col("label").cast("int").alias("truth"), F.col("embedding").cast("array<double>").alias("values")).where(F.size("values") > 0)


class Fitted(NamedTuple):
    """A fitted table: labels and log priors; means and deviations by (label, dim)."""

    labels: np.ndarray
    log_priors: np.ndarray
    mean: np.ndarray
    sd: np.ndarray

    def log_likelihoods(self, values: pa.ListArray) -> np.ndarray:
        """(record, label, dim); what a record lacks says nothing."""
        dims = self.mean.shape[1]
        given = values.flatten()
        flat = given.to_numpy(zero_copy_only=False).astype(float)
        if np.isfinite(flat).sum() != len(flat) - given.null_count:
            raise ValueError("evidence is not finite")
        sizes = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        v = np.full((len(sizes), dims), np.nan)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        v[np.repeat(np.arange(len(sizes)), sizes)[at < dims], at[at < dims]] = flat[at < dims]
        z = (v[:, None, :] - self.mean) / self.sd
        return np.nan_to_num(-0.5 * z * z - np.log(self.sd) - 0.5 * np.log(2 * pi), nan=0.0)

    def shares(self, logits: np.ndarray) -> np.ndarray:
        """Softmax over the labels, shifted and floored."""
        e = np.exp(np.maximum(logits - logits.max(axis=-1, keepdims=True), FLOOR))
        return e / e.sum(axis=-1, keepdims=True)

    def lists(self, p: np.ndarray) -> pa.ListArray:
        """Rows of shares as lists of (label, p)."""
        both = pa.StructArray.from_arrays([pa.array(np.tile(self.labels, len(p)), pa.int32()), pa.array(p.ravel())], names=["label", "p"])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * len(self.labels), pa.int32()), both)


def fitted(lik: DataFrame, pri: DataFrame) -> Fitted:
    """The table as numbers: labels times dims, both dimensions."""
    rows = lik.join(pri, "label").select("label", "dim", "mean", "sd", F.ln("prior").alias("lp")).orderBy("label", "dim").toArrow()
    labels, first = np.unique(rows["label"].to_numpy(), return_index=True)
    label, dim = np.searchsorted(labels, rows["label"].to_numpy()), rows["dim"].to_numpy()

    def grid(c: str) -> np.ndarray:
        """By (label, dim); a pair that was never seen says nothing."""
        out = np.full((len(labels), dim.max() + 1 if len(dim) else 0), np.nan)
        out[label, dim] = rows[c].to_numpy()
        return out

    return Fitted(labels, rows["lp"].to_numpy()[first], grid("mean"), grid("sd"))


#: Records taken at once: their numbers by label and value stay in a few megabytes.
SLICE = 128
SEQUENCE = StructField("sequence", ArrayType(ArrayType(StructType([StructField("label", IntegerType()), StructField("p", DoubleType())]))))


def sliced(rows: pa.Array | pa.RecordBatch) -> Iterator[pa.Array | pa.RecordBatch]:
    """``rows`` in order, ``SLICE`` at a time."""
    return (rows.slice(i, SLICE) for i in range(0, len(rows), SLICE))


def beliefs(records: DataFrame, model: Fitted) -> DataFrame:
    """``records`` (with values) and ``belief``, an array of (label, p) in the
    order of the labels; a value that is null says nothing."""

    def of(values: pa.Array) -> pa.Array:
        parts = [model.shares(model.log_priors + model.log_likelihoods(v).sum(axis=2)) for v in sliced(values)]
        return model.lists(np.concatenate([np.zeros((0, len(model.labels))), *parts]))

    return records.withColumn("belief", F.arrow_udf(of, "array<struct<label:int,p:double>>")("values"))


def belief_sequences(records: DataFrame, model: Fitted) -> DataFrame:
    """``records`` and ``sequence``: the beliefs after 0, 1, ... values.  A
    sequence is far larger than its record, so slices leave one by one."""

    def of(values: pa.Array) -> pa.Array:
        steps = np.cumsum(model.log_likelihoods(values), axis=2)
        logits = np.concatenate([np.zeros((*steps.shape[:2], 1)), steps], axis=2) + model.log_priors[:, None]
        p = model.shares(np.swapaxes(logits, 1, 2))
        per = model.lists(p.reshape(-1, p.shape[2]))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * p.shape[1], pa.int32()), per)

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in given:
            for part in sliced(b):
                yield pa.RecordBatch.from_arrays([*part.columns, of(part.column("values"))], names=[*part.schema.names, "sequence"])

    return records.mapInArrow(batches, StructType([*records.schema.fields, SEQUENCE]))


def _fitted(spark: SparkSession, sf_dir: str) -> Fitted:
    ev = evidence(spark, sf_dir)
    return fitted(likelihoods(ev), priors(ev))


def belief_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, truth, belief) of every record."""
    return beliefs(vectors(spark, sf_dir), _fitted(spark, sf_dir)).drop("values")


def posterior_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, truth, label, p): :func:`posteriors` without a shuffle."""
    return belief_rows(spark, sf_dir).select("key", "truth", F.inline("belief"))


def sequence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, truth, k, label, p): :func:`sequences` without a shuffle."""
    s = belief_sequences(vectors(spark, sf_dir), _fitted(spark, sf_dir)).select("key", "truth", F.posexplode("sequence").alias("k", "belief"))
    return s.select("key", "truth", "k", F.inline("belief"))


def row_entropy(belief: Column) -> Column:
    return -F.aggregate(belief, F.lit(0.0), lambda a, x: a + F.when(x["p"] > 0, x["p"] * F.ln(x["p"])).otherwise(0.0))


def expected_score(belief: Column) -> Column:
    """The expected severity-weighted Brier score of reporting a belief."""
    square = F.aggregate(belief, F.lit(0.0), lambda a, x: a + x["p"] * x["p"])
    return once(square, lambda s2: F.aggregate(belief, F.lit(0.0), lambda a, x: a + x["p"] * weight(1 + x["label"] % 4) * (0.9 - (s2 - 2 * x["p"] + 1))))


def entropy(p: Column) -> Column:
    return -F.sum(F.when(p > 0, p * F.ln(p)).otherwise(0.0))


EV = """ev AS (SELECT vec_id AS key, label::INT AS truth, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS value FROM embeddings)"""
LIK = f"""{EV},
lik AS (SELECT dim, truth AS label, avg(value) AS mean, greatest(stddev_pop(value), {MIN_SD}) AS sd FROM ev GROUP BY 1, 2),
pri AS (SELECT truth AS label, count(*) * 1.0e0 / sum(count(*)) OVER () AS prior FROM ev WHERE dim = 0 GROUP BY 1)"""
_LL = "-0.5 * ((value - mean) / sd) ** 2 - ln(sd) - 0.5 * ln(2 * pi())"
POST = f"""{LIK},
ll AS (SELECT key, truth, label, sum({_LL}) AS ll FROM ev JOIN lik USING (dim) GROUP BY 1, 2, 3),
lp AS (SELECT key, truth, label, ll + ln(prior) AS lp FROM ll JOIN pri USING (label)),
ex AS (SELECT *, exp(greatest(lp - max(lp) OVER (PARTITION BY key), {FLOOR})) AS e FROM lp),
post AS (SELECT key, truth, label, e / sum(e) OVER (PARTITION BY key) AS p FROM ex)"""
SEQ = f"""{LIK},
sr AS (SELECT key, truth, label, 0 AS k, ln(prior) AS ll FROM ev, pri WHERE dim = 0 UNION ALL SELECT key, truth, label, dim + 1, {_LL} FROM ev JOIN lik USING (dim)),
sl AS (SELECT *, sum(ll) OVER (PARTITION BY key, label ORDER BY k) AS lp FROM sr),
se AS (SELECT *, exp(greatest(lp - max(lp) OVER (PARTITION BY key, k), {FLOOR})) AS e FROM sl),
seq AS (SELECT key, truth, k, label, e / sum(e) OVER (PARTITION BY key, k) AS p FROM se)"""
_H = "-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END)"
_W = DEFAULT.weight_sql("1 + label % 4")


@query(f"WITH {LIK} SELECT dim, label, round(mean, 6) AS mean, round(sd, 6) AS sd FROM lik")
def bel_likelihood(spark, sf_dir):
    return likelihoods(evidence(spark, sf_dir)).select("dim", "label", r6("mean").alias("mean"), r6("sd").alias("sd"))


@query(f"WITH {LIK} SELECT label, round(prior, 6) AS prior, round(ln(prior), 6) AS log_prior FROM pri")
def bel_prior(spark, sf_dir):
    return priors(evidence(spark, sf_dir)).select("label", r6("prior").alias("prior"), r6(F.ln("prior")).alias("log_prior"))


@query(f"WITH {POST} SELECT key, label, round(p, 6) AS p FROM post")
def bel_posterior(spark, sf_dir):
    return posterior_rows(spark, sf_dir).select("key", "label", r6("p").alias("p"))


@query(f"WITH {SEQ} SELECT key, k, label, round(p, 6) AS p FROM seq")
def bel_sequence(spark, sf_dir):
    return sequence_rows(spark, sf_dir).select("key", "k", "label", r6("p").alias("p"))


@query(f"WITH {POST} SELECT key, round({_H}, 6) AS entropy FROM post GROUP BY key")
def bel_entropy(spark, sf_dir):
    return belief_rows(spark, sf_dir).select("key", r6(row_entropy(F.col("belief"))).alias("entropy"))


@query(f"WITH {SEQ}, h AS (SELECT key, k, {_H} AS h FROM seq GROUP BY 1, 2) SELECT k, round(avg(h), 6) AS mean_entropy FROM h GROUP BY k")
def bel_entropy_curve(spark, sf_dir):
    """Mean entropy after k observations."""
    return sequence_rows(spark, sf_dir).groupBy("key", "k").agg(entropy(F.col("p")).alias("h")).groupBy("k").agg(r6(F.avg("h")).alias("mean_entropy"))


def ceilings(post: DataFrame, score: Column | None = None) -> DataFrame:
    """(key, expected): the expected score of reporting the belief itself.  The
    rule is a column over (label, p, s2 = sum of squares); by default the
    severity-weighted Brier score, in closed form."""
    s2 = post.groupBy("key").agg(F.sum(F.col("p") * F.col("p")).alias("s2"))
    rule = weight(1 + F.col("label") % 4) * (0.9 - (F.col("s2") - 2 * F.col("p") + 1)) if score is None else score
    return post.join(s2, "key").groupBy("key").agg(F.sum(F.col("p") * rule).alias("expected"))


@query(f"WITH {POST}, q AS (SELECT *, sum(p * p) OVER (PARTITION BY key) AS s2 FROM post) SELECT key, round(sum(p * {_W} * (0.9 - (s2 - 2 * p + 1))), 6) AS expected, round(max(0.9 * {_W}), 6) AS hard FROM q GROUP BY key")
def bel_ceilings(spark, sf_dir):
    """Expected ceiling of each belief and the hard ceiling of any."""
    hard = F.array_max(F.transform("belief", lambda x: 0.9 * weight(1 + x["label"] % 4)))
    return belief_rows(spark, sf_dir).select("key", r6(expected_score(F.col("belief"))).alias("expected"), r6(hard).alias("hard"))


@query(f"WITH {SEQ}, h AS (SELECT key, k, sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) AS phi FROM seq GROUP BY 1, 2), d AS (SELECT *, phi - lag(phi) OVER (PARTITION BY key ORDER BY k) AS term FROM h) SELECT key, round({DEFAULT.shaping_scale} * sum(term), 6) AS plain, round({DEFAULT.shaping_scale} * sum(term * 0.9 ** (k - 1)), 6) AS discounted, round({DEFAULT.shaping_scale} * (max_by(phi, k) - min_by(phi, k)), 6) AS telescoped FROM d GROUP BY key")
def shape_terms(spark, sf_dir):
    """Potential shaping by negative entropy: summed, discounted, telescoped."""
    h = sequence_rows(spark, sf_dir).groupBy("key", "k").agg((-entropy(F.col("p"))).alias("phi"))
    d = h.withColumn("term", F.col("phi") - F.lag("phi").over(W.partitionBy("key").orderBy("k")))
    s = DEFAULT.shaping_scale
    return d.groupBy("key").agg(r6(s * F.sum("term")).alias("plain"), r6(s * F.sum(F.col("term") * F.pow(F.lit(0.9), F.col("k") - 1))).alias("discounted"), r6(s * (F.max_by("phi", "k") - F.min_by("phi", "k"))).alias("telescoped"))


@query(f"WITH {SEQ}, m AS (SELECT key, k, p > lag(p) OVER (PARTITION BY key ORDER BY k) AS rose FROM seq WHERE label = truth) SELECT key, round(coalesce(avg(rose::INT), 1), 6) AS fraction FROM m WHERE k > 0 GROUP BY key")
def process_fraction(spark, sf_dir):
    """Share of observations after which the truth's mass rose."""
    t = sequence_rows(spark, sf_dir).where("label = truth")
    m = t.withColumn("rose", F.col("p") > F.lag("p").over(W.partitionBy("key").orderBy("k")))
    return m.where("k > 0").groupBy("key").agg(r6(F.coalesce(F.avg(F.col("rose").cast("int")), F.lit(1.0))).alias("fraction"))


GRID, SEEN = 9, 4
COST = 0.5
MIN_GAIN = 0.15


def partial(records: DataFrame, model: Fitted) -> DataFrame:
    """``records`` of SEEN values or more, and ``belief`` after the first SEEN."""
    seen = records.where(F.size("values") >= SEEN).withColumns({"all": F.col("values"), "values": F.slice("values", 1, SEEN)})
    return beliefs(seen, model).withColumn("values", F.col("all")).drop("all")


def expected_entropies(records: DataFrame, model: Fitted) -> DataFrame:
    """(key, dim, eig): expected entropy after observing ``dim``, over a grid
    between the smallest and the largest mean.  Likelihoods are shifted at each
    grid point before they weigh it, as the rule has it.  A record is a row of
    the task's batch; nothing is shuffled."""
    lo, hi = np.fmin.reduce(model.mean, axis=0), np.fmax.reduce(model.mean, axis=0)
    x = lo + np.arange(GRID)[:, None, None] * (hi - lo) / (GRID - 1)  # grid, 1, dim
    z = (x - model.mean) / model.sd
    ll = -0.5 * z * z - np.log(model.sd) - 0.5 * np.log(2 * pi)
    points = np.nan_to_num(np.exp(ll - np.fmax.reduce(ll, axis=1, keepdims=True)), nan=0.0)  # grid, label, dim
    n_labels, dims = model.mean.shape

    def entropies(p: np.ndarray) -> np.ndarray:
        """(record, dim) of beliefs (record, label); NaN where nothing weighs."""
        total, top = np.zeros((len(p), dims)), np.zeros((len(p), dims))
        for l in points:
            w = p[:, :, None] * l
            s = w.sum(axis=1)
            wl = np.where(w > 0, w * np.log(np.where(w > 0, w, 1.0)), 0.0).sum(axis=1)
            # entropy of w / s from two sums: ln s - sum(w ln w) / s
            some = np.where(s > 0, s, 1.0)
            top += np.where(s > 0, s * (np.log(some) - wl / some), 0.0)
            total += np.where(s > 0, s, 0.0)
        return np.divide(top, total, out=np.full_like(top, np.nan), where=total > 0)

    def of(belief: pa.Array) -> pa.Array:
        parts = [entropies(b.flatten().field("p").to_numpy(zero_copy_only=False).reshape(-1, n_labels)) for b in sliced(belief)]
        flat = np.concatenate([np.zeros((0, dims)), *parts])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * dims, pa.int32()), pa.array(flat.ravel()))

    e = partial(records, model).select("key", F.posexplode(F.arrow_udf(of, "array<double>")("belief")).alias("dim", "eig"))
    return e.where(~F.isnan("eig"))


_EIG = f"""{SEQ}, bl AS (SELECT key, truth, label, p FROM seq WHERE k = {SEEN}),
gp AS (SELECT dim, label, g, -0.5 * ((lo + g * (hi - lo) / {GRID - 1} - mean) / sd) ** 2 - ln(sd) - 0.5 * ln(2 * pi()) AS ll FROM (SELECT *, min(mean) OVER (PARTITION BY dim) AS lo, max(mean) OVER (PARTITION BY dim) AS hi FROM lik), (SELECT unnest(range({GRID})) AS g)),
gl AS (SELECT dim, label, g, exp(ll - max(ll) OVER (PARTITION BY dim, g)) AS l FROM gp),
gw AS (SELECT key, dim, g, sum(p * l) AS s, sum(p * l * ln(p * l)) AS wl FROM bl JOIN gl USING (label) WHERE p * l > 0 GROUP BY 1, 2, 3),
eig AS (SELECT key, dim, sum(s * (ln(s) - wl / s)) / sum(s) AS eig FROM gw GROUP BY 1, 2)"""


@query(f"WITH {_EIG} SELECT key, dim, round(eig, 6) AS eig FROM eig")
def eig(spark, sf_dir):
    return expected_entropies(vectors(spark, sf_dir), _fitted(spark, sf_dir)).select("key", "dim", r6("eig").alias("eig"))


@query(f"WITH {_EIG} SELECT key, first(dim ORDER BY round(eig * sqrt(1 + dim), 9), dim) AS next_dim, round(min(eig * sqrt(1 + dim)), 6) AS score FROM eig WHERE dim >= {SEEN} AND 1 + dim <= 7 GROUP BY key")
def next_test(spark, sf_dir):
    """The affordable test not yet ordered with the least entropy times cost."""
    e = expected_entropies(vectors(spark, sf_dir), _fitted(spark, sf_dir)).where((F.col("dim") >= SEEN) & (1 + F.col("dim") <= 7))
    s = e.withColumn("score", F.col("eig") * F.pow(1.0 + F.col("dim"), COST))
    return s.groupBy("key").agg(F.min_by("dim", F.struct(F.round("score", 9), F.col("dim"))).alias("next_dim"), r6(F.min("score")).alias("score"))


def log_gains(ev: DataFrame, b: DataFrame) -> DataFrame:
    """(key, dim, gain): how much the truth's log posterior rises at the
    record's own value; ``b``: (key, truth, label, p) of what was believed."""
    j = ev.select("key", "dim", "value").join(F.broadcast(likelihoods(ev)), "dim").withColumn("ll", log_likelihood(F.col("value")))
    j = j.join(b, ["key", "label"]).withColumn("w", F.col("p") * F.exp(F.col("ll") - F.max("ll").over(W.partitionBy("key", "dim"))))
    hit = F.col("label") == F.col("truth")
    g = j.groupBy("key", "dim").agg(F.sum("w").alias("s"), F.max(F.when(hit, F.col("w"))).alias("t"), F.max(F.when(hit, F.col("p"))).alias("b"))
    return g.select("key", "dim", (F.ln(F.greatest(F.col("t") / F.col("s"), F.lit(1e-300))) - F.ln(F.greatest("b", F.lit(1e-300)))).alias("gain"))


def partial_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, truth, label, p) after the first SEEN observations."""
    return partial(vectors(spark, sf_dir), _fitted(spark, sf_dir)).select("key", "truth", F.inline("belief"))


def _log_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_gains(evidence(spark, sf_dir), partial_rows(spark, sf_dir))


_GAIN = f"""{SEQ}, bl AS (SELECT key, truth, label, p FROM seq WHERE k = {SEEN}), gx AS (SELECT ev.key, dim, label, {_LL} AS ll FROM ev JOIN lik USING (dim)),
gy AS (SELECT gx.key, dim, gx.label, bl.truth, p, p * exp(ll - max(ll) OVER (PARTITION BY gx.key, dim)) AS w FROM gx JOIN bl ON bl.key = gx.key AND bl.label = gx.label),
gain AS (SELECT key, dim, ln(greatest(max(w) FILTER (label = truth) / sum(w), 1e-300)) - ln(greatest(max(p) FILTER (label = truth), 1e-300)) AS gain FROM gy GROUP BY 1, 2)"""


@query(f"WITH {_GAIN} SELECT key, dim, round(gain, 6) AS gain FROM gain")
def log_gain(spark, sf_dir):
    return _log_gains(spark, sf_dir).select("key", "dim", r6("gain").alias("gain"))


@query(f"WITH {_GAIN}, b AS (SELECT key, max(round(gain / sqrt(1 + dim), 9)) AS best, first(dim ORDER BY round(gain / sqrt(1 + dim), 9) DESC, dim) AS d FROM gain WHERE dim >= {SEEN} GROUP BY key) SELECT key, CASE WHEN best >= {MIN_GAIN} THEN d END AS test, round(best, 6) AS best FROM b")
def hindsight_test(spark, sf_dir):
    """The most telling test per cost in hindsight; none below a least gain."""
    s = _log_gains(spark, sf_dir).where(F.col("dim") >= SEEN).withColumn("per", F.round(F.col("gain") / F.pow(1.0 + F.col("dim"), COST), 9))
    b = s.groupBy("key").agg(F.max("per").alias("best"), F.min_by("dim", F.struct(-F.col("per"), F.col("dim"))).alias("d"))
    return b.select("key", F.when(F.col("best") >= MIN_GAIN, F.col("d")).alias("test"), r6("best").alias("best"))


#: Tests ordered after which a record is reported, greedily and in hindsight.
STOP, STOP_HINDSIGHT = 6, 5


def affordable(rows: DataFrame) -> DataFrame:
    """``rows`` (key, dim, ...) whose test a record has not ordered and can pay.
    A record has ordered the first 4 + key % 4 and has 5 + key % 60 left."""
    had, left = SEEN + F.col("key") % 4, 5 + F.col("key") % 60
    return rows.withColumn("ordered", had).where((F.col("dim") >= had) & (1 + F.col("dim") <= left))


@query(f"WITH {_EIG}, a AS (SELECT *, {SEEN} + key % 4 AS ordered FROM eig WHERE dim >= {SEEN} + key % 4 AND 1 + dim <= 5 + key % 60), b AS (SELECT key, first(dim ORDER BY round(eig * sqrt(1 + dim), 9), dim) AS d FROM a WHERE ordered < {STOP} GROUP BY 1) SELECT k.key, d AS next_dim FROM (SELECT DISTINCT key FROM eig) k LEFT JOIN b USING (key)")
def next_test_budget(spark, sf_dir):
    """The next test of each record under its own budget and orders; none when
    it has ordered enough or can pay for none."""
    ev = evidence(spark, sf_dir)
    e = affordable(expected_entropies(vectors(spark, sf_dir), _fitted(spark, sf_dir))).where(F.col("ordered") < STOP)
    best = e.groupBy("key").agg(F.min_by("dim", F.struct(F.round(F.col("eig") * F.pow(1.0 + F.col("dim"), COST), 9), F.col("dim"))).alias("next_dim"))
    return ev.where("dim = 0").select("key").join(best, "key", "left")


@query(f"WITH {_GAIN}, a AS (SELECT *, {SEEN} + key % 4 AS ordered FROM gain WHERE dim >= {SEEN} + key % 4 AND 1 + dim <= 5 + key % 60), b AS (SELECT key, max(round(gain / sqrt(1 + dim), 9)) AS best, first(dim ORDER BY round(gain / sqrt(1 + dim), 9) DESC, dim) AS d FROM a WHERE ordered < {STOP_HINDSIGHT} GROUP BY 1) SELECT k.key, CASE WHEN best >= {MIN_GAIN} THEN d END AS test FROM (SELECT DISTINCT key FROM gain) k LEFT JOIN b USING (key)")
def hindsight_test_budget(spark, sf_dir):
    """The most telling test per cost in hindsight, within budget and orders."""
    ev = evidence(spark, sf_dir)
    g = affordable(_log_gains(spark, sf_dir)).where(F.col("ordered") < STOP_HINDSIGHT).withColumn("per", F.round(F.col("gain") / F.pow(1.0 + F.col("dim"), COST), 9))
    b = g.groupBy("key").agg(F.max("per").alias("best"), F.min_by("dim", F.struct(-F.col("per"), F.col("dim"))).alias("d"))
    return ev.where("dim = 0").select("key").join(b.select("key", F.when(F.col("best") >= MIN_GAIN, F.col("d")).alias("test")), "key", "left")
