"""Deterministic splits, guards and draws.  Every draw is a hash of a seed and a
row's own key, so results do not depend on partitions or order."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from marlstone.functions.normal import normal_quantile
from marlstone.operators.evaluation import uniform
from marlstone.operators.ordering import lowest
from marlstone.plans.registry import query
from marlstone.sources.views import ctes, table, view

SEED, FRACTION, HELD_OUT = 11, 0.2, ("de", "es")


def order_key(seed: int, key: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")), 256)


def split(docs: DataFrame, fraction: float = FRACTION, seed: int = SEED) -> DataFrame:
    """(doc_id, split): held-out languages, a seeded share for evaluation and
    the rest for training."""
    if not 0 < fraction < 1:
        raise ValueError("the fraction must lie in (0, 1)")
    ids = docs.select("doc_id", "lang")
    held, rest = ids.where(F.col("lang").isin(*HELD_OUT)), ids.where(~F.coalesce(F.col("lang").isin(*HELD_OUT), F.lit(False)))
    n = rest.agg(F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * F.lit(fraction))).cast("long").alias("n"))
    rows = rest.join(F.broadcast(n), F.lit(True))  # one row
    chosen = lowest(rows, F.col("n"), order_key(seed, F.col("doc_id")), "doc_id").select("doc_id", F.lit(True).alias("chosen"))
    j = rest.join(chosen, "doc_id", "left").select("doc_id", F.when(F.col("chosen"), "eval").otherwise("train").alias("split"))
    return j.unionByName(held.select("doc_id", F.lit("holdout").alias("split")))


SPLIT = f"""rest AS (SELECT doc_id FROM documents WHERE lang NOT IN {HELD_OUT}), hs AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('{SEED}:' || doc_id), doc_id) AS i, count(*) OVER () AS n FROM rest),
split AS (SELECT doc_id, CASE WHEN i <= greatest(1, round_even(n * {FRACTION}, 0)) THEN 'eval' ELSE 'train' END AS split FROM hs UNION ALL SELECT doc_id, 'holdout' FROM documents WHERE lang IN {HELD_OUT})"""


@query(f"WITH {SPLIT} SELECT doc_id, split FROM split")
def split_ids(spark, sf_dir):
    return split(table(spark, sf_dir, "documents"))


def manifest(parts: DataFrame) -> DataFrame:
    """(split, n, ids_sha256): each part's canonical hash.  Ids are hashed in
    blocks (three digits of their md5), sorted inside; the part's hash is that
    of its blocks' hashes in order, so no task holds a part's ids."""
    ids = parts.select("split", F.col("doc_id").cast("string").alias("id")).withColumn("block", F.substring(F.md5("id"), 1, 3))
    blocks = ids.groupBy("split", "block").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.to_json(F.array_sort(F.collect_list("id"))), 256).alias("h"))
    return blocks.groupBy("split").agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "h"))), lambda x: x["h"]), ""), 256).alias("ids_sha256"))


_BLOCKS = "bk AS (SELECT split, substr(md5(doc_id::VARCHAR), 1, 3) AS block, count(*) AS n, sha256('[' || string_agg('\"' || doc_id || '\"', ',' ORDER BY doc_id::VARCHAR) || ']') AS h FROM split GROUP BY 1, 2), mf AS (SELECT split, sum(n)::BIGINT AS n, sha256(string_agg(h, '' ORDER BY block)) AS ids_sha256 FROM bk GROUP BY 1)"


@query(f"WITH {SPLIT}, {_BLOCKS} SELECT * FROM mf")
def split_freeze(spark, sf_dir):
    """Counts and the canonical hash of each part's ids."""
    return manifest(split(table(spark, sf_dir, "documents")))


PROVENANCE = ("seed", "fraction", "held_out", "algorithm")


def provenance(**given: object) -> dict[str, str]:
    """What a frozen split must say of its making; a missing key is an error."""
    missing = [k for k in PROVENANCE if given.get(k) in (None, "")]
    if missing:
        raise ValueError(f"a frozen split needs {', '.join(missing)}")
    return {k: str(given[k]) for k in PROVENANCE}


def split_drifted(frozen: DataFrame, now: DataFrame) -> DataFrame:
    """(split, field, frozen, now) of what differs between two manifests."""
    fields = lambda m, c: m.select("split", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(c)) for f in ("n", "ids_sha256")])))
    j = fields(frozen, "frozen").join(fields(now, "now"), ["split", "field"], "full_outer")
    return j.where(~F.col("frozen").eqNullSafe(F.col("now")))


_SPLIT_OF = lambda t: SPLIT.replace("FROM documents", f"FROM {t}")


@query(f"WITH {SPLIT}, {_BLOCKS}, documents2 AS (SELECT * FROM documents WHERE n_chars >= 300), {re.sub(r'(?<![a-z_])(rest|hs|split)(?![a-z_])', r'\1_2', _SPLIT_OF('documents2')).replace('AS split_2', 'AS split')}, {re.sub(r'(?<![a-z_])(bk|mf)(?![a-z_])', r'\1_2', _BLOCKS).replace('FROM split', 'FROM split_2')}, o AS (SELECT split, unnest(['n', 'ids_sha256']) AS field, unnest([n::VARCHAR, ids_sha256]) AS frozen FROM mf), p AS (SELECT split, unnest(['n', 'ids_sha256']) AS field, unnest([n::VARCHAR, ids_sha256]) AS now FROM mf_2) SELECT split, field, frozen, now FROM o FULL JOIN p USING (split, field) WHERE frozen IS DISTINCT FROM now")
def split_drift(spark, sf_dir):
    """A frozen split against the one that a changed corpus gives."""
    d = table(spark, sf_dir, "documents")
    return split_drifted(manifest(split(d)), manifest(split(d.where("n_chars >= 300"))))


@query(f"WITH {SPLIT}, p AS (SELECT split, count(*) AS n, bit_xor(('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT) AS fingerprint FROM split GROUP BY 1) SELECT * FROM p")
def split_fingerprint(spark, sf_dir):
    """The same check without collecting ids: an order-free fingerprint."""
    s = split(table(spark, sf_dir, "documents"))
    x = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 15), 16, 10).cast("long")
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(x).alias("fingerprint"))


@query(f"WITH {SPLIT}, a AS (SELECT doc_id, count(DISTINCT split) AS k FROM split GROUP BY 1) SELECT count(*)::BIGINT AS overlapping FROM a WHERE k > 1")
def split_overlap(spark, sf_dir):
    s = split(table(spark, sf_dir, "documents"))
    return s.groupBy("doc_id").agg(F.count_distinct("split").alias("k")).where("k > 1").agg(F.count(F.lit(1)).alias("overlapping"))


def guarded(requested: DataFrame, evaluation: DataFrame) -> DataFrame:
    """The requested ids that training must not read (there must be none)."""
    return requested.join(evaluation.select("doc_id"), "doc_id", "left_semi")


@query(f"WITH {SPLIT} SELECT doc_id FROM split WHERE split = 'eval' AND doc_id IN (SELECT doc_id FROM labels)")
def split_guard(spark, sf_dir):
    """Labelled documents that training must not ask for."""
    s = split(table(spark, sf_dir, "documents"))
    return guarded(table(spark, sf_dir, "labels").select("doc_id").distinct(), s.where("split = 'eval'"))


DEV = 32


@query(f"WITH {SPLIT}, t AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('5:' || doc_id), doc_id) AS i FROM split WHERE split = 'train') SELECT doc_id, CASE WHEN i <= {DEV} THEN 'dev' ELSE 'pool' END AS part FROM t")
def dev_set(spark, sf_dir):
    """A fixed development set out of training, and the pool that is left."""
    t = split(table(spark, sf_dir, "documents")).where("split = 'train'").select("doc_id")
    dev = lowest(t, F.lit(DEV), order_key(5, F.col("doc_id")), "doc_id")
    return dev.select("doc_id", F.lit("dev").alias("part")).unionByName(t.join(dev, "doc_id", "left_anti").select("doc_id", F.lit("pool").alias("part")))


@query(f"WITH {SPLIT}, t AS (SELECT doc_id, step, row_number() OVER (PARTITION BY step ORDER BY sha256(step || ':' || doc_id), doc_id) AS i FROM split, (SELECT unnest(range(4)) AS step) WHERE split = 'train') SELECT step, doc_id FROM t WHERE i <= 8")
def batches(spark, sf_dir):
    """Eight training ids for each of four steps, drawn without replacement."""
    t = split(table(spark, sf_dir, "documents")).where("split = 'train'").select("doc_id")
    parts = [lowest(t, F.lit(8), order_key(step, F.col("doc_id")), "doc_id").select(F.lit(step).cast("long").alias("step"), "doc_id") for step in range(4)]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("SELECT doc_id, sha256('3:' || doc_id) AS place FROM documents")
def shuffle_order(spark, sf_dir):
    """A seeded shuffle as a sort key: a range sort by it needs no single task."""
    return table(spark, sf_dir, "documents").select("doc_id", order_key(3, F.col("doc_id")).alias("place"))


def drawn(rows: DataFrame, prior: DataFrame, seed: int, key: str) -> DataFrame:
    """``rows`` with a label drawn from ``prior`` (label, p) by inverse CDF; the
    bounds are an array of one row, searched inside each row."""
    w = W.orderBy("label").rowsBetween(W.unboundedPreceding, 0)  # one row a label
    bounds = prior.withColumn("c", F.sum("p").over(w)).agg(F.sort_array(F.collect_list(F.struct("c", "label"))).alias("b"))
    u = uniform(seed, F.col(key))
    j = rows.join(F.broadcast(bounds), F.lit(True)).withColumn("u", u)
    hit = F.coalesce(F.get(F.filter("b", lambda x: x["c"] >= F.col("u")), F.lit(0)), F.element_at("b", -1))
    return j.withColumn("drawn", hit["label"]).drop("b")


_PRI = "pr AS (SELECT lang AS label, count(*) * 1.0e0 / sum(count(*)) OVER () AS p FROM documents GROUP BY 1), cd AS (SELECT label, sum(p) OVER (ORDER BY label) AS c FROM pr)"


@query(f"WITH {_PRI}, u AS (SELECT doc_id, ('0x' || substr(md5('7:' || doc_id), 1, 13))::BIGINT::DOUBLE / {2.0**52} AS u FROM documents) SELECT doc_id, round(u, 9) AS u, coalesce((SELECT min(label) FROM cd WHERE c >= u), (SELECT max(label) FROM cd)) AS drawn FROM u")
def draw_labels(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    prior = d.groupBy(F.col("lang").alias("label")).agg(F.count(F.lit(1)).alias("k")).withColumn("p", F.col("k") / F.sum("k").over(W.partitionBy())).select("label", "p")
    return drawn(d.select("doc_id"), prior, 7, "doc_id").select("doc_id", F.round("u", 9).alias("u"), "drawn")


BUDGETS = ((10.0, 0.2), (25.0, 0.2), (50.0, 0.25), (100.0, 0.2), (200.0, 0.15))
_CUM = [(b, round(sum(p for _, p in BUDGETS[: i + 1]), 6)) for i, (b, _) in enumerate(BUDGETS)]
_BUDGET_SQL = "CASE " + " ".join(f"WHEN u < {c} THEN {b}" for b, c in _CUM[:-1]) + f" ELSE {_CUM[-1][0]} END::DOUBLE"


@query(f"WITH {ctes('episode')}, u AS (SELECT DISTINCT patient_id, ('0x' || substr(md5('9:' || patient_id), 1, 13))::BIGINT::DOUBLE / {2.0**52} AS u FROM episode) SELECT patient_id, {_BUDGET_SQL} AS budget FROM u")
def draw_budgets(spark, sf_dir):
    """One budget a patient from a mixture, shared by all of its samples."""
    p = view(spark, sf_dir, "episode").select("patient_id").distinct().withColumn("u", uniform(9, F.col("patient_id")))
    out = F.when(F.col("u") < _CUM[0][1], _CUM[0][0])
    for b, c in _CUM[1:-1]:
        out = out.when(F.col("u") < c, b)
    return p.select("patient_id", out.otherwise(_CUM[-1][0]).alias("budget"))


@query("SELECT c_custkey AS patient_id, i AS sample, c_custkey * 1000 + i AS seed FROM customer, (SELECT unnest(range(4)) AS i)")
def k_slots(spark, sf_dir):
    """Four sample slots a patient, each with its own seed."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("patient_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("sample"))
    return c.withColumn("seed", F.col("patient_id") * 1000 + F.col("sample"))


@query()
def synth_table(spark, sf_dir):
    """A seeded table of stand-in records, one a customer: label by the id's last
    digit, age by the inverse normal CDF clipped to 0..100, sex uniform."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    age = 52 + 21 * normal_quantile(uniform(1, F.col("id"), "age"))
    return c.select("id", F.least(F.greatest(F.round(age), F.lit(0.0)), F.lit(100.0)).cast("int").alias("age"), F.when(uniform(1, F.col("id"), "sex") < 0.5, "female").otherwise("male").alias("sex"), F.concat(F.lit("label_"), (F.col("id") % 10).cast("string")).alias("label"))
