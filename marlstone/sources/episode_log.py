"""The append-only episode log: fail-closed reading, guarded appending, manifests,
dimension checks and content-hashed menus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marlstone.operators.ordering import ranked_by
from marlstone.plans.config import DEFAULT
from marlstone.plans.registry import query
from marlstone.sources.views import ctes, table, view

STORED = "trajectory struct<patient_id:bigint,seed:bigint,config_hash:string,budget:double,termination_reason:string,steps:array<struct<turn:int,kind:string,test_key:string,cost_charged:double>>>, ground_truth struct<condition:string,patient_id:bigint>, tags map<string,string>"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Stored episodes, fail-closed: malformed JSON and rows without a
    trajectory or a ground truth are errors; blank lines are skipped."""
    return whole_rows(spark.read.schema(STORED).option("mode", "FAILFAST").json(path))


def tail_log(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream over the runs' partitions (run_id=...), file by file.
    A malformed line stops it; once the file is repaired a restart with the same
    checkpoint reads that batch again and goes on, so nothing is lost or read
    twice."""
    return whole_rows(spark.readStream.schema(STORED + ", run_id string").option("mode", "FAILFAST").option("maxFilesPerTrigger", 100).json(path))


def whole_rows(rows: DataFrame) -> DataFrame:
    """``rows``; one without a trajectory or a ground truth is an error."""
    whole = F.col("trajectory").isNotNull() & F.col("ground_truth").isNotNull()
    return rows.withColumn("trajectory", F.when(whole, F.col("trajectory")).otherwise(F.raise_error(F.lit("a stored line lacks its trajectory or ground truth"))))


def diagnosed_log(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a log that cannot be read, with their text and file."""
    rows = spark.read.schema(STORED + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path).withColumn("file", F.input_file_name()).cache()
    return rows.where("_corrupt_record IS NOT NULL OR trajectory IS NULL OR ground_truth IS NULL").select("file", "_corrupt_record")


def undeclared(rows: DataFrame, declared: DataFrame) -> DataFrame:
    """Config hashes of incoming rows that the run has not declared."""
    return rows.select(F.col("trajectory.config_hash").alias("config_hash")).distinct().join(declared, "config_hash", "left_anti")


def append_log(rows: DataFrame, declared: DataFrame, path: str) -> None:
    """Append episodes, unless one has an undeclared configuration."""
    bad = undeclared(rows, declared).limit(3).collect()
    if bad:
        raise ValueError(f"undeclared configurations: {[r.config_hash for r in bad]}")
    rows.write.mode("append").json(path)


def drifted(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(field, stored, current) of a manifest's identity fields that differ."""
    j = stored.toDF("field", "stored").join(current.toDF("field", "current"), "field", "full_outer")
    return j.where(~F.col("stored").eqNullSafe(F.col("current")))


def model_safe(rows: DataFrame) -> DataFrame:
    """Trajectories alone: no column of the ground truth survives."""
    return rows.select("trajectory.*")


def stored_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes in their stored shape, from the supplied tables."""
    steps = view(spark, sf_dir, "charged").groupBy("episode_id").agg(F.sort_array(F.collect_list(F.struct(F.col("turn").cast("int").alias("turn"), "kind", "test_key", "cost_charged"))).alias("steps"))
    e = view(spark, sf_dir, "episode").join(steps, "episode_id", "left")
    none = F.array().cast("array<struct<turn:int,kind:string,test_key:string,cost_charged:double>>")
    t = F.struct("patient_id", F.col("seed"), F.lit(DEFAULT.hash()).alias("config_hash"), "budget", "termination_reason", F.coalesce("steps", none).alias("steps"))
    return e.select(t.alias("trajectory"), F.struct("condition", "patient_id").alias("ground_truth"), F.create_map(F.lit("policy"), F.col("policy")).alias("tags"))


@query(f"WITH {ctes('charged', 'episode')}, s AS (SELECT episode_id, count(*) AS n, sum(cost_charged) AS spent FROM charged GROUP BY 1) SELECT patient_id, seed, coalesce(n, 0) AS n_steps, round(coalesce(spent, 0), 6) AS spent, termination_reason FROM episode LEFT JOIN s USING (episode_id)")
def log_scan(spark, sf_dir):
    """Stored episodes through JSON text and back, as a log is read."""
    lines = stored_episodes(spark, sf_dir).select(F.to_json(F.struct("trajectory", "ground_truth", "tags")).alias("line"))
    rows = lines.select(F.from_json("line", STORED, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    spent = F.aggregate("steps", F.lit(0.0), lambda a, s: a + s["cost_charged"])
    return model_safe(rows).select("patient_id", "seed", F.size("steps").cast("long").alias("n_steps"), F.round(spent, 6).alias("spent"), "termination_reason")


def violations_of(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations): every rule's count, in one pass over the rows."""
    counts = rows.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])).alias("x")).select("x.*")


@query(f"WITH {ctes('charged')} SELECT 'price_positive' AS rule, count_if(NOT price > 0)::BIGINT AS violations FROM charged UNION ALL SELECT 'kind_known', count_if(kind NOT IN ('order_test', 'prescribe'))::BIGINT FROM charged UNION ALL SELECT 'charge_is_price_or_zero', count_if(NOT (cost_charged = price OR cost_charged = 0))::BIGINT FROM charged UNION ALL SELECT 'turn_positive', count_if(NOT turn >= 1)::BIGINT FROM charged UNION ALL SELECT 'bucket_known', count_if(prediction NOT IN ('low', 'normal', 'high'))::BIGINT FROM charged")
def contract_checks(spark, sf_dir):
    c = F.col
    return violations_of(view(spark, sf_dir, "charged"), {
        "price_positive": c("price") > 0, "kind_known": c("kind").isin("order_test", "prescribe"),
        "charge_is_price_or_zero": (c("cost_charged") == c("price")) | (c("cost_charged") == 0),
        "turn_positive": c("turn") >= 1, "bucket_known": c("prediction").isin("low", "normal", "high"),
    })


@query(f"WITH {ctes('step')}, t AS (SELECT DISTINCT test_key FROM step), d AS (SELECT 't' || i AS test_key FROM (SELECT unnest(range(73)) AS i)) SELECT 'unpriced' AS kind, count(*)::BIGINT AS n FROM t WHERE test_key NOT IN (SELECT test_key FROM d) UNION ALL SELECT 'orphan', count(*)::BIGINT FROM d WHERE test_key NOT IN (SELECT test_key FROM t)")
def dim_checks(spark, sf_dir):
    """Dangling and orphaned keys between steps and the price list."""
    t = view(spark, sf_dir, "step").select("test_key").distinct()
    d = spark.range(73).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("test_key"))
    n = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    return n(t.join(d, "test_key", "left_anti"), "unpriced").unionByName(n(d.join(t, "test_key", "left_anti"), "orphan"))


@query(f"WITH {ctes('step')}, k AS (SELECT DISTINCT 'test' AS kind, test_key AS key FROM step UNION SELECT DISTINCT 'treatment', treatment_key FROM step) SELECT kind, key, kind || ':' || substr(sha256(kind || '|' || key), 1, 16) AS action_id FROM k")
def menu(spark, sf_dir):
    """The global action menu with content-hashed ids."""
    s = view(spark, sf_dir, "step")
    k = s.select(F.lit("test").alias("kind"), F.col("test_key").alias("key")).union(s.select(F.lit("treatment"), F.col("treatment_key"))).distinct()
    return k.withColumn("action_id", F.concat("kind", F.lit(":"), F.substring(F.sha2(F.concat("kind", F.lit("|"), "key"), 256), 1, 16)))


@query(f"WITH {ctes('step')}, k AS (SELECT DISTINCT 'test' AS kind, test_key AS key FROM step UNION SELECT DISTINCT 'treatment', treatment_key FROM step), i AS (SELECT kind || ':' || substr(sha256(kind || '|' || key), 1, 16) AS id FROM k) SELECT sha256(string_agg(id, '|' ORDER BY id)) AS fingerprint, count(*) AS actions, (count(*) - count(DISTINCT id))::BIGINT AS collisions FROM i")
def menu_fingerprint(spark, sf_dir):
    m = menu(spark, sf_dir)
    return m.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("action_id")), "|"), 256).alias("fingerprint"), F.count(F.lit(1)).alias("actions"), (F.count(F.lit(1)) - F.count_distinct("action_id")).alias("collisions"))


@query("SELECT vec_id AS key, count(*) AS n_evidence, string_agg(dim, ',' ORDER BY dim) AS dims FROM (SELECT vec_id, unnest(range(len(embedding))) AS dim FROM embeddings) GROUP BY 1")
def evidence_assembly(spark, sf_dir):
    """Evidence of a record from three projections, later ones winning."""
    from marlstone.operators.belief import evidence

    ev = evidence(spark, sf_dir)
    parts = [ev.where("dim < 3").withColumn("o", F.lit(0)), ev.where("dim BETWEEN 2 AND 5").withColumn("o", F.lit(1)), ev.where("dim >= 5").withColumn("o", F.lit(2))]
    last = reduce(DataFrame.unionByName, parts).groupBy("key", "dim").agg(F.max_by("value", "o").alias("value"))
    return last.groupBy("key").agg(F.count(F.lit(1)).alias("n_evidence"), F.array_join(F.sort_array(F.collect_list("dim")), ",").alias("dims"))


@query("WITH b AS (SELECT c_custkey AS bundle, [c_custkey % 7, c_custkey % 11 + 3, c_custkey % 13] AS codes FROM customer), x AS (SELECT bundle, unnest(codes) AS code, unnest([0, 1, 2]) AS pos FROM b), m AS (SELECT * FROM x WHERE code < 10) SELECT b.bundle, first('label_' || code ORDER BY 1 + code % 4 DESC, pos) FILTER (code IS NOT NULL) AS label, CASE WHEN count(code) = 0 THEN 'no mapped condition' END AS error FROM b LEFT JOIN m USING (bundle) GROUP BY 1")
def bundle_ingest(spark, sf_dir):
    """Bundles of coded conditions to one label each: the most urgent mapped
    code, the first of equals; bundles without one are kept with a reason."""
    c = F.col("c_custkey")
    b = table(spark, sf_dir, "customer").select(c.alias("bundle"), F.to_json(F.struct(F.array(c % 7, c % 11 + 3, c % 13).alias("codes"))).alias("json"))
    x = b.select("bundle", F.posexplode(F.from_json("json", "codes array<bigint>")["codes"]).alias("pos", "code"))
    labels = view(spark, sf_dir, "label").select(F.col("idx").cast("long").alias("code"), "label", "urgency")
    best = x.join(F.broadcast(labels), "code").groupBy("bundle").agg(F.min_by("label", F.struct(-F.col("urgency"), F.col("pos"))).alias("label"))
    return b.select("bundle").join(best, "bundle", "left").withColumn("error", F.when(F.col("label").isNull(), F.lit("no mapped condition")))


@query("SELECT DISTINCT ON (custkey) c_custkey AS custkey, row_number() OVER (ORDER BY c_name) - 1 AS idx FROM customer")
def label_index(spark, sf_dir):
    """A dimension's canonical index: the rank of its sorted names."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), "c_name")
    return ranked_by(c, "c_name").select("custkey", F.col("place").alias("idx"))
