"""What runs leave behind: manifests, training sets, results and step metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marlstone.sources.episode_log import drifted, undeclared

#: Fields that two runs must agree on to be one run's log.
IDENTITY = ("run_id", "config_hash", "menu_fingerprint", "label_fingerprint", "prices_hash")
#: Tags too bulky to be stored with an episode.
BULKY = ("generations", "logprobs", "prompt")
METRICS = ("reward", "loss", "kl", "n_tests")


def write_manifest(spark: SparkSession, path: str, **fields: str) -> None:
    """One row a run; a missing identity field is an error."""
    missing = [k for k in IDENTITY if not fields.get(k)]
    if missing:
        raise ValueError(f"a manifest needs {', '.join(missing)}")
    spark.createDataFrame([{k: str(v) for k, v in fields.items()}]).select(*sorted(fields)).coalesce(1).write.mode("error").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(field, value) of a run's identity; a manifest without one is an error."""
    rows = spark.read.schema(", ".join(f"{k} string" for k in IDENTITY)).option("mode", "FAILFAST").json(path)
    value = lambda k: F.when(F.col(k).isNotNull(), F.col(k)).otherwise(F.raise_error(F.lit(f"the manifest lacks {k}")))
    return rows.select(F.inline(F.array(*[F.struct(F.lit(k).alias("field"), value(k).alias("value")) for k in IDENTITY])))


def compatible(spark: SparkSession, path: str, other: str) -> None:
    """Raise unless two runs agree in every identity field but the run's id."""
    rows = lambda p: read_manifest(spark, p).where("field <> 'run_id'")
    bad = drifted(rows(path), rows(other)).orderBy("field").collect()  # a row a field
    if bad:
        raise ValueError("runs differ in " + ", ".join(r.field for r in bad))


def slim(tags: Column) -> Column:
    """A map of tags without its bulky ones."""
    return F.map_filter(tags, lambda k, _: ~k.isin(*BULKY))


def append_run(rows: DataFrame, declared: DataFrame, path: str) -> None:
    """Append a run's episodes to its own partition, without bulky tags, in the
    order of patient and seed inside each file; an undeclared configuration is
    an error and nothing is written."""
    bad = undeclared(rows, declared).limit(3).collect()
    if bad:
        raise ValueError(f"undeclared configurations: {[r.config_hash for r in bad]}")
    t = rows.withColumn("tags", slim(F.col("tags")))
    t.sortWithinPartitions("run_id", "trajectory.patient_id", "trajectory.seed").write.mode("append").partitionBy("run_id").json(path)


def write_training_set(examples: DataFrame, path: str) -> None:
    """One compact JSON object a line, keys in order; nulls are left out."""
    examples.select(F.to_json(F.struct(*sorted(examples.columns))).alias("value")).write.mode("error").text(path)


def read_training_set(spark: SparkSession, path: str, schema: str, **defaults: object) -> DataFrame:
    """Examples with defaults for optional fields; a malformed line is an error."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return rows.fillna(defaults) if defaults else rows


def write_results(summary: DataFrame, path: str) -> None:
    """A run's summary (a few rows) as one file."""
    summary.coalesce(1).write.mode("error").json(path)


def read_metrics(spark: SparkSession, path: str, names: tuple[str, ...] = METRICS) -> DataFrame:
    """(step, metrics...) of a step log in order; a metric that a line lacks is
    NaN, so that it is seen and never taken for 0."""
    rows = spark.read.schema("step long, " + ", ".join(f"{n} double" for n in names)).option("mode", "FAILFAST").json(path)
    return rows.select("step", *[F.coalesce(n, F.lit(float("nan"))).alias(n) for n in names]).orderBy("step")
