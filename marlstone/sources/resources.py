"""Resources behind an allowlist that fails closed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marlstone.plans.registry import query
from marlstone.sources.views import table

BLOCKED = ("purchase",)
ALLOWED = {"click": ["k"], "view": ["k"], "signup": []}


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("event_type").alias("resource_type"), F.col("props").alias("body"))


def allowed_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources of allowed types with their allowed fields only.  Blocked
    types go, and so does every type that no list names."""
    r = _typed(spark, sf_dir).where(~F.col("resource_type").isin(*BLOCKED) & F.col("resource_type").isin(*ALLOWED))
    fields = F.create_map(*[x for t, f in ALLOWED.items() for x in (F.lit(t), F.array(*[F.lit(k) for k in f]).cast("array<string>"))])
    body = F.map_filter(F.from_json("body", "map<string,string>"), lambda k, _: F.array_contains(fields[F.col("resource_type")], k))
    return r.select("event_id", "resource_type", body.alias("body"))


@query("SELECT event_id, event_type AS resource_type, CASE WHEN event_type = 'signup' THEN '' ELSE coalesce('k=' || json_extract_string(props, '$.k'), '') END AS body FROM events WHERE event_type IN ('click', 'view', 'signup')")
def allowlist_filter(spark, sf_dir):
    r = allowed_resources(spark, sf_dir)
    return r.select("event_id", "resource_type", F.array_join(F.transform(F.map_entries("body"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("body"))


@query("SELECT event_type AS resource_type, count(*) AS n FROM events WHERE event_type NOT IN ('purchase', 'click', 'view', 'signup') OR event_type IS NULL GROUP BY 1")
def allowlist_unknown(spark, sf_dir):
    """What strict mode would stop at: types that no list names, or none."""
    r = _typed(spark, sf_dir)
    known = F.col("resource_type").isin(*BLOCKED, *ALLOWED)
    return r.where(~F.coalesce(known, F.lit(False))).groupBy("resource_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS overlap FROM (SELECT DISTINCT event_type FROM events WHERE event_type = 'purchase' INTERSECT SELECT DISTINCT event_type FROM events WHERE event_type IN ('click', 'view', 'signup'))")
def allowlist_disjoint(spark, sf_dir):
    t = _typed(spark, sf_dir).select("resource_type")
    return t.where(F.col("resource_type").isin(*BLOCKED)).intersect(t.where(F.col("resource_type").isin(*ALLOWED))).agg(F.count(F.lit(1)).alias("overlap"))


def strictly(rows: DataFrame) -> DataFrame:
    """``rows`` (event_id, resource_type, body); a type that no list names, or
    none, is an error."""
    known = F.coalesce(F.col("resource_type").isin(*BLOCKED, *ALLOWED), F.lit(False))
    return rows.withColumn("resource_type", F.when(known, F.col("resource_type")).otherwise(F.raise_error(F.concat(F.lit("unknown resource type "), F.coalesce("resource_type", F.lit("null"))))))


#: Type, display, unit, and reference range of numbers.
CATALOGUE = (("click", "Clicks", "n", 10.0, 60.0), ("view", "Views", "s", 5.0, 80.0), ("signup", "Sign-up", None, None, None), ("error", "Error", None, None, None), ("purchase", "Purchase", None, None, None))
_CATALOGUE_SQL = "cat(event_type, display, unit, low, high) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in r) + ")" for r in CATALOGUE) + ")"


@query(f"WITH {_CATALOGUE_SQL} SELECT event_id, display, unit, CASE WHEN low IS NOT NULL THEN round_even(value / 7, 4) END AS value_number, CASE WHEN low IS NULL THEN event_type END AS value_code, low AS ref_low, high AS ref_high FROM events JOIN cat USING (event_type)")
def allowlist_typed_result(spark, sf_dir):
    """Exactly one of a number (to four decimals) and a code; display, unit and
    range come from the catalogue, never from the record."""
    cat = spark.createDataFrame(list(CATALOGUE), "event_type string, display string, unit string, low double, high double")
    e = table(spark, sf_dir, "events").join(F.broadcast(cat), "event_type")
    number = F.col("low").isNotNull()
    return e.select("event_id", "display", "unit", F.when(number, F.bround(F.col("value") / 7, 4)).alias("value_number"), F.when(~number, F.col("event_type")).alias("value_code"), F.col("low").alias("ref_low"), F.col("high").alias("ref_high"))


@query("SELECT user_id, count(*) AS n, string_agg(event_type || ':' || k, ',' ORDER BY event_type, k) AS results, count(DISTINCT event_type) AS kinds FROM (SELECT user_id, event_type, coalesce(json_extract_string(props, '$.k'), '') AS k FROM events WHERE event_type IN ('click', 'view')) GROUP BY 1")
def observation(spark, sf_dir):
    """What a reader of a record may see: its allowed results, sorted."""
    e = table(spark, sf_dir, "events").where("event_type IN ('click', 'view')")
    k = F.coalesce(F.get_json_object("props", "$.k"), F.lit(""))
    rows = F.sort_array(F.collect_list(F.struct("event_type", k.alias("k"))))
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(rows, lambda r: F.concat(r["event_type"], F.lit(":"), r["k"])), ",").alias("results"), F.count_distinct("event_type").alias("kinds"))
