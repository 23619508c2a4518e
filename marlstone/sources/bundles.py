"""Bundles of nested JSON resources, one document a record, read to one typed row
each.  What cannot be read is kept with its error; a bad bundle never fails the
others.  The results of a bundle are not taken: which of them are there would
give its label away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marlstone.plans.registry import query
from marlstone.sources.views import SQL, table, view

RESOURCE = "struct<resourceType:string,id:string,gender:string,birthDate:string,code:struct<coding:array<struct<system:string,code:string>>>>"
BUNDLE = f"struct<entry:array<struct<resource:{RESOURCE}>>>"
#: The only system of codes that is read, and the ages that are kept.
SYSTEM, OLDEST = "snomed", 120

#: Codes that are mapped, and their labels.
SQL["coded"] = "SELECT DISTINCT CAST(p_size AS VARCHAR(20)) AS code, concat('label_', CAST(p_size % 10 AS VARCHAR(20))) AS label, CAST(1 + p_size % 4 AS INT) AS urgency FROM {part} WHERE p_size % 3 <> 0"


def parsed_bundles(files: DataFrame, codes: DataFrame, year: int) -> DataFrame:
    """``files`` (bundle, json) as bundle, label, age, sex, unmapped, error.

    The first Patient counts.  Of the mapped codes of its conditions the most
    urgent one labels the record, of equals the first.  error: 'malformed', 'no
    patient', 'no coded condition' or 'no mapped condition'; else null.  Ages are
    clamped to 0..``OLDEST``.  One pass: codes are a dimension in one row.
    """
    known = codes.agg(F.map_from_entries(F.collect_list(F.struct("code", F.struct("label", "urgency").alias("to")))).alias("known"))
    r = files.select("bundle", F.from_json("json", BUNDLE, {"mode": "PERMISSIVE"}).alias("b"), F.col("json").isNull().alias("none"))
    resources = F.filter(F.transform("b.entry", lambda e: e["resource"]), lambda x: x.isNotNull())
    r = r.select("bundle", F.col("b.entry").isNull().alias("bad"), resources.alias("res"))
    is_snomed = lambda c: F.contains(F.lower(F.coalesce(c["system"], F.lit(""))), F.lit(SYSTEM)) & c["code"].isNotNull()
    conditions = F.filter("res", lambda x: x["resourceType"] == "Condition")
    found = F.flatten(F.transform(conditions, lambda x: F.transform(F.filter(F.coalesce(x["code"]["coding"], F.array().cast("array<struct<system:string,code:string>>")), is_snomed), lambda c: c["code"])))
    r = r.select("bundle", "bad", F.get(F.filter("res", lambda x: x["resourceType"] == "Patient"), F.lit(0)).alias("patient"), found.alias("codes"))
    r = r.join(F.broadcast(known), F.lit(True))  # one row
    rank = lambda c, i: F.struct((-F.col("known")[c]["urgency"]).alias("u"), i.alias("i"), F.col("known")[c]["label"].alias("label"))
    best = F.array_min(F.filter(F.transform("codes", rank), lambda x: x["label"].isNotNull()))["label"]
    unmapped = F.array_sort(F.array_distinct(F.filter("codes", lambda c: F.col("known")[c].isNull())))
    born = F.try_to_number(F.substring("patient.birthDate", 1, 4), F.lit("9999")).cast("int")
    age = F.when(born.isNotNull(), F.least(F.greatest(F.lit(year) - born, F.lit(0)), F.lit(OLDEST)))  # else not known
    error = F.when(F.col("bad"), "malformed").when(F.col("patient").isNull(), "no patient").when(F.size("codes") == 0, "no coded condition").when(F.col("label").isNull(), "no mapped condition")
    r = r.select("bundle", "bad", "patient", "codes", best.alias("label"), unmapped.alias("unmapped"), age.alias("age"))
    r = r.withColumn("error", error)
    ok = lambda c: F.when(F.col("error").isNull(), c)
    return r.select("bundle", ok(F.col("label")).alias("label"), ok(F.col("age")).alias("age"), ok(F.col("patient.gender")).alias("sex"), F.when(~F.col("bad"), F.col("unmapped")).alias("unmapped"), "error")


def strict_bundles(files: DataFrame, codes: DataFrame, year: int) -> DataFrame:
    """The same rows; a bundle with an error is one."""
    p = parsed_bundles(files, codes, year)
    label = F.when(F.col("error").isNull(), F.col("label")).otherwise(F.raise_error(F.concat(F.lit("bundle "), F.col("bundle").cast("string"), F.lit(": "), F.col("error"))))
    return p.withColumn("label", label)


def event_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bundle, json): a bundle for each user of ``events``: their purchases and
    errors as conditions in order of time, coded by what the event's properties
    say; some lack a patient, some are cut off."""
    e = table(spark, sf_dir, "events").where("event_type IN ('purchase', 'error')")
    code = F.get_json_object("props", "$.k")
    system = F.when(F.col("event_type") == "purchase", "http://snomed.info/sct").otherwise("http://loinc.org")
    condition = F.struct(F.struct(F.lit("Condition").alias("resourceType"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("id"), F.lit(None).cast("string").alias("gender"), F.lit(None).cast("string").alias("birthDate"), F.struct(F.array(F.struct(system.alias("system"), code.alias("code"))).alias("coding")).alias("code")).alias("resource"))
    per = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", condition.alias("c")))), lambda x: x["c"]).alias("conditions"), F.count(F.lit(1)).alias("n"))
    no_code = F.lit(None).cast("struct<coding:array<struct<system:string,code:string>>>")
    born = F.concat((F.lit(1890) + F.col("user_id") % 140).cast("string"), F.lit("-02-03"))
    patient = F.struct(F.struct(F.lit("Patient").alias("resourceType"), F.col("user_id").cast("string").alias("id"), F.when(F.col("user_id") % 2 == 0, "female").otherwise("male").alias("gender"), born.alias("birthDate"), no_code.alias("code")).alias("resource"))
    entries = F.when(F.col("user_id") % 11 == 0, F.col("conditions")).otherwise(F.concat(F.array(patient), F.col("conditions")))
    json = F.to_json(F.struct(entries.alias("entry")))
    return per.select(F.col("user_id").alias("bundle"), F.when(F.col("user_id") % 13 == 0, F.substr(json, F.lit(1), F.length(json) - 3)).otherwise(json).alias("json"))


@query("""WITH c AS (SELECT user_id, event_id, event_type, json_extract_string(props, '$.k') AS code FROM events WHERE event_type IN ('purchase', 'error')),
k AS (SELECT DISTINCT p_size::VARCHAR AS code, 'label_' || (p_size % 10) AS label, 1 + p_size % 4 AS urgency FROM part WHERE p_size % 3 <> 0),
m AS (SELECT user_id, count_if(event_type = 'purchase' AND c.code IS NOT NULL) AS coded, first(label ORDER BY urgency DESC, event_id) FILTER (event_type = 'purchase' AND label IS NOT NULL) AS label,
  coalesce(string_agg(DISTINCT c.code, ',' ORDER BY c.code) FILTER (event_type = 'purchase' AND label IS NULL), '') AS unmapped FROM c LEFT JOIN k ON k.code = c.code GROUP BY 1),
x AS (SELECT *, CASE WHEN user_id % 13 = 0 THEN 'malformed' WHEN user_id % 11 = 0 THEN 'no patient' WHEN coded = 0 THEN 'no coded condition' WHEN label IS NULL THEN 'no mapped condition' END AS error FROM m)
SELECT user_id AS bundle, CASE WHEN error IS NULL THEN label END AS label, CASE WHEN error IS NULL THEN least(greatest(2024 - (1890 + user_id % 140), 0), 120)::INT END AS age,
 CASE WHEN error IS NULL THEN CASE WHEN user_id % 2 = 0 THEN 'female' ELSE 'male' END END AS sex, CASE WHEN error IS DISTINCT FROM 'malformed' THEN unmapped END AS unmapped, error FROM x""")
def bundle_parse(spark, sf_dir):
    """Records from bundles of resources, with what is wrong with the others."""
    p = parsed_bundles(event_bundles(spark, sf_dir), view(spark, sf_dir, "coded"), 2024)
    return p.withColumn("unmapped", F.array_join("unmapped", ","))
