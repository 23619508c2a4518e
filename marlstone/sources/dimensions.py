"""Dimension tables with their rules: labels, catalogue, prices, treatments and
code maps.  A load is a table and a table of violations (rule, violations); the
strict form raises if there are any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from marlstone.plans.registry import query
from marlstone.sources.episode_log import violations_of
from marlstone.sources.views import SQL, ctes, table, view

SQL["label_dim"] = "SELECT n_name AS slug, CAST(n_regionkey AS INT) + 1 AS urgency, n_nationkey / 300.0e0 AS prior FROM {nation}"
SQL["catalog"] = """SELECT p_partkey AS analyte, p_name AS display, p_size AS low, p_size + p_partkey % 7 - 1 AS high, (p_partkey % 11) / 10.0e0 AS sd,
 0.8e0 + CASE WHEN p_partkey % 13 = 0 THEN 0.1e0 ELSE 0.2e0 END AS healthy FROM {part}"""
SQL["test_bridge"] = "SELECT concat('s', CAST(s_suppkey AS VARCHAR(20))) AS test_key, s_suppkey * 3 AS analyte FROM {supplier}"
SQL["price_list"] = "SELECT concat('s', CAST(s_suppkey AS VARCHAR(20))) AS test_key, CASE WHEN s_suppkey % 17 <> 0 THEN s_acctbal END AS price FROM {supplier}"
SQL["filed_rule"] = "SELECT concat('d', CAST(s_suppkey % 80 AS VARCHAR(20))) AS treatment_key, concat('label_', CAST(s_nationkey % 12 AS VARCHAR(20))) AS condition, CASE WHEN s_suppkey % 9 = 0 THEN '<=' ELSE '<' END AS op, s_acctbal / 10000.0e0 AS scale FROM {supplier}"
SQL["code_map"] = "SELECT DISTINCT c_nationkey AS code, concat('label_', CAST(c_nationkey % 12 AS VARCHAR(20))) AS label FROM {customer}"


def repeated(key: str) -> Column:
    """A row's key is another row's too."""
    return F.count(F.lit(1)).over(W.partitionBy(key)) > 1


def missing(rows: DataFrame, of: DataFrame, key: str, rule: str) -> DataFrame:
    """(rule, violations): distinct keys of ``rows`` that ``of`` lacks."""
    return rows.select(key).distinct().join(of.select(key), key, "left_anti").agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("violations"))


def strict(rows: DataFrame, violations: DataFrame) -> DataFrame:
    """``rows``, unless a rule is violated."""
    bad = violations.where("violations > 0").collect()  # one row a rule
    if bad:
        raise ValueError("; ".join(f"{r.rule}: {r.violations}" for r in bad))
    return rows


def label_violations(labels: DataFrame) -> DataFrame:
    c = F.col
    return violations_of(labels.withColumn("again", repeated("slug")), {"slug_unique": ~c("again"), "slug_given": F.coalesce(F.length("slug") > 0, F.lit(False)), "urgency_tier": c("urgency").between(1, 4), "prior_positive": c("prior") > 0})


@query(f"WITH {ctes('label_dim')} SELECT 'slug_unique' AS rule, (SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM label_dim GROUP BY slug HAVING count(*) > 1)) AS violations UNION ALL SELECT 'slug_given', count_if(slug IS NULL OR slug = '')::BIGINT FROM label_dim UNION ALL SELECT 'urgency_tier', count_if(urgency NOT BETWEEN 1 AND 4)::BIGINT FROM label_dim UNION ALL SELECT 'prior_positive', count_if(NOT prior > 0)::BIGINT FROM label_dim")
def label_checks(spark, sf_dir):
    return label_violations(view(spark, sf_dir, "label_dim"))


def catalog_violations(catalog: DataFrame, bridge: DataFrame) -> DataFrame:
    c = F.col
    own = violations_of(catalog.withColumn("again", repeated("display")), {"display_unique": ~c("again"), "bounds_increase": c("low") < c("high"), "sd_positive": c("sd") > 0, "healthy_sums_to_one": F.abs(c("healthy") - 1) <= 1e-9})
    return own.unionByName(missing(bridge, catalog, "analyte", "dangling_reference")).unionByName(missing(catalog, bridge, "analyte", "orphan_analyte"))


@query(f"WITH {ctes('catalog', 'test_bridge')} SELECT 'display_unique' AS rule, (SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM catalog GROUP BY display HAVING count(*) > 1)) AS violations UNION ALL SELECT 'bounds_increase', count_if(NOT low < high)::BIGINT FROM catalog UNION ALL SELECT 'sd_positive', count_if(NOT sd > 0)::BIGINT FROM catalog UNION ALL SELECT 'healthy_sums_to_one', count_if(abs(healthy - 1) > 1e-9)::BIGINT FROM catalog UNION ALL SELECT 'dangling_reference', count(DISTINCT analyte)::BIGINT FROM test_bridge WHERE analyte NOT IN (SELECT analyte FROM catalog) UNION ALL SELECT 'orphan_analyte', count(DISTINCT analyte)::BIGINT FROM catalog WHERE analyte NOT IN (SELECT analyte FROM test_bridge)")
def catalog_checks(spark, sf_dir):
    return catalog_violations(view(spark, sf_dir, "catalog"), view(spark, sf_dir, "test_bridge"))


def price_violations(prices: DataFrame, ordered: DataFrame) -> DataFrame:
    """No price is taken for granted: every test has one, above 0."""
    own = violations_of(prices.withColumn("again", repeated("test_key")), {"test_unique": ~F.col("again"), "price_given": F.col("price").isNotNull(), "price_positive": F.coalesce(F.col("price") > 0, F.lit(True))})
    return own.unionByName(missing(ordered, prices.where("price IS NOT NULL"), "test_key", "unpriced_test"))


@query(f"WITH {ctes('price_list')}, o AS (SELECT DISTINCT concat('s', l_suppkey) AS test_key FROM lineitem) SELECT 'test_unique' AS rule, (SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM price_list GROUP BY test_key HAVING count(*) > 1)) AS violations UNION ALL SELECT 'price_given', count_if(price IS NULL)::BIGINT FROM price_list UNION ALL SELECT 'price_positive', count_if(price <= 0)::BIGINT FROM price_list UNION ALL SELECT 'unpriced_test', count(*)::BIGINT FROM o WHERE test_key NOT IN (SELECT test_key FROM price_list WHERE price IS NOT NULL)")
def price_checks(spark, sf_dir):
    ordered = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("test_key"))
    return price_violations(view(spark, sf_dir, "price_list"), ordered)


def rule_violations(rules: DataFrame, drugs: DataFrame, labels: DataFrame) -> DataFrame:
    own = violations_of(rules, {"operator_known": F.col("op").isin("<", ">"), "scale_positive": F.col("scale") > 0})
    names = labels.select(F.col("label").alias("condition"))
    return own.unionByName(missing(rules, drugs, "treatment_key", "unknown_treatment")).unionByName(missing(rules, names, "condition", "unknown_condition"))


@query(f"WITH {ctes('filed_rule', 'drug', 'label')} SELECT 'operator_known' AS rule, count_if(op NOT IN ('<', '>'))::BIGINT AS violations FROM filed_rule UNION ALL SELECT 'scale_positive', count_if(NOT scale > 0)::BIGINT FROM filed_rule UNION ALL SELECT 'unknown_treatment', count(DISTINCT treatment_key)::BIGINT FROM filed_rule WHERE treatment_key NOT IN (SELECT treatment_key FROM drug) UNION ALL SELECT 'unknown_condition', count(DISTINCT condition)::BIGINT FROM filed_rule WHERE condition NOT IN (SELECT label FROM label)")
def rule_checks(spark, sf_dir):
    return rule_violations(view(spark, sf_dir, "filed_rule"), view(spark, sf_dir, "drug"), view(spark, sf_dir, "label"))


@query(f"WITH {ctes('code_map', 'label')} SELECT code, label FROM code_map WHERE label NOT IN (SELECT label FROM label)")
def code_map_checks(spark, sf_dir):
    """Codes whose target is no label (there must be none)."""
    return view(spark, sf_dir, "code_map").join(view(spark, sf_dir, "label").select("label"), "label", "left_anti").select("code", "label")


@query(f"WITH {ctes('code_map', 'label')}, x AS (SELECT c_custkey AS record, c_nationkey AS code FROM customer) SELECT code, count(*) AS records FROM x WHERE code NOT IN (SELECT code FROM code_map WHERE label IN (SELECT label FROM label)) GROUP BY 1")
def unmapped_codes(spark, sf_dir):
    """Codes of records that no label takes, put aside with their counts."""
    good = view(spark, sf_dir, "code_map").join(view(spark, sf_dir, "label").select("label"), "label", "left_semi")
    x = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("code"))
    return x.join(good.select("code"), "code", "left_anti").groupBy("code").agg(F.count(F.lit(1)).alias("records"))
