"""Scores of stored episodes: every term is a grouped sum over an append-only
log, so a log can be scored again under other weights at any time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from marlstone.plans.config import DEFAULT, RewardConfig
from marlstone.plans.registry import query
from marlstone.sources.views import ctes, view

N_LABELS = 10
LOW, HIGH = 15.0, 35.0


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def weight(urgency: Column, cfg: RewardConfig = DEFAULT) -> Column:
    """Severity weight of an urgency tier; an unknown tier is an error."""
    return F.when(urgency == 1, cfg.weight_1).when(urgency == 2, cfg.weight_2).when(urgency == 3, cfg.weight_3).when(urgency == 4, cfg.weight_4).otherwise(F.raise_error(F.concat(F.lit("urgency "), urgency.cast("string"))))


def checked(reports: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries (episode_id, label, p) with the violation of each, or null: it
    names an unknown label, or its p is negative, not finite or missing."""
    known = F.broadcast(labels.select("label", F.lit(True).alias("known")))  # a dimension
    j = reports.join(known, "label", "left")
    p = F.col("p")
    kind = F.when(F.col("known").isNull(), "unknown_label").when(p.isNull() | F.isnan(p) | (F.abs(p) == float("inf")), "not_finite").when(p < 0, "negative")
    return j.select("episode_id", "label", kind.alias("violation"))


def report_violations(reports: DataFrame, labels: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(episode_id, label, violation) of the entries of :func:`checked` that have
    one; with ``asked`` (episode_id), also of episodes that have no entry at all."""
    bad = checked(reports, labels).where("violation IS NOT NULL")
    if asked is None:
        return bad
    none = asked.select("episode_id").join(reports, "episode_id", "left_anti")
    return bad.unionByName(none.select("episode_id", F.lit(None).cast("string").alias("label"), F.lit("empty").alias("violation")))


def stated(reports: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a report: episode_id, names (the sorted label set), ``named``
    (label, p) and ``share``, the mass of each label that is not named.

    Entries of a label add up; mass that was not named is spread over the labels
    not named; more than 1 is scaled down; all zero goes to the others.  An
    entry that :func:`report_violations` finds is an error.
    """
    every = labels.selectExpr("label").agg(F.expr("array_sort(collect_set(label))").alias("names"))  # one row
    known = F.broadcast(labels.selectExpr("label", "true AS known"))
    wrong = "known IS NULL OR p IS NULL OR isnan(p) OR abs(p) = double('infinity') OR p < 0"
    told = "concat('bad entry of a report: ', coalesce(label, 'null'), ' ', coalesce(CAST(p AS STRING), 'null'))"
    sure = reports.join(known, "label", "left").selectExpr("episode_id", "label", f"CASE WHEN {wrong} THEN CAST(raise_error({told}) AS DOUBLE) ELSE p END AS p")
    per = sure.repartition("episode_id").groupBy("episode_id", "label").agg(F.sum("p").alias("p"))  # one shuffle for both groups
    r = per.groupBy("episode_id").agg(F.expr("sum(p)").alias("total"), F.expr("count(1)").alias("k"), F.expr("sort_array(collect_list(struct(label, p)))").alias("named"))
    r = r.join(F.broadcast(every), F.lit(True)).selectExpr("*", "size(names) - k AS unnamed")
    down = "(total > 1 OR (unnamed = 0 AND total > 0))"
    scaled = f"CASE WHEN {down} THEN transform(named, x -> named_struct('label', x.label, 'p', x.p / total)) ELSE named END"
    nothing = "CAST(raise_error('a report that names every label gives none of them mass') AS array<struct<label:string,p:double>>)"
    share = f"CASE WHEN {down} OR unnamed = 0 THEN 0.0D WHEN total <= 0 THEN 1.0D / unnamed ELSE (1.0D - total) / unnamed END AS share"
    return r.selectExpr("episode_id", "names", f"CASE WHEN unnamed = 0 AND total <= 0 THEN {nothing} ELSE {scaled} END AS named", "unnamed", share)


def completed(reports: DataFrame, labels: DataFrame) -> DataFrame:
    """Partial reports (episode_id, label, p) as distributions over all labels;
    what rounding leaves of 1 goes to the largest entry."""
    r = stated(reports, labels)
    own = lambda x: F.coalesce(F.get(F.filter("named", lambda y: y["label"] == x), F.lit(0))["p"], F.col("share"))
    r = r.withColumn("full", F.transform("names", lambda x: F.struct(x.alias("label"), own(x).alias("p"))))
    r = r.withColumns({"drift": 1.0 - F.aggregate("full", F.lit(0.0), lambda a, x: a + x["p"]), "top": F.array_min(F.transform("full", lambda x: F.struct((-x["p"]).alias("p"), x["label"].alias("label"))))["label"]})
    r = r.select("episode_id", "drift", "top", F.inline("full"))
    return r.select("episode_id", "label", (F.col("p") + F.when(F.col("label") == F.col("top"), F.col("drift")).otherwise(0.0)).alias("p"))


def _mass(label: str) -> str:
    return f"coalesce(get(filter(named, x -> x.label = {label}), 0).p, CASE WHEN array_contains(names, {label}) THEN share END, 0.0D)"


def mass_on(label: str) -> Column:
    """The mass that a stated report puts on the label of a column; 0 without a
    report."""
    return F.expr(_mass(label))


def declared() -> Column:
    """The label with most mass in a stated report; of equals the first.  Labels
    that are not named are looked for only if their share can win."""
    first = "array_except(names, transform(named, x -> x.label))"
    rest = f"CASE WHEN size({first}) > 0 THEN array(named_struct('p', -share, 'label', get({first}, 0))) ELSE CAST(array() AS array<struct<p:double,label:string>>) END"
    own = "transform(named, x -> named_struct('p', -x.p, 'label', x.label))"
    return F.expr(f"CASE WHEN array_min({own}).p < -share THEN array_min({own}).label ELSE array_min(concat({own}, {rest})).label END")


def stated_brier(label: str) -> Column:
    """:func:`brier` of a stated report in closed form, for the label of a
    column: labels that are not named share one mass."""
    square = "aggregate(named, 0.0D, (a, x) -> a + x.p * x.p) + unnamed * share * share"
    return F.expr(f"(1.0D - 1.0D / size(names)) - ({square} - 2.0D * {_mass(label)} + 1.0D)")


def brier(p: Column, hit: Column, n: int = N_LABELS) -> Column:
    """Aggregate: shifted Brier score of a distribution, 0 for the uniform one."""
    return (1.0 - 1.0 / n) - (F.sum(p * p) - 2.0 * F.sum(F.when(hit, p).otherwise(0.0)) + 1.0)


def bucket(value: Column) -> Column:
    return F.when(value < LOW, "low").when(value > HIGH, "high").otherwise("normal")


def bucket_priors(charged: DataFrame) -> DataFrame:
    """(prediction, prior): how often a revealed value falls into a bucket."""
    b = charged.where("cost_charged > 0").groupBy(bucket(F.col("value_number")).alias("prediction")).agg(F.count(F.lit(1)).alias("k"))
    return b.select("prediction", (F.col("k") / F.sum("k").over(W.partitionBy())).alias("prior"))


BUCKETS = ("low", "normal", "high")


def facts(charged: DataFrame) -> DataFrame:
    """One row an episode: all numbers that any weights need of its steps.  The
    steps come partitioned by episode, so this is a pass without a further
    shuffle, and numbers alone are summed in compiled code.  Expressions are SQL
    text: building them costs one call each."""
    rows = charged.selectExpr("*", "cost_charged > 0 AS is_paid", f"CASE WHEN value_number < {LOW}D THEN 'low' WHEN value_number > {HIGH}D THEN 'high' ELSE 'normal' END AS seen")
    price = lambda ok: f"sum(CASE WHEN is_paid AND {ok} THEN price ELSE 0.0D END)"
    of = {"paid": price("true"), "paid_right": price("seen = prediction"), **{f"paid_{b}": price(f"prediction = '{b}'") for b in BUCKETS}}
    of |= {f"seen_{b}": f"count_if(is_paid AND seen = '{b}')" for b in BUCKETS} | {f"right_{b}": f"count_if(is_paid AND seen = '{b}' AND prediction = '{b}')" for b in BUCKETS}
    of |= {"n_tests": "count_if(is_paid)", "n_turns": "count(1)", "lo": "min(value_number)", "hi": "max(value_number)"}
    return rows.groupBy("episode_id").agg(*[F.expr(e).alias(n) for n, e in of.items()])


def prescribed(steps: DataFrame) -> DataFrame:
    """(episode_id, drugs): the treatments of the episodes that have one."""
    given = steps.where("kind = 'prescribe' AND treatment_key IS NOT NULL").select("episode_id", "treatment_key").repartition("episode_id")
    return given.groupBy("episode_id").agg(F.expr("array_sort(collect_list(treatment_key))").alias("drugs"))


#: The facts, in one array: uses that need different ones cannot be pruned apart.
COUNTS = ("n_tests", "n_turns", *(f"{of}_{b}" for of in ("seen", "right") for b in BUCKETS))
FACTS = ("paid", "paid_right", *(f"paid_{b}" for b in BUCKETS), "lo", "hi", *COUNTS)


def with_bucket_priors(charged: DataFrame) -> DataFrame:
    """Episode facts with the priors of the buckets (one row, broadcast).  Both
    need all facts, which are shuffled for that: a row an episode is written, and
    steps are sorted and summed once instead of twice.  Steps without an episode
    count for the priors too; they are asked for apart, which is next to nothing,
    as joins by episode leave them out: what both read is then one shuffle."""
    kept = lambda rows: facts(rows).selectExpr("episode_id", f"array({', '.join(f'double({c})' for c in FACTS)}) AS facts").hint("rebalance", "episode_id")
    at = {c: f"facts[{i}]" if c not in COUNTS else f"bigint(facts[{i}])" for i, c in enumerate(FACTS)}
    seen = lambda rows: kept(charged.where(rows)).agg(*[F.expr(f"sum({at[f'seen_{b}']})").alias(b) for b in BUCKETS])
    both = seen("episode_id IS NOT NULL").unionByName(seen("episode_id IS NULL")).agg(*[F.sum(b).alias(b) for b in BUCKETS])
    total = sum((F.col(b) for b in BUCKETS[1:]), F.col(BUCKETS[0]))
    priors = both.select(*[(F.col(b) / total).alias(f"prior_{b}") for b in BUCKETS])
    return kept(charged).selectExpr("episode_id", *[f"{e} AS {c}" for c, e in at.items()]).join(F.broadcast(priors), F.lit(True))


def step_terms(cfg: RewardConfig = DEFAULT) -> dict[str, Column]:
    """Cost, turn and verification terms of episode facts with priors.  A right
    prediction earns what it was worth beyond its bucket's prior."""
    expected = sum((F.col(f"paid_{b}") * F.coalesce(f"prior_{b}", F.lit(0.0)) for b in BUCKETS), F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return {
        "test_cost": zero(-cfg.lam * F.col("paid")),
        "turn_penalty": zero(-cfg.mu * F.col("n_turns")),
        "verify": zero(cfg.verify_fraction * cfg.lam * (F.col("paid_right") - expected)),
    }


def diagnosis(cfg: RewardConfig = DEFAULT) -> Column:
    """The terminal term; an unknown ending is an error."""
    price = cfg.abstain_value - cfg.abstain_penalty
    reason = F.col("termination_reason")
    return F.when(reason == "diagnose", F.col("brier") * weight(F.col("urgency"), cfg)).when(reason == "abstain", F.lit(price)).when(reason.isin("max_turns", "decode_failure"), F.lit(price - cfg.no_commit_penalty)).otherwise(F.raise_error(F.concat(F.lit("unknown ending "), reason)).cast("double"))


def drug_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a treatment with the rules that bear on it: class, what it is
    appropriate for, limits, and partners it must not be given with."""
    d = view(spark, sf_dir, "drug")
    per = lambda name, *cols: view(spark, sf_dir, name).groupBy("treatment_key").agg(F.collect_list(F.struct(*cols)).alias(name))
    for name, cols in (("rule_appropriate", ("condition", "score")), ("rule_threshold", ("rule", "op", "limit", "scale")), ("rule_pair", ("partner", "scale"))):
        d = d.join(F.broadcast(per(name, *cols)), "treatment_key", "left")
    return d.withColumn("fit_of", F.map_from_entries("rule_appropriate"))


def violation_list() -> Column:
    """Violated rules of one prescription: an array of (treatment, rule, scale).
    Repeats repeat; a pair counts once an episode."""
    none = "CAST(array() AS array<struct<treatment:string,rule:string,scale:double>>)"
    allergy = f"CASE WHEN class = patient_id % 6 THEN array(named_struct('treatment', treatment_key, 'rule', 'allergy', 'scale', 1.0D)) ELSE {none} END"
    limits = f"coalesce(transform(filter(rule_threshold, x -> CASE WHEN x.op = '<' THEN lo < x.limit ELSE hi > x.limit END), x -> named_struct('treatment', treatment_key, 'rule', x.rule, 'scale', x.scale)), {none})"
    first = "array_position(drugs, treatment_key) = pos + 1"
    pairs = f"coalesce(transform(filter(rule_pair, x -> {first} AND array_contains(drugs, x.partner)), x -> named_struct('treatment', concat(treatment_key, '+', x.partner), 'rule', 'interaction', 'scale', x.scale)), {none})"
    return F.expr(f"concat({allergy}, {limits}, {pairs})")


def contraindication() -> Column:
    """The scales of :func:`violation_list` summed, without making the list: the
    rules that only few rows have are array functions, which are interpreted."""
    limits = "aggregate(filter(rule_threshold, x -> CASE WHEN x.op = '<' THEN lo < x.limit ELSE hi > x.limit END), 0.0D, (a, x) -> a + x.scale)"
    pairs = "aggregate(filter(rule_pair, x -> array_contains(drugs, x.partner)), 0.0D, (a, x) -> a + x.scale)"
    first = "array_position(drugs, treatment_key) = pos + 1"
    return F.expr(f"CASE WHEN class = patient_id % 6 THEN 1.0D ELSE 0.0D END + CASE WHEN rule_threshold IS NOT NULL THEN {limits} ELSE 0.0D END + CASE WHEN rule_pair IS NOT NULL AND {first} THEN {pairs} ELSE 0.0D END")


def prescriptions(b: DataFrame, rules: DataFrame) -> DataFrame:
    """``b`` (episode rows) once for each prescription, with its rules; rows
    without prescriptions stay once.  An unknown treatment is an error."""
    x = b.select("*", F.posexplode_outer("drugs").alias("pos", "treatment_key"))
    j = x.join(F.broadcast(rules.withColumn("listed", F.lit(True))), "treatment_key", "left")
    known = F.col("treatment_key").isNull() | F.col("listed")
    return j.withColumn("treatment_key", F.when(F.coalesce(known, F.lit(False)), F.col("treatment_key")).otherwise(F.raise_error(F.concat(F.lit("unknown treatment "), "treatment_key"))))


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(episode_id, treatment, rule, scale) of each violated rule.  Allergy:
    the patient's class; limits: a value beyond one with a listed treatment;
    interaction: both of a pair (once an episode)."""
    f = facts(view(spark, sf_dir, "charged")).select("episode_id", "lo", "hi").join(prescribed(view(spark, sf_dir, "step")), "episode_id")
    b = f.join(view(spark, sf_dir, "episode").select("episode_id", "patient_id"), "episode_id")
    return prescriptions(b, drug_rules(spark, sf_dir)).select("episode_id", F.inline(violation_list()))


def base(spark: SparkSession, sf_dir: str, more: Callable[[DataFrame], DataFrame] | None = None, n_said: int = 0, only: dict[str, Column] | None = None) -> DataFrame:
    """One row an episode with all that scores depend on, under any weights:
    steps are read once, reports are kept in closed form.  ``more`` adds columns
    to episodes while their stated reports and ``drugs`` are there; if one is
    ``said``, an array of ``n_said`` labels, ``told0``, ``told1``, ... are how well the
    treatments fit each, on average.  ``only`` is what is kept of an episode
    beside these: keys of a group are not pruned, so each column costs."""
    labels = view(spark, sf_dir, "label")
    truth = F.broadcast(labels.select(F.col("label").alias("condition"), "urgency", F.lit(True).alias("listed_label")))
    e = view(spark, sf_dir, "episode").join(truth, "condition", "left")
    e = e.withColumn("condition", F.when(F.col("listed_label"), F.col("condition")).otherwise(F.raise_error(F.concat(F.lit("unknown label "), "condition")))).drop("listed_label")
    r = stated(view(spark, sf_dir, "report"), labels)
    j = e.join(with_bucket_priors(view(spark, sf_dir, "charged")), "episode_id", "left").join(prescribed(view(spark, sf_dir, "step")), "episode_id", "left").join(r, "episode_id", "left")
    j = j.withColumns({"brier": stated_brier("condition"), "mass": mass_on("condition"), "declared": declared()})
    j = (more(j) if more else j).drop("names", "named", "unnamed", "share")
    keep = [c for c in j.columns if c not in ("episode_id", "drugs", "lo", "hi", "said")]
    if only is not None:
        needed = ("condition", "declared", "patient_id", "drugs", "lo", "hi")
        j, keep = j.select("episode_id", *needed, *[c.alias(n) for n, c in only.items() if n not in needed]), list(only)
    x = prescriptions(j, drug_rules(spark, sf_dir))
    app = lambda label: F.coalesce(F.col("fit_of")[label], F.lit(0.0))
    given = F.col("treatment_key").isNotNull()
    x = x.withColumns({"fit_declared": F.when(given, app(F.col("declared"))), "fit_truth": F.when(given, app(F.col("condition"))), "scale": F.when(given, contraindication()), "given": given, **{f"told{i}": F.when(given, app(F.get("said", F.lit(i)))) for i in range(n_said)}})
    # what an episode's rows have in common is part of the key: its sums then stay in one hash table
    return x.groupBy("episode_id", *keep).agg(
        F.coalesce(F.avg("fit_declared"), F.lit(0.0)).alias("coherence"), F.coalesce(F.avg("fit_truth"), F.lit(0.0)).alias("correctness"),
        F.coalesce(F.sum("scale"), F.lit(0.0)).alias("contraindicated"), F.count_if("given").alias("n_drugs"), *[F.avg(f"told{i}").alias(f"told{i}") for i in range(n_said)],
    )


def terms(cfg: RewardConfig = DEFAULT) -> dict[str, Column]:
    """Every term of a row of :func:`base`, and the total."""
    t = {"diagnosis": diagnosis(cfg), **step_terms(cfg), "treatment": treatment(cfg)}
    return t | {"total": finite(sum(t.values(), F.lit(0.0)))}


def treatment(cfg: RewardConfig = DEFAULT) -> Column:
    """The term of an episode's prescriptions."""
    return cfg.coherence_scale * F.col("coherence") + cfg.correctness_scale * F.col("mass") * F.col("correctness") - cfg.contraindication_penalty * F.col("contraindicated")


def finite(total: Column) -> Column:
    """A total; one that is not finite is an error."""
    return F.when(F.abs(total) < float("inf"), total).otherwise(F.raise_error(F.lit("a score is not finite")).cast("double"))


def scores(spark: SparkSession, sf_dir: str, cfg: RewardConfig = DEFAULT) -> DataFrame:
    """One row an episode with every term and the total."""
    keep = ["episode_id", "patient_id", "policy", "seed", "budget", "termination_reason", "condition"]
    early = {"diagnosis": diagnosis(cfg), **step_terms(cfg)}  # all but the treatment's
    number = lambda c: F.coalesce(c, F.lit(0))
    b = base(spark, sf_dir, only={c: F.col(c) for c in keep[1:]} | early | {"mass": F.col("mass"), "n_tests": number("n_tests"), "n_turns": number("n_turns")})
    b = b.withColumn("treatment", treatment(cfg))
    t = [*early, "treatment"]
    return b.select(*keep, *t, finite(sum((F.col(c) for c in t), F.lit(0.0))).alias("total"), "n_tests", "n_turns")


def totals(spark: SparkSession, sf_dir: str, cfg: RewardConfig = DEFAULT) -> DataFrame:
    """Of :func:`scores` what groups of episodes need: patient_id, policy, seed,
    termination_reason and total."""
    keep = ["patient_id", "policy", "seed", "termination_reason"]
    early = sum({"diagnosis": diagnosis(cfg), **step_terms(cfg)}.values(), F.lit(0.0))  # terms add up in the order of scores
    b = base(spark, sf_dir, only={c: F.col(c) for c in keep} | {"early": early, "mass": F.col("mass")})
    return b.select(*keep, finite(F.col("early") + treatment(cfg)).alias("total"))


_PRIOR = f"""bp AS (SELECT CASE WHEN value_number < {LOW} THEN 'low' WHEN value_number > {HIGH} THEN 'high' ELSE 'normal' END AS prediction, count(*) * 1.0e0 / sum(count(*)) OVER () AS prior FROM charged WHERE cost_charged > 0 GROUP BY 1)"""
_COMPLETE = """nm AS (SELECT episode_id, label, sum(p)::DOUBLE AS p FROM report GROUP BY ALL),
nt AS (SELECT episode_id, sum(p) AS total, count(*) AS k FROM nm GROUP BY episode_id),
full_report AS (SELECT nt.episode_id, l.label, coalesce(CASE WHEN total > 1 THEN nm.p / total ELSE nm.p END, CASE WHEN total > 1 THEN 0.0 ELSE (1.0 - total) / (10 - k) END) AS p
  FROM nt, label l LEFT JOIN nm ON nm.episode_id = nt.episode_id AND nm.label = l.label)"""


def scores_sql(cfg: RewardConfig = DEFAULT) -> str:
    """CTEs that end in ``scores``."""
    return f"""{ctes('charged', 'report', 'label', 'episode')}, {_PRIOR}, {_COMPLETE},
st AS (SELECT episode_id, sum(CASE WHEN cost_charged > 0 THEN -{cfg.lam} * price ELSE 0 END)::DOUBLE AS test_cost, -{cfg.mu}::DOUBLE * count(*) AS turn_penalty,
  sum(CASE WHEN cost_charged > 0 THEN {cfg.verify_fraction} * {cfg.lam} * price * ((CASE WHEN value_number < {LOW} THEN 'low' WHEN value_number > {HIGH} THEN 'high' ELSE 'normal' END = prediction)::INT - prior) ELSE 0 END)::DOUBLE AS verify,
  count_if(cost_charged > 0)::BIGINT AS n_tests, count(*) AS n_turns FROM charged LEFT JOIN bp USING (prediction) GROUP BY episode_id),
br AS (SELECT f.episode_id, 0.9 - (sum(p * p) - 2 * sum(CASE WHEN f.label = e.condition THEN p ELSE 0 END) + 1) AS brier FROM full_report f JOIN episode e USING (episode_id) GROUP BY f.episode_id),
gv AS (SELECT s.*, substr(treatment_key, 2)::INT AS d, patient_id, condition, min(value_number) OVER q AS lo, max(value_number) OVER q AS hi FROM step s JOIN episode USING (episode_id) WINDOW q AS (PARTITION BY s.episode_id)),
vi AS (SELECT episode_id, treatment_key AS treatment, 'allergy' AS rule, 1.0::DOUBLE AS scale FROM gv WHERE kind = 'prescribe' AND d % 6 = patient_id % 6
  UNION ALL SELECT episode_id, treatment_key, 'renal', 1.0 FROM gv WHERE kind = 'prescribe' AND lo < 5 AND d IN (3, 9, 27, 36, 45)
  UNION ALL SELECT episode_id, treatment_key, 'hyperkalemia', 0.8 FROM gv WHERE kind = 'prescribe' AND hi > 48 AND d % 9 = 4
  UNION ALL SELECT DISTINCT a.episode_id, 'd' || a.d || '+d' || b.d, 'interaction', 0.6 FROM gv a JOIN gv b ON a.episode_id = b.episode_id AND a.kind = 'prescribe' AND b.kind = 'prescribe' AND a.d % 2 = 0 AND b.d = a.d + 1),
tp AS (SELECT episode_id, first(label ORDER BY p DESC, label) AS declared FROM full_report GROUP BY episode_id),
ap AS (SELECT gv.episode_id, avg(CASE WHEN declared IS NULL THEN 0 WHEN d % 10 = substr(declared, 7)::INT THEN 1.0 WHEN d % 5 = substr(declared, 7)::INT % 5 THEN 0.5 ELSE 0 END) AS coh,
  avg(CASE WHEN d % 10 = substr(condition, 7)::INT THEN 1.0 WHEN d % 5 = substr(condition, 7)::INT % 5 THEN 0.5 ELSE 0 END) AS cor, coalesce(max(f.p), 0) AS mass
  FROM gv LEFT JOIN tp USING (episode_id) LEFT JOIN full_report f ON f.episode_id = gv.episode_id AND f.label = gv.condition WHERE kind = 'prescribe' GROUP BY gv.episode_id),
tr AS (SELECT episode_id, {cfg.coherence_scale} * coh + {cfg.correctness_scale} * mass * cor - {cfg.contraindication_penalty} * coalesce((SELECT sum(scale) FROM vi WHERE vi.episode_id = ap.episode_id), 0) AS treatment FROM ap),
dg AS (SELECT e.*, CASE termination_reason WHEN 'diagnose' THEN brier * {cfg.weight_sql()} WHEN 'abstain' THEN {cfg.abstain_value - cfg.abstain_penalty}e0 ELSE {cfg.abstain_value - cfg.abstain_penalty - cfg.no_commit_penalty}e0 END AS diagnosis
  FROM episode e JOIN label l ON l.label = e.condition LEFT JOIN br ON br.episode_id = e.episode_id),
scores AS (SELECT dg.*, coalesce(test_cost, 0) AS test_cost, coalesce(turn_penalty, 0) AS turn_penalty, coalesce(verify, 0) AS verify, coalesce(treatment, 0) AS treatment, coalesce(n_tests, 0) AS n_tests, coalesce(n_turns, 0) AS n_turns,
  diagnosis + coalesce(test_cost, 0) + coalesce(turn_penalty, 0) + coalesce(verify, 0) + coalesce(treatment, 0) AS total FROM dg LEFT JOIN st USING (episode_id) LEFT JOIN tr USING (episode_id))"""


@query(f"WITH {scores_sql()} SELECT policy, count(*) AS n, round(avg(total), 6) AS mean_total, round(avg(diagnosis), 6) AS mean_diagnosis, round(avg(n_tests), 6) AS mean_tests, round(avg((termination_reason = 'diagnose')::INT), 6) AS diagnose_fraction, round(avg((termination_reason = 'abstain')::INT), 6) AS abstain_fraction, round(avg((termination_reason = 'max_turns')::INT), 6) AS no_commit_fraction FROM scores GROUP BY policy")
def policy_summary(spark, sf_dir):
    """Score the stored episodes and rank their policies."""
    ends = {"diagnose": "diagnose_fraction", "abstain": "abstain_fraction", "max_turns": "no_commit_fraction"}
    return scores(spark, sf_dir).groupBy("policy").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("total")).alias("mean_total"), r6(F.avg("diagnosis")).alias("mean_diagnosis"), r6(F.avg("n_tests")).alias("mean_tests"), *[r6(F.avg((F.col("termination_reason") == k).cast("int"))).alias(v) for k, v in ends.items()])


_TERMS = ("diagnosis", "test_cost", "turn_penalty", "verify", "treatment", "total")


@query(f"WITH {scores_sql()} SELECT episode_id, {', '.join(f'round({t}, 6) AS {t}' for t in _TERMS)}, n_tests, n_turns FROM scores")
def ep_score_total(spark, sf_dir):
    return scores(spark, sf_dir).select("episode_id", *[r6(t).alias(t) for t in _TERMS], "n_tests", "n_turns")


_OTHER = RewardConfig(lam=0.01, no_commit_penalty=0.0)


@query(f"WITH a AS (WITH {scores_sql()} SELECT episode_id, policy, total FROM scores), b AS (WITH {scores_sql(_OTHER)} SELECT episode_id, total AS again FROM scores) SELECT policy, count(*) AS n, round(avg(again), 6) AS mean_rescored, round(avg(total), 6) AS mean_stored, round(avg(again - total), 6) AS mean_delta FROM a JOIN b USING (episode_id) GROUP BY policy")
def ep_score_rescore(spark, sf_dir):
    """A stored run under other weights, against its stored totals."""
    return rescored(base(spark, sf_dir).select("policy", terms(DEFAULT)["total"].alias("total"), terms(_OTHER)["total"].alias("again")))


def rescored(rows: DataFrame) -> DataFrame:
    """Of (policy, total, again), ``again`` by any rule: n and means."""
    return rows.groupBy("policy").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("again")).alias("mean_rescored"), r6(F.avg("total")).alias("mean_stored"), r6(F.avg(F.col("again") - F.col("total"))).alias("mean_delta"))


@query(f"WITH {ctes('charged')}, {_PRIOR} SELECT prediction, round(prior, 6) AS prior FROM bp")
def bucket_prior(spark, sf_dir):
    return bucket_priors(view(spark, sf_dir, "charged")).select("prediction", r6("prior").alias("prior"))


@query(f"WITH {ctes('charged')}, {_PRIOR} SELECT episode_id, round(sum(CASE WHEN cost_charged > 0 THEN {DEFAULT.verify_fraction * DEFAULT.lam} * price * ((CASE WHEN value_number < 15 THEN 'low' WHEN value_number > 35 THEN 'high' ELSE 'normal' END = prediction)::INT - prior) ELSE 0 END), 6) AS verify FROM charged JOIN bp USING (prediction) GROUP BY episode_id")
def ep_verify(spark, sf_dir):
    f = with_bucket_priors(view(spark, sf_dir, "charged"))
    return f.select("episode_id", r6(step_terms()["verify"]).alias("verify"))


@query(f"WITH {scores_sql()} SELECT episode_id, rule, count(*) AS n, round(sum(scale), 6) AS scale, string_agg(treatment, ',' ORDER BY treatment) AS treatments FROM vi GROUP BY episode_id, rule")
def treat_violations(spark, sf_dir):
    v = violations(spark, sf_dir)
    return v.groupBy("episode_id", "rule").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("scale")).alias("scale"), F.array_join(F.sort_array(F.collect_list("treatment")), ",").alias("treatments"))


@query(f"WITH {scores_sql()} SELECT episode_id, round(treatment, 6) AS treatment FROM tr")
def treat_score(spark, sf_dir):
    b = base(spark, sf_dir).where("n_drugs > 0")
    return b.select("episode_id", r6(terms()["treatment"]).alias("treatment"))


@query(f"WITH {ctes('report', 'label')}, {_COMPLETE} SELECT episode_id, label, round(p, 6) AS p FROM full_report")
def complete_report(spark, sf_dir):
    return completed(view(spark, sf_dir, "report"), view(spark, sf_dir, "label")).select("episode_id", "label", r6("p").alias("p"))


@query(f"WITH {ctes('filed', 'label', 'episode')} SELECT episode_id, label, CASE WHEN label NOT IN (SELECT label FROM label) THEN 'unknown_label' WHEN p IS NULL OR isnan(p) OR isinf(p) THEN 'not_finite' WHEN p < 0 THEN 'negative' END AS violation FROM filed WHERE label NOT IN (SELECT label FROM label) OR p IS NULL OR isnan(p) OR isinf(p) OR p < 0 UNION ALL SELECT episode_id, NULL, 'empty' FROM episode WHERE termination_reason = 'diagnose' AND episode_id NOT IN (SELECT episode_id FROM filed)")
def report_checks(spark, sf_dir):
    """What is wrong with the reports as they were filed."""
    asked = view(spark, sf_dir, "episode").where("termination_reason = 'diagnose'")
    return report_violations(view(spark, sf_dir, "filed"), view(spark, sf_dir, "label"), asked)


@query(f"WITH {ctes('filed', 'label', 'episode')}, bad AS (SELECT DISTINCT episode_id FROM filed WHERE label NOT IN (SELECT label FROM label) OR p IS NULL OR isnan(p) OR isinf(p) OR p < 0), good AS (SELECT * FROM filed WHERE episode_id NOT IN (SELECT episode_id FROM bad)), {_COMPLETE.replace('FROM report', 'FROM good')} SELECT e.termination_reason, count(*) AS asked, count(x.episode_id) AS valid, round(count(x.episode_id) / count(*), 6) AS schema_valid_fraction, round(avg(brier), 6) AS mean_brier FROM episode e LEFT JOIN (SELECT f.episode_id, 0.9 - (sum(p * p) - 2 * max(CASE WHEN label = condition THEN p ELSE 0 END) + 1) AS brier FROM full_report f JOIN episode USING (episode_id) GROUP BY 1) x ON x.episode_id = e.episode_id GROUP BY 1")
def report_valid(spark, sf_dir):
    """How many of the filed reports are valid, and what those score."""
    filed, labels = view(spark, sf_dir, "filed"), view(spark, sf_dir, "label")
    bad = report_violations(filed, labels).select("episode_id").distinct()
    r = stated(filed.join(bad, "episode_id", "left_anti"), labels)
    j = view(spark, sf_dir, "episode").join(r, "episode_id", "left").select("termination_reason", F.col("named").isNotNull().cast("int").alias("ok"), F.when(F.col("named").isNotNull(), stated_brier("condition")).alias("b"))
    return j.groupBy("termination_reason").agg(F.count(F.lit(1)).alias("asked"), F.sum("ok").alias("valid"), r6(F.avg("ok")).alias("schema_valid_fraction"), r6(F.avg("b")).alias("mean_brier"))


@query(f"WITH {ctes('report')}, k AS (SELECT episode_id, string_agg(DISTINCT label, ',' ORDER BY label) AS keys FROM report GROUP BY 1) SELECT keys, count(*) AS reports, (SELECT count(DISTINCT keys) FROM k) = 1 AS constant FROM k GROUP BY 1")
def report_key_sets(spark, sf_dir):
    """The label sets that reports name; other than one says that they differ."""
    k = view(spark, sf_dir, "report").groupBy("episode_id").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("keys")).groupBy("keys").agg(F.count(F.lit(1)).alias("reports"))
    return k.withColumn("constant", F.count(F.lit(1)).over(W.partitionBy()) == 1)  # one row a label set


@query(f"WITH {ctes('charged', 'episode')} SELECT episode_id, turn, round(sum(cost_charged) OVER w, 6) AS spent, round(budget - sum(cost_charged) OVER w, 6) AS remaining, sum(cost_charged) OVER w >= budget - 1e-9 AS capped, 20 - turn AS turns_left FROM charged JOIN episode USING (episode_id) WINDOW w AS (PARTITION BY episode_id ORDER BY turn)")
def ledger_running(spark, sf_dir):
    """Spending so far, what is left, and turns left of twenty."""
    w = W.partitionBy("episode_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    j = view(spark, sf_dir, "charged").join(view(spark, sf_dir, "episode").select("episode_id", "budget"), "episode_id")
    j = j.withColumn("spent", F.sum("cost_charged").over(w))
    return j.select("episode_id", "turn", r6("spent").alias("spent"), r6(F.col("budget") - F.col("spent")).alias("remaining"), (F.col("spent") >= F.col("budget") - 1e-9).alias("capped"), (20 - F.col("turn")).alias("turns_left"))


def folded(steps: DataFrame, episodes: DataFrame) -> DataFrame:
    """The ledger replayed: (episode_id, turn, outcome, cost).  A refusal
    depends on what was spent before, so an episode's steps are folded."""
    per = steps.where("kind = 'order_test'").groupBy("episode_id").agg(F.sort_array(F.collect_list(F.struct("turn", "test_key", "price"))).alias("s"))
    j = per.join(episodes.select("episode_id", "budget"), "episode_id")
    zero = F.struct(F.lit(0.0).alias("spent"), F.array().cast("array<string>").alias("had"), F.array().cast("array<struct<turn:int,outcome:string,cost:double>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        repeat = F.array_contains(a["had"], x["test_key"])
        refused = ~repeat & (x["price"] > F.col("budget") - a["spent"] + 1e-9)
        outcome = F.when(repeat, "duplicate").when(refused, "refused").otherwise("charged")
        paid = outcome == "charged"
        cost = F.when(paid, x["price"]).otherwise(0.0)
        row = F.struct(x["turn"].alias("turn"), outcome.alias("outcome"), cost.alias("cost"))
        return F.struct((a["spent"] + cost).alias("spent"), F.when(paid, F.array_append(a["had"], x["test_key"])).otherwise(a["had"]).alias("had"), F.array_append(a["out"], row).alias("out"))

    return j.select("episode_id", F.explode(F.aggregate("s", zero, step)["out"]).alias("x")).select("episode_id", "x.*")


@query(f"""WITH RECURSIVE {ctes('step', 'episode')},
o AS (SELECT s.*, budget, row_number() OVER (PARTITION BY episode_id ORDER BY turn) AS i FROM step s JOIN episode USING (episode_id) WHERE kind = 'order_test'),
f AS (SELECT episode_id, 0::BIGINT AS i, 0::BIGINT AS turn, 0.0::DOUBLE AS spent, []::VARCHAR[] AS had, '' AS outcome, 0.0::DOUBLE AS cost FROM (SELECT DISTINCT episode_id FROM o)
 UNION ALL SELECT episode_id, i, turn, spent + cost, CASE WHEN outcome = 'charged' THEN list_append(had, test_key) ELSE had END, outcome, cost FROM (
  SELECT *, CASE WHEN outcome = 'charged' THEN price ELSE 0.0 END AS cost FROM (
   SELECT o.episode_id, o.i, o.turn, f.spent, f.had, o.test_key, o.price, CASE WHEN list_contains(f.had, o.test_key) THEN 'duplicate' WHEN o.price > o.budget - f.spent + 1e-9 THEN 'refused' ELSE 'charged' END AS outcome
   FROM f JOIN o ON o.episode_id = f.episode_id AND o.i = f.i + 1)))
SELECT episode_id, turn, outcome, cost FROM f WHERE i > 0""")
def ledger_fold(spark, sf_dir):
    return folded(view(spark, sf_dir, "step"), view(spark, sf_dir, "episode"))


@query(f"WITH {scores_sql()} SELECT policy, round(avg(0.9 * {DEFAULT.weight_sql()} - total), 6) AS mean_headroom, round(max(total), 6) AS best, count_if(total > 0.9 * {DEFAULT.weight_4} + 1e-6)::BIGINT AS above_hard_ceiling FROM scores JOIN label ON label = condition GROUP BY policy")
def headroom(spark, sf_dir):
    """Distance to the ceiling of each episode's truth, and rows above the hard
    ceiling (there must be none)."""
    s = scores(spark, sf_dir).join(F.broadcast(view(spark, sf_dir, "label").withColumnRenamed("label", "condition")), "condition")
    top = (1 - 1 / N_LABELS) * weight(F.col("urgency"))
    return s.groupBy("policy").agg(r6(F.avg(top - F.col("total"))).alias("mean_headroom"), r6(F.max("total")).alias("best"), F.count_if(F.col("total") > 0.9 * DEFAULT.weight_4 + 1e-6).alias("above_hard_ceiling"))


@query(f"WITH {ctes('step')}, p AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY turn DESC) AS back FROM step WHERE kind = 'prescribe') SELECT episode_id, turn, treatment_key FROM p WHERE back = 1")
def last_report(spark, sf_dir):
    """What counts of an episode that concludes more than once: the last."""
    p = view(spark, sf_dir, "step").where("kind = 'prescribe'").groupBy("episode_id").agg(F.max(F.struct("turn", "treatment_key")).alias("x"))
    return p.select("episode_id", "x.turn", "x.treatment_key")
