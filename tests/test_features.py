"""Truncated normals, verification by test, observations, nulls, shrunk reports,
bundles, generations, rules over stored episodes and the tail of a log."""

from __future__ import annotations

import json
import math
import os
import random
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from marlstone.functions.normal import normal_cdf, normal_quantile
from marlstone.operators import belief, nulls, observing, rescoring, shrink, truncated, verify
from marlstone.operators.evaluation import uniform
from marlstone.plans.config import RewardConfig
from marlstone.sources import bundles, episode_log, generations
from marlstone.streaming.streams import drained

SF = "/root/testdata/sf0.001"


def test_normal_functions_are_exact_and_native(spark):
    z = [0.0, 1e-9, 0.3, -0.3, 1.5, -2.7, 5.0, -6.5, 7.0, -7.2, 9.0, -20.0, 37.0, -39.0, 40.0, None]
    p = [1e-11, 1e-5, 0.02, 0.074, 0.076, 0.3, 0.5, 0.7, 0.925, 0.99999, 1 - 1e-10, 0.0, 1.0, None]
    a = spark.createDataFrame([(x,) for x in z], "z double").select("z", normal_cdf(F.col("z")).alias("c"))
    for r in a.collect():
        assert (r.c is None) == (r.z is None)
        assert r.z is None or r.c == pytest.approx(0.5 * math.erfc(-r.z / math.sqrt(2)), rel=1e-9, abs=1e-15)
    q = spark.createDataFrame([(x,) for x in p], "p double").select("p", normal_quantile(F.col("p")).alias("x"))
    for r in q.collect():
        assert (r.x is None) == (r.p is None)
        assert r.p is None or r.x == pytest.approx(NormalDist().inv_cdf(min(max(r.p, 1e-12), 1 - 1e-12)), abs=1e-9)
    assert "Python" not in a._jdf.queryExecution().executedPlan().toString()


def test_truncated_draws_keep_their_bounds_and_their_law(spark):
    lik = spark.createDataFrame([(0, 0, 0.0, 0.5), (1, 0, 5.0, 0.3), (0, 1, -0.6, 0.01)], "dim int, label int, mean double, sd double")
    records = spark.range(4000).select(F.col("id").alias("key"), (F.col("id") % 2).cast("int").alias("truth"))
    rows = truncated.drawn_values(records, lik, 3).collect()
    got = {k: np.array([r.value for r in rows if (r.dim, r.key % 2) == k]) for k in ((0, 0), (1, 0), (0, 1))}
    assert all((abs(v) <= 0.6).all() for v in got.values())
    assert got[1, 0].min() > 0.5 and abs(got[0, 0].mean()) < 0.02
    d = NormalDist(0, 0.5)
    want = (d.cdf(0.3) - d.cdf(-0.6)) / (d.cdf(0.6) - d.cdf(-0.6))
    assert (got[0, 0] <= 0.3).mean() == pytest.approx(want, abs=0.03)
    mass = truncated.with_mass(lik).where("dim = 0 AND label = 0").select(truncated.truncated_log_likelihood(F.lit(0.1)).alias("l")).first().l
    assert math.exp(mass) == pytest.approx(d.pdf(0.1) / (d.cdf(0.6) - d.cdf(-0.6)))


def test_beliefs_in_batches_equal_the_join(spark):
    rows = {(r.key, r.label): r.p for r in belief.posteriors(belief.evidence(spark, SF)).collect()}
    got = {(r.key, r.label): r.p for r in belief.posterior_rows(spark, SF).collect()}
    assert got.keys() == rows.keys() and all(got[k] == pytest.approx(v, abs=1e-9) for k, v in rows.items())
    model = belief.Fitted(np.array([0, 1]), np.log([0.25, 0.75]), np.array([[0.0, 1.0], [1.0, 0.0]]), np.ones((2, 2)))
    records = spark.createDataFrame([(1, [0.0, 1.0]), (2, [None, None]), (3, []), (4, [0.0, 1.0, 9.0]), (5, [0.0])], "key int, values array<double>")
    p = {r.key: [x.p for x in r.belief] for r in belief.beliefs(records, model).collect()}
    assert p[2] == p[3] == pytest.approx([0.25, 0.75]) and p[4] == p[1] and p[1][0] == pytest.approx(0.25 * math.e / (0.25 * math.e + 0.75))
    seq = {r.key: [[x.p for x in b] for b in r.sequence] for r in belief.belief_sequences(records, model).collect()}
    assert seq[1][0] == pytest.approx([0.25, 0.75]) and seq[1][2] == pytest.approx(p[1]) and seq[5][2] == pytest.approx(p[5])
    with pytest.raises(Exception, match="not finite"):
        belief.beliefs(spark.createDataFrame([(1, [float("nan"), 1.0])], "key int, values array<double>"), model).collect()


def test_beliefs_are_taken_in_slices(spark):
    class Small(belief.Fitted):
        def log_likelihoods(self, values):
            assert len(values) <= 128
            return super().log_likelihoods(values)

    model = Small(np.array([0, 1]), np.log([0.25, 0.75]), np.array([[0.0, 1.0], [1.0, 0.0]]), np.ones((2, 2)))
    records = spark.range(0, 300, 1, 1).selectExpr("id AS key", "array(id / 300D, 0D) AS values")
    ends = {r.key: [x.p for x in r.belief] for r in belief.beliefs(records, model).collect()}
    seq = {r.key: [[x.p for x in b] for b in r.sequence] for r in belief.belief_sequences(records, model).collect()}
    assert ends.keys() == seq.keys() == set(range(300))
    for k, p in ends.items():
        odds = 3 * math.exp((-((k / 300 - 1) ** 2) + (k / 300) ** 2 + 1) / 2)
        assert seq[k][2] == pytest.approx(p) and p[1] / p[0] == pytest.approx(odds)
    assert belief.beliefs(records.where("key < 0"), model).count() == 0


def test_verification_by_test(spark):
    refs = spark.createDataFrame([("n", False, 10.0, 20.0), ("c", True, 0.0, 0.0)], "test_key string, categorical boolean, ref_low double, ref_high double")
    r = random.Random(1)
    values = [("n", f"l{i % 2}", r.gauss(15 if i % 2 else 25, 3)) for i in range(400)] + [("c", f"l{i % 2}", 20.0 if i % 4 else 40.0) for i in range(400)]
    priors = verify.range_priors(spark.createDataFrame(values, "test_key string, condition string, value_number double"), refs)
    p = {(x.test_key, x.range): x.prior for x in priors.collect()}
    assert sum(v for k, v in p.items() if k[0] == "n") == pytest.approx(1) and p["c", "normal_categorical"] == pytest.approx(0.75)
    want = 0
    for lab in (0, 1):
        v = np.array([x for k, c, x in values if (k, c) == ("n", f"l{lab}")])
        want += 0.5 * NormalDist(v.mean(), v.std()).cdf(10.0)
    assert p["n", "low"] == pytest.approx(want, abs=1e-9)
    rows = [("n", "high", 25.0, 4.0), ("n", "low", 25.0, 4.0), ("n", "normal_categorical", 25.0, 4.0), ("c", "low", 20.0, 4.0), ("c", "abnormal_categorical", 40.0, 4.0), ("n", "high", 25.0, 0.0), ("n", None, 25.0, 4.0), ("n", "high", None, 4.0)]
    schema = "test_key string, prediction string, value_number double, cost_charged double"
    cfg = RewardConfig(verify_fraction=0.5, lam=1.0)
    got = [round(x.verify, 9) for x in verify.verified(spark.createDataFrame(rows, schema).coalesce(1), refs, priors, cfg).collect()]
    worth = [1 - p["n", "high"], -p["n", "low"], -p["n", "low"], -p["c", "normal_categorical"], 1 - p["c", "abnormal_categorical"], 0, -p["n", "low"], 0]
    assert got == [round(2 * w, 9) for w in worth]
    for bad, match in ((("x", "low", 1.0, 1.0), "no prior"), (("n", "low", 1.0, -1.0), "negative charge")):
        with pytest.raises(PySparkException, match=match):
            verify.verified(spark.createDataFrame([bad], schema), refs, priors).collect()
    with pytest.raises(ValueError, match="fraction"):
        verify.verified(spark.createDataFrame(rows, schema), refs, priors, RewardConfig(verify_fraction=1.0))


def test_observations(spark):
    steps = spark.createDataFrame([(1, t, k, n, v, c) for t, k, n, v, c in ((1, "order_test", "a", 1.0, 5.0), (2, "prescribe", "a", 9.0, 0.0), (3, "order_test", "b", 2.0, 3.0), (4, "order_test", "a", 7.0, 0.0), (5, "prescribe", "z", None, 0.0))], "episode_id long, turn int, kind string, test_key string, value_number double, cost_charged double")
    episodes = spark.createDataFrame([(1, 10, 20.0)], "episode_id long, patient_id long, budget double")
    records = spark.createDataFrame([(10, 40, "cough")], "patient_id long, age_years int, complaint string")
    tests = spark.createDataFrame([("a",), ("b",)], "test_key string")
    got = [([(x.test_key, x.value) for x in r.results], r.remaining, r.turns_left) for r in observing.observations(steps, episodes, records, tests).orderBy("turn").collect()]
    assert got == [([], 20.0, 20), ([("a", 1.0)], 15.0, 19), ([("a", 1.0)], 15.0, 18), ([("a", 1.0), ("b", 2.0)], 12.0, 17), ([("a", 7.0), ("b", 2.0)], 12.0, 16)]
    with pytest.raises(ValueError, match="condition"):
        observing.observations(steps, episodes, records.withColumn("condition", F.lit("x")), tests)
    with pytest.raises(PySparkException, match="no complaint"):
        observing.observations(steps, episodes, records.withColumn("complaint", F.lit(None).cast("string")), tests).collect()
    with pytest.raises(PySparkException, match="not in the catalogue"):
        observing.observations(steps, episodes, records, tests.where("test_key = 'a'")).collect()


def test_nulls_are_drawn_from_each_belief(spark):
    one = [(i, i % 3, [(0, 0.2), (1, 0.5), (2, 0.3)]) for i in range(3000)] + [(5000, 1, [(0, 0.0), (1, 1.0), (2, 0.0)])]
    rows = nulls.with_null(spark.createDataFrame(one, "key long, truth int, belief array<struct<label:int,p:double>>"), 4)
    got = rows.select("*", uniform(4, F.col("key")).alias("u")).collect()
    for r in got:
        c = np.cumsum([x.p for x in r.belief])
        assert r.drawn == int(np.searchsorted(c, r.u)) and r.truth_rank == (1 if r.key == 5000 else {0: 3, 1: 1, 2: 2}[r.truth])
    share = np.mean([r.drawn == 1 for r in got if r.key < 5000])
    assert share == pytest.approx(0.5, abs=0.04) and next(r.drawn for r in got if r.key == 5000) == 1
    gap = {r.truth: r.gap for r in nulls.label_blind(rows, 1).collect()}
    assert gap[1] > 0.4 and gap[0] < -0.4


def test_stored_reports_shrink_between_their_prior_and_themselves(spark):
    from marlstone.operators.scoring import scores

    alone = {r.policy: r.m for r in scores(spark, SF).groupBy("policy").agg(F.avg("total").alias("m")).collect()}
    at = {(r.policy, r.alpha): r for r in shrink.swept_reports(spark, SF).collect()}
    assert all(at[p, 1.0].mean_total == pytest.approx(m) for p, m in alone.items())
    rep = spark.createDataFrame([(["a", "b", "c"], [("a", 1.0)], 2, 0.0, 1.0, "a", {"a": 0.5, "b": 0.3, "c": 0.2}, 0.38)], "names array<string>, named array<struct<label:string,p:double>>, unnamed int, share double, mass double, condition string, pi map<string,double>, pp double")
    r = rep.select(*[c.alias(k) for k, c in shrink.mixed_brier().items()], shrink.declared_at((0.0, 0.5)).alias("d")).first()
    for alpha in (0.0, 0.3, 1.0):
        m = {k: (1 - alpha) * v + alpha * (k == "a") for k, v in {"a": 0.5, "b": 0.3, "c": 0.2}.items()}
        want = (1 - 1 / 3) - (sum(x * x for x in m.values()) - 2 * m["a"] + 1)
        assert r.a0 + alpha * r.a1 + alpha * alpha * r.a2 == pytest.approx(want) and r.m0 + alpha * r.m1 == pytest.approx(m["a"])
    assert r.d == ["a", "a"]


def resource(kind, **more):
    return {"resource": {"resourceType": kind, **more}}


def test_bundles_with_everything_wrong(spark):
    coded = lambda *codes: resource("Condition", code={"coding": [{"system": s, "code": c} for s, c in codes]})
    patient = resource("Patient", id="1", gender="female", birthDate="1990-01-01")
    files = {
        1: [patient, coded(("http://snomed.info/sct", "x"), ("http://loinc.org", "y")), coded(("SNOMED", "z"))], 2: [coded(("snomed", "x"))], 3: [patient, coded(("loinc", "x"))], 4: [patient, coded(("snomed", "q"), ("snomed", "q"))],
        5: [resource("Patient", birthDate="1800"), resource("Patient", gender="male"), coded(("snomed", "w"), ("snomed", "x"))], 6: [None, {"resource": None}, resource("Patient"), resource("Condition"), coded(("snomed", "x"))], 7: [],
    }
    rows = [(k, json.dumps({"entry": v})) for k, v in files.items()] + [(8, json.dumps({"entry": [patient]})[:-4]), (9, None), (10, "{}")]
    codes = spark.createDataFrame([("x", "mild", 1), ("z", "grave", 4), ("w", "mild too", 1)], "code string, label string, urgency int")
    got = {r.bundle: (r.label, r.age, r.sex, r.unmapped, r.error) for r in bundles.parsed_bundles(spark.createDataFrame(rows, "bundle int, json string"), codes, 2024).collect()}
    assert got[1] == ("grave", 34, "female", [], None) and got[5] == ("mild too", 120, None, [], None) and got[6][:2] == ("mild", None)
    assert [got[k][4] for k in (2, 3, 4, 7, 8, 9, 10)] == ["no patient", "no coded condition", "no mapped condition", "no patient", "malformed", "malformed", "malformed"]
    assert got[4][3] == ["q"]
    with pytest.raises(PySparkException, match="bundle 2: no patient"):
        bundles.strict_bundles(spark.createDataFrame(rows[1:2], "bundle int, json string"), codes, 2024).collect()


def test_generations_settle_on_the_last_attempt(spark):
    good, line = '{"action_id": "a1", "reason": "r"}', lambda c, t, k, fin, text, prompt="CASE {c} (turn {t})": (c, t, k, 10, fin, prompt and prompt.format(c=c, t=t), text)
    rows = [line(1, 0, 1, "stop", good), line(1, 0, 0, "length", good[:9]), line(1, 1, 0, "length", "{"), line(1, 1, 1, "length", "{"), line(2, 0, 0, "stop", "no json"), line(3, 0, 0, "stop", good, "CASE 4 (turn 0)"), line(4, 0, 0, "stop", good, None)]
    log = generations.read_lines(spark.createDataFrame(rows, generations.LINE).select(F.to_json(F.struct("*")).alias("line")))
    got = {(r.conv_id, r.turn): (r.attempts, r.status, r.action_id) for r in generations.settled(log).collect()}
    assert got == {(1, 0): (2, "parsed", "a1"), (1, 1): (2, "truncated", None), (2, 0): (1, "unparseable", None), (3, 0): (1, "misaligned", "a1"), (4, 0): (1, "parsed", "a1")}
    with pytest.raises(PySparkException, match="misaligned"):
        generations.actions(log, strict=False).collect()
    rest = log.where("conv_id <> 3")
    assert {r.conv_id for r in generations.actions(rest, strict=False).where("action_id IS NULL").collect()} == {1, 2}
    with pytest.raises(PySparkException, match="unparseable|truncated"):
        generations.actions(rest).collect()
    with pytest.raises(Exception, match="(?i)malformed"):
        generations.read_lines(spark.createDataFrame([("{broken",)], "line string")).collect()
    statuses = {r.status for r in generations.settled(generations.read_lines(generations.conversation_log(spark, "/root/testdata/sf0.01"))).collect()}
    assert statuses == {"parsed", "truncated", "unparseable", "misaligned"}


def test_rules_over_stored_episodes(spark):
    def frugal(trajectory: pa.StructArray, truth: pa.StructArray) -> pa.Array:
        out = []
        for t, g in zip(trajectory.to_pylist(), truth.to_pylist(), strict=True):
            worth = (2.0 if g["condition"] in ("label_0", "label_9") else 1.0) if t["termination_reason"] == "diagnose" else -0.1
            out.append(worth - 0.01 * sum(s["cost_charged"] for s in t["steps"]) - 0.02 * len(t["steps"]))
        return pa.array(out)

    stored = episode_log.stored_episodes(spark, SF)
    rows = lambda rule: {r.seed: round(r.score, 9) for r in rescoring.rescored_stored(stored, rule).collect()}
    assert rows(rescoring.frugal) == rows(rescoring.by_arrow(frugal))
    nothing = rescoring.by_arrow(lambda t, g: pc.cast(pa.nulls(len(t)), pa.float64()))
    with pytest.raises(PySparkException, match="no score"):
        rescoring.rescored_stored(stored, nothing).collect()


def test_a_tailed_log_stops_at_a_bad_line_and_goes_on_when_it_is_repaired(spark, tmp_path):
    run = tmp_path / "log" / "run_id=a"
    os.makedirs(run)
    good = lambda i: json.dumps({"trajectory": {"patient_id": i, "seed": i, "config_hash": "h", "budget": 1.0, "termination_reason": "abstain", "steps": []}, "ground_truth": {"condition": "x", "patient_id": i}})
    (run / "1.json").write_text(good(1) + "\n" + good(2) + "\n")
    tail = lambda: drained(episode_log.tail_log(spark, str(tmp_path / "log")).select("run_id", "trajectory.seed"), folder=f"file://{tmp_path}/state")
    assert {r.seed for r in tail().collect()} == {1, 2}
    (run / "2.json").write_text(good(3) + "\n{broken\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        tail()
    (run / "2.json").write_text(good(3) + "\n" + good(4) + "\n")
    (run / "3.json").write_text(good(5) + "\n")
    assert sorted(r.seed for r in tail().collect()) == [1, 2, 3, 4, 5]
    (run / "4.json").write_text(json.dumps({"trajectory": None, "ground_truth": {"condition": "x"}}) + "\n")
    with pytest.raises(Exception, match="lacks its trajectory"):
        tail()
