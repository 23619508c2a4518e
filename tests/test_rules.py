"""Rules on small tables: every check must be able to fire."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from marlstone.operators.evaluation import gated, inherited, paired, reading
from marlstone.operators.groups import balanced
from marlstone.operators import categorical, ordering
from marlstone.operators.scoring import brier, completed, declared, diagnosis, folded, mass_on, report_violations, stated, stated_brier, terms
from marlstone.operators.text import grounding_findings, leaks, ngrams, scrubbed, similarity, squashed
from marlstone.operators.training import probability
from marlstone.plans.config import RewardConfig
from marlstone.sources import dimensions, episode_log as log, sinks
from marlstone.sources.resources import strictly
from marlstone.streaming import streams
from marlstone.streaming.monitors import advance

GOOD = {"trajectory": {"patient_id": 1, "seed": 1, "config_hash": "a", "budget": 1.0, "termination_reason": "abstain", "steps": []}, "ground_truth": {"condition": "x", "patient_id": 1}, "tags": {}}


def labels(spark):
    return spark.createDataFrame([(f"l{i}", 1 + i % 4) for i in range(4)], "label string, urgency int")


def report(spark, *pairs):
    got = completed(spark.createDataFrame([(1, k, p) for k, p in pairs], "episode_id long, label string, p double"), labels(spark))
    return {r.label: round(r.p, 9) for r in got.collect()}


def test_reports_are_completed(spark):
    assert report(spark, ("l0", 0.4), ("l0", 0.2)) == {"l0": 0.6, "l1": 0.133333333, "l2": 0.133333333, "l3": 0.133333333}
    assert report(spark, ("l0", 1.5), ("l1", 0.5)) == {"l0": 0.75, "l1": 0.25, "l2": 0.0, "l3": 0.0}
    assert report(spark, ("l0", 0.0)) == {"l0": 0.0, "l1": 0.333333333, "l2": 0.333333333, "l3": 0.333333333}


def test_brier_is_zero_for_the_uniform_report_and_proper(spark):
    df = spark.createDataFrame([("u", i, 0.25, i == 0) for i in range(4)] + [("h", i, float(i == 0), i == 0) for i in range(4)], "k string, i int, p double, hit boolean")
    got = {r.k: r.b for r in df.groupBy("k").agg(brier(F.col("p"), F.col("hit"), 4).alias("b")).collect()}
    assert got["u"] == pytest.approx(0) and got["h"] == pytest.approx(0.75)


def test_an_unknown_ending_is_an_error(spark):
    e = spark.createDataFrame([(0.1, 1, "vanished")], "brier double, urgency int, termination_reason string")
    with pytest.raises(PySparkException, match="unknown ending"):
        e.select(diagnosis().alias("d")).collect()
    total = spark.createDataFrame([(float("inf"),), (float("nan"),)], "x double")
    for r in total.collect():
        row = spark.createDataFrame([(r.x, 0.0)], "brier double, zero double").selectExpr("brier", "1 AS urgency", "'diagnose' AS termination_reason", *[f"zero AS {c}" for c in ("paid", "n_turns", "paid_right", "paid_low", "paid_normal", "paid_high", "prior_low", "prior_normal", "prior_high", "coherence", "correctness", "mass", "contraindicated")])
        with pytest.raises(PySparkException, match="not finite"):
            row.select(terms()["total"].alias("t")).collect()


@pytest.mark.parametrize(("pairs", "kind"), [([("zzz", 0.5), ("l0", 0.5)], "unknown_label"), ([("l0", -0.5), ("l1", 0.2)], "negative"), ([("l0", float("nan"))], "not_finite"), ([("l0", float("inf"))], "not_finite"), ([("l0", None)], "not_finite")])
def test_a_bad_report_is_found_and_raises(spark, pairs, kind):
    rows = spark.createDataFrame([(1, k, p) for k, p in pairs], "episode_id long, label string, p double")
    assert kind in {r.violation for r in report_violations(rows, labels(spark)).collect()}
    for f in (completed, stated):
        with pytest.raises(PySparkException, match="bad entry"):
            f(rows, labels(spark)).collect()


def test_empty_reports_and_full_ones_without_mass(spark):
    none = spark.createDataFrame([], "episode_id long, label string, p double")
    asked = spark.createDataFrame([(1,), (2,)], "episode_id long")
    assert [(r.episode_id, r.violation) for r in report_violations(none, labels(spark), asked).orderBy("episode_id").collect()] == [(1, "empty"), (2, "empty")]
    zero = spark.createDataFrame([(1, f"l{i}", 0.0) for i in range(4)], "episode_id long, label string, p double")
    with pytest.raises(PySparkException, match="none of them mass"):
        completed(zero, labels(spark)).collect()


def test_completed_reports_sum_to_one_and_agree_with_the_closed_form(spark):
    import random

    rng = random.Random(4)
    rows = [(e, f"l{rng.randrange(4)}", rng.random() * rng.choice([0.1, 0.5, 1.0])) for e in range(200) for _ in range(rng.randint(1, 5))]
    rows = spark.createDataFrame([r for r in rows if True], "episode_id long, label string, p double")
    full = completed(rows, labels(spark)).groupBy("episode_id").agg(F.sum("p").alias("s"), brier(F.col("p"), F.col("label") == "l1", 4).alias("b"), F.sum(F.when(F.col("label") == "l1", F.col("p"))).alias("m"), F.min_by("label", F.struct(-F.round("p", 12), F.col("label"))).alias("d"))
    short = stated(rows, labels(spark)).select("episode_id", stated_brier("'l1'").alias("b2"), mass_on("'l1'").alias("m2"), declared().alias("d2"))
    got = full.join(short, "episode_id").collect()
    assert len(got) == 200
    for r in got:
        assert r.s == pytest.approx(1, abs=1e-15) and r.b == pytest.approx(r.b2) and r.m == pytest.approx(r.m2) and r.d == r.d2


def test_manifests_and_sinks(spark, tmp_path):
    fields = dict(run_id="a", config_hash="c", menu_fingerprint="m", label_fingerprint="l", prices_hash="p")
    sinks.write_manifest(spark, str(tmp_path / "m1"), **fields)
    sinks.write_manifest(spark, str(tmp_path / "m2"), **fields | {"run_id": "b"})
    sinks.write_manifest(spark, str(tmp_path / "m3"), **fields | {"config_hash": "x"})
    sinks.compatible(spark, str(tmp_path / "m1"), str(tmp_path / "m2"))
    with pytest.raises(ValueError, match="config_hash"):
        sinks.compatible(spark, str(tmp_path / "m1"), str(tmp_path / "m3"))
    with pytest.raises(ValueError, match="prices_hash"):
        sinks.write_manifest(spark, str(tmp_path / "m4"), run_id="a", config_hash="c", menu_fingerprint="m", label_fingerprint="l")
    rows = spark.createDataFrame([(1, "x", None), (2, "y", 0.5)], "b int, a string, target double")
    sinks.write_training_set(rows, str(tmp_path / "t"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect()) == ['{"a":"x","b":1}', '{"a":"y","b":2,"target":0.5}']
    assert {r.target for r in sinks.read_training_set(spark, str(tmp_path / "t"), "a string, b int, target double", target=1.0).collect()} == {1.0, 0.5}
    (tmp_path / "steps.json").write_text('{"step": 2, "reward": 0.5}\n{"step": 1, "loss": 3}\n')
    got = sinks.read_metrics(spark, str(tmp_path / "steps.json"), ("reward", "loss")).collect()
    assert [r.step for r in got] == [1, 2] and got[0].loss == 3 and got[0].reward != got[0].reward
    tags = spark.createDataFrame([({"policy": "p", "prompt": "long"},)], "tags map<string,string>").select(sinks.slim(F.col("tags")).alias("t")).first().t
    assert tags == {"policy": "p"}


def test_run_log_is_partitioned_and_guarded(spark, tmp_path):
    rows = log.stored_episodes(spark, "/root/testdata/sf0.001").withColumn("run_id", F.lit("r1"))
    known = spark.createDataFrame([(RewardConfig().hash(),)], "config_hash string")
    with pytest.raises(ValueError, match="undeclared"):
        sinks.append_run(rows, known.where("false"), str(tmp_path / "log"))
    sinks.append_run(rows, known, str(tmp_path / "log"))
    back = log.read_log(spark, str(tmp_path / "log"))
    assert back.count() == rows.count() and (tmp_path / "log" / "run_id=r1").is_dir()


def test_dimension_loads_raise(spark):
    bad = spark.createDataFrame([("a", 1, 0.5), ("a", 9, 0.0)], "slug string, urgency int, prior double")
    got = {r.rule: r.violations for r in dimensions.label_violations(bad).collect()}
    assert got == {"slug_unique": 2, "slug_given": 0, "urgency_tier": 1, "prior_positive": 1}
    with pytest.raises(ValueError, match="urgency_tier"):
        dimensions.strict(bad, dimensions.label_violations(bad))


def test_categorical_likelihoods(spark):
    frame = spark.createDataFrame
    base = frame([(8, "low", 0.5), (8, "mid", 0.3), (8, "high", 0.2)], "dim int, value string, p double")
    own = frame([(8, 1, "low", 1.0)], "dim int, label int, value string, p double")
    t = categorical.likelihood_table(frame([(8,)], "dim int"), frame([(0,), (1,)], "label int"), frame([(v,) for v in ("low", "mid", "high")], "value string"), base, own, eps=0.3)
    got = {(r.label, r.value): round(r.p, 9) for r in t.collect()}
    assert got == {(0, "low"): 0.45, (0, "mid"): 0.31, (0, "high"): 0.24, (1, "low"): 0.8, (1, "mid"): 0.1, (1, "high"): 0.1}
    with pytest.raises(PySparkException, match="unknown value"):
        categorical.looked_up(frame([(1, 0, 8, "odd")], "key int, truth int, dim int, value string"), t).collect()


def test_leaks_by_words_and_by_likeness(spark):
    forms = spark.createDataFrame([("anemia", "iron deficiency anemia"), ("anemia", "anemia"), ("gout", "gouty arthritis")], "label string, form string")
    docs = spark.createDataFrame([(1, "This is Iron-Deficiency  ANEMIA, surely.", "anemia"), (2, "Iron deficiency anemias. Something else.", "anemia"), (3, "Nothing of the kind is said here; at all", "gout"), (4, "gouty arthritiss\nother", "gout"), (5, None, "gout"), (6, "anemias", "anemia")], "doc_id long, text string, label string")
    got = {r.doc_id: r for r in leaks(docs, forms).collect()}
    assert set(got) == {1, 2, 4} and got[1].kind == "word" and got[2].kind == "similar" and got[2].form == "iron deficiency anemia" and got[4].sim >= 0.55
    assert "Iron-Deficiency" in got[1].excerpt and got[2].excerpt == "Iron deficiency anemias"
    every = {r.doc_id for r in leaks(docs, forms, like=lambda a, b: F.lit(1.0)).collect()}
    assert every == {1, 2, 3, 4}


def test_places_in_an_order_without_one_task(spark):
    rows = spark.range(5000).select("id", F.concat(F.lit("n"), F.format_string("%05d", (F.col("id") * 7919) % 5000)).alias("name"))
    got = {r.id: r.place for r in ordering.shuffled(rows, F.md5(F.col("id").cast("string")), "id").collect()}
    import hashlib

    want = sorted(range(5000), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    assert [got[i] for i in want] == list(range(5000))
    for n in (0, 1, 777, 5000, 9000):
        assert {r.id for r in ordering.lowest(rows, F.lit(n), F.md5(F.col("id").cast("string")), "id").collect()} == set(want[:n])
    assert all(r.place == int(r.name[1:]) for r in ordering.ranked_by(rows, "name").collect())


def test_strict_resources(spark):
    r = spark.createDataFrame([(1, "click", "{}"), (2, "weird", "{}")], "event_id long, resource_type string, body string")
    with pytest.raises(PySparkException, match="unknown resource type weird"):
        strictly(r).collect()
    assert strictly(r.where("event_id = 1")).count() == 1


EVENT = "event_id long, ts timestamp_ntz, run_id int, group_id long, reward double, hard_ceiling double, expected_ceiling double, termination_reason string, n_tests int"


def events(spark, path, first, reward=0.0, n=4):
    spark.range(first, first + n).selectExpr("id AS event_id", "CAST(TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) AS timestamp_ntz) AS ts", "0 AS run_id", "id AS group_id", f"CAST({reward} AS DOUBLE) AS reward", "CAST(4 AS DOUBLE) AS hard_ceiling", "CAST(0.5 AS DOUBLE) AS expected_ceiling", "'diagnose' AS termination_reason", "1 AS n_tests").coalesce(1).write.mode("append").parquet(path)


def test_a_run_halts_at_its_ceiling(spark, tmp_path):
    events(spark, str(tmp_path / "in"), 0)
    read = lambda: spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))
    streams.until_alert(streams.ceiling_alerts(read()), str(tmp_path / "s"))
    events(spark, str(tmp_path / "in"), 10, reward=4.5, n=1)
    with pytest.raises(Exception, match="event 10 is above its ceiling"):
        streams.until_alert(streams.ceiling_alerts(read()), str(tmp_path / "s"))


def test_a_restart_goes_on_and_refuses_another_configuration(spark, tmp_path):
    run = lambda config: streams.drained(streams._stateful(spark, spark.readStream.schema(EVENT).parquet(str(tmp_path / "in")), "run_id", streams.Stages(config), "run_id int, event_id long, stage int"), folder=str(tmp_path / "s"))
    events(spark, str(tmp_path / "in"), 0, reward=9.0, n=3)
    assert [r.stage for r in run("a").orderBy("event_id").collect()] == [0, 0, 0]
    events(spark, str(tmp_path / "in"), 10, reward=9.0, n=3)
    assert [r.stage for r in run("a").orderBy("event_id").collect()] == [0, 0, 0, 0, 1, 1]  # five of both runs make a window
    events(spark, str(tmp_path / "in"), 20, reward=9.0, n=1)
    with pytest.raises(Exception, match="another configuration"):
        run("b").collect()


def test_ledger_refuses_and_repeats(spark):
    steps = spark.createDataFrame([(1, t, "order_test", k, p) for t, k, p in [(1, "a", 6.0), (2, "a", 6.0), (3, "b", 5.0), (4, "c", 4.0), (5, "b", 5.0)]], "episode_id long, turn int, kind string, test_key string, price double")
    got = [r.outcome for r in folded(steps, spark.createDataFrame([(1, 10.0)], "episode_id long, budget double")).orderBy("turn").collect()]
    assert got == ["charged", "duplicate", "refused", "charged", "refused"]


def test_log_fails_closed(spark, tmp_path):
    for name, line in (("bad", "not json"), ("lacking", json.dumps({k: v for k, v in GOOD.items() if k != "ground_truth"}))):
        (tmp_path / name).write_text(json.dumps(GOOD) + "\n\n" + line + "\n")
        with pytest.raises(Exception, match="(?i)malformed|lacks"):
            log.read_log(spark, str(tmp_path / name)).collect()
        assert log.diagnosed_log(spark, str(tmp_path / name)).count() == 1
    (tmp_path / "good").write_text(json.dumps(GOOD) + "\n")
    assert log.model_safe(log.read_log(spark, str(tmp_path / "good"))).columns == ["patient_id", "seed", "config_hash", "budget", "termination_reason", "steps"]


def test_append_is_guarded(spark, tmp_path):
    rows = spark.read.schema(log.STORED).json(spark.sparkContext.parallelize([json.dumps(GOOD)]))
    with pytest.raises(ValueError, match="undeclared"):
        log.append_log(rows, spark.createDataFrame([("b",)], "config_hash string"), str(tmp_path / "log"))
    log.append_log(rows, spark.createDataFrame([("a",)], "config_hash string"), str(tmp_path / "log"))
    assert log.read_log(spark, str(tmp_path / "log")).count() == 1


def test_drift_is_null_safe(spark):
    a = spark.createDataFrame([("menu", "1"), ("seed", None), ("only", "x")], "f string, v string")
    b = spark.createDataFrame([("menu", "2"), ("seed", None)], "f string, v string")
    assert {r.field for r in log.drifted(a, b).collect()} == {"menu", "only"}


def test_gate_skips_and_fails(spark):
    m = spark.createDataFrame([("p", "a", 1.0), ("q", "a", 0.0), ("r", "a", 1.0), ("r", "b", 1.0)], "policy string, metric string, value double")
    t = spark.createDataFrame([("A", "a", ">", 0.5, "x"), ("B", "b", ">=", 1.0, "x")], "criterion string, metric string, op string, threshold double, role string")
    assert {r.policy: r.overall for r in gated(m, t).collect()} == {"p": "INCOMPLETE", "q": "FAIL", "r": "PASS"}
    i = inherited(t.select("criterion", "threshold"), spark.createDataFrame([("B", 2.0)], "criterion string, threshold double"))
    assert {(r.criterion, r.threshold, r.changed) for r in i.collect()} == {("A", 0.5, False), ("B", 2.0, True)}


def test_unpaired_rows_are_an_error(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 1.0)], "patient_id long, a double")
    with pytest.raises(PySparkException, match="not paired"):
        paired(a, spark.createDataFrame([(1, 0.5)], "patient_id long, b double")).collect()


@pytest.mark.parametrize(("points", "want"), [([(0.0, 0.0), (0.5, 0.2), (1.0, 0.1)], "calibration"), ([(0.0, 0.1), (0.5, 0.11), (1.0, 0.0)], "knowledge"), ([(0.0, 0.0), (0.5, 0.2), (1.0, 0.21)], "ranking")])
def test_sweep_readings(spark, points, want):
    assert reading(spark.createDataFrame(points, "alpha double, mean_total double")).first()["reading"] == want


def test_text_rules(spark):
    df = spark.createDataFrame([("This is THAT, thatch; avec.",)], "t string")
    assert df.select(scrubbed(F.col("t"))).first()[0] == "[redacted] is [redacted], thatch; [redacted]."
    pair = spark.createDataFrame([("diabetes type 2", "type 2 diabetes"), ("abc", "abc")], "a string, b string")
    got = [r[0] for r in pair.select(similarity(ngrams(squashed(F.col("a"))), ngrams(squashed(F.col("b"))))).collect()]
    assert 0.3 < got[0] < 1 and got[1] == 1.0


def test_grounding_wants_rank_and_number(spark):
    turns = spark.createDataFrame([(1, "alpha 0.51 and beta seem likely, gamma too")], "turn_id long, text string")
    b = spark.createDataFrame([(1, "A", 0.5, 1), (1, "B", 0.3, 2), (1, "C", 0.01, 9)], "turn_id long, label string, p double, rank int")
    f = spark.createDataFrame([("A", "alpha"), ("B", "beta"), ("C", "gamma")], "label string, form string")
    assert {(r.label, r.kind) for r in grounding_findings(turns, b, f).collect()} == {("B", "ungrounded_assertion"), ("C", "unearned_mention")}


def test_balance_caps_labels(spark):
    k = spark.createDataFrame([("x", float(i), i) for i in range(5)] + [("y", 1.0, 9)], "condition string, total double, seed int")
    assert sorted((r.condition, r.seed) for r in balanced(k, 2).collect()) == [("x", 3), ("x", 4), ("y", 9)]


def test_stage_rule_resets():
    stage, recent = 0, []
    for _ in range(5):
        stage, recent = advance(stage, recent, 0.0)
    assert (stage, recent) == (1, [])


def test_config_hash_follows_its_values():
    assert RewardConfig().hash() == RewardConfig().hash() != RewardConfig(lam=0.5).hash()


def test_plans_have_no_cartesian_product(spark):
    from marlstone.plans.registry import QUERIES, load

    load()
    for name in ("policy_summary", "grp_keep_best", "bel_sequence", "mention", "split_ids"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name


def test_import_needs_no_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr


def test_digests_are_md5():
    import hashlib

    import numpy as np

    from marlstone.functions.digests import decimals, md5_words

    for start, a, b in ((b"", 0, 10), (b"0:17:", 1000, 1100), (b"12345:6789:", 10**6, 10**6 + 9)):
        words = md5_words(start, decimals(np.arange(a, b)))
        for i, x in enumerate(range(a, b)):
            assert "".join(f"{int(w[i]):08x}" for w in words) == hashlib.md5(start + str(x).encode()).hexdigest()


def test_resamples_store_no_draws(spark, monkeypatch):
    import hashlib

    from marlstone.operators import evaluation

    n, resamples = 103, 12
    keys = sorted(range(n), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
    d = [(i % 17) / 7 for i in keys]
    draw = lambda r, i: int(int(hashlib.md5(f"5:{r}:{i // 4}".encode()).hexdigest()[i % 4 * 8 :][:8], 16) / 2**32 * n)
    want = {r: sum(d[draw(r, i)] for i in range(n)) / n for r in range(resamples)}
    at = spark.createDataFrame(list(enumerate(d)), "j long, d double")
    for held in (evaluation.HELD, 20):  # differences in one block, and in six
        monkeypatch.setattr(evaluation, "HELD", held)
        means = evaluation.resampled(at, n, resamples, 5)
        assert {r.r: r.m for r in means.collect()} == pytest.approx(want)
        assert "Join" not in means._jdf.queryExecution().toString()
    assert evaluation.bootstrap(spark.createDataFrame([], "patient_id long, d double"), 5).collect()[0].lo is None


class _Handle:
    """A state of one value, without Spark."""

    value = None

    def getValueState(self, *_):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_a_micro_batch_is_not_kept_whole():
    import weakref

    import pandas as pd

    refs, hits = [], [i * i % 11 < 3 for i in range(25_000)]

    def frames():
        for k in range(4, -1, -1):  # the last rows come first
            assert all(r() is None for r in refs[:-1])
            i = range(5_000 * k, 5_000 * (k + 1))
            p = pd.DataFrame({"event_id": i, "ts": pd.to_datetime([x // 7 for x in i], unit="s"), "termination_reason": ["diagnose" if hits[x] else "abstain" for x in i]})
            refs.append(weakref.ref(p))
            yield p

    m = streams.CommitMonitor()
    m.init(_Handle())
    out = list(m.handleInputRows((0,), frames(), None))
    assert max(map(len, out)) <= 10_000
    got = pd.concat(out)
    assert list(got.event_id) == list(range(25_000)) and list(got.hits) == [sum(hits[max(0, i - 639) : i + 1]) for i in range(25_000)]


def test_carried_sums_equal_those_taken_anew():
    import pandas as pd

    tests = [i * i * 7 % 13 % 9 for i in range(3_000)]
    m, out = streams.CostMonitor(512), []
    for a, b in ((0, 100), (100, 2_000), (2_000, 3_000)):  # the state goes on
        m.init(handle := _Handle() if not a else handle)
        p = pd.DataFrame({"event_id": range(a, b), "ts": pd.to_datetime(range(a, b), unit="s"), "n_tests": tests[a:b]})
        out += m.handleInputRows((0,), iter([p]), None)
    got, last = pd.concat(out), [tests[max(0, i - 511) : i + 1] for i in range(3_000)]
    assert list(got.total) == [x.count(0) for x in last]
    assert list(got.alert) == [len(x) >= 256 and (x.count(0) / len(x) > 0.95 or sum(t >= 7 for t in x) / len(x) > 0.5) for x in last]


def test_steps_are_shuffled_once(spark):
    from marlstone.operators.scoring import facts
    from marlstone.sources.views import view

    f = facts(view(spark, "/root/testdata/sf0.001", "charged"))
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_scores_sort_steps_once_a_pass_and_group_by_hash(spark):
    from marlstone.operators.scoring import base

    plan = base(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [row_number()") == 3  # facts, priors of the buckets, and of these the steps without an episode
    assert "SortAggregate" not in plan


def test_a_contraindication_is_the_sum_of_its_list(spark):
    from marlstone.operators.scoring import contraindication, drug_rules, prescriptions, violation_list

    given = spark.createDataFrame([(0, 3, 1.0, 50.0, ["d3", "d4"]), (1, 4, 9.0, 49.0, ["d4", "d4", "d5"]), (2, 1, 9.0, 9.0, ["d1"]), (3, 1, 9.0, 9.0, None)], "episode_id int, patient_id bigint, lo double, hi double, drugs array<string>")
    x = prescriptions(given, drug_rules(spark, "/root/testdata/sf0.01")).where("treatment_key IS NOT NULL").select("episode_id", contraindication().alias("got"), violation_list().alias("list")).collect()
    assert len(x) == 6 and all(abs(r.got - sum(v.scale for v in r.list)) < 1e-12 for r in x)
    totals = [sum(r.got for r in x if r.episode_id == i) for i in range(3)]
    assert [round(t, 6) for t in totals] == [2.8, 4.2, 1.0]


def test_all_passes_over_steps_read_one_shuffle(spark):
    from marlstone.plans.registry import QUERIES

    df = QUERIES["turn_advantages"](spark, "/root/testdata/sf0.001")
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("ReusedExchange") >= 2  # scores, priors and turns


def test_steps_without_an_episode_count_for_the_priors(spark):
    from marlstone.operators.scoring import with_bucket_priors

    step = "episode_id bigint, turn int, kind string, treatment_key string, price double, value_number double, prediction string, cost_charged double"
    charged = spark.createDataFrame([(e, 1, "order_test", "d1", 2.0, v, "low", 2.0) for e, v in ((1, 1.0), (1, 40.0), (None, 1.0), (None, 20.0))], step)
    rows = {r.episode_id: (r.n_tests, r.prior_low, r.prior_normal, r.prior_high) for r in with_bucket_priors(charged).collect()}
    assert rows == {1: (2, 0.5, 0.25, 0.25), None: (2, 0.5, 0.25, 0.25)}


def test_a_sweep_collects_no_rules(spark):
    from marlstone.operators.shrink import swept_reports

    plan = swept_reports(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "rule_appropriate" in plan and "flatten" not in plan


def test_expected_entropies_shuffle_no_record(spark):
    from marlstone.plans.registry import QUERIES

    for name in ("eig", "next_test"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == (name == "next_test")  # its rows of one record are grouped


def test_a_fitted_table_may_lack_pairs(spark):
    from marlstone.operators.belief import GRID, SEEN, expected_entropies, fitted, likelihoods, priors

    rows = [(0, 0, [0.0, 1.0, 2.0, 0.5, 3.0]), (1, 0, [0.2, 0.8, 1.5, 0.1, 2.0]), (2, 1, [1.0, 0.0, 0.5, 0.9]), (3, 1, [0.7, 0.2, 0.1, 0.4]), (4, 1, [0.1])]
    records = spark.createDataFrame(rows, "key long, truth int, values array<double>")
    ev = records.selectExpr("key", "truth", "posexplode(values) AS (dim, value)")
    model = fitted(likelihoods(ev), priors(ev))
    assert model.mean.shape == (2, 5) and [bool(x) for x in model.mean[1] != model.mean[1]] == [False] * 4 + [True]
    got = {(r.key, r.dim): r.eig for r in expected_entropies(records, model).collect()}
    assert set(got) == {(k, d) for k in range(4) for d in range(5)}  # the record of one value is not asked
    import numpy as np

    v = np.array(rows[2][2])
    z = (v - model.mean[:, :SEEN]) / model.sd[:, :SEEN]
    lp = np.log([0.4, 0.6]) + (-0.5 * z * z - np.log(model.sd[:, :SEEN]) - 0.5 * np.log(2 * np.pi)).sum(axis=1)
    p = np.exp(lp - lp.max()) / np.exp(lp - lp.max()).sum()
    top = total = 0.0
    for x in np.linspace(model.mean[:, 1].min(), model.mean[:, 1].max(), GRID):
        like = np.exp(-0.5 * ((x - model.mean[:, 1]) / model.sd[:, 1]) ** 2) / model.sd[:, 1]
        w = p * like / like.max()
        h = -sum(a * np.log(a) for a in w / w.sum() if a > 0)
        top, total = top + w.sum() * h, total + w.sum()
    assert abs(got[2, 1] - top / total) < 1e-9 and abs(got[2, 4]) < 1e-12  # only one label knows the last value


def test_a_gate_that_is_amended_scores_its_episodes_once(spark):
    from marlstone.plans.registry import QUERIES

    df = QUERIES["gate_inherit"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [row_number()") == 3  # facts, priors of the buckets, and of these the steps without an episode
    assert {r.criterion: r.changed for r in df.collect()} == {"1": True, "2": False, "3": True, "4": False, "5": False, "new": True}


def test_priors_read_the_facts_of_the_scores(spark):
    from marlstone.operators.scoring import with_bucket_priors
    from marlstone.sources.views import view

    rows = with_bucket_priors(view(spark, "/root/testdata/sf0.01", "charged")).where("episode_id IS NOT NULL")
    got = rows.agg(*[F.sum(f"seen_{b}").alias(b) for b in ("low", "normal", "high")], F.max("prior_low").alias("prior")).first()
    assert got.low and abs(got.prior - got.low / (got.low + got.normal + got.high)) < 1e-12
    rows.collect()
    final = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "REBALANCE" in final and any("ReusedExchange" in x and "facts#" in x for x in final.splitlines())


def test_totals_are_those_of_the_scores(spark):
    from marlstone.operators.scoring import base, scores, terms, totals

    sf, key = "/root/testdata/sf0.01", ("patient_id", "policy", "seed", "termination_reason", "total")
    want = base(spark, sf).withColumn("total", terms()["total"])
    rows = [sorted(map(tuple, x.select(*key).collect())) for x in (want, totals(spark, sf), scores(spark, sf))]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) > 1_000


def test_filed_reports_are_read_once_and_judged_as_before(spark):
    from marlstone.operators.evaluation import valid_fractions
    from marlstone.sources.views import SQL, view

    sf = "/root/testdata/sf0.01"
    plain = spark.sql(SQL["filed"], report=view(spark, sf, "report"))
    want, got = (sorted(map(str, x.collect())) for x in (plain, view(spark, sf, "filed")))
    assert want == got and plain.schema.simpleString() == view(spark, sf, "filed").schema.simpleString()
    plan = valid_fractions(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("orders.parquet") == 3  # who is asked, and the two kinds of entries


def test_an_asked_episode_needs_a_good_report(spark, tmp_path):
    from datetime import datetime

    from marlstone.operators.evaluation import valid_fractions

    # 1: good; 71: nothing is filed; 97 and 89: a bad entry beside good ones; no number; not asked
    rows = [(i, 3, "F", 1.0, datetime(2000, 1, 1), "1-URGENT") for i in (1, 71, 97, 89, None)] + [(2, 3, "O", 1.0, datetime(2000, 1, 1), "2-HIGH")]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(10).selectExpr("id AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    assert [tuple(r) for r in valid_fractions(spark, str(tmp_path)).collect()] == [("1", 0.25)]


def test_a_declared_label_may_be_one_that_is_not_named(spark):
    entry = "named array<struct<label:string,p:double>>, share double, want string"
    rows = [([("b", 0.6)], 0.2, "b"), ([("b", 0.1)], 0.45, "a"), ([("c", 0.4)], 0.4, "a"), ([("a", 0.5), ("b", 0.5), ("c", 0.0)], 0.0, "a"), ([("b", 0.0), ("a", 0.0)], 0.5, "c"), ([], 1 / 3, "a")]
    for r in spark.createDataFrame(rows, entry).withColumn("names", F.array(*map(F.lit, "abc"))).select("want", declared().alias("got")).collect():
        assert r.got == r.want


def test_probabilities_are_rounded_as_they_are(spark):
    """Beside a half in the tenth decimal, the number decides, not its name."""
    rng = random.Random(3)
    p = [0.0, 1.0, 0.5, 0.0677604365, 0.0135704595, 1e-12, 5e-10, 4.9999e-10, 0.9999999996, 0.9999999994]
    p += [float(f"0.{rng.randrange(10**9):09d}5") for _ in range(3000)] + [rng.random() ** 8 for _ in range(3000)] + [k / 2**10 for k in range(1025)]
    got = spark.createDataFrame(list(enumerate(p)), "i int, p double").select("i", probability(F.col("p")).alias("t")).collect()
    assert {r.i: r.t for r in got} == {i: re.sub(r"\.?0+$", "", f"{x:.9f}") for i, x in enumerate(p)}
