"""Training sets from stored turns: examples, wire format, abstentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from marlstone.functions.normal import general
from marlstone.operators.belief import SEQ, entropy, evidence, sequence_rows, posterior_rows
from marlstone.operators.evaluation import RANKED, ranked
from marlstone.operators.ordering import placed
from marlstone.operators.scoring import r6
from marlstone.operators.text import TOLERANCE, grounding_findings
from marlstone.plans.registry import query
from marlstone.sources.views import table

ABSTAIN_QUANTILE, ABSTAIN_FRACTION = 0.85, 0.05
PROBABILITY = r"^(0|1|0\.[0-9]{1,9})$"


def probability(p: Column) -> Column:
    """A probability on the wire: nine decimals at most, no trailing zeros.  The
    number itself is rounded, halves to even; ``format_string`` rounds the shortest
    decimals that name it, and takes 0.0677604365, which is below the half, up."""
    high = (p * 134217729.0) - (p * 134217729.0 - p)  # the leading 26 bits: their product is exact
    whole = p * 1e9
    rest = (high * 1e9 - whole) + (p - high) * 1e9  # what the product above has lost
    units = F.floor(whole)
    over = whole - units - 0.5
    up = (over > 0) | ((over == 0) & ((rest > 0) | ((rest == 0) & (units % 2 == 1))))
    n = units + up.cast("long")
    text = F.concat(F.floor(n / 1_000_000_000).cast("string"), F.lit("."), F.lpad((n % 1_000_000_000).cast("string"), 9, "0"))
    return F.regexp_replace(F.when(p.between(0, 1), text).otherwise(F.format_string("%.9f", p)), r"\.?0+$", "")


@query(f"WITH {RANKED} SELECT key, label, regexp_replace(format('{{:.9f}}', p), '\\.?0+$', '') AS wire FROM rk")
def prob_format(spark, sf_dir):
    r = ranked(posterior_rows(spark, sf_dir))
    text = probability(F.col("p"))
    return r.select("key", "label", F.when(text.rlike(PROBABILITY), text).otherwise(F.raise_error(F.concat(F.lit("probability "), text))).alias("wire"))


@query(f"WITH {RANKED} SELECT key, '{{\"kind\":\"diagnose\",\"diagnosis\":[' || string_agg('{{\"condition\":\"label_' || label || '\",\"probability\":\"' || regexp_replace(format('{{:.9f}}', p), '\\.?0+$', '') || '\"}}', ',' ORDER BY rank) || ']}}' AS wire FROM rk WHERE rank <= 4 GROUP BY key")
def wire_render(spark, sf_dir):
    """Compact JSON of a report, keys in their declared order."""
    r = ranked(posterior_rows(spark, sf_dir)).where("rank <= 4")
    item = F.struct("rank", F.concat(F.lit("label_"), F.col("label").cast("string")).alias("condition"), probability(F.col("p")).alias("probability"))
    g = r.groupBy("key").agg(F.sort_array(F.collect_list(item)).alias("x"))
    pairs = F.transform("x", lambda s: F.struct(s["condition"].alias("condition"), s["probability"].alias("probability")))
    return g.select("key", F.to_json(F.struct(F.lit("diagnose").alias("kind"), pairs.alias("diagnosis"))).alias("wire"))


ACTION = "kind string, reasoning string, test_key string, prediction string"


def parsed(log: DataFrame, tests: DataFrame) -> DataFrame:
    """``log`` (id, text) with the action its text holds.  Text that is no JSON,
    or names no known test, stays, flagged; nothing is dropped."""
    a = F.from_json("text", ACTION, {"mode": "PERMISSIVE", "allowUnquotedControlChars": "true"})
    j = log.withColumn("a", a).withColumn("t", F.col("a.test_key")).join(F.broadcast(tests.withColumn("known", F.lit(True))), F.col("t") == F.col("test_key"), "left")
    ok = F.coalesce(F.col("a.kind").isin("diagnose", "abstain") | (F.col("a.kind").isin("order_test") & F.col("known")), F.lit(False))
    keys = F.coalesce(F.json_object_keys("text"), F.array().cast("array<string>"))
    unknown = F.size(F.array_except(keys, F.array(*[F.lit(k) for k in ("kind", "reasoning", "test_key", "prediction")])))
    return j.select("id", F.when(ok, F.col("a.kind")).alias("kind"), F.coalesce("a.reasoning", F.lit("")).alias("reasoning"), (ok & (unknown == 0)).alias("parsed"))


_TEXT = """CASE WHEN event_id % 7 = 0 THEN '{"kind": broken' WHEN event_id % 11 = 0 THEN '{"kind":"abstain","extra":1}'
 WHEN event_id % 2 = 0 THEN concat('{"kind":"order_test","test_key":"t', event_id % 90, '","reasoning":"r', event_id, '"}') ELSE '{"kind":"abstain","reasoning":""}' END"""


@query(f"""WITH g AS (SELECT event_id AS id, {_TEXT} AS text FROM events), p AS (SELECT id, text, CASE WHEN json_valid(text) THEN text END AS j FROM g),
q AS (SELECT id, json_extract_string(j, '$.kind') AS k, json_extract_string(j, '$.test_key') AS t, coalesce(json_extract_string(j, '$.reasoning'), '') AS reasoning, coalesce(json_extract_string(j, '$.extra') IS NOT NULL, false) AS extra FROM p),
r AS (SELECT *, coalesce(k IN ('diagnose', 'abstain') OR (k = 'order_test' AND substr(t, 2)::INT < 73), false) AS ok FROM q)
SELECT id, CASE WHEN ok THEN k END AS kind, reasoning, ok AND NOT extra AS parsed FROM r""")
def wire_parse(spark, sf_dir):
    """Generated text to actions; failures are kept and flagged."""
    log = table(spark, sf_dir, "events").selectExpr("event_id AS id", f"{_TEXT} AS text")
    tests = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("t"), (F.col("l_partkey") % 73).cast("string")).alias("test_key")).distinct()
    return parsed(log, tests)


def examples(turns: DataFrame) -> DataFrame:
    """One example an assistant turn: what was said before it, itself, and its
    kind (a conversation's last assistant turn concludes)."""
    w = W.partitionBy("conv_id").orderBy("turn")
    said = F.struct("role", F.col("text").alias("content"))
    t = turns.withColumn("before", F.collect_list(said).over(w.rowsBetween(W.unboundedPreceding, -1)))
    a = t.where("role = 'assistant'")
    last = F.max("turn").over(W.partitionBy("conv_id"))
    return a.withColumn("kind", F.when(F.col("turn") == last, "diagnose").otherwise("order_test"))


@query("WITH a AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations WHERE role = 'assistant') SELECT conv_id, turn, CASE WHEN turn = last THEN 'diagnose' ELSE 'order_test' END AS kind, (SELECT count(*) FROM conversations c WHERE c.conv_id = a.conv_id AND c.turn < a.turn) AS n_before, (SELECT coalesce(sum(length(text)), 0)::BIGINT FROM conversations c WHERE c.conv_id = a.conv_id AND c.turn < a.turn) AS prompt_chars, length(text) AS completion_chars FROM a")
def turns_to_examples(spark, sf_dir):
    e = examples(table(spark, sf_dir, "conversations"))
    chars = F.aggregate("before", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(F.length(x["content"]), F.lit(0)))
    return e.select("conv_id", "turn", "kind", F.size("before").cast("long").alias("n_before"), chars.alias("prompt_chars"), F.length("text").cast("long").alias("completion_chars"))


@query("WITH a AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations WHERE role = 'assistant') SELECT CASE WHEN turn = last THEN 'diagnose' ELSE 'order_test' END AS kind, count(*) AS n, count(DISTINCT conv_id) AS patients, round(avg(length(text)), 6) AS mean_chars FROM a GROUP BY 1")
def trainset_summary(spark, sf_dir):
    e = examples(table(spark, sf_dir, "conversations"))
    return e.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("conv_id").alias("patients"), r6(F.avg(F.length("text"))).alias("mean_chars"))


def abstentions(h: DataFrame) -> DataFrame:
    """Of (key, h): the most uncertain share, out of those above a quantile."""
    cut = h.agg(F.percentile("h", ABSTAIN_QUANTILE).alias("cut"), F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * ABSTAIN_FRACTION).cast("int")).alias("n"))
    pool = h.join(F.broadcast(cut), F.col("h") >= F.col("cut"))  # one row
    # the highest first: blocks are ten-thousandths of the entropy
    high = placed(pool.withColumn("low", -F.round("h", 9)), F.floor(F.col("h") * -10_000), "low", "key")
    return high.where("place < n").select("key", "h")


@query(f"WITH {SEQ}, h AS (SELECT key, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) AS h FROM seq WHERE k = 2 GROUP BY 1), r AS (SELECT key, h, row_number() OVER (ORDER BY round(h, 9) DESC, key) AS i, (SELECT greatest(1, round_even(count(*) * {ABSTAIN_FRACTION}, 0)) FROM h) AS n, (SELECT quantile_cont(h, {ABSTAIN_QUANTILE}) FROM h) AS cut FROM h) SELECT key, round(h, 6) AS h FROM r WHERE i <= n AND h >= cut")
def abstain_seeds(spark, sf_dir):
    h = sequence_rows(spark, sf_dir).where("k = 2").groupBy("key").agg(entropy(F.col("p")).alias("h"))
    return abstentions(h).select("key", r6("h").alias("h"))


@query(f"WITH {SEQ}, h AS (SELECT key, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) AS h FROM seq WHERE k = 2 GROUP BY 1) SELECT 'turn' AS source, (SELECT count(*) FROM conversations WHERE role = 'assistant') AS n UNION ALL SELECT 'seeded_abstention', (SELECT greatest(1, round_even(count(*) * {ABSTAIN_FRACTION}, 0))::BIGINT FROM h)")
def trainset_union(spark, sf_dir):
    """Turn examples and seeded abstentions together (a bag union)."""
    h = sequence_rows(spark, sf_dir).where("k = 2").groupBy("key").agg(entropy(F.col("p")).alias("h"))
    both = examples(table(spark, sf_dir, "conversations")).select(F.lit("turn").alias("source")).unionByName(abstentions(h).select(F.lit("seeded_abstention").alias("source")))
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {RANKED} SELECT key, 'After {{n}} results these are most likely: ' || string_agg('label_' || label || ' ' || format('{{:.2f}}', p), ', ' ORDER BY rank) || '.' AS reasoning FROM rk WHERE rank <= 3 GROUP BY key".replace("{n}", "64"))
def blind_reasoning(spark, sf_dir):
    """Reasoning from the visible posterior alone."""
    r = ranked(posterior_rows(spark, sf_dir)).where("rank <= 3")
    said = F.format_string("label_%d %.2f", F.col("label"), F.col("p"))
    g = r.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", said.alias("s")))).alias("x"))
    return g.select("key", F.concat(F.format_string("After %d results these are most likely: ", F.lit(64)), F.array_join(F.transform("x", lambda s: s["s"]), ", "), F.lit(".")).alias("reasoning"))


def blind_text(top: DataFrame) -> DataFrame:
    """(key, reasoning) from a posterior's best labels (key, label, rank, p)
    alone: nothing of the truth enters."""
    said = F.format_string("label_%d %.2f", F.col("label"), F.col("p"))
    g = top.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", said.alias("s")))).alias("x"))
    return g.select("key", F.array_join(F.transform("x", lambda s: s["s"]), ", ").alias("reasoning"))


def privileged_text(top: DataFrame) -> DataFrame:
    """(key, reasoning) that names the truth: a positive control only."""
    return top.where("rank = 1").select("key", F.format_string("It is label_%d.", F.col("truth")).alias("reasoning"))


def swapped(top: DataFrame, text) -> DataFrame:
    """How many rows' text changes if their truth is another: (checked, changed)."""
    other = text(top.withColumn("truth", (F.col("truth") + 1) % 10)).withColumnRenamed("reasoning", "other")
    return text(top).join(other, "key").agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("reasoning") != F.col("other")).alias("changed"))


@query(f"WITH {RANKED}, t AS (SELECT key, truth, string_agg('label_' || label || ' ' || format('{{:.2f}}', p), ', ' ORDER BY rank) FILTER (rank <= 3) AS blind FROM rk GROUP BY 1, 2), o AS (SELECT key, string_agg('label_' || label || ' ' || format('{{:.2f}}', p), ', ' ORDER BY rank) FILTER (rank <= 3) AS blind FROM (SELECT *, (truth + 1) % 10 AS swapped FROM rk) GROUP BY key, swapped) SELECT 'blind' AS text, count(*) AS checked, count_if(t.blind <> o.blind)::BIGINT AS changed FROM t JOIN o USING (key) UNION ALL SELECT 'privileged', count(*), count_if('label_' || truth <> 'label_' || (truth + 1) % 10)::BIGINT FROM t")
def label_swap(spark, sf_dir):
    """Reasoning that must not change with the truth, and a control that must."""
    top = ranked(posterior_rows(spark, sf_dir)).where("rank <= 3")
    return swapped(top, blind_text).withColumn("text", F.lit("blind")).unionByName(swapped(top, privileged_text).withColumn("text", F.lit("privileged")))


@query(f"""WITH {RANKED}, n AS (SELECT key, label, rank, p, round(p, 2) + CASE WHEN rank = 2 AND key % 3 = 0 THEN 0.05 ELSE 0 END AS said FROM rk WHERE rank <= 3 OR (rank = 4 AND key % 5 = 0))
SELECT a.key AS turn_id, 'label_' || a.label AS label, CASE WHEN a.rank > 3 THEN 'unearned_mention' ELSE 'ungrounded_assertion' END AS kind FROM n a JOIN n b ON a.key = b.key AND b.rank >= a.rank GROUP BY a.key, a.label, a.rank HAVING a.rank > 3 OR NOT bool_or(abs(b.said - a.p) <= {TOLERANCE} + 1e-9)""")
def grounding_numbers(spark, sf_dir):
    """Reasoning with wrong numbers and a label beyond the first three, checked
    against the belief that it should come from."""
    r = ranked(posterior_rows(spark, sf_dir))
    said = r.where("rank <= 3 OR (rank = 4 AND key % 5 = 0)").withColumn("said", F.round("p", 2) + F.when((F.col("rank") == 2) & (F.col("key") % 3 == 0), 0.05).otherwise(0.0))
    turns = blind_text(said.select("key", "label", "rank", F.col("said").alias("p"))).select(F.col("key").alias("turn_id"), F.col("reasoning").alias("text"))
    beliefs = r.select(F.col("key").alias("turn_id"), F.format_string("label_%d", F.col("label")).alias("label"), "p", "rank")
    names = r.select("label").distinct().select(F.format_string("label_%d", F.col("label")).alias("label"), F.format_string("label_%d", F.col("label")).alias("form"))
    return grounding_findings(turns, beliefs, names)


@query("SELECT conv_id, turn, role, text IS NULL OR trim(text) = '' AS empty, role = 'assistant' AND length(text) < 60 AS stub FROM conversations")
def case_text_checks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", "role", (F.col("text").isNull() | (F.trim("text") == "")).alias("empty"), ((F.col("role") == "assistant") & (F.length("text") < 60)).alias("stub"))


@query("WITH a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, length(text) AS n FROM conversations WHERE role = 'assistant') SELECT conv_id, turn, CASE WHEN n > 600 THEN 'truncated' WHEN n < 60 THEN 'unparseable' ELSE 'parsed' END AS status FROM a")
def gen_finish(spark, sf_dir):
    """Finish reasons: cut off at the length limit, unparseable, parsed."""
    a = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    n = F.length("text")
    return a.select("conv_id", "turn", F.when(n > 600, "truncated").when(n < 60, "unparseable").otherwise("parsed").alias("status"))


@query("SELECT conv_id, turn FROM conversations c WHERE turn > 0 AND NOT EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1)")
def gen_align(spark, sf_dir):
    """Turns whose predecessor is missing: a log out of step with its prompts."""
    c = table(spark, sf_dir, "conversations").where("turn > 0").select("conv_id", "turn")
    p = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("turn"))
    return c.join(p, ["conv_id", "turn"], "left_anti")


@query("SELECT vec_id AS key, 'RECORD ' || vec_id || chr(10) || string_agg('d' || dim || ': ' || printf('%.4g', v) || ' (ref -0.5 to 0.5)', chr(10) ORDER BY dim) AS sheet FROM (SELECT vec_id, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY vec_id")
def case_text(spark, sf_dir):
    """A record's sheet: its values to four digits beside their references."""
    ev = evidence(spark, sf_dir)
    line = F.concat(F.lit("d"), F.col("dim").cast("string"), F.lit(": "), general(F.col("value")), F.lit(" (ref -0.5 to 0.5)"))
    rows = ev.select("key", "dim", line.alias("line")).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("dim", "line"))).alias("x"))
    return rows.select("key", F.concat(F.lit("RECORD "), F.col("key").cast("string"), F.lit("\n"), F.array_join(F.transform("x", lambda s: s["line"]), "\n")).alias("sheet"))


@query("SELECT conv_id, turn, '[{\"role\":\"system\",\"content\":\"Report a distribution.\"},{\"role\":\"user\",\"content\":' || to_json(text) || '}]' AS messages FROM conversations WHERE role = 'user'")
def chat(spark, sf_dir):
    """Chat messages of each user turn, as compact JSON."""
    u = table(spark, sf_dir, "conversations").where("role = 'user'")
    said = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return u.select("conv_id", "turn", F.to_json(F.array(said("system", F.lit("Report a distribution.")), said("user", F.col("text")))).alias("messages"))


@query("WITH p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS nth, role FROM conversations WHERE length(text) < 60) SELECT role, conv_id, turn FROM p WHERE nth <= 40")
def failure_sample(spark, sf_dir):
    """At most forty unusable generations of each role, for inspection."""
    c = table(spark, sf_dir, "conversations").where(F.length("text") < 60)
    nth = F.row_number().over(W.partitionBy("role").orderBy("conv_id", "turn"))
    return c.withColumn("nth", nth).where("nth <= 40").select("role", "conv_id", "turn")


LEAST_ENTROPY, LEAST_ABSTAIN = 0.25, 0.02


@query(f"WITH {SEQ}, h AS (SELECT key, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) AS h FROM seq WHERE k = 2 GROUP BY 1), a AS (SELECT count(*) AS n, greatest(1, round_even(count(*) * {ABSTAIN_FRACTION}, 0)) AS m, avg(h) AS e FROM h) SELECT n, round(m / (n + m), 6) AS abstain_fraction, round(e, 6) AS mean_target_entropy, e >= {LEAST_ENTROPY} AND m / (n + m) >= {LEAST_ABSTAIN} AS valid FROM a")
def trainset_targets(spark, sf_dir):
    """Whether soft targets stay uncertain enough and abstentions are many
    enough: n, their share, the mean entropy, and both floors."""
    h = sequence_rows(spark, sf_dir).where("k = 2").groupBy("key").agg(entropy(F.col("p")).alias("h"))
    a = h.agg(F.count(F.lit(1)).alias("n"), F.avg("h").alias("e"), F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * ABSTAIN_FRACTION)).alias("m"))
    share = F.col("m") / (F.col("n") + F.col("m"))
    return a.select("n", r6(share).alias("abstain_fraction"), r6("e").alias("mean_target_entropy"), ((F.col("e") >= LEAST_ENTROPY) & (share >= LEAST_ABSTAIN)).alias("valid"))
