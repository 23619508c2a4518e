"""The append-only log of generations: one JSON line for each attempt at a turn.

A generation that was cut off at its limit is asked for again; the last attempt
of a request counts.  A log in which a line's prompt does not name the case that
the line is filed under is out of step with its prompts: every action would be
legal and belong to another episode, so nothing of it can be used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marlstone.operators.scoring import r6
from marlstone.plans.registry import query
from marlstone.sources.views import table

LINE = "conv_id bigint, turn bigint, attempt int, limit int, finish_reason string, prompt string, text string"
ACTION = "action_id string, reason string"
#: Characters of a first attempt; a second one has twice as many.
LIMIT = 400


def read_lines(lines: DataFrame) -> DataFrame:
    """Rows of ``LINE`` from JSON text (line); a malformed line is an error."""
    return lines.select(F.from_json("line", LINE, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def marker(conv_id: Column, turn: Column) -> Column:
    """What the prompt of a turn says of its case."""
    return F.concat(F.lit("CASE "), conv_id.cast("string"), F.lit(" (turn "), turn.cast("string"), F.lit(")"))


def settled(log: DataFrame) -> DataFrame:
    """One row a request: conv_id, turn, attempts, status and the last text.

    status: 'misaligned' (a prompt that is given does not name the case),
    'truncated' (the last attempt was cut off), 'unparseable', or 'parsed'.
    Equal attempt numbers are decided by their whole rows, so reruns agree.
    Combined map-side: a request's attempts are few, but may be anywhere.
    """
    off = F.col("prompt").isNotNull() & ~F.contains("prompt", marker(F.col("conv_id"), F.col("turn")))
    last = F.max(F.struct("attempt", "limit", "finish_reason", "text"))
    per = log.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("attempts"), last.alias("last"), F.bool_or(off).alias("off"))
    action = F.from_json("last.text", ACTION, {"mode": "PERMISSIVE"})
    status = F.when(F.col("off"), "misaligned").when(F.col("last.finish_reason") == "length", "truncated").when(action["action_id"].isNull(), "unparseable").otherwise("parsed")
    return per.select("conv_id", "turn", "attempts", status.alias("status"), F.col("last.text").alias("text"), action["action_id"].alias("action_id"))


def actions(log: DataFrame, strict: bool = True) -> DataFrame:
    """(conv_id, turn, action_id).  A misaligned line is an error always; strictly
    so is any other failure, else its action is null: there is no stand-in for
    what a policy was going to do."""
    s = settled(log)
    bad = F.col("status") == "misaligned" if not strict else F.col("status") != "parsed"
    stop = F.raise_error(F.concat(marker(F.col("conv_id"), F.col("turn")), F.lit(": "), "status")).cast("string")
    return s.select("conv_id", "turn", F.when(bad, stop).when(F.col("status") == "parsed", F.col("action_id")).alias("action_id"))


def conversation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines (line) of a log in which the assistants' turns were generated: what
    is longer than its limit is cut off and tried again, some turns are filed
    under another case, and some texts are no JSON to begin with."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    whole = F.to_json(F.struct(F.concat(F.lit("a"), F.col("turn").cast("string")).alias("action_id"), F.col("text").alias("reason")))
    whole = F.when((F.col("conv_id") % 7 == 0) & (F.col("turn") % 4 == 1), F.concat(F.lit("Sure: "), whole)).otherwise(whole)
    c = c.select("conv_id", "turn", whole.alias("whole"), F.length(whole).alias("n"))
    tries = c.withColumn("attempt", F.explode(F.when(F.col("n") > LIMIT, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    limit = F.lit(LIMIT) * (1 + F.col("attempt"))
    case = F.when((F.col("conv_id") % 29 == 3) & (F.col("turn") == 1), F.col("conv_id") + 1).otherwise(F.col("conv_id"))
    rows = tries.select("conv_id", "turn", "attempt", limit.alias("limit"), F.when(F.col("n") > limit, "length").otherwise("stop").alias("finish_reason"), F.concat(marker(case, F.col("turn")), F.lit(" What next?")).alias("prompt"), F.substr("whole", F.lit(1), limit).alias("text"))
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("line"))


_GEN = f"""w AS (SELECT conv_id, turn, CASE WHEN conv_id % 7 = 0 AND turn % 4 = 1 THEN 'Sure: ' ELSE '' END || to_json({{'action_id': 'a' || turn, 'reason': text}}) AS whole FROM conversations WHERE role = 'assistant'),
g AS (SELECT conv_id, turn, CASE WHEN length(whole) > {LIMIT} THEN 2 ELSE 1 END AS attempts, CASE WHEN conv_id % 29 = 3 AND turn = 1 THEN 'misaligned' WHEN length(whole) > {2 * LIMIT} THEN 'truncated' WHEN NOT json_valid(whole) THEN 'unparseable' ELSE 'parsed' END AS status FROM w)"""


@query(f"WITH {_GEN} SELECT conv_id, turn, attempts::BIGINT AS attempts, status, CASE WHEN status = 'parsed' THEN 'a' || turn END AS action_id FROM g")
def gen_settled(spark, sf_dir):
    """Every request of the log with its last attempt's outcome."""
    s = settled(read_lines(conversation_log(spark, sf_dir)))
    return s.select("conv_id", "turn", "attempts", "status", F.when(F.col("status") == "parsed", F.col("action_id")).alias("action_id"))


@query(f"WITH {_GEN} SELECT turn, count(*) AS requests, sum(attempts)::BIGINT AS attempts, round(avg((status = 'parsed')::INT), 6) AS schema_valid_fraction, count_if(status = 'misaligned')::BIGINT AS misaligned, count_if(status = 'truncated')::BIGINT AS truncated FROM g GROUP BY 1")
def gen_valid(spark, sf_dir):
    """The share of requests that gave an action, by turn."""
    s = settled(read_lines(conversation_log(spark, sf_dir)))
    n = lambda k: F.count_if(F.col("status") == k).alias(k)
    return s.groupBy("turn").agg(F.count(F.lit(1)).alias("requests"), F.sum("attempts").alias("attempts"), r6(F.avg((F.col("status") == "parsed").cast("int"))).alias("schema_valid_fraction"), n("misaligned"), n("truncated"))
