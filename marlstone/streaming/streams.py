"""The run log as a stream: alerts, count-window monitors, ledger and roll-ups.

Each function builds a streaming DataFrame; :func:`drained` runs one over all
that is there (``availableNow``) and returns what it wrote.  Count windows are
state (a bounded deque per run), not event-time windows: rows count in order of
arrival, by (ts, event_id) inside a micro-batch; late rows are appended.
"""

from __future__ import annotations

import json
import math
import sys
from collections import deque
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from marlstone.plans.config import DEFAULT
from marlstone.plans.registry import query
from marlstone.sources.episode_log import stored_episodes, tail_log
from marlstone.sources.views import SQL, ctes, table
from marlstone.streaming.monitors import CEILING, COMMIT, COST, CRITERION, GROUPS, SLACK, STAGE_WINDOW, STAGES, advance

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run log, read as files arrive."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return events.selectExpr(*_columns(SQL["run_event"]))


def _columns(select: str) -> list[str]:
    """The expressions of a view's SELECT, to apply to a stream."""
    out, depth, part = [], 0, ""
    for word in select.removeprefix("SELECT ").rpartition(" FROM ")[0]:
        depth += (word == "(") - (word == ")")
        if word == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += word
    return [*out, part]


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; only a local master may do without one."""
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set")
        base = "file://" + tempfile.mkdtemp(prefix="spark-marlstone-")
    return base.rstrip("/")


def drained(df: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Run a stream over everything there is; rows end in the shared folder.
    With a ``folder`` of an earlier run the stream goes on where that stopped:
    its state and what it has read are kept there."""
    import uuid

    base = folder or f"{shared_folder(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    schema = df.schema

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")

    df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(schema.add("epoch", "long")).parquet(f"{base}/out")


class Halted(RuntimeError):
    """A run was stopped by an alert."""


def until_alert(alerts: DataFrame, folder: str | None = None) -> None:
    """Run a stream of alerts (event_id, ...) and stop it at the first one."""
    import uuid

    base = folder or f"{shared_folder(alerts.sparkSession)}/halt-{uuid.uuid4().hex}"

    def stop(batch: DataFrame, epoch: int) -> None:
        first = batch.orderBy("event_id").limit(1).collect()
        if first:
            raise Halted(f"event {first[0].event_id} is above its ceiling")

    alerts.writeStream.foreachBatch(stop).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()


def ceiling_alerts(events: DataFrame) -> DataFrame:
    """Episodes above their own hard ceiling; a sink may halt the run on one."""
    return events.where(F.col("reward") > F.col("hard_ceiling") + 1e-6).select("event_id", "run_id", "reward")


@query("SELECT event_id, user_id % 4 AS run_id, value / 100.0 - 1.0 AS reward FROM events WHERE value / 100.0 - 1.0 > 4 + 1e-6")
def st_ceiling_halt(spark, sf_dir):
    return drained(ceiling_alerts(stream(spark, sf_dir))).drop("epoch")


@query("SELECT CAST(user_id % 4 AS INT) AS run_id, date_trunc('day', ts) AS day, count(*) AS n, round(avg(value / 100.0 - 1.0), 6) AS reward FROM events GROUP BY 1, 2")
def st_roll_up(spark, sf_dir):
    """Metrics by run and day, in complete mode."""
    g = stream(spark, sf_dir).groupBy("run_id", F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("reward"), 6).alias("reward"))
    out = drained(g, "complete")
    last = out.agg(F.max("epoch").alias("last"))
    return out.join(F.broadcast(last), F.col("epoch") == F.col("last")).select("run_id", "day", "n", "reward")


@query(f"WITH {ctes('charged', 'episode')}, s AS (SELECT episode_id, count(*) AS n, sum(cost_charged) AS spent FROM charged GROUP BY 1) SELECT policy AS run_id, termination_reason, count(*) AS episodes, sum(coalesce(n, 0))::BIGINT AS steps, round(sum(coalesce(spent, 0)), 4) AS spent FROM episode LEFT JOIN s USING (episode_id) GROUP BY 1, 2")
def st_log_tail(spark, sf_dir):
    """The stored log, written as JSON by run and tailed from there: episodes,
    steps and spending by run and ending."""
    import uuid

    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    rows = stored_episodes(spark, sf_dir)
    rows.withColumn("run_id", F.col("tags")["policy"]).write.partitionBy("run_id").json(path)
    spent = F.aggregate("trajectory.steps", F.lit(0.0), lambda a, s: a + s["cost_charged"])
    flat = tail_log(spark, path).select("run_id", "trajectory.termination_reason", F.size("trajectory.steps").alias("n"), spent.alias("spent"))
    return drained(flat).groupBy("run_id", "termination_reason").agg(F.count(F.lit(1)).alias("episodes"), F.sum("n").alias("steps"), F.round(F.sum("spent"), 4).alias("spent"))


@query("SELECT count(*) AS rows, count(DISTINCT event_id) AS events FROM events")
def st_duplicates(spark, sf_dir):
    """Rows delivered twice count once, within the watermark."""
    s = stream(spark, sf_dir)
    twice = s.unionByName(s).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["event_id"])
    return drained(twice.select("event_id", "ts")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("event_id").alias("events"))


#: Rows that leave a processor at once.
ROWS = 10_000


def _in_order(rows: Iterator[pd.DataFrame], *numbers: Callable[[pd.DataFrame], pd.Series]) -> Iterator[tuple]:
    """A micro-batch's rows of one key by (ts, event_id), as event_id and
    ``numbers``.  A micro-batch may be a whole log, so of a row nothing else is
    kept, and what is kept lies in arrays."""
    parts: list[list[np.ndarray]] = [[] for _ in range(2 + len(numbers))]
    for p in rows:
        for part, column in zip(parts, (p["ts"], p["event_id"], *(f(p) for f in numbers))):
            part.append(column.to_numpy(copy=True))
    columns = []
    while parts:
        columns.append(np.concatenate(parts.pop(0)))
    order = np.lexsort((columns[1], columns.pop(0)))
    for i in range(0, len(order), ROWS):
        yield from zip(*(c[order[i : i + ROWS]].tolist() for c in columns))


def _frames(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Result rows as frames of bounded size."""
    while part := list(islice(rows, ROWS)):
        yield pd.DataFrame(part, columns=columns)


class CommitMonitor(StatefulProcessor):
    """Alerts when too few of a run's last episodes end in a diagnosis."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getValueState("recent", StructType([StructField("flags", StringType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from _frames(self.judged(rows), ["event_id", "alert", "hits"])

    def judged(self, rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        flags = self.recent.get()[0] if self.recent.exists() else ""
        for event_id, hit in _in_order(rows, lambda p: p["termination_reason"] == "diagnose"):
            flags = (flags + ("1" if hit else "0"))[-COMMIT:]
            share = flags.count("1") / len(flags)
            yield event_id, len(flags) >= COMMIT // 2 and share < 0.1, flags.count("1")
        self.recent.update((flags,))

    def close(self) -> None:
        pass


class WindowMonitor(StatefulProcessor):
    """A rule over a run's last ``n`` rows, with a half-window warm-up.  A row
    adds a list of numbers; the rule sees the sums of those in the window, and
    how many rows they are of.  Sums of whole numbers are carried from row to
    row, which is exact; others are taken anew."""

    whole = False

    def __init__(self, n: int) -> None:
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getValueState("recent", StructType([StructField("rows", StringType())]))

    def numbers(self) -> list[Callable[[pd.DataFrame], pd.Series]]:
        raise NotImplementedError

    def alert(self, sums: list[float], k: int) -> bool:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from _frames(self.judged(rows), ["event_id", "alert", "total"])

    def judged(self, rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        recent = deque(json.loads(self.recent.get()[0]) if self.recent.exists() else [])
        carried = [math.fsum(c) for c in zip(*recent)]
        for event_id, *x in _in_order(rows, *self.numbers()):
            gone = recent.popleft() if len(recent) == self.n else [0.0] * len(x)
            recent.append(x)
            if self.whole:
                carried = [s + new - old for s, new, old in zip(carried or [0.0] * len(x), x, gone)]
            sums = carried if self.whole else [math.fsum(c) for c in zip(*recent)]
            yield event_id, len(recent) >= self.n // 2 and self.alert(sums, len(recent)), sums[0]
        self.recent.update((json.dumps(list(recent)),))

    def close(self) -> None:
        pass


class CeilingMonitor(WindowMonitor):
    """Mean reward above the mean of the expected ceiling."""

    def numbers(self) -> list[Callable[[pd.DataFrame], pd.Series]]:
        return [lambda p: p["reward"], lambda p: p["expected_ceiling"]]

    def alert(self, sums: list[float], k: int) -> bool:
        return sums[0] / k > sums[1] / k + SLACK


class CostMonitor(WindowMonitor):
    """Nearly all without tests, or most at the cap."""

    whole = True

    def numbers(self) -> list[Callable[[pd.DataFrame], pd.Series]]:
        return [lambda p: p["n_tests"] == 0, lambda p: p["n_tests"] >= 7]

    def alert(self, sums: list[float], k: int) -> bool:
        return sums[0] / k > 0.95 or sums[1] / k > 0.5


#: Episodes of a group on a stream.
K = 8


class DegenerateMonitor(StatefulProcessor):
    """Most of a run's last groups have no spread.  A group is complete when its
    ``K`` episodes are in; open groups wait in the state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("groups", StructType([StructField("v", StringType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from _frames(self.judged(rows), ["event_id", "alert", "total"])

    def judged(self, rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        state = json.loads(self.state.get()[0]) if self.state.exists() else {"open": {}, "flat": []}
        flat = deque(state["flat"], maxlen=GROUPS)
        for event_id, group_id, reward in _in_order(rows, lambda p: p["group_id"], lambda p: p["reward"]):
            group = state["open"].setdefault(str(group_id), [])
            group.append(reward)
            if len(group) == K:
                flat.append(int(max(group) - min(group) < 1e-6))
                del state["open"][str(group_id)]
                yield event_id, len(flat) >= GROUPS // 2 and sum(flat) / len(flat) > 0.5, float(sum(flat))
        self.state.update((json.dumps({"open": state["open"], "flat": list(flat)}),))

    def close(self) -> None:
        pass


class Stages(StatefulProcessor):
    """The stage rule over a stream of (run_id, step, reward).  The state keeps
    the configuration's hash; a restart under another one is refused."""

    def __init__(self, config: str) -> None:
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("stage", StructType([StructField("v", StringType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from _frames(self.staged(key[0], rows), ["run_id", "event_id", "stage"])

    def staged(self, run_id: int, rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        config, stage, recent = self.config, 0, []
        if self.state.exists():
            config, stage, recent = self.state.get()[0].split("|")
            stage, recent = int(stage), [float(x) for x in recent.split(",") if x]
        if config != self.config:
            raise ValueError("the run was started under another configuration")
        for event_id, reward in _in_order(rows, lambda p: p["reward"]):
            stage, recent = advance(stage, recent, reward)
            yield run_id, event_id, stage
        self.state.update((f"{config}|{stage}|{','.join(map(repr, recent))}",))

    def close(self) -> None:
        pass


class Ledger(StatefulProcessor):
    """The ledger of an episode over a stream: a repeat is free, what cannot be
    paid is refused, and nothing counts after the end."""

    BUDGET = 100.0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ledger", StructType([StructField("v", StringType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from _frames(self.entered(rows), ["event_id", "outcome", "cost"])

    def entered(self, rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        spent, had, ended = self.state.get()[0].split("|") if self.state.exists() else ("0.0", "", "")
        spent, had = float(spent), set(filter(None, had.split(",")))
        for event_id, n_tests, concluded in _in_order(rows, lambda p: p["n_tests"], lambda p: p["termination_reason"] == "diagnose"):
            test, price = str(n_tests), float(1 + n_tests)
            if ended:
                outcome, cost = "after_end", 0.0
            elif concluded and n_tests == 7:
                outcome, cost, ended = "end", 0.0, "1"
            elif test in had:
                outcome, cost = "duplicate", 0.0
            elif price > self.BUDGET - spent + 1e-9:
                outcome, cost = "refused", 0.0
            else:
                outcome, cost = "charged", price
                spent, had = spent + price, had | {test}
            yield event_id, outcome, cost
        self.state.update((f"{spent!r}|{','.join(sorted(had))}|{ended}",))

    def close(self) -> None:
        pass


def _stateful(spark: SparkSession, df: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return df.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None")


@query(f"WITH e AS ({SQL['run_event'].replace('{events}', 'events')}) SELECT event_id, count(*) OVER w >= {COMMIT // 2} AND avg((termination_reason = 'diagnose')::INT) OVER w < 0.1 AS alert, (sum((termination_reason = 'diagnose')::INT) OVER w)::BIGINT AS hits FROM e WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id ROWS {COMMIT - 1} PRECEDING)")
def st_commit_monitor(spark, sf_dir):
    """The commit monitor as state; equal to its batch twin."""
    return drained(_stateful(spark, stream(spark, sf_dir), "run_id", CommitMonitor(), "event_id long, alert boolean, hits long")).drop("epoch")


_E = f"WITH e AS ({SQL['run_event'].replace('{events}', 'events')})"
_ALERTS = "event_id long, alert boolean, total double"


@query(f"{_E} SELECT event_id, count(*) OVER w >= {CEILING // 2} AND avg(reward) OVER w > avg(expected_ceiling) OVER w + {SLACK} AS alert, round(sum(reward) OVER w, 4) AS total FROM e WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id ROWS {CEILING - 1} PRECEDING)")
def st_ceiling_monitor(spark, sf_dir):
    """The ceiling monitor as state; equal to its batch twin."""
    out = drained(_stateful(spark, stream(spark, sf_dir), "run_id", CeilingMonitor(CEILING), _ALERTS))
    return out.select("event_id", "alert", F.round("total", 4).alias("total"))


@query(f"{_E} SELECT event_id, count(*) OVER w >= {COST // 2} AND (avg((n_tests = 0)::INT) OVER w > 0.95 OR avg((n_tests >= 7)::INT) OVER w > 0.5) AS alert, sum((n_tests = 0)::INT) OVER w::DOUBLE AS total FROM e WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id ROWS {COST - 1} PRECEDING)")
def st_cost_monitor(spark, sf_dir):
    """The cost monitor as state; equal to its batch twin."""
    return drained(_stateful(spark, stream(spark, sf_dir), "run_id", CostMonitor(COST), _ALERTS)).drop("epoch")


@query(f"{_E}, n AS (SELECT *, (row_number() OVER (PARTITION BY run_id, group_id ORDER BY ts, event_id) - 1) // {K} AS g FROM e), c AS (SELECT run_id, group_id, g, max(ts) AS ts, max_by(event_id, (ts, event_id)) AS event_id, max(reward) - min(reward) < 1e-6 AS flat FROM n GROUP BY 1, 2, 3 HAVING count(*) = {K}) SELECT event_id, count(*) OVER w >= {GROUPS // 2} AND avg(flat::INT) OVER w > 0.5 AS alert, (sum(flat::INT) OVER w)::DOUBLE AS total FROM c WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id ROWS {GROUPS - 1} PRECEDING)")
def st_degenerate_monitor(spark, sf_dir):
    """The monitor of flat groups as state; equal to its batch twin."""
    return drained(_stateful(spark, stream(spark, sf_dir), "run_id", DegenerateMonitor(), _ALERTS)).drop("epoch")


_STAGE = """st AS (SELECT run_id, event_id, reward, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS i FROM e),
f AS (SELECT DISTINCT run_id, 0::BIGINT AS i, 0::BIGINT AS event_id, 0 AS stage, []::DOUBLE[] AS recent FROM st UNION ALL
 SELECT run_id, i, event_id, CASE WHEN up THEN stage + 1 ELSE stage END, CASE WHEN up THEN [] ELSE recent END FROM (
  SELECT *, stage < {s} AND len(recent) = {w} AND list_sum(recent) / {w} >= {c} AS up FROM (
   SELECT st.run_id, st.i, st.event_id, f.stage, list_append(f.recent, st.reward)[-{w}:] AS recent FROM f JOIN st ON st.run_id = f.run_id AND st.i = f.i + 1)))""".format(s=STAGES, w=STAGE_WINDOW, c=CRITERION)


@query(f"{_E.replace('WITH', 'WITH RECURSIVE')}, {_STAGE} SELECT run_id, event_id, stage FROM f WHERE i > 0")
def st_stage_advance(spark, sf_dir):
    return drained(_stateful(spark, stream(spark, sf_dir), "run_id", Stages(DEFAULT.hash()), "run_id int, event_id long, stage int")).drop("epoch")


@query(f"""{_E.replace('WITH', 'WITH RECURSIVE')}, o AS (SELECT group_id, event_id, n_tests, termination_reason, row_number() OVER (PARTITION BY group_id ORDER BY ts, event_id) AS i FROM e),
f AS (SELECT DISTINCT group_id, 0::BIGINT AS i, 0::BIGINT AS event_id, 0.0::DOUBLE AS spent, []::INT[] AS had, false AS ended, '' AS outcome, 0.0::DOUBLE AS cost FROM o UNION ALL
 SELECT group_id, i, event_id, spent + cost, CASE WHEN outcome = 'charged' THEN list_append(had, t) ELSE had END, outcome IN ('end', 'after_end'), outcome, cost FROM (
  SELECT *, CASE WHEN outcome = 'charged' THEN 1.0 + t ELSE 0.0 END AS cost FROM (
   SELECT o.group_id, o.i, o.event_id, f.spent, f.had, o.n_tests AS t, CASE WHEN f.ended THEN 'after_end' WHEN o.termination_reason = 'diagnose' AND o.n_tests = 7 THEN 'end' WHEN list_contains(f.had, o.n_tests) THEN 'duplicate' WHEN 1.0 + o.n_tests > 100.0 - f.spent + 1e-9 THEN 'refused' ELSE 'charged' END AS outcome
   FROM f JOIN o ON o.group_id = f.group_id AND o.i = f.i + 1)))
SELECT event_id, outcome, cost FROM f WHERE i > 0""")
def st_ledger(spark, sf_dir):
    return drained(_stateful(spark, stream(spark, sf_dir), "group_id", Ledger(), "event_id long, outcome string, cost double")).drop("epoch")
