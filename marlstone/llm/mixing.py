"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash and may be passed over up to
``PASSES`` times.  A passage of a document has a virtual finish time: the words
of its source up to and with it, divided by the source's target.  Served in
order of finish time, all sources advance in proportion to their targets; the
mix is every passage up to the total budget.

The order is global, but no row needs to know its global position.  Rows that
agree in id, size and text are one *entry* with a number of rows, whose finish
times follow by arithmetic.  The targets add up to the budget, so at time 1 what
is served falls short of it by less than one document of each source: only the
passages that finish soon after are sorted to find the last one served, and how
many these are depends on the number of sources, not of documents.  Each
source's share then is a number of whole passes, a last entry and how many of
its rows are served, so the full rows (with their texts) are judged where they
lie, by a join with one row per source.

Targets: total size shared by weight, capped at ``PASSES`` times a source's
size, the excess reshared by weight (water filling in closed form over the
sources sorted by cap / weight).

Edge cases: a null or blank text has size 0 and is taken 0 words; a source
without words has target 0; the null source comes last; rows that repeat are
passed one by one, and which of them are passed once more is left to where they
lie; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import documents, n_words, packed, sent_if_small, written

PASSES = 3
WEIGHTS = (1, 2, 3)
SEED = "mix"


def order_key(doc_id: Column, size: Column, text: Column) -> Column:
    """Place of a document in its source's shuffled order; rows that agree in
    id, size and text share it."""
    key = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return F.concat_ws(":", F.md5(F.concat(F.lit(SEED + ":"), key)), key, size.cast("string"), F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 12))


def targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """source, source_size, rank and target of each source (one row each)."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumns({"weight": weight, "cap": PASSES * F.col("source_size")})
    by = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    below, all_rows = by.rowsBetween(W.unboundedPreceding, -1), W.orderBy("rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(below), F.lit(0))
    heft = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(below), F.lit(0))
    ranked = ranked.withColumns({"nth": F.row_number().over(by), "level": left.cast("double") / heft})
    fits = ranked.withColumn("fit", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("nth", "level")))
    level = F.min("fit").over(all_rows)["level"]
    return fits.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("weight"))).select("source", "source_size", "rank", "target")


def _queue(sized: DataFrame, per: DataFrame) -> DataFrame:
    """Every passage of every entry: rank, target, size, n (rows of the entry),
    ord, pass, and base (words of its source served before it)."""
    same = sized.where("size > 0").groupBy("source", "ord").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("n"))
    blocks = written(same.withColumn("block", F.substring("ord", 1, 3)), "entries")
    words = F.col("size") * F.col("n")
    sums = blocks.groupBy("source", "block").agg(F.sum(words).alias("s"))
    sums = sums.select(F.col("source").alias("b_source"), F.col("block").alias("b_block"), F.coalesce(F.sum("s").over(W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum(words).over(W.partitionBy("source", "block").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cum = blocks.withColumn("inner", inside).join(sums, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block")))
    t = per.select(F.col("source").alias("t_source"), "source_size", "rank", "target")
    cum = cum.join(t, F.col("source").eqNullSafe(F.col("t_source"))).where("target > 0")
    passes = cum.withColumn("pass", F.explode(F.array(*[F.lit(p) for p in range(PASSES)])))
    return passes.select("rank", "target", "size", "n", "ord", "pass", (F.col("pass") * F.col("source_size") + F.col("before") + F.col("inner")).alias("base"))


def _rows_until(time: Column) -> Column:
    """How many of an entry's rows finish until ``time``."""
    return F.greatest(F.lit(0), F.least(F.col("n"), F.floor((time * F.col("target") - F.col("base")) / F.col("size")))).cast("long")


def shares(sized: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """One row per source: source, source_size, target, and what the mix takes
    of it: ``passes`` whole ones, then the entries before ``last`` and
    ``last_rows`` of the ``last_n`` rows there.

    ``sized`` has source, size and ord (see :func:`order_key`) per document.
    """
    per = written(targets(sized, weights), "targets")
    queue = written(_queue(sized, per), "queue")
    place = lambda k: F.struct("pass", "ord", k.alias("k"), "n")
    one = queue.withColumn("k", _rows_until(F.lit(1.0)))
    early = one.groupBy("rank").agg(
        F.max(F.when(F.col("k") > 0, F.col("base") + F.col("k") * F.col("size"))).alias("served"), F.max(F.when(F.col("k") > 0, place(F.col("k")))).alias("at"),
        F.max("target").alias("target"), F.max("size").alias("longest"), F.max(F.col("base") + F.col("n") * F.col("size")).alias("most"),
    )
    early = written(early, "early")
    budget = per.agg(F.sum("source_size")).first()[0] or 0
    left, longest, aim = early.agg(F.lit(budget) - F.coalesce(F.sum("served"), F.lit(0)), F.sum(F.when(F.col("most") > F.col("target"), F.col("longest"))), F.sum(F.when(F.col("most") > F.col("target"), F.col("target")))).first()
    # passages that finish after 1: by then as many words are served as are left
    width = (longest or 0) / aim if aim else 0.0
    while True:
        end = F.lit(1.0 + width)
        after = one.withColumn("upto", _rows_until(end)).where("upto > k")
        got, more = queue.agg(F.sum((_rows_until(end) - _rows_until(F.lit(1.0))) * F.col("size")), F.max(F.col("n") - _rows_until(end))).first()
        if not width or not more or got > left:
            break
        width *= 2
    rows = after.withColumn("j", F.explode(F.sequence(F.col("k") + 1, F.col("upto")))).select("rank", "ord", "pass", "n", F.col("j").alias("k"), "size", ((F.col("base") + F.col("j") * F.col("size")).cast("double") / F.col("target")).alias("finish"))
    running = F.sum("size").over(W.orderBy("finish", "rank", "ord", "pass", "k").rowsBetween(W.unboundedPreceding, 0))
    late = rows.withColumn("running", running).where(F.col("running") <= left).groupBy("rank").agg(F.max(place(F.col("k"))).alias("late"))
    last = early.select("rank", "at").join(late, "rank", "left").select(F.col("rank").alias("l_rank"), F.greatest("at", "late").alias("l"))
    out = per.join(last, F.col("rank") == F.col("l_rank"), "left")
    number = lambda c: F.coalesce(c.cast("long"), F.lit(0))
    return written(out.select("source", "source_size", "target", number(F.col("l.pass")).alias("passes"), F.coalesce("l.ord", F.lit("")).alias("last"), number(F.col("l.k")).alias("last_rows"), number(F.col("l.n")).alias("last_n")), "shares")


def with_times(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Joins ``rows`` (source, size, ord and others) with their source's share
    and adds ``times``: how often the mix passes the document."""
    s = sent_if_small(per_source).withColumnRenamed("source", "s_source")
    extra = ["passes", "last", "last_rows", "last_n"]
    joined = rows.join(s, rows["source"].eqNullSafe(s["s_source"])).drop("s_source")
    cut = (F.col("ord") == F.col("last")) & (F.col("last_rows") < F.col("last_n"))
    times = lambda more: F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("passes") + more.cast("long")).cast("int")
    whole = joined.withColumn("times", times(F.col("ord") <= F.col("last")))
    if per_source.where("last_rows < last_n").isEmpty():
        return whole.drop(*extra)
    # an entry that is served in part: its rows are numbered by file, then inside
    tied = written(joined.where(cut).withColumn("rid", F.monotonically_increasing_id()).withColumn("file", F.shiftright("rid", 33)), "tied")
    counts = tied.groupBy("source", "file").agg(F.count(F.lit(1)).alias("c"))
    before = counts.select(F.col("source").alias("b_source"), F.col("file").alias("b_file"), F.coalesce(F.sum("c").over(W.partitionBy("source").orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    nth = F.col("before") + F.row_number().over(W.partitionBy("source", "file").orderBy("rid"))
    tied = tied.join(before, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("file") == F.col("b_file"))).withColumn("times", times(nth <= F.col("last_rows")))
    return whole.where(~cut).unionByName(tied.select(*whole.columns)).drop(*extra)


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is passed."""
    size = n_words(F.col("text"))
    place = order_key(F.col("doc_id"), F.col("size"), F.col("text"))
    sized = docs.select("source", size.alias("size"), "doc_id", "text").select("source", "size", place.alias("ord"))
    per_source = shares(written(sized, "sized"), weights)
    rows = packed(docs, F.col("source"), F.col("doc_id"), size.alias("size"), F.col("text")).withColumn("ord", place).drop("text")
    times = with_times(rows, per_source).where("times > 0")
    return times.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def op5_weighted_fair_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", n_words(F.col("text")).alias("size"), "text")
    sized = written(docs.select("doc_id", "source", "size", order_key(F.col("doc_id"), F.col("size"), F.col("text")).alias("ord")), "sized")
    rows = with_times(sized, shares(sized))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"), "source", "times")


OP5_SQL = rf"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
p AS (SELECT doc_id, source, size, md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) || ':' || coalesce(doc_id::VARCHAR, 'null') || ':' || size || ':' || substr(md5(text), 1, 12) AS ord FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY source, ord) AS nth FROM p),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM o GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank, {PASSES} * source_size AS cap FROM s),
w AS (SELECT *, ([{', '.join(map(str, WEIGHTS))}])[(rank - 1) % {len(WEIGHTS)} + 1] AS weight FROM r),
v AS (SELECT *, row_number() OVER q AS nth, ((sum(source_size) OVER () - coalesce(sum(cap) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS level FROM w WINDOW q AS (ORDER BY cap / weight, rank)),
t AS (SELECT source, source_size, rank, least(cap::DOUBLE, (SELECT coalesce(min_by(level, nth), 0) FROM v WHERE level * weight <= cap) * weight) AS target FROM v),
c AS (SELECT rank, source_size, target, size, ord, o.nth AS nth, sum(size) OVER (PARTITION BY rank ORDER BY ord, o.nth ROWS UNBOUNDED PRECEDING) AS cum
  FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source WHERE size > 0 AND target > 0),
e AS (SELECT *, (pass * source_size + cum)::DOUBLE / target AS finish FROM c, (SELECT unnest(range({PASSES})) AS pass)),
k AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, ord, pass, nth ROWS UNBOUNDED PRECEDING) AS running FROM e),
n AS (SELECT rank, ord, nth, count(*) AS times FROM k WHERE running <= (SELECT sum(size) FROM o) GROUP BY rank, ord, nth)
SELECT doc_id, size, source_size, target, (size * coalesce(times, 0))::BIGINT AS taken, o.source AS source, coalesce(times, 0) AS times
FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source LEFT JOIN n ON n.rank = t.rank AND n.ord = o.ord AND n.nth = o.nth"""
