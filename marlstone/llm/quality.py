"""Quality rules with adaptive thresholds (native).

Every document is measured once, inside its own row: counts of words, symbols,
capitals, repeated lines and repeated three-word windows.  Each ratio is then
summarised per language and source in a mergeable quantile sketch: a table of
log-linear buckets (``SIG_BITS`` leading bits are kept, so a bucket is within
2**-(SIG_BITS-1) of its values) with their counts.  Sketches of a language, or
of everything, are sums of their parts' rows; a group's sketch borrows
``BORROWED`` rows of its language's, and that as many of everything's, so that
small groups borrow and no size switches anything.

No ratio has a cutoff or a least spread of its own.  A group's fence stands where
the half of its sketch beyond the median falls apart into two classes: of all
buckets at which it can be cut the one with the largest variance between the
classes, halfway between their means, if these are at least ``APART`` of the
classes' common deviations apart.  A deviation includes what one event (a symbol,
a repeated line) makes in a document of the group, so that the first document
with one symbol is no outlier.  Otherwise nothing there is an outlier, and there
is no fence.  A document is rejected when a ratio lies beyond its group's fences,
or when it fails the fixed base rules; sketches are of those that pass them.

Edge cases: a null text counts as empty (0 words, fails the base rule); null
language or source is a group of its own; an empty table gives an empty result;
rows that repeat are judged one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import WORD_CLASS, documents, sent_if_small, words, written

SIG_BITS = 6
#: Rows that a group borrows from the next larger one.
BORROWED = 100
#: Deviations between the means of what counts as two classes; the halves of a
#: uniform distribution are 3.46 apart.
APART = 3.5
#: Weight of a row, so that borrowed parts of rows are integers.
ROW = 1000
#: ratio -> whether low values are judged too
RATIOS = {"symbol_milli": False, "upper_milli": False, "dup_milli": False, "repeat_milli": False, "word_len_milli": True}
#: ratio -> (what one event adds to its count, the count it is a share of); one
#: repeated window is two windows of three words
EVENTS = {"symbol_milli": (1, "n_words"), "upper_milli": (1, "word_chars"), "dup_milli": (1, "n_lines"), "repeat_milli": (6, "n_words"), "word_len_milli": (0, "n_words")}
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
FENCES = tuple(f"hi_{r}" for r in RATIOS) + tuple(f"lo_{r}" for r, low in RATIOS.items() if low)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines")


def _repeat_words(w: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the array."""
    hashed = F.transform(w, lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")))
    return F.when(F.size(w) < 4, F.array().cast("array<struct<h:bigint,p:int>>")).otherwise(F.sort_array(F.slice(hashed, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))))


def _covered(pos: Column) -> Column:
    """Size of the union of the windows [p, p + 3) over sorted positions."""
    gaps = F.transform(pos, lambda p, i: F.coalesce(F.least(F.get(pos, i + 1) - p, F.lit(3)), F.lit(3)).cast("long"))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)


def measured(docs: DataFrame, carry: tuple[str, ...] | None = None) -> DataFrame:
    """``row`` (the carried input columns as a struct), lang, source and the
    counts of ``COUNTS`` for each document, in one pass without a shuffle."""
    kept = docs if carry is None else docs.select(*carry)
    text = F.coalesce(docs["text"], F.lit(""))
    base = docs.select(F.struct(*[docs[f"`{c}`"] for c in kept.columns]).alias("row"), docs["lang"].alias("lang"), docs["source"].alias("source"), text.alias("t"), words(text).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD_CLASS))
    base = base.select("row", "lang", "source", "t", "w", lines.alias("ls"), _repeat_words(F.col("w")).alias("hs"))
    hs = F.col("hs")
    again = F.filter(hs, lambda x, i: (x["h"] == F.get(hs, i - 1)["h"]) | (x["h"] == F.get(hs, i + 1)["h"]))
    base = base.select(
        "row", "lang", "source",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.transform(again, lambda x: x["p"])).alias("pos"),
        F.length(F.regexp_replace("t", r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        F.size("ls").cast("long").alias("n_lines"),
    )
    return base.withColumn("n_repeat_words", _covered(F.col("pos"))).drop("pos")


def _milli(top: str, below: str) -> Column:
    return F.when(F.col(below) == 0, F.lit(0)).otherwise(F.expr(f"({top} * 1000) div {below}")).cast("long")


def with_ratios(m: DataFrame) -> DataFrame:
    """Adds the integer ratios that thresholds are fitted to."""
    return m.withColumns({
        "symbol_milli": _milli("n_symbols", "n_words"),
        "upper_milli": _milli("n_upper", "word_chars"),
        "dup_milli": _milli("n_dup_lines", "n_lines"),
        "repeat_milli": _milli("n_repeat_words", "n_words"),
        "word_len_milli": _milli("word_chars", "n_words"),
    })


def sketches(m: DataFrame) -> DataFrame:
    """Quantile sketches: (lang, source, ratio, bucket, n, e) of the documents
    that pass the base rules; e sums the squares of one event's part.  Summing n
    and e over any grouping of rows merges the sketches of that grouping."""
    event = lambda r: F.expr(f"CASE WHEN {EVENTS[r][1]} = 0 THEN 0 ELSE ({EVENTS[r][0]} * 1000) div {EVENTS[r][1]} END").cast("long")
    pairs = F.array(*[F.struct(F.lit(r).alias("ratio"), F.col(r).alias("v"), (event(r) * event(r)).alias("e")) for r in RATIOS])
    long = m.where(f"NOT ({BASE_FAILED})").select("lang", "source", F.explode(pairs).alias("x")).select("lang", "source", "x.ratio", "x.v", "x.e")
    long = long.withColumn("s", F.greatest(F.length(F.bin("v")) - SIG_BITS, F.lit(0)))
    return long.withColumn("bucket", F.expr("shiftleft(shiftright(v, s), s)")).groupBy("lang", "source", "ratio", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("e"))


def pooled(sk: DataFrame) -> DataFrame:
    """(lang, source, ratio, bucket, w, e): every group's sketch with what it
    borrows; ``ROW`` is the weight of a row."""
    both = lambda k: [F.sum(c).alias(c) for c in k]
    weighed = sk.withColumns({"w": ROW * F.col("n"), "e": ROW * F.col("e")})
    everything = weighed.groupBy("ratio", "bucket").agg(*both(("w", "e")))  # some thousand rows at most: buckets are log-linear
    part = lambda c, lot, rows: f"(CAST({lot} AS DECIMAL(10,0)) * {c}) div ({rows}) AS {c}"  # noqa: E731  the product of a large table's sum is beyond 64 bits
    everything = everything.withColumn("rows", F.sum("w").over(W.partitionBy("ratio"))).selectExpr("ratio AS r", "bucket", *[part(c, ROW * BORROWED, "rows") for c in ("w", "e")])
    rows = sk.groupBy("lang", "ratio").agg(F.sum("n").alias("rows"))
    lent = rows.join(F.broadcast(everything), F.col("ratio") == F.col("r")).select("lang", "ratio", "bucket", "w", "e")
    lang = weighed.select("lang", "ratio", "bucket", "w", "e").unionByName(lent).groupBy("lang", "ratio", "bucket").agg(*both(("w", "e")))
    share = lang.alias("l").join(rows.alias("r"), F.col("l.lang").eqNullSafe(F.col("r.lang")) & (F.col("l.ratio") == F.col("r.ratio")))
    share = share.selectExpr("l.lang AS m_lang", "l.ratio AS m_ratio", "bucket", *[part(c, BORROWED, f"rows + {BORROWED}") for c in ("w", "e")])
    groups = sk.select("lang", "source", "ratio").distinct()
    lent = groups.join(share, F.col("lang").eqNullSafe(F.col("m_lang")) & (F.col("ratio") == F.col("m_ratio"))).select("lang", "source", "ratio", "bucket", "w", "e")
    own = weighed.select("lang", "source", "ratio", "bucket", "w", "e")
    return own.unionByName(lent).groupBy("lang", "source", "ratio", "bucket").agg(*[F.sum(c).cast("double").alias(c) for c in ("w", "e")]).where("w > 0")


def fences(sk: DataFrame) -> DataFrame:
    """(g_lang, g_source, ``FENCES``): null where a group has no fence."""
    keys = ["lang", "source", "ratio"]
    g = W.partitionBy(*keys)
    run = pooled(sk).withColumns({"cum": F.sum("w").over(g.orderBy("bucket")), "all": F.sum("w").over(g)})
    run = run.withColumn("median", F.min(F.when(F.col("cum") * 2 >= F.col("all"), F.col("bucket"))).over(g))
    low = run.where(F.col("ratio").isin(*[r for r, judged_low in RATIOS.items() if judged_low]) & (F.col("bucket") <= F.col("median")))
    sides = run.where(F.col("bucket") >= F.col("median")).withColumns({"side": F.lit("hi"), "o": F.col("bucket")}).unionByName(low.withColumns({"side": F.lit("lo"), "o": -F.col("bucket")}))
    half = W.partitionBy(*keys, "side")
    v = F.col("bucket").cast("double")
    width = F.expr(f"pow(2.0D, greatest(length(bin(bucket)) - {SIG_BITS}, 0))")  # values are even within a bucket
    sums = {"w": F.col("w"), "s": F.col("w") * v, "q": F.col("w") * (v * v + width * width / 12) + F.col("e")}
    cut = sides.select(*keys, "side", "o", *[F.sum(c).over(half.orderBy("o")).alias(f"{n}1") for n, c in sums.items()], *[F.sum(c).over(half).alias(f"{n}0") for n, c in sums.items()])
    cut = cut.where("w1 < w0").selectExpr(*keys, "side", "o", "w1", "w0 - w1 AS w2", "s1 / w1 AS m1", "(s0 - s1) / (w0 - w1) AS m2", "q1 / w1 AS q1", "(q0 - q1) / (w0 - w1) AS q2")
    cut = cut.selectExpr(*keys, "side", "o", "m1", "m2", "(m1 - m2) * (m1 - m2) AS d", "w1 * w2 * ((m1 - m2) * (m1 - m2)) AS between", "greatest(q1 - m1 * m1, 0.0D) + greatest(q2 - m2 * m2, 0.0D) AS spread")
    best = cut.groupBy(*keys, "side").agg(F.min(F.struct((-F.col("between")).alias("b"), "o", "m1", "m2", "d", "spread")).alias("x"))
    at = F.when(2 * F.col("x.d") >= APART * APART * F.col("x.spread"), F.floor((F.col("x.m1") + F.col("x.m2")) / 2))
    best = best.select("lang", "source", F.concat("side", F.lit("_"), "ratio").alias("fence"), at.alias("at"))
    groups = sk.select("lang", "source").distinct()
    named = best.groupBy("lang", "source").agg(*[F.max(F.when(F.col("fence") == f, F.col("at"))).alias(f) for f in FENCES]).toDF("g_lang", "g_source", *FENCES)
    j = groups.join(named, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    return j.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *FENCES)


def judged(docs: DataFrame, carry: tuple[str, ...] | None = None) -> DataFrame:
    """``row``, the counts, the ratios, ``base_failed``, ``outlier`` (a ratio
    beyond its fence) and ``kept`` for each document of ``docs``."""
    m = with_ratios(written(measured(docs, carry), "measured"))
    limits = sent_if_small(written(fences(written(sketches(m), "sketches")), "limits"))
    j = m.join(limits, m["lang"].eqNullSafe(limits["g_lang"]) & m["source"].eqNullSafe(limits["g_source"]), "left")
    out = F.lit(False)
    for r, low in RATIOS.items():  # null where there is no fence
        out = out | F.coalesce(F.col(r) > F.col(f"hi_{r}"), F.lit(False))
        if low:
            out = out | F.coalesce(F.col(r) < F.col(f"lo_{r}"), F.lit(False))
    j = j.withColumns({"base_failed": F.expr(BASE_FAILED), "outlier": out})
    return j.withColumn("kept", ~F.col("base_failed") & ~F.col("outlier")).select("row", *COUNTS, *RATIOS, "base_failed", "outlier", "kept")


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with its columns."""
    return judged(docs).where("kept").select("row.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judged(documents(spark, sf_dir), carry=("doc_id",))
    return j.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "outlier", *RATIOS)


_WITHIN = " AND ".join([f"coalesce({r} <= hi_{r}, true)" for r in RATIOS] + [f"coalesce({r} >= lo_{r}, true)" for r, low in RATIOS.items() if low])


def judged_sql(table: str) -> str:
    """CTEs that end in ``judged`` (doc_id, counts, ratios, verdicts, text,
    lang, source, n_chars) over a table with the columns of documents."""
    events = ", ".join(f"CASE WHEN {below} = 0 THEN 0 ELSE {1000 * n} // {below} END" for n, below in (EVENTS[r] for r in RATIOS))
    judged_low = ", ".join(f"'{r}'" for r, low in RATIOS.items() if low)
    at = ", ".join(f"max(cut) FILTER (fence = '{f}') AS {f}" for f in FENCES)
    return rf"""
raw AS (SELECT *, coalesce(text, '') AS t FROM {table}),
wl AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM raw),
tg AS (SELECT *, [w[i] || chr(10) || w[i+1] || chr(10) || w[i+2] for i in range(1, len(w) - 1)] AS g FROM wl),
tp AS (SELECT *, list_transform(list_filter(map_entries(list_aggregate(g, 'histogram')), lambda e: e.value > 1), lambda e: e.key) AS many FROM tg),
cn AS (SELECT doc_id, text, lang, source, n_chars, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  len(list_distinct(flatten([CASE WHEN list_contains(many, g[i]) THEN [i, i+1, i+2] ELSE []::BIGINT[] END for i in range(1, len(g) + 1)]))) AS n_repeat_words,
  length(regexp_replace(t, '\P{{Lu}}', '', 'g')) AS n_upper, len(ls) AS n_lines FROM tp),
m AS (SELECT *, CASE WHEN n_words = 0 THEN 0 ELSE n_symbols * 1000 // n_words END AS symbol_milli,
  CASE WHEN word_chars = 0 THEN 0 ELSE n_upper * 1000 // word_chars END AS upper_milli,
  CASE WHEN n_lines = 0 THEN 0 ELSE n_dup_lines * 1000 // n_lines END AS dup_milli,
  CASE WHEN n_words = 0 THEN 0 ELSE n_repeat_words * 1000 // n_words END AS repeat_milli,
  CASE WHEN n_words = 0 THEN 0 ELSE word_chars * 1000 // n_words END AS word_len_milli FROM cn),
lg AS (SELECT lang, source, unnest([{', '.join(f"'{r}'" for r in RATIOS)}]) AS ratio, unnest([{', '.join(RATIOS)}]) AS v, unnest([{events}]) AS e FROM m WHERE NOT ({BASE_FAILED})),
sk AS (SELECT lang, source, ratio, bucket, count(*) AS n, sum(e * e)::BIGINT AS e FROM (SELECT lang, source, ratio, e, (v >> greatest(length(bin(v)) - {SIG_BITS}, 0)) << greatest(length(bin(v)) - {SIG_BITS}, 0) AS bucket FROM lg) GROUP BY ALL),
ev AS (SELECT ratio, bucket, ({ROW * BORROWED} * sum(n)::BIGINT) // (sum(sum(n)) OVER (PARTITION BY ratio))::BIGINT AS w, ({ROW * BORROWED} * sum(e)::BIGINT) // (sum(sum(n)) OVER (PARTITION BY ratio))::BIGINT AS e FROM sk GROUP BY 1, 2),
lr AS (SELECT lang, ratio, sum(n)::BIGINT AS n FROM sk GROUP BY 1, 2),
lw AS (SELECT lang, ratio, bucket, sum(w)::BIGINT AS w, sum(e)::BIGINT AS e FROM (SELECT lang, ratio, bucket, {ROW} * n AS w, {ROW} * e AS e FROM sk UNION ALL SELECT lr.lang, lr.ratio, ev.bucket, ev.w, ev.e FROM lr JOIN ev ON lr.ratio = ev.ratio) GROUP BY 1, 2, 3),
gr AS (SELECT DISTINCT lang, source, ratio FROM sk),
pw AS (SELECT lang, source, ratio, bucket, sum(w)::DOUBLE AS w, sum(e)::DOUBLE AS e FROM (SELECT lang, source, ratio, bucket, {ROW} * n AS w, {ROW} * e AS e FROM sk
  UNION ALL SELECT gr.lang, gr.source, gr.ratio, bucket, ({BORROWED} * w) // (lr.n + {BORROWED}), ({BORROWED} * e) // (lr.n + {BORROWED}) FROM gr JOIN lw ON gr.lang IS NOT DISTINCT FROM lw.lang AND gr.ratio = lw.ratio JOIN lr ON gr.lang IS NOT DISTINCT FROM lr.lang AND gr.ratio = lr.ratio)
  GROUP BY 1, 2, 3, 4 HAVING sum(w) > 0),
cm AS (SELECT *, sum(w) OVER (PARTITION BY lang, source, ratio ORDER BY bucket) AS cum, sum(w) OVER (PARTITION BY lang, source, ratio) AS tot FROM pw),
md AS (SELECT *, min(CASE WHEN cum * 2 >= tot THEN bucket END) OVER (PARTITION BY lang, source, ratio) AS median FROM cm),
sd AS (SELECT lang, source, ratio, 'hi' AS side, bucket AS o, w, e, bucket::DOUBLE AS v FROM md WHERE bucket >= median
  UNION ALL SELECT lang, source, ratio, 'lo', -bucket, w, e, bucket::DOUBLE FROM md WHERE bucket <= median AND ratio IN ({judged_low})),
ct AS (SELECT *, sum(w) OVER c AS w1, sum(w * v) OVER c AS s1, sum(w * (v * v + wd * wd / 12) + e) OVER c AS q1, sum(w) OVER a AS w0, sum(w * v) OVER a AS s0, sum(w * (v * v + wd * wd / 12) + e) OVER a AS q0 FROM (SELECT *, pow(2.0::DOUBLE, greatest(length(bin(abs(o))) - {SIG_BITS}, 0)) AS wd FROM sd)
  WINDOW c AS (PARTITION BY lang, source, ratio, side ORDER BY o), a AS (PARTITION BY lang, source, ratio, side)),
mn AS (SELECT *, w0 - w1 AS w2, s1 / w1 AS m1, (s0 - s1) / (w0 - w1) AS m2, q1 / w1 AS e1, (q0 - q1) / (w0 - w1) AS e2 FROM ct WHERE w1 < w0),
bt AS (SELECT *, w1 * w2 * ((m1 - m2) * (m1 - m2)) AS between_, greatest(e1 - m1 * m1, 0) + greatest(e2 - m2 * m2, 0) AS spread FROM mn),
bs AS (SELECT *, CASE WHEN 2 * ((m1 - m2) * (m1 - m2)) >= {APART * APART} * spread THEN floor((m1 + m2) / 2)::BIGINT END AS cut, side || '_' || ratio AS fence FROM bt
  QUALIFY row_number() OVER (PARTITION BY lang, source, ratio, side ORDER BY between_ DESC, o) = 1),
gs AS (SELECT DISTINCT lang, source FROM sk),
lim AS (SELECT gs.lang AS g_lang, gs.source AS g_source, {at} FROM gs LEFT JOIN bs ON gs.lang IS NOT DISTINCT FROM bs.lang AND gs.source IS NOT DISTINCT FROM bs.source GROUP BY 1, 2),
judged AS (SELECT *, base_failed AS bf, NOT base_failed AND NOT outlier AS kept FROM (SELECT *,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT ({_WITHIN}) AS outlier
  FROM m LEFT JOIN lim ON m.lang IS NOT DISTINCT FROM g_lang AND m.source IS NOT DISTINCT FROM g_source))"""


OP2_SQL = f"""WITH {judged_sql('documents')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, outlier, {', '.join(RATIOS)} FROM judged"""
