"""Line deduplication by winnowing over line hashes (native).

A repeated run is a maximal run of consecutive lines (blank ones between them
apart) with at least ``MIN_WORDS`` words in all that stands anywhere earlier in
the corpus too, in order of doc_id, then row, then line.  All its lines go.

1. Grams: from each line on, the lines that together hold half of ``MIN_WORDS``
   are hashed.  Of the grams that start in the first half of a window of
   ``MIN_WORDS`` words the smallest is selected (of equal ones the last), so a
   run long enough shares a selected gram, at one place in it, with every other
   occurrence.  Only selected grams are shuffled.
2. Positions are joined on their gram: those whose gram stands elsewhere too
   stay, which leaves most documents out.
3. Matches are extended both ways, line by line: forward from each line, and
   backward from each, until ``MIN_WORDS`` words are held.  Such a window that
   holds a match is named by two hashes of its lines, and one whose name stands
   earlier is a repeat.  A line of a maximal run lies in a forward or a backward
   window inside the run, so their union is the union of maximal runs; only the
   first position of each name is needed, and no pairs of copies are formed.

Edge cases: a null text has one blank line; blank lines alone never repeat;
rows that repeat count as later occurrences (by doc_id, then by position in the
table); null doc_ids come first; an empty table gives no rows; a line repeated
within a text is earlier than its repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import documents, n_words, packed, sent_if_small, written

MIN_WORDS = 50


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _spoken(text: Column) -> Column:
    """The lines with words: p (line number), w (words), h and g (hashes)."""
    each = F.transform(_lines(text), lambda x, i: F.struct(i.alias("p"), n_words(x).cast("int").alias("w"), F.xxhash64(x).alias("h"), F.xxhash64(F.lit("#"), x).alias("g")))
    return F.filter(each, lambda x: x["w"] > 0)


def _selected(min_words: int) -> Column:
    """(j, k): index and hash of the grams that windows of ``sp`` select."""
    half = min_words // 2
    start = F.struct(F.lit(0).alias("w"), F.lit(17).cast("bigint").alias("k"))
    grown = lambda a, x: F.when(a["w"] >= half, a).otherwise(F.struct((a["w"] + x["w"]).alias("w"), F.xxhash64(a["k"], x["h"]).alias("k")))
    # a line with words has one at least, so as many lines as words suffice
    grams = F.transform("sp", lambda x, i: F.struct(i.alias("j"), x["w"].alias("w"), F.aggregate(F.slice("sp", i + 1, half), start, grown).alias("g")))
    none = F.struct(F.lit(0).alias("w"), F.lit(None).cast("bigint").alias("k"), F.lit(None).cast("int").alias("j"))
    better = lambda a, x: (x["g"]["w"] >= half) & (a["k"].isNull() | (x["g"]["k"] <= a["k"]))
    least = lambda a, x: F.when(a["w"] > min_words - half, a).otherwise(F.struct((a["w"] + x["w"]).alias("w"), F.when(better(a, x), x["g"]["k"]).otherwise(a["k"]).alias("k"), F.when(better(a, x), x["j"]).otherwise(a["j"]).alias("j")))
    picked = F.transform("grams", lambda x, i: F.aggregate(F.slice("grams", i + 1, min_words - half + 1), none, least))
    return grams, F.array_distinct(F.transform(F.filter(picked, lambda a: a["j"].isNotNull()), lambda a: F.struct(a["j"].alias("j"), a["k"].alias("k"))))


def _windows(array: str, min_words: int, seed: int) -> Column:
    """Per line of ``array`` (sp, or sp from the back) the shortest window from
    it on with enough words, if it holds a match: (first, last, k1, k2)."""
    start = F.struct(F.lit(0).alias("w"), F.lit(None).cast("int").alias("last"), F.lit(False).alias("hit"), F.lit(seed).cast("bigint").alias("k1"), F.lit(seed).cast("bigint").alias("k2"))
    add = lambda a, x: F.when(a["w"] >= min_words, a).otherwise(F.struct((a["w"] + x["w"]).alias("w"), x["p"].alias("last"), (a["hit"] | x["hit"]).alias("hit"), F.xxhash64(a["k1"], x["h"]).alias("k1"), F.xxhash64(x["g"], a["k2"]).alias("k2")))
    grown = F.transform(array, lambda x, i: F.struct(x["p"].alias("p"), F.aggregate(F.slice(array, i + 1, min_words), start, add).alias("a")))
    full = F.filter(grown, lambda g: (g["a"]["w"] >= min_words) & g["a"]["hit"])
    return F.transform(full, lambda g: F.struct(F.least(g["p"], g["a"]["last"]).alias("first"), F.greatest(g["p"], g["a"]["last"]).alias("last"), g["a"]["k1"].alias("k1"), g["a"]["k2"].alias("k2")))


def repeated(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(rid, runs) of the rows (rid, doc_id, sp: see :func:`_spoken`; a written
    table) that hold later repeats: runs of line numbers (first, last), in order
    and apart."""
    grams, selected = _selected(min_words)
    picked = lines.where(F.size("sp") > 0).select("rid", "sp", grams.alias("grams")).select("rid", F.inline(selected))
    picked = written(picked, "selected")
    company = written(picked.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k"), "company")
    matched = picked.join(sent_if_small(company), "k", "left_semi").groupBy("rid").agg(F.sort_array(F.collect_list("j")).alias("js"))
    gaps = F.transform("js", lambda j, i: F.concat(F.array_repeat(F.lit(False), j - F.coalesce(F.get("js", i - 1), F.lit(-1)) - 1), F.array(F.lit(True))))
    near = lines.join(matched, "rid").select("rid", "doc_id", "sp", F.flatten(gaps).alias("hits"))
    near = near.withColumn("sp", F.transform("sp", lambda x, i: F.struct(x["p"].alias("p"), x["w"].alias("w"), x["h"].alias("h"), x["g"].alias("g"), F.coalesce(F.get("hits", i), F.lit(False)).alias("hit"))))
    near = near.select("rid", "doc_id", "sp", F.reverse("sp").alias("rs"))
    w = written(near.select("rid", "doc_id", F.inline(F.concat(_windows("sp", min_words, 17), _windows("rs", min_words, 71)))), "windows")
    place = F.struct("doc_id", "rid", "first")
    origin = w.groupBy("k1", "k2").agg(F.min(place).alias("origin"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = w.join(origin, ["k1", "k2"]).where(place != F.col("origin")).select("rid", "first", "last")
    spans = later.groupBy("rid").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("s"))
    # of windows in order of their starts the ends are in order too
    heads = F.transform("s", lambda x, i: F.struct(x["first"].alias("first"), x["last"].alias("last"), F.coalesce(x["first"] > F.get("s", i - 1)["last"] + 1, F.lit(True)).alias("head")))
    spans = spans.withColumn("s", heads).withColumn("h", F.filter("s", lambda x: x["head"])).withColumn("t", F.filter("s", lambda x, i: F.coalesce(F.get("s", i + 1)["head"], F.lit(True))))
    return spans.select("rid", F.transform("h", lambda x, i: F.struct(x["first"].alias("first"), F.get("t", i)["last"].alias("last"))).alias("runs"))


def labelled(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_deleted and runs (first, last) of each row."""
    text = F.col("text")
    lines = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.size(_lines(text)).cast("long").alias("n_lines"), _spoken(text).alias("sp"))
    lines = written(lines, "lines")
    j = lines.select("rid", "doc_id", "n_lines").join(repeated(lines.select("rid", "doc_id", "sp"), min_words), "rid", "left")
    deleted = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"] + 1)
    return j.select("doc_id", "n_lines", F.coalesce(deleted, F.lit(0)).alias("n_deleted"), "runs")


def cleaned(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` with later repeated runs cut out of ``text``."""
    rows = written(packed(docs, F.monotonically_increasing_id().alias("rid"), F.col("doc_id"), F.col("text")), "rows")
    lines = written(rows.select("rid", "doc_id", _spoken(F.col("text")).alias("sp")), "lines")
    j = rows.join(repeated(lines, min_words), "rid", "left")
    ls = _lines(F.col("text"))
    gone = F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["last"])))
    j = j.withColumn("ls", ls).withColumn("stay", F.array_except(F.sequence(F.lit(0), F.size("ls") - 1), gone))
    text = F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(F.transform("stay", lambda i: F.get("ls", i)), "\n"))
    return j.withColumn("clean", text).select(*[F.col("clean").alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def op8_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = F.array_join(F.transform("runs", lambda r: F.concat_ws("-", r["first"].cast("string"), r["last"].cast("string"))), ",")
    return labelled(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_deleted", F.coalesce(runs, F.lit("")).alias("runs"))


OP8_SQL = rf"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS x, unnest(range(len(ls))) AS p FROM d),
s AS (SELECT *, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY p) AS upto FROM s),
e AS (SELECT a.doc_id, a.p AS first, b.p AS last FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.p >= a.p
  AND b.upto - a.upto + a.w >= {MIN_WORDS} AND b.upto - a.upto + a.w - greatest(a.w, b.w) < {MIN_WORDS}),
k AS (SELECT e.doc_id, first, last, string_agg(x, chr(10) ORDER BY p) AS k FROM e JOIN s ON s.doc_id = e.doc_id AND p BETWEEN first AND last GROUP BY e.doc_id, first, last),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, first) AS nth FROM k),
r AS (SELECT doc_id, first, last, coalesce(first > max(last) OVER (PARTITION BY doc_id ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, true) AS head FROM o WHERE nth > 1),
g AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY first) AS run FROM r),
m AS (SELECT doc_id, run, min(first) AS a, max(last) AS z FROM g GROUP BY doc_id, run),
n AS (SELECT doc_id, sum(z - a + 1)::BIGINT AS n_deleted, string_agg(a || '-' || z, ',' ORDER BY a) AS runs FROM m GROUP BY doc_id)
SELECT d.doc_id, len(ls)::BIGINT AS n_lines, coalesce(n_deleted, 0) AS n_deleted, coalesce(runs, '') AS runs FROM d LEFT JOIN n USING (doc_id)"""
