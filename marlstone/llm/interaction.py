"""Audit of how filters interact: every order of five filters, step by step.

Four filters read a text alone, inside its row.  The fifth (E) asks whether a
smaller doc_id has the same text anywhere in the table:

1. Each map task inserts its rows' whole texts into a compressed trie.  A
   terminal holds the least doc_id and, by (part, good, toxic), the number of
   rows with that id, with larger ids, and without an id.  So a text crosses
   once a task, however many rows have it.
2. Terminals are dealt by prefixes that adapt to the texts: a prefix whose texts
   weigh more than ``LIMIT`` is replaced by longer ones (``GROWTH`` times), until
   none is too heavy.  Copies of one text that alone are too heavy (one from each
   of very many tasks) are merged in several tasks first.
3. Each task inserts what it gets into its trie, terminals merge, and a
   traversal tells which rows have a smaller id elsewhere: their masks of failed
   filters are counted by (part, good, toxic).

What is left is at most 32 masks times 4 for each part; the 120 orders are taken
from those counts.

Edge cases: a null text counts as empty; a null source is the part ''; a row
without doc_id neither is nor makes a duplicate, and rows that repeat one doc_id
do not make each other duplicates; several labels of a document count as any of
them; documents without labels are neither good nor toxic; an empty table gives
an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import documents, sent_if_small, shipped, tidy, words, written
from .tries import Trie

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
#: Bytes of texts (and what their terminals take beside) of one trie.
LIMIT = 32_000_000
BESIDE = 600
#: Bytes of the first prefixes, and how much longer the next ones are.
FIRST, GROWTH = 4, 4
#: Rows without an id are dealt into so many keys.
SPREAD = 1000

_COUNT = pa.struct([("part", pa.string()), ("good", pa.bool_()), ("toxic", pa.bool_()), ("n", pa.int64())])
_COUNT_DDL = "array<struct<part:string,good:boolean,toxic:boolean,n:bigint>>"
TERMINAL = f"t binary, mask int, least long, first {_COUNT_DDL}, later {_COUNT_DDL}, nameless {_COUNT_DDL}"
_TERMINAL = pa.schema([("t", pa.binary()), ("mask", pa.int32()), ("least", pa.int64()), *[(n, pa.list_(_COUNT)) for n in ("first", "later", "nameless")]])
MASKS = "part string, mask int, good boolean, toxic boolean, n long"
_MASKS = pa.schema([("part", pa.string()), ("mask", pa.int32()), ("good", pa.bool_()), ("toxic", pa.bool_()), ("n", pa.int64())])


def own_mask(text: Column) -> Column:
    """Bits of the filters that a text fails by itself."""
    w, n = words(text), F.coalesce(F.length(text), F.lit(0))
    # words are bound once
    few = F.get(F.transform(F.array(w), lambda w: F.when(F.size(w) < 200, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(w)) < 50 * F.size(w), 2).otherwise(0)), F.lit(0))
    capitals = F.when(100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 2 * n, 4).otherwise(0)
    return few + capitals + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)


def rows_with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, t, mask, part, good, toxic of every row of ``docs``."""
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    marks = sent_if_small(written(marks.toDF("label_id", "good", "toxic"), "labels")).withColumn("nobody", F.lit(0))
    t = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", t.alias("t"), F.coalesce("source", F.lit("")).alias("part"))
    nobody = F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.xxhash64("t"), F.lit(SPREAD))).otherwise(0)
    j = d.withColumn("spread", nobody).join(marks, (F.col("doc_id") == F.col("label_id")) & (F.col("spread") == F.col("nobody")), "left")
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return j.select("doc_id", F.col("t").cast("binary").alias("t"), own_mask(F.col("t")).cast("int").alias("mask"), "part", no("good"), no("toxic"))


class Held:
    """Tries of what a task has read so far."""

    def __init__(self) -> None:
        self.trie, self.weight = Trie(), 0

    def add(self, text: bytes, mask: int, least: int | None, first: Counter, later: Counter, nameless: Counter) -> None:
        node = self.trie.terminal(text)
        if node.value is None:
            node.value = [mask, least, first, later, nameless]
            self.weight += len(text) + BESIDE
            return
        v = node.value
        v[4] += nameless
        if least is None:
            return
        if v[1] is None:
            v[1], v[2], v[3] = least, first, later
            return
        if least == v[1]:
            v[2] += first
            v[3] += later
        elif least < v[1]:
            v[1], v[2], v[3] = least, first, later + v[2] + v[3]
        else:
            v[3] += first + later

    def whole(self) -> pa.RecordBatch:
        counts = lambda c: [{"part": p, "good": g, "toxic": x, "n": n} for (p, g, x), n in c.items()]
        rows = [(t, v[0], v[1], counts(v[2]), counts(v[3]), counts(v[4])) for t, v in self.trie.terminals()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*rows), _TERMINAL.types, strict=True)], schema=_TERMINAL)

    def masks(self) -> pa.RecordBatch:
        total: Counter = Counter()
        for mask, _, first, later, nameless in self.trie.values():
            for counts, fails in ((first, mask), (nameless, mask), (later, mask | DUPLICATE)):
                for (part, good, toxic), n in counts.items():
                    total[part, fails, good, toxic] += n
        cols = list(zip(*[(*k, n) for k, n in total.items()], strict=True))
        return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(cols, _MASKS.types, strict=True)], schema=_MASKS)


def _inserted(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows to terminals; what is held is sent on at ``limit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, none = Held(), Counter()
        for b in batches:
            for t, doc_id, mask, *tag in zip(*(b.column(c).to_pylist() for c in ("t", "doc_id", "mask", "part", "good", "toxic")), strict=True):
                one = Counter({tuple(tag): 1})
                held.add(t, mask, doc_id, *((none.copy(), none.copy(), one) if doc_id is None else (one, none.copy(), none.copy())))
                if held.weight >= limit:
                    yield held.whole()
                    held = Held()
        if held.weight:
            yield held.whole()

    return run


def _merged(counted: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Terminals to merged terminals, or to their masks' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held()
        for b in batches:
            for t, mask, least, *counts in zip(*(b.column(c).to_pylist() for c in _TERMINAL.names), strict=True):
                held.add(t, mask, least, *(Counter({(x["part"], x["good"], x["toxic"]): x["n"] for x in c}) for c in counts))
        if held.weight:
            yield held.masks() if counted else held.whole()

    return run


def dealt(terminals: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, int, bool]:
    """``terminals`` with ``leaf`` (a hash of the prefix that they are dealt by)
    and ``piece`` (null but for a text whose copies alone are too heavy); their
    weight in limits; whether there are pieces."""
    key = lambda depth: F.xxhash64(F.lit(depth), F.substring("t", 1, depth))
    names, size = terminals.columns, F.octet_length("t")
    x = terminals.withColumns({"w": (size + BESIDE).cast("long"), "leaf": key(FIRST), "depth": F.lit(FIRST), "piece": F.lit(None).cast("long")})
    depth, total, cut = FIRST, None, False
    while True:
        longer = (F.max(size) > depth) & (F.min(F.xxhash64("t")) < F.max(F.xxhash64("t")))
        per = written(x.where(F.col("depth") == depth).groupBy("leaf").agg(F.sum("w").alias("w"), longer.alias("longer")), f"prefixes{depth}")
        total = per.agg(F.sum("w")).first()[0] or 0 if total is None else total
        heavy = per.where(F.col("w") > limit).select(F.col("leaf").alias("h"), F.lit(depth).alias("at"), "longer", F.ceil(F.col("w") / limit).alias("pieces"))
        kinds = {r.longer for r in heavy.select("longer").distinct().collect()}  # two rows
        cut = cut or False in kinds
        if kinds:
            j = x.join(sent_if_small(heavy), (F.col("leaf") == F.col("h")) & (F.col("depth") == F.col("at")), "left")
            on = F.coalesce("longer", F.lit(False))
            # copies of one text, each from a task of its own: told apart by their least ids
            piece = F.when(~F.col("longer"), F.pmod(F.xxhash64("least"), "pieces")).otherwise(F.col("piece"))
            x = j.select(*names, "w", F.when(on, key(depth * GROWTH)).otherwise(F.col("leaf")).alias("leaf"), F.when(on, depth * GROWTH).otherwise(F.col("depth")).alias("depth"), piece.alias("piece"))
        if True not in kinds:
            return x, -(-total // limit), cut
        depth *= GROWTH


def failed_masks(docs: DataFrame, labels: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(part, mask, good, toxic, n): rows by the filters that they fail."""
    spark = docs.sparkSession
    shipped(spark)
    terminals = written(rows_with_labels(docs, labels).mapInArrow(tidy(_inserted(limit)), TERMINAL), "terminals")
    x, weight, cut = dealt(terminals, limit)
    n, names = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * weight), terminals.columns
    counted = lambda df, key: df.repartition(n, key).select(*names).mapInArrow(tidy(_merged(True)), MASKS)
    counts = counted(x.where("piece IS NULL").select(*names, "leaf"), "leaf")
    if cut:
        pieces = x.where("piece IS NOT NULL").select(*names, "leaf", "piece").repartition(n, "leaf", "piece").select(*names).mapInArrow(tidy(_merged(False)), TERMINAL)
        counts = counts.unionByName(counted(pieces, "t"))
    return counts.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def _plan() -> list[tuple[str, int, str, int, int, int]]:
    """(filter_order, step, filter, its bit, bits before it, orders with those
    bits before it) of every step of every order."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for k, f in enumerate(order):
            bit = 1 << FILTERS.index(f)
            out.append(("".join(order), k + 1, f, bit, before, factorial(k) * factorial(len(FILTERS) - 1 - k)))
            before |= bit
    return out


def audited(masks: DataFrame) -> DataFrame:
    """Every step of every order for each part, from the counts of masks."""
    spark = masks.sparkSession
    plan = spark.createDataFrame(_plan(), "filter_order string, step int, filter string, bit int, before int, weight int")
    cells = plan.select("bit", "before", "weight").distinct()  # 80 rows
    per = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("m"))  # 128 at most
    total = lambda ok: F.aggregate(F.filter("m", ok), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    bit, before = F.col("bit"), F.col("before")
    fails = lambda x: x["mask"].bitwiseAND(bit) != 0
    here = lambda x: x["mask"].bitwiseAND(before) == 0
    x = per.join(F.broadcast(cells), F.lit(True)).select(
        "part", "bit", "before", "weight",
        total(lambda x: here(x) & ~fails(x)).alias("kept"), total(lambda x: here(x) & fails(x)).alias("removed"), total(lambda x: ~here(x) & fails(x)).alias("redundant"), total(lambda x: x["mask"] == bit).alias("unique_fails"),
        total(lambda x: here(x) & fails(x) & x["good"]).alias("good_lost"), total(lambda x: here(x) & fails(x) & x["toxic"]).alias("toxic_lost"),
    )
    s = x.groupBy("part", "bit").agg(F.sum(F.col("removed") * F.col("weight")).alias("shapley"))
    return x.drop("weight").join(F.broadcast(plan), ["bit", "before"]).join(s, ["part", "bit"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op12_radix_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = failed_masks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return audited(written(masks, "masks"))


OP12_SQL = r"""WITH l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
  100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS dd, coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false) AS e FROM d LEFT JOIN l USING (doc_id)),
m AS (SELECT part, good, toxic, [a, b, c, dd, e] AS fails, count(*) AS n FROM f GROUP BY ALL),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)) AS v(x, i)),
orders AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.i, q.i, r.i, s.i, t.i] AS o FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.i, q.i, r.i, s.i, t.i])) = 5),
steps AS (SELECT filter_order, o, unnest(range(1, 6))::INT AS step FROM orders),
x AS (SELECT part, filter_order, step, o[step] AS f, good, toxic, n, fails[o[step]] AS bad, len(list_filter(o[1:step - 1], lambda k: fails[k])) > 0 AS gone, len(list_filter(fails, lambda k: k)) = 1 AS once FROM m, steps),
g AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT gone AND NOT bad), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND bad), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (gone AND bad), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (bad AND once), 0)::BIGINT AS unique_fails, coalesce(sum(n) FILTER (NOT gone AND bad AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (NOT gone AND bad AND toxic), 0)::BIGINT AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM g"""
