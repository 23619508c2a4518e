"""Quality classifier: a factorisation machine over hashed words, statistics of
structure and metadata.

A text's features are its lower-cased words hashed to ``WORDS`` columns (weights
log(1 + count), scaled to length 1) and one indicator for each statistic, which
is cut into steps: shares of symbols, capitals, digits and other characters,
word and line lengths, repeated words and lines, and the metadata given.  With
weights w and factors v of ``RANK`` numbers a row x has

    w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

and the pairs are taken in linear time as half the square of the sum less the
sum of squares, factor by factor.  The score is the logistic function of that.

Features are made in the tasks and whole texts are read.  The model is fitted on
at most ``FIT_ROWS`` labelled rows, those with the smallest hashes of their ids,
in one task; only weights come back (``COLUMNS`` times ``RANK`` + 1 numbers).

Edge cases: a null text counts as empty and has a score too; a row without
doc_id is scored and never learnt from; labels that are null or no number are
passed over, several labels of a document count as their majority (ties as 1);
without labels, or with one kind, the score is the smoothed share of label 1;
metadata that is null has a step of its own; an empty table gives an empty
result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import documents, shipped, tidy, written
from .hashing import slices, word_hashes

WORDS = 1 << 15
STEPS = 32
STATISTICS = ("words", "word_length", "symbols", "capitals", "digits", "marks", "foreign", "distinct", "commonest", "runs", "line_length", "repeated_lines")
META = 4
COLUMNS = WORDS + STEPS * (len(STATISTICS) + META)
RANK = 8
#: Labelled rows that a model is fitted on, at most.
FIT_ROWS = 8_000
#: Fitting: rows of a step, passes and steps at least, step size, shrinkage, spread of the first factors.
BATCH, PASSES, LEAST_STEPS, RATE, SHRINK, SPREAD, SEED = 128, 6, 400, 0.05, 1e-5, 0.05, 11
FOLDS, HELD_OUT, LEAST = 4, 2, 0.7

_KIND = np.zeros(256, dtype=np.int64)  # 0 other letters, 1 symbols, 2 capitals, 3 digits, 4 marks, 5 white space, 6 beyond ASCII
for _kind, _chars in ((1, b"#*$%&|<>@^~\\{}[]=+_"), (2, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (3, b"0123456789"), (4, b".,;:!?\"'()-/"), (5, b" \t\n\x0b\x0c\r"), (6, bytes(range(128, 256)))):
    _KIND[np.frombuffer(_chars, np.uint8)] = _kind

Rows = tuple[np.ndarray, np.ndarray, np.ndarray]


def _share(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Steps of a share: finer near 0."""
    return np.minimum((np.sqrt(x / np.maximum(of, 1)) * STEPS).astype(np.int64), STEPS - 1)


def _size(x: np.ndarray) -> np.ndarray:
    """Steps of a size: two for each doubling."""
    return np.minimum((2 * np.log2(1 + x)).astype(np.int64), STEPS - 1)


def features(data: np.ndarray, offsets: np.ndarray, meta: list[np.ndarray]) -> Rows:
    """(columns, weights, first): sparse rows of texts given as bytes; row r has
    the entries from ``first[r]`` to ``first[r + 1]``."""
    n = len(offsets) - 1
    h, first = word_hashes(data, offsets)
    n_words = np.diff(first)
    row = np.repeat(np.arange(n), n_words)
    key, count = np.unique(row * WORDS + (h % np.uint64(WORDS)).astype(np.int64), return_counts=True)
    word_row, column = key // WORDS, key % WORDS
    weight = np.log1p(count)
    weight /= np.sqrt(np.bincount(word_row, weight**2, minlength=n))[word_row]

    kind = _KIND[data]
    chars = np.diff(offsets)
    at = np.repeat(np.arange(n), chars)
    kinds = np.bincount(at * 7 + kind, minlength=7 * n).reshape(n, 7)
    per_word = np.unique(np.stack([row.astype(np.uint64), h], axis=1), axis=0, return_counts=True) if len(h) else (np.zeros((0, 2), np.uint64), np.zeros(0, np.int64))
    owner = per_word[0][:, 0].astype(np.int64)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, owner, per_word[1])
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    lines, again = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for r in range(n):  # text by text: split in C
        parts = data[offsets[r] : offsets[r + 1]].tobytes().split(b"\n")
        lines[r], again[r] = len(parts), len(parts) - len(set(parts))
    body = chars - kinds[:, 5]
    steps = [
        _size(n_words), np.minimum(2 * body // np.maximum(n_words, 1), STEPS - 1), _share(kinds[:, 1], body), _share(kinds[:, 2], body), _share(kinds[:, 3], body), _share(kinds[:, 4], body), _share(kinds[:, 6], body),
        _share(np.bincount(owner, minlength=n), n_words), _share(most, n_words), _share(np.bincount(row[same], minlength=n), n_words), _size(n_words // np.maximum(lines, 1)), _share(again, lines), *meta,
    ]
    flat = np.concatenate([WORDS + STEPS * k + s for k, s in enumerate(steps)])
    rows = np.concatenate([word_row, np.tile(np.arange(n), len(steps))])
    columns, weights = np.concatenate([column, flat]), np.concatenate([weight, np.ones(len(flat))])
    order = np.argsort(rows, kind="stable")
    return columns[order], weights[order], np.searchsorted(rows[order], np.arange(n + 1))


def margins(model: np.ndarray, x: Rows) -> tuple[np.ndarray, np.ndarray]:
    """The machine's value of each row in linear time, and the factors' sums.
    ``model`` has a row (w, v) for each column; w0 stands after them."""
    columns, weights, first = x
    e = model[columns] * weights[:, None]
    linear, sums, squares = (np.add.reduceat(y, first[:-1], axis=0) for y in (e[:, 0], e[:, 1:], e[:, 1:] ** 2))  # no row is empty
    return model[-1, 0] + linear + 0.5 * (sums**2 - squares).sum(1), sums


def fitted(x: Rows, y: np.ndarray) -> np.ndarray:
    """Weights by steps of adaptive size on the logistic loss, always the same
    ones for the same rows."""
    columns, weights, first = x
    rng = np.random.default_rng(SEED)
    model = np.zeros((COLUMNS + 1, RANK + 1))
    model[-1, 0] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    if not 0 < y.sum() < len(y):
        return model
    model[:-1, 1:] = rng.normal(0, SPREAD, (COLUMNS, RANK))
    seen = np.full(model.shape, 1e-2)
    for _ in range(max(PASSES, -(-LEAST_STEPS * BATCH // len(y)))):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), BATCH):
            rows = order[lo : lo + BATCH]
            sizes = first[rows + 1] - first[rows]
            starts = np.concatenate([[0], np.cumsum(sizes)])
            take = np.arange(starts[-1]) + np.repeat(first[rows] - starts[:-1], sizes)
            c, wt = columns[take], weights[take]
            value, sums = margins(model, (c, wt, starts))
            slope = (1 / (1 + np.exp(-np.clip(value, -30, 30))) - y[rows]) / len(rows)
            each = np.repeat(slope, sizes) * wt
            used, place = np.unique(c, return_inverse=True)
            grad = np.empty((len(used), RANK + 1))
            grad[:, 0] = np.bincount(place, each, minlength=len(used))
            inner = each[:, None] * (np.repeat(sums, sizes, axis=0) - model[c, 1:] * wt[:, None])
            for f in range(RANK):
                grad[:, 1 + f] = np.bincount(place, inner[:, f], minlength=len(used))
            grad += SHRINK * model[used]
            seen[used] += grad**2
            model[used] -= RATE * grad / np.sqrt(seen[used])
            seen[-1, 0] += slope.sum() ** 2
            model[-1, 0] -= RATE * slope.sum() / np.sqrt(seen[-1, 0])
    return model


def _meta_steps(batch: pa.RecordBatch, names: tuple[str, ...]) -> list[np.ndarray]:
    """Metadata numbers as steps; null (and what is no number) has the last."""
    out = []
    for m in names:
        x = batch.column(m).to_numpy(zero_copy_only=False).astype(float)
        out.append(np.where(np.isfinite(x), np.minimum(_size(np.abs(np.where(np.isfinite(x), x, 0))), STEPS - 2), STEPS - 1))
    return out


def _pieces(batch: pa.RecordBatch, names: tuple[str, ...]) -> Iterator[tuple[int, int, Rows]]:
    meta = _meta_steps(batch, names)
    for lo, hi, data, offsets in slices(batch.column("text")):
        yield lo, hi, features(data, offsets, [m[lo:hi] for m in meta])


def _sparse(names: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, (columns, weights, first) in _pieces(b, names):
                lists = [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(x, t)) for x, t in ((columns, pa.int32()), (weights, pa.float64()))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[lo:hi], b.column("y")[lo:hi], *lists], names=["doc_id", "y", "columns", "weights"])

    return run


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held).combine_chunks()
    t = t.take(pa.array(np.argsort(t["doc_id"].to_numpy(), kind="stable")))
    flat = lambda c: t[c].combine_chunks().flatten().to_numpy()
    sizes = np.diff(t["columns"].combine_chunks().offsets.to_numpy())
    model = fitted((flat("columns"), flat("weights"), np.concatenate([[0], np.cumsum(sizes)])), t["y"].to_numpy().astype(float))
    yield pa.RecordBatch.from_arrays([pa.array([model.tobytes()], pa.binary())], names=["model"])


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learnt from; a row without id is none of them."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, meta: tuple[str, ...] = ("n_chars",), fit_rows: int = FIT_ROWS) -> np.ndarray:
    """The model of ``labels`` (doc_id, y: 0 or 1)."""
    shipped(docs.sparkSession)
    y = labels.where("doc_id IS NOT NULL AND y IN (0, 1)").groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    known = written(y.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows), "known").withColumnRenamed("doc_id", "label_id")
    own = docs.select("doc_id", "text", *meta)  # other columns may clash
    rows = own.join(F.broadcast(known), F.col("doc_id") == F.col("label_id")).select(*own.columns, "y")  # fit_rows ids at most
    sparse = rows.mapInArrow(tidy(_sparse(meta)), "doc_id long, y double, columns array<int>, weights array<double>")
    one = sparse.groupBy("doc_id").agg(F.min(F.struct("columns", "weights", "y")).alias("x")).select("doc_id", "x.*")  # ids may repeat
    got = one.repartition(1).mapInArrow(tidy(_fit), "model binary").collect()  # one row
    if not got:
        return np.zeros((COLUMNS + 1, RANK + 1))
    return np.frombuffer(got[0].model, float).reshape(COLUMNS + 1, RANK + 1)


def scored(docs: DataFrame, model: np.ndarray, meta: tuple[str, ...] = ("n_chars",)) -> DataFrame:
    """(doc_id, score) of every row."""
    spark = docs.sparkSession
    shipped(spark)
    sent = spark.sparkContext.broadcast(model.astype(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = np.empty(b.num_rows)
            for lo, hi, x in _pieces(b, meta):
                score[lo:hi] = 1 / (1 + np.exp(-np.clip(margins(sent.value, x)[0], -500, 500)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return docs.select("doc_id", "text", *meta).mapInArrow(tidy(run), "doc_id long, score double")


def op11_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("y"))
    s = scored(d, trained(d, labels))
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= LEAST).cast("int").alias("predicted"))
