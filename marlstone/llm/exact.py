"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. Every document gets a fingerprint (``FP_BITS`` leading bits of its SHA-256).
2. Each partition (in runs of ``RUN`` rows, where it has more) sorts its distinct
   fingerprints by owner and sends every owner the Golomb-Rice coded differences
   with a bitmap of local repeats.
3. Owners merge what they receive and answer each sender with a bitmap of the
   fingerprints seen more than once; the sender's list and the answer together
   name the suspects.
4. Only suspects' texts are shuffled and compared byte by byte, with map-side
   combining, so a text with millions of copies crosses once per task.

The number of owners follows the number of rows, so an owner's list is bounded.

Edge cases: a null text counts as empty; equal rows (doc_id and text) are
repeats of which exactly one stays; a null doc_id ranks below every other; an
empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import documents, packed, sent_if_small, shipped, tidy, written

FP_BITS = 48
#: Fingerprints that a task sorts and codes at once.
RUN = 2_000_000
ROWS_PER_OWNER = 2_000_000
#: Suspect fingerprints (8 bytes each) up to this many are broadcast to filter
#: the texts; above it the filter is a shuffled semi join.
BROADCAST_FPS = 4_000_000


def rice_encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Shift, unary part and remainder part of sorted distinct integers."""
    gaps = np.diff(values, prepend=values.dtype.type(0)).astype(np.uint64)
    mean = float(values[-1]) / len(values) + 1
    shift = max(0, int(np.log2(mean)))
    q = (gaps >> np.uint64(shift)).astype(np.int64)
    unary = np.zeros(int(q.sum()) + len(q), dtype=np.uint8)
    unary[np.cumsum(q + 1) - 1] = 1
    rest = ((gaps[:, None] >> np.arange(shift, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return shift, np.packbits(unary).tobytes(), np.packbits(rest.ravel()).tobytes()


def rice_decode(n: int, shift: int, unary: bytes, rest: bytes) -> np.ndarray:
    """The ``n`` sorted integers that :func:`rice_encode` was given."""
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    q = np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1)
    bits = np.unpackbits(np.frombuffer(rest, np.uint8))[: n * shift].reshape(n, shift).astype(np.uint64)
    low = (bits << np.arange(shift, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum((q << np.uint64(shift)) | low, dtype=np.uint64).astype(np.int64)


def text_sha(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def fingerprint(sha: Column, bits: int = FP_BITS) -> Column:
    return F.shiftrightunsigned(F.conv(F.hex(F.substring(sha, 1, 7)), 16, 10).cast("long"), 56 - bits)


_SENT = "chunk string, owner int, n int, shift int, unary binary, rest binary, repeats binary"


_SENT_TYPES = pa.schema([("chunk", pa.string()), ("owner", pa.int32()), ("n", pa.int32()), ("shift", pa.int32()), ("unary", pa.binary()), ("rest", pa.binary()), ("repeats", pa.binary())])


def _sender(owners: int, bits: int, run: int):
    def coded(chunk: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        owner = (values.astype(np.uint64) * np.uint64(owners) >> np.uint64(bits)).astype(np.int64)  # by range
        heads = np.flatnonzero(np.diff(owner, prepend=-1))
        rows = [(f"{chunk}", int(owner[x]), int(z - x), *rice_encode(values[x:z]), np.packbits(counts[x:z] > 1).tobytes()) for x, z in zip(heads, [*heads[1:], len(values)])]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), _SENT_TYPES.types, strict=True)], schema=_SENT_TYPES)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chunk, n = [], None, 0
        for b in batches:
            if b.num_rows:
                chunk = b.column(0)[0].as_py() if chunk is None else chunk
                held.append(np.asarray(b.column(1)))
                n += b.num_rows
            if n >= run:
                yield coded(chunk, held)
                held, chunk, n = [], None, 0
        if held:
            yield coded(chunk, held)

    return send


def _columns(t: pa.Table | pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Rows of the named columns, one at a time."""
    return ((*(x.as_py() for x in row),) for row in zip(*(t.column(c) for c in names), strict=True))


def _flags(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)


def _owner(t: pa.Table) -> pa.Table:
    lists = [rice_decode(*row) for row in _columns(t, "n", "shift", "unary", "rest")]
    repeats = [v[_flags(f, n)] for v, (f, n) in zip(lists, _columns(t, "repeats", "n"), strict=True)]
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    more = np.union1d(values[counts > 1], np.concatenate(repeats))
    answers = [np.packbits(np.isin(v, more, assume_unique=True)).tobytes() for v in lists]
    return pa.table({"chunk": t["chunk"], "owner": t["owner"], "answer": pa.array(answers, pa.binary())})


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for answer, n, *code in _columns(b, "answer", "n", "shift", "unary", "rest"):
            hit = _flags(answer, n)
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(rice_decode(n, *code)[hit])], names=["fp"])


def exchanged(meta: DataFrame, bits: int = FP_BITS, rows_per_owner: int = ROWS_PER_OWNER, run: int = RUN) -> DataFrame:
    """Fingerprints (fp) that occur more than once in ``meta`` (rid, fp)."""
    shipped(meta.sparkSession)
    owners = max(16, -(-meta.count() // rows_per_owner))
    sent = written(meta.select("rid", "fp").mapInArrow(tidy(_sender(owners, bits, run)), _SENT), "sent")
    answers = sent.groupBy("owner").applyInArrow(_owner, "chunk string, owner int, answer binary")
    back = sent.select("chunk", "owner", "n", "shift", "unary", "rest").join(answers, ["chunk", "owner"])
    return written(back.mapInArrow(_suspects, "fp long").distinct(), "suspects")


def copy_groups(docs: DataFrame, bits: int = FP_BITS, rows_per_owner: int = ROWS_PER_OWNER, run: int = RUN) -> tuple[DataFrame, DataFrame]:
    """(meta, groups).  meta: rid, doc_id, sha, fp of each row.  groups: sha,
    keep_id, keep_rid and group_size of each text that occurs more than once."""
    base = docs.select("doc_id", F.col("text").alias("t")).select("doc_id", text_sha(F.col("t")).alias("sha"))
    meta = written(base.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "sha", fingerprint(F.col("sha"), bits).alias("fp")), "meta")
    fps = exchanged(meta, bits, rows_per_owner, run)
    fps = F.broadcast(fps) if fps.count() <= BROADCAST_FPS else fps
    rows = docs.select(F.coalesce("text", F.lit("")).alias("t")).withColumn("sha", text_sha(F.col("t")))
    texts = rows.withColumn("fp", fingerprint(F.col("sha"), bits)).join(fps, "fp", "left_semi")
    same = texts.groupBy("sha").agg(F.min("t").alias("a"), F.max("t").alias("z"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    verified = same.select("sha", F.when(F.col("a") == F.col("z"), F.col("group_size")).otherwise(F.raise_error(F.lit("different texts with one SHA-256")).cast("long")).alias("group_size"))
    keep = meta.join(fps, "fp", "left_semi").groupBy("sha").agg(F.max(F.struct("doc_id", "rid")).alias("k"))
    groups = verified.join(keep, "sha").select("sha", F.col("k.doc_id").alias("keep_id"), F.col("k.rid").alias("keep_rid"), "group_size")
    return meta, written(groups, "groups")


def labelled(docs: DataFrame, **how: int) -> DataFrame:
    """doc_id, keep_id, group_size, kept and sha of each row."""
    meta, groups = copy_groups(docs, **how)
    j = meta.join(groups, "sha", "left")
    alone = F.col("group_size").isNull()
    return j.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (alone | (F.col("rid") == F.col("keep_rid"))).alias("kept"), "sha")


def distinct_documents(docs: DataFrame, **how: int) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns."""
    _, groups = copy_groups(docs, **how)
    rows = packed(docs, text_sha(F.col("text")).alias("sha"), F.col("doc_id"))
    j = rows.join(sent_if_small(groups).select("sha", "keep_id", F.lit(True).alias("copied")), "sha", "left")
    alone = j.where("copied IS NULL").select("row")
    keepers = j.where(F.col("copied") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).dropDuplicates(["sha"]).select("row")
    return alone.unionByName(keepers).select("row.*")


def op9_golomb_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = labelled(documents(spark, sf_dir))
    return j.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


OP9_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)"""
