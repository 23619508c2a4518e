"""Helpers shared by the document operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: ASCII white space; every other character belongs to a word.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null or blank text."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS + "+"))


def n_words(text: Column) -> Column:
    """Number of words of a text (long); 0 for null or blank text."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split(bare, SPACE_CLASS + "+"))).cast("long")


def packed(docs: DataFrame, *parts: Column) -> DataFrame:
    """Whole input rows as one struct column ``row`` beside ``parts``, so that
    no extra column of the input can clash with an operator's own names."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *parts)


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under the cluster's shared checkpoint folder.

    Only a local master (tests) may do without one: a temporary folder is made
    and set.  On a cluster executors do not see each other's folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set")
        base = "file://" + tempfile.mkdtemp(prefix="spark-marlstone-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/marlstone-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage,
    survives lost executors and lets later reads prune columns."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a narrow table (a key, an id or two, a few numbers) up to which it is
#: broadcast: some tens of megabytes.
BROADCAST_ROWS = 300_000


def sent_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a written table), to be broadcast if it was counted to have few
    rows; above that joins shuffle as Spark sees fit."""
    return F.broadcast(df) if df.count() <= rows else df


#: Rows of an Arrow batch that carries texts.
ARROW_ROWS = "1000"

_SHIPPED: set[str] = set()


def shipped(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once a session, so
    that it need not be installed there."""
    # texts may be long: few rows at a time, unless the session says otherwise
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[2]
    path = Path(tempfile.mkdtemp(prefix="spark-marlstone-"), "marlstone.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "marlstone").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(app)


def give_back() -> None:
    """Hand free memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f`` over a partition, after which the worker hands free memory back:
    it stays alive between tasks, beside whatever runs next."""

    @functools.wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run
