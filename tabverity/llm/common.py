"""Spark helpers shared by the text operators: shared scratch tables, batching, table reading."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task handles at once; a longer text makes a batch of its own.
BATCH_BYTES = 1 << 19
#: Rows of texts, and bytes, that Spark hands to Python at once at most.
ARROW_ROWS, ARROW_BYTES = 2000, 4 << 20
#: What a Python worker remembers from task to task. It is one operator's: tasks of others drop it.
REMEMBERED: dict = {}


def scratch_dir(spark: SparkSession) -> str:
    """Folder in the cluster's shared storage: ``spark.checkpoint.dir``. Without one, a local master (tests) has a local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not jvm_dir.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = jvm_dir.get() if jvm_dir.isDefined() else f"file://{tempfile.gettempdir()}/tabverity-{os.getpid()}"
    return root.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to shared storage and read it back: cuts the lineage, and survives the loss of executors."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts; from here on the session hands fewer rows to Python at once (their number changes no result)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, ARROW_ROWS)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Second half of a row's identity: rows that repeat an id with another text stay apart."""
    return F.xxhash64(F.lit(7), F.coalesce(F.col(text_col), F.lit("")))


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The only two columns that the text operators read, so that other columns of any name can't clash."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def release_memory() -> None:
    """Gives freed memory back to the system: a Python worker stays when its task ends, and others need the room."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def released(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task returns; when that ends, its memory is given back."""
    REMEMBERED.clear()
    yield from rows
    release_memory()


def text_batches(batches: Iterable[pa.RecordBatch], columns: list[str], text_col: str = "text", limit: int = BATCH_BYTES, remember: bool = False) -> Iterator[tuple[list[list], list[bytes]]]:
    """Regroup Arrow batches into lists of about ``limit`` bytes of text; a null text reads as empty.

    Without ``remember`` the worker drops what another operator's tasks have left in ``REMEMBERED``.
    """
    if not remember:
        REMEMBERED.clear()
    rows: list[list] = [[] for _ in columns]
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        got = [batch.column(c).to_pylist() for c in columns]
        for k, text in enumerate(batch.column(text_col).cast(pa.binary())):
            text = text.as_py() or b""
            if texts and size + len(text) > limit:
                yield rows, texts
                rows, texts, size = [[] for _ in columns], [], 0
            for column, values in zip(rows, got):
                column.append(values[k])
            texts.append(text)
            size += len(text) + 1
    if texts:
        yield rows, texts
    del rows, texts
    release_memory()


def int64_ids(ids: list) -> list:
    """Ids as they are, checked: the operators compare ids as 64-bit integers."""
    return [None if x is None else int(x) for x in ids]
