"""Fitted transforms over streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter


def apply_each_batch(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str) -> DataStreamWriter:
    """Writes every micro-batch of a stream, transformed, as Parquet; the number of the batch makes a retry overwrite itself."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write)
