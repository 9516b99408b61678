"""Products of the columns of a tall table, summed in the tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_products(rows: DataFrame, column: str, n: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(number of rows, sums, n x n sums of products) of an array column of length ``n`` without nulls.

    Each task sends its own small matrix, row by row; the driver gets n x (n + 1) numbers whatever the number of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n + 1, n + 1))
        for batch in batches:
            x = np.ones((len(batch), n + 1))
            x[:, 1:] = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), n)
            total += x.T @ x
        i, j = np.meshgrid(np.arange(n + 1), np.arange(n + 1), indexing="ij")
        yield pa.record_batch([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], ["i", "j", "v"])

    sums = rows.select(F.col(column).cast("array<double>")).mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((n + 1, n + 1))
    for r in sums.collect():
        out[r.i, r.j] = r.v
    return int(round(out[0, 0])), out[0, 1:], out[1:, 1:]
