"""Sums of long arrays over all tasks, folded a few at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import tidy_group

#: Arrays that one task adds up.
FAN = 32
SCHEMA = "task int, slot int, data binary"
_codec = pa.Codec("zstd")


def packed(x: np.ndarray) -> bytes:
    return _codec.compress(x.astype(np.int64).tobytes(), asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(_codec.decompress(data, decompressed_size=8 * n, asbytes=True), np.int64)


def tree_sum(rows: DataFrame, tasks: int, n: int) -> list[np.ndarray | None]:
    """For each slot the sum of its arrays of ``n`` longs; ``rows``: (task, slot, data), ``tasks`` tasks at most.

    What comes to the driver is one array a slot, whatever the number of rows and tasks.
    """

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(n, np.int64)
        for data in table.column("data").to_pylist():
            total += unpacked(data, n)
        return pa.table({"task": table.column("task")[:1].cast(pa.int32()), "slot": table.column("slot")[:1].cast(pa.int32()), "data": [packed(total)]})

    while True:
        tasks = -(-tasks // FAN)
        rows = rows.withColumn("task", F.pmod("task", F.lit(tasks)).cast("int")).groupBy("task", "slot").applyInArrow(tidy_group(add), SCHEMA)
        if tasks == 1:
            break
    got = {slot: unpacked(data, n) for _, slot, data in rows.collect()}
    return [got.get(k) for k in range(max(got, default=-1) + 1)]
