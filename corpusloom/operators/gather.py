"""Ordinals and whitening in one barrier stage: tasks tell each other counts and moments by allGather.

All tasks of the stage run at once (one a slot), and a message is a few numbers, whatever a partition holds. A
partition waits for the others' messages in Arrow batches, in memory up to KEEP bytes and beyond that in a
temporary file of its own task, which nobody else reads.
"""

from __future__ import annotations

import json
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP = 64 << 20


class Held:
    """Batches that can be read again and again."""

    def __init__(self, keep: int = KEEP):
        self.keep, self.batches, self.size, self.file, self.writer = keep, [], 0, None, None

    def add(self, batch: pa.RecordBatch) -> None:
        self.size += batch.nbytes
        if self.size <= self.keep:
            self.batches.append(batch)
            return
        if self.writer is None:
            self.file = tempfile.TemporaryFile()
            self.writer = pa.ipc.new_stream(self.file, batch.schema)
        self.writer.write_batch(batch)

    def __iter__(self) -> Iterator[pa.RecordBatch]:
        yield from self.batches
        if self.writer is not None:
            self.writer.close()
            self.file.seek(0)
            yield from pa.ipc.open_stream(self.file)


def whitened(rows: DataFrame, key: str, values: str, eps: float = 1e-8, keep: int = KEEP) -> DataFrame:
    """key, ord (place in the order of key), values as (x - mean) / sqrt(variance + eps) over all values of all rows.

    values: arrays of numbers. The variance is the sample's, or the plain one of a single value. Null arrays and
    null elements stay null and do not count. Rows with equal keys have neighbouring places.
    """
    n = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    kind = rows.schema[key].dataType.simpleString()
    rows = rows.select(F.col(key), F.col(values).cast("array<double>").alias("x")).repartitionByRange(n, key).sortWithinPartitions(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get()
        held, count, numbers, total = Held(keep), 0, 0, 0.0

        def flat(b: pa.RecordBatch) -> np.ndarray:
            return b.column(1).flatten().drop_null().to_numpy(zero_copy_only=False)

        for b in batches:
            held.add(b)
            x = flat(b)
            count, numbers, total = count + len(b), numbers + len(x), total + float(x.sum())
        told = [json.loads(m) for m in context.allGather(json.dumps([count, numbers, total]))]
        ord_ = sum(c for c, _, _ in told[: context.partitionId()])
        every = sum(m for _, m, _ in told)
        mean = sum(t for _, _, t in told) / max(every, 1)
        squares = sum(float(((flat(b) - mean) ** 2).sum()) for b in held)
        squares = sum(json.loads(m) for m in context.allGather(json.dumps(squares)))
        deviation = float(np.sqrt(squares / max(every - 1, 1) + eps))
        for b in held:
            lists = b.column(1)
            x = pa.array((lists.values.to_numpy(zero_copy_only=False) - mean) / deviation, mask=lists.values.is_null().to_numpy(zero_copy_only=False))
            out = pa.ListArray.from_arrays(lists.offsets, x, mask=lists.is_null() if lists.null_count else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.arange(ord_, ord_ + len(b))), out], [key, "ord", values])
            ord_ += len(b)

    return rows.mapInArrow(run, f"{key} {kind}, ord long, {values} array<double>", barrier=True)
