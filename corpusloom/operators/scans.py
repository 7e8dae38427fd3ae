"""Recurrences over long sequences as parallel scans: y_t = add_t + mult_t * y_(t+1), from the end.

One step is an affine map of what follows, and maps of neighbouring steps compose to one. Sequences are rows (key,
place from 0). Places fall into blocks; each block composes its maps to one, the blocks' maps are scanned in the
same way (as often as it takes until one block is left), and what flows into each block is then known, so that all
blocks are solved side by side. No task holds more than a block, however long a sequence is.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import stage

BLOCK = 1 << 16


def _ordered(t: pa.Table) -> tuple[pa.Table, list[float], list[float]]:
    t = t.sort_by("place")
    return t, t["mult"].to_pylist(), t["add"].to_pylist()


def _compose(block: int):
    def run(t: pa.Table) -> pa.Table:
        t, mult, add = _ordered(t)
        m, a = 1.0, 0.0  # of what comes after the block
        for x, b in zip(reversed(mult), reversed(add)):
            m, a = x * m, b + x * a
        row = [t["key"][:1].combine_chunks(), pa.array([t["place"][0].as_py() // block]), pa.array([m]), pa.array([a])]
        return pa.Table.from_arrays(row, ["key", "place", "mult", "add"])

    return run


def _solve(t: pa.Table) -> pa.Table:
    t, mult, add = _ordered(t)
    y, out = t["carry"][0].as_py() or 0.0, []
    for x, b in zip(reversed(mult), reversed(add)):
        y = b + x * y
        out.append(y)
    return pa.Table.from_arrays([t["key"], t["place"], pa.array(out[::-1], pa.float64())], ["key", "place", "y"])


def affine_scan(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows: key, place (from 0, no gaps), mult, add. Gives key, place, y; after the last place y counts as 0."""
    kind = rows.schema["key"].dataType.simpleString()
    rows = stage(rows.select("key", F.col("place").cast("long"), F.col("mult").cast("double"), F.col("add").cast("double")), "steps").df
    last = rows.agg(F.max("place")).first()[0]
    here = F.floor(F.col("place") / block)
    if last is None or last < block:
        rows = rows.withColumn("carry", F.lit(0.0))
    else:
        maps = rows.withColumn("b", here).groupBy("key", "b").applyInArrow(_compose(block), f"key {kind}, place long, mult double, add double")
        carry = affine_scan(maps, block).select(F.col("key").alias("k"), (F.col("place") - 1).alias("b"), F.col("y").alias("carry"))
        rows = rows.join(carry, F.col("key").eqNullSafe(F.col("k")) & (here == F.col("b")), "left").drop("k", "b")
    return rows.withColumn("b", here).groupBy("key", "b").applyInArrow(_solve, f"key {kind}, place long, y double")


def _with_next(rows: DataFrame, **names: str) -> DataFrame:
    """rows with what stands one place later, by a join on (key, place), so that no sequence is gathered."""
    later = rows.select(F.col("key").alias("__k"), (F.col("place") - 1).alias("__p"), *[F.col(c).alias(n) for n, c in names.items()])
    return rows.join(later, F.col("key").eqNullSafe(F.col("__k")) & (F.col("place") == F.col("__p")), "left").drop("__k", "__p")


def gae(rows: DataFrame, gamma: float, lam: float, block: int = BLOCK) -> DataFrame:
    """rows: key, place, reward, value. key, place, y: advantages r + gamma v' - v + gamma lam y', as `rollouts.gae` folds arrays."""
    r = _with_next(rows.select("key", "place", "reward", "value"), after="value")
    add = F.col("reward") + gamma * F.coalesce("after", F.lit(0.0)) - F.col("value")
    return affine_scan(r.select("key", "place", F.lit(gamma * lam).alias("mult"), add.alias("add")), block)


def discounted_returns(rows: DataFrame, gamma: float, block: int = BLOCK) -> DataFrame:
    """rows: key, place, reward, mask. key, place, y: r + gamma y', where what follows counts if its mask is 1."""
    r = _with_next(rows.select("key", "place", "reward", "mask"), after="mask")
    mult: Column = gamma * F.coalesce(F.col("after").cast("double"), F.lit(0.0))
    return affine_scan(r.select("key", "place", mult.alias("mult"), F.col("reward").alias("add")), block)
