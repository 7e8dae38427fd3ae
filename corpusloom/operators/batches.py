"""Row and batch algebra: selection, union by position, repeat, split, pad, reorder, balanced partitions."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..scratch import stage


def select_known(rows: DataFrame, names: list[str]) -> DataFrame:
    """The named columns that exist; unknown names are ignored."""
    return rows.select(*[n for n in names if n in rows.columns])


def pop(rows: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    taken = [n for n in names if n in rows.columns]
    return rows.select(*taken), rows.drop(*taken)


def numbered(rows: DataFrame, by: list, name: str = "ord") -> DataFrame:
    """rows with their place (from 0) in a total order, numbered by ranges and not in one task.

    The ranges are made once: the sorted rows are staged with their range and their place within it, so that
    the counts of the ranges (one row each) and the rows never come from two different samplings.
    """
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__m", F.monotonically_increasing_id())
    ranged = stage(ranged, "ranges").df.withColumn("__p", F.shiftright("__m", 33))
    parts = ranged.groupBy("__p").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select("__p", F.coalesce(before, F.lit(0)).alias("__b"))  # as many rows as ranges
    place = F.col("__b") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(F.broadcast(parts), "__p").withColumn(name, place).drop("__p", "__m", "__b")


def take(rows: DataFrame, ordinals: list[int] | None = None, start: int = 0, stop: int | None = None, step: int = 1, mask: Column | None = None) -> DataFrame:
    """Rows by a list of ordinals, a slice or a mask."""
    o = F.col("ord")
    if ordinals is not None:
        return rows.where(o.isin(ordinals))
    if mask is not None:
        return rows.where(mask)
    return rows.where((o >= start) & (F.lit(stop is None) | (o < (stop or 0))) & (F.pmod(o - start, F.lit(step)) == 0))


def union_columns(left: DataFrame, right: DataFrame, on: str = "ord") -> DataFrame:
    """Columns side by side by ordinal; a column of both sides must be equal, else it is an error."""
    both = [c for c in right.columns if c in left.columns and c != on]
    r = right.withColumnsRenamed({c: f"__r_{c}" for c in both})
    out = left.join(r, on, "full")
    for c in both:
        bad = F.raise_error(F.lit(f"column {c} differs")).cast(left.schema[c].dataType)
        out = out.withColumn(c, F.when(F.col(c).eqNullSafe(F.col(f"__r_{c}")), F.col(c)).otherwise(bad))
    return out.drop(*[f"__r_{c}" for c in both])


def concat(batches: list[DataFrame]) -> DataFrame:
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out


def concat_with_meta(batches: list[tuple[DataFrame, dict]]) -> tuple[DataFrame, dict]:
    """The rows of all batches, and what the first batch says about itself."""
    return concat([rows for rows, _ in batches]), dict(batches[0][1])


def repeat(rows: DataFrame, n: int, interleave: bool = True) -> DataFrame:
    """Every row n times; `place` numbers them row by row (interleaved) or copy by copy (tiled)."""
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if interleave:
        return copies.withColumn("place", F.col("ord") * n + F.col("copy"))
    total = rows.agg(F.count("*").alias("__n"))
    return copies.join(F.broadcast(total)).withColumn("place", F.col("copy") * F.col("__n") + F.col("ord")).drop("__n")


def chunk(rows: DataFrame, n: int) -> DataFrame:
    """Equal parts by ordinal; a count that n does not divide is an error."""
    total = rows.agg(F.count("*").alias("__n"))
    size = F.when(F.col("__n") % n == 0, F.col("__n") / n).otherwise(F.raise_error(F.lit("rows do not divide equally")).cast("double"))
    return rows.join(F.broadcast(total)).withColumn("chunk", F.floor(F.col("ord") / size)).drop("__n")


def pad_to(rows: DataFrame, divisor: int) -> DataFrame:
    """Rows wrapped around from the start until the count divides; `padded` marks them for removal."""
    total = rows.agg(F.count("*").alias("__n"))
    r = rows.join(F.broadcast(total))
    lack = F.pmod(-F.col("__n"), F.lit(divisor))
    laps = F.when(F.col("ord") < lack, F.floor((lack - 1 - F.col("ord")) / F.col("__n")) + 1).otherwise(0)
    more = r.where(laps > 0).withColumn("lap", F.explode(F.sequence(F.lit(1).cast("long"), laps.cast("long"))))
    more = more.withColumn("ord", F.col("ord") + F.col("lap") * F.col("__n")).drop("lap", "__n").withColumn("padded", F.lit(True))
    return rows.withColumn("padded", F.lit(False)).unionByName(more)


def unpad(rows: DataFrame) -> DataFrame:
    return rows.where("NOT padded").drop("padded")


def reorder(rows: DataFrame, permutation: DataFrame) -> DataFrame:
    """permutation: (pos, ord): the row `ord` comes to place `pos`."""
    return rows.join(permutation, "ord").withColumn("old", F.col("ord")).withColumn("ord", F.col("pos")).drop("pos")


def restore(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ord", F.col("old")).drop("old")


def fold(rows: DataFrame, k: int, value: str) -> DataFrame:
    """k neighbouring rows to one, their values in order."""
    g = rows.groupBy(F.floor(F.col("ord") / k).alias("row")).agg(F.array_sort(F.collect_list(F.struct("ord", value))).alias("v"))
    return g.select("row", F.transform("v", lambda x: x[value]).alias(value))


def mini_batches(rows: DataFrame, size: int, epochs: int, seed, id_col: str = "ord") -> DataFrame:
    """(epoch, batch) of every row in a seeded order of each epoch; incomplete batches drop."""
    from .curation import hash_rank

    e = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    e = e.withColumn("__h", hash_rank(seed, F.concat(F.col("epoch").cast("string"), F.lit(":"), F.col(id_col).cast("string"))))
    e = numbered(e, ["epoch", "__h", id_col], "__o")
    n = rows.agg(F.count("*").alias("__n"))
    e = e.join(F.broadcast(n)).withColumn("batch", F.floor((F.col("__o") - F.col("epoch") * F.col("__n")) / size))
    return e.where(F.col("batch") < F.floor(F.col("__n") / size)).drop("__h", "__o", "__n")


def smoke_slice(rows: DataFrame, n: int) -> DataFrame:
    """n rows from the start, around again where there are fewer, with suffixed ids."""
    total = rows.agg(F.count("*").alias("__n"))
    r = rows.join(F.broadcast(total)).withColumn("lap", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((n - 1 - F.col("ord")) / F.col("__n")), F.lit(-1)).cast("long"))))
    r = r.where((F.col("lap") >= 0) & (F.col("ord") + F.col("lap") * F.col("__n") < n))
    return r.withColumn("id", F.concat(F.col("id").cast("string"), F.lit("_smoke_"), (F.col("ord") + F.col("lap") * F.col("__n")).cast("string"))).drop("__n", "lap")


def repeat_prompts(rows: DataFrame, n: int) -> DataFrame:
    return repeat(rows, n).withColumnRenamed("copy", "sample_index")


# -- balanced partitions -------------------------------------------------------------------------------


def karmarkar_karp(lengths: list[int], k: int, equal: bool) -> list[list[int]]:
    """k index sets of nearly equal sums by largest differencing; with `equal`, of equal sizes too.

    A state is k parts in falling order of sums; the two states that are most uneven merge, the largest parts
    of one with the smallest of the other.
    """
    n = len(lengths)
    if equal and n % k:
        raise ValueError("rows do not divide equally")
    order = sorted(range(n), key=lambda i: (-lengths[i], i))
    if equal:
        states = [[(lengths[i], [i]) for i in order[a : a + k]] for a in range(0, n, k)]
    else:
        states = [[(lengths[i], [i])] + [(0, [])] * (k - 1) for i in order]
    heap = [(-(s[0][0] - s[-1][0]), j, s) for j, s in enumerate(states)]
    heapq.heapify(heap)
    tick = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        both = [(x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b))]
        both.sort(key=lambda t: (-t[0], sorted(t[1])))
        heapq.heappush(heap, (-(both[0][0] - both[-1][0]), tick, both))
        tick += 1
    parts = [sorted(p) for _, p in (heap[0][2] if heap else [(0, [])] * k)]
    return sorted(parts)


def least_loaded(lengths: list[int], k: int, equal: bool = False) -> list[list[int]]:
    """In the order of input, each to the part with the smallest sum, the first of equal ones; a part keeps its place, also an empty one."""
    parts: list[list[int]] = [[] for _ in range(k)]
    heap = [(0, j) for j in range(k)]
    for i in range(len(lengths)):
        total, j = heapq.heappop(heap)
        parts[j].append(i)
        if not equal or len(parts[j]) * k < len(lengths):
            heapq.heappush(heap, (total + lengths[i], j))
    return parts


def blocks(lengths: list[int], k: int) -> list[list[int]]:
    """k runs of neighbouring rows, of equal sizes where k divides the rows."""
    n = len(lengths)
    parts: list[list[int]] = [[] for _ in range(k)]
    for i in range(n):
        parts[i * k // n].append(i)
    return parts


def even_parts(lengths: list[int], k: int, equal: bool) -> list[list[int]]:
    """Largest differencing, or the blocks where these happen to be more even, so that balancing never makes a batch worse."""

    def spread(parts: list[list[int]]) -> int:
        sums = [sum(lengths[i] for i in p) for p in parts if p]  # parts without rows do not show
        return max(sums, default=0) - min(sums, default=0)

    return min((karmarkar_karp(lengths, k, equal), blocks(lengths, k)), key=spread)


def balance(rows: DataFrame, batch: str, length: str, k: int, equal: bool = True, method=even_parts) -> DataFrame:
    """rows plus `part` by balanced partition within each batch; a batch is one training step's rows and fits a task."""
    schema = rows.select(batch, "ord", length).schema.simpleString()[7:-1].replace(":", " ") + ", part int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord").reset_index(drop=True)
        part = [0] * len(pdf)
        for j, members in enumerate(method([int(x) for x in pdf[length]], k, equal)):
            for i in members:
                part[i] = j
        return pdf.assign(part=part)

    return rows.select(batch, "ord", length).groupBy(batch).applyInPandas(run, schema)


def token_batches(rows: DataFrame, batch: str, length: str, most_tokens: int) -> DataFrame:
    """Micro-batches of at most about most_tokens: min(n, ceil(sum / most)) parts, largest squared length first."""
    schema = rows.select(batch, "ord", length).schema.simpleString()[7:-1].replace(":", " ") + ", part int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord").reset_index(drop=True)
        lengths = [int(x) for x in pdf[length]]
        k = min(len(lengths), max(1, -(-sum(lengths) // most_tokens)))
        parts = sorted(karmarkar_karp(lengths, k, False), key=lambda p: -sum(lengths[i] ** 2 for i in p))
        place = {i: j for j, p in enumerate(parts) for i in p}
        return pdf.assign(part=[place[i] for i in range(len(pdf))])

    return rows.select(batch, "ord", length).groupBy(batch).applyInPandas(run, schema)


def imbalance(parted: DataFrame, batch: str, length: str, k: int) -> DataFrame:
    """Sums of contiguous blocks and of assigned parts: least, most and difference, before and after."""
    n = F.count(F.lit(1)).over(W.partitionBy(batch))
    place = F.row_number().over(W.partitionBy(batch).orderBy("ord")) - 1
    rows = parted.withColumn("block", F.floor(place * k / n))
    before = rows.groupBy(batch, "block").agg(F.sum(length).alias("s")).groupBy(batch).agg(F.min("s").alias("min_before"), F.max("s").alias("max_before"))
    after = rows.groupBy(batch, "part").agg(F.sum(length).alias("s")).groupBy(batch).agg(F.min("s").alias("min_after"), F.max("s").alias("max_after"))
    both = before.join(after, batch)
    return both.withColumn("diff_before", F.col("max_before") - F.col("min_before")).withColumn("diff_after", F.col("max_after") - F.col("min_after"))
