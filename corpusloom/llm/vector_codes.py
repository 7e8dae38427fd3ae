"""Product codes of vectors: nearest codebook entries found through segment-mean lower bounds.

Components become integers floor(256 x) and vectors PARTS equal parts, each with a codebook of up to ENTRIES
entries. For a part x and an entry c cut into segments of g components, Cauchy-Schwarz gives per segment
    |x - c|^2 >= g (mean x - mean c)^2 + (|x - mean x| - |c - mean c|)^2.
The search goes from coarse to fine: one segment, then two, four, and so on. At each step the entries whose sum of
bounds, less a slack for rounding, exceeds the exact distance to the entry of the smallest first bound are
left out; survivors get exact integer distances, and ties go to the lower index. So the bounds decide only how
much is computed. Codebooks are a few thousand integers: they travel to the tasks, which send back one
row of counts and sums for each entry that they used.

Defined cases: rows go whose vector is null or has a null, NaN or infinite component; components beyond LIMIT in
size count as LIMIT, so that all distances fit 64 bits; vectors are read with zeros after their end up to the
least multiple of PARTS that holds the longest; with under ENTRIES rows there are as many entries; equal vec_ids are
taken in the order of their vectors, null ones last; repeated rows count as often as they come; a null label is a
label; sums of errors beyond 64 bits stay at their limit; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE, LIMIT = 256.0, 1 << 24
#: Rows whose bounds a task holds at once.
CHUNK = 4096


# -- nearest entries -----------------------------------------------------------------------------------


def segments(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Means times the root of a segment's length, and residual norms, of n nearly equal segments: arrays (rows, n)."""
    cuts = np.linspace(0, x.shape[1], n + 1).astype(int)
    sizes = np.diff(cuts)
    sums = np.add.reduceat(x, cuts[:-1], axis=1).astype(np.float64)
    squares = np.add.reduceat(x * x, cuts[:-1], axis=1).astype(np.float64)
    means = sums / np.sqrt(sizes)
    return means, np.sqrt(np.maximum(squares - means * means, 0))


def levels(width: int) -> list[int]:
    """Numbers of segments, from coarse to fine; segments of one component would be the distance itself."""
    return [n for n in (1 << k for k in range(20)) if n == 1 or 2 * n <= width]


def nearest(x: np.ndarray, book: np.ndarray, tally: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the entry of `book` nearest to each row of x, all of 64-bit integers."""
    index, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    norms = (book * book).sum(axis=1).astype(np.float64)
    for at in range(0, len(x), CHUNK):
        part = x[at : at + CHUNK]
        n = len(part)
        slack = ((part * part).sum(axis=1).astype(np.float64)[:, None] + norms) * 1e-9
        (mx, rx), (mc, rc) = segments(part, 1), segments(book, 1)
        bound = (mx - mc[:, 0]) ** 2 + (rx - rc[:, 0]) ** 2 - slack
        guess = bound.argmin(axis=1)
        best = ((part - book[guess]) ** 2).sum(axis=1)
        row, entry = np.nonzero(bound <= best[:, None])
        for k in levels(x.shape[1])[1:]:
            (mx, rx), (mc, rc) = segments(part, k), segments(book, k)
            finer = ((mx[row] - mc[entry]) ** 2 + (rx[row] - rc[entry]) ** 2).sum(axis=1) - slack[row, entry]
            may = finer <= best[row]
            row, entry = row[may], entry[may]
        if tally is not None:
            tally.append((n * len(book), len(row)))
        exact = ((part[row] - book[entry]) ** 2).sum(axis=1)
        order = np.lexsort((entry, exact, row))  # every row has its guess at least
        first = order[np.searchsorted(row[order], np.arange(n))]
        index[at : at + n], distance[at : at + n] = entry[first], exact[first]
    return index, distance


# -- batches -------------------------------------------------------------------------------------------


def integers(column: pa.Array, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows that stay, integers (row, component)) of portions of a column of lists, zeros after a vector's end."""
    step = max(1, (CHUNK << 8) // max(most, 1))
    for at in range(0, len(column), step):
        part = column.slice(at, step)
        sizes = np.nan_to_num(part.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
        flat = part.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components are NaN
        row = np.repeat(np.arange(len(part)), sizes)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        bad = np.zeros(len(part), bool)
        bad[row[~np.isfinite(flat)]] = True
        bad |= part.is_null().to_numpy(zero_copy_only=False)
        out = np.zeros((len(part), most), np.int64)
        good = ~bad[row]
        out[row[good], place[good]] = np.clip(np.floor(flat[good] * SCALE), -LIMIT, LIMIT).astype(np.int64)
        yield at + np.flatnonzero(~bad), out[~bad]


def _prepare(most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, x in integers(b.column("embedding"), most):
                size = most * 8
                data = np.ascontiguousarray(x, "<i8").tobytes()
                packed = [data[k * size : (k + 1) * size] for k in range(len(x))]
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([b.column("vec_id").take(at), b.column("label").take(at), pa.array(packed, pa.binary())], ["vec_id", "label", "ints"])

    return run


def _unpacked(b: pa.RecordBatch, most: int) -> np.ndarray:
    return np.frombuffer(b"".join(b.column("ints").to_pylist()), "<i8").reshape(-1, most)


def _totals(books: np.ndarray) -> Callable:
    """Of each entry that the task's parts chose: (part, entry, count, componentwise sums)."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for b in batches:
            x = _unpacked(b, parts * width)
            for p in range(parts):
                own = x[:, p * width : (p + 1) * width]
                index, _ = nearest(own, books[p])
                count[p] += np.bincount(index, minlength=entries)
                np.add.at(sums[p], index, own)
        p, e = np.nonzero(count)
        cols = [pa.array(p), pa.array(e), pa.array(count[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, ["part", "entry", "n", "sums"])

    return run


def _encode(books: np.ndarray) -> Callable:
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _unpacked(b, parts * width)
            codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                index, distance = nearest(x[:, p * width : (p + 1) * width], books[p])
                codes[:, p] = index
                error += distance
            cols = [b.column("vec_id"), b.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "label", "code", "error"])

    return run


# -- the operator --------------------------------------------------------------------------------------


def _vectors(vectors: DataFrame) -> tuple[DataFrame, int]:
    """Staged (vec_id, label, ints) of the rows that stay, and the number of components."""
    vectors = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    good = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    longest = vectors.where(good).agg(F.max(F.size("embedding"))).first()[0] or 1
    most = -(-longest // PARTS) * PARTS
    return stage(vectors.where(good).mapInArrow(_prepare(most), "vec_id long, label long, ints binary"), "vectors").df, most


def fit(kept: DataFrame, most: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (part, entry, component) after some rounds of assignment and floored means; None without rows. kept: staged."""
    first = kept.orderBy(F.col("vec_id").isNull(), "vec_id", "ints").limit(entries).select("ints").collect()
    if not first:
        return None
    start = np.frombuffer(b"".join(bytes(r.ints) for r in first), "<i8").reshape(len(first), parts, most // parts)
    books = np.ascontiguousarray(start.transpose(1, 0, 2))
    for _ in range(rounds):
        found = kept.mapInArrow(_totals(books), "part long, entry long, n long, sums array<long>")
        found = found.select("part", "entry", "n", F.posexplode("sums").alias("k", "x"))
        new = books.copy()
        for r in found.groupBy("part", "entry", "k").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect():  # one row a codebook integer
            new[r.part, r.entry, r.k] = r.x // r.n
        books = new
    return books


def encode(vectors: DataFrame) -> DataFrame:
    """One row per row that stays: vec_id, code, error, label_error, codebooks_sha256."""
    kept, most = _vectors(vectors)
    books = fit(kept, most)
    if books is None:
        return kept.selectExpr("vec_id", "'' AS code", "0L AS error", "0L AS label_error", "'' AS codebooks_sha256")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = stage(kept.mapInArrow(_encode(books), "vec_id long, label long, code string, error long"), "codes").df
    most_ = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(20,0)")).cast("decimal(38,0)"), most_).cast("long").alias("label_error"))
    out = coded.join(sums, coded["label"].eqNullSafe(sums["of"]))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "embeddings"))


def _rounds() -> str:
    """A round of assignment and floored means for each codebook but the first."""
    ctes = []
    for k in range(ROUNDS + 1):
        ctes.append(f"""
a{k} AS MATERIALIZED (
  SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d
  FROM (SELECT x.vec_id, x.part, b.entry, sum((x.v - b.v) * (x.v - b.v))::BIGINT AS d
        FROM x JOIN b{k} b ON x.part = b.part AND x.pos = b.pos GROUP BY x.vec_id, x.part, b.entry)
  GROUP BY vec_id, part)""")
        if k < ROUNDS:
            ctes.append(f"""
b{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.pos, coalesce(m.v, b.v) AS v
  FROM b{k} b LEFT JOIN (
    SELECT a.part, a.entry, x.pos, floor(sum(x.v)::DOUBLE / count(*))::BIGINT AS v FROM a{k} a JOIN x ON a.vec_id = x.vec_id AND a.part = x.part GROUP BY a.part, a.entry, x.pos
  ) m ON b.part = m.part AND b.entry = m.entry AND b.pos = m.pos)""")
    return ",".join(ctes)


OP13_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, embedding, len(embedding) // {PARTS} AS width FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
x AS MATERIALIZED (
  SELECT vec_id, (i - 1) // width AS part, (i - 1) % width AS pos, floor({SCALE:.0f} * embedding[i]::DOUBLE)::BIGINT AS v
  FROM (SELECT vec_id, embedding, width, unnest(range(1, len(embedding) + 1)) AS i FROM kept)),
b0 AS MATERIALIZED (
  SELECT part, entry, pos, v FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < {ENTRIES}) USING (vec_id)),
{_rounds()},
c AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM c JOIN kept USING (vec_id), h
"""
