"""A resumable iterator over seeded batches: the order of an epoch is a keyed bijection of row numbers.

Each round either leaves a number x or swaps it with k - x (modulo the number of rows), as a keyed function of the larger
of the two says; so each round is its own inverse, and all rounds in reverse order lead from a place back to
its row. An epoch is therefore neither sorted nor staged, any batch can be found on its own, and a position is two
numbers. Rows are numbered once (ord from 0, see `numbered`).
"""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME = (1 << 31) - 1
ROUNDS = 64
#: Rows of a batch request that are looked up by their numbers; more come from a scan that filters by place.
LOOKUP = 1_000_000


def round_keys(seed, epoch: int, rounds: int = ROUNDS) -> list[tuple[int, int, int, int, int]]:
    """Per round the constant of the swap and four factors of the keyed function."""
    out = []
    for r in range(rounds):
        d = hashlib.sha256(f"{seed}:{epoch}:{r}".encode()).digest()
        factors = [int.from_bytes(d[8 + 4 * j : 12 + 4 * j], "big") % PRIME for j in range(4)]
        out.append((int.from_bytes(d[:8], "big") >> 4, *factors))
    return out


def placed(x: int, n: int, keys: list[tuple]) -> int:
    for k, a, b, c, e in keys:
        y = (k - x) % n
        high = max(x, y)
        f = (a * (high % PRIME) + c * ((high >> 31) % PRIME) + b) % PRIME
        x = y if 2 * ((f * f + e) % PRIME) >= PRIME else x
    return x


def place_of(x: Column, n: int, keys: list[tuple]) -> Column:
    """The place of row number x; with the keys reversed the row number of place x."""
    names = ("k", "a", "b", "c", "e")
    rounds = F.array(*[F.struct(*[F.lit(v % n if name == "k" else v).cast("long").alias(name) for name, v in zip(names, key)]) for key in keys])

    def step(x: Column, r: Column) -> Column:
        y = F.pmod(r["k"] - x, F.lit(n))
        high = F.greatest(x, y)
        f = (r["a"] * (high % PRIME) + r["c"] * (F.shiftright(high, 31) % PRIME) + r["b"]) % PRIME
        return F.when(((f * f + r["e"]) % PRIME) * 2 >= PRIME, y).otherwise(x)

    return F.aggregate(rounds, x.cast("long"), step)


class BatchIterator:
    """Batches of `size` rows over `epochs` epochs; incomplete ones drop. take(k) gives the next k of them.

    state() is JSON; an iterator made with it goes on from there, and refuses another seed, size or number of rows.
    """

    def __init__(self, rows: DataFrame, size: int, epochs: int, seed, state: str | None = None, shuffle: bool = True):
        self.rows, self.size, self.epochs, self.seed, self.shuffle = rows, size, epochs, seed, shuffle
        self.n = rows.count()
        self.of_epoch = self.n // size
        self.at = 0
        if state is not None:
            held = json.loads(state)
            if {**held, "at": 0} != {**self._state(), "at": 0}:
                raise ValueError(f"the position belongs to another iterator: {held}")
            self.at = held["at"]

    def _state(self) -> dict:
        return {"at": self.at, "size": self.size, "seed": str(self.seed), "rows": self.n, "shuffle": self.shuffle}

    def state(self) -> str:
        return json.dumps(self._state(), sort_keys=True)

    def position(self) -> tuple[int, int]:
        """(epoch, batch) that comes next."""
        return divmod(self.at, self.of_epoch) if self.of_epoch else (0, 0)

    def _some(self, epoch: int, low: int, high: int) -> DataFrame:
        """Batches low to high - 1 of an epoch."""
        keys = round_keys(self.seed, epoch) if self.shuffle else []
        first, last = low * self.size, high * self.size
        if last - first <= LOOKUP:
            wanted = self.rows.sparkSession.range(first, last).withColumnRenamed("id", "place")
            wanted = wanted.withColumn("ord", place_of(F.col("place"), self.n, keys[::-1]) if keys else F.col("place"))
            out = self.rows.join(F.broadcast(wanted), "ord")
        else:
            out = self.rows.withColumn("place", place_of(F.col("ord"), self.n, keys) if keys else F.col("ord"))
            out = out.where(F.col("place").between(first, last - 1))
        return out.withColumn("epoch", F.lit(epoch)).withColumn("batch", F.floor(F.col("place") / self.size))

    def take(self, k: int) -> DataFrame:
        """rows with place, epoch and batch of the next k batches (fewer at the end)."""
        end = min(self.at + k, self.epochs * self.of_epoch)
        parts = []
        while self.at < end:
            epoch, low = divmod(self.at, self.of_epoch)
            high = min(self.of_epoch, low + end - self.at)
            parts.append(self._some(epoch, low, high))
            self.at += high - low
        if not parts:
            return self.rows.limit(0).select("*", F.lit(0).cast("long").alias("place"), F.lit(0).alias("epoch"), F.lit(0).cast("long").alias("batch"))
        return reduce(DataFrame.unionByName, parts)
