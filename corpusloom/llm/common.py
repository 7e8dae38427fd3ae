"""Shared helpers: words, A-Z case, connected components; staging comes from the core."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Staged, shared_root, stage

__all__ = ["UPPER", "WORD", "Staged", "ascii_lower", "connected_components", "free_names", "meet", "shared_root", "stage", "table"]

#: Python's bytes.split() and this class agree: ASCII space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take the faster built-in; the results are equal."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def free_names(rows: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores more as it takes for none of them to be a column of rows."""
    taken, more = {c.lower() for c in rows.columns}, ""
    while any((n + more).lower() in taken for n in names):
        more += "_"
    return [n + more for n in names]


def meet(rows: DataFrame, side: DataFrame, heavy: DataFrame, on: list[str]) -> DataFrame:
    """rows joined with side. heavy: staged keys that each have over a p-th of the rows, so p of them at most.

    Those meet by a broadcast, so that no task takes a heavy key's rows; all others by a shuffled join.
    """
    heavy = F.broadcast(heavy)
    return rows.join(F.broadcast(side.join(heavy, on, "left_semi")), on).unionByName(rows.join(heavy, on, "left_anti").join(side, on))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> Staged:
    """Smallest reachable node of every node that has an edge, by alternating large and small stars.

    edges: columns u, v of one orderable type; self-loops and repeats are allowed. Returns staged
    (node, root). Each half round is one aggregation with map-side combine and one equi-join, which
    adaptive execution may split at a hub. No group is gathered anywhere.
    """
    cur = stage(edges.select("u", "v").where("u <> v").distinct(), "edges")
    for _ in range(max_rounds):
        e = cur.df
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("a"), F.col("u").alias("b"), "m")
        small = small.select(F.explode(F.array(F.col("a"), F.col("b"))).alias("u"), F.col("m").alias("v"))
        new = stage(small.where("u <> v").distinct(), "edges")
        cur.drop()
        cur = new
        # done when all edges are stars: one centre a node, and no centre hangs on another node
        n, nodes = cur.df.agg(F.count("*"), F.count_distinct("u")).first()
        if n == nodes and cur.df.join(cur.df.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError("connected components did not settle")
    e = cur.df
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    out = stage(e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), "components")
    cur.drop()
    return out
