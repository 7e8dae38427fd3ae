"""Grading samples, difficulty bins, balanced and target-accuracy selection."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from ..functions.fixed import DIFFICULTY_BINS
from .batches import numbered
from .curation import hash_rank

#: Prompts that a task hands to its threads at once.
JUDGED = 256


def mean_or_zero(x: Column) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def solve_rates(samples: DataFrame, key: str, correct: str) -> DataFrame:
    """key, n_samples, n_correct, solve_rate."""
    ok = F.col(correct).cast("int")
    return samples.groupBy(key).agg(F.count("*").alias("n_samples"), F.sum(ok).alias("n_correct"), F.avg(ok).alias("solve_rate"))


def histogram(rates: DataFrame, rate: str = "solve_rate") -> DataFrame:
    """All six difficulty bins with their counts, zero where empty; rows without a rate are in none."""
    bins = rates.sparkSession.createDataFrame([(b,) for b in DIFFICULTY_BINS], "bin string")
    counts = rates.groupBy(X.difficulty_bin(F.col(rate)).alias("bin")).agg(F.count("*").alias("n"))
    return bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def band(rates: DataFrame, low: float, high: float, rate: str = "solve_rate") -> DataFrame:
    """Rows whose rate lies in [low, high]; a missing rate counts as -1."""
    return rates.where(F.coalesce(F.col(rate), F.lit(-1.0)).between(low, high))


def stratify(rows: DataFrame, seed, cap: int | None = None, rate: str = "solve_rate", id_col: str = "id") -> DataFrame:
    """At most `cap` rows a bin in hash order; by default as many as the smallest non-empty bin has.

    The rows are numbered by ranges of (bin, hash), so that no bin is sorted in one task.
    """
    binned = rows.withColumn("bin", X.difficulty_bin(F.col(rate))).where("bin IS NOT NULL").withColumn("__h", hash_rank(seed, F.col(id_col)))
    placed = numbered(binned, ["bin", "__h", id_col], "__o")
    bins = placed.groupBy("bin").agg(F.min("__o").alias("__first"), F.count("*").alias("__n"))  # six rows at most
    least = F.lit(cap) if cap is not None else F.min("__n").over(W.partitionBy(F.lit(1)))
    bins = bins.select("bin", "__first", least.alias("__cap"))
    return placed.join(F.broadcast(bins), "bin").where(F.col("__o") - F.col("__first") < F.col("__cap")).drop("__h", "__o", "__first", "__cap")


def trim_to_mean(rows: DataFrame, target: float, rate: str = "solve_rate", id_col: str = "id") -> DataFrame:
    """Drop the easiest rows while the mean is above target, or the hardest while it is below.

    Rows are ordered by rate, then id; a running sum from the kept end finds how many stay. The order is
    global, so sums are taken over distinct rates first and only those (few: rates are fractions of a
    sample count) are accumulated in one place; rows are numbered by ranges.
    """
    placed = numbered(rows, [rate, id_col], "__o")
    steps = placed.groupBy(F.col(rate).alias("r")).agg(F.count("*").alias("n"), F.min("__o").alias("first"))
    up = W.orderBy("r").rowsBetween(W.unboundedPreceding, -1)
    down = W.orderBy(F.desc("r")).rowsBetween(W.unboundedPreceding, -1)
    total = steps.agg((F.sum(F.col("r") * F.col("n")) / F.sum("n")).alias("mean"))
    s = steps.join(F.broadcast(total))  # one row
    zero = F.lit(0.0)
    for name, w in (("up", up), ("down", down)):
        s = s.withColumn(f"n_{name}", F.coalesce(F.sum("n").over(w), F.lit(0)))
        s = s.withColumn(f"s_{name}", F.coalesce(F.sum(F.col("n") * F.col("r")).over(w), zero))
    above = F.col("mean") > target

    def room(n: str, t: str) -> Column:
        """How many rows of this rate may join what is before it with the mean on the right side of target."""
        gap = target * F.col(n) - F.col(t)
        per = F.col("r") - target
        free = F.when(above, F.when(per <= 0, F.col("n")).otherwise(F.floor(gap / per + 1e-9))).otherwise(F.when(per >= 0, F.col("n")).otherwise(F.floor(gap / per + 1e-9)))
        return F.greatest(F.lit(0), F.least(F.col("n"), free)).cast("long")

    s = s.withColumn("take", F.when(above, room("n_up", "s_up")).when(F.col("mean") < target, room("n_down", "s_down")).otherwise(F.col("n")))
    s = s.select("r", "take", "n", "first", above.alias("above"))
    joined = placed.join(s, placed[rate] == s["r"])
    place = F.col("__o") - F.col("first")
    kept = F.when(F.col("above"), place < F.col("take")).otherwise(F.col("n") - place <= F.col("take"))
    return joined.where(kept).drop("r", "take", "n", "first", "above", "__o")


def recheck_merge(results: DataFrame, judgements: DataFrame, key: str = "id") -> DataFrame:
    """Rows below 0.5 whose judge says yes get score 1; the first score stays as deterministic_score.

    A missing score is 1.0 here (nothing to recheck), and 0 in the mean that final_score takes.
    """
    j = judgements.select(F.col(key), "judgement")
    asked = F.coalesce("score", F.lit(1.0)) < 0.5
    out = results.join(j, key, "left").withColumn("deterministic_score", F.col("score"))
    out = out.withColumn("llm_recheck_judgement", F.when(asked, F.col("judgement")))
    out = out.withColumn("llm_recheck_status", F.when(asked, "checked").otherwise("skipped"))
    return out.withColumn("score", F.when(asked & (F.col("judgement") == "yes"), F.lit(1.0)).otherwise(F.col("score"))).drop("judgement")


def final_score(results: DataFrame) -> DataFrame:
    return results.agg(F.bround(F.avg(F.coalesce("score", F.lit(0.0))) * 100, 2).alias("final_score"))


def judge_with(rows: DataFrame, judge, threads: int = 10) -> DataFrame:
    """rows (id, prompt) to (id, judgement) by an external judge: threads per task; any failure fails the task."""

    def run(batches):
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                for at in range(0, len(batch), JUDGED):  # so few prompts are Python strings at once
                    b = batch.slice(at, JUDGED)
                    said = pa.array(pool.map(judge, b.column("prompt").to_pylist()), pa.string())
                    yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.int64()), said], ["id", "judgement"])

    return rows.select("id", "prompt").mapInArrow(run, "id long, judgement string")
