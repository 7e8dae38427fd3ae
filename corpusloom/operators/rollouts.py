"""Group-relative statistics, advantages, masked reductions and losses over recorded rollouts.

A rollout is a row; token arrays are array columns. Each per-token recurrence is one fold over the row's own
arrays, so that no row is exploded for it; statistics over groups are aggregates or windows by group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..scratch import stage


def _d(x) -> Column:
    return F.lit(float(x))


def array_sum(x: Column) -> Column:
    return F.aggregate(x, _d(0), lambda a, v: a + v)


def masked_sum(x: Column, mask: Column) -> Column:
    return array_sum(F.zip_with(x, mask, lambda v, m: v * m))


# -- advantages ----------------------------------------------------------------------------------------


def grpo(rows: DataFrame, group: str = "uid", score: str = "score", eps: float = 1e-6) -> DataFrame:
    """(score - mean) / (sample deviation + eps) by group; a group of one is an error."""
    w = W.partitionBy(group)
    n = F.count(F.lit(1)).over(w)
    value = (F.col(score) - F.avg(score).over(w)) / (F.stddev_samp(score).over(w) + eps)
    return rows.withColumn("advantage", F.when(n > 1, value).otherwise(F.raise_error(F.lit("a group needs two samples")).cast("double")))


def rloo(rows: DataFrame, group: str = "uid", score: str = "score") -> DataFrame:
    """score less the mean of the group's other samples."""
    w = W.partitionBy(group)
    n = F.count(F.lit(1)).over(w)
    rest = (F.sum(score).over(w) - F.col(score)) / (n - 1)
    return rows.withColumn("advantage", F.when(n > 1, F.col(score) - rest).otherwise(F.raise_error(F.lit("a group needs two samples")).cast("double")))


def remax(rows: DataFrame, score: str = "score", baseline: str = "baseline") -> DataFrame:
    return rows.withColumn("advantage", F.col(score) - F.col(baseline))


def gae(rewards: Column, values: Column, gamma: float, lam: float) -> Column:
    """Advantages by the recurrence a_t = r_t + gamma v_(t+1) - v_t + gamma lam a_(t+1), from the end."""
    pairs = F.reverse(F.arrays_zip(rewards.alias("r"), values.alias("v")))
    zero = F.struct(_d(0).alias("a"), _d(0).alias("v"), F.array().cast("array<double>").alias("out"))

    def step(s, x):
        a = x["r"] + gamma * s["v"] - x["v"] + gamma * lam * s["a"]
        return F.struct(a.alias("a"), x["v"].cast("double").alias("v"), F.concat(s["out"], F.array(a)).alias("out"))

    return F.reverse(F.aggregate(pairs, zero, step, lambda s: s["out"]))


def discounted_returns(rewards: Column, mask: Column, gamma: float) -> Column:
    """Running discounted sums from the end; what lies before a place with mask 0 starts anew."""
    pairs = F.reverse(F.arrays_zip(rewards.alias("r"), mask.alias("m")))
    zero = F.struct(_d(0).alias("g"), F.array().cast("array<double>").alias("out"))

    def step(s, x):
        g = x["r"] + gamma * s["g"]
        return F.struct((g * x["m"]).alias("g"), F.concat(s["out"], F.array(g)).alias("out"))

    return F.reverse(F.aggregate(pairs, zero, step, lambda s: s["out"]))


ESTIMATORS = {"grpo": grpo, "rloo": rloo, "remax": remax}


def register_estimator(name: str):
    """Decorator that adds an advantage estimator (DataFrame to DataFrame) by name."""

    def add(f):
        if name in ESTIMATORS:
            raise ValueError(f"an estimator named {name} exists")
        ESTIMATORS[name] = f
        return f

    return add


def advantages(rows: DataFrame, estimator: str, **options) -> DataFrame:
    return ESTIMATORS[estimator](rows, **options)


# -- masks ---------------------------------------------------------------------------------------------


def response_mask(tokens: Column, eos: int) -> Column:
    """1 up to and including the first end token, 0 after it."""
    at = F.array_position(tokens, F.lit(eos))
    return F.transform(tokens, lambda t, i: F.when((at == 0) | (i < at), 1).otherwise(0))


def position_ids(mask: Column) -> Column:
    """max(running sum of the mask - 1, 0)."""
    zero = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))
    step = lambda s, m: F.struct((s["n"] + m).alias("n"), F.array_append(s["out"], F.greatest(s["n"] + m - 1, F.lit(0))).alias("out"))
    return F.aggregate(mask, zero, step, lambda s: s["out"])


def reward_on_last(mask: Column, reward: Column) -> Column:
    """The reward at the last place where the mask is 1, zeros elsewhere."""
    last = F.size(mask) - F.array_position(F.reverse(mask), 1)
    return F.transform(mask, lambda m, i: F.when((F.array_position(mask, 1) > 0) & (i == last), reward).otherwise(_d(0)))


def pad(tokens: Column, length: int, fill, side: str = "right", truncate: str = "error") -> Column:
    """An array of exactly `length`; longer ones are cut left or right, or are an error."""
    if truncate == "error":
        tokens = F.when(F.size(tokens) <= length, tokens).otherwise(F.raise_error(F.lit("a sequence is too long")).cast("array<bigint>"))
    elif truncate == "left":
        tokens = F.slice(tokens, F.greatest(F.size(tokens) - length, F.lit(0)) + 1, length)
    else:
        tokens = F.slice(tokens, 1, length)
    more = F.array_repeat(F.lit(fill), F.greatest(length - F.size(tokens), F.lit(0)))
    return F.concat(tokens, more) if side == "right" else F.concat(more, tokens)


def collate(rows: DataFrame, batch: str, tokens: str, fill: int, side: str = "right") -> DataFrame:
    """Every batch's rows padded to its longest, with the attention mask."""
    longest = F.max(F.size(tokens)).over(W.partitionBy(batch))
    more = F.array_repeat(F.lit(fill), longest - F.size(tokens))
    zeros, ones = F.array_repeat(F.lit(0), longest - F.size(tokens)), F.array_repeat(F.lit(1), F.size(tokens))
    order = (lambda a, b: F.concat(a, b)) if side == "right" else (lambda a, b: F.concat(b, a))
    return rows.withColumn("input_ids", order(F.col(tokens), more)).withColumn("attention_mask", order(ones, zeros))


# -- masked statistics ---------------------------------------------------------------------------------


#: Rows, then blocks, that one sum of doubles runs over where a sum over the whole table would lose digits.
BLOCK = 256


def masked_moments(rows: DataFrame, x: str, mask: str, group: list[str] | None = None) -> DataFrame:
    """n, mean and variance of all tokens under the mask; Bessel's correction unless only one is there.

    Without groups the sums run over blocks of rows, blocks of these and then all, as the rounding of one long sum
    grows with the table.
    """
    v, m = F.col(x), F.col(mask)
    sums = {"n": F.sum(array_sum(m)), "s": F.sum(masked_sum(v, m)), "q": F.sum(masked_sum(F.transform(v, lambda t: t * t), m))}
    if group:
        sums = rows.groupBy(*group).agg(*[c.alias(k) for k, c in sums.items()])
    else:
        again = [F.sum(k).alias(k) for k in sums]
        blocks = rows.select(x, mask, F.floor(F.monotonically_increasing_id() / BLOCK).alias("block"))
        blocks = blocks.groupBy("block").agg(*[c.alias(k) for k, c in sums.items()])
        sums = blocks.groupBy(F.floor(F.col("block") / BLOCK).alias("block")).agg(*again).agg(*again)
    mean = F.col("s") / F.col("n")
    var = F.greatest(F.col("q") / F.col("n") - mean * mean, _d(0))
    return sums.select(*(group or []), "n", mean.alias("mean"), F.when(F.col("n") > 1, var * F.col("n") / (F.col("n") - 1)).otherwise(var).alias("var"))


def whiten(rows: DataFrame, x: str, mask: str, eps: float = 1e-8) -> DataFrame:
    """x standardised by the moments of all tokens under the mask (one row is joined to all)."""
    m = masked_moments(rows, x, mask).select(F.col("mean").alias("__m"), F.col("var").alias("__v"))
    out = rows.join(F.broadcast(m))
    return out.withColumn(x, F.transform(x, lambda t: (t - F.col("__m")) / F.sqrt(F.col("__v") + eps))).drop("__m", "__v")


def average_loss(rows: DataFrame, loss: str, mask: str, mode: str) -> DataFrame:
    """'token': all masked losses over all masked tokens; 'seq': the mean of the rows' own means."""
    total, n = masked_sum(F.col(loss), F.col(mask)), array_sum(F.col(mask))
    if mode == "token":
        return rows.agg((F.sum(total) / (F.sum(n) + 1e-8)).alias("loss"))
    return rows.agg(F.avg(total / (n + 1e-8)).alias("loss"))


def length_metrics(rows: DataFrame, mask: str, limit: int, name: str) -> DataFrame:
    n = array_sum(F.col(mask))
    return rows.agg(F.avg(n).alias(f"{name}_mean"), F.max(n).alias(f"{name}_max"), F.min(n).alias(f"{name}_min"), F.avg((n >= limit).cast("double")).alias(f"{name}_clip_ratio"))


def token_metrics(rows: DataFrame, mask: str, columns: list[str]) -> DataFrame:
    """Mean, maximum and minimum over masked tokens of each column."""
    at = lambda c: F.filter(F.zip_with(c, mask, lambda v, m: F.when(m > 0, v)), lambda v: v.isNotNull())
    out = []
    for c in columns:
        kept = at(F.col(c))
        out += [(F.sum(array_sum(kept)) / F.sum(F.size(kept))).alias(f"{c}_mean"), F.max(F.array_max(kept)).alias(f"{c}_max"), F.min(F.array_min(kept)).alias(f"{c}_min")]
    return rows.agg(*out)


def explained_variance(rows: DataFrame, returns: str, values: str, mask: str) -> DataFrame:
    """1 - var(returns - values) / (var(returns) + 1e-5) over masked tokens."""
    both = rows.withColumn("__d", F.zip_with(returns, values, lambda a, b: a - b))
    one, two = (masked_moments(both, c, mask).select(F.col("var").alias(n)) for c, n in (("__d", "vd"), (returns, "vr")))
    return one.join(F.broadcast(two)).select((1 - F.col("vd") / (F.col("vr") + 1e-5)).alias("explained_variance"))


def throughput(rows: DataFrame, tokens: Column, seconds: float, gpus: int) -> DataFrame:
    n = F.sum(tokens)
    return rows.agg(n.alias("tokens"), (_d(seconds) * 1000 / n).alias("ms_per_token"), (n / (_d(seconds) * gpus)).alias("tokens_per_second_per_gpu"))


def flops(rows: DataFrame, length: Column, dense: float, quadratic: float) -> DataFrame:
    """6 times the dense parameters for each token, plus attention's share, quadratic in each length."""
    return rows.agg((6 * dense * F.sum(length) + quadratic * F.sum(length * length)).alias("flops"))


def pass_at_n(rows: DataFrame, prompt: str, correct: str) -> DataFrame:
    """Each row with whether any sample of its prompt is correct, and the group's flags by call."""
    w = W.partitionBy(prompt)
    ok = F.col(correct)
    return rows.withColumns({
        "pass_at_n": F.bool_or(ok).over(w),
        "solved_without_call": F.bool_or(ok & ~F.col("has_call")).over(w),
        "solved_with_call": F.bool_or(ok & F.col("has_call")).over(w),
    })


def group_filter(rows: DataFrame, group: str, score: str, low: float, high: float) -> DataFrame:
    """Rows of groups whose mean score lies strictly between low and high."""
    kept = rows.groupBy(group).agg(F.avg(score).alias("__m")).where((F.col("__m") > low) & (F.col("__m") < high))
    return rows.join(kept.select(group), group, "left_semi")


def running_best(steps: DataFrame, step: str = "step", score: str = "score") -> DataFrame:
    """The best score and the earliest step that reached it."""
    return steps.agg(F.max(score).alias("best_score"), F.max_by(step, F.struct(score, -F.col(step))).alias("best_step"))


def retained(steps: DataFrame, keep: int, step: str = "step", best: Column | None = None) -> DataFrame:
    """Checkpoints that stay: the latest keep - 1, and the best one whatever its age."""
    w = W.orderBy(F.desc(step))
    ranked = steps.withColumn("__k", F.row_number().over(w))
    return ranked.where((F.col("__k") <= keep - 1) | (best if best is not None else F.lit(False))).drop("__k")


# -- losses --------------------------------------------------------------------------------------------


def kl(log_probs: Column, reference: Column, kind: str) -> Column:
    """Per-token divergence estimates: kl, abs, mse or low_var_kl (clamped to [-10, 10])."""

    def one(p, r):
        d = p - r
        if kind == "kl":
            return d
        if kind == "abs":
            return F.abs(d)
        if kind == "mse":
            return 0.5 * d * d
        if kind == "low_var_kl":
            x = F.greatest(_d(-20), F.least(_d(20), -d))
            return F.greatest(_d(-10), F.least(_d(10), F.exp(x) - x - 1))
        raise ValueError(f"unknown divergence {kind}")

    return F.zip_with(log_probs, reference, one)


def shaped_rewards(scores: Column, divergence: Column, mask: Column, coefficient: float) -> Column:
    return F.zip_with(scores, F.zip_with(divergence, mask, lambda d, m: d * m), lambda s, d: s - coefficient * d)


def policy_loss(old: Column, new: Column, advantage: Column, low: float, high: float, dual: float) -> Column:
    """Clipped policy objective a token; negative advantages are bounded by the dual clip."""
    ratio = F.zip_with(new, old, lambda n, o: F.exp(F.greatest(_d(-20), F.least(_d(20), n - o))))

    def one(r, a):
        clipped = F.greatest(_d(1 - low), F.least(_d(1 + high), r))
        worse = F.greatest(-a * r, -a * clipped)
        return F.when(a < 0, F.least(worse, -a * dual)).otherwise(worse)

    return F.zip_with(ratio, advantage, one)


def value_loss(values: Column, old: Column, returns: Column, clip: float) -> Column:
    """Half the larger of the plain and the clipped squared error, a token."""
    clipped = F.zip_with(values, old, lambda v, o: F.greatest(o - clip, F.least(o + clip, v)))
    error = lambda a: F.zip_with(a, returns, lambda v, r: (v - r) * (v - r))
    return F.zip_with(error(values), error(clipped), lambda a, b: 0.5 * F.greatest(a, b))


def adaptive_kl(observed: Column, start: float, target: float, horizon: float, steps: Column) -> Column:
    """The coefficient after a sequence of observed divergences: each moves it by a clipped relative error."""
    pairs = F.arrays_zip(observed.alias("d"), steps.alias("n"))
    return F.aggregate(pairs, _d(start), lambda c, x: c * (1 + F.greatest(_d(-0.2), F.least(_d(0.2), x["d"] / target - 1)) * x["n"] / horizon))


def within_tokens(rows: DataFrame, text: str, most: int, tokens=None) -> DataFrame:
    """Rows of at most `most` tokens. tokens: a tokenizer as Column to Column; by default words are counted."""
    count = tokens or (lambda x: F.regexp_count(x, F.lit(r"[^\s]+")))
    return rows.where(count(F.col(text)) <= most)


def rank_stats(rows: DataFrame, group: str, rank: str, hits: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Per group: hit counts, least, most, and the upper median (the element at n // 2 of the sorted ranks).

    The median is found from counts of distinct ranks, so that no group is gathered.
    """
    n = rows.groupBy(group, rank).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy(group).orderBy(rank))
    total = F.sum("n").over(W.partitionBy(group))
    n = n.withColumn("upto", upto).withColumn("total", total)
    median = F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col(rank)))
    counts = [F.sum(F.when(F.col(rank) <= h, F.col("n")).otherwise(0)).alias(f"hits_{h}") for h in hits]
    return n.groupBy(group).agg(*counts, F.min(rank).alias("least"), median.alias("median"), F.max(rank).alias("most"))


def first_per_action(rows: DataFrame, action: str, order: str, k: int, needed: list[str]) -> DataFrame:
    """The first k rows of each action; an action without rows is an error."""
    have = {r[0] for r in rows.select(action).where(F.col(action).isin(needed)).distinct().collect()}  # at most the needed names
    lack = sorted(set(needed) - have)
    if lack:
        raise ValueError(f"no rows for {lack}")
    w = W.partitionBy(action).orderBy(order)
    return rows.where(F.col(action).isin(needed)).withColumn("k", F.row_number().over(w)).where(F.col("k") <= k)


def refill(batches, group: str, score: str, low: float, high: float, size: int, most_tries: int, order: str) -> DataFrame:
    """Rows of well-mixed groups from successive batches until `size` are there, cut to it by order.

    batches: an iterator of DataFrames; running out of tries before the batch is full is an error.
    """
    kept, rows = None, 0
    for n, batch in enumerate(batches):
        if n >= most_tries:
            break
        good = stage(group_filter(batch, group, score, low, high), "refill").df
        rows += good.count()
        kept = good if kept is None else kept.unionByName(good)
        if rows >= size:
            return kept.orderBy(order).limit(size)
    raise RuntimeError(f"not enough groups between {low} and {high} in {most_tries} tries")
