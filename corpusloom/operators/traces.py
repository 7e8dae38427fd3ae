"""Interaction traces: validation for replay, utility, best of each problem, summaries, paired runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from ..functions.fixed import CONTEXT_MARKERS, INTERACTION_POLICY, OTHER_POLICY_REASON
from ..scratch import stage
from .batches import numbered
from .protocol import segment_errors

COUNTERS = ("ask_count", "verify_count", "accept_count", "invalid_accept_count", "invalid_protocol_count", "denied_action_count")


def _n(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _interactive(traces: DataFrame) -> DataFrame:
    return traces.where(F.col("interaction_policy") == INTERACTION_POLICY)


def utility(budget: float = 192.0, cost: float = 0.15, invalid: float = 0.1, denied: float = 0.05) -> Column:
    """Score less the costs of teacher tokens, invalid accepts and denied actions."""
    if budget <= 0:
        raise ValueError("the token budget must be positive")
    spent = _n("teacher_tokens_used").cast("double") / budget
    return F.coalesce("score", F.lit(0.0)) - cost * spent - invalid * _n("invalid_accept_count") - denied * _n("denied_action_count")


def trajectory_type() -> Column:
    ask, verify = _n("ask_count") > 0, _n("verify_count") > 0
    return (
        F.when(~ask & ~verify, "independent_success")
        .when(ask & verify, "mixed_interaction_success")
        .when(ask, "ask_success")
        .when(_n("accept_count") > 0, "verify_accept_success")
        .otherwise("verify_without_accept_success")
    )


def _some(events: Column, test) -> Column:
    return F.coalesce(F.exists(events, lambda e: F.coalesce(test(e), F.lit(False))), F.lit(False))


def replay_reject_reason(min_score: float = 1.0, max_tokens: int | None = None, event_errors: bool = False, invalid_actions: bool = False, train_only: bool = True) -> Column:
    """Why a trace cannot be replayed, by ordered rules of which the first that holds gives the reason; else null."""
    events = F.col("events")
    accepted = F.filter(events, lambda e: (e["action"] == "verify") & F.coalesce(e["accepted"], F.lit(False)))
    right = lambda e, f: F.coalesce(e[f], F.lit(False))
    wrong = lambda e, f: F.coalesce(~e[f], F.lit(False))
    # the first accepted event that breaks a rule decides, by the order of rules within it
    verdict = lambda e: (
        F.when(wrong(e, "feedback_answer_correct"), "wrong_accept")
        .when(~e["tentative_answer_scope"].eqNullSafe(F.lit("cumulative_student_visible")) | ~e["feedback_answer_scope"].eqNullSafe(F.lit("visible_teacher_context")), "unvalidated_accept")
        .when(~right(e, "feedback_answer_correct"), "unvalidated_accept")
        .when(right(e, "tentative_answer_correct"), "redundant_accept")
    )
    accept_fault = F.get(F.filter(F.transform(accepted, verdict), lambda v: v.isNotNull()), F.lit(0))
    seg = F.col("segments")
    lossy = lambda s: F.coalesce(s["loss"], F.lit(False))
    fault = lambda s: F.when(lossy(s) & (s["source"] != "student"), "non_student_loss").when((s["source"] == "student") & X.contains_any(s["text"], CONTEXT_MARKERS), "forged_environment_marker")
    segment_fault = F.get(F.filter(F.transform(seg, fault), lambda v: v.isNotNull()), F.lit(0))
    spoken = F.array_join(F.transform(F.filter(seg, lambda s: lossy(s) & (s["source"] == "student")), lambda s: s["text"]), "")
    counts_differ = reduce(lambda a, b: a | b, [X.occurrences(spoken, t) != _n(c) for t, c in (("<ASK>", "ask_count"), ("<VERIFY>", "verify_count"), ("<ACCEPT>", "accept_count"))])
    rules = [
        (~F.col("interaction_policy").eqNullSafe(F.lit(INTERACTION_POLICY)), F.lit(OTHER_POLICY_REASON)),
        (F.lit(train_only) & ~F.col("data_role").eqNullSafe(F.lit("train")), F.lit("non_train_provenance")),
        (F.coalesce("collection_error", F.lit("")) != "", F.lit("collection_error")),
        (_n("invalid_protocol_count") > 0, F.lit("forged_environment_marker")),
        (F.coalesce("score", F.lit(0.0)) < min_score, F.lit("below_min_score")),
        (F.lit(max_tokens is not None) & (_n("teacher_tokens_used") > (max_tokens or 0)), F.lit("above_teacher_token_limit")),
        (F.lit(not invalid_actions) & ((_n("invalid_accept_count") > 0) | (_n("denied_action_count") > 0)), F.lit("invalid_action")),
        (F.lit(not event_errors) & _some(events, lambda e: e["error"] != ""), F.lit("event_error")),
        (_some(events, lambda e: e["implicit_adoption_without_accept"]), F.lit("implicit_adoption_without_accept")),
        (F.coalesce(F.size(accepted), F.lit(0)) != _n("accept_count"), F.lit("accept_event_mismatch")),
        (accept_fault.isNotNull(), accept_fault),
        (F.coalesce(F.size(seg), F.lit(0)) == 0, F.lit("missing_segments")),
        (~F.get(seg, F.lit(0))["source"].isin("system", "user"), F.lit("missing_initial_context")),
        (~_some(seg, lambda s: (s["source"] == "student") & lossy(s)), F.lit("missing_student_target")),
        (segment_fault.isNotNull(), segment_fault),
        (F.size(segment_errors(seg)) > 0, F.lit("invalid_protocol_segments")),
        (counts_differ, F.lit("action_event_mismatch")),
    ]
    return reduce(lambda chain, r: F.when(F.coalesce(r[0], F.lit(True)), r[1]).otherwise(chain), reversed(rules), F.lit(None).cast("string"))


def replay_candidates(traces: DataFrame, columns: list, **rules) -> DataFrame:
    """The given columns of traces that no rule rejects.

    The verdict is staged before it filters: a filter on it would be pushed below the traces' own expressions, and so
    work out events and segments anew for each rule.
    """
    judged = stage(traces.select(*columns, replay_reject_reason(**rules).alias("__reason")), "judged").df
    return judged.where(F.col("__reason").isNull()).drop("__reason")


def best_per_problem(candidates: DataFrame, k: int, key: str = "question") -> DataFrame:
    """Highest utility, then fewest tokens and interactions, then input order; ids count problems in key order.

    Problems are numbered by ranges: range partitions are counted and only those counts accumulate in one place. The
    best rows are staged, for their keys are sampled, numbered and joined: candidates are worked out once.
    """
    calls = _n("ask_count") + _n("verify_count")
    order = W.partitionBy(key).orderBy(F.desc("utility"), _n("teacher_tokens_used"), calls, "ord")
    top = stage(candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best").df
    keys = dense_index(top.select(key).distinct(), key, "problem")
    out = top.join(keys, key)
    return out.withColumn("id", F.format_string("outcome_%07d_%d", "problem", F.col("rank") - 1))


def dense_index(keys: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct keys with their place (from 0) in global order, without sorting them in one task."""
    return numbered(keys, [key], name)


def run_summary(traces: DataFrame) -> DataFrame:
    """One row: examples, mean score, tokens, action totals and rates, event errors and truncations."""
    own = _interactive(traces)
    events = lambda test: F.sum(F.coalesce(F.size(F.filter("events", lambda e: F.coalesce(test(e), F.lit(False)))), F.lit(0)))
    return own.agg(
        F.count("*").alias("examples"),
        F.avg(F.coalesce("score", F.lit(0.0))).alias("mean_score"),
        F.sum(_n("teacher_tokens_used")).alias("teacher_tokens_total"),
        F.avg(_n("teacher_tokens_used")).alias("teacher_tokens_mean"),
        *[F.sum(_n(c)).alias(f"{c}_total") for c in COUNTERS],
        *[(F.sum(_n(c)) / F.count("*")).alias(f"{c}_rate") for c in COUNTERS],
        events(lambda e: e["error"] != "").alias("event_error_count"),
        events(lambda e: e["feedback_truncated"]).alias("feedback_truncated_count"),
    )


GROUPS = {
    "no_interaction": "ask_count + verify_count = 0",
    "any_interaction": "ask_count + verify_count > 0",
    "asked": "ask_count > 0",
    "verified": "verify_count > 0",
    "accepted": "accept_count > 0",
    "verified_without_accept": "verify_count > 0 AND accept_count = 0",
}


def subset_metrics(traces: DataFrame) -> DataFrame:
    """Six overlapping groups in one pass: count, fraction, mean score, mean tokens."""
    own = _interactive(traces)
    parts = []
    for name, test in GROUPS.items():
        p = F.expr(test)
        parts.append(F.struct(
            F.lit(name).alias("grp"), F.count_if(p).alias("n"), (F.count_if(p) / F.count("*")).alias("fraction"),
            F.avg(F.when(p, F.coalesce("score", F.lit(0.0)))).alias("mean_score"), F.avg(F.when(p, _n("teacher_tokens_used"))).alias("mean_tokens"),
        ))
    return own.agg(F.array(*parts).alias("g")).select(F.inline("g"))


def paired_comparison(traces: DataFrame, budget: float = 192.0, cost: float = 0.15, key: str = "question", base: str = "independent") -> DataFrame:
    """Each mode against the independent run on equal (question, sample_index), by means of each key first."""
    u = F.coalesce("score", F.lit(0.0)) - cost * _n("teacher_tokens_used") / budget
    by = _interactive(traces).groupBy(key, "sample_index", "collection_mode").agg(
        F.avg(F.coalesce("score", F.lit(0.0))).alias("s"), F.avg(u).alias("u"), F.bool_or(_n("ask_count") + _n("verify_count") > 0).alias("acts")
    )
    left = by.where(F.col("collection_mode") == base).select(key, "sample_index", F.col("s").alias("s0"), F.col("u").alias("u0"))
    both = by.where(F.col("collection_mode") != base).join(left, [key, "sample_index"])
    return both.groupBy("collection_mode").agg(
        F.count("*").alias("paired_examples"),
        F.avg(F.col("s") - F.col("s0")).alias("mean_score_delta"),
        F.avg(F.col("u") - F.col("u0")).alias("mean_utility_delta"),
        F.count_if((F.col("s0") <= 0) & (F.col("s") > 0)).alias("rescued_failures"),
        F.count_if((F.col("s0") > 0) & F.col("acts")).alias("interactions_on_independent_successes"),
    )


def verify_trust(traces: DataFrame) -> DataFrame:
    """Counts over verify events: reviews, explicit accepts, implicit adoptions."""
    e = _interactive(traces).select(F.explode("events").alias("e")).where("e.action = 'verify'")
    yes = lambda f: F.count_if(F.coalesce(F.col(f"e.{f}"), F.lit(False)))
    return e.agg(F.count("*").alias("review_events"), yes("accepted").alias("explicit_accepts"), yes("implicit_adoption_without_accept").alias("implicit_adoptions"))


def replay_mix(protocol: DataFrame, replay: DataFrame, fraction: float, seed, id_col: str = "id") -> DataFrame:
    """All protocol rows and at most int(P f / (1 - f)) replay rows in hash order."""
    from .curation import hash_rank

    if not 0 <= fraction < 1:
        raise ValueError("the replay fraction must lie in [0, 1)")
    most = int(protocol.count() * fraction / (1 - fraction))
    chosen = replay.withColumn("__h", hash_rank(seed, F.col(id_col))).orderBy("__h", id_col).limit(most).drop("__h")
    return protocol.withColumn("origin", F.lit("protocol")).unionByName(chosen.withColumn("origin", F.lit("replay")), allowMissingColumns=True)


def annotate_review(events: Column, gold: Column, final: Column, boxed=X.last_boxed_flat) -> Column:
    """events with tentative, feedback and final correctness, and adoption without an accept.

    A feedback without a boxed answer is right if its verdict agrees with the tentative answer; without a
    verdict or a tentative answer that stays null. Events that are no reviews, or failed, stay as they are.
    """
    same = lambda a, b: F.when(a.isNotNull(), X.normalize_answer(a) == X.normalize_answer(b))
    yes = lambda x: F.coalesce(x, F.lit(False))

    def one(e: Column) -> Column:
        tentative, proposed = boxed(e["student_before_feedback"]), boxed(e["teacher_context_text"])
        t, p = same(tentative, gold), same(proposed, gold)
        said = F.lower(e["teacher_context_text"])
        verdict = F.when(F.contains(said, F.lit("verdict: correct")), t).when(F.contains(said, F.lit("verdict: incorrect")), ~t)
        review = (e["action"] == "verify") & (F.coalesce(e["error"], F.lit("")) == "")
        adopted = ~yes(e["accepted"]) & yes(same(boxed(final), proposed)) & ~yes(same(tentative, proposed))
        for name, value in (("tentative_answer_correct", t), ("feedback_answer_correct", p), ("feedback_is_correct", F.coalesce(p, verdict)), ("implicit_adoption_without_accept", adopted)):
            e = e.withField(name, F.when(review, value).otherwise(e[name]))
        return e

    return F.transform(events, one)
