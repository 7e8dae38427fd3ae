"""Reward functions as columns: answer accuracy, format, relay calls, interaction costs and trust."""

from __future__ import annotations

import importlib.util
import json
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import text as X
from ..scratch import stage

#: Summaries of groups that a task holds before it passes them on.
SUMMARIES = 10_000
#: Rows that a reward by summaries sees at once.
PIECE = 64


def same_answer(a: Column, b: Column) -> Column:
    """Equality of normalised answers; symbolic equality would take a grader from outside."""
    return F.coalesce(X.normalize_answer(a) == X.normalize_answer(b), F.lit(False))


def accuracy(response: Column, truth: Column, boxed=X.last_boxed_flat) -> Column:
    return same_answer(boxed(response), truth).cast("double")


def final_answer_accuracy(response: Column, truth: Column) -> Column:
    """1 or -1 by the last 'Answer:' line among the last 300 characters."""
    tail = F.substring(response, -300, 300)
    said = F.coalesce(X.trim_u(X.last_match(tail, r"(?i)Answer\s*:\s*([^\n]+)")), F.lit("[INVALID]"))
    return F.when(X.normalize_final_answer(said) == X.normalize_final_answer(truth), F.lit(1.0)).otherwise(F.lit(-1.0))


def overlong(length: Column, longest: int, buffer: int) -> Column:
    """0 up to longest - buffer, then falling to -1 at longest, -1 beyond."""
    free = longest - buffer
    return F.when(length <= free, F.lit(0.0)).when(length <= longest, (free - length) / F.lit(float(buffer))).otherwise(F.lit(-1.0))


def overlong_score(response: Column, truth: Column, length: Column, longest: int, buffer: int, factor: float) -> Column:
    acc, late = final_answer_accuracy(response, truth), overlong(length, longest, buffer)
    return F.struct((acc + late * factor).alias("overall"), acc.alias("accuracy"), late.alias("overlong"), (0.5 * (acc + 1.0)).alias("accuracy_normalized"))


def boxed_format(response: Column) -> Column:
    return response.rlike(r"(?s)\A<think>.*</think>.*\\boxed\{.*\}.*\z").cast("double")


def tagged_format(response: Column) -> Column:
    return response.rlike(r"(?s)\A<think>.*?</think>\s*<answer>.*?</answer>\z").cast("double")


def weighted(acc: Column, fmt: Column, weight: float) -> Column:
    return (1 - weight) * acc + weight * fmt


def call_tokens(response: Column) -> Column:
    """Sum of the called budgets, each at most 4096."""
    found = F.regexp_extract_all(response, F.lit(r"<call>\s*(\d+)\s*</call>"), F.lit(1))
    capped = F.transform(found, lambda x: F.least(F.coalesce(x.try_cast("bigint"), F.lit(4096)), F.lit(4096)))
    return F.aggregate(capped, F.lit(0).cast("long"), lambda a, v: a + v)


def call_ratio(response: Column, length: Column) -> Column:
    return F.least(call_tokens(response) / length, F.lit(1.0))


def relay_group_score(rows: DataFrame, prompt: str, correct: str, called: str, ratio: str) -> DataFrame:
    """Overall reward by what the prompt's other samples achieved without and with a call."""
    w = W.partitionBy(prompt)
    ok, call, r = F.col(correct), F.col(called), F.col(ratio)
    alone, helped = F.bool_or(ok & ~call).over(w), F.bool_or(ok & call).over(w)
    score = (
        F.when(alone, F.when(ok & ~call, 1.5).when(ok, 1.0 - r).otherwise(0.0))
        .when(helped, F.when(ok & call, 1.0 - r).when(~ok & ~call, -1.0).otherwise(0.0))
        .otherwise(F.when(call, r).otherwise(0.0))
    )
    return rows.withColumn("overall", score.cast("double")).withColumn("pass_at_n", F.bool_or(ok).over(w).cast("double"))


#: Weights of the interaction reward by outcome or counter.
COSTS = {
    "teacher_cost": 0.15, "useful_accept": 0.0, "resist_bad_review": 0.0, "wrong_accept": 0.50, "wrong_reject": 0.50,
    "implicit_adoption": 0.05, "wrong_implicit_adoption": 0.50, "unsupported_accept": 0.10, "invalid_accept": 0.10,
    "invalid_protocol": 0.20, "denied_action": 0.05, "teacher_error": 0.0, "independent_correct": 0.0,
}
OUTCOMES = ("useful_accept", "wrong_accept", "unsupported_accept", "wrong_implicit_adoption", "implicit_adoption", "wrong_reject", "resist_bad_review")


def event_outcomes(events: Column, truth: Column, response: Column, acc: Column, boxed=X.last_boxed_flat) -> Column:
    """One of seven outcomes (or null) of each event, by ordered rules."""
    final = boxed(response)

    def one(e: Column) -> Column:
        visible = F.coalesce(e["teacher_context_text"], F.lit(""))
        proposed, tentative = boxed(visible), boxed(F.coalesce(e["student_before_feedback"], F.lit("")))
        t = F.when(tentative.isNotNull(), same_answer(tentative, truth))
        p = F.when(proposed.isNotNull(), same_answer(proposed, truth))
        low, t0 = F.lower(visible), F.coalesce(t, F.lit(False))
        said = F.when(F.contains(low, F.lit("verdict: correct")), t0).when(F.contains(low, F.lit("verdict: incorrect")), ~t0)
        right = F.when((e["action"] == "verify") & (F.coalesce(e["error"], F.lit("")) == ""), F.coalesce(p, said))
        accepted = F.coalesce(e["accepted"], F.lit(False))
        adopted = ~accepted & proposed.isNotNull() & final.isNotNull() & ~(tentative.isNotNull() & same_answer(tentative, proposed)) & same_answer(final, proposed)
        p1, p0, fresh = p.eqNullSafe(F.lit(True)), p.eqNullSafe(F.lit(False)), ~t.eqNullSafe(F.lit(True))
        r0 = right.eqNullSafe(F.lit(False))
        tests = (accepted & p1 & fresh & (acc > 0.5), accepted & (r0 | p0), accepted & ~p1, adopted & p0, adopted & p1 & fresh & (acc > 0.5), ~accepted & ~adopted & p1 & fresh & (acc < 0.5), ~accepted & r0 & (acc > 0.5))
        return reduce(lambda rest, x: F.when(x[0], x[1]).otherwise(rest), reversed(list(zip(tests, OUTCOMES))), F.lit(None).cast("string"))

    return F.transform(events, one)


def interaction_score(rows: DataFrame, budget: float = 192.0, **weights: float) -> DataFrame:
    """rows (response, ground_truth, events, counters) plus outcome counts, accuracy and the overall reward."""
    if budget <= 0:
        raise ValueError("the token budget must be positive")
    c = COSTS | weights
    n = lambda x: F.coalesce(F.col(x), F.lit(0))
    out = rows.withColumn("accuracy", accuracy(F.coalesce("response", F.lit("")), F.col("ground_truth")))
    out = out.withColumn("__o", event_outcomes(F.col("events"), F.col("ground_truth"), F.col("response"), F.col("accuracy")))
    for o in OUTCOMES:
        out = out.withColumn(f"{o}_count", F.coalesce(F.size(F.filter("__o", lambda x: x == o)), F.lit(0)).cast("double"))
    errors = F.coalesce(F.size(F.filter("events", lambda e: F.coalesce(e["error"], F.lit("")) != "")), F.lit(0)).cast("double")
    out = out.withColumn("teacher_error_count", errors).withColumn("teacher_token_ratio", n("teacher_tokens_used") / F.lit(budget))
    alone = ((F.col("accuracy") > 0.5) & (n("ask_count") + n("verify_count") == 0)).cast("double")
    out = out.withColumn("correct_without_interaction_count", alone)
    plus = {"useful_accept": "useful_accept_count", "resist_bad_review": "resist_bad_review_count", "independent_correct": "correct_without_interaction_count"}
    minus = {"teacher_cost": "teacher_token_ratio", "teacher_error": "teacher_error_count"} | {o: f"{o}_count" for o in ("wrong_accept", "wrong_reject", "implicit_adoption", "wrong_implicit_adoption", "unsupported_accept", "invalid_accept", "invalid_protocol", "denied_action")}
    total = F.col("accuracy")
    for k, col in plus.items():
        total = total + c[k] * n(col)
    for k, col in minus.items():
        total = total - c[k] * n(col)
    return out.withColumn("overall", total).drop("__o")


# -- plug-in rewards -----------------------------------------------------------------------------------


def load_reward(spec: str, **options):
    """The function that 'path:name' names, with its keyword options bound; what it knows of its groups (see apply_rewards) stays with it."""
    path, _, name = spec.rpartition(":")
    module_spec = importlib.util.spec_from_file_location("reward_plugin", path)
    module = importlib.util.module_from_spec(module_spec)
    module_spec.loader.exec_module(module)
    function = getattr(module, name)

    def bound(rows, **more):
        return function(rows, **options, **more)

    for part in ("summary", "merge"):
        if hasattr(function, part):
            setattr(bound, part, getattr(function, part))
    return bound


def _scored(pdf: pd.DataFrame, function, **more) -> pd.DataFrame:
    records = pdf.to_dict("records")
    return pd.DataFrame([{**r, **s} for r, s in zip(records, function(records, **more))])


def apply_rewards(rows: DataFrame, function, schema: str, group: str | None = None) -> DataFrame:
    """function: list of dicts to list of dicts. With `group` it sees all rows of a prompt at once, else batches.

    A function that needs but a summary of a group says so by two attributes: `summary`, of some rows of it to a JSON
    value, and `merge`, of a list of those to one. It then gets any rows of one group and `summary=` of them all, and
    no group is ever gathered.
    """
    if not group:
        return rows.mapInPandas(lambda it: (_scored(b, function) for b in it), schema)
    if not hasattr(function, "summary"):
        return rows.groupBy(group).applyInPandas(lambda b: _scored(b, function), schema)
    summary, merge = function.summary, function.merge
    kind, form = rows.schema[group].dataType.simpleString(), to_arrow_schema(StructType.fromDDL(schema))

    def pieces(batches, by: str):
        """Some rows at a time, dealt by a column."""
        for b in batches:
            for at in range(0, b.num_rows, PIECE):
                own: dict = {}
                for r in b.slice(at, PIECE).to_pylist():
                    own.setdefault(r[by], []).append(r)
                yield own

    def summed(batches):
        known: dict = {}
        for own in pieces(batches, group):
            for name, some in own.items():
                said = summary(some)
                known[name] = merge([known[name], said]) if name in known else said
            if len(known) >= SUMMARIES:
                yield told(known)
                known = {}
        yield told(known)

    def told(known: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"__group": list(known), "__summary": [json.dumps(x) for x in known.values()]}, summaries)

    def merged(parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"__group": parts["__group"][:1], "__summary": [json.dumps(merge([json.loads(x) for x in parts["__summary"]]))]})

    def scored(batches):
        for own in pieces(batches, "__summary"):
            out = [{**r, **s} for said, some in own.items() for r, s in zip(some, function(some, summary=json.loads(said)))]
            yield pa.RecordBatch.from_pylist(out, form)

    known = f"__group {kind}, __summary string"
    summaries = to_arrow_schema(StructType.fromDDL(known))
    parts = rows.mapInArrow(summed, known).groupBy("__group").applyInPandas(merged, known)
    parts = stage(parts, "summaries").df
    both = rows.join(parts, rows[group].eqNullSafe(parts["__group"])).drop("__group")
    return both.mapInArrow(scored, schema)
