"""Queries over interaction traces, which events stand in for, and protocol examples from documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.fixed import INTERACTION_POLICY, OTHER_POLICY_REASON, RELAY_POLICY
from ..operators import protocol as P
from ..operators import traces as T
from ..operators.dialogues import wrap
from .base import Registry, WS, rounded, table

query = Registry()
QUERIES, SQL = query.queries, query.sql

#: One trace an event. Both engines read these expressions; {..} differ between them.
FIELDS = """
  event_id AS ord, concat('q', user_id % 40) AS question, CAST(event_id % 3 AS INT) AS sample_index, {k} AS k,
  CASE WHEN event_type = 'error' AND {k} < 20 THEN '{relay}' ELSE '{own}' END AS interaction_policy,
  CASE event_type WHEN 'view' THEN 'independent' WHEN 'purchase' THEN 'force_ask_first' WHEN 'signup' THEN 'force_verify_after_draft' ELSE 'policy' END AS collection_mode,
  CASE WHEN {k} < 85 THEN 'train' ELSE 'eval' END AS data_role,
  CASE WHEN {k} = 13 THEN 'timeout' END AS collection_error,
  CASE WHEN {k} % 3 = 0 THEN 0.0 WHEN {k} = 50 THEN NULL ELSE 1.0 END AS score,
  CASE WHEN event_type = 'view' THEN 0 ELSE CAST(floor(value) AS BIGINT) END AS teacher_tokens_used,
  CASE WHEN event_type = 'purchase' OR (event_type = 'click' AND {k} % 2 = 0) THEN 1 ELSE 0 END AS ask_count,
  CASE WHEN event_type = 'signup' OR (event_type = 'click' AND {k} % 5 = 0) THEN 1 ELSE 0 END AS verify_count,
  CASE WHEN (event_type = 'signup' OR (event_type = 'click' AND {k} % 5 = 0)) AND {k} % 2 = 1 THEN 1 ELSE 0 END AS accept_count,
  CASE WHEN {k} = 7 THEN 1 ELSE 0 END AS invalid_accept_count,
  CASE WHEN {k} = 11 THEN 1 ELSE 0 END AS invalid_protocol_count,
  CASE WHEN {k} % 10 = 9 THEN 1 ELSE 0 END AS denied_action_count"""

FIELDS = FIELDS.replace("{relay}", RELAY_POLICY).replace("{own}", INTERACTION_POLICY)
BASE = "base AS (SELECT {} FROM events)".format(FIELDS.replace("{k}", "CAST(props::JSON->>'k' AS INT)"))

EVENT = """struct_pack(action := {a}, error := CASE WHEN k = 17 THEN 'http' END, accepted := {acc}, feedback_truncated := k % 8 = 3,
 implicit_adoption_without_accept := {imp}, feedback_answer_correct := CASE WHEN k % 4 = 0 THEN NULL ELSE k % 4 <> 3 END,
 tentative_answer_correct := k % 7 = 1, tentative_answer_scope := CASE WHEN k % 29 <> 2 THEN 'cumulative_student_visible' END,
 feedback_answer_scope := 'visible_teacher_context')"""
TRACES = (
    BASE
    + ", traces AS (SELECT *, list_filter([CASE WHEN ask_count = 1 THEN "
    + EVENT.format(a="'ask'", acc="NULL::BOOLEAN", imp="NULL::BOOLEAN")
    + " END, CASE WHEN verify_count = 1 THEN "
    + EVENT.format(a="'verify'", acc="accept_count = 1", imp="accept_count = 0 AND k % 12 = 4")
    + " END], lambda e: e IS NOT NULL) AS events FROM base)"
)


def traces(spark, sf):
    raw = table(spark, sf, "events").withColumn("k0", F.get_json_object("props", "$.k").cast("int"))
    base = raw.selectExpr(*[f.strip() for f in _split(FIELDS.replace("{k}", "k0"))])

    def event(action, accepted, implicit):
        return (
            f"named_struct('action', {action}, 'error', CASE WHEN k = 17 THEN 'http' END, 'accepted', {accepted}, 'feedback_truncated', k % 8 = 3,"
            f" 'implicit_adoption_without_accept', {implicit}, 'feedback_answer_correct', CASE WHEN k % 4 = 0 THEN NULL ELSE k % 4 <> 3 END,"
            " 'tentative_answer_correct', k % 7 = 1, 'tentative_answer_scope', CASE WHEN k % 29 <> 2 THEN 'cumulative_student_visible' END,"
            " 'feedback_answer_scope', 'visible_teacher_context')"
        )

    ask = event("'ask'", "CAST(NULL AS BOOLEAN)", "CAST(NULL AS BOOLEAN)")
    verify = event("'verify'", "accept_count = 1", "accept_count = 0 AND k % 12 = 4")
    events = f"filter(array(CASE WHEN ask_count = 1 THEN {ask} END, CASE WHEN verify_count = 1 THEN {verify} END), e -> e IS NOT NULL) AS events"

    def seg(source, text):
        return f"named_struct('source', '{source}', 'text', {text}, 'loss', {'true' if source == 'student' else 'false'})"

    segments = (
        f"concat(array({seg('user', 'question')}),"
        f" CASE WHEN ask_count = 1 THEN array({seg('student', repr('Help me <ASK>64</ASK>'))}, {seg('teacher', repr('<TEACHER_HELP>hint</TEACHER_HELP>'))}) ELSE filter(array({seg('user', 'question')}), s -> false) END,"
        f" CASE WHEN verify_count = 1 THEN array({seg('student', repr('Draft <VERIFY>64</VERIFY>'))}, {seg('teacher', repr('<TEACHER_REVIEW>ok</TEACHER_REVIEW>'))}) ELSE filter(array({seg('user', 'question')}), s -> false) END,"
        f" array({seg('student', 'concat(CASE WHEN accept_count = 1 THEN ' + repr('<ACCEPT>') + ' ELSE ' + repr('') + ' END, CASE WHEN k % 31 = 5 THEN ' + repr('<TEACHER_HELP>') + ' ELSE ' + repr('Answer') + ' END)')})) AS segments"
    )
    return base.selectExpr("*", events).selectExpr("*", segments)


def _split(fields: str) -> list[str]:
    """Top-level commas part the fields."""
    out, depth, cur = [], 0, ""
    for c in fields:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(cur)
            cur = ""
        else:
            cur += c
    return [*out, cur]


COUNTERS = T.COUNTERS


@query("a5_run_summary", f"""
WITH {TRACES}, h AS (SELECT * FROM traces WHERE interaction_policy = '{INTERACTION_POLICY}')
SELECT count(*) AS examples, avg(coalesce(score, 0.0))::DOUBLE AS mean_score, sum(teacher_tokens_used)::BIGINT AS teacher_tokens_total, avg(teacher_tokens_used) AS teacher_tokens_mean,
{', '.join(f'sum({c})::BIGINT AS {c}_total, sum({c}) / count(*) AS {c}_rate' for c in COUNTERS)},
sum(len(list_filter(events, lambda e: coalesce(e.error <> '', false))))::BIGINT AS event_error_count,
sum(len(list_filter(events, lambda e: coalesce(e.feedback_truncated, false))))::BIGINT AS feedback_truncated_count FROM h""")
def a5(spark, sf):
    return T.run_summary(traces(spark, sf))


@query("a6_subset_metrics", f"WITH {TRACES}, h AS (SELECT *, coalesce(score, 0.0)::DOUBLE AS s FROM traces WHERE interaction_policy = '{INTERACTION_POLICY}')\n" + " UNION ALL ".join(
    f"SELECT '{g}' AS grp, count(*) FILTER ({t}) AS n, count(*) FILTER ({t}) / count(*) AS fraction, avg(s) FILTER ({t}) AS mean_score, avg(teacher_tokens_used) FILTER ({t}) AS mean_tokens FROM h"
    for g, t in T.GROUPS.items()))
def a6(spark, sf):
    return T.subset_metrics(traces(spark, sf))


@query("a7_verify_trust", f"""
WITH {TRACES}, e AS (SELECT unnest(events) AS e FROM traces WHERE interaction_policy = '{INTERACTION_POLICY}')
SELECT count(*) AS review_events, count(*) FILTER (e.accepted) AS explicit_accepts, count(*) FILTER (e.implicit_adoption_without_accept) AS implicit_adoptions FROM e WHERE e.action = 'verify'""")
def a7(spark, sf):
    return T.verify_trust(traces(spark, sf))


@query("j4_paired_comparison", f"""
WITH {TRACES}, b AS (SELECT question, sample_index, collection_mode, avg(coalesce(score, 0.0))::DOUBLE AS s, avg(coalesce(score, 0.0)::DOUBLE - 0.15 * teacher_tokens_used / 192.0) AS u,
 bool_or(ask_count + verify_count > 0) AS acts FROM traces WHERE interaction_policy = '{INTERACTION_POLICY}' GROUP BY ALL)
SELECT m.collection_mode, count(*) AS paired_examples, round(avg(m.s - i.s), 9) AS mean_score_delta, round(avg(m.u - i.u), 9) AS mean_utility_delta,
 count(*) FILTER (i.s <= 0 AND m.s > 0) AS rescued_failures, count(*) FILTER (i.s > 0 AND m.acts) AS interactions_on_independent_successes
FROM b m JOIN b i ON m.question = i.question AND m.sample_index = i.sample_index AND i.collection_mode = 'independent' AND m.collection_mode <> 'independent' GROUP BY 1""")
def j4(spark, sf):
    out = T.paired_comparison(traces(spark, sf))
    return out.withColumns({c: rounded(F.col(c), 9) for c in ("mean_score_delta", "mean_utility_delta")})


UTILITY = "coalesce(score, 0.0)::DOUBLE - 0.15 * (teacher_tokens_used / 192.0) - 0.1 * invalid_accept_count - 0.05 * denied_action_count"
KIND = """CASE WHEN ask_count = 0 AND verify_count = 0 THEN 'independent_success' WHEN ask_count > 0 AND verify_count > 0 THEN 'mixed_interaction_success'
 WHEN ask_count > 0 THEN 'ask_success' WHEN accept_count > 0 THEN 'verify_accept_success' ELSE 'verify_without_accept_success' END"""
#: Each trace has one verify event at most, so that its rules can be written out.
REASON = f"""CASE WHEN interaction_policy <> '{INTERACTION_POLICY}' THEN '{OTHER_POLICY_REASON}' WHEN data_role <> 'train' THEN 'non_train_provenance' WHEN collection_error IS NOT NULL THEN 'collection_error'
 WHEN invalid_protocol_count > 0 THEN 'forged_environment_marker' WHEN coalesce(score, 0) < 1 THEN 'below_min_score' WHEN teacher_tokens_used > 150 THEN 'above_teacher_token_limit'
 WHEN invalid_accept_count > 0 OR denied_action_count > 0 THEN 'invalid_action' WHEN k = 17 AND len(events) > 0 THEN 'event_error'
 WHEN verify_count = 1 AND accept_count = 0 AND k % 12 = 4 THEN 'implicit_adoption_without_accept'
 WHEN accept_count = 1 AND k % 4 = 3 THEN 'wrong_accept' WHEN accept_count = 1 AND k % 29 = 2 THEN 'unvalidated_accept' WHEN accept_count = 1 AND k % 4 = 0 THEN 'unvalidated_accept'
 WHEN accept_count = 1 AND k % 7 = 1 THEN 'redundant_accept' WHEN k % 31 = 5 THEN 'forged_environment_marker' END"""


@query("p6_replay_reasons", f"WITH {TRACES} SELECT ord, {REASON} AS reason FROM traces")
def p6(spark, sf):
    return traces(spark, sf).select("ord", T.replay_reject_reason(max_tokens=150).alias("reason"))


@query("w1_best_per_problem", f"""
WITH {TRACES}, c AS (SELECT *, {UTILITY} AS utility, {KIND} AS trajectory_type FROM traces WHERE {REASON} IS NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY utility DESC, teacher_tokens_used, ask_count + verify_count, ord) AS rank FROM c)
SELECT printf('outcome_%07d_%d', dense_rank() OVER (ORDER BY question) - 1, rank - 1) AS id, question, ord, utility, trajectory_type FROM r WHERE rank <= 3""")
def w1(spark, sf):
    own = ["question", "ord", "teacher_tokens_used", "ask_count", "verify_count", T.utility().alias("utility"), T.trajectory_type().alias("trajectory_type")]
    c = T.replay_candidates(traces(spark, sf), own, max_tokens=150)
    return T.best_per_problem(c, 3).select("id", "question", "ord", "utility", "trajectory_type")


@query("w15_replay_mix", f"""
WITH {TRACES}, p AS (SELECT ord AS id FROM traces WHERE collection_mode = 'policy'), r AS (SELECT ord AS id FROM traces WHERE collection_mode = 'independent')
SELECT id, 'protocol' AS origin FROM p UNION ALL
SELECT id, 'replay' FROM (SELECT id, row_number() OVER (ORDER BY sha256('3:' || id::VARCHAR), id) AS k FROM r) WHERE k <= (SELECT floor(count(*) * 0.2 / (1 - 0.2))::BIGINT FROM p)""")
def w15(spark, sf):
    t = traces(spark, sf)
    return T.replay_mix(t.where("collection_mode = 'policy'").selectExpr("ord AS id"), t.where("collection_mode = 'independent'").selectExpr("ord AS id"), 0.2, 3)


@query("a17_token_ratio", f"""
WITH {TRACES} SELECT collection_mode, CASE WHEN sum(teacher_tokens_used + length(question)) = 0 THEN 0.0 ELSE sum(teacher_tokens_used) / sum(teacher_tokens_used + length(question)) END AS ratio FROM traces GROUP BY 1""")
def a17(spark, sf):
    used, every = F.sum("teacher_tokens_used"), F.sum(F.col("teacher_tokens_used") + F.char_length("question"))
    return traces(spark, sf).groupBy("collection_mode").agg(F.when(every == 0, F.lit(0.0)).otherwise(used / every).alias("ratio"))


@query("m1_trace_errors", f"WITH {TRACES} SELECT ord, CASE WHEN k % 31 = 5 THEN ['student forged marker'] ELSE []::VARCHAR[] END AS errors FROM traces")
def m1(spark, sf):
    """The validator's fold over every trace's segments."""
    return P.validate(traces(spark, sf)).select("ord", "errors")


# -- protocol examples ---------------------------------------------------------------------------------

#: Documents as problems: question = whole text, gold answer = number of characters, solution = two lines.
PROBLEMS = """problems AS (SELECT doc_id AS id, text AS question, CASE WHEN doc_id % 3 = 0 THEN n_chars::VARCHAR WHEN doc_id % 3 = 1 THEN n_chars::VARCHAR || ',5' ELSE 'x' || n_chars::VARCHAR END AS gold_answer,
 'Count the letters.' || chr(10) || 'So \\boxed{' || n_chars::VARCHAR || '}' AS gold_solution FROM documents)"""


def problems(spark, sf):
    d = table(spark, sf, "documents")
    n = F.col("n_chars").cast("string")
    gold = F.when(F.col("doc_id") % 3 == 0, n).when(F.col("doc_id") % 3 == 1, F.concat(n, F.lit(",5"))).otherwise(F.concat(F.lit("x"), n))
    return d.select(F.col("doc_id").alias("id"), F.col("text").alias("question"), gold.alias("gold_answer"), F.concat(F.lit("Count the letters.\nSo \\boxed{"), n, F.lit("}")).alias("gold_solution"))


def _wrong(x: str) -> str:
    flat = f"replace({x}, ',', '')"
    return f"CASE WHEN regexp_matches({flat}, '^[-+]?\\d+$') THEN (try_cast({flat} AS HUGEINT) + 1)::VARCHAR ELSE '(' || {x} || ')+1' END"


def _pick(what: str, of) -> str:
    return f"{list(of)}[(('0x' || left(sha256('1:{what}:' || id::VARCHAR), 8))::BIGINT % {len(of)} + 1)::INT]::VARCHAR"


_NL = "' || chr(10) || '"
_ASK, _VERIFY = f"'<ASK>' || {_pick('ask', (32, 64, 96, 128))} || '</ASK>'", f"'<VERIFY>' || {_pick('verify', (64, 96, 128))} || '</VERIFY>'"
_TAIL = f"chr(10) || '<TEACHER_REVIEW>{_NL}Verdict: "
_ANSWERS = {
    "normal": "gold_solution",
    "ask_help": f"'I need a useful next reasoning step before completing this solution.{_NL}' || {_ASK} || '{_NL}<TEACHER_HELP>{_NL}A useful next step is: Count the letters.{_NL}</TEACHER_HELP>{_NL}' || gold_solution",
    "verify_confirm": f"gold_solution || '{_NL}' || {_VERIFY} || {_TAIL}correct{_NL}Issue: None{_NL}Correction: None{_NL}Suggested answer: \\boxed{{' || gold_answer || '}}{_NL}</TEACHER_REVIEW>{_NL}The checked final answer remains \\boxed{{' || gold_answer || '}}.'",
    "verify_accept_correction": f"'A tentative calculation gives \\boxed{{' || wrong || '}}.{_NL}' || {_VERIFY} || {_TAIL}incorrect{_NL}Issue: The tentative result ' || wrong || ' does not match the corrected derivation.{_NL}Correction: The corrected result is \\boxed{{' || gold_answer || '}}.{_NL}Suggested answer: \\boxed{{' || gold_answer || '}}{_NL}</TEACHER_REVIEW>{_NL}<ACCEPT>{_NL}' || gold_solution",
    "verify_reject_bad_feedback": f"gold_solution || '{_NL}' || {_VERIFY} || {_TAIL}incorrect{_NL}Issue: Replace the final value with ' || wrong || '.{_NL}Correction: The final value is \\boxed{{' || wrong || '}}.{_NL}Suggested answer: \\boxed{{' || wrong || '}}{_NL}</TEACHER_REVIEW>{_NL}The proposed correction conflicts with the derivation, so I retain \\boxed{{' || gold_answer || '}}.'",
    "verify_uncertain": f"'I have a tentative derivation but want an external check before finalizing.{_NL}' || {_VERIFY} || {_TAIL}uncertain{_NL}Issue: The available check is inconclusive.{_NL}Correction: None{_NL}Suggested answer: None{_NL}</TEACHER_REVIEW>{_NL}' || gold_solution",
}
EXAMPLES = f"{PROBLEMS}, w AS (SELECT *, {_wrong('gold_answer')} AS wrong FROM problems), examples AS (" + " UNION ALL ".join(
    f"SELECT id::VARCHAR || '_{name}_{k}' AS id, regexp_replace(question, '{WS}+$', '') || '{_NL}Please reason step by step, and put your final answer within \\boxed{{}}.' AS question, {answer} AS answer, '' AS system, '{name}' AS sample_type, gold_answer FROM w"
    for k, (name, answer) in enumerate(_ANSWERS.items())
) + ")"


@query("m2_expand_and_flatten", f"WITH {EXAMPLES} SELECT question, answer, system, sample_type, gold_answer FROM examples")
def m2(spark, sf):
    """Six examples of each problem, flattened to question and answer."""
    return P.flatten(P.expand(problems(spark, sf), 1))


@query("m1_expanded_are_valid", f"WITH {EXAMPLES} SELECT sample_type, count(*) AS n, 0::BIGINT AS errors, sum(CASE sample_type WHEN 'normal' THEN 0 ELSE 1 END)::BIGINT AS teacher_segments, count(*) FILTER (sample_type = 'verify_accept_correction') AS accepts FROM examples GROUP BY 1")
def m1_valid(spark, sf):
    v = P.validate(P.expand(problems(spark, sf), 1))
    return v.groupBy("sample_type").agg(F.count("*").alias("n"), F.sum(F.size("errors")).alias("errors"), F.sum("teacher_segments").alias("teacher_segments"), F.sum("accepts").alias("accepts"))


@query("a26_type_shares", f"WITH {EXAMPLES} SELECT sample_type, count(*) AS n, count(*) * 100 / sum(count(*)) OVER () AS percent FROM examples WHERE gold_answer <> 'x9' GROUP BY 1")
def a26(spark, sf):
    return P.type_shares(P.flatten(P.expand(problems(spark, sf), 1)).where("gold_answer <> 'x9'"))


@query("w20_weighted_types", """
WITH u AS (SELECT doc_id, ('0x' || left(sha256('6:' || doc_id::VARCHAR), 8))::BIGINT / 4294967296.0 AS u FROM documents)
SELECT doc_id, CASE WHEN u < 0.45 THEN 'normal' WHEN u < 0.45 + 0.15 THEN 'ask_help' WHEN u < 0.7 THEN 'verify_confirm' WHEN u < 0.85 THEN 'verify_accept_correction' WHEN u < 0.95 THEN 'verify_reject_bad_feedback' ELSE 'verify_uncertain' END AS sample_type FROM u""")
def w20(spark, sf):
    return table(spark, sf, "documents").select("doc_id", P.weighted_type(6, F.col("doc_id")).alias("sample_type"))


@query("f26_loss_spans", """
WITH t AS (SELECT conv_id, turn, role, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM conversations)
SELECT conv_id, coalesce(list(pos::INT ORDER BY turn) FILTER (role = 'assistant'), []) AS starts, coalesce(list((pos + n)::INT ORDER BY turn) FILTER (role = 'assistant'), []) AS ends FROM t GROUP BY 1""")
def f26(spark, sf):
    spans = P.loss_spans(F.col("segments"))
    return _conversations(spark, sf).select("conv_id", spans["start"].alias("starts"), spans["end"].alias("ends"))


def _conversations(spark, sf):
    """Turns as segments: the assistant is the student."""
    c = table(spark, sf, "conversations")
    source = F.when(F.col("role") == "assistant", "student").otherwise(F.col("role"))
    turn = F.struct("turn", source.alias("source"), "text", (F.col("role") == "assistant").alias("loss"))
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return rows.select("conv_id", F.transform("t", lambda t: F.struct(t["source"], t["text"], t["loss"])).alias("segments"))


@query("f25_flatten_turns", """
SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS question, coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS answer FROM conversations GROUP BY 1""")
def f25(spark, sf):
    seg = F.col("segments")
    first = F.get(F.filter(seg, lambda s: s["source"] == "user"), F.lit(0))["text"]
    said = F.array_join(F.transform(F.filter(seg, lambda s: ~s["source"].isin("system", "user")), lambda s: s["text"]), "")
    return _conversations(spark, sf).select("conv_id", first.alias("question"), said.alias("answer"))


@query("m12_probe_prefix", """
WITH s AS (SELECT *, role = 'assistant' AND contains(text, ' de ') AS hit FROM conversations),
f AS (SELECT conv_id, min(turn) FILTER (hit) AS stop FROM s GROUP BY 1)
SELECT s.conv_id, length(string_agg(CASE WHEN turn = stop THEN split_part(text, ' de ', 1) ELSE text END, '' ORDER BY turn))::INT AS n FROM s JOIN f USING (conv_id) WHERE turn <= stop GROUP BY 1""")
def m12(spark, sf):
    p = P.probe_prefix(F.col("segments"), " de ")
    return _conversations(spark, sf).select("conv_id", F.char_length(p).alias("n")).where("n IS NOT NULL")


@query("f27_token_labels", """
WITH t AS (SELECT doc_id, list_transform(range(0, 12), lambda i: struct_pack(id := (doc_id + i)::BIGINT, "start" := i * 5, "end" := i * 5 + 5)) AS tokens, [struct_pack(a := 10, b := 25), struct_pack(a := 40, b := 55)] AS spans FROM documents)
SELECT doc_id, list_transform(tokens, lambda t: CASE WHEN (t."start" >= 10 AND t."end" <= 25) OR (t."start" >= 40 AND t."end" <= 55) THEN t.id ELSE -100 END) AS labels FROM t""")
def f27(spark, sf):
    tokens = F.expr("transform(sequence(0, 11), i -> named_struct('id', doc_id + i, 'start', i * 5, 'end', i * 5 + 5))")
    spans = F.expr("array(named_struct('start', 10, 'end', 25), named_struct('start', 40, 'end', 55))")
    return table(spark, sf, "documents").select("doc_id", P.token_labels(tokens, spans).alias("labels"))


# -- dialogues with stub models ------------------------------------------------------------------------


@query("m3_dialogues", """
WITH d AS (SELECT item_id AS id, length(text) % 2 = 1 AS asks FROM benchmark)
SELECT id, asks::BIGINT AS ask_count, 1::BIGINT AS verify_count, 1::BIGINT AS accept_count, 0::BIGINT AS denied_action_count, (CASE WHEN asks THEN 11 ELSE 0 END + 29)::BIGINT AS teacher_tokens_used,
       (CASE WHEN asks THEN 5 ELSE 3 END)::INT AS n_segments, 0::INT AS n_errors FROM d""")
def m3(spark, sf):
    """The turn loop with deterministic models; its segments pass the validator."""
    from ..operators import dialogues as D

    rows = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("prompt"))
    out = D.run_dialogues(rows, D.stub_student, D.stub_teacher, D.Rules(tokens=len))
    first = F.array(F.struct(F.lit("user").alias("source"), F.lit("q").alias("text"), F.lit(False).alias("loss")))
    errors = F.size(P.segment_errors(F.concat(first, "segments")))
    return out.select("id", "ask_count", "verify_count", "accept_count", "denied_action_count", "teacher_tokens_used", F.size("segments").alias("n_segments"), errors.alias("n_errors"))


def _ones(said: str, value: int = 1) -> str:
    return f"list_transform(range({len(said)}), lambda i: {value})"


M4_LENGTH = 320
M4_HELP = (_ones("First step. <ASK>16</ASK>"), _ones(wrap("ask", "Try halves."), 0), _ones("Draft \\boxed{1}. <VERIFY>32</VERIFY>"))
M4_REVIEW = (_ones(wrap("verify", "Verdict: incorrect. \\boxed{2}"), 0), _ones("<ACCEPT>\nSo \\boxed{2}."))


@query("m4_training_rollouts", f"""
WITH d AS (SELECT item_id AS id, length(text) % 2 = 1 AS asks FROM benchmark),
m AS (SELECT id, asks, flatten(CASE WHEN asks THEN [{", ".join(M4_HELP + M4_REVIEW)}] ELSE [{", ".join((_ones("Draft \\boxed{1}. <VERIFY>0</VERIFY>"), *M4_REVIEW))}] END) AS own FROM d)
SELECT id, asks::BIGINT AS ask_count, 1::BIGINT AS verify_count, list_concat(own, list_transform(range({M4_LENGTH} - len(own)), lambda i: 0))::INT[] AS policy_mask FROM m""")
def m4(spark, sf):
    """The turn loop with the training profile; characters stand for tokens."""
    from ..operators import dialogues as D

    rows = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("prompt"))
    out = D.training_rollouts(rows, D.stub_student, D.stub_teacher, D.Rules(profile="train", most_tokens=M4_LENGTH), M4_LENGTH)
    return out.select("id", "ask_count", "verify_count", "policy_mask")


@query("m8_fitted_feedback", f"""
SELECT doc_id, left(text, n) AS shown_eval, left(text, n) AS shown_train, length(text) > n AS truncated
FROM (SELECT doc_id, text, greatest(0, 2048 - {len(wrap("ask", ""))} - length(coalesce(source, ''))) AS n FROM documents)""")
def m8(spark, sf):
    """Whole documents as feedback after their source as context; characters stand for tokens."""
    from ..operators import dialogues as D

    def shown(profile):
        rules = D.Rules(profile=profile)

        @F.pandas_udf("string")
        def cut(contexts: pd.Series, texts: pd.Series) -> pd.Series:
            return pd.Series([None if t is None else D.fitted(c, "ask", t, rules) for c, t in zip(contexts, texts)], dtype="object")

        return cut(F.coalesce("source", F.lit("")), "text")

    out = table(spark, sf, "documents").select("doc_id", "text", shown("eval").alias("shown_eval"), shown("train").alias("shown_train"))
    return out.select("doc_id", "shown_eval", "shown_train", (F.char_length("text") > F.char_length("shown_eval")).alias("truncated"))


@query("m5_relay", "SELECT item_id AS id, 'please <call>4</call>helpdone' AS response, 1::BIGINT AS ask_count, 4::BIGINT AS teacher_tokens_used, 'done' AS status FROM benchmark")
def m5(spark, sf):
    from ..operators import dialogues as D

    def student(prompts, limits):
        return ["done" if "help" in p[-8:] else "please <call>4</call>" for p in prompts]

    def teacher(prompts, limits):
        return [{"text": "help!"[:n]} for n in limits]

    rows = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("prompt"))
    return D.run_dialogues(rows, student, teacher, D.Rules(), D.relay).select("id", "response", "ask_count", "teacher_tokens_used", "status")


@query("f24_annotate_review", """
WITH d AS (SELECT doc_id, doc_id % 3 AS t, doc_id % 4 AS p, doc_id % 2 = 0 AS acc, doc_id % 5 AS f FROM documents)
SELECT doc_id, CASE WHEN t = 2 THEN NULL ELSE t = 0 END AS tentative_answer_correct, CASE WHEN p >= 2 THEN NULL ELSE p = 0 END AS feedback_answer_correct,
 CASE WHEN p < 2 THEN p = 0 WHEN t = 2 THEN NULL WHEN p = 2 THEN t = 0 ELSE t <> 0 END AS feedback_is_correct,
 NOT acc AND p < 2 AND f < 2 AND f = p AND NOT (t < 2 AND t = p) AS implicit_adoption_without_accept FROM d""")
def f24(spark, sf):
    """Tentative, proposed and final answers by doc_id; 7 is right, 8 is wrong."""
    n = F.col("doc_id")
    box = lambda k: F.when(k == 0, "\\boxed{7}").when(k == 1, "\\boxed{8}")
    shown = F.coalesce(box(n % 4), F.when(n % 4 == 2, "Verdict: correct").otherwise("Verdict: incorrect"))
    none = F.lit(None).cast("boolean")
    event = F.struct(
        F.lit("verify").alias("action"), F.lit(None).cast("string").alias("error"), (n % 2 == 0).alias("accepted"), F.coalesce(box(n % 3), F.lit("none yet")).alias("student_before_feedback"),
        shown.alias("teacher_context_text"), *[none.alias(c) for c in ("tentative_answer_correct", "feedback_answer_correct", "feedback_is_correct", "implicit_adoption_without_accept")],
    )
    final = F.coalesce(box(n % 5), F.lit("no answer"))
    e = T.annotate_review(F.array(event), F.lit("7"), final)[0]
    cols = ("tentative_answer_correct", "feedback_answer_correct", "feedback_is_correct", "implicit_adoption_without_accept")
    return table(spark, sf, "documents").select("doc_id", *[e[c].alias(c) for c in cols])


@query("m9_policy_mask", """
SELECT doc_id, list_transform(range(0, doc_id % 30), lambda i: CASE WHEN (i >= 3 AND i < 7) OR (i >= 20 AND i < 22) THEN 0 ELSE 1 END) AS mask FROM documents""")
def m9(spark, sf):
    spans = F.expr("array(named_struct('start', 3, 'end', 7), named_struct('start', 20, 'end', 22))")
    return table(spark, sf, "documents").select("doc_id", P.policy_mask(F.col("doc_id") % 30, spans).alias("mask"))


@query("m11_smoke_report", f"""
WITH {TRACES}, s AS (SELECT * FROM traces WHERE collection_mode = 'force_ask_first')
SELECT count(*) AS rollouts, count(*) FILTER (ask_count > 0) AS took_action, count(*) FILTER (teacher_tokens_used >= 1) AS spent_tokens, count(*) FILTER (k % 31 <> 5 AND collection_error IS NULL) AS clean, false AS ok FROM s""")
def m11(spark, sf):
    return P.smoke_report(traces(spark, sf).where("collection_mode = 'force_ask_first'"), "ask")


@query("m9_conversation_mask", """
SELECT conv_id, flatten(list(list_transform(range(length(text)), lambda i: (role = 'assistant')::INT) ORDER BY turn)) AS mask FROM conversations GROUP BY 1""")
def m9_conversations(spark, sf):
    """Policy masks of whole conversations: characters that the assistant said are 1."""
    return _conversations(spark, sf).select("conv_id", P.segment_mask(F.col("segments")).alias("mask"))


@query("p10_trainable", "SELECT doc_id FROM documents WHERE doc_id % 6 < 4")
def p10(spark, sf):
    d = table(spark, sf, "documents").withColumn("labels", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(i >= F.col("doc_id") % 6, i).otherwise(-100)))
    return P.trainable_after_cut(d, "labels", 4).select("doc_id")
