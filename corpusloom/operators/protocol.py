"""Protocol examples: expansion of problems, validation of segments, flattening, token labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.fixed import ACTION_MARKERS, ASK_BUDGETS, CONTEXT_MARKERS, HELP, NOTICE, REVIEW, SAMPLE_TYPES, SAMPLE_WEIGHTS, VERIFY_BUDGETS
from .curation import hash_rank

REQUEST = r"<(?:ASK>\s*\d+\s*</ASK|VERIFY>\s*\d+\s*</VERIFY)>"


def _count(x: Column, pattern: str) -> Column:
    return F.regexp_count(x, F.lit(pattern))


def segment_errors(segments: Column) -> Column:
    """Names of the rules that a sequence of segments breaks, in order, by one fold over its states.

    State: the observation that a request waits for, an unanswered review, an observation that the student
    has not continued, whether any trainable student text was seen.
    """
    none = F.lit(None).cast("string")
    zero = F.struct(none.alias("waits"), F.lit(False).alias("review"), F.lit(False).alias("owed"), F.lit(False).alias("spoke"), F.array().cast("array<string>").alias("errors"))

    def step(a: Column, s: Column) -> Column:
        src, text, loss = F.coalesce(s["source"], F.lit("")), F.coalesce(s["text"], F.lit("")), F.coalesce(s["loss"], F.lit(False))
        context, teacher, notice, student = src.isin("system", "user"), src == "teacher", src == "environment", src == "student"
        waits, pending = a["waits"].isNotNull(), a["review"]
        has = lambda tokens: X.contains_any(text, tokens)
        help_ok, review_ok, notice_ok = (X.exact_wrapper(text, *w) for w in (HELP, REVIEW, NOTICE))
        fits = F.when(a["waits"] == "ask", help_ok).when(waits, review_ok).otherwise(F.lit(False))
        foreign = F.when(a["waits"].eqNullSafe(F.lit("ask")), has((*REVIEW, *NOTICE))).otherwise(has((*HELP, *NOTICE)))
        asks, verifies = _count(text, r"<ASK>\s*\d+\s*</ASK>"), _count(text, r"<VERIFY>\s*\d+\s*</VERIFY>")
        requests, accepts = asks + verifies, X.occurrences(text, "<ACCEPT>")
        rules = (
            (~src.isin("system", "user", "student", "teacher", "environment"), "unsupported source"),
            (loss & ~student, "loss outside student"),
            (context & has((*ACTION_MARKERS, *CONTEXT_MARKERS)), "reserved marker in context"),
            (context & (waits | pending), "context interrupts"),
            (teacher & has(ACTION_MARKERS), "teacher action"),
            (teacher & ~waits, "unsolicited teacher"),
            (teacher & waits & ~fits, "teacher mismatch"),
            (teacher & foreign, "teacher foreign marker"),
            (notice & has((*ACTION_MARKERS, *HELP, *REVIEW)), "notice marker"),
            (notice & ~notice_ok, "notice wrapper"),
            (notice & ~waits, "unsolicited notice"),
            (student & has(CONTEXT_MARKERS), "student forged marker"),
            (student & waits, "student before observation"),
            (student & (requests > 1), "several requests"),
            (student & (requests == 1) & ~text.rlike(REQUEST + r"\s*$"), "request not last"),
            (student & (accepts > 1), "several accepts"),
            (student & (accepts > 0) & ~pending, "accept without review"),
        )
        found = F.filter(F.array(*[F.when(test, F.lit(name)) for test, name in rules]), lambda e: e.isNotNull())
        seen = waits & ((teacher & fits) | (notice & notice_ok))
        return F.struct(
            F.when(teacher | notice, none).when(student & (requests == 1), F.when(asks > 0, F.lit("ask")).otherwise(F.lit("verify"))).otherwise(a["waits"]).alias("waits"),
            F.when(student, F.lit(False)).otherwise(pending | (teacher & a["waits"].eqNullSafe(F.lit("verify")) & review_ok)).alias("review"),
            F.when(student, F.lit(False)).otherwise(a["owed"] | seen).alias("owed"),
            (a["spoke"] | (student & loss & (text != ""))).alias("spoke"),
            F.concat(a["errors"], found).alias("errors"),
        )

    def close(a: Column) -> Column:
        last = F.array(F.when(a["waits"].isNotNull(), F.lit("observation missing")), F.when(a["owed"], F.lit("continuation missing")), F.when(~a["spoke"], F.lit("no trainable text")))
        return F.concat(a["errors"], F.filter(last, lambda e: e.isNotNull()))

    return F.when(F.coalesce(F.size(segments), F.lit(0)) == 0, F.array(F.lit("no segments"))).otherwise(F.aggregate(segments, zero, step, close))


def validate(examples: DataFrame) -> DataFrame:
    """examples plus errors, and the counters of segments and actions that a report sums."""
    seg = F.col("segments")
    spoken = F.array_join(F.transform(F.filter(seg, lambda s: (s["source"] == "student") & s["loss"]), lambda s: s["text"]), "")
    out = examples.withColumn("errors", segment_errors(seg)).withColumn("spoken", spoken)
    for name, token in (("asks", "<ASK>"), ("verifies", "<VERIFY>"), ("accepts", "<ACCEPT>")):
        out = out.withColumn(name, X.occurrences(F.col("spoken"), token))
    out = out.withColumn("teacher_segments", F.size(F.filter(seg, lambda s: s["source"] == "teacher")))
    return out.withColumn("trainable_segments", F.size(F.filter(seg, lambda s: (s["source"] == "student") & s["loss"]))).drop("spoken")


def _draw(seed, what: str, n: int) -> Column:
    """A number below n from a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:{what}:"), F.col("id").cast("string")), 256)
    return (F.conv(F.left(digest, F.lit(8)), 16, 10).cast("long") % n).cast("int")


def _segment(source: str, text: Column) -> Column:
    return F.struct(F.lit(source).alias("source"), text.alias("text"), F.lit(source == "student").alias("loss"))


def expand(problems: DataFrame, seed=0) -> DataFrame:
    """Six protocol examples of every problem (id, question, gold_answer, gold_solution)."""
    cat, t = F.concat, F.lit
    gold, solution, wrong = F.col("gold_answer"), F.col("gold_solution"), X.incorrect_answer(F.col("gold_answer"))
    budget = lambda what, of: F.element_at(F.array(*[t(str(b)) for b in of]), _draw(seed, what, len(of)) + 1)
    ask = cat(t("<ASK>"), budget("ask", ASK_BUDGETS), t("</ASK>"))
    verify = cat(t("<VERIFY>"), budget("verify", VERIFY_BUDGETS), t("</VERIFY>"))
    box = lambda x: cat(t("\\boxed{"), x, t("}"))
    # fixed values: the sentences that examples are made of
    review = lambda *parts: _segment("teacher", cat(t("\n<TEACHER_REVIEW>\n"), *parts, t("\n</TEACHER_REVIEW>\n")))
    say = lambda *parts: _segment("student", cat(*parts))
    by_type = {
        "normal": [say(solution)],
        "ask_help": [
            say(t("I need a useful next reasoning step before completing this solution.\n"), ask),
            _segment("teacher", cat(t("\n<TEACHER_HELP>\nA useful next step is: "), X.help_hint(solution), t("\n</TEACHER_HELP>\n"))),
            say(solution),
        ],
        "verify_confirm": [
            say(solution, t("\n"), verify),
            review(t("Verdict: correct\nIssue: None\nCorrection: None\nSuggested answer: "), box(gold)),
            say(t("The checked final answer remains "), box(gold), t(".")),
        ],
        "verify_accept_correction": [
            say(t("A tentative calculation gives "), box(wrong), t(".\n"), verify),
            review(t("Verdict: incorrect\nIssue: The tentative result "), wrong, t(" does not match the corrected derivation.\nCorrection: The corrected result is "), box(gold), t(".\nSuggested answer: "), box(gold)),
            say(t("<ACCEPT>\n"), solution),
        ],
        "verify_reject_bad_feedback": [
            say(solution, t("\n"), verify),
            review(t("Verdict: incorrect\nIssue: Replace the final value with "), wrong, t(".\nCorrection: The final value is "), box(wrong), t(".\nSuggested answer: "), box(wrong)),
            say(t("The proposed correction conflicts with the derivation, so I retain "), box(gold), t(".")),
        ],
        "verify_uncertain": [
            say(t("I have a tentative derivation but want an external check before finalizing.\n"), verify),
            review(t("Verdict: uncertain\nIssue: The available check is inconclusive.\nCorrection: None\nSuggested answer: None")),
            say(solution),
        ],
    }
    right = {"verify_confirm": True, "verify_accept_correction": True, "verify_reject_bad_feedback": False}
    kinds = [
        F.struct(
            t(name).alias("sample_type"), t(k).alias("variant"), t(right.get(name)).cast("boolean").alias("feedback_is_correct"),
            F.array(_segment("user", X.user_prompt(F.col("question"))), *by_type[name]).alias("segments"),
        )
        for k, name in enumerate(SAMPLE_TYPES)
    ]
    rows = problems.select(F.col("id").alias("source_id"), "gold_answer", F.explode(F.array(*kinds)).alias("k"))
    key = cat(F.col("source_id").cast("string"), t("_"), F.col("k.sample_type"), t("_"), F.col("k.variant").cast("string"))
    return rows.select(key.alias("id"), "source_id", "k.sample_type", t("synthetic_protocol_seed").alias("generation_mode"), "gold_answer", "k.feedback_is_correct", "k.segments")


def weighted_type(seed, id_col: Column) -> Column:
    """A sample type drawn by its weight: inverse distribution function of a hash in [0, 1)."""
    u = F.conv(F.left(hash_rank(seed, id_col), F.lit(8)), 16, 10).cast("long") / F.lit(float(1 << 32))
    out, upto = None, 0.0
    for name, weight in SAMPLE_WEIGHTS.items():
        upto += weight
        out = F.when(u < upto, name) if out is None else out.when(u < upto, name)
    return out.otherwise(SAMPLE_TYPES[-1])


def flatten(examples: DataFrame) -> DataFrame:
    """question (first user segment), answer (all that student, teacher and environment say), other fields."""
    seg = F.col("segments")
    said = F.filter(seg, lambda s: ~s["source"].isin("system", "user"))
    rows = examples.select(
        F.get(F.filter(seg, lambda s: s["source"] == "user"), F.lit(0))["text"].alias("question"),
        F.array_join(F.transform(said, lambda s: s["text"]), "").alias("answer"),
        F.lit("").alias("system"),
        "sample_type",
        "gold_answer",
    )
    return rows.where((X.trim_u(F.col("question")) != "") & (X.trim_u(F.col("answer")) != ""))


def type_shares(flat: DataFrame) -> DataFrame:
    """Counts and percentages of sample types."""
    from pyspark.sql import Window as W

    n = flat.groupBy("sample_type").agg(F.count("*").alias("n"))  # one row a type
    return n.withColumn("percent", F.col("n") * 100 / F.sum("n").over(W.partitionBy(F.lit(1))))


def loss_spans(segments: Column) -> Column:
    """[start, end) character ranges of trainable segments in the concatenated text."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("spans"))

    def step(a, s):
        end = a["at"] + F.char_length(s["text"])
        own = F.struct(a["at"].alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(s["loss"], F.array_append(a["spans"], own)).otherwise(a["spans"]).alias("spans"))

    return F.aggregate(segments, zero, step, lambda a: a["spans"])


def token_labels(tokens: Column, spans: Column) -> Column:
    """ids of tokens (id, start, end) that lie within a span; -100 elsewhere."""
    inside = lambda t: F.exists(spans, lambda s: (t["start"] >= s["start"]) & (t["end"] <= s["end"]) & (t["end"] > t["start"]))
    return F.transform(tokens, lambda t: F.when(inside(t), t["id"]).otherwise(F.lit(-100)))


def probe_prefix(segments: Column, token: str) -> Column:
    """All text before the first student segment's first `token`; null if none holds it."""
    zero = F.struct(F.lit("").alias("text"), F.lit(False).alias("found"))

    def step(a, s):
        hit = (s["source"] == "student") & F.contains(s["text"], F.lit(token))
        part = F.when(hit, F.substring_index(s["text"], token, 1)).otherwise(s["text"])
        return F.when(a["found"], a).otherwise(F.struct(F.concat(a["text"], part).alias("text"), hit.alias("found")))

    return F.aggregate(segments, zero, step, lambda a: F.when(a["found"], a["text"]))


def trainable_after_cut(rows: DataFrame, labels: str, most: int) -> DataFrame:
    """Rows that keep a trained token within the first `most`."""
    return rows.where(F.exists(F.slice(labels, 1, most), lambda t: t != -100))


def policy_mask(length: Column, foreign: Column) -> Column:
    """1 for each of `length` tokens but those within a foreign [start, end) span."""
    at = F.when(length > 0, F.sequence(F.lit(0), (length - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.when(F.exists(foreign, lambda s: (i >= s["start"]) & (i < s["end"])), 0).otherwise(1))


def segment_mask(segments: Column) -> Column:
    """1 for each character of a trained segment, 0 for each of the others, in the order of the text; linear in its length."""
    own = lambda s: F.array_repeat(F.coalesce(s["loss"], F.lit(False)).cast("int"), F.char_length(s["text"]))
    return F.flatten(F.transform(segments, own))


def split_tokens(tokens: DataFrame, unknown: int) -> DataFrame:
    """(token, ids) rows of control tokens that a tokenizer does not know as one id of their own."""
    return tokens.where((F.size("ids") != 1) | (F.get("ids", F.lit(0)) == unknown))


def smoke_report(traces: DataFrame, action: str, least_tokens: int = 1) -> DataFrame:
    """One row: rollouts, how many took the action, spent tokens, kept the protocol; ok if all did."""
    taken, spent = F.col(f"{action}_count") > 0, F.col("teacher_tokens_used") >= least_tokens
    clean = (F.size(segment_errors(F.col("segments"))) == 0) & F.coalesce(F.col("collection_error") == "", F.lit(True))
    out = traces.agg(F.count("*").alias("rollouts"), F.count_if(taken).alias("took_action"), F.count_if(spent).alias("spent_tokens"), F.count_if(clean).alias("clean"))
    return out.withColumn("ok", (F.col("rollouts") > 0) & (F.least("took_action", "spent_tokens", "clean") == F.col("rollouts")))
