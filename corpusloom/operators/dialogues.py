"""Student and teacher dialogues against pluggable batch models.

Every dialogue is a coroutine: it yields what it needs next (a student turn or a teacher reply) and is sent the
answer. A scheduler per task gathers the open requests of all its dialogues, so that each model sees batches.
A student is a function (prompts, limits) -> texts, a teacher (prompts, limits) -> replies {text, error, tokens}.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.fixed import ACTION_MARKERS, CONTEXT_MARKERS, HELP, REVIEW

MODES = ("policy", "independent", "force_ask_first", "force_verify_after_draft")
TAGS = {"ask": re.compile(r"<ASK>\s*(\d+)\s*</ASK>"), "verify": re.compile(r"<VERIFY>\s*(\d+)\s*</VERIFY>")}
CALL = re.compile(r"<call>\s*(\d+)\s*</call>")
# fixed values: what the environment says
LIMIT_NOTICE = "\n<ENVIRONMENT_NOTICE>No further external interactions are available. Complete the answer independently.</ENVIRONMENT_NOTICE>\n"
FAILURE_NOTICE = "\n<ENVIRONMENT_NOTICE>External response unavailable. Complete the answer independently.</ENVIRONMENT_NOTICE>\n"

SCHEMA = (
    "id long, response string, student_response string, status string, termination_reason string, collection_error string, "
    "ask_count long, verify_count long, accept_count long, invalid_accept_count long, invalid_protocol_count long, denied_action_count long, teacher_tokens_used long, "
    "events array<struct<action:string,forced:boolean,requested_budget_tokens:long,applied_budget_tokens:long,student_before_feedback:string,teacher_text:string,"
    "teacher_context_text:string,teacher_tokens_used:long,feedback_truncated:boolean,accepted:boolean,student_after_feedback:string,observation_status:string,error:string>>, "
    "segments array<struct<source:string,text:string,loss:boolean>>"
)


@dataclass(frozen=True)
class Rules:
    """profile 'eval' also rejects closing action tags in teacher texts; 'train' does not."""

    mode: str = "policy"
    profile: str = "eval"
    most_interactions: int = 2
    ask_budget: int = 64
    verify_budget: int = 96
    most_tokens: int = 2048
    tokens: Callable[[str], int] = len
    cut: Callable[[str, int], str] = lambda text, n: text[:n]
    most_calls: int = 5

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode}")
        if self.most_interactions < (self.mode.startswith("force")) or min(self.ask_budget, self.verify_budget) <= 0:
            raise ValueError("a forced mode needs an interaction, and budgets must be positive")

    def reserved(self) -> tuple[str, ...]:
        closing = ("</ASK>", "</VERIFY>") if self.profile == "eval" else ()
        return (*ACTION_MARKERS, *closing, *CONTEXT_MARKERS)


@dataclass
class Record:
    id: int
    text: str = ""
    spoken: str = ""
    status: str = "done"
    termination_reason: str | None = None
    collection_error: str | None = None
    counts: dict = field(default_factory=lambda: dict.fromkeys(("ask_count", "verify_count", "accept_count", "invalid_accept_count", "invalid_protocol_count", "denied_action_count", "teacher_tokens_used"), 0))
    events: list = field(default_factory=list)
    segments: list = field(default_factory=list)

    def say(self, source: str, text: str, loss: bool = False) -> None:
        self.text += text
        if source == "student":
            self.spoken += text
        self.segments.append({"source": source, "text": text, "loss": loss})

    def row(self) -> dict:
        return {"id": self.id, "response": self.text, "student_response": self.spoken, "status": self.status, "termination_reason": self.termination_reason, "collection_error": self.collection_error, **self.counts, "events": self.events, "segments": self.segments}


def wrap(action: str, text: str) -> str:
    opening, closing = HELP if action == "ask" else REVIEW
    return f"\n{opening}\n{text}\n{closing}\n"


def teacher_prompt(prompt: str, so_far: str, action: str) -> str:
    task = "Give one useful next step without the final answer." if action == "ask" else "Review the draft: verdict, issue, correction, suggested answer."
    return f"{prompt}\n\nStudent's work so far:\n{so_far}\n\n{task}"


def leaks(text: str) -> bool:
    return re.search(r"\\boxed\s*\{", text, re.I) is not None or "final answer" in text.lower()


def dialogue(id_: int, prompt: str, rules: Rules) -> Generator[tuple, object, Record]:
    r = Record(id_)
    c, allowed, drafting = r.counts, rules.mode == "policy", rules.mode == "force_verify_after_draft"
    review: dict | None = None
    next_action: tuple[str, int, bool] | None = None

    def room() -> int:
        return rules.most_tokens - rules.tokens(r.text)

    def notice(text: str, why: str) -> bool:
        """Put a notice into the text; False if there is no room for it."""
        if rules.tokens(text) > room():
            r.termination_reason = why
            return False
        r.say("environment", text)
        return True

    if rules.mode == "force_ask_first":
        r.say("student", f"<ASK>{rules.ask_budget}</ASK>")
        next_action = ("ask", rules.ask_budget, True)
    while True:
        if next_action is None:
            if room() <= 0:
                return r
            said = yield ("student", prompt + r.text, room())
            r.say("student", said, True)
            accepts = said.count("<ACCEPT>")
            if review is None:
                c["invalid_accept_count"] += accepts
            else:
                review.update(student_after_feedback=said, accepted=accepts > 0)
                c["accept_count"] += accepts > 0
                c["invalid_accept_count"] += max(accepts - 1, 0)
                review = None
            forged = sum(said.count(m) for m in CONTEXT_MARKERS)
            if forged:
                c["invalid_protocol_count"] += forged
                r.collection_error = "reserved environment marker in a student turn"
            asked = {a: p.search(said) for a, p in TAGS.items()}
            if not allowed:
                blocked = sum(len(p.findall(said)) for p in TAGS.values())
                c["denied_action_count"] += blocked
                if blocked and rules.mode != "policy":
                    r.collection_error = "disabled action in a controlled dialogue"
            if drafting:
                drafting = False
                if any(asked.values()) or accepts:
                    r.collection_error = "action in the first draft"
                    return r
                r.say("student", f"\n<VERIFY>{rules.verify_budget}</VERIFY>")
                next_action = ("verify", rules.verify_budget, True)
            else:
                action = next((a for a in TAGS if asked[a]), None) if allowed else None
                if action is None:
                    return r
                if c["ask_count"] + c["verify_count"] >= rules.most_interactions:
                    c["denied_action_count"] += 1
                    if not notice(LIMIT_NOTICE, "no room for the limit notice"):
                        return r
                    allowed = False
                    continue
                wanted = int(asked[action][1])
                next_action = (action, wanted or (rules.ask_budget if action == "ask" else rules.verify_budget), False)
        action, budget, forced = next_action
        next_action = None
        c[f"{action}_count"] += 1
        event = {
            "action": action, "forced": forced, "requested_budget_tokens": budget, "applied_budget_tokens": None, "student_before_feedback": r.spoken, "teacher_text": None, "teacher_context_text": None,
            "teacher_tokens_used": 0, "feedback_truncated": None, "accepted": False if action == "verify" else None, "student_after_feedback": None, "observation_status": "pending", "error": None,
        }
        r.events.append(event)
        free = room() - rules.tokens(wrap(action, ""))
        if free <= 0:
            event.update(error="no room for feedback", observation_status="terminated_without_observation")
            r.termination_reason = "no room for a teacher observation"
            return r
        event["applied_budget_tokens"] = min(budget, free)
        reply = yield ("teacher", teacher_prompt(prompt, r.text, action), event["applied_budget_tokens"])
        text, fault = reply.get("text") or "", reply.get("error")
        if not fault:
            used = reply.get("tokens") or rules.tokens(text)
            event.update(teacher_text=text, teacher_tokens_used=used)
            c["teacher_tokens_used"] += used
            marker = next((m for m in rules.reserved() if m in text), None)
            fault = f"reserved marker {marker}" if marker else "help disclosed an answer" if action == "ask" and leaks(text) else None
        if fault:
            event["error"] = fault
            if not notice(FAILURE_NOTICE, "no room for the failure notice"):
                event["observation_status"] = "terminated_without_observation"
                return r
            event["observation_status"] = "delivered_environment_notice"
            continue
        shown = fitted(r.text, action, text, rules)
        r.say("teacher", wrap(action, shown))
        event.update(teacher_context_text=shown, feedback_truncated=shown != text, observation_status="delivered_teacher_observation")
        if action == "verify":
            review = event


def fitted(context: str, action: str, text: str, rules: Rules) -> str:
    """The longest beginning of a teacher's text that leaves context and observation within the budget.

    profile 'eval' counts the whole of each candidate, since tokens of parts need not add up; 'train' cuts to what is free.
    """
    if rules.profile == "train":
        free = max(0, rules.most_tokens - rules.tokens(context) - rules.tokens(wrap(action, "")))
        return text if rules.tokens(text) <= free else rules.cut(text, free)

    def over(shown: str) -> bool:
        return rules.tokens(context + wrap(action, shown)) > rules.most_tokens

    if not over(text):
        return text
    return rules.cut(text, bisect_left(range(rules.tokens(text)), True, key=lambda n: over(rules.cut(text, n + 1))))


def relay(id_: int, prompt: str, rules: Rules) -> Generator[tuple, object, Record]:
    """The plain relay: after <call>N</call> the teacher writes on for up to N tokens."""
    r = Record(id_)
    for turn in range(rules.most_calls + 1):
        if room_left(r, rules) <= 0:
            break
        said = yield ("student", prompt + r.text, room_left(r, rules))
        r.say("student", said, True)
        call = CALL.search(said)
        if call is None or turn == rules.most_calls:
            break
        reply = yield ("teacher", prompt + r.text, max(0, min(int(call[1]), 4096, room_left(r, rules))))
        if reply.get("error"):
            r.status = "failed" if rules.profile == "eval" else "done"
            r.collection_error = reply["error"]
            break
        r.say("teacher", reply.get("text") or "")
        r.counts["ask_count"] += 1
        r.counts["teacher_tokens_used"] += reply.get("tokens") or rules.tokens(reply.get("text") or "")
    return r


def room_left(r: Record, rules: Rules) -> int:
    return rules.most_tokens - rules.tokens(r.text)


def play(rows: list[tuple[int, str]], student: Callable, teacher: Callable, rules: Rules, script: Callable = dialogue) -> list[Record]:
    """Run all dialogues to their end; each round every model answers one batch."""
    live, done = {}, {}
    for id_, prompt in rows:
        talk = script(id_, prompt, rules)
        live[len(live)] = (talk, None)
    asks: dict[str, list] = {"student": [], "teacher": []}

    def advance(k: int, value) -> None:
        talk = live[k][0]
        try:
            kind, prompt, limit = talk.send(value)
            asks[kind].append((k, prompt, limit))
        except StopIteration as end:
            done[k] = end.value

    for k in list(live):
        advance(k, None)
    while asks["student"] or asks["teacher"]:
        for kind, model in (("student", student), ("teacher", teacher)):
            batch, asks[kind] = asks[kind], []
            if batch:
                replies = list(model([b[1] for b in batch], [b[2] for b in batch]))
                if len(replies) != len(batch):
                    raise ValueError(f"the {kind} answered {len(replies)} of {len(batch)} requests")
                for (k, _, _), reply in zip(batch, replies):
                    advance(k, reply)
    return [done[k] for k in sorted(done)]


def run_dialogues(requests: DataFrame, student: Callable, teacher: Callable, rules: Rules = Rules(), script: Callable = dialogue) -> DataFrame:
    """requests: (id, prompt). One row per request; models are called within tasks and never on the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = play(list(zip(b["id"].tolist(), b["prompt"].tolist())), student, teacher, rules, script)
            yield pd.DataFrame([r.row() for r in done], columns=[c.strip().split()[0] for c in _columns()])

    return requests.select("id", "prompt").mapInPandas(run, SCHEMA)


def training_rollouts(requests: DataFrame, student: Callable, teacher: Callable, rules: Rules, length: int, script: Callable = dialogue) -> DataFrame:
    """run_dialogues for training: every row also has policy_mask, of `length` places.

    A place is 1 for a token that the student wrote of its own accord, 0 for teachers, notices, forced tags and padding.
    """

    def mask(r: Record) -> list[int]:
        own = [int(s["loss"]) for s in r.segments for _ in range(rules.tokens(s["text"]))][:length]
        return own + [0] * (length - len(own))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = play(list(zip(b["id"].tolist(), b["prompt"].tolist())), student, teacher, rules, script)
            yield pd.DataFrame([r.row() | {"policy_mask": mask(r)} for r in done], columns=[*(c.strip().split()[0] for c in _columns()), "policy_mask"])

    return requests.select("id", "prompt").mapInPandas(run, f"{SCHEMA}, policy_mask array<int>")


def _columns() -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in SCHEMA:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]


def stub_student(prompts: list[str], limits: list[int]) -> list[str]:
    """Deterministic stand-in: asks, then has its draft reviewed, then accepts and answers."""
    out = []
    for p in prompts:
        if "<ENVIRONMENT_NOTICE>" in p:
            out.append("So \\boxed{1}.")
        elif "</TEACHER_REVIEW>" in p:
            out.append("<ACCEPT>\nSo \\boxed{2}.")
        elif "</TEACHER_HELP>" in p:
            out.append("Draft \\boxed{1}. <VERIFY>32</VERIFY>")
        else:
            out.append("First step. <ASK>16</ASK>" if len(p) % 2 else "Draft \\boxed{1}. <VERIFY>0</VERIFY>")
    return out


def stub_teacher(prompts: list[str], limits: list[int]) -> list[dict]:
    return [{"text": ("Try halves." if "next step" in p else "Verdict: incorrect. \\boxed{2}")[:n], "error": None} for p, n in zip(prompts, limits)]
