import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.functions import text as X
from corpusloom.operators import batches, curation, dialogues, grading, protocol, rewards, rollouts, traces


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# -- curation ------------------------------------------------------------------------------------------


def test_records_gold_cascade(spark):
    raw = spark.createDataFrame(
        [("a", "Q1", "So \\boxed{5}.", None), ("b", "Q2", "w #### 7 ", None), ("c", "Q3", "short", None), ("d", "Q4", "x" * 90, None), ("e", "Q5", "text \\boxed{1}", " 2. "), ("f", " ", "s", None)],
        "id string, problem string, solution string, target string",
    )
    got = {r["id"]: r for r in rows(curation.normalize_records(raw))}
    assert [got[k]["gold_answer"] for k in "abce"] == ["5", "7", "short", "2"]
    assert got["a"]["gold_solution"] == "So \\boxed{5}." and got["e"]["gold_solution"].endswith("\\boxed{2}.")
    assert got["d"]["reason"] == got["f"]["reason"] == "missing_question_solution_or_answer" and got["a"]["reason"] is None


def test_near_match_ranks_after_the_threshold(spark):
    """The held-out text with the highest overlap is too long to qualify; a shorter one matches."""
    target = "abcdefghij klmnopqrst uvwxyz"
    held = spark.createDataFrame([(1, target + " and a very much longer tail that goes on and on and on"), (2, target[:-1])], "id long, t string")
    left = curation.gram_sets(spark.createDataFrame([(9, target)], "id long, t string"), "id", "t")
    pairs = curation.similarity_join(left, curation.gram_sets(held, "id", "t"), 0.85)
    assert [(r["left_id"], r["match_id"]) for r in rows(curation.near_contamination(pairs))] == [(9, 2)]


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.85])
def test_prefix_filter_loses_nothing(spark, threshold):
    rng = random.Random(1)
    base = ["".join(rng.choice("abcd") for _ in range(40)) for _ in range(12)]
    texts = base + [t[:k] + "z" + t[k + 1 :] for t in base for k in (3, 20)] + ["ab", "abcdef"]
    sets = curation.gram_sets(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t")
    grams = [{t[i : i + 5] for i in range(max(1, len(t) - 4))} for t in texts]
    want = {(i, j) for j in range(len(texts)) for i in range(j) if len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= threshold}
    assert {(r["left_id"], r["right_id"]) for r in rows(curation.similarity_join(sets, None, threshold))} == want


def test_survivor_is_the_smallest_id(spark):
    r = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "y")], "id string, norm string")
    assert {x["id"]: x["duplicate_of"] for x in rows(curation.first_of_duplicates(r))} == {"a": None, "b": "a", "c": None}


def test_split_is_disjoint_and_repeatable(spark):
    r = spark.range(50).withColumnRenamed("id", "id")
    a, b = (sorted((x["id"], x["split"]) for x in rows(curation.hash_split(d, 1, {"train": 20, "validation": 10}))) for d in (r, r.repartition(7)))
    assert a == b and len({i for i, _ in a}) == 30 and sum(s == "train" for _, s in a) == 20


# -- grading -------------------------------------------------------------------------------------------


def test_bins_bands_and_strata(spark):
    r = spark.createDataFrame(list(enumerate([0.0, 0.2, 0.25, 0.5, 0.75, 0.9, 1.0, None])), "id int, solve_rate double")
    assert {x["bin"]: x["n"] for x in rows(grading.histogram(r))} == {"0": 1, "(0,0.25]": 2, "(0.25,0.5]": 1, "(0.5,0.75]": 1, "(0.75,1)": 1, "1": 1}
    assert {x["id"] for x in rows(grading.band(r, 0.25, 0.75))} == {2, 3, 4}
    assert len(rows(grading.stratify(r, 0))) == 6 and len(rows(grading.stratify(r, 0, cap=5))) == 7


@pytest.mark.parametrize("target", [0.3, 0.55, 0.9])
def test_trim_to_mean_is_the_greedy_one(spark, target):
    rng = random.Random(2)
    rates = [(i, rng.choice([0.0, 0.25, 0.5, 0.75, 1.0])) for i in range(40)]
    keep = sorted(rates, key=lambda r: (r[1], r[0]))
    mean = lambda k: sum(r for _, r in k) / len(k)
    if mean(keep) > target:
        while mean(keep) > target + 1e-12:
            keep.pop()
    else:
        while mean(keep) < target - 1e-12:
            keep.pop(0)
    got = grading.trim_to_mean(spark.createDataFrame(rates, "id int, solve_rate double"), target)
    assert {x["id"] for x in rows(got)} == {i for i, _ in keep}


def test_judge_runs_in_threads(spark):
    got = grading.judge_with(spark.createDataFrame([(1, "a"), (2, "b")], "id long, prompt string"), str.upper, 2)
    assert {x["id"]: x["judgement"] for x in rows(got)} == {1: "A", 2: "B"}


# -- segments ------------------------------------------------------------------------------------------

ASK, HELP, VERIFY, REVIEW = "go <ASK>5</ASK>", "<TEACHER_HELP>h</TEACHER_HELP>", "go <VERIFY>5</VERIFY>", "<TEACHER_REVIEW>r</TEACHER_REVIEW>"
NOTICE = "<ENVIRONMENT_NOTICE>n</ENVIRONMENT_NOTICE>"
CASES = {
    "good": ([("user", "q"), ("student", ASK), ("teacher", HELP), ("student", "x")], []),
    "accepted": ([("user", "q"), ("student", VERIFY), ("teacher", REVIEW), ("student", "<ACCEPT> x")], []),
    "notice": ([("user", "q"), ("student", ASK), ("environment", NOTICE), ("student", "x")], []),
    "source": ([("robot", "q"), ("student", "x")], ["unsupported source"]),
    "context": ([("user", "q <ASK>"), ("student", "x")], ["reserved marker in context"]),
    "interrupts": ([("user", "q"), ("student", ASK), ("user", "q"), ("teacher", HELP), ("student", "x")], ["context interrupts"]),
    "unsolicited": ([("user", "q"), ("teacher", REVIEW), ("student", "x")], ["unsolicited teacher"]),
    "mismatch": ([("user", "q"), ("student", VERIFY), ("teacher", HELP), ("student", "x")], ["teacher mismatch", "teacher foreign marker"]),
    "forged": ([("user", "q"), ("student", "x <TEACHER_HELP>")], ["student forged marker"]),
    "early": ([("user", "q"), ("student", ASK), ("student", "x"), ("teacher", HELP), ("student", "x")], ["student before observation"]),
    "several": ([("user", "q"), ("student", ASK + ASK), ("student", "x")], ["several requests"]),
    "not last": ([("user", "q"), ("student", ASK + " more"), ("teacher", HELP), ("student", "x")], ["request not last"]),
    "no review": ([("user", "q"), ("student", "<ACCEPT>")], ["accept without review"]),
    "two accepts": ([("user", "q"), ("student", VERIFY), ("teacher", REVIEW), ("student", "<ACCEPT><ACCEPT>")], ["several accepts"]),
    "missing": ([("user", "q"), ("student", ASK)], ["observation missing"]),
    "not continued": ([("user", "q"), ("student", ASK), ("teacher", HELP)], ["continuation missing"]),
    "silent": ([("user", "q")], ["no trainable text"]),
    "wrapper": ([("user", "q"), ("student", ASK), ("environment", "n"), ("student", "x")], ["notice wrapper"]),
    "empty": ([], ["no segments"]),
}


def test_every_rule_of_the_validator(spark):
    data = [(k, [(s, t, s == "student") for s, t in segs]) for k, (segs, _) in CASES.items()]
    df = spark.createDataFrame(data, "k string, segments array<struct<source:string,text:string,loss:boolean>>")
    got = {r["k"]: r["errors"] for r in rows(df.select("k", protocol.segment_errors(F.col("segments")).alias("errors")))}
    assert got == {k: want for k, (_, want) in CASES.items()}


# -- rollouts ------------------------------------------------------------------------------------------


def test_small_groups_raise(spark):
    one = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 1.0)], "uid string, score double")
    for name in ("grpo", "rloo"):
        with pytest.raises(Exception, match="two samples"):
            rows(rollouts.advantages(one, name))


def test_folds(spark):
    r = spark.createDataFrame([([1.0, 2.0, 3.0], [0.5, 0.5, 0.5], [1, 1, 0])], "r array<double>, v array<double>, m array<int>")
    got = rows(r.select(rollouts.gae(F.col("r"), F.col("v"), 0.9, 0.8).alias("g"), rollouts.discounted_returns(F.col("r"), F.col("m"), 0.5).alias("d"), rollouts.reward_on_last(F.col("m"), F.lit(9.0)).alias("l"), rollouts.position_ids(F.col("m")).alias("p")))[0]
    a2 = 3 - 0.5
    a1 = 2 + 0.9 * 0.5 - 0.5 + 0.72 * a2
    a0 = 1 + 0.9 * 0.5 - 0.5 + 0.72 * a1
    assert all(math.isclose(x, y) for x, y in zip(got["g"], [a0, a1, a2]))
    assert got["d"] == [2.0, 2.0, 3.0] and got["l"] == [0.0, 9.0, 0.0] and got["p"] == [0, 1, 1]
    t = spark.createDataFrame([([7, 3, 1, 3],), ([3, 1],), ([1, 2],)], "t array<int>")
    assert [x["m"] for x in rows(t.select(rollouts.response_mask(F.col("t"), 3).alias("m")))] == [[1, 1, 0, 0], [1, 0], [1, 1]]


# -- rewards -------------------------------------------------------------------------------------------


def event(before="", shown=None, accepted=False, action="verify", error=None):
    return (action, error, accepted, before, shown)


def test_interaction_outcomes(spark):
    right, wrong = "\\boxed{7}", "\\boxed{8}"
    cases = [
        ("useful", right, [event(wrong, right, True)], "useful_accept_count"),
        ("wrong accept", wrong, [event(right, wrong, True)], "wrong_accept_count"),
        ("unsupported", right, [event(right, "fine", True)], "unsupported_accept_count"),
        ("hidden answer", right, [event(wrong, "cut off", True)], "unsupported_accept_count"),
        ("wrong adoption", wrong, [event(right, wrong)], "wrong_implicit_adoption_count"),
        ("adoption", right, [event(wrong, right)], "implicit_adoption_count"),
        ("wrong reject", wrong, [event(wrong, right)], "wrong_reject_count"),
        ("resisted", right, [event(right, wrong)], "resist_bad_review_count"),
        ("resisted verdict", right, [event(right, "Verdict: incorrect")], "resist_bad_review_count"),
    ]
    schema = "name string, response string, ground_truth string, events array<struct<action:string,error:string,accepted:boolean,student_before_feedback:string,teacher_context_text:string>>, teacher_tokens_used long, ask_count int, verify_count int, invalid_accept_count int, invalid_protocol_count int, denied_action_count int"
    df = spark.createDataFrame([(n, r, "7", e, 96, 0, 1, 0, 0, 0) for n, r, e, _ in cases], schema)
    got = {r["name"]: r for r in rows(rewards.interaction_score(df))}
    for name, _, _, column in cases:
        counts = {f"{o}_count": got[name][f"{o}_count"] for o in rewards.OUTCOMES}
        assert counts == {c: float(c == column) for c in counts}, name
    assert math.isclose(got["wrong accept"]["overall"], -0.15 * 0.5 - 0.5)
    assert math.isclose(got["useful"]["overall"], 1 - 0.15 * 0.5)


def test_reward_plugin(spark, tmp_path):
    (tmp_path / "r.py").write_text("def score(rows, k=1):\n    return [{'overall': r['x'] * k} for r in rows]\n")
    f = rewards.load_reward(f"{tmp_path}/r.py:score", k=3)
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "uid string, x double")
    assert sorted(r["overall"] for r in rows(rewards.apply_rewards(df, f, "uid string, x double, overall double", "uid"))) == [3.0, 6.0]
    assert sorted(r["overall"] for r in rows(rewards.apply_rewards(df, f, "uid string, x double, overall double"))) == [3.0, 6.0]


def test_options_and_formats(spark):
    df = spark.createDataFrame([("<think>a</think> <answer>b</answer>", "<think>x</think> \\boxed{1}")], "a string, b string")
    got = rows(df.select(rewards.tagged_format(F.col("a")).alias("t"), rewards.boxed_format(F.col("b")).alias("b"), rewards.boxed_format(F.col("a")).alias("n")))[0]
    assert got == {"t": 1.0, "b": 1.0, "n": 0.0}
    assert rows(df.select(X.option_list(F.array(F.lit("x"), F.lit("y"))).alias("o")))[0]["o"] == "A. x\nB. y"


# -- batches -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("k", [2, 4])
def test_balanced_partitions(k):
    rng = random.Random(k)
    lengths = [rng.randint(1, 1000) for _ in range(32)]
    for equal in (True, False):
        parts = batches.karmarkar_karp(lengths, k, equal)
        assert sorted(i for p in parts for i in p) == list(range(32)) and all(p == sorted(p) for p in parts)
        assert not equal or {len(p) for p in parts} == {32 // k}
        sums = [sum(lengths[i] for i in p) for p in parts]
        assert max(sums) - min(sums) < max(lengths) / 2
    with pytest.raises(ValueError):
        batches.karmarkar_karp([1, 2, 3], 2, True)
    assert sorted(i for p in batches.least_loaded(lengths, k, True) for i in p) == list(range(32))


def test_a_reward_by_summaries_never_holds_a_group(spark, monkeypatch):
    """One group of 1,000 rows and a null one: the function sees at most PIECE rows at a time and still scores by the whole group."""
    most = rewards.PIECE

    def best(some, summary):
        assert len(some) <= most
        return [{"reward": float(r["x"] == summary)} for r in some]

    best.summary, best.merge = (lambda some: max(r["x"] for r in some)), max
    df = spark.range(1005).selectExpr("IF(id < 1000, 'a', NULL) AS uid", "id AS x").repartition(3)
    got = {r["x"]: r["reward"] for r in rows(rewards.apply_rewards(df, best, "uid string, x long, reward double", "uid"))}
    assert len(got) == 1005 and {x for x, r in got.items() if r} == {999, 1004}


def test_balancing_is_never_worse_than_the_blocks():
    rng, worse = random.Random(3), 0
    for n in (8, 12, 64, 5, 2):
        for _ in range(300):
            lengths = [int(9 * rng.paretovariate(0.6)) for _ in range(n)]
            spread = lambda parts: max(s := [sum(lengths[i] for i in p) for p in parts if p]) - min(s)
            own, plain = batches.even_parts(lengths, 4, n % 4 == 0), [[i for i in range(n) if i * 4 // n == j] for j in range(4)]
            assert spread(own) <= spread(plain) and sorted(i for p in own for i in p) == list(range(n))
            assert n % 4 or {len(p) for p in own} == {n // 4}
            worse += spread(batches.karmarkar_karp(lengths, 4, n % 4 == 0)) > spread(plain)
    assert worse  # differencing alone is


def test_the_least_loaded_part_keeps_its_place():
    """Fewer rows than parts, or rows of length 0: the parts are those that the running sums name."""
    for lengths in ([7, 3], [0, 0, 0], [5, 0, 0, 1, 9], []):
        sums, want = [0] * 4, [[] for _ in range(4)]
        for i, n in enumerate(lengths):
            j = sums.index(min(sums))
            want[j].append(i)
            sums[j] += n
        assert batches.least_loaded(lengths, 4) == want


@pytest.mark.parametrize("n,d", [(6, 4), (6, 3), (2, 7), (1, 5)])
def test_pad_and_unpad(spark, n, d):
    df = spark.range(n).selectExpr("id AS ord", "id * 10 AS x")
    got = sorted(rows(batches.pad_to(df, d)), key=lambda r: r["ord"])
    assert len(got) % d == 0 and [r["ord"] for r in got] == list(range(len(got))) and all(r["x"] == r["ord"] % n * 10 for r in got)
    assert batches.unpad(batches.pad_to(df, d)).count() == n


def test_unequal_columns_raise(spark):
    df = spark.range(3).selectExpr("id AS ord", "id AS x")
    with pytest.raises(Exception, match="differs"):
        rows(batches.union_columns(df, df.selectExpr("ord", "x + 1 AS x")))
    with pytest.raises(Exception, match="divide"):
        rows(batches.chunk(df, 2))


# -- traces --------------------------------------------------------------------------------------------


def test_cheap_success_wins(spark):
    df = spark.createDataFrame([("q", 1.0, 100, 1, 0, 0, 0, 0), ("q", 1.0, 10, 1, 0, 0, 0, 1), ("q", 0.0, 0, 0, 0, 0, 0, 2)], "question string, score double, teacher_tokens_used long, ask_count int, verify_count int, invalid_accept_count int, denied_action_count int, ord long")
    best = traces.best_per_problem(df.withColumn("utility", traces.utility()), 2)
    assert [(r["id"], r["ord"]) for r in sorted(rows(best), key=lambda r: r["id"])] == [("outcome_0000000_0", 1), ("outcome_0000000_1", 0)]
    with pytest.raises(ValueError):
        traces.utility(budget=0)


def test_dense_index(spark):
    keys = spark.createDataFrame([(f"k{i:03d}",) for i in range(57)], "k string").repartition(5)
    assert sorted((r["k"], r["n"]) for r in rows(traces.dense_index(keys, "k", "n"))) == [(f"k{i:03d}", i) for i in range(57)]


# -- dialogues -----------------------------------------------------------------------------------------


def talk(lines, replies, **rules):
    lines, replies = iter(lines), iter(replies)
    return dialogues.play([(1, "Q")], lambda p, n: [next(lines) for _ in p], lambda p, n: [next(replies) for _ in p], dialogues.Rules(**rules))[0]


def test_dialogue_paths():
    r = talk(["a <ASK>9</ASK>", "b <VERIFY>0</VERIFY>", "<ACCEPT> c <ACCEPT>"], [{"text": "hint", "tokens": 3}, {"text": "ok", "tokens": 2}])
    assert (r.counts["ask_count"], r.counts["verify_count"], r.counts["accept_count"], r.counts["invalid_accept_count"], r.counts["teacher_tokens_used"]) == (1, 1, 1, 1, 5)
    assert [e["requested_budget_tokens"] for e in r.events] == [9, 96] and r.events[1]["accepted"]
    r = talk(["<ASK>9</ASK>", "end"], [{"text": "the final answer is 3"}])
    assert r.events[0]["error"] == "help disclosed an answer" and r.events[0]["observation_status"] == "delivered_environment_notice"
    r = talk(["<ASK>9</ASK>", "end"], [{"text": None, "error": "down"}])
    assert r.segments[1]["source"] == "environment" and r.text.endswith("end")
    r = talk(["<ASK>9</ASK>", "<ASK>9</ASK>", "<ASK>1</ASK> end"], [{"text": "h"}], most_interactions=1)
    assert r.counts["denied_action_count"] == 2 and r.counts["ask_count"] == 1
    r = talk(["draft", "after"], [{"text": "fine"}], mode="force_verify_after_draft")
    assert r.events[0]["forced"] and r.events[0]["accepted"] is False
    r = talk(["draft <ASK>1</ASK>"], [], mode="force_verify_after_draft")
    assert r.collection_error == "action in the first draft"
    r = talk(["x <ASK>1</ASK>"], [], mode="independent")
    assert r.counts["denied_action_count"] == 1 and r.collection_error
    r = talk(["y"], [{"text": "</VERIFY>"}], mode="force_ask_first", profile="eval")
    assert r.events[0]["error"] == "reserved marker </VERIFY>"
    r = talk(["y"], [{"text": "</VERIFY>"}], mode="force_ask_first", profile="train")
    assert r.events[0]["error"] is None
    r = talk(["<ASK>90</ASK>", "z"], [{"text": "t" * 90}], most_tokens=100)
    assert r.events[0]["feedback_truncated"] and r.events[0]["applied_budget_tokens"] < 90
    with pytest.raises(ValueError):
        dialogues.Rules(mode="force_ask_first", most_interactions=0)
    with pytest.raises(ValueError):
        dialogues.play([(1, "Q")], lambda p, n: [], lambda p, n: [], dialogues.Rules())


def test_similarity_join_against_all_pairs(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 90))) for _ in range(40)]
    texts = base + [t + " end" for t in base] + [t[: len(t) // 2] + "#" + t[len(t) // 2 :] for t in base] + ["", "ab", "abcde", "abcdef"]
    grams = lambda t: {t[i : i + 5] for i in range(len(t) - 4)} if len(t) > 5 else {t}
    sets = [grams(t) for t in texts]
    want = {(i, j) for j in range(len(texts)) for i in range(j) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.85}
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = rows(curation.similarity_join(curation.gram_sets(df, "i", "t"), None, 0.85))
    assert {(r["left_id"], r["right_id"]) for r in got} == want and len(want) > 40
    assert all(r["overlap"] == len(sets[r["left_id"]] & sets[r["right_id"]]) for r in got)
    cross = rows(curation.similarity_join(curation.gram_sets(df.where("i < 40"), "i", "t"), curation.gram_sets(df.where("i >= 40"), "i", "t"), 0.85))
    assert {(r["left_id"], r["right_id"]) for r in cross} == {(i, j) for i, j in want if i < 40 <= j}


def near_texts(copies: int = 4) -> list[str]:
    """Texts of 60 to 1,500 characters and copies that are cut, lengthened or changed here and there, to both sides of a similarity of 0.85."""
    rng, texts = random.Random(5), []
    for k in range(40):
        base = "".join(rng.choice("abcdefgh ") for _ in range(rng.choice([60, 200, 640, 1500])))
        texts.append(base)
        for c in range(copies):
            t = list(base[: len(base) - rng.randrange(1 + len(base) // 8)] if c % 2 else base + base[:1].upper() * (c * 3))
            for _ in range(rng.randrange(1 + len(t) // 45)):
                t[rng.randrange(len(t))] = rng.choice("xyz")
            texts.append("".join(t))
    return texts


@pytest.mark.parametrize("sheet", [1 << 20, 1 << 14])
def test_groups_of_grams_lose_no_pair(spark, monkeypatch, sheet):
    """All blocks by groups of grams, in one cell or many, on one sheet or many, with pairs that leave before all are found: the pairs are those of all pairs."""
    monkeypatch.setattr(curation, "FEW", 0)
    monkeypatch.setattr(curation, "FOUND", 8)
    monkeypatch.setattr(curation, "SHEET", sheet)
    texts = near_texts()
    grams = [set(curation.grams_of(t).tolist()) for t in texts]
    alike = {(i, j): len(x & y) / len(x | y) for j, y in enumerate(grams) for i, x in enumerate(grams[:j])}
    want = {p for p, x in alike.items() if x >= 0.85}
    got = rows(curation.similarity_join(curation.gram_sets(spark.createDataFrame(list(enumerate(texts)), "i long, t string"), "i", "t"), None, 0.85))
    found = [(r["left_id"], r["right_id"]) for r in got]
    assert set(found) == want and len(found) == len(want) > 100 and sum(0.75 < x < 0.85 for x in alike.values()) > 10
    assert all(r["overlap"] == len(grams[r["left_id"]] & grams[r["right_id"]]) for r in got)


def test_groups_of_grams_name_few_other_pairs():
    """Of texts of one language, groups name all pairs at the threshold and few others, so that the work does not follow all pairs."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 7))) for _ in range(400)]
    texts = [" ".join(rng.choice(words, 180)) for _ in range(300)]
    texts += [t[: len(t) - 30] for t in texts[:50]]
    grams = [curation.grams_of(t) for t in texts]
    n = [len(g) for g in grams]
    groups = 2 * max(n) * 15 // 185 // (curation.RADIUS + 1) + 1
    keys = np.stack([curation.group_keys(g, groups) for g in grams]).reshape(len(texts), groups, curation.SUBS)
    named = set(np.concatenate(list(curation.alike(keys))).tolist())
    near = {i * len(texts) + 300 + i for i in range(50)}
    assert near <= named and len(named) < 0.02 * len(texts) ** 2 / 2


def test_blocks_of_a_large_table():
    """Ten million texts of common sizes: sheets are bounded, and only the longest texts are held against each other, in many cells."""
    step = -math.log(0.85)
    sizes = {b: (200_000, math.ceil(math.exp(b * step)), math.floor(math.exp((b + 1) * step))) for b in range(30, 60)}
    blocks = curation.own_blocks(sizes, 0.85)
    for b, (parts, groups, each, words) in blocks.items():
        rows_ = (400_000 if b > 30 else 200_000) * (1 if parts == 1 else 2 / parts)
        assert rows_ * (8 * words + 2 * curation.SUBS * each) <= curation.SHEET * 1.01
        assert 64 * words >= 64 and 64 * words <= max(64, 2 * sizes[b][1])
        if sizes[b][2] <= curation.LONG:
            assert (curation.RADIUS + 1) * groups > 2 * sizes[b][2] * 0.15 / 1.85
        else:
            assert not groups and rows_**2 * words <= 4.1 * curation.MET


def test_near_duplicates_keep_no_second_copy_of_texts(spark):
    """Gram sets hold the texts; records and classes have left the disk when pairs are sought, and members are joined without texts."""
    from pathlib import Path

    from corpusloom.plans import curation as plans
    from corpusloom.scratch import shared_root

    root = Path(shared_root(spark).removeprefix("file:"))
    before = {p.name for p in root.glob("*")}
    got = plans.j2(spark, "/root/testdata/sf0.001")
    assert sorted({p.name.rsplit("-", 1)[0] for p in root.glob("*") if p.name not in before}) == ["candidates", "grams", "members", "similar"]
    assert got.count() > 200 and {"norm", "text"}.isdisjoint(got.columns)


def test_gram_sets_hold_no_grams(spark):
    """A text is staged with the number of its grams and a bit or two for each, never with the grams; halves fold to smaller bitmaps."""
    text = "".join(random.Random(4).choice("abcdefgh ") for _ in range(3000))
    r = curation.gram_sets(spark.createDataFrame([(1, text), (2, "ab"), (3, "")], "i long, t string"), "i", "t").orderBy("id").collect()
    assert [x.n for x in r] == [len({text[i : i + 5] for i in range(2996)}), 1, 1] and all(set(x.asDict()) == {"id", "text", "n", "bits"} for x in r)
    assert all(x.n <= 8 * len(x.bits) <= max(64, 2 * x.n) for x in r)
    own = curation.parity_bits(g := curation.grams_of(text))
    half = len(own) // 2
    assert ((own[:half] ^ own[half:]) == [sum(1 << b for b in range(8) if ((g.view("uint64") % (8 * half)) == 8 * k + b).sum() % 2) for k in range(half)]).all()


def test_gram_counts_hold_neither_texts_nor_parities(spark, monkeypatch):
    """The counts of gram_sets in portions of few bytes; f3 stages records and classes, nothing of their grams."""
    from corpusloom.plans import curation as plans

    monkeypatch.setattr(curation, "PORTION", 40)
    texts = ["".join(random.Random(k).choice("abc ") for _ in range(k)) for k in range(70)] + [None, "é" * 9]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").coalesce(1)
    got = curation.gram_counts(rows, "i", "t")
    assert got.columns == ["id", "n"]
    assert {r.id: r.n for r in got.collect()} == {r.id: r.n for r in curation.gram_sets(rows, "i", "t").collect()} == {i: max(1, len({t[k : k + 5] for k in range(len(t) - 4)})) for i, t in enumerate(x or "" for x in texts)}
    staged, stage = [], plans.stage
    for module in (curation, plans):
        monkeypatch.setattr(module, "stage", lambda df, name: (staged.append(name), stage(df, name))[1])
    assert plans.f3(spark, "/root/testdata/sf0.001").count() > 200
    assert staged == ["records", "classes"]


def test_numbered_is_one_order_over_wide_rows_and_many_partitions(spark):
    """Ordinal and payload used together; ranges come from one sampling."""
    from corpusloom.operators.batches import numbered
    from corpusloom.operators.traces import dense_index

    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        rows = spark.range(60_000).select(F.xxhash64("id").alias("k"), "id", F.repeat(F.sha2(F.col("id").cast("string"), 256), 3).alias("wide"))
        got = numbered(rows, ["k"]).withColumn("next", F.lead("k").over(W.orderBy("ord")))
        n, distinct, low, high, wrong, wide = got.agg(F.count("*"), F.count_distinct("ord"), F.min("ord"), F.max("ord"), F.count_if(F.col("next") < F.col("k")), F.count_distinct("wide")).first()
        assert (n, distinct, low, high, wrong, wide) == (60_000, 60_000, 0, 59_999, 0, 60_000)
        assert dense_index(rows.select("k").distinct(), "k", "i").agg(F.count_distinct("i"), F.max("i")).first()[:] == (60_000, 59_999)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_feedback_fits_the_budget_whatever_tokens_count():
    """Tokens of parts need not add up: here every started run of four characters is one."""
    from corpusloom.operators import dialogues as D

    rules = D.Rules(most_tokens=20, tokens=lambda t: -(-len(t) // 4), cut=lambda t, n: t[: 4 * n])
    for context in ("", "abc", "abcdefg"):
        for size in range(60):
            text = "x" * size
            fit = [n for n in range(size // 4 + 2) if rules.tokens(context + D.wrap("ask", rules.cut(text, n))) <= 20]
            want = text if rules.tokens(context + D.wrap("ask", text)) <= 20 else rules.cut(text, max(fit, default=0))
            assert D.fitted(context, "ask", text, rules) == want
    assert D.fitted("c" * 99, "ask", "text", D.Rules(profile="train", most_tokens=50)) == ""


def test_training_rollouts_mask_what_the_student_did_not_write(spark):
    from corpusloom.operators import dialogues as D

    asked = spark.createDataFrame([(1, "Q"), (2, "Qu")], "id long, prompt string")
    rules = D.Rules(mode="force_verify_after_draft", profile="train", most_tokens=400)
    student = lambda prompts, limits: ["<ACCEPT> b" if "TEACHER" in p else "a" * len(p) for p in prompts]
    for length in (8, 400):
        got = {r["id"]: r for r in rows(D.training_rollouts(asked, student, D.stub_teacher, rules, length))}
        for k in (1, 2):
            own = [s["loss"] for s in got[k]["segments"] for _ in s["text"]][:length]
            assert len(got[k]["policy_mask"]) == length and got[k]["policy_mask"] == [int(x) for x in own] + [0] * (length - len(own))
            assert got[k]["policy_mask"][: k + 1] == [1] * k + [0]  # the draft, then the forced tag
    assert D.training_rollouts(asked.where("false"), student, D.stub_teacher, rules, 8).count() == 0


def test_first_description_wins(spark):
    a, b = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(2, "x")], "k int, s string")
    both, meta = batches.concat_with_meta([(a, {"of": "a"}), (b, {"of": "b", "more": 1})])
    assert sorted((r["k"], r["s"]) for r in rows(both)) == [(1, None), (2, "x")] and meta == {"of": "a"}


def test_staging_leaves_the_session_as_it_was(spark):
    from corpusloom.scratch import CLEANUP, stage

    before = spark.conf.get(CLEANUP, None)
    assert stage(spark.range(10).repartition(3), "t").df.count() == 10 and spark.conf.get(CLEANUP, None) == before
    spark.conf.set(CLEANUP, "false")
    with pytest.raises(Exception, match="stop here"):
        stage(spark.range(1).select(F.raise_error(F.lit("stop here"))), "t")
    assert spark.conf.get(CLEANUP, None) == "false"
    spark.conf.unset(CLEANUP)
