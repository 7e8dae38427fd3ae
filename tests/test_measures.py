"""Answers by value, boxes, real tokens, long recurrences and barrier stages against plain definitions."""

import random
import time
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import equivalence as E
from corpusloom.functions import tokens as K
from corpusloom.functions.text import balanced_boxed
from corpusloom.operators import gather, rollouts, scans

SAME = [
    ("1/2", "0.5"), ("\\frac12", "\\dfrac{1}{2}"), ("2\\frac12", "5/2"), ("1,234,567.50", "1234567.5"), ("50%", "\\frac{1}{2}"), ("50\\%", "0.5"), ("x = 7", "7"), ("$\\frac{x^2-1}{x-1}$", "x+1"),
    ("\\frac{1}{\\sqrt2}", "\\frac{\\sqrt{2}}{2}"), ("\\sqrt{12}", "2\\sqrt{3}"), ("\\sqrt2\\sqrt3", "\\sqrt6"), ("(1, 2/4)", "\\left(1,\\frac12\\right)"), ("\\{1,2\\}", "\\{2, 1.0\\}"), ("[0,1)", "[0, 1)"),
    ("90^\\circ", "90"), ("5\\text{ cm}", "5"), ("(x+1)^3", "x^3+3x^2+3x+1"), ("2\\pi r", "r \\cdot 2\\pi"), ("-(-3)", "3"), ("x^{-2}", "1/x^2"), ("yes.", "YES"), ("0", "-0.00"), ("3 \\times 10^{4}", "30000"),
]
OTHER = [("1/2", "0.51"), ("x+1", "x-1"), ("(1,2)", "(2,1)"), ("(1,2)", "[1,2]"), ("\\{1,2\\}", "\\{1,3\\}"), ("\\sqrt2", "1.41421356"), ("1/0", "0"), ("yes", "no"), ("x", "y"), ("12", "1 2 3"), ("x^{1000}", "x^{1001}"), ("9" * 70, "9" * 71)]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(a, b):
    assert E.same_answer(a, b) and E.same_answer(b, a)


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_other(a, b):
    assert not E.same_answer(a, b) and not E.same_answer(b, a) and E.same_answer(a, a)


def test_values_at_random_points():
    rng = random.Random(2)

    def made(depth):
        if not depth or rng.random() < 0.2:
            return rng.choice([("x", lambda x, y: x), ("y", lambda x, y: y), *[(str(k), lambda x, y, k=k: Fraction(k)) for k in (1, 2, 7)], ("0.25", lambda x, y: Fraction(1, 4))])
        (s, f), (t, g) = made(depth - 1), made(depth - 1)
        return rng.choice([
            (f"({s})+({t})", lambda x, y: f(x, y) + g(x, y)), (f"({s})-({t})", lambda x, y: f(x, y) - g(x, y)), (f"({s})({t})", lambda x, y: f(x, y) * g(x, y)),
            (f"\\frac{{{s}}}{{({t})^2+1}}", lambda x, y: f(x, y) / (g(x, y) ** 2 + 1)), (f"({s})^2", lambda x, y: f(x, y) ** 2),
        ])

    texts = [made(3) for _ in range(60)]
    points = [(Fraction(rng.randint(-99, 99), 7), Fraction(rng.randint(-99, 99), 11)) for _ in range(4)]
    values = [[f(*p) for p in points] for _, f in texts]
    equal = 0
    for i, (s, _) in enumerate(texts):
        for j, (t, _) in enumerate(texts):
            equal += i < j and values[i] == values[j]
            assert E.same_answer(s, t) == (values[i] == values[j]), (s, t)
    assert equal > 5


def test_boxes():
    assert balanced_boxed("İİ \\BOXED{7} end", True) == "7" and balanced_boxed("\\BOXED{7}") is None
    assert balanced_boxed("}{ \\boxed{a{b}c} \\boxed { \\boxed{d}") == "d" and balanced_boxed(None) is None
    began = time.time()
    assert balanced_boxed("\\boxed{1}" + "\\boxed{" * 200_000, True) == "1"
    assert time.time() - began < 5


def test_token_labels(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["ab ", "é", "漢", "\n", "cde", "<|endoftext|>", "😀"]) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    spans = [[tuple(sorted((rng.randint(0, len(t)), rng.randint(0, len(t))))) for _ in range(rng.randint(0, 5))] for t in texts]
    rows = spark.createDataFrame([(k, t, [{"start": a, "end": b} for a, b in s]) for k, (t, s) in enumerate(zip(texts, spans))] + [(99, None, None)], "k int, text string, spans array<struct<start: int, end: int>>")
    got = rows.select("k", K.tokens(F.col("text")).alias("t"), K.labels(F.col("text"), F.col("spans")).alias("l"), K.token_count(F.col("text")).alias("n"), K.within(F.col("text"), 20).alias("few"), K.labels(F.col("text"), F.col("spans"), most=3).alias("cut"))
    for r in got.collect():
        if r.k == 99:
            assert (r.n, r.few, list(r.l.labels)) == (None, False, [])
            continue
        want = [i if b > a and any(a >= x and b <= y for x, y in spans[r.k]) else -100 for i, a, b in zip(*r.t)]
        assert list(r.l.labels) == want and list(r.l.ids) == list(r.t.ids) and r.n == len(r.t.ids) and r.few == (r.n <= 20)
        assert list(r.cut.labels) == want[:3] and r.cut.truncated == (r.n > 3)
        assert max(r.t.ends, default=0) == len(texts[r.k])


@pytest.mark.parametrize("block", [3, 7, 1 << 16])
def test_scans_are_the_folds(spark, block):
    rng = random.Random(5)
    seqs = {k: [(rng.random(), rng.random(), rng.randint(0, 1)) for _ in range(n)] for k, n in (("a", 40), ("b", 1), (None, 23), ("c", 7))}
    rows = spark.createDataFrame([(k, i, *x) for k, s in seqs.items() for i, x in enumerate(s)], "key string, place long, reward double, value double, mask int")
    lists = spark.createDataFrame([(k, *map(list, zip(*s))) for k, s in seqs.items()], "key string, reward array<double>, value array<double>, mask array<int>")
    for out, fold in ((scans.gae(rows, 0.9, 0.8, block), rollouts.gae(F.col("reward"), F.col("value"), 0.9, 0.8)), (scans.discounted_returns(rows, 0.7, block), rollouts.discounted_returns(F.col("reward"), F.col("mask"), 0.7))):
        got = {}
        for r in out.collect():
            got.setdefault(r.key, {})[r.place] = r.y
        for r in lists.select("key", fold.alias("y")).collect():
            assert [got[r.key][i] for i in range(len(r.y))] == pytest.approx(r.y)
    assert scans.gae(rows.limit(0), 0.9, 0.8).count() == 0


def test_a_million_steps(spark):
    began = time.time()
    rows = spark.range(1_000_000).select(F.lit("one").alias("key"), F.col("id").alias("place"), F.lit(1.0).alias("mult"), F.lit(1.0).alias("add"))
    out = scans.affine_scan(rows).agg(F.sum("y"), F.max("y"), F.count("*")).first()
    assert tuple(out) == (500_000_500_000.0, 1_000_000.0, 1_000_000) and time.time() - began < 60


@pytest.mark.parametrize("keep", [gather.KEEP, 100])
def test_barrier_whitening(spark, keep):
    rng = np.random.default_rng(3)
    data = [(k, None if k % 17 == 3 else [None if k % 13 == 2 and j == 0 else float(x) for j, x in enumerate(rng.normal(3, 2, k % 5))]) for k in range(120)]
    rows = spark.createDataFrame(data, "k long, v array<double>").repartition(5)
    flat = np.array([x for _, v in data if v for x in v if x is not None])
    got = sorted((r.k, r.ord, r.v) for r in gather.whitened(rows, "k", "v", keep=keep).collect())
    assert [g[1] for g in got] == list(range(120))
    for (_, v), (_, _, w) in zip(data, got):
        assert (w is None) == (v is None)
        for x, y in zip(v or [], w or []):
            assert y == (None if x is None else pytest.approx((x - flat.mean()) / np.sqrt(flat.var(ddof=1) + 1e-8)))


def test_nested_and_flat_columns(spark):
    from corpusloom.functions import config as G

    rows = spark.createDataFrame([(1, 2, "x"), (None, None, None)], "`a.b` int, `a.c.d` int, e string")
    nested = G.nested_columns(rows)
    assert nested.columns == ["a", "e"] and nested.first().a.c.d == 2
    assert G.flat_columns(nested).columns == rows.columns and G.flat_columns(nested).collect() == rows.collect()
    for names in ("a int, `a.b` int", "`a.b` int, a int"):
        with pytest.raises(ValueError, match="name"):
            G.nested_columns(spark.createDataFrame([], names))


def test_snapshots_stream(spark):
    import hashlib
    import json

    from corpusloom.operators import curation

    rng = random.Random(6)
    data = [(f"s{k % 3}", rng.choice(["a", 'b "q"', "é\n", "漢", "", "z" * 9, f"t{k}"])) for k in range(60)] + [("only empty", "")]
    rows = spark.createDataFrame(data, "source string, norm string").repartition(3)
    sets = {}
    for s, t in data:
        sets.setdefault(s, set()).update({t} - {""})
    got = {r.source: (r.questions, r.unique_questions, r.sha256) for r in curation.snapshot(rows).collect()}
    order = lambda x: sorted(x, key=lambda t: t.encode())
    assert got == {s: (sum(a == s for a, _ in data), len(t), hashlib.sha256("\n".join(order(t)).encode()).hexdigest()) for s, t in sets.items()}
    text = json.dumps({s: order(sets[s]) for s in sorted(sets)}, ensure_ascii=False)
    assert curation.combined_hash(rows).first().combined == hashlib.sha256(text.encode()).hexdigest()
    assert curation.combined_hash(rows.limit(0)).first().combined == hashlib.sha256(b"{}").hexdigest()


def test_rounding_keeps_the_sign_of_zero(spark):
    """As SQL's round: -0.0000001 is -0.0 at six digits, alone and in the arrays of recurrences and whitening."""
    from corpusloom.plans.base import rounded
    from corpusloom.plans.rollouts import rounded as every

    values = [-1e-7, 1e-7, -0.0, 0.0, -2e-6, None, 0.1234567]
    r = spark.createDataFrame([(values, -4e-7)], "v array<double>, x double").select(every("v").alias("v"), rounded(F.col("x")).alias("x")).first()
    assert list(map(repr, r.v)) == ["-0.0", "0.0", "-0.0", "0.0", "-2e-06", "None", "0.123457"] and repr(r.x) == "-0.0"


def test_whitening_rounds_to_the_zero_that_sql_gives(spark):
    from corpusloom.plans.rollouts import rounded as every

    df = rollouts.whiten(spark.createDataFrame([([1.0, -1.0, -1e-8], [1, 1, 1])], "v array<double>, m array<int>"), "v", "m")
    assert list(map(repr, df.select(every("v").alias("v")).first().v)) == ["1.0", "-1.0", "-0.0"]


def test_moments_of_long_tables_keep_their_digits(spark):
    """200,000 rows of one partition: the mean by one sum over them is off by over 1e-14, by sums of blocks it is not; groups as before."""
    rows = spark.range(0, 200_000, 1, 1).select(F.array(F.lit(0.1), F.lit(7.0)).alias("v"), F.array(F.lit(1), F.lit(0)).alias("m"), (F.col("id") % 2).alias("k"))
    got = rollouts.masked_moments(rows, "v", "m").first()
    assert got.n == 200_000 and abs(got.mean - 0.1) < 5e-15 and abs(rows.agg(F.sum(F.col("v")[0])).first()[0] / 200_000 - 0.1) > 1e-14
    assert sorted((r.k, r.n) for r in rollouts.masked_moments(rows, "v", "m", ["k"]).collect()) == [(0, 100_000), (1, 100_000)]
    assert tuple(rollouts.masked_moments(rows.limit(0), "v", "m").first())[:2] == (None, None)


def test_labelled_rows_leave_in_pieces(spark):
    """Tokens and labels as the columns give them, null and empty texts too; no more than a piece of rows is encoded ahead."""
    from corpusloom.functions import tokens as K

    data = [(k, [None, "", "Ünï 漢 two", "plain words here"][k % 4], [(0, 5), (6, 11)] if k % 3 else None) for k in range(200)]
    rows = spark.createDataFrame(data, "k long, text string, spans array<struct<start: int, end: int>>").coalesce(1)
    t, own = K.tokens(F.col("text")), K.labels(F.col("text"), F.col("spans"))
    want = rows.select("k", "spans", t["ids"], t["starts"], t["ends"], own["labels"]).collect()
    assert [tuple(r) for r in K.labelled(rows, "text", "spans").collect()] == [tuple(r) for r in want]
    cut = rows.select(K.labels(F.col("text"), F.col("spans"), most=2).alias("c"), t["ids"].alias("ids")).collect()
    assert all(r.c.ids == r.ids[:2] and r.c.truncated == (len(r.ids) > 2) for r in cut)


def test_cells_between_two_tables(spark, monkeypatch):
    """Cells hold CELL rows of each side, however many the left has; pairs are those of all pairs, for sizes that differ by a range too."""
    from corpusloom.operators import curation as C

    parts = C.block_parts({(5, 0): 10_000_000, (5, 1): 200, (9, 0): 7}, False)
    assert parts == [(5, 5, False, -(-10_000_000 // C.CELL), 1)]
    monkeypatch.setattr(C, "CELL", 5)
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(60, 140))) for _ in range(12)]
    texts = [(k, b[: len(b) - k % 9] + "".join(rng.choice("xyz") for _ in range(k % 4))) for k, b in enumerate(base * 6)]
    sides = [texts[:60], [(k, t) for k, t in texts[60:]] + [(500 + k, b) for k, b in enumerate(base)]]
    grams = [{k: set(C.grams_of(t).tolist()) for k, t in side} for side in sides]
    want = {(a, b) for a, x in grams[0].items() for b, y in grams[1].items() if len(x & y) / len(x | y) >= 0.85}
    made = [C.gram_sets(spark.createDataFrame(side, "id long, text string"), "id", "text") for side in sides]
    got = [(r.left_id, r.right_id) for r in C.similarity_join(*made).collect()]
    assert len(got) == len(set(got)) and set(got) == want and 50 < len(want) < 700


def test_numbers_take_no_polynomial_products(monkeypatch):
    """Products by a number leave monomials as they are, and plain decimals need no parser; values stay what they were."""
    x = {(("x", 2),): 3, ((6, 1),): Fraction(1, 2)}
    assert E.times(x, {(): 1}) == x and E.times({(): Fraction(2, 3)}, x) == {(("x", 2),): 2, ((6, 1),): Fraction(1, 3)}
    assert E.times(x, {}) == {} and E.Value({(): 7}, {(): 2}).rational() == Fraction(7, 2)
    with pytest.raises(E.Unreadable):
        E.times({(): E.LARGEST}, {(): 2})
    monkeypatch.setattr(E, "_monomial", lambda *_: 1 / 0)
    monkeypatch.setattr(E.Parser, "__init__", (lambda init: lambda self, t: init(self, t) if "." not in t else 1 / 0)(E.Parser.__init__))
    assert E.same_answer("\\dfrac{370368}{3 \\cdot 10^{2}}", "1234.56") and not E.same_answer("(123457) / (50 + 50)", "1234.56")
    assert E.same_answer("0", "0.00") and E.same_answer("007", "7.0")
