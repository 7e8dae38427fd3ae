import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import config as C
from corpusloom.functions import text as X


def value(spark, column, **columns):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()]) if columns else spark.range(1)
    return row.select(column.alias("v")).first().v


def one(spark, f, text, **kw):
    return value(spark, f(F.col("x"), **kw), x=text)


def test_question_spellings_meet(spark):
    a = "What is  ( 1 + 2 )?\nPlease reason step by step."
    assert one(spark, X.normalize_question, a) == one(spark, X.normalize_question, "WHAT is (1+2) ?") == "what is(1+2)?"
    assert one(spark, X.normalize_question, "Find x = 3 .\nPut your final answer in a box") == "find x=3."
    assert one(spark, X.normalize_question, "A\\nPlease reason step by step") == "a"
    assert one(spark, X.normalize_question, "Ｆｕｌｌ ß") == unicodedata.normalize("NFKC", "Ｆｕｌｌ ß").casefold()


@pytest.mark.parametrize("text,want", [("\\boxed{1} then \\boxed{ {a}{b} }", "{a}{b}"), ("\\boxed{\\boxed{2}}", "2"), ("\\boxed{open", None), ("none", None), (None, None), ("\\boxed {3}", "3"), ("\\boxed{1} \\boxed{2", "1")])
def test_last_boxed(spark, text, want):
    assert X.balanced_boxed(text) == want
    if text is not None:
        assert one(spark, X.last_boxed, text) == want


def test_grams(spark):
    assert sorted(one(spark, X.char_ngrams, "abcdefab")) == sorted({"abcde", "bcdef", "cdefa", "defab"})
    assert one(spark, X.char_ngrams, "abc") == ["abc"]
    assert one(spark, X.char_ngrams, "ab\ncdé") == ["ab\ncd", "b\ncdé"]


@pytest.mark.parametrize("f,text,want", [
    (X.clean_gold_answer, " 42.,; ", "42"), (X.incorrect_answer, "41", "42"), (X.incorrect_answer, "1,000", "1001"), (X.incorrect_answer, "1.5", "2.5"), (X.incorrect_answer, "x", "(x)+1"),
    (X.normalize_answer, " A b. ", "ab"), (X.help_hint, "\\boxed{1}\n  Second line \n", "Second line"), (X.help_hint, "\\boxed{1}", "Set up the governing equation before simplifying."),
    (X.clean_solution, " <ask>x</ASK> y ", "x y"), (X.user_prompt, "Q  ", "Q\nPlease reason step by step, and put your final answer within \\boxed{}."), (X.user_prompt, "Please reason step by step: Q", "Please reason step by step: Q"),
    (X.normalize_final_answer, "x = \\frac12", "\\frac{1}{2}"), (X.normalize_final_answer, "the answer is 1,234 dollars", "theansweris1,234"), (X.judgement, "  Yes, same", "yes"),
    (X.trim_u, "\u00a0a\u2003", "a"),
])
def test_functions(spark, f, text, want):
    assert one(spark, f, text) == want


def test_markers(spark):
    assert one(spark, X.exact_wrapper, "<TEACHER_HELP>x</TEACHER_HELP>", opening="<TEACHER_HELP>", closing="</TEACHER_HELP>")
    assert not one(spark, X.exact_wrapper, "</TEACHER_HELP>x<TEACHER_HELP>", opening="<TEACHER_HELP>", closing="</TEACHER_HELP>")
    assert one(spark, X.context_marker_count, "<TEACHER_HELP></TEACHER_REVIEW><ASK>") == 2
    assert one(spark, X.leaks_answer, "so \\Boxed {1}") and not one(spark, X.leaks_answer, "hint")
    with pytest.raises(Exception, match="unreadable"):
        one(spark, X.judgement, "maybe")


def test_config():
    tree = {"a": {"b": 1, "c": {"d": 2}}, "e": {}}
    assert C.flatten(tree) == {"a.b": 1, "a.c.d": 2, "e": {}}
    assert C.unflatten(C.flatten(tree)) == tree
    assert C.override(tree, {"a.b": 5, "a.c": {"x": 1}, "f.g": 2}) == {"a": {"b": 5, "c": {"x": 1}}, "e": {}, "f": {"g": 2}}
    with pytest.raises(ValueError):
        C.override(tree, {"a.b.z": 1})
    assert C.broken_rules(C.flatten(tree), {"b": ("a.b", lambda v: v > 3), "d": ("a.c.d", lambda v: v == 2), "z": ("z", bool)}) == ["b", "z"]
    assert C.assign_round_robin(["x", "y", "z"], [0, 1]) == {"x": 0, "y": 1, "z": 0}


def test_case_folding_takes_pieces_and_nulls(spark):
    """More texts than a piece, some null, none, in order."""
    from corpusloom.functions import text as T

    texts = ["Ｆｕｌｌ ẞ", None, "ﬁ"] * (T.PIECE + 1)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    got = [r.t for r in df.select("i", T.nfkc_casefold("t").alias("t")).orderBy("i").collect()]
    assert got == ["full ss", None, "fi"] * (T.PIECE + 1)
    assert df.where("i < 0").select(T.nfkc_casefold("t").alias("t")).collect() == []


def test_case_folding_lets_pieces_go_as_they_are_made():
    """No array is longer than a piece, and the second batch is not asked for before the first has left."""
    import pyarrow as pa

    asked = []
    batches = (asked.append(k) or pa.array(["É", None] * X.PIECE) for k in range(2))
    out = X.nfkc_casefold.func(batches)
    first = [next(out), next(out)]
    assert asked == [0] and [len(x) for x in first] == [X.PIECE] * 2
    assert [x for part in [*first, *out] for x in part.to_pylist()] == ["é", None] * 2 * X.PIECE
