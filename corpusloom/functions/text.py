"""Text functions from Column to Column. All are native but `last_boxed` and, for texts beyond ASCII, `casefold`."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import StringType

from .fixed import ACTION_MARKERS, ANSWER_REMOVED, ANSWER_REPLACED, CONTEXT_MARKERS, CONTROL_MARKER, DIFFICULTY_BINS, INSTRUCTION_LINE, INSTRUCTION_PHRASES, PROMPT_SUFFIX, STEP_BY_STEP


def _s(text: str) -> Column:
    return F.lit(text)


def trim_u(x: Column) -> Column:
    """Strip Unicode white space at both ends; Spark's trim takes spaces only."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def rtrim_u(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\s+$", "")


def first_nonblank(*columns: Column) -> Column:
    """The first of the columns that is not blank, stripped."""
    return F.coalesce(*[F.nullif(trim_u(c.cast("string")), _s("")) for c in columns])


#: Texts of an Arrow batch that are Python strings at once.
PIECE = 64


@arrow_udf(StringType())
def nfkc_casefold(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """By pieces, which leave as they are made, so that no second batch of folded texts is held."""
    fold = lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold()
    for x in batches:
        for a in range(0, len(x), PIECE):
            yield pa.array(map(fold, x[a : a + PIECE].to_pylist()), pa.string())


def casefold(x: Column) -> Column:
    """NFKC and full case folding. ASCII texts are lower-cased natively; only others go to the UDF."""
    ascii_ = F.octet_length(x) == F.char_length(x)
    return F.when(ascii_, F.lower(x)).otherwise(nfkc_casefold(F.when(~ascii_, x)))


def _compact(x: Column) -> Column:
    x = F.regexp_replace(x, r"(?U)\s+", " ")
    return F.btrim(F.regexp_replace(x, r"\s*([{}()\[\],.=+\-*/^])\s*", "$1"))


def normalize_question(x: Column) -> Column:
    """Comparable form of a question: NFKC and case folding, instruction lines dropped, white space compacted."""
    spelt = F.when(F.contains(x, _s("\\n")), F.regexp_replace(x, r"(?i)\\n(?=(?:please|solve|remember|the last line))", "\n")).otherwise(x)
    x = casefold(spelt)
    lines = F.filter(F.split(x, r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]"), lambda line: ~line.rlike(INSTRUCTION_LINE))
    # few texts hold such a line; in all others the line breaks are but white space, and no line is looked at
    plain = F.translate(x, "\x1c\x1d\x1e", "   ")
    return _compact(F.when(contains_any(x, INSTRUCTION_PHRASES), F.array_join(lines, " ")).otherwise(plain))


def problem_fingerprint(x: Column) -> Column:
    return F.sha2(_compact(casefold(x)), 256)


def char_ngrams(x: Column, size: int = 5) -> Column:
    """Distinct substrings of `size` characters; the whole text if it is no longer than that."""
    grams = F.array_distinct(F.regexp_extract_all(x, _s(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))
    return F.when(F.char_length(x) <= size, F.array(x)).otherwise(grams)


_BOX = {False: re.compile(r"\\boxed\s*\{|[{}]"), True: re.compile(r"\\boxed\s*\{|[{}]", re.IGNORECASE)}


def balanced_boxed(text: str | None, ignore_case: bool = False) -> str | None:
    """What the last \\boxed{...} with balanced braces holds, stripped. One pass: open braces wait for their closing ones."""
    if text is None:
        return None
    waiting: list[tuple[int, bool]] = []
    best, found = -1, None
    for m in _BOX[ignore_case].finditer(text):
        if m[0] != "}":
            waiting.append((m.end(), len(m[0]) > 1))
        elif waiting:
            start, boxed = waiting.pop()
            if boxed and start > best:
                best, found = start, (start, m.start())
    return None if found is None else text[found[0] : found[1]].strip()


@pandas_udf(StringType())
def last_boxed(x: pd.Series) -> pd.Series:
    return x.map(balanced_boxed)


@pandas_udf(StringType())
def last_boxed_any_case(x: pd.Series) -> pd.Series:
    return x.map(lambda t: balanced_boxed(t, True))


def last_boxed_flat(x: Column) -> Column:
    """last_boxed where boxes hold no braces: native."""
    return trim_u(F.try_element_at(F.regexp_extract_all(x, _s(r"\\boxed\s*\{([^{}]*)\}"), F.lit(1)), F.lit(-1)))


def last_match(x: Column, pattern: str, group: int = 1) -> Column:
    """The last match's group, or null."""
    return F.try_element_at(F.regexp_extract_all(x, _s(pattern), F.lit(group)), F.lit(-1))


def clean_solution(x: Column) -> Column:
    return trim_u(F.regexp_replace(x, CONTROL_MARKER, ""))


def clean_gold_answer(x: Column) -> Column:
    return trim_u(F.regexp_replace(trim_u(x), r"[.,;:]+$", ""))


def incorrect_answer(x: Column) -> Column:
    """A wrong answer near the gold one: one more for a number, else (x)+1."""
    flat = trim_u(F.replace(x, _s(","), _s("")))
    whole = flat.try_cast("decimal(37,0)") + 1
    return (
        F.when(flat.rlike(r"^[-+]?\d+$"), whole.cast("string"))
        .when(flat.rlike(r"^[-+]?\d*\.\d+$"), (flat.try_cast("double") + 1.0).cast("string"))
        .otherwise(F.concat(_s("("), x, _s(")+1")))
    )


def help_hint(x: Column) -> Column:
    """The first line without a box, at most 240 characters."""
    lines = F.filter(F.transform(F.split(x, "\n"), trim_u), lambda t: (t != "") & ~F.contains(t, _s("\\boxed")))
    return F.left(F.coalesce(F.get(lines, F.lit(0)), _s("Set up the governing equation before simplifying.")), F.lit(240))


def normalize_answer(x: Column) -> Column:
    """Answers compare without white space, trailing full stops and case."""
    return F.lower(F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", ""), r"\.+$", ""))


def difficulty_bin(rate: Column) -> Column:
    b = DIFFICULTY_BINS
    return F.when(rate <= 0, b[0]).when(rate <= 0.25, b[1]).when(rate <= 0.5, b[2]).when(rate <= 0.75, b[3]).when(rate < 1, b[4]).when(rate >= 1, b[5])


def normalize_final_answer(x: Column) -> Column:
    """Final answers of quantitative problems in one form: fixed replacements, LaTeX unwrapped, shorthand spelt out."""
    x = F.element_at(F.split(x, "="), -1)
    x = reduce(lambda t, ab: F.replace(t, _s(ab[0]), _s(ab[1])), [*ANSWER_REPLACED, *((e, "") for e in ANSWER_REMOVED)], x)
    for pattern, put in (
        (r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$"),
        (r"(\\text\{)(.*?)(\})", "$2"),
        (r"(\\textbf\{)(.*?)(\})", "$2"),
        (r"(\\overline\{)(.*?)(\})", "$2"),
        (r"(\\boxed\{)(.*)(\})", "$2"),
        (r"(frac)([^{])(.)", "frac{$2}{$3}"),
        (r"(sqrt)([^{])", "sqrt{$2}"),
    ):
        x = F.regexp_replace(x, pattern, put)
    x = F.replace(x, _s("$"), _s(""))
    digits = F.replace(x, _s(","), _s(""))
    return trim_u(F.when(digits.rlike(r"^\d+$"), digits).otherwise(x))


def slug(x: Column, most: int | None = 64) -> Column:
    """Runs of other characters than letters, digits, '.', '_' and '-' become one hyphen."""
    x = F.regexp_replace(F.regexp_replace(x, r"[^A-Za-z0-9._-]+", "-"), r"^[-.]+|[-.]+$", "")
    return F.left(x, F.lit(most)) if most else x


def output_key(readable: Column, identity: Column, tag: Column) -> Column:
    """A readable name with eight digits of SHA-256 over identity and tag."""
    return F.concat(slug(readable), _s("-"), F.left(F.sha2(F.concat(identity, _s("|"), tag), 256), F.lit(8)))


def judgement(x: Column) -> Column:
    """yes or no at the start of a judge's reply, else an error."""
    said = F.lower(F.regexp_extract(x, r"(?i)^\s*(yes|no)\b", 1))
    return F.when(said != "", said).otherwise(F.raise_error(F.concat(_s("unreadable judgement: "), x)).cast("string"))


def user_prompt(x: Column) -> Column:
    """The question with the answering instruction, which is added once only."""
    return F.when(F.contains(x, _s(STEP_BY_STEP)), x).otherwise(F.concat(rtrim_u(x), _s(PROMPT_SUFFIX)))


def occurrences(x: Column, token: str) -> Column:
    return ((F.char_length(x) - F.char_length(F.replace(x, _s(token), _s("")))) / len(token)).cast("int")


def contains_any(x: Column, tokens) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(x, _s(t)) for t in tokens])


def first_marker(x: Column, tokens=(*ACTION_MARKERS, *CONTEXT_MARKERS)) -> Column:
    """The first of the tokens, in declared order, that x contains."""
    return F.coalesce(*[F.when(F.contains(x, _s(t)), t) for t in tokens])


def exact_wrapper(x: Column, opening: str, closing: str) -> Column:
    """Both markers once each, in order."""
    once = (occurrences(x, opening) == 1) & (occurrences(x, closing) == 1)
    return once & (F.instr(x, opening) < F.instr(x, closing))


def leaks_answer(x: Column) -> Column:
    return x.rlike(r"(?i)\\boxed\s*\{") | F.contains(F.lower(x), _s("final answer"))


def context_marker_count(x: Column) -> Column:
    return F.regexp_count(x, _s("</?(?:TEACHER_HELP|TEACHER_REVIEW|ENVIRONMENT_NOTICE)>"))


def option_list(options: Column) -> Column:
    """Multiple-choice options as lines 'A. ...'."""
    return F.array_join(F.transform(options, lambda o, i: F.concat(F.char(i + 65), _s(". "), o)), "\n")
