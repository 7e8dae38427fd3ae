"""Scans: JSON lines, JSON documents, CSV, benchmark handlers and a registry of sources by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.curation import hash_rank


def read_jsonl(spark: SparkSession, path, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped. The schema is given, so that no pass infers it."""
    return spark.read.schema(schema).json(path)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array or lines, or an object that holds its rows under train, data or examples (in that order)."""
    if path.endswith((".jsonl", ".ndjson")):
        return read_jsonl(spark, path, schema)
    keys = ("train", "data", "examples")
    wrapped = ", ".join(f"{k} ARRAY<STRUCT<{schema}>>" for k in keys)
    whole = spark.read.text(path, wholetext=True)
    array = F.from_json("value", f"ARRAY<STRUCT<{schema}>>")
    object_ = F.from_json("value", f"STRUCT<{wrapped}>")
    is_list = F.ltrim(F.col("value")).startswith("[")
    none = F.raise_error(F.lit("no list under train, data or examples")).cast(f"ARRAY<STRUCT<{schema}>>")
    return whole.select(F.inline(F.when(is_list, array).otherwise(F.coalesce(*[object_[k] for k in keys], none))))


def read_results(spark: SparkSession, paths: list[str], schema: str, tagged: bool = True) -> DataFrame:
    """JSON arrays of result items; source_path names each item's file."""
    rows = spark.read.schema(schema).option("multiLine", True).json(paths)
    return rows.withColumn("source_path", F.col("_metadata.file_path")) if tagged else rows


def read_first_existing(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The first of the paths that exists."""
    for p in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return read_results(spark, [p], schema)
    raise FileNotFoundError(f"none exists: {paths}")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (r.schema(schema) if schema else r).csv(path)


def read_dataset(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """A dataset by its extension; 'path@split' keeps the rows of that split, `most` limits their number."""
    path, _, split = path.partition("@")
    kind = {"jsonl": "json", "json": "json", "parquet": "parquet", "csv": "csv", "orc": "orc"}.get(path.rsplit(".", 1)[-1], "parquet")
    rows = spark.read.option("header", True).format(kind).load(path)
    rows = rows.where(F.col("split") == split) if split else rows
    return rows if most is None else rows.limit(most)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A held-out snapshot {questions: {source: [question]}} as (source, question); a malformed one is an error."""
    whole = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", "questions MAP<STRING, ARRAY<STRING>>", {"mode": "FAILFAST"})
    rows = whole.select(F.explode(F.coalesce(parsed["questions"], F.raise_error(F.lit("no questions in the snapshot")).cast("map<string,array<string>>"))).alias("source", "q"))
    return rows.select("source", F.explode("q").alias("question"))


def local_json(rows: DataFrame, question: list[str], answer: list[str]) -> DataFrame:
    """question and answer by alias; a row that lacks one is an error that names it."""
    def need(names: list[str], what: str):
        here = [F.col(n) for n in names if n in rows.columns]
        return F.coalesce(X.first_nonblank(*here) if here else F.lit(None).cast("string"), F.raise_error(F.concat(F.lit(f"no {what} in row "), F.col("ord").cast("string"))).cast("string"))

    return rows.select("ord", need(question, "question").alias("question"), need(answer, "answer").alias("answer"))


def multiple_choice(rows: DataFrame, seed, most: int = 1000, id_col: str = "id") -> DataFrame:
    """At most `most` items in hash order, options listed as letters: question, answer."""
    chosen = rows.withColumn("__h", hash_rank(seed, F.col(id_col))).orderBy("__h", id_col).limit(most)
    return chosen.select(id_col, F.concat("question", F.lit("\n"), X.option_list(F.col("options"))).alias("question"), F.char(F.col("answer_index") + 65).alias("answer"))


_HANDLERS: dict[str, Callable[..., DataFrame]] = {}


def handler(name: str):
    """Register a source: a function of (spark, path) that gives question and answer."""

    def add(f):
        _HANDLERS[name] = f
        return f

    return add


def dataset(spark: SparkSession, name: str, path: str) -> DataFrame:
    if name not in _HANDLERS:
        raise KeyError(f"no source named {name}; known: {sorted(_HANDLERS)}")
    return _HANDLERS[name](spark, path)


@handler("math")
def _math(spark, path):
    return read_csv(spark, path).select(F.col("Question").alias("question"), F.col("Answer").alias("answer"))


@handler("gsm8k")
def _gsm8k(spark, path):
    rows = read_jsonl(spark, path, "question string, answer string")
    return rows.select("question", F.element_at(F.split("answer", "#### "), -1).alias("answer"))


@handler("olympiad")
def _olympiad(spark, path):
    rows = read_jsonl(spark, path, "question string, final_answer array<string>")
    return rows.select("question", F.get("final_answer", F.lit(0)).alias("answer"))


for _name in ("amc", "aime24", "aime25", "minerva"):

    @handler(_name)
    def _plain(spark, path):
        rows = read_jsonl(spark, path, "problem string, question string, answer string")
        return rows.select(F.coalesce("question", "problem").alias("question"), "answer")


def read_committed(spark: SparkSession, path: str, schema: str, committed: int) -> DataFrame:
    """The first `committed` rows of a JSON-lines file that a stopped job left; fewer are an error.

    The rows are numbered by file order (one file is read in order of its splits).
    """
    from ..operators.batches import numbered

    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("at", F.monotonically_increasing_id())
    rows = numbered(lines, ["at"]).where(F.col("ord") < committed)
    if rows.count() < committed:
        raise ValueError(f"{path} holds fewer rows than the {committed} committed ones")
    return rows.select("ord", F.from_json("value", schema).alias("r")).select("ord", "r.*")
