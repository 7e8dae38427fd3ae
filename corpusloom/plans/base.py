"""Registering queries, and SQL snippets that the oracles share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WS = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

INSTRUCTION = "(?i)(?:please reason step by step|solve the following math problem step by step|remember to put your answer|put your final answer|the last line of your response)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def norm_sql(x: str) -> str:
    lines = f"array_to_string(list_filter(string_split({x}, chr(10)), lambda l: NOT regexp_matches(l, '{INSTRUCTION}')), ' ')"
    return compact_sql(f"replace(lower({lines}), 'ß', 'ss')")


def compact_sql(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({x}, '{WS}+', ' ', 'g'), '\s*([{{}}()\[\],.=+\-*/^])\s*', '\1', 'g'))"


def trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def rounded(x: Column, digits: int = 6) -> Column:
    """x rounded as in SQL: a negative number that rounds to zero stays a negative zero, which Spark's round alone makes a positive one."""
    r = F.round(x, digits)
    return F.when(r == 0, x * F.lit(0.0)).otherwise(r)


class Registry:
    def __init__(self):
        self.queries, self.sql = {}, {}

    def __call__(self, name: str, sql: str | None = None):
        def add(f):
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return add
