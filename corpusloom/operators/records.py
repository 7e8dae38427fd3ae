"""Scans and row algebra over record tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X


def category_scan(rows: DataFrame, categories: list[str], most: int, page_size: int, seed: str) -> DataFrame:
    """Rows of some categories without blank texts, the first of each fingerprint, up to `most`.

    Pages of page_size ids come in hash order of seed and page, ids in order within a page.
    """
    rows = rows.where(F.col("category").isin(categories) & (X.trim_u(F.col("text")) != ""))
    page = F.sha2(F.concat(F.lit(f"{seed}|"), F.floor(F.col("id") / page_size).cast("string")), 256)
    rows = rows.select("*", X.problem_fingerprint(F.col("text")).alias("fp"), page.alias("page"))
    first = rows.groupBy("fp").agg(F.min_by("id", F.struct("page", "id")).alias("id"))
    return rows.join(first, ["fp", "id"], "left_semi").orderBy("page", "id").limit(most)
