"""Exact deduplication through a log-structured merge index of digests (DataFrame functions only).

Texts are equal when identical after lower-casing A-Z. Entries (digest, identifier) gather in
memtables (the map-side hash tables of an aggregation), which flush as runs: Parquet sorted by digest,
with Parquet's Bloom filters and row-group bounds on the digest. Compaction merges all runs into one and
keeps the smallest identifier of each digest under the chosen order. Digests that more than one row has
are hits; their bytes are then compared, so that two texts with one digest are never taken for equal.

Nulls: a null text counts as the empty text; a null doc_id orders before all others, so it stays only
where no other row has its text. Repeated rows (same doc_id, same text): one of them stays. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, shared_root, stage, table

#: Hit identifiers are broadcast to narrow the byte check up to this many rows (about 64 MB); beyond it the
#: texts meet their hits in a shuffled join.
BROADCAST_ROWS = 2_000_000


class DigestIndex:
    """Runs of (digest, best, n) under a root folder. keep: 'largest' or 'smallest' doc_id.

    Compaction keeps the smallest identifier; for 'largest' identifiers are ordered downwards.
    """

    def __init__(self, spark: SparkSession, keep: str = "largest", root: str | None = None):
        self.spark, self.keep, self.runs = spark, keep, []
        self.root = root or f"{shared_root(spark)}/lsm-{uuid.uuid4().hex[:8]}"

    def _write(self, rows: DataFrame, *by: str) -> str:
        path = f"{self.root}/run-{len(self.runs):05d}-{uuid.uuid4().hex[:6]}"
        order = [*by, "digest"]
        w = rows.repartitionByRange(*order).sortWithinPartitions(*order).write
        w = w.option("parquet.bloom.filter.enabled#digest", "true").option("compression", "zstd")
        (w.partitionBy(*by) if by else w).parquet(path)
        self.runs.append(path)
        return path

    def flush(self, entries: DataFrame, memtables: int = 4) -> None:
        """entries: (doc_id, digest). Every row falls to one memtable, and each memtable becomes a run."""
        filled = entries.withColumn("memtable", F.pmod(F.xxhash64("doc_id"), F.lit(memtables)))
        self._write(filled.groupBy("memtable", "digest").agg(_best("doc_id", self.keep), F.count("*").alias("n")), "memtable")

    def read(self) -> DataFrame:
        runs = (self.spark.read.schema("digest binary, best long, n long").parquet(r) for r in self.runs)
        return reduce(DataFrame.unionByName, runs)

    def compact(self) -> None:
        """Merge all runs into one: one row a digest, with the smallest identifier and the count."""
        merged = self.read().groupBy("digest").agg(_best("best", self.keep), F.sum("n").alias("n"))
        self.runs = [self._write(merged)]

    def lookup(self, digests: list) -> DataFrame:
        """Rows of a few given digests; run filters and row-group bounds spare most of the files."""
        return self.read().where(F.col("digest").isin(digests))


def exact_groups(docs: DataFrame, keep: str = "largest", memtables: int = 4, digest_bytes: int = 32) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    digest_bytes: how much of SHA-256 the index uses; a short digest collides, and the byte check then
    still gives right groups (tests use this).
    """
    spark = docs.sparkSession
    norm = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    texts = docs.select("doc_id", norm.alias("norm"))

    def entries(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("sha", F.unhex(F.sha2("norm", 256)))
        return rows.withColumn("digest", F.substring("sha", 1, digest_bytes))

    base = entries(texts).drop("norm").withColumn("rid", F.monotonically_increasing_id())
    base = _numbered(stage(base, "digests").df, "sha")

    index = DigestIndex(spark, keep)
    index.flush(base.select("doc_id", "digest"), memtables)
    index.compact()
    hits = index.read().where("n > 1")

    # Bytes of the hits only. The rows of a digest combine on the map side to one row a distinct text.
    ids = stage(base.join(hits.select("digest"), "digest", "left_semi").select("doc_id").distinct(), "hits")
    wanted = ids.df.withColumnRenamed("doc_id", "hit_id")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    read = entries(texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("hit_id")), "left_semi"))
    variants = read.groupBy("digest", "norm").agg(_best("doc_id", keep), F.count("*").alias("size"))
    groups = variants.groupBy("digest").agg(F.count("*").alias("variants"), _best("best", keep), F.sum("size").alias("size"))
    groups = stage(groups, "verified").df
    plain = groups.where("variants = 1 and size > 1").select("digest", "best", "size")
    out = _result(base.join(plain, "digest", "left"))

    mixed = groups.where("variants > 1").select("digest")
    if not mixed.isEmpty():  # different texts with one digest: these rows meet by their bytes
        own = entries(texts).join(mixed, "digest", "left_semi").withColumn("rid", F.monotonically_increasing_id())
        own = stage(own, "collided").df
        by_text = own.groupBy("norm").agg(_best("doc_id", keep), F.count("*").alias("size"))
        own = _numbered(own, "norm")
        rest = base.join(mixed, "digest", "left_anti").join(plain, "digest", "left")
        out = _result(rest).unionByName(_result(own.join(by_text, "norm")))
    return out


def _numbered(rows: DataFrame, text: str) -> DataFrame:
    """rows with copy: 1 for one of the rows with one doc_id and text (the smallest rid), 2 for the others. rows: staged, with rid.

    Repeated rows meet one row a group that map-side combine has made; adaptive execution may split such a join.
    """
    twice = rows.groupBy("doc_id", text).agg(F.min("rid").alias("first"), F.count("*").alias("times")).where("times > 1")
    twice = stage(twice.select(F.col("doc_id").alias("same_id"), F.col(text).alias("same"), "first"), "repeated").df
    if twice.isEmpty():
        return rows.withColumn("copy", F.lit(1)).drop("rid")
    out = rows.join(twice, rows["doc_id"].eqNullSafe(twice["same_id"]) & (rows[text] == twice["same"]), "left")
    copy = F.when(F.col("first").isNull() | (F.col("first") == F.col("rid")), 1).otherwise(2)
    return stage(out.withColumn("copy", copy).drop("rid", "same_id", "same", "first"), "digests").df


def _best(c: str, keep: str):
    return (F.max(c) if keep == "largest" else F.min(c)).alias("best")


def _result(rows: DataFrame) -> DataFrame:
    keep_id = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("best"))
    return rows.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep_id) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM n
"""
