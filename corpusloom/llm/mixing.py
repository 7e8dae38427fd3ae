"""Mixing sources to target weights by Efraimidis-Spirakis sampling (DataFrame functions only).

Every document draws an exponential key, scaled by its quality weight: key = -ln(u) / quality, with u a
hash of seed and doc_id. Within a source documents are ordered by key; a running sum of sizes meets the
source's budget. A budget above the source's size takes complete epochs first (every document once per
epoch) and then the fractional rest in key order. With `cut` the document at the budget's edge is taken in
part, so that each source meets its whole-word budget exactly; without it that document is taken whole
if at least half of it is within the budget.

A source is never gathered: keys fall into ranges, sizes are pre-aggregated by (source, bin), the running
sum goes over those few sums, and only the rows of one (source, bin) are sorted together. A range spans
1 / bins of the key's natural logarithm. A quality only shifts that logarithm, and its density is 1/e at most,
so no bin expects over 1 / (e bins) of a source's rows whatever their qualities.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own and comes
last; a null doc_id draws by its text; equal keys fall back to doc_id and the text's hash, and only rows
equal in both may change places; very long texts are counted whole;
a table whose sizes are all 0 (or an empty one) has targets 0. Other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, free_names, stage, table

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BINS = 2048
SEED = "mix-1"


def quality(text: Column) -> Column:
    """Share of letters in the text, from 0.1 (none) to 1 (all): a document's sampling weight."""
    letters = F.char_length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.coalesce(F.lit(0.1) + F.lit(0.9) * letters / F.greatest(F.char_length(text), F.lit(1)), F.lit(0.1))


def uniform(doc_id: Column, text: Column, seed: str) -> Column:
    """In (0, 1): 52 bits of SHA-256 over seed and id (or the text's digest), which any SQL engine can recompute."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.sha2(F.coalesce(text, F.lit("")), 256)))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), name), 256)
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(sources: DataFrame, weights=WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """sources: one row a source (source, source_size). Adds target.

    A target is min(most * size, level * weight) with the one level at which targets sum to the total:
    sources are capped in the order of their cap per weight, as resharing the excess until none is above.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    wheel = F.array(*[F.lit(float(w)) for w in weights])
    s = sources.withColumn("weight", F.element_at(wheel, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("cap", most * F.col("source_size"))
    by = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    every = W.partitionBy(F.lit(1))
    s = s.withColumn("capped", F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)))
    s = s.withColumn("open", F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing)))
    s = s.withColumn("total", F.sum("source_size").over(every))
    level = (F.col("total") - F.coalesce("capped", F.lit(0))) / F.col("open")
    first = F.min(F.when(level <= F.col("cap") / F.col("weight"), F.struct((F.col("cap") / F.col("weight")).alias("at"), level.alias("level"))))
    s = s.withColumn("level", first.over(every)["level"])
    return s.withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))).select("source", "source_size", "weight", "target")


def sizes(docs: DataFrame, seed: str = SEED, bins: int = BINS) -> DataFrame:
    """doc_id, source, text hash, size, sampling key and its bin of every row."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = -F.log(uniform(F.col("doc_id"), F.col("text"), seed)) / quality(F.col("text"))
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("th"), size.alias("size"), key.alias("key"))
    return rows.withColumn("bin", F.floor(F.log("key") * bins).cast("int"))


def select_mix(docs: DataFrame, weights=WEIGHTS, most: int = MAX_EPOCHS, seed: str = SEED, bins: int = BINS, cut: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, source, th, size, source_size, target, taken, copies."""
    rows = stage(sizes(docs, seed, bins), "sizes").df
    none = F.col("source").isNull().alias("no_source")
    name = F.coalesce("source", F.lit("")).alias("name")
    sums = rows.groupBy(none, name, "bin").agg(F.sum("size").alias("bin_size"))
    sums = stage(sums, "bins").df
    sources = sums.groupBy("no_source", "name").agg(F.sum("bin_size").alias("source_size"))
    sources = sources.select(F.when(~F.col("no_source"), F.col("name")).alias("source"), "source_size")
    goals = source_targets(sources, weights, most)
    goals = goals.select(F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("name"), "source_size", "target")
    before = F.sum("bin_size").over(W.partitionBy("no_source", "name").orderBy("bin").rowsBetween(W.unboundedPreceding, -1))
    plan = sums.withColumn("bins_before", F.coalesce(before, F.lit(0))).join(goals, ["no_source", "name"])
    plan = stage(plan.drop("bin_size"), "plan").df

    keyed = rows.withColumn("no_source", F.col("source").isNull()).withColumn("name", F.coalesce("source", F.lit("")))
    keyed = keyed.join(plan, ["no_source", "name", "bin"])
    order = W.partitionBy("no_source", "name", "bin").orderBy("key", F.col("doc_id").isNull(), "doc_id", "th")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col("bins_before")
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    epochs = F.least(epochs, F.lit(most).cast("long"))
    rest = budget - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before"))).cast("long")
    out = keyed.withColumn("before", before).withColumn("epochs", epochs).withColumn("rest", rest).withColumn("part", part)
    if not cut:
        out = out.withColumn("part", F.when((F.col("part") * 2 >= F.col("size")) & (F.col("part") > 0), F.col("size")).otherwise(F.lit(0)))
    copies = F.when(F.col("size") > 0, F.col("epochs") + (F.col("part") > 0).cast("long")).otherwise(0)
    return out.select("doc_id", "source", "th", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"), copies.cast("long").alias("copies"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, whole documents only.

    Rows equal in doc_id, text and source share what the mix takes of them all.
    """
    n, m, k, own, copy, hash_, id_, th, source = free_names(docs, *(f"__cl_{x}" for x in ("n", "m", "k", "own", "copy", "hash", "id", "th", "source")))
    take = select_mix(docs, cut=False, **options).groupBy("doc_id", "th", "source")
    take = stage(take.agg(F.sum("copies").alias(n), F.count("*").alias(m)).where(F.col(n) > 0), "taken").df
    take = take.withColumnsRenamed({"doc_id": id_, "th": th, "source": source})
    out = docs.withColumn(hash_, F.xxhash64("text"))
    same = out["doc_id"].eqNullSafe(take[id_]) & (out[hash_] == take[th]) & out["source"].eqNullSafe(take[source])
    out = out.join(take, same)
    if take.where(F.col(m) > 1).isEmpty():
        out = out.withColumn(k, F.lit(0))
    else:  # number the rows of a repeated one; they are few, or the same row over and over
        place = F.row_number().over(W.partitionBy(id_, th, source).orderBy(F.lit(1))) - 1
        out = out.where(F.col(m) == 1).withColumn(k, F.lit(0)).unionByName(out.where(F.col(m) > 1).withColumn(k, place))
    times = F.floor((F.col(n) - F.col(k) + F.col(m) - 1) / F.col(m)).cast("int")
    out = out.withColumn(own, times).where(F.col(own) > 0)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(own)))).select(*docs.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(sha256('mix-1:' || coalesce(doc_id::VARCHAR, 'null:' || sha256(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u,
         coalesce(0.1 + 0.9 * length(regexp_replace(text, '[^\\p{L}]+', '', 'g')) / greatest(length(text), 1), 0.1) AS q
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM d GROUP BY source),
c AS (
  SELECT *, 3 * source_size AS cap,
         coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
         sum(w) OVER (ORDER BY 3 * source_size / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
         sum(source_size) OVER ()::BIGINT AS total
  FROM s),
v AS (SELECT arg_min((total - capped) / open, cap / w) AS level FROM c WHERE (total - capped) / open <= cap / w),
g AS (SELECT source, source_size, least(cap::DOUBLE, level * w) AS target FROM c, v),
r AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, floor(g.target)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(u) / q, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(budget // source_size, 3) ELSE 0 END AS epochs FROM r)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken
FROM e
"""
