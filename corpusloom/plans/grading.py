"""Queries over graded samples: orders as samples of customers, labels as grades of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import grading as G
from .base import Registry, table

query = Registry()
QUERIES, SQL = query.queries, query.sql

#: A customer is a problem, its orders are samples; an order of status F is a correct sample.
RATES = """rates AS (SELECT o_custkey AS id, count(*) AS n_samples, sum((o_orderstatus = 'F')::INT)::BIGINT AS n_correct, avg((o_orderstatus = 'F')::INT) AS solve_rate FROM orders GROUP BY 1)"""
BIN = "CASE WHEN solve_rate <= 0 THEN '0' WHEN solve_rate <= 0.25 THEN '(0,0.25]' WHEN solve_rate <= 0.5 THEN '(0.25,0.5]' WHEN solve_rate <= 0.75 THEN '(0.5,0.75]' WHEN solve_rate < 1 THEN '(0.75,1)' ELSE '1' END"


def rates(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_orderstatus") == "F").alias("ok"))
    return G.solve_rates(rows, "id", "ok")


@query("a9_solve_rates", f"WITH {RATES} SELECT * FROM rates")
def a9(spark, sf):
    return rates(spark, sf)


@query("a2_histogram", f"""
WITH {RATES}, b AS (SELECT unnest(['0', '(0,0.25]', '(0.25,0.5]', '(0.5,0.75]', '(0.75,1)', '1']) AS bin)
SELECT b.bin, count(id) AS n FROM b LEFT JOIN rates ON b.bin = {BIN} GROUP BY b.bin""")
def a2(spark, sf):
    return G.histogram(rates(spark, sf))


@query("p5_band", f"WITH {RATES} SELECT id, solve_rate FROM rates WHERE coalesce(solve_rate, -1) BETWEEN 0.25 AND 0.6")
def p5(spark, sf):
    return G.band(rates(spark, sf), 0.25, 0.6).select("id", "solve_rate")


@query("w4_stratified", f"""
WITH {RATES}, r AS (SELECT *, {BIN} AS bin FROM rates), k AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY sha256('5:' || id::VARCHAR), id) AS k FROM r)
SELECT id, bin FROM k WHERE k <= (SELECT min(n) FROM (SELECT count(*) AS n FROM r GROUP BY bin))""")
def w4(spark, sf):
    return G.stratify(rates(spark, sf), 5).select("id", "bin")


@query("w5_trim_to_mean", f"""
WITH {RATES}, o AS (SELECT id, solve_rate, sum(solve_rate) OVER w AS s, count(*) OVER w AS n FROM rates WINDOW w AS (ORDER BY solve_rate, id ROWS UNBOUNDED PRECEDING))
SELECT id, solve_rate FROM o WHERE n <= (SELECT max(n) FROM o WHERE s / n <= 0.25 + 1e-12)""")
def w5(spark, sf):
    """The mean rate lies above the target: the easiest go."""
    return G.trim_to_mean(rates(spark, sf), 0.25).select("id", "solve_rate")


@query("a1_means", "SELECT coalesce(avg(quality), 0.0) AS mean_quality, coalesce(avg(CASE WHEN doc_id < 0 THEN quality END), 0.0) AS empty_mean, avg(CASE WHEN doc_id < 0 THEN quality END) AS null_mean FROM labels")
def a1(spark, sf):
    x = table(spark, sf, "labels")
    none = F.when(F.col("doc_id") < 0, F.col("quality"))
    return x.agg(G.mean_or_zero(F.col("quality")).alias("mean_quality"), G.mean_or_zero(none).alias("empty_mean"), F.avg(none).alias("null_mean"))


@query("a3_count_by_key", "SELECT coalesce(role, 'unspecified') AS role, count(*) AS n FROM conversations GROUP BY 1")
def a3(spark, sf):
    return table(spark, sf, "conversations").groupBy(F.coalesce("role", F.lit("unspecified")).alias("role")).agg(F.count("*").alias("n"))


@query("a10_grades", "SELECT source, avg(quality) AS mean_score, count(quality) AS graded, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def a10(spark, sf):
    both = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return both.groupBy("source").agg(F.avg("quality").alias("mean_score"), F.count("quality").alias("graded"), F.count("*").alias("n"))


RECHECK = """
r AS (SELECT doc_id AS id, quality::DOUBLE AS score0, CASE WHEN toxic = 1 THEN 'no' ELSE 'yes' END AS j FROM labels),
m AS (SELECT id, score0 AS deterministic_score, CASE WHEN coalesce(score0, 1) < 0.5 THEN j END AS llm_recheck_judgement,
      CASE WHEN coalesce(score0, 1) < 0.5 THEN 'checked' ELSE 'skipped' END AS llm_recheck_status,
      CASE WHEN coalesce(score0, 1) < 0.5 AND j = 'yes' THEN 1.0 ELSE score0 END AS score FROM r)"""


def _recheck(spark, sf):
    x = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("score"), "toxic")
    said = x.select("id", X.judgement(F.when(F.col("toxic") == 1, F.lit("No.")).otherwise(F.lit("Yes, it is"))).alias("judgement"))
    return G.recheck_merge(x.drop("toxic"), said)


@query("x7_recheck", f"WITH {RECHECK} SELECT * FROM m")
def x7(spark, sf):
    """A stub judge's replies, parsed and merged."""
    return _recheck(spark, sf)


@query("a23_final_score", f"WITH {RECHECK} SELECT round_even(avg(coalesce(score, 0)) * 100, 2) AS final_score FROM m")
def a23(spark, sf):
    return G.final_score(_recheck(spark, sf))


@query("w14_sample", "SELECT doc_id, source FROM (SELECT doc_id, source, sha256('9:' || doc_id::VARCHAR) AS h FROM documents) ORDER BY h, doc_id LIMIT 120")
def w14(spark, sf):
    from ..operators.curation import hash_rank

    return table(spark, sf, "documents").withColumn("h", hash_rank(9, F.col("doc_id"))).orderBy("h", "doc_id").select("doc_id", "source").limit(120)


@query("a19_expected_counts", """
SELECT e.name, e.expected, coalesce(a.n, 0) AS n, coalesce(a.n, 0) = e.expected AS ok
FROM (VALUES ('user', 279), ('assistant', 1), ('judge', 0)) e(name, expected) LEFT JOIN (SELECT role, count(*) AS n FROM conversations GROUP BY role) a ON a.role = e.name""")
def a19(spark, sf):
    want = spark.createDataFrame([("user", 279), ("assistant", 1), ("judge", 0)], "name string, expected int")
    have = table(spark, sf, "conversations").groupBy(F.col("role").alias("name")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return want.join(have, "name", "left").select("name", "expected", n.alias("n"), (n == F.col("expected")).alias("ok"))
