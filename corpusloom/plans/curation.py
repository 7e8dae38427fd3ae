"""Queries over documents and benchmark: normalise, decontaminate, deduplicate, split, report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import curation as C
from ..scratch import stage
from ..sources import sinks as K
from .base import Registry, compact_sql, norm_sql, table, trim_sql

query = Registry()
QUERIES, SQL = query.queries, query.sql

BENCH = "SELECT 'bench_' || (item_id % 7)::VARCHAR AS source, text, {norm} AS norm FROM benchmark".format(norm=norm_sql("text"))
#: Records: documents and, so that an exact match exists, benchmark items posing as documents.
RECORDS = f"""SELECT doc_id AS id, source, text, {norm_sql("text")} AS norm FROM documents
UNION ALL SELECT 10000000 + item_id, 'leak', text, {norm_sql("text")} FROM benchmark WHERE item_id % 5 = 0"""


def heldout(spark, sf):
    b = table(spark, sf, "benchmark")
    own = b.select(F.concat(F.lit("bench_"), (F.col("item_id") % 7).cast("string")).alias("source"), "text", X.normalize_question(F.col("text")).alias("norm"))
    return own.withColumn("key", F.sha2("norm", 256))


def staged_records(spark, sf):
    """Staged, so that texts are normalised once. key: the normal form's digest, which joins and groups carry in its place."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    leak = table(spark, sf, "benchmark").where("item_id % 5 = 0").select((F.col("item_id") + 10000000).alias("id"), F.lit("leak").alias("source"), "text")
    rows = docs.unionByName(leak).select("id", "source", X.normalize_question(F.col("text")).alias("norm"))
    return stage(rows.select("*", F.sha2("norm", 256).alias("key"), (F.col("norm") == "").alias("blank")), "records")


def records(spark, sf):
    return staged_records(spark, sf).df


def keyed(spark, sf):
    return records(spark, sf).drop("norm"), heldout(spark, sf).select("source", "key")


SLICE = f"""
WITH h AS ({BENCH}), r AS ({RECORDS}),
c AS (SELECT r.*, s.sources FROM r LEFT JOIN (SELECT norm, list_sort(list(DISTINCT source)) AS sources FROM h GROUP BY norm) s USING (norm)),
k AS (SELECT *, first_value(id::VARCHAR) OVER (PARTITION BY norm ORDER BY id::VARCHAR) AS first_id FROM c WHERE sources IS NULL AND norm <> ''),
o AS (SELECT id, source, row_number() OVER (ORDER BY sha256('42:' || id::VARCHAR), id) AS k FROM k WHERE id::VARCHAR = first_id)
"""


def _slice(spark, sf):
    rows = C.exact_contamination(*keyed(spark, sf), "key")
    clean = rows.where(F.col("heldout_sources").isNull() & ~F.col("blank"))
    return rows, C.first_of_duplicates(clean, "key")


@query("curation_slice", SLICE + "SELECT id, source, CASE WHEN k <= 400 THEN 'train' ELSE 'validation' END AS split FROM o WHERE k <= 500")
def curation_slice(spark, sf):
    """J1, J3, W3: which records survive into which split."""
    _, kept = _slice(spark, sf)
    return C.hash_split(kept.where("duplicate_of IS NULL").select("id", "source"), 42, {"train": 400, "validation": 100}).select("id", "source", "split")


@query("curation_rejects", SLICE + """
SELECT reason, count(*) AS n FROM (
  SELECT 'empty_question' AS reason FROM c WHERE norm = '' UNION ALL
  SELECT 'exact_match' FROM c WHERE sources IS NOT NULL UNION ALL
  SELECT 'internal_normalized_duplicate' FROM k WHERE id::VARCHAR <> first_id) GROUP BY reason""")
def curation_rejects(spark, sf):
    """U1, A4: union of the reject streams, counted by reason."""
    rows, kept = _slice(spark, sf)
    empty = rows.where("blank AND heldout_sources IS NULL").select("id", F.lit("empty_question").alias("reason"))
    exact = rows.where("heldout_sources IS NOT NULL").select("id", F.lit("exact_match").alias("reason"), "heldout_sources")
    twice = kept.where("duplicate_of IS NOT NULL").select("id", F.lit("internal_normalized_duplicate").alias("reason"), "duplicate_of")
    every = empty.unionByName(exact, allowMissingColumns=True).unionByName(twice, allowMissingColumns=True)
    return C.reason_counts(every)


@query("j1_exact_contamination", f"""
WITH h AS ({BENCH}), r AS ({RECORDS})
SELECT r.id, list_sort(list(DISTINCT h.source)) AS heldout_sources FROM r JOIN h USING (norm) GROUP BY r.id""")
def j1(spark, sf):
    return C.exact_contamination(*keyed(spark, sf), "key").where("heldout_sources IS NOT NULL").select("id", "heldout_sources")


@query("j3_internal_duplicates", f"""
WITH r AS ({RECORDS}), f AS (SELECT id, first_value(id::VARCHAR) OVER (PARTITION BY norm ORDER BY id::VARCHAR) AS first_id FROM r)
SELECT id, first_id AS duplicate_of FROM f WHERE id::VARCHAR <> first_id""")
def j3(spark, sf):
    return C.first_of_duplicates(records(spark, sf).drop("norm"), "key").where("duplicate_of IS NOT NULL").select("id", "duplicate_of")


GRAMS = f"""
m AS (SELECT id, norm FROM ({RECORDS})), r AS (SELECT min(id) AS id, norm FROM m GROUP BY norm),
g AS (SELECT DISTINCT id, unnest(CASE WHEN length(norm) <= 5 THEN [norm] ELSE list_transform(range(1, length(norm) - 3), lambda i: substr(norm, i, 5)) END) AS gram FROM r),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id)"""
PAIRS = f"""{GRAMS},
o AS (SELECT a.id AS left_id, b.id AS right_id, count(*) AS overlap FROM g a JOIN g b ON a.gram = b.gram AND a.id < b.id
      JOIN n na ON na.id = a.id JOIN n nb ON nb.id = b.id WHERE least(na.n, nb.n) >= 0.85 * greatest(na.n, nb.n) - 1e-9 GROUP BY 1, 2),
p AS (SELECT left_id, right_id, overlap::INT AS overlap, round(overlap / (na.n + nb.n - overlap), 6) AS similarity
      FROM o JOIN n na ON na.id = left_id JOIN n nb ON nb.id = right_id WHERE overlap / (na.n + nb.n - overlap) >= 0.85)"""


def _classes(spark, sf, grams=C.gram_sets, members=True):
    """Grams of the distinct texts (id: the smallest of a text), and every record's class. Texts that gram sets have taken over do not stay on disk."""
    rows = staged_records(spark, sf)
    classes = stage(rows.df.groupBy("norm", "key").agg(F.min("id").alias("class_id")), "classes")
    own = rows.df.select("id", "key").join(classes.df.select("key", "class_id"), "key").select("id", "class_id") if members else None
    if grams is not C.gram_sets:
        return grams(classes.df, "class_id", "norm"), own
    own = stage(own, "members").df if members else None
    rows.drop()
    sets = grams(classes.df, "class_id", "norm")
    classes.drop()
    return sets, own


@query("f3_gram_counts", f"WITH {GRAMS} SELECT m.id, n::INT AS n FROM m JOIN r USING (norm) JOIN n ON n.id = r.id")
def f3(spark, sf):
    counts, members = _classes(spark, sf, C.gram_counts)
    return members.join(counts.withColumnRenamed("id", "class_id"), "class_id").select("id", "n")


@query("f4_similar_texts", f"WITH {PAIRS} SELECT * FROM p")
def f4(spark, sf):
    """Pairs of distinct texts (named by their classes) with overlap and similarity."""
    return C.similarity_join(_classes(spark, sf, members=False)[0], None, 0.85)


@query("j2_near_duplicates", f"""
WITH {PAIRS}, q AS (SELECT left_id AS c, right_id AS d FROM p UNION ALL SELECT right_id, left_id FROM p),
l AS (SELECT c, count(*) AS links, list(d ORDER BY d) AS partners FROM q GROUP BY c)
SELECT m.id, r.id AS class_id, coalesce(links, 0) AS links, coalesce(partners, []::BIGINT[]) AS partners FROM m JOIN r USING (norm) LEFT JOIN l ON l.c = r.id""")
def j2(spark, sf):
    """Every record with its class of equal texts, and the classes that are similar to it."""
    grams, members = _classes(spark, sf)
    pairs = stage(C.similarity_join(grams, None, 0.85).select("left_id", "right_id"), "similar").df
    both = pairs.unionByName(pairs.select(F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id")))
    links = both.groupBy(F.col("left_id").alias("class_id")).agg(F.count("*").alias("links"), F.array_sort(F.collect_list("right_id")).alias("partners"))
    none = F.array().cast("array<bigint>")
    return members.join(links, "class_id", "left").select("id", "class_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("partners", none).alias("partners"))


@query("j2_near_contamination", f"""
WITH {GRAMS}, b AS (SELECT item_id, {norm_sql("text || ' copy'")} AS norm FROM benchmark),
bg AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, length(norm) - 3), lambda i: substr(norm, i, 5))) AS gram FROM b),
bn AS (SELECT item_id, count(*) AS n FROM bg GROUP BY 1),
o AS (SELECT g.id AS left_id, item_id AS right_id, count(*) AS overlap FROM g JOIN bg USING (gram) GROUP BY 1, 2),
q AS (SELECT left_id, right_id, overlap, overlap / (n.n + bn.n - overlap) AS similarity FROM o JOIN n ON n.id = left_id JOIN bn ON bn.item_id = right_id),
t AS (SELECT left_id, right_id AS match_id, similarity FROM q WHERE similarity >= 0.85 QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY overlap DESC, right_id) = 1)
SELECT m.id, match_id, round(similarity, 6) AS similarity FROM m JOIN r USING (norm) JOIN t ON t.left_id = r.id""")
def j2_heldout(spark, sf):
    """Every record that is near a slightly changed held-out text, with the qualifying candidate of highest overlap."""
    grams, members = _classes(spark, sf)
    b = table(spark, sf, "benchmark").select("item_id", X.normalize_question(F.concat("text", F.lit(" copy"))).alias("norm"))
    near = C.near_contamination(C.similarity_join(grams, C.gram_sets(b, "item_id", "norm"), 0.85))
    return members.join(near.withColumnRenamed("left_id", "class_id"), "class_id").select("id", "match_id", "similarity")


@query("w3_hash_split", """
SELECT doc_id AS id, CASE WHEN k <= 60 THEN 'train' ELSE 'validation' END AS split FROM (
SELECT doc_id, row_number() OVER (ORDER BY sha256('7:' || doc_id::VARCHAR), doc_id) AS k FROM documents) WHERE k <= 90""")
def w3(spark, sf):
    return C.hash_split(table(spark, sf, "documents").select(F.col("doc_id").alias("id")), 7, {"train": 60, "validation": 30})


@query("k5_snapshot", f"""
WITH h AS ({BENCH})
SELECT source, count(*) AS questions, count(DISTINCT norm) AS unique_questions, sha256(array_to_string(list_sort(list(DISTINCT norm)), chr(10))) AS sha256 FROM h GROUP BY source""")
def k5(spark, sf):
    return C.snapshot(heldout(spark, sf))


@query("k5_combined_hash", f"""
WITH h AS ({BENCH}), s AS (SELECT source, array_to_string(list_transform(list_sort(list(DISTINCT norm)), lambda x: to_json(x)::VARCHAR), ', ') AS own FROM h WHERE norm <> '' GROUP BY source)
SELECT sha256('{{' || string_agg(to_json(source)::VARCHAR || ': [' || own || ']', ', ' ORDER BY source) || '}}') AS combined FROM s""")
def k5_combined(spark, sf):
    return C.combined_hash(heldout(spark, sf))


@query("k6_manifest", f"""
WITH h AS ({BENCH}), r AS ({RECORDS}),
c AS (SELECT count(*) AS source_rows, count(DISTINCT norm) AS unique_rows, count(*) FILTER (norm IN (SELECT norm FROM h)) AS contaminated, (SELECT count(*) FROM h) AS heldout_rows FROM r)
SELECT to_json(c)::VARCHAR AS manifest FROM c""")
def k6(spark, sf):
    h = heldout(spark, sf)
    sides = h.select("norm").distinct().withColumn("hit", F.lit(1))
    rows = records(spark, sf).join(sides, "norm", "left")
    counts = rows.agg(F.count("*").alias("source_rows"), F.count_distinct("norm").alias("unique_rows"), F.count("hit").alias("contaminated"))
    return K.manifest(counts.withColumn("heldout_rows", F.lit(h.count()).cast("long")))


@query("f1_document_forms", f"SELECT doc_id, sha256({norm_sql('text')}) AS norm FROM (SELECT doc_id, '  ' || text || chr(10) || ' Please reason STEP by step! ' AS text FROM documents)")
def f1_documents(spark, sf):
    """Normal forms of whole documents behind an instruction line, as digests."""
    t = F.concat(F.lit("  "), "text", F.lit("\n Please reason STEP by step! "))
    return table(spark, sf, "documents").select("doc_id", F.sha2(X.normalize_question(t), 256).alias("norm"))


@query("f1_normal_forms", """
SELECT k, norm FROM (VALUES (0, 'full fi 1 ss'), (1, 'a b=c'), (2, 'what is x?'), (3, 'keep me')) v(k, norm)""")
def f1(spark, sf):
    """Compatibility forms, full case folding, punctuation and instruction lines, against literal results."""
    rows = [(0, "Ｆｕｌｌ ﬁ ① ẞ"), (1, "  A\u00a0\tB  = C "), (2, "What is X?\nPlease reason step by step"), (3, "Ｐlease reason step by step\u2028Keep me")]
    return spark.createDataFrame(rows, "k int, raw string").select("k", X.normalize_question(F.col("raw")).alias("norm"))


@query("s8_category_scan", f"""
SELECT id, fp FROM (
  SELECT doc_id AS id, sha256({compact_sql("replace(lower(text), 'ß', 'ss')")}) AS fp,
         row_number() OVER (PARTITION BY sha256({compact_sql("replace(lower(text), 'ß', 'ss')")}) ORDER BY sha256('page|' || (doc_id // 100)::VARCHAR), doc_id) AS k,
         sha256('page|' || (doc_id // 100)::VARCHAR) AS page
  FROM documents WHERE source IN ('src1', 'src2', 'src3') AND {trim_sql("text")} <> '') WHERE k = 1 ORDER BY page, id LIMIT 50""")
def s8(spark, sf):
    """Category filter, blanks dropped, first of equal fingerprints in shuffled page order, stop at N."""
    from ..operators.records import category_scan

    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("category"))
    return category_scan(docs, ["src1", "src2", "src3"], 50, 100, "page").select("id", "fp")


@query("f2_fingerprints", f"SELECT doc_id, sha256({compact_sql("replace(lower(text), 'ß', 'ss')")}) AS fp FROM documents")
def f2(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.problem_fingerprint(F.col("text")).alias("fp"))


@query("p16_markers", """
SELECT doc_id, contains(text, 'the ') OR contains(text, 'der ') AS has_any,
       CASE WHEN contains(text, 'der ') THEN 'der ' WHEN contains(text, 'the ') THEN 'the ' END AS first_marker,
       ((length(text) - length(replace(text, 'the', ''))) // 3)::INT AS n FROM documents""")
def p16(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", X.contains_any(t, ["the ", "der "]).alias("has_any"), X.first_marker(t, ["der ", "the "]).alias("first_marker"), X.occurrences(t, "the").alias("n"))


@query("f37_slugs", r"""
SELECT page_id, left(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), 64)
       || '-' || left(sha256(url || '|' || page_id::VARCHAR), 8) AS key FROM pages""")
def k8(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.output_key(F.col("url"), F.col("url"), F.col("page_id").cast("string")).alias("key"))
