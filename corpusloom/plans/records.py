"""Queries over sources, sinks, batch algebra and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import batches as B
from ..scratch import scratch_path, stage
from ..sources import readers as S
from ..sources import sinks as K
from ..streaming import ingest as T
from .base import Registry, table

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query("s1_k1_jsonl_round_trip", "SELECT doc_id, text, lang FROM documents")
def s1(spark, sf):
    path = scratch_path(spark, "jsonl")
    K.write_jsonl(table(spark, sf, "documents").select("doc_id", "text", "lang"), path)
    return S.read_jsonl(spark, path, "doc_id long, text string, lang string")


@query("s5_csv_round_trip", "SELECT p_partkey, p_name, p_type FROM part")
def s5(spark, sf):
    path = scratch_path(spark, "csv")
    table(spark, sf, "part").select("p_partkey", "p_name", "p_type").write.option("header", True).csv(path)
    return S.read_csv(spark, path, "p_partkey long, p_name string, p_type string")


@query("s7_heldout_union", "SELECT source, count(*) AS n FROM (SELECT 'benchmark' AS source FROM benchmark UNION ALL SELECT 'pages' FROM pages UNION ALL SELECT 'turns' FROM conversations WHERE role = 'user') GROUP BY 1")
def s7(spark, sf):
    parts = [
        table(spark, sf, "benchmark").select(F.lit("benchmark").alias("source"), F.col("text").alias("question")),
        table(spark, sf, "pages").select(F.lit("pages").alias("source"), F.col("url").alias("question")),
        table(spark, sf, "conversations").where("role = 'user'").select(F.lit("turns").alias("source"), F.col("text").alias("question")),
    ]
    return B.concat(parts).groupBy("source").agg(F.count("*").alias("n"))


@query("u2_first_meta", "SELECT key, n, 'nation' AS meta FROM (SELECT n_nationkey::BIGINT AS key, count(*) AS n FROM (SELECT n_nationkey FROM nation UNION ALL SELECT r_regionkey FROM region) GROUP BY 1)")
def u2(spark, sf):
    """Batches with equal columns and different descriptions: all rows, the first description."""
    batches = [(table(spark, sf, t).select(F.col(f"{t[0]}_{t}key").cast("long").alias("key")), {"table": t}) for t in ("nation", "region")]
    rows, meta = B.concat_with_meta(batches)
    return rows.groupBy("key").agg(F.count("*").alias("n")).withColumn("meta", F.lit(meta["table"]))


@query("s12_answer_handler", "SELECT text AS question, source AS answer FROM documents")
def s12(spark, sf):
    path = scratch_path(spark, "gsm")
    d = table(spark, sf, "documents")
    K.write_jsonl(d.select(F.col("text").alias("question"), F.concat(F.lit("work #### "), "source").alias("answer")), path)
    return S.dataset(spark, "gsm8k", path)


@query("s13_multiple_choice", """
SELECT p_partkey AS id, p_name || chr(10) || 'A. ' || p_brand || chr(10) || 'B. ' || p_type || chr(10) || 'C. none' AS question, chr(65 + (p_partkey % 3)::INT) AS answer
FROM (SELECT *, sha256('4:' || p_partkey::VARCHAR) AS h FROM part) ORDER BY h, p_partkey LIMIT 100""")
def s13(spark, sf):
    p = table(spark, sf, "part")
    rows = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("question"), F.array("p_brand", "p_type", F.lit("none")).alias("options"), (F.col("p_partkey") % 3).cast("int").alias("answer_index"))
    return S.multiple_choice(rows, 4, 100)


@query("k7_write_splits", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'validation' ELSE 'train' END AS split FROM documents")
def k7(spark, sf):
    path = scratch_path(spark, "splits")
    rows = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, "validation").otherwise("train").alias("split"))
    K.write_splits(rows, path)
    return spark.read.parquet(path).select("doc_id", "split")


@query("k10_batch_save_load", "SELECT vec_id, label FROM embeddings")
def k10(spark, sf):
    path = scratch_path(spark, "batch")
    K.save_batch(table(spark, sf, "embeddings").select("vec_id", "label"), {"step": 3}, path)
    return K.load_batch(spark, path)[0]


ORD = "o AS (SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY s_suppkey) - 1 AS ord FROM supplier)"


def suppliers(spark, sf):
    return B.numbered(table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), ["s_suppkey"])


@query("p12_take_slice", f"WITH {ORD} SELECT s_suppkey, ord FROM o WHERE ord >= 3 AND ord < 60 AND (ord - 3) % 4 = 0")
def p12(spark, sf):
    return B.take(suppliers(spark, sf), start=3, stop=60, step=4).select("s_suppkey", "ord")


@query("p11_select_and_pop", "SELECT s_suppkey FROM supplier")
def p11(spark, sf):
    popped, _ = B.pop(table(spark, sf, "supplier"), ["s_suppkey", "unknown"])
    return B.select_known(popped, ["s_suppkey", "nothing"])


@query("j5_union_columns", f"WITH {ORD} SELECT ord, s_suppkey, s_acctbal, s_acctbal * 2 AS twice FROM o")
def j5(spark, sf):
    s = suppliers(spark, sf)
    return B.union_columns(s, s.select("ord", "s_acctbal", (F.col("s_acctbal") * 2).alias("twice"))).select("ord", "s_suppkey", "s_acctbal", "twice")


@query("j8_repeat_interleaved", f"WITH {ORD} SELECT s_suppkey, c::INT AS sample_index, ord * 3 + c AS place FROM o, range(3) r(c)")
def j8(spark, sf):
    return B.repeat_prompts(suppliers(spark, sf), 3).select("s_suppkey", "sample_index", "place")


@query("j8_repeat_tiled", f"WITH {ORD} SELECT s_suppkey, c * (SELECT count(*) FROM o) + ord AS place FROM o, range(2) r(c)")
def j8_tiled(spark, sf):
    return B.repeat(suppliers(spark, sf), 2, interleave=False).select("s_suppkey", "place")


@query("u6_chunk", f"WITH {ORD} SELECT s_suppkey, ord // ((SELECT count(*) FROM o) // 5) AS chunk FROM o")
def u6(spark, sf):
    return B.chunk(suppliers(spark, sf), 5).select("s_suppkey", "chunk")


@query("u7_pad_to_divisor", f"WITH {ORD}, n AS (SELECT count(*) AS n FROM o) SELECT s_suppkey, ord, false AS padded FROM o UNION ALL SELECT s_suppkey, ord + n, true FROM o, n WHERE ord < (7 - n % 7) % 7")
def u7(spark, sf):
    return B.pad_to(suppliers(spark, sf), 7).select("s_suppkey", "ord", "padded")


@query("u8_reorder_and_restore", f"WITH {ORD}, n AS (SELECT count(*) AS n FROM o) SELECT s_suppkey, n - 1 - ord AS ord, ord AS old FROM o, n")
def u8(spark, sf):
    s = suppliers(spark, sf)
    n = s.agg(F.count("*").alias("n"))
    turned = s.join(F.broadcast(n)).select("ord", (F.col("n") - 1 - F.col("ord")).alias("pos"))
    return B.reorder(s, turned).select("s_suppkey", "ord", "old")


@query("u9_fold", f"WITH {ORD} SELECT ord // 4 AS row, list(s_suppkey ORDER BY ord) AS s_suppkey FROM o GROUP BY 1")
def u9(spark, sf):
    return B.fold(suppliers(spark, sf), 4, "s_suppkey")


@query("u14_mini_batches", f"""
WITH {ORD}, e AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY sha256('8:' || ep::VARCHAR || ':' || ord::VARCHAR), ord) - 1 AS k FROM o, range(2) r(ep))
SELECT s_suppkey, ep::INT AS epoch, k // 16 AS batch FROM e WHERE k // 16 < (SELECT count(*) // 16 FROM o)""")
def u14(spark, sf):
    return B.mini_batches(suppliers(spark, sf), 16, 2, 8).select("s_suppkey", "epoch", "batch")


@query("u15_smoke_slice", f"WITH {ORD}, n AS (SELECT count(*) AS n FROM o) SELECT s_suppkey::VARCHAR || '_smoke_' || (ord + lap * n)::VARCHAR AS id FROM o, n, range(3) r(lap) WHERE ord + lap * n < 2 * n + 5")
def u15(spark, sf):
    s = suppliers(spark, sf)
    return B.smoke_slice(s.withColumn("id", F.col("s_suppkey")), 2 * s.count() + 5).select("id")


@query("u3_u4_set_operations", """
WITH w AS (SELECT doc_id, list_distinct(string_split(lower(split_part(text, chr(10), 1)), ' ')) AS a, list_distinct(string_split(lower(substr(text, length(split_part(text, chr(10), 1)) + 2)), ' ')) AS b FROM documents)
SELECT doc_id, len(list_intersect(a, b))::INT AS both_n, len(list_distinct(list_concat(a, b)))::INT AS either_n, len(list_filter(a, lambda x: NOT list_contains(b, x)))::INT AS only_n FROM w""")
def u3(spark, sf):
    """Words of the first line against those of all further lines."""
    words = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    first = F.substring_index("text", "\n", 1)
    d = table(spark, sf, "documents").select("doc_id", words(first).alias("a"), words(F.substring("text", F.char_length(first) + 2, F.char_length("text"))).alias("b"))
    return d.select("doc_id", F.size(F.array_intersect("a", "b")).alias("both_n"), F.size(F.array_union("a", "b")).alias("either_n"), F.size(F.array_except("a", "b")).alias("only_n"))


@query("u18_collate", "SELECT ord // 32 AS row, list(vec_id ORDER BY ord) AS vec_id FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS ord FROM embeddings) GROUP BY 1")
def u18(spark, sf):
    """Batches of 32 rows to one, their values as lists."""
    return B.fold(B.numbered(table(spark, sf, "embeddings").select("vec_id"), ["vec_id"]), 32, "vec_id")


BATCHES = "d AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS ord FROM documents), b AS (SELECT ord // 64 AS batch, ord % 64 AS place, n_chars FROM d), n AS (SELECT batch, count(*) AS n, sum(n_chars)::BIGINT AS chars, max(n_chars) AS most FROM b GROUP BY 1)"


def batches(spark, sf):
    d = B.numbered(table(spark, sf, "documents").select("doc_id", "n_chars"), ["doc_id"])
    return d.withColumn("batch", F.floor(F.col("ord") / 64)).drop("doc_id")


def balanced(spark, sf, method=B.even_parts):
    """Batches of 64 documents in four parts, of equal size where the batch divides; the last batch may not."""
    d = batches(spark, sf)
    whole = F.count(F.lit(1)).over(W.partitionBy("batch")) % 4 == 0
    d = stage(d.withColumn("whole", whole), "batches").df
    parts = [B.balance(d.where(F.col("whole") == equal), "batch", "n_chars", 4, equal, method) for equal in (True, False)]
    return stage(parts[0].unionByName(parts[1]), "parts").df


def invariants(parted):
    """Per batch: rows, sum, and whether every row comes once, sizes are right and sums are near each other."""
    own = parted.groupBy("batch", "part").agg(F.count("*").alias("size"), F.sum("n_chars").alias("s"))
    own = own.groupBy("batch").agg(F.max("size").alias("big"), F.min("size").alias("small"), F.max("s").alias("high"), F.min("s").alias("low"), F.count("*").alias("parts"))
    every = parted.groupBy("batch").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("most"), F.count_distinct("ord").alias("rows"))
    both = every.join(own, "batch")
    sizes = (F.col("n") % 4 != 0) | (F.col("big") == F.col("small"))
    return both.select("batch", "n", "chars", (F.col("rows") == F.col("n")).alias("once"), sizes.alias("sizes_ok"), (F.col("high") - F.col("low") <= F.col("most")).alias("near"))


PARTED = f"WITH {BATCHES} SELECT batch, n, chars, true AS once, true AS sizes_ok, true AS near FROM n"


@query("u10_balanced_partitions", PARTED)
def u10(spark, sf):
    """Largest differencing (invariants; tests compare small batches with all partitions)."""
    return invariants(balanced(spark, sf))


@query("u11_least_loaded", f"WITH {BATCHES} SELECT batch, n, chars, true AS once FROM n")
def u11(spark, sf):
    return invariants(balanced(spark, sf, B.least_loaded)).select("batch", "n", "chars", "once")


@query("u11_least_loaded_parts", f"""
WITH RECURSIVE {BATCHES}, s AS (
  SELECT batch, -1::BIGINT AS place, [0, 0, 0, 0]::BIGINT[] AS sums, -1 AS part FROM n
  UNION ALL
  SELECT s.batch, b.place, list_transform(s.sums, lambda x, i: CASE WHEN i = list_position(s.sums, list_min(s.sums)) THEN x + b.n_chars ELSE x END), list_position(s.sums, list_min(s.sums)) - 1
  FROM s JOIN b ON b.batch = s.batch AND b.place = s.place + 1)
SELECT batch, batch * 64 + place AS ord, part::INT AS part FROM s WHERE place >= 0""")
def u11_parts(spark, sf):
    """The very parts of the greedy partition: in input order each row to the part with the smallest sum."""
    return B.balance(batches(spark, sf), "batch", "n_chars", 4, False, B.least_loaded).select("batch", "ord", "part")


@query("a22_imbalance", f"""
WITH {BATCHES}, k AS (SELECT b.batch, floor(place * 4 / n) AS block, sum(n_chars) AS s FROM b JOIN n USING (batch) GROUP BY ALL)
SELECT batch, min(s)::BIGINT AS min_before, max(s)::BIGINT AS max_before, (max(s) - min(s))::BIGINT AS diff_before, true AS better FROM k GROUP BY 1""")
def a22(spark, sf):
    out = B.imbalance(balanced(spark, sf), "batch", "n_chars", 4)
    return out.select("batch", "min_before", "max_before", "diff_before", (F.col("diff_after") <= F.col("diff_before")).alias("better"))


@query("u12_token_batches", f"WITH {BATCHES} SELECT batch, n, chars, least(n, greatest(1, ceil(chars / 40000)))::BIGINT AS parts, true AS once, true AS falling FROM n")
def u12(spark, sf):
    parted = stage(B.token_batches(batches(spark, sf), "batch", "n_chars", 40_000), "parts").df
    own = parted.groupBy("batch", "part").agg(F.sum(F.col("n_chars").cast("long") * F.col("n_chars")).alias("squares"))
    drop = F.lag("squares").over(W.partitionBy("batch").orderBy("part")) - F.col("squares")
    own = own.withColumn("drop", drop).groupBy("batch").agg(F.count("*").alias("parts"), F.coalesce(F.min(F.col("drop") >= 0), F.lit(True)).alias("falling"))
    every = parted.groupBy("batch").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), (F.count_distinct("ord") == F.count("*")).alias("once"))
    return every.join(own, "batch").select("batch", "n", "chars", "parts", "once", "falling")


@query("u7_unpad", f"WITH {ORD} SELECT s_suppkey, ord FROM o")
def u7_unpad(spark, sf):
    return B.unpad(B.pad_to(suppliers(spark, sf), 7)).select("s_suppkey", "ord")


@query("w16_restore", f"WITH {ORD} SELECT s_suppkey, ord FROM o")
def w16(spark, sf):
    s = suppliers(spark, sf)
    turned = s.join(F.broadcast(s.agg(F.count("*").alias("n")))).select("ord", (F.col("n") - 1 - F.col("ord")).alias("pos"))
    return B.restore(B.reorder(s, turned)).select("s_suppkey", "ord")


# -- streams -------------------------------------------------------------------------------------------

ACTION = "CASE event_type WHEN 'purchase' THEN 'ask' WHEN 'signup' THEN 'verify' WHEN 'click' THEN 'accept' ELSE 'other' END"


def _stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return T.events_stream(spark, f"{sf}/events[.]parquet", schema)  # as a pattern, for a file and a folder alike


@query("t2_running_dedup", "SELECT user_id, event_type FROM events GROUP BY ALL")
def t2(spark, sf):
    out, state = scratch_path(spark, "t2"), scratch_path(spark, "t2-state")
    T.drain(T.deduplicated(_stream(spark, sf).select("user_id", "event_type"), ["user_id", "event_type"]), out, state)
    return spark.read.parquet(out)


@query("t1_resumable_ingest", "SELECT event_id, value FROM events")
def t1(spark, sf):
    """Started twice with one checkpoint: the second start finds nothing new, so that no row comes twice."""
    out, state = scratch_path(spark, "t1"), scratch_path(spark, "t1-state")
    for _ in range(2):
        T.drain(_stream(spark, sf).select("event_id", "value"), out, state, request={"table": "events", "columns": ["event_id", "value"]})
    return spark.read.parquet(out)


@query("t3_stop_after_n", "SELECT least(count(*), 500) AS n FROM events")
def t3(spark, sf):
    out, state = scratch_path(spark, "t3"), scratch_path(spark, "t3-state")
    T.take_until(_stream(spark, sf).select("event_id"), 500, out, state)
    return spark.read.format("committed").schema("event_id long").option("path", out).load().agg(F.count("*").alias("n"))


@query("t4_request_state", f"""
WITH a AS (SELECT user_id, event_id, {ACTION} AS action FROM events),
p AS (SELECT *, lag(action) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM a WHERE action IN ('verify', 'accept'))
SELECT a.user_id, count(*) AS n_events, count(*) FILTER (a.action = 'ask') AS asks, count(*) FILTER (a.action = 'verify') AS verifies,
 count(*) FILTER (p.action = 'accept' AND p.before = 'verify') AS accepts, count(*) FILTER (p.action = 'accept' AND coalesce(p.before, '') <> 'verify') AS invalid_accepts
FROM a LEFT JOIN p USING (user_id, event_id) GROUP BY 1""")
def t4(spark, sf):
    out, state = scratch_path(spark, "t4"), scratch_path(spark, "t4-state")
    stream = T.request_state(_stream(spark, sf).select("user_id", "event_id", F.expr(ACTION).alias("action")))

    T.drain_updates(stream, out, state)
    rows = spark.read.parquet(out)
    last = rows.groupBy("user_id").agg(F.max_by(F.struct("n_events", "asks", "verifies", "accepts", "invalid_accepts"), "epoch").alias("r"))
    return last.select("user_id", "r.*")


@query("t6_windowed_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING max(ts) IS NOT NULL")
def t6(spark, sf):
    """The windowed stream in update mode: of each window the last count stays."""
    out, state = scratch_path(spark, "t6"), scratch_path(spark, "t6-state")
    T.drain_updates(T.windowed_counts(_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "10 minutes", "event_type"), out, state)
    return spark.read.parquet(out).groupBy(F.col("start").cast("timestamp_ntz").alias("start"), "event_type").agg(F.max_by("n", "epoch").alias("n"))
