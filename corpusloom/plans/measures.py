"""Queries over real tokens, equal answers, long recurrences and barrier stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import config as G
from ..functions import equivalence as E
from ..functions import text as X
from ..functions import tokens as K
from ..operators import gather, scans
from ..operators import protocol as P
from ..operators.batches import numbered
from . import traces
from .base import Registry, rounded, table

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query("f5_boxed_documents", "SELECT doc_id, doc_id::VARCHAR AS box, n_chars::VARCHAR AS any_case FROM documents")
def f5(spark, sf):
    """Boxes behind whole texts, among letters whose lower case is longer, open boxes and nested braces."""
    said = F.concat("text", F.lit("}{ İİ \\boxed{{1}} \\boxed{\\boxed{ "), F.col("doc_id").cast("string"), F.lit(" } \\BOXED { "), F.col("n_chars").cast("string"), F.lit("} \\boxed{\\boxed{"))
    return table(spark, sf, "documents").select("doc_id", X.last_boxed(said).alias("box"), X.last_boxed_any_case(said).alias("any_case"))


@query("f12_equivalent_answers", """
SELECT l_orderkey, l_linenumber, l_orderkey % 3 <> 0 AS equal FROM lineitem""")
def f12(spark, sf):
    """Every price in one of eight spellings against its decimal form; a third of them is a cent off."""
    cents = F.round(F.col("l_extendedprice").cast("double") * 100).cast("long")
    said = cents + F.when(F.col("l_orderkey") % 3 == 0, 1).otherwise(0)
    s, whole, rest = (c.cast("string") for c in (said, F.floor(said / 100), F.lpad((said % 100).cast("string"), 2, "0")))
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 8
    lit = F.lit
    spelt = (
        F.when(k == 0, F.concat(lit("\\frac{"), s, lit("}{100}")))
        .when(k == 1, F.concat(F.format_number(F.floor(said / 100), 0), lit("."), rest))
        .when(k == 2, F.concat(lit("x = "), whole, lit(" + \\frac{"), rest, lit("}{100}")))
        .when(k == 3, F.concat(s, lit("%")))
        .when(k == 4, F.concat(lit("\\dfrac{"), (said * 3).cast("string"), lit("}{3 \\cdot 10^{2}}")))
        .when(k == 5, F.concat(lit("$\\left("), s, lit("\\right) / (50 + 50)$")))
        .when(k == 6, F.concat(lit("\\frac{\\sqrt{8} \\times "), s, lit("}{200\\sqrt2}")))
        .otherwise(F.concat(lit("-(-"), whole, lit(" - 0."), rest, lit(").")))
    )
    gold = F.concat(F.floor(cents / 100).cast("string"), lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", E.equivalent(spelt, gold).alias("equal"))


def _rendered(spark, sf):
    """conv_id, whole text of a conversation, spans of what the assistant says."""
    c = traces._conversations(spark, sf)
    return c.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("text"), P.loss_spans(F.col("segments")).alias("spans"))


@query("f27_conversation_labels", """
SELECT conv_id, sum(length(text))::BIGINT AS n_chars, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS trained_chars FROM conversations
GROUP BY 1 HAVING bool_and(length(text) = strlen(text))""")
def f27(spark, sf):
    """Labels of whole conversations by a real tokenizer, as characters that all tokens and the trained ones cover.

    A token across a span's edge is not trained: its characters inside the span are added here. Only ASCII
    conversations are compared, where a token covers whole characters.
    """
    rows = _rendered(spark, sf).where(F.octet_length("text") == F.char_length("text"))
    rows = K.labelled(rows.select("conv_id", "text", "spans"), "text", "spans")
    parts = F.arrays_zip(F.col("starts").alias("a"), F.col("ends").alias("b"), F.col("labels").alias("l"))
    within = lambda x: F.aggregate("spans", F.lit(0), lambda n, s: n + F.greatest(F.lit(0), F.least(x["b"], s["end"]) - F.greatest(x["a"], s["start"])))
    trained = lambda x: F.when(x["l"] != K.IGNORED, x["b"] - x["a"]).otherwise(within(x))
    # an untrained token lies in no span as a whole, or the definition is broken: such a row shows as -1
    broken = F.exists(parts, lambda x: (x["l"] == K.IGNORED) & F.exists("spans", lambda s: (x["a"] >= s["start"]) & (x["b"] <= s["end"]) & (x["b"] > x["a"])))
    total = lambda f: F.aggregate(parts, F.lit(0), lambda n, x: n + f(x)).cast("long")
    return rows.select("conv_id", total(lambda x: x["b"] - x["a"]).alias("n_chars"), F.when(broken, F.lit(-1)).otherwise(total(trained)).cast("long").alias("trained_chars"))


@query("p9_token_limit")
def p9(spark, sf):
    """Documents of at most 256 real tokens."""
    return table(spark, sf, "documents").where(K.within(F.col("text"), 256)).select("doc_id", K.token_count(F.col("text")).alias("n_tokens"))


@query("p10_trainable_conversations")
def p10(spark, sf):
    """Conversations that keep a trained token within their first 64."""
    rows = _rendered(spark, sf).select("conv_id", K.labels(F.col("text"), F.col("spans"), most=64)["labels"].alias("labels"))
    return P.trainable_after_cut(rows, "labels", 64).select("conv_id")


@query("p20_split_words")
def p20(spark, sf):
    """Languages, sources and kinds of events that the tokenizer does not know as one id of their own."""
    d, e = table(spark, sf, "documents"), table(spark, sf, "events")
    words = d.select(F.col("lang").alias("token")).union(d.select("source")).union(e.select("event_type")).where("token IS NOT NULL").distinct()
    return P.split_tokens(words.select("token", K.tokens(F.col("token"))["ids"].alias("ids")), -1)


@query("f35_flat_orders", """
SELECT o_orderkey AS id, o_custkey AS customer__key, o_orderstatus AS state__now, o_totalprice AS state__sums__price FROM orders""")
def f35(spark, sf):
    """Nested rows as dotted columns, and back, and again."""
    o = table(spark, sf, "orders")
    nested = o.select(F.col("o_orderkey").alias("id"), F.struct(F.col("o_custkey").alias("key")).alias("customer"), F.struct(F.col("o_orderstatus").alias("now"), F.struct(F.col("o_totalprice").alias("price")).alias("sums")).alias("state"))
    flat = G.flat_columns(G.nested_columns(G.flat_columns(nested)))
    return flat.toDF(*[c.replace(".", "__") for c in flat.columns])


LINES = "l AS (SELECT l_returnflag AS key, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount) - 1 AS place, l_quantity::DOUBLE AS reward, l_discount::DOUBLE AS value, (l_linenumber < 4)::INT AS mask FROM lineitem)"
FAR = 160


def _sequences(spark, sf):
    """All line items as three long sequences, one a return flag."""
    cols = (F.col("l_returnflag").alias("key"), F.col("l_quantity").cast("double").alias("reward"), F.col("l_discount").cast("double").alias("value"), (F.col("l_linenumber") < 4).cast("int").alias("mask"))
    by = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = numbered(table(spark, sf, "lineitem").select(*cols, *by), ["key", *by, "reward", "value"])
    first = rows.groupBy("key").agg(F.min("ord").alias("first"))
    return rows.join(first, "key").select("key", (F.col("ord") - F.col("first")).alias("place"), "reward", "value", "mask")


@query("w9_long_sequences", f"""
WITH {LINES}, d AS (SELECT key, place, reward + 0.9 * coalesce(lead(value) OVER (PARTITION BY key ORDER BY place), 0) - value AS d FROM l),
w AS (SELECT key, place, list(d) OVER (PARTITION BY key ORDER BY place ROWS BETWEEN CURRENT ROW AND {FAR} FOLLOWING) AS ds FROM d)
SELECT key, place, round(list_sum(list_transform(ds, lambda x, i: x * pow(0.72, i - 1))), 6) AS advantage FROM w""")
def w9(spark, sf):
    """gamma 0.9, lambda 0.8: what lies over {FAR} steps away counts under 1e-22, so that a window is the oracle."""
    return scans.gae(_sequences(spark, sf), 0.9, 0.8, block=1 << 12).select("key", "place", rounded(F.col("y")).alias("advantage"))


@query("w10_long_sequences", f"""
WITH {LINES}, w AS (SELECT key, place, list({{'r': reward, 'm': mask}}) OVER (PARTITION BY key ORDER BY place ROWS BETWEEN CURRENT ROW AND {FAR} FOLLOWING) AS xs FROM l),
c AS (SELECT key, place, list_transform(xs, lambda x: x.r) AS rs, coalesce(list_position(list_transform(xs[2:], lambda x: x.m), 0), {FAR + 1}) AS cut FROM w)
SELECT key, place, round(list_sum(list_transform(rs[:cut], lambda x, i: x * pow(0.8, i - 1))), 6) AS y FROM c""")
def w10(spark, sf):
    return scans.discounted_returns(_sequences(spark, sf), 0.8, block=1 << 12).select("key", "place", rounded(F.col("y")).alias("y"))


@query("u17_a20_barrier_whitening", """
WITH v AS (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT avg(x) AS mean, var_samp(x) AS var FROM v)
SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS ord, list_transform(embedding, lambda x: round((x::DOUBLE - mean) / sqrt(var + 1e-8), 6)) AS embedding FROM embeddings, m""")
def u17(spark, sf):
    """Places and whitened components of all vectors by one barrier stage: counts and moments go from task to task."""
    out = gather.whitened(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return out.select("vec_id", "ord", F.transform("embedding", lambda x: rounded(x)).alias("embedding"))
