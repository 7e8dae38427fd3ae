"""Queries over rollouts: embeddings stand in for token arrays, labels for prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import rewards as R
from ..operators import rollouts as O
from . import base
from .base import Registry, table

query = Registry()
QUERIES, SQL = query.queries, query.sql

EMB = "e AS (SELECT vec_id, label AS uid, (vec_id % 7)::DOUBLE AS score, embedding::DOUBLE[] AS v, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS m, list_transform(embedding::DOUBLE[], lambda x: (floor(abs(x) * 20))::BIGINT) AS t, list_reverse(embedding::DOUBLE[]) AS w FROM embeddings)"
TOK = EMB + ", k AS (SELECT vec_id, uid, unnest(v) AS v, unnest(w) AS w, unnest(m) AS m, unnest(range(0, len(v))) AS i FROM e)"


def emb(spark, sf):
    x = table(spark, sf, "embeddings")
    v = F.col("embedding").cast("array<double>")
    return x.select(
        "vec_id", F.col("label").alias("uid"), (F.col("vec_id") % 7).cast("double").alias("score"), v.alias("v"),
        F.transform("embedding", lambda t: F.when(t > 0, 1).otherwise(0)).alias("m"),
        F.transform(v, lambda t: F.floor(F.abs(t) * 20)).alias("t"), F.reverse(v).alias("w"),
    )


def rounded(x, n=6):
    return F.transform(x, lambda t: base.rounded(t, n))


@query("w6_grpo", f"WITH {EMB} SELECT vec_id, (score - avg(score) OVER g) / (stddev_samp(score) OVER g + 1e-6) AS advantage FROM e WINDOW g AS (PARTITION BY uid)")
def w6(spark, sf):
    return O.advantages(emb(spark, sf), "grpo").select("vec_id", "advantage")


@query("w7_rloo", f"WITH {EMB} SELECT vec_id, score - (sum(score) OVER g - score) / (count(*) OVER g - 1) AS advantage FROM e WINDOW g AS (PARTITION BY uid)")
def w7(spark, sf):
    return O.advantages(emb(spark, sf), "rloo").select("vec_id", "advantage")


@query("w8_remax", f"WITH {EMB} SELECT vec_id, score - vec_id % 3 AS advantage FROM e")
def w8(spark, sf):
    return O.advantages(emb(spark, sf).withColumn("baseline", F.col("vec_id") % 3), "remax").select("vec_id", "advantage")


@query("w9_gae", f"""
WITH {TOK}, d AS (SELECT vec_id, i, v + 0.95 * coalesce(lead(w) OVER (PARTITION BY vec_id ORDER BY i), 0) - w AS d FROM k),
a AS (SELECT vec_id, i, sum(d * 0.855 ** i) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / 0.855 ** i AS a FROM d)
SELECT vec_id, list(round(a, 6) ORDER BY i) AS advantages FROM a GROUP BY 1""")
def w9(spark, sf):
    return emb(spark, sf).select("vec_id", rounded(O.gae(F.col("v"), F.col("w"), 0.95, 0.9)).alias("advantages"))


@query("w10_discounted_returns", f"""
WITH {TOK}, a AS (SELECT vec_id, i, sum(v * 0.9 ** i) OVER (PARTITION BY vec_id, i < 20 ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / 0.9 ** i AS g FROM k)
SELECT vec_id, list(round(g, 6) ORDER BY i) AS returns FROM a GROUP BY 1""")
def w10(spark, sf):
    mask = F.transform("v", lambda _, i: F.when(i == 20, 0).otherwise(1))
    return emb(spark, sf).select("vec_id", rounded(O.discounted_returns(F.col("v"), mask, 0.9)).alias("returns"))


@query("w11_response_mask", f"WITH {EMB} SELECT vec_id, list_transform(t, lambda x, i: CASE WHEN coalesce(list_position(t, 3), 0) = 0 OR i <= list_position(t, 3) THEN 1 ELSE 0 END) AS mask FROM e")
def w11(spark, sf):
    return emb(spark, sf).select("vec_id", O.response_mask(F.col("t"), 3).alias("mask"))


@query("w12_position_ids", f"WITH {EMB} SELECT vec_id, list_transform(m, lambda x, i: greatest(list_sum(m[1:i]) - 1, 0)::INT) AS ids FROM e")
def w12(spark, sf):
    return emb(spark, sf).select("vec_id", O.position_ids(F.col("m")).alias("ids"))


@query("w13_reward_on_last", f"WITH {EMB} SELECT vec_id, list_transform(m, lambda x, i: CASE WHEN x = 1 AND list_sum(m[i:]) = 1 THEN score ELSE 0.0 END) AS rewards FROM e")
def w13(spark, sf):
    return emb(spark, sf).select("vec_id", O.reward_on_last(F.col("m"), F.col("score")).alias("rewards"))


@query("f28_pad", f"WITH {EMB} SELECT vec_id, list_concat(t[1:40], list_transform(range(0, 0), lambda x: x)) AS cut, list_concat(list_transform(range(0, 6), lambda x: -1::BIGINT), t) AS padded FROM e")
def f28(spark, sf):
    return emb(spark, sf).select("vec_id", O.pad(F.col("t"), 40, -1, truncate="right").alias("cut"), O.pad(F.col("t"), 70, -1, side="left").alias("padded"))


@query("f29_collate", f"""
WITH {EMB}, s AS (SELECT vec_id, uid, t[1:vec_id % 9 + 1] AS t FROM e), x AS (SELECT *, max(len(t)) OVER (PARTITION BY uid) - len(t) AS more FROM s)
SELECT vec_id, list_concat(t, list_transform(range(0, more), lambda x: 0::BIGINT)) AS input_ids, list_concat(list_transform(t, lambda x: 1), list_transform(range(0, more), lambda x: 0)) AS attention_mask FROM x""")
def f29(spark, sf):
    s = emb(spark, sf).withColumn("t", F.slice("t", 1, (F.col("vec_id") % 9 + 1).cast("int")))
    return O.collate(s, "uid", "t", 0).select("vec_id", F.col("input_ids").cast("array<bigint>").alias("input_ids"), "attention_mask")


@query("a20_masked_moments", f"WITH {TOK} SELECT uid, sum(m)::DOUBLE AS n, round(avg(v) FILTER (m = 1), 9) AS mean, round(var_samp(v) FILTER (m = 1), 9) AS var FROM k GROUP BY 1")
def a20(spark, sf):
    out = O.masked_moments(emb(spark, sf), "v", "m", ["uid"])
    return out.withColumns({c: base.rounded(F.col(c), 9) for c in ("mean", "var")})


@query("a20_whiten", f"""
WITH {TOK}, s AS (SELECT avg(v) FILTER (m = 1) AS mean, var_samp(v) FILTER (m = 1) AS var FROM k)
SELECT vec_id, list(round((v - mean) / sqrt(var + 1e-8), 6) ORDER BY i) AS v FROM k, s GROUP BY 1""")
def a20_whiten(spark, sf):
    return O.whiten(emb(spark, sf).select("vec_id", "v", "m"), "v", "m").select("vec_id", rounded(F.col("v")).alias("v"))


@query("a21_loss_average", f"""
WITH {TOK}, r AS (SELECT vec_id, sum(v * m) AS s, sum(m) AS n FROM k GROUP BY 1)
SELECT 'token' AS mode, sum(s) / (sum(n) + 1e-8) AS loss FROM r UNION ALL SELECT 'seq', avg(s / (n + 1e-8)) FROM r""")
def a21(spark, sf):
    e = emb(spark, sf)
    one = lambda mode: O.average_loss(e, "v", "m", mode).select(F.lit(mode).alias("mode"), "loss")
    return one("token").unionByName(one("seq"))


@query("a14_length_metrics", f"WITH {EMB}, n AS (SELECT list_sum(m)::DOUBLE AS n FROM e) SELECT avg(n) AS response_mean, max(n) AS response_max, min(n) AS response_min, avg((n >= 35)::INT) AS response_clip_ratio FROM n")
def a14(spark, sf):
    return O.length_metrics(emb(spark, sf), "m", 35, "response")


@query("a15_token_metrics", f"WITH {TOK} SELECT avg(v) AS v_mean, max(v) AS v_max, min(v) AS v_min, avg(w) AS w_mean, max(w) AS w_max, min(w) AS w_min FROM k WHERE m = 1")
def a15(spark, sf):
    return O.token_metrics(emb(spark, sf), "m", ["v", "w"])


@query("a15_explained_variance", f"WITH {TOK} SELECT round(1 - var_samp(v - w) / (var_samp(v) + 1e-5), 9) AS explained_variance FROM k WHERE m = 1")
def a15_ev(spark, sf):
    return O.explained_variance(emb(spark, sf), "v", "w", "m").select(base.rounded(F.col("explained_variance"), 9).alias("explained_variance"))


@query("a13_metric_means", "SELECT event_type AS key, avg(value) AS mean FROM events GROUP BY 1")
def a13(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("key")).agg(F.avg("value").alias("mean"))


@query("a16_throughput", "SELECT sum(n_chars)::BIGINT AS tokens, 12.5 * 1000 / sum(n_chars) AS ms_per_token, sum(n_chars) / (12.5 * 4) AS tokens_per_second_per_gpu FROM documents")
def a16(spark, sf):
    return O.throughput(table(spark, sf, "documents"), F.col("n_chars"), 12.5, 4)


@query("a24_flops", "SELECT 6 * 1e6 * sum(n_chars) + 12.0 * sum(n_chars * n_chars) AS flops FROM documents")
def a24(spark, sf):
    return O.flops(table(spark, sf, "documents"), F.col("n_chars"), 1e6, 12.0)


@query("a25_validation", f"WITH {EMB} SELECT uid, avg(list_sum(v)) AS mean_reward, avg(score) AS mean_score FROM e GROUP BY 1")
def a25(spark, sf):
    return emb(spark, sf).groupBy("uid").agg(F.avg(O.array_sum(F.col("v"))).alias("mean_reward"), F.avg("score").alias("mean_score"))


@query("a27_running_best", "SELECT max(o_totalprice) AS best_score, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best_step FROM orders")
def a27(spark, sf):
    return O.running_best(table(spark, sf, "orders"), "o_orderkey", "o_totalprice")


@query("k13_retained", "SELECT s_suppkey FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey DESC) AS k, s_acctbal = max(s_acctbal) OVER () AS best FROM supplier) WHERE k <= 4 OR best")
def k13(spark, sf):
    s = table(spark, sf, "supplier")
    top = s.agg(F.max("s_acctbal").alias("__top"))
    return O.retained(s.join(F.broadcast(top)), 5, "s_suppkey", F.col("s_acctbal") == F.col("__top")).select("s_suppkey")


@query("j6_group_filter", f"WITH {EMB} SELECT vec_id, uid FROM e WHERE uid IN (SELECT uid FROM e GROUP BY uid HAVING avg(score) > 2.9 AND avg(score) < 3.2)")
def j6(spark, sf):
    return O.group_filter(emb(spark, sf), "uid", "score", 2.9, 3.2).select("vec_id", "uid")


@query("a11_pass_at_n", """
WITH s AS (SELECT o_orderkey, o_custkey, o_orderstatus = 'P' AS ok, o_orderkey % 2 = 0 AS has_call FROM orders)
SELECT o_orderkey, bool_or(ok) OVER w AS pass_at_n, bool_or(ok AND NOT has_call) OVER w AS solved_without_call, bool_or(ok AND has_call) OVER w AS solved_with_call FROM s WINDOW w AS (PARTITION BY o_custkey)""")
def a11(spark, sf):
    s = table(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderstatus") == "P").alias("ok"), (F.col("o_orderkey") % 2 == 0).alias("has_call"))
    return O.pass_at_n(s, "o_custkey", "ok").drop("o_custkey", "ok", "has_call")


@query("f30_kl", f"""
WITH {EMB}, z AS (SELECT vec_id, list_zip(v, w) AS z FROM e)
SELECT vec_id, list_transform(z, lambda x: x[1] - x[2]) AS kl, list_transform(z, lambda x: abs(x[1] - x[2])) AS abs, list_transform(z, lambda x: 0.5 * (x[1] - x[2]) * (x[1] - x[2])) AS mse,
       list_transform(z, lambda x: round(greatest(-10.0, least(10.0, exp(x[2] - x[1]) - (x[2] - x[1]) - 1)), 6)) AS low_var_kl FROM z""")
def f30(spark, sf):
    return emb(spark, sf).select("vec_id", *[O.kl(F.col("v"), F.col("w"), k).alias(k) for k in ("kl", "abs", "mse")], rounded(O.kl(F.col("v"), F.col("w"), "low_var_kl")).alias("low_var_kl"))


@query("f31_shaped_rewards", f"WITH {EMB}, z AS (SELECT vec_id, list_zip(v, w, m) AS z FROM e) SELECT vec_id, list_transform(z, lambda x: x[1] - 0.1 * (x[2] * x[3])) AS rewards FROM z")
def f31(spark, sf):
    return emb(spark, sf).select("vec_id", O.shaped_rewards(F.col("v"), F.col("w"), F.col("m"), 0.1).alias("rewards"))


@query("f32_policy_loss", f"""
WITH {EMB}, z AS (SELECT vec_id, list_transform(list_zip(v, w), lambda x: [exp(x[1] - x[2]), x[1] * 10]) AS z FROM e)
SELECT vec_id, list_transform(z, lambda x: round(CASE WHEN x[2] < 0 THEN least(greatest(-x[2] * x[1], -x[2] * greatest(0.8, least(1.2, x[1]))), -x[2] * 1.3) ELSE greatest(-x[2] * x[1], -x[2] * greatest(0.8, least(1.2, x[1]))) END, 6)) AS loss FROM z""")
def f32(spark, sf):
    gain = F.transform("v", lambda t: t * 10)
    return emb(spark, sf).select("vec_id", rounded(O.policy_loss(F.col("w"), F.col("v"), gain, 0.2, 0.2, 1.3)).alias("loss"))


@query("f33_value_loss", f"""
WITH {EMB}, z AS (SELECT vec_id, list_transform(list_zip(v, w), lambda x: [x[1], greatest(x[2] - 0.1, least(x[2] + 0.1, x[1])), x[1] * 2]) AS z FROM e)
SELECT vec_id, list_transform(z, lambda x: 0.5 * greatest((x[1] - x[3]) * (x[1] - x[3]), (x[2] - x[3]) * (x[2] - x[3]))) AS loss FROM z""")
def f33(spark, sf):
    return emb(spark, sf).select("vec_id", O.value_loss(F.col("v"), F.col("w"), F.transform("v", lambda t: t * 2), 0.1).alias("loss"))


@query("f34_adaptive_kl", f"""
WITH {TOK} SELECT vec_id, round(0.2 * exp(sum(ln(1 + greatest(-0.2, least(0.2, abs(v) / 0.1 - 1)) * 8 / 100.0))), 6) AS coefficient FROM k GROUP BY 1""")
def f34(spark, sf):
    seen = F.transform("v", lambda t: F.abs(t))
    c = O.adaptive_kl(seen, 0.2, 0.1, 100.0, F.transform("v", lambda t: F.lit(8)))
    return emb(spark, sf).select("vec_id", base.rounded(c, 6).alias("coefficient"))


# -- rewards over texts --------------------------------------------------------------------------------

#: Each document as a response: calls and a boxed answer are appended by rule.
RESP = r"""r AS (SELECT doc_id, source AS prompt, n_chars, (n_chars % 50)::VARCHAR AS truth,
 '<think>' || text || CASE WHEN doc_id % 3 = 0 THEN ' <call>' || (doc_id * 7)::VARCHAR || '</call> <call> 12 </call>' ELSE '' END || '</think> ' ||
 CASE WHEN doc_id % 5 = 4 THEN 'Answer: ' || (n_chars % 50)::VARCHAR || ' units.' ELSE 'So \boxed{' || (n_chars % (CASE WHEN doc_id % 4 = 0 THEN 50 ELSE 10 END))::VARCHAR || '}' END AS response FROM documents)"""
_BOX = r"trim(regexp_extract_all(response, '\\boxed\s*\{([^{}]*)\}', 1)[-1])"
_CALLS = r"coalesce(list_sum(list_transform(regexp_extract_all(response, '<call>\s*(\d+)\s*</call>', 1), lambda x: least(x::BIGINT, 4096))), 0)"


def responses(spark, sf):
    d, n = table(spark, sf, "documents"), F.col("n_chars")
    cat, t = F.concat, F.lit
    call = F.when(F.col("doc_id") % 3 == 0, cat(t(" <call>"), (F.col("doc_id") * 7).cast("string"), t("</call> <call> 12 </call>"))).otherwise(t(""))
    given = (n % F.when(F.col("doc_id") % 4 == 0, 50).otherwise(10)).cast("string")
    end = F.when(F.col("doc_id") % 5 == 4, cat(t("Answer: "), (n % 50).cast("string"), t(" units."))).otherwise(cat(t("So \\boxed{"), given, t("}")))
    return d.select("doc_id", F.col("source").alias("prompt"), "n_chars", (n % 50).cast("string").alias("truth"), cat(t("<think>"), "text", call, t("</think> "), end).alias("response"))


@query("f20_math_reward", f"WITH {RESP}, s AS (SELECT doc_id, coalesce({_BOX} = truth, false)::INT::DOUBLE AS accuracy, regexp_full_match(response, '(?s)<think>.*</think>.*\\\\boxed\\{{.*\\}}.*')::INT::DOUBLE AS format FROM r) SELECT *, 0.9 * accuracy + 0.1 * format AS overall FROM s")
def f20(spark, sf):
    s = responses(spark, sf).select("doc_id", R.accuracy(F.col("response"), F.col("truth")).alias("accuracy"), R.boxed_format(F.col("response")).alias("format"))
    return s.withColumn("overall", R.weighted(F.col("accuracy"), F.col("format"), 0.1))


@query("f17_call_ratio", f"WITH {RESP} SELECT doc_id, {_CALLS}::BIGINT AS tokens, least({_CALLS} / n_chars, 1.0) AS ratio FROM r")
def f17(spark, sf):
    return responses(spark, sf).select("doc_id", R.call_tokens(F.col("response")).alias("tokens"), R.call_ratio(F.col("response"), F.col("n_chars")).alias("ratio"))


_RELAY = f"{RESP}, s AS (SELECT doc_id, prompt, coalesce({_BOX} = truth, false) AS ok, contains(response, '<call>') AS call, least({_CALLS} / n_chars, 1.0) AS ratio FROM r)"


@query("f18_relay_group", f"""
WITH {_RELAY}, f AS (SELECT *, bool_or(ok AND NOT call) OVER w AS alone, bool_or(ok AND call) OVER w AS helped, bool_or(ok) OVER w AS any_ok FROM s WINDOW w AS (PARTITION BY prompt))
SELECT doc_id, any_ok::INT::DOUBLE AS pass_at_n, (CASE WHEN alone THEN CASE WHEN ok AND NOT call THEN 1.5 WHEN ok THEN 1 - ratio ELSE 0 END
 WHEN helped THEN CASE WHEN ok AND call THEN 1 - ratio WHEN NOT ok AND NOT call THEN -1 ELSE 0 END ELSE CASE WHEN call THEN ratio ELSE 0 END END)::DOUBLE AS overall FROM f""")
def f18(spark, sf):
    s = responses(spark, sf)
    s = s.select("doc_id", "prompt", (R.accuracy(F.col("response"), F.col("truth")) > 0.5).alias("ok"), F.contains("response", F.lit("<call>")).alias("call"), R.call_ratio(F.col("response"), F.col("n_chars")).alias("ratio"))
    return R.relay_group_score(s, "prompt", "ok", "call", "ratio").select("doc_id", "pass_at_n", "overall")


@query("f19_relay_simple", f"WITH {_RELAY} SELECT doc_id, ok::INT - ratio AS overall FROM s")
def f19(spark, sf):
    s = responses(spark, sf)
    return s.select("doc_id", (R.accuracy(F.col("response"), F.col("truth")) - R.call_ratio(F.col("response"), F.col("n_chars"))).alias("overall"))


@query("f15_overlong_score", f"""
WITH {RESP}, s AS (SELECT doc_id, n_chars, CASE WHEN doc_id % 5 = 4 THEN 1.0 ELSE -1.0 END AS accuracy,
 CASE WHEN n_chars <= 1500 THEN 0.0 WHEN n_chars <= 2500 THEN (1500 - n_chars) / 1000.0 ELSE -1.0 END AS overlong FROM r)
SELECT doc_id, (accuracy + overlong * 0.5)::DOUBLE AS overall, accuracy::DOUBLE AS accuracy, overlong::DOUBLE AS overlong, (0.5 * (accuracy + 1.0))::DOUBLE AS accuracy_normalized FROM s""")
def f15(spark, sf):
    """Final answers are normalised ('12 units.' equals '12.'), long responses lose."""
    truth = F.concat("truth", F.lit("."))
    s = R.overlong_score(F.col("response"), truth, F.col("n_chars"), 2500, 1000, 0.5)
    return responses(spark, sf).select("doc_id", F.inline(F.array(s)))


@query("f14_line_answers", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE k WHEN 0 THEN n WHEN 1 THEN '\\frac{' || left(n, 1) || '}{' || d || '}' WHEN 2 THEN '\\sqrt{' || d || '}' WHEN 3 THEN n ELSE n || '.5' END AS normal
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 5 AS k, round(l_extendedprice * 100)::BIGINT::VARCHAR AS n, (l_linenumber % 9 + 1)::VARCHAR AS d FROM lineitem)""")
def f14_lines(spark, sf):
    """Every line's price in five spellings of a final answer: grouped digits with a unit, short fractions and roots, text, decimals."""
    n, d, lit = F.round(F.col("l_extendedprice") * 100).cast("long"), (F.col("l_linenumber") % 9 + 1).cast("string"), F.lit
    s, k = n.cast("string"), F.col("l_partkey") % 5
    raw = (
        F.when(k == 0, F.concat(lit("The price is = $"), F.format_number(n, 0), lit("$ dollars")))
        .when(k == 1, F.concat(lit("x = \\frac"), F.left(s, lit(1)), d))
        .when(k == 2, F.concat(lit("$\\sqrt"), d, lit("$")))
        .when(k == 3, F.concat(lit("\\text{"), s, lit("}")))
        .otherwise(F.concat(lit("y = \\boxed{"), s, lit(".5} units")))
    )
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.normalize_final_answer(raw).alias("normal"))


@query("f14_final_answers", "SELECT k, want AS normal FROM (VALUES (0, '\\frac{1}{2}'), (1, '12'), (2, '1234'), (3, '\\sqrt{3}'), (4, 'x+1'), (5, 'five')) v(k, want)")
def f14(spark, sf):
    rows = [(0, "x = \\frac12"), (1, "\\text{12}"), (2, "1,234 dollars"), (3, "$\\sqrt3$"), (4, "y = x + 1"), (5, "\\boxed{five}")]
    return spark.createDataFrame(rows, "k int, raw string").select("k", X.normalize_final_answer(F.col("raw")).alias("normal"))


@query("f21_interaction_score", """
WITH t AS (SELECT doc_id, n_chars, (doc_id % 3 = 0)::INT::DOUBLE AS accuracy, doc_id % 2 = 0 AS accepted FROM documents)
SELECT doc_id, accuracy, n_chars / 192.0 AS teacher_token_ratio, accepted::INT::DOUBLE AS unsupported_accept_count,
       accuracy - 0.15 * (n_chars / 192.0) - 0.1 * accepted::INT AS overall FROM t""")
def f21(spark, sf):
    """One verify event a document; accuracy and costs (outcomes are tested on hand-made events)."""
    d = table(spark, sf, "documents")
    n = F.col("doc_id")
    final = F.when(n % 3 == 0, "7").otherwise("8")
    event = F.struct(F.lit("verify").alias("action"), F.lit(None).cast("string").alias("error"), (n % 2 == 0).alias("accepted"), F.lit("draft \\boxed{7}").alias("student_before_feedback"), F.lit("Verdict: correct").alias("teacher_context_text"))
    rows = d.select("doc_id", F.concat(F.lit("\\boxed{"), final, F.lit("}")).alias("response"), F.lit("7").alias("ground_truth"), F.array(event).alias("events"), F.col("n_chars").alias("teacher_tokens_used"), *[F.lit(0).alias(c) for c in ("ask_count", "verify_count", "invalid_accept_count", "invalid_protocol_count", "denied_action_count")])
    return R.interaction_score(rows).select("doc_id", "accuracy", "teacher_token_ratio", "unsupported_accept_count", "overall")


@query("a18_rank_stats", """
SELECT o_orderpriority AS grp, count(*) FILTER (o_custkey <= 1)::BIGINT AS hits_1, count(*) FILTER (o_custkey <= 100)::BIGINT AS hits_100, min(o_custkey) AS least,
       list_sort(list(o_custkey))[count(*) // 2 + 1] AS median, max(o_custkey) AS most FROM orders GROUP BY 1""")
def a18(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_custkey").alias("r"))
    return O.rank_stats(rows, "grp", "r", (1, 100))


@query("w18_first_per_action", "SELECT event_type, event_id, k FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id)::INT AS k FROM events WHERE event_type IN ('view', 'click')) WHERE k <= 20")
def w18(spark, sf):
    return O.first_per_action(table(spark, sf, "events"), "event_type", "event_id", 20, ["view", "click"]).select("event_type", "event_id", "k")


@query("m10_refill", """
WITH b AS (SELECT o_custkey, o_orderkey, (o_orderstatus = 'F')::INT::DOUBLE AS score, o_custkey % 4 AS batch FROM orders),
g AS (SELECT o_custkey FROM b GROUP BY 1 HAVING avg(score) > 0.3 AND avg(score) < 0.6),
c AS (SELECT b.*, (SELECT count(*) FROM b x JOIN g USING (o_custkey) WHERE x.batch < b.batch) AS before FROM b JOIN g USING (o_custkey))
SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS k FROM c WHERE before < (SELECT count(*) // 5 FROM orders)) WHERE k <= (SELECT count(*) // 5 FROM orders)""")
def m10(spark, sf):
    """Batches of customers until rows of well-mixed ones are a fifth of all."""
    b = table(spark, sf, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "F").cast("double").alias("score"))
    parts = (b.where(F.col("o_custkey") % 4 == k) for k in range(4))
    return O.refill(parts, "o_custkey", "score", 0.3, 0.6, b.count() // 5, 4, "o_orderkey").select("o_custkey", "o_orderkey")


@query("f36_overrides", "SELECT s_suppkey, (s_acctbal + 1)::VARCHAR AS a, 'base' AS b, 'new' AS c FROM supplier")
def f36(spark, sf):
    from ..functions.config import merged

    s = table(spark, sf, "supplier")
    base = F.create_map(F.lit("a"), F.lit("0"), F.lit("b"), F.lit("base"))
    m = merged(base, F.create_map(F.lit("a"), F.lit("1"), F.lit("c"), F.lit("old")), F.create_map(F.lit("a"), (F.col("s_acctbal") + 1).cast("string"), F.lit("c"), F.lit("new")))
    return s.select("s_suppkey", m["a"].alias("a"), m["b"].alias("b"), m["c"].alias("c"))


@query("p13_templates", "SELECT doc_id, 'Q: ' || trim(text) || chr(10) || 'lang=' || lang || '!' AS prompt FROM documents")
def p13(spark, sf):
    from ..functions.config import template

    return table(spark, sf, "documents").select("doc_id", template("Q: {{ text | trim }}\nlang={{ lang }}!").alias("prompt"))


@query("p9_token_filter", "SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[^\\s]+')) <= 200")
def p9(spark, sf):
    """Over-long prompts go; the tokenizer's stand-in counts words."""
    return O.within_tokens(table(spark, sf, "documents"), "text", 200).select("doc_id")
