"""Queries over record files, source handlers, sinks, text rules, configuration and plug-ins."""

from __future__ import annotations

import importlib.util
import json
import os

from pyspark.sql import functions as F

from ..functions import config as G
from ..functions import text as X
from ..operators import curation as C
from ..operators import grading, protocol, rewards, rollouts
from ..scratch import scratch_path
from ..sources import pages as P
from ..sources import readers as S
from ..sources import sinks as K
from .base import Registry, rounded, table, trim_sql

query = Registry()
QUERIES, SQL = query.queries, query.sql


def _file(spark, text: str, name: str) -> str:
    """A small text as one file in the shared folder."""
    path = scratch_path(spark, name)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return path


def _nations(spark, sf) -> str:
    """The 25 nations as a JSON array."""
    row = F.struct("n_nationkey", "n_name")
    return table(spark, sf, "nation").agg(F.to_json(F.array_sort(F.collect_list(row)))).first()[0]


# -- record normalisation ------------------------------------------------------------------------------

RAW = r"""raw AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 <> 4 THEN text END AS problem, CASE WHEN doc_id % 5 = 4 AND doc_id % 2 = 0 THEN '  ' ELSE lang END AS prompt,
 CASE doc_id % 4 WHEN 0 THEN 'work #### ' || n_chars::VARCHAR || '. ' WHEN 1 THEN 'So \boxed{ ' || n_chars::VARCHAR || '}' WHEN 2 THEN 'short <ASK>' || n_chars::VARCHAR ELSE repeat('long ', 30) || text END AS solution,
 CASE WHEN doc_id % 6 = 3 THEN ' ' || n_chars::VARCHAR || ' ; ' END AS final_answer FROM documents)"""


def _raw(spark, sf):
    d, n = table(spark, sf, "documents"), F.col("n_chars").cast("string")
    k, cat, t = F.col("doc_id"), F.concat, F.lit
    solution = F.when(k % 4 == 0, cat(t("work #### "), n, t(". "))).when(k % 4 == 1, cat(t("So \\boxed{ "), n, t("}"))).when(k % 4 == 2, cat(t("short <ASK>"), n)).otherwise(cat(F.repeat(t("long "), t(30)), "text"))
    prompt = F.when((k % 5 == 4) & (k % 2 == 0), t("  ")).otherwise(F.col("lang"))
    return d.select(k.alias("id"), F.when(k % 5 != 4, F.col("text")).alias("problem"), prompt.alias("prompt"), solution.alias("solution"), F.when(k % 6 == 3, cat(t(" "), n, t(" ; "))).alias("final_answer"))


@query("p1_p2_normalize_records", f"""
WITH {RAW}, a AS (SELECT id, coalesce(nullif({trim_sql("problem")}, ''), nullif({trim_sql("prompt")}, '')) AS question, {trim_sql("replace(solution, '<ASK>', '')")} AS s,
  regexp_replace({trim_sql("final_answer")}, '[.,;:]+$', '') AS e FROM raw),
b AS (SELECT *, CASE WHEN id % 4 = 1 THEN trim(regexp_extract(s, '\\\\boxed\\{{([^{{}}]*)\\}}', 1)) END AS box FROM a),
g AS (SELECT *, coalesce({trim_sql("e")}, box, CASE WHEN id % 4 = 0 THEN regexp_replace({trim_sql("split_part(s, '####', 2)")}, '[.,;:]+$', '') END, CASE WHEN length(s) <= 80 THEN s END) AS gold FROM b)
SELECT id::VARCHAR AS id, question, gold AS gold_answer, CASE WHEN box IS NOT DISTINCT FROM gold THEN s ELSE s || chr(10) || 'Therefore, the final answer is \\boxed{{' || gold || '}}.' END AS gold_solution,
  CASE WHEN coalesce(question, '') = '' OR s IS NULL OR gold IS NULL THEN 'missing_question_solution_or_answer' END AS reason FROM g""")
def p2(spark, sf):
    """Aliases, the cascade of gold answers, closing sentences and reasons, over whole texts."""
    return C.normalize_records(_raw(spark, sf))


@query("p3_record_rejects", f"""
WITH {RAW} SELECT 'missing_question_solution_or_answer' AS reason, count(*) AS n FROM raw
WHERE (problem IS NULL AND trim(prompt) = '') OR (id % 4 = 3 AND final_answer IS NULL)""")
def p3(spark, sf):
    return C.reason_counts(C.normalize_records(_raw(spark, sf)).where("reason IS NOT NULL"))


@query("f5_boxed_answers", r"""
SELECT * FROM (VALUES (0, '\frac{1}{2}', '\frac{1}{2}'), (1, 'b', 'b'), (2, NULL, NULL), (3, 'in', 'in'), (4, NULL, 'up'), (5, 'x', 'x')) v(k, box, any_case)""")
def f5(spark, sf):
    """Balanced braces, the last box, unbalanced and nested ones, and the form that ignores case."""
    raw = ["\\boxed{\\frac{1}{2}}", "\\boxed{a} and \\boxed { b }", "\\boxed{open", "\\boxed{out \\boxed{in}}", "\\BOXED{up}", "\\boxed{x} \\boxed{never"]
    rows = spark.createDataFrame(list(enumerate(raw)), "k int, raw string")
    return rows.select("k", X.last_boxed("raw").alias("box"), X.last_boxed_any_case("raw").alias("any_case"))


@query("f6_f8_answer_forms", r"""
SELECT doc_id, n_chars::VARCHAR AS said, text || ' end' AS clean, n_chars::VARCHAR AS gold FROM documents""".replace("text || ' end'", trim_sql("text || ' end'")))
def f6(spark, sf):
    """The last answer by a pattern, a solution without control markers, a gold answer without closing marks."""
    d, n = table(spark, sf, "documents"), F.col("n_chars").cast("string")
    said = F.concat("text", F.lit("\nAnswer: 0\nAnswer: "), n)
    return d.select("doc_id", X.last_match(said, r"Answer:\s*(\d+)").alias("said"), X.clean_solution(F.concat("text", F.lit(" <ask></ASK>end<Accept> "))).alias("clean"), X.clean_gold_answer(F.concat(F.lit(" "), n, F.lit(" .;, "))).alias("gold"))


@query("p14_p17_f41_prompts", f"""
WITH d AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN text || ' Final Answer' WHEN 1 THEN text || ' \\Boxed {{' ELSE text END AS t FROM documents)
SELECT doc_id, regexp_replace(text, '[\\s\\x{{0085}}\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+$', '') || chr(10) || 'Please reason step by step, and put your final answer within \\boxed{{}}.' AS prompt,
       doc_id % 3 < 2 AS leaks, (CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END)::INT AS markers FROM d""")
def p14(spark, sf):
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    t = F.when(k % 3 == 0, F.concat("text", F.lit(" Final Answer"))).when(k % 3 == 1, F.concat("text", F.lit(" \\Boxed {"))).otherwise(F.col("text"))
    marked = F.concat("text", F.when(k % 2 == 0, "<TEACHER_HELP>x</TEACHER_REVIEW><ASK>").otherwise("<help>"))
    once = X.user_prompt(X.user_prompt(F.col("text")))
    return d.select("doc_id", once.alias("prompt"), X.leaks_answer(t).alias("leaks"), X.context_marker_count(marked).cast("int").alias("markers"))


@query("f16_tagged_format", "SELECT doc_id, (doc_id % 2 = 0)::INT::DOUBLE AS ok FROM documents")
def f16(spark, sf):
    said = F.concat(F.lit("<think>"), "text", F.lit("</think>\n<answer>"), F.col("n_chars").cast("string"), F.when(F.col("doc_id") % 2 == 0, "</answer>").otherwise("</answer>."))
    return table(spark, sf, "documents").select("doc_id", rewards.tagged_format(said).alias("ok"))


# -- sources -------------------------------------------------------------------------------------------


@query("s2_record_files", "SELECT kind, n_nationkey, n_name FROM nation, (VALUES ('data'), ('examples'), ('list'), ('train')) v(kind)")
def s2(spark, sf):
    """A JSON array, and objects that hold their rows under one of three keys (the first of them wins)."""
    array, parts = _nations(spark, sf), []
    texts = {"list": array, "train": f'{{"examples": [], "data": [], "train": {array}}}', "data": f'{{"examples": [], "data": {array}}}', "examples": f'{{"examples": {array}}}'}
    for kind, text in texts.items():
        parts.append(S.read_records(spark, _file(spark, text, kind), "n_nationkey long, n_name string").select(F.lit(kind).alias("kind"), "n_nationkey", "n_name"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("s3_tagged_results", "SELECT n_nationkey, f AS file FROM nation, (VALUES (0), (1)) v(f)")
def s3(spark, sf):
    paths = [_file(spark, _nations(spark, sf), f"results{k}x") for k in range(2)]
    rows = S.read_results(spark, paths, "n_nationkey long, n_name string")
    return rows.select("n_nationkey", F.regexp_extract("source_path", r"/results(\d)x-[^/]*/[^/]*$", 1).cast("int").alias("file"))


@query("s4_fallback_path", "SELECT n_nationkey, n_name FROM nation")
def s4(spark, sf):
    path = _file(spark, _nations(spark, sf), "fallback")
    return S.read_first_existing(spark, [f"{path}-none", path], "n_nationkey long, n_name string").select("n_nationkey", "n_name")


def _pages(spark, sf) -> list[str]:
    """The nations as three pages of a rows API."""
    out = []
    for k in range(3):
        own = table(spark, sf, "nation").where(F.floor(F.col("n_nationkey") / 10) == k)
        item = F.struct(F.col("n_nationkey").alias("row_idx"), F.struct(F.col("n_name").alias("problem")).alias("row"))
        text = own.agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("rows"), F.lit(25).alias("num_rows_total")))).first()[0]
        out += spark.read.text(_file(spark, text, "page")).inputFiles()
    return out


@query("s6_s9_paged_rows", "SELECT n_nationkey AS row_idx, n_name AS problem FROM nation")
def s6(spark, sf):
    """One partition a page, each read with retries."""
    spark.dataSource.register(P.PagedSource)
    return spark.read.format("pages").option("pages", "|".join(_pages(spark, sf))).load().select("row_idx", "problem")


@query("s10_remote_count", "SELECT count(*) AS n FROM nation")
def s10(spark, sf):
    return spark.createDataFrame([(P.total_rows(_pages(spark, sf)[0]),)], "n long")


@query("s11_prefix_limit", "SELECT least(count(*), 30) AS n FROM part")
def s11(spark, sf):
    return S.read_dataset(spark, f"{sf}/part.parquet", most=30).agg(F.count("*").alias("n"))


@query("s14_local_json", "SELECT r_regionkey::BIGINT AS ord, r_name AS question, r_regionkey::VARCHAR AS answer FROM region")
def s14(spark, sf):
    r = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("ord"), F.when(F.col("r_regionkey") > 1, F.col("r_name")).alias("question"), F.col("r_name").alias("problem"), F.col("r_regionkey").cast("string").alias("target"))
    return S.local_json(r, ["question", "problem"], ["answer", "target"])


@query("s15_x4_handlers", """
SELECT 'math' AS source, p_name AS question, p_partkey::VARCHAR AS answer FROM part UNION ALL SELECT 'olympiad', p_name, p_type FROM part UNION ALL SELECT 'amc', p_name, p_brand FROM part""")
def s15(spark, sf):
    """Sources by their registered names."""
    p, path = table(spark, sf, "part"), scratch_path(spark, "handlers")
    p.select(F.col("p_name").alias("Question"), F.col("p_partkey").alias("Answer")).write.option("header", True).csv(f"{path}/math")
    K.write_jsonl(p.select(F.col("p_name").alias("question"), F.array("p_type", "p_brand").alias("final_answer")), f"{path}/olympiad")
    K.write_jsonl(p.select(F.col("p_name").alias("problem"), F.col("p_brand").alias("answer")), f"{path}/amc")
    parts = [S.dataset(spark, n, f"{path}/{n}").select(F.lit(n).alias("source"), "question", "answer") for n in ("math", "olympiad", "amc")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("s16_dataset_split", "SELECT doc_id, text FROM documents WHERE doc_id % 10 = 0")
def s16(spark, sf):
    path = scratch_path(spark, "dataset")
    split = F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train").alias("split")
    table(spark, sf, "documents").select("doc_id", "text", split).write.parquet(path)
    return S.read_dataset(spark, f"{path}@test").select("doc_id", "text")


@query("s17_snapshot", "SELECT 'b' || (item_id % 3)::VARCHAR AS source, text AS question FROM benchmark")
def s17(spark, sf):
    """A snapshot is one JSON text of some thousand held-out questions."""
    b = table(spark, sf, "benchmark").groupBy(F.concat(F.lit("b"), (F.col("item_id") % 3).cast("string")).alias("s")).agg(F.collect_list("text").alias("q"))
    text = b.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("s", "q"))).alias("questions")))).first()[0]
    return S.read_snapshot(spark, _file(spark, text, "snapshot"))


@query("s19_committed_prefix", "SELECT ord, doc_id, text FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ord, doc_id, text FROM documents) WHERE ord < 50")
def s19(spark, sf):
    """Of a file that a stopped job left, the committed rows."""
    path = scratch_path(spark, "partial")
    K.write_jsonl(table(spark, sf, "documents").select("doc_id", "text").orderBy("doc_id").limit(80).coalesce(1), path)
    return S.read_committed(spark, path, "doc_id long, text string", 50)


# -- sinks ---------------------------------------------------------------------------------------------


@query("k2_summary_beside", "SELECT count(*) AS items, (SELECT sum(length(text)) FROM documents)::BIGINT AS chars FROM documents")
def k2(spark, sf):
    d, path = table(spark, sf, "documents").select("doc_id", "text"), scratch_path(spark, "items")
    K.write_with_summary(d, d.agg(F.sum(F.char_length("text")).alias("chars")), path)
    items = S.read_jsonl(spark, f"{path}/items", "doc_id long, text string").agg(F.count("*").alias("items"))
    return items.join(F.broadcast(S.read_jsonl(spark, f"{path}/summary", "chars long")))  # one row each


@query("k3_exclusive_create", "SELECT r_regionkey, r_name FROM region")
def k3(spark, sf):
    """A second writer is refused; with the flag it replaces what is there."""
    r, path = table(spark, sf, "region").select("r_regionkey", "r_name"), scratch_path(spark, "exclusive")
    K.write_jsonl(r.limit(1), path)
    try:
        K.write_jsonl(r, path)
    except Exception as e:
        if "exist" not in str(e).lower():
            raise
        K.write_jsonl(r, path, overwrite=True)
    return S.read_jsonl(spark, path, "r_regionkey int, r_name string")


@query("k11_event_metrics", "SELECT dense_rank() OVER (ORDER BY event_type) AS step, m.key, CASE m.key WHEN 'count' THEN n ELSE v END AS value FROM (SELECT event_type, count(*)::DOUBLE AS n, round(avg(value), 6) AS v FROM events GROUP BY 1), (VALUES ('count'), ('mean')) m(key)")
def k11_events(spark, sf):
    """Count and mean value of every kind of event, logged as a step each."""
    path = scratch_path(spark, "metrics")
    kinds = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), rounded(F.avg("value")).alias("v")).orderBy("event_type")
    for step, r in enumerate(kinds.collect(), 1):  # kinds are few
        K.LOGGERS["parquet"](spark, step, {"count": r.n, "mean": r.v}, path)
    return spark.read.parquet(path)


@query("p19_line_rules", """
SELECT l_orderkey, l_linenumber, l_partkey, list_filter([CASE WHEN l_discount > 0.05 THEN 'discount' END, CASE WHEN l_quantity < 10 OR l_quantity > 40 THEN 'quantity' END, CASE WHEN l_tax IS NULL OR l_tax = 0 THEN 'tax' END], lambda x: x IS NOT NULL) AS broken FROM lineitem""")
def p19_lines(spark, sf):
    """Every line item with the names of the rules that it breaks."""
    rules = {"discount": F.col("l_discount") <= 0.05, "quantity": F.col("l_quantity").between(10, 40), "tax": F.col("l_tax") != 0}
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", G.row_faults(rules).alias("broken"))


@query("k11_x6_metrics", "SELECT step::BIGINT AS step, key, value::DOUBLE AS value FROM (VALUES (1, 'loss', 0.5), (1, 'reward', 2), (2, 'loss', 0.25)) v(step, key, value)")
def k11(spark, sf):
    path = scratch_path(spark, "metrics")
    for step, metrics in ((1, {"reward": 2, "loss": 0.5}), (2, {"loss": 0.25})):
        K.LOGGERS["parquet"](spark, step, metrics, path)
    return spark.read.parquet(path)


# -- configuration -------------------------------------------------------------------------------------

TREE = {"data": {"path": "x", "limits": {"most": 5}}, "trainer": {"gpus": [0, 1]}, "empty": {}}


@query("f35_flatten", "SELECT * FROM (VALUES ('data.path', '\"x\"'), ('data.limits.most', '5'), ('trainer.gpus', '[0, 1]'), ('empty', '{}')) v(path, value)")
def f35(spark, sf):
    flat = G.flatten(G.unflatten(G.flatten(TREE)))
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in flat.items()], "path string, value string")


if importlib.util.find_spec("yaml"):

    @query("s18_yaml_mapping", "SELECT * FROM (VALUES ('data.path', '\"x\"'), ('data.limits.most', '5'), ('trainer.gpus', '[0, 1]')) v(path, value)")
    def s18(spark, sf):
        """A YAML file as dotted paths."""
        text = "data:\n  path: x\n  limits: {most: 5}\ntrainer:\n  gpus: [0, 1]\n"
        tree = G.read_yaml(_file(spark, text, "yaml"), spark)
        return spark.createDataFrame([(k, json.dumps(v)) for k, v in G.flatten(tree).items()], "path string, value string")


@query("p18_p19_rules", "SELECT * FROM (VALUES ('rule', 'most'), ('rule', 'seed'), ('column', 'nothing')) v(kind, name)")
def p19(spark, sf):
    """Rules over dotted paths that do not hold, and needed columns that are missing."""
    rules = {"path": ("data.path", lambda v: v == "x"), "most": ("data.limits.most", lambda v: v > 9), "seed": ("trainer.seed", lambda v: True)}
    broken = [("rule", n) for n in G.broken_rules(G.flatten(TREE), rules)]
    missing = [("column", n) for n in G.missing_columns(table(spark, sf, "part").columns, ["p_name", "nothing"])]
    return spark.createDataFrame(broken + missing, "kind string, name string")


@query("k9_j10_run_table", "SELECT s_name AS run, (ord % 3)::INT AS slot, 'run:' || s_name || ' slot:' || (ord % 3)::VARCHAR AS line FROM (SELECT s_name, row_number() OVER (ORDER BY s_name) - 1 AS ord FROM supplier)")
def k9(spark, sf):
    """Runs dealt to slots in turn, and the line that starts each."""
    from ..operators.batches import numbered

    runs = G.run_table(numbered(table(spark, sf, "supplier").select(F.col("s_name").alias("run")), ["run"]), [0, 1, 2])
    return runs.select("run", "slot", G.template("run:{{ run }} slot:{{ slot }}").alias("line"))


@query("j11_shared_slots", "SELECT s_suppkey, list_sort(list_intersect([s_suppkey % 3, 3, 5], [1, s_suppkey % 5]))::BIGINT[] AS both FROM supplier")
def j11(spark, sf):
    k, n = F.col("s_suppkey").cast("long"), lambda x: F.lit(x).cast("long")
    return table(spark, sf, "supplier").select("s_suppkey", G.shared_slots(F.array(k % 3, n(3), n(5)), F.array(n(1), k % 5)).alias("both"))


@query("p20_split_tokens", "SELECT * FROM (VALUES ('<VERIFY>'), ('<ACCEPT>')) v(token)")
def p20(spark, sf):
    rows = [("<ASK>", [7]), ("<VERIFY>", [8, 9]), ("<ACCEPT>", [0])]
    return protocol.split_tokens(spark.createDataFrame(rows, "token string, ids array<int>"), 0).select("token")


# -- plug-ins ------------------------------------------------------------------------------------------

REWARD = os.path.join(os.path.dirname(os.path.abspath(__file__)), "example_reward.py")


@query("x1_loaded_reward", "SELECT doc_id, 2.0 * length(text) AS reward FROM documents")
def x1(spark, sf):
    """A reward by 'path:name' with an option, in batches of rows."""
    rows = table(spark, sf, "documents").select("doc_id", F.col("text").alias("response"))
    out = rewards.apply_rewards(rows, rewards.load_reward(f"{REWARD}:length_reward", scale=2.0), "doc_id long, response string, reward double")
    return out.select("doc_id", "reward")


@query("x2_group_reward", "SELECT vec_id, (vec_id = max(vec_id) OVER (PARTITION BY label))::INT::DOUBLE AS reward FROM embeddings")
def x2(spark, sf):
    """A reward that sees all samples of a prompt (some rollouts each)."""
    rows = table(spark, sf, "embeddings").select("vec_id", "label", F.repeat(F.lit("x"), F.col("vec_id").cast("int")).alias("response"))
    schema = rows.schema.simpleString()[7:-1].replace(":", " ") + ", reward double"
    return rewards.apply_rewards(rows, rewards.load_reward(f"{REWARD}:best_of_group"), schema, group="label").select("vec_id", "reward")


@rollouts.register_estimator("centred")
def _centred(rows):
    from pyspark.sql import Window as W

    return rows.withColumn("advantage", F.col("score") - F.avg("score").over(W.partitionBy("uid")))


@query("x3_registered_estimator", "SELECT vec_id, (vec_id % 7) - avg(vec_id % 7) OVER (PARTITION BY label) AS advantage FROM embeddings")
def x3(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("uid"), (F.col("vec_id") % 7).cast("double").alias("score"))
    return rollouts.advantages(rows, "centred").select("vec_id", "advantage")


@query("x7_judge_calls", "SELECT doc_id AS id, CASE WHEN length(text) % 2 = 0 THEN 'yes' ELSE 'no' END AS judgement FROM documents")
def x7(spark, sf):
    """A stub judge, called by threads of each task."""
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("prompt"))
    return grading.judge_with(rows, lambda p: "no" if len(p) % 2 else "yes", threads=4)
