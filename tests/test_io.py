import json

import pytest
from pyspark.sql import functions as F

from corpusloom.scratch import scratch_path
from corpusloom.sources import pages, readers, sinks
from corpusloom.streaming import ingest


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_record_files(spark, tmp_path):
    schema = "a long, b string"
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": "é"}\n\n{"a": 2}\n')
    assert [r["a"] for r in rows(readers.read_records(spark, f"{tmp_path}/x.jsonl", schema))] == [1, 2]
    for name, text in (("list", '[{"a": 1}]'), ("train", '{"train": [{"a": 1}], "data": [{"a": 9}]}'), ("data", '{"data": [{"a": 1}]}')):
        (tmp_path / f"{name}.json").write_text(text)
        assert [r["a"] for r in rows(readers.read_records(spark, f"{tmp_path}/{name}.json", schema))] == [1]
    (tmp_path / "bad.json").write_text('{"other": []}')
    with pytest.raises(Exception, match="no list"):
        rows(readers.read_records(spark, f"{tmp_path}/bad.json", schema))
    (tmp_path / "r.json").write_text('[{"a": 1}]')
    got = rows(readers.read_first_existing(spark, [f"{tmp_path}/none.json", f"{tmp_path}/r.json"], schema))
    assert got[0]["source_path"].endswith("r.json")
    with pytest.raises(FileNotFoundError):
        readers.read_first_existing(spark, [f"{tmp_path}/none.json"], schema)


def test_snapshot_and_handlers(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"questions": {"x": ["q1", "q2"], "y": []}}))
    assert rows(readers.read_snapshot(spark, f"{tmp_path}/s.json")) == [{"source": "x", "question": "q1"}, {"source": "x", "question": "q2"}]
    (tmp_path / "g.jsonl").write_text('{"question": "q", "answer": "steps #### 12"}\n')
    assert rows(readers.dataset(spark, "gsm8k", f"{tmp_path}/g.jsonl")) == [{"question": "q", "answer": "12"}]
    (tmp_path / "m.csv").write_text('Question,Answer\n"a\nb",1\n')
    assert rows(readers.dataset(spark, "math", f"{tmp_path}/m.csv")) == [{"question": "a\nb", "answer": "1"}]
    with pytest.raises(KeyError):
        readers.dataset(spark, "unknown", "")
    bad = spark.createDataFrame([(0, "q", "a"), (1, None, "b")], "ord long, problem string, target string")
    with pytest.raises(Exception, match="no question in row 1"):
        rows(readers.local_json(bad, ["question", "problem"], ["target"]))


def test_pages(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"p{k}.json").write_text(json.dumps({"rows": [{"row_idx": k, "row": {"problem": f"q{k}", "source": "s"}}], "num_rows_total": 2}))
    spark.dataSource.register(pages.PagedSource)
    got = rows(spark.read.format("pages").option("pages", f"{tmp_path}/p0.json|{tmp_path}/p1.json").load())
    assert sorted((r["row_idx"], r["problem"]) for r in got) == [(0, "q0"), (1, "q1")]
    waits, fails = [], iter([TimeoutError(), ConnectionError()])

    def call():
        for e in fails:
            raise e
        return "ok"

    assert pages.with_retries(call, sleep=waits.append) == "ok" and waits == [2, 4]


def test_sinks(spark):
    path = scratch_path(spark, "out")
    df = spark.createDataFrame([(1, "é", None)], "a long, b string, c string")
    sinks.write_with_summary(df, df.agg(F.count("*").alias("n")), path)
    with pytest.raises(Exception, match="exists"):
        sinks.write_jsonl(df, f"{path}/items")
    sinks.write_jsonl(df, f"{path}/items", overwrite=True)
    assert spark.read.text(f"{path}/items").first().value == '{"a":1,"b":"é","c":null}'
    assert json.loads(sinks.manifest(df).first().manifest) == {"a": 1, "b": "é", "c": None}
    sinks.log_metrics(spark, 1, {"x": 2, "y": 3}, f"{path}/m")
    sinks.log_metrics(spark, 2, {"x": 4}, f"{path}/m")
    assert spark.read.parquet(f"{path}/m").count() == 3


def test_streams_resume(spark):
    base = scratch_path(spark, "in")
    schema = "event_id long, user_id long, action string, ts timestamp"

    def put(k, data):
        spark.createDataFrame(data, "event_id long, user_id long, action string").withColumn("ts", F.timestamp_seconds(F.col("event_id") * 60)).coalesce(1).write.parquet(f"{base}/part={k}")

    put(0, [(0, 1, "ask"), (1, 1, "verify"), (2, 2, "accept")])
    stream = lambda: ingest.events_stream(spark, f"{base}/*", schema)
    out, state = scratch_path(spark, "o"), scratch_path(spark, "c")
    ingest.drain(ingest.deduplicated(stream().select("user_id"), ["user_id"]), out, state)
    put(1, [(3, 1, "accept"), (4, 3, "ask"), (400, 3, "ask")])
    ingest.drain(ingest.deduplicated(stream().select("user_id"), ["user_id"]), out, state)
    assert sorted(r["user_id"] for r in rows(spark.read.parquet(out))) == [1, 2, 3]
    w, ws = scratch_path(spark, "w"), scratch_path(spark, "ws")
    ingest.drain(ingest.windowed_counts(stream(), "ts", "1 hour", "10 minutes", "action"), w, ws)
    assert sum(r["n"] for r in rows(spark.read.parquet(w))) == 5  # the last window is still open


def test_committed_prefix(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"a": 5}\n{"a": 6}\n\n{"a": 7}\n')
    got = rows(readers.read_committed(spark, f"{tmp_path}/p.jsonl", "a long", 2))
    assert [(r["ord"], r["a"]) for r in sorted(got, key=lambda r: r["ord"])] == [(0, 5), (1, 6)]
    with pytest.raises(ValueError):
        readers.read_committed(spark, f"{tmp_path}/p.jsonl", "a long", 9)


def test_yaml_and_tokens(spark, tmp_path):
    from corpusloom.functions.config import read_yaml
    from corpusloom.operators.protocol import split_tokens

    (tmp_path / "a.yaml").write_text("a:\n  b: 1\n")
    assert read_yaml(f"{tmp_path}/a.yaml") == {"a": {"b": 1}}
    (tmp_path / "b.yaml").write_text("- 1\n")
    with pytest.raises(ValueError):
        read_yaml(f"{tmp_path}/b.yaml")
    t = spark.createDataFrame([("<ASK>", [7]), ("<X>", [1, 2]), ("<U>", [0])], "token string, ids array<int>")
    assert sorted(r["token"] for r in rows(split_tokens(t, 0))) == ["<U>", "<X>"]
