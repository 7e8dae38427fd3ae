"""Paged sources over a service, committed tables, stateful requests and resumable iterators."""

import json
import os
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import iterate as I
from corpusloom.operators.batches import numbered
from corpusloom.plans.feeds import stub_service
from corpusloom.scratch import scratch_path
from corpusloom.sources import commits, pages
from corpusloom.streaming import ingest, requests


class Service:
    """A rows API on this machine: `rows` rows, a total or none, and replies that fail at first."""

    def __init__(self, rows, total=True, failures=()):
        self.rows, self.total, self.failures, self.asked = rows, total, list(failures), []
        service = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                q = parse_qs(urlparse(self.path).query)
                low, n = int(q["offset"][0]), int(q["length"][0])
                service.asked.append(low)
                if service.failures:
                    self.send_response(service.failures.pop(0))
                    self.send_header("Retry-After", "0")
                    self.end_headers()
                    return
                body = {"rows": [{"row_idx": k, "row": {"problem": f"q{k}", "solution": "s", "source": "x"}} for k in range(low, min(low + n, service.rows))]}
                if service.total:
                    body["num_rows_total"] = service.rows
                self.send_response(200)
                self.end_headers()
                self.wfile.write(json.dumps(body).encode())

            def log_message(self, *_):
                pass

        self.server = HTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_port}/rows"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def stop(self):
        self.server.shutdown()


@pytest.mark.parametrize("total", [True, False])
@pytest.mark.parametrize("rows", [0, 1, 9, 10, 11, 70, 73])
def test_the_end_of_a_paged_source(rows, total):
    service = Service(rows, total)
    try:
        assert pages.Source({"url": service.url, "size": "10"}).page_count() == -(-rows // 10)
        assert len(service.asked) < 16
    finally:
        service.stop()


def test_a_service_that_fails_at_first(spark):
    service = Service(57, failures=[429, 500, 503, 429])
    spark.dataSource.register(pages.PagedSource)
    try:
        out, state = scratch_path(spark, "rows"), scratch_path(spark, "rows-state")
        reader = spark.readStream.format("pages").options(url=service.url, size=10, backoff=0, batch=2, checkpoint=state)
        ingest.collect_pages(reader.load(), out, state, {"url": service.url})
        ingest.collect_pages(reader.load(), out, state, {"url": service.url})  # nothing is left
        got = spark.read.format("committed").schema("row_idx long, problem string").option("path", out).load().collect()
        assert sorted(r.row_idx for r in got) == list(range(57)) and {r.problem for r in got} == {f"q{k}" for k in range(57)}
        assert len(commits.manifests(out)) == 3
        with pytest.raises(ValueError, match="begun with"):
            ingest.collect_pages(reader.load(), out, state, {"url": "other"})
        batch = spark.read.format("pages").options(url=service.url, size=10, task=4).load()
        assert batch.count() == 57
    finally:
        service.stop()
    service = Service(5, failures=[404])
    with pytest.raises(Exception, match="404"):
        pages.Source({"url": service.url}).page(0)
    service.stop()


def test_offsets_of_another_request():
    schema = type("S", (), {"fields": []})
    here, other = (pages.PagedStream(schema, {"url": "x", "size": "5", "request": r}) for r in "ab")
    with pytest.raises(ValueError, match="another request"):
        here.partitions(other.initialOffset(), other._offset(3))
    with pytest.raises(ValueError, match="short"):
        source = pages.Source({"url": "/nowhere", "size": "5"})
        list(pages.read_pages(source, pages.Page(None, 0, 1, 4), []))


def test_commits(spark):
    spark.dataSource.register(commits.CommittedTable)
    out = scratch_path(spark, "table")
    rows = spark.range(100).selectExpr("id", "CAST(id AS STRING) AS s").repartition(4)

    def write(rows, mode="append", **o):
        rows.write.format("committed").mode(mode).options(path=out, **o).save()

    def ids(**o):
        return sorted(r.id for r in spark.read.format("committed").schema("s string, id long").options(path=out, **o).load().collect())

    assert ids() == []
    import pyarrow as pa

    killed = commits.BatchWriter({"path": out}, False)
    part = killed.write(iter([pa.RecordBatch.from_pydict({"id": [7], "s": ["x"]})]))  # written, never committed
    assert part.rows == 1 and ids() == []
    killed.abort([killed.write(iter([pa.RecordBatch.from_pydict({"id": [8], "s": ["x"]})])), None])
    assert commits.vacuum(out) == 1 and commits.vacuum(out) == 0
    write(rows, exclusive="true")
    with pytest.raises(Exception, match="exists"):
        write(rows, exclusive="true")
    write(rows.where("id < 10"), commit=5)
    write(rows.where("id < 10"), commit=5)
    assert ids() == sorted([*range(100), *range(10)]) and ids(rows=110) == ids()
    with pytest.raises(Exception, match="fewer"):
        ids(rows=111)
    with pytest.raises(Exception, match="torn"):
        write(rows.withColumn("s", F.when(F.col("id") == 99, F.raise_error(F.lit("torn")).cast("string")).otherwise(F.col("s"))))
    assert len(ids()) == 110
    write(rows.where("id > 97"), "overwrite")
    assert ids() == [98, 99]
    commits._drop(out, [commits.committed(out)[0]["file"]])
    with pytest.raises(Exception, match="No such file|not found|Failed to open"):
        ids()
    assert spark.read.format("committed").schema("id long").option("path", out).load().columns == ["id"]


def test_summaries_join():
    rng = random.Random(1)
    for _ in range(300):
        acts = "".join(rng.choice("avco") for _ in range(rng.randint(0, 12)))
        k, m = sorted((rng.randint(0, len(acts)), rng.randint(0, len(acts))))
        parts = [requests.summary(acts[:k]), requests.summary(acts[k:m]), requests.summary(acts[m:])]
        whole = requests.summary(acts)
        assert requests.joined(requests.joined(*parts[:2]), parts[2]) == whole == requests.joined(parts[0], requests.joined(*parts[1:]))
        pending = valid = 0
        for c in acts:
            if c == "v":
                pending = 1
            elif c == "c":
                valid, pending = valid + pending, 0
        assert whole[4] == valid


def test_requests_survive_a_restart(spark):
    requests.with_rocks(spark)
    base, out, state = (scratch_path(spark, x) for x in ("ev", "req", "req-state"))
    rng = random.Random(3)
    rows = [(k, 1 if k % 3 else rng.randint(2, 6), rng.choice(["ask", "verify", "accept", "view"])) for k in range(3000)]  # user 1 is a hot one
    schema = "event_id long, user_id long, ts timestamp, action string"

    def put(part, some):
        df = spark.createDataFrame(some, "event_id long, user_id long, action string").withColumn("ts", F.timestamp_seconds(F.col("event_id") * 60 + 60))
        df.coalesce(1).write.parquet(f"{base}/part={part}")

    def run():
        ingest.drain_updates(requests.request_totals(ingest.events_stream(spark, f"{base}/*", schema, 1), late="2 hours"), out, state)

    first = rows[:1500]
    rng.shuffle(first)
    put(0, first)
    run()
    late = [r for r in rows[1500:2900] if r[0] % 7]
    put(1, late + late[:50])  # some come twice
    run()
    put(2, rows[2900:] + [r for r in rows[2850:2900] if not r[0] % 7])
    run()
    kept = {r[0]: r for r in [*first, *late, *rows[2900:], *[r for r in rows[2850:2900] if not r[0] % 7]]}
    want = {}
    for _, user, action in (kept[k] for k in sorted(kept)):
        n = want.setdefault(user, [0, 0, 0, 0, 0, 0])
        n[0] += 1
        if action == "ask":
            n[1] += 1
        elif action == "verify":
            n[2], n[5] = n[2] + 1, 1
        elif action == "accept":
            n[3], n[4], n[5] = n[3] + n[5], n[4] + 1 - n[5], 0
    found = spark.read.parquet(out).groupBy("user_id").agg(F.max_by(F.struct("n_events", "asks", "verifies", "accepts", "invalid_accepts"), "epoch").alias("r"))
    assert {r.user_id: list(r.r) for r in found.collect()} == {u: n[:5] for u, n in want.items()}


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_places_are_a_bijection(spark, n):
    keys = I.round_keys("s", 1)
    want = [I.placed(x, n, keys) for x in range(n)]
    assert sorted(want) == list(range(n))
    assert [I.placed(p, n, keys[::-1]) for p in want] == list(range(n))
    got = spark.range(n).select("id", I.place_of(F.col("id"), n, keys).alias("p")).orderBy("id").collect()
    assert [r.p for r in got] == want
    if n == 1000:
        assert I.placed(5, n, I.round_keys("s", 2)) != want[5] or I.placed(6, n, I.round_keys("s", 2)) != want[6]
        near = sum(abs(a - b) < 10 for a, b in zip(want, want[1:]))
        assert near < 60 and sum(abs(p - x) < 10 for x, p in enumerate(want)) < 60  # about 20 each by chance


def test_iterators_resume_anywhere(spark, monkeypatch):
    rows = numbered(spark.range(47).select("id"), ["id"])

    def got(df):
        return sorted((r.epoch, r.batch, r.place, r.id) for r in df.collect())

    whole = got(I.BatchIterator(rows, 5, 3, "x").take(1000))
    assert len(whole) == 3 * 45 and len({r[3] for r in whole if r[0] == 1}) == 45
    for k in (1, 9, 26):
        it = I.BatchIterator(rows, 5, 3, "x")
        first = got(it.take(k))
        assert it.position() == divmod(k, 9)
        rest = I.BatchIterator(rows, 5, 3, "x", it.state())
        monkeypatch.setattr(I, "LOOKUP", 1_000_000 if k % 2 else 0)  # by number, and by a scan
        assert sorted(first + got(rest.take(2)) + got(rest.take(99))) == whole
    with pytest.raises(ValueError, match="another iterator"):
        I.BatchIterator(rows, 6, 3, "x", it.state())
    plain = got(I.BatchIterator(rows, 5, 1, "x", shuffle=False).take(3))
    assert [r[3] for r in plain] == list(range(15))
    assert I.BatchIterator(rows, 50, 1, "x").take(5).count() == 0


def test_replies_or_error_rows(spark):
    from corpusloom.sources import service

    waits, fails = [], iter([ConnectionError("status 503"), TimeoutError()])

    def flaky(prompts):
        for e in fails:
            raise e
        return [p.upper() for p in prompts]

    assert service.replies(flaky, ["a", "b"], 3, waits.append) == (["A", "B"], [None, None]) and waits == [2, 4]
    assert service.replies(lambda p: ["x"], ["a", "b"], 3) == ([None, None], ["ValueError: 1 replies to 2 prompts"] * 2)
    assert service.replies(lambda p: "xy", ["a", "b"], 3)[1][0].startswith("ValueError: no replies")
    assert service.replies(lambda p: ["x", None], ["a", "b"], 3) == (["x", None], [None, "empty reply"])
    rows = spark.createDataFrame([(k, None if k == 3 else f"p{k}", 1) for k in range(10)], "id int, prompt string, n int").coalesce(1)
    with stub_service(lambda prompts: [] if "p5" in prompts else [p + "!" for p in prompts]) as url:
        got = {r.id: (r.reply, r.error) for r in service.ask_model(rows, "prompt", url, batch=4).collect()}
    assert got[3] == (None, None) and got[0] == ("p0!", None) and got[9] == ("p9!", None)
    assert {k for k, (_, e) in got.items() if e} == {5, 6, 7, 8} and got[5][1] == "ValueError: 0 replies to 4 prompts"
    got = service.ask_model(rows.where("id = 1"), "prompt", url, tries=2, wait=0).first()  # the service is gone
    assert got.reply is None and got.error.startswith("ConnectionError")


def test_pages_are_dealt_to_a_bounded_number_of_tasks():
    for n, task in ((3, 8), (100, 1), (5_000, 8), (600_007, 8)):
        tasks = pages._tasks(7, 7 + n, 7 + n, {"task": str(task)})
        assert len(tasks) <= pages.TASKS and [k for t in tasks for k in range(t.number, t.number + t.count)] == list(range(7, 7 + n))
    assert [t.count for t in pages._tasks(0, 20, 20, {"task": "8"})] == [8, 8, 4]


def test_sets_of_any_name(spark):
    names = ["a/b", "c:d%", "e f+", "", "é", None]
    rows = spark.createDataFrame([(k, names[k % 6]) for k in range(50)], "id int, kind string")
    root = scratch_path(spark, "named")
    pages.write_pages(numbered(rows, ["kind", "id"]), root, 3, by="kind")
    got = pages.count_sets(spark, [(str(n), pages.set_folder(root, "kind", n)) for n in names]).collect()
    assert {r.name: r.n for r in got} == {str(n): 8 + (k < 2) for k, n in enumerate(names)}
    spark.dataSource.register(pages.PagedSource)
    found = spark.read.format("pages").schema("row_idx long, id int").options(url=pages.set_folder(root, "kind", "a/b"), size=3).load()
    assert sorted((r.row_idx, r.id) for r in found.collect()) == [(k, 6 * k) for k in range(9)]


def test_a_service_beside_each_task(spark):
    from corpusloom.sources import service

    def serve():
        return stub_service(lambda prompts: [f"{os.getpid()}" for _ in prompts])

    rows = spark.range(40, numPartitions=2).selectExpr("id", "CAST(id AS STRING) AS prompt")
    got = service.ask_model(rows, "prompt", serve, batch=1).collect()
    assert len(got) == 40 and all(r.error is None and int(r.reply) != os.getpid() for r in got)


def test_calls_share_a_connection(monkeypatch):
    import http.client

    from corpusloom.sources import service

    opened, connect = [], http.client.HTTPConnection.connect
    monkeypatch.setattr(http.client.HTTPConnection, "connect", lambda self: (opened.append(1), connect(self)))
    with stub_service(lambda prompts: [p * 2 for p in prompts]) as url:
        call = service.Caller(url)
        assert [call([str(k)]) for k in range(20)] == [[f"{k}{k}"] for k in range(20)] and len(opened) == 1
        call.open.sock.close()  # lost meanwhile
        assert call(["x"]) == ["xx"] and len(opened) == 2
        call.close()


def test_few_open_events_take_few_state_calls():
    """67 events in 67 buckets: one value holds them, and one timer waits. Sealing them changes no count."""
    import pandas as pd

    calls, timers = [], []

    class Value:
        held = None

        def get(self):
            calls.append("get")
            return self.held

        def exists(self):
            calls.append("exists")
            return self.held is not None

        def update(self, value):
            calls.append("update")
            self.held = value

        def clear(self):
            self.held = None

    class Map:
        def __getattr__(self, name):
            raise AssertionError(f"map state is used: {name}")

    class Handle:
        def getValueState(self, *_):
            return Value()

        def getMapState(self, *_):
            return Map()

        def registerTimer(self, ms):
            timers.append(ms)

    class Now:
        def getCurrentWatermarkInMs(self):
            return 40 * 3_600_000

    p = requests.Requests(3_600_000, 1 << 46)
    p.init(Handle())
    rng = random.Random(4)
    acts = [rng.choice(["ask", "verify", "accept", "view"]) for _ in range(67)]
    rows = pd.DataFrame({"ts": pd.to_datetime([k * 3_600_000 for k in range(67)], unit="ms"), "event_id": [k * 1000 for k in range(67)], "action": acts})
    first = next(iter(p.handleInputRows((1,), iter([rows.sample(frac=1, random_state=1)]), None)))
    assert len(calls) <= 6 and len(timers) == 2 and min(timers) == 3_600_000
    list(p.handleExpiredTimer((1,), Now(), None))
    assert len(p.few.held[1]) == 27 and timers[-1] == 41 * 3_600_000 and p.sealed.held[0] == 40
    again = next(iter(p.handleInputRows((1,), iter([rows.tail(3)]), None)))
    assert first.values.tolist() == again.values.tolist() and first["n_events"][0] == 67
