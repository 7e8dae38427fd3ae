"""Queries over paged sources, committing sinks, resumable iterators and stateful requests."""

from __future__ import annotations

import json
import threading
from contextlib import contextmanager
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import iterate as I
from ..operators.batches import numbered
from ..scratch import scratch_path, stage
from ..sources import commits, pages
from ..streaming import ingest as T
from ..streaming import requests as Q
from . import records
from .base import Registry, compact_sql, table

query = Registry()
QUERIES, SQL = query.queries, query.sql

PAGE = "row_idx long, doc_id long, text string, source string"


def _rename(spark, old: str, new: str) -> None:
    sc = spark.sparkContext
    one, other = (sc._jvm.org.apache.hadoop.fs.Path(p) for p in (old, new))
    one.getFileSystem(sc._jsc.hadoopConfiguration()).rename(one, other)


def _paged_documents(spark, sf, size: int):
    """All documents as pages of `size` rows in a folder; gives the folder and the source as a stream's reader."""
    path = scratch_path(spark, "pages")
    d = numbered(table(spark, sf, "documents").select("doc_id", "text", "source"), ["doc_id"])
    pages.write_pages(d, path, size)
    spark.dataSource.register(pages.PagedSource)
    return path, spark.readStream.format("pages").schema(PAGE).option("url", path).option("size", size).option("retries", 1).option("task", 8)


def _committed(spark, path, schema):
    return spark.read.format("committed").schema(schema).option("path", path).load()


@query("s6_t1_paged_stream", "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_idx, doc_id, text, source FROM documents")
def s6_stream(spark, sf):
    """Some hundred pages of all documents as a stream. In mid-run a page is gone; with it back the stream goes on."""
    size = 5
    path, reader = _paged_documents(spark, sf, size)
    n = -(-table(spark, sf, "documents").count() // size)
    out, state, request = scratch_path(spark, "collected"), scratch_path(spark, "collected-state"), {"url": path, "size": size}
    stream = lambda: reader.option("batch", -(-n // 3)).option("checkpoint", state).load()
    gone = f"{path}/page={n * 3 // 5}"
    _rename(spark, gone, f"{path}/_away")
    try:
        T.collect_pages(stream(), out, state, request)
        raise AssertionError("the missing page went unnoticed")
    except Exception as e:
        if "is short, but it is not the last one" not in str(e):
            raise
    _rename(spark, f"{path}/_away", gone)
    T.collect_pages(stream(), out, state, request)
    return _committed(spark, out, PAGE)


@query("s8_streamed_scan", f"SELECT DISTINCT sha256({compact_sql('lower(text)')}) AS fingerprint FROM documents WHERE source = (SELECT min(source) FROM documents) AND trim(text) <> '' AND length(text) = strlen(text)")
def s8_stream(spark, sf):
    """One category of a paged source without blanks and without problems seen before, as a stream (ASCII texts)."""
    path, reader = _paged_documents(spark, sf, 50)
    least = table(spark, sf, "documents").agg(F.min("source")).first()[0]
    rows = reader.load().where((F.col("source") == least) & (X.trim_u(F.col("text")) != "") & (F.octet_length("text") == F.char_length("text")))
    rows = T.deduplicated(rows.select(X.problem_fingerprint(F.col("text")).alias("fingerprint")), ["fingerprint"])
    out = scratch_path(spark, "scan")
    T.collect_pages(rows, out, scratch_path(spark, "scan-state"), {"url": path, "source": least})
    return _committed(spark, out, "fingerprint string")


@query("s19_k3_k4_commits", "SELECT doc_id, text FROM documents")
def s19_commits(spark, sf):
    """A first attempt fails in one task, so nothing of it is seen; then two commits, the second tried twice."""
    d, out = table(spark, sf, "documents").select("doc_id", "text"), scratch_path(spark, "commits")
    spark.dataSource.register(commits.CommittedTable)
    last = d.agg(F.max("doc_id")).first()[0]
    write = lambda rows, **o: rows.write.format("committed").mode("append").options(path=out, **o).save()
    try:
        write(d.repartition(8).withColumn("text", F.when(F.col("doc_id") == last, F.raise_error(F.lit("torn")).cast("string")).otherwise(F.col("text"))))
        raise AssertionError("the attempt did not fail")
    except Exception as e:
        if "torn" not in str(e):
            raise
    seen = _committed(spark, out, "doc_id long, text string").count()
    half = F.col("doc_id") <= F.lit((last or 0) // 2)
    write(d.where(half), exclusive="true")
    for _ in range(2):
        write(d.where(~half | F.col("doc_id").isNull()), commit=1)
    return _committed(spark, out, "doc_id long, text string").where(F.lit(seen == 0))


@query("s10_counted_sets", "SELECT source, count(*) AS n FROM documents GROUP BY 1")
def s10_sets(spark, sf):
    """The number of rows of every page set, one folder of pages a source, as a page of each says."""
    d = numbered(table(spark, sf, "documents").select("doc_id", "source"), ["source", "doc_id"])
    root = scratch_path(spark, "sets")
    pages.write_pages(d, root, 40, by="source")
    names = [r.source for r in d.select("source").distinct().collect()]  # sources are few
    return pages.count_sets(spark, [(name, pages.set_folder(root, "source", name)) for name in names]).select(F.col("name").alias("source"), "n")


# -- resumable iterators -------------------------------------------------------------------------------

SIZE, EPOCHS, SEED = 32, 2, 7


def _shuffled_sql(epoch: int) -> str:
    """doc_id and its place in an epoch, by the rounds of the keyed bijection."""
    rows = "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS x, count(*) OVER () AS n FROM documents"
    for k, a, b, c, e in I.round_keys(SEED, epoch):
        rows = f"SELECT doc_id, n, CASE WHEN 2 * ((f * f + {e}) % {I.PRIME}) >= {I.PRIME} THEN y ELSE x END AS x FROM (SELECT *, ({a} * (greatest(x, y) % {I.PRIME}) + {c} * ((greatest(x, y) >> 31) % {I.PRIME}) + {b}) % {I.PRIME} AS f FROM (SELECT *, (({k} % n) - x + n) % n AS y FROM ({rows})))"
    return f"SELECT doc_id, {epoch} AS epoch, x // {SIZE} AS batch, x AS place FROM ({rows}) WHERE x // {SIZE} < n // {SIZE}"


@query("t5_w19_resumed_batches", " UNION ALL ".join(_shuffled_sql(e) for e in range(EPOCHS)))
def t5(spark, sf):
    """Two epochs in four portions, by three iterators: each goes on from the position that the one before it saved."""
    rows = numbered(table(spark, sf, "documents").select("doc_id"), ["doc_id"])
    state, parts = None, []
    for k in (5, 20):
        it = I.BatchIterator(rows, SIZE, EPOCHS, SEED, state)
        parts.append(it.take(k))
        state = it.state()
    it = I.BatchIterator(rows, SIZE, EPOCHS, SEED, state)
    parts += [it.take(1), it.take(1 << 40)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("doc_id", "epoch", "batch", "place")


# -- requests ------------------------------------------------------------------------------------------


@query("t4_open_requests", records.SQL["t4_request_state"])
def t4_open(spark, sf):
    """Counts of each request by a stateful processor with timers, the events in four files and out of their order."""
    path, out, state = (scratch_path(spark, x) for x in ("events", "requests", "requests-state"))
    e = table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.expr(records.ACTION).alias("action"))
    top = e.agg(F.max("event_id")).first()[0] or 0
    e.withColumn("part", F.floor(F.col("event_id") * 4 / (top + 1))).repartition("part").sortWithinPartitions(F.desc("event_id")).write.partitionBy("part").parquet(path)
    Q.with_rocks(spark)
    stream = T.events_stream(spark, path, "event_id long, user_id long, ts timestamp, action string, part int", 1)
    T.drain_updates(Q.request_totals(stream, late="40 days"), out, state)
    rows = spark.read.parquet(out)
    return rows.groupBy("user_id").agg(F.max_by(F.struct("n_events", "asks", "verifies", "accepts", "invalid_accepts"), "epoch").alias("r")).select("user_id", "r.*")


# -- an outside model ----------------------------------------------------------------------------------


@query("x8_service_replies", """
SELECT doc_id, CASE WHEN length(text) % 5 <> 0 THEN length(text)::VARCHAR END AS reply, CASE WHEN length(text) % 5 = 0 THEN 'ValueError: 0 replies to 1 prompts' END AS error FROM documents""")
def x8(spark, sf):
    """A model that counts characters, served over HTTP by each task for itself; some batches come back too short."""
    from ..sources import service

    serve = lambda: stub_service(lambda prompts: [] if len(prompts[0]) % 5 == 0 else [len(p) for p in prompts])
    rows = service.ask_model(table(spark, sf, "documents").select("doc_id", "text"), "text", serve, batch=1)
    return stage(rows.select("doc_id", "reply", "error"), "replies").df


@contextmanager
def stub_service(model, host: str = "127.0.0.1"):
    """A service on this machine while the block runs; gives its address."""

    class Handler(BaseHTTPRequestHandler):
        protocol_version, wbufsize, disable_nagle_algorithm = "HTTP/1.1", -1, True  # connections stay open

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            body = json.dumps({"replies": model(asked["prompts"])}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer((host, 0), Handler)
    server.daemon_threads = True
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        yield f"http://{host}:{server.server_port}/"
    finally:
        server.shutdown()
        server.server_close()
