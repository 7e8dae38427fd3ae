"""A paged source, in batches and as a stream whose offsets are pages, with retries and backoff.

A page is JSON {"rows": [...], "num_rows_total": n}, as a rows API serves it: from a service (an http address,
asked for offset and length) or replayed from a folder that holds page=0, page=1 and so on. The end is the first
empty page, the first short one or the total; pages before it are full. Where no page tells the total, the
last page is found by doubling and halving, so that the driver fetches a logarithm of their number only. Pages
are read by tasks, one each. A page that turns out short before the end is an error, never a silent gap.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Tasks that a batch of pages is dealt to at most; with more pages a task reads more neighbours.
TASKS = 256


def with_retries(call: Callable, most: int = 6, sleep: Callable = time.sleep):
    """call() again after min(2^(n+1), 60) seconds, or after what the error's retry_after says."""
    for n in range(most):
        try:
            return call()
        except (TimeoutError, ConnectionError, BlockingIOError) as e:
            if n == most - 1:
                raise
            wait = getattr(e, "retry_after", None)
            sleep(min(2 ** (n + 1), 60) if wait is None else wait)
    return None


def load_page(path: str) -> dict:
    """A page's JSON, from any file system that the path names."""
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    with where.open_input_stream(inner) as f:
        return json.loads(f.read())


def total_rows(path: str) -> int:
    """How many rows the source has in all, as any of its pages says."""
    return int(load_page(path)["num_rows_total"])


def ask_service(url: str, offset: int, length: int) -> dict:
    """A page from a service; what may pass (429, 5xx, timeouts) is a ConnectionError with the wait it asks for."""
    from urllib.error import HTTPError, URLError
    from urllib.request import urlopen

    try:
        with urlopen(f"{url}{'&' if '?' in url else '?'}offset={offset}&length={length}", timeout=60) as reply:
            return json.loads(reply.read())
    except HTTPError as e:
        if e.code != 429 and e.code < 500:
            raise
        passing = ConnectionError(f"{e.code} from {url}")
        said = (e.headers.get("Retry-After") or "").strip()
        passing.retry_after = float(said) if said.replace(".", "", 1).isdigit() else None
        raise passing from e
    except URLError as e:
        raise ConnectionError(f"no reply from {url}: {e.reason}") from e


def page_in_folder(folder: str, page: int) -> dict:
    """The page in folder/page=<number>, or an empty one."""
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
    files = where.get_file_info(fs.FileSelector(f"{inner}/page={page}", allow_not_found=True))
    for f in sorted(f.path for f in files if f.is_file and not f.base_name.startswith(("_", "."))):
        with where.open_input_stream(f) as data:
            return json.loads(data.read())
    return {"rows": []}


def _exists(path: str) -> bool:
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    return any(f.is_file for f in where.get_file_info(fs.FileSelector(f"{inner}/offsets", allow_not_found=True)))


class Source:
    """Where pages come from: options url, size (rows a page), retries, backoff (factor of the waits)."""

    def __init__(self, options: dict):
        self.url, self.size = options["url"].rstrip("/"), int(options.get("size", "100"))
        self.retries, self.factor = int(options.get("retries", "6")), float(options.get("backoff", "1"))

    def page(self, k: int) -> dict:
        call = (lambda: ask_service(self.url, k * self.size, self.size)) if self.url.startswith("http") else (lambda: page_in_folder(self.url, k))
        return with_retries(call, self.retries, lambda s: time.sleep(s * self.factor))

    def total(self) -> int | None:
        said = self.page(0).get("num_rows_total")
        return said if isinstance(said, int) else None

    def page_count(self) -> int:
        def rows(k: int) -> int:
            return len(self.page(k).get("rows") or [])

        if (first := rows(0)) < self.size:
            return int(first > 0)
        low, high = 0, 1  # low is full; the end lies at high or before
        if (total := self.total()) is not None:
            last = -(-total // self.size) - 1
            if last <= 0 or rows(last):
                return max(last, 0) + 1
            high = last
        else:
            while rows(high) == self.size:
                low, high = high, high * 2
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if rows(mid) == self.size else (low, mid)
        return high + int(rows(high) > 0)


class Page(InputPartition):
    """A page by its file, or `count` pages from a number on; end: the number of all pages."""

    def __init__(self, path: str | None, number: int = 0, count: int = 1, end: int = 1):
        self.path, self.number, self.count, self.end = path, number, count, end


def _tasks(low: int, high: int, end: int, options: dict) -> list[Page]:
    """Pages low to high - 1, dealt to tasks of `task` neighbours (an option, 1 by default), more where that makes over TASKS."""
    step = max(1, int(options.get("task", "1")), -(-(high - low) // TASKS))
    return [Page(None, k, min(step, high - k), end) for k in range(low, high, step)]


def _tuples(page: dict, names: list[str], first: int):
    for k, row in enumerate(page.get("rows") or []):
        inner = row.get("row", row)
        yield tuple(row.get("row_idx", first + k) if n == "row_idx" else inner.get(n) for n in names)


class PagedReader(DataSourceReader):
    """All pages, by the option pages (their files) or url."""

    def __init__(self, schema, options):
        self.names, self.options = [f.name for f in schema.fields], dict(options)
        self.retries = int(options.get("retries", "6"))

    def partitions(self):
        if "pages" in self.options:
            return [Page(p) for p in self.options["pages"].split("|") if p]
        n = Source(self.options).page_count()
        return _tasks(0, n, n, self.options)

    def read(self, partition):
        if partition.path is None:
            yield from read_pages(Source(self.options), partition, self.names)
        else:
            yield from _tuples(with_retries(lambda: load_page(partition.path), self.retries), self.names, 0)


def read_pages(source: Source, some: Page, names: list[str]):
    for k in range(some.number, some.number + some.count):
        found = source.page(k)
        if len(found.get("rows") or []) < source.size and k < some.end - 1:
            raise ValueError(f"page {k} is short, but it is not the last one")
        yield from _tuples(found, names, k * source.size)


class PagedStream(DataSourceStreamReader):
    """Offsets are (page, request): a checkpoint of another request is refused.

    Option batch: pages a batch at most. Spark asks for the latest offset before it tells a reader its place, so the
    limit needs option checkpoint, the stream's folder: without one there the place is 0. A reader that goes on
    after a clean stop learns its place with its first batch, which takes what is left.
    """

    def __init__(self, schema, options):
        self.names, self.options, self.source = [f.name for f in schema.fields], dict(options), Source(options)
        asked = {k: v for k, v in self.options.items() if k.lower() in ("url", "size", "request")}
        self.request = hashlib.sha256(json.dumps(asked, sort_keys=True).encode()).hexdigest()[:16]
        self.end, self.most = None, int(options.get("batch", "0"))
        self.at = 0 if "checkpoint" in self.options and not _exists(self.options["checkpoint"]) else None

    def _offset(self, page: int) -> dict:
        return {"page": page, "request": self.request}

    def initialOffset(self):
        return self._offset(0)

    def latestOffset(self):
        if self.end is None:
            self.end = self.source.page_count()
        return self._offset(self.end if self.at is None or not self.most else min(self.end, self.at + self.most))

    def partitions(self, start, end):
        for known in (start, end):
            if known["request"] != self.request:
                raise ValueError("the checkpoint belongs to another request")
        self.at = max(self.at or 0, end["page"])
        if self.end is None:
            self.end = self.source.page_count()
        return _tasks(start["page"], end["page"], self.end, self.options)

    def read(self, partition):
        yield from read_pages(self.source, partition, self.names)

    def commit(self, end):
        self.at = max(self.at or 0, end["page"])


class PagedSource(DataSource):
    """spark.dataSource.register(PagedSource); then format("pages") in spark.read or spark.readStream."""

    @classmethod
    def name(cls):
        return "pages"

    def schema(self):
        return "row_idx long, problem string, solution string, source string"

    def reader(self, schema):
        return PagedReader(schema, self.options)

    def streamReader(self, schema):
        return PagedStream(schema, self.options)


def set_folder(path: str, by: str, value) -> str:
    """Where write_pages puts the pages of one value."""
    from urllib.parse import quote

    return f"{path}/{by}={'__null__' if value is None else quote(str(value), safe='')}"


def write_pages(rows, path: str, size: int, by: str | None = None) -> None:
    """rows (with ord from 0) as a folder of pages, as PagedSource replays it.

    by: a column with few values; rows lie in its order, and each value has its pages in set_folder. A page is a file
    of its own, which tasks put in place themselves: no committer lists or moves it. Tried again, it is replaced by its like.
    """
    from pyspark.sql import functions as F

    total = rows.groupBy(*([F.col(by).alias("__by")] if by else [])).agg(F.count("*").alias("num_rows_total"), F.min("ord").alias("first"))
    placed = rows.join(F.broadcast(total), F.col(by).eqNullSafe(F.col("__by")) if by else None).withColumn("ord", F.col("ord") - F.col("first"))
    item = F.struct(F.col("ord").alias("row_idx"), F.struct(*[c for c in rows.columns if c not in ("ord", by)]).alias("row"))
    name = F.col(by).cast("string").alias("name") if by else F.lit(None).cast("string").alias("name")
    pages = placed.groupBy(name, F.floor(F.col("ord") / size).alias("page"), "num_rows_total").agg(F.collect_list(item).alias("rows"))
    in_order = F.array_sort("rows", lambda a, b: F.signum(a["row_idx"] - b["row_idx"]).cast("int"))
    texts = pages.select("name", "page", F.to_json(F.struct(in_order.alias("rows"), "num_rows_total"), {"ignoreNullFields": "false"}).alias("value"))

    def write(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
        for b in batches:
            for own, page, value in zip(*(b.column(c).to_pylist() for c in ("name", "page", "value"))):
                folder = f"{set_folder(root, by, own) if by else root}/page={page}"
                where.create_dir(folder, recursive=True)
                other = f"{folder}/.{uuid.uuid4().hex}"
                with where.open_output_stream(other) as f:
                    f.write(value.encode())
                where.move(other, f"{folder}/page.json")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    texts.mapInArrow(write, "n long").agg(F.sum("n")).collect()


def count_sets(spark, sets: list[tuple[str, str]], options: dict | None = None):
    """(name, n): the total that a page of each set (name, url) says, each asked by a task of its own."""
    given = dict(options or {})

    def ask(batches):
        import pyarrow as pa

        for b in batches:
            n = [Source({**given, "url": url}).total() for url in b.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(n, pa.int64())], ["name", "n"])

    rows = spark.createDataFrame(sets, "name string, url string").repartition(max(1, len(sets)))
    return rows.mapInArrow(ask, "name string, n long")
