"""A sink that commits: parts become visible together, by one manifest that appears whole or not at all.

Tasks write Parquet parts and send back what they wrote. Only the driver's commit names parts, in a manifest that is
written under another name and then renamed. Readers see the parts of manifests and nothing else, so a job that fails or is killed
before its commit leaves nothing to be read; `vacuum` removes such parts. Each manifest has a number: an
existing one is never replaced, a writer that overwrites adds one that hides all before it, and a stream's batch
commits once however often it is tried. A part that is missing or has fewer rows than committed is an error.

spark.dataSource.register(CommittedTable); then format("committed") with option path in df.write (append or
overwrite), spark.read.schema(s) and df.writeStream. Options: exclusive (a table that exists is an error), commit (a
number of one's own, for what may be tried again), rows (a reader expects so many at least).
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def write_json(path: str, value: dict) -> None:
    """JSON that appears whole: written under another name, then renamed."""
    where, inner = file_system(path)
    where.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    other = f"{inner.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
    with where.open_output_stream(other) as f:
        f.write(json.dumps(value, ensure_ascii=False, sort_keys=True).encode())
    where.move(other, inner)


def manifests(path: str) -> dict[str, dict]:
    """Name and content of every manifest, in order."""
    where, inner = file_system(path)
    found = where.get_file_info(fs.FileSelector(f"{inner}/manifest", allow_not_found=True))
    out = {}
    for f in sorted((f for f in found if not f.base_name.startswith(".")), key=lambda f: f.base_name):
        with where.open_input_stream(f.path) as data:
            out[f.base_name] = json.loads(data.read())
    return out


def committed(path: str) -> list[dict]:
    """The parts that readers see: {file, rows}."""
    parts: list[dict] = []
    for m in manifests(path).values():
        parts = m["parts"] if m["replaces"] else parts + m["parts"]
    return parts


def _drop(path: str, files: list[str]) -> None:
    where, inner = file_system(path)
    for f in files:
        if where.get_file_info(f"{inner}/parts/{f}").is_file:
            where.delete_file(f"{inner}/parts/{f}")


def vacuum(path: str) -> int:
    """Remove the parts that no manifest names; not to be run beside a writer. How many they were."""
    where, inner = file_system(path)
    named = {p["file"] for m in manifests(path).values() for p in m["parts"]}
    found = where.get_file_info(fs.FileSelector(f"{inner}/parts", allow_not_found=True))
    loose = [f.base_name for f in found if f.base_name not in named]
    _drop(path, loose)
    return len(loose)


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class _Writer:
    def __init__(self, options: dict, overwrite: bool, stream: bool = False):
        self.path, self.overwrite = options["path"], overwrite
        self.exclusive = str(options.get("exclusive", "false")).lower() == "true"
        known = manifests(self.path)
        if known and self.exclusive and not stream:
            raise FileExistsError(f"a table exists at {self.path}")
        self.tried = "commit" in options  # a commit's own number: tried again, it counts once
        number = int(options["commit"]) if self.tried else max((int(n.split(".")[0]) for n in known), default=-1) + 1
        self.next = f"{number:09d}.json"

    def write(self, iterator) -> Written:
        where, inner = file_system(self.path)
        where.create_dir(f"{inner}/parts", recursive=True)
        name, rows, out = f"{uuid.uuid4().hex}.parquet", 0, None
        try:
            for batch in iterator:
                if out is None:
                    out = pq.ParquetWriter(f"{inner}/parts/{name}", batch.schema, filesystem=where, compression="zstd")
                out.write_batch(batch)
                rows += batch.num_rows
        except BaseException:
            if out is not None:
                out.close()
                _drop(self.path, [name])
            raise
        if out is not None:
            out.close()
        return Written(name, rows)

    def _commit(self, messages, name: str) -> None:
        parts = [{"file": m.file, "rows": m.rows} for m in messages if m is not None and m.rows]
        if name in manifests(self.path):
            raise FileExistsError(f"{name} is committed at {self.path}")
        write_json(f"{self.path}/manifest/{name}", {"parts": parts, "rows": sum(p["rows"] for p in parts), "replaces": self.overwrite})

    def _commit_once(self, messages, name: str) -> None:
        if name in manifests(self.path):  # it was tried before, and committed
            self._abort(messages)
        else:
            self._commit(messages, name)

    def _abort(self, messages) -> None:
        _drop(self.path, [m.file for m in messages if m is not None])


class BatchWriter(_Writer, DataSourceArrowWriter):
    def commit(self, messages):
        self._commit_once(messages, self.next) if self.tried else self._commit(messages, self.next)

    def abort(self, messages):
        self._abort(messages)


class StreamWriter(_Writer, DataSourceStreamArrowWriter):
    def commit(self, messages, batchId):
        self._commit_once(messages, f"{batchId:09d}.json")

    def abort(self, messages, batchId):
        self._abort(messages)


class Part(InputPartition):
    def __init__(self, file: str, rows: int):
        self.file, self.rows = file, rows


class Reader(DataSourceReader):
    def __init__(self, schema, options):
        self.names, self.path = [f.name for f in schema.fields], options["path"]
        self.least = int(options.get("rows", "0"))

    def partitions(self):
        parts = committed(self.path)
        if sum(p["rows"] for p in parts) < self.least:
            raise ValueError(f"{self.path} holds fewer than the {self.least} rows expected")
        return [Part(**p) for p in parts] or [Part("", 0)]

    def read(self, partition):
        if not partition.file:
            return
        where, inner = file_system(self.path)
        rows = 0
        with pq.ParquetFile(f"{inner}/parts/{partition.file}", filesystem=where) as f:
            for batch in f.iter_batches(columns=self.names):
                rows += batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(n) for n in self.names], self.names)
        if rows < partition.rows:
            raise ValueError(f"{partition.file} holds {rows} of {partition.rows} committed rows")


class CommittedTable(DataSource):
    @classmethod
    def name(cls):
        return "committed"

    def reader(self, schema):
        return Reader(schema, self.options)

    def writer(self, schema, overwrite):
        return BatchWriter(self.options, overwrite)

    def streamWriter(self, schema, overwrite):
        return StreamWriter(self.options, False, stream=True)
