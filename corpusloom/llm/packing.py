"""Bounded-space online packing of tokenised documents into windows of fixed length.

Each partition keeps `open_windows` windows. The full windows a document fills leave at once; the
remainder goes to the open window that it fits best. Where none fits and no further window may open, the
fullest one is filled with the remainder's head and emitted, and the rest goes on. At the partition's end
the open windows are merged, and what is short of one window joins the leftovers of up to `merge`
neighbouring partitions. The last leftover of such a group is cut to lengths that are powers of two, which
need no padding.

Defined cases: a null text is the empty text and still gives the closing id 0; repeated rows (and null
doc_ids) are packed row by row; an empty table gives no piece; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

TOKENIZER = "byte_bpe_50k.json"
SPECIAL = "<|endoftext|>"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str | None = None):
    """text -> uint32 ids, as `tokenizers` gives them for that file without added special tokens.

    A vocabulary that also comes as ranks beside its JSON is encoded by tiktoken, about four times
    faster with equal ids; texts that hold a special token's string always go to `tokenizers`.
    """
    import sys

    path = path or tokenizer_path()
    loaded = sys.__dict__.setdefault("_corpusloom_encoders", {})  # outlives one task of a worker
    if path not in loaded:
        import base64
        import os

        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_, special_tokens={})
        else:
            fast = None
        special = [t.content for t in slow.get_added_tokens_decoder().values()]

        def run(text: str) -> np.ndarray:
            if fast is None or any(s in text for s in special):
                return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
            return fast.encode_to_numpy(text, disallowed_special=())

        loaded[path] = run
    return loaded[path]


class Packer:
    """State of one partition: open windows as lists of (doc, start, ids, doc_tokens) and free room."""

    def __init__(self, size: int, open_windows: int, first_id: int):
        self.size, self.most, self.next = size, open_windows, first_id
        self.free: list[int] = []
        self.held: list[list[tuple]] = []
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple], leftover: bool = False) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            data = ids.astype("<u4").tobytes()
            self.rows.append((doc, start, len(ids), zlib.crc32(data), total, self.next, at, data if leftover else None))
            at += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray, start: int = 0, total: int | None = None) -> None:
        n = start + len(ids) if total is None else total
        at, end = 0, len(ids)
        while end - at >= self.size:
            self.emit([(doc, start + at, ids[at : at + self.size], n)])
            at += self.size
        while at < end:
            rest = end - at
            fits = [(f, k) for k, f in enumerate(self.free) if f >= rest]
            if fits:
                k = min(fits)[1]
            elif len(self.free) < self.most:
                self.free.append(self.size)
                self.held.append([])
                k = len(self.free) - 1
            else:
                k = min((f, k) for k, f in enumerate(self.free))[1]
            take = min(rest, self.free[k])
            self.held[k].append((doc, start + at, ids[at : at + take], n))
            self.free[k] -= take
            at += take
            if not self.free[k]:
                self.emit(self.held.pop(k))
                self.free.pop(k)

    def merge(self) -> list[tuple]:
        """Close all windows: full ones are emitted; the pieces of the last, short one are returned."""
        pieces, room = [], self.size
        for doc, start, ids, total in (p for held in self.held for p in held):
            at = 0
            while at < len(ids):
                take = min(room, len(ids) - at)
                pieces.append((doc, start + at, ids[at : at + take], total))
                at, room = at + take, room - take
                if not room:
                    self.emit(pieces)
                    pieces, room = [], self.size
        self.free, self.held = [], []
        return pieces

    def finish(self, pieces: list[tuple]) -> None:
        """Emit a short window in parts whose lengths are powers of two."""
        left, room, part = sum(len(p[2]) for p in pieces), 0, []
        for doc, start, ids, total in pieces:
            at = 0
            while at < len(ids):
                if not room:
                    room = 1 << (left.bit_length() - 1)
                    left -= room
                take = min(room, len(ids) - at)
                part.append((doc, start + at, ids[at : at + take], total))
                at, room = at + take, room - take
                if not room:
                    self.emit(part)
                    part = []

    def batch(self) -> pa.RecordBatch:
        types = [pa.int64()] * 7 + [pa.binary()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        cols = list(zip(*self.rows)) or [()] * 8
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)


def pack(docs: DataFrame, size: int = 1024, open_windows: int = 32, merge: int = 256, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer)
        packer = Packer(size, open_windows, TaskContext.get().partitionId() << 36)
        close = np.array([end_id], np.uint32)
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                packer.add(doc, np.concatenate([encode(text.as_py() or ""), close]))
                if len(packer.rows) >= 20_000:
                    yield packer.batch()
        rest = packer.merge()
        if rest:
            packer.emit(rest, leftover=True)
        yield packer.batch()

    def join(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist()
        packer = Packer(size, 1, (1 << 62) + (rows[0]["sequence_id"] >> 36 << 20))
        for r in rows:
            packer.held.append([(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"])])
        packer.finish(packer.merge())
        return pa.Table.from_batches([packer.batch()])

    first = stage(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(fill, SCHEMA), "pieces").df
    left = first.where("ids is not null")
    group = F.shiftright("sequence_id", 36)
    merged = left.groupBy(F.floor(group / merge)).applyInArrow(join, SCHEMA)
    return first.where("ids is null").drop("ids").unionByName(merged.drop("ids"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
