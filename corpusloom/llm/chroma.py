"""Chroma fingerprints of media columns, and the alignment of recordings by them.

A recording becomes frames of twelve pitch-class energies. Over the frames' integral image sixteen
rectangle filters (wholes, halves, quarters and thirds of WINDOW frames by some pitch classes) compare the
logarithms of sums; each answer is quantised to two Gray-coded bits, and sixteen of them pack into one
32-bit integer per frame position. Recordings align
where integers agree, every position of the one held against every position of the other: a histogram of their
offsets names the offsets of a pair, one vote is enough, and the first of them, in falling order of votes, at
which the share of differing bits over the overlap is small decides.

Search: the classes of recordings with equal integers that hold an id divisible by 100 are the queries,
against all classes. The queries are dealt to blocks of about BLOCK_BYTES. A task makes the integers of some
thousand recordings once and holds one block after the other against them: votes and comparisons happen there,
so that nothing of a recording but its matches is written, and those stay one row. Up to PASS_BYTES of blocks
are sent out at once; beyond that there are further passes, so that memory and disk are bounded at any size.

Sources of frames: `pcm_frames` reads WAV or raw 16-bit PCM from a binary column. The given tables hold no
audio, so the registered query reads each text of `documents` as a score: a word is a frame, and each of its
bytes sounds the pitch class of its value modulo 12.

Defined cases: a null or empty text, or one with fewer words than WINDOW, has no integers, forms one class
with others like it and matches nothing; very long texts are read in portions, with equal results; a null
doc_id is never a query and never names a class unless alone; of offsets with equal votes the smallest in
size, then the negative one, goes first; repeated rows get equal results; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import re
import wave
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import meet, stage, table

CLASSES = 12
WINDOW = 16
LEAST_OVERLAP = 8
MOST_ERROR = 0.25
#: Integers of the queries, with their places, that a task holds at once.
BLOCK_BYTES = 32 << 20
#: Agreeing positions that are counted by offset at once.
HITS = 1 << 21
#: Blocks that are broadcast for one pass over all recordings (about 300 MB of them at 30 GB of text).
PASS_BYTES = 512 << 20
#: Digests of recordings that a task has settled and need not settle again.
REMEMBERED = 200_000
#: Bytes of text whose frames are made at once.
PORTION = 1 << 20
#: A class with more than this part of all rows is heavy: there are at most PARTS of them.
PARTS = 4096

#: (kind, first pitch class, pitch classes, frames) of the sixteen filters, by rule.
FILTERS = tuple((k % 6, (5 * k) % 9, 3 + k % 4 if k % 4 < 3 else 3, WINDOW if k % 2 else WINDOW // 2) for k in range(16))
#: The two bits of an answer count the levels that the logarithm of the quotient of sums reaches.
LEVELS = np.exp((-0.25, 0.0, 0.25))
GRAY = np.array([0, 1, 3, 2], np.uint32)

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def byte_frames(text: bytes) -> np.ndarray:
    data = np.frombuffer(b" " + text, np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    first = ~space[1:] & space[:-1]
    word = np.cumsum(first, dtype=np.int32) - 1
    letters = ~space[1:]
    n = int(first.sum())
    return np.bincount(word[letters] * CLASSES + data[1:][letters] % CLASSES, minlength=n * CLASSES).reshape(n, CLASSES).astype(np.int32)


def text_frames(text: str | None) -> np.ndarray:
    """A frame a word: how often its bytes fall to each pitch class."""
    return byte_frames((text or "").encode("utf-8", "surrogatepass"))


def text_integers(texts: list[str | None]) -> list[np.ndarray]:
    """integers(text_frames(t)) of each: short texts together, long ones in portions. Sums of counts are exact, so that both agree."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    out: list = [None] * len(data)
    group: list[int] = []

    def settle() -> None:
        words = [byte_frames(data[i]) for i in group]
        every = integers(np.concatenate(words)) if words else None
        at = 0
        for i, own in zip(group, words):
            out[i] = every[at : at + max(0, len(own) - WINDOW + 1)]
            at += len(own)
        group.clear()

    size = 0
    for i, t in enumerate(data):
        if len(t) > PORTION:
            parts, left, at = [], np.zeros((0, CLASSES), np.int32), 0
            while at < len(t):
                gap = _SPACE.search(t, at + PORTION)
                end = gap.start() if gap else len(t)
                left = np.concatenate([left[max(0, len(left) - WINDOW + 1) :], byte_frames(t[at:end])])
                parts.append(integers(left))
                at = end
            out[i] = np.concatenate(parts)
            continue
        if size + len(t) > PORTION:
            settle()
            size = 0
        group.append(i)
        size += len(t)
    settle()
    return out


def pcm_frames(data: bytes | None, rate: int = 11025, size: int = 4096, hop: int = 1365) -> np.ndarray:
    """Pitch-class energies of overlapping Hamming frames; WAV is read by its header, else 16-bit mono."""
    if not data:
        return np.zeros((0, CLASSES))
    if data[:4] == b"RIFF":
        with wave.open(io.BytesIO(data)) as w:
            rate, channels = w.getframerate(), w.getnchannels()
            data = w.readframes(w.getnframes())
        samples = np.frombuffer(data, "<i2").reshape(-1, channels).mean(axis=1)
    else:
        samples = np.frombuffer(data[: len(data) // 2 * 2], "<i2").astype(float)
    if len(samples) < size:
        return np.zeros((0, CLASSES))
    freq = np.fft.rfftfreq(size, 1 / rate)
    heard = (freq >= 28) & (freq <= 3520)
    pitch = np.round(12 * np.log2(freq[heard] / 440)).astype(int) % CLASSES
    window, out = np.hamming(size), []
    for at in range(0, len(samples) - size + 1, hop):
        power = np.abs(np.fft.rfft(samples[at : at + size] * window)[heard]) ** 2
        energy = np.bincount(pitch, power, CLASSES)
        out.append(energy / max(1e-9, np.sqrt((energy**2).sum())))
    return np.array(out)


def integers(frames: np.ndarray) -> np.ndarray:
    """One packed integer for each WINDOW frames in a row."""
    n = len(frames) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    image = np.zeros((CLASSES + 1, len(frames) + 1), np.int64 if frames.dtype.kind in "iu" else float)
    image[1:, 1:] = frames.T.cumsum(0).cumsum(1)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return image[p1, t1 : t1 + n] - image[p1, t0 : t0 + n] - image[p0, t1 : t1 + n] + image[p0, t0 : t0 + n]

    packed = np.zeros(n, np.uint32)
    for kind, p, high, wide in FILTERS:
        whole = area(0, wide, p, p + high)
        if kind == 0:
            part = area(0, WINDOW, 0, CLASSES) * (high * wide / (CLASSES * WINDOW))
            plus, minus = whole, part
        elif kind == 1:
            plus = area(0, wide, p, p + high // 2)
            minus = (whole - plus) * (high // 2) / (high - high // 2)
        elif kind == 2:
            plus = area(0, wide // 2, p, p + high)
            minus = whole - plus
        elif kind == 3:
            plus = area(0, wide // 2, p, p + high // 2) + area(wide // 2, wide, p + high // 2, p + high)
            minus = whole - plus
        elif kind == 4:
            plus = area(0, wide, p + 1, p + high - 1) * (2 / (high - 2))
            minus = area(0, wide, p, p + 1) + area(0, wide, p + high - 1, p + high)
        else:
            third = wide // 3
            plus = area(third, wide - third, p, p + high) * (2 * third / (wide - 2 * third))
            minus = area(0, third, p, p + high) + area(wide - third, wide, p, p + high)
        plus, minus = 1 + np.maximum(plus, 0), 1 + np.maximum(minus, 0)
        code = (plus >= minus * LEVELS[0]).astype(np.uint8) + (plus >= minus) + (plus >= minus * LEVELS[2])
        packed = packed << np.uint32(2) | GRAY[code]
    return packed


def bit_error(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, float]:
    """Overlap when b starts `offset` places into a, and the share of differing bits in it."""
    x, y = (a[offset:], b) if offset >= 0 else (a, b[-offset:])
    n = min(len(x), len(y))
    return n, float(np.bitwise_count(x[:n] ^ y[:n]).sum() / (32 * n)) if n > 0 else 1.0


def _integers(frames: Callable, batched: bool) -> Callable:
    def run(media: pa.Array) -> list[np.ndarray]:
        return text_integers(media.to_pylist()) if batched else [integers(frames(raw.as_py())) for raw in media]

    return run


def _describe(of: Callable, every: int) -> Callable:
    """A row's integers: their number and digests, and for a query the integers themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, values in zip(b.column("id").to_pylist(), of(b.column("media"))):
                data = values.tobytes()
                asks = k is not None and k % every == 0
                out.append((len(values), zlib.crc32(data), hashlib.md5(data).digest(), data if asks else None))
            cols = list(zip(*out)) or [()] * 4
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.int64()), *arrays], ["id", "n", "crc", "digest", "ints"])

    return run


def _marks(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All positions of several recordings: integers, places, and which recording each is of."""
    sizes = [len(v) for v in values]
    places = [np.arange(n, dtype=np.int32) for n in sizes]
    who = np.repeat(np.arange(len(values), dtype=np.int32), sizes)
    return np.concatenate([np.zeros(0, np.uint32), *values]), np.concatenate([np.zeros(0, np.int32), *places]), who


def _counted(keys: np.ndarray, votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with the sum of its votes."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.append(len(keys) > 0, keys[1:] != keys[:-1]))
    return keys[new], np.add.reduceat(votes[order], new) if len(new) else votes


def candidates(block: tuple, marks: np.ndarray, places: np.ndarray, who: np.ndarray, alike: np.ndarray) -> np.ndarray:
    """Rows (recording, query, offset, votes), those of a pair in the order in which to try them. alike: each recording's own query.

    HITS agreeing positions are counted at a time, as a value that repeats in both recordings agrees at very many.
    """
    value, query, at = block[:3]
    lo = np.searchsorted(value, marks)
    some = np.flatnonzero(np.append(value, np.uint32(0))[lo] == marks) if len(value) else np.zeros(0, np.int64)
    lo, places, who = lo[some], places[some].astype(np.int64), who[some].astype(np.int64)
    n = np.searchsorted(value, marks[some], "right") - lo
    found, some = n > 0, None
    lo, places, who, n = lo[found], places[found], who[found], n[found]
    # a hit as one number: recording, query, offset; an Arrow batch and a block are small enough for it
    queries, low = int(query.max(initial=0)) + 1, int(places.max(initial=0))
    span = low + int(at.max(initial=0)) + 1
    ends, start = np.cumsum(n), 0
    keys, votes, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), []
    while start < len(n):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] - n[start] + HITS, "right")))
        k = n[start:stop]
        hit = np.repeat(lo[start:stop] - np.cumsum(k) + k, k) + np.arange(int(k.sum()))
        row, q = np.repeat(who[start:stop], k), query[hit]
        key = (row * queries + q) * span + at[hit] - np.repeat(places[start:stop], k) + low
        key = np.sort(key[q != alike[row]])
        new = np.flatnonzero(np.append(len(key) > 0, key[1:] != key[:-1]))
        waiting.append((key[new], np.diff(np.append(new, len(key)))))
        start = stop
        if start == len(n) or sum(len(w[0]) for w in waiting) > max(HITS, len(keys)):
            keys, votes = _counted(*(np.concatenate(x) for x in zip((keys, votes), *waiting)))
            waiting = []
    pair, offset = np.divmod(keys, span)
    offset -= low
    order = np.lexsort((offset, np.abs(offset), -votes, pair))
    return np.column_stack([pair // queries, pair % queries, offset, votes])[order]


def bit_errors(x: np.ndarray, x_first: np.ndarray, y: np.ndarray, y_first: np.ndarray, a: np.ndarray, b: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """bit_error of many: recordings a of those in x (each from x_first to the next), b of those in y, by their offsets."""
    p, q = x_first[a] + np.maximum(offset, 0), y_first[b] + np.maximum(-offset, 0)
    n = np.maximum(0, np.minimum(x_first[a + 1] - p, y_first[b + 1] - q))
    ends, start, wrong = np.cumsum(n), 0, np.zeros(len(n), np.int64)
    while start < len(n):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] - n[start] + HITS, "right")))
        k = n[start:stop]
        first = np.cumsum(k) - k
        step = np.arange(int(k.sum())) - np.repeat(first, k)
        bits = np.bitwise_count(x[np.repeat(p[start:stop], k) + step] ^ y[np.repeat(q[start:stop], k) + step])
        sums = np.append(0, np.cumsum(bits, dtype=np.int64))
        wrong[start:stop] = sums[first + k] - sums[first]
        start = stop
    return n, np.where(n > 0, wrong / np.maximum(32 * n, 1), 1.0)


def _search(of: Callable, blocks: list) -> Callable:
    """Matches of every recording with the queries of these blocks, one block in memory at a time."""
    kind = pa.list_(pa.struct([("query_id", pa.int64()), ("offset", pa.int32()), ("votes", pa.int64()), ("bit_error", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            fresh: dict[bytes, np.ndarray] = {}
            for v in of(b.column("media")):
                d = hashlib.md5(v.tobytes()).digest()
                if len(v) and d not in seen:
                    fresh[d] = v
            if len(seen) < REMEMBERED:
                seen.update(fresh)
            digests, values = list(fresh), list(fresh.values())
            marks, places, who = _marks(values)
            flat, sizes = marks, np.array([len(v) for v in values], np.int64)
            starts = np.append(0, np.cumsum(sizes))
            found: list[list[dict]] = [[] for _ in values]
            for sent in blocks:
                block = sent.load_from_path(sent._path)  # not kept: the next one takes its place
                _, _, _, known, names, ints, first = block
                alike = np.array([known.get(d, -1) for d in digests], np.int64)
                rows = candidates(block, marks, places, who, alike)
                top = np.append(len(rows) > 0, (rows[1:, :2] != rows[:-1, :2]).any(1))[: len(rows)]
                pair = np.cumsum(top) - 1
                settled = np.zeros(int(top.sum()), bool)
                for now in (top, ~top):  # most pairs are settled by their first offset
                    left = np.flatnonzero(now & ~settled[pair])
                    row, q, off, votes = rows[left].T
                    n, error = bit_errors(ints, first, flat, starts, q, row, off)
                    near = (error <= MOST_ERROR) & (n >= np.minimum(LEAST_OVERLAP, np.minimum(np.diff(first)[q], sizes[row])))
                    near[near] = np.append(True, np.diff(pair[left[near]]) != 0)[: int(near.sum())]
                    settled[pair[left[near]]] = True
                    for i, k, o, v, e in zip(*(x[near].tolist() for x in (row, q, off, votes, error))):
                        found[i].append({"query_id": names[k], "offset": o, "votes": v, "bit_error": round(e, 6)})
            some = [i for i, f in enumerate(found) if f]
            yield pa.RecordBatch.from_arrays([pa.array([digests[i] for i in some], pa.binary()), pa.array([found[i] for i in some], kind)], ["digest", "matches"])

    return run


def _block(queries: DataFrame):
    """A block of queries as arrays for every task: all positions in order (value, query, place), digests, names, integers."""
    rows = queries.orderBy("digest").toArrow()
    values = [np.frombuffer(x.as_buffer(), np.uint32) for x in rows["ints"]]
    marks, places, who = _marks(values)
    order = np.argsort(marks, kind="stable")
    known = {d: i for i, d in enumerate(rows["digest"].to_pylist())}
    first = np.append(0, np.cumsum([len(v) for v in values])).astype(np.int64)
    packed = (marks[order], who[order], places[order], known, rows["class_id"].to_pylist(), np.concatenate([np.zeros(0, np.uint32), *values]), first)
    return queries.sparkSession.sparkContext.broadcast(packed)


def align(media: DataFrame, frames: Callable = text_frames, every: int = 100, block_bytes: int = BLOCK_BYTES, pass_bytes: int = PASS_BYTES, parts: int = PARTS) -> DataFrame:
    """media: (id, media). One row per row: id, n_items, class_id, crc32, matches by the class's queries."""
    of = _integers(frames, frames is text_frames)
    media = media.select("id", "media")
    base = stage(media.mapInArrow(_describe(of, every), "id long, n long, crc long, digest binary, ints binary"), "prints").df
    kinds = stage(base.groupBy("digest").agg(F.min("id").alias("class_id"), F.count("*").alias("copies")), "classes").df
    queries = base.where("ints IS NOT NULL AND n > 0").select("digest", "ints").dropDuplicates(["digest"])
    queries = stage(queries.join(kinds.select("digest", "class_id"), "digest"), "queries").df
    size = queries.agg(F.sum(4 * F.octet_length("ints"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    found, match = [], "array<struct<query_id: bigint, offset: int, votes: bigint, bit_error: double>>"
    at_once = max(1, pass_bytes // block_bytes)
    for low in range(0, blocks, at_once):
        sent = [_block(queries.where(F.pmod(F.xxhash64("digest"), F.lit(blocks)) == i)) for i in range(low, min(blocks, low + at_once))]
        rows = media.select("media").mapInArrow(_search(of, sent), f"digest binary, matches {match}")
        found.append(stage(rows.groupBy("digest").agg(F.first("matches").alias("matches")), "matches").df)  # copies have equal ones
        for s in sent:
            s.destroy()
    none = F.array().cast(match)
    if found:
        every_ = reduce(DataFrame.unionByName, found)
        if len(found) > 1:
            every_ = every_.groupBy("digest").agg(F.flatten(F.collect_list("matches")).alias("matches"))
        kinds = kinds.join(every_.select("digest", F.array_sort("matches").alias("matches")), "digest", "left")
    else:
        kinds = kinds.withColumn("matches", none)
    kinds = stage(kinds.select("digest", "class_id", "copies", "matches"), "matched").df
    rows = base.select("id", "n", "crc", "digest")
    heavy = stage(kinds.where(F.col("copies") > rows.count() // parts).select("digest"), "heavy").df
    out = meet(rows, kinds.drop("copies"), heavy, ["digest"])
    return out.select("id", F.col("n").alias("n_items"), "class_id", F.col("crc").alias("crc32"), F.coalesce("matches", none).alias("matches"))


def op2_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return align(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("media"))).withColumnRenamed("id", "doc_id")
