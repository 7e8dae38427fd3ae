"""Fuzzy line deduplication: MinHash, banding, exact Jaccard, distributed union-find.

Lines are parted by \\n and compared without white space at their ends. Equal lines collapse first by an
aggregation with map-side combine. Each distinct line then gets a MinHash signature over its character
shingles (SHINGLE characters), and BANDS bands of ROWS values make it meet its candidates; at a similarity
of 0.8 a pair misses all bands with probability under 3e-4, at 0.85 under 1e-5. In a bucket every line meets
the most frequent one (its centre), candidate pairs' exact Jaccard similarity is computed, and those of at
least `threshold` link. The components of these links go back to the buckets. Where a bucket's lines then
lie in several components, they are dealt to tasks by pairs of blocks of BLOCK lines, and each task tests the
pairs that nothing links yet: bitmaps of the shingles bound the symmetric difference from below, which loses
no pair, and what passes is tested exactly. Such a bucket costs the square of its lines in the number of
those bounds (some nanoseconds each), spread over tasks. All links form components, and of each component
one occurrence stays, that with the smallest (doc_id, line number).

Band keys travel packed: a task parts its keys by their highest bits into BUCKETS or more binary rows.

Defined cases: blank lines always stay, and a null text stays null (it has no lines); lines shorter than a
shingle meet only equal lines; rows with one doc_id count as one document, a null doc_id comes after all
others; repeated rows get equal results; very long lines are shingled whole; an empty table gives an empty
result; other columns are kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .common import connected_components, free_names, stage, table

SHINGLE = 8
BANDS, ROWS = 16, 4
BLOCK = 2048
#: Packed rows that a bucket of keys should have at most, the least number of buckets, and keys sorted at once.
PACKED, BUCKETS, CHUNK = 1 << 20, 256, 1 << 22
THRESHOLD = 0.8
#: Up to this many line numbers are broadcast to narrow a scan; beyond it the join is shuffled.
BROADCAST_ROWS = 2_000_000
#: The same for rows of a hash and a place (about 40 MB).
NARROW_ROWS = 500_000

_M = 0x9E3779B97F4A7C15


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(lines: list[str], k: int | Callable = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all k-character shingles of all lines, and how many each line has (0 if too short).

    Where k is a function it gives both, for texts of another kind of shingle.
    """
    if callable(k):
        return k(lines)
    sizes = np.array([len(x) for x in lines], np.int64)
    c = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    counts = np.maximum(sizes - k + 1, 0)
    if not counts.sum():
        return np.zeros(0, np.uint64), counts
    with np.errstate(over="ignore"):
        if k & (k - 1) == 0:  # a polynomial of k terms by doubling
            h, step, m = c, 1, np.uint64(_M)
            while step < k:
                h = h[:-step] * m + h[step:]
                m, step = m * m, step * 2
        else:
            h = np.zeros(len(c) - k + 1, np.uint64)
            for j in range(k):
                h = h * np.uint64(_M) + c[j : len(c) - k + 1 + j]
        inside = np.ones(len(h) + k - 1, bool)  # shingles that do not run over a line's end
        ends = np.cumsum(sizes)
        for j in range(1, k):
            inside[ends[sizes >= j] - j] = False
        h = h[inside[: len(h)]]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29)), counts


def signatures(lines: list[str], k: int | Callable = SHINGLE, size: int = BANDS * ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line index, signatures, which are there) of the lines that have a shingle.

    Every shingle falls to one of `size` bins by its hash, and each bin has its minimum. Where most bins are
    filled these make a signature (the second half); an empty bin takes the minimum of another, which a hash
    of its number and of the attempt names. Lines that leave more bins empty have few distinct shingles and
    get the minima of `size` hash functions instead (the first half). In between a line has both, so
    that two lines of nearly equal sets always share a kind: what a line has depends on its set alone.
    """
    h, counts = shingle_hashes(lines, k)
    who = np.flatnonzero(counts)
    n = counts[who]
    most = np.iinfo(np.uint64).max
    sig = np.zeros((len(who), 2 * size), np.uint64)
    if not len(who):
        return who, sig, np.zeros((0, 2), bool)
    owner = np.repeat(np.arange(len(who)), n)
    with np.errstate(over="ignore"):
        flat = np.full(len(who) * size, most, np.uint64)
        bin_ = ((h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).view(np.int64)
        np.minimum.at(flat, owner * size + bin_, h * np.uint64(_M))
        bins = flat.reshape(-1, size)
        empty = bins == most
        filled = size - empty.sum(axis=1)
        there = np.column_stack([filled < 0.92 * size, filled >= 0.75 * size])
        few = there[:, 0]
        if few.any():
            hs, starts = (h[few[owner]] >> np.uint64(16)).astype(np.uint32), np.cumsum(n[few]) - n[few]
            rng = np.random.default_rng(5)
            for j, (a, b) in enumerate(rng.integers(1, 1 << 31, (size, 2), dtype=np.uint32)):
                sig[few, j] = np.minimum.reduceat((hs ^ a) * (b * np.uint32(2) + np.uint32(1)), starts)
        rich = np.flatnonzero(there[:, 1])
        part, hole = bins[rich], empty[rich]
        r, b = np.nonzero(hole)
        for attempt in range(1, 1000):
            if not len(r):
                break
            donor = (_mix((b + size * attempt).astype(np.uint64)) % np.uint64(size)).astype(np.int64)
            ok = ~hole[r, donor]
            part[r[ok], b[ok]] = part[r[ok], donor[ok]]
            r, b = r[~ok], b[~ok]
        sig[rich, size:] = part
    return who, sig, there


def band_keys(lines: list[str], k: int | Callable = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(line index, band key), `bands` of them for each signature of a line that has a shingle."""
    who, sig, there = signatures(lines, k, bands * rows)
    owners, keys = [], []
    with np.errstate(over="ignore"):
        for kind in (0, 1):
            at = np.flatnonzero(there[:, kind])
            own = sig[at, kind * bands * rows :][:, : bands * rows]
            key = np.repeat((np.arange(bands, dtype=np.uint64)[None, :] + np.uint64(kind * bands)) * np.uint64(_M), len(at), 0)
            for j in range(rows):
                key = _mix(key ^ own[:, j::rows])
            owners.append(np.repeat(who[at], bands))
            keys.append(key.ravel())
    return np.concatenate(owners), np.concatenate(keys).view(np.int64)


def shingle_sets(lines: list[str], k: int | Callable = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each line; a line shorter than k is one shingle."""
    h, counts = shingle_hashes(lines, k)
    ends = np.cumsum(counts)
    out = []
    for line, n, end in zip(lines, counts.tolist(), ends.tolist()):
        own = np.sort(h[end - n : end]) if n else np.array([zlib.crc32(line.encode())], np.uint64)
        out.append(own[np.append(True, own[1:] != own[:-1])])
    return out


def overlap(x: np.ndarray, y: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted distinct arrays; 0 where their sizes alone keep it under `least`."""
    if len(x) > len(y):
        x, y = y, x
    if len(x) < least * len(y) - 1e-9:
        return 0.0
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return both / (len(x) + len(y) - both)


def jaccard(a: str, b: str, k: int = SHINGLE) -> float:
    """Plain form, for tests: substrings instead of their hashes."""
    x, y = ({t[i : i + k] for i in range(max(1, len(t) - k + 1))} for t in (a, b))
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def _similar(threshold: float, k: int | Callable):
    @pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out: list[bool] = []
        left, right = a.tolist(), b.tolist()
        for at in range(0, len(left), 500):
            names = list(dict.fromkeys(left[at : at + 500]))  # rows come in the order of a: each centre is split once
            sets = dict(zip(names, shingle_sets(names, k)))
            others = shingle_sets(right[at : at + 500], k)
            out += [overlap(sets[x], y, threshold) >= threshold for x, y in zip(left[at : at + 500], others)]
        return pd.Series(out, dtype="bool")

    return run


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 64-bit words for each set: bit (element modulo their number) is 1."""
    most = max(map(len, sets), default=0)
    bits = 1024 if most <= 400 else 4096 if most <= 1600 else 16384
    out = np.zeros((len(sets), bits // 64), np.uint64)
    who, every = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
    at = every % np.uint64(bits)
    np.bitwise_or.at(out, (who, (at >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (at & np.uint64(63)))
    return out


def link_block(lines: list[str], labels: list[int], sides: list[int], threshold: float, k: int | Callable = SHINGLE) -> list[tuple[int, int]]:
    """Positions of pairs that link two components; where there are two sides, pairs across them only.

    The symmetric difference of two sets is at least the number of differing bits of their bitmaps, and at a
    similarity of t at most (1 - t) / (1 + t) of the sum of their sizes.
    """
    label, side, one_side = np.unique(labels, return_inverse=True)[1], np.array(sides), len(set(sides)) == 1
    sets = shingle_sets(lines, k)
    sizes, maps, share = np.array([len(x) for x in sets]), bitmaps(sets), (1 - threshold) / (1 + threshold)
    found = []
    for x in range(len(lines) - 1):
        open_ = label[x + 1 :] != label[x]
        if not one_side:
            open_ &= side[x + 1 :] != side[x]
        open_ &= np.minimum(sizes[x + 1 :], sizes[x]) >= threshold * np.maximum(sizes[x + 1 :], sizes[x]) - 1e-9
        rest = np.flatnonzero(open_) + x + 1
        if not len(rest):
            continue
        differ = np.bitwise_count(maps[rest] ^ maps[x]).sum(axis=1, dtype=np.int64)
        for y in rest[differ <= share * (sizes[rest] + sizes[x]) + 1e-9]:
            if label[y] != label[x] and overlap(sets[x], sets[y], threshold) >= threshold:
                label[label == label[y]] = label[x]
                found.append((x, int(y)))
    return found


def _link_blocks(threshold: float, k: int | Callable):
    def pack(rows: list[tuple[int, int]]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [(), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["u", "v"])

    def settle(group: list[tuple]) -> list[tuple[int, int]]:
        group.sort(key=lambda r: (r[3], r[4]))
        roots = [r[5] for r in group]
        found = link_block([r[6] for r in group], roots, [r[3] for r in group], threshold, k)
        return [(roots[x], roots[y]) for x, y in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for b in batches:
            out: list[tuple[int, int]] = []
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "i", "j", "side", "lid", "root", "line"))):
                if group and group[0][:3] != row[:3]:
                    out += settle(group)
                    group = []
                group.append(row)
            yield pack(out)
        if group:
            yield pack(settle(group))

    return run


def _packed(x: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary value of 64-bit integers for each range between two cuts."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def _bands(k: int | Callable, bands: int, rows: int, bits: int):
    """Band keys and line numbers, packed by the `bits` highest bits of the keys."""

    def pack(keys: list[np.ndarray], lids: list[np.ndarray]) -> pa.RecordBatch:
        key, lid = np.concatenate(keys), np.concatenate(lids)
        bucket = (key.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        cuts = np.append(first, len(key))
        return pa.RecordBatch.from_arrays([pa.array(bucket[first]), _packed(key[order], cuts), _packed(lid[order], cuts)], ["bucket", "keys", "lids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        size = 0
        for b in batches:
            own, lines = b.column("lid").to_numpy(), b.column("line").to_pylist()
            for at in range(0, len(lines), 500):
                who, keys = band_keys(lines[at : at + 500], k, bands, rows)
                held[0].append(keys)
                held[1].append(own[who + at])
                size += len(keys)
                if size >= PACKED:
                    yield pack(*held)
                    held, size = ([], []), 0
        if size:
            yield pack(*held)

    return run


class Meeting:
    """Keys and line numbers of one bucket, in portions: pairs with each key's centre, and members of keys with over two lines.

    The centre is the most frequent line of the first portion with that key, as the order of line numbers has
    it. What goes on to the next portion is a key's count and its first two lines, so that a key with very many
    lines takes no more memory than any other.
    """

    def __init__(self):
        self.keys = None

    def feed(self, keys: np.ndarray, lids: np.ndarray, last: bool) -> list[np.ndarray]:
        """Columns key, rank (-1 for a pair), a, b."""
        order = np.argsort(keys)
        k = keys[order]
        if last and self.keys is None:  # the usual case: a key that stands alone meets nothing
            twice = np.append(k[1:] == k[:-1], False) | np.append(False, k[1:] == k[:-1])
            order = order[twice]
        order = order[np.lexsort((lids[order], keys[order]))]
        k, own = keys[order], lids[order]
        starts = np.flatnonzero(np.append(len(k) > 0, k[1:] != k[:-1]))
        counts = np.diff(np.append(starts, len(k)))
        group = np.repeat(np.arange(len(starts)), counts)
        names, one = k[starts], own[starts]
        two = np.where(counts > 1, own[np.minimum(starts + 1, max(0, len(own) - 1))], -1)
        before = np.zeros(len(starts), np.int64)
        if self.keys is not None and len(names):
            at = np.minimum(np.searchsorted(self.keys, names), len(self.keys) - 1)
            hit = self.keys[at] == names
            before = np.where(hit, self.counts[at], 0)
            two = np.where(before > 1, self.two[at], np.where(before == 1, one, two))
            one = np.where(before > 0, self.one[at], one)
        rank = np.arange(len(k)) - starts[group] + before[group]
        pair = rank > 0
        centre = one[group]
        large = before + counts > 2
        late1, late2 = large & (before > 0) & (before < 3), large & (before == 2)
        members = large[group]
        out = [
            (k[pair], np.full(int(pair.sum()), -1), np.minimum(centre, own)[pair], np.maximum(centre, own)[pair]),
            (k[members], rank[members], own[members], own[members]),
            (names[late1], np.zeros(int(late1.sum()), np.int64), one[late1], one[late1]),
            (names[late2], np.ones(int(late2.sum()), np.int64), two[late2], two[late2]),
        ]
        if not last:
            new = [names, before + counts, one, two]
            if self.keys is not None:
                stay = ~np.isin(self.keys, names)
                new = [np.concatenate([o[stay], n]) for o, n in zip((self.keys, self.counts, self.one, self.two), new)]
            order = np.argsort(new[0])
            self.keys, self.counts, self.one, self.two = (x[order] for x in new)
        return [np.concatenate([o[i] for o in out]).astype(np.int64) for i in range(4)]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows in the order of their buckets: pairs with centres, and members of keys that have more lines."""
    names = ["key", "rank", "a", "b"]
    bucket, meeting, keys, lids, size = None, Meeting(), [], [], 0

    def feed(last: bool) -> pa.RecordBatch:
        cols = meeting.feed(np.concatenate(keys), np.concatenate(lids), last)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

    for b in batches:
        for own, key, lid in zip(b.column("bucket").to_pylist(), b.column("keys"), b.column("lids")):
            if keys and own != bucket:
                yield feed(True)
                meeting, keys, lids, size = Meeting(), [], [], 0
            elif size >= CHUNK:
                yield feed(False)
                keys, lids, size = [], [], 0
            bucket = own
            keys.append(np.frombuffer(key.as_buffer(), np.int64))
            lids.append(np.frombuffer(lid.as_buffer(), np.int64))
            size += len(keys[-1])
    if keys:
        yield feed(True)


def similar_lines(lines: DataFrame, threshold: float = THRESHOLD, k: int | Callable = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """lines: staged (lid, line), one row a distinct line. Gives (node, root) of lines that have a link."""
    bits = min(16, max(BUCKETS, 2 * bands * lines.count() // PACKED).bit_length())
    sent = lines.select("lid", "line").mapInArrow(_bands(k, bands, rows, bits), "bucket int, keys binary, lids binary")
    sent = sent.repartition("bucket").sortWithinPartitions("bucket")
    met = stage(sent.mapInArrow(_meet, "key long, rank long, a long, b long"), "buckets").df
    large = met.where("rank >= 0").selectExpr("key", "rank", "a AS lid")

    def texts(ids: DataFrame) -> DataFrame:
        """Lines of the given lids."""
        need = stage(ids.distinct(), "needed").df
        need = F.broadcast(need) if need.count() <= BROADCAST_ROWS else need
        return stage(lines.join(need, "lid", "left_semi").select("lid", "line"), "compared").df

    pairs = stage(met.where("rank < 0").select("a", "b").distinct(), "candidates").df
    text = texts(pairs.select(F.explode(F.array("a", "b")).alias("lid")))
    both = pairs.join(text.select(F.col("lid").alias("b"), F.col("line").alias("lb")), "b")
    both = both.join(text.select(F.col("lid").alias("a"), F.col("line").alias("la")), "a")
    links = both.where(_similar(threshold, k)("la", "lb")).select(F.col("a").alias("u"), F.col("b").alias("v"))
    parts = connected_components(links).df

    named = large.join(_bounded(parts.withColumnRenamed("node", "lid")), "lid", "left")
    named = stage(named.select("key", "rank", "lid", F.coalesce("root", "lid").alias("root")), "members").df
    members = F.sum(F.xxhash64("lid").cast("decimal(20,0)")).alias("members")
    spread = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("rank").alias("top"), members)
    once = spread.where("lo <> hi").groupBy("members", "top").agg(F.min("key").alias("key")).select("key", "top")
    once = stage(once, "once").df
    open_ = stage(named.join(_bounded(once), "key"), "open").df  # of buckets with the same lines one is enough
    mine, other = F.floor(F.col("rank") / BLOCK), F.col("other")
    dealt = open_.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("top") / BLOCK))))
    dealt = dealt.select("key", F.least(mine, other).alias("i"), F.greatest(mine, other).alias("j"), mine.alias("side"), "lid", "root")
    dealt = dealt.join(texts(open_.select("lid")), "lid").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    more = dealt.select("key", "i", "j", "side", "lid", "root", "line").mapInArrow(_link_blocks(threshold, k), "u long, v long")
    more = stage(more, "links").df
    if more.isEmpty():
        return parts
    joined = connected_components(more).df.select(F.col("node").alias("root"), F.col("root").alias("top"))
    known = parts.join(_bounded(joined), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    fresh = joined.join(parts, joined["root"] == parts["node"], "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root"))
    return stage(known.unionByName(fresh), "components").df


def _bounded(rows: DataFrame) -> DataFrame:
    """rows, to be broadcast if they are few (staged rows: the count reads file footers)."""
    return F.broadcast(rows) if rows.count() <= NARROW_ROWS else rows


def _line(raw: Column) -> Column:
    """The line without white space at its ends; the slower trim runs only where a blank other than a space stands there."""
    flat = F.trim(raw)
    other = reduce(lambda a, b: a | b, [t for c in "\t\n\x0b\f\r" for t in (flat.startswith(c), flat.endswith(c))])
    return F.when(other, F.btrim(flat, F.lit(" \t\n\x0b\f\r"))).otherwise(flat)


def _hash() -> tuple[Column, Column]:
    """128 bits of a line: XXH64 under two seeds."""
    return F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), F.col("line")).alias("h2")


def _place() -> Column:
    """The order of occurrences as one number: doc_id (null after all others), then line number."""
    none = F.lit("10000000000000000000").cast("decimal(20,0)")
    doc = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), none) * F.lit("1000000000000").cast("decimal(13,0)")
    return (doc + F.col("no").cast("decimal(12,0)")).cast("decimal(38,0)")


def line_decisions(docs: DataFrame, threshold: float = THRESHOLD, **banding) -> DataFrame:
    """(doc_id, text hash, numbers of the lines that go) of documents that lose a line."""
    parts = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("th"), F.split("text", "\n").alias("parts"))
    raw = parts.select("doc_id", "th", F.posexplode("parts").alias("no", "raw"))  # the hash is made once a document
    lines = raw.select("doc_id", "th", "no", _line(F.col("raw")).alias("line")).where("line <> ''")
    found = lines.select("line", _place().alias("place")).groupBy("line").agg(F.count("*").alias("n"), F.min("place").alias("place"))
    # numbers in falling order of frequency (by powers of two), so that a bucket's first line is a frequent one
    rare = F.lit(63).cast("long") - F.floor(F.log2("n")).cast("long")
    lid = F.shiftleft(rare, 57).bitwiseOR(F.monotonically_increasing_id())
    found = found.select(lid.alias("lid"), "line", *_hash(), "n", "place")
    found = stage(found, "lines").df
    parts = _bounded(similar_lines(found.select("lid", "line"), threshold, **banding).withColumnRenamed("node", "lid"))
    joined = found.select("lid", "h1", "h2", "place").join(parts, "lid")
    keeps = _bounded(stage(joined.groupBy("root").agg(F.min("place").alias("keep")), "keeps").df)
    alone = found.where("n > 1").select("lid", "h1", "h2", F.col("place").alias("keep")).join(parts, "lid", "left_anti")
    rules = joined.join(keeps, "root").select("h1", "h2", "keep").unionByName(alone.select("h1", "h2", "keep"))
    rules = stage(rules, "rules").df
    seen = lines.select("doc_id", "th", "no", *_hash())
    gone = seen.join(_bounded(rules), ["h1", "h2"]).where(_place() != F.col("keep"))
    return stage(gone.groupBy("doc_id", "th").agg(F.collect_set("no").alias("gone")), "gone").df


@pandas_udf(StringType())
def _without(texts: pd.Series, gone: pd.Series) -> pd.Series:
    """Texts without the lines of these numbers, in one pass over a text; null where no number is given."""
    out = []
    for text, numbers in zip(texts, gone):
        if text is None or numbers is None:
            out.append(None)
            continue
        lines = text.split("\n")
        stay = np.ones(len(lines), bool)
        stay[numbers] = False
        out.append("\n".join([lines[k] for k in np.flatnonzero(stay)]))
    return pd.Series(out, dtype="object")


def deduplicate_lines(docs: DataFrame, threshold: float = THRESHOLD, n_lines: str = "__cl_lines", n_gone: str = "__cl_gone", **banding) -> DataFrame:
    """The rows of docs, all columns, with the lines that stay as text; adds their numbers of lines and of lost lines.

    banding: bands and rows of the signatures. At a similarity of s a pair misses every band with probability
    (1 - s^rows)^bands; more rows mean fewer chance candidates, for tables of over about a billion lines.
    """
    gone = line_decisions(docs, threshold, **banding)
    few, numbers = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    own, th, no, hash_ = free_names(docs, "__cl_id", "__cl_th", "__cl_no", "__cl_hash")
    gone = gone.select(F.col("doc_id").alias(own), F.col("th").alias(th), F.col("gone").alias(no))
    if few <= NARROW_ROWS and numbers <= 8 * NARROW_ROWS:
        gone = F.broadcast(gone)
    out = docs.withColumn(hash_, F.xxhash64("text"))
    out = out.join(gone, (out[hash_] == gone[th]) & out["doc_id"].eqNullSafe(gone[own]), "left")
    loses = F.col(no).isNotNull()
    size = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n"))).cast("long")
    out = out.withColumn(n_lines, size).withColumn(n_gone, F.when(loses, F.size(no)).otherwise(F.lit(0)).cast("long"))
    text = F.when(loses, _without(F.when(loses, F.col("text")), F.col(no))).otherwise(F.col("text"))
    return out.withColumn("text", text).drop(own, th, no, hash_)


def rewritten_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows and columns of docs with the lines that stay; a column n_chars follows the text."""
    n_lines, n_gone = free_names(docs, "__cl_lines", "__cl_gone")
    out = deduplicate_lines(docs, threshold, n_lines, n_gone).drop(n_lines, n_gone)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate_lines(table(spark, sf_dir, "documents"), n_lines="n_lines", n_gone="n_removed")
    return out.select("doc_id", "n_lines", "n_removed", "text")
