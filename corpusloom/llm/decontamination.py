"""Benchmark decontamination: suffix arrays over shards of the corpus, searched for every suffix of the tests.

Texts become sequences of term numbers (0: a term that no test holds, or a text's end). A task makes a suffix
array of each shard of some MB of text: positions ordered by the terms that follow, several to a 64-bit key, ties by
the next keys until a 0 or `depth` is met. Positions that no test can match over `least` terms (a 0 comes sooner)
are left out. Every test suffix is placed by binary search, and its neighbours in the array give its longest
verbatim match in the shard. Where that reaches the item's window, a second search gives the range of places
that share the window.

The tests are the stated query set: they go out in blocks of BLOCK_BYTES of text, one pass over the corpus each, and
what a pass finds (spans and items of a document) joins what former passes found. No row of the corpus is
shuffled, except one row a test suffix and task in `longest_matches`.

Defined cases: a null or empty text has no terms and is never contaminated; a test without terms has no window;
tests with equal terms are searched once; an item_id that comes twice is one item; a null item_id's windows
hit like others, but it is neither counted nor listed; texts over PORTION bytes are read in portions that overlap
by a window, with equal results; repeated rows are judged one by one; empty tables give an empty result, or one
without hits; other columns are ignored or, in `decontaminate`, kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table
from .terms import portions, query_blocks, terms

WINDOW = 10
#: Text of the tests that a task holds at once, and text of the corpus in a shard.
BLOCK_BYTES = 16 << 20
PORTION = 16 << 20


# -- suffix arrays -------------------------------------------------------------------------------------


class Sequence:
    """Term numbers with `run` (terms up to the next 0) and `packed` (the next `per` terms as one key, zeros after a 0)."""

    def __init__(self, ids: np.ndarray, bits: int):
        self.bits, self.per, n = bits, 64 // bits, len(ids)
        ends = np.where(ids == 0, np.arange(n), n)
        self.run = np.minimum.accumulate(ends[::-1])[::-1] - np.arange(n) if n else np.zeros(0, np.int64)
        self.packed = ids.astype(np.uint64)
        for j in range(1, self.per):
            nxt = np.zeros(n, np.uint64)
            nxt[: max(0, n - j)] = ids[j:]
            self.packed = self.packed << np.uint64(bits) | np.where(self.run > j, nxt, np.uint64(0))

    def keys(self, at: np.ndarray, offset: int) -> np.ndarray:
        """The packed terms that stand `offset` after the positions; 0 where the run has ended."""
        there = self.run[at] > offset
        return np.where(there, self.packed[np.where(there, at + offset, 0)], np.uint64(0)) if len(self.packed) else np.zeros(0, np.uint64)


def bit_length(x: np.ndarray) -> np.ndarray:
    """Of unsigned 64-bit numbers."""
    high, low = (np.frexp(half.astype(np.float64))[1] for half in (x >> np.uint64(32), x & np.uint64(0xFFFFFFFF)))
    return np.where(high > 0, high + 32, low)


def suffix_array(seq: Sequence, at: np.ndarray, depth: int) -> np.ndarray:
    """The positions `at` in the order of what follows them, up to `depth` terms."""
    keys = seq.keys(at, 0)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    group = np.cumsum(np.append(False, keys[1:] != keys[:-1])) if len(at) else np.zeros(0, np.int64)
    offset, tied = seq.per, np.arange(len(at))
    while offset < depth and len(tied):
        g = group[tied]
        same = np.append(g[1:] == g[:-1], False) | np.append(False, g[1:] == g[:-1])
        tied = tied[same]
        if not len(tied):
            break
        g, own = group[tied], order[tied]
        keys = seq.keys(at[own], offset)
        sort = np.lexsort((keys, g))
        order[tied], keys = own[sort], keys[sort]
        new = np.append(False, (g[1:] != g[:-1]) | (keys[1:] != keys[:-1]))
        first = np.maximum.accumulate(np.where(new | (np.arange(len(g)) == 0), tied, 0))
        group[tied] = first  # a group is named by its first place; names rise with the order
        tied = tied[keys > 0]  # what has ended is equal for good
        offset += seq.per
    return at[order]


def compare(seq: Sequence, at: np.ndarray, tests: Sequence, q: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sign, shared terms) of the terms at `at` against the first `width` at `q`: only so many count."""
    sign, shared = np.zeros(len(at), np.int8), np.zeros(len(at), np.int64)
    live, offset, bits, per = np.arange(len(at)), 0, seq.bits, seq.per
    while len(live):
        left = width[live] - offset
        cut = (bits * np.clip(per - left, 0, per)).astype(np.uint64)
        cut, none = np.minimum(cut, np.uint64(63)), left <= 0
        x = np.where(none, np.uint64(0), seq.keys(at[live], offset) >> cut << cut)
        y = np.where(none, np.uint64(0), tests.keys(q[live], offset) >> cut << cut)
        sign[live] = (x > y).astype(np.int8) - (x < y)
        same = x == y
        # whole keys agree, or the terms above the highest differing bit do
        here = np.where(same, per, (per * bits - bit_length(x ^ y)) // bits)
        shared[live] += np.minimum(here, np.maximum(left, 0))
        live = live[same & (left > per)]
        offset += per
    return sign, np.minimum(shared, np.minimum(seq.run[at], width)) if len(at) else shared


def place(seq: Sequence, array: np.ndarray, tests: Sequence, q: np.ndarray, width: np.ndarray, after: bool = False) -> np.ndarray:
    """By binary search the first place in the array that is not before (after: that is behind) the test's terms."""
    lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(array), np.int64)
    live = np.arange(len(q)) if len(array) else np.zeros(0, np.int64)
    while len(live):
        mid = (lo[live] + hi[live]) >> 1
        sign, _ = compare(seq, array[mid], tests, q[live], width[live])
        right = sign <= 0 if after else sign < 0
        lo[live[right]] = mid[right] + 1
        hi[live[~right]] = mid[~right]
        live = live[lo[live] < hi[live]]
    return lo


# -- tests ---------------------------------------------------------------------------------------------


class Tests:
    """A block of tests: numbers of their terms, suffixes, windows, and the items of each distinct text."""

    def __init__(self, rows: list[tuple[int | None, bytes]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        names: dict[tuple, set] = {}
        for item, text in rows:
            own = tuple(self.vocabulary.setdefault(t, len(self.vocabulary) + 1) for t in terms(text))
            if own:
                names.setdefault(own, set()).add(item)
        self.items = [sorted(x - {None}) for x in names.values()]
        sizes = np.array([len(t) for t in names], np.int64)
        ids = np.array([i for t in names for i in (*t, 0)], np.uint32)
        self.bits = max(1, len(self.vocabulary).bit_length())
        self.seq = Sequence(ids, self.bits)
        self.who = np.repeat(np.arange(len(sizes)), sizes + 1)
        self.starts = np.cumsum(sizes + 1) - (sizes + 1)
        self.suffixes = np.flatnonzero(ids)
        width = np.minimum(sizes, window)
        self.width = width[self.who]  # by position
        self.is_window = self.seq.run >= np.maximum(self.width, 1)
        self.least, self.longest = (int(width.min()), int(sizes.max())) if len(sizes) else (1, 0)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, 0) for w in words), np.uint32, len(words))


def probe(tests: Tests, ids: np.ndarray, least: int | None = None):
    """One shard: (sequence, suffix array, longest match of each test suffix, its place in the array)."""
    seq = Sequence(ids, tests.bits)
    array = suffix_array(seq, np.flatnonzero(seq.run >= max(1, least or tests.least)), tests.longest)
    q = tests.suffixes
    width = tests.seq.run[q]
    at = place(seq, array, tests.seq, q, width)
    longest = np.zeros(len(q), np.int64)
    if len(array):
        for there, near in ((at < len(array), np.minimum(at, len(array) - 1)), (at > 0, np.maximum(at - 1, 0))):
            _, shared = compare(seq, array[near], tests.seq, q, width)
            longest = np.maximum(longest, np.where(there, shared, 0))
    return seq, array, longest


def ranges(seq: Sequence, array: np.ndarray, tests: Tests, q: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return place(seq, array, tests.seq, q, width), place(seq, array, tests.seq, q, width, after=True)


def expand(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of the ranges lo..hi-1, one range after the other."""
    n = hi - lo
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Hits:
    """Windows of the tests that occur in a shard: terms they cover, (place, range) of occurrences, texts of each range."""

    def __init__(self, tests: Tests, ids: np.ndarray):
        self.covered, self.at, self.kind = np.zeros(len(ids), bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
        seq, array, longest = probe(tests, ids)
        q = tests.suffixes
        q = q[(longest >= tests.width[q]) & tests.is_window[q]]
        if not len(q):
            return
        lo, hi = ranges(seq, array, tests, q, tests.width[q])
        # equal windows, of one test or of several, have one range
        kinds, which = np.unique(np.column_stack([lo, hi, tests.width[q]]), axis=0, return_inverse=True)
        self.at = array[expand(kinds[:, 0], kinds[:, 1])]
        self.kind = np.repeat(np.arange(len(kinds)), kinds[:, 1] - kinds[:, 0])
        step = np.bincount(self.at, minlength=len(ids) + 1) - np.bincount(self.at + kinds[self.kind, 2], minlength=len(ids) + 1)
        self.covered = np.cumsum(step[:-1]) > 0
        texts = np.unique(np.column_stack([which.ravel(), tests.who[q]]), axis=0)
        split = np.searchsorted(texts[:, 0], np.arange(len(kinds) + 1))
        self.texts = [texts[a:b, 1] for a, b in zip(split, split[1:])]


# -- documents -----------------------------------------------------------------------------------------


def _spans(covered: np.ndarray, shift: int = 0) -> np.ndarray:
    """Pairs (first term, end) of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    return edges.astype(np.int64) + shift


def _merged(spans: np.ndarray) -> np.ndarray:
    pairs = spans.reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    ends = np.maximum.accumulate(pairs[:, 1])
    new = np.append(True, pairs[1:, 0] > ends[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(pairs) - 1)
    return np.column_stack([pairs[new, 0], ends[last]]).ravel()


class Judge:
    """Holds texts against one block of tests: number of terms, spans of hit terms, items."""

    def __init__(self, tests: Tests):
        self.tests, self.known = tests, {}

    def _items(self, texts: np.ndarray) -> np.ndarray:
        key = texts.tobytes()
        if key not in self.known:
            if len(self.known) > 10_000:
                self.known.clear()
            every = [i for t in texts.tolist() for i in self.tests.items[t]]
            self.known[key] = np.unique(np.array(every, np.int64))
        return self.known[key]

    def _shard(self, parts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(covered, items) of each of these sequences, which make one shard."""
        sizes = np.array([len(p) for p in parts], np.int64)
        first = np.cumsum(sizes + 1) - (sizes + 1)
        ids = np.zeros(int((sizes + 1).sum()), np.uint32)
        for a, p in zip(first, parts):
            ids[a : a + len(p)] = p
        found = Hits(self.tests, ids)
        own: dict[int, np.ndarray] = {}
        if len(found.at):
            pairs = np.unique(np.column_stack([np.searchsorted(first, found.at, "right") - 1, found.kind]), axis=0)
            cuts = np.flatnonzero(np.append(True, pairs[1:, 0] != pairs[:-1, 0]))
            for a, b in zip(cuts, np.append(cuts[1:], len(pairs))):
                every = [found.texts[k] for k in pairs[a:b, 1]]
                own[int(pairs[a, 0])] = self._items(np.unique(np.concatenate(every)))
        none = np.zeros(0, np.int64)
        for k, (a, m) in enumerate(zip(first, sizes)):
            yield found.covered[a : a + m], own.get(k, none)

    def judge(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of terms, spans, items) of each text."""
        held: list[np.ndarray] = []
        size = 0

        def settle():
            for n, (covered, items) in zip([len(h) for h in held], self._shard(held)):
                yield n, _spans(covered), items

        for t in texts:
            if len(t) > PORTION:
                yield from settle()
                held, size = [], 0
                yield self._long(t)
                continue
            held.append(self.tests.numbers(terms(t)))
            size += len(t)
            if size >= PORTION:
                yield from settle()
                held, size = [], 0
        if held:
            yield from settle()

    def _long(self, text: bytes) -> tuple[int, np.ndarray, np.ndarray]:
        n, spans, items = 0, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        carry = np.zeros(0, np.uint32)
        for words in portions(text, PORTION):
            ids = np.concatenate([carry, self.tests.numbers(words)])
            for covered, own in self._shard([ids]):
                spans.append(_spans(covered, n - len(carry)))
                items.append(own)
            n += len(words)
            carry = ids[len(ids) - min(len(ids), self.tests.window - 1) :]
        return n, _merged(np.concatenate(spans)) if sum(map(len, spans)) else spans[0], np.unique(np.concatenate(items))


def _binary(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _mark(tests: Tests, more: bool) -> Callable:
    """Batches of (doc_id, text, n_words, spans, items): this block's finds join the former ones; text stays if more blocks come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(tests)
        for b in batches:
            was, had = b.column("spans").to_pylist(), b.column("items").to_pylist()
            n, spans, items = [], [], []
            for k, (size, own, named) in enumerate(judge.judge(_binary(b.column("text")))):
                n.append(size)
                old = np.frombuffer(was[k] or b"", np.int64)
                spans.append((_merged(np.concatenate([old, own])) if len(old) and len(own) else own if len(own) else old).tobytes())
                items.append(sorted({*(had[k] or []), *named.tolist()}))
            text = b.column("text") if more else pa.nulls(len(b), pa.string())
            cols = [b.column("doc_id"), text, pa.array(n, pa.int64()), pa.array(spans, pa.binary()), pa.array(items, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text", "n_words", "spans", "items"])

    return run


def _blocks(tests: DataFrame, window: int, block_bytes: int) -> Iterator[tuple[Tests, bool]]:
    """(block, whether more come). A block travels with the function that uses it, which Spark broadcasts."""
    blocks = query_blocks(tests, block_bytes)
    now = next(blocks, [])
    while True:
        nxt = next(blocks, None)
        yield Tests(now, window), nxt is not None
        if nxt is None:
            return
        now = nxt


def marked(docs: DataFrame, tests: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, spans (pairs of 64-bit term numbers: first, end), items (sorted ids)."""
    schema = "doc_id long, text string, n_words long, spans binary, items array<long>"
    rows = docs.select("doc_id", "text", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("binary").alias("spans"), F.lit(None).cast("array<long>").alias("items"))
    for block, more in _blocks(tests, window, block_bytes):
        rows = rows.mapInArrow(_mark(block, more), schema)
        if more:
            rows = stage(rows, "marked").df
    return rows.drop("text")


def contamination(docs: DataFrame, tests: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [int(np.frombuffer(x or b"", np.int64).reshape(-1, 2).dot([-1, 1]).sum()) for x in b.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(n, pa.int64()), b.column("items")], ["doc_id", "n_words", "n_hit", "items"])

    rows = marked(docs, tests, window, block_bytes).mapInArrow(count, "doc_id long, n_words long, n_hit long, items array<long>")
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items")


def decontaminate(docs: DataFrame, tests: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, without a verbatim window of the tests."""
    at = docs.columns.index("text")

    def clean(block: Tests) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            judge = Judge(block)
            for b in batches:
                yield b.filter(pa.array([not len(spans) for _, spans, _ in judge.judge(_binary(b.column(at)))], pa.bool_()))

        return run

    for block, more in _blocks(tests, window, block_bytes):
        docs = docs.mapInArrow(clean(block), docs.schema)
        if more:
            docs = stage(docs, "clean").df
    return docs


def longest_matches(docs: DataFrame, tests: DataFrame, least: int = 1, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per test suffix that matches `least` terms or more: item_id, word, n_words (longest verbatim match), doc_id, at.

    word and at count terms from 0; of places with the longest match the smallest (doc_id, at) is given, null doc_ids
    last. Tests with equal terms are named by their smallest item_id.
    """
    schema = "test long, item_id long, word long, n_words long, doc_id long, at long"
    none = 1 << 62

    def search(tests: Tests) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = tests.suffixes
            best = np.zeros((len(q), 3), np.int64)  # length, doc_id, place
            for b in batches:
                docs_ = [none if d is None else d for d in b.column("doc_id").to_pylist()]
                held: list[tuple] = []  # (doc_id, first term, numbers)

                def settle() -> None:
                    sizes = np.array([len(x) + 1 for _, _, x in held], np.int64)
                    first = np.cumsum(sizes) - sizes
                    ids = np.zeros(int(sizes.sum()), np.uint32)
                    for a, (_, _, x) in zip(first, held):
                        ids[a : a + len(x)] = x
                    seq, array, longest = probe(tests, ids, least)
                    at = np.flatnonzero((longest >= np.maximum(least, best[:, 0])) & (longest > 0))
                    if not len(at):
                        return
                    lo, hi = ranges(seq, array, tests, q[at], longest[at])
                    own = np.searchsorted(first, array, "right") - 1
                    name, shift = np.array([d for d, _, _ in held], np.int64), np.array([s for _, s, _ in held], np.int64)
                    where = np.column_stack([name[own], array - first[own] + shift[own]])
                    rank = np.empty(len(array), np.int64)
                    sort = np.lexsort((where[:, 1], where[:, 0]))
                    rank[sort] = np.arange(len(array))
                    low = np.minimum.reduceat(np.append(rank, len(array)), np.ravel(np.column_stack([lo, hi])))[::2]
                    new = np.column_stack([longest[at], where[sort[low]]])
                    old = best[at]
                    win = (new[:, 0] > old[:, 0]) | (new[:, 0] == old[:, 0]) & ((new[:, 1] < old[:, 1]) | (new[:, 1] == old[:, 1]) & (new[:, 2] < old[:, 2]))
                    best[at[win]] = new[win]

                size = 0
                for d, t in zip(docs_, _binary(b.column("text"))):
                    words, overlap = terms(t), tests.longest - 1
                    step = max(PORTION // 8, overlap)
                    for a in range(0, max(1, len(words)), step):
                        part = words[a : a + step + overlap]
                        held.append((d, a, tests.numbers(part)))
                        size += len(part) * 6
                        if size >= PORTION:
                            settle()
                            held, size = [], 0
                if held:
                    settle()
            at = np.flatnonzero(best[:, 0])
            who = tests.who[q[at]]
            names = [tests.items[w][0] if tests.items[w] else None for w in who]
            doc = pa.array(best[at, 1], mask=best[at, 1] == none)
            cols = [pa.array(who), pa.array(names, pa.int64()), pa.array(q[at] - tests.starts[who]), pa.array(best[at, 0]), doc, pa.array(best[at, 2])]
            yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in schema.split(", ")])

        return run

    out = None
    for block, more in _blocks(tests, WINDOW, block_bytes):
        found = docs.select("doc_id", "text").mapInArrow(search(block), schema)
        order = F.struct(-F.col("n_words"), F.col("doc_id").isNull(), "doc_id", "at")
        found = found.groupBy("test", "item_id", "word").agg(F.min_by(F.struct("n_words", "doc_id", "at"), order).alias("best"))
        found = found.select("item_id", "word", "best.*")
        found = stage(found, "longest").df if more else found
        out = found if out is None else out.unionByName(found)
    return out


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


OP12_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS w, array_to_string(ws[p : p + least(len(ws), 10) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS p FROM i WHERE len(ws) > 0)),
dw AS (
  SELECT r, w, p, array_to_string(ws[p : p + w - 1], ' ') AS win
  FROM (SELECT r, ws, w, unnest(range(1, len(ws) - w + 2)) AS p FROM d, (SELECT DISTINCT w FROM iw) WHERE len(ws) >= w)),
hit AS (SELECT r, p, dw.w, item_id FROM dw JOIN iw ON dw.w = iw.w AND dw.win = iw.win),
words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(p, p + w)) AS k FROM hit) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names
  FROM (SELECT DISTINCT r, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN named USING (r)
"""
