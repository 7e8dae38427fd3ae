"""Ranked lexical search: every query item's best documents by summed term impacts, as a threshold-seeded join.

A first pass writes the forward index: per document its length and the counts of the queries' terms. Over it go
the statistics (documents, lengths, document frequencies), then per term the largest and the kth largest impact.
An item has at least k documents at the kth impact of any one of its terms, so the largest of these seeds its
threshold. Its terms in rising order of largest impact: as long as their sum stays under the threshold, no document
with only those can rank, so they lead to no candidates. The join of the other terms with the index generates
candidates; those whose sum so far plus what the left-out terms can add at most stays under the threshold go;
all others are rescored exactly over all terms. Tasks keep the k best of each item; thresholds rise with them, and
fewer terms lead to candidates as they do.

The items are the stated query set: they go out in blocks, one round of passes over the documents each. Impacts are
64-bit integers; no posting is shuffled, only sums by term and the k best of an item and task.

Defined cases: a null or empty text has no terms, is not counted and never ranks; an item without terms or
without a document has no rows; items with equal terms are searched once, and each of their rows gets its own
ranks; a null doc_id ranks after all others of the score; rows with one doc_id rank one by one; very long texts are
read in portions, with equal results; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import stage, table
from .decontamination import expand
from .terms import portions, query_blocks, terms

TOP = 50
#: Text of the items in a block, and of documents whose terms are counted at once.
BLOCK_BYTES = 8 << 20
PORTION = 8 << 20
#: Postings or (document, item) pairs that a task holds at once, about.
CHUNK = 1 << 18


class Items:
    """A block of items: numbers of their terms, and the distinct terms of every distinct item."""

    def __init__(self, rows: list[tuple[int | None, bytes]]):
        self.vocabulary: dict[bytes, int] = {}
        kinds: dict[tuple, int] = {}
        self.rows: list[tuple[int, int | None]] = []  # (kind, item_id)
        for item, text in rows:
            own = {self.vocabulary.setdefault(t, len(self.vocabulary)) for t in terms(text)}
            if own:
                self.rows.append((kinds.setdefault(tuple(sorted(own)), len(kinds)), item))
        self.terms = [np.array(t, np.int64) for t in kinds]


# -- forward index -------------------------------------------------------------------------------------

_INDEX = "doc_id long, n long, terms binary, counts binary"


def _index(items: Items) -> Callable:
    size = len(items.vocabulary)

    def count(parts: list[tuple[int, list[bytes]]], rows: int) -> tuple[np.ndarray, list[bytes], list[bytes]]:
        """Lengths, terms and counts of `rows` texts from (text number, some of its terms), in order."""
        get, n, keys = items.vocabulary.get, np.zeros(rows, np.int64), []
        for k, words in parts:
            ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
            n[k] += len(words)
            keys.append(ids[ids >= 0] + k * size)
        key, times = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_counts=True)
        cuts = np.searchsorted(key, np.arange(rows + 1) * size)
        who, times = (key % max(size, 1)).astype(np.uint32), times.astype(np.int64)
        return n, [who[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], [times[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]

    def pack(docs: list, n: np.ndarray, who: list[bytes], times: list[bytes]) -> pa.RecordBatch:
        some = pa.array(n > 0)
        cols = [pa.array(docs, pa.int64()), pa.array(n), pa.array(who, pa.binary()), pa.array(times, pa.binary())]
        return pa.RecordBatch.from_arrays([c.filter(some) for c in cols], ["doc_id", "n", "terms", "counts"])

    def long(text: bytes) -> tuple[np.ndarray, list[bytes], list[bytes]]:
        n, total = 0, np.zeros(size, np.int64)
        for words in portions(text, PORTION):
            own, who, times = count([(0, words)], 1)
            n += own[0]
            total[np.frombuffer(who[0], np.uint32)] += np.frombuffer(times[0], np.int64)
        there = np.flatnonzero(total)
        return np.array([n]), [there.astype(np.uint32).tobytes()], [total[there].tobytes()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, held, room = [], [], PORTION
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary())):
                text = text.as_py() or b""
                if len(text) > PORTION:
                    yield pack([doc], *long(text))
                    continue
                held.append((len(docs), terms(text)))
                docs.append(doc)
                room -= len(text)
                if room < 0:
                    yield pack(docs, *count(held, len(docs)))
                    docs, held, room = [], [], PORTION
            yield pack(docs, *count(held, len(docs)))

    return run


def _postings(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """(doc_ids, which are null, lengths, row of each posting, term, count) of portions of a batch."""
    sizes = np.array([len(x) // 4 for x in b.column("terms").to_pylist()], np.int64)
    part = np.cumsum(sizes) // CHUNK
    for k in np.unique(part):
        at = np.flatnonzero(part == k)
        p = b.slice(int(at[0]), len(at))
        doc = p.column("doc_id")
        who = np.frombuffer(b"".join(p.column("terms").to_pylist()), np.uint32).astype(np.int64)
        times = np.frombuffer(b"".join(p.column("counts").to_pylist()), np.int64)
        none = doc.is_null().to_numpy(zero_copy_only=False)
        yield doc.fill_null(0).to_numpy(), none, p.column("n").to_numpy(), np.repeat(np.arange(len(at)), sizes[at]), who, times


def _sums(size: int) -> Callable:
    """Document frequency of each term; under -1 the number of documents, under -2 that of their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2, np.int64)
        for b in batches:
            for _, _, n, _, who, _ in _postings(b):
                total[:size] += np.bincount(who, minlength=size)
                total[size:] += len(n), n.sum()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(at < size, at, size - 1 - at)), pa.array(total[at])], ["term", "df"])

    return run


def strengths(times: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """What a term's weight is multiplied by: from its count in a document, that one's length and the corpus."""
    m = 50 + (50 * n * docs) // length
    return (1_000_000_000 * times) // (1000 * times + 20 * m)


def _best(who: np.ndarray, value: np.ndarray, times: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of (term, value, times it occurs) the largest values of each term, until k of them are counted."""
    order = np.lexsort((-value, who))
    who, value, times = who[order], value[order], times[order]
    new = np.append(True, (who[1:] != who[:-1]) | (value[1:] != value[:-1])) if len(who) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    who, value, times = who[at], value[at], np.add.reduceat(times, at) if len(at) else times
    before = np.cumsum(times) - times
    first = np.searchsorted(who, who)
    keep = before - before[first] < k if len(who) else np.zeros(0, bool)
    return who[keep], value[keep], times[keep]


def _impacts(docs: int, length: int, k: int) -> Callable:
    """(term, strength, times): each term's k largest strengths of the task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[np.zeros(0, np.int64)] for _ in range(3)]
        for b in batches:
            for _, _, n, row, who, times in _postings(b):
                for h, x in zip(held, (who, strengths(times, n[row], docs, length), np.ones(len(who), np.int64))):
                    h.append(x)
                if sum(map(len, held[0][1:])) >= CHUNK + len(held[0][0]):
                    held = [[x] for x in _best(*map(np.concatenate, held), k)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _best(*map(np.concatenate, held), k)], ["term", "value", "times"])

    return run


# -- search --------------------------------------------------------------------------------------------


class Plan:
    """Thresholds and bounds of a block's items, from the terms' weights and stored impacts."""

    def __init__(self, items: Items, weight: np.ndarray, largest: np.ndarray, kth: np.ndarray):
        self.weight, self.items = weight, len(items.terms)
        upper, seed = weight * largest, weight * kth
        self.threshold = np.array([max(1, int(seed[t].max())) for t in items.terms], np.int64)
        self.of = np.cumsum([0, *map(len, items.terms)])
        every = np.concatenate([np.zeros(0, np.int64), *items.terms])
        self.item = np.repeat(np.arange(self.items), np.diff(self.of))
        self.every = every[np.lexsort((every, upper[every], self.item))]  # each item's terms in rising order of what they can add
        total = np.cumsum(upper[self.every])
        self.sums = total - (total[self.of[:-1]] - upper[self.every][self.of[:-1]])[self.item] if len(every) else total
        self.by_term = np.argsort(self.every, kind="stable")

    def lead(self, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, items, rest): the items that each term leads to, and what an item's other terms can add at most.

        The first terms of an item, as long as their sum stays under its threshold, lead nowhere.
        """
        idle = self.sums < threshold[self.item]
        rest = np.zeros(self.items, np.int64)
        np.maximum.at(rest, self.item[idle], self.sums[idle])
        leading = self.by_term[~idle[self.by_term]]
        return np.searchsorted(self.every[leading], np.arange(len(self.weight) + 1)), self.item[leading], rest


def candidates(plan: Plan, threshold: np.ndarray, row: np.ndarray, who: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, item) pairs that may reach the item's threshold."""
    first, led, rest = plan.lead(threshold)
    lo, hi = first[who], first[who + 1]
    pairs = hi - lo
    rows, items = [], []
    cuts = np.searchsorted(row, np.arange(0, row[-1] + 2)) if len(row) else np.zeros(1, np.int64)  # postings of each row
    ends = np.cumsum(np.append(0, pairs))[cuts]
    part = (ends[1:] - 1) // CHUNK if len(ends) > 1 else np.zeros(0, np.int64)
    for k in np.unique(part):
        rs = np.flatnonzero(part == k)
        a, b = cuts[rs[0]], cuts[rs[-1] + 1]
        key = np.repeat(row[a:b], pairs[a:b]) * plan.items + led[expand(lo[a:b], hi[a:b])]
        order = np.argsort(key, kind="stable")
        key, add = key[order], np.repeat(impact[a:b], pairs[a:b])[order]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        if not len(at):
            continue
        r, i, s = key[at] // plan.items, key[at] % plan.items, np.add.reduceat(add, at)
        may = s + rest[i] >= threshold[i]
        rows.append(r[may])
        items.append(i[may])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *items])


def rescored(plan: Plan, rows: np.ndarray, items: np.ndarray, row: np.ndarray, who: np.ndarray, impact: np.ndarray) -> np.ndarray:
    """Exact scores of (row, item) pairs over all terms of the item. The postings are in the order of (row, term)."""
    out = np.zeros(len(rows), np.int64)
    size = len(plan.weight)
    known = row * size + who
    for a in range(0, len(rows), 1 << 14):
        r, i = rows[a : a + (1 << 14)], items[a : a + (1 << 14)]
        n = plan.of[i + 1] - plan.of[i]
        key = np.repeat(r, n) * size + plan.every[expand(plan.of[i], plan.of[i + 1])]
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        out[a : a + (1 << 14)] = np.add.reduceat(np.where(known[at] == key, impact[at], 0), np.cumsum(n) - n)
    return out


def _search(plan: Plan, docs: int, length: int, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        threshold = plan.threshold.copy()
        held = [np.zeros(0, np.int64)] * 4  # item, score, null doc_id, doc_id
        for b in batches:
            for doc, none, n, row, who, times in _postings(b):
                impact = plan.weight[who] * strengths(times, n[row], docs, length)
                rows, items = candidates(plan, threshold, row, who, impact)
                if not len(rows):
                    continue
                score = rescored(plan, rows, items, row, who, impact)
                may = score >= threshold[items]
                new = (items[may], score[may], none[rows[may]].astype(np.int64), doc[rows[may]])
                held = [np.concatenate([h, x]) for h, x in zip(held, new)]
                order = np.lexsort((held[3], held[2], -held[1], held[0]))
                held = [h[order] for h in held]
                rank = np.arange(len(order)) - np.searchsorted(held[0], held[0])
                last = rank == k - 1
                threshold[held[0][last]] = np.maximum(threshold[held[0][last]], held[1][last])
                held = [h[rank < k] for h in held]
        item, score, none, doc = held
        cols = [pa.array(item), pa.array(score), pa.array(doc, mask=none > 0)]
        yield pa.RecordBatch.from_arrays(cols, ["kind", "score", "doc_id"])

    return run


def weights(df: np.ndarray, docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def rank(docs: DataFrame, items: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of each item's k highest-scoring documents."""
    spark, out = docs.sparkSession, None
    texts = docs.select("doc_id", "text")
    for rows in query_blocks(items, block_bytes):
        block = Items(rows)
        size = len(block.vocabulary)
        index = stage(texts.mapInArrow(_index(block), _INDEX), "index")
        sums = dict(index.df.mapInArrow(_sums(size), "term long, df long").groupBy("term").agg(F.sum("df")).collect())
        count, length = sums.pop(-1, 0), sums.pop(-2, 0)
        if not sums:
            index.drop()
            continue
        df = np.zeros(size, np.int64)
        df[list(sums)] = list(sums.values())
        found = index.df.mapInArrow(_impacts(count, length, k), "term long, value long, times long")
        found = found.groupBy("term", "value").agg(F.sum("times").alias("times"))
        falling = W.partitionBy("term").orderBy(F.desc("value")).rowsBetween(W.unboundedPreceding, 0)
        found = found.withColumn("upto", F.sum("times").over(falling)).groupBy("term")
        found = found.agg(F.max("value"), F.coalesce(F.max(F.when(F.col("upto") >= k, F.col("value"))), F.lit(0))).collect()
        largest, kth = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for t, high, low in found:
            largest[t], kth[t] = high, low
        plan = Plan(block, weights(df, count), largest, kth)
        best = index.df.mapInArrow(_search(plan, count, length, k), "kind long, score long, doc_id long")
        order = [F.desc("score"), F.col("doc_id").isNull(), "doc_id"]
        for keys in (["kind", "task"], ["kind"]):  # the k best of some tasks, then of all
            ranked = best.withColumn("task", F.pmod(F.spark_partition_id(), F.lit(64))) if "task" in keys else best
            best = ranked.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
        best = stage(best.select("kind", "rank", "doc_id", "score"), "ranked").df
        index.drop()
        named = F.broadcast(spark.createDataFrame(block.rows, "kind long, item_id long"))  # rows of one block
        best = best.join(named, "kind").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = best if out is None else out.unionByName(best)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
c AS (SELECT count(*) AS n_docs, sum(len(ws))::BIGINT AS n_all FROM d WHERE len(ws) > 0),
m AS (SELECT r, doc_id, 50 + (50 * len(ws)::BIGINT * n_docs) // n_all AS m FROM d, c WHERE len(ws) > 0),
p AS (
  SELECT r, term, count(*) AS tf
  FROM (SELECT r, translate(unnest(ws), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d) GROUP BY r, term),
q AS (
  SELECT DISTINCT item_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term, n_docs),
s AS (
  SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY item_id, r)
SELECT item_id, rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s JOIN m USING (r) WHERE score > 0)
WHERE rank <= 50
"""
