"""From raw records to train and validation: normalise, decontaminate, deduplicate, split, report."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from ..scratch import stage


def normalize_records(raw: DataFrame, boxed=X.last_boxed) -> DataFrame:
    """id, question, gold_answer, gold_solution and, where a record cannot be used, a reason.

    The gold answer is the explicit one, else the solution's last box, else what follows its last ####,
    else a solution of at most 80 characters. A solution whose last box differs gets a closing sentence.
    """
    c = {n: F.col(n) if n in raw.columns else F.lit(None).cast("string") for n in ("id", "question", "problem", "prompt", "gold_solution", "solution", "response", "answer", "gold_answer", "final_answer", "target")}
    rows = raw.select(
        c["id"].cast("string").alias("id"),
        X.clean_solution(X.first_nonblank(c["question"], c["problem"], c["prompt"])).alias("question"),
        X.clean_solution(X.first_nonblank(c["gold_solution"], c["solution"], c["response"], c["answer"])).alias("solution"),
        X.first_nonblank(c["gold_answer"], c["final_answer"], c["target"]).alias("explicit"),
    ).withColumn("box", boxed(F.col("solution")))
    tail = F.when(F.contains("solution", F.lit("####")), X.trim_u(F.element_at(F.split("solution", "####"), -1)))
    short = F.when(F.char_length("solution") <= 80, X.trim_u(F.col("solution")))
    gold = F.coalesce(*[F.nullif(x, F.lit("")) for x in (F.col("explicit"), F.col("box"), tail, short)])
    rows = rows.withColumn("gold_answer", F.nullif(X.clean_gold_answer(gold), F.lit("")))
    usable = (F.coalesce("question", F.lit("")) != "") & F.col("solution").isNotNull() & F.col("gold_answer").isNotNull()
    closing = F.concat("solution", F.lit("\nTherefore, the final answer is \\boxed{"), "gold_answer", F.lit("}."))
    full = F.when(F.col("box").eqNullSafe(F.col("gold_answer")), F.col("solution")).otherwise(closing)
    reason = F.when(~usable, F.lit("missing_question_solution_or_answer"))
    return rows.select("id", "question", "gold_answer", full.alias("gold_solution"), reason.alias("reason"))


def exact_contamination(records: DataFrame, heldout: DataFrame, key: str = "norm") -> DataFrame:
    """records plus heldout_sources: all sources (sorted) whose normalised text equals the record's, else null.

    The held-out side is aggregated to one row a text first. Spark's threshold decides on a broadcast.
    """
    sides = heldout.groupBy(key).agg(F.array_sort(F.collect_set("source")).alias("heldout_sources"))
    return records.join(sides, key, "left")


def first_of_duplicates(records: DataFrame, by: str = "norm", order: Column | None = None) -> DataFrame:
    """records plus duplicate_of: null for the first of equal texts by string id, else that one's id.

    min with map-side combine and a join instead of a window, so that a hot text is not sorted in one task.
    """
    name = order if order is not None else F.col("id").cast("string")
    first = records.groupBy(by).agg(F.min(name).alias("first_id"))
    return records.join(first, by).withColumn("duplicate_of", F.when(name != F.col("first_id"), F.col("first_id"))).drop("first_id")


#: Rows of a block of sizes whose square root (of their multiple) says how many parts it is dealt to; a cell is two parts.
#: Between two tables, the rows of a part.
CELL = 2048
#: Pairs that are checked together; characters of texts taken, and bytes of grams kept, at once.
CHECKED, PORTION, KEPT = 200_000, 1 << 21, 128 << 20
#: A group of grams is cut into SUBS subsets, of which up to RADIUS may differ between two texts. Bytes of a sheet, groups of a sheet at most.
RADIUS, SUBS, SHEET, GROUPS = 2, 5, 256 << 20, 32
#: Within one table: all pairs are held against each other where rows times words of a bitmap are no more than FEW, or texts have over LONG grams
#: (then grams are common to most texts and their groups say little); a cell makes up to MET comparisons of words.
FEW, LONG, MET = 1 << 17, 7000, 1 << 31
#: Pairs of a sheet that are held at once; grams of the pairs that are checked together.
FOUND, CHECKED_GRAMS = 1 << 22, 32 << 20


def sorted_distinct(x: np.ndarray) -> np.ndarray:
    """numpy's unique hashes first, at several times the cost."""
    x = np.sort(x)
    return x[np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]])]


def grams_of(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct substrings of `size` characters; of the whole text if it is no longer."""
    c = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    wide = size if len(c) > size else max(1, len(c))
    h = np.full(max(1, len(c) - wide + 1), wide, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(wide, len(c))):
            h = (h ^ c[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return sorted_distinct(h.view(np.int64))


def parity_bits(grams: np.ndarray) -> np.ndarray:
    """A bitmap of 2^k >= n bits, each the parity of the grams that fall to it; XOR of its halves is the bitmap of half the size."""
    bits = np.uint64(max(64, 1 << (len(grams) - 1).bit_length()))
    at = np.bincount((grams.view(np.uint64) & (bits - np.uint64(1))).astype(np.int64), minlength=int(bits))
    return np.packbits(at.astype(np.uint8) & 1, bitorder="little")


def text_portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of up to PORTION bytes of text, one row at least."""
    for b in batches:
        lengths, at = [0 if x is None else x for x in pc.binary_length(b.column("text")).to_pylist()], 0
        while at < len(lengths):
            end, total = at + 1, lengths[at]
            while end < len(lengths) and total + lengths[end] <= PORTION:
                total, end = total + lengths[end], end + 1
            yield b.slice(at, end - at)
            at = end


def gram_counts(rows: DataFrame, id_col: str, text_col: str, size: int = 5) -> DataFrame:
    """(id, n): the number of each text's grams. Neither texts nor anything made of their grams leave the task."""

    def run(batches):
        for part in text_portions(batches):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(grams_of(t.as_py(), size)) for t in part.column("text")], pa.int32())], ["id", "n"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n int")


def gram_sets(rows: DataFrame, id_col: str, text_col: str, size: int = 5) -> DataFrame:
    """Staged (id, text, n, bits): the number of a text's grams and their parities. The grams, many times the text, are made anew where needed."""

    def run(batches):
        for part in text_portions(batches):
            n, bits = [], []
            for t in part.column("text"):
                g = grams_of(t.as_py(), size)
                n.append(len(g))
                bits.append(parity_bits(g).tobytes())
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text"), pa.array(n, pa.int32()), pa.array(bits, pa.binary())], ["id", "text", "n", "bits"])

    kind = rows.schema[id_col].dataType.simpleString()
    return stage(rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, text string, n int, bits binary"), "grams").df


def block_parts(counts: dict[tuple[int, int], int], own: bool) -> list[tuple[int, int, bool, int, int]]:
    """(block, range, is guest, left parts, right parts) from the rows of each (range, side)."""
    out = []
    for b in sorted({r for r, _ in counts}):
        n = [counts.get((b, s), 0) + counts.get((b - 1, s), 0) for s in (0, 1)]
        lefts, rights = (max(1, math.ceil(math.sqrt(n[0] / CELL))),) * 2 if own else (math.ceil(x / CELL) for x in n)
        if lefts and rights:
            out += [(b, b - g, g == 1, lefts, rights) for g in (0, 1) if any((b - g, s) in counts for s in (0, 1))]
    return out


def own_blocks(sizes: dict[int, tuple[int, int, int]], threshold: float) -> dict[int, tuple[int, int, int, int]]:
    """Of each block (parts, groups in all, groups of a sheet, words of a bitmap) from the rows, least and largest size of each range. No groups: all pairs.

    Sets of up to `top` grams at the threshold differ in up to d grams, so that of more than d / (RADIUS + 1) groups one has up to RADIUS of them.
    """
    out = {}
    for b, (count, least, top) in sizes.items():
        more, low, _ = sizes.get(b - 1, (0, least, 0))
        n, d = count + more, math.floor(2 * top * (1 - threshold) / (1 + threshold) + 1e-6)
        words = max(1, (1 << max(0, low - 1).bit_length()) // 64)
        groups = 0 if top > LONG or 9 * top < 40 * d else d // (RADIUS + 1) + 1
        fold = lambda words, share: words if words == 1 or words * 32 < share * top else fold(words // 2, share)  # noqa: E731, B023
        if not groups or n * fold(words, 0.5) <= FEW:
            words = fold(words, 0.5)
            out[b] = max(1, math.ceil(n / math.sqrt(MET / words)), math.ceil(4 * n * 8 * words / SHEET)), 0, 0, words
        else:
            words = fold(words, 0.4)
            parts = 1 if 16 * n * words <= SHEET else math.ceil(4 * n * 8 * words / SHEET)
            rows = n if parts == 1 else math.ceil(2 * n / parts)
            out[b] = parts, groups, max(1, min(groups, GROUPS, SHEET // 2 // (rows * 2 * SUBS))), words
    return out


def group_keys(grams: np.ndarray, groups: int) -> np.ndarray:
    """16 bits for each of SUBS subsets of each group; grams fall to subsets by their hashes, and equal subsets have equal bits."""
    m = groups * SUBS
    at = ((grams.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(grams.view(np.uint64), dtype=np.uint64)])
    ends = np.searchsorted(at, np.arange(m + 1, dtype=np.uint64))
    return ((sums[ends[1:]] - sums[ends[:-1]]) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.uint16)


def alike(keys: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs of rows (smaller * rows + larger) that differ in up to RADIUS subsets of a group, once a group unless they are many; keys: rows, groups, SUBS."""
    rows = len(keys)
    bits = max(1, (rows - 1).bit_length())
    low, mask, row = np.uint64(bits), np.uint64((1 << bits) - 1), np.arange(rows, dtype=np.uint64)
    for q in range(keys.shape[1]):
        columns, out, held = [keys[:, q, c].astype(np.uint64) for c in range(SUBS)], [], 0
        for chosen in combinations(columns, SUBS - RADIUS):
            k = np.zeros(rows, np.uint64)
            for c in chosen:
                k = (k << np.uint64(16)) | c
            k = np.sort((k * np.uint64(0x9E3779B97F4A7C15) & ~mask) | row)
            top, k, apart = k >> low, (k & mask).astype(np.int64), 1
            at = np.flatnonzero(top[1:] == top[:-1])
            while len(at):
                a, b = k[at], k[at + apart]
                out.append(np.minimum(a, b) * rows + np.maximum(a, b))
                held += len(at)
                if held > FOUND // 4:
                    yield sorted_distinct(np.concatenate(out))
                    out, held = [], 0
                apart += 1
                at = at[at + apart < rows]
                at = at[top[at + apart] == top[at]]
        if out:
            yield sorted_distinct(np.concatenate(out))


def near_within(left: DataFrame, threshold: float, step: float, size: int) -> DataFrame:
    """Distinct (left_id, right_id, n): pairs of texts that may reach the threshold, smaller id first, with the sum of their sizes."""
    rows = left.withColumn("range", F.floor(F.log("n") / step).cast("int")).withColumn("deal", F.xxhash64("id").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    sizes = rows.groupBy("range").agg(F.count("*").alias("c"), F.min("n").alias("a"), F.max("n").alias("z")).toArrow().to_pylist()  # few, as a logarithm of the longest text
    blocks = own_blocks({r["range"]: (r["c"], r["a"], r["z"]) for r in sizes}, threshold)
    keyed = [b for b, x in blocks.items() if x[1]]
    id_kind = left.schema["id"].dataType.simpleString()
    names = ["block", "i", "j", "sheet", "part", "guest", "id", "n", "bits", "keys"]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), None, pa.int32(), pa.binary(), pa.binary()]

    def deal(batches):
        for b in batches:
            kinds[6] = b.schema.field("id").type
            out, held = [], 0
            for id_, text, n, bits, own, deal_ in zip(*(b.column(c) for c in ("id", "text", "n", "bits", "range", "deal"))):
                grams, id_, n, own, bits = None, id_.as_py(), n.as_py(), own.as_py(), np.frombuffer(bits.as_buffer(), np.uint64)
                for block in (own, own + 1):
                    if block not in blocks:
                        continue
                    parts, groups, each, words = blocks[block]
                    maps, sheets = np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0).tobytes(), [b""]
                    if groups:
                        grams = grams_of(text.as_py(), size) if grams is None else grams
                        keys = group_keys(grams, groups).reshape(groups, SUBS)
                        sheets = [keys[a : a + each].tobytes() for a in range(0, groups, each)]
                    part = deal_.as_py() % parts
                    for other in range(parts):
                        for k, sheet in enumerate(sheets):
                            out.append((block, min(part, other), max(part, other), k, part, block > own, id_, n, maps, sheet))
                            held += len(maps) + len(sheet) + 64
                if held > PORTION:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, i, j, _ = (k.as_py() for k in key)
        groups = blocks[block][1]
        rows = lambda column, kind: np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)
        held = [(b.column("id"), b.column("n").to_numpy().astype(np.int64), *(b.column(c).to_numpy(zero_copy_only=False) for c in ("part", "guest")), rows(b.column("bits"), np.uint64), rows(b.column("keys"), np.uint16) if groups else None) for b in batches]
        ids = pa.concat_arrays([h[0] for h in held])
        n, part, guest, maps = (np.concatenate([h[k] for h in held]) for k in range(1, 5))
        keys = np.concatenate([h[5] for h in held]).reshape(len(n), -1, SUBS) if groups else None
        del held

        def most(both):
            return both - 2 * np.ceil(both * (threshold / (1 + threshold)) - 1e-9)

        def all_pairs():
            by_size = np.argsort(n, kind="stable")
            mine, theirs = by_size[part[by_size] == i], by_size[part[by_size] == j]
            m, columns, g = n[theirs], np.ascontiguousarray(maps[theirs].T), guest[theirs]
            count, slice_ = np.uint16 if len(columns) < 1024 else np.int64, max(256, 65536 // len(columns))
            for k, x in enumerate(mine.tolist()):
                lo, hi = np.searchsorted(m, math.ceil(n[x] * threshold - 1e-6), "left"), np.searchsorted(m, math.floor(n[x] / threshold + 1e-6), "right")
                for a in range(max(lo, k + 1) if i == j else lo, hi, slice_):
                    e = min(hi, a + slice_)
                    near = np.bitwise_count(columns[:, a:e] ^ maps[x][:, None]).sum(axis=0, dtype=count) <= most(m[a:e] + n[x])
                    at = theirs[a:e][near & ~(g[a:e] & guest[x])]
                    if len(at):
                        yield np.full(len(at), x), at

        def by_groups():
            for codes in alike(keys):
                a, b = np.divmod(codes, len(n))
                fits = (np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b]) - 1e-6) & ~(guest[a] & guest[b])
                if i != j:
                    fits &= part[a] != part[b]
                a, b = a[fits], b[fits]
                for at in range(0, len(a), 16384):
                    p, q = a[at : at + 16384], b[at : at + 16384]
                    near = np.bitwise_count(maps[p] ^ maps[q]).sum(axis=1, dtype=np.int64) <= most(n[p] + n[q])
                    if near.any():
                        yield p[near], q[near]

        def leave(codes):
            one, two = np.divmod(codes, len(n))
            p, q = ids.take(pa.array(one)), ids.take(pa.array(two))
            turn = pc.greater(p, q)
            return pa.RecordBatch.from_arrays([pc.if_else(turn, q, p), pc.if_else(turn, p, q), pa.array(n[one] + n[two])], ["left_id", "right_id", "n"])

        found, total = [np.zeros(0, np.int64)], 0
        for a, b in by_groups() if groups else all_pairs():
            found.append(a * len(n) + b)
            total += len(a)
            if total > FOUND:
                found = [sorted_distinct(np.concatenate(found))]
                total = len(found[0])
                if total > FOUND // 2:
                    yield leave(found[0])
                    found, total = [np.zeros(0, np.int64)], 0
        yield leave(sorted_distinct(np.concatenate(found)))

    source = rows.select("id", F.col("text") if keyed else F.lit("").alias("text"), "n", "bits", "range", "deal")
    sent = source.mapInArrow(deal, f"block int, i int, j int, sheet int, part int, guest boolean, id {id_kind}, n int, bits binary, keys binary")
    return sent.groupBy("block", "i", "j", "sheet").applyInArrow(meet, f"left_id {id_kind}, right_id {id_kind}, n long").distinct()


def near_between(left: DataFrame, right: DataFrame, threshold: float, step: float) -> DataFrame:
    """(left_id, right_id, n): pairs of a left and a right text that may reach the threshold, with the sum of their sizes."""
    every = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    rows = every.select("side", "id", "n", "bits", F.floor(F.log("n") / step).cast("int").alias("range"))
    sizes = rows.groupBy("range", "side").count().toArrow().to_pylist()  # ranges are few: their number is a logarithm of the longest text's
    dealt = block_parts({(r["range"], r["side"]): r["count"] for r in sizes}, False)
    blocks = left.sparkSession.createDataFrame(dealt, "block int, range int, guest boolean, lefts int, rights int")
    first = F.col("side") == 0
    mine, others = F.when(first, F.col("lefts")).otherwise(F.col("rights")), F.when(first, F.col("rights")).otherwise(F.col("lefts"))
    sent = rows.join(F.broadcast(blocks), "range").withColumn("part", F.pmod(F.xxhash64("side", "id"), mine).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    i, j = F.when(first, F.col("part")).otherwise(F.col("other")), F.when(first, F.col("other")).otherwise(F.col("part"))
    sent = sent.select("block", i.alias("i"), j.alias("j"), "guest", "side", "id", "n", "bits")
    id_kind = every.schema["id"].dataType.simpleString()

    def meet(key, t):
        block = key[0].as_py()
        t = t.sort_by("n")
        n, guest, side = (t[c].to_numpy() for c in ("n", "guest", "side"))
        words = max(1, (1 << max(0, math.floor(math.exp((block - 1) * step)) - 1).bit_length()) // 64)
        bits = np.stack([np.bitwise_xor.reduce(np.frombuffer(x.as_buffer(), np.uint64).reshape(-1, words), axis=0) for x in t["bits"]])
        mine, theirs = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        m, maps, g = n[theirs].astype(np.int64), bits[theirs], guest[theirs]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for x in mine.tolist():
            lo, hi = np.searchsorted(m, math.ceil(n[x] * threshold - 1e-6), "left"), np.searchsorted(m, math.floor(n[x] / threshold + 1e-6), "right")
            for a in range(lo, hi, 2048):
                e = min(hi, a + 2048)
                both = m[a:e] + n[x]
                most = both - 2 * np.ceil(both * (threshold / (1 + threshold)) - 1e-9)
                near = np.bitwise_count(maps[a:e] ^ bits[x]).sum(axis=1, dtype=np.int64) <= most
                near &= ~(g[a:e] & guest[x])
                at = theirs[a:e][near]
                if len(at):
                    found.append((np.full(len(at), x), at))
        one, two = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in (0, 1))
        ids = t["id"].combine_chunks()
        return pa.table({"left_id": ids.take(pa.array(one)), "right_id": ids.take(pa.array(two)), "n": n[one].astype(np.int64) + n[two]})

    return sent.groupBy("block", "i", "j").applyInArrow(meet, f"left_id {id_kind}, right_id {id_kind}, n long")


def similarity_join(left: DataFrame, right: DataFrame | None, threshold: float = 0.85, size: int = 5) -> DataFrame:
    """Pairs with Jaccard similarity of gram sets >= threshold: left_id, right_id, overlap, similarity (6 decimals).

    left, right: from gram_sets with the same `size`; with right None the pairs lie within left, smaller id first.
    Sizes of a pair differ by one range at most, so that a block holds the texts of a range and, as guests, of the
    one before. A pair at the threshold differs in at most d grams. Within one table the grams fall into so many groups
    that one of them has at most RADIUS of these; a group is cut into SUBS subsets, of which all but RADIUS are then equal,
    so that equal keys of any SUBS - RADIUS subsets name every such pair. Keys go to sheets of bounded bytes by block and groups.
    There, and for all pairs of small blocks, of the longest texts and between two tables, the parities of the grams rule out
    most others (a differing bit is a gram that one side lacks). What is left is checked exactly on the texts, dealt by both sides.
    Between two tables a part of CELL left texts meets a part of CELL right ones; sizes that the other side lacks go nowhere.
    """
    own = right is None
    kinds = [left.schema["id"].dataType, (left if own else right).schema["id"].dataType]
    every = left.withColumn("side", F.lit(0))
    every = every if own else every.unionByName(right.withColumn("side", F.lit(1)))
    step = -math.log(threshold) * (1 + 1e-9) if threshold < 1 else 1.0
    id_kind = every.schema["id"].dataType
    pairs = stage(near_within(left, threshold, step, size) if own else near_between(left, right, threshold, step), "candidates").df
    total = pairs.agg(F.count("*").alias("pairs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    cells = max(1, math.ceil(math.sqrt(max(total["pairs"] / CHECKED, total["n"] / CHECKED_GRAMS))))
    pairs = pairs.select(F.pmod(F.xxhash64("left_id"), F.lit(cells)).cast("int").alias("i"), F.pmod(F.xxhash64("right_id", F.lit(1)), F.lit(cells)).cast("int").alias("j"), "left_id", "right_id")
    cell = ["i", "j"]
    ends = pairs.select(*cell, F.lit(0).alias("side"), F.col("left_id").alias("id")).unionByName(pairs.select(*cell, F.lit(0 if own else 1).alias("side"), F.col("right_id").alias("id"))).distinct()
    texts = ends.join(every.select("side", "id", "text"), ["side", "id"]).select(*[F.col(c).alias(f"t_{c}") for c in cell], "side", "id", "text")

    def exact(key, p, t):
        text = dict(zip(zip(t["side"].to_pylist(), t["id"].to_pylist()), range(len(t))))
        column, known, held = t["text"].combine_chunks(), {}, 0

        def grams(side, id_) -> np.ndarray:
            nonlocal held
            at = text[side, id_]
            if at not in known:
                if held > KEPT:
                    known.clear()
                    held = 0
                known[at] = grams_of(column[at].as_py(), size)
                held += known[at].nbytes
            return known[at]

        p = p.sort_by("left_id")
        overlaps, similar = [], []
        for a, b in zip(p["left_id"].to_pylist(), p["right_id"].to_pylist()):
            x, y = grams(0, a), grams(0 if own else 1, b)
            at = np.searchsorted(x, y)
            overlaps.append(int((x[np.minimum(at, len(x) - 1)] == y).sum()))
            similar.append(overlaps[-1] / (len(x) + len(y) - overlaps[-1]))
        out = pa.table({"left_id": p["left_id"], "right_id": p["right_id"], "overlap": pa.array(overlaps, pa.int32()), "similarity": pa.array(similar, pa.float64())})
        return out.filter(pc.greater_equal(out["similarity"], threshold))

    out = pairs.groupBy(*cell).cogroup(texts.groupBy(*[f"t_{c}" for c in cell])).applyInArrow(exact, f"left_id {id_kind.simpleString()}, right_id {id_kind.simpleString()}, overlap int, similarity double")
    return out.select(F.col("left_id").cast(kinds[0]).alias("left_id"), F.col("right_id").cast(kinds[1]).alias("right_id"), "overlap", F.round("similarity", 6).alias("similarity"))


def near_contamination(pairs: DataFrame) -> DataFrame:
    """Of each record's qualifying candidates the one with the highest overlap, then the lowest id."""
    best = F.max_by(F.struct("right_id", "similarity"), F.struct("overlap", -F.col("right_id")))
    return pairs.groupBy("left_id").agg(best.alias("b")).select("left_id", F.col("b.right_id").alias("match_id"), F.col("b.similarity").alias("similarity"))


def hash_rank(seed, id_col: Column) -> Column:
    """The order of seeded splits and samples: SHA-256 over 'seed:id'."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), id_col.cast("string")), 256)


def hash_split(records: DataFrame, seed, sizes: dict[str, int], id_col: str = "id") -> DataFrame:
    """The first rows in hash order go to the first split, the next to the second, and so on; the rest drop.

    Sort and limit run as a distributed top-n; only the chosen rows are numbered in one place.
    """
    total = sum(sizes.values())
    chosen = records.withColumn("h", hash_rank(seed, F.col(id_col))).orderBy("h", id_col).limit(total)
    chosen = chosen.withColumn("k", F.row_number().over(W.orderBy("h", id_col)))
    name, upto = None, 0
    for split, n in sizes.items():
        upto += n
        name = F.when(F.col("k") <= upto, split) if name is None else name.when(F.col("k") <= upto, split)
    return chosen.withColumn("split", name).drop("h", "k")


def reason_counts(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy("reason").agg(F.count("*").alias("n"))


def snapshot(heldout: DataFrame) -> DataFrame:
    """Per source: number of questions, of distinct normalised ones, and SHA-256 over the sorted distinct ones, by lines.

    Empty ones do not count. A source's texts stream through the hash in their order; none of it is gathered.
    """

    def digests(batches):
        now, n, h = None, 0, None
        for b in batches:
            for source, text in zip(b.column("source").to_pylist(), b.column("norm").to_pylist()):
                if h is None or source != now:
                    if h is not None:
                        yield _one(source=[now], unique_questions=[n], sha256=[h.hexdigest()])
                    now, n, h = source, 0, hashlib.sha256()
                h.update((b"\n" if n else b"") + text.encode())
                n += 1
        if h is not None:
            yield _one(source=[now], unique_questions=[n], sha256=[h.hexdigest()])

    distinct = heldout.where("norm <> ''").select("source", "norm").distinct()
    own = distinct.repartition("source").sortWithinPartitions("source", "norm").mapInArrow(digests, "source string, unique_questions long, sha256 string")
    own = own.withColumnRenamed("source", "of")
    counts = heldout.groupBy("source").agg(F.count("*").alias("questions"))
    out = counts.join(own, counts["source"].eqNullSafe(own["of"]), "left")
    nothing = F.lit(hashlib.sha256().hexdigest())
    return out.select("source", "questions", F.coalesce("unique_questions", F.lit(0)).cast("long").alias("unique_questions"), F.coalesce("sha256", nothing).alias("sha256"))


def combined_hash(heldout: DataFrame) -> DataFrame:
    """One row: SHA-256 over the JSON text {source: [sorted distinct normalised questions]} of all sources.

    One hash over all texts is one stream by its nature: they pass it sorted, by lists of an Arrow batch.
    """
    quoted = lambda x: F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)

    def digest(batches):
        h, now, n = hashlib.sha256(b"{"), None, -1
        for b in batches:
            for source, text in zip(b.column("source").to_pylist(), b.column("norm").to_pylist()):
                if n < 0 or source != now:
                    h.update((b"" if n < 0 else b"], ") + source.encode() + b": [")
                    now, n = source, 0
                if text is not None:
                    h.update((b", " if n else b"") + text.encode())
                    n += 1
        h.update(b"]}" if n >= 0 else b"}")
        yield _one(combined=[h.hexdigest()])

    named = F.when(F.col("norm") != "", F.col("norm"))
    rows = heldout.select("source", named.alias("norm")).distinct().repartition(1).sortWithinPartitions("source", "norm")
    rows = rows.select(quoted(F.col("source")).alias("source"), F.when(F.col("norm").isNotNull(), quoted(F.col("norm"))).alias("norm"))
    return rows.mapInArrow(digest, "combined string").agg(F.coalesce(F.max("combined"), F.lit(hashlib.sha256(b"{}").hexdigest())).alias("combined"))


def _one(**columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)

