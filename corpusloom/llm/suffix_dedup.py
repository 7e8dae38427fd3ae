"""Removal of byte strings that repeat across the corpus, by deep-shallow suffix sorting.

A byte goes if a `span`-byte string that covers it also starts anywhere else. Equal texts fall together
first: what has a copy and is long enough goes whole, and one representative stands for it. In the
others every window of `span` bytes names as its anchor the GRAM-byte string inside it with the smallest
hash, so that equal windows have equal anchors at equal offsets. Only anchors whose hash occurs again lead
on: their context (the windows that named them) is cut out, equal contexts fall together by their bytes,
and the distinct contexts of an anchor are ordered twice by deep-shallow sorting: the suffixes that begin
at the anchor, and the reversed prefixes that end there. Multikey quicksort orders them to a shallow
depth, blind tries the groups that still agree there. Common prefix lengths of both orders then tell for
every offset whether another context has the same window.

An anchor with over HOT distinct contexts is dealt again: its windows part by ranges of their offset from
the anchor, each context is cut to each range, and what the windows of a range have in common (more than
the anchor) joins the key. Equal cuts fall together by their bytes with map-side combine, and each smaller
group is sorted in the same way; at one offset a range, equal cuts are all that is left. So no task holds
an unbounded group. Anchors and contexts that very many documents share meet their partners by a broadcast
of at most PARTS keys, all others by a shuffled join.

Defined cases: a null text is the empty text; texts under `span` bytes lose nothing; very long texts are
read in overlapping portions of _BATCH bytes, with equal results; rows with one text, with or without the
same doc_id, are copies of each other; ties do not arise, as strings are judged, not rows; an empty table
gives an empty result; other columns are ignored. In the text column, bytes that a cut leaves as no valid
UTF-8 become U+FFFD; kept_sha256 is of the bytes themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import meet, stage, table

SPAN = 400
GRAM = 64
SHALLOW = 64
HOT = 8192
#: A key with more than this part of all rows is heavy: there are at most PARTS of them.
PARTS = 4096
#: Up to this many rows are broadcast to narrow a scan of texts; beyond it the join is shuffled.
BROADCAST_ROWS = 2_000_000
_BATCH = 4 << 20
_POS = np.uint64((1 << 24) - 1)


# -- ordering strings ----------------------------------------------------------------------------------


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix; the first `start` bytes are known to agree."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[start:n], "big") ^ int.from_bytes(b[start:n], "big")
    return n - (x.bit_length() + 7) // 8


def blind_trie(strings: list[bytes], group: list[int], depth: int) -> tuple[list[int], list[int]]:
    """Order of strings that share their first `depth` bytes, and what each shares with the one before.

    Nodes hold a depth and one byte a branch. A string goes down by its own bytes without comparing the
    skipped ones; one comparison with the leaf it meets shows where it really leaves the path.
    """
    root: list = [depth, {}]
    leaves: dict[int, list[int]] = {}
    for i in group:
        s = strings[i]
        node = root
        while isinstance(node, list) and node[1]:
            kids = node[1]
            c = s[node[0]] if node[0] < len(s) else -1
            node = kids[c] if c in kids else next(iter(kids.values()))
        if isinstance(node, list):
            leaves[i] = [i]
            root[1][s[depth] if depth < len(s) else -1] = i
            continue
        other = strings[node]
        if s == other:
            leaves[node].append(i)
            continue
        at = common(s, other, depth)
        here, up, by = root, None, None
        while isinstance(here, list) and here[0] < at:
            up, by = here, s[here[0]] if here[0] < len(s) else -1
            here = here[1][by]
        leaves[i] = [i]
        mine = s[at] if at < len(s) else -1
        if isinstance(here, list) and here[0] == at:
            here[1][mine] = i
        else:
            theirs = other[at] if at < len(other) else -1
            split = [at, {theirs: here, mine: i}]
            if up is None:
                root = split
            else:
                up[1][by] = split
    order, shared, todo = [], [], [(root, depth)]
    while todo:
        node, before = todo.pop()
        if isinstance(node, list):
            kids = sorted(node[1].items())
            todo.extend((kid, before if k == 0 else node[0]) for k, (_, kid) in reversed(list(enumerate(kids))))
        else:
            for k, i in enumerate(leaves[node]):
                order.append(i)
                shared.append(len(strings[i]) if k else before)
    return order, shared


def deep_shallow(strings: list[bytes], known: int = 0, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of strings whose first `known` bytes agree, and common prefix with the one before."""
    order: list[int] = []
    shared: list[int] = []
    limit = known + shallow
    todo: list[tuple[list[int], int]] = [(list(range(len(strings))), known)]
    while todo:
        group, depth = todo.pop()
        if len(group) == 1:
            part, own = group, [0]
        elif depth >= limit:
            part, own = blind_trie(strings, group, depth)
        else:
            pivot = strings[group[len(group) // 2]][depth : depth + 8]
            less, same, more = [], [], []
            for i in group:
                key = strings[i][depth : depth + 8]
                (same if key == pivot else less if key < pivot else more).append(i)
            if more:
                todo.append((more, depth))
            if same:
                if len(pivot) < 8:  # they end here and are equal
                    todo.append((same, limit))
                else:
                    todo.append((same, depth + 8))
            if less:
                todo.append((less, depth))
            continue
        if order:
            own[0] = common(strings[order[-1]], strings[part[0]], known)
        order += part
        shared += own
    if shared:
        shared[0] = 0
    return np.array(order, np.int64), np.array(shared, np.int64)


def repeated_windows(contexts: list[bytes], lefts: list[int], span: int = SPAN, gram: int = GRAM) -> list[list[tuple[int, int]]]:
    """For every context the ranges of window starts (within it) whose window another context has as well.

    lefts: where the anchor stands in each context. Windows correspond at equal offsets from the anchor.
    """
    n = len(contexts)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    right, r_shared = deep_shallow([c[k:] for c, k in zip(contexts, lefts)])
    left, l_shared = deep_shallow([c[:k][::-1] for c, k in zip(contexts, lefts)])
    rank = np.empty(n, np.int64)
    rank[left] = np.arange(n)
    todo = [(0, n, gram - 1)]
    while todo:
        lo, hi, above = todo.pop()
        if hi - lo < 2:
            continue
        inner = r_shared[lo + 1 : hi]
        depth = int(inner.min())
        if depth > above:
            ranks = np.sort(rank[right[lo:hi]])
            cuts = np.ravel(np.column_stack([ranks[:-1] + 1, ranks[1:] + 1]))
            steps = np.minimum.reduceat(np.append(l_shared, 0), cuts)[::2]
            best = np.maximum(np.append(steps, 0), np.append(0, steps))
            for k, most in zip(left[ranks], best):
                low = max(span - depth, lefts[k] - (len(contexts[k]) - span))
                high = min(int(most), lefts[k], span - above - 1)
                if low <= high:
                    out[k].append((lefts[k] - high, lefts[k] - low))
        cuts = [lo, *(np.flatnonzero(inner == depth) + lo + 1).tolist(), hi]
        todo.extend((a, b, max(depth, above)) for a, b in zip(cuts, cuts[1:]))
    return out


# -- anchors -------------------------------------------------------------------------------------------


def window_anchors(texts: list[bytes], span: int = SPAN, gram: int = GRAM):
    """Arrays (text, first window, last window, anchor, anchor's hash) over texts of up to 16 MB in sum.

    Windows first..last of a text (by start) share that anchor, the leftmost of the smallest hashes.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    windows = np.maximum(sizes - span + 1, 0)
    if not windows.sum():
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    h = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        step, m = 1, np.uint64(0x9E3779B97F4A7C15)
        while step < gram:
            h = h[:-step] * m + h[step:]
            m, step = m * m, step * 2
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    key = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
    width, step = span - gram + 1, 1
    while step * 2 <= width:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    if width > step:
        key = np.minimum(key[: step - width], key[width - step :])
    who = np.repeat(np.arange(len(texts)), windows)
    at = np.arange(len(who)) - np.repeat(np.cumsum(windows) - windows, windows)
    anchor = (key[starts[who] + at] & _POS).astype(np.int64)
    cut = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (who[1:] != who[:-1])))
    last = np.append(cut[1:], len(who)) - 1
    return who[cut], at[cut], at[last], anchor[cut] - starts[who[cut]], h[anchor[cut]]


def _portions(texts: list[bytes], span: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(text numbers, offsets, parts) of up to some MB; long texts are cut with an overlap of span - 1."""
    who, base, parts, size = [], [], [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - span + 1), _BATCH):
            parts.append(t[at : at + _BATCH + span - 1])
            who.append(k)
            base.append(at)
            size += len(parts[-1])
            if size >= _BATCH:
                yield np.array(who), np.array(base), parts
                who, base, parts, size = [], [], [], 0
    if parts:
        yield np.array(who), np.array(base), parts


def _list_anchors(span: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, cids = b.column("bytes").to_pylist(), b.column("cid")
            for who, _, parts in _portions(texts, span):
                k, _, _, _, h = window_anchors(parts, span, gram)
                k, h = who[k], h.view(np.int64)
                order = np.lexsort((h, k))
                k, h = k[order], h[order]
                at = np.flatnonzero(np.append(len(k) > 0, (k[1:] != k[:-1]) | (h[1:] != h[:-1])))
                n = np.diff(np.append(at, len(k)))
                yield pa.RecordBatch.from_arrays([pa.array(h[at]), cids.take(pa.array(k[at])), pa.array(n)], ["h", "cid", "n"])

    return run


def _cut_contexts(span: int, gram: int):
    names = ["h", "off", "ctxd", "cid", "first", "n", "ctx"]
    types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, cids = b.column("bytes").to_pylist(), b.column("cid").to_pylist()
            wanted = [np.array(x, np.int64) for x in b.column("hs").to_pylist()]
            for who, base, parts in _portions(texts, span):
                arrays = window_anchors(parts, span, gram)
                split = np.searchsorted(arrays[0], np.arange(len(parts) + 1))
                rows, seen = [], {}
                for part, (lo, hi) in enumerate(zip(split, split[1:])):
                    k = who[part]
                    _, s1, s2, m, h = (x[lo:hi] for x in arrays)
                    h = h.view(np.int64)
                    for i in np.flatnonzero(np.isin(h, wanted[k])):
                        a, off, hash_ = int(s1[i]), int(m[i] - s1[i]), int(h[i])
                        ctx = parts[part][a : int(s2[i]) + span]
                        key = (hash_, off, xxhash.xxh3_128_digest(ctx))
                        old = seen.get(key)
                        if old is None:
                            seen[key] = len(rows)
                            rows.append([*key, cids[k], int(base[part]) + a, 1, ctx])
                        else:
                            rows[old][5] += 1
                            rows.append([*key, cids[k], int(base[part]) + a, 0, None])
                for at in range(0, len(rows), 20_000):
                    cols = list(zip(*rows[at : at + 20_000]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return run


def _judge(span: int, gram: int):
    names = ["h", "off", "ctxd", "w0", "w1"]

    def settle(rows: list[tuple]) -> Iterator[tuple]:
        if len(rows) > 1:
            found = repeated_windows([r[3] for r in rows], [r[1] for r in rows], span, gram)
        else:
            found = [[]]
        for (h, off, ctxd, ctx, n), ranges in zip(rows, found):
            if n > 1:
                ranges = [(0, len(ctx) - span)]
            for a, b in ranges:
                yield h, off, ctxd, a, b

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * 5
        types = [pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for b in batches:
            out: list[tuple] = []
            for row in zip(*(b.column(c).to_pylist() for c in ("h", "off", "ctxd", "ctx", "n"))):
                if group and group[0][0] != row[0]:
                    out.extend(settle(group))
                    group = []
                group.append(row)
            yield pack(out)
        if group:
            yield pack(list(settle(group)))

    return run


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for b in batches:
        rows = []
        for doc_id, data, spans in zip(b.column("doc_id").to_pylist(), b.column("bytes").to_pylist(), b.column("spans").to_pylist()):
            merged: list[list[int]] = []
            for s in sorted((x["a"], x["b"]) for x in spans):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            cuts = [0, *(x for m in merged for x in m), len(data)]
            kept = b"".join(data[lo:hi] for lo, hi in zip(cuts[::2], cuts[1::2]))
            rows.append((doc_id, len(data), len(data) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
        cols = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)


# -- the operator --------------------------------------------------------------------------------------


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"


def _only(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """rows with (left_semi) or without (left_anti) the few ids, broadcast where their count is bounded."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, ids.columns, how)


def _ranges(contexts: DataFrame, span: int, width: int) -> DataFrame:
    """Contexts cut to each range of `width` offsets of their windows from the anchor, under finer keys.

    h2: the anchor with the bytes that all windows of the range hold; off2: the anchor's place in the cut;
    w: the cut's first window. Equal windows stand at equal offsets, so they come under equal keys.
    """
    low, high = F.col("off") - (F.octet_length("ctx") - span), F.col("off")
    part = F.explode(F.sequence(F.floor(low / width), F.floor(high / width))).alias("part")
    c = contexts.select("h", "off", "ctxd", "n", "ctx", low.alias("low"), part)
    first, last = F.col("part") * width, (F.col("part") + 1) * width - 1
    c = c.withColumn("w", (F.col("off") - F.least(last, F.col("off"))).cast("int"))
    until = F.col("off") - F.greatest(first, F.col("low")) + span
    shared = F.substring("ctx", (F.col("off") - first + 1).cast("int"), (first - last + span).cast("int"))
    return c.select(
        "h", "off", "ctxd", "n", "w", F.xxhash64("h", "part", shared).alias("h2"), (F.col("off") - F.col("w")).alias("off2"),
        F.substring("ctx", F.col("w") + 1, (until - F.col("w")).cast("int")).alias("ctx"),
    ).withColumn("ctxd2", F.substring(F.unhex(F.sha2("ctx", 256)), 1, 16))


def _repeated(distinct: DataFrame, span: int, gram: int, hot: int, width: int) -> DataFrame:
    """distinct: staged (h, off, ctxd, ctx, n). (h, off, ctxd, w0, w1): the windows that another place has as well."""
    crowded = stage(distinct.groupBy("h").agg(F.count("*").alias("m")).where(F.col("m") > hot).select("h"), "crowded").df
    calm = _only(distinct, crowded, "left_anti")
    calm = calm.repartition("h").sortWithinPartitions("h").select("h", "off", "ctxd", "ctx", "n")
    found = calm.mapInArrow(_judge(span, gram), "h long, off int, ctxd binary, w0 int, w1 int")
    if crowded.isEmpty():
        return found
    pieces = stage(_ranges(_only(distinct, crowded, "left_semi"), span, width), "pieces").df
    finer = pieces.groupBy(F.col("h2").alias("h"), F.col("off2").alias("off"), F.col("ctxd2").alias("ctxd"), "ctx").agg(F.sum("n").alias("n"))
    finer = stage(_repeated(stage(finer, "distinct").df, span, gram, hot, max(1, width // 16)), "repeated").df
    finer = finer.select(F.col("h").alias("h2"), F.col("off").alias("off2"), F.col("ctxd").alias("ctxd2"), "w0", "w1")
    back = pieces.select("h", "off", "ctxd", "w", "h2", "off2", "ctxd2").join(finer, ["h2", "off2", "ctxd2"])
    return found.unionByName(back.select("h", "off", "ctxd", (F.col("w") + F.col("w0")).alias("w0"), (F.col("w") + F.col("w1")).alias("w1")))


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, hot: int = HOT, parts: int = PARTS) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, text (what stays)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    whole = whole.withColumn("cid", F.substring("digest", 1, 16)).withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    base = stage(whole.select("doc_id", "cid", "key", "n_bytes"), "digests").df
    classes = base.where(F.col("n_bytes") >= span).groupBy("cid").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"))
    multi = stage(classes.where("copies > 1").select("cid", "copies", "rep"), "copies").df
    rows = base.count()
    copied = meet(base.select("doc_id", "cid", "key"), multi, stage(multi.where(F.col("copies") > rows // parts).select("cid"), "heavy").df, ["cid"])
    copied = stage(copied.select("cid", "key", (~F.col("doc_id").eqNullSafe(F.col("rep"))).alias("other")).distinct(), "copied").df
    texts = whole.where(F.col("n_bytes") >= span)
    texts = _only(texts, copied.where("other").select("cid", "key"), "left_anti").select("cid", F.col("text").cast("binary").alias("bytes"))

    anchors = stage(texts.mapInArrow(_list_anchors(span, gram), "h long, cid binary, n long"), "anchors").df
    again = anchors.groupBy("h").agg(F.sum("n").alias("n"), F.count("*").alias("m")).where("n > 1")
    again = stage(again.select("h", "m"), "again").df
    heavy = stage(again.where(F.col("m") > anchors.count() // parts).select("h"), "heavy").df
    suspects = meet(anchors.select("h", "cid"), again.select("h"), heavy, ["h"]).groupBy("cid").agg(F.collect_set("h").alias("hs"))
    suspects = stage(suspects, "suspects").df
    open_texts = _only(texts, suspects.select("cid"), "left_semi").join(suspects, "cid")
    places = open_texts.mapInArrow(_cut_contexts(span, gram), "h long, off int, ctxd binary, cid binary, first long, n long, ctx binary")
    places = stage(places, "contexts").df

    distinct = places.where("ctx is not null").groupBy("h", "off", "ctxd", "ctx").agg(F.sum("n").alias("n"))
    distinct = stage(distinct, "distinct").df
    found = stage(_repeated(distinct, span, gram, hot, 16), "repeated").df
    window = F.struct(F.col("w0").alias("a"), F.col("w1").alias("b"))
    found = found.groupBy("h", "off", "ctxd").agg(F.collect_set(window).alias("ws"))  # within one context: bounded
    on = ["h", "off", "ctxd"]
    heavy = stage(distinct.where(F.col("n") > places.count() // parts).select(*on).distinct(), "heavy").df
    spans = meet(places.select(*on, "cid", "first"), found, heavy, on)
    spans = spans.join(multi.select("cid"), "cid", "left_anti")
    shift = F.transform("ws", lambda x: F.struct((F.col("first") + x["a"]).alias("a"), (F.col("first") + x["b"] + span).alias("b")))
    spans = stage(spans.groupBy("cid").agg(F.flatten(F.collect_list(shift)).alias("spans")), "spans").df

    cut = _only(whole, spans.select("cid"), "left_semi").join(spans, "cid")
    cut = cut.select("doc_id", F.col("text").cast("binary").alias("bytes"), "spans").mapInArrow(_finish, _OUT)
    rest = _only(whole, spans.select("cid"), "left_anti")
    gone = copied.select("cid", "key").distinct().withColumn("gone", F.lit(True))
    rest = rest.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, ["cid", "key"], "left")
    gone, nothing = F.coalesce("gone", F.lit(False)), F.lit(0).cast("long")
    rest = rest.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(nothing).alias("n_removed"),
        F.when(gone, nothing + 1).otherwise(nothing).alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256().hexdigest())).otherwise(F.lower(F.hex("digest"))).alias("kept_sha256"),
        F.when(gone, F.lit("")).otherwise(F.col("text")).alias("text"),
    )
    return cut.unionByName(rest)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
