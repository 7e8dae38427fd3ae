import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from corpusloom.llm import exact_dedup, line_dedup, simhash
from corpusloom.llm.common import connected_components

from .fixtures import collected, documents


class Forest:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def lower_az(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_components_match_a_plain_forest(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(900 + i, 901 + i) for i in range(60)] + [(5, 5)]
    forest = Forest()
    for a, b in edges:
        forest.join(a, b)
    got = {r["node"]: r["root"] for r in collected(connected_components(spark.createDataFrame(edges, "u long, v long")).df)}
    assert got == {n: forest.find(n) for a, b in edges for n in (a, b) if a != b or n in got}


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_groups(spark, keep, digest_bytes):
    docs = documents(spark)
    groups = defaultdict(list)
    for r in collected(docs):
        groups[lower_az(r["text"])].append(r["doc_id"])
    got = collected(exact_dedup.exact_groups(docs, keep=keep, digest_bytes=digest_bytes))
    assert len(got) == docs.count()
    import hashlib

    kept = defaultdict(int)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_sha[r["text_sha256"]]
        named = [i for i in ids if i is not None]
        best = (max if keep == "largest" else min)(named) if named else None
        assert (r["keep_id"], r["group_size"]) == (best, len(ids))
        kept[r["text_sha256"]] += r["kept"]
    assert set(kept.values()) == {1}


def test_exact_index_lookup_and_compaction(spark):
    index = exact_dedup.DigestIndex(spark, keep="smallest")
    for ids in ([3, 4], [1, 9]):
        index.flush(spark.createDataFrame([(i, bytes([i % 3])) for i in ids], "doc_id long, digest binary"), memtables=2)
    index.compact()
    assert len(index.runs) == 1
    assert sorted((bytes(r["digest"]), r["best"], r["n"]) for r in collected(index.read())) == [(b"\0", 3, 2), (b"\1", 1, 2)]
    assert [r["best"] for r in collected(index.lookup([b"\1"]))] == [1]


def plain_fingerprint(text):
    words = lower_az(text).encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_all_pairs(spark):
    docs = documents(spark)
    rows = collected(docs)
    prints = [plain_fingerprint(r["text"]) for r in rows]
    forest = Forest()
    for i in range(len(rows)):
        for j in range(i + 1):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                forest.join(i, j)
    low = defaultdict(list)
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            low[forest.find(i)].append(r["doc_id"])
    want = sorted((str(r["doc_id"]), f"{p:016x}", min(low[forest.find(i)], default=None)) for i, (r, p) in enumerate(zip(rows, prints)))
    got = simhash.near_groups(docs)
    got = sorted((str(r["doc_id"]), f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in collected(got))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == [w[2] for w in want]
    kept = collected(simhash.deduplicate(docs))
    assert len(kept) == len({forest.find(i) for i in range(len(rows))})
    assert set(kept[0]) == set(docs.columns)


def test_vantage_points_find_every_pair():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    points = np.unique(np.concatenate([base ^ np.uint64(sum(1 << int(b) for b in rng.integers(0, 64, k))) for k in (0, 1, 2, 3, 4) for _ in range(20)]))
    tree = simhash.build_tree(points, 40, 2)
    forest, want = Forest(), Forest()
    for _, at, home in simhash.route(tree, points, 2):
        for a, b in simhash.spanning_links(points[at[home]], points[at[~home]], 2):
            forest.join(a, b)
    for i, p in enumerate(points):
        for q in points[:i]:
            if int(p ^ q).bit_count() <= 2:
                want.join(int(p), int(q))
    assert {int(p): forest.find(int(p)) for p in points} == {int(p): want.find(int(p)) for p in points}


@pytest.mark.parametrize("spread", [40, 500_000])
def test_leaves_get_trees_of_their_own(spark, monkeypatch, spread):
    """A tree fitted on a few fingerprints leaves large leaves, which further trees part; links are those of all pairs."""
    monkeypatch.setattr(simhash, "SPREAD", spread)
    monkeypatch.setattr(simhash, "LEAF_SAMPLE", 100)
    rounds, part = [], simhash.part_leaves
    monkeypatch.setattr(simhash, "part_leaves", lambda sent, *a: rounds.append(sent.select("leaf").distinct().count()) or part(sent, *a))
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    points = np.unique(np.concatenate([base ^ np.uint64(sum(1 << int(b) for b in rng.integers(0, 64, k))) for k in (0, 1, 2, 3, 4) for _ in range(3)]))
    want = Forest()
    for i, p in enumerate(points):
        for q in points[:i][np.bitwise_count(points[:i] ^ p) <= 2].view(np.int64):
            want.join(int(p.view(np.int64)), int(q))
    fps = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    got = {r["node"]: r["root"] for r in collected(simhash.fingerprint_components(fps, leaf=20, sample=30).df)}
    assert got == {p: want.find(p) for p in map(int, points.view(np.int64)) if p in want.up}
    assert len(rounds) >= 2 and rounds[-1] > rounds[0]


def test_large_leaf_is_split(monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 50)
    rng = np.random.default_rng(2)
    points = np.unique(np.concatenate([np.uint64(77) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)), rng.integers(0, 1 << 63, 300, dtype=np.uint64)]))
    forest, want = Forest(), Forest()
    for a, b in simhash.spanning_links(points, points[:0], 2):
        forest.join(a, b)
    for i, p in enumerate(points):
        for q in points[:i]:
            if int(p ^ q).bit_count() <= 2:
                want.join(int(p), int(q))
    assert {int(p): forest.find(int(p)) for p in points} == {int(p): want.find(int(p)) for p in points}


def plain_lines(rows, threshold=0.8):
    """Brute force: kept line numbers of each row."""
    def clean(x):
        return x.strip(" \t\n\r\f\v")

    lines = sorted({clean(x) for r in rows for x in (r["text"] or "").split("\n")} - {""})
    forest = Forest()
    for i, a in enumerate(lines):
        for b in lines[:i]:
            if line_dedup.jaccard(a, b) >= threshold:
                forest.join(a, b)
    place = defaultdict(list)
    for r in rows:
        for no, x in enumerate((r["text"] or "").split("\n")):
            if clean(x):
                place[forest.find(clean(x))].append((r["doc_id"] is None, r["doc_id"] or 0, no))
    return ["\n".join(x for no, x in enumerate(r["text"].split("\n")) if not clean(x) or min(place[forest.find(clean(x))]) == (r["doc_id"] is None, r["doc_id"] or 0, no)) if r["text"] is not None else None for r in rows]


def test_lines_against_all_pairs(spark):
    docs = documents(spark)
    rows = collected(docs)
    want = sorted((str(r["doc_id"]), str(t)) for r, t in zip(rows, plain_lines(rows)))
    out = collected(line_dedup.deduplicate_lines(docs))
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in out) == want
    assert set(out[0]) == {*docs.columns, "__cl_lines", "__cl_gone"}


def test_blocks_reach_every_component(spark, monkeypatch):
    """With one band for all lines, one bucket holds several components larger than the first centres."""
    monkeypatch.setattr(line_dedup, "band_keys", lambda lines, *_: (np.arange(len(lines)), np.full(len(lines), 1, np.int64)))
    bases = [chr(97 + k) * 3 + f"{k} " + " ".join(f"{chr(97 + k)}{j}w" for j in range(30)) for k in range(6)]
    rows = [(i, f"{bases[i % 6]} {'z' * (i // 6)}") for i in range(36)]
    lines = spark.createDataFrame([(i, t, 1) for i, t in rows], "lid long, line string, n long")
    for block in (2048, 5):
        monkeypatch.setattr(line_dedup, "BLOCK", block)
        roots = {r["node"]: r["root"] for r in collected(line_dedup.similar_lines(lines))}
        assert roots == {i: i % 6 for i in range(36)}


def test_signatures_agree_at_every_length():
    """Lines of 0.8 similarity and more meet in a band, whatever the number of their shingles."""
    rng = random.Random(9)
    missed = 0
    for n in range(30, 330, 3):
        a = "".join(rng.choice("abcdefghij ") for _ in range(n))
        for b in (a + "x" * (n // 12), a[: n // 2] + "#" + a[n // 2 + 1 :] if n > 90 else a + "!"):
            who, keys = line_dedup.band_keys([a, b])
            assert line_dedup.jaccard(a, b) >= 0.8
            missed += not set(keys[who == 0]) & set(keys[who == 1])
    assert missed <= 1


@pytest.mark.parametrize("chunk", [1, 7, 60])
def test_meet_is_the_same_however_rows_are_batched(monkeypatch, chunk):
    import pyarrow as pa

    keys = np.array([1] * 30 + [2] + [3] * 2 + [4] * 12 + [-5] * 3, np.int64)
    lids = np.arange(len(keys))

    def run(size):
        rows = []
        for bucket in (0, 1):
            own = np.flatnonzero((keys < 0) == bool(bucket))
            rows += [(bucket, keys[own[i : i + size]].tobytes(), lids[own[i : i + size]].tobytes()) for i in range(0, len(own), size)]
        cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))]
        whole = pa.RecordBatch.from_arrays(cols, ["bucket", "keys", "lids"])
        return sorted(tuple(r.values()) for b in line_dedup._meet(iter([whole.slice(0, 2), whole.slice(2)])) for r in b.to_pylist())

    want = run(1000)
    assert {r[1] for r in want if r[0] == 4} == {-1, *range(12)} and not [r for r in want if r[0] == 2]
    assert [r for r in want if r[0] == 3] == [(3, -1, 31, 32)]
    monkeypatch.setattr(line_dedup, "CHUNK", chunk)
    for size in (1, 3, 5):
        assert run(size) == want


def test_bitmaps_bound_the_symmetric_difference():
    rng = np.random.default_rng(6)
    for n in (5, 300, 1000, 5000):
        sets = [np.unique(rng.integers(0, 2 * n, n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(12)]
        maps = line_dedup.bitmaps(sets)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                assert np.bitwise_count(maps[i] ^ maps[j]).sum() <= len(np.setxor1d(a, b))


def test_overlap_is_exact_at_any_threshold():
    x, y = np.arange(10, dtype=np.uint64), np.arange(40, dtype=np.uint64)
    assert line_dedup.overlap(x, y) == 0.25 and line_dedup.overlap(y, x, 0.2) == 0.25 and line_dedup.overlap(x, y, 0.3) == 0.0


def test_empty_tables(spark):
    docs = documents(spark, empty=True)
    assert exact_dedup.exact_groups(docs).count() == 0
    assert simhash.near_groups(docs).count() == 0
    assert simhash.deduplicate(docs).count() == 0
    assert line_dedup.deduplicate_lines(docs).count() == 0


def test_bands_miss_few_pairs():
    assert (1 - 0.8**line_dedup.ROWS) ** line_dedup.BANDS < 3e-4
    _, keys = line_dedup.band_keys(["a line that is long enough for its shingles to fill most of the bins of a signature"])
    assert len(keys) % 16 == 0
