"""Ranked search against a plain scorer of all pairs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import lexical_search as L

from .fixtures import collected, documents

PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in PLAIN.findall(text or "")]


def plain_ranks(docs, items, k):
    """(item row, rank, doc_id or null, score), ranks over all documents."""
    counts = [(d, Counter(plain_terms(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n_docs, n_all = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in counts:
            m = 100 - 50 + (50 * n * n_docs) // n_all
            s = 0
            for t in set(plain_terms(text)):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    s += w * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
            if s > 0:
                scores.append((-s, d is None, d or 0))
        for r, (s, none, d) in enumerate(sorted(scores)[:k], 1):
            out.append((str(item), r, "None" if none else str(d), -s))
    return sorted(out)


def sample():
    rng = random.Random(4)
    words = [f"{c}{i}" for i in range(12) for c in "abcé"] + ["The", "of", "a"] * 12

    def prose(n):
        return " ".join(rng.choice(words) + rng.choice(["", ",", "--"]) for _ in range(n))

    docs = [(i if i % 11 else None, prose(rng.randint(0, 90))) for i in range(150)]
    docs += [(7, docs[7][1]), (7, docs[7][1]), (500, docs[9][1].upper()), (501, None), (502, ""), (503, "rare"), (504, "of " * 3000), (505, docs[20][1] * 40)]
    items = [(i, prose(rng.randint(1, 30))) for i in range(25)]
    items += [(3, items[4][1]), (None, items[5][1] + " rare"), (60, ""), (61, None), (62, "nowhere else"), (63, "rare"), (64, "the of a"), (65, items[6][1].upper() + " of of")]
    return docs, items


@pytest.mark.parametrize(("k", "block_bytes"), [(50, L.BLOCK_BYTES), (3, 200)])
def test_against_all_pairs(spark, k, block_bytes):
    docs, items = sample()
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, kind int, rank int").repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string")
    rows = collected(L.rank(d, q, k, block_bytes))
    assert sorted((str(r["item_id"]), r["rank"], str(r["doc_id"]), r["score"]) for r in rows) == plain_ranks(docs, items, k)


def test_pieces(monkeypatch):
    """Portions and chunks change nothing, candidates hold every document over the threshold, and bounds leave most out."""
    docs, items = sample()
    import pyarrow as pa

    block = L.Items([(i, (t or "").encode()) for i, t in items])
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array([t for _, t in docs], pa.string())], ["doc_id", "text"])

    def index():
        return sorted((r for b in L._index(block)(iter([batch])) for r in b.to_pylist()), key=str)

    whole = index()
    for portion in (30, 400):
        monkeypatch.setattr(L, "PORTION", portion)
        assert index() == whole
    rows = pa.RecordBatch.from_pylist(whole, pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()), ("counts", pa.binary())]))
    for chunk in (1 << 20, 50):
        monkeypatch.setattr(L, "CHUNK", chunk)
        parts = list(L._postings(rows))
        assert sum(len(p[0]) for p in parts) == len(whole) and (len(parts) > 5) == (chunk == 50)
    monkeypatch.setattr(L, "CHUNK", 1 << 20)
    docs_, none, n, row, who, times = next(iter(L._postings(rows)))
    size = len(block.vocabulary)
    value = L.strengths(times, n[row], len(n), int(n.sum()))
    weight = L.weights(np.bincount(who, minlength=size), len(n))
    best = L._best(who, value, np.ones(len(who), np.int64), 5)
    largest, kth = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for t in range(size):
        own = sorted(value[who == t].tolist(), reverse=True)
        if own:
            largest[t], kth[t] = own[0], own[4] if len(own) > 4 else 0
            have = best[0] == t
            assert best[1][have].tolist() == sorted(set(own[:5]), reverse=True) and best[2][have].sum() == sum(v >= own[min(4, len(own) - 1)] for v in own)
    plan = L.Plan(block, weight, largest, kth)
    impact = weight[who] * value
    scores = np.zeros((len(n), len(block.terms)), np.int64)
    for i, t in enumerate(block.terms):
        np.add.at(scores[:, i], row[np.isin(who, t)], impact[np.isin(who, t)])
    for chunk in (1 << 20, 40):
        monkeypatch.setattr(L, "CHUNK", chunk)
        r, i = L.candidates(plan, np.maximum(plan.threshold, 1), row, who, impact)
        found = set(zip(r.tolist(), i.tolist()))
        assert {(a, b) for a, b in np.argwhere(scores >= np.maximum(plan.threshold, 1)).tolist()} <= found
        assert len(found) < 0.9 * (scores > 0).sum()
        assert L.rescored(plan, r, i, row, who, impact).tolist() == scores[r, i].tolist()
        high = np.sort(scores, axis=0)[-5]  # the true fifth score of each item
        r, i = L.candidates(plan, np.maximum(high, 1), row, who, impact)
        assert {(a, b) for a, b in np.argwhere(scores >= np.maximum(high, 1)).tolist()} <= set(zip(r.tolist(), i.tolist()))
        assert len(r) < len(found)


def test_awkward_documents(spark):
    docs = documents(spark)
    items = [(1, "one"), (2, "ä"), (3, "word"), (4, "line b")]
    q = spark.createDataFrame(items, "item_id long, text string")
    rows = collected(L.rank(docs, q))
    assert sorted((str(r["item_id"]), r["rank"], str(r["doc_id"]), r["score"]) for r in rows) == plain_ranks([(r["doc_id"], r["text"]) for r in collected(docs)], items, 50)
    assert L.rank(documents(spark, empty=True), q).count() == 0
    assert L.rank(docs, q.where("item_id > 9")).count() == 0
