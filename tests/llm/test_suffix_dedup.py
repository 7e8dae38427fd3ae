import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import suffix_dedup as S

from .fixtures import collected, documents


def plain(texts, span):
    """Brute force over all windows of all texts."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + span] for d in data for i in range(len(d) - span + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - span + 1):
            if seen[d[i : i + span]] > 1:
                gone[i : i + span] = True
        runs = int(np.sum(gone[1:] & ~gone[:-1]) + gone[0])
        kept = bytes(c for c, g in zip(d, gone) if not g)
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_orders_like_sorted():
    rng = random.Random(2)
    for _ in range(60):
        stem = bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 5, 40, 90])))
        strings = [stem + bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 1, 3, 60, 90]))) * rng.choice([1, 2]) for _ in range(rng.randint(1, 40))]
        strings += rng.sample(strings, len(strings) // 3)
        order, shared = S.deep_shallow(strings, known=len(stem), shallow=rng.choice([0, 8, 64]))
        assert [strings[i] for i in order] == sorted(strings)
        assert sorted(order) == list(range(len(strings)))
        for k in range(1, len(order)):
            assert shared[k] == S.common(strings[order[k - 1]], strings[order[k]])


def test_windows_of_contexts():
    rng = random.Random(4)
    span, gram = 20, 4
    for _ in range(200):
        n = rng.randint(2, 9)
        base = bytes(rng.choice(b"abc") for _ in range(36))
        contexts, lefts = [], []
        for _ in range(n):
            c = bytearray(base)
            for _ in range(rng.randint(0, 3)):
                c[rng.choice([k for k in range(36) if not 16 <= k < 20])] = rng.choice(b"abc")
            lo, hi = rng.randint(0, 16), rng.randint(20, 36)
            if hi - lo >= span:
                contexts.append(bytes(c[lo:hi]))
                lefts.append(16 - lo)
        if len(contexts) < 2:
            continue
        got = S.repeated_windows(contexts, lefts, span, gram)
        for k, (c, left) in enumerate(zip(contexts, lefts)):
            want = set()
            for w in range(len(c) - span + 1):
                a = left - w
                if 0 <= a <= span - gram:
                    for j, (d, other) in enumerate(zip(contexts, lefts)):
                        v = other - a
                        if j != k and 0 <= v <= len(d) - span and d[v : v + span] == c[w : w + span]:
                            want.add(w)
            assert {w for a, b in got[k] for w in range(a, b + 1)} == want


@pytest.mark.parametrize(("hot", "parts"), [(S.HOT, S.PARTS), (1, 10), (6, 40)])
def test_against_all_windows(spark, hot, parts):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    passage, other = prose(130), prose(160)
    texts = [prose(rng.randint(5, 300)) for _ in range(25)]
    texts += [f"{prose(rng.randint(1, 60))} {passage} {prose(rng.randint(1, 60))}" for _ in range(12)]
    texts += [f"{other}{prose(30)}{other[40:]}", other + "x", other[:500], passage[:399], passage[:400]]
    near = prose(300)
    texts += [near[:k] + "#" + near[k + 1 :] for k in range(0, 1200, 110)]
    texts += [texts[3], texts[3], texts[30], "z" * 1500, "ab" * 900, "y" * 399, "", None, "line\n" * 200, prose(20) * 12]
    rows = [(i if i % 9 else None, t, 1, "c") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h int, cid string").repartition(3)
    rows = collected(docs)
    want = sorted(zip((str(r["doc_id"]) for r in rows), plain([r["text"] for r in rows], 400)))
    out = collected(S.remove_repeats(docs, hot=hot, parts=parts))
    got = sorted((str(r["doc_id"]), (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in out)
    assert got == want
    assert all(r["n_removed"] in (0, r["n_bytes"]) or len(r["text"].encode()) <= r["n_bytes"] - r["n_removed"] + 6 * r["n_spans"] for r in out)
    assert not any(passage in r["text"] for r in out)


def test_long_texts_are_cut_with_overlap(spark, monkeypatch):
    monkeypatch.setattr(S, "_BATCH", 700)
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(900))
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(2500)) + passage + str(i) * 50 + "q" * i for i in range(3)]
    data = [t.encode() for t in texts]
    found = [S.window_anchors(p) for _, _, p in S._portions(data, 400)]
    assert sum(int((f[2] - f[1] + 1).sum()) for f in found) == sum(len(d) - 399 for d in data)


def test_awkward_documents(spark):
    docs = documents(spark)
    rows = collected(docs)
    want = sorted(zip((str(r["doc_id"]) for r in rows), plain([r["text"] if len(r["text"] or "") < 50_000 else r["text"][:3000] for r in rows], 400)))
    short = docs.selectExpr("doc_id", "CASE WHEN length(text) < 50000 THEN text ELSE substring(text, 1, 3000) END AS text", "size", "digest")
    got = sorted((str(r["doc_id"]), (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in collected(S.remove_repeats(short)))
    assert got == want
    whole = {r["doc_id"]: r for r in collected(S.remove_repeats(docs))}
    assert whole[309]["n_removed"] == 60_000 and whole[308]["n_removed"] == 100_000
    assert S.remove_repeats(documents(spark, empty=True)).count() == 0
