"""Decontamination against plain loops over all windows and all places."""

import hashlib
import random
import re

import numpy as np
import pytest

from corpusloom.llm import decontamination as D
from corpusloom.llm.terms import terms

from .fixtures import collected, documents

PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_terms(text):
    return PLAIN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_row(text, tests, window=10):
    words, hit, items = plain_terms(text), set(), set()
    for item, t in tests:
        own = plain_terms(t)
        w = min(window, len(own))
        wins = {tuple(own[k : k + w]) for k in range(len(own) - w + 1)} if w else set()
        at = [k for k in range(len(words) - w + 1) if w and tuple(words[k : k + w]) in wins]
        hit.update(x for k in at for x in range(k, k + w))
        if at and item is not None:
            items.add(item)
    digest = hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
    return len(words), len(hit), len(items), digest, bool(hit)


def sample():
    rng = random.Random(8)
    words = ["ab", "cé", "D9", "eF", "gh", "ij", "kl"]

    def prose(n):
        return " ".join(rng.choice(words) + rng.choice(["", ",", ".\n", "_"]) for _ in range(n))

    tests = [(i, prose(rng.randint(8, 40))) for i in range(30)]
    tests += [(100, tests[0][1]), (0, prose(12)), (None, prose(15)), (101, "zz yy"), (102, "solo"), (103, ""), (104, None), (105, "ab " * 40), (106, "ab " * 9), (107, " . "), (11, tests[11][1].upper())]
    texts = [prose(rng.randint(0, 60)) for _ in range(20)]
    texts += [f"{prose(9)} {tests[k][1]} {prose(5)}" for k in (0, 3, 3, 31, 32)] + [" ".join(tests[k][1].split()[2:14]) for k in range(12)]
    texts += [" ".join(tests[4][1].split()[:9]), "AB-" * 300, "yy zz yy", "SOLO!", "", None, "zz\x00yy", f"{tests[5][1]} {tests[6][1]}"]
    return texts, tests


def tables(spark):
    texts, tests = sample()
    docs = spark.createDataFrame([(i if i % 7 else None, t, 3, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, items string")
    return docs.repartition(3), spark.createDataFrame(tests, "item_id long, text string")


@pytest.mark.parametrize("block_bytes", [D.BLOCK_BYTES, 300])
def test_contamination(spark, block_bytes):
    docs, tests = tables(spark)
    rows = collected(D.contamination(docs, tests, block_bytes=block_bytes))
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows)
    pairs = sample()[1]
    assert got == sorted((str(r["doc_id"]), *plain_row(r["text"], pairs)) for r in collected(docs))
    assert 20 < sum(r["contaminated"] for r in rows) < len(rows)


@pytest.mark.parametrize("block_bytes", [D.BLOCK_BYTES, 300])
def test_decontaminate(spark, block_bytes):
    docs, tests = tables(spark)
    pairs = sample()[1]
    want = sorted(str(r) for r in collected(docs) if not plain_row(r["text"], pairs)[4])
    assert sorted(map(str, collected(D.decontaminate(docs, tests, block_bytes=block_bytes)))) == want


@pytest.mark.parametrize(("block_bytes", "least"), [(D.BLOCK_BYTES, 1), (500, 6)])
def test_longest_matches(spark, block_bytes, least):
    docs, tests = tables(spark)
    texts = [(r["doc_id"], plain_terms(r["text"])) for r in collected(docs)]
    want = set()
    for item, t in sample()[1]:
        own = plain_terms(t)
        for j in range(len(own)):
            best = None
            for doc, words in texts:
                for p in range(len(words)):
                    n = 0
                    while j + n < len(own) and p + n < len(words) and own[j + n] == words[p + n]:
                        n += 1
                    key = (-n, doc is None, doc or 0, p)
                    best = key if n >= least and (best is None or key < best) else best
            if best:
                want.add((j, -best[0], None if best[1] else best[2], best[3]))
    rows = collected(D.longest_matches(docs, tests, least, block_bytes))
    assert {(r["word"], r["n_words"], r["doc_id"], r["at"]) for r in rows} == want


def test_long_texts_in_portions(monkeypatch):
    texts, tests = sample()
    block = D.Tests([(i, (t or "").encode()) for i, t in tests])
    data = [" ".join(t or "" for t in texts).encode(), *[(t or "").encode() for t in texts]]

    def judged():
        return [(n, spans.tolist(), items.tolist()) for n, spans, items in D.Judge(block).judge(data)]

    whole = judged()
    for size in (40, 700):
        monkeypatch.setattr(D, "PORTION", size)
        assert judged() == whole


@pytest.mark.parametrize("vocabulary", [2, 5, 300, 70_000])
def test_suffix_arrays(vocabulary):
    rng = np.random.default_rng(vocabulary)
    bits = vocabulary.bit_length()
    ids = rng.integers(0, vocabulary + 1, 3000).astype(np.uint32)
    ids[500:900] = ids[1500:1900]
    ids[2000:2100] = 1
    ids[-1] = 0
    seq = D.Sequence(ids, bits)
    at = np.flatnonzero(ids)
    array = D.suffix_array(seq, at, 5000)
    runs = [ids[k : k + seq.run[k]].tolist() for k in array]
    assert runs == sorted(runs) and sorted(array) == at.tolist()
    q = rng.choice(at, 200)
    width = rng.integers(1, 12, 200)
    lo, hi = D.place(seq, array, seq, q, width), D.place(seq, array, seq, q, width, after=True)
    for k, w, a, b in zip(q, width, lo, hi):
        head = ids[k : k + min(w, seq.run[k])].tolist()
        head += [0] * (w - len(head))
        same = [i for i, r in enumerate(runs) if (r + [0] * w)[:w] == head]
        assert same == list(range(a, b))
    other = rng.choice(at, 200)
    sign, shared = D.compare(seq, other, seq, q, width)
    for x, y, w, s, n in zip(other, q, width, sign, shared):
        a, b = (ids[k : k + seq.run[k]].tolist()[:w] for k in (x, y))
        both = next((i for i, (c, d) in enumerate(zip(a, b)) if c != d), min(len(a), len(b)))
        assert (s, n) == ((a > b) - (a < b), both)


def test_terms_are_the_pattern():
    text = "".join(map(chr, range(1, 0x250))) + " ǅ 漢字 x y"
    assert [w.decode() for w in terms(text.encode())] == plain_terms(text)


def test_awkward_documents(spark):
    docs, tests = documents(spark), tables(spark)[1]
    n = docs.count()
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(docs, none).where("NOT contaminated AND n_items = 0").count() == n
    assert D.contamination(documents(spark, empty=True), tests).count() == 0
    assert D.longest_matches(docs, none).count() == 0
    own = D.contamination(docs, docs.selectExpr("doc_id AS item_id", "text"))
    assert own.where("n_words > 0 AND n_hit < n_words").count() == 0
    assert D.decontaminate(docs, docs.selectExpr("doc_id AS item_id", "text")).where("text IS NOT NULL").count() == docs.where(r"NOT text RLIKE '[0-9a-zA-Z]|[^\\x00-\\x7F]'").count()
