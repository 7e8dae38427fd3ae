"""Each stage of the pipeline against a plain version on that stage's own input."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from corpusloom.llm import packing, toxicity

from .fixtures import SCHEMA, collected, documents
from .test_near_dedup import Forest, plain_fingerprint, plain_lines
from .test_operators import labelled


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    docs, labels = labelled(spark, 120)
    docs = docs.where("doc_id IS NOT NULL").selectExpr("doc_id + 1000 AS doc_id", "text")
    labels = labels.where("doc_id IS NOT NULL").selectExpr("doc_id + 1000 AS doc_id", "quality", "toxic")
    base = documents(spark)
    extra = docs.selectExpr("doc_id", "text", "'en' AS lang", "'s1' AS source", "CAST(length(text) AS BIGINT) AS n_chars", "7L AS size", "0.5D AS score", "'d' AS digest", "1L AS fp", "'n' AS node")
    base.unionByName(extra).write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    return str(d)


def keyed(rows):
    return Counter((str(r["doc_id"]), str(r["text"]), str(r["source"])) for r in rows)


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    inputs, outputs = [], []
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        inputs.append(collected(docs))
        f(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        outputs.append(collected(docs))
        if k < 4:
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]

    model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert keyed(outputs[0]) == keyed(r for r in inputs[0] if model.scores([r["text"]])[0] < 0.3)
    assert 0 < len(inputs[0]) - len(outputs[0]) <= 60

    assert keyed(outputs[1]) == keyed({**r, "text": t} for r, t in zip(inputs[1], plain_lines(inputs[1])))
    assert all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) for r in outputs[1])

    forest, prints = Forest(), [plain_fingerprint(r["text"]) for r in inputs[2]]
    for i in range(len(prints)):
        for j in range(i + 1):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                forest.join(i, j)
    lowest = defaultdict(list)
    for i, r in enumerate(inputs[2]):
        lowest[forest.find(i)].append((r["doc_id"] is None, r["doc_id"] or 0))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in outputs[2]) == sorted(min(v) for v in lowest.values())

    words = lambda rows: sum(len((r["text"] or "").encode().split()) for r in rows)
    assert abs(words(outputs[3]) - words(inputs[3])) < 0.35 * words(inputs[3])  # whole documents only, on tiny sources
    assert set(keyed(outputs[3])) <= set(keyed(inputs[3])) and max(keyed(outputs[3]).values()) <= 4

    encode = packing.encoder()
    tokens = sum(len(encode(r["text"] or "")) + 1 for r in inputs[4])
    assert tokens == sum(r["length"] for r in outputs[4])
    bodies = defaultdict(list)
    for r in inputs[4]:
        bodies[r["doc_id"]].append(np.append(encode(r["text"] or ""), np.uint32(0)).astype("<u4"))
    for r in outputs[4]:
        assert any(zlib.crc32(b[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for b in bodies[r["doc_id"]])


def test_run_is_the_stages_in_order(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "mixing", "packing"]
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_near_dedup_against_all_pairs(spark):
    """Copies with replaced words at a five-word Jaccard similarity of 0.75 to 1, none of them equal."""
    rng = random.Random(11)
    texts, share = [], []
    for n, most in [(100, 4), (300, 10), (1000, 30)] * 20:
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        texts.append(base)
        for edits in (most // 2, most):
            copy = list(base)
            for at in rng.sample(range(n), edits):
                copy[at] = f"v{rng.randrange(10**6)}"
            texts.append(copy)
    hub = [f"h{k}" for k in range(200)]
    texts += [[*hub[: k % 7], f"x{k}", *hub[k % 7 :]] for k in range(60)]  # one large group
    texts += [[], [], ["one"], ["ONE"], ["one", "two"]]
    grams = [{tuple(w.lower() for w in t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    forest = Forest()
    for i, a in enumerate(grams):
        for j in range(i):
            both = len(a & grams[j])
            similarity = both / (len(a) + len(grams[j]) - both)
            if similarity >= 0.8:
                forest.join(i, j)
                share.append(similarity)
    assert sum(s < 0.95 for s in share) > 60
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = sorted(r["doc_id"] for r in collected(corpus_pipeline.dedup_near(spark, docs, "")))
    assert got == [i for i in range(len(texts)) if forest.find(i) == i]


def test_near_dedup_goes_by_fingerprints_too(spark):
    """Texts under a similarity of 0.8 whose fingerprints differ in at most 2 bits: one of each pair stays."""
    from corpusloom.llm import simhash

    rng = random.Random(5)
    pairs = []
    while len(pairs) < 4:
        a = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        b = [f"v{k}" if k in (15, 40) else w for k, w in enumerate(a)]
        x, y = (simhash.fingerprint(" ".join(t)) for t in (a, b))
        if ((x ^ y) & (1 << 64) - 1).bit_count() <= 2:
            pairs.append((a, b))
    rows = [(2 * k + n, " ".join(t)) for k, p in enumerate(pairs) for n, t in enumerate(p)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert simhash.deduplicate_similar(docs).count() == len(rows)
    assert sorted(r["doc_id"] for r in collected(corpus_pipeline.dedup_near(spark, docs, ""))) == [0, 2, 4, 6]
