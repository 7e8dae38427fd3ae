"""Product codes against plain loops in exact integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from corpusloom.llm import vector_codes as V

from .fixtures import collected


def plain(rows):
    """Rows (vec_id, vector, label) -> list of (vec_id, code, error, label_error), digest."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], ""
    most = max(1, max(len(v) for _, v, _ in kept))
    width = -(-most // V.PARTS)
    ints = [[max(-V.LIMIT, min(V.LIMIT, math.floor(256 * x))) for x in v] + [0] * (width * V.PARTS - len(v)) for _, v, _ in kept]
    parts = [[x[p * width : (p + 1) * width] for p in range(V.PARTS)] for x in ints]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0))[:64]
    books = [[parts[k][p] for k in first] for p in range(V.PARTS)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x[p], c)), e) for e, c in enumerate(books[p])) for p in range(V.PARTS)] for x in parts]

    for _ in range(2):
        found = assign()
        for p in range(V.PARTS):
            for e in range(len(books[p])):
                own = [x[p] for x, f in zip(parts, found) if f[p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    found = assign()
    errors = [sum(d for d, _ in f) for f in found]
    out = []
    for (i, _, lab), f, error in zip(kept, found, errors):
        out.append((str(i), "".join(f"{e:02x}" for _, e in f), error, sum(e for e, (_, _, other) in zip(errors, kept) if other == lab)))
    return sorted(out), hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


def run(spark, rows):
    df = spark.createDataFrame([(i, v, lab, "x", 1) for i, v, lab in rows], "vec_id long, embedding array<float>, label int, code string, error int").repartition(3)
    rows = collected(V.encode(df))
    return sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"]) for r in rows), {r["codebooks_sha256"] for r in rows}


def vectors(n, width, seed=2):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.4) for _ in range(width)] for _ in range(9)]
    return [(i, [float(np.float32(c + rng.gauss(0, 0.1))) for c in rng.choice(centres)], rng.choice([None, 0, 1, 2])) for i in range(n)]


@pytest.mark.parametrize("width", [16, 64, 112])
def test_against_plain_loops(spark, width):
    rows = vectors(150, width)
    rows += [(900, rows[3][1], 1), (901, rows[3][1], None), (902, None, 1), (903, [*rows[0][1][:-1], None], 1), (904, [float("nan")] * width, 2), (905, [float("-inf"), *rows[0][1][1:]], 2)]
    rows += [(906, [0.0] * width, 0), (907, [1.0] * width, 0), (None, rows[5][1], 0)]
    want, digest = plain(rows)
    assert run(spark, rows) == (want, {digest})


def test_awkward_vectors(spark):
    rows = vectors(20, 20) + [(50, [], 1), (51, [0.5], 1), (52, [3e38] * 20, 4), (53, [-3e38] * 20, 4), (54, [1e-40, -1e-40], None)]
    want, digest = plain(rows)
    assert run(spark, rows) == (want, {digest})  # fewer rows than entries, unequal lengths, huge components
    assert run(spark, [(1, None, 1), (2, [None], None)]) == ([], set())
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert V.encode(empty).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and V.encode(empty).count() == 0
    assert run(spark, [(4, [], 1)])[0] == [("4", "00" * 16, 0, 0)]


@pytest.mark.parametrize("width", [1, 2, 3, 4, 5, 16, 100])
@pytest.mark.parametrize("scale", [1, 50, V.LIMIT])
def test_bounds_lose_nothing(width, scale):
    rng = np.random.default_rng(width)
    x = rng.integers(-scale, scale + 1, (3000, width))
    book = rng.integers(-scale, scale + 1, (64, width))
    book[40:44] = book[3:7]  # ties
    x[:50] = book[rng.integers(0, 64, 50)]
    every = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    tally = []
    index, distance = V.nearest(x, book, tally)
    assert index.tolist() == every.argmin(axis=1).tolist() and distance.tolist() == every.min(axis=1).tolist()
    if width >= 4 and width <= 16 and scale > 1:
        assert sum(k for _, k in tally) < 0.8 * sum(n for n, _ in tally)
