"""The toxicity classifier against a dense recomputation of its loss, and on the held-out labels of the given tables."""

import os

import numpy as np
import pytest

from corpusloom.llm import toxicity


def dense_loss(w, b, x, change, y, l2, fair):
    """The definition, over whole matrices."""
    z = x @ w + b
    losses = np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y * z
    swapped = (change != 0).any(axis=1).sum()
    return losses.mean() + l2 * (w**2).sum() + fair * ((change @ w) ** 2).sum() / max(1, swapped)


@pytest.mark.parametrize("fair", [0.0, 5.0])
def test_fit_minimises_the_stated_loss(fair):
    rng = np.random.default_rng(4)
    n, size, l2 = 60, 8, 2e-2
    x = rng.integers(0, 4, (n, size)).astype(float)
    change = np.where(rng.random((n, size)) < 0.15, rng.integers(-2, 3, (n, size)), 0).astype(float)
    y = (x @ rng.normal(0, 1, size) + rng.normal(0, 1, n) > 0).astype(float)

    def entries(m):
        r, c = np.nonzero(m)
        return r.astype(np.int32), c.astype(np.int32), m[r, c]

    w, b = toxicity.fit_arrays(entries(x), entries(change), y, size, l2, fair, 4000)
    at = dense_loss(w, b, x, change, y, l2, fair)
    step = 1e-5
    for k in range(size + 1):  # numeric gradient of the definition: nothing is left to gain
        up, down = np.append(w, b), np.append(w, b)
        up[k] += step
        down[k] -= step
        slope = (dense_loss(up[:-1], up[-1], x, change, y, l2, fair) - dense_loss(down[:-1], down[-1], x, change, y, l2, fair)) / (2 * step)
        assert abs(slope) < 2e-3
    for _ in range(200):  # convex: no other point is better
        other = np.append(w, b) + rng.normal(0, 0.3, size + 1)
        assert dense_loss(other[:-1], other[-1], x, change, y, l2, fair) > at - 1e-6


def test_held_out_labels_of_the_tables(spark):
    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic IS NOT NULL").select("doc_id", "toxic")
    rows = toxicity.op6_toxicity(spark, sf).where("held_out").join(labels, "doc_id").groupBy("toxic").agg({"predicted": "sum", "*": "count"}).collect()
    found = {r["toxic"]: (r["sum(predicted)"], r["count(1)"]) for r in rows}
    print(f"held out: {found[1][0]} of {found[1][1]} toxic found, {found[0][0]} of {found[0][1]} clean ones called toxic")
    assert found[1][0] >= 0.93 * found[1][1] and found[0][0] <= 0.01 * found[0][1]
