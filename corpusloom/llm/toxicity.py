"""Toxicity scores by a counterfactually regularised classifier.

Logistic regression over capped counts of words and of word beginnings (3 to 8 letters: inflected and
compound words share them). For each labelled text that names a group, a counterfactual
twin is made by swapping identity terms for their partners, and the squared change of the score that the
swap causes is added to the loss, so that a neutral mention of any group does not raise the score.

Labels come only from rows with crc32(doc_id as text) mod 4 <> 2. The fit uses at most `sample` labelled
documents (chosen by a hash of doc_id) and all features of that sample whose chi-squared reaches
LEAST_CHI, plus all identity terms; scoring reads every document whole. labels, lang, source and doc_id are
never inputs of a score.

Defined cases: a null or empty text has no words and gets the intercept's score; labels other than 0 and 1
are ignored, and of several labels for one doc_id the highest holds; without labels of both kinds the
score is the smoothed share of label 1; a null doc_id has no label and is not held out; repeated rows get
equal scores; an empty table gives an empty result; other columns are ignored or carried along.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import free_names, stage, table

SAMPLE = 20_000
CAP = 3
THRESHOLD = 0.3

#: Partners that a counterfactual swaps; each way.
PARTNERS = (
    ("women", "men"), ("woman", "man"), ("female", "male"), ("girls", "boys"), ("girl", "boy"), ("she", "he"), ("her", "his"),
    ("muslims", "christians"), ("muslim", "christian"), ("jews", "buddhists"), ("jewish", "buddhist"), ("islam", "christianity"),
    ("black", "white"), ("blacks", "whites"), ("african", "european"), ("asian", "american"), ("latino", "anglo"),
    ("gay", "straight"), ("gays", "straights"), ("lesbian", "heterosexual"), ("transgender", "cisgender"), ("queer", "hetero"),
    ("immigrants", "citizens"), ("immigrant", "citizen"), ("refugees", "residents"), ("refugee", "resident"),
    ("disabled", "abled"), ("deaf", "hearing"), ("blind", "sighted"), ("elderly", "young"), ("old", "youthful"),
    ("frauen", "männer"), ("frau", "mann"), ("ausländer", "inländer"), ("juden", "christen"), ("moslems", "katholiken"),
    ("femmes", "hommes"), ("femme", "homme"), ("juifs", "chrétiens"), ("musulmans", "catholiques"), ("noirs", "blancs"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("judíos", "cristianos"), ("musulmanes", "católicos"), ("negros", "blancos"),
)
SWAP = {a: b for x in PARTNERS for a, b in (x, x[::-1])}
PREFIXES = range(3, 9)
#: Chi-squared of one degree of freedom at p = 0.001: what a feature of the sample must reach.
LEAST_CHI = 10.83
#: Words whose features a worker remembers.
REMEMBERED = 1_000_000

_KEEP_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters."""
    return (text or "").lower().encode("utf-8", "replace").translate(_KEEP_LETTERS).decode().split()


def word_features(word: str) -> list[str]:
    """The word itself and its proper beginnings, which end in a hyphen."""
    return [word, *(f"{word[:n]}-" for n in PREFIXES if n < len(word))]


def text_features(counts: Counter, at: dict[str, int], seen: dict[str, tuple]) -> dict[int, int]:
    """Counts of the features in `at`. seen: what words gave before."""
    out: dict[int, int] = {}
    for w, n in counts.items():
        ids = seen.get(w)
        if ids is None:
            ids = tuple(at[f] for f in word_features(w) if f in at)
            if len(seen) < REMEMBERED:
                seen[w] = ids
        for k in ids:
            out[k] = out.get(k, 0) + n
    return out


def trainable(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(True))


class Model:
    def __init__(self, bias: float, weights: dict[str, float], cap: int = CAP):
        self.bias, self.cap = bias, cap
        self.at = {f: k for k, f in enumerate(sorted(weights))}
        self.weights = [weights[f] for f in sorted(weights)]

    def scores(self, texts) -> list[float]:
        out, seen = [], {}
        for t in texts:
            found = text_features(Counter(words(t)), self.at, seen)
            z = self.bias + sum(self.weights[k] * min(n, self.cap) for k, n in sorted(found.items()))
            out.append(1 / (1 + math.exp(-max(-40.0, min(40.0, z)))))
        return out

    def udf(self):
        @pandas_udf("double")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series(self.scores(texts), dtype="float64")

        return run


def _entries(ks, vs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of every entry of two list columns (Arrow), without Python objects for them."""
    ks, vs = ks.combine_chunks(), vs.combine_chunks()
    lengths = np.diff(np.asarray(ks.offsets))
    return np.repeat(np.arange(len(ks), dtype=np.int32), lengths), np.asarray(ks.flatten()), np.asarray(vs.flatten())


def fit_arrays(x: tuple, change: tuple, y: np.ndarray, size: int, l2: float, fair: float, steps: int):
    """Minimise mean logistic loss + l2 |w|^2 + fair * mean (change . w)^2 by Adam, deterministically.

    x, change: entries (row, column, value) of the counts and of what the swaps change in them.
    """
    (r, c, v), (r2, c2, v2) = x, change
    swapped = len(np.unique(r2))
    n, w, b = len(y), np.zeros(size), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    m, s = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(r, v * w[c], n)
        e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
        g = np.bincount(c, v * e[r], size) + 2 * l2 * w
        if len(r2):
            d = np.bincount(r2, v2 * w[c2], n)
            g += np.bincount(c2, v2 * d[r2], size) * (2 * fair / max(1, swapped))
        grad = np.append(g, e.sum())
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
        move = 0.1 * (1 - t / steps * 0.9) * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least_chi: float = LEAST_CHI, l2: float = 2e-4, fair: float = 5.0, steps: int = 400) -> Model:
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & trainable(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = stage(chosen.select(F.col("doc_id").alias("label_id"), "toxic"), "labelled").df  # at most `sample` rows
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    rows = stage(rows.select("doc_id", "text", "toxic"), "sample").df

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, list[int]] = {}

        def send() -> Iterator[pd.DataFrame]:
            names = list(total)
            for k in range(0, len(names), 20_000):
                part = names[k : k + 20_000]
                yield pd.DataFrame({"word": part, "n": [total[w][0] for w in part], "pos": [total[w][1] for w in part]})
            total.clear()

        for b in batches:
            for text, toxic in zip(b["text"], b["toxic"]):
                for w in {f for w in set(words(text)) for f in word_features(w)}:
                    both = total.setdefault(w, [0, 0])
                    both[0] += 1
                    both[1] += int(toxic)
                if len(total) > 400_000:
                    yield from send()
        yield from send()

    counts = rows.mapInPandas(count, "word string, n long, pos long")
    counts = counts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    n, pos = rows.agg(F.count("*"), F.sum("toxic")).first()
    pos = int(pos or 0)
    if not 0 < pos < n:
        share = (pos + 1) / (n + 2)
        return Model(float(np.log(share / (1 - share))), {})
    a = F.col("pos").cast("double")
    expect = F.col("n") * (pos / n)
    chi = (a - expect) * (a - expect) / (expect * (1 - pos / n) * (1 - F.col("n") / (n + 1.0)))
    top = counts.select("word", chi.alias("chi")).where(F.col("chi") >= least_chi).collect()
    names = sorted({t.word for t in top} | set(SWAP))
    at = {w: k for k, w in enumerate(names)}

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, tuple] = {}
        for b in batches:
            out = []
            for text in b["text"]:
                own = Counter(words(text))
                twin = Counter()
                if own.keys() & SWAP.keys():
                    for w, n in own.items():
                        twin[SWAP.get(w, w)] += n
                x = {k: float(min(n, CAP)) for k, n in text_features(own, at, seen).items()}
                z = {k: float(min(n, CAP)) for k, n in text_features(twin, at, seen).items()} if twin else x
                d = {k: x.get(k, 0.0) - z.get(k, 0.0) for k in sorted(x.keys() | z.keys()) if x.get(k) != z.get(k)}
                out.append((list(x), list(x.values()), list(d), list(d.values())))
            cols = list(zip(*out)) or [[], [], [], []]
            yield pd.DataFrame({"doc_id": b["doc_id"], "toxic": b["toxic"], "k": cols[0], "v": cols[1], "dk": cols[2], "dv": cols[3]})

    data = rows.mapInPandas(encode, "doc_id long, toxic int, k array<int>, v array<double>, dk array<int>, dv array<double>").toArrow()
    data = data.take(np.lexsort([[len(k) for k in data["k"]], data["doc_id"].to_numpy()]))
    y = data["toxic"].to_numpy().astype(float)
    w, bias = fit_arrays(_entries(data["k"], data["v"]), _entries(data["dk"], data["dv"]), y, len(names), l2, fair, steps)
    return Model(bias, {name: float(v) for name, v in zip(names, w)})


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    score = model.udf()(F.col("text"))
    return docs.select("doc_id", (~trainable(F.col("doc_id"))).alias("held_out"), score.alias("score")).select(
        "*", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def clean_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model does not call toxic, with all their columns."""
    (score,) = free_names(docs, "__cl_score")
    return docs.withColumn(score, model.udf()(F.col("text"))).where(F.col(score) < THRESHOLD).drop(score)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
