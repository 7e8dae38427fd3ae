"""SimHash near-duplicates, found exactly through vantage-point trees over Hamming distance.

A fingerprint has 64 bits over the word shingles of a text: a bit is 1 if it is set in over half of the
shingles' XXH64 hashes. Documents link where fingerprints differ in at most `radius` bits; a component
is what links reach. Distinct fingerprints (not documents) are routed down a tree of vantage points that
is fitted on a bounded sample. Each lands in one home leaf. A fingerprint just outside a ball also visits
its inside, which the triangle bound makes sufficient: pairs that a sphere parts differ by at most
`radius` in their distance to its centre. A leaf that holds too much gets a tree of its own, fitted on a
sample of the leaf, and its rows stream through that tree from several partitions; this repeats until leaves
are small or nothing parts them. In a leaf all pairs of members and visitors are compared, with
further splits where a leaf is large, and a spanning forest leaves it: never all pairs of a group.

Defined cases: a null or empty text has fingerprint zero and links like any other; fewer words than a
shingle has make one shingle of the whole sequence; a null doc_id never becomes a component's id unless
nothing else is there. Repeated rows get equal results. Other columns are ignored or carried along.

`deduplicate_near` serves the pipeline: documents link where fingerprints of three-word shingles differ in at most
2 bits, by the trees, and also where the Jaccard similarity of their five-word shingles is at least 0.8. Fingerprints of
the latter pairs differ in up to about 20 of 64 bits, a radius at which balls part nothing (unrelated ones differ
by 32, standard deviation 4), so that they are found besides by MinHash bands, as in line_dedup, and every
such link is checked exactly. Texts without a word are equal.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import connected_components, free_names, stage, table
from .line_dedup import similar_lines

#: Fingerprints in the sample that the routing tree is fitted on, at most.
SAMPLE = 20_000
#: Members that a leaf should have; leaves with over four times as many are parted by trees of their own.
LEAF = 4096
#: Fingerprints in the sample of one leaf, about.
LEAF_SAMPLE = 2000
#: Rows of a leaf that one partition streams through the leaf's tree, about.
SPREAD = 500_000


def word_sequence(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], width: int) -> list[int]:
    """XXH64 of every `width` words in a row, or of the whole sequence if it has fewer."""
    h = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= width:
        return [h(joined, 42)]
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    return [h(joined[a : b - 1], 42) for a, b in zip(starts, starts[width:])]


def fingerprint(text: str | None, width: int = 3) -> int:
    words = word_sequence(text)
    if not words:
        return 0
    hashes = shingle_hashes(words, width)
    counts = np.zeros(64, np.int64)
    every = np.array(hashes, np.uint64)
    for k in range(0, len(every), 8192):
        part = every[k : k + 8192]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > len(every)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprint_udf(width: int = 3):
    @pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return run


# -- vantage-point trees -------------------------------------------------------------------------------


def _choose(points: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[int, int] | None:
    """A vantage point and a ball size near the middle with few points in the shell that must visit."""
    best = None
    for v in rng.choice(points, size=min(16, len(points)), replace=False):
        hist = np.bincount(np.bitwise_count(points ^ v), minlength=65 + radius)
        inside = np.cumsum(hist)
        for mu in range(64):
            share = inside[mu] / len(points)
            if 0.2 <= share <= 0.8:
                shell = (inside[min(64, mu + radius)] - inside[mu]) / len(points)
                cost = shell + 0.6 * abs(share - 0.5)
                if best is None or cost < best[0]:
                    best = (cost, int(v), mu)
    return best and best[1:]


def build_tree(points: np.ndarray, leaves: int, radius: int, seed: int = 7):
    """Nested (vantage, mu, inside, outside) with integer leaves, fitted on sampled fingerprints."""
    rng, count = np.random.default_rng(seed), iter(range(1 << 30))

    def grow(pts: np.ndarray, want: float):
        pick = _choose(pts, radius, rng) if want > 1 and len(pts) >= 8 else None
        if pick is None:
            return next(count)
        v, mu = pick
        near = np.bitwise_count(pts ^ np.uint64(v)) <= mu
        part = near.mean()
        return (v, mu, grow(pts[near], want * part), grow(pts[~near], want * (1 - part)))

    return grow(points, leaves)


def route(tree, points: np.ndarray, radius: int, own: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, indices, is home) for all points: each is at home once and visits where pairs may cross.

    own: which points are at home in the tree; the others only visit. Default: all.
    """
    todo = [(tree, np.arange(len(points)), np.ones(len(points), bool) if own is None else own)]
    while todo:
        node, at, home = todo.pop()
        if not len(at):
            continue
        if not isinstance(node, tuple):
            yield node, at, home
            continue
        v, mu, inner, outer = node
        d = np.bitwise_count(points[at] ^ np.uint64(v)).astype(np.int16)
        into = d <= mu + radius
        todo.append((inner, at[into], home[into] & (d[into] <= mu)))
        out = np.where(home, d > mu, d > mu - radius)
        todo.append((outer, at[out], home[out]))


def spanning_links(members: np.ndarray, visitors: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges (fingerprint, root) that connect what pairs with a member within radius connect."""
    points = np.concatenate([members, visitors])
    label = np.arange(len(points))

    def search(home: np.ndarray, guest: np.ndarray, seed: int) -> None:
        pick = None
        if len(home) > LEAF:
            pick = _choose(points[home[:: max(1, len(home) // 2000)]], radius, np.random.default_rng(seed))
        if pick:
            v, mu = np.uint64(pick[0]), pick[1]
            dh, dg = (np.bitwise_count(points[x] ^ v).astype(np.int16) for x in (home, guest))
            shell = home[(dh > mu) & (dh <= mu + radius)]
            search(home[dh <= mu], np.concatenate([shell, guest[dg <= mu + radius]]), seed + 1)
            search(home[dh > mu], guest[dg > mu - radius], seed + 2)
            return
        every = np.concatenate([home, guest])
        for k in range(len(home)):
            near = every[k + 1 :][np.bitwise_count(points[every[k + 1 :]] ^ points[home[k]]) <= radius]
            if len(near):
                old = np.unique(label[near])
                low = min(old[0], label[home[k]])
                for x in (*old, label[home[k]]):
                    if x != low:
                        label[label == x] = low

    search(np.arange(len(members)), np.arange(len(members), len(points)), 1)
    moved = np.flatnonzero(label != np.arange(len(points)))
    return [(int(points[i]), int(points[label[i]])) for i in moved]


def part_leaves(sent: DataFrame, radius: int, leaf: int, seed: int) -> DataFrame | None:
    """sent with large leaves parted by trees of their own; None if no leaf is large and can be parted.

    sent: staged (leaf, fp, home). No leaf is gathered: a bounded sample of each fits its tree, and its rows
    follow the tree through SPREAD-sized partitions, in a stream.
    """
    sizes = sent.groupBy("leaf").agg(F.count("*").alias("n"), F.count_if("home").alias("members")).where(F.col("members") > 4 * leaf)
    sizes = stage(sizes, "sizes").df
    if sizes.isEmpty():
        return None
    lot = F.pmod(F.xxhash64("fp", F.lit(seed)), F.col("members"))
    drawn = sent.where("home").join(sizes, "leaf").where(lot < LEAF_SAMPLE)

    def fit(b: pd.DataFrame) -> pd.DataFrame:
        points = np.sort(b["fp"].to_numpy(np.int64).view(np.uint64))
        tree = build_tree(points, -(-int(b["members"].iloc[0]) // leaf), radius)
        rows = [(b["leaf"].iloc[0], b["n"].iloc[0], pickle.dumps(tree))] if isinstance(tree, tuple) else []
        return pd.DataFrame(rows, columns=["leaf", "n", "tree"])

    trees = stage(drawn.groupBy("leaf").applyInPandas(fit, "leaf string, n long, tree binary"), "trees").df
    if trees.isEmpty():
        return None
    shares = F.floor(F.col("n") / SPREAD).cast("int")
    points = sent.join(trees.select("leaf", "n"), "leaf")
    points = points.select("leaf", F.pmod(F.xxhash64("fp"), shares + 1).cast("int").alias("share"), "fp", "home", F.lit(None).cast("binary").alias("tree"))
    heads = trees.select("leaf", F.explode(F.sequence(F.lit(0), shares)).alias("share"), F.lit(0).cast("long").alias("fp"), F.lit(False).alias("home"), "tree")
    rows = points.unionByName(heads).repartition("leaf", "share").sortWithinPartitions("leaf", "share", F.col("tree").isNull())

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = tree = None
        for b in batches:
            fps, home = b["fp"].to_numpy(np.int64).view(np.uint64), b["home"].to_numpy(bool)
            heads = np.flatnonzero(b["tree"].notna())
            for a, e in zip([-1, *heads], [*heads, len(b)]):
                if a >= 0:
                    name, tree = b["leaf"].iloc[a], pickle.loads(b["tree"].iloc[a])
                part, own = fps[a + 1 : e], home[a + 1 : e]
                if len(part):
                    for k, at, mine in route(tree, part, radius, own):
                        yield pd.DataFrame({"leaf": f"{name}.{k}", "fp": part[at].view(np.int64), "home": mine})

    parted = rows.mapInPandas(send, "leaf string, fp long, home boolean")
    return stage(parted.unionByName(sent.join(trees, "leaf", "left_anti")), "leaves").df


def fingerprint_components(fps: DataFrame, radius: int = 2, leaf: int = LEAF, sample: int = SAMPLE):
    """Staged (node, root) over distinct fingerprints (column fp, long, unique) that have a link."""
    total = fps.count()
    share = min(1.0, sample / max(1, total))
    keep = F.pmod(F.xxhash64(F.col("fp"), F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30))
    drawn = np.array([r.fp for r in fps.where(keep).limit(2 * sample).collect()], np.int64).view(np.uint64)
    tree = build_tree(np.sort(drawn), max(1, -(-total // leaf)), radius) if len(drawn) else 0

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            points = b["fp"].to_numpy(np.int64).view(np.uint64)
            for k, at, home in route(tree, points, radius):
                yield pd.DataFrame({"leaf": str(k), "fp": points[at].view(np.int64), "home": home})

    def search(b: pd.DataFrame) -> pd.DataFrame:
        points, home = b["fp"].to_numpy(np.int64).view(np.uint64), b["home"].to_numpy(bool)
        found = spanning_links(points[home], points[~home], radius)
        return pd.DataFrame(np.array(found, np.uint64).reshape(-1, 2).view(np.int64), columns=["u", "v"])

    sent = stage(fps.select("fp").mapInPandas(send, "leaf string, fp long, home boolean"), "leaves").df
    seed = 1
    while (finer := part_leaves(sent, radius, leaf, seed)) is not None:
        sent, seed = finer, seed + 1
    return connected_components(sent.groupBy("leaf").applyInPandas(search, "u long, v long"))


def near_groups(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp, component_id of every row of docs."""
    base = stage(docs.select("doc_id", fingerprint_udf(width)("text").alias("fp")), "fingerprints").df
    fps = stage(base.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct").df
    parts = fingerprint_components(fps, radius).df
    named = fps.join(parts, fps.fp == parts.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return base.join(named.join(lows, "root").select("fp", "component_id"), "fp")


def deduplicate(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row with the smallest doc_id.

    Between rows with one doc_id the smaller (fingerprint, text hash) stays; of equal rows one.
    """
    base = docs.select("doc_id", F.xxhash64("text").alias("th"), fingerprint_udf(width)("text").alias("fp"))
    base = stage(base, "fingerprints").df
    me = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "th")
    fps = stage(base.groupBy("fp").agg(F.min(me).alias("low"), F.count("*").alias("n")), "distinct").df
    parts = fingerprint_components(fps, radius).df
    named = fps.join(parts, fps.fp == parts.node, "left").select("low", "n", F.coalesce("root", "fp").alias("root"))
    return _kept(docs, base, named.groupBy("root").agg(F.min("low").alias("low")))


def _kept(docs: DataFrame, base: DataFrame, stay: DataFrame) -> DataFrame:
    """The rows of docs that stay (low: doc_id, th) names, equal ones once. base: doc_id, th of all rows, staged."""
    own, th_, hash_ = free_names(docs, "__cl_id", "__cl_th", "__cl_hash")
    stay = stage(stay.select(F.col("low.doc_id").alias(own), F.col("low.th").alias(th_)), "keepers").df
    out = docs.withColumn(hash_, F.xxhash64("text"))
    out = out.join(stay, out["doc_id"].eqNullSafe(stay[own]) & (out[hash_] == stay[th_]), "left_semi")
    if not base.groupBy("doc_id", "th").count().where("count > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", hash_])
    return out.drop(hash_)


def _sequence_udf():
    @pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([xxhash.xxh3_128_digest(b" ".join(word_sequence(t))) for t in texts], dtype="object")

    return run


def _word_shingles(width: int) -> Callable:
    def run(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        every = [shingle_hashes(words, width) if words else [] for words in map(word_sequence, texts)]
        return np.array([h for own in every for h in own], np.uint64), np.array([len(own) for own in every], np.int64)

    return run


def deduplicate_near(docs: DataFrame, width: int = 3, radius: int = 2, similar_width: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row with the smallest doc_id.

    Documents link where their fingerprints (`width` words) differ in at most `radius` bits, or where the Jaccard
    similarity of their shingles of `similar_width` words reaches the threshold. Between rows with one doc_id the
    smaller text hash stays; of equal rows one.
    """
    return _deduplicate(docs, similar_width, threshold, (width, radius))


def deduplicate_similar(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """As deduplicate_near, by the Jaccard similarity alone."""
    return _deduplicate(docs, width, threshold, None)


def _deduplicate(docs: DataFrame, similar_width: int, threshold: float, prints: tuple[int, int] | None) -> DataFrame:
    fp = fingerprint_udf(prints[0])("text") if prints else F.lit(0).cast("long")
    base = stage(docs.select("doc_id", F.xxhash64("text").alias("th"), _sequence_udf()("text").alias("words"), fp.alias("fp")), "sequences").df
    me = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    # equal sequences of words have equal fingerprints
    kinds = base.groupBy("words").agg(F.min(me).alias("low"), F.count("*").alias("n"), F.min("fp").alias("fp"))
    # numbers in falling order of frequency (by powers of two), so that a bucket's first text is a frequent one
    rare = F.lit(63).cast("long") - F.floor(F.log2("n")).cast("long")
    kinds = stage(kinds.select(F.shiftleft(rare, 57).bitwiseOR(F.monotonically_increasing_id()).alias("lid"), "low", "fp"), "distinct").df
    named = kinds.select("lid", F.col("low.doc_id").alias("__cl_id"), F.col("low.th").alias("__cl_th"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("line"))
    texts = texts.join(named, texts.doc_id.eqNullSafe(named["__cl_id"]) & (texts.th == named["__cl_th"]))
    texts = stage(texts.dropDuplicates(["lid"]).select("lid", "line"), "texts").df
    parts = similar_lines(texts, threshold, _word_shingles(similar_width))
    if prints:
        fps = stage(kinds.groupBy("fp").agg(F.min("lid").alias("first")), "prints").df
        near = fingerprint_components(fps, prints[1]).df
        groups = fps.join(near, fps.fp == near.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
        firsts = groups.groupBy("root").agg(F.min("first").alias("v"))
        links = kinds.join(groups.join(firsts, "root").select("fp", "v"), "fp").where("lid <> v").select(F.col("lid").alias("u"), "v")
        parts = connected_components(links.unionByName(parts.select(F.col("node").alias("u"), F.col("root").alias("v")))).df
    roots = kinds.join(parts.withColumnRenamed("node", "lid"), "lid", "left").select("low", F.coalesce("root", "lid").alias("root"))
    return _kept(docs, base, roots.groupBy("root").agg(F.min("low").alias("low")))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
