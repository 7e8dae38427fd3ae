"""Very long documents, large and null ids, clashing column names."""

import time
import zlib

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import line_dedup, mixing, packing, simhash, toxicity

from .fixtures import collected, documents


def test_packing_keeps_large_and_null_ids(spark):
    big = 1 << 53
    rows = [(None, "alpha beta"), (big + 1, "gamma"), (big + 3, "delta epsilon zeta"), (None, None), (-(1 << 63), "eta"), ((1 << 63) - 1, "theta")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    encode = packing.encoder()
    want = sorted((str(d), zlib.crc32(np.append(encode(t or ""), 0).astype("<u4").tobytes())) for d, t in rows)
    pieces = collected(packing.pack(docs))
    whole = [p for p in pieces if p["length"] == p["doc_tokens"]]
    assert sorted({str(p["doc_id"]) for p in pieces}) == sorted({d for d, _ in want})
    assert {(str(p["doc_id"]), p["ids_crc32"]) for p in whole} <= set(want) and len(whole) >= 3
    assert sum(p["length"] for p in pieces) == sum(len(encode(t or "")) + 1 for _, t in rows)


def test_a_document_of_a_million_lines(spark):
    n = 1_000_000
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: F.concat(F.lit("l"), F.when(x % 2 == 0, F.lit(0)).otherwise(x).cast("string"))), "\n")
    docs = spark.range(1).select(F.col("id").alias("doc_id"), text.alias("text"))
    began = time.time()
    row = line_dedup.deduplicate_lines(docs).first()
    assert (row["__cl_lines"], row["__cl_gone"]) == (n, n // 2 - 1) and row["text"].startswith("l1\nl0\nl3\nl5\n") and row["text"].count("\n") == n // 2
    assert time.time() - began < 120


def test_clashing_names(spark):
    docs = documents(spark)
    for name in ("__cl_hash", "__CL_id", "__cl_th", "__cl_no", "__cl_lines", "__cl_gone", "__cl_n", "__cl_m", "__cl_k", "__cl_own", "__cl_copy", "__cl_source", "__cl_score"):
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    own = [c for c in docs.columns if c.lower().startswith("__cl_")]
    model = toxicity.Model(-9.0, {})
    for run in (line_dedup.rewritten_documents, simhash.deduplicate_similar, simhash.deduplicate, mixing.mixed_documents, lambda d: toxicity.clean_documents(d, model)):
        out = run(docs)
        assert out.columns == docs.columns and out.count() > 0
        assert out.where(" AND ".join(f"{c} = 'own {c}'" for c in own)).count() == out.count()
