"""Real tokens: counts, ids with character offsets, and labels of loss spans, in Arrow batches.

The tokenizer is a file of the `tokenizers` library, given by its path; workers load it once. Texts are encoded whole.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.functions import arrow_udf, pandas_udf

IGNORED = -100
TOKENS = "ids array<int>, starts array<int>, ends array<int>"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _tokenizer(path: str | None):
    path = path or default_path()
    loaded = sys.__dict__.setdefault("_corpusloom_tokenizers", {})  # outlives one task of a worker
    if path not in loaded:
        from tokenizers import Tokenizer

        loaded[path] = Tokenizer.from_file(path)
        loaded[path].encode_special_tokens = True  # their strings in a text are ordinary text
    return loaded[path]


def encode(text: str, path: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, first characters and ends of a text's tokens."""
    e = _tokenizer(path).encode(text, add_special_tokens=False)
    places = np.array(e.offsets, np.int64).reshape(-1, 2)
    return np.array(e.ids, np.int64), places[:, 0], places[:, 1]


def token_count(x: Column, path: str | None = None) -> Column:
    @pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else len(encode(t, path)[0]) for t in texts], dtype="Int32")

    return count(x)


def within(prompt: Column, most: int, path: str | None = None, byte_level: bool = True) -> Column:
    """Whether a prompt has at most `most` tokens. A byte-level token holds at least a byte, so that short prompts need no encoding."""
    from pyspark.sql import functions as F

    short = F.lit(byte_level) & F.coalesce(F.octet_length(prompt) <= most, F.lit(False))
    return short | F.coalesce(token_count(F.when(~short, prompt), path) <= most, F.lit(False))


#: Texts whose tokens are numpy arrays at once.
PIECE = 64


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int32)))


def tokens(x: Column, path: str | None = None) -> Column:
    """Struct of ids, starts and ends (in characters)."""

    @arrow_udf(TOKENS)
    def run(texts: pa.Array) -> pa.Array:
        names, out = ["ids", "starts", "ends"], []
        for at in range(0, max(1, len(texts)), PIECE):
            parts = [encode(t or "", path) for t in texts[at : at + PIECE].to_pylist()]
            out.append(pa.StructArray.from_arrays([_lists([p[k] for p in parts]) for k in range(3)], names))
        return pa.concat_arrays(out)

    return run(x)


def labelled(rows: DataFrame, text: str, spans: str, path: str | None = None) -> DataFrame:
    """rows without text, with ids, starts, ends and labels of its tokens: each text is encoded once, and PIECE rows leave a task together."""
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    rest = [c for c in rows.columns if c != text]
    made = [StructField(c, ArrayType(IntegerType())) for c in ("ids", "starts", "ends", "labels")]
    schema = StructType([*(rows.schema[c] for c in rest), *made])

    def run(batches):
        for b in batches:
            for at in range(0, len(b), PIECE):
                part, every = b.slice(at, PIECE), []
                for t, own in zip(part.column(text).to_pylist(), part.column(spans).to_pylist()):
                    ids, starts, ends = encode(t or "", path)
                    low, high = (np.array([s[k] for s in own or []], np.int64) for k in ("start", "end"))
                    every.append((ids, starts, ends, span_labels(ids, starts, ends, low, high)))
                made = [_lists([e[k] for e in every]) for k in range(4)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *made], [*rest, "ids", "starts", "ends", "labels"])

    return rows.mapInArrow(run, schema)


def span_labels(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Ids of the tokens that lie within a span, IGNORED for the others; one pass over sorted spans and tokens.

    A token lies in a span that begins at or before it if the farthest end of those reaches its own.
    """
    order = np.argsort(low, kind="stable")
    reach = np.append(-1, np.maximum.accumulate(high[order])) if len(low) else np.array([-1])
    at = np.searchsorted(low[order], starts, "right")
    return np.where((ends > starts) & (reach[at] >= ends), ids, IGNORED)


def labels(text: Column, spans: Column, path: str | None = None, most: int | None = None) -> Column:
    """Struct of ids and labels of the text's tokens, by spans (struct of start and end, in characters); `most` cuts both."""

    @arrow_udf("ids array<int>, labels array<int>, truncated boolean")
    def run(texts: pa.Array, marked: pa.Array) -> pa.Array:
        names, out = ["ids", "labels", "truncated"], []
        for at in range(0, max(1, len(texts)), PIECE):
            every = []
            for t, own in zip(texts[at : at + PIECE].to_pylist(), marked[at : at + PIECE].to_pylist()):
                ids, starts, ends = encode(t or "", path)
                low, high = (np.array([s[k] for s in own or []], np.int64) for k in ("start", "end"))
                said = span_labels(ids, starts, ends, low, high)
                cut = len(ids) if most is None else most
                every.append((ids[:cut], said[:cut], len(ids) > cut))
            parts = [_lists([e[0] for e in every]), _lists([e[1] for e in every]), pa.array([e[2] for e in every], pa.bool_())]
            out.append(pa.StructArray.from_arrays(parts, names))
        return pa.concat_arrays(out)

    return run(text, spans)
