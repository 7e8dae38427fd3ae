"""Batch calls of an outside model over HTTP: every prompt gets a reply, or a row that says what went wrong.

Prompts go out as {"prompts": [...]} in batches; {"replies": [...]} of the same length comes back. A batch with another
length, a status that does not pass, or no reply after the retries gives error rows for its prompts, and the job
goes on. What may pass (429, 5xx, timeouts) is tried again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .pages import with_retries


class Caller:
    """Posts prompts to a service over one connection that stays open; after a failure the next call opens another."""

    def __init__(self, url: str, timeout: float = 60.0):
        from urllib.parse import urlsplit

        self.at, self.timeout, self.open = urlsplit(url), timeout, None

    def _send(self, body: bytes):
        import http.client

        fresh = self.open is None
        if fresh:
            kind = http.client.HTTPSConnection if self.at.scheme == "https" else http.client.HTTPConnection
            self.open = kind(self.at.netloc, timeout=self.timeout)
        try:
            self.open.request("POST", (self.at.path or "/") + (f"?{self.at.query}" if self.at.query else ""), body, {"Content-Type": "application/json"})
            reply = self.open.getresponse()
            return reply.status, reply.reason, reply.read()
        except (OSError, http.client.HTTPException) as e:
            self.close()
            if not fresh and not isinstance(e, TimeoutError):  # the service had closed the connection meanwhile
                return self._send(body)
            raise ConnectionError(f"no reply: {e}") from e

    def __call__(self, prompts: list[str]) -> list:
        status, reason, body = self._send(json.dumps({"prompts": prompts}).encode())
        if status == 429 or status >= 500:
            raise ConnectionError(f"status {status}")
        if status >= 300:
            raise ValueError(f"HTTP Error {status}: {reason}")
        return json.loads(body)["replies"]

    def close(self) -> None:
        if self.open is not None:
            self.open.close()
            self.open = None


def replies(call: Callable[[list[str]], list], prompts: list[str], tries: int, sleep: Callable | None = None) -> tuple[list, list]:
    """(replies, errors) of a batch: as many as prompts, and one of the two for each."""
    try:
        said = with_retries(lambda: call(prompts), tries, **({"sleep": sleep} if sleep else {}))
        if not isinstance(said, list) or len(said) != len(prompts):
            raise ValueError(f"{len(said) if isinstance(said, list) else 'no'} replies to {len(prompts)} prompts")
        return [None if x is None else str(x) for x in said], [None if x is not None else "empty reply" for x in said]
    except Exception as e:  # noqa: BLE001  whatever fails for a batch is its rows' error
        return [None] * len(prompts), [f"{type(e).__name__}: {e}"] * len(prompts)


def ask_model(rows: DataFrame, prompt: str, url: str | Callable | None = None, call: Callable | None = None, batch: int = 32, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """rows plus reply and error. A null prompt is not sent: both stay null. call: instead of a service.

    url: of the service, or a function whose context gives the address of one that runs beside the task while it lasts.
    """
    import time
    from contextlib import nullcontext

    at, names = rows.columns.index(prompt), [*rows.columns, "reply", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with (url() if callable(url) else nullcontext(url)) as where:
            ask = call or Caller(where)
            try:
                for b in batches:
                    yield asked(ask, b)
            finally:
                if not call:
                    ask.close()

    def asked(ask: Callable, b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(at).to_pylist()
        sent = [k for k, t in enumerate(texts) if t is not None]
        said, failed = [None] * len(texts), [None] * len(texts)
        for low in range(0, len(sent), batch):
            some = sent[low : low + batch]
            for k, r, e in zip(some, *replies(ask, [texts[k] for k in some], tries, lambda s: time.sleep(s * wait))):
                said[k], failed[k] = r, e
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(said, pa.string()), pa.array(failed, pa.string())], names)

    from pyspark.sql.types import StringType, StructField, StructType

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("reply", StringType()), StructField("error", StringType())]))
