"""Terms of texts (digits, letters a-z after lower-casing A-Z, every character beyond ASCII), and blocks of a query set."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

#: Every byte of a text to itself (term), to its lower case (A-Z) or to a space (all other ASCII).
TERM_BYTES = bytes(c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """All terms of a UTF-8 text in order."""
    return text.translate(TERM_BYTES).split()


def portions(text: bytes, size: int) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in lists of about `size` bytes of text each; a term is never cut."""
    at, text = 0, text.translate(TERM_BYTES)
    while at < len(text):
        end = text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def query_blocks(items: DataFrame, block_bytes: int, block_rows: int = 200_000) -> Iterator[list[tuple[int | None, bytes]]]:
    """Rows (item_id, text in UTF-8, null: empty) in portions of about block_bytes and at most block_rows; the driver holds one at a time."""
    held: list[tuple[int | None, bytes]] = []
    size = 0
    for r in items.select("item_id", "text").toLocalIterator():
        held.append((r.item_id, (r.text or "").encode("utf-8", "surrogatepass")))
        size += len(held[-1][1])
        if size >= block_bytes or len(held) >= block_rows:
            yield held
            held, size = [], 0
    if held:
        yield held
