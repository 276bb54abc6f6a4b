"""Word and letter rules shared by the text operators, as columns and as byte functions."""

from __future__ import annotations

import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def ascii_lower(column: Column) -> Column:
    """A-Z become a-z; all other letters stay."""
    return F.translate(column, UPPER, LOWER)


def word_count(column: Column) -> Column:
    """Number of whitespace-separated words; 0 for null."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def words_of(text: bytes | None, lower: bool = False) -> list[bytes]:
    """The same words from UTF-8 bytes: `split` and `lower` of bytes know ASCII only."""
    if not text:
        return []
    return (text.lower() if lower else text).split()


class Names(dict):
    """Word -> 64-bit name; a cache that is emptied when it has grown to `limit` words, and goes with its block."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value
