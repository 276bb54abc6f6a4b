"""Sorted 64-bit keys in packed rows, for exchanges between blocks of documents and ranges of keys.

A block is a bounded share of the documents, chosen by hash. It asks about its distinct keys: for each
range of keys one row holds the sorted keys of the block in that range, as differences in byte planes, so
that the zero bytes of close keys cost nothing in a compressed shuffle. A range's task sees the keys of all
blocks, bounded by the number of ranges, and answers each row. A key that all documents share is one entry
per block: nothing is hot.
"""

from __future__ import annotations

import gc
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20
RANGE_KEYS = 1 << 20


def planes(values: np.ndarray) -> bytes:
    """8-byte values as byte planes, lowest first; high planes that are zero throughout are left out."""
    grid = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T)
    used = 8
    while used and not grid[used - 1].any():
        used -= 1
    return bytes([used]) + grid[:used].tobytes()


def unplanes(data: bytes, n: int) -> np.ndarray:
    grid = np.zeros((8, n), np.uint8)
    used = data[0]
    grid[:used] = np.frombuffer(data, np.uint8, used * n, 1).reshape(used, n)
    return np.ascontiguousarray(grid.T).view(np.uint64).reshape(-1)


def pack(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpack(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unplanes(data, n), dtype=np.uint64)


def slices(keys: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of sorted keys, for `ranges` equal shares of the key space; empty ones left out."""
    part = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    cut = np.flatnonzero(np.diff(part)) + 1
    edges = np.concatenate(([0], cut, [len(keys)])).astype(np.int64)
    return [(int(part[a]), int(a), int(b)) for a, b in zip(edges, edges[1:]) if b > a]


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    z = values * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and for each key its position among them."""
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.ones(len(keys), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(first) - 1
    return ordered[first], place


def texts(table: pa.Table, name: str = "text") -> list[bytes | None]:
    """The texts of a group as bytes. What an earlier group of the task has left is freed first."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    return table.column(name).cast(pa.binary()).to_pylist()


def plan(documents: DataFrame, doc: str, text: str, block_bytes: int, range_keys: int) -> tuple[DataFrame, int, int]:
    """Rows (block, doc_id, text, text_hash), the number of blocks and that of key ranges."""
    total = documents.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    blocks, ranges = -(-total // block_bytes) or 1, -(-total // (6 * range_keys)) or 1
    slim = documents.select(F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(text).alias("text_hash"))
    return slim.select(F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(blocks)).alias("block"), "doc_id", "text", "text_hash"), blocks, ranges


def settle(frame: DataFrame, rounds: int = 2, wait: float = 0.7) -> None:
    """Have Spark drop the shuffle files of stages that are stored by now; it does so on garbage collection only.

    The first round frees plans that still hold shuffles, the second the shuffles.
    """
    for _ in range(rounds):
        gc.collect()
        frame.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(wait)
