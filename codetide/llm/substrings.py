"""Substring dedup by recompression: remove passages that a document with a smaller id also has.

A window is `WIDTH` consecutive words of one document. Each word covered by a window whose word sequence
also starts in a document with a smaller id is removed; windows are judged on the input.

Recompression rounds shorten each document: first every maximal run of equal symbols gets one name, then
every neighbouring pair of a left and a right symbol, where the side of a symbol is a bit of its name.
Names are 64-bit fingerprints of what they stand for, so all tasks give equal symbols equal names without
an exchange. What a name depends on is a known stretch of words; where the stretch lies inside a window,
every occurrence of the window has the same symbol at the same place. So a window can only be repeated if
all the symbols fixed by it are in two documents.

Spark then exchanges, in packed rows between blocks of documents and ranges of keys (see `blocks`):
1. the symbols: one is shared if two documents have it;
2. the hashes of windows with shared symbols only, with the block's smallest id: a block learns which of
   its windows start in a smaller document of another block;
3. these against the block's documents, together with repeats inside the block, decide the words to go.
Most windows never leave their block. A passage shared by very many documents is one key per block, and no
group of documents is gathered. Blocks and ranges are bounded by parameters.

Windows are compared by 64-bit hashes: among n different ones about n^2 / 2^65 pairs are confused, 0.1 in
a corpus of 2 billion candidate windows.

Null and empty texts have no words. Ids are integers; rows with the same id are no smaller than each other;
null ids neither lose words nor cause a loss. Extra columns pass through `cleaned`.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codetide.llm import blocks
from codetide.llm.text import Names, words_of
from codetide.session import Stages

WIDTH, ROUNDS = 13, 3
FAR = 1 << 20  # context of a document's edge: longer than any window
PAIR, RUN = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
SIGN = np.uint64(1 << 63)


def recompressed(names: np.ndarray, edge: np.ndarray, rounds: int = ROUNDS):
    """Yield (name, begin, end, from, to) arrays of new symbols: words, then runs and pairs of each round.

    A symbol spans words [begin, end); its name and place depend on the words [from, to) alone.
    `edge` marks separators between documents, which depend on everything.
    """
    s = names
    begin = np.arange(len(s))
    end = begin + 1
    since, until = begin - FAR * edge, end + FAR * edge
    yield s, begin, end, since, until
    for number in range(rounds):
        first = np.ones(len(s), bool)
        first[1:] = (s[1:] != s[:-1]) | edge[1:] | edge[:-1]
        at = np.flatnonzero(first)
        size = np.diff(np.append(at, len(s)))
        until = until[np.minimum(at + size, len(s) - 1)]
        since = since[np.maximum(at - 1, 0)]
        begin, end, edge, s = begin[at], end[at + size - 1], edge[at], s[at]
        since, until = np.where(edge, begin - FAR, since), np.where(edge, end + FAR, until)
        run = size > 1
        if run.any():
            s = s.copy()
            s[run] = blocks.mix(s[run] * RUN + size[run].astype(np.uint64))
            yield s[run], begin[run], end[run], since[run], until[run]
        left = ((s >> np.uint64(11 + number)) & np.uint64(1) == 0) & ~edge
        right = ~left & ~edge
        joins = np.zeros(len(s), bool)
        joins[:-1] = left[:-1] & right[1:]
        keep = np.ones(len(s), bool)
        keep[1:] = ~joins[:-1]
        at = np.flatnonzero(keep)
        pair = joins[at]
        following = np.minimum(at + 1, len(s) - 1)
        name = s[at]
        name[pair] = blocks.mix(s[at][pair] * PAIR + s[following][pair])
        since = np.where(right[at], since[np.maximum(at - 1, 0)], since[at])
        until = np.where(left[at], until[following], until[at])
        begin, end, edge = begin[at], np.where(pair, end[following], end[at]), edge[at]
        since, until = np.where(edge, begin - FAR, since), np.where(edge, end + FAR, until)
        s = name
        yield s[pair], begin[pair], end[pair], since[pair], until[pair]


def fixed_symbols(names: np.ndarray, edge: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """(name, begin, from, to) of the runs and pairs that a window can fix."""
    parts = []
    for number, (name, begin, _, since, until) in enumerate(recompressed(names, edge)):
        if number:  # single words tell little
            fits = until - since <= width
            parts.append((name[fits], begin[fits].astype(np.int32), since[fits].astype(np.int32), until[fits].astype(np.int32)))
    return tuple(np.concatenate(x) for x in zip(*parts))


def possible(windows: np.ndarray, since: np.ndarray, until: np.ndarray, size: int, width: int = WIDTH) -> np.ndarray:
    """Whether each window fixes none of the symbols given by their stretches."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, np.maximum(until - width, 0), 1)
    np.add.at(change, since + 1, -1)
    return np.cumsum(change)[windows] == 0


class Block:
    """The words of a block's documents in one array, separated by edges."""

    def __init__(self, table: pa.Table, width: int, keep_words: bool = False):
        split = [words_of(t) for t in blocks.texts(table)]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        total = int(counts.sum())
        self.starts = np.cumsum(counts + 1) - counts
        self.edge = np.ones(total + len(counts) + 1, bool)
        flat = np.arange(total) + np.repeat(np.arange(len(counts)) + 1, counts)
        self.edge[flat] = False
        self.names = np.zeros(len(self.edge), np.uint64)
        self.names[flat] = np.fromiter(map(Names().__getitem__, chain.from_iterable(split)), np.uint64, total)
        self.words = split if keep_words else None
        ids = table.column("doc_id")
        self.known = ~np.asarray(ids.is_null().combine_chunks())
        self.ids = np.asarray(ids.fill_null(0).combine_chunks()).astype(np.int64)
        per_doc = np.where(self.known, np.maximum(counts - width + 1, 0), 0)
        self.doc = np.repeat(np.arange(len(counts), dtype=np.int32), per_doc)
        self.windows = np.arange(len(self.doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc) + self.starts[self.doc]
        self.width = width

    def hashes(self, windows: np.ndarray) -> np.ndarray:
        """Hash of the words of each window: names are random, so a weighted sum spreads them."""
        out, factor = np.zeros(len(windows), np.uint64), np.uint64(1)
        for k in range(self.width):
            out += self.names[windows + k] * factor
            factor = np.uint64((int(factor) * int(PAIR)) & 0xFFFFFFFFFFFFFFFF)
        return blocks.mix(out)

    def symbols(self) -> tuple[np.ndarray, ...]:
        """Sorted distinct keys; for each symbol its place among them, document, and stretch."""
        name, begin, since, until = fixed_symbols(self.names, self.edge, self.width)
        keys, place = blocks.distinct(blocks.mix(name))
        return keys, place, np.searchsorted(self.starts, begin, side="right") - 1, since, until


def _rows(block: int, keys: np.ndarray, ranges: int, extra) -> pa.Table:
    parts = blocks.slices(keys, ranges) if len(keys) else []
    return pa.table({
        "range": pa.array([r for r, _, _ in parts], pa.int64()), "block": pa.array([block] * len(parts), pa.int64()),
        "n": pa.array([b - a for _, a, b in parts], pa.int64()),
        "keys": pa.array([blocks.pack(keys[a:b]) for _, a, b in parts], pa.binary()),
        "extra": pa.array([extra(a, b) for _, a, b in parts], pa.binary())})


ROWS = "range long, block long, n long, keys binary, extra binary"


def _gathered(table: pa.Table):
    """All keys of a range, row by row, as places among the distinct ones; and the rows' ends."""
    columns = [table.column(c).to_pylist() for c in ("range", "block", "n", "keys", "extra")]
    keys = [blocks.unpack(k, n) for k, n in zip(columns[3], columns[2])]
    known, place = blocks.distinct(np.concatenate(keys))
    return columns, keys, known, place, np.cumsum([0, *columns[2]])


def _ordered(answers: pa.Table) -> list[dict]:
    return sorted(answers.to_pylist(), key=lambda r: r["range"])


def repeated(documents: DataFrame, *, doc: str = "doc_id", text: str = "text", width: int = WIDTH, keep_text: bool = False,
             block_bytes: int = blocks.BLOCK_BYTES, range_keys: int = blocks.RANGE_KEYS) -> DataFrame:
    """One row per document: doc_id, text_hash, n_words, n_removed, kept_sha256, kept_text.

    kept_text is the remaining words joined by a space, given only with `keep_text` and where words went.
    """
    stages = Stages(documents.sparkSession)
    docs, _, ranges = blocks.plan(documents, doc, text, block_bytes, range_keys)
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    by_block = docs.groupBy("block")

    def ask_symbols(table: pa.Table) -> pa.Table:
        b = Block(table, width)
        keys, place, doc_of, _, _ = b.symbols()
        low, high = np.full(len(keys), len(b.ids)), np.full(len(keys), -1)
        np.minimum.at(low, place, doc_of)
        np.maximum.at(high, place, doc_of)
        return _rows(table.column("block")[0].as_py(), keys, ranges, lambda x, y: np.packbits(low[x:y] != high[x:y]).tobytes())

    def answer_symbols(table: pa.Table) -> pa.Table:
        (part, block, size, _, extra), _, known, place, ends = _gathered(table)
        several = np.concatenate([np.unpackbits(np.frombuffer(e, np.uint8), count=n) for e, n in zip(extra, size)])
        shared = np.bincount(place, weights=1 + several, minlength=len(known)) > 1
        return pa.table({"range": pa.array(part, pa.int64()), "block": pa.array(block, pa.int64()), "n": pa.array(size, pa.int64()),
                         "keys": pa.array([b""] * len(part), pa.binary()),
                         "extra": pa.array([np.packbits(shared[place[a:b]]).tobytes() for a, b in zip(ends, ends[1:])], pa.binary())})

    def ask_windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return _rows(0, np.zeros(0, np.uint64), ranges, None)
        b = Block(table, width)
        keys, place, _, since, until = b.symbols()
        single = np.concatenate([np.unpackbits(np.frombuffer(r["extra"], np.uint8), count=r["n"]) for r in _ordered(answers)] or [np.zeros(0, np.uint8)]) == 0
        alone = single[place]
        chosen = possible(b.windows, since[alone], until[alone], len(b.edge), width)
        keys, place = blocks.distinct(b.hashes(b.windows[chosen]))
        least = np.full(len(keys), np.iinfo(np.int64).max)
        np.minimum.at(least, place, b.ids[b.doc[chosen]])
        least = least.view(np.uint64) ^ SIGN
        return _rows(table.column("block")[0].as_py(), keys, ranges, lambda x, y: blocks.planes(np.ascontiguousarray(least[x:y])))

    def answer_windows(table: pa.Table) -> pa.Table:
        (part, block, size, _, extra), keys, known, place, ends = _gathered(table)
        own = np.concatenate([blocks.unplanes(e, n) for e, n in zip(extra, size)])
        least = np.full(len(known), np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, place, own)
        later = least[place] < own
        hits = [k[later[a:b]] for k, a, b in zip(keys, ends, ends[1:])]
        return pa.table({"range": pa.array(part, pa.int64()), "block": pa.array(block, pa.int64()),
                         "n": pa.array([len(h) for h in hits], pa.int64()),
                         "keys": pa.array([blocks.pack(h) if len(h) else b"" for h in hits], pa.binary()),
                         "extra": pa.array([b""] * len(part), pa.binary())})

    def decide(table: pa.Table, answers: pa.Table) -> pa.Table:
        b = Block(table, width, keep_words=True)
        hashes = b.hashes(b.windows)
        keys, place = blocks.distinct(hashes)
        least = np.full(len(keys), np.iinfo(np.int64).max)
        np.minimum.at(least, place, b.ids[b.doc])
        gone = b.ids[b.doc] > least[place]
        hit = [blocks.unpack(r["keys"], r["n"]) for r in _ordered(answers) if r["n"]] if len(answers) else []
        if hit:
            hit = np.concatenate(hit)
            gone |= hit[np.minimum(np.searchsorted(hit, keys), len(hit) - 1)][place] == hashes
        change = np.zeros(len(b.edge) + 1, np.int64)
        np.add.at(change, b.windows[gone], 1)
        np.add.at(change, b.windows[gone] + width, -1)
        covered = np.cumsum(change)[:-1] > 0
        removed, digests, texts = [], [], []
        for start, words in zip(b.starts.tolist(), b.words):
            drop = covered[start:start + len(words)]
            n = int(drop.sum())
            line = b" ".join([w for w, d in zip(words, drop.tolist()) if not d] if n else words)
            removed.append(n)
            digests.append(hashlib.sha256(line).hexdigest())
            texts.append(line.decode() if n and keep_text else None)
        return pa.table({"doc_id": table.column("doc_id"), "text_hash": table.column("text_hash"),
                         "n_words": pa.array([len(w) for w in b.words], pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                         "kept_sha256": digests, "kept_text": pa.array(texts, pa.string())})

    symbols = stages.keep(by_block.applyInArrow(ask_symbols, ROWS).groupBy("range").applyInArrow(answer_symbols, ROWS), "symbols")
    blocks.settle(documents)
    asked = by_block.cogroup(symbols.groupBy("block")).applyInArrow(ask_windows, ROWS)
    windows = stages.keep(asked.groupBy("range").applyInArrow(answer_windows, ROWS), "windows")
    blocks.settle(documents)
    return by_block.cogroup(windows.groupBy("block")).applyInArrow(
        decide, "doc_id long, text_hash long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def cleaned(documents: DataFrame, *, doc: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """All documents with all their columns; where words went, `text` is the remaining words joined by a space."""
    found = repeated(documents, doc=doc, text=text, keep_text=True, **options).where("n_removed > 0") \
        .select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"), F.col("kept_text").alias("__kept")) \
        .dropDuplicates(["__doc", "__hash"])
    same = (documents[doc] == found["__doc"]) & (F.xxhash64(documents[text]) == found["__hash"])
    out = documents.join(found, same, "left")
    return out.select(*[F.coalesce("__kept", documents[c]).alias(c) if c == text else documents[c] for c in documents.columns])
