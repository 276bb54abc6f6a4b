"""Katz backoff language model: learns from one part of a corpus, scores all of it.

Tokens are the words of a text, A-Z lower-cased, then one end token. With training counts c, for a token w
after h (the start mark, for the first):

    P(w | h) = d(c(h, w)) c(h, w) / C(h)   if c(h, w) > 0, else   a(h) P(w)
    P(w)     = d(c(w)) c(w) / N            if c(w) > 0, else the mass left, for the one class of unknown words

d is the Good-Turing discount for counts up to 5 and 1 above; a(h) is the mass that the seen followers of h
leave, over the mass of P that they do not cover, so both levels sum to one exactly. Where a level's
count-of-counts give no discount between 0 and 1, as in tiny corpora, n1 / (n1 + 2 n2) is taken off each
count instead. Where nothing is left (all counts above 5), the denominator is one more. P of a word after
a history that was not seen is P(w).

The exchange is between blocks of documents and ranges of 64-bit keys, in packed rows (see `blocks`):
1. each block asks for its distinct words and word pairs, with its training counts; a range adds them up,
   answers with the totals and names for each pair one block as its owner. Answers are a table in the
   shared folder, partitioned by order of the n-gram, with count-of-counts for the discounts.
2. each block sums the mass of the pairs it owns by history; ranges add them up and answer with a(h), a
   table as before.
3. each block walks down its tokens: pair, else backoff weight and word, else unknown.
All counts and weights cover all training rows. A word that makes up a third of all tokens is one key per
block. Pairs with a hot history are spread, as owners are blocks and not histories.

Null texts are empty: one end token. Rows are held out or learnt from by their id; null ids are hashed as
the text `null`. Equal rows are scored alike and each counts. Pairs are told apart by 64-bit hashes. The
order is two: three would pass the disk budget (README).
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codetide.llm import blocks
from codetide.llm.text import Names, words_of
from codetide.session import Stages

CUT = 5  # counts above are taken as they are
END, START = np.uint64(1), np.uint64(2)
FACTOR = np.uint64(0x9FB21C651E98DF25)
ASK = "kind int, range long, block long, n long, keys binary, counts binary"
ANSWER = "kind int, range long, block long, n long, counts binary, own binary, stats array<long>"


def discounts(stats: list[int]) -> np.ndarray:
    """d for counts 0..CUT from [n1 .. n(CUT+1)]; d[0] = 0, and the last entry is for all larger counts."""
    n = [0, *map(int, stats)]
    d = np.ones(CUT + 2)
    d[0] = 0.0
    if all(n[1:CUT + 2]):
        a = (CUT + 1) * n[CUT + 1] / n[1]
        if a < 1:
            for r in range(1, CUT + 1):
                d[r] = ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a)
    if not (np.all((d[1:CUT + 1] > 0) & (d[1:CUT + 1] < 1))):
        off = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        d[1:CUT + 1] = 1 - off / np.arange(1, CUT + 1)
    return d


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return d[np.minimum(counts, CUT + 1)] * counts


class Unigrams:
    """The lower level: P(w) from counts, the unknown class, and the base score."""

    def __init__(self, stats: list[int]):
        """stats: number of types, number of tokens, mass-defining count-of-counts n1..n6."""
        self.types, self.tokens = stats[0], stats[1]
        self.d = discounts(stats[2:])
        mass = sum(self.d[r] * r * n for r, n in enumerate(stats[2:2 + CUT], 1))
        mass += self.tokens - sum(r * n for r, n in enumerate(stats[2:2 + CUT], 1))
        self.total = self.tokens if self.tokens - mass > 1e-9 * max(self.tokens, 1) else self.tokens + 1
        self.unknown = (self.total - mass) / self.total

    def p(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, discounted(counts, self.d) / self.total, self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1.0) / (self.tokens + self.types + 1.0))


class Block:
    """Tokens of a block: distinct words and pairs, and where each token finds its own."""

    def __init__(self, table: pa.Table):
        words = [words_of(t, True) for t in blocks.texts(table)]
        self.counts = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.ends = np.cumsum(self.counts)
        total = int(self.ends[-1])
        last = np.zeros(total, bool)
        last[self.ends - 1] = True
        tokens = np.full(total, END)
        # Names below 4 are kept for the marks.
        tokens[~last] = np.fromiter(map(Names().__getitem__, chain.from_iterable(words)), np.uint64, total - len(words)) | np.uint64(4)
        before = np.empty(total, np.uint64)
        before[1:] = tokens[:-1]
        before[self.ends - self.counts] = START
        self.train = np.repeat(~np.asarray(table.column("held_out").combine_chunks().to_pylist(), dtype=bool), self.counts)
        # The start mark is a word of its own here, so that it has a count as a history.
        keys, place = blocks.distinct(blocks.mix(np.concatenate((tokens, np.full(len(words), START)))))
        self.words, self.word, self.start = keys, place[:total], int(place[total])
        starts = self.train[self.ends - 1].sum()
        self.word_counts = np.bincount(self.word, weights=self.train, minlength=len(keys)).astype(np.uint64)
        self.word_counts[self.start] = starts
        self.history = np.empty(total, np.int64)
        self.history[1:] = self.word[:-1]
        self.history[self.ends - self.counts] = self.start
        self.pairs, self.pair = blocks.distinct(blocks.mix(before * FACTOR + blocks.mix(tokens)))
        self.pair_counts = np.bincount(self.pair, weights=self.train, minlength=len(self.pairs)).astype(np.uint64)
        one = np.zeros(len(self.pairs), np.int64)
        one[self.pair] = np.arange(total)
        self.pair_word, self.pair_history = self.word[one], self.history[one]


def _ask(kind: int, block: int, keys: np.ndarray, ranges: int, *values: np.ndarray) -> pa.Table:
    parts = blocks.slices(keys, ranges)
    payload = [[blocks.planes(np.ascontiguousarray(v[a:b])) for _, a, b in parts] for v in values]
    return pa.table({
        "kind": pa.array([kind] * len(parts), pa.int32()), "range": pa.array([r for r, _, _ in parts], pa.int64()),
        "block": pa.array([block] * len(parts), pa.int64()), "n": pa.array([b - a for _, a, b in parts], pa.int64()),
        "keys": pa.array([blocks.pack(keys[a:b]) for _, a, b in parts], pa.binary()),
        "counts": pa.array([b"".join(x) for x in zip(*payload)], pa.binary())})


def _split(data: bytes, n: int, several: int) -> list[np.ndarray]:
    out, at = [], 0
    for _ in range(several):
        size = 1 + data[at] * n
        out.append(blocks.unplanes(data[at:at + size], n))
        at += size
    return out


def _gathered(table: pa.Table, several: int):
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    known, place = blocks.distinct(np.concatenate([blocks.unpack(r["keys"], r["n"]) for r in rows]))
    values = [np.concatenate(v) for v in zip(*(_split(r["counts"], r["n"], several) for r in rows))]
    return rows, known, place, values, np.cumsum([0, *(r["n"] for r in rows)])


def _answers(rows: list[dict]) -> dict[int, list[dict]]:
    out: dict[int, list[dict]] = {0: [], 1: [], 2: []}
    for r in sorted(rows, key=lambda r: r["range"]):
        out[r["kind"]].append(r)
    return out


def scored(documents: DataFrame, held_out: Column, *, doc: str = "doc_id", text: str = "text",
           block_bytes: int = blocks.BLOCK_BYTES, range_keys: int = blocks.RANGE_KEYS) -> DataFrame:
    """doc_id, text_hash, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    `held_out` is an expression over `documents`; rows where it is true are not learnt from. Scores are log10.
    """
    stages = Stages(documents.sparkSession)
    marked = documents.withColumn("__held", F.coalesce(held_out, F.lit(False)))
    docs, _, ranges = blocks.plan(marked.select(F.struct(doc, "__held").alias("id"), F.col(text).alias("text")), "id", "text", block_bytes, range_keys)
    docs = docs.select("block", F.col(f"doc_id.{doc}").alias("doc_id"), F.col("doc_id.__held").alias("held_out"), "text", "text_hash")
    by_block = docs.groupBy("block")
    start_key = blocks.mix(np.array([START]))[0]

    def ask_counts(table: pa.Table) -> pa.Table:
        b, block = Block(table), table.column("block")[0].as_py()
        return pa.concat_tables([_ask(0, block, b.words, ranges, b.word_counts), _ask(1, block, b.pairs, ranges, b.pair_counts)])

    def answer_counts(table: pa.Table) -> pa.Table:
        kind = table.column("kind")[0].as_py()
        rows, known, place, (counts,), ends = _gathered(table, 1)
        totals = np.zeros(len(known), np.uint64)
        np.add.at(totals, place, counts)
        # A pair belongs to the first block that asks for it.
        own = np.zeros(len(place), bool)
        own[np.unique(place, return_index=True)[1]] = True
        own &= totals[place] > 0
        counted = totals[known != start_key] if kind == 0 else totals
        stats = [int((counted > 0).sum()), int(counted.sum()), *(int((counted == r).sum()) for r in range(1, CUT + 2))]
        spans = list(zip(ends, ends[1:]))
        return pa.table({
            "kind": table.column("kind").slice(0, 1).to_pylist() * len(rows), "range": pa.array([r["range"] for r in rows], pa.int64()),
            "block": pa.array([r["block"] for r in rows], pa.int64()), "n": pa.array([r["n"] for r in rows], pa.int64()),
            "counts": pa.array([blocks.planes(totals[place[a:b]]) for a, b in spans], pa.binary()),
            "own": pa.array([np.packbits(own[a:b]).tobytes() if kind else b"" for a, b in spans], pa.binary()),
            "stats": pa.array([stats] + [None] * (len(rows) - 1), pa.list_(pa.int64()))}).cast(_schema())

    ngrams = stages.keep(by_block.applyInArrow(ask_counts, ASK).groupBy("kind", "range").applyInArrow(answer_counts, ANSWER), "ngrams", "kind")
    blocks.settle(documents)
    sums = {r["kind"]: [r[f"s{i}"] for i in range(CUT + 3)] for r in ngrams.where("stats IS NOT NULL").groupBy("kind").agg(
        *[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(CUT + 3)]).collect()}  # two rows
    low = Unigrams(sums.get(0, [0] * (CUT + 3)))
    pair_discount = discounts(sums.get(1, [0] * (CUT + 3))[2:])

    def known_counts(b: Block, rows: list[dict]):
        found = _answers(rows)
        words = np.concatenate([blocks.unplanes(r["counts"], r["n"]) for r in found[0]]).astype(np.int64)
        pairs = np.concatenate([blocks.unplanes(r["counts"], r["n"]) for r in found[1]]).astype(np.int64)
        return found, words, pairs

    def ask_weights(table: pa.Table, answers: pa.Table) -> pa.Table:
        b = Block(table)
        found, words, pairs = known_counts(b, answers.to_pylist())
        own = np.concatenate([np.unpackbits(np.frombuffer(r["own"], np.uint8), count=r["n"]) for r in found[1]]).astype(bool)
        at = b.pair_history[own]
        seen = np.bincount(at, weights=discounted(pairs[own], pair_discount), minlength=len(words))
        covered = np.bincount(at, weights=low.p(words)[b.pair_word[own]], minlength=len(words))
        return _ask(2, table.column("block")[0].as_py(), b.words, ranges, words.astype(np.uint64), seen.view(np.uint64), covered.view(np.uint64))

    def answer_weights(table: pa.Table) -> pa.Table:
        rows, known, place, (count, seen, covered), ends = _gathered(table, 3)
        total = np.zeros(len(known), np.int64)
        total[place] = count.astype(np.int64)
        seen = np.bincount(place, weights=seen.view(np.float64), minlength=len(known))
        covered = np.bincount(place, weights=covered.view(np.float64), minlength=len(known))
        full = total - seen <= 1e-9 * total
        below = np.where(total > 0, total + full, 1)
        weight = np.where(total > 0, (below - seen) / below / np.maximum(1 - covered, 1e-300), 1.0)
        signed = np.where(full & (total > 0), -weight, weight)  # the sign tells that the denominator is one more
        return pa.table({
            "kind": [2] * len(rows), "range": [r["range"] for r in rows], "block": [r["block"] for r in rows], "n": [r["n"] for r in rows],
            "counts": pa.array([blocks.planes(signed[place[a:b]].view(np.uint64)) for a, b in zip(ends, ends[1:])], pa.binary()),
            "own": pa.array([b""] * len(rows), pa.binary()), "stats": pa.array([None] * len(rows), pa.list_(pa.int64()))}).cast(_schema())

    asked = by_block.cogroup(ngrams.groupBy("block")).applyInArrow(ask_weights, ASK)
    weights = stages.keep(asked.groupBy("range").applyInArrow(answer_weights, ANSWER), "weights")
    blocks.settle(documents)

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        b = Block(table)
        found, words, pairs = known_counts(b, answers.to_pylist())
        weight = np.concatenate([blocks.unplanes(r["counts"], r["n"]) for r in found[2]]).view(np.float64)
        count, joint, history = words[b.word], pairs[b.pair], b.history
        below = np.maximum(words[history] + (weight[history] < 0), 1)
        p = np.where(joint > 0, discounted(joint, pair_discount) / below, np.abs(weight[history]) * low.p(count))
        first = b.ends - b.counts
        n = len(table)
        return pa.table({
            "doc_id": table.column("doc_id"), "text_hash": table.column("text_hash"), "held_out": table.column("held_out"),
            "n_tokens": b.counts, "n_known": np.add.reduceat((count > 0).astype(np.int64), first),
            "train_tokens": np.full(n, low.tokens, np.int64), "base_score": np.add.reduceat(low.base(count), first),
            "score": np.add.reduceat(np.log10(p), first)})

    id_type = documents.schema[doc].dataType.simpleString()
    return by_block.cogroup(ngrams.unionByName(weights).groupBy("block")).applyInArrow(
        score, f"doc_id {id_type}, text_hash long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _schema() -> pa.Schema:
    return pa.schema([("kind", pa.int32()), ("range", pa.int64()), ("block", pa.int64()), ("n", pa.int64()),
                      ("counts", pa.binary()), ("own", pa.binary()), ("stats", pa.list_(pa.int64()))])


def fold(doc: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`."""
    return F.crc32(F.coalesce(doc.cast("string"), F.lit("null")).cast("binary")) % parts
