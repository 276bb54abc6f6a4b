"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(b + sum of w[i] + sum over pairs of <v[i], v[j]>) over the distinct terms i, j of a text:
besides additive weights, pairs of terms count, such as an insult with the mention of a group.

Terms are lower-cased words without outer punctuation, hashed to 2^20 buckets. The machine is fitted on at
most `sample` labelled documents in one task, whose input is bounded by that parameter. A bucket gets a weight
and factors, by Adam, if it tells something of the label: by itself (likelihood ratio statistic), or
beside another. The latter is judged by what a first machine leaves unexplained: of all pairs of buckets that
stand in at least `paired` of the documents, those count whose common documents' residuals differ by
5.5 standard deviations from what either bucket leaves alone. No bucket that passes is dropped. The parameters, bounded by the sample's terms,
go to every task; scoring is a pass over all whole texts without a shuffle.

Inputs of a score are the words of the text alone. Null and empty texts get sigmoid(b). Null ids and null
labels are not learnt from; without labels the score is low and even. Equal rows get equal scores. Extra
columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codetide.llm import labelled
from codetide.llm.text import words_of
from codetide.session import Stages

BITS, FACTORS, EPOCHS, EVIDENCE, PAIRED, DEVIATIONS = 20, 8, 12, 9.5, 0.02, 5.5
OUTER = b".,;:!?\"'()[]{}<>*#$%&|~_-/\\"


class Terms(dict):
    """Word -> bucket; emptied when it has grown to `limit` words."""

    def __init__(self, bits: int, limit: int = 400_000):
        super().__init__()
        self.bits, self.limit = bits, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.strip(OUTER) or word) >> (64 - self.bits)
        return value


def buckets(text: bytes | None, terms: Terms) -> np.ndarray:
    words = words_of(text, True)
    return np.unique(np.fromiter(map(terms.__getitem__, words), np.int64, len(words)))


def telling(flat: np.ndarray, rows: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """Buckets with evidence of their own about the label, sorted; at least EVIDENCE and two documents."""
    n, pos = len(y), y.sum()
    seen = np.bincount(flat, minlength=size).astype(float)
    hit = np.bincount(flat, weights=y[rows], minlength=size)
    at = np.flatnonzero(seen >= 2)
    seen, hit = seen[at], hit[at]

    def part(o, e):
        return np.where(o > 0, o * np.log(np.maximum(o, 1e-12) / np.maximum(e, 1e-12)), 0.0)

    p = pos / max(n, 1)
    g = 2 * (part(hit, seen * p) + part(seen - hit, seen * (1 - p)) + part(pos - hit, (n - seen) * p) + part(n - seen - pos + hit, (n - seen) * (1 - p)))
    return at[g >= EVIDENCE]


def telling_pairs(flat: np.ndarray, rows: np.ndarray, y: np.ndarray, z: np.ndarray, size: int, paired: float, block: int = 1024) -> np.ndarray:
    """Buckets that tell, together with another bucket, something of the labels `y` that the margins `z` do not, sorted.

    The residuals of a pair's documents must differ from what each of the two leaves by itself. A residual
    counts with a tenth of the label's variance at least: what is all but explained needs no pairs.
    """
    n, residual = len(y), y - 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    variance = max(np.mean(residual ** 2), 0.1 * np.var(y), 1e-9) if n else 1.0
    seen = np.bincount(flat, minlength=size)
    often = np.flatnonzero(seen >= max(20, paired * n))
    number = np.full(size, -1)
    number[often] = np.arange(len(often))
    inside = number[flat] >= 0
    f, r = number[flat[inside]], rows[inside]
    sums, common = (np.zeros((len(often), len(often)), np.float32) for _ in range(2))
    for start in range(0, n, block):  # rows come in order
        a, b = np.searchsorted(r, (start, start + block))
        x = np.zeros((min(block, n - start), len(often)), np.float32)
        x[r[a:b] - start, f[a:b]] = 1
        sums += (x * residual[start:start + block, None].astype(np.float32)).T @ x
        common += x.T @ x
    own = np.diag(sums) / np.maximum(np.diag(common), 1)  # what a bucket leaves by itself is not the pair's
    beyond = np.minimum(np.abs(sums - common * own), np.abs(sums - common * own[:, None]))
    strong = beyond >= DEVIATIONS * np.sqrt(np.maximum(common, 20) * variance)
    np.fill_diagonal(strong, False)
    return often[strong.any(axis=1)]


def margins(flat: np.ndarray, start: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray):
    """Margins of rows of feature numbers (row r: flat[start[r]:start[r + 1]]), and the sums of factors."""
    rows = np.repeat(np.arange(len(start) - 1), np.diff(start))
    linear = np.bincount(rows, weights=w[flat], minlength=len(start) - 1)
    sums = np.stack([np.bincount(rows, weights=v[flat, k], minlength=len(start) - 1) for k in range(v.shape[1])], axis=1)
    squares = np.bincount(rows, weights=(v[flat] ** 2).sum(axis=1), minlength=len(start) - 1)
    return bias + linear + 0.5 * ((sums ** 2).sum(axis=1) - squares), sums, rows


def fit(flat: np.ndarray, start: np.ndarray, y: np.ndarray, n: int, factors: int = FACTORS, epochs: int = EPOCHS, batch: int = 512,
        steps: int = 400, rate: float = 0.05, decay: float = 2e-4, seed: int = 9) -> tuple[float, np.ndarray, np.ndarray]:
    """bias, w, v of a factorization machine over `n` features by Adam on the logistic loss.

    The rarer label 1 weighs as the square root of its odds, four times at most.
    """
    rng = np.random.default_rng(seed)
    pos = y.sum()
    weight = np.where(y > 0, np.clip(np.sqrt((len(y) - pos) / max(pos, 1.0)), 1.0, 4.0), 1.0)
    theta = np.concatenate(([np.log((pos + 0.5) / (len(y) - pos + 1.0))], np.zeros(n), rng.normal(0, 0.05, n * factors)))
    m, s, t = np.zeros_like(theta), np.zeros_like(theta), 0
    parts = max(1, len(y) // batch)
    epochs = max(epochs, -(-steps // parts))  # small samples are gone through more often
    for epoch in range(epochs if n else 0):
        for at in np.array_split(rng.permutation(len(y)), parts):
            size = start[at + 1] - start[at]
            own = np.concatenate(([0], np.cumsum(size)))
            f = flat[np.repeat(start[at] - own[:-1], size) + np.arange(own[-1])]
            w, v = theta[1:n + 1], theta[n + 1:].reshape(n, factors)
            z, sums, rows = margins(f, own, theta[0], w, v)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at]) * weight[at] / len(at)
            grad = np.empty_like(theta)
            grad[0] = g.sum()
            grad[1:n + 1] = np.bincount(f, weights=g[rows], minlength=n)
            each = g[rows, None] * (sums[rows] - v[f])
            grad[n + 1:] = np.stack([np.bincount(f, weights=each[:, k], minlength=n) for k in range(factors)], axis=1).ravel()
            grad[1:] += decay * theta[1:]
            t += 1
            m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad ** 2
            step = rate * (1 - epoch / epochs) + 0.002
            theta -= step * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.999 ** t)) + 1e-8)
    return float(theta[0]), theta[1:n + 1], theta[n + 1:].reshape(n, factors)


def learnt(documents: DataFrame, known: DataFrame, doc: str, text: str, keep, *, bits: int = BITS, paired: float = PAIRED, factors: int = FACTORS):
    """bucket numbers, bias, w, v from documents with labels in `known` (a bounded table: __doc, label)."""
    rows = documents.select(F.col(doc).alias("__doc"), F.col(text).cast("string").alias("text")).join(F.broadcast(known), "__doc")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(bits)
        for batch in batches:
            found = [buckets(t, terms) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("__doc"), batch.column("label"), pa.array(found, pa.list_(pa.int64()))], names=["doc", "label", "terms"])

    id_type = documents.schema[doc].dataType.simpleString()
    examples = keep(rows.mapInArrow(hashed, f"doc {id_type}, label int, terms array<long>").dropDuplicates(["doc"]), "examples")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if parts:
            table = pa.Table.from_batches(parts)
            order = np.argsort(table.column("doc").to_numpy(), kind="stable")  # one order in every run
            table = table.take(pa.array(order))
            y = table.column("label").to_numpy().astype(float)
            lists = table.column("terms").combine_chunks()
            flat = lists.flatten().to_numpy()
            size = np.asarray(lists.value_lengths()).astype(np.int64)
        else:
            y, flat, size = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(y)), size)

        def machine(chosen):
            number = np.full(1 << bits, -1)
            number[chosen] = np.arange(len(chosen))
            inside = number[flat] >= 0
            start = np.concatenate(([0], np.cumsum(np.bincount(row[inside], minlength=len(y))))).astype(np.int64)
            own = number[flat[inside]]
            bias, w, v = fit(own, start, y, len(chosen), factors)
            return bias, w, v, margins(own, start, bias, w, v)[0]

        chosen = telling(flat, row, y, 1 << bits)
        bias, w, v, z = machine(chosen)
        more = telling_pairs(flat, row, y, z, 1 << bits, paired)
        if len(np.setdiff1d(more, chosen)):
            chosen = np.union1d(chosen, more)
            bias, w, v, _ = machine(chosen)
        yield pa.RecordBatch.from_arrays(
            [pa.array([bias]), pa.array([chosen.tolist()], pa.list_(pa.int64())), pa.array([w.tolist()], pa.list_(pa.float64())),
             pa.array([v.ravel().tolist()], pa.list_(pa.float64()))], names=["bias", "chosen", "w", "v"])

    model = keep(examples.coalesce(1).mapInArrow(train, "bias double, chosen array<long>, w array<double>, v array<double>"), "machine")
    row = model.first()  # one row, bounded by the sample's terms
    if row is None:
        return np.zeros(0, np.int64), float(np.log(0.5)), np.zeros(0), np.zeros((0, factors))
    return np.array(row["chosen"], np.int64), row["bias"], np.array(row["w"]), np.array(row["v"]).reshape(-1, factors)


def scored(documents: DataFrame, labels: DataFrame, held_out, *, doc: str = "doc_id", text: str = "text", label_doc: str = "doc_id",
           label: str = "toxic", sample: int = labelled.SAMPLE, bits: int = BITS, **options) -> DataFrame:
    """doc_id, text_hash, held_out, score, predicted of every document; `held_out(id column)` rows are not learnt from."""
    stages = Stages(documents.sparkSession)
    usable = labels.where(~F.coalesce(held_out(F.col(label_doc)), F.lit(True)))
    known = stages.keep(labelled.sample(usable, label_doc, label, sample), "labels")
    chosen, bias, w, v = learnt(documents, known, doc, text, stages.keep, bits=bits, **options)
    slim = documents.select(F.col(doc).alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                            F.coalesce(held_out(F.col(doc)), F.lit(False)).alias("held_out"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, number = Terms(bits), np.full(1 << bits, -1)
        number[chosen] = np.arange(len(chosen))
        for batch in batches:
            rows = [number[buckets(t, terms)] for t in batch.column("text").cast(pa.binary()).to_pylist()]
            rows = [r[r >= 0] for r in rows]
            start = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
            z, _, _ = margins(np.concatenate(rows) if rows else np.zeros(0, np.int64), start, bias, w, v)
            score = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                names=["doc_id", "text_hash", "held_out", "score", "predicted"])

    id_type = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {id_type}, text_hash long, held_out boolean, score double, predicted int")
