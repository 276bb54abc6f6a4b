"""Quality classifier by importance resampling.

Two generative models of hashed n-grams, of target text (documents labelled good) and of all text, give
each document the log of its probability ratio; Gumbel noise seeded by its id is added, and the k documents
with the largest sums stay: a draw without replacement by importance. k is the number of documents whose
log ratio is at least `cut`, the point that errs least on the labelled documents (in the middle of the gap
there), so noise decides only between documents near it.

The n-grams are of words and of word forms. A word is lower-cased (in the full sense) and without outer
punctuation; in its form letters become A or a, digits 0, repeats are squeezed, and a form whose word equals
the one before is marked. Singles and pairs of both are hashed to 2^20 buckets. Most words are rare, so
smoothing is strong, and every document is judged by the counts of the others (its own are taken off): a word
that only this document has says nothing, whether the document is labelled or not. `words=False` leaves the
forms alone, in 2^16 buckets, smoothed by one, as the first version did; the query and the pipeline use words.

All text means all rows: each task sums the buckets of its rows, Spark adds them up. The target model and
the cut come from at most `sample` labelled ids, hence that broadcast is bounded, and so are the buckets.
The k-th largest sum is found exactly by counting 16 bits of it at a time; nothing is sorted.

Null and empty texts have ratio 0 and are judged like others. Null ids share one noise. Equal rows and ties
at the k-th sum stay or go together. Without labels of both kinds everything stays. Extra columns pass
through `selected`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codetide.llm import labelled
from codetide.llm.blocks import mix
from codetide.llm.text import words_of
from codetide.session import Stages

BITS, WORD_BITS, SMOOTHING, SEED = 16, 20, 20.0, 8
OUTER = ".,;:!?\"'()[]{}<>*#$%&|~_-/\\"
FORMS = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))
REPEAT = re.compile(rb"(.)\1+", re.DOTALL)
SAME, PAIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Forms(dict):
    """Word -> 64-bit name of its form; emptied when it has grown to `limit` words."""

    limit = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(REPEAT.sub(rb"\1", word.translate(FORMS)))
        return value


class Vocabulary(dict):
    """Word -> row of `forms` and `names`, its 64-bit names as a form and as a word; `trim` empties it beyond `limit` words."""

    limit = 200_000

    def __init__(self):
        super().__init__()
        self.forms, self.names = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)

    def trim(self) -> None:
        if len(self) >= self.limit:
            self.clear()

    def __missing__(self, word: bytes) -> int:
        row = len(self)
        if row == len(self.forms):
            self.forms, self.names = (np.concatenate((x, np.zeros_like(x))) for x in (self.forms, self.names))
        self.forms[row] = xxhash.xxh3_64_intdigest(REPEAT.sub(rb"\1", word.translate(FORMS)))
        lower = word.decode("utf-8", "replace").lower()
        self.names[row] = xxhash.xxh3_64_intdigest((lower.strip(OUTER) or lower).encode(), SEED)
        self[word] = row
        return row


def word_buckets(text: bytes | None, known: Vocabulary, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of the forms and words of a text and of their pairs, and how often each occurs."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    known.trim()
    rows = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    form, name = known.forms[rows], known.names[rows]
    form[1:] += (rows[1:] == rows[:-1]).astype(np.uint64) * SAME
    pairs, word_pairs = form[:-1] * PAIR ^ form[1:], name[:-1] * PAIR ^ name[1:]
    found = (mix(np.concatenate((form, pairs, name, word_pairs))) >> np.uint64(64 - bits)).astype(np.int32)
    return np.unique(found, return_counts=True)


def buckets(text: bytes | None, forms: Forms, bits: int = BITS) -> np.ndarray:
    """Buckets of the single forms and pairs of a text, repeats included."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.int64)
    form = np.fromiter(map(forms.__getitem__, words), np.uint64, len(words))
    form[1:] += np.fromiter((a == b for a, b in zip(words, words[1:])), np.uint64, len(words) - 1) * SAME
    pairs = form[:-1] * PAIR ^ form[1:]
    return (mix(np.concatenate((form, pairs))) >> np.uint64(64 - bits)).astype(np.int64)


def counted(documents: DataFrame, good: DataFrame, doc: str, text: str, bits: int, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts of all documents and of those in `good` (a bounded table of ids)."""
    flagged = documents.select(F.col(doc).alias("__doc"), F.col(text).cast("string").alias("text")) \
        .join(F.broadcast(good.withColumn("target", F.lit(1))), "__doc", "left").select("text", "target")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, target, forms = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64), Vocabulary() if words else Forms()
        for batch in batches:
            for value, chosen in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
                if words:
                    at, times = word_buckets(value, forms, bits)
                    total[at] += times
                    if chosen:
                        target[at] += times
                    continue
                n = np.bincount(buckets(value, forms, bits), minlength=1 << bits) if value and len(value) > 20_000 else None
                if n is None:
                    at, times = np.unique(buckets(value, forms, bits), return_counts=True)
                    total[at] += times
                    if chosen:
                        target[at] += times
                else:
                    total += n
                    if chosen:
                        target += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at]), pa.array(target[at])], names=["bucket", "total", "target"])

    rows = flagged.mapInArrow(run, "bucket long, total long, target long").groupBy("bucket") \
        .agg(F.sum("total").alias("total"), F.sum("target").alias("target")).toArrow()  # at most 2^bits rows
    total, target = np.zeros(1 << bits), np.zeros(1 << bits)
    at = rows.column("bucket").to_numpy()
    total[at], target[at] = rows.column("total").to_numpy(), rows.column("target").to_numpy()
    return total, target


def ratios(total: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p_target - log p_all of each bucket, smoothed by one of all and as much of one as the target has of all.

    So a bucket that has its share of the target has ratio 0, whatever the size of the sample.
    """
    n, share = len(total), target.sum() / max(total.sum(), 1)
    if not share:
        return np.zeros(n)
    return np.log((target + share) / (target.sum() + n * share)) - np.log((total + 1) / (total.sum() + n))


def ratio_without(at: np.ndarray, times: np.ndarray, own: bool, total: np.ndarray, target: np.ndarray, sums: tuple[float, float], bits: int) -> float:
    """The log ratio of one document under the models of all others, strongly smoothed; `own` says if it is of the target.

    A bucket that no other document has, or that has its share of the target, gives 0.
    """
    size = times.sum()
    everything, wanted = sums[0] - size, sums[1] - (size if own else 0)
    if not len(at) or everything <= 0 or wanted <= 0:
        return 0.0
    share, n = wanted / everything, 1 << bits
    rest, good = total[at] - times, target[at] - (times if own else 0)
    each = np.log((good + SMOOTHING * share) / (wanted + n * SMOOTHING * share)) - np.log((rest + SMOOTHING) / (everything + n * SMOOTHING))
    return float((times * each).sum())


def best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The log ratio that errs least when everything below it is bad; in the middle of its gap."""
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order].astype(np.int64)
    if not len(w) or g.all() or not g.any():
        return -np.inf
    errors = np.concatenate(([0], np.cumsum(g))) + np.concatenate((np.cumsum((1 - g)[::-1])[::-1], [0]))
    errors[1:-1][w[1:] == w[:-1]] = len(w) + 1  # equal ratios are not parted
    at = int(np.argmin(errors))
    if at == 0:
        return -np.inf
    return float(w[-1]) + 1.0 if at == len(w) else float((w[at - 1] + w[at]) / 2)


def noise(doc: Column, seed: int) -> Column:
    """Standard Gumbel noise from the hash of the id."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def scored(documents: DataFrame, labels: DataFrame, *, doc: str = "doc_id", text: str = "text", label_doc: str = "doc_id",
           label: str = "quality", sample: int = labelled.SAMPLE, bits: int | None = None, seed: int = SEED, words: bool = False) -> DataFrame:
    """doc_id, text_hash, log_weight, drawn (log_weight with noise), kept of every document."""
    stages = Stages(documents.sparkSession)
    bits = bits or (WORD_BITS if words else BITS)
    known = stages.keep(labelled.sample(labels, label_doc, label, sample), "labels")
    good = known.where("label = 1").select("__doc")
    total, target = counted(documents, good, doc, text, bits, words)
    slim = documents.select(F.col(doc).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).cast("string").alias("text"))
    id_type = slim.schema["doc_id"].dataType.simpleString()
    if words:
        weighed = weighed_without(slim, good, total, target, bits, id_type)
    else:
        weighed = weighed_forms(slim, ratios(total, target), bits, id_type)
    drawn = stages.keep(weighed.withColumn("drawn", F.col("log_weight") + noise(F.col("doc_id"), seed)), "weights")
    judged = drawn.join(F.broadcast(known), drawn["doc_id"] == known["__doc"]).select("__doc", "log_weight", "label") \
        .dropDuplicates(["__doc"]).orderBy("__doc").limit(sample).collect()  # bounded by the sample
    cut = best_cut(np.array([r["log_weight"] for r in judged]), np.array([r["label"] == 1 for r in judged]))
    k = drawn.where(F.col("log_weight") >= F.lit(cut)).count()
    return drawn.withColumn("kept", F.col("drawn") >= F.lit(kth_largest(drawn, "drawn", k)))


def weighed_forms(slim: DataFrame, weight: np.ndarray, bits: int, id_type: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = Forms()
        for batch in batches:
            sums = [float(weight[buckets(t, forms, bits)].sum()) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.float64())], names=["doc_id", "text_hash", "log_weight"])

    return slim.mapInArrow(run, f"doc_id {id_type}, text_hash long, log_weight double")


def weighed_without(slim: DataFrame, good: DataFrame, total: np.ndarray, target: np.ndarray, bits: int, id_type: str) -> DataFrame:
    """Each document by the models of the others; `good` is a bounded table of ids."""
    flagged = slim.join(F.broadcast(good.withColumn("target", F.lit(1))), slim["doc_id"] == good["__doc"], "left").select("doc_id", "text_hash", "text", "target")
    sums = float(total.sum()), float(target.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary()
        for batch in batches:
            values = [ratio_without(*word_buckets(t, known, bits), own == 1, total, target, sums, bits)
                      for t, own in zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.float64())], names=["doc_id", "text_hash", "log_weight"])

    return flagged.mapInArrow(run, f"doc_id {id_type}, text_hash long, log_weight double")


def kth_largest(frame: DataFrame, column: str, k: int) -> float:
    """The k-th largest value of a column of finite numbers; infinity for k = 0. Exact, in four counts of at most 2^16 rows."""
    if k <= 0:
        return float("inf")
    span = frame.agg(F.min(column).alias("low"), F.max(column).alias("high")).first()
    low, high = span["low"], span["high"]
    left = k
    while low < high:
        step = (high - low) / (1 << 16)
        if step <= 0 or low + step == low:
            break
        cell = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(step)), F.lit((1 << 16) - 1))
        inside = frame.where((F.col(column) >= F.lit(low)) & (F.col(column) <= F.lit(high)))
        cells = inside.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy(F.desc("cell")).collect()
        for r in cells:
            if left <= r["n"]:
                low, high = r["low"], r["high"]
                break
            left -= r["n"]
    return low


def selected(documents: DataFrame, labels: DataFrame, *, doc: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that are drawn, with all their columns."""
    gone = scored(documents, labels, doc=doc, text=text, **options).where("NOT kept") \
        .select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash")).distinct()
    same = documents[doc].eqNullSafe(gone["__doc"]) & (F.xxhash64(documents[text]) == gone["__hash"])
    return documents.join(gone, same, "left_anti")
