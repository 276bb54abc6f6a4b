"""SimHash near-dedup with pigeonring filtering.

A 64-bit fingerprint is cut into five segments on a ring. If two fingerprints differ in at most `2` bits,
there is a segment from which every chain of l consecutive segments has at most floor(2 l / 5) differing
bits: 0, 0, 1, 1, 2. So from that start two neighbouring segments are equal, and of the next two at most
one bit differs, hence one of them is equal as well. A fingerprint is therefore entered under ten keys of
about 38 bits: start, start+1 and start+2 or start+3. Only distinct fingerprints that share a key meet;
the chains are checked before the whole distance.

Equal fingerprints are one class from the start, summed map-side, so groups of copies never meet. Keys
with more than `bucket` fingerprints do not pair their members: these differ in the 26 other bits only, so
each is entered under itself and its one-bit changes there, and members that meet are linked as a star.
Two fingerprints at distance 2 or less share such a point, so no link is lost and rows grow linearly.

Null texts count as empty; texts without words have fingerprint zero and are linked like any other. Null
ids are larger than all ids. Equal rows are copies of each other. Extra columns pass through
`deduplicated`; `near_duplicates` returns its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codetide.llm.components import connected
from codetide.llm.text import words_of
from codetide.session import Stages

DISTANCE, SHINGLE, SEED, BUCKET = 2, 3, 42, 256
SEGMENT_BITS = (13, 13, 13, 13, 12)


def masks() -> list[int]:
    out, at = [], 0
    for width in SEGMENT_BITS:
        out.append(((1 << width) - 1) << at)
        at += width
    return out


def shingles(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of all shingles, repeats included; fewer words than one shingle has are one."""
    n = len(words) - shingle + 1
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = list(accumulate(map((1).__add__, map(len, words))))
    starts = [0, *ends]
    return np.fromiter((xxhash.xxh64_intdigest(line[a:b - 1], SEED) for a, b in zip(starts, ends[shingle - 1:])), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    n = len(hashes)
    if n <= 1:
        return int(hashes[0]) if n else 0
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8))
    # Eight counters to a 64-bit lane, widened before one can overflow.
    lanes = np.add.reduceat(bits.view(np.uint64).reshape(n, 8), np.arange(0, n, 255), axis=0)
    counts = lanes.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n).view(">u8")[0])


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """Majority of the bits of XXH64 over all shingles, repeats included."""
    return majority(shingles(words, shingle))


def fingerprints(documents: DataFrame, *, doc: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, fp (signed) per document, without a shuffle."""
    slim = documents.select(F.col(doc).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            fps = np.fromiter((fingerprint(words_of(t, True), shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def links(classes: DataFrame, keep, bucket: int = BUCKET) -> DataFrame:
    """a, b: fingerprints at distance 1 or 2, or two of them joined by such steps, from distinct `fp`."""
    ring = masks()
    m = lambda *at: F.lit(_signed(sum(ring[i % 5] for i in set(at))))
    entries = []
    for start in range(5):
        for third in (start + 2, start + 3):
            entries.append(F.struct(F.lit(2 * start + (third - start - 2)).alias("tag"), F.col("fp").bitwiseAND(m(start, start + 1, third)).alias("key")))
    entered = classes.select("fp", F.explode(F.array(*entries)).alias("e")).select("fp", "e.*")
    shared = entered.groupBy("tag", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = keep(entered.join(shared, ["tag", "key"]), "members")
    normal = members.where(F.col("n") <= bucket).drop("n")
    differ = F.col("fp").bitwiseXOR(F.col("other"))
    start = F.shiftright("tag", 1)
    chain = lambda *steps: F.bit_count(differ.bitwiseAND(F.element_at(F.array(*[m(*(s + k for k in steps)) for s in range(5)]), start + 1)))
    pairs = normal.join(normal.withColumnRenamed("fp", "other"), ["tag", "key"]).where(F.col("fp") < F.col("other")) \
        .where((chain(0, 1) == 0) & (chain(0, 1, 2) <= 1) & (chain(0, 1, 2, 3) <= 1) & (F.bit_count(differ) <= DISTANCE)) \
        .select(F.col("fp").alias("a"), F.col("other").alias("b")).distinct()
    flips = []
    for i in range(5):
        for third in (i + 2, i + 3):
            fixed = ring[i] | ring[(i + 1) % 5] | ring[third % 5]
            flips.append(F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << b)) for b in range(64) if not fixed >> b & 1]))
    points = members.where(F.col("n") > bucket).select(
        "tag", "key", "fp", F.explode(F.element_at(F.array(*flips), F.col("tag") + 1)).alias("flip")) \
        .groupBy("tag", "key", F.col("fp").bitwiseXOR(F.col("flip")).alias("point")).agg(F.collect_set("fp").alias("near"))  # at most 28
    stars = points.where(F.size("near") > 1).select(F.array_min("near").alias("a"), F.explode("near").alias("b")).where("a <> b").distinct()
    return pairs.union(stars)


def groups(documents: DataFrame, keep, *, doc: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, text_hash, fp, component_id (smallest id of the group), root (its smallest linked fingerprint, also where no id is known)."""
    marked = keep(fingerprints(documents, doc=doc, text=text, shingle=shingle), "fingerprints")
    classes = keep(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = connected(links(classes.select("fp"), keep, bucket), keep)
    grouped = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = keep(grouped.join(smallest, "root").select("fp", "root", "component_id"), "labels")
    return marked.join(labels, "fp").select("doc_id", "text_hash", "fp", "component_id", "root")


def near_duplicates(documents: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, text_hash, fingerprint (16 hex digits), component_id (smallest id of its group).

    Options: `doc`, `text` (column names), `shingle` (words), `bucket` (most fingerprints of a key that are paired).
    """
    return groups(documents, Stages(documents.sparkSession).keep, **options).select(
        "doc_id", "text_hash", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(documents: DataFrame, *, doc: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The document with the smallest id of each group, with all its columns; of several texts of that id one.

    Rows equal in id and text are one row: the smallest by their other columns. Texts are moved once, by the
    join with the chosen ids; a second time only those of rows that occur repeatedly, aggregated map-side.
    """
    keep = Stages(documents.sparkSession).keep
    counted = groups(documents, keep, doc=doc, text=text, **options).groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "n")).alias("x")
    chosen = keep(counted.groupBy("root").agg(smallest).select(F.col("x.doc_id").alias("__doc"), F.col("x.text_hash").alias("__hash"), F.col("x.n").alias("__n")), "chosen")

    def of(wanted: DataFrame) -> DataFrame:
        same = documents[doc].eqNullSafe(wanted["__doc"]) & (F.xxhash64(documents[text]) == wanted["__hash"])
        return documents.join(wanted, same, "left_semi")

    repeated = chosen.where("__n > 1")
    if repeated.isEmpty():
        return of(chosen)
    fields = [F.col(f"`{name}`") for name in documents.columns]
    ordered = [F.col(f"`{f.name}`") for f in documents.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    once = of(repeated).groupBy(F.col(f"`{doc}`").alias("d"), F.xxhash64(F.col(f"`{text}`")).alias("h")).agg(F.min_by(F.struct(*fields), F.struct(*ordered)).alias("row"))
    return of(chosen.where("__n = 1")).unionByName(once.select("row.*"))
