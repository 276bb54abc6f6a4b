"""What each filter does in every order: wide packed counters over the masks of failed filters.

A document is its mask: the filters it fails. For any of the 120 orders of five filters a mask decides
what happens at each step: the document is kept, removed, or fails a filter after an earlier one has
removed it. One big integer per mask holds these outcomes of all 600 steps, each in a field of 64 bits.
Integers are summed per part, once over all documents, once over the good and once over the toxic ones;
unpacking a sum gives all 600 rows. A field counts documents, so below 2^64 documents no field can carry
into its neighbour.

Equal integers are not added one by one: documents are counted per part and mask first (with map-side
combine, at most 128 rows per part and task), and an integer is taken as often as its mask occurs. Texts
stay where they are; a narrow table of ids, 32-byte text digests and masks is written once, and feeds
the search for copies and the joins. Copies are found without gathering them: the smallest id of a
digest is a partial minimum, and a document is a first one if (digest, id) joins it, a key that no group
of copies makes hot. Rows that repeat an id are one counted row before they are joined.

Null texts are empty; nulls and '' in `lang` are one part ''. Of several labels of one id the largest
value of each column counts, null is 0. A null id has no labels, and neither is a copy nor makes one.
Rows that repeat an id and text count each, and are no copies of each other. An empty table has no
parts, so no rows. Extra columns are not read.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codetide.llm.text import SPACE
from codetide.session import Stages

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(ORDERS) * len(FILTERS)
#: Outcomes of a step: one field each, in this order.
OUTCOMES = ("kept", "removed", "redundant", "unique_fails")
FIELD_BYTES = 8

RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, " \
         "good_lost long, toxic_lost long, shapley long"


def outcomes(mask: int) -> np.ndarray:
    """0 or 1 for each step of each order and each outcome, of a document that fails the filters in `mask` (bit i: FILTERS[i])."""
    fails = {name for i, name in enumerate(FILTERS) if mask >> i & 1}
    rows = []
    for order in ORDERS:
        gone = False
        for name in order:
            hit = name in fails
            rows.append((not gone and not hit, hit and not gone, hit and gone, fails == {name}))
            gone = gone or hit
    return np.array(rows, np.uint64)


def packed(mask: int) -> int:
    """The outcomes of all steps as one integer, the first in the lowest field."""
    return int.from_bytes(outcomes(mask).astype("<u8").tobytes(), "little")


def unpacked(total: int) -> np.ndarray:
    """The fields of a sum: one row per step, one column per outcome."""
    data = total.to_bytes(STEPS * len(OUTCOMES) * FIELD_BYTES, "little")
    return np.frombuffer(data, "<u8").reshape(STEPS, len(OUTCOMES)).astype(np.int64)


def audit(counts: pa.Table) -> pa.Table:
    """All rows of one part, from its counted masks (at most 128)."""
    every = good = toxic = 0
    for row in counts.to_pylist():
        amount = row["n"] * packed(row["mask"])
        every += amount
        good += amount * row["good"]
        toxic += amount * row["toxic"]
    fields = unpacked(every)
    removed = fields[:, OUTCOMES.index("removed")]
    names = np.array([name for order in ORDERS for name in order])
    shapley = {name: int(removed[names == name].sum()) for name in FILTERS}
    columns = {
        "part": [counts["part"][0].as_py()] * STEPS,
        "filter_order": [order for order in ORDERS for _ in order],
        "step": list(range(1, len(FILTERS) + 1)) * len(ORDERS),
        **{name: fields[:, i] for i, name in enumerate(OUTCOMES)},
        "good_lost": unpacked(good)[:, OUTCOMES.index("removed")],
        "toxic_lost": unpacked(toxic)[:, OUTCOMES.index("removed")],
        "shapley": [shapley[name] for name in names],
    }
    types = {"part": pa.string(), "filter_order": pa.string(), "step": pa.int32()}
    return pa.table({name: pa.array(values, types.get(name, pa.int64())) for name, values in columns.items()})


def measured(documents: DataFrame, doc: str, text: str, part: str) -> DataFrame:
    """doc, digest, part, fails (mask of the filters that need this row alone: A to D)."""
    found = documents.select(
        F.col(doc).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    # The words are a column before they are counted, so that the text is split once.
    split = found.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    sized = split.select("doc", "text", "part", F.size("words").alias("n"), F.size(F.array_distinct("words")).alias("different"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]++", ""))
    checks = (F.col("n") < 200, 100 * F.col("different") < 50 * F.col("n"), 100 * capitals > 3 * F.length("text"), F.col("text").rlike("[#$%&*|]"))
    mask = sum((F.when(check, 1 << i).otherwise(0) for i, check in enumerate(checks)), F.lit(0))
    return sized.select("doc", F.unhex(F.sha2("text", 256)).alias("digest"), "part", mask.cast("int").alias("fails"))


def masks(documents: DataFrame, labels: DataFrame, keep, *, doc: str, text: str, part: str) -> DataFrame:
    """part, mask, good, toxic, n: documents counted by what they fail and how they are labelled."""
    rows = keep(measured(documents, doc, text, part), "measured")
    known = rows.where("doc IS NOT NULL")
    counted = known.groupBy("doc", "digest", "part", "fails").agg(F.count("*").alias("n"))
    firsts = known.groupBy("digest").agg(F.min("doc").alias("doc")).withColumn("first", F.lit(True))
    marked = keep(counted.join(firsts, ["digest", "doc"], "left").select(
        "doc", "part", "n", (F.col("fails") + F.when(F.col("first"), 0).otherwise(1 << 4)).alias("mask")), "marked")
    flags = keep(labels.where(F.col(doc).isNotNull()).groupBy(F.col(doc).cast("long").alias("doc")).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"),
        F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic")), "flags")
    flagged = marked.join(flags, "doc", "left").select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "n")
    unnamed = rows.where("doc IS NULL").groupBy("part", "fails").agg(F.count("*").alias("n")) \
        .select("part", F.col("fails").alias("mask"), F.lit(0).alias("good"), F.lit(0).alias("toxic"), "n")
    return flagged.union(unnamed).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def audited(documents: DataFrame, labels: DataFrame, *, doc: str = "doc_id", text: str = "text", part: str = "lang", keep=None) -> DataFrame:
    """600 rows per part: what each filter does at each step of each order."""
    keep = keep or Stages(documents.sparkSession).keep
    return masks(documents, labels, keep, doc=doc, text=text, part=part).groupBy("part").applyInArrow(audit, RESULT)
