"""Mixing sources to target weights.

Sources in code point order, null last, get the weights in turn and share `total` times all words by
weight. No target exceeds `most` times its source's words; what is above is shared again by weight among
the others until none is above. A document is emitted floor(rate) times, rate = target / words of its
source, plus one copy if the hash of its id and text falls below the fraction of the rate.

Words are counted once per document in the scan; what is shuffled is one partial sum per source and task.
The decision of a document needs only its source's rate, which is joined by source. The rank of sources
is taken from range-partitioned sources, so no task holds all of them.

Null texts count 0 words; a source without words has rate 0 and emits nothing. Null sources are one
source. Equal rows get equal decisions. Extra columns pass through `mixed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from codetide.llm.text import word_count
from codetide.session import Stages

WEIGHTS, TOTAL, MOST, SEED = (5, 2, 1), 1.5, 2, "mix"


def draw(doc: Column, text: Column, seed: str) -> Column:
    """Uniform in [0, 1), from the first 52 bits of a digest: the same in every run."""
    key = F.concat_ws("|", F.lit(seed), F.coalesce(doc.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, keep, *, weights=WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """source, source_size, target from rows (source, size). `keep(df, name)` stores a stage."""
    per_source = keep(sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), "source_sizes")
    ranged = keep(
        per_source.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "ranged_sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range partition, a number fixed by the settings and not by the data.
    offsets = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    turn = (F.col("offset") + F.row_number().over(inside) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    ranked = keep(ranged.join(offsets, "part").select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(most)).alias("cap")), "weights")
    sums = ranked.agg(F.sum("source_size").alias("all"), F.sum("weight").alias("w")).first()
    goal, level = total * (sums["all"] or 0), 0.0
    caps, w = 0.0, sums["w"] or 0.0
    while w > 0:  # the level rises until no further source is above its cap
        new = (goal - caps) / w
        if new <= level:
            break
        level = new
        row = ranked.agg(F.sum(F.when(F.col("cap") < F.lit(level) * F.col("weight"), F.col("cap")).otherwise(0.0)).alias("caps"),
                         F.sum(F.when(F.col("cap") < F.lit(level) * F.col("weight"), 0.0).otherwise(F.col("weight"))).alias("w")).first()
        caps, w = row["caps"], row["w"]
    target = F.when(F.col("cap") < F.lit(level) * F.col("weight"), F.col("cap")).otherwise(F.lit(level) * F.col("weight"))
    return ranked.select("source", "source_size", target.alias("target"))


def planned(documents: DataFrame, *, doc: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED,
            **options) -> DataFrame:
    """One row per document: doc_id, text_hash, source_size, target, size, copies, taken."""
    stages = Stages(documents.sparkSession)
    sized = stages.keep(documents.select(
        F.col(doc).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
        F.xxhash64(text).alias("text_hash"), draw(F.col(doc), F.col(text), seed).alias("u")), "sized")
    targets = source_targets(sized, stages.keep, **options).withColumnRenamed("source", "of")
    joined = sized.join(targets, sized["source"].eqNullSafe(targets["of"]))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor(rate) + (F.col("u") < rate - F.floor(rate)).cast("long")
    return joined.withColumn("copies", copies).select(
        "doc_id", "text_hash", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(documents: DataFrame, *, doc: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The mix: every document as often as it is taken, with all its columns and `copy` (from 0)."""
    plan = planned(documents, doc=doc, text=text, **options).where("copies > 0") \
        .select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"), F.col("copies").alias("__copies")).distinct()
    same = documents[doc].eqNullSafe(plan["__doc"]) & (F.xxhash64(documents[text]) == plan["__hash"])
    copy = "copy" if "copy" not in documents.columns else "mix_copy"
    return documents.join(plan, same).select(
        *[documents[c] for c in documents.columns], F.explode(F.sequence(F.lit(0), (F.col("__copies") - 1).cast("int"))).alias(copy))
