"""Benchmark decontamination: find benchmark passages in documents, remove spans or documents.

Words are runs of digits, ASCII letters and non-ASCII characters, A-Z lower-cased. A window is `width`
consecutive words of a benchmark item; an item of fewer words, but not none, is one window. A document
word inside any occurrence of a window is hit.

A window of n words that occurs in a document covers one whole run of m = (n + 1) / 2 words that starts at
a multiple of m. So a first scan looks up only every m-th position, by the hash of its m words, in the set
of all such runs of the items; documents without any match are done. In the rest every position is looked up by the hash
of its n words, and what matches is compared word by word. A set is broadcast only if its rows, counted
first, are within `broadcast_rows`; beyond that the same join shuffles both sides. Only matches leave the
scan, so a hot document or passage adds rows in proportion to its own words.

Null and empty texts have no words and no hits; null items have no windows. Items of null id hit words
but are not listed. Rows with the same id and text get the same result, each row kept; rows with the same
id and different texts are judged apart. Extra columns pass through `remove`; `hits` returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codetide.llm.text import ascii_lower

# Words and separators before lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WIDTH = 13
BROADCAST_ROWS = 200_000


def words(column):
    """Array of the normalised words of a text; empty for null."""
    return F.filter(F.split(F.coalesce(ascii_lower(column), F.lit("")), SEPARATORS), lambda w: w != "")


def fits(table: DataFrame, rows: int) -> bool:
    return table.limit(rows + 1).count() <= rows


def bounded(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if fits(table, rows) else table


def hashes(w: str, n: int, step: int, with_words: bool = False):
    """Hash of the n words from every step-th position of array column `w`, as structs (start from 1, n, h).

    Equal to the hash of the array of these words; slices of a long array would each copy all of it.
    """
    starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    at = lambda i: [F.element_at(w, i + k) for k in range(n)]
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(n).alias("n"), F.xxhash64(*at(i)).alias("h"),
                                                  *([F.array(*at(i)).alias("words")] if with_words else [])))


def marks(w: str, sizes: list[tuple[int, int]], with_words: bool = False):
    parts = [hashes(w, n, step, with_words) for n, step in sizes]
    empty = F.array().cast(f"array<struct<start:int,n:int,h:bigint{',words:array<string>' if with_words else ''}>>")
    return F.explode(F.concat(*parts) if parts else empty)


def candidates(documents: DataFrame, benchmark: DataFrame, sizes: list[int], doc: str, text: str, item_text: str, broadcast_rows: int) -> DataFrame:
    """doc, version, w of the documents that share a run of half a window with an item."""
    halves = sorted({(n + 1) // 2 for n in sizes})
    runs = benchmark.select(words(F.col(item_text)).alias("w")).select(marks("w", [(m, 1) for m in halves]).alias("m")) \
        .select("m.n", "m.h").distinct()
    version = F.xxhash64(text)
    source = documents.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), version.alias("version"), F.col(text).alias("whole"), words(F.col(text)).alias("w"))
    positions = marks("w", [(m, m) for m in halves]).alias("m")
    if fits(runs, broadcast_rows):
        # One stage from scan to match: texts go along, and only those of documents found are shuffled.
        found = source.select("doc", "whole", positions).select("doc", "whole", "m.n", "m.h").join(F.broadcast(runs), ["h", "n"]) \
            .select("doc", F.xxhash64("whole").alias("version"), "whole").dropDuplicates(["doc", "version"])
    else:
        # Positions are shuffled as hash and key, a fixed width; texts are fetched once for the documents found.
        keys = source.select("doc", "version", positions).select("doc", "version", "m.n", "m.h").join(runs, ["h", "n"]) \
            .select(F.col("doc").alias("_doc"), F.col("version").alias("_version")).distinct()
        slim = source.select("doc", "version", "whole")
        found = slim.join(keys, slim["doc"].eqNullSafe(keys["_doc"]) & (slim["version"] == keys["_version"]), "left_semi")
    return found.select("doc", "version", words(F.col("whole")).alias("w"))


def benchmark_windows(benchmark: DataFrame, item: str, text: str, width: int) -> DataFrame:
    """Windows of the items: h, n, window, item."""
    w = benchmark.select(F.col(item).alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1))))
    windows = w.select("item", "w", starts.alias("i")).select("item", F.slice("w", F.col("i"), width).alias("window"))
    return windows.select(F.xxhash64("window").alias("h"), F.size("window").alias("n"), "window", "item").distinct()


def hits(documents: DataFrame, benchmark: DataFrame, *, doc: str = "doc_id", text: str = "text", item: str = "item_id",
         item_text: str = "text", width: int = WIDTH, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Documents with occurrences: doc, version (hash of the text), spans (start, n), items (ids as text, sorted).

    Lists of a document are bounded by its own length.
    """
    windows = benchmark_windows(benchmark, item, item_text, width)
    sizes = sorted(r["n"] for r in windows.select("n").distinct().collect())  # at most `width` values
    near = candidates(documents, benchmark, sizes, doc, text, item_text, broadcast_rows)
    # A row carries the words of its own position, never those of the whole document.
    wanted = bounded(windows.select("h", "n", "window").distinct(), broadcast_rows)
    found = near.select("doc", "version", marks("w", [(n, 1) for n in sizes], with_words=True).alias("m")).select("doc", "version", "m.*") \
        .join(wanted, ["h", "n"]).where(F.col("words") == F.col("window")).select("doc", "version", "start", "h", "n", "window")
    hit = found.groupBy("doc", "version").agg(
        F.collect_set(F.struct((F.col("start") - 1).alias("start"), "n")).alias("spans"), F.collect_set(F.struct("h", "n", "window")).alias("found"))
    # Items come in after the match: a window that many items share is one entry until then. Spans go with the first entry.
    each = hit.select("doc", "version", "spans", F.posexplode("found").alias("at", "f")) \
        .select("doc", "version", F.when(F.col("at") == 0, F.col("spans")).alias("spans"), "f.h", "f.n", "f.window")
    return each.join(bounded(windows, broadcast_rows), ["h", "n", "window"]).groupBy("doc", "version").agg(
        F.first("spans", ignorenulls=True).alias("spans"), F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))


def hit_positions(spans):
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1))))


def report(documents: DataFrame, benchmark: DataFrame, *, doc: str = "doc_id", text: str = "text", share: int = 20,
           **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_hash.

    A document is contaminated if any word is hit and at least one in `share` of its words is.
    """
    found = hits(documents, benchmark, doc=doc, text=text, **options) \
        .select("doc", "version", F.size(hit_positions(F.col("spans"))).cast("long").alias("hit"), "items")
    base = documents.select(
        F.col(doc).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    joined = base.join(found, base["doc_id"].eqNullSafe(found["doc"]) & (base["text_hash"] == found["version"]), "left")
    n_hit = F.coalesce("hit", F.lit(0))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"), "text_hash")


def remove(documents: DataFrame, benchmark: DataFrame, *, doc: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    bad = report(documents, benchmark, doc=doc, text=text, **options).where("contaminated") \
        .select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash")).distinct()
    same = documents[doc].eqNullSafe(bad["__doc"]) & (F.xxhash64(documents[text]) == bad["__hash"])
    return documents.join(bad, same, "left_anti")


def remove_spans(documents: DataFrame, benchmark: DataFrame, *, doc: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """All documents; where words are hit, `text` becomes the normalised words that are not, space-joined."""
    found = hits(documents, benchmark, doc=doc, text=text, **options) \
        .select(F.col("doc").alias("__doc"), F.col("version").alias("__hash"), hit_positions(F.col("spans")).alias("__hit"))
    same = documents[doc].eqNullSafe(found["__doc"]) & (F.xxhash64(documents[text]) == found["__hash"])
    kept = F.array_join(F.filter(words(documents[text]), lambda w, i: ~F.array_contains("__hit", i)), " ")
    out = documents.join(found, same, "left")
    return out.select(*[F.when(F.col("__hit").isNull(), documents[c]).otherwise(kept).alias(c) if c == text else documents[c]
                        for c in documents.columns])
