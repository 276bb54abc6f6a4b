"""Corpus filtering, chunking and incremental maintenance of the chunk index.

Index state is two tables: chunks (repo, file_path, chunk_index, ..., embedding) and the
ledger of content hashes (repo, file_path, content_hash). Change detection shuffles only
keys and hashes. Contents are read again and chunked where they lie: all of them where nothing
was indexed before, else those whose 64-bit mark is among the changed files' marks, which
travel to the contents. Only marks beyond a stated number make the contents travel.
"""

from pyspark.sql import DataFrame, Window, functions as F

from codetide.functions import paths, symbols, text

FILE = ["repo", "file_path"]

# Stored text length per chunk.
STORED_CHARS = 500
# Marks of changed files that may be broadcast: 8 bytes each, some 64 MB as a hash table.
BROADCAST_MARKS = 2_000_000


def label_eligibility(files: DataFrame) -> DataFrame:
    """Add `outcome`: NULL inside skipped directories, else skipped_type, skipped_size or eligible."""
    path = F.col("file_path")
    return files.withColumn(
        "outcome",
        F.when(paths.in_skipped_directory(path), F.lit(None).cast("string"))
        .when(~paths.is_indexed_type(path), "skipped_type")
        .when(F.col("size_bytes") > paths.MAX_FILE_BYTES, "skipped_size")
        .otherwise("eligible"),
    )


def eligible_files(files: DataFrame) -> DataFrame:
    """Files a full index covers; plain filters, so they reach the scan."""
    path = F.col("file_path")
    return files.where(
        ~paths.in_skipped_directory(path) & paths.is_indexed_type(path) & (F.col("size_bytes") <= paths.MAX_FILE_BYTES))


def hashed_keys(files: DataFrame) -> DataFrame:
    """Keys with content hash, and whether the content could be decoded."""
    return files.select(
        *FILE, F.col("content").isNotNull().alias("decodable"), text.content_hash(F.col("content")).alias("content_hash"))


def one_per_file(hashed: DataFrame) -> DataFrame:
    """`hashed_keys` with one row per file; of a file that is listed twice a readable version counts, then the largest hash."""
    best = F.max(F.struct("decodable", "content_hash"))
    return hashed.groupBy(*FILE).agg(best.alias("_best")).select(*FILE, "_best.decodable", "_best.content_hash")


def changed_keys(hashed: DataFrame, ledger: DataFrame) -> DataFrame:
    """Decodable files whose hash is absent from the ledger or differs, with the new hash."""
    stored = ledger.select(*FILE, F.col("content_hash").alias("_stored"))
    return (
        hashed.where("decodable")
        .join(stored, FILE, "left")
        .where(~F.col("content_hash").eqNullSafe(F.col("_stored")))
        .select(*FILE, "content_hash")
    )


def chunk_files(files: DataFrame) -> DataFrame:
    """Chunks of each file: a structure summary if parseable, then the whole text or 50-line blocks.

    `seq` counts the chunks of a file from 0. Narrow: one row in, its chunks out. The outer explode
    only avoids an inferred filter that would chunk twice; every readable file has a chunk.
    """
    path, content = F.col("file_path"), F.col("content")
    summary = F.when(
        F.col("language").isNotNull(),
        F.struct(
            F.lit("file_summary").alias("chunk_type"), path.alias("name"),
            F.concat(F.lit("File: "), path, F.lit("\n\n"), symbols.structure_summary()).alias("content")),
    )
    whole = F.array(F.struct(F.lit("full_file").alias("chunk_type"), path.alias("name"), content.alias("content")))
    body = F.when(F.length(content) < text.WHOLE_FILE_CHARS, whole).otherwise(text.line_blocks(F.col("_lines"), path))
    return (
        symbols.with_symbols(files.where(content.isNotNull()))
        .withColumn("_lines", text.lines(content))
        .select(*FILE, F.posexplode_outer(F.concat(F.array_compact(F.array(summary)), body)).alias("seq", "chunk"))
        .select(*FILE, F.col("seq").cast("bigint").alias("seq"), "chunk.chunk_type", "chunk.name", "chunk.content")
    )


def number_valid_chunks(embedded: DataFrame) -> DataFrame:
    """Drop chunks without a vector and number the rest from 0 inside their file.

    A file without failed chunks has its numbers already. In the others positions, not texts, are
    counted in order, and joined to the chunks by file and position: rows of a fixed width, however
    many chunks a file has and however many failed.
    """
    valid = F.coalesce(F.size("embedding") > 0, F.lit(False))
    positions = embedded.select(*FILE, "seq", valid.alias("_valid"))
    failed = positions.where("NOT _valid").select(*FILE).distinct()
    inside = Window.partitionBy(*FILE).orderBy("seq")
    numbers = (
        positions.where("_valid").join(failed, FILE, "left_semi")
        .select(*FILE, "seq", (F.row_number().over(inside) - 1).cast("bigint").alias("_number")))
    return (
        embedded.where(valid).join(numbers, [*FILE, "seq"], "left")
        .withColumn("chunk_index", F.coalesce("_number", "seq")).drop("_number")
    )


def cut_texts(embedded: DataFrame) -> DataFrame:
    """Only the head of a chunk's text is stored; the vector was made from all of it."""
    return embedded.withColumn("content", F.substring("content", 1, STORED_CHARS))


def to_index_rows(numbered: DataFrame) -> DataFrame:
    return cut_texts(numbered).select(
        *FILE, F.col("chunk_index").cast("bigint").alias("chunk_index"),
        F.coalesce("chunk_type", F.lit("code")).alias("chunk_type"), F.coalesce("name", F.lit("")).alias("name"),
        "content", F.col("embedding").cast("array<double>").alias("embedding"),
    )


def contents_of(files: DataFrame, hashed: DataFrame, changed: DataFrame, nothing_indexed: bool, broadcast_marks: int = BROADCAST_MARKS) -> DataFrame:
    """Contents (repo, file_path, content) of the changed files, each once.

    `hashed` has the keys and hashes of all `files`, one row per listed one; `changed` those to read, one
    row per file. Both are counted, so they should be kept tables. No content is shuffled, but for files that are
    listed more than once, and when more than `broadcast_marks` files of known repositories changed.
    """
    twice = hashed.groupBy(*FILE).count().where("count > 1").select(*FILE)
    slim = files.select(*FILE, "content")
    repeated = not twice.isEmpty()
    if nothing_indexed and not repeated:
        return slim.where(F.col("content").isNotNull())
    mark = F.xxhash64("repo", "file_path", "content_hash")
    marks = changed.select(mark.alias("_mark"))
    if changed.count() <= broadcast_marks:
        marks = F.broadcast(marks)
    hashed_content = slim.withColumn("content_hash", text.content_hash(F.col("content")))
    found = hashed_content.where(F.col("content").isNotNull()).join(marks, mark == F.col("_mark"), "left_semi").select(*FILE, "content")
    if not repeated:
        return found
    # Rows of one file that are left have one hash, so any of them will do.
    return found.join(twice, FILE, "left_anti").unionByName(found.join(twice, FILE, "left_semi").dropDuplicates(FILE))


def replace_chunks(chunks: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """Chunk table after re-indexing: old rows of re-indexed files go, new rows come."""
    touched = new_chunks.select(*FILE).distinct()
    return chunks.join(touched, FILE, "left_anti").unionByName(new_chunks)


def new_hashes(changed: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """Hashes of files that got a valid chunk; the others keep their old entry and are retried."""
    return changed.join(new_chunks.select(*FILE).distinct(), FILE, "left_semi")


def replace_hashes(ledger: DataFrame, hashes: DataFrame) -> DataFrame:
    """Ledger after re-indexing."""
    return ledger.join(hashes.select(*FILE), FILE, "left_anti").unionByName(hashes)


def delete_files(chunks: DataFrame, ledger: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunk table and ledger without the removed files."""
    keys = removed.select(*FILE).distinct()
    return chunks.join(keys, FILE, "left_anti"), ledger.join(keys, FILE, "left_anti")


def index_stats(chunks: DataFrame, ledger: DataFrame) -> DataFrame:
    """Chunks and indexed files per repository; indexed files are those of the ledger."""
    counted = chunks.groupBy("repo").agg(F.count(F.lit(1)).alias("total_chunks"))
    files = ledger.groupBy("repo").agg(F.count(F.lit(1)).alias("indexed_files"))
    return counted.join(files, "repo", "full").fillna(0, ["total_chunks", "indexed_files"])


def label_run(files: DataFrame, hashed: DataFrame, new_chunks: DataFrame, full: bool = True) -> DataFrame:
    """Outcome of an index run per file: indexed, skipped or errors.

    A full run ignores skipped directories and counts ineligible files as skipped; an incremental
    run takes every listed file. Reads paths, sizes and hashes, not contents.
    """
    if full:
        labelled = label_eligibility(files).where(F.col("outcome").isNotNull())
    else:
        labelled = files.withColumn("outcome", F.lit("eligible"))
    # A file that is listed twice is one file, eligible if one of its rows is.
    labelled = labelled.groupBy(*FILE).agg(F.min("outcome").alias("outcome"))
    stored = new_chunks.select(*FILE).distinct().withColumn("_stored", F.lit(True))
    return (
        labelled.join(hashed, FILE, "left").join(stored, FILE, "left")
        .select(
            *FILE,
            F.when(F.col("outcome") != "eligible", "skipped")
            .when(~F.coalesce("decodable", F.lit(False)), "errors")
            .when(F.col("_stored"), "indexed")
            .otherwise("skipped").alias("outcome"))
    )


def run_stats(labelled: DataFrame) -> DataFrame:
    """Counts of `label_run` per repository."""
    count = lambda name: F.count_if(F.col("outcome") == name).alias(name)
    return labelled.groupBy("repo").agg(count("indexed"), count("skipped"), count("errors"))
