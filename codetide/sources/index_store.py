"""The chunk index on disk: a log of segments, and a manifest that names those in force.

A segment is two parquet tables: `chunks` of the files it brings, and `files`, one row per file with its hash, or marked
as removed. An update writes one segment with the files it changes and nothing else; then it
puts a manifest with the next version number beside the older ones, by one rename. Readers take the
highest version, so a writer that dies leaves the old version as it was, and of two writers that start
from one version the second fails. Of several segments that name a file the last one counts; reading
drops the rows of the others by a join with the keys of later segments, which are as small as the updates.

`compact` merges the last segments while they are of similar size, so their number stays near
the logarithm of the index and every row is rewritten about that often. `vacuum` deletes what no recent
version names. Rows of a segment are dealt by ranges of repository and path, a hot repository over several,
and sorted, so row-group statistics find a repository.
"""

import json
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from codetide import schemas
from codetide.operators import indexing
from codetide.sources.folder import Folder
from codetide.sources.readers import read_table

FILE = ["repo", "file_path"]
# Segments of similar size are merged when there are this many.
FAN = 4
FILES = T.StructType(schemas.FILE_HASHES.fields + [T.StructField("removed", T.BooleanType())])


class Layout(NamedTuple):
    """Table of a segment: its folder, columns, and the columns by whose ranges its rows are dealt and sorted."""

    table: str
    schema: T.StructType
    order: list[str]


CHUNKS = Layout("chunks", schemas.CHUNKS, FILE)


class Conflict(Exception):
    """The index has a newer version than the one this change started from."""


def same_file(a: DataFrame, b: DataFrame) -> Column:
    """Equal repository and path; a missing repository equals another missing one."""
    return a["repo"].eqNullSafe(b["repo"]) & (a["file_path"] == b["file_path"])


def versions(spark: SparkSession, path: str) -> list[int]:
    """Version numbers of an index that can be read, in order."""
    names = Folder(spark, path).names()
    return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))


def segments(spark: SparkSession, path: str, version: int | None = None) -> list[dict]:
    """Segments in force (name, bytes), oldest first."""
    known = versions(spark, path)
    if not known:
        return []
    return json.loads(Folder(spark, path).read(f"manifest-{known[-1] if version is None else version:012d}.json"))["segments"]


def _commit(spark: SparkSession, path: str, before: int, parts: list[dict]) -> None:
    text = json.dumps({"version": before + 1, "segments": parts})
    if not Folder(spark, path).write_new(f"manifest-{before + 1:012d}.json", text, f".manifest-{uuid.uuid4().hex}"):
        raise Conflict(f"{path} has a version {before + 1} already")


def _version(spark: SparkSession, path: str) -> int:
    return (versions(spark, path) or [0])[-1]


def _named(rows: DataFrame, names: list[str]) -> DataFrame:
    """A missing repository is the one named ''."""
    return rows.select(*names).fillna("", ["repo"])


def _dealt(rows: DataFrame, order: list[str] = FILE) -> DataFrame:
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def _write_segment(path: str, files: DataFrame, rows: DataFrame | None, layout: Layout = CHUNKS) -> dict | None:
    """A new segment, not yet in force; None if it would name no file."""
    spark, name = files.sparkSession, f"segments/{uuid.uuid4().hex}"
    _dealt(_named(files, FILES.fieldNames())).write.parquet(f"{path}/{name}/files")
    if spark.read.schema(FILES).parquet(f"{path}/{name}/files").isEmpty():
        Folder(spark, path).delete(name)
        return None
    if rows is not None:
        _dealt(_named(rows, layout.schema.fieldNames()), layout.order).write.parquet(f"{path}/{name}/{layout.table}")
    return {"name": name, "bytes": Folder(spark, path).size(name)}


def _union(spark: SparkSession, path: str, parts: list[dict], table: str, schema: T.StructType, skip_corrupt: bool = False) -> DataFrame:
    """Rows of a table in all segments, with `segment`, their place in the log."""
    out = spark.createDataFrame([], T.StructType(schema.fields + [T.StructField("segment", T.IntegerType(), False)]))
    for number, part in enumerate(parts):
        rows = read_table(spark, f"{path}/{part['name']}/{table}", schema, skip_corrupt).withColumn("segment", F.lit(number))
        out = rows if number == 0 else out.unionByName(rows)
    return out


def _in_force(rows: DataFrame, files: DataFrame, parts: list[dict]) -> DataFrame:
    """Rows whose file no later segment names."""
    if len(parts) < 2:
        return rows
    later = files.where("segment > 0").select(*FILE, F.col("segment").alias("_later"))
    return rows.join(later, same_file(rows, later) & (later["_later"] > rows["segment"]), "left_anti")


def read_log(
    spark: SparkSession, path: str, parts: list[dict], skip_corrupt: bool = False, repos: list[str] | None = None, layout: Layout = CHUNKS,
) -> tuple[DataFrame, DataFrame]:
    """(rows, files) in force, files with `removed`."""
    wanted = F.col("file_path").isNotNull() & (F.lit(True) if repos is None else F.col("repo").isin(repos))
    files = _union(spark, path, parts, "files", FILES, skip_corrupt).where(wanted)
    rows = _union(spark, path, parts, layout.table, layout.schema, skip_corrupt).where(wanted)
    return _in_force(rows, files, parts).drop("segment"), _in_force(files, files, parts).drop("segment")


def load_index(
    spark: SparkSession, path: str, skip_corrupt: bool = False, repos: list[str] | None = None, version: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(chunks, ledger) of an index, of some repositories or of an older version; empty tables if there is none yet."""
    chunks, files = read_log(spark, path, segments(spark, path, version), skip_corrupt, repos)
    return chunks, files.where(~F.coalesce("removed", F.lit(False))).drop("removed")


def append(spark: SparkSession, path: str, files: DataFrame, rows: DataFrame | None, layout: Layout = CHUNKS) -> None:
    """One more segment: the rows of the files that it names; without rows these are marked as removed."""
    before = _version(spark, path)
    part = _write_segment(path, files, rows, layout)
    if part is not None:
        _commit(spark, path, before, [*(segments(spark, path, before) if before else []), part])


def update_index(spark: SparkSession, path: str, new_chunks: DataFrame, new_hashes: DataFrame) -> None:
    """Store re-indexed files: chunks and hashes of the files in `new_hashes` are replaced."""
    append(spark, path, new_hashes.withColumn("removed", F.lit(False)), new_chunks)


def remove_files(spark: SparkSession, path: str, removed: DataFrame) -> None:
    """Drop files from the index."""
    keys = removed.fillna("", ["repo"]).select(*FILE).distinct()
    append(spark, path, keys.select(*FILE, F.lit(None).cast("string").alias("content_hash"), F.lit(True).alias("removed")), None)


def save_index(path: str, chunks: DataFrame, ledger: DataFrame) -> None:
    """Write a whole index, in place of whatever is at `path`."""
    spark = chunks.sparkSession
    before, part = _version(spark, path), _write_segment(path, ledger.withColumn("removed", F.lit(False)), chunks)
    _commit(spark, path, before, [part] if part else [])


def compact(spark: SparkSession, path: str, fan: int = FAN, layout: Layout = CHUNKS) -> bool:
    """Merge the last segments if at least `fan` of them are of similar size; True if so."""
    before = _version(spark, path)
    parts = segments(spark, path, before) if before else []
    first, total = len(parts) - 1, parts[-1]["bytes"] if parts else 0
    while first > 0 and parts[first - 1]["bytes"] <= 2 * total:
        first -= 1
        total += parts[first]["bytes"]
    if len(parts) - first < max(fan, 2):
        return False
    rows, files = read_log(spark, path, parts[first:], layout=layout)
    if first == 0:  # nothing lies below that a mark of removal would have to hide
        files = files.where(~F.coalesce("removed", F.lit(False)))
    part = _write_segment(path, files, rows, layout)
    _commit(spark, path, before, [*parts[:first], *([part] if part else [])])
    return True


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Delete all but the last `keep` versions, and segments that none of these names: not while an update is under way."""
    folder, known = Folder(spark, path), versions(spark, path)
    used = {part["name"] for version in known[-keep:] for part in segments(spark, path, version)}
    for version in known[:-keep]:
        folder.delete(f"manifest-{version:012d}.json")
    for name in Folder(spark, f"{path}/segments").names():
        if f"segments/{name}" not in used:
            folder.delete(f"segments/{name}")


def repaired_ledger(chunks: DataFrame, ledger: DataFrame) -> DataFrame:
    """Ledger without files that have no chunk, as lost files of a store may leave them."""
    files = chunks.select(*FILE).distinct()
    return ledger.join(files, same_file(ledger, files), "left_semi")


def stats(spark: SparkSession, path: str) -> DataFrame:
    """Chunk and file counts per repository; reads no texts and no vectors."""
    return indexing.index_stats(*load_index(spark, path))
