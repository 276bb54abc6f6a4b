"""Text expressions: fingerprints, added lines, line blocks."""

from pyspark.sql import Column, functions as F

# Chunking limits.
WHOLE_FILE_CHARS = 4000
BLOCK_LINES = 50


def content_hash(content: Column) -> Column:
    """First 16 hex characters of the SHA-256 of the text."""
    return F.substring(F.sha2(content, 256), 1, 16)


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def added_code(patch: Column) -> Column:
    """Lines of a diff that start with `+`, the sign kept."""
    return F.array_join(F.filter(lines(patch), lambda line: F.startswith(line, F.lit("+"))), "\n")


def line_blocks(lines_col: Column, path: Column) -> Column:
    """Blocks of 50 lines as (chunk_type, name, content) structs; linear in the file's size.

    `lines_col` must be a materialised column, not an expression, as it is read per block.
    """
    n = F.size(lines_col)
    starts = F.sequence(F.lit(0), F.floor((n - 1) / BLOCK_LINES).cast("int"))

    def block(b: Column) -> Column:
        first = b * BLOCK_LINES
        last = F.least(first + BLOCK_LINES, n)
        return F.struct(
            F.lit("code_chunk").alias("chunk_type"),
            F.concat(path, F.lit(":L"), (first + 1).cast("string"), F.lit("-"), last.cast("string")).alias("name"),
            F.array_join(F.slice(lines_col, first + 1, BLOCK_LINES), "\n").alias("content"),
        )

    return F.transform(starts, block)
