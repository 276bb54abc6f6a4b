"""Vector expressions and the block kernel of the similarity search."""

import hashlib
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

# The kernels travel with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: keeps zero vectors finite.
EPSILON = 1e-8
# Scores are compared at this many decimals, so their order does not depend on summation order.
SCORE_DECIMALS = 12
# Values in a matrix: 4 MB.
BLOCK_VALUES = 1 << 19
# Rows of a matrix that are scored in one product, and candidates per query above which a product is scored in doubles as a whole.
TILE_ROWS, DENSE_CANDIDATES = 1024, 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two double arrays."""
    scaled = dot(a, b) / ((norm(a) + F.lit(EPSILON)) * (norm(b) + F.lit(EPSILON)))
    return F.round(scaled, SCORE_DECIMALS)


def unit_rows(vectors: pa.ListArray) -> np.ndarray:
    """Rows of one Arrow list column as normalised doubles."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    matrix = flat.reshape(len(vectors), -1)
    return matrix / (np.linalg.norm(matrix, axis=1, keepdims=True) + EPSILON)


BLOCK_FIELDS = "repo string, dim int, ids array<string>, ords array<bigint>, matrix binary"
PAIR_FIELDS = "repo string, query_id string, id string, ord bigint, similarity double"


def pack_blocks(rows_per_block: int):
    """mapInArrow function: vectors (repo, dim, id, ord, embedding), sorted by repo and dim, to matrices of bounded height and size.

    A block goes on over the borders of Arrow batches and ends with its key, its height, its size or the task. Its rows stand in
    the order in which ties are broken: by ord, then id.
    """

    def block(key: tuple, parts: list[pa.Table]) -> dict:
        table = pa.concat_tables(parts).combine_chunks()
        ids, ords = table.column("id").to_pylist(), table.column("ord").to_pylist()
        rows = sorted(range(len(ids)), key=lambda r: (ords[r] is not None, ords[r] or 0, ids[r] is not None, ids[r] or ""))
        matrix = unit_rows(table.column("embedding").combine_chunks())[rows]
        return {"repo": key[0], "dim": key[1], "ids": [ids[r] for r in rows], "ords": [ords[r] for r in rows], "matrix": matrix.tobytes()}

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("repo", pa.string()), ("dim", pa.int32()), ("ids", pa.list_(pa.string())), ("ords", pa.list_(pa.int64())), ("matrix", pa.binary())])
        key, parts, height = None, [], 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([batch])
            codes = table.column("repo").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
            dims, out = table.column("dim").to_numpy(), []
            edges = [0, *(np.flatnonzero((np.diff(codes) != 0) | (np.diff(dims) != 0)) + 1).tolist(), table.num_rows]
            for first, end in zip(edges, edges[1:]):
                own = table.column("repo")[first].as_py(), int(dims[first])
                if own != key and parts:
                    out.append(block(key, parts))
                    parts, height = [], 0
                key, most = own, max(1, min(rows_per_block, BLOCK_VALUES // own[1]))
                while first < end:
                    take = min(end - first, most - height)
                    parts.append(table.slice(first, take))
                    first, height = first + take, height + take
                    if height == most:
                        out.append(block(key, parts))
                        parts, height = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if parts:
            yield pa.RecordBatch.from_pylist([block(key, parts)], schema)

    return pack


def top_k_of_block_pair(chunks: np.ndarray, queries: np.ndarray, k: int):
    """(query row, chunk row, score) of each query's k best chunks in one block; ties by chunk row."""
    scores = np.round(chunks @ queries.T, SCORE_DECIMALS)
    n = scores.shape[0]
    if n <= k:
        chunk_rows, query_rows = np.divmod(np.arange(scores.size), scores.shape[1])
        return query_rows, chunk_rows, scores[chunk_rows, query_rows]
    bound = np.partition(scores, n - k, axis=0)[n - k]
    query_rows, chunk_rows = np.nonzero((scores >= bound).T)
    return _best_of_each(query_rows, chunk_rows, scores[chunk_rows, query_rows], k)


def _best_of_each(query_rows, chunk_rows, scores, k: int):
    """Of (query row, chunk row, score) rows each query's k best, ties by chunk row; ordered by query row, best first."""
    order = np.lexsort((chunk_rows, -scores, query_rows))
    query_rows, chunk_rows, scores = query_rows[order], chunk_rows[order], scores[order]
    place = np.arange(len(order)) - np.searchsorted(query_rows, query_rows)
    kept = place < k
    return query_rows[kept], chunk_rows[kept], scores[kept]


def raise_best(best: np.ndarray, query_rows, scores) -> None:
    """Put scores, ordered by query row and at most k each, into `best`: per query its k best scores so far, ascending."""
    touched, first, counts = np.unique(query_rows, return_index=True, return_counts=True)
    new = np.full((len(touched), best.shape[1]), -np.inf)
    new[np.repeat(np.arange(len(touched)), counts), np.arange(len(scores)) - np.repeat(first, counts)] = scores
    best[touched] = np.sort(np.concatenate([best[touched], new], axis=1), axis=1)[:, best.shape[1]:]


def _near_in_doubles(tile: np.ndarray, queries: np.ndarray, bound: np.ndarray | None, k: int):
    """(query row, chunk row) of a tile's chunks that reach the bound, or of each query's k best where these are too many."""
    found = []
    for first in range(0, len(queries), TILE_ROWS):
        part = queries[first:first + TILE_ROWS]
        near = None if bound is None else np.flatnonzero(part @ tile.T >= bound[first:first + TILE_ROWS] - 10.0 ** (1 - SCORE_DECIMALS))
        if near is None or len(near) > DENSE_CANDIDATES * len(part):
            query_rows, chunk_rows, _ = top_k_of_block_pair(tile, part, k)
        else:
            query_rows, chunk_rows = np.divmod(near, len(tile))
        found.append((query_rows + first, chunk_rows))
    return tuple(np.concatenate(column) for column in zip(*found))


def hits_of_block_pair(chunks: np.ndarray, queries: np.ndarray, best: np.ndarray):
    """(query row, chunk row, score) of chunks that may be among each query's k best, with every one that is; at most k per query.

    `best` holds each query's k best scores so far, ascending, and is brought up to date. Products are taken in single
    precision. Their error is below `slack` for unit rows, so whoever is not within it of the k-th best score cannot enter;
    the few others are scored again in doubles.
    """
    k, narrow, found = best.shape[1], queries.astype(np.float32), []
    slack = (queries.shape[1] + 8) * 2.0 ** -23
    for start in range(0, len(chunks), TILE_ROWS):
        tile = chunks[start:start + TILE_ROWS]
        bound = best[:, :1]
        known = np.isfinite(bound).all()
        near = np.flatnonzero(narrow @ tile.astype(np.float32).T >= (bound - slack).astype(np.float32)) if known else None
        if near is None or len(near) > DENSE_CANDIDATES * len(queries):
            query_rows, chunk_rows = _near_in_doubles(tile, queries, bound if known else None, k)
        else:
            query_rows, chunk_rows = np.divmod(near, len(tile))
        # Summed pair by pair, equal vectors have equal scores.
        scores = np.round(np.einsum("ij,ij->i", queries[query_rows], tile[chunk_rows]), SCORE_DECIMALS)
        entering = scores >= best[query_rows, 0]
        query_rows, chunk_rows, scores = _best_of_each(query_rows[entering], chunk_rows[entering], scores[entering], k)
        raise_best(best, query_rows, scores)
        found.append((query_rows, chunk_rows + start, scores))
    query_rows, chunk_rows, scores = (np.concatenate(column) for column in zip(*found))
    kept = scores >= best[query_rows, 0]
    return _best_of_each(query_rows[kept], chunk_rows[kept], scores[kept], k)


def score_against(vector: list[float], k: int):
    """mapInArrow function: rows with an `embedding` to each batch's k best (and ties), scored against one vector."""
    query = np.asarray(vector, np.float64)
    query = query / (np.linalg.norm(query) + EPSILON)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            lengths = table.column("embedding").combine_chunks().value_lengths().fill_null(0).to_numpy()
            table = table.take(np.flatnonzero(lengths == len(query)))
            if table.num_rows == 0:
                continue
            scores = np.round(unit_rows(table.column("embedding").combine_chunks()) @ query, SCORE_DECIMALS)
            if len(scores) > k:
                best = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
                table, scores = table.take(best), scores[best]
            table = table.drop_columns(["embedding"]).append_column("similarity", pa.array(scores, pa.float64()))
            yield from table.to_batches()

    return score


def score_block_pairs(k: int, rows_per_batch: int = 8192):
    """mapInArrow function: (chunk block, query block) rows to rows that may be in the top k, and all that are.

    While a task meets pairs of one repository and width it remembers the k best scores of each query, 8 k bytes a query, so that
    later blocks return only what beats them.
    """

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("repo", "query_id", "id", "ord", "similarity")
        types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64())
        out, rows = {name: [] for name in names}, 0
        own, so_far = None, {}

        def drained() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(out[name], kind) for name, kind in zip(names, types)], names=list(names))

        for batch in batches:
            columns = {name: batch.column(name) for name in batch.schema.names}
            for i in range(batch.num_rows):
                dim, repo = columns["dim"][i].as_py(), columns["repo"][i].as_py()
                ids, ords, query_ids = columns["ids"][i], columns["ords"][i], columns["query_ids"][i].as_py()
                chunks = np.frombuffer(columns["matrix"][i].as_buffer(), np.float64).reshape(-1, dim)
                queries = np.frombuffer(columns["query_matrix"][i].as_buffer(), np.float64).reshape(-1, dim)
                if own != (repo, dim):
                    own, so_far = (repo, dim), {}
                if np.isfinite(chunks).all() and np.isfinite(queries).all():
                    # Equal vectors have equal best scores, so a digest of the matrix is key enough.
                    best = so_far.setdefault(hashlib.blake2b(queries, digest_size=16).digest(), np.full((len(queries), k), -np.inf))
                    query_rows, chunk_rows, scores = hits_of_block_pair(chunks, queries, best)
                else:
                    query_rows, chunk_rows, scores = top_k_of_block_pair(chunks, queries, k)
                taken = pa.array(chunk_rows)
                out["repo"] += [repo] * len(scores)
                out["query_id"] += [query_ids[q] for q in query_rows]
                out["id"] += ids.values.take(taken).to_pylist()
                out["ord"] += ords.values.take(taken).to_pylist()
                out["similarity"] += scores.tolist()
                rows += len(scores)
                if rows >= rows_per_batch:
                    yield drained()
                    out, rows = {name: [] for name in names}, 0
        if rows:
            yield drained()

    return score
