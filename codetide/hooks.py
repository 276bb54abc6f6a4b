"""Model hooks: text to vector and request to text.

A hook is a function from DataFrame to DataFrame. The defaults need no model; batch functions
of any model plug in through Arrow batches.
"""

import hashlib
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F, types as T

# The batch functions travel with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIMENSIONS = 768


def hashing_embedder(dimensions: int = DIMENSIONS, text_col: str = "content") -> Callable[[DataFrame], DataFrame]:
    """Bag-of-words vectors by feature hashing; empty texts get an empty vector."""

    def embed(df: DataFrame) -> DataFrame:
        tokens = RegexTokenizer(inputCol="_text", outputCol="_tokens", pattern=r"[^\p{L}\p{N}_]+", toLowercase=True)
        hashed = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dimensions)
        out = hashed.transform(tokens.transform(df.withColumn("_text", F.coalesce(text_col, F.lit("")))))
        vector = F.when(F.size("_tokens") > 0, vector_to_array("_tf")).otherwise(F.expr("cast(array() as array<double>)"))
        return out.withColumn("embedding", vector).drop("_text", "_tokens", "_tf")

    return embed


def digest_embedder(dimensions: int = 64, text_col: str = "content") -> Callable[[DataFrame], DataFrame]:
    """Bag-of-words vectors whose places come from a token's MD5, which any SQL engine can follow; empty texts get an empty vector.

    Tokens are counted in Arrow batches, in time linear in their number; a digest is taken once per distinct token of a batch.
    """

    def counted(tokens: pa.Array) -> pa.Array:
        sizes = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        coded, held = tokens.flatten().dictionary_encode(), sizes > 0
        places = np.array([int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dimensions for token in coded.dictionary.to_pylist()], np.int64)
        at = np.repeat(np.cumsum(held) - 1, sizes) * dimensions + places[coded.indices.to_numpy(zero_copy_only=False)]
        counts = np.bincount(at, minlength=int(held.sum()) * dimensions).astype(np.float64)
        ends = np.concatenate([[0], np.cumsum(held * dimensions)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(counts))

    # Marked as not deterministic, so that a filter on the vector is not moved below it, where it would count twice.
    vector = F.arrow_udf(counted, T.ArrayType(T.DoubleType())).asNondeterministic()

    def embed(df: DataFrame) -> DataFrame:
        lowered = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        return df.withColumn("embedding", vector(F.regexp_extract_all(lowered, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))))

    return embed


def _answers(model: Callable[[list], list], asked: list, failed) -> list:
    """The model's answers; where a batch fails its rows are asked one by one, and those that fail get `failed`."""
    try:
        return list(model(asked))
    except Exception:
        if len(asked) <= 1:
            return [failed] * len(asked)
    return [answer for one in asked for answer in _answers(model, [one], failed)]


def batch_embedder(model: Callable[[list[str]], list[list[float]]], text_col: str = "content") -> Callable[[DataFrame], DataFrame]:
    """Embedder around a function from a batch of texts to vectors; an empty vector marks failure, a raised error too."""

    def embed(df: DataFrame) -> DataFrame:
        schema = T.StructType(df.schema.fields + [T.StructField("embedding", T.ArrayType(T.DoubleType()))])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                vectors = _answers(model, [text or "" for text in pdf[text_col]], [])
                yield pdf.assign(embedding=[[float(x) for x in v] for v in vectors])

        return df.mapInPandas(run, schema)

    return embed


def batch_writer(model: Callable[[list[str]], list[str]], request_col: str = "request") -> Callable[[DataFrame], DataFrame]:
    """Text generator: replaces the request column by a `text` column, batch by batch; NULL where the model fails."""

    def write(df: DataFrame) -> DataFrame:
        kept = [f for f in df.schema.fields if f.name != request_col]
        schema = T.StructType(kept + [T.StructField("text", T.StringType())])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                texts = _answers(model, list(pdf[request_col]), None)
                yield pdf.drop(columns=[request_col]).assign(text=texts)

        return df.mapInPandas(run, schema)

    return write
