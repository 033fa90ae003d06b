"""Models as replaceable parts, with deterministic offline defaults."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType


class Embedder(Protocol):
    """Adds a unit vector ``vec`` (array of double) to rows with a column ``text``."""

    model: str
    dim: int

    def embed(self, rows: DataFrame) -> DataFrame: ...


class HashingEmbedder:
    """Word counts hashed to ``dim`` places, scaled to unit length; no model file is needed."""

    model = "hashing"

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def embed(self, rows: DataFrame) -> DataFrame:
        named = rows.withColumn("_text", F.coalesce("text", F.lit("")))
        words = Tokenizer(inputCol="_text", outputCol="_words").transform(named)
        counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=self.dim).transform(words)
        unit = Normalizer(inputCol="_counts", outputCol="_unit", p=2.0).transform(counts)
        return unit.withColumn("vec", vector_to_array("_unit")).drop("_text", "_words", "_counts", "_unit")


class BatchEmbedder:
    """A Python model's ``encode(texts) -> vectors`` over Arrow batches, loaded once per task."""

    def __init__(self, load, model: str, dim: int, batch: int = 256) -> None:
        self.load, self.model, self.dim, self.batch = load, model, dim, batch

    def embed(self, rows: DataFrame) -> DataFrame:
        load, batch = self.load, self.batch

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            encode = load()
            for frame in frames:
                texts = frame["text"].fillna("").tolist()
                vectors = [v for i in range(0, len(texts), batch) for v in encode(texts[i : i + batch])]
                yield frame.assign(vec=[[float(x) for x in v] for v in vectors])

        return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField("vec", ArrayType(DoubleType()))]))


class Judge(Protocol):
    """Answers a prompt; called only for rows that no cheaper rule decided."""

    def complete(self, prompt: str, max_tokens: int) -> str: ...


class UncertainJudge:
    """Decides nothing, so that rows stay up for review."""

    def complete(self, prompt: str, max_tokens: int) -> str:
        return '{"verdict": "uncertain", "evidence": "no judge configured"}'
