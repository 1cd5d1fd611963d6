"""Dense vectors: exact top-k by dot product of unit vectors, and rows of a vector store."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relweave.functions.text import similarity_from_distance
from relweave.semantic.base import SemanticBackend

ALL = "__all__"


class EmbeddingModel(Protocol):
    def embed_documents(self, texts: Sequence[str]) -> list[list[float]]: ...

    def embed_query(self, text: str) -> list[float]: ...


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Longest query vector that is written out term by term, which runs inside generated code.
UNROLLED = 256


def dot_with(v: Column, query: Sequence[float]) -> Column:
    """The product with a known vector; null for a null vector or one of another length."""
    if len(query) > UNROLLED:
        product = dot(v, F.lit(list(map(float, query))))
    else:
        product = reduce(lambda a, b: a + b, [F.get(v, F.lit(i)).cast("double") * float(x) for i, x in enumerate(query)], F.lit(0.0))
    return F.when(F.size(v) == len(query), product)


def unit_of(query: Sequence[float]) -> list[float]:
    size = math.sqrt(sum(float(x) * float(x) for x in query))
    return [float(x) / size if size else 0.0 for x in query]


def top_k(vectors: DataFrame, query: Sequence[float], k: int, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """``id, score`` (cosine) of the best rows; every row is scored, and each task passes on k rows at most.

    A zero vector scores 0; null vectors, and vectors of another length, take no part.
    """
    own = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    scored = own.select("id", dot_with(F.col("v"), unit_of(query)).alias("d"), size.alias("n")).filter("d is not null")
    scored = scored.select("id", F.when(F.col("n") > 0, F.col("d") / F.col("n")).otherwise(0.0).alias("score"))
    return scored.orderBy(F.desc(F.round("score", 12)), "id").limit(k)


class Dense(SemanticBackend):
    """Vectors of rows and fields: ``field, id, vector``."""

    def __init__(self, entity: str, fields: list[str], vectors: DataFrame, model: EmbeddingModel | None = None) -> None:
        self.entity, self.fields, self.vectors, self.model = entity, fields, vectors, model

    @classmethod
    def build(cls, df: DataFrame, entity: str, id_col: str, fields: list[str], model: EmbeddingModel) -> Dense:
        """Vectors of each field and of all fields joined by a blank; a null text is embedded as an empty one."""
        texts = [F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("")).alias("text")) for f in fields]
        joined = F.concat_ws(" ", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
        rows = df.select(F.col(id_col).alias("id"), F.inline(F.array(*texts, F.struct(F.lit(ALL).alias("field"), joined.alias("text")))))
        vectors = rows.select("field", "id", embed(model)(F.col("text")).alias("vector"))
        return cls(entity, list(fields), vectors, model)

    def search(self, entity: str, fields: list[str] | str, query: str, top_k: int = 100) -> DataFrame:
        """``id, score`` summed over the fields; scores of zero and less are kept."""
        if self.model is None:
            raise RuntimeError("Searching dense vectors by text needs the embedding model")
        return self.search_vector(entity, fields, self.model.embed_query(query), top_k)

    def search_vector(self, entity: str, fields: list[str] | str, query: Sequence[float], top_k: int = 100) -> DataFrame:
        if entity != self.entity:
            raise KeyError(f"Entity '{entity}' has no semantic index")
        wanted = [fields] if isinstance(fields, str) else list(fields or [])
        if unknown := [f for f in wanted if f not in self.fields]:
            raise ValueError(f"Fields {unknown} are not indexed for '{entity}'")
        own = self.vectors.filter(F.col("field").isin(wanted or [ALL])).select("id", dot_with(F.col("vector"), unit_of(query)).alias("s"))
        return own.groupBy("id").agg(F.sum("s").alias("score")).orderBy(F.desc(F.round("score", 12)), "id").limit(top_k)


def embed(model: EmbeddingModel) -> Callable[[Column], Column]:
    """Vectors of a text column, of length 1 unless they are zero."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            v = np.array(model.embed_documents(list(texts)), dtype=float).reshape(len(texts), -1)
            size = np.sqrt((v * v).sum(axis=1, keepdims=True))
            yield pd.Series(list(np.divide(v, size, out=v, where=size > 0)), dtype=object)

    return apply


class Store(SemanticBackend):
    """Rows that a vector store returns: ``metadata map<string,string>, value double``.

    ``fetch`` gives them for a query and k. With a ``model`` the store is asked by the query's vector instead, through ``fetch_by_vector``;
    a store that can't be asked so is a `TypeError`.
    """

    def __init__(
        self,
        spark: SparkSession,
        fetch: Callable[[str, int], DataFrame] | None = None,
        *,
        entity_key: str = "entity",
        field_key: str = "field",
        id_keys: Sequence[str] = ("id", "pk"),
        score_kind: str = "distance",
        model: EmbeddingModel | None = None,
        fetch_by_vector: Callable[[list[float], int], DataFrame] | None = None,
    ) -> None:
        if score_kind not in ("distance", "similarity"):
            raise ValueError(f"Unknown score kind {score_kind!r}")
        if model is not None and not callable(fetch_by_vector):
            raise TypeError("a model is given, but the vector store can't be asked by a vector (fetch_by_vector)")
        if model is None and not callable(fetch):
            raise TypeError("the vector store can't be asked by a text (fetch), and no model is given")
        self.model, self.fetch_by_vector = model, fetch_by_vector
        self.spark, self.fetch, self.entity_key, self.field_key, self.id_keys, self.score_kind = spark, fetch, entity_key, field_key, tuple(id_keys), score_kind

    def search(self, entity: str, fields: list[str] | str, query: str, top_k: int = 100) -> DataFrame:
        wanted = [fields] if isinstance(fields, str) else list(fields or [])
        meta = lambda k: F.try_element_at("metadata", F.lit(k))
        found = self.fetch(query, top_k) if self.model is None else self.fetch_by_vector(list(self.model.embed_query(query)), top_k)
        own = found.filter(meta(self.entity_key).isNull() | (meta(self.entity_key) == entity))
        if wanted:
            own = own.filter(meta(self.field_key).isin(wanted))
        score = similarity_from_distance(F.col("value")) if self.score_kind == "distance" else F.col("value")
        found = own.select(F.coalesce(*[meta(k) for k in self.id_keys]).alias("id"), score.alias("score")).filter("id is not null")
        return found.orderBy(F.desc("score"), "id").limit(top_k)
