"""What a semantic backend offers to the compiler."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame


class SemanticBackend(ABC):
    @abstractmethod
    def search(self, entity: str, fields: list[str], query: str, top_k: int = 100) -> DataFrame:
        """``id, score`` of the best ``top_k`` rows, best first; ids in the key column's own type."""


class Router(SemanticBackend):
    """One backend for each entity."""

    def __init__(self, backends: dict[str, SemanticBackend]) -> None:
        self.backends = backends

    def search(self, entity: str, fields: list[str], query: str, top_k: int = 100) -> DataFrame:
        if entity not in self.backends:
            raise KeyError(f"Entity '{entity}' has no semantic index")
        return self.backends[entity].search(entity, fields, query, top_k)


class Fixed(SemanticBackend):
    """Ready-made matches (``entity, id, score``), for adapters of external search services."""

    def __init__(self, matches: DataFrame) -> None:
        self.matches = matches

    def search(self, entity: str, fields: list[str], query: str, top_k: int = 100) -> DataFrame:
        from pyspark.sql import functions as F

        return self.matches.filter(F.col("entity") == entity).select("id", "score").orderBy(F.desc("score"), "id").limit(top_k)
