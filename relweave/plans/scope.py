"""Names inside one query: which joined table a reference means, and what its column is called."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class Slot:
    """A table's place in the join chain. Every column is renamed before the join, so nothing can clash."""

    index: int
    entity: str
    key: str | None
    columns: tuple[str, ...]
    types: dict[str, T.DataType]

    def internal(self, column: str) -> str:
        return f"t{self.index}:{column}"


@dataclass
class Scope:
    root: Slot
    joined: list[Slot] = field(default_factory=list)

    def of_entity(self, entity: str) -> list[Slot]:
        return [s for s in self.joined if s.entity == entity]

    def has(self, entity: str) -> bool:
        return entity == self.root.entity or bool(self.of_entity(entity))

    def slot(self, name: str | None) -> Slot:
        """The root by default or by its entity's name; a joined table by its relation, or by its entity if that is joined once."""
        if name is None or name == self.root.entity:
            return self.root
        for s in self.joined:
            if s.key == name:
                return s
        found = self.of_entity(name)
        if not found:
            raise ValueError(f"Unknown entity/relation '{name}'")
        if len(found) > 1:
            raise ValueError(f"Ambiguous reference '{name}'. Use relation key: {[s.key for s in found]}")
        return found[0]

    def label(self, s: Slot) -> str:
        """The name that a joined table's columns carry when nothing is selected by name."""
        return s.entity if s.entity != self.root.entity and len(self.of_entity(s.entity)) == 1 else str(s.key)

    def split(self, reference: str, entity: str | None = None) -> tuple[str, str]:
        """The entity or relation and the column of ``column``, ``entity.column`` or ``relation.column``."""
        if entity is None and "." in reference and reference not in self.root.columns:
            entity, reference = reference.split(".", 1)
        return entity or self.root.entity, reference

    def resolve(self, reference: str, entity: str | None = None) -> tuple[Column, T.DataType, str]:
        """A reference's column, its type, and its name in the result."""
        owner, name = self.split(reference, entity)
        s = self.slot(owner)
        if name not in s.columns:
            raise KeyError(f"Column '{name}' not found in '{owner}'")
        out = name if owner == self.root.entity else f"{owner}__{name}"
        return F.col(quoted(s.internal(name))), s.types[name], out


def enter(df: DataFrame, index: int, entity: str, key: str | None, columns: list[str]) -> tuple[DataFrame, Slot]:
    """A table under internal names, with the declared columns only."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"Table of '{entity}' lacks columns {missing}")
    s = Slot(index, entity, key, tuple(columns), {c: df.schema[c].dataType for c in columns})
    return df.select(*[F.col(quoted(c)).alias(s.internal(c)) for c in columns]), s
