"""The catalog: entities, relations between them, and the table behind each entity."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, field, replace
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Declared column types. Anything else is read as text.
TYPES = {"text": T.StringType(), "string": T.StringType(), "int": T.LongType(), "integer": T.LongType(), "float": T.DoubleType(), "double": T.DoubleType(), "date": T.DateType(), "bool": T.BooleanType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}
CARDINALITIES = ("1_to_1", "1_to_many", "many_to_1", "many_to_many")
JOINS = {"inner": "inner", "left": "left", "right": "right", "outer": "full"}


@dataclass(frozen=True)
class Column:
    name: str
    type: str = "text"
    role: str | None = None
    semantic: bool = False


@dataclass(frozen=True)
class Entity:
    name: str
    columns: tuple[Column, ...] = ()
    label: str | None = None
    source: str | None = None
    semantic_text_fields: tuple[str, ...] = ()
    planning_hint: str | None = None

    @property
    def primary_key(self) -> str | None:
        keys = [c.name for c in self.columns if c.role == "primary_key"]
        return keys[0] if len(keys) == 1 else None

    def same(self, other: Entity) -> bool:
        """Whether both describe one table, in whatever order the columns stand."""
        order = lambda e: sorted((c.name, c.type, c.role or "", c.semantic) for c in e.columns)
        return (self.name, self.label, order(self)) == (other.name, other.label, order(other))


@dataclass(frozen=True)
class Relation:
    name: str
    from_entity: str
    from_column: str
    to_entity: str
    to_column: str
    cardinality: str = "many_to_1"
    join: str = "left"
    semantic_hint: str | None = None
    planning_hint: str | None = None

    def __post_init__(self) -> None:
        if self.join not in JOINS:
            raise ValueError(f"Unknown join type {self.join!r} of relation {self.name!r}")
        if self.cardinality not in CARDINALITIES:
            raise ValueError(f"Unknown cardinality {self.cardinality!r} of relation {self.name!r}")


@dataclass(frozen=True)
class Schema:
    name: str = "default"
    entities: tuple[Entity, ...] = ()
    relations: tuple[Relation, ...] = ()
    label: str | None = None
    description: str | None = None
    planning_hints: tuple[str, ...] = ()
    examples: tuple[str, ...] = ()

    @classmethod
    def parse(cls, data: Mapping[str, Any]) -> Schema:
        """From a JSON object; a column's ``pk`` gives its role; keys that aren't known are passed over."""

        def pick(kind: type, raw: Mapping[str, Any], **more: Any) -> Any:
            names = kind.__dataclass_fields__
            given = {k: tuple(v) if isinstance(v, list) else v for k, v in raw.items() if k in names and k not in more and v is not None}
            return kind(**given, **more)

        def column(raw: Mapping[str, Any]) -> Column:
            return pick(Column, raw, role=raw.get("role") or ("primary_key" if raw.get("pk") else None))

        def relation(raw: Mapping[str, Any]) -> Relation:
            if isinstance(on := raw.get("join"), Mapping):
                raw = {**raw, "from_column": on.get("from_column"), "to_column": on.get("to_column"), "join": on.get("join_type", "left"), "from_entity": on.get("from_entity", raw.get("from_entity")), "to_entity": on.get("to_entity", raw.get("to_entity"))}
            return pick(Relation, raw)

        entities = tuple(pick(Entity, e, columns=tuple(map(column, e.get("columns", ())))) for e in data.get("entities", ()))
        return pick(cls, data, entities=entities, relations=tuple(map(relation, data.get("relations", ()))))

    @classmethod
    def load(cls, path: str | Path) -> Schema:
        return cls.parse(json.loads(Path(path).read_text(encoding="utf-8")))

    def dump(self) -> dict[str, Any]:
        return json.loads(json.dumps(asdict(self)))

    def save(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(self.dump(), ensure_ascii=False, indent=2, sort_keys=True), encoding="utf-8")

    def problems(self) -> list[str]:
        """What is wrong or missing; never an exception, since a partial schema can still be queried."""
        out: list[str] = []
        columns = {e.name: {c.name for c in e.columns} for e in self.entities}
        for e in self.entities:
            keys = [c.name for c in e.columns if c.role == "primary_key"]
            if not e.source:
                out.append(f"entity {e.name}: no source")
            if not e.columns:
                out.append(f"entity {e.name}: no columns")
            if not keys:
                out.append(f"entity {e.name}: no primary key")
            if len(keys) > 1:
                out.append(f"entity {e.name}: composite primary key {keys}")
            out += [f"entity {e.name}: unknown semantic field {f}" for f in e.semantic_text_fields if f not in columns[e.name]]
        for r in self.relations:
            for entity, col in ((r.from_entity, r.from_column), (r.to_entity, r.to_column)):
                if entity not in columns:
                    out.append(f"relation {r.name}: unknown entity {entity}")
                elif col not in columns[entity]:
                    out.append(f"relation {r.name}: unknown column {entity}.{col}")
        return out


@dataclass
class Catalog:
    """A schema bound to tables. ``loaders`` are called when an entity is first used; nothing is read before an action."""

    spark: SparkSession
    schema: Schema
    loaders: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)
    semantic: Any = None
    origin: dict[str, str] = field(default_factory=dict)
    #: Entities whose rows come over a connection, so that a filter sent along saves more than a scan.
    remote: set[str] = field(default_factory=set)
    #: A backend's own way to answer a request, by its kind (``query``, ``semantic_only``): from the parsed request to a frame. Else it is compiled.
    handlers: dict[str, Callable[[Any], DataFrame]] = field(default_factory=dict)

    def entity(self, name: str) -> Entity:
        for e in self.schema.entities:
            if e.name == name:
                return e
        raise KeyError(f"Entity '{name}' not found")

    def relation(self, name: str) -> Relation:
        found = [r for r in self.schema.relations if r.name == name]
        if not found:
            raise KeyError(f"Relation '{name}' not found")
        if len(found) > 1:
            raise ValueError("Multiple relations share the same name; set distinct relation.name in schema.")
        return found[0]

    def table(self, name: str) -> DataFrame:
        if name not in self.loaders:
            raise KeyError(f"Entity '{name}' has no table")
        return self.loaders[name]()

    def columns(self, name: str) -> list[str]:
        """Declared columns, else those of the table."""
        return [c.name for c in self.entity(name).columns] or self.table(name).columns

    def primary_key(self, name: str) -> str:
        if not (key := self.entity(name).primary_key):
            raise ValueError(f"Entity '{name}' has no single primary key")
        return key

    # --- builders -------------------------------------------------------------------------------------------

    @classmethod
    def from_frames(cls, spark: SparkSession, schema: Schema, frames: Mapping[str, DataFrame], semantic: Any = None) -> Catalog:
        return cls(spark, schema, {n: (lambda df=df: df) for n, df in frames.items()}, semantic, {n: schema.name for n in frames})

    @classmethod
    def from_schema(
        cls,
        spark: SparkSession,
        schema: Schema,
        format: str,
        *,
        data_dir: str | None = None,
        default_schema: str | None = None,
        table_name_resolver: Callable[[Entity], str | None] | None = None,
        options: Mapping[str, str] | None = None,
        semantic: Any = None,
        partitions: int = 1,
    ) -> Catalog:
        """Tables of ``csv``, ``parquet``, ``json`` or ``orc`` files below ``data_dir``, of catalog tables (``table``) or over ``jdbc`` (``options``).

        File formats leave out entities without a source. A table's name is what the resolver says, else the stem of a file
        source, else the source, else the entity's name; ``default_schema`` goes before names without a dot. A ``jdbc`` table with a primary key of
        integers is read over ``partitions`` connections, by ranges of the key between its least and greatest value, which the database is asked for.
        """
        files = ("csv", "parquet", "json", "orc")
        if format not in (*files, "table", "jdbc"):
            raise ValueError(f"Unknown format {format!r}")
        if format in files and data_dir is None:
            raise TypeError(f"data_dir is required for {format}")
        if format == "jdbc" and not options:
            raise TypeError("options with a url are required for jdbc")

        def table_name(e: Entity) -> str:
            name = table_name_resolver(e) if table_name_resolver else None
            name = name or (Path(e.source).stem if e.source and e.source.endswith(tuple("." + f for f in files)) else e.source) or e.name
            return f"{default_schema}.{name}" if default_schema and "." not in name else name

        def loader(e: Entity) -> Callable[[], DataFrame]:
            declared = T.StructType([T.StructField(c.name, TYPES.get(c.type, T.StringType()), c.role != "primary_key", {"role": c.role or "", "semantic": c.semantic}) for c in e.columns])

            def load() -> DataFrame:
                if format in files:
                    path = f"{data_dir}/{e.source}"
                    reader = spark.read.options(**(options or {}))
                    if format == "csv":
                        reader = reader.option("header", True).option("enforceSchema", False)
                    if format in ("csv", "json"):
                        return (reader.schema(declared) if e.columns else reader).format(format).load(path)
                    return reader.format(format).load(path)
                name = table_name(e)
                if format == "jdbc":
                    reader = spark.read.format("jdbc").options(**options)
                    key = next((c.name for c in e.columns if c.name == e.primary_key and c.type in ("int", "integer")), None)
                    if partitions > 1 and key:
                        quoted = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(options["url"]).quoteIdentifier(key)
                        least, most = spark.read.format("jdbc").options(**options).option("query", f"select min({quoted}) as a, max({quoted}) as b from {name}").load().first()
                        if least is not None:
                            reader = reader.options(partitionColumn=key, lowerBound=least, upperBound=most + 1, numPartitions=partitions)
                    return reader.option("dbtable", name).load()
                return spark.table(".".join(f"`{p}`" for p in name.split(".")))

            return load

        own = [e for e in schema.entities if e.source or format in ("table", "jdbc")]
        return cls(spark, schema, {e.name: loader(e) for e in own}, semantic, {e.name: schema.name for e in own}, {e.name for e in own} if format == "jdbc" else set())

    @classmethod
    def merge(cls, parts: Mapping[str, Catalog]) -> Catalog:
        """One catalog over several sources. What two of them both describe must be the same in both.

        A relation may lead from a source to another: it is an ordinary join to Spark.
        """
        entities: dict[str, Entity] = {}
        relations: dict[str, Relation] = {}
        merged = cls(next(iter(parts.values())).spark, Schema())
        for name, part in parts.items():
            for e in part.schema.entities:
                if e.name in entities and not entities[e.name].same(e):
                    raise ValueError(f"Conflicting definitions of entity '{e.name}'")
                entities.setdefault(e.name, e)
            for r in part.schema.relations:
                if r.name in relations and relations[r.name] != r:
                    raise ValueError(f"Conflicting definitions of relation '{r.name}'")
                relations.setdefault(r.name, r)
            for e, load in part.loaders.items():
                merged.loaders.setdefault(e, load)
                if merged.origin.setdefault(e, name) == name and e in part.remote:
                    merged.remote.add(e)
            merged.semantic = merged.semantic or part.semantic
        merged.schema = replace(merged.schema, name="+".join(parts), entities=tuple(entities.values()), relations=tuple(relations.values()))
        return merged

    # --- introspection --------------------------------------------------------------------------------------

    def entities_frame(self) -> DataFrame:
        rows = [(e.name, e.label, c.name, c.type, c.role, c.semantic) for e in self.schema.entities for c in e.columns]
        return self.spark.createDataFrame(rows, "entity string, label string, column string, type string, role string, semantic boolean")

    def relations_frame(self) -> DataFrame:
        rows = [(r.name, r.from_entity, r.from_column, r.to_entity, r.to_column, r.cardinality, r.join) for r in self.schema.relations]
        return self.spark.createDataFrame(rows, "relation string, from_entity string, from_column string, to_entity string, to_column string, cardinality string, join string")

    def violations(self) -> DataFrame:
        """Foreign keys without a parent: ``relation, key, n_rows``."""
        parts = []
        for r in self.schema.relations:
            if r.from_entity in self.loaders and r.to_entity in self.loaders:
                child = self.table(r.from_entity).select(F.col(r.from_column).alias("key")).filter("key is not null")
                parent = self.table(r.to_entity).select(F.col(r.to_column).alias("key"))
                lost = child.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows")).join(parent, "key", "left_anti")
                parts.append(lost.select(F.lit(r.name).alias("relation"), F.col("key").cast("string").alias("key"), "n_rows"))
        if not parts:
            return self.spark.createDataFrame([], "relation string, key string, n_rows long")
        return reduce(DataFrame.unionByName, parts)
