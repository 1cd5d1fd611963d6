"""TF-IDF search over sparse postings.

The postings (``field, token, id, weight``) are what dense vectors over the vocabulary would hold besides zeros: scores are the
same and the size follows the text. Document frequencies come from all fields of a row together and are
shared by the fields; ``idf = ln((1 + N) / (1 + df)) + 1``; weights are L2-normalised for each row and field.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relweave.functions.text import tokens
from relweave.semantic.base import SemanticBackend
from relweave.semantic.dense import Dense, EmbeddingModel

ALL = "__all__"
#: Words that stand for another: fixed values of the product vocabulary.
SYNONYMS = {"widget": "gadget", "widgets": "gadget", "gizmo": "gadget", "gizmos": "gadget"}


def _fold(token: Column, synonyms: Mapping[str, str]) -> Column:
    for target in sorted(set(synonyms.values())):
        token = F.when(token.isin([a for a, b in synonyms.items() if b == target]), target).otherwise(token)
    return token


def query_tokens(query: str) -> list[str]:
    """What `tokens` gives, on the driver."""
    return "".join(c if c == "_" or unicodedata.category(c)[0] in "LN" else " " for c in query.lower()).split()


class TfIdf(SemanticBackend):
    def __init__(self, entity: str, fields: list[str], postings: DataFrame, idf: DataFrame, synonyms: Mapping[str, str]) -> None:
        self.entity, self.fields, self.postings, self.idf, self.synonyms = entity, fields, postings, idf, synonyms

    @classmethod
    def build(cls, df: DataFrame, entity: str, id_col: str, fields: list[str], synonyms: Mapping[str, str] = SYNONYMS) -> TfIdf:
        """An index of text columns; rows without text count among N, null texts have no tokens."""
        texts = df.select(F.col(id_col).alias("id"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
        # one explode for all fields: a token counts for its own field and for all of them
        def of_field(i: int, name: str) -> Column:
            found = F.coalesce(tokens(F.col(f"f{i}")), F.array().cast("array<string>"))
            return F.transform(found, lambda t: F.struct(F.lit(name).alias("field"), _fold(t, synonyms).alias("token")))

        words = F.flatten(F.array(*[of_field(i, f) for i, f in enumerate(fields)]))
        by_field = texts.select("id", F.inline(words)).groupBy("field", "id", "token").agg(F.count(F.lit(1)).alias("tf"))
        total = by_field.groupBy("id", "token").agg(F.sum("tf").alias("tf"))
        n = df.agg(F.count(F.lit(1))).scalar()
        idf = total.groupBy("token").agg((F.log((1.0 + n) / (1.0 + F.count(F.lit(1)))) + 1.0).alias("idf"))
        tf = by_field.unionByName(total.withColumn("field", F.lit(ALL)))
        w = tf.join(idf, "token").withColumn("x", F.col("tf") * F.col("idf"))
        norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("field", "id")))
        return cls(entity, list(fields), w.select("field", "token", "id", (F.col("x") / norm).alias("weight")), idf, synonyms)

    def write(self, path: str) -> None:
        """The index as two tables; postings are clustered by token, so a query reads few row groups."""
        self.postings.repartitionByRange("token").sortWithinPartitions("token").write.mode("overwrite").parquet(f"{path}/postings")
        self.idf.write.mode("overwrite").parquet(f"{path}/idf")

    @classmethod
    def read(cls, spark: SparkSession, path: str, entity: str, fields: list[str], synonyms: Mapping[str, str] = SYNONYMS) -> TfIdf:
        return cls(entity, fields, spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/idf"), synonyms)

    def query_weights(self, query: str) -> tuple[list[str], DataFrame]:
        """The query's tokens, and ``token, q`` of those that are known, L2-normalised."""
        words = Counter(self.synonyms.get(t, t) for t in query_tokens(query))
        if not words:
            return [], self.idf.select("token", F.lit(0.0).alias("q")).limit(0)
        times = F.element_at(F.create_map(*[F.lit(x) for pair in words.items() for x in pair]), F.col("token"))
        w = self.idf.filter(F.col("token").isin(list(words))).select("token", (times * F.col("idf")).alias("x"))
        size = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(F.lit(1))))  # a row for each word asked for
        return list(words), w.select("token", (F.col("x") / size).alias("q"))

    def search(self, entity: str, fields: list[str] | str, query: str, top_k: int = 100) -> DataFrame:
        """``id, score``: scores summed over the fields asked for (all together by default); only positive scores."""
        if entity != self.entity:
            raise KeyError(f"Entity '{entity}' has no semantic index")
        wanted = [fields] if isinstance(fields, str) else list(fields or [])
        if unknown := [f for f in wanted if f not in self.fields]:
            raise ValueError(f"Fields {unknown} are not indexed for '{entity}'")
        # the words are literals, so that the scan of a written index skips all other row groups
        words, weights = self.query_weights(query)
        own = self.postings.filter(F.col("field").isin(wanted or [ALL]) & F.col("token").isin(words))
        hits = own.join(F.broadcast(weights), "token")
        scores = hits.groupBy("id").agg(F.sum(F.col("q") * F.col("weight")).alias("score")).filter("score > 0")
        return scores.orderBy(F.desc(F.round("score", 12)), "id").limit(top_k)


#: An index as one JSON object, the older form; a row has ``vectors`` by field or a single ``vector``.
LEGACY = "entity string, kind string, fields array<string>, vocab array<string>, idf array<double>, embeddings array<struct<id: string, vector: array<double>, vectors: map<string, array<double>>>>"


def read_json_index(spark: SparkSession, path: str, entity: str, id_type: T.DataType | str = "string", synonyms: Mapping[str, str] = SYNONYMS, model: EmbeddingModel | None = None) -> SemanticBackend:
    """An index in a JSON file: postings of the vectors of ``kind`` tfidf (the default), else `Dense` vectors.

    The vector of all fields is ``__all__``, ``vector`` among the vectors, or the row's single ``vector``, whichever comes first, else zeros; a field that
    has none of its own uses it. Ids get ``id_type``. A file of another entity is a `ValueError`. One such file is read by one task: write what is
    returned (`TfIdf.write`) where it is large.
    """
    one = spark.read.schema(LEGACY).option("multiLine", True).option("mode", "FAILFAST").json(path)
    head = one.select("entity", F.coalesce("kind", F.lit("tfidf")).alias("kind"), F.coalesce("fields", F.array().cast("array<string>")).alias("fields")).first()
    if head is None or head["entity"] != entity:
        raise ValueError(f"the index in {path} is of {head['entity'] if head else None!r}, not of {entity!r}")
    rows = one.select("vocab", F.explode("embeddings").alias("e")).select("vocab", F.col("e.id").cast(id_type).alias("id"), "e.vector", "e.vectors")
    named = lambda f: F.try_element_at("vectors", F.lit(f))
    zeros = F.transform(F.coalesce("vocab", F.array().cast("array<string>")), lambda _: F.lit(0.0))
    whole = F.when(F.col("vectors").isNotNull(), F.coalesce(F.when(F.size(named(ALL)) > 0, named(ALL)), named("vector"))).otherwise(F.col("vector"))
    rows = rows.withColumn("all", F.coalesce(whole, zeros))
    each = [F.struct(F.lit(f).alias("field"), (F.col("all") if f == ALL else F.coalesce(named(f), F.col("all"))).alias("vector")) for f in [ALL, *head["fields"]]]
    vectors = rows.select("id", "vocab", F.inline(F.array(*each)))
    if head["kind"] != "tfidf":
        return Dense(entity, list(head["fields"]), vectors.select("field", "id", "vector"), model)
    postings = vectors.select("field", "id", "vocab", F.posexplode("vector").alias("at", "weight")).filter("weight <> 0").select("field", F.get("vocab", "at").alias("token"), "id", "weight")
    idf = one.select(F.inline(F.arrays_zip("vocab", "idf"))).select(F.col("vocab").alias("token"), "idf")
    return TfIdf(entity, list(head["fields"]), postings, idf, synonyms)
