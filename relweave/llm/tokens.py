"""Encoding of a corpus with a public byte-level vocabulary, and back."""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relweave.llm.bpe import Decoder, Encoder, MergeList, read_ranks
from relweave.plans.partitioning import spread

#: Where vocabulary files are looked for unless a path is given.
FOLDER = "/opt/tokenizers"


def load_merges(path: str = "byte_bpe_50k.tiktoken") -> MergeList:
    """A merge list from a rank file; a relative path is one below ``RELWEAVE_TOKENIZERS`` or ``FOLDER``."""
    with open(os.path.join(os.environ.get("RELWEAVE_TOKENIZERS", FOLDER), path), "rb") as f:
        return MergeList(read_ranks(f.read()))


def _ids(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            flat, ends = array("i"), [0]
            for text in batch.column(1).to_pylist():
                flat.extend(encoder.encode(text))
                ends.append(len(flat))
            # the buffers are handed over as they are
            values = pa.array(np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], ["id", "ids"])

    return encode


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", merges: MergeList | None = None) -> DataFrame:
    """``doc_id, ids``: the token ids of every row's whole text, no special tokens.

    Defined cases: a null or empty text has the empty list; a null id stays null; repeated rows give repeated rows; strings that
    look like special tokens are ordinary text; very long texts are encoded slice by slice; an empty table gives no
    rows; other columns are not looked at. Nothing is shuffled; the merge list, of a fixed size, is broadcast.
    """
    merges = merges or load_merges()
    merges.lookahead()
    rows = docs.select(F.col(id_col).alias("id"), F.make_valid_utf8(F.col(text_col)).alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    shared = docs.sparkSession.sparkContext.broadcast(merges)
    return spread(rows).mapInArrow(_ids(shared), schema).select(F.col("id").alias(id_col), "ids")


def decode_corpus(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", merges: MergeList | None = None) -> DataFrame:
    """``doc_id, text`` of ids; an empty or null list is the empty text, an unfinished character U+FFFD. An id outside the vocabulary is an error."""
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    shared = encoded.sparkSession.sparkContext.broadcast(merges or load_merges())

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decoder.decode(x) for x in batch.column(1).to_pylist()], pa.string())], ["id", "text"])

    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("text", T.StringType())])
    return rows.mapInArrow(decode, schema).select(F.col("id").alias(id_col), "text")
