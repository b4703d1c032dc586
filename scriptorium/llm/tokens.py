"""Token ids and counts of text columns by a public byte-level tokenizer.

The rank file (under MAX_FILE bytes) is read once by the driver and broadcast; each Python
worker compiles it once. Rows are independent, so nothing is shuffled.

Defined cases: null and empty texts have an empty list and the count 0; blank texts and
special tokens' spellings are ordinary text; texts of any length are encoded whole, in
time proportional to their length; repeated rows, ties and other columns pass unchanged.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.transducer import Encoder
from scriptorium.session import ship

#: A larger rank file is refused rather than broadcast.
MAX_FILE = 64 << 20
_made: dict = {}


class Tokenizer:
    """A rank file and its pattern, sent to the workers and compiled there on first use."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        if os.path.getsize(path) > MAX_FILE:
            raise ValueError(f"{path} is larger than {MAX_FILE} bytes")
        with open(path, "rb") as file:
            data = file.read()
        self.key = (path, hash(data), pattern)
        ship(spark)
        self.sent = spark.sparkContext.broadcast((data, pattern))

    def encoder(self) -> Encoder:
        made = _made.get(self.key)
        if made is None:
            made = _made[self.key] = Encoder(*self.sent.value)
        return made


def public(spark: SparkSession, name: str = "byte_bpe_50k", folder: str | None = None) -> Tokenizer:
    """A tokenizer of the installed public ones, or of another folder with the same files."""
    import public_tokenizers

    return Tokenizer(spark, os.path.join(folder or os.path.dirname(public_tokenizers.__file__), f"{name}.tiktoken"), public_tokenizers.PATTERN)


def token_ids(df: DataFrame, id_col: str, text_col: str, tokenizer: Tokenizer) -> DataFrame:
    """(id, ids array<int>) of each row."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text = tokenizer.encoder().encode
        for batch in batches:
            lists = [encode_text(text) for text in batch.column(1).to_pylist()]
            offsets = np.zeros(len(lists) + 1, np.int64)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.fromiter((i for x in lists for i in x), np.int32, offsets[-1])
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["id", "ids"])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(encode, f"id {df.schema[id_col].dataType.simpleString()}, ids array<int>")


def with_token_count(df: DataFrame, text_col: str, tokenizer: Tokenizer, name: str = "n_tokens") -> DataFrame:
    """The frame with the number of tokens of a text column."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counted = tokenizer.encoder().count
        for texts in batches:
            yield pd.Series([counted(t) for t in texts], dtype="int32")

    return df.withColumn(name, count(F.col(text_col).cast("string")))


def texts(df: DataFrame, ids_col: str, tokenizer: Tokenizer, name: str) -> DataFrame:
    """The frame with the text of a column of token ids; null has an empty one."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoded = tokenizer.encoder().decode
        for lists in batches:
            yield pd.Series(["" if x is None else decoded(x) for x in lists], dtype=object)

    return df.withColumn(name, decode(F.col(ids_col)))
