"""Token counts by a digest cache: only distinct texts that no earlier call has counted are encoded."""

from __future__ import annotations

import os
from collections.abc import Iterator
from importlib import metadata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivane.llm import vocabulary
from scrivane.llm.common import by_value, exists, materialise, scratch, text_of

LIMIT = 1024
#: Bytes of text that a worker encodes at once.
BATCH_BYTES = 1 << 20
_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def counter(file: str):
    """A function from texts to their token counts, as the file's library gives them without begin, end and added special tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if file.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=file)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(file)
    own.no_truncation()
    own.no_padding()
    return lambda texts: [len(x) for x in own.encode_batch_fast(texts, add_special_tokens=False)]


def version_of(file: str) -> str:
    """What counts depend on besides the text: the tokenizer's file and the library that reads it."""
    library = "sentencepiece" if file.endswith(".model") else "tokenizers"
    return f"{vocabulary.digest(file)} {library} {metadata.version(library)}"


def _counts(file: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(file)
        for batch in batches:
            digests, texts = batch.column(0), batch.column(1).to_pylist()
            start, held = 0, 0
            for k, t in enumerate(texts):
                held += len(t)
                if held >= BATCH_BYTES or k == len(texts) - 1:
                    part = digests.slice(start, k + 1 - start)
                    n = count(texts[start : k + 1])
                    yield pa.RecordBatch.from_arrays([part, pa.array([version] * len(n)), pa.array(n, pa.int64())], ["digest", "tokenizer", "n_tokens"])
                    start, held = k + 1, 0

    return run


def read_cache(df: DataFrame, path: str, version: str) -> DataFrame:
    """The stored (digest, n_tokens) of a tokenizer version; empty where nothing is stored yet."""
    spark = df.sparkSession
    stored = spark.read.schema(_SCHEMA).parquet(path) if exists(spark, path) else spark.createDataFrame([], _SCHEMA)
    # A call that was broken off or ran twice may have stored a digest twice.
    return stored.where(F.col("tokenizer") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(df: DataFrame, text: str = "text", id: str = "doc_id", file: str | None = None, cache: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row for each row of df: (id, n_bytes, n_tokens, over_limit).

    cache: a folder in a store that all executors share, with the counts of earlier calls by SHA-256 of the text (nulls
    as empty texts; tokenizers tell all other texts apart, so nothing else is normalised) and by version of the tokenizer's file and library.
    What it lacks is brought down to distinct texts, before and after one shuffle by digest, encoded, and appended.
    Without cache a new, empty one is used. Then the table's digests, without its texts, are joined to the stored counts;
    Spark splits that join where a digest is very frequent.

    Null texts are empty (no tokens); very long ones are encoded whole; an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    file = file or vocabulary.path("byte_bpe_50k.json")
    cache, version = cache or scratch(df.sparkSession, "token-cache"), version_of(file)
    own = text_of(text)
    digests = df.select(F.unhex(F.sha2(own, 256)).alias("digest"), own.alias("text"))
    distinct = digests.groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(read_cache(df, cache, version), "digest", "left_anti")
    misses.mapInArrow(_counts(file, version), _SCHEMA).write.mode("append").parquet(cache)
    rows = df.select(F.col(f"`{id}`").alias("_id"), F.octet_length(own).cast("long").alias("n_bytes"), F.unhex(F.sha2(own, 256)).alias("digest"))
    found = rows.join(materialise(read_cache(df, cache, version), "counts"), "digest")
    return found.select(F.col("_id").alias(id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


by_value(__name__)
