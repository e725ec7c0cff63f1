"""Token counts through a digest cache.

Method: a text's key is the SHA-256 digest of its normalised content and of the tokenizer file. Keys already in the
cache are answered from it; of the others one text a key is encoded, however many rows have it, and the new counts are
appended to the cache.
Content is normalised by turning each run of ASCII white space into one space and trimming it, which no tokenizer that
drops white space can see; tokenizers that see white space are keyed by the text as it is.

Defined results: a null text is empty and has 0 tokens; repeated rows give repeated results; an empty table gives no
rows; a null key column is allowed; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import materialize
from .pretokens import Encoder
from .words import SPACE, slices

LIMIT = 2048
HOT_PARTS = 1000
CACHE = "digest binary, n_tokens long"
DROPS_SPACE = {"word_bpe_49k.json"}


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache's rows; a new cache starts empty."""
    spark.createDataFrame([], CACHE).write.mode("append").parquet(path)
    return spark.read.schema(CACHE).parquet(path)


def digests(docs: DataFrame, tokenizer: str, key: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    content = whole
    if os.path.basename(tokenizer) in DROPS_SPACE:
        content = F.trim(F.regexp_replace(whole, f"[{SPACE}]+", " "))
    digest = F.unhex(F.sha2(F.concat(F.lit(tokenizer_version(tokenizer) + "\n"), content), 256))
    return docs.select(F.col(key).alias("key"), F.octet_length(whole).cast("long").alias("n_bytes"),
                       whole.alias("text"), digest.alias("digest"))


def missing_texts(rows: DataFrame, misses: DataFrame, least: float) -> DataFrame:
    """(digest, text): one row for each digest of ``misses`` (digest, holder, copies), found in ``rows``.

    A digest of one row is met by its key. Of the others at most one part in ``least`` rows are hot: they are broadcast, and
    their copies shrink to one within each task before the shuffle; copies of the rest shrink after the join.
    """
    wanted = misses.withColumnRenamed("digest", "wanted")
    found = (rows.join(wanted.where(F.col("copies") <= least).hint("shuffle_hash"),
                       (F.col("digest") == F.col("wanted")) & F.col("key").eqNullSafe(F.col("holder")))
             .select("digest", "text", "copies"))
    repeated = found.where("copies > 1").select("digest", "text").dropDuplicates(["digest"])
    once = found.where("copies = 1").select("digest", "text").unionByName(repeated)
    hot = wanted.where(F.col("copies") > least)
    if hot.isEmpty():
        return once
    return once.unionByName(rows.join(F.broadcast(hot.select("wanted")), F.col("digest") == F.col("wanted"))
                            .select("digest", "text").dropDuplicates(["digest"]))


def encode_counts(texts: DataFrame, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) of rows (digest, text)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = Encoder(tokenizer, len).parts
        for batch in slices(batches, "text"):
            counts = [sum(parts(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())],
                                             ["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(count, CACHE)


def token_counts(docs: DataFrame, tokenizer: str, cache_path: str, key: str = "doc_id", text: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row; texts the cache doesn't know are encoded and added to it."""
    spark = docs.sparkSession
    rows = digests(docs, tokenizer, key, text)
    keyed = materialize(rows.select("key", "n_bytes", "digest"), "token-digests")
    known = open_cache(spark, cache_path)
    # at most HOT_PARTS digests hold more than one part in HOT_PARTS of the rows
    least = keyed.count() / HOT_PARTS
    # one row for each new digest, found on narrow rows; hot digests shrink before the shuffle
    misses = materialize(keyed.groupBy("digest").agg(F.min("key").alias("holder"), F.count("*").alias("copies"))
                         .join(known.select("digest"), "digest", "left_anti"), "token-wanted")
    # written beside the cache first: a job that fails half-way leaves the cache as it was
    new = materialize(encode_counts(missing_texts(rows, misses, max(least, 1.0)), tokenizer), "token-misses")
    new.write.mode("append").parquet(cache_path)
    counts = spark.read.schema(CACHE).parquet(cache_path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    # copies of hot digests meet their count by broadcast
    copied = keyed.groupBy("digest").agg(F.count("*").alias("copies")).where(F.col("copies") > least).select("digest")
    hot = F.broadcast(counts.join(F.broadcast(copied), "digest"))
    counted = keyed.join(hot, "digest").unionByName(keyed.join(hot.select("digest"), "digest", "left_anti").join(counts, "digest"))
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def fresh_cache(folder: str) -> str:
    return f"{folder}/token-cache-{uuid.uuid4().hex}"
