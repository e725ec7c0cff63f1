"""Text to vectors, with a content-hash cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..constants import EMBEDDING_CACHE_TTL_SECONDS

HASH_DIM = 256


def embed(df: DataFrame, text: str, encoder: Callable[[Column], Column] | None = None,
          out: str = "vector", dim: int = HASH_DIM) -> DataFrame:
    """Add unit vectors. ``encoder`` (for instance a pandas UDF around a model) replaces the
    default, a hashed tf-idf fitted on the corpus by Spark ML."""
    if encoder is not None:
        return df.withColumn(out, encoder(F.col(text)))
    pipeline = Pipeline(stages=[
        RegexTokenizer(inputCol="_t", outputCol="_words", pattern=r"[^\p{L}\p{N}]+", toLowercase=True),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dim),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="_unit"),
    ])
    source = df.withColumn("_t", F.coalesce(text, F.lit("")))
    done = pipeline.fit(source.select("_t")).transform(source)
    return (done.withColumn(out, vector_to_array("_unit", "float32"))
            .drop("_t", "_words", "_tf", "_tfidf", "_unit"))


def live(cache: DataFrame, as_of: int) -> DataFrame:
    return cache.filter(F.col("expires_at") > as_of)


def embed_cached(df: DataFrame, text: str, cache: DataFrame, as_of: int,
                 encode: Callable[[DataFrame], DataFrame],
                 ttl: int = EMBEDDING_CACHE_TTL_SECONDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(requested hashes with vector and hit flag, new cache, counts of hits and misses).

    Only distinct texts without an unexpired cache entry are encoded. Times are epoch seconds."""
    wanted = (df.select(F.col(text).alias("text")).filter(F.col("text").isNotNull())
              .withColumn("text_hash", F.sha2("text", 256)).dropDuplicates(["text_hash"]))
    fresh = live(cache, as_of)
    hits = fresh.join(wanted.select("text_hash"), "text_hash", "left_semi").select("text_hash", "vector")
    misses = encode(wanted.join(fresh.select("text_hash"), "text_hash", "left_anti")).select("text_hash", "vector")
    vectors = hits.withColumn("hit", F.lit(True)).unionByName(misses.withColumn("hit", F.lit(False)))
    kept = fresh.select("text_hash", "vector", "expires_at").unionByName(
        misses.withColumn("expires_at", F.lit(as_of + ttl).cast("bigint")))
    stats = wanted.join(fresh.select("text_hash", F.lit(True).alias("_h")), "text_hash", "left").agg(
        F.count_if(F.col("_h")).alias("hits"), F.count_if(F.col("_h").isNull()).alias("misses"))
    return vectors, kept, stats


def cache_stats(cache: DataFrame, as_of: int) -> DataFrame:
    return cache.agg(F.count(F.lit(1)).alias("entries"),
                     F.count_if(F.col("expires_at") > as_of).alias("live"),
                     F.count_if(F.col("expires_at") <= as_of).alias("expired"))


def cache_evict(cache: DataFrame, as_of: int) -> DataFrame:
    return live(cache, as_of)
