"""Concatenate-and-cut packing of documents into fixed windows of tokens.

Method: two-pass prefix sums. Pass one encodes every document once, in the task that reads it, and writes its ids with
the number of ids before it in that task's part. Pass two adds up the parts' totals (one small row a part), which
gives every document its global offset; windows are then fixed intervals of offsets, and a document that crosses window
ends becomes one boundary record a window. Token ids are never shuffled.

Defined results: a null text is empty; an empty document is its end id alone; repeated rows are packed each; an empty
table gives no pieces; other columns of the input are ignored. The order is that of the written parts, so only the last
window is short.
"""

from __future__ import annotations

import sys
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from .pretokens import Encoder
from .words import slices

WINDOW = 2048
END = 1
ID_BYTES = 4
#: Part totals are broadcast up to this many parts (16 bytes each); beyond it they are joined.
MAX_BROADCAST_PARTS = 2_000_000


def little_endian(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def encoded(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pass one: (part, before, key, tokens, ids) of each row; ids are little-endian unsigned 32-bit values."""
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, part, before = Encoder(tokenizer, little_endian).parts, TaskContext.get().partitionId(), 0
        end = little_endian([END])
        for batch in slices(batches, "text"):
            ids = [b"".join(parts(t)) + end for t in batch.column("text").to_pylist()]
            counts = [len(x) // ID_BYTES for x in ids]
            starts = [before]
            for n in counts:
                starts.append(starts[-1] + n)
            before = starts.pop()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), batch.column("key"),
                 pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                ["part", "before", "key", "tokens", "ids"])

    return source.mapInArrow(encode, f"part int, before long, key {kind}, tokens long, ids binary")


def cut(encoded_rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pass two, over written rows of ``encoded``: (key, start, length, ids, doc_tokens, sequence_id, offset)."""
    totals = encoded_rows.groupBy("part").agg(F.max(F.col("before") + F.col("tokens")).alias("total"))
    below = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(below), F.lit(0)).alias("base"))
    if totals.count() <= MAX_BROADCAST_PARTS:
        offsets = F.broadcast(offsets)
    at, end = F.col("at"), F.col("at") + F.col("tokens")

    def piece(w):
        begin, stop = F.greatest(at, w * window), F.least(end, (w + 1) * window)
        first = (ID_BYTES * (begin - at) + 1).cast("int")
        return F.struct(w.alias("sequence_id"), (begin - at).alias("start"), (stop - begin).alias("length"),
                        (begin - w * window).alias("offset"),
                        F.substr(F.col("ids"), first, (ID_BYTES * (stop - begin)).cast("int")).alias("ids"))

    windows = F.sequence(F.floor(at / window), F.floor((end - 1) / window))
    return (encoded_rows.join(offsets, "part").withColumn("at", F.col("base") + F.col("before"))
            .select("key", F.col("tokens").alias("doc_tokens"), F.explode(F.transform(windows, piece)).alias("p"))
            .select("key", "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset"))


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with their ids; the key column keeps its name."""
    rows = materialize(encoded(docs, tokenizer, key, text), "packing")
    return cut(rows, window).withColumnRenamed("key", key)
