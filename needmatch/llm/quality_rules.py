"""Quality rules with cross-document line frequencies.

Method: every line is normalised (lower case, single spaces) and hashed. For each host the number of distinct documents
that hold a line is counted; exact copies of a document count once. Lines held by ``min_docs`` documents, whatever the
host's size, are taken out, and so are those held by more than ``max_share`` of the host's documents and by FEWEST of
them at least. A document that keeps too few of its words is rejected. Documents that fail the rules on their own text
(too short, too repetitive) are rejected as well.

Defined results: a null text is empty, so it fails; a null host is a host of its own; a line without words counts
nowhere; repeated rows get the same verdict each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .words import Words, slices, summed, window_hashes

SYMBOLS = r"[#*$%&|<>]"
REPEAT_WIDTH = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
MIN_DOCS = 50
MAX_SHARE = 0.05
#: Fewer documents than this have no line in common that says anything of their host.
FEWEST = 3
MIN_LEFT_SHARE = 0.2

FACT_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content", "lines"]
FACTS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content long, "
         "lines array<struct<line: long, words: long>>")


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def repeated_words(codes: np.ndarray, owner: np.ndarray, vocabulary: int, starts: np.ndarray) -> np.ndarray:
    """Words of each text inside windows that its text holds twice or more."""
    scrambled = window_hashes(np.arange(vocabulary, dtype=np.uint64), 1)
    windows = window_hashes(scrambled[codes], REPEAT_WIDTH)
    inside = owner[:len(windows)] == owner[REPEAT_WIDTH - 1:] if len(windows) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    own = window_hashes(windows[at] + owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 1)
    order = np.argsort(own, kind="stable")
    ranked = own[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(own), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(len(codes) + 1, np.int64)
    np.add.at(change, at[twice], 1)
    np.add.at(change, at[twice] + REPEAT_WIDTH, -1)
    return summed(np.cumsum(change[:-1]) > 0, starts)


def text_facts(texts: pa.Array) -> list[pa.Array]:
    """The columns of FACTS for a batch of texts without nulls."""
    listed = pc.split_pattern(texts, "\n")
    at, lines = listed.offsets.to_numpy(), listed.values
    words = Words(lines)
    per_line, starts = words.lengths(), words.starts[at]
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    chars = pc.utf8_length(words.vocabulary).to_numpy(zero_copy_only=False)[words.codes]
    coded = lines.dictionary_encode()
    code, line_owner = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(texts)), np.diff(at))
    _, first = np.unique(line_owner * (len(coded.dictionary) + 1) + code, return_index=True)
    again = np.ones(len(code), bool)
    again[first] = False
    again &= per_line > 0
    plain = pc.ascii_lower(coded.dictionary).to_pylist()
    digest = xxhash.xxh3_64_intdigest
    hashes = signed(np.array([digest(b" ".join(x.encode().split())) for x in plain], np.uint64))[code]
    real = np.flatnonzero(per_line > 0)
    ends = np.concatenate([[0], np.cumsum(per_line > 0)])[at]
    held = pa.ListArray.from_arrays(
        pa.array(ends, pa.int32()),
        pa.StructArray.from_arrays([pa.array(hashes[real]), pa.array(per_line[real].astype(np.int64))], ["line", "words"]))
    content = signed(np.array([digest(t) for t in texts.to_pylist()], np.uint64))
    symbols = pc.count_substring_regex(texts, SYMBOLS).cast(pa.int64())
    return [pa.array(np.diff(starts)), pa.array(summed(chars, starts)), symbols, pa.array(summed(again, at)),
            pa.array(repeated_words(words.codes, owner, len(words.vocabulary), starts)), pa.array(content), held]


def facts(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """One row a document: key, host (never null) and FACTS."""
    owner = F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit(""))
    source = docs.select(F.col(key).alias("key"), owner.alias("host"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    names = ["key", "host", *FACT_NAMES]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("host"),
                                              *text_facts(batch.column("text"))], names)

    return source.mapInArrow(read, f"key {kind}, host string, {FACTS}")


def common_lines(contents: DataFrame, min_docs: int, max_share: float) -> DataFrame:
    """(host, line) of the lines above either limit; ``contents`` has one row for each distinct text of a host."""
    sizes = contents.groupBy("host").agg(F.count("*").alias("docs"))
    holders = F.col("holders")
    counts = (contents.select("host", F.explode(F.array_distinct("lines.line")).alias("line"))
              .groupBy("host", "line").agg(F.count("*").alias("holders")).where(holders >= min(FEWEST, min_docs)))
    return (counts.join(sizes, "host").where((holders >= min_docs) | (holders > max_share * F.col("docs")))
            .select("host", "line"))


def judge_quality(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
                  min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE,
                  min_left_share: float = MIN_LEFT_SHARE) -> DataFrame:
    """Key, the facts of its text, removed_words (in common lines), base_failed and kept of every row."""
    rows = materialize(facts(docs, key, text, host), "quality-facts")
    contents = rows.select("host", "content", "lines").dropDuplicates(["host", "content"])
    common = common_lines(contents, min_docs, max_share)
    removed = (contents.select("host", "content", F.inline("lines")).join(common, ["host", "line"])
               .groupBy("host", "content").agg(F.sum("words").alias("removed_words")))
    n, left = F.col("n_words"), F.col("n_words") - F.col("removed_words")
    return (rows.drop("lines").join(removed, ["host", "content"], "left").na.fill(0, ["removed_words"])
            .withColumn("base_failed", (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * n))
            .withColumn("kept", ~F.col("base_failed") & (left >= MIN_WORDS) & (left >= min_left_share * n))
            .select(F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "removed_words", "base_failed", "kept"))
