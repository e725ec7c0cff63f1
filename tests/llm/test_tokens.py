"""Packing and token counts against plain encodings."""

import zlib
from array import array

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from needmatch.llm import packing, token_counts
from needmatch.llm.pretokens import Encoder
from needmatch.session import fresh_path

BYTES, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
TEXTS = ["", "it's I'LL we'Ve don't ''s !!'s", "a b\x85c \x1c d", "  lead  \n\n trail  \n", "<|endoftext|> x <|ENDOFTEXT|>",
         "ΑΣ Σ", "İstanbul ŉ ſ ß ẞ ªº ²³ ¼", "é Å Å", "\r\n\t\x0b\x0c x", "123 456789 a1b2", "日本語", "“quoted” ‘x’ – — … €5",
         "'T 'S it'S'", "a" * 3000, "x  'll", " 's  's", "Ǆ", "x   y\n\n\nz"]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_equals_library(path):
    library, parts = Tokenizer.from_file(path), Encoder(path, list).parts
    for text in TEXTS:
        assert [i for p in parts(text) for i in p] == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("window", [16, 2048])
def test_packing(odd, window):
    library = Tokenizer.from_file(BYTES)
    pieces = packing.pack(odd, BYTES, window).collect()
    texts = odd.collect()
    want = sorted(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in texts)
    firsts = [p for p in pieces if p.start == 0]
    assert sorted(p.doc_tokens for p in firsts) == want
    assert sum(p.length for p in pieces) == sum(want)
    by_sequence = {}
    for p in pieces:
        assert len(p.ids) == 4 * p.length
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    ends = []
    for held in by_sequence.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        ends.append(end)
    assert sorted(ends)[1:] == [window] * (len(ends) - 1) and max(ends) <= window
    ids = {r.doc_id: array("I", [*library.encode(r.text or "", add_special_tokens=False).ids, 1]).tobytes() for r in texts}
    for p in pieces:
        assert p.ids == ids[p.doc_id][4 * p.start:4 * (p.start + p.length)]
    crc = packing.pack(odd.where("doc_id = 1"), BYTES).select(F.crc32("ids")).first()[0]
    assert crc == zlib.crc32((1).to_bytes(4, "little"))


def test_token_counts(spark, odd):
    library, cache = Tokenizer.from_file(WORDS), fresh_path(spark, "cache")
    want = sorted((r.doc_id or 0, len((r.text or "").encode()), len(library.encode(r.text or "").ids)) for r in odd.collect())
    for _ in range(2):      # the second run finds every text in the cache
        got = token_counts.token_counts(odd, WORDS, cache).collect()
        assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
        stored = spark.read.parquet(cache)
        assert stored.count() == stored.distinct().count()


def test_repeated_texts_are_encoded_once(spark):
    """A third of all rows are one text under one key or many; only distinct texts reach the encoder."""
    rows = ([(1, "the same text again")] * 5000 + [(n, "another text") for n in range(3000)] + [(None, "no key")] * 3
            + [(n, f"text number {n}") for n in range(4000)])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    texts = token_counts.digests(docs, WORDS, "doc_id", "text")
    misses = texts.groupBy("digest").agg(F.min("key").alias("holder"), F.count("*").alias("copies"))
    for least in (12.0, 1e9):       # with and without hot digests
        found = token_counts.missing_texts(texts, misses, least).collect()
        assert len(found) == len({bytes(r.digest) for r in found}) == 4003
    library = Tokenizer.from_file(WORDS)
    want = sorted((-1 if k is None else k, len(library.encode(t).ids)) for k, t in rows)
    cache = fresh_path(spark, "cache")
    got = token_counts.token_counts(docs, WORDS, cache).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in got) == want
    assert spark.read.parquet(cache).count() == 4003


def test_empty(spark, bare):
    assert packing.pack(bare, BYTES).count() == 0
    assert token_counts.token_counts(bare, WORDS, fresh_path(spark, "cache")).count() == 0
