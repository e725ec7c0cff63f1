"""Tokenizer runs that encode each distinct pre-token once.

Byte-pair merges never cross pre-tokens, so a text's ids are those of its pre-tokens in order. Texts of the plain
character set below are cut by Python's ``re``, where its classes agree with the library's; any other text, and any
that might hold a special token, goes to the library whole.
"""

from __future__ import annotations

import base64
import os
import re

LETTERS = "A-Za-zÀ-ÖØ-öø-įĲ-ňŊ-ž"
PLAIN = re.compile(f"[\\t-\\r -~¡«°·»¿{LETTERS}–—‘-„…€]*")
# Pre-token patterns of the two tokenizer files, with their classes written out for the plain set.
CUTS = {
    "byte_bpe_50k.json": f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\\s0-9{LETTERS}]+|\\s+(?!\\S)|\\s+",
    "word_bpe_49k.json": f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\\s0-9{LETTERS}]+",
}
LOWERED = {"word_bpe_49k.json"}
#: Files that hold the same vocabulary as ranks, which another library encodes about three times as fast.
RANKS = {"byte_bpe_50k.json": "byte_bpe_50k.tiktoken"}
MEMO = 400_000


class Memo(dict):
    """What is kept of each pre-token met so far."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word):
        self[word] = out = self.encode(word)
        return out


class Encoder:
    """Encodes with the library's file at ``path``. ``keep`` turns a list of ids into what is kept of a pre-token."""

    def __init__(self, path: str, keep):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        library, name = Tokenizer.from_file(path), os.path.basename(path)
        self.whole = lambda text: keep(library.encode(text, add_special_tokens=False).ids)
        self.cut = re.compile(CUTS[name]).findall if name in CUTS else None
        self.lower, word = name in LOWERED, self.whole
        if name in RANKS:
            ranked = _ranked(os.path.join(os.path.dirname(path), RANKS[name]))
            word = lambda text: keep(ranked.encode_ordinary(text))
        self.memo = Memo(word)

    def parts(self, text: str) -> list:
        """What is kept of the text's pre-tokens, in order (of the whole text where it isn't plain)."""
        if self.cut is None or "<|" in text or not PLAIN.fullmatch(text):
            return [self.whole(text)]
        if len(self.memo) > MEMO:
            self.memo.clear()
        return list(map(self.memo.__getitem__, self.cut(text.lower() if self.lower else text)))


def _ranked(path: str):
    import tiktoken
    with open(path) as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(str.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
