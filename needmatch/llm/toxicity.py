"""Toxicity by a lexicon trie, Levenshtein automata and context windows.

The lexicon is learned from a bounded sample of labelled documents: the fewest words,
and stems that many forms share, that explain the toxic documents and hardly stand in clean ones. The automaton that accepts a misspelled entry (up to one or two
edits, by length) is run together with the trie over the entries, as one lazily built deterministic automaton; it is
applied to the distinct words of a block of texts. Where a word matches, a window of neighbours tells whether it is
quoted (inside quotation marks or after a word of citing). Every (entry, edits) pair and context has a weight, the
smoothed share of toxic documents among those it matched in the sample; a document's score combines what its matches
have above the sample's rate, as independent causes.

Defined results: a null or empty text has no match and gets the base score; repeated rows are scored each; an empty
table gives no rows; without labelled rows of both kinds the lexicon is empty; other columns pass through.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .labels import MAX_LABELLED, labelled_sample, remainder
from .quality_classifier import text_blocks
from .words import Words, slices

THRESHOLD = 0.3
HELD_OUT = 2
MODULUS = 4
MAX_ENTRIES = 20_000
STEMS = (4, 5, 6)
MIN_SHARE = 0.8
MAX_CHANCE = 0.01
COVER = 3
CLEAN_COST = 3
LONG_LIST = 8
MIN_GAIN = 3
PRIOR_ROWS = 2.0
UNSEEN_EDITS = 0.2
QUOTED = 0.25
WINDOW = 8
EDGE = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~«»“”„‘’…–—¿¡"
OPENING, CLOSING = "\"'«“„‘", "\"'»”’“"
CITING = {"said", "says", "wrote", "writes", "quote", "quoted", "quotes", "called", "sagte", "schrieb", "zitat",
          "dit", "écrit", "dijo", "escribió", "cita"}


class Entry(NamedTuple):
    text: str
    stem: bool


def bare(word: str) -> str:
    return word.strip(EDGE).lower()


def edits_allowed(entry: Entry) -> int:
    return 0 if len(entry.text) < 4 else 1 if entry.stem or len(entry.text) < 9 else 2


class LexiconAutomaton:
    """Product of the entries' trie and their Levenshtein automata, made deterministic as words are read.

    A state is a set of (trie node, edits so far); deleting, inserting and replacing a character cost one edit each.
    """

    def __init__(self, entries: list[Entry]):
        self.children: list[dict[str, int]] = [{}]
        self.allowed, self.entry, self.stem = [0], [-1], [-1]
        for number, e in enumerate(entries):
            node, allowed = 0, edits_allowed(e)
            self.allowed[0] = max(self.allowed[0], allowed)
            for char in e.text:
                if char not in self.children[node]:
                    self.children[node][char] = len(self.children)
                    self.children.append({})
                    self.allowed.append(0)
                    self.entry.append(-1)
                    self.stem.append(-1)
                node = self.children[node][char]
                self.allowed[node] = max(self.allowed[node], allowed)
            (self.stem if e.stem else self.entry)[node] = number
        self.limit = [edits_allowed(e) for e in entries]
        self.states: list[dict[int, int]] = []
        self.numbers: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.ends: list[tuple[int, int] | None] = []
        self.hits: list[tuple[int, int] | None] = []
        self.dead = self._number({})
        self.start = self._number(self._skipping({0: 0}))

    def _skipping(self, state: dict[int, int]) -> dict[int, int]:
        """Adds the nodes reached by leaving out characters of an entry."""
        out, todo = dict(state), list(state.items())
        while todo:
            node, edits = todo.pop()
            for below in self.children[node].values():
                if edits < self.allowed[below] and out.get(below, 99) > edits + 1:
                    out[below] = edits + 1
                    todo.append((below, edits + 1))
        return out

    def _number(self, state: dict[int, int]) -> int:
        key = frozenset(state.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            found = [(e, self.entry[n]) for n, e in state.items() if self.entry[n] >= 0 and e <= self.limit[self.entry[n]]]
            self.ends.append(min(found) if found else None)
            begun = [(e, self.stem[n]) for n, e in state.items() if self.stem[n] >= 0 and e <= self.limit[self.stem[n]]]
            self.hits.append(min(begun) if begun else None)
        return self.numbers[key]

    def _move(self, state: int, char: str) -> int:
        new: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits <= self.allowed[node] and new.get(node, 99) > edits:
                new[node] = edits

        for node, edits in self.states[state].items():
            reach(node, edits + 1)      # a character too many
            for label, below in self.children[node].items():
                reach(below, edits + (label != char))
        self.moves[state][char] = out = self._number(self._skipping(new))
        return out

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, entry) of the nearest entry; a stem counts where the word begins with it. Of equally near ones a whole
        word comes first."""
        state, stem, moves = self.start, None, self.moves
        for char in word:
            state = moves[state].get(char, -1) if char in moves[state] else self._move(state, char)
            if state == self.dead:
                return stem
            hit = self.hits[state]
            if hit and (stem is None or hit[0] < stem[0]):
                stem = hit
        end = self.ends[state]
        return end if end and (stem is None or end[0] <= stem[0]) else stem


class Lexicon:
    """Entries and weights; ``matches`` finds them in blocks of texts."""

    def __init__(self, entries: list[Entry], base: float, rate: float):
        self.entries, self.base, self.rate = entries, base, rate
        self.weights: dict[tuple[int, int, bool], float] = {}
        self._automaton = None

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def matches(self, texts: pa.Array) -> list[tuple[int, int, int, bool]]:
        """(text, entry, edits, quoted) of every matching word."""
        self._automaton = self._automaton or LexiconAutomaton(self.entries)
        words = Words(texts)
        listed = words.vocabulary.to_pylist()
        found = [self._automaton.match(bare(w)) for w in listed]
        hit = np.array([f is not None for f in found], bool)
        places = np.flatnonzero(hit[words.codes]) if len(listed) else []
        owner = np.searchsorted(words.starts, places, "right") - 1
        out = []
        for at, text in zip(np.asarray(places).tolist(), np.asarray(owner).tolist(), strict=True):
            begin, end = max(words.starts[text], at - WINDOW), min(words.starts[text + 1], at + WINDOW + 1)
            around = [listed[c] for c in words.codes[begin:end].tolist()]
            edits, entry = found[words.codes[at]]
            out.append((text, entry, edits, quoted(around, at - int(begin))))
        return out

    def weight(self, entry: int, edits: int, is_quoted: bool) -> float:
        known = self.weights.get((entry, edits, is_quoted))
        if known is not None:
            return known
        plain = self.weights.get((entry, edits, False), UNSEEN_EDITS if edits else 0.5)
        return plain * QUOTED if is_quoted else plain

    def scores(self, texts: pa.Array) -> np.ndarray:
        clean = np.full(len(texts), 1.0 - self.base)
        for text, entry, edits, is_quoted in set(self.matches(texts)):
            above = (self.weight(entry, edits, is_quoted) - self.rate) / (1.0 - self.rate)
            clean[text] *= 1.0 - max(0.0, above)
        return 1.0 - clean


def quoted(around: list[str], at: int) -> bool:
    """Whether the word at a place of its window is cited: between quotation marks, or after a word of citing."""
    opened = any(w[0] in OPENING for w in around[:at + 1])
    closed = any(w.rstrip(".,;:!?")[-1:] in CLOSING and w.rstrip(".,;:!?") for w in around[at:])
    return (opened and closed) or any(bare(w) in CITING for w in around[:at])


def tail(hits: int, n: int, rate: float) -> float:
    """Probability of at least ``hits`` toxic documents among n drawn at the base rate: the binomial tail, summed from
    logarithms until, beyond the mode, a term adds nothing."""
    if hits <= 0 or rate >= 1.0:
        return 1.0 if hits <= n else 0.0
    if rate <= 0.0:
        return 0.0
    total, odd, even = 0.0, math.log(rate), math.log1p(-rate)
    for k in range(hits, n + 1):
        term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * odd + (n - k) * even)
        total += term
        if k > n * rate and term <= total * 1e-17:
            break
    return min(total, 1.0)


def terms_of(text: str) -> set[Entry]:
    words = {bare(w) for w in re.split(r"[\x20\x09-\x0D]+", text)} - {""}
    return {Entry(w, False) for w in words} | {Entry(w[:n], True) for w in words for n in STEMS if len(w) >= n}


def nested(a: Entry, b: Entry) -> bool:
    """Whether one entry's form begins with the other's, where that one is a stem."""
    return (a.stem and b.text.startswith(a.text)) or (b.stem and a.text.startswith(b.text))


def choose_entries(terms: list[Entry], clean: list[int], held: list[list[int]], max_entries: int) -> list[Entry]:
    """Fewest terms that explain the toxic documents: greedy cover, each document COVER times.

    ``held`` lists the terms of each toxic document, ``clean`` counts the other documents of each term. Documents with
    one long list are copies and count once. A term that explains fewer than MIN_GAIN more documents isn't taken:
    copies of one text share many terms that mean nothing. Whole words below a chosen stem follow as entries of their
    own, so that misspelled inflected forms are found.
    """
    lists = [sorted(set(h)) for h in held]
    docs = [h for h in lists if len(h) <= LONG_LIST] + [list(h) for h in {tuple(h) for h in lists if len(h) > LONG_LIST}]
    holders: list[list[int]] = [[] for _ in terms]
    for number, doc in enumerate(docs):
        for t in doc:
            holders[t].append(number)
    need, chosen = [COVER] * len(docs), []

    def rank(t: int):
        return CLEAN_COST * clean[t] - sum(need[d] > 0 for d in holders[t]), terms[t].stem, -len(terms[t].text), terms[t].text, t

    heap = [rank(t) for t in range(len(terms))]
    heapq.heapify(heap)
    while heap and len(chosen) < max_entries:
        t = heapq.heappop(heap)[-1]
        if any(nested(terms[t], c) for c in chosen):
            continue
        now = rank(t)
        if heap and now > heap[0]:
            heapq.heappush(heap, now)
            continue
        if -now[0] < MIN_GAIN:
            break
        chosen.append(terms[t])
        for d in holders[t]:
            need[d] -= 1
    stems = {c.text for c in chosen if c.stem}
    taken = set(chosen)
    forms = [t for t in terms if not t.stem and any(t.text[:n] in stems for n in STEMS) and t not in taken]
    return chosen + forms[:max_entries - len(chosen)]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
        max_labelled: int = MAX_LABELLED, max_entries: int = MAX_ENTRIES) -> Lexicon:
    """A lexicon from the labelled rows that aren't held out."""
    taught = labels.where(remainder(key, MODULUS) != HELD_OUT)
    sample = labelled_sample(docs, taught, label, key, text, max_labelled)
    totals = sample.groupBy("label").count().collect()
    n, toxic = sum(r["count"] for r in totals), sum(r["count"] for r in totals if r["label"] > 0)
    if not 0 < toxic < n:
        return Lexicon([], (toxic + 0.5) / (n + 1.0), 0.0)
    rate = toxic / n

    def list_terms(batches):
        for batch in slices(batches, "text"):
            tally = Counter()
            for y, t in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
                tally.update((*term, y > 0) for term in terms_of(t))
            keys = list(tally)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()),
                 pa.array([tally[k] if k[2] else 0 for k in keys], pa.int64()),
                 pa.array([tally[k] for k in keys], pa.int64())], ["term", "stem", "toxic", "n"])

    counted = (sample.mapInArrow(list_terms, "term string, stem boolean, toxic long, n long")
               .groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")))
    # terms of toxic documents that clean ones hardly have, and their documents: bounded by the sample
    likely = [tuple(r) for r in counted.where((F.col("toxic") >= MIN_GAIN) & (F.col("toxic") >= MIN_SHARE * F.col("n")))
              .collect()]
    others = {Entry(t, stem): of - hits for t, stem, hits, of in likely if tail(hits, of, rate) <= MAX_CHANCE}
    terms = sorted(others)
    numbered = {t: i for i, t in enumerate(terms)}

    def list_held(batches):
        for batch in slices(batches, "text"):
            held = [[numbered[t] for t in terms_of(x) if t in numbered] for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.int32()))], ["held"])

    held = sample.where("label > 0").mapInArrow(list_held, "held array<int>").collect()
    entries = choose_entries(terms, [others[t] for t in terms], [r["held"] for r in held], max_entries)
    lexicon = Lexicon(entries, 0.0, rate)

    def find(batches):
        for batch in slices(batches, "text"):
            labels_of = batch.column("label").to_pylist()
            rows = sorted(set(lexicon.matches(batch.column("text"))))
            hit = {r[0] for r in rows}
            rows += [(i, -1, 0, False) for i in range(len(labels_of)) if i not in hit]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()),
                 pa.array([r[3] for r in rows], pa.bool_()), pa.array([int(labels_of[r[0]] > 0) for r in rows], pa.int32())],
                ["entry", "edits", "quoted", "toxic"])

    seen = (sample.mapInArrow(find, "entry int, edits int, quoted boolean, toxic int")
            .groupBy("entry", "edits", "quoted").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).collect())
    for r in seen:
        if r["entry"] < 0:
            lexicon.base = (r["toxic"] + 0.5 * rate) / (r["n"] + 1.0)
        else:
            prior = UNSEEN_EDITS if r["edits"] else rate
            lexicon.weights[r["entry"], r["edits"], r["quoted"]] = (
                (r["toxic"] + PRIOR_ROWS * prior) / (r["n"] + PRIOR_ROWS))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", out: str = "toxicity") -> DataFrame:
    """All rows and columns of ``docs`` with the score in column ``out``, which replaces one of that name.

    The lexicon goes to the tasks with the function; it has MAX_ENTRIES entries at most.
    """
    @F.arrow_udf("double")
    def rate(texts: pa.Array) -> pa.Array:
        parts = [lexicon.scores(block) for block in text_blocks(texts)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))
    return docs.withColumn(out, rate(F.coalesce(F.col(text).cast("string"), F.lit(""))))
