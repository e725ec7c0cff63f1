"""Language-model scores by Brown classes: exchange clustering and a class bigram.

Every word belongs to a class; P(text) is the product over its tokens of P(class | history) and P(word | class).
Words that make up at least 1 / HEADS of the training tokens are units of their own; all rarer words share TAILS units by
their last two letters at first. The exchange algorithm moves units between classes; here all units weigh their best move
at once against the same class counts, and a random half of them moves each round, until two rounds together gain less
than MIN_GAIN a token. Then every rare word that occurs MIN_COUNT times leaves its unit and is exchanged by itself, as
part of the data: a word meets its own counts of the histories it follows, a table with a row a word, in TURNS groups of
words, each against class counts that hold the moves of the groups before. The history of a token is the class of the unit
of the token before, so it is known without a lookup; what is predicted is the word's own class. Words below MIN_COUNT
keep the class of their unit. What is clustered by itself thus grows with the input, and nothing of it passes the driver.

Transitions are smoothed by class frequencies; emissions by absolute discounting, where what is taken off the known words
of a class goes to the one unknown word of that class (for an unknown word, the class of its unit).

Counts are exact and cover all training text. Counts and classes of frequent words are broadcast (those with at least
1 / MAX_KNOWN of the tokens, so MAX_KNOWN at most); of the others each block of texts asks for its distinct words once,
by a join with the table of rare words.

Defined results: a null or empty text is its end token alone; repeated rows are scored each; without training text every
token is unknown; an empty table gives no rows; a null key is allowed; other columns are ignored. Words are 64-bit hashes.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .words import Words, mixed, slices

CLASSES = 64
#: The exchange of units goes on while two rounds gain this much a token (in nats).
MIN_GAIN = 1e-3
#: A rare word seen less often says too little of its neighbours to have a class of its own.
MIN_COUNT = 3
TURNS = 4
HEADS = 1 << 15
TAILS = 1024
MAX_KNOWN = 1 << 20
TRANSITION_PRIOR = 20.0
#: The end token, which no text can hold as a word.
END = np.uint64(0x454E44)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x, np.uint64).view(np.int64))


def tail_groups(vocabulary: pa.Array) -> np.ndarray:
    """Group of each word by its last two letters."""
    coded = pc.utf8_slice_codeunits(vocabulary, -2).dictionary_encode()
    groups = np.array([zlib.crc32(x.encode()) % TAILS for x in coded.dictionary.to_pylist()], np.int32)
    return groups[coded.indices.to_numpy()] if len(vocabulary) else np.zeros(0, np.int32)


def _texts(docs: DataFrame, *more: Column, text: str) -> DataFrame:
    return docs.select(*more, F.col(text).cast("string").alias("text"))


def count_words(train: DataFrame) -> DataFrame:
    """(word, n, tail) of all training tokens, ends included."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"), lower=True)
            n = np.bincount(words.codes, minlength=len(words.vocabulary))
            yield pa.RecordBatch.from_arrays(
                [signed(np.append(words.hashes().astype(np.uint64), END)), pa.array(np.append(n, len(batch)).astype(np.int64)),
                 pa.array(np.append(tail_groups(words.vocabulary), 0).astype(np.int32))], ["word", "n", "tail"])

    return (train.mapInArrow(count, "word long, n long, tail int").groupBy("word")
            .agg(F.sum("n").alias("n"), F.max("tail").alias("tail")))


class Units:
    """Numbers of units: heads by their sorted hashes, then tail groups, then the end."""

    def __init__(self, heads: np.ndarray):
        self.heads, self.end, self.count = heads, len(heads) + TAILS, len(heads) + TAILS + 1

    def of(self, hashes: np.ndarray, tails: np.ndarray) -> np.ndarray:
        if not len(self.heads):
            return tails.astype(np.int64)
        at = np.minimum(np.searchsorted(self.heads, hashes), len(self.heads) - 1)
        return np.where(self.heads[at] == hashes, at, len(self.heads) + tails).astype(np.int64)

    def sequence(self, words: Words, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units of all tokens, each text followed by its end, and where each text begins."""
        texts = len(words.starts) - 1
        out = np.full(len(words.codes) + texts, self.end, np.int64)
        out[np.arange(len(words.codes)) + words.owner()] = units[words.codes]
        return out, words.starts[:-1] + np.arange(texts)


def count_pairs(train: DataFrame, units: Units) -> DataFrame:
    """(a, b, n): how often unit b follows unit a; every text begins after an end."""
    shared = train.sparkSession.sparkContext.broadcast(units)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"), lower=True)
            tokens, _ = own.sequence(words, own.of(words.hashes(), tail_groups(words.vocabulary)))
            before = np.concatenate([[own.end], tokens[:-1]])
            pairs, n = np.unique(before * own.count + tokens, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n.astype(np.int64))], ["pair", "n"])

    pair = F.col("pair")
    return (train.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
            .select(F.floor(pair / units.count).cast("int").alias("a"), (pair % units.count).cast("int").alias("b"), "n"))


def neighbours(pairs: DataFrame) -> DataFrame:
    """(unit, next, before): a row a unit with its neighbours and their counts; lists are as long as there are units."""
    after = pairs.groupBy(F.col("a").alias("unit")).agg(F.collect_list(F.struct(F.col("b").alias("u"), "n")).alias("next"))
    ahead = pairs.groupBy(F.col("b").alias("unit")).agg(F.collect_list(F.struct(F.col("a").alias("u"), "n")).alias("before"))
    return after.join(ahead, "unit", "full")


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def by_class(lists: pa.Array, classes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of each row's neighbours by class; and rows, units and counts of the flat lists."""
    flat = lists.flatten()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), sizes)
    unit, n = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False).astype(float)
    table = np.bincount(row * k + classes[unit], n, len(lists) * k).reshape(len(lists), k)
    return table, row, np.column_stack([unit, n]) if len(flat) else np.zeros((0, 2))


def best_moves(own: np.ndarray, after: np.ndarray, ahead: np.ndarray, self_pairs: np.ndarray, counts: np.ndarray,
               k: int) -> tuple[np.ndarray, np.ndarray]:
    """Exchange step for some units against fixed class bigram ``counts``: best class of each, and what it gains.

    ``after`` and ``ahead`` count a unit's neighbours by class, ``self_pairs`` those that are the unit itself. The last
    class belongs to the end token alone.
    """
    best, gain = own.copy(), np.zeros(len(own))
    for i, c in enumerate(own.tolist()):
        r, left, s = after[i].copy(), ahead[i].copy(), self_pairs[i]
        r[c] -= s
        left[c] -= s
        rest = counts.copy()
        rest[c, :] -= r
        rest[:, c] -= left
        rest[c, c] -= s
        rows, columns = rest.sum(1), rest.sum(0)
        out_n, in_n = r.sum() + s, left.sum() + s
        value = (xlogx(rest + r) - xlogx(rest)).sum(1) + (xlogx(rest + left[:, None]) - xlogx(rest)).sum(0)
        here = np.diagonal(rest)
        both = r + left + s     # the cell (d, d) gets what comes from both sides
        value += xlogx(here + both) - xlogx(here + r) - xlogx(here + left) + xlogx(here)
        value -= xlogx(rows + out_n) - xlogx(rows) + xlogx(columns + in_n) - xlogx(columns)
        value[k - 1] = -np.inf
        best[i] = int(np.argmax(value))
        gain[i] = value[best[i]] - value[c]
    return best, gain


def class_pairs(adjacent: DataFrame, classes: np.ndarray, k: int) -> np.ndarray:
    """Class bigram counts, added up in the tasks; k * k numbers come back."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            after, _, _ = by_class(batch.column("next"), classes, k)
            np.add.at(total, classes[batch.column("unit").to_numpy()], after)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.ravel()[cells].astype(np.int64))], ["cell", "n"])

    out = np.zeros(k * k)
    for r in adjacent.select("unit", "next").mapInArrow(add, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out.reshape(k, k)


def likelihood(counts: np.ndarray) -> float:
    return float(xlogx(counts).sum() - xlogx(counts.sum(1)).sum() - xlogx(counts.sum(0)).sum())


def exchange(adjacent: DataFrame, frequency: np.ndarray, k: int = CLASSES, min_gain: float = MIN_GAIN) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all units and their bigram counts; ``adjacent`` is a written table of ``neighbours``.

    Each pair of rounds but the last raises the best likelihood, which is bounded, so the loop ends.
    """
    end = len(frequency) - 1
    classes = np.empty(len(frequency), np.int64)
    classes[np.argsort(-frequency, kind="stable")] = np.arange(len(frequency)) % (k - 1)
    classes[end] = k - 1
    counts = class_pairs(adjacent, classes, k)
    best = (likelihood(counts), classes, counts)
    needed = max(min_gain * counts.sum(), 1e-6)
    marks = [best[0]]
    for turn in itertools.count():
        def propose(batches: Iterator[pa.RecordBatch], classes=classes, counts=counts, turn=turn) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                unit = batch.column("unit").to_numpy().astype(np.int64)
                turns = (mixed(unit.astype(np.uint64) * np.uint64(1000) + np.uint64(turn)) & np.uint64(1)) == 0
                batch = batch.filter(pa.array(turns & (unit != end)))
                unit = batch.column("unit").to_numpy().astype(np.int64)
                after, row, flat = by_class(batch.column("next"), classes, k)
                ahead, _, _ = by_class(batch.column("before"), classes, k)
                same = flat[:, 0] == unit[row]
                self_pairs = np.bincount(row[same], flat[same, 1], len(unit))
                to, gain = best_moves(classes[unit], after, ahead, self_pairs, counts, k)
                moves = gain > 1e-6
                yield pa.RecordBatch.from_arrays([pa.array(unit[moves]), pa.array(to[moves])], ["unit", "to"])

        moved = adjacent.mapInArrow(propose, "unit long, to long").toPandas()     # units at most, see HEADS
        if moved.empty:
            break
        classes = classes.copy()
        classes[moved["unit"].to_numpy()] = moved["to"].to_numpy()
        counts = class_pairs(adjacent, classes, k)
        best = max(best, (likelihood(counts), classes, counts), key=lambda b: b[0])
        marks.append(best[0])
        if turn and marks[-1] - marks[-3] < needed:
            break
    return best[1], best[2]


def rare_histories(train: DataFrame, units: Units, classes: np.ndarray) -> DataFrame:
    """(word, tail, n, after): a row a rare word, with how often it follows each class; at most a cell a class."""
    shared = train.sparkSession.sparkContext.broadcast((units, classes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, unit_classes = shared.value
        k = int(unit_classes.max()) + 1
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"), lower=True)
            hashes, tails = words.hashes().astype(np.uint64), tail_groups(words.vocabulary)
            unit = own.of(hashes, tails)
            tokens, _ = own.sequence(words, unit)
            at = np.arange(len(words.codes)) + words.owner()
            history = unit_classes[np.concatenate([[own.end], tokens[:-1]])][at]
            is_rare = (unit >= len(own.heads))[words.codes]
            cells, n = np.unique(words.codes[is_rare].astype(np.int64) * k + history[is_rare], return_counts=True)
            code = cells // k
            yield pa.RecordBatch.from_arrays(
                [signed(hashes[code]), pa.array(tails[code].astype(np.int32)), pa.array((cells % k).astype(np.int32)),
                 pa.array(n.astype(np.int64))], ["word", "tail", "h", "n"])

    # one shuffle: both groupings hold within a word's partition, and no rare word is frequent
    return (train.mapInArrow(count, "word long, tail int, h int, n long").repartition("word")
            .groupBy("word", "h").agg(F.max("tail").alias("tail"), F.sum("n").alias("n"))
            .groupBy("word").agg(F.max("tail").alias("tail"), F.sum("n").alias("n"),
                                 F.sort_array(F.collect_list(F.struct("h", "n"))).alias("after")))


def best_classes(row: np.ndarray, h: np.ndarray, n: np.ndarray, own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Exchange step for the predicted class of some words against fixed ``counts`` (history, class).

    Entry i says that word ``row[i]`` follows class ``h[i]`` ``n[i]`` times; entries stand by word, every word has one.
    ``own`` are the words' classes, whose counts hold them. The last class belongs to the end token alone.
    """
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    rest = counts[h].astype(float)
    rest[np.arange(len(h)), own[row]] -= n
    value = np.add.reduceat(xlogx(rest + n[:, None]) - xlogx(rest), starts)
    total = np.add.reduceat(n, starts)
    size = np.repeat(counts.sum(0)[None, :], len(own), 0)
    size[np.arange(len(own)), own] -= total
    value -= xlogx(size + total[:, None]) - xlogx(size)
    value[:, -1] = -np.inf
    best = np.argmax(value, 1)
    here = np.arange(len(own))
    return np.where(value[here, best] > value[here, own] + 1e-6, best, own)


def exchange_rare(histories: DataFrame, units: Units, classes: np.ndarray, counts: np.ndarray, min_count: int = MIN_COUNT,
                  turns: int = TURNS) -> tuple[DataFrame, np.ndarray]:
    """(word, n, class) of all rare words, and the bigram counts with their moves; ``histories`` is a written table."""
    first_tail, done = len(units.heads), []
    group = F.pmod(F.xxhash64("word"), F.lit(turns))
    for turn in range(turns):
        def move(batches: Iterator[pa.RecordBatch], counts=counts) -> Iterator[pa.RecordBatch]:
            moved = np.zeros(counts.shape)
            for batch in batches:
                for at in range(0, len(batch), 2000):       # a word's cells are weighed for all classes at once
                    part = batch.slice(at, 2000)
                    cells = part.column("after")
                    total = part.column("n").to_numpy()
                    row = np.repeat(np.arange(len(part)), pc.list_value_length(cells).to_numpy(zero_copy_only=False))
                    flat = cells.flatten()
                    h, n = flat.field(0).to_numpy(), flat.field(1).to_numpy().astype(float)
                    own = classes[first_tail + part.column("tail").to_numpy()]
                    to = np.where(total >= min_count, best_classes(row, h, n, own, counts), own)
                    np.add.at(moved, (h, to[row]), n)
                    np.add.at(moved, (h, own[row]), -n)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("word"), part.column("n"), pa.array(to.astype(np.int32)), pa.nulls(len(part), pa.int32())],
                        ["word", "n", "class", "cell"])
            cell = np.flatnonzero(moved)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(cell), pa.int64()), pa.array(moved.ravel()[cell].astype(np.int64)),
                 pa.nulls(len(cell), pa.int32()), pa.array(cell.astype(np.int32))], ["word", "n", "class", "cell"])

        rows = materialize(histories.where(group == turn).mapInArrow(move, "word long, n long, class int, cell int"), "rare-classes")
        changes = np.zeros(counts.size)
        for r in rows.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("n").alias("n")).collect():    # k * k at most
            changes[r["cell"]] = r["n"]
        counts = counts + changes.reshape(counts.shape)
        done.append(rows.where("cell IS NULL").select("word", "n", "class"))
    return reduce(DataFrame.unionAll, done), counts


class Model(NamedTuple):
    units: Units
    classes: np.ndarray         # of units
    transitions: np.ndarray     # log10 P(class | class of the unit before)
    class_tokens: np.ndarray    # training tokens of each class
    unknown: np.ndarray         # log10 P(unknown word | class)
    discount: float
    known: np.ndarray           # sorted hashes of frequent words
    known_n: np.ndarray
    known_class: np.ndarray
    tokens: int
    types: int

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 0.5) / (self.tokens + 0.5 * (self.types + 1)))

    def emission(self, n: np.ndarray, classes: np.ndarray) -> np.ndarray:
        seen = np.log10(np.maximum(n - self.discount, 1e-9) / np.maximum(self.class_tokens[classes], 1.0))
        return np.where(n > 0, seen, self.unknown[classes])


def fit(train: DataFrame, counts: DataFrame, k: int = CLASSES, heads: int = HEADS,
        max_known: int = MAX_KNOWN) -> tuple[Model, DataFrame]:
    """The model and (word, n, class) of its rare words; ``counts`` is a written table of ``count_words`` over ``train``."""
    n, end = F.col("n"), int(END)
    once = F.sum((n == 1).cast("long"))
    twice = F.sum((n == 2).cast("long"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("types"),
                       F.coalesce(once, F.lit(0)).alias("once"), F.coalesce(twice, F.lit(0)).alias("twice")).first()
    tokens = total["tokens"]
    frequent = counts.where((n * heads >= tokens) & (F.col("word") != end)).select("word", "n").toPandas()   # heads rows at most
    order = np.argsort(frequent["word"].to_numpy(np.int64).view(np.uint64))
    units = Units(frequent["word"].to_numpy(np.int64).view(np.uint64)[order])

    frequency = np.zeros(units.count)
    frequency[:len(units.heads)] = frequent["n"].to_numpy(np.int64)[order]
    rare = counts.where((n * heads < tokens) & (F.col("word") != end))
    for r in rare.groupBy("tail").agg(F.sum("n").alias("n")).collect():
        frequency[len(units.heads) + r["tail"]] = r["n"]
    ends = counts.where(F.col("word") == end).first()
    if ends is not None:
        frequency[units.end] = ends["n"]

    adjacent = materialize(neighbours(materialize(count_pairs(train, units), "unit-pairs")), "unit-neighbours")
    classes, pairs = exchange(adjacent, frequency, k)
    words, pairs = exchange_rare(materialize(rare_histories(train, units, classes), "rare-histories"), units, classes, pairs)

    class_tokens, class_types = pairs.sum(0), np.bincount(classes[:len(units.heads)], minlength=k).astype(float)
    class_types[k - 1] += ends is not None
    for r in words.groupBy("class").count().collect():
        class_types[r["class"]] += r["count"]
    better_known = words.where(n * max_known >= tokens).toPandas()       # max_known rows at most
    ends_n = [ends["n"]] if ends is not None else []
    known = np.concatenate([units.heads, better_known["word"].to_numpy(np.int64).view(np.uint64), np.full(len(ends_n), END)])
    known_n = np.concatenate([frequency[:len(units.heads)], better_known["n"].to_numpy(np.int64), ends_n]).astype(np.int64)
    known_class = np.concatenate([classes[:len(units.heads)], better_known["class"].to_numpy(np.int64),
                                  np.full(len(ends_n), k - 1)]).astype(np.int64)
    order = np.argsort(known)

    discount = total["once"] / max(1.0, total["once"] + 2.0 * total["twice"])
    discount = min(max(discount, 0.1), 0.9)
    share = (class_tokens + 0.5) / (class_tokens.sum() + 0.5 * k)
    transitions = (pairs + TRANSITION_PRIOR * share) / (pairs.sum(1, keepdims=True) + TRANSITION_PRIOR)
    unknown = np.where(class_tokens > 0, discount * class_types / np.maximum(class_tokens, 1.0), 1.0)
    model = Model(units, classes, np.log10(transitions), class_tokens, np.log10(unknown), discount, known[order], known_n[order],
                  known_class[order], int(tokens), int(total["types"]))
    return model, words


def add_by_text(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of runs that begin at ``starts``; every run has a value."""
    return np.add.reduceat(values, starts) if len(starts) else np.zeros(0)


def part_scores(docs: DataFrame, model: Model, key: str, text: str) -> DataFrame:
    """What a block of texts knows by itself: a row a text, and one row a block with its rare words.

    ``rare`` lists a text's rare tokens as places in the block's ``words``, ``history`` the classes they follow.
    """
    source = _texts(docs, F.col(key).alias("key"), text=text)
    kind = source.schema["key"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = (f"block long, key {kind}, n_tokens long, n_known long, base double, score double, rare array<int>, "
              "history array<int>, words array<long>, word_class array<int>")
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, block = shared.value, TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text"):
            block += 1
            words = Words(batch.column("text"), lower=True)
            hashes = words.hashes().astype(np.uint64)
            unit = m.units.of(hashes, tail_groups(words.vocabulary))
            tokens, starts = m.units.sequence(words, unit)
            before = np.concatenate([[m.classes[m.units.end]], m.classes[tokens][:-1]])
            n = np.zeros(len(hashes) + 1, np.int64)     # the end stands last
            word_class = m.classes[np.append(unit, m.units.end)]
            asked = np.append(hashes, END)
            if len(m.known):
                at = np.minimum(np.searchsorted(m.known, asked), len(m.known) - 1)
                found = m.known[at] == asked
                n, word_class = np.where(found, m.known_n[at], 0), np.where(found, m.known_class[at], word_class)
            # rare words (0 here) are scored once their counts and classes are known; the end is always scored here
            here = np.append(n[:-1] > 0, True)
            code = np.full(len(tokens), len(hashes))
            code[np.arange(len(words.codes)) + words.owner()] = words.codes
            base, emitted = np.where(here, m.base(n), 0.0), np.where(here, m.emission(n, word_class), 0.0)
            steps = np.where(here[code], m.transitions[before, word_class[code]], 0.0)
            place = np.cumsum(~here) - 1
            open_tokens = ~here[code]
            ends = np.append(starts, len(tokens))
            rare_ends = np.concatenate([[0], np.cumsum(open_tokens)])[ends]
            rows, rare = len(batch), pa.array(place[code[open_tokens]].astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(rows, block)), batch.column("key"), pa.array(np.diff(ends)),
                pa.array(add_by_text((n > 0)[code].astype(np.int64), starts).astype(np.int64)),
                pa.array(add_by_text(base[code], starts)),
                pa.array(add_by_text(emitted[code] + steps, starts)),
                pa.ListArray.from_arrays(pa.array(rare_ends.astype(np.int32)), rare),
                pa.ListArray.from_arrays(pa.array(rare_ends.astype(np.int32)), pa.array(before[open_tokens].astype(np.int32))),
                pa.nulls(rows, pa.list_(pa.int64())), pa.nulls(rows, pa.list_(pa.int32()))], names)
            left = ~here[:-1]
            yield pa.RecordBatch.from_arrays([
                pa.array([block]), pa.nulls(1, batch.column("key").type), *[pa.nulls(1, pa.int64())] * 2,
                *[pa.nulls(1, pa.float64())] * 2, *[pa.nulls(1, pa.list_(pa.int32()))] * 2,
                pa.array([hashes[left].view(np.int64)], pa.list_(pa.int64())),
                pa.array([word_class[:-1][left].astype(np.int32)], pa.list_(pa.int32()))], names)

    return source.mapInArrow(read, schema)


def score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", k: int = CLASSES,
          heads: int = HEADS, max_known: int = MAX_KNOWN) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every row; ``train`` tells which rows teach."""
    taught = _texts(docs.where(train), text=text)
    counts = materialize(count_words(taught), "word-counts")
    model, rare = fit(taught, counts, k, heads, max_known)
    parts = materialize(part_scores(docs, model, key, text), "part-scores")
    rare = rare.where(F.col("n") * max_known < model.tokens)
    asked = parts.where(F.col("words").isNotNull()).select("block", F.posexplode("words").alias("place", "word"))
    # a block's words are bounded by its text
    found = asked.join(rare, "word").groupBy(F.col("block").alias("asker")).agg(F.collect_list(F.struct("place", "n", "class")).alias("found"))
    kind = parts.schema["key"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def finish(block: pa.Table, found: pa.Table) -> pa.Table:
        m = shared.value
        block = block.combine_chunks()
        is_list = pc.is_valid(block.column("words"))
        listed, texts = block.filter(is_list), block.filter(pc.invert(is_list))
        classes = listed.column("word_class")[0].values.to_numpy().copy() if len(listed) else np.zeros(0, np.int32)
        n = np.zeros(len(classes), np.int64)
        if len(found):
            pairs = found.column("found")[0].values
            n[pairs.field(0).to_numpy()] = pairs.field(1).to_numpy()
            classes[pairs.field(0).to_numpy()] = pairs.field(2).to_numpy()
        rare = texts.column("rare").combine_chunks()
        history = texts.column("history").combine_chunks().flatten().to_numpy()
        sizes = pc.list_value_length(rare).to_numpy(zero_copy_only=False)
        place, owner = rare.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)

        def more(values: np.ndarray) -> np.ndarray:
            return np.bincount(owner, values[place], len(sizes))

        steps = np.bincount(owner, m.transitions[history, classes[place]], len(sizes))

        return pa.table({
            "key": texts.column("key"), "n_tokens": texts.column("n_tokens"),
            "n_known": texts.column("n_known").to_numpy() + more(n > 0).astype(np.int64),
            "base_score": texts.column("base").to_numpy() + more(m.base(n)),
            "score": texts.column("score").to_numpy() + more(m.emission(n, classes)) + steps})

    done = parts.groupBy("block").cogroup(found.groupBy("asker")).applyInArrow(
        finish, f"key {kind}, n_tokens long, n_known long, base_score double, score double")
    return done.select(F.col("key").alias(key), "n_tokens", "n_known",
                       F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
