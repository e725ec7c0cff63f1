"""Judging, mixing and joining documents, against brute force and on odd rows."""

import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from needmatch.llm import class_model, components, jaccard_join, labels as labelled, mixing, quality_classifier, quality_rules, toxicity

from .conftest import prose


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality_classifier(spark, odd, bare, labels):
    out = quality_classifier.score(odd, labels)
    assert set(out.columns) == {*odd.columns, "verdict"} and out.count() == odd.count()
    assert all(0 <= r.verdict.score <= 1 for r in out.collect())
    joined = quality_classifier.score(odd, labels, max_broadcast_sites=0)
    assert sorted(map(repr, joined.collect())) == sorted(map(repr, out.collect()))
    assert quality_classifier.score(bare, labels).count() == 0
    none = quality_classifier.score(odd, labels.where("false")).collect()
    assert {r.verdict.kept for r in none} == {True}


def test_quality_classifier_learns_and_shrinks(spark):
    bad = [(i, " ".join(w.upper() + "!!" for w in prose(i, 60).split()), "b", "x", 0) for i in range(150)]
    good = [(1000 + i, prose(i, 60), "a", "x" if i % 2 else "y", 1) for i in range(300)]
    docs = spark.createDataFrame(bad + good, "doc_id long, text string, source string, lang string, quality int")
    truth = docs.select("doc_id", "quality").where("doc_id % 3 = 0")
    rows = quality_classifier.score(docs, truth).collect()
    assert all(r.verdict.kept == bool(r.quality) for r in rows)
    assert max(r.verdict.host_rate for r in rows if r.source == "b") < 0.2 < min(r.verdict.host_rate for r in rows if r.source == "a")


def test_toxicity(spark, odd, bare):
    rng = random.Random(3)
    docs, truth = [], []
    for i in range(600):
        text = prose(i, 40).split()
        bad = i % 6 == 0
        if bad:
            text[10] = rng.choice(["dreadfull", "blockhead", "knavish1", "knavish2"])
        docs.append((i, " ".join(text), "s", "en"))
        truth.append((i, 1, int(bad)))
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    lexicon = toxicity.fit(frame, spark.createDataFrame(truth, "doc_id long, quality int, toxic int"))
    forms = {e.text for e in lexicon.entries}
    assert {"dreadfull", "blockhead"} <= forms and any(e.stem and "knavish".startswith(e.text) for e in lexicon.entries)
    scored = {r.doc_id: r.toxicity for r in toxicity.score(frame, lexicon).collect()}
    assert all((scored[i] >= toxicity.THRESHOLD) == (i % 6 == 0) for i in scored)
    import pyarrow as pa
    plain, misspelled, cited = lexicon.scores(pa.array([prose(1, 20), "you blockheed you dreadfll", "they said \"blockhead\" then"]))
    assert plain < misspelled and cited < lexicon.scores(pa.array(["you blockhead there"]))[0]
    odd_scores = toxicity.score(odd, lexicon, out="verdict")
    assert odd_scores.count() == odd.count() and odd_scores.columns.count("verdict") == 1
    assert toxicity.score(bare, lexicon).count() == 0
    empty = toxicity.fit(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert empty.entries == [] and all(0 <= r.toxicity <= 1 for r in toxicity.score(odd, empty).collect())


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_automaton_against_edit_distance():
    rng = random.Random(5)
    entries = [toxicity.Entry(w, False) for w in ("abc", "abcab", "babba", "cabbacabb", "aabbccaab")]
    automaton = toxicity.LexiconAutomaton(entries)
    for _ in range(4000):
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 12)))
        near = [(d, i) for i, e in enumerate(entries) if (d := edit_distance(word, e.text)) <= toxicity.edits_allowed(e)]
        assert (automaton.match(word) or (None,))[0] == (min(near)[0] if near else None), word


def test_misspelled_inflected_terms(spark):
    import pyarrow as pa
    rng, docs, truth = random.Random(4), [], []
    for i in range(600):
        text = prose(i, 40).split()
        if i % 6 == 0:
            text[10] = rng.choice(["idiot", "idiots", "idiotic", "scum"])
        docs.append((i, " ".join(text)))
        truth.append((i, int(i % 6 == 0)))
    lexicon = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"),
                           spark.createDataFrame(truth, "doc_id long, toxic int"))
    assert any(e.stem and "idiot".startswith(e.text) for e in lexicon.entries)
    assert {"idiot", "idiots", "idiotic"} <= {e.text for e in lexicon.entries if not e.stem}
    clean = [prose(1000 + i, 40) for i in range(50)]
    scores = lexicon.scores(pa.array([f"you {w} there" for w in ("1diot", "diot", "1diots", "idiotis", "idiotlc", "scvm", "people")] + clean))
    assert all(s > scores[6] for s in scores[:6])
    assert all(s < toxicity.THRESHOLD for s in scores[6:])


def test_stems_against_edit_distance():
    rng = random.Random(6)
    entries = [toxicity.Entry("abca", True), toxicity.Entry("bbacb", True), toxicity.Entry("abcab", False)]
    automaton = toxicity.LexiconAutomaton(entries)
    for _ in range(4000):
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 12)))
        near = [min(edit_distance(word[:n], e.text) for n in range(len(word) + 1)) if e.stem else edit_distance(word, e.text)
                for e in entries]
        near = [d for d, e in zip(near, entries, strict=True) if d <= toxicity.edits_allowed(e)]
        assert (automaton.match(word) or (None,))[0] == (min(near) if near else None), word


def test_quality_rules(odd, bare):
    got = quality_rules.judge_quality(odd).collect()
    assert len(got) == odd.count()
    texts = {}
    for r in odd.collect():
        texts.setdefault(r.doc_id, r.text or "")
    for r in got:
        text = texts[r.doc_id]
        w = words(text)
        lines = [x for x in text.split("\n") if words(x)]
        grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        covered = {k for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for k in range(i, i + 5)}
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
    assert quality_rules.judge_quality(bare).count() == 0


def test_common_lines_count_distinct_documents(spark):
    note = "please read all of these terms with care before you go on to use this site"
    rows = [(i, f"{note}\n{prose(i, 12)}", "a") for i in range(30)]             # note in 30 documents of a
    rows += [(100 + i, f"{prose(500, 40)}\n{prose(501, 40)}", "a") for i in range(30)]      # copies count once
    rows += [(200 + i, prose(900 + i, 40), "a") for i in range(30)] + [(300, f"{note}\n{prose(1, 12)}", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: (r.kept, r.removed_words) for r in
            quality_rules.judge_quality(docs, min_docs=5, max_share=0.1, min_left_share=0.5).collect()}
    assert all(kept[i] == (False, 16) for i in range(30)) and kept[300] == (True, 0)
    assert all(kept[i] == (True, 0) for i in [*range(100, 130), *range(200, 230)])


def test_common_lines_on_small_and_hot_hosts(spark):
    note = "please read all of these terms with care before you go on to use this site"
    rows = [(i, f"{note}\n{prose(i, 30)}", "small") for i in range(8)]          # all documents of a small host
    rows += [(100 + i, (f"{note}\n" if i < 60 else "") + prose(100 + i, 30), "hot") for i in range(2000)]      # 3 % of a large one
    rows += [(3000 + i, f"{note}\n{prose(3000 + i, 30)}", "two") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    removed = {r.doc_id: r.removed_words for r in quality_rules.judge_quality(docs).collect()}
    assert {i for i, n in removed.items() if n == 16} == {*range(8), *range(100, 160)}
    assert set(removed.values()) == {0, 16}


def filled(sizes, weights=(5, 2, 1), most=3):
    """Targets by plain repetition of the rule."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    full = {s for s in names if not sizes[s]}
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / free for s in names}
        over = {s for s in names if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("seed", range(4))
def test_mixing(spark, seed):
    rng = random.Random(seed)
    sources = [None, "", "a", "b", "ä", "z"]
    rows = [(i, prose(i, rng.randrange(1, 60)), rng.choice(sources if seed else ["a", "a", "a", "b"])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, group_rows=16).collect()
    assert len(got) == 400
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(words(text))
    want = filled(sizes)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert own[0].target == pytest.approx(want[s]) and own[0].source_size == sizes[s]
        assert abs(sum(r.taken for r in own) - want[s]) <= 60
    assert all(r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in got)
    again = mixing.mix(docs.repartition(7), group_rows=16).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_rounding_is_unbiased():
    rng = np.random.default_rng(1)
    masses = np.array([50.0, 30, 20, 9, 5, 5, 1])
    pooled, paired = np.zeros(7), np.zeros(7)
    for _ in range(6000):
        a = mixing.pool_rounding(masses, 0.3, rng.random(7))
        b = mixing.pair_rounding(masses, np.array([0.3, 0.9, 0.0, 0.5, 0.2, 1.0, 0.7]), rng.random(7))
        assert ((a > 0) & (a < 1)).sum() <= 1 and ((b > 0) & (b < 1)).sum() <= 1
        assert abs(a @ masses - 0.3 * masses.sum()) < 1e-6
        pooled, paired = pooled + a, paired + b
    assert np.allclose(pooled / 6000, 0.3, atol=0.03)
    assert np.allclose(paired / 6000, [0.3, 0.9, 0.0, 0.5, 0.2, 1.0, 0.7], atol=0.03)


def test_mixed_rows(odd, bare):
    plan = Counter()
    for r in mixing.mix(odd).collect():
        plan[r.doc_id, r.source] += r.copies
    rows = mixing.mixed_rows(odd)
    assert rows.columns == odd.columns
    assert Counter((r.doc_id, r.source) for r in rows.collect()) == +plan
    assert mixing.mix(bare).count() == 0 and mixing.mixed_rows(bare).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_equal_rows_are_mixed_apart(spark, seed):
    """Half of a source is one row 5000 times over; the source still meets its target."""
    text = prose(3, 40)
    rows = ([(7, text, "a", 0)] * 5000 + [(1000 + i, prose(i, 40), "a", 0) for i in range(300)]
            + [(5000 + i, prose(i, 37), "b", 0) for i in range(1500)])
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _copy int").repartition(5)
    got = mixing.mix(docs, seed=seed, group_rows=64)
    totals = {r.source: r for r in got.groupBy("source").agg({"taken": "sum", "target": "max", "*": "count"}).collect()}
    for r in totals.values():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 40
    assert totals["a"]["count(1)"] == 5300
    copies = {r.copies for r in got.where("doc_id = 7").collect()}
    assert len(copies) == 2 and max(copies) - min(copies) == 1
    out = mixing.mixed_rows(docs, seed=seed, group_rows=64)
    assert out.columns == docs.columns
    want = {r.doc_id: r["sum(copies)"] for r in got.groupBy("doc_id").agg({"copies": "sum"}).collect() if r["sum(copies)"]}
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == want


def test_mixed_rows_with_clashing_names(spark):
    """Columns named like the operator's own pass through as they are."""
    names = ["_key", "_source", "_content", "_copies", "_copy", "row", "rows", "least", "more", "place", "copies", "copy"]
    rows = [(i, prose(i, 20), "a", *[f"{n}{i}" for n in names]) for i in range(20)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    assert all(r[n] == f"{n}{r.doc_id}" for r in out.collect() for n in names)


def test_labelled_sample_is_bounded_on_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "one text")] * 5000 + [(2, f"text {n}") for n in range(500)] + [(3, None), (None, "x")],
                                 "doc_id long, text string").repartition(5)
    marks = spark.createDataFrame([(1, 0, 1), (1, 0, 1), (2, 1, 0), (3, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = labelled.labelled_sample(docs, marks, "toxic", max_rows=10).collect()
    assert sorted((r.key, r.label) for r in got) == [(1, 1), (2, 0), (3, 0)]
    assert {r.key: r.text for r in got}[3] == ""
    assert labelled.labelled_sample(docs, marks, "toxic", max_rows=2).count() == 2
    again = labelled.labelled_sample(docs.repartition(3), marks, "toxic", max_rows=10).collect()
    assert sorted(got) == sorted(again)


def test_tail_is_the_binomial_tail():
    """Against exact fractions; the number of documents switches nothing."""
    for rate in (Fraction(1, 50), Fraction(1, 2), Fraction(9, 10)):
        for n in (1, 5, 60, 61, 200, 400):
            for hits in {0, 1, n // 2, n - 1, n}:
                want = sum(math.comb(n, k) * rate ** k * (1 - rate) ** (n - k) for k in range(hits, n + 1))
                assert toxicity.tail(hits, n, float(rate)) == pytest.approx(float(want), rel=1e-9, abs=1e-300)
    assert toxicity.tail(61, 61, 0.9) < toxicity.tail(60, 60, 0.9) < toxicity.MAX_CHANCE
    assert toxicity.tail(400, 400, 0.9) < 1e-15 < toxicity.tail(20000, 20000, 0.999)
    assert toxicity.tail(3, 5, 0.0) == 0.0 and toxicity.tail(3, 5, 1.0) == 1.0 and toxicity.tail(0, 0, 0.3) == 1.0


def linked_components(texts, width=4):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_linked_sets_meet_where_both_have_room():
    import pyarrow as pa
    rng = random.Random(2)
    for words_of, boundary in [(150, 24), (20, 24), (30, 32)] * 20:
        base = prose(rng.randrange(999), words_of).split()
        texts = []
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(99)}"
            texts.append(" ".join(copy))
        sets = jaccard_join.ShingleSets(pa.array(texts), 4)
        lists = [dict(zip(*(x.tolist() for x in sets.signatures(i, boundary, 85)), strict=True)) for i in range(len(texts))]
        own = [set(sets.values[a:b].tolist()) for a, b in zip(sets.starts[:-1], sets.starts[1:], strict=True)]
        for i in range(len(texts)):
            for j in range(i):
                both, either = len(own[i] & own[j]), len(own[i] | own[j])
                if 100 * both >= 85 * either and own[i] != own[j]:
                    need = 85 * (len(own[i]) + len(own[j]))
                    assert any(185 * min(lists[i][s], lists[j][s]) >= need for s in lists[i].keys() & lists[j].keys())


def test_near_copies(spark):
    rng = random.Random(11)
    texts = {}
    for family in range(25):
        base = prose(family, rng.choice([3, 6, 9, 15, 40, 120]), rng.choice(["en", "de"])).split()
        for _ in range(rng.randrange(1, 14)):
            copy = list(base)
            for _ in range(rng.randrange(0, 3)):
                at = rng.randrange(len(copy))
                copy[at:at + rng.randrange(2)] = [f"new{rng.randrange(99)}"]
            texts[len(texts)] = " ".join(copy)
            base = copy if rng.random() < 0.4 else base          # chains
    shared = prose(77, 60)
    for i in range(20):
        texts[len(texts)] = shared + " " + prose(1000 + i, 25)
    texts[len(texts)] = None
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_copies(docs).collect()}
    assert got == linked_components(texts)


def test_near_copies_odd(odd, bare):
    got = jaccard_join.near_copies(odd).collect()
    assert len(got) == odd.count()
    ids = {r.doc_id: r.component_id for r in got}
    assert ids[5] == 4 and ids[7] == 6 and ids[1] == 1 and ids[2] == 2 and ids[11] == 11
    assert jaccard_join.near_copies(bare).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)]
    got = {r.node: r.comp for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for a, b in edges:
        assert a == b or got[a] == got[b]
    assert len({got[i] for i in range(61)}) == 1 and not {got[i] for i in range(61)} & {got[i] for i in got if i >= 100}


def test_class_model(spark):
    rows = [(i, None if i == 3 else prose(i, i % 90, "de" if i % 3 else "en")) for i in range(400)]
    docs = spark.createDataFrame([*rows, (400, "Only New Wörds")], "doc_id long, text string")
    held = labelled.remainder("doc_id", 5) == 1
    got = {r.doc_id: r for r in class_model.score(docs, ~held, k=8).collect()}
    tokens = {i: (t or "").encode().lower().split() + [b"\n"] for i, t in [*rows, (400, "Only New Wörds")]}
    taught = [i for i in tokens if zlib.crc32(str(i).encode()) % 5 != 1]
    counts = Counter(t for i in taught for t in tokens[i])
    n, v = sum(counts.values()), len(counts)
    gain = 0.0
    for i, r in got.items():
        assert r.n_tokens == len(tokens[i]) and r.n_known == sum(t in counts for t in tokens[i]) and r.train_tokens == n
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens[i]))
        gain += (r.score - r.base_score) * (i not in taught)
    assert len(got) == 401 and gain > 0


def test_class_model_sums_to_one(spark):
    docs = spark.createDataFrame([(i, prose(i, 50)) for i in range(80)], "doc_id long, text string")
    counts = class_model.materialize(class_model.count_words(docs.select("text")), "counts")
    m, rare = class_model.fit(docs.select("text"), counts, k=6, heads=60)
    assert 0 < len(m.units.heads) < 60 and rare.where("n >= 3").count() > 50
    assert np.allclose((10 ** m.transitions).sum(1), 1)
    rows = counts.toPandas()
    hashes = rows["word"].to_numpy(np.int64).view(np.uint64)
    at = np.searchsorted(m.known, hashes)
    n, classes = rows["n"].to_numpy(), m.known_class[at]
    assert (m.known[at] == hashes).all() and (m.known_n[at] == n).all()
    assert np.allclose(m.class_tokens, np.bincount(classes, n, 6))
    for c in set(classes.tolist()):
        inside = classes == c
        mass = (10 ** m.emission(n[inside], classes[inside])).sum() + 10 ** m.unknown[c]
        assert mass == pytest.approx(1)


def test_class_model_best_classes():
    """The best class of a word is the one with the largest likelihood of all counts, by trying each."""
    rng = np.random.default_rng(5)
    k = 5
    tables = [rng.integers(0, 9, k) for _ in range(12)]
    tables = [t + (t.sum() == 0) for t in tables]
    own = rng.integers(0, k - 1, len(tables))
    counts = rng.integers(20, 60, (k, k)).astype(float)
    for t, c in zip(tables, own):
        counts[:, c] += t
    cells = [(i, h, n) for i, t in enumerate(tables) for h, n in enumerate(t) if n]
    row, h, n = (np.array(x) for x in zip(*cells))
    got = class_model.best_classes(row, h, n.astype(float), own, counts)
    for i, (t, c) in enumerate(zip(tables, own)):
        tried = []
        for d in range(k - 1):
            other = counts.copy()
            other[:, c] -= t
            other[:, d] += t
            tried.append(class_model.likelihood(other))
        assert tried[got[i]] == pytest.approx(max(tried), abs=1e-5)


def test_class_model_rare_words(spark):
    """Scores by hand from the classes found, with words that are known to tasks and words that are asked for."""
    texts = {i: prose(i, 40, "de" if i % 2 else "en") for i in range(60)}
    docs = spark.createDataFrame([*texts.items(), (60, "Only New Wörds")], "doc_id long, text string")
    train = F.col("doc_id") < 50
    taught = docs.where(train).select("text")
    counts = class_model.materialize(class_model.count_words(taught), "counts")
    m, rare = class_model.fit(taught, counts, k=6, heads=60, max_known=400)
    own = {r["word"]: r for r in rare.collect()}
    heads = {int(w.view(np.int64)): i for i, w in enumerate(m.units.heads)}
    assert any(r["n"] * 400 < m.tokens for r in own.values()) and any(r["n"] * 400 >= m.tokens for r in own.values())
    counted = {r["word"]: r["n"] for r in counts.collect()}
    once = {i: r for i, r in own.items() if r["n"] < class_model.MIN_COUNT}
    got = {r.doc_id: r.score for r in class_model.score(docs, train, k=6, heads=60, max_known=400).collect()}
    for i, text in [*texts.items(), (60, "only new wörds")]:
        before, total = m.classes[m.units.end], 0.0
        for w in text.lower().split():
            h = int(np.uint64(xxhash.xxh3_64_intdigest(w)).view(np.int64))
            tail = len(heads) + zlib.crc32(w[-2:].encode()) % class_model.TAILS
            unit = m.classes[heads.get(h, tail)]
            c = own[h]["class"] if h in own else unit
            assert h not in once or c == unit
            total += m.transitions[before, c] + m.emission(np.array([counted.get(h, 0)]), np.array([c]))[0]
            before = unit
        end = m.classes[m.units.end]
        total += m.transitions[before, end] + m.emission(np.array([50]), np.array([end]))[0]
        assert got[i] == pytest.approx(total)


def test_class_model_odd(odd, bare):
    train = labelled.remainder("doc_id", 5) != 1
    got = class_model.score(odd, train, k=4).collect()
    assert len(got) == odd.count() and all(r.score <= 0 for r in got)
    assert class_model.score(bare, train, k=4).count() == 0
    none = class_model.score(odd, F.lit(False), k=4).collect()
    assert {r.n_known for r in none} == {0}
