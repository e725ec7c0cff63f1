"""SimHash fingerprints and links against plain versions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from needmatch.llm import simhash_dedup as sd
from needmatch.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])


def plain_prints(spark, rows):
    """By Spark's own XXH64 with seed 42."""
    frame = spark.createDataFrame([(i, s) for i, t in enumerate(rows) for s in plain_shingles(t)], "i int, s string")
    hashes = {}
    for r in frame.select("i", F.xxhash64("s").alias("h")).collect():
        hashes.setdefault(r.i, []).append(r.h % 2 ** 64)
    return [sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes.get(i, [])) > len(hashes.get(i, [])))
            for i in range(len(rows))]


def plain_components(prints, keys, limit=2):
    parent = list(range(len(prints)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, p in enumerate(prints):
        for j in range(i):
            if bin(p ^ prints[j]).count("1") <= limit:
                parent[top(i)] = top(j)
    groups = {}
    for i, k in enumerate(keys):
        groups.setdefault(top(i), []).append(k)
    least = {t: min((k for k in ks if k is not None), default=None) for t, ks in groups.items()}
    return [least[top(i)] for i in range(len(prints))]


def clustered(n, seed):
    """Distinct fingerprints: near ones in chains, some bits tied together, some nearly constant."""
    r = random.Random(seed)
    out = {0, 1, 2 ** 64 - 1, 2 ** 63}
    while len(out) < n:
        p = r.getrandbits(64) & r.choice([2 ** 64 - 1, 2 ** 20 - 1, 2 ** 40 - 1])
        p = p & ~0xFF | (0xFF if r.random() < 0.5 else 0)
        for _ in range(r.choice([1, 1, 5, 30])):
            out.add(p)
            for _ in range(r.choice([1, 2, 2, 3])):
                p ^= 1 << r.choice(range(64))
    return sorted(out)


def signed(p):
    return p - 2 ** 64 if p >= 2 ** 63 else p


@pytest.mark.parametrize("layout", [None, 0, 1, 2, 3])
def test_links(spark, layout):
    prints = clustered(1500, 5)
    want = {(a, b) for i, a in enumerate(prints) for b in prints[i + 1:] if bin(a ^ b).count("1") <= 2}
    frame = spark.createDataFrame([(signed(p),) for p in prints], "print long").repartition(3)
    got = [(r.a % 2 ** 64, r.b % 2 ** 64) for r in sd.links(frame, 2, layout).collect()]
    assert len(got) == len(set(got)) and {tuple(sorted(x)) for x in got} == want


def test_thresholds():
    prints = np.array([signed(p) for p in clustered(1500, 6)])
    bits = np.arange(64).reshape(4, 16)
    values = sd.block_values(prints, bits)
    counts = np.stack([np.bincount(values[:, b], minlength=65536) for b in range(4)]).astype(float)
    plan = sd.Plan(bits, counts)
    one = plan.expected(values[:20], (0,))
    for i in range(20):
        apart = np.array([bin(x).count("1") for x in (values[:, 0] ^ values[i, 0]).tolist()])
        assert np.allclose(one[i] * len(prints), [(apart == e).sum() for e in range(3)])
    for layout in sd.LAYOUTS:
        thresholds, cost = plan.allocate(values[:50], layout)
        assert (thresholds.sum(axis=1) == 2 - len(layout) + 1).all() and thresholds.min() >= -1
        one = [np.cumsum(plan.expected(values[:50], p), axis=1) * len(prints) for p in layout]
        ball = [np.cumsum([len(sd.masks(16 * len(p), e)) for e in range(3)]) for p in layout]
        price = lambda i, row, t: 0 if t < 0 else sd.PROBE_COST * ball[i][t] + one[i][row, t]
        ways = [()]
        for _ in layout:
            ways = [(*w, t) for w in ways for t in range(-1, 3)]
        ways = [w for w in ways if sum(w) == 3 - len(layout)]
        for row in range(50):
            best = min(sum(price(i, row, t) for i, t in enumerate(w)) for w in ways)
            assert np.isclose(best, cost[row])
            assert np.isclose(best, sum(price(i, row, t) for i, t in enumerate(thresholds[row])))


def test_bits_are_grouped():
    r = np.random.default_rng(2)
    bits = r.integers(0, 2, (4000, 64))
    for a, b in [(3, 60), (5, 40), (17, 33)]:
        bits[:, b] = bits[:, a]
    blocks = sd.grouped_bits(4000, bits.T @ bits)
    assert sorted(blocks.ravel().tolist()) == list(range(64))
    for a, b in [(3, 60), (5, 40), (17, 33)]:
        assert any({a, b} <= set(block) for block in blocks.tolist())


@pytest.mark.parametrize("hot", [1e-4, 0.2])
def test_odd_rows(spark, odd, hot):
    rows = odd.collect()
    prints = plain_prints(spark, [r.text for r in rows])
    want = sorted((repr(r.doc_id), f"{p:016x}", c) for r, p, c in
                  zip(rows, prints, plain_components(prints, [r.doc_id for r in rows]), strict=True))
    got = sd.near_duplicates(odd, hot_share=hot).collect()
    assert sorted((repr(r.doc_id), r.fingerprint, r.component_id) for r in got) == want


def test_empty(spark, bare):
    assert sd.near_duplicates(bare).count() == 0


def test_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    prints = plain_prints(spark, [r.text for r in rows])
    comps = plain_components(prints, [r.doc_id for r in rows])
    df = QUERIES["op11_simhash_dedup"](spark, FOLDER)
    assert df.dtypes == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    assert {tuple(r) for r in df.collect()} == {(r.doc_id, f"{p:016x}", c) for r, p, c in zip(rows, prints, comps, strict=True)}


def test_large_group(spark):
    """5,000 equal rows and a star of 2,000 near fingerprints keep one component each."""
    r = random.Random(3)
    text = " ".join(r.choice("abcdefgh") + str(r.randrange(50)) for _ in range(60))
    rows = [(i, text) for i in range(5000)] + [(5000 + i, f"{text} {i % 7} {i}") for i in range(300)]
    got = {x.doc_id: x for x in sd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = [int(got[k].fingerprint, 16) for k, _ in rows]
    few = sorted(set(prints))
    least = {p: min(k for (k, _), q in zip(rows, prints, strict=True) if q == p) for p in few}
    comps = dict(zip(few, plain_components(few, [least[p] for p in few]), strict=True))
    assert all(got[k].component_id == comps[p] for (k, _), p in zip(rows, prints, strict=True))
