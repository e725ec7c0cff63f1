"""Vector codes against a plain version in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from needmatch.llm import vector_codes as vc

NAN, INF = float("nan"), float("inf")
DDL = "vec_id long, embedding array<double>, label int, code string, n int"


def plain(rows, parts=16, entries=64, rounds=2):
    """rows: (key, vector, label); key -> (code, error, label_error), and the sha256."""
    kept = [(k, [math.floor(256 * x) if abs(x) < 2.0 ** 53 else 256 * int(x) for x in v], label) for k, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    d = len(kept[0][1]) // parts
    cut = [[v[p * d:(p + 1) * d] for p in range(parts)] for _, v, _ in kept]
    smallest = {}
    for (k, v, _), c in zip(kept, cut, strict=True):
        smallest[k is None, k or 0] = min(smallest.get((k is None, k or 0), (v, c)), (v, c))
    books = [[smallest[k][1][p] for k in sorted(smallest)[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p]))
                 for p, x in enumerate(row)] for row in cut]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [row[p] for row, f in zip(cut, found, strict=True) if f[p][1] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assign()
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    fits = lambda x: x if x < 1 << 63 else None
    out = sorted((repr(k), "".join(f"{e:02x}" for _, e in f), fits(err), fits(by_label[label]))
                 for (k, _, label), f, err in zip(kept, found, errors, strict=True))
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return out, digest


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], DDL).repartition(3)


def check(spark, rows, **options):
    got = vc.encode(frame(spark, rows), **options).collect()
    want, digest = plain([r for r in rows if r[1] is None or len(r[1]) == 32])
    assert sorted((repr(r.vec_id), r.code, r.error, r.label_error) for r in got) == want
    assert {r.codebooks_sha256 for r in got} == {digest}


@pytest.mark.parametrize("limit", [100, 0])
def test_codes(spark, limit):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist(), [None, 1, 2][i % 3]) for i, v in enumerate(rng.normal(size=(150, 32)))]
    rows += [(200, None, 1), (201, [NAN] * 32, 1), (202, [1.0] * 31 + [None], 2), (203, [-INF] + [0.0] * 31, 1), (204, [], 1),
             (205, [1.0] * 7, 1), (206, [1.0] * 16, 1), (None, [0.25] * 32, None), (3, [0.5] * 32, 1)]
    rows += [rows[7]] * 40
    check(spark, rows, max_broadcast_labels=limit)


def test_large_components(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1, 1]) * 10.0 ** rng.randrange(-3, 40) for _ in range(32)], i % 2) for i in range(70)]
    rows += [(100 + i, [rng.uniform(-1, 1) for _ in range(32)], 3) for i in range(30)]
    check(spark, rows)


def test_few_and_none(spark):
    check(spark, [(5, [0.1] * 32, 1), (4, [0.1] * 32, 1), (9, [-0.3] * 32, None)])
    assert vc.encode(frame(spark, [])).count() == 0
    assert vc.encode(frame(spark, [(1, None, 1)])).count() == 0


@pytest.mark.parametrize("bits", [8, 24, 27, 45, 61, 90])
def test_products(bits):
    rng = random.Random(bits)
    one = lambda n: np.array([[rng.randrange(-2 ** bits, 2 ** bits) for _ in range(6)] for _ in range(n)], object)
    x, c = one(40), one(7)
    kind = np.int64 if bits < 62 else object
    assert (vc.exact_products(x.astype(kind), c.astype(kind), object) == x @ c.T).all()


def test_limbs():
    x = np.array([0, -1, 1, 2 ** 25, -2 ** 25, 2 ** 50 + 3, -2 ** 50 - 3])
    assert vc.limb_width(4) == 25
    assert (sum(limb.astype(np.int64) << 25 * i for i, limb in enumerate(vc.limbs(x, 25))) == x).all()
