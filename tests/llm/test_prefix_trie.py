"""The prefix trie against a plain version."""

import hashlib
import random
import re
import zlib

import pytest

from needmatch.llm import prefix_trie as pt

DDL = "conv_id long, turn int, role string, text string, path string, node int, kind string, n long"


def plain_families(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            said = (role or "", text or "")
            digest = hashlib.sha256(f"{len(said[0])}:{said[0]}{said[1]}".encode()).digest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest[:16], *said))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + ts[h:]
    return out


def plain_trie(convs):
    members = {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []
    saved = {p: (len(cs) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0 for p, cs in members.items()}
    leaves = {p: int(p not in kids) for p in members}
    for p in sorted(members, key=len, reverse=True):
        if p:
            saved[p[:-1]] += saved[p]
            leaves[p[:-1]] += leaves[p]
    for p, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(convs[c]) == len(p))))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids.get(p, [])), leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "x", 1, "k", 2) for r in rows], DDL).repartition(3)
    got = pt.prefix_trie(pt.with_family_heads(pt.turn_lists(frame)), **options)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted([tuple(r) for r in got.collect()], key=repr) == plain_trie(plain_families(rows))


def talks(seed, n, deep=6, choices=3):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randrange(1, deep)):
            text = " ".join(["hello"] * r.randrange(choices)) + r.choice(["", " \t", "\n x"])
            rows.append((c, t, r.choice(["user", "user", None]), text))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("shards", "most"), [(1, 1000), (13, 1000), (60, 1000), (13, 4), (13, 1)])
def test_trie(spark, shards, most):
    odd = [(None, 1, "user", "lost"), (500, None, None, None), (500, None, None, None), (500, 3, "user", "x y"), (611, 0, "user", "own"),
           (2 ** 60, 5, "user", "far"), (502, -1, "a", "b:c"), (503, -1, "ab", ":c")]
    check(spark, talks(1, 150) + odd + [(700, 1, "user", "again")] * 50, shards=shards, max_skeleton=most)


def test_copies_and_long_paths(spark):
    """A third of all conversations are one path of 40 turns; one conversation has 3,000 turns, one turn 50,000 words."""
    r = random.Random(2)
    rows = [(20 * c, t, "user", f"w {t}") for c in range(120) for t in range(40)]
    rows += [(20 * c, t, "user", f"w {t}" if t < 39 else str(c % 7)) for c in range(120, 240) for t in range(40)]
    rows += [(5001, t, "user", r.choice("ab")) for t in range(3000)] + [(5003, 0, "user", "z " * 50000)] + talks(3, 120)
    check(spark, rows, shards=16)


def test_empty(spark):
    check(spark, [])
    check(spark, [(None, 1, "user", "x")])


def test_no_shared_turn(spark):
    check(spark, [(c, 1, "user", str(c)) for c in range(100)], shards=5)


def test_separators_cut_anywhere():
    """Splitters need not come from the rows: nodes of two shards are in the skeleton."""
    r = random.Random(5)
    paths = sorted((b"".join(bytes([r.randrange(3)]) * 16 for _ in range(r.randrange(6))), i) for i in range(400))
    sample = [(p, i, len(p) // 16 + 1) for p, i in paths if i % 5 == 0]
    cuts, trie = pt.skeleton(pt.separators(sample, 12), 10_000)
    assert 5 < len(cuts.keys) < 12
    shards = [cuts.shard(p, i) for p, i in paths]
    assert shards == sorted(shards) and len(set(shards)) == len(cuts.keys) + 1
    assert max(shards.count(s) for s in set(shards)) < 100
    held = {}
    for (p, _), s in zip(paths, shards, strict=True):
        for d in range(len(p) // 16 + 1):
            held.setdefault(p[:16 * d], set()).add(s)
    for p, where in held.items():
        node = 0
        for at in range(0, len(p), 16):
            node = trie.children[node].get(p[at:at + 16]) if node is not None else None
        assert node is not None or len(where) == 1
