"""Vector search and url rules, against brute force and on odd rows."""

import random

import numpy as np
import pytest

from needmatch.llm import url_filters, vector_search

NAN, INF = float("nan"), float("inf")


def test_search(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[50] = x[0]
    x[51] = 2 * x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(900, None), (901, [0.0] * 16), (902, [NAN] * 16), (903, [INF] * 16), (904, [1.0]), (905, [None] + [1.0] * 15),
           (None, x[0].tolist()), (0, x[0].tolist())]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = vector_search.search(frame, frame.where("vec_id % 50 = 0"), 5, pivots=32, places=24, block_rows=200,
                               chunk_queries=7).collect()
    x = x.astype(float)
    hits = 0
    for q in range(0, 900, 50):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        exact = x @ x[q] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[q])
        exact[q] = -2
        assert all(abs(r.score - exact[r.vec_id]) < 1e-12 for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        hits += len({r.vec_id for r in own} & set(np.argsort(-exact, kind="stable")[:5].tolist()))
    assert hits >= 0.9 * 5 * 18


def test_search_small(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id int, embedding array<double>")
    got = vector_search.search(frame, frame.where("vec_id = 0"), 5).collect()
    assert [(r.vec_id, r["rank"]) for r in got] == [(2, 1), (1, 2)]
    assert vector_search.search(frame.where("false"), frame.where("false"), 5).count() == 0
    assert vector_search.search(frame, frame.where("false"), 5).count() == 0


URLS = [None, "", "no scheme", "http://", "https://Www.Example.com/en/1?x#y", "http://example.com/en", "http://a.example.com/en/",
        "http://a.net/es/q", "http://net/fr/", "ftp://x.net:80/fr/", "http://example.com", "http://example.com?q=/en/",
        "http://notexample.com/en/", "http://u@www.example.com/en/x", "http://a.net/es", "http://com/", "x://a.b/c://d.com/"]


@pytest.mark.parametrize("largest", [1000, 0])
def test_urls(spark, largest):
    rng = random.Random(1)
    hosts, paths = ["com", "a.com", "b.a.com", "net"], ["", "/", "/e", "/en/", "/en/x", "/fr"]
    rules = {(rng.choice(["allow", "block"]), h, p) for h in hosts for p in rng.sample(paths, 3)} | {("allow", "com", "/en/"), ("block", "com", "/en/")}
    urls = URLS + [f"http://{h}{p}{t}" for h in ["com", "a.com", "c.a.com", "x.b.a.com", "xa.com", "net", "org"]
                   for p in ["", "/", "/e/f", "/en/x/y", "/en", "/fr"] for t in ["", "?a/b", "#z"]]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    listed = spark.createDataFrame(sorted(rules), "verdict string, host string, path string")
    got = {r.page_id: r for r in url_filters.judge_urls(frame, listed, max_trie_rules=largest).collect()}
    for i, url in enumerate(urls):
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1].split("?")[0].split("#")[0]
            host, slash, path = rest.partition("/")
            host, path = host.lower(), slash + path
        fits = [(h.count("."), len(p), v, h + p) for v, h, p in rules
                if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits, default=(0, 0, "allow", None))
        assert (got[i].host, got[i].path, got[i].verdict, got[i].rule) == (host, path, want[2], want[3]), url


def test_urls_empty(spark):
    frame = spark.createDataFrame([], "page_id int, url string, host string")
    rules = spark.createDataFrame([("block", "com", "/")], "verdict string, host string, path string")
    assert url_filters.judge_urls(frame, rules).count() == 0
    one = spark.createDataFrame([(1, "http://a.com/", "x")], "page_id int, url string, host string")
    assert url_filters.judge_urls(one, rules.where("false")).first().verdict == "allow"
