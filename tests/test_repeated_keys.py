"""Repeated JSON keys and CSV columns: the last one counts, everywhere."""

import json

from needmatch.operators import ingest as ing, nodes as nd
from needmatch.session import prepare

TEXTS = [(1, '{"a": 1, "a": 2}'), (2, '{"b": {"x": 1, "x": [3, 4]}, "c": null}')]


def test_json(spark):
    df = prepare(spark).createDataFrame(TEXTS, "doc_id int, p string")
    assert {r.f for r in df.select(nd.node_format("p").alias("f")).collect()} == {"json"}
    done, dead = ing.normalize(df, "doc_id", "p")
    assert {r.doc_id: json.loads(r.norm_json) for r in done.collect()} == {i: json.loads(t) for i, t in TEXTS} and dead.count() == 0
    nodes, _ = nd.to_nodes(df, "doc_id", "p")
    first = [r.content for r in nodes.where("doc_id = 1").collect()]
    assert len(first) == 1 and "2" in first[0] and "1" not in first[0]


def test_csv(spark):
    text = 'n,v,n\n1,"a, b",x\n2,,"say ""y"""\n3\n'
    df = prepare(spark).createDataFrame([(1, text, "csv"), (2, "", "csv"), (3, None, "csv")], "doc_id int, p string, hint string")
    rows = nd.csv_nodes(df, "doc_id", "p").orderBy("ord").collect()
    assert [json.loads(r.content) for r in rows] == [{"n": "x", "v": "a, b"}, {"n": 'say "y"', "v": ""}, {"n": None, "v": None}]
    done = {r.doc_id: r for r in ing.normalize(df.where("doc_id = 1"), "doc_id", "p", "hint")[0].collect()}
    assert json.loads(done[1].norm_json) == {"records": [{"n": "x", "v": "a, b"}, {"n": 'say "y"', "v": None}],
                                             "schema": {"n": "string", "v": "string"}, "row_count": 2, "column_count": 3}
