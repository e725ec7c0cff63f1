"""The JSON walk makes no coder per document, encodes a document in one call and keeps its rows."""

import json

from needmatch.functions import json_walk as jw
from needmatch.operators import nodes as nd

ODD = [{"a": "\nNaN\n", "b": [1, 2]}, "x\ny", ",", None, True, 10 ** 30, 1.5, [], {}, {"é": ["NaN", None]}, "\ud800"]


def test_no_coder_is_made_per_document(monkeypatch):
    made = []
    for kind in (json.JSONEncoder, json.JSONDecoder):
        monkeypatch.setattr(kind, "__init__", lambda self, *a, **k: made.append(type(self)))
    rows = [tuple(r) for r in jw.node_rows(jw.parsed('{"a": {"x": 1, "y": [1.5, "z"]}, "b": [{"c": null}], "d": 2}')[0])]
    assert [r[1:] for r in rows] == [("a", '{"x":1,"y":[1.5,"z"]}', "object"), ("b[0]", '{"c":null}', "object")]
    assert [list(r[0]) for r in rows] == [[0], [1, 0]] and not made


def test_one_call_encodes_as_many_do():
    expected = [json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in ODD]
    assert [jw.compact(x) for x in ODD] == expected and jw.compact_all(ODD) == expected and jw.compact_all([]) == []


def test_levels_beyond_the_call_stack():
    root = jw.parsed('{"a":' * 1500 + "{}" + "}" * 1500)[0]
    ((ord_, path, content, kind),) = jw.node_rows(root)
    assert list(ord_) == [0] * 1500 and path == ".".join("a" * 1500) and (content, kind) == ("{}", "object")


def test_only_the_columns_asked_for(spark):
    df = spark.createDataFrame([(1, '{"a":{"x":"\\ud800"},"b":[{"y":2}]}'), (2, "[]"), (3, None)], "d bigint, j string")
    some = nd.json_nodes(df, "d", "j", ["path", "content"])
    assert some.columns == ["d", "path", "content"]
    assert [tuple(r) for r in some.collect()] == [(1, "a", '{"x":"?"}'), (1, "b[0]", '{"y":2}')]
    assert [r["ord"] for r in nd.json_nodes(df, "d", "j").collect()] == [[0], [1, 0]]


def test_node_text_without_words_or_body(spark):
    df = spark.createDataFrame([("[0]", "5", "primitive"), ("a[1].b", '{"k":null}', "object"), ("", None, "primitive"),
                                ("a", None, "primitive")], "p string, c string, t string")
    assert [r[0] for r in df.select(nd.node_text("p", "c", "t")).collect()] == ["5", "a b | k: None", None, "a"]
