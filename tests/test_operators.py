"""Pinned cases of single operators."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from needmatch import constants as C
from needmatch.operators import (
    access as ac, context as cx, eventlog as ev, ingest as ing, metrics as mt, nodes as nd, retention as rt,
    search as se, subscribe as sub, tenancy as tn, webhooks as wh,
)
from needmatch.sources.tables import read_table

now = lambda: F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")



def make_log(spark, n, project="p"):
    return spark.range(1, n + 1).select(
        F.col("id"), F.lit(project).alias("project_id"), F.lit("t").alias("tenant_id"), F.lit("k").alias("data_key"),
        F.concat(F.lit("event_"), "id").alias("event_type"), F.concat(F.lit('{"data": '), "id", F.lit("}")).alias("data"),
        F.col("id").alias("sequence"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id as int))").alias("created_at"))


def test_trim_keeps_the_newest(spark):
    kept = rt.trim_to_count(make_log(spark, 25), 10)
    assert sorted(r["sequence"] for r in kept.collect()) == list(range(16, 26))


def test_projects_do_not_mix(spark):
    log = make_log(spark, 5, "a").unionByName(make_log(spark, 7, "b"))
    assert {r["project_id"]: r["length"] for r in ev.stream_length(log).collect()} == {"a": 5, "b": 7}


def test_append_continues_and_renumbers(spark):
    log = make_log(spark, 5)
    assert sorted(r["sequence"] for r in ev.append_events(log, log).collect()) == [6, 7, 8, 9, 10]
    assert sorted(r["sequence"] for r in ev.append_events(log, log, renumber=True).collect()) == [1, 2, 3, 4, 5]


def test_since_cursor_text(spark):
    df = spark.createDataFrame([("17",), ("12-0",), ("abc",), (None,)], "s string").select(ev.parse_since("s").alias("n"))
    assert [r["n"] for r in df.collect()] == [17, 0, 0, 0]


def test_import_refuses_or_overwrites(spark):
    log, bundle = make_log(spark, 5), make_log(spark, 3)
    none = spark.createDataFrame([], "project_id string")
    new, refused = ing.import_events(bundle, log, none)
    assert new.count() == 0 and [r["project_id"] for r in refused.collect()] == ["p"]
    new, refused = ing.import_events(bundle, log, bundle.select("project_id").distinct())
    assert sorted(r["sequence"] for r in new.collect()) == [1, 2, 3] and refused.count() == 0


def test_agents_never_seen_are_kept(spark):
    agents = spark.sql("SELECT 'a' AS agent_id, CAST(NULL AS DATE) AS last_seen UNION ALL SELECT 'b', DATE '2024-01-01' UNION ALL SELECT 'c', DATE '2024-01-30'")
    assert sorted(r["agent_id"] for r in rt.expire_agents(agents, now()).collect()) == ["a", "c"]


def test_limiter_remaining_then_block(spark):
    df = spark.sql("SELECT 'u' AS k, id AS i, timestamp_seconds(id) AS ts FROM range(7) UNION ALL SELECT 'v', 100 + id, timestamp_seconds(id) FROM range(1)")
    out = {r["request_id"]: r for r in ac.rate_limit(df, "k", "i", "ts", 5).collect()}
    assert [out[i]["remaining"] for i in range(5)] == [4, 3, 2, 1, 0]
    assert not out[5]["allowed"] and out[5]["retry_after"] == 60 and out[100]["allowed"]


def test_endpoint_normalization(spark):
    paths = {"/api/v1/projects/12345/data": "/api/v1/projects/{id}/data", "/api/agents/agent-123": "/api/agents/{id}",
             "/x/123e4567-e89b-12d3-a456-426614174000": "/x/{id}", "/api/v1/health": "/api/v1/health", "/": "/"}
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", mt.normalize_endpoint("p").alias("n"))
    assert {r["p"]: r["n"] for r in df.collect()} == paths


def test_flatten_object_array(spark):
    df = spark.createDataFrame([(1, '{"items":[{"id":1,"name":"a"}],"a":{"b":{"c":"x"}},"e":{},"n":null}')], "d bigint, j string")
    got = {r["path"]: r["value"] for r in ing.flatten_json(df, "d", "j").collect()}
    assert got == {"items[*]": "array", "a.b.c": "x", "e": "{}", "n": None}


def test_deep_documents_are_walked_whole(spark):
    deep = '{"a":' * 40 + '{"x":1}' + "}" * 40
    df = spark.createDataFrame([(1, deep), (2, None), (3, "{"), (4, ""), (5, "NaN"), (6, "1e999")], "d bigint, j string")
    assert [(r["path"], r["value"]) for r in ing.flatten_json(df, "d", "j").collect()] == [(".".join("a" * 40 + "x"), "1")]
    assert [(r["path"], r["content"]) for r in nd.json_nodes(df, "d", "j").collect()] == [(".".join("a" * 40), '{"x":1}')]


def test_document_order_repeated_keys_and_escaped_paths(spark):
    df = spark.createDataFrame([(1, '{"z\\"]":{"b":1,"a":2,"b":3},"c":{"s":"\\ud800é"}}')], "d bigint, j string")
    nodes = nd.json_nodes(df, "d", "j")
    assert [(r["path"], r["content"]) for r in nodes.collect()] == [('z"]', '{"b":3,"a":2}'), ("c", '{"s":"?é"}')]
    back = nd.explode_json(nd.reassemble_json(nodes, "d"), "d").collect()
    assert [(r["path"], r["content"]) for r in back] == [('z"]', '{"b":3,"a":2}'), ("c", '{"s":"?é"}')]


def test_json_nodes_cases(spark):
    docs = {1: '{"a": 1, "b": [1, 2]}', 2: '{"t": {"people": [{"n": "x"}, {"n": "y"}]}, "drop": 1}', 3: '[1, {"k": 2}]', 4: '5',
            5: '{"a": {}, "z": 1}'}
    df = spark.createDataFrame(list(docs.items()), "d bigint, j string")
    got = {}
    for r in nd.json_nodes(df, "d", "j").collect():
        got.setdefault(r["d"], {})[r["path"]] = (r["node_type"], r["content"])
    assert got[1] == {"root": ("object", '{"a":1,"b":[1,2]}')}
    assert got[2] == {"t.people[0]": ("object", '{"n":"x"}'), "t.people[1]": ("object", '{"n":"y"}')}
    assert got[3] == {"[0]": ("primitive", "1"), "[1]": ("object", '{"k":2}')}
    assert got[4] == {"value": ("primitive", "5")}
    assert got[5] == {"a": ("object", "{}")}


def test_text_nodes_split_sentences_or_paragraphs(spark):
    df = spark.createDataFrame([(1, "One. Two! Three"), (2, "A b.\n\nC d. E")], "d bigint, t string")
    got = [(r["d"], r["path"], r["content"]) for r in nd.text_nodes(df, "d", "t").orderBy("d", "ord").collect()]
    assert got == [(1, "sentence_0", "One"), (1, "sentence_1", "Two"), (1, "sentence_2", "Three"),
                   (2, "paragraph_0", "A b."), (2, "paragraph_1", "C d. E")]


def test_markdown_nodes_carry_heading(spark):
    df = spark.createDataFrame([(1, "intro\n\n# A\n\np1\n\n```py\nx\n```\n\n## B\np2")], "d bigint, t string")
    got = [(r["path"], r["content"], r["heading"]) for r in nd.markdown_nodes(df, "d", "t").orderBy("ord").collect()]
    assert got == [("paragraph_0", "intro", None), ("heading_0", "A", "A"), ("code_block_2", "x", "A"),
                   ("paragraph_3", "p1", "A"), ("heading_1", "B", "B"), ("paragraph_5", "p2", "B")]


@pytest.mark.parametrize("payload,hint,expected", [
    ('{"a": 1}', None, "json"), ('[1]', None, "text"), ("a: 1\nb: 2", None, "yaml"), ('[x]\na = 1', None, "toml"),
    ("<a><b>1</b></a>", None, "xml"), ("a,b\n1,2\n3,4", None, "csv"), ("a\tb\n1\t2", None, "csv"), ("# T\n\nwords", None, "markdown"),
    ("def f(x):\n    return x", None, "code"), ("plain words here", None, "text"), ("plain words", "csv", "csv"), ('{"a": 1}', "csv", "json"),
])
def test_detection(spark, payload, hint, expected):
    df = spark.createDataFrame([(payload, hint)], "p string, h string")
    assert ing.detect_format(df, "p", "h").first()["format"] == expected


def test_a_format_can_be_plugged_in(spark):
    rule = ing.FormatRule("ini", 1, lambda c, h: c.startswith("[["))
    df = spark.createDataFrame([("[[x]]",), ("words",)], "p string")
    assert [r["format"] for r in ing.detect_format(df, "p", formats=[*ing.DEFAULT_FORMATS, rule]).collect()] == ["ini", "text"]


def test_node_routes(spark):
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, "a,b\n1,2"), (3, "# T\nx"), (4, "Hello there. You"), (5, "k: v")], "d bigint, p string")
    nodes, dead = nd.to_nodes(df, "d", "p")
    assert {r["d"]: r["format"] for r in nodes.select("d", "format").distinct().collect()} == {1: "json", 2: "csv", 3: "markdown", 4: "text"}
    assert [r["d"] for r in dead.collect()] == [5]


def test_quoted_csv(spark):
    text = 'name,note,n\r\nann,"one, two",1\r\n\r\n"bob ""b""","first\n\nlast",2\r\ncid,5" pipe,3\ndan,too,many,4\neve,"open,5\n'
    rows = ing.csv_records(spark.createDataFrame([(1, text), (2, None)], "d bigint, t string"), "d", "t").collect()
    got = {}
    for r in rows:
        got.setdefault(r["row_no"], {})[r["column"]] = r["value"]
    assert [tuple(got[i].values()) for i in sorted(got)] == [
        ("ann", "one, two", "1"), ('bob "b"', "first\n\nlast", "2"), ("cid", '5" pipe', "3"), ("eve", '"open', "5")]
    assert {r["int_value"] for r in rows if r["column"] == "n"} == {1, 2, 3, 5}


def test_csv_inference(spark):
    text = "id,score,flag,word\n1,1.5,yes,x\n2,,no,\nragged\n3,2,true,z"
    rows = ing.csv_records(spark.createDataFrame([(1, text)], "d bigint, t string"), "d", "t").collect()
    types = {r["column"]: r["type"] for r in rows}
    assert types == {"id": "int", "score": "float", "flag": "bool", "word": "string"}
    assert [r["int_value"] for r in sorted(rows, key=lambda r: r["row_no"]) if r["column"] == "id"] == [1, 2, 3]


def matches(spark, rows):
    return spark.createDataFrame([("a", n, r, f"m{n}{r}", s, t) for n, r, s, t in rows],
                                 "agent string, need_no int, rank int, node string, similarity double, tokens bigint")


def test_budget_keeps_best_per_need_then_fills(spark):
    rows = [(0, 1, .9, 50), (0, 2, .8, 30), (1, 1, .5, 40), (1, 2, .45, 20), (2, 1, .3, 200), (0, 3, .2, 5)]
    kept = {r["node"] for r in cx.fit_budget(matches(spark, rows), ["agent"], 116).collect()}
    assert kept == {"m01", "m11", "m12", "m03"}           # m02 and m21 do not fit and are skipped
    assert cx.fit_budget(matches(spark, rows), ["agent"], 345).count() == 6


def test_breaker_opens_probes_and_closes():
    b = wh.Breaker(failures=3, successes=2, timeout_us=10)
    states = [b.offer(t, ok)[3] for t, ok in [(0, False), (1, False), (2, False), (5, True), (12, True), (13, True)]]
    assert states == ["closed", "closed", "open", "open", "half_open", "closed"]
    b = wh.Breaker(failures=1, successes=2, timeout_us=10)
    assert [b.offer(t, ok) for t, ok in [(0, False), (10, False), (11, True)]] == [
        ("closed", True, False, "open"), ("open", True, True, "open"), ("open", False, False, "open")]


@pytest.mark.parametrize("secret", ["my-secret-key", "k" * 64, "long " * 30, "schlüssel"])
def test_hmac_matches_the_standard(spark, secret):
    df = wh.with_pads(spark.createDataFrame([(secret, '{"test": "data"}')], "secret string, m string"))
    assert df.select(wh.hmac_sha256("m")).first()[0] == hmac.new(secret.encode(), b'{"test": "data"}', hashlib.sha256).hexdigest()


def test_routing_with_lists(spark):
    ends = spark.createDataFrame([("all", True, None, [], [], []), ("two", True, "t1", ["x", "y"], [], ["p1", "p2"]),
                                  ("off", False, None, [], [], []), ("cat", True, None, [], ["c2"], [])],
                                 "endpoint_id string, is_active boolean, tenant_id string, events array<string>, categories array<string>, project_ids array<string>")
    evs = spark.createDataFrame([(1, "t1", "x", "c1", "p1"), (2, "t2", "x", "c2", "p1"), (3, "t1", "z", "c1", "p2")],
                                "event_id int, tenant_id string, event_type string, category string, project_id string")
    got = sorted((r["event_id"], r["endpoint_id"]) for r in wh.route(evs, ends).collect())
    assert got == [(1, "all"), (1, "two"), (2, "all"), (2, "cat"), (3, "all")]


def test_quota_messages(spark):
    tenants = tn.quotas(spark.createDataFrame([("a", "free", True), ("b", "odd", False)], "tenant_id string, plan string, is_active boolean"))
    usage = spark.createDataFrame([("a", 1, 0, 0, 999, 0.5)], "tenant_id string, projects_count bigint, agents_count bigint, api_keys_count bigint, events_this_month bigint, storage_used_mb double")
    reqs = spark.createDataFrame([("a", "projects", 1), ("a", "events", 1), ("a", "events", 2), ("b", "events", 1), ("c", "events", 1), ("a", "moons", 9)],
                                 "tenant_id string, resource string, amount bigint")
    got = {(r["tenant_id"], r["resource"], r["amount"]): (r["allowed"], r["message"]) for r in tn.check_quota(reqs, tenants, usage).collect()}
    assert got[("a", "projects", 1)] == (False, "Quota exceeded: projects (2/1)")
    assert got[("a", "events", 1)] == (True, "OK") and got[("a", "events", 2)][0] is False
    assert got[("b", "events", 1)][1] == "Tenant 'b' is inactive" and got[("c", "events", 1)][1] == "Tenant 'c' not found"
    assert got[("a", "moons", 9)] == (True, "Unknown resource")


def test_roles(spark):
    for role, allowed in C.ROLE_PERMISSIONS.items():
        df = spark.createDataFrame([(p,) for p in C.ROLE_PERMISSIONS["admin"]], "p string").select(
            "p", ac.role_allows(F.lit(role), "p").alias("ok"))
        assert {r["p"] for r in df.collect() if r["ok"]} == set(allowed)


def test_quantile_of_infinite_bucket_is_last_bound(spark):
    df = spark.createDataFrame([("a", 100.0)] * 3 + [("b", 0.75)] * 2, "k string, v double")
    got = {r["k"]: r["quantile"] for r in mt.histogram_quantile(mt.histogram(df, "v", ["k"]), ["k"], 0.5).collect()}
    assert got == {"a": 5.0, "b": 0.75}


def test_counter_reset(spark):
    df = spark.sql("SELECT 's' AS k, id, timestamp_seconds(id) AS ts, CAST(CASE id WHEN 0 THEN 5 WHEN 1 THEN 8 WHEN 2 THEN 2 ELSE 3 END AS BIGINT) AS v FROM range(4)")
    assert mt.increase(df, ["k"], "v", "ts", "id", "5 minutes", 300).first()["increase"] == 3 + 2 + 1


def test_ann_recall(spark):
    e = read_table(spark, "/root/testdata/sf0.001", "embeddings").withColumn("g", F.lit("all"))
    q = e.select("g", F.col("vec_id").alias("q"), "embedding").filter("q < 60")
    exact = se.vector_topk(q, e, ["g"], "q", "vec_id", 10, -1.0).select("q", "vec_id")
    near = se.vector_topk_ann(q, e, ["g"], "q", "vec_id", 10, cells=8, probes=6).select("q", "vec_id")
    assert near.intersect(exact).count() / exact.count() >= 0.9


def test_ann_with_all_cells_is_exact(spark):
    e = read_table(spark, "/root/testdata/sf0.001", "embeddings").withColumn("g", F.lit("all"))
    q = e.select("g", F.col("vec_id").alias("q"), "embedding").filter("q < 20")
    exact = se.vector_topk(q, e, ["g"], "q", "vec_id", 5, -1.0).select("q", "vec_id", "rank")
    near = se.vector_topk_ann(q, e, ["g"], "q", "vec_id", 5, cells=6, probes=6).select("q", "vec_id", "rank")
    assert near.exceptAll(exact).count() == 0 and near.count() == exact.count()


def test_notifications_use_own_channels_and_skip_rejected_agents(spark):
    agents = spark.createDataFrame([("a", "redis", None, "team"), ("b", "redis", None, ""), ("c", "webhook", None, "x"),
                                    ("d", "webhook", "http://h", "x")],
                                   "agent_id string, notification_method string, webhook_url string, notification_channel string")
    keys = agents.selectExpr("'p' AS project_id", "'k' AS data_key", "agent_id")
    changes = spark.sql("SELECT 'p' AS project_id, 'k' AS data_key, 1L AS sequence, '{}' AS data")
    got = {r["agent_id"]: r["target"] for r in sub.notifications(changes, keys, agents).collect()}
    assert got == {"a": "team", "b": "agent:b:updates", "d": "http://h"}


def test_request_series_from_panes(spark):
    """Panes that add up give what each evaluation time's own rows give; a row on the edge belongs to the pane it ends."""
    import random
    rng = random.Random(11)
    rows = [(i, rng.choice([0.0, 30.0, 30.000001, 299.5, rng.random() * 2000]), rng.choice([None, 0.003, 0.2, 0.9, 4.0, 99.0]), rng.random() < 0.3)
            for i in range(200)]
    df = spark.createDataFrame(rows, "id long, at double, v double, bad boolean").withColumn("at", F.timestamp_micros((F.col("at") * 1e6).cast("long")))
    got = {(r.series, r.grid): r.value for r in mt.request_series(
        df, "at", {"share": F.col("bad")}, {"rate": F.col("id")}, {"p95": (F.col("v"), F.col("bad"), C.HISTOGRAM_BOUNDS)}).collect()}
    want = {}
    for grid in range(0, 2400, 30):
        inside = [r for r in rows if grid - 300 < r[1] <= grid]
        if not inside:
            continue
        want["share", grid] = sum(r[3] for r in inside) / len(inside)
        want["rate", grid] = sum(r[0] for r in inside) / 300.0
        values = [r[2] for r in inside if r[3] and r[2] is not None]
        if values:
            low, below, rank = 0.0, 0, 0.95 * len(values)
            for bound in C.HISTOGRAM_BOUNDS:
                bucket = sum(v <= bound for v in values)
                if bucket >= rank:
                    low += (bound - low) * (rank - below) / (bucket - below)
                    break
                low, below = bound, bucket
            want["p95", grid] = low
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_gauge_series(spark):
    rows = [("up", "a", 10, 1, 1.0), ("up", "b", 10, 2, 0.0), ("up", "a", 10, 3, 5.0), ("up", "b", 40, 4, 3.0), ("agents", "x", 1, 5, 2.0), ("agents", "y", 301, 6, 4.0)]
    df = spark.createDataFrame(rows, "series string, label string, at long, id long, value double").withColumn("at", F.timestamp_seconds("at"))
    got = {(r.series, r.grid): r.value for r in mt.gauge_series(df, "at", "id", {"up": "min", "agents": "sum"}).collect()}
    assert got["up", 30] == 0.0 and got["up", 60] == 3.0 and got["up", 300] == 3.0 and got["up", 330] == 3.0 and ("up", 360) not in got
    assert got["agents", 30] == got["agents", 300] == 2.0 and got["agents", 330] == got["agents", 600] == 4.0


def test_every_alert_rule_fires(spark):
    from needmatch.checks import registry
    registry.load_all()
    fired = registry.QUERIES["m11_alerts"](spark, "/root/testdata/sf0.01").select("alert").distinct().collect()
    assert {r["alert"] for r in fired} == set(C.ALERT_RULES)


def test_envelope_carries_data(spark):
    import json
    matches = spark.createDataFrame([("a", "n2", 2, 7, 0.5), ("a", "n2", 1, 8, 0.9), ("a", "n1", 1, 7, 0.4)],
                                    "agent_id string, need string, rank int, vec_id long, similarity double")
    data = spark.createDataFrame([(7, "k", '{"x": [1, "\\u00e9"]}', None)], "vec_id long, data_key string, j string, description string")
    rows = cx.context_envelope(cx.with_data(matches, data.withColumn("data", F.parse_json("j")))).collect()
    assert len(rows) == 1 and json.loads(rows[0].payload) == {
        "type": "initial_context", "agent_id": "a", "format": "json", "context": {
            "n1": [{"data_key": "k", "similarity": 0.4, "data": {"x": [1, "é"]}, "description": None}],
            "n2": [{"data_key": None, "similarity": 0.9, "data": None, "description": None},
                   {"data_key": "k", "similarity": 0.5, "data": {"x": [1, "é"]}, "description": None}]}}


def test_outbox_message(spark):
    import json
    events = spark.sql("""SELECT 7 AS event_id, timestamp_ntz'2024-01-02 03:04:05.5' AS ts, 'p' AS project_id, 't' AS tenant_id, '{"b": 1, "a": null}' AS props,
                          'data.updated' AS event_type, 'data' AS category""")
    ends = spark.sql("SELECT 'e' AS endpoint_id, true AS is_active, string(null) AS tenant_id, 'key' AS secret, array() AS events, array() AS categories, array() AS project_ids")
    ends = ends.select("endpoint_id", "is_active", "tenant_id", "secret", *[F.col(c).cast("array<string>").alias(c) for c in ("events", "categories", "project_ids")])
    row, again = wh.outbox(events, ends).first(), wh.outbox(events, ends, attempt=2).first()
    assert json.loads(row.payload) == {"data": {"b": 1, "a": None}, "event_id": 7, "event_type": "data.updated", "project_id": "p",
                                       "tenant_id": "t", "timestamp": "2024-01-02T03:04:05.500000Z"}
    signed = hmac.new(b"key", row.payload.encode(), hashlib.sha256).hexdigest()
    assert json.loads(row.headers) == {"Content-Type": "application/json", "X-Webhook-Event": "data.updated", "X-Webhook-Signature": f"sha256={signed}",
                                       "X-Webhook-Timestamp": "2024-01-02T03:04:05.500000Z", "X-Webhook-Delivery-ID": row.delivery_id}
    assert len(row.delivery_id) == 36 and row.delivery_id != again.delivery_id and again.payload == row.payload


def test_count_since_is_the_length_of_the_page(spark):
    log = make_log(spark, 30, "a").unionByName(make_log(spark, 7, "b"))
    cursors = spark.createDataFrame([("a", "x", "12-0"), ("a", "y", "25"), ("a", "z", "30"), ("b", "v", "5"), ("c", "w", "0")],
                                    "project_id string, agent_id string, since string")
    pages = {r["agent_id"]: r["n"] for r in ev.events_since(log, cursors, "agent_id", "since", 10).groupBy("agent_id").agg(F.count("*").alias("n")).collect()}
    got = ev.count_since(log, cursors, "agent_id", "since", 10)
    assert {r["agent_id"]: r["n"] for r in got.collect() if r["n"]} == pages == {"x": 10, "y": 5, "v": 2}


def test_envelope_shuffles_data_once(spark):
    m = spark.sql("SELECT concat('a', id % 3) AS agent_id, concat('a', id % 3, '#', id % 2) AS need, id DIV 6 AS rank, "
                  "concat('k', id) AS data_key, 0.5 AS similarity, 'x' AS data, 'd' AS description FROM range(24)").repartition(3)
    plan = cx.context_envelope(m)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_index_of_asked_terms_and_stats_without_an_index(spark):
    docs = spark.createDataFrame([(1, "a b a", "x"), (2, "", ""), (3, None, "x y"), (4, "c", None)], "doc_id long, content string, metadata string")
    whole = se.bm25_index(docs, "doc_id", ["content", "metadata"])
    some = se.bm25_index(docs, "doc_id", ["content", "metadata"], spark.createDataFrame([("a",), ("a",), ("y",), ("q",)], "term string"))
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, whole.where("term IN ('a', 'y')").collect()))
    stats = se.field_stats(docs, ["content", "metadata"])
    assert sorted(map(tuple, stats.collect())) == sorted(map(tuple, se.bm25_stats(whole, docs).collect()))
    assert "Exchange hashpartitioning" not in stats._jdf.queryExecution().executedPlan().toString()
