"""Inputs of the registered queries, derived from the given tables.

Each is one SQL text that Spark SQL and DuckDB both run unchanged, without windows or joins, so
that reading a fixture stays a pure scan at any size.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import BASE_TABLES, read_table, spread

NOW = "2024-01-31 00:00:00"

FIXTURES = {
    # event log: 20 projects in 5 tenants, 15 data keys; sequence unique and increasing per project
    "fx_log": """
SELECT event_id AS id, concat('proj_', user_id % 20) AS project_id, concat('tenant_', (user_id % 20) % 5) AS tenant_id,
       concat(event_type, '_', event_id % 3) AS data_key, concat(event_type, '_', event_id % 3, '_updated') AS event_type,
       props AS data, event_id + 1 AS sequence, ts AS created_at
FROM events""",
    "fx_tenants": """
SELECT concat('tenant_', c_custkey) AS tenant_id, c_name AS name, c_custkey % 9 <> 4 AS is_active,
       CASE c_custkey % 6 WHEN 0 THEN 'free' WHEN 1 THEN 'starter' WHEN 2 THEN 'pro' WHEN 3 THEN 'enterprise'
            WHEN 4 THEN 'legacy' ELSE 'free' END AS plan,
       CASE WHEN c_custkey % 7 = 3 THEN CAST(250 AS BIGINT) END AS custom_max_events,
       DATE '2023-01-01' + CAST(c_custkey % 365 AS INT) AS created_on
FROM customer""",
    "fx_agents": """
SELECT concat('agent_', c_custkey) AS agent_id, concat('proj_', c_custkey % 20) AS project_id,
       concat('tenant_', (c_custkey % 20) % 5) AS tenant_id, c_custkey * 7 % 9000 AS last_sequence,
       CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE DATE '2024-01-31' - CAST(c_custkey % 14 AS INT) END AS last_seen,
       CASE WHEN c_custkey % 3 = 0 THEN 'webhook' ELSE 'redis' END AS notification_method,
       CASE WHEN c_custkey % 6 = 0 THEN concat('https://hooks.example.com/', c_custkey) END AS webhook_url,
       CASE WHEN c_custkey % 4 = 1 THEN concat('team_', c_custkey % 9) END AS notification_channel
FROM customer""",
    # keys tracked by each agent (three of the 15)
    "fx_agent_keys": " UNION ALL ".join(f"""
SELECT concat('agent_', c_custkey) AS agent_id, concat('proj_', c_custkey % 20) AS project_id,
       concat(CASE (c_custkey + {k}) % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup'
              ELSE 'error' END, '_{k}') AS data_key
FROM customer""" for k in range(3)),
    "fx_keys": """
SELECT concat('key_', s_suppkey) AS key_id, concat('ck_', s_suppkey) AS raw_key, concat('tenant_', s_suppkey % 5) AS tenant_id,
       CASE s_suppkey % 5 WHEN 0 THEN 'admin' WHEN 1 THEN 'publisher' WHEN 2 THEN 'consumer' WHEN 3 THEN 'readonly' END AS role,
       CASE WHEN s_suppkey % 4 = 0 THEN concat('proj_', s_suppkey % 20) END AS only_project
FROM supplier""",
    "fx_requests": """
SELECT event_id AS request_id, ts, value AS duration_ms, concat('proj_', user_id % 20) AS project_id,
       CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN 'bad' ELSE concat('ck_', user_id % 120) END AS raw_key,
       CASE WHEN event_type IN ('click', 'view') THEN 'GET' ELSE 'POST' END AS method,
       CASE event_type WHEN 'click' THEN concat('/api/projects/', user_id % 20, '/data')
            WHEN 'view' THEN concat('/api/projects/', user_id % 20, '/events') WHEN 'purchase' THEN '/api/publish'
            WHEN 'signup' THEN '/api/register' ELSE concat('/api/projects/', user_id % 20, '/query') END AS path,
       CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 13 = 0 THEN 404 ELSE 200 END AS status_code
FROM events""",
    "fx_accounts": """
SELECT concat('sa_', s_suppkey) AS account_id, concat('sak_', s_suppkey) AS raw_key, concat('sakey_', s_suppkey) AS key_id,
       s_suppkey % 7 <> 3 AS is_active, s_suppkey % 11 <> 5 AS key_listed,
       CASE WHEN s_suppkey % 3 = 0 THEN DATE '2024-01-15' + CAST(s_suppkey % 20 AS INT) END AS expires_on
FROM supplier""",
    "fx_sa_requests": """
SELECT event_id AS request_id, ts,
       CASE WHEN event_id % 50 = 0 THEN 'ck_1' ELSE concat('sak_', user_id % 130) END AS raw_key
FROM events""",
    "fx_audit": """
SELECT event_id, ts AS timestamp, concat('key_', user_id % 100) AS actor_id, concat('tenant_', (user_id % 20) % 5) AS tenant_id,
       CASE event_type WHEN 'click' THEN 'data.updated' WHEN 'view' THEN 'data.exported' WHEN 'purchase' THEN 'data.published'
            WHEN 'signup' THEN 'agent.registered' ELSE 'auth.login.failure' END AS event_type,
       CASE WHEN value < 50 THEN 'info' WHEN value < 100 THEN 'warning' WHEN value < 200 THEN 'error' ELSE 'critical' END AS severity,
       CASE WHEN event_type = 'error' THEN 'failure' WHEN event_id % 11 = 0 THEN 'partial' ELSE 'success' END AS result,
       CASE WHEN event_id % 9 = 0 THEN NULL ELSE concat('{"theme": "light", "limit": "', event_id % 4, '"}') END AS before_state,
       concat('{"theme": "', CASE WHEN event_id % 2 = 0 THEN 'dark' ELSE 'light' END, '", "limit": "', event_id % 5, '", "mode": "x"}') AS after_state
FROM events""",
    # webhook endpoints: NULL filter = no restriction
    "fx_endpoints": """
SELECT concat('ep_', s_suppkey) AS endpoint_id, s_suppkey % 6 <> 5 AS is_active, 3 AS max_retries,
       concat('secret-', s_suppkey) AS secret,
       CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE concat('tenant_', s_suppkey % 5) END AS tenant_id,
       CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE 'data.published' END AS only_event,
       CASE WHEN s_suppkey % 4 = 0 THEN 'data' END AS only_category,
       CASE WHEN s_suppkey % 50 <> 0 AND s_suppkey <> 6 THEN concat('proj_', s_suppkey % 20) END AS only_project
FROM supplier""",
    "fx_hook_events": """
SELECT event_id, ts, concat('proj_', user_id % 20) AS project_id, concat('tenant_', (user_id % 20) % 5) AS tenant_id, props,
       CASE event_type WHEN 'click' THEN 'data.updated' WHEN 'view' THEN 'context.queried' WHEN 'purchase' THEN 'data.published'
            WHEN 'signup' THEN 'agent.registered' ELSE 'security.auth.failed' END AS event_type,
       CASE event_type WHEN 'click' THEN 'data' WHEN 'view' THEN 'context' WHEN 'purchase' THEN 'data'
            WHEN 'signup' THEN 'agent' ELSE 'security' END AS category
FROM events""",
    "fx_deliveries": """
SELECT event_id AS delivery_id, concat('ep_', user_id % 25) AS endpoint_id, ts AS created_at, event_id % 3 + 1 AS attempt,
       CASE WHEN event_type = 'error' THEN 503 WHEN event_id % 10 = 7 THEN 404 WHEN event_id % 10 = 8 THEN NULL ELSE 200 END AS status_code,
       value AS duration_ms
FROM events""",
    # counter samples that fall back to 1 (a restart) every 977 events
    "fx_counter": """
SELECT event_id, ts, concat('proj_', user_id % 20) AS project_id, event_id % 977 + 1 AS value
FROM events""",
    "fx_vectors": """
SELECT vec_id, concat('proj_', label) AS project_id, embedding FROM embeddings""",
    "fx_vector_queries": """
SELECT vec_id AS query_id, concat('proj_', label) AS project_id, embedding FROM embeddings""",
    "fx_corpus": """
SELECT doc_id, source AS project_id, text AS content, lang AS metadata FROM documents""",
    "fx_text_queries": """
SELECT item_id AS query_id, text AS query FROM benchmark""",
    # stored nodes: one per document
    "fx_nodes": """
SELECT source AS project_id, concat('doc_', lang, '_', doc_id % 50) AS data_key,
       concat('doc_', lang, '_', doc_id % 50, '.part_', doc_id) AS node_key, concat('part_', doc_id) AS node_path,
       CASE doc_id % 3 WHEN 0 THEN 'object' WHEN 1 THEN 'row' ELSE 'paragraph' END AS node_type,
       text AS content, doc_id
FROM documents""",
    # payloads of seven formats around the whole text of each document
    "fx_payloads": """
SELECT doc_id, doc_id % 7 AS kind, source AS project_id, CASE WHEN doc_id % 35 = 6 THEN 'text' END AS format_hint,
  CASE doc_id % 7
  WHEN 0 THEN concat('{"title": "', source, '", "order": {"id": ', doc_id, ', "lang": "', lang, '", "tags": ["a", "b"]}, "items": [{"part": ',
       doc_id % 11, ', "qty": ', n_chars, '}, {"part": ', doc_id % 13, ', "qty": null}], "body": "', clean, '"}')
  WHEN 1 THEN concat('doc,lang,size,ok,score,note', chr(10), doc_id, ',', lang, ',', n_chars, ',yes,', doc_id % 10, '.5,', chr(10),
       doc_id + 1, ',', source, ',7,no,3,x y', chr(10), 'short,row', chr(10), doc_id + 2, ',de,,true,', doc_id % 3, '.25, z')
  WHEN 2 THEN concat('# ', source, ' guide', chr(10), chr(10), clean, chr(10), chr(10), '- one', chr(10), '* two', chr(10), '1. first', chr(10), chr(10),
       'See [docs](http://example.com/', doc_id, ') and [more](http://example.com/more).', chr(10), chr(10), '```python', chr(10), 'x = ', doc_id, chr(10),
       '```', chr(10), chr(10), '## Part ', doc_id % 5, chr(10), chr(10), 'Closing words.')
  WHEN 3 THEN concat('<doc><id>', doc_id, '</id><lang>', lang, '</lang><tag>a</tag><tag>b', doc_id % 4, '</tag>',
       CASE WHEN doc_id % 2 = 0 THEN '<size>12</size>' ELSE '<size>oops' END, '</doc>')
  WHEN 4 THEN CASE WHEN doc_id % 2 = 0 THEN concat('name: ', source, chr(10), 'lang: ', lang, chr(10), 'nested:', chr(10), '  size: ', n_chars)
       ELSE concat('name = "', source, '"', chr(10), '[nested]', chr(10), 'size = ', n_chars) END
  WHEN 5 THEN CASE WHEN doc_id % 2 = 0
       THEN concat('import os, sys', chr(10), 'from math import sqrt', chr(10), '@cached', chr(10), 'def f', doc_id, '(a, b) -> int:', chr(10), '    pass', chr(10),
            'class Box', doc_id, '(Base):', chr(10), '    def run(self):', chr(10), '        # ', source, chr(10), '        return 1')
       ELSE concat('import x from "lib', doc_id % 3, '"', chr(10), 'const go = (a) => {', chr(10), '  return a }', chr(10), 'function walk', doc_id, '(x) { return x }', chr(10),
            'export class Tree extends Base { }') END
  ELSE text END AS payload
FROM (SELECT doc_id, source, lang, n_chars, text, translate(text, concat('"', chr(92), chr(10), chr(9), chr(13)), '     ') AS clean FROM documents) dd""",
    # CSV with a repeated column, quoted commas, quotes and line breaks, blank and missing cells
    "fx_csv_payloads": """
SELECT doc_id, source AS project_id, 'csv' AS format_hint,
  concat('id,name,size,score,ok,name', chr(10), doc_id, ',"Doe, ', lang, '",', n_chars, ',', doc_id % 10, '.5,yes,"say ""', source, '""', '"', chr(10),
         doc_id + 1, ',x,,1,no,"two', chr(10), 'lines"', chr(10), doc_id + 2, ',y,7,,no,plain', chr(10), 'short,row', chr(10),
         doc_id + 3, ',z,8,2.25,t,') AS payload
FROM documents""",
    # import bundles, valid and broken in eight ways
    "fx_bundles": """
SELECT event_id AS bundle_id, event_id % 8 AS kind,
  CASE event_id % 8
  WHEN 0 THEN concat('{"project_id": "p', user_id, '", "version": "1.0", "data": {"events": [{"event_id": 1, "data": ', props, '}], "embeddings": [], "agents": []}}')
  WHEN 1 THEN concat('{"version": "1.0", "data": {"events": [{"event_id": 1, "data": ', props, '}]}}')
  WHEN 2 THEN concat('{"project_id": "p', user_id, '", "version": "1.0"}')
  WHEN 3 THEN concat('{"project_id": "p', user_id, '", "version": "1.0", "data": [1, 2]}')
  WHEN 4 THEN concat('{"project_id": "p', user_id, '", "version": "1.0", "data": {"events": "none", "agents": {}}}')
  WHEN 5 THEN concat('{"project_id": "p', user_id, '", "version": "1.0", "data": {"events": [{"event_id": 1, "data": 1}, {"event_id": 2}, {"data": 3}]}}')
  WHEN 6 THEN concat('{"project_id": "p', user_id, '", "data": {"embeddings": 5}}')
  ELSE concat('{"project_id": "p', user_id, '", "version"') END AS bundle
FROM events""",
    # requested points in time, per project
    "fx_targets": """
SELECT concat('proj_', c_custkey % 20) AS project_id, c_custkey AS target_id, c_custkey * 37 % 9500 AS at_sequence
FROM customer""",
    # snapshots taken of each project, some beyond the end of its log
    "fx_snapshot_points": """
SELECT concat('proj_', o_orderkey % 20) AS project_id, o_orderkey AS sequence, o_orderdate AS created_at
FROM orders""",
}


def _needed(sql: str, seen: list[str]) -> list[str]:
    for name in re.findall(r"\bfx_\w+\b", sql):
        if name in FIXTURES and name not in seen:
            _needed(FIXTURES[name], seen)
            seen.append(name)
    return seen


def with_fixtures(sql: str) -> str:
    """DuckDB text with the fixtures it names put in front."""
    names = _needed(sql, [])
    ctes = ",\n".join(f"{n} AS ({FIXTURES[n].strip()})" for n in names)
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE'):].strip()}"
    if body.upper().startswith("WITH"):
        return f"WITH {ctes},\n{body[len('WITH'):].strip()}"
    return f"WITH {ctes}\n{body}"


# texts are parsed and tokenized: deal them out where the files are few
TEXTS = ["documents", "conversations", "pages"]


def fx(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Fixture as a DataFrame over the parquet files of ``folder``."""
    sql, views = FIXTURES[name], []
    for table in BASE_TABLES:
        if table in TEXTS and re.search(rf"\bFROM {table}\b", sql):
            views.append(f"texts_{uuid.uuid4().hex}")
            spread(read_table(spark, folder, table)).createOrReplaceTempView(views[-1])
            sql = re.sub(rf"\bFROM {table}\b", f"FROM {views[-1]}", sql)
        else:
            sql = re.sub(rf"\bFROM {table}\b", f"FROM parquet.`{folder}/{table}.parquet`", sql)
    df = spark.sql(sql)
    for view in views:
        spark.catalog.dropTempView(view)
    return df
