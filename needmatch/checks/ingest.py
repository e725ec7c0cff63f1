"""Queries over payloads, bundles and stored nodes."""

from pyspark.sql import functions as F

from .. import constants as C
from ..operators import ingest as ing
from .fixtures import NOW, fx
from .registry import query

ntz = lambda s: F.lit(s).cast("timestamp_ntz")
lit = lambda s: "'" + s.replace("'", "''") + "'"


def any_of(c, patterns):
    return "(" + " OR ".join(f"regexp_matches({c}, {lit(p)})" for p in patterns) + ")"


LINES = r"list_filter(regexp_split_to_array(trim(payload, E' \t\n\r'), '\r?\n'), lambda l: trim(l) <> '')"


def consistent(d):
    counts = f"list_transform(lines, lambda l: len(string_split(l, {d})))"
    mode = f"list_aggregate({counts}, 'mode')"
    return f"(len(list_filter({counts}, lambda n: n = {mode})) / len(lines) >= 0.7 AND {mode} >= 2)"


DELIMS = ["','", "chr(9)", "';'", "'|'"]
DETECT = f"""
l AS (SELECT *, {LINES} AS lines FROM fx_payloads),
f AS (SELECT *, CASE
  WHEN CASE WHEN json_valid(payload) THEN json_type(payload) = 'OBJECT' ELSE false END THEN 'json'
  WHEN NOT (length(payload) - length(replace(payload, '.', '')) >= 2 AND {' AND '.join(f"regexp_matches(payload, {lit(p)})" for p in C.PROSE_PATTERNS)})
       AND {any_of('payload', C.YAML_PATTERNS)} THEN 'yaml'
  WHEN len(lines) > 0 AND len(list_filter(lines, lambda x: NOT regexp_matches(x, '^\\s*(\\[[^\\]]+\\]|#.*|[\\w."-]+\\s*=\\s*\\S.*)$'))) = 0
       AND contains(payload, '=') THEN 'toml'
  WHEN regexp_extract(trim(payload, E' \\t\\n\\r'), '^(?:<\\?xml[^>]*\\?>\\s*)?<([A-Za-z_][\\w.-]*)', 1) <> ''
       AND ends_with(trim(payload, E' \\t\\n\\r'), '</' || regexp_extract(trim(payload, E' \\t\\n\\r'), '^(?:<\\?xml[^>]*\\?>\\s*)?<([A-Za-z_][\\w.-]*)', 1) || '>') THEN 'xml'
  WHEN NOT {any_of('payload', C.CSV_REJECT_PATTERNS)} AND len(lines) >= 2 AND ({' OR '.join(consistent(d) for d in DELIMS)}) THEN 'csv'
  WHEN {any_of('payload', C.MARKDOWN_PATTERNS)} THEN 'markdown'
  WHEN {any_of('payload', C.CODE_PATTERNS)} THEN 'code'
  ELSE 'text' END AS format FROM l)"""


@query("s4_detect_format", f"WITH {DETECT} SELECT doc_id, format FROM f")
def s4(spark, d):
    return ing.detect_format(fx(spark, d, "fx_payloads"), "payload", "format_hint").select("doc_id", "format")


@query("s4_format_shares", f"WITH {DETECT} SELECT project_id, format, count(*) AS payloads FROM f GROUP BY 1, 2")
def s4b(spark, d):
    return ing.format_shares(ing.detect_format(fx(spark, d, "fx_payloads"), "payload", "format_hint"), "project_id")


XML_SCHEMA = "id BIGINT, lang STRING, tag ARRAY<STRING>, size INT"


@query("s5_normalize_payload", f"""
WITH {DETECT}
SELECT doc_id, format, format IN ('json', 'csv', 'xml') AS is_structured, true AS is_object FROM f
WHERE format NOT IN ('yaml', 'toml') AND NOT (format = 'xml' AND doc_id % 2 = 1)""")
def s5(spark, d):
    out, _ = ing.normalize(fx(spark, d, "fx_payloads"), "doc_id", "payload", "format_hint", XML_SCHEMA)
    return out.select("doc_id", "format", "is_structured",
                      F.get_json_object("norm_json", "$").startswith("{").alias("is_object"))


@query("s5_csv_norm_json", """
SELECT doc_id, 'csv' AS format, concat('{"records":[{"id":', doc_id, ',"name":"say \\"', source, '\\"","size":', n_chars, ',"score":', doc_id % 10, '.5,"ok":true},{"id":',
  doc_id + 1, ',"name":"two\\nlines","size":null,"score":1.0,"ok":false},{"id":', doc_id + 2, ',"name":"plain","size":7,"score":null,"ok":false},{"id":',
  doc_id + 3, ',"name":null,"size":8,"score":2.25,"ok":true}],"schema":{"id":"int","name":"string","size":"int","score":"float","ok":"bool"},"row_count":4,"column_count":6}') AS norm_json
FROM documents""")
def s5c(spark, d):
    return ing.normalize(fx(spark, d, "fx_csv_payloads"), "doc_id", "payload", "format_hint")[0].select("doc_id", "format", "norm_json")


@query("s5_dead_letters", f"""
WITH {DETECT}
SELECT doc_id, format FROM f WHERE format IN ('yaml', 'toml') OR (format = 'xml' AND doc_id % 2 = 1)""")
def s5r(spark, d):
    return ing.normalize(fx(spark, d, "fx_payloads"), "doc_id", "payload", "format_hint", XML_SCHEMA)[1]


@query("s6_csv_payload_infer", """
WITH c AS (SELECT *, doc_id % 10 AS a, doc_id % 3 AS b FROM fx_payloads WHERE kind = 1),
s AS (SELECT c.*, o.lang, o.n_chars, o.source FROM c JOIN documents o ON o.doc_id = c.doc_id),
r AS (SELECT doc_id, 0 AS row_no, [doc_id::VARCHAR, lang, n_chars::VARCHAR, 'yes', a || '.5', ''] AS v FROM s
  UNION ALL SELECT doc_id, 1, [(doc_id + 1)::VARCHAR, source, '7', 'no', '3', 'x y'] FROM s
  UNION ALL SELECT doc_id, 2, [(doc_id + 2)::VARCHAR, 'de', '', 'true', b || '.25', 'z'] FROM s),
e AS (SELECT doc_id, row_no, unnest(v) AS value, unnest(['doc', 'lang', 'size', 'ok', 'score', 'note']) AS "column",
        unnest(['int', 'string', 'int', 'bool', 'float', 'string']) AS type FROM r)
SELECT doc_id, CAST(row_no AS BIGINT) AS row_no, "column", type, nullif(value, '') AS value,
  CASE WHEN type = 'int' THEN TRY_CAST(nullif(value, '') AS BIGINT) END AS int_value,
  CASE WHEN type = 'float' THEN TRY_CAST(value AS DOUBLE) END AS float_value,
  CASE WHEN type = 'bool' THEN value IN ('yes', 'true') END AS bool_value
FROM e""")
def s6(spark, d):
    csv = fx(spark, d, "fx_payloads").filter("kind = 1")
    return ing.csv_records(csv, "doc_id", "payload")


@query("s7_xml_records", """
SELECT p.doc_id, p.doc_id AS id, o.lang, 'a|b' || (p.doc_id % 4) AS tags, CAST(12 AS INTEGER) AS size
FROM fx_payloads p JOIN documents o ON o.doc_id = p.doc_id WHERE p.kind = 3 AND p.doc_id % 2 = 0""")
def s7(spark, d):
    good, _ = ing.xml_records(fx(spark, d, "fx_payloads").filter("kind = 3"), "payload", XML_SCHEMA, ["doc_id"])
    return good.select("doc_id", "id", "lang", F.array_join("tag", "|").alias("tags"), "size")


@query("s7_xml_rejects", "SELECT doc_id FROM fx_payloads WHERE kind = 3 AND doc_id % 2 = 1")
def s7r(spark, d):
    return ing.xml_records(fx(spark, d, "fx_payloads").filter("kind = 3"), "payload", XML_SCHEMA, ["doc_id"])[1].select("doc_id")


@query("s8_markdown_structure", r"""
WITH a AS (SELECT doc_id, payload, list_filter(list_transform(string_split(payload, chr(10)), lambda l: trim(l, E' \t\n\r')), lambda l: regexp_matches(l, '^(#{1,6})\s+(.+)$')) AS hl,
  list_filter(list_transform(regexp_split_to_array(payload, '\n\n+'), lambda p: trim(p, E' \t\n\r')), lambda p: p <> '') AS ps FROM fx_payloads),
b AS (SELECT *, list_transform(hl, lambda l: length(regexp_extract(l, '^(#{1,6})\s+(.+)$', 1)) || ':' || regexp_extract(l, '^(#{1,6})\s+(.+)$', 2)) AS hs FROM a)
SELECT doc_id, array_to_string(hs, '|') AS headings,
  array_to_string(regexp_extract_all(payload, '\[([^\]]+)\]\(([^\)]+)\)', 2), '|') AS urls,
  array_to_string(regexp_extract_all(payload, '(?s)```(\w*)\n(.*?)\n```', 2), '|') AS code,
  CAST(len(regexp_extract_all(payload, '(?m)^\s*[-*+]\s')) AS BIGINT) AS unordered_items,
  CAST(len(regexp_extract_all(payload, '(?m)^\s*\d+\.\s')) AS BIGINT) AS ordered_items,
  CASE WHEN len(hl) > 0 THEN regexp_extract(hl[1], '^(#{1,6})\s+(.+)$', 2) ELSE substr(string_split(payload, chr(10))[1], 1, 100) END AS title,
  substr(ps[CASE WHEN starts_with(ps[1], '#') THEN 2 ELSE 1 END], 1, 200) AS summary, CAST(len(hl) AS BIGINT) AS heading_count
FROM b""")
def s8(spark, d):
    out = ing.markdown_structure(fx(spark, d, "fx_payloads"), "payload")
    return out.select(
        "doc_id", F.array_join(F.transform("headings", lambda h: F.concat_ws(":", h["level"], h["text"])), "|").alias("headings"),
        F.array_join(F.transform("links", lambda x: x["url"]), "|").alias("urls"),
        F.array_join(F.transform("code_blocks", lambda x: x["code"]), "|").alias("code"),
        "unordered_items", "ordered_items", "title", "summary", "heading_count")


@query("s9_code_structure", r"""
WITH s AS (SELECT *, """ + " + ".join(f"contains(payload, '{w}')::INT" for w in C.PYTHON_MARKS) + " AS py, "
       + " + ".join(f"contains(payload, '{w}')::INT" for w in C.JS_MARKS) + r""" AS js FROM fx_payloads),
g AS (SELECT *, CASE WHEN py > js THEN 'python' WHEN js > 0 AND (contains(payload, 'interface ') OR contains(payload, ': ')) THEN 'typescript'
   WHEN js > 0 THEN 'javascript' ELSE 'unknown' END AS language FROM s)
SELECT doc_id, language,
  CASE language WHEN 'python' THEN array_to_string(regexp_extract_all(payload, '(?m)^\s*def\s+(\w+)\s*\((.*?)\)(?:\s*->\s*([^:]+))?:', 1), ',')
    WHEN 'unknown' THEN '' ELSE array_to_string(list_concat(regexp_extract_all(payload, 'function\s+(\w+)\s*\((.*?)\)', 1),
       regexp_extract_all(payload, '(?:const|let|var)\s+(\w+)\s*=\s*(?:\([^)]*\)|[^=])*\s*=>', 1)), ',') END AS functions,
  CASE language WHEN 'python' THEN array_to_string(regexp_extract_all(payload, '(?m)^\s*class\s+(\w+)(?:\(([^)]*)\))?:', 1), ',')
    WHEN 'unknown' THEN '' ELSE array_to_string(regexp_extract_all(payload, 'class\s+(\w+)(?:\s+extends\s+(\w+))?', 1), ',') END AS classes,
  CASE language WHEN 'python' THEN array_to_string(list_sort(list_distinct(list_concat(
       flatten(list_transform(regexp_extract_all(payload, '(?m)^\s*import\s+(.+)$', 1), lambda s: list_transform(string_split(s, ','), lambda x: trim(x, E' \t\n\r')))),
       regexp_extract_all(payload, '(?m)^\s*from\s+(\S+)\s+import', 1)))), ',')
    WHEN 'unknown' THEN '' ELSE array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(payload, 'import\s+.*?from\s+["'']([^"'']+)["'']', 1),
       regexp_extract_all(payload, 'require\(["'']([^"'']+)["'']\)', 1)))), ',') END AS imports,
  CASE language WHEN 'python' THEN array_to_string(list_sort(list_distinct(regexp_extract_all(payload, '(?m)^\s*@(\w+(?:\.\w+)*)', 1))), ',') ELSE '' END AS decorators,
  CASE WHEN language IN ('python', 'unknown') THEN '' ELSE array_to_string(regexp_extract_all(payload, 'export\s+(?:const|let|var|function|class)\s+(\w+)', 1), ',') END AS exports,
  CAST(len(string_split(payload, chr(10))) AS BIGINT) AS line_count,
  CAST(len(list_filter(string_split(payload, chr(10)), lambda l: trim(l, E' \t\n\r') <> '')) AS BIGINT) AS non_empty_lines,
  CAST(len(list_filter(string_split(payload, chr(10)), lambda l: regexp_matches(trim(l, E' \t\n\r'), '^(#|//|/\*|\*)'))) AS BIGINT) AS comment_lines
FROM g""")
def s9(spark, d):
    out = ing.code_structure(fx(spark, d, "fx_payloads"), "payload")
    names = lambda c: F.array_join(F.transform(c, lambda x: x["name"]), ",").alias(c)
    return out.select("doc_id", "language", names("functions"), names("classes"),
                      F.array_join("imports", ",").alias("imports"), F.array_join("decorators", ",").alias("decorators"),
                      F.array_join("exports", ",").alias("exports"), "line_count", "non_empty_lines", "comment_lines")


PAYLOAD_FIELDS = """
SELECT p.doc_id, o.source, o.lang, o.n_chars, translate(o.text, concat('"', chr(92), chr(10), chr(9), chr(13)), '     ') AS body
FROM fx_payloads p JOIN documents o ON o.doc_id = p.doc_id WHERE p.kind = 0"""


@query("s10_flatten_paths", f"""
WITH o AS ({PAYLOAD_FIELDS})
SELECT doc_id, 'title' AS path, source AS value FROM o
UNION ALL SELECT doc_id, 'order.id', CAST(doc_id AS VARCHAR) FROM o
UNION ALL SELECT doc_id, 'order.lang', lang FROM o
UNION ALL SELECT doc_id, 'order.tags', '["a","b"]' FROM o
UNION ALL SELECT doc_id, 'items[*]', 'array' FROM o
UNION ALL SELECT doc_id, 'body', body FROM o""")
def s10(spark, d):
    return ing.flatten_json(fx(spark, d, "fx_payloads"), "doc_id", "payload")


@query("s11_field_paths", f"""
WITH o AS ({PAYLOAD_FIELDS})
SELECT doc_id, unnest(['title', 'order.id', 'order.lang', 'order.tags', 'items[]', 'body']) AS path FROM o""")
def s11(spark, d):
    return ing.field_paths(fx(spark, d, "fx_payloads"), "doc_id", "payload")


@query("s11_field_description", f"""
WITH o AS ({PAYLOAD_FIELDS})
SELECT doc_id, 'doc_' || doc_id || ' with fields: body, items[], order.id, order.lang, order.tags, title' AS description FROM o""")
def s11b(spark, d):
    paths = ing.field_paths(fx(spark, d, "fx_payloads"), "doc_id", "payload")
    return ing.describe_fields(paths, "doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")))


@query("s12_export_project", """
SELECT project_id, 'events' AS section, '1.0' AS version, CAST(sequence AS VARCHAR) AS key,
  '{"event_id":' || sequence || ',"event_type":"' || event_type || '","data":' || replace(data, ' ', '') || '}' AS json FROM fx_log
UNION ALL SELECT project_id, 'embeddings', '1.0', node_key,
  '{"data_key":"' || data_key || '","node_key":"' || node_key || '","node_path":"' || node_path || '","node_type":"' || node_type || '"}' FROM fx_nodes
UNION ALL SELECT project_id, 'agents', '1.0', agent_id,
  '{"agent_id":"' || agent_id || '","last_sequence":' || last_sequence || ',"notification_method":"' || notification_method || '"}' FROM fx_agents""")
def s12(spark, d):
    return ing.export_project(*(fx(spark, d, n) for n in ("fx_log", "fx_nodes", "fx_agents")))


@query("s13_validate_import", """
SELECT bundle_id, kind = 0 OR kind = 6 AND false AS valid,
  CASE kind WHEN 0 THEN '' WHEN 1 THEN 'Missing required field: project_id' WHEN 2 THEN 'Missing required field: data'
   WHEN 3 THEN '''data'' field must be a dictionary' WHEN 4 THEN '''events'' must be a list; ''agents'' must be a list'
   WHEN 5 THEN 'Event 1 missing data; Event 2 missing event_id' WHEN 6 THEN '''embeddings'' must be a list' ELSE 'Invalid JSON' END AS errors,
  CASE WHEN kind = 6 THEN 'Missing version field' ELSE '' END AS warnings
FROM fx_bundles""")
def s13(spark, d):
    out = ing.validate_bundle(fx(spark, d, "fx_bundles"), "bundle_id", "bundle")
    return out.select("bundle_id", "valid", F.array_join("errors", "; ").alias("errors"),
                      F.array_join("warnings", "; ").alias("warnings"))


IMPORTS = """
SELECT event_id AS id, concat('proj_', user_id % 40) AS project_id, concat(event_type, '_', event_id % 3) AS data_key,
       props AS data, ts AS created_at FROM events"""
FORCED = "SELECT DISTINCT concat('proj_', user_id % 40) AS project_id FROM events WHERE user_id % 40 < 5"


def raw(spark, d, sql, table="events"):
    return spark.sql(sql.replace(f"FROM {table}", f"FROM parquet.`{d}/{table}.parquet`"))


@query("s14_import_events", f"""
WITH b AS ({IMPORTS}), o AS ({FORCED}), x AS (SELECT DISTINCT project_id FROM fx_log)
SELECT id, project_id, data_key, row_number() OVER (PARTITION BY project_id ORDER BY created_at, id) AS sequence
FROM b WHERE project_id IN (SELECT project_id FROM o) OR project_id NOT IN (SELECT project_id FROM x)""")
def s14(spark, d):
    new, _ = ing.import_events(raw(spark, d, IMPORTS), fx(spark, d, "fx_log"), raw(spark, d, FORCED))
    return new.select("id", "project_id", "data_key", "sequence")


@query("s14_import_refused", f"""
WITH b AS ({IMPORTS}), o AS ({FORCED})
SELECT DISTINCT project_id FROM b WHERE project_id NOT IN (SELECT project_id FROM o) AND project_id IN (SELECT project_id FROM fx_log)""")
def s14r(spark, d):
    return ing.import_events(raw(spark, d, IMPORTS), fx(spark, d, "fx_log"), raw(spark, d, FORCED))[1]


@query("s15_import_dedup", """
WITH n AS (SELECT project_id, node_key, data_key || '_new' AS data_key, 'import' AS origin FROM fx_nodes),
x AS (SELECT project_id, node_key, data_key, 'stored' AS origin FROM fx_nodes WHERE node_type <> 'row')
SELECT * FROM x UNION ALL SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.project_id = n.project_id AND x.node_key = n.node_key)""")
def s15(spark, d):
    nodes = fx(spark, d, "fx_nodes")
    new = nodes.select("project_id", "node_key", F.concat("data_key", F.lit("_new")).alias("data_key"), F.lit("import").alias("origin"))
    old = nodes.filter("node_type <> 'row'").select("project_id", "node_key", "data_key", F.lit("stored").alias("origin"))
    return ing.import_rows(new, old, ["project_id", "node_key"])


@query("s15_import_overwrite", """
WITH n AS (SELECT agent_id, project_id, 'import' AS origin FROM fx_agents WHERE notification_method = 'redis'),
x AS (SELECT agent_id, project_id, 'stored' AS origin FROM fx_agents)
SELECT * FROM n UNION ALL SELECT * FROM x WHERE agent_id NOT IN (SELECT agent_id FROM n)""")
def s15o(spark, d):
    agents = fx(spark, d, "fx_agents").select("agent_id", "project_id", "notification_method")
    new = agents.filter("notification_method = 'redis'").select("agent_id", "project_id", F.lit("import").alias("origin"))
    old = agents.select("agent_id", "project_id", F.lit("stored").alias("origin"))
    return ing.import_rows(new, old, ["agent_id"], overwrite=True)


@query("s16_archive_split", """
SELECT id, project_id, CASE WHEN created_at < TIMESTAMP '2024-01-15 00:00:00' THEN 'archive' ELSE 'kept' END AS part FROM fx_log""")
def s16(spark, d):
    old, kept = ing.archive_split(fx(spark, d, "fx_log"), ntz("2024-01-15 00:00:00"))
    return (old.withColumn("part", F.lit("archive")).unionByName(kept.withColumn("part", F.lit("kept")))
            .select("id", "project_id", "part"))


@query("s17_audit_trail_export", "SELECT created_at AS timestamp, data_key, 'published' AS change_type FROM fx_log")
def s17(spark, d):
    return ing.audit_trail(fx(spark, d, "fx_log"))


@query("s18_list_data_keys", "SELECT DISTINCT project_id, split_part(data_key, '.', 1) AS data_key FROM fx_nodes")
def s18(spark, d):
    return ing.data_keys(fx(spark, d, "fx_nodes"))


@query("s18_project_data", "SELECT project_id, data_key, node_key, node_type, node_type IN ('object', 'row') AS is_structured FROM fx_nodes")
def s18b(spark, d):
    return ing.project_data(fx(spark, d, "fx_nodes")).select("project_id", "data_key", "node_key", "node_type", "is_structured")


@query("s19_data_original", "SELECT project_id, data_key, arg_min(content, node_key) AS content FROM fx_nodes GROUP BY 1, 2")
def s19(spark, d):
    return ing.data_originals(fx(spark, d, "fx_nodes"), "content")


@query("s20_upsert_nodes", """
WITH t AS (SELECT project_id, data_key AS node_key, sequence AS version, data FROM fx_log WHERE id < 0),
b AS (SELECT project_id, data_key AS node_key, sequence AS version, data FROM fx_log)
SELECT project_id, node_key, max(version) AS version, arg_max(data, version) AS data FROM (SELECT * FROM t UNION ALL SELECT * FROM b) GROUP BY 1, 2""")
def s20(spark, d):
    log = fx(spark, d, "fx_log").select("project_id", F.col("data_key").alias("node_key"), F.col("sequence").alias("version"), "data")
    stored = log.filter("version <= 0")
    return ing.upsert_nodes(stored, log, ["project_id", "node_key"], "version")


CLEARED = "SELECT DISTINCT source AS project_id FROM documents WHERE lang = 'fr' AND n_chars > 10000"


@query("s21_clear_project", f"""
WITH c AS ({CLEARED})
SELECT project_id, node_key FROM fx_nodes WHERE project_id NOT IN (SELECT project_id FROM c)""")
def s21(spark, d):
    return ing.clear_project(fx(spark, d, "fx_nodes"), raw(spark, d, CLEARED, "documents"))[0].select("project_id", "node_key")


@query("s21_clear_counts", f"""
WITH c AS ({CLEARED})
SELECT project_id, count(*) AS deleted FROM fx_nodes WHERE project_id IN (SELECT project_id FROM c) GROUP BY 1""")
def s21b(spark, d):
    return ing.clear_project(fx(spark, d, "fx_nodes"), raw(spark, d, CLEARED, "documents"))[1]
