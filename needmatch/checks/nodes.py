"""Queries that split documents into nodes and back."""

from pyspark.sql import functions as F

from ..operators import ingest as ing, nodes as nd
from ..sources.tables import read_table, spread
from .fixtures import fx
from .ingest import PAYLOAD_FIELDS
from .registry import query

TRIM = "trim({}, E' \\t\\n\\r')"


DEEP_LEVELS = 16
DEEP = ".".join(["trail", *(f"l{i}" for i in range(1, DEEP_LEVELS + 1))])


def order_docs(spark, d):
    """One nested document per order with its line items (a handful of rows per order) and a long chain of objects."""
    deep = F.struct(F.col("o_orderkey").alias("doc"))
    for level in range(DEEP_LEVELS, 0, -1):
        deep = F.struct(deep.alias(f"l{level}"))
    items = (read_table(spark, d, "lineitem").repartition("l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("qty")))).alias("l")))
    return (read_table(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
            .select(F.col("o_orderkey").alias("doc_id"), F.to_json(F.struct(
                F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"),
                         F.col("o_orderpriority").alias("priority")).alias("order"),
                F.lit("v1").alias("note"),
                F.transform("l", lambda x: F.struct(x["l_partkey"].alias("part"), x["qty"].alias("qty"))).alias("items"),
                deep.alias("trail"))).alias("json")))


ORDER_NODES = f"""
i AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)) - 1 AS n,
        l_partkey AS part, CAST(l_quantity AS BIGINT) AS qty FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
n AS (SELECT DISTINCT o_orderkey AS doc_id, 'order' AS path, 'object' AS node_type,
        '{{"key":' || o_orderkey || ',"status":"' || o_orderstatus || '","priority":"' || o_orderpriority || '"}}' AS content FROM orders JOIN i ON i.doc_id = o_orderkey
      UNION ALL SELECT DISTINCT doc_id, '{DEEP}', 'object', '{{"doc":' || doc_id || '}}' FROM i
      UNION ALL SELECT doc_id, 'items[' || n || ']', 'object', '{{"part":' || part || ',"qty":' || qty || '}}' FROM i)"""


@query("n1_json_nodes", f"WITH {ORDER_NODES} SELECT doc_id, path, node_type, content FROM n")
def n1(spark, d):
    return nd.json_nodes(order_docs(spark, d), "doc_id", "json", ["path", "content", "node_type"]).select("doc_id", "path", "node_type", "content")


@query("s10_flatten_deep", f"""
SELECT o_orderkey AS doc_id, unnest(['order.key', 'order.status', 'order.priority', 'note', 'items[*]', '{DEEP}.doc']) AS path,
  unnest([CAST(o_orderkey AS VARCHAR), o_orderstatus, o_orderpriority, 'v1', 'array', CAST(o_orderkey AS VARCHAR)]) AS value
FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def s10_deep(spark, d):
    return ing.flatten_json(order_docs(spark, d), "doc_id", "json")


TEXT_NODES = r"""
p AS (SELECT doc_id, list_filter(list_transform(string_split(trim(text, E' \t\n\r'), E'\n\n'), lambda p: trim(p, E' \t\n\r')), lambda p: p <> '') AS ps FROM documents),
q AS (SELECT doc_id, len(ps) = 1 AS one, CASE WHEN len(ps) = 1 THEN list_filter(list_transform(regexp_split_to_array(ps[1], '[.!?]+\s+'), lambda s: trim(s, E' \t\n\r')), lambda s: s <> '') ELSE ps END AS parts FROM p),
n AS (SELECT doc_id, one, unnest(parts) AS content, generate_subscripts(parts, 1) - 1 AS ord FROM q)"""


@query("n3_text_nodes", f"""
WITH {TEXT_NODES}
SELECT doc_id, CAST(ord AS INTEGER) AS ord, CASE WHEN one THEN 'sentence_' ELSE 'paragraph_' END || ord AS path, content,
  CASE WHEN one THEN 'sentence' ELSE 'paragraph' END AS node_type FROM n""")
def n3(spark, d):
    return nd.text_nodes(spread(read_table(spark, d, "documents")), "doc_id", "text")


@query("n4_markdown_nodes", r"""
WITH o AS (SELECT p.doc_id, d.source, trim(translate(d.text, concat('"', chr(92), chr(10), chr(9), chr(13)), '     ')) AS body
  FROM fx_payloads p JOIN documents d ON d.doc_id = p.doc_id WHERE p.kind = 2),
n AS (SELECT doc_id, 0 AS ord, 'heading_0' AS path, source || ' guide' AS content, 'heading' AS node_type FROM o
  UNION ALL SELECT doc_id, 1, 'code_block_1', 'x = ' || doc_id, 'code_block' FROM o
  UNION ALL SELECT doc_id, 2, 'paragraph_2', body, 'paragraph' FROM o
  UNION ALL SELECT doc_id, 3, 'paragraph_3', E'- one\n* two\n1. first', 'paragraph' FROM o
  UNION ALL SELECT doc_id, 4, 'paragraph_4', 'See [docs](http://example.com/' || doc_id || ') and [more](http://example.com/more).', 'paragraph' FROM o
  UNION ALL SELECT doc_id, 5, 'heading_1', 'Part ' || (doc_id % 5), 'heading' FROM o
  UNION ALL SELECT doc_id, 6, 'paragraph_6', 'Closing words.', 'paragraph' FROM o)
SELECT n.*, CASE WHEN ord < 5 THEN source || ' guide' ELSE 'Part ' || (n.doc_id % 5) END AS heading FROM n JOIN o ON o.doc_id = n.doc_id""")
def n4(spark, d):
    return nd.markdown_nodes(fx(spark, d, "fx_payloads").filter("kind = 2"), "doc_id", "payload").select(
        "doc_id", "ord", "path", "content", "node_type", "heading")


@query("n5_csv_nodes", """
WITH s AS (SELECT p.doc_id, o.lang, o.n_chars, o.source FROM fx_payloads p JOIN documents o ON o.doc_id = p.doc_id WHERE p.kind = 1),
n AS (SELECT doc_id, 0 AS ord, ['"' || doc_id || '"', '"' || lang || '"', '"' || n_chars || '"', '"yes"', '"' || (doc_id % 10) || '.5"', '""'] AS v FROM s
  UNION ALL SELECT doc_id, 1, ['"' || (doc_id + 1) || '"', '"' || source || '"', '"7"', '"no"', '"3"', '"x y"'] FROM s
  UNION ALL SELECT doc_id, 2, ['"short"', '"row"', 'null', 'null', 'null', 'null'] FROM s
  UNION ALL SELECT doc_id, 3, ['"' || (doc_id + 2) || '"', '"de"', '""', '"true"', '"' || (doc_id % 3) || '.25"', '" z"'] FROM s)
SELECT doc_id, CAST(ord AS INTEGER) AS ord, 'row_' || ord AS path, 'row' AS node_type,
  '{"doc":' || v[1] || ',"lang":' || v[2] || ',"size":' || v[3] || ',"ok":' || v[4] || ',"score":' || v[5] || ',"note":' || v[6] || '}' AS content FROM n""")
def n5(spark, d):
    return nd.csv_nodes(fx(spark, d, "fx_payloads").filter("kind = 1"), "doc_id", "payload")


@query("n5_csv_nodes_quoted", """
WITH n AS (
  SELECT doc_id, 0 AS ord, concat('{"id":"', doc_id, '","name":"say \\"', source, '\\"","size":"', n_chars, '","score":"', doc_id % 10, '.5","ok":"yes"}') AS content FROM documents
  UNION ALL SELECT doc_id, 1, concat('{"id":"', doc_id + 1, '","name":"two\\nlines","size":"","score":"1","ok":"no"}') FROM documents
  UNION ALL SELECT doc_id, 2, concat('{"id":"', doc_id + 2, '","name":"plain","size":"7","score":"","ok":"no"}') FROM documents
  UNION ALL SELECT doc_id, 3, '{"id":"short","name":null,"size":null,"score":null,"ok":null}' FROM documents
  UNION ALL SELECT doc_id, 4, concat('{"id":"', doc_id + 3, '","name":"","size":"8","score":"2.25","ok":"t"}') FROM documents)
SELECT doc_id, CAST(ord AS INTEGER) AS ord, 'row_' || ord AS path, 'row' AS node_type, content FROM n""")
def n5q(spark, d):
    return nd.csv_nodes(fx(spark, d, "fx_csv_payloads"), "doc_id", "payload")


@query("n6_node_format_route")
def n6(spark, d):
    nodes, dead = nd.to_nodes(fx(spark, d, "fx_payloads"), "doc_id", "payload", "format_hint")
    return (nodes.groupBy("doc_id", "format").agg(F.count(F.lit(1)).alias("nodes"))
            .unionByName(dead.withColumn("nodes", F.lit(0).cast("bigint"))))


@query("n7_node_key", """
SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN data_key ELSE data_key || '.' || node_path END AS node_key FROM fx_nodes""")
def n7(spark, d):
    path = F.when(F.col("doc_id") % 6 != 0, F.col("node_path"))
    return fx(spark, d, "fx_nodes").select("doc_id", nd.node_key("data_key", path).alias("node_key"))


@query("n8_node_text", f"""
WITH {ORDER_NODES}
SELECT doc_id, path, CASE WHEN path = 'order' THEN 'order | key: ' || json_extract_string(content, '$.key') || ' | status: ' || json_extract_string(content, '$.status')
   || ' | priority: ' || json_extract_string(content, '$.priority')
  WHEN path = '{DEEP}' THEN '{DEEP.replace(".", " ")} | doc: ' || json_extract_string(content, '$.doc')
  ELSE 'items | part: ' || json_extract_string(content, '$.part') || ' | qty: ' || json_extract_string(content, '$.qty') END AS text FROM n""")
def n8(spark, d):
    nodes = nd.json_nodes(order_docs(spark, d), "doc_id", "json", ["path", "content", "node_type"])
    return nodes.select("doc_id", "path", nd.node_text("path", "content", "node_type").alias("text"))


@query("n9_embedding_text", f"""
WITH o AS ({PAYLOAD_FIELDS}),
f AS (SELECT doc_id, 'body: ' || body || ' | items: [{{"part":' || (doc_id % 11) || ',"qty":' || n_chars || '}},{{"part":' || (doc_id % 13) || ',"qty":null}}]'
   || ' | order: {{"id":' || doc_id || ',"lang":"' || lang || '","tags":["a","b"]}}' || ' | title: ' || source AS c FROM o)
SELECT doc_id, 'doc_' || doc_id || ': ' || CASE WHEN length(c) > 500 THEN substr(c, 1, 500) || '...' ELSE c END AS text FROM f
UNION ALL SELECT doc_id, 'text_' || doc_id || ': ' || CASE WHEN length(payload) > 500 THEN substr(payload, 1, 500) || '...' ELSE payload END
FROM fx_payloads WHERE kind = 6""")
def n9(spark, d):
    p = fx(spark, d, "fx_payloads")
    j = p.filter("kind = 0").select("doc_id", nd.embedding_text(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")), F.to_json(F.parse_json("payload")), F.lit(True)).alias("text"))
    t = p.filter("kind = 6").select("doc_id", nd.embedding_text(
        F.concat(F.lit("text_"), F.col("doc_id").cast("string")), F.to_json(F.struct(F.col("payload").alias("content"))), F.lit(False)).alias("text"))
    return j.unionByName(t)


@query("n10_reassemble_text", f"""
WITH {TEXT_NODES}
SELECT doc_id, replace(string_agg(content, chr(1) ORDER BY ord), chr(1), CASE WHEN one THEN ' ' ELSE E'\\n\\n' END) AS text FROM n GROUP BY doc_id, one""")
def n10(spark, d):
    return nd.reassemble_text(nd.text_nodes(spread(read_table(spark, d, "documents")), "doc_id", "text"), "doc_id")


@query("n10_reassemble_markdown", r"""
SELECT p.doc_id, '# ' || d.source || E' guide\n\n```python\nx = ' || p.doc_id || E'\n```\n\n'
  || trim(translate(d.text, concat('"', chr(92), chr(10), chr(9), chr(13)), '     ')) || E'\n\n- one\n* two\n1. first\n\nSee [docs](http://example.com/'
  || p.doc_id || E') and [more](http://example.com/more).\n\n## Part ' || (p.doc_id % 5) || E'\n\nClosing words.' AS text
FROM fx_payloads p JOIN documents d ON d.doc_id = p.doc_id WHERE p.kind = 2""")
def n10m(spark, d):
    return nd.reassemble_markdown(nd.markdown_nodes(fx(spark, d, "fx_payloads").filter("kind = 2"), "doc_id", "payload"), "doc_id")


@query("n10_reassemble_csv", """
SELECT p.doc_id, E'doc,lang,note,ok,score,size\\n' || p.doc_id || ',' || o.lang || ',,yes,' || (p.doc_id % 10) || '.5,' || o.n_chars || E'\\n'
  || (p.doc_id + 1) || ',' || o.source || E',x y,no,3,7\\nshort,row,,,,\\n' || (p.doc_id + 2) || ',de, z,true,' || (p.doc_id % 3) || '.25,' AS text
FROM fx_payloads p JOIN documents o ON o.doc_id = p.doc_id WHERE p.kind = 1""")
def n10c(spark, d):
    return nd.reassemble_csv(nd.csv_nodes(fx(spark, d, "fx_payloads").filter("kind = 1"), "doc_id", "payload"), "doc_id")


@query("n11_reassemble_json", f"""
WITH {ORDER_NODES}
SELECT doc_id, '{{' || string_agg('"' || path || '":' || content, ',' ORDER BY CASE WHEN path = 'order' THEN -1 WHEN path = '{DEEP}' THEN 1000000
  ELSE CAST(regexp_extract(path, '\\d+') AS BIGINT) END) || '}}' AS json FROM n GROUP BY 1""")
def n11(spark, d):
    return nd.reassemble_json(nd.json_nodes(order_docs(spark, d), "doc_id", "json", ["ord", "path", "content"]), "doc_id")


@query("n11_round_trip", f"WITH {ORDER_NODES} SELECT doc_id, path, content FROM n")
def n11b(spark, d):
    docs = nd.reassemble_json(nd.json_nodes(order_docs(spark, d), "doc_id", "json", ["ord", "path", "content"]), "doc_id")
    return nd.explode_json(docs, "doc_id")
