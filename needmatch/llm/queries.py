"""Registered queries of the corpus operators, with their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import prepare, shared_dir
from ..sources.tables import read_table
from . import (class_model, jaccard_join, labels, mixing, packing, prefix_trie, quality_classifier, quality_rules, simhash_dedup, token_counts,
               toxicity, url_filters, vector_codes, vector_search)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(prepare(spark), folder.rstrip("/"))
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


@query("op1_quality_classifier")
def _quality_classifier(spark, folder):
    docs = read_table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    return (quality_classifier.score(docs, read_table(spark, folder, "labels"))
            .select("doc_id", F.col("source").alias("host"), F.col("lang").alias("path"), "verdict.*"))


@query("op2_packing")
def _packing(spark, folder):
    pieces = packing.pack(read_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


@query("op3_vector_search")
def _vector_search(spark, folder):
    vectors = read_table(spark, folder, "embeddings").select("vec_id", "embedding")
    return vector_search.search(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


@query("op4_toxicity")
def _toxicity(spark, folder):
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    lexicon = toxicity.fit(docs, read_table(spark, folder, "labels"))
    held = labels.remainder("doc_id", toxicity.MODULUS) == toxicity.HELD_OUT
    return toxicity.score(docs, lexicon).select(
        "doc_id", held.alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query("op5_class_model")
def _class_model(spark, folder):
    held = labels.remainder("doc_id", 5) == 1
    scores = class_model.score(read_table(spark, folder, "documents"), ~held)
    return scores.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op6_jaccard_join")
def _jaccard_join(spark, folder):
    return jaccard_join.near_copies(read_table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]


@query("op7_url_filters", oracle=r"""
WITH rules(verdict, rule_host, rule_path) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
urls AS (
  SELECT row_number() OVER () AS n, page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
best AS (
  SELECT n, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls LEFT JOIN best USING (n)
""")
def _url_filters(spark, folder):
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return url_filters.judge_urls(read_table(spark, folder, "pages"), rules)


@query("op8_mixing")
def _mixing(spark, folder):
    return mixing.mix(read_table(spark, folder, "documents")).select("doc_id", "source", "size", "source_size", "target",
                                                                     "copies", "taken")


@query("op9_token_counts")
def _token_counts(spark, folder):
    cache = token_counts.fresh_cache(shared_dir(spark))
    return token_counts.token_counts(read_table(spark, folder, "documents"),
                                     public_tokenizers.path("word_bpe_49k.json"), cache)


@query("op10_quality_rules")
def _quality_rules(spark, folder):
    return quality_rules.judge_quality(read_table(spark, folder, "documents"))


@query("op11_simhash_dedup")
def _simhash_dedup(spark, folder):
    return simhash_dedup.near_duplicates(read_table(spark, folder, "documents"))


@query("op12_prefix_trie", oracle=r"""
WITH t AS (  -- table of CRC-32
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS ts,
    list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)) AS bytes
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
o AS (
  SELECT conv_id, ts, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 4 AS h FROM own, t),
rebuilt AS (
  SELECT o.conv_id, list_concat(CASE WHEN h = 0 THEN [] ELSE coalesce(b.ts, [])[1:h] END, o.ts[h + 1:]) AS ts
  FROM o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
m AS (
  SELECT conv_id, d, CASE WHEN d = 0 THEN [] ELSE ts[1:d] END AS p, d = len(ts) AS ends
  FROM (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM rebuilt)),
g AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
    (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(p[d].text, '[^\x20\x09-\x0D]+')) END AS saved
  FROM m GROUP BY p, d),
c AS (SELECT CASE WHEN d = 1 THEN [] ELSE p[1:d - 1] END AS p, d - 1 AS d, count(*) AS n_children FROM g WHERE d > 0 GROUP BY ALL),
w AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN c ON c.p = g.p AND c.d = g.d),
u AS (
  SELECT CASE WHEN a = 0 THEN [] ELSE p[1:a] END AS p, a AS d, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM w) GROUP BY ALL)
SELECT w.conv_id, w.d AS depth, x.conv_id AS parent_conv_id, w.n AS n_convs, w.n_children, u.n_leaves,
  CAST(u.saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256
FROM w JOIN u ON u.p = w.p AND u.d = w.d
LEFT JOIN w x ON w.d > 0 AND x.d = w.d - 1 AND x.p = CASE WHEN w.d <= 1 THEN [] ELSE w.p[1:w.d - 1] END
""")
def _prefix_trie(spark, folder):
    lists = prefix_trie.turn_lists(read_table(spark, folder, "conversations"))
    return prefix_trie.prefix_trie(prefix_trie.with_family_heads(lists))


CODES_SQL = """
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT vec_id, label, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS x FROM k, range(16) t(p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM p QUALIFY e < 64),
{rounds}
f AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
      FROM a{last} GROUP BY vec_id),
l AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM f GROUP BY label),
s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{last})
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM f JOIN l ON f.label IS NOT DISTINCT FROM l.label, s
"""
ASSIGN_SQL = """
a{n} AS (
  SELECT vec_id, label, p, x, min(d) AS d, arg_min(e, (d, e)) AS e FROM (
    SELECT vec_id, label, p.p, x, e, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS d
    FROM p JOIN b{n} b ON p.p = b.p) GROUP BY vec_id, label, p, x),"""
MEAN_SQL = """
m{n} AS (
  SELECT p, e, list(CAST(floor(total / n) AS BIGINT) ORDER BY i) AS c FROM (
    SELECT p, e, i, sum(x[i])::DOUBLE AS total, count(*) AS n FROM a{n}, range(1, 1025) t(i) WHERE i <= len(x) GROUP BY p, e, i)
  GROUP BY p, e),
b{next} AS (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{n} b LEFT JOIN m{n} m ON b.p = m.p AND b.e = m.e),"""


@query("op13_vector_codes", oracle=CODES_SQL.format(
    last=2, rounds="".join(ASSIGN_SQL.format(n=n) + MEAN_SQL.format(n=n, next=n + 1) for n in range(2)) + ASSIGN_SQL.format(n=2)))
def _vector_codes(spark, folder):
    return (vector_codes.encode(read_table(spark, folder, "embeddings"))
            .select("vec_id", "code", "error", "label_error", "codebooks_sha256"))
