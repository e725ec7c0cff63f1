"""Splitting documents into addressable nodes and putting them together again.

A node row is (doc_id, ord, path, content, node_type, ...); all splits run inside the row of the
document; JSON documents are walked whole, in Arrow batches.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import constants as C
from ..functions import json_walk
from ..functions.text import clip, col, staged, strip, unix
from .ingest import csv_rows, csv_tables, last_index

MARK = "\x01"


def json_nodes(df: DataFrame, doc_id: str, json: str, only: list[str] | None = None) -> DataFrame:
    """Leaf objects and primitives of arrays with their keys in document order, to any depth; ``only`` names the columns
    to make beside the id, where not all are needed."""
    rows_of = partial(json_walk.node_rows, ordered=only is None or "ord" in only)
    return json_walk.walk(df, doc_id, json, rows_of, "ord array<int>, path string, content string, node_type string", only)


def text_nodes(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Paragraphs; a text of one paragraph is split into sentences."""
    cleaned = lambda parts: F.filter(F.transform(parts, lambda p: strip(p)), lambda p: p != "")
    paras = staged(df.select(doc_id, text), _paras=cleaned(F.split(strip(text), "\n\n")))
    one = F.size("_paras") == 1
    parts = staged(paras, _one=one, _parts=F.when(
        one, cleaned(F.split(F.get("_paras", F.lit(0)), C.SENTENCE_END))).otherwise(F.col("_paras")))
    kind = F.when(F.col("_one"), "sentence").otherwise("paragraph")
    return parts.select(doc_id, kind.alias("node_type"), F.posexplode("_parts").alias("ord", "content")).select(
        doc_id, "ord", F.concat_ws("_", "node_type", "ord").alias("path"), "content", "node_type")


def markdown_nodes(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Headings, code blocks and paragraphs in order, with level, language and current heading."""
    marked = F.regexp_replace(strip(text), unix(r"(?m)^(#{1,6}\s+.+)$"), f"{MARK}$1{MARK}")
    sections = F.filter(F.transform(F.split(marked, MARK), lambda s: strip(s)), lambda s: s != "")
    parts = df.select(doc_id, F.posexplode(sections).alias("_s", "_part"))
    part = F.col("_part")
    is_head = part.rlike(r"\A#{1,6}\s+[^\n]+\z")
    empty = F.lit(None).cast("string")
    node = lambda kind, content, level, lang: F.struct(
        F.lit(kind).alias("node_type"), content.alias("content"), level.alias("level"), lang.alias("language"))
    heading = F.array(node("heading", F.regexp_extract(part, r"\A#{1,6}\s+(.+)", 1),
                           F.length(F.regexp_extract(part, r"\A(#{1,6})", 1)), empty))
    fences = F.arrays_zip(F.regexp_extract_all(part, F.lit(C.MD_NODE_FENCE), F.lit(1)).alias("lang"),
                          F.regexp_extract_all(part, F.lit(C.MD_NODE_FENCE), F.lit(2)).alias("code"))
    blocks = F.transform(fences, lambda f: node(
        "code_block", strip(f["code"]), F.lit(None).cast("int"),
        F.when(f["lang"] == "", "text").otherwise(f["lang"])))
    rest = strip(F.regexp_replace(part, r"(?s)```.*?```", ""))
    paras = F.transform(F.filter(F.transform(F.split(rest, "\n\n"), lambda p: strip(p)), lambda p: p != ""),
                        lambda p: node("paragraph", p, F.lit(None).cast("int"), empty))
    inside = parts.select(doc_id, "_s", F.posexplode(F.when(is_head, heading).otherwise(F.concat(blocks, paras))).alias("_i", "_n"))
    along = Window.partitionBy(doc_id).orderBy("_s", "_i")                  # the nodes of one document
    sofar = along.rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("_n.node_type") == "heading"
    numbered = (inside.withColumn("ord", F.row_number().over(along) - 1)
                .withColumn("_h", F.sum(head.cast("int")).over(sofar) - 1)
                .withColumn("heading", F.last(F.when(head, F.col("_n.content")), ignorenulls=True).over(sofar)))
    return numbered.select(
        doc_id, "ord", F.concat_ws("_", "_n.node_type", F.when(head, F.col("_h")).otherwise(F.col("ord"))).alias("path"),
        F.col("_n.content").alias("content"), F.col("_n.node_type").alias("node_type"), "heading",
        F.col("_n.level").alias("level"), F.col("_n.language").alias("language"))


def csv_nodes(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row node per record, keyed by the first record; missing cells are null, quoted cells may hold commas and line
    breaks, and of repeated columns the last one counts."""
    split = staged(df.select(doc_id, text), _rows=csv_rows(strip(text), F.lit(",")))
    headed = staged(split, _head=F.get("_rows", F.lit(0)))
    rows = headed.select(doc_id, "_head", F.posexplode(F.expr("slice(_rows, 2, size(_rows))")).alias("ord", "_row"))
    pairs = F.transform(F.array_distinct("_head"), lambda h: F.struct(h.alias("k"), F.get(F.col("_row"), last_index("_head", h)).alias("v")))
    return rows.select(doc_id, "ord", F.concat(F.lit("row_"), F.col("ord").cast("string")).alias("path"),
                       F.to_json(F.map_from_entries(pairs), {"ignoreNullFields": "false"}).alias("content"),
                       F.lit("row").alias("node_type"))


def node_format(payload: str | Column, hint: str | Column | None = None) -> Column:
    """Format for node splitting: json, yaml, csv, markdown, text in that order."""
    c = col(payload)
    h = F.lit(None).cast("string") if hint is None else col(hint)
    hinted = lambda name: F.coalesce(h == name, F.lit(False))
    body = strip(c)
    yaml_like = (~body.startswith("{") & ~(c.contains(",") & c.contains("\n")) & (c.contains(":") | c.contains("-"))
                 & c.rlike(unix(r"(?m)\A\s*(?:[\w-]+:(\s|$)|-\s+\S)"))
                 & ~c.rlike(unix(r"(?m)^(?!\s*$)(?!\s*[\w-]+:(\s|$))(?!\s*-\s)(?!\s*#)")))
    csv = body.contains("\n") & c.contains(",")
    markdown = c.rlike(unix(r"(?m)^#{1,6}\s")) | c.contains("```") | c.rlike(unix(r"(?m)^\*|\d+\."))
    return (F.when(F.try_parse_json(c).isNotNull(), "json").when(hinted("yaml") | yaml_like, "yaml")
            .when(hinted("csv") | csv, "csv").when(hinted("markdown") | markdown, "markdown").otherwise("text"))


def to_nodes(df: DataFrame, doc_id: str, payload: str, hint: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes of all documents, dead letters): each document goes to the splitter of its format."""
    routed = staged(df, format=node_format(payload, hint))
    columns = [doc_id, "format", "ord", "path", "content", "node_type"]

    def part(name: str, split) -> DataFrame:
        nodes = split(routed.filter(F.col("format") == name), doc_id, payload).withColumn("format", F.lit(name))
        ord_ = F.col("ord") if name == "json" else F.array("ord")
        return nodes.withColumn("ord", ord_.cast("array<int>")).select(columns)

    nodes = (part("json", json_nodes).unionByName(part("csv", csv_nodes))
             .unionByName(part("markdown", markdown_nodes)).unionByName(part("text", text_nodes)))
    return nodes, routed.filter(F.col("format") == "yaml").select(doc_id, "format")


def node_key(data_key: str | Column, path: str | Column) -> Column:
    p = col(path)
    return F.when(F.coalesce(p, F.lit("")) == "", col(data_key)).otherwise(F.concat(col(data_key), F.lit("."), p))


def node_text(path: str | Column, content_json: str | Column, node_type: str | Column) -> Column:
    """Searchable text: words of the path, then ``k: v`` pairs (objects) or the plain content."""
    words = F.array_join(F.filter(F.split(F.translate(col(path), "[]", "."), r"\."),
                                  lambda w: (w != "") & ~w.rlike(r"^\d+$")), " ")
    pairs = F.array_join(F.transform(F.map_entries(F.from_json(col(content_json), "map<string,string>")),
                                     lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("None")))), " | ")
    body = F.when(col(node_type).isin("object", "row"), pairs).otherwise(col(content_json))
    both = F.array(F.struct(words.alias("words"), body.alias("body")))       # each is evaluated once, though used twice
    return F.get(F.transform(both, lambda x: F.when(x["words"] == "", x["body"]).otherwise(
        F.concat_ws(" | ", x["words"], x["body"]))), F.lit(0))


def embedding_text(data_key: str | Column, norm_json: str | Column, structured: str | Column) -> Column:
    """Text that is embedded for a data key: its fields without metadata, or its content, cut to
    a fixed number of characters."""
    key, m = col(data_key), F.from_json(col(norm_json), "map<string,string>")
    kept = F.map_filter(m, lambda k, v: ~k.startswith("_") & ~k.isin(C.EMBEDDING_DROPPED_FIELDS))
    fields = F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat(
        e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("None")))), " | ")
    short = F.when(key.contains("[") | key.contains("."), F.element_at(F.split(F.element_at(
        F.split(key, r"\["), 1), r"\."), -1)).otherwise(key)
    cut = clip(fields, C.EMBEDDING_TEXT_CHARS)
    content = clip(F.coalesce(F.element_at(m, "content"), F.lit("")), C.EMBEDDING_TEXT_CHARS)
    return (F.when(col(structured) & (short != "") & (short != key), F.concat(cut, F.lit(" ("), short, F.lit(")")))
            .when(col(structured), F.concat(key, F.lit(": "), cut))
            .otherwise(F.concat(key, F.lit(": "), content)))


# --------------------------------------------------------------------------- back to documents
def _in_order(*cols: Column) -> Column:
    return F.array_sort(F.collect_list(F.struct(*cols)))


def reassemble_text(nodes: DataFrame, doc_id: str) -> DataFrame:
    """Sentences joined by a space, paragraphs by a blank line. One row per document again."""
    return (nodes.groupBy(doc_id).agg(_in_order(F.col("ord"), F.col("content")).alias("_n"),
                                      F.max(F.col("node_type") == "paragraph").alias("_p"))
            .select(doc_id, F.array_join(F.transform("_n", lambda n: n["content"]),
                                         "\x00").alias("_t"), "_p")
            .select(doc_id, F.replace("_t", F.lit("\x00"), F.when(F.col("_p"), "\n\n").otherwise(" ")).alias("text")))


def reassemble_markdown(nodes: DataFrame, doc_id: str) -> DataFrame:
    piece = (F.when(F.col("node_type") == "heading", F.concat(F.lit("\n"), F.repeat(F.lit("#"), F.col("level")),
                                                              F.lit(" "), "content", F.lit("\n")))
             .when(F.col("node_type") == "code_block", F.concat(F.lit("\n```"), "language", F.lit("\n"), "content",
                                                                F.lit("\n```\n")))
             .otherwise(F.concat(F.lit("\n"), "content", F.lit("\n"))))
    return (nodes.groupBy(doc_id).agg(_in_order(F.col("ord"), piece.alias("t")).alias("_n"))
            .select(doc_id, strip(F.array_join(F.transform("_n", lambda n: n["t"]), "")).alias("text")))


def reassemble_csv(nodes: DataFrame, doc_id: str) -> DataFrame:
    """Header = sorted union of the keys of all row nodes of the document."""
    rows = nodes.select(doc_id, "ord", F.from_json("content", "map<string,string>").alias("_m"))
    head = rows.groupBy(doc_id).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys("_m"))))).alias("_h"),
                                    _in_order(F.col("ord"), F.map_entries("_m").alias("m")).alias("_r"))
    quoted = lambda x: F.when(x.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    line = lambda r: F.array_join(F.transform("_h", lambda h: F.coalesce(
        quoted(F.element_at(F.map_from_entries(r["m"]), h)), F.lit(""))), ",")
    return head.select(doc_id, F.concat(F.array_join("_h", ","), F.lit("\n"),
                                        F.array_join(F.transform("_r", line), "\n")).alias("text"))


def reassemble_json(nodes: DataFrame, doc_id: str) -> DataFrame:
    """One JSON object per document, keyed by node path in node order."""
    listed = F.to_json(F.array("path"))                                                  # ["quoted and escaped"]
    name = F.substr(listed, F.lit(2), F.length(listed) - 2)
    fields = nodes.select(doc_id, "ord", F.concat(name, F.lit(":"), "content").alias("_f"))
    return (fields.repartition(doc_id).groupBy(doc_id).agg(_in_order(F.col("ord"), F.col("_f")).alias("_n"))
            .select(doc_id, F.concat(F.lit("{"), F.array_join(F.col("_n._f"), ","), F.lit("}")).alias("json")))


def explode_json(docs: DataFrame, doc_id: str) -> DataFrame:
    """(doc, path, content) of documents built by reassemble_json."""
    return json_walk.walk(docs, doc_id, "json", json_walk.field_rows, "path string, content string")
