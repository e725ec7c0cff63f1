"""Mixed-format payloads: detection, normalization, typed records, bundles and stored nodes."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import constants as C
from ..functions import json_walk
from ..functions.text import blank_to_null, col, found, matches, matches_any, staged, strip
from ..functions.variant import explode_level, is_array, is_empty, is_object, is_object_array
from .eventlog import append_events

DELIMITERS = [",", "\t", ";", "|"]


# --------------------------------------------------------------------------- format detection
@dataclass(frozen=True)
class FormatRule:
    """A format: its place in the order and the condition on (payload, hint)."""

    name: str
    priority: int
    applies: object                       # callable (Column, Column) -> Column


def _lines(c: Column) -> Column:
    return F.filter(F.split(strip(c), r"\r?\n"), lambda l: F.trim(l) != "")


def _consistent(c: Column, delimiter: str) -> Column:
    """At least 70 % of the lines have the same number of fields, two or more. A value with that
    share is the middle one of the sorted counts."""
    lines = _lines(c)
    fields = F.transform(lines, lambda l: F.length(l) - F.length(F.replace(l, F.lit(delimiter), F.lit(""))) + 1)
    n = F.size(lines)
    usual = F.get(F.array_sort(fields), F.floor(n / 2).cast("int"))
    return ((n - F.size(F.array_remove(fields, usual))) / n >= C.CSV_CONSISTENT_SHARE) & (usual >= 2)


def csv_delimiter(c: str | Column) -> Column:
    """First delimiter with consistent field counts, else null."""
    c = col(c)
    return F.coalesce(*[F.when(_consistent(c, d), F.lit(d)) for d in DELIMITERS])


def _json(c: Column, hint: Column) -> Column:
    return is_object(F.try_parse_json(c))


def _yaml(c: Column, hint: Column) -> Column:
    dots = F.length(c) - F.length(F.replace(c, F.lit("."), F.lit("")))
    prose = reduce(lambda a, b: a & b, [c.rlike(p) for p in C.PROSE_PATTERNS])
    return ~((dots >= 2) & prose) & matches_any(c, C.YAML_PATTERNS)


def _toml(c: Column, hint: Column) -> Column:
    line = r"^\s*(\[[^\]]+\]|#.*|[\w.\x22-]+\s*=\s*\S.*)$"
    lines = _lines(c)
    return (F.size(lines) > 0) & F.forall(lines, lambda l: l.rlike(line)) & c.contains("=")


def _xml(c: Column, hint: Column) -> Column:
    body = strip(c)
    root = F.regexp_extract(body, r"^(?:<\?xml[^>]*\?>\s*)?<([A-Za-z_][\w.-]*)", 1)
    return (root != "") & body.endswith(F.concat(F.lit("</"), root, F.lit(">")))


def _csv(c: Column, hint: Column) -> Column:
    return (~matches_any(c, C.CSV_REJECT_PATTERNS) & (F.size(_lines(c)) >= 2)
            & csv_delimiter(c).isNotNull())


DEFAULT_FORMATS = [
    FormatRule("json", C.FORMAT_PRIORITY["json"], _json),
    FormatRule("yaml", C.FORMAT_PRIORITY["yaml"], _yaml),
    FormatRule("toml", C.FORMAT_PRIORITY["toml"], _toml),
    FormatRule("xml", C.FORMAT_PRIORITY["xml"], _xml),
    FormatRule("csv", C.FORMAT_PRIORITY["csv"], _csv),
    FormatRule("markdown", C.FORMAT_PRIORITY["markdown"], lambda c, h: matches_any(c, C.MARKDOWN_PATTERNS)),
    FormatRule("code", C.FORMAT_PRIORITY["code"], lambda c, h: matches_any(c, C.CODE_PATTERNS)),
]
# a hint cannot make a payload valid, so these formats are accepted on their content only
CONTENT_ONLY = {"json", "xml"}


def detect_format(df: DataFrame, payload: str, hint: str | None = None,
                  formats: Sequence[FormatRule] = DEFAULT_FORMATS, out: str = "format") -> DataFrame:
    """Add the format of each payload: the first rule in priority order whose content test or
    hint holds. Add a FormatRule to ``formats`` to plug in another one."""
    c = F.col(payload)
    h = F.col(hint) if hint else F.lit(None).cast("string")
    chain = None
    for rule in sorted(formats, key=lambda r: r.priority):
        test = F.coalesce(rule.applies(c, h), F.lit(False))
        if rule.name not in CONTENT_ONLY:
            test = test | F.coalesce(h.isin(C.FORMAT_HINTS.get(rule.name, [rule.name])), F.lit(False))
        chain = F.when(test, rule.name) if chain is None else chain.when(test, rule.name)
    return df.withColumn(out, chain.otherwise("text"))


def format_shares(detected: DataFrame, by: str) -> DataFrame:
    return detected.groupBy(by, "format").agg(F.count(F.lit(1)).alias("payloads"))


# --------------------------------------------------------------------------- csv
def _infer(values: Column) -> Column:
    """Column type from its values: int, float, bool, else string (all blank: string)."""
    given = F.filter(values, lambda v: v != "")
    return (F.when(F.size(given) == 0, "string")
            .when(F.forall(given, lambda v: v.rlike(r"^[+-]?\d+$")), "int")
            .when(F.forall(given, lambda v: v.try_cast("double").isNotNull()), "float")
            .when(F.forall(given, lambda v: F.lower(v).isin(C.BOOL_WORDS)), "bool")
            .otherwise("string"))


@lru_cache
def _field(delimiter: str) -> re.Pattern:
    """A quoted or bare field and what ends it; a quote that is never closed is a plain character."""
    d = re.escape(delimiter)
    return re.compile(rf'(?:"((?:[^"]|"")*+)"([^{d}\n]*+)|([^{d}\n]*+))({d}|\n|\Z)')


def split_csv(text: str, delimiter: str) -> list[list[str]]:
    """Fields of each record; quoted ones may hold delimiters, line breaks and doubled quotes. Blank lines are no records."""
    rows, row, at, match = [], [], 0, _field(delimiter).match
    while True:
        found = match(text, at)
        quoted, rest, plain, end = found.groups()
        value = plain if quoted is None else quoted.replace('""', '"') + rest
        if end == "\n" and (plain or rest or "").endswith("\r"):
            value = value[:-1]
        row.append(value)
        at = found.end()
        if end == delimiter:
            continue
        if len(row) > 1 or quoted is not None or value.strip(" "):
            rows.append(row)
        row = []
        if not end:
            return rows


@F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
def csv_rows(texts: pa.Array, delimiters: pa.Array) -> pa.Array:
    rows = [None if t is None else split_csv(t, d) for t, d in zip(texts.to_pylist(), delimiters.to_pylist(), strict=True)]
    return pa.array(rows, pa.list_(pa.list_(pa.string())))


def csv_tables(df: DataFrame, text: str) -> DataFrame:
    """Add header, rows (ragged ones dropped) and types of the CSV/TSV text of each row; all inside
    the row, no shuffle."""
    raw = staged(staged(df, _d=F.coalesce(csv_delimiter(text), F.lit(","))),
                 _raw=csv_rows(strip(F.col(text)), F.col("_d")))
    split = staged(raw, _rows=F.transform("_raw", lambda r: F.transform(r, lambda x: F.trim(x))))
    first = F.get("_rows", F.lit(0))
    headed = staged(split, _headed=(F.size("_rows") > 1) & ~F.exists(
        first, lambda x: x.try_cast("double").isNotNull()))
    shaped = staged(headed, header=F.when(F.col("_headed"), first).otherwise(
        F.transform(first, lambda x, i: F.concat(F.lit("col_"), i.cast("string")))))
    shaped = staged(shaped, _width=F.size("header"))
    shaped = staged(shaped, rows=F.filter(
        F.when(F.col("_headed"), F.expr("slice(_rows, 2, size(_rows))")).otherwise(F.col("_rows")),
        lambda r: F.size(r) == F.col("_width")))
    shaped = staged(shaped, _sample=F.slice("rows", 1, C.CSV_SAMPLE_ROWS))
    return (staged(shaped, types=F.transform("header", lambda h, i: _infer(F.transform("_sample", lambda r: r[i]))))
            .drop("_d", "_raw", "_rows", "_headed", "_width", "_sample"))


def last_index(names: str | Column, name: Column) -> Column:
    """0-based place of the last occurrence of ``name``: of repeated columns the last one counts."""
    names = col(names)
    return F.size(names) - F.array_position(F.reverse(names), name).cast("int")


def _quoted(value: Column) -> Column:
    """JSON text of a string."""
    whole = F.to_json(F.struct(value.alias("v")))
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def _typed_json(value: Column, kind: Column) -> Column:
    """JSON text of a cell by the type of its column: blank is null, what doesn't convert stays a string."""
    number = F.to_json(F.struct(value.try_cast("double").alias("v")))
    typed = (F.when(kind == "int", value.try_cast("decimal(38,0)").cast("string"))
             .when((kind == "float") & value.try_cast("double").isNotNull(), F.substr(number, F.lit(6), F.length(number) - 6))
             .when(kind == "bool", F.lower(value).isin(C.TRUE_WORDS).cast("string")))
    return F.when(blank_to_null(value).isNull(), "null").otherwise(F.coalesce(typed, _quoted(value)))


def csv_json(header: str, rows: str, types: str) -> Column:
    """JSON text of a table: typed records, schema and counts."""
    names = F.array_distinct(header)
    pair = lambda n, v: F.concat(_quoted(n), F.lit(":"), v)
    record = lambda r: F.concat(F.lit("{"), F.array_join(F.transform(names, lambda n: pair(
        n, _typed_json(F.get(r, last_index(header, n)), F.get(F.col(types), last_index(header, n))))), ","), F.lit("}"))
    schema = F.array_join(F.transform(names, lambda n: pair(n, _quoted(F.get(F.col(types), last_index(header, n))))), ",")
    return F.concat(F.lit('{"records":['), F.array_join(F.transform(rows, record), ","), F.lit('],"schema":{'), schema,
                    F.lit('},"row_count":'), F.size(rows).cast("string"), F.lit(',"column_count":'), F.size(header).cast("string"), F.lit("}"))


def csv_records(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per cell: raw value (null when blank), column type and the typed value."""
    tables = csv_tables(df.select(doc_id, text), text)
    rows = tables.select(doc_id, "header", "types", F.posexplode("rows").alias("row_no", "_row"))
    cells = rows.select(doc_id, "row_no", F.posexplode(F.arrays_zip(
        F.col("header").alias("name"), F.col("types").alias("type"), F.col("_row").alias("value"))).alias("_i", "_c"))
    value = blank_to_null(F.col("_c.value"))
    kind = F.col("_c.type")
    return cells.select(
        doc_id, F.col("row_no").cast("bigint").alias("row_no"), F.col("_c.name").alias("column"),
        kind.alias("type"), value.alias("value"),
        F.when(kind == "int", value.try_cast("bigint")).alias("int_value"),
        F.when(kind == "float", value.try_cast("double")).alias("float_value"),
        F.when(kind == "bool", F.lower(value).isin(C.TRUE_WORDS)).alias("bool_value"))


# --------------------------------------------------------------------------- xml
def xml_records(df: DataFrame, text: str, schema: str, keep: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Typed rows of XML text and, apart, the rows that do not parse."""
    ddl = schema + ", _corrupt_record STRING"
    parsed = df.select(*keep, text, F.from_xml(F.col(text), ddl, {"mode": "PERMISSIVE"}).alias("_x"))
    bad = F.col("_x").isNull() | F.col("_x._corrupt_record").isNotNull()
    good = parsed.filter(~bad).select(*keep, "_x.*").drop("_corrupt_record")
    return good, parsed.filter(bad).select(*keep, text)


# --------------------------------------------------------------------------- markdown and code
def markdown_structure(df: DataFrame, text: str) -> DataFrame:
    """Add headings, links, code_blocks, item counts, title and summary."""
    c = F.col(text)
    lines = F.transform(F.split(c, "\n"), lambda l: strip(l))
    heads = F.transform(
        F.filter(lines, lambda l: l.rlike(C.MD_HEADING)),
        lambda l: F.struct(F.length(F.regexp_extract(l, C.MD_HEADING, 1)).alias("level"),
                           F.regexp_extract(l, C.MD_HEADING, 2).alias("text")))
    links = F.transform(F.arrays_zip(found(c, C.MD_LINK, 1).alias("text"), found(c, C.MD_LINK, 2).alias("url")),
                        lambda x: x)
    blocks = F.transform(
        F.arrays_zip(found(c, C.MD_FENCE, 1).alias("language"), found(c, C.MD_FENCE, 2).alias("code")),
        lambda x: F.struct(F.when(x["language"] == "", "text").otherwise(x["language"]).alias("language"),
                           x["code"].alias("code")))
    paragraphs = F.filter(F.transform(F.split(c, r"\n\n+"), lambda p: strip(p)), lambda p: p != "")
    first = F.when(F.get(paragraphs, F.lit(0)).startswith("#"), 1).otherwise(0)
    return (df.withColumn("headings", heads).withColumn("links", links).withColumn("code_blocks", blocks)
            .withColumn("unordered_items", matches(c, C.MD_BULLET))
            .withColumn("ordered_items", matches(c, C.MD_ORDERED))
            .withColumn("title", F.coalesce(F.get("headings", F.lit(0))["text"],
                                            F.substring(F.get(F.split(c, "\n"), F.lit(0)), 1, C.MD_TITLE_CHARS)))
            .withColumn("summary", F.substring(F.get(paragraphs, first), 1, C.MD_SUMMARY_CHARS))
            .withColumn("heading_count", F.size("headings").cast("bigint"))
            .withColumn("link_count", F.size("links").cast("bigint"))
            .withColumn("code_block_count", F.size("code_blocks").cast("bigint")))


def _marks(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [c.contains(w).cast("int") for w in words])


def code_language(c: str | Column) -> Column:
    c = col(c)
    python, js = _marks(c, C.PYTHON_MARKS), _marks(c, C.JS_MARKS)
    return (F.when(python > js, "python")
            .when((js > 0) & (c.contains("interface ") | c.contains(": ")), "typescript")
            .when(js > 0, "javascript").otherwise("unknown"))


def code_structure(df: DataFrame, text: str) -> DataFrame:
    """Add language, functions, classes, imports, decorators, exports and line counts."""
    c = F.col(text)
    py, js = F.col("language") == "python", F.col("language").isin("javascript", "typescript")
    empty = F.array().cast("array<string>")
    struct3 = "array<struct<name:string,params:string,kind_or_return:string>>"
    py_functions = F.transform(
        F.arrays_zip(found(c, C.PY_FUNCTION, 1).alias("a"), found(c, C.PY_FUNCTION, 2).alias("b"),
                     found(c, C.PY_FUNCTION, 3).alias("c")),
        lambda x: F.struct(x["a"].alias("name"), strip(x["b"]).alias("params"),
                           blank_to_null(x["c"]).alias("kind_or_return")))
    js_functions = F.concat(
        F.transform(found(c, C.JS_FUNCTION, 1), lambda n: F.struct(
            n.alias("name"), F.lit(None).cast("string").alias("params"), F.lit("function").alias("kind_or_return"))),
        F.transform(found(c, C.JS_ARROW, 1), lambda n: F.struct(
            n.alias("name"), F.lit(None).cast("string").alias("params"), F.lit("arrow").alias("kind_or_return"))))

    def pairs(pattern: str) -> Column:
        return F.transform(F.arrays_zip(found(c, pattern, 1).alias("a"), found(c, pattern, 2).alias("b")),
                           lambda x: F.struct(x["a"].alias("name"), blank_to_null(x["b"]).alias("base")))
    py_imports = F.concat(
        F.flatten(F.transform(found(c, C.PY_IMPORT, 1), lambda s: F.transform(F.split(s, ","), lambda x: strip(x)))),
        found(c, C.PY_FROM, 1))
    js_imports = F.concat(found(c, C.JS_IMPORT, 1), found(c, C.JS_REQUIRE, 1))
    lines = F.split(c, "\n")
    is_comment = lambda l: reduce(lambda a, b: a | b, [strip(l).startswith(m) for m in C.COMMENT_MARKS])
    return (df.withColumn("language", code_language(c))
            .withColumn("functions", F.when(py, py_functions).when(js, js_functions).otherwise(
                F.array().cast(struct3)))
            .withColumn("classes", F.when(py, pairs(C.PY_CLASS)).when(js, pairs(C.JS_CLASS)).otherwise(
                F.array().cast("array<struct<name:string,base:string>>")))
            .withColumn("imports", F.array_sort(F.array_distinct(
                F.when(py, py_imports).when(js, js_imports).otherwise(empty))))
            .withColumn("decorators", F.array_sort(F.array_distinct(
                F.when(py, found(c, C.PY_DECORATOR, 1)).otherwise(empty))))
            .withColumn("exports", F.when(js, found(c, C.JS_EXPORT, 1)).otherwise(empty))
            .withColumn("line_count", F.size(lines).cast("bigint"))
            .withColumn("non_empty_lines", F.size(F.filter(lines, lambda l: strip(l) != "")).cast("bigint"))
            .withColumn("comment_lines", F.size(F.filter(lines, is_comment)).cast("bigint")))


# --------------------------------------------------------------------------- normalization
def normalize(df: DataFrame, doc_id: str, payload: str, hint: str | None = None,
              xml_schema: str | None = None,
              formats: Sequence[FormatRule] = DEFAULT_FORMATS) -> tuple[DataFrame, DataFrame]:
    """(norm_json, format, is_structured) for every payload with a job for its format; the rest
    (formats without a job, XML that does not parse) goes to the second, dead-letter table."""
    source = df.select(doc_id, payload, *([hint] if hint else []))
    found_ = detect_format(source, payload, hint, formats, "_format").drop(*([hint] if hint else []))
    detected = staged(found_, format=F.col("_format")).drop("_format")
    c = F.col(payload)
    is_ = lambda name: F.col("format") == name
    rows = csv_tables(detected.withColumn("_csv", F.when(is_("csv"), c)), "_csv")
    rows = rows.withColumn("_xml", F.from_xml(
        F.when(is_("xml"), c), (xml_schema or "_none STRING") + ", _corrupt_record STRING", {"mode": "PERMISSIVE"}))
    xml_ok = F.col("_xml").isNotNull() & F.col("_xml._corrupt_record").isNull() & F.lit(xml_schema is not None)
    text = lambda kind, *more: F.to_json(F.struct(c.alias("content"), F.lit(kind).alias("content_type"), *more))
    md = markdown_structure(rows.withColumn("_md", F.when(is_("markdown"), c)), "_md")
    norm = (F.when(is_("json"), F.to_json(F.try_parse_json(c)))
            .when(is_("csv"), csv_json("header", "rows", "types"))
            .when(is_("xml") & xml_ok, F.to_json(F.col("_xml").dropFields("_corrupt_record")))
            .when(is_("markdown"), text("markdown", "title", "summary", "heading_count", "link_count",
                                        "code_block_count"))
            .when(is_("code"), text("code", code_language(c).alias("language")))
            .when(is_("text"), text("text")))
    done = md.select(doc_id, "format", is_structured(F.col("format")).alias("is_structured"), norm.alias("norm_json"))
    return (done.filter(F.col("norm_json").isNotNull()),
            done.filter(F.col("norm_json").isNull()).select(doc_id, "format"))


def is_structured(fmt: Column) -> Column:
    return fmt.isin("json", "csv", "xml")


# --------------------------------------------------------------------------- paths of JSON objects
def flatten_json(df: DataFrame, doc_id: str, json: str) -> DataFrame:
    """(doc, path, value): dotted leaf paths, to any depth; an array of objects is one leaf ``path[*]`` = 'array'."""
    return json_walk.walk(df, doc_id, json, json_walk.leaf_rows, "path string, value string")


def field_paths(df: DataFrame, doc_id: str, json: str, max_depth: int = C.MAX_FIELD_DEPTH,
                reserved: Sequence[str] = tuple(C.RESERVED_FIELDS)) -> DataFrame:
    """(doc, path): field names with ``[]`` on object arrays; ``_``/``@`` and reserved names are
    skipped with everything below them, as is everything below ``max_depth``."""
    cur = df.select(doc_id, F.try_parse_json(json).alias("_v"), F.lit(None).cast("string").alias("path"))
    for _ in range(max_depth):
        opened = F.when(is_object(F.col("_v")) & (~is_empty(F.col("_v")) | F.col("path").isNull()), F.col("_v"))
        step = explode_level(cur, opened)
        child = F.col("_open").isNotNull() & F.col("_pos").isNotNull()
        name = F.col("_key")
        skip = child & (name.startswith("_") | name.startswith("@") | name.isin(list(reserved)))
        cur = step.filter(~F.coalesce(skip, F.lit(False))).select(
            doc_id,
            F.when(child, F.col("_value")).when(F.col("_open").isNull(), F.col("_v")).alias("_v"),
            F.when(child, F.concat_ws(".", "path", "_key")).otherwise(F.col("path")).alias("path"))
    deeper = is_object(F.col("_v")) & ~is_empty(F.col("_v"))
    return (cur.filter(F.col("path").isNotNull() & ~deeper)
            .select(doc_id, F.when(is_object_array(F.col("_v")), F.concat("path", F.lit("[]")))
                    .otherwise(F.col("path")).alias("path")))


def describe_fields(paths: DataFrame, doc_id: str, key: Column, first: int = C.DESCRIPTION_FIELDS) -> DataFrame:
    """``key with fields: a, b, ...`` with the first paths by name (the fields of one document)."""
    return (paths.groupBy(doc_id).agg(F.array_sort(F.collect_list("path")).alias("_p"))
            .select(doc_id, F.concat(key, F.lit(" with fields: "),
                                     F.array_join(F.slice("_p", 1, first), ", ")).alias("description")))


# --------------------------------------------------------------------------- export and import
def export_project(log: DataFrame, nodes: DataFrame, agents: DataFrame,
                   sections: Sequence[str] = ("events", "embeddings", "agents")) -> DataFrame:
    """Bundle rows (project_id, section, version, key, json); vectors are left out."""
    parts = {
        "events": log.select("project_id", F.col("sequence").cast("string").alias("key"), F.to_json(F.struct(
            F.col("sequence").alias("event_id"), "event_type", F.try_parse_json("data").alias("data"))).alias("json")),
        "embeddings": nodes.select("project_id", F.col("node_key").alias("key"), F.to_json(F.struct(
            "data_key", "node_key", "node_path", "node_type")).alias("json")),
        "agents": agents.select("project_id", F.col("agent_id").alias("key"), F.to_json(F.struct(
            "agent_id", "last_sequence", "notification_method")).alias("json")),
    }
    rows = [parts[s].withColumn("section", F.lit(s)) for s in sections]
    return reduce(DataFrame.unionByName, rows).withColumn("version", F.lit(C.EXPORT_VERSION))


def validate_bundle(df: DataFrame, bundle_id: str, bundle: str) -> DataFrame:
    """(bundle_id, valid, errors, warnings) of import bundles given as JSON text."""
    b = F.col("_b")

    def has(field: str) -> Column:
        return F.array_contains(F.json_object_keys(F.col("_t")), field)

    def section(name: str) -> Column:
        return F.try_variant_get(b, f"$.data.{name}", "variant")

    def listed(name: str) -> Column:
        return F.when(section(name).isNotNull() & ~is_array(section(name)), F.lit(f"'{name}' must be a list"))

    events = F.coalesce(F.try_variant_get(b, "$.data.events", "array<variant>"), F.array().cast("array<variant>"))
    lacks = lambda e, f: F.try_variant_get(e, f"$.{f}", "variant").isNull()
    per_event = F.flatten(F.transform(events, lambda e, i: F.array(
        F.when(lacks(e, "event_id"), F.concat(F.lit("Event "), i.cast("string"), F.lit(" missing event_id"))),
        F.when(lacks(e, "data"), F.concat(F.lit("Event "), i.cast("string"), F.lit(" missing data"))))))
    is_dict = is_object(F.try_variant_get(b, "$.data", "variant"))
    inside = F.concat(F.array(listed("events")), per_event, F.array(listed("embeddings")), F.array(listed("agents")))
    errors = F.concat(
        F.array(F.when(~has("project_id"), F.lit("Missing required field: project_id")),
                F.when(~has("data"), F.lit("Missing required field: data")),
                F.when(has("data") & ~is_dict, F.lit("'data' field must be a dictionary"))),
        F.when(is_dict, inside).otherwise(F.array().cast("array<string>")))
    parsed = df.select(bundle_id, F.try_parse_json(bundle).alias("_b"), F.col(bundle).alias("_t"))
    broken = ~is_object(b)
    return (parsed
            .withColumn("errors", F.when(broken, F.array(F.lit("Invalid JSON"))).otherwise(
                F.filter(errors, lambda e: e.isNotNull())))
            .withColumn("warnings", F.when(broken, F.array().cast("array<string>")).otherwise(F.filter(
                F.array(F.when(~has("version"), F.lit("Missing version field"))), lambda e: e.isNotNull())))
            .select(bundle_id, (F.size("errors") == 0).alias("valid"), "errors", "warnings"))


def import_events(bundle: DataFrame, log: DataFrame, overwrite: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new events, refused projects). Projects listed in ``overwrite`` start again from 1; other
    projects that already have events are refused; the rest continue their sequence. Bundle order
    is (created_at, id)."""
    existing = log.select("project_id").distinct()
    forced = bundle.join(overwrite, "project_id", "left_semi")
    plain = bundle.join(overwrite, "project_id", "left_anti")
    refused = plain.select("project_id").distinct().join(existing, "project_id", "left_semi")
    new = append_events(plain.join(existing, "project_id", "left_anti"), log)
    return append_events(forced, log, renumber=True).unionByName(new), refused


def import_rows(new: DataFrame, existing: DataFrame, keys: Sequence[str], overwrite: bool = False,
                vector: str | None = None, dim: int = C.EMBEDDING_DIM) -> DataFrame:
    """Rows after an import: absent keys are inserted, present ones kept or overwritten. With
    ``vector`` inserted rows get a zero vector that marks them for embedding."""
    keys = list(keys)
    fresh = new.dropDuplicates(keys)
    if vector:
        fresh = fresh.withColumn(vector, F.array_repeat(F.lit(0.0).cast("float"), dim))
    if overwrite:
        return existing.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)
    return existing.unionByName(fresh.join(existing.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def archive_split(log: DataFrame, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """(older than the cutoff, kept)."""
    return log.filter(F.col("created_at") < cutoff), log.filter(F.col("created_at") >= cutoff)


def audit_trail(log: DataFrame) -> DataFrame:
    return log.select(F.col("created_at").alias("timestamp"), "data_key", F.lit("published").alias("change_type"))


# --------------------------------------------------------------------------- stored nodes
def data_keys(nodes: DataFrame) -> DataFrame:
    return nodes.select("project_id", F.split_part("data_key", F.lit("."), F.lit(1)).alias("data_key")).distinct()


def project_data(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("is_structured", F.col("node_type").isin("object", "row"))


def data_originals(nodes: DataFrame, original: str) -> DataFrame:
    """One original per data key: that of its first node key."""
    return nodes.groupBy("project_id", "data_key").agg(F.min_by(original, "node_key").alias(original))


def upsert_nodes(target: DataFrame, batch: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Newest row per key of target and batch (the batch wins ties); one combinable aggregate."""
    keys = list(keys)
    both = target.withColumn("_src", F.lit(0)).unionByName(batch.withColumn("_src", F.lit(1)))
    rest = [c for c in target.columns if c not in keys]
    newest = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "_src")).alias("_r"))
    return newest.select(*keys, "_r.*")


def clear_project(df: DataFrame, projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows kept, deleted rows per project)."""
    gone = df.join(projects, "project_id", "left_semi").groupBy("project_id").agg(
        F.count(F.lit(1)).alias("deleted"))
    return df.join(projects, "project_id", "left_anti"), gone
