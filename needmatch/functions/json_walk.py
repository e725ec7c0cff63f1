"""Walks over whole JSON documents in document order, to any depth the parser reads.

VARIANT sorts keys and a chain of generators ends at a fixed level, so these walks run in Arrow batches: one pass, no
shuffle, memory of one document. Of repeated keys the last one counts. A null, a text that isn't JSON (NaN and numbers
beyond a double included) and one nested deeper than the parser's own stack give no rows.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Callable, Collection, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

CHUNK_ROWS = 10_000


def _finite(text: str) -> float:
    if math.isfinite(x := float(text)):
        return x
    raise ValueError(text)


#: Made once: json.loads and json.dumps with options make a new one for every call.
_DECODER = json.JSONDecoder(parse_float=_finite, parse_constant=_finite)
_ENCODER = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"), check_circular=False)      # parsed values have no cycles


def parsed(text: str | None) -> list:
    """[value], or [] where the text has none."""
    try:
        return [] if text is None else [_DECODER.decode(text)]
    except (ValueError, RecursionError):
        return []


#: Encoded strings hold no line break and parsed values no NaN, so these can part values that are encoded in one call.
_LINES = json.JSONEncoder(ensure_ascii=False, separators=("\n", ":"), check_circular=False)
_PART = "\nNaN\n"


def compact(value) -> str:
    return _ENCODER.encode(value)


def compact_all(values: Collection) -> list[str]:
    """``compact`` of each value, by one call of the encoder."""
    if not values:
        return []
    parted = [math.nan] * (2 * len(values) - 1)
    parted[::2] = values
    return [text.replace("\n", ",") for text in _LINES.encode(parted)[1:-1].split(_PART)]


def as_text(value) -> str | None:
    """Scalars as plain text, containers as JSON."""
    return value if value is None or isinstance(value, str) else compact(value)


def starts_with_object(value) -> bool:
    return isinstance(value, list) and bool(value) and isinstance(value[0], dict)


def _utf8(text) -> bytes | None:
    return text.encode("utf-8", "replace") if isinstance(text, str) else text       # lone surrogates


def _strings(values: Sequence[str | None]) -> pa.Array:
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:
        return pa.array(map(_utf8, values), pa.binary()).cast(pa.string())


def _int_lists(values: Sequence[Sequence[int]]) -> pa.Array:
    ends = pa.array([0, *itertools.accumulate(map(len, values))], pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(list(itertools.chain.from_iterable(values)), pa.int32()))


def walk(df: DataFrame, doc_id: str, text: str, rows_of: Callable[[object], Iterable[tuple]], fields: str,
         only: list[str] | None = None) -> DataFrame:
    """(doc, *fields) of the rows that ``rows_of`` gives for each parsed document; ``only`` names the fields to hand over,
    as Spark can't leave out columns of a Python result by itself."""
    source = df.select(F.col(doc_id), F.col(text).cast("string").alias("_json"))
    made = T.StructType.fromDDL(fields)
    places = [i for i, name in enumerate(made.names) if only is None or name in only]
    schema = T.StructType([source.schema[0], *[made[i] for i in places]])
    array_of = {"string": _strings, "array<int>": _int_lists}
    makers = [array_of[made[i].dataType.simpleString()] for i in places]

    def batch_of(ids: pa.Array, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        arrays = [make(columns[i]) for i, make in zip(places, makers, strict=True)]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *arrays], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, raw in enumerate(batch.column(1)):
                for value in parsed(raw.as_py()):
                    rows.extend(rows_of(value))
                    at.extend(itertools.repeat(i, len(rows) - len(at)))
                if len(rows) >= CHUNK_ROWS:
                    for k in range(0, len(rows), CHUNK_ROWS):
                        yield batch_of(batch.column(0), at[k:k + CHUNK_ROWS], rows[k:k + CHUNK_ROWS])
                    at, rows = [], []
            if rows:
                yield batch_of(batch.column(0), at, rows)

    return source.mapInArrow(run, schema)


def _add_nodes(ord_: tuple[int, ...] | None, path: str, value, out: list[tuple]) -> None:
    """(ord, path, value, kind) of node_rows by one call a level, which costs half of a stack of one's own."""
    if isinstance(value, dict):
        opened = False
        for n, (k, x) in enumerate(value.items()):
            if isinstance(x, dict) or (isinstance(x, list) and x and isinstance(x[0], dict)):
                opened = True
                _add_nodes(None if ord_ is None else (*ord_, n), f"{path}.{k}" if path else k, x, out)
        if not opened:
            out.append((ord_, path or "root", value, "object"))
    elif isinstance(value, list):
        for n, x in enumerate(value):
            _add_nodes(None if ord_ is None else (*ord_, n), f"{path}[{n}]", x, out)
    else:
        out.append((ord_, path or "value", value, "primitive"))


def node_rows(root, ordered: bool = True) -> Iterable[tuple]:
    """(ord, path, content, node_type) of leaf objects and primitives, in document order.

    An object that holds an object, or an array beginning with one, is opened: those are walked, its other fields are
    dropped. ``ord`` is the list of positions from the root, left out if not ``ordered``."""
    nodes: list[tuple] = []
    try:
        _add_nodes(() if ordered else None, "", root, nodes)
        if not nodes:
            return nodes
        ords, paths, values, kinds = zip(*nodes, strict=True)
        return zip(ords, paths, compact_all(values), kinds, strict=True)
    except RecursionError:          # more levels than calls may nest, fewer than the parser reads
        return _deep_node_rows(root)


def _deep_node_rows(root) -> Iterator[tuple]:
    todo = [((), "", root)]
    while todo:
        ord_, path, value = todo.pop()
        below = None
        if isinstance(value, list):
            below = [(n, f"{path}[{n}]", x) for n, x in enumerate(value)]
        elif isinstance(value, dict):
            below = [(n, f"{path}.{k}" if path else k, x) for n, (k, x) in enumerate(value.items())
                     if isinstance(x, dict) or starts_with_object(x)]
        if below or isinstance(value, list):
            todo.extend(((*ord_, n), p, x) for n, p, x in reversed(below))
        else:
            kind = "object" if isinstance(value, dict) else "primitive"
            yield ord_, path or ("root" if kind == "object" else "value"), compact(value), kind


def leaf_rows(root) -> Iterator[tuple]:
    """(path, value) of the leaves of an object; an array beginning with an object is one leaf ``path[*]`` = 'array'."""
    todo = [(None, root)] if isinstance(root, dict) else []
    while todo:
        path, value = todo.pop()
        if isinstance(value, dict) and (value or path is None):
            todo.extend((k if path is None else f"{path}.{k}", x) for k, x in reversed(value.items()))
        elif starts_with_object(value):
            yield f"{path}[*]", "array"
        else:
            yield path, as_text(value)


def field_rows(root) -> Iterator[tuple]:
    """(path, content) of the fields of an object, contents as JSON."""
    if isinstance(root, dict):
        yield from zip(root, compact_all(root.values()), strict=True)
