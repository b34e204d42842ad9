"""Nested semi-structured records into related flat tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.operators.batches import by_bytes
from gneiss.operators.json_arrow import flatten

#: The fields whose value is a list whatever form it has.
LIST_FIELDS = (
    "claims", "sources", "spans", "emails", "contact_forms", "exclusion_checks", "reassessment_history",
    "changes", "search_runs", "results", "osm_elements", "hints",
)


def nested_objects(df: DataFrame, id_col: str, json_col: str, list_fields: tuple[str, ...] = LIST_FIELDS, with_json: bool = False) -> DataFrame:
    """Every JSON object that is an element of a list, at any depth, with the way to its parent.

    Output: ``parent_id`` (the value of ``id_col``), ``path``, ``parent_path`` (the nearest
    such object around it, "" if none) and, with ``with_json``, the object's own JSON text.
    Only the two named columns are read, so extra columns and their names don't matter.

    Null, empty, blank and unreadable JSON, and an empty table, give no row. A null id is kept
    as null. Repeated rows give their objects once each. Elements that aren't objects keep their
    position. A lone object in one of ``list_fields`` stands at [0]. A value that is JSON written
    as text counts as what the text says, as often as it is wrapped. Of repeated keys the last counts.

    One pass without a shuffle: memory is bounded by STEP_BYTES of text or one single text.
    """
    fields = tuple(list_fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text"):
                table = _flat(part, fields, with_json)
                yield from table.to_batches(max_chunksize=50_000)

    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).alias("id"), F.col(json_col).alias("text"))
    schema = f"parent_id {kind}, path string, parent_path string" + (", json string" if with_json else "")
    return source.mapInArrow(run, schema)


def _flat(part: pa.RecordBatch, fields: tuple[str, ...], with_json: bool, child: tuple[str, tuple[str, ...]] | None = None) -> pa.Table:
    found = flatten(part.column("text"), np.arange(len(part)), fields, with_json, child)
    out = {
        "parent_id": part.column("id").take(found["row"].combine_chunks()),
        "path": found["path"].cast(pa.string()),
        "parent_path": found["parent_path"].cast(pa.string()),
    }
    if with_json:
        out["json"] = found["json"].cast(pa.string())
    for i in range(len(child[1]) if child else 0):
        out |= {f"v{i}": found[f"v{i}"].cast(pa.string()), f"s{i}": found[f"s{i}"]}
    return pa.table(out)


def last_field(path: Column) -> Column:
    """The name of the list that holds an object: claims for ``a.claims[0]``."""
    return F.regexp_extract(path, r"([^.\[\]]*)(?:\[\d+\])+$", 1)


def _typed(value: Column, text: Column, kind: T.DataType) -> Column:
    """A value cut from JSON as a column: a string takes all but null, a nested type what reads as one, other types only what isn't written as a string."""
    if isinstance(kind, T.StringType):
        return value
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.from_json(F.when(~text, value), kind)
    return F.when(~text, value.try_cast(kind))


def child_table(df: DataFrame, id_col: str, json_col: str, field: str, schema: str, list_fields: tuple[str, ...] = LIST_FIELDS) -> DataFrame:
    """One flat table of the objects in lists named ``field``, with the fields of ``schema`` (DDL) cut from the Arrow buffers.

    Columns: parent_id, path, parent_path, position (in its list) and the fields. Missing fields, nulls and values
    of another type than the column's are null; of repeated keys the last counts. Rows as ``nested_objects`` has them.
    """
    wanted = T.StructType.fromDDL(schema)
    child = (field, tuple(wanted.names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text"):
                yield from _flat(part, tuple(list_fields), False, child).to_batches(max_chunksize=50_000)

    kind = df.schema[id_col].dataType.simpleString()
    raw = "".join(f", v{i} string, s{i} boolean" for i in range(len(wanted)))
    rows = df.select(F.col(id_col).alias("id"), F.col(json_col).alias("text")).mapInArrow(run, f"parent_id {kind}, path string, parent_path string{raw}")
    position = F.regexp_extract("path", r"\[(\d+)\]$", 1).cast("int").alias("position")
    return rows.select("parent_id", "path", "parent_path", position, *[_typed(F.col(f"v{i}"), F.col(f"s{i}"), f.dataType).alias(f.name) for i, f in enumerate(wanted)])
