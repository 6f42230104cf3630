"""Nested records to related flat tables, by single-pass tagged emission.

One visit of each record walks it depth first and emits a row per object with
the tag of its table, its primary key (record id and path), the key of its
parent and its own scalar fields as JSON.  The tagged rows are written once,
partitioned by tag; a table is that partition with its schema applied.

Defined results
  * null, empty, non-JSON or truncated payloads are incomplete deliveries: no rows;
  * a leading byte order mark, a payload encoded as a JSON string, an envelope
    with the record under ``data`` and any letter case of keys are accepted;
  * an array may be missing, null, written as a JSON string, or replaced by its
    only element; null or scalar elements emit nothing but keep their position;
  * of several complete deliveries the latest counts (null time is the earliest;
    equal times are settled by version, then payload text); exact copies count once;
  * rows without record id are skipped; further input columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAGGED = "record_id bigint, entity string, node_path string, parent_path string, payload string"

#: entity -> key of its array in the parent, and the entities below it
CHILDREN = {
    "root": (("slides", "slide"), ("qualityissues", "quality_issue")),
    "slide": (("shapes", "shape"),),
    "shape": (("shapes", "shape"),),
    "quality_issue": (),
}

#: schemas applied to the tables on reading
SCHEMAS = {
    "slide": T.StructType([T.StructField("index", T.IntegerType()), T.StructField("layout", T.StringType())]),
    "shape": T.StructType(
        [T.StructField(n, T.StringType()) for n in ("name", "type", "placeholder", "text", "fontname")]
        + [T.StructField("fontsize", T.DoubleType())]
        + [T.StructField(n, T.DoubleType()) for n in ("x", "y", "w", "h")]
    ),
    "quality_issue": T.StructType([T.StructField(n, T.StringType()) for n in ("类别", "具体问题", "证据位置", "为什么构成问题", "最低修改要求", "是否需要真实数据", "模拟数据替代说明", "优先级")]),
}


def _lower(node: dict) -> dict:
    return {k.lower(): v for k, v in node.items()}


def parse_record(payload: str | None) -> dict | None:
    """The record of a payload with lower-case top keys, or None when it isn't complete."""
    if not payload:
        return None
    value: object = payload
    for _ in range(3):
        if not isinstance(value, str):
            break
        try:
            value = json.loads(value.lstrip("\ufeff").strip())
        except (ValueError, RecursionError):
            return None
    if not isinstance(value, dict):
        return None
    record = _lower(value)
    wanted = [key for key, _ in CHILDREN["root"]]
    if isinstance(record.get("data"), dict) and not any(k in record for k in wanted):
        record = _lower(record["data"])
    return record


def _elements(value: object) -> list:
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return []
    if value is None:
        return []
    return value if isinstance(value, list) else [value]


def visit(record: dict) -> Iterator[tuple[str, str, str, dict]]:
    """Depth-first (entity, node_path, parent_path, own fields); an explicit stack bounds recursion."""
    stack: list[tuple[str, str, dict]] = [("root", "", record)]
    while stack:
        entity, path, node = stack.pop()
        if entity != "root":
            parent = path.rpartition(".")[0]
            below = {key for key, _ in CHILDREN[entity]}
            yield entity, path, parent, {k: v for k, v in node.items() if k not in below}
        found = []
        for key, child in CHILDREN[entity]:
            for position, element in enumerate(_elements(node.get(key))):
                if isinstance(element, str) and element[:1] == "{":
                    try:
                        element = json.loads(element)
                    except (ValueError, RecursionError):
                        continue
                if isinstance(element, dict):
                    found.append((child, f"{path}.{position}" if path else str(position), _lower(element)))
        stack.extend(reversed(found))


def latest_complete(raw: DataFrame) -> DataFrame:
    """One complete payload per record id, the latest.

    The JVM's strict parser tells complete payloads; the pick is an aggregate with
    map-side combine, so a record delivered very often isn't gathered in one task.
    """
    text = F.regexp_replace(F.col("payload"), "^\ufeff+", "")
    complete = F.try_parse_json(text).isNotNull() & F.col("record_id").isNotNull()
    version: Column = F.col("tool_version") if "tool_version" in raw.columns else F.lit(None).cast("string")
    at: Column = F.col("received_at") if "received_at" in raw.columns else F.lit(None).cast("timestamp")
    return (
        raw.select("record_id", "payload", at.alias("received_at"), version.alias("tool_version"))
        .filter(complete)
        .groupBy("record_id")
        .agg(F.max(F.struct("received_at", "tool_version", "payload")).alias("last"))
        .select("record_id", F.col("last.payload").alias("payload"))
    )


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record_id", "entity", "node_path", "parent_path", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for rid, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            record = parse_record(payload)
            for entity, path, parent, own in visit(record) if record is not None else ():
                for cell, value in zip(out, (rid, entity, path, parent, json.dumps(own, ensure_ascii=False)), strict=True):
                    cell.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=names)


def tagged_rows(raw: DataFrame) -> DataFrame:
    """All nodes of all records in one pass: columns of ``TAGGED``."""
    return latest_complete(raw).mapInArrow(_emit, TAGGED)


def write_tables(raw: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write the tagged rows once, partitioned by their table's tag."""
    tagged_rows(raw).write.mode(mode).partitionBy("entity").parquet(path)


def read_table(spark, path: str, entity: str) -> DataFrame:
    """One flat table with its schema; keys first, so that parent and child join on (record_id, path)."""
    rows = spark.read.schema(TAGGED).parquet(path).filter(F.col("entity") == entity)
    return apply_schema(rows, entity)


def apply_schema(rows: DataFrame, entity: str) -> DataFrame:
    """Typed columns of one table out of tagged rows."""
    fields = F.from_json("payload", SCHEMAS[entity], {"mode": "PERMISSIVE"})
    return rows.filter(F.col("entity") == entity).select("record_id", "node_path", "parent_path", fields.alias("f")).select("record_id", "node_path", "parent_path", "f.*")
