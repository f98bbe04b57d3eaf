"""Checks of table schemas, field ids, and logical field types kept in field metadata."""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import UserInputError

ADDRESS = T.StructType([T.StructField("_FILE", T.StringType()), T.StructField("_ROW_ID", T.LongType())])
ID = "parquet.field.id"


def file_field(name: str, directory: str) -> T.StructField:
    """A string field that names files below ``directory``."""
    return T.StructField(name, T.StringType(), True, {"logical": "file", "directory": directory})


def full_path(field: T.StructField, column: Column | None = None) -> Column:
    """The path of a file field's value."""
    return F.concat(F.lit(field.metadata["directory"].rstrip("/") + "/"), F.col(field.name) if column is None else column)


def serialized_field(name: str, serializer: str) -> T.StructField:
    """A binary field whose values a registered serializer reads and writes."""
    return T.StructField(name, T.BinaryType(), True, {"logical": "serialized", "serializer": serializer})


SERIALIZERS: dict[str, tuple[Callable, Callable]] = {
    "pickle": (pickle.dumps, pickle.loads),
    "json": (lambda x: json.dumps(x).encode(), lambda b: json.loads(b)),
}


def register_serializer(name: str, dump: Callable, load: Callable) -> None:
    SERIALIZERS[name] = (dump, load)


def _apply(data: dict[str, list], schema: T.StructType, way: int) -> dict[str, list]:
    out = dict(data)
    for f in schema:
        if f.metadata.get("logical") == "serialized" and f.name in out:
            g = SERIALIZERS[f.metadata["serializer"]][way]
            out[f.name] = [None if x is None else g(x) for x in out[f.name]]
    return out


def serialize(data: dict[str, list], schema: T.StructType) -> dict[str, list]:
    return _apply(data, schema, 0)


def deserialize(data: dict[str, list], schema: T.StructType) -> dict[str, list]:
    return _apply(data, schema, 1)


def numbered(schema: T.StructType) -> T.StructType:
    """``schema``, all nullable, with depth-first field ids from 0 (an element counts one, then its children)."""
    seen = iter(range(1 << 30))

    def kind(t: T.DataType) -> T.DataType:
        if isinstance(t, T.ArrayType):
            next(seen)
            return T.ArrayType(kind(t.elementType))
        if isinstance(t, T.MapType):
            next(seen), next(seen)
            return T.MapType(kind(t.keyType), kind(t.valueType))
        return T.StructType([field(f) for f in t]) if isinstance(t, T.StructType) else t

    def field(f: T.StructField) -> T.StructField:
        meta = dict(f.metadata or {}) | {ID: next(seen)}
        return T.StructField(f.name, kind(f.dataType), True, meta)

    return T.StructType([field(f) for f in schema])


def physical(schema: T.StructType, record_fields: list[str]) -> T.StructType:
    """Record fields replaced by addresses."""
    return T.StructType([T.StructField(f.name, ADDRESS) if f.name in record_fields else T.StructField(f.name, f.dataType) for f in schema])


def check(schema: T.StructType, primary_keys: list[str], record_fields: list[str]) -> None:
    names = {f.name: f for f in schema}
    if not primary_keys:
        raise UserInputError("Must specify at least one primary key")
    for k in primary_keys:
        if k not in names:
            raise UserInputError(f"Primary key {k} is not in the schema {sorted(names)}")
        f = names[k]
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) or f.metadata.get("logical") == "serialized":
            raise UserInputError(f"Primary key {k} has a type that can't be a key: {f.dataType.simpleString()}")
    for r in record_fields:
        if r not in names:
            raise UserInputError(f"Record field {r} is not in the schema {sorted(names)}")
        if r in primary_keys:
            raise UserInputError(f"Record field {r} cannot be a primary key")
        if not isinstance(names[r].dataType, T.BinaryType):
            raise UserInputError(f"Record field {r} must be binary, not {names[r].dataType.simpleString()}")
