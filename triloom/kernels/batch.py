"""Running NumPy kernels over nested rows: one ``mapInArrow`` with a loop inside the batch.

A kernel gets a row's values with geometry as arrays and returns a dict of output values, or a ``Failure``. A failure is
a value: the row keeps its keys, gets empty outputs and its code; it never fails the job.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..types import EMPTY


class Failure(Exception):
    """An operator's error code."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


class Rows:
    """An array of structs as a kernel makes it: one NumPy array a field (or None: null), and which entries are not null."""

    def __init__(self, columns: dict[str, np.ndarray | None], valid: np.ndarray | None = None):
        self.columns, self.size = columns, len(next(iter(columns.values())))
        self.valid = np.ones(self.size, bool) if valid is None else valid


def as_array(values, names: str, kind=np.float64) -> np.ndarray:
    return np.array([[v[n] for n in names] for v in values], kind).reshape(-1, len(names))


def decode(value, kind: T.DataType):
    """Structs of coordinates become arrays; everything else stays as Python values."""
    if value is None:
        return None
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, T.StructType):
            names = inner.fieldNames()
            if names in (["x", "y", "z"], ["x", "y"]):
                return as_array(value, "".join(names))
            if names == ["a", "b", "c"]:
                return as_array(value, "abc", np.int64)
        return [decode(v, inner) for v in value]
    if isinstance(kind, T.StructType):
        names = kind.fieldNames()
        if names in (["x", "y", "z"], ["x", "y"]):
            return np.array([value[n] for n in names], float)
        return {f.name: decode(value[f.name], f.dataType) for f in kind.fields}
    return value


def encode(value, kind: T.DataType):
    if value is None:
        return None
    if isinstance(kind, T.ArrayType):
        return [encode(v, kind.elementType) for v in value]
    if isinstance(kind, T.StructType):
        if isinstance(value, dict):
            return {f.name: encode(value.get(f.name), f.dataType) for f in kind.fields}
        return {f.name: encode(v, f.dataType) for f, v in zip(kind.fields, value, strict=True)}
    if isinstance(kind, T.MapType):
        return list(value.items())
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float(value)
    if isinstance(kind, (T.IntegerType, T.LongType)):
        return int(value)
    return bool(value) if isinstance(kind, T.BooleanType) else value


def _columns(arrays: list, kind: T.DataType) -> pa.Array:
    """Arrow arrays of coordinates straight from NumPy, without a Python object per number."""
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)
    inner = kind.elementType if isinstance(kind, T.ArrayType) else None
    if any(isinstance(a, Rows) for a in arrays):
        return _structs(arrays, inner, arrow)
    if isinstance(inner, T.StructType) and all(isinstance(f.dataType, (T.DoubleType, T.IntegerType)) for f in inner.fields):
        width = len(inner.fields)
        made = [np.zeros((0, width)) if a is None else np.asarray(a).reshape(-1, width) for a in arrays]
        flat = np.concatenate(made) if made else np.zeros((0, width))
        fields = [pa.array(flat[:, k].astype(np.float64 if isinstance(f.dataType, T.DoubleType) else np.int32)) for k, f in enumerate(inner.fields)]
        struct = pa.StructArray.from_arrays(fields, fields=list(arrow.value_type))
        offsets = np.concatenate([[0], np.cumsum([len(m) for m in made])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), struct, type=arrow)
    if isinstance(inner, T.DoubleType) and all(a is None or isinstance(a, np.ndarray) for a in arrays):
        offsets = np.concatenate([[0], np.cumsum([0 if a is None else len(a) for a in arrays])]).astype(np.int32)
        flat = np.concatenate([np.zeros(0), *[a for a in arrays if a is not None]])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), type=arrow, mask=pa.array([a is None for a in arrays], pa.bool_()))
    if isinstance(inner, T.StructType) and all(isinstance(d, dict) for a in arrays if a is not None for d in a):
        flat = [d for a in arrays if a is not None for d in a]
        struct = pa.StructArray.from_arrays([_columns([d.get(f.name) for d in flat], f.dataType) for f in inner.fields], fields=list(arrow.value_type))
        offsets = np.concatenate([[0], np.cumsum([0 if a is None else len(a) for a in arrays])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), struct, type=arrow, mask=pa.array([a is None for a in arrays], pa.bool_()))
    if isinstance(kind, (T.LongType, T.DoubleType)) and {type(a) for a in arrays} <= {int if isinstance(kind, T.LongType) else float, type(None)}:
        return pa.array(arrays, arrow)
    return pa.array([encode(a, kind) for a in arrays], arrow)


def _structs(arrays: list[Rows | None], inner: T.StructType, arrow: pa.DataType) -> pa.Array:
    some = [a for a in arrays if a is not None]

    def column(name: str, kind: T.DataType, arrow_kind: pa.DataType) -> pa.Array:
        if some[0].columns[name] is None:
            return pa.nulls(sum(a.size for a in some), arrow_kind)
        flat = np.concatenate([a.columns[name] for a in some])
        if isinstance(kind, T.StructType):
            return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(len(kind.fields))], fields=list(arrow_kind))
        return pa.array(flat.astype(np.float64 if isinstance(kind, T.DoubleType) else np.int64 if isinstance(kind, T.LongType) else np.int32))

    fields = [column(f.name, f.dataType, arrow.value_type.field(f.name).type) for f in inner.fields]
    values = pa.StructArray.from_arrays(fields, fields=list(arrow.value_type), mask=pa.array(~np.concatenate([a.valid for a in some])))
    offsets = np.concatenate([[0], np.cumsum([0 if a is None else a.size for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values, type=arrow, mask=pa.array([a is None for a in arrays]))


def _read(column: pa.Array, kind: T.DataType) -> list:
    inner = kind.elementType if isinstance(kind, T.ArrayType) else None
    if isinstance(inner, T.StructType) and inner.fieldNames() in (["x", "y", "z"], ["x", "y"], ["a", "b", "c"]) and not column.null_count:
        values, at = column.flatten(), column.offsets.to_numpy() - column.offsets[0].as_py()
        if not values.null_count:
            flat = np.stack([values.field(k).to_numpy(zero_copy_only=False) for k in range(values.type.num_fields)], axis=1) if len(values) else np.zeros((0, values.type.num_fields))
            flat = flat.astype(np.int64 if inner.fieldNames() == ["a", "b", "c"] else np.float64)
            return [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    elif isinstance(inner, T.StructType) and not column.null_count:
        values, at = column.flatten(), column.offsets.to_numpy() - column.offsets[0].as_py()
        if not values.null_count:
            names, fields = inner.fieldNames(), [_read(values.field(k), f.dataType) for k, f in enumerate(inner.fields)]
            flat = [dict(zip(names, x, strict=True)) for x in zip(*fields, strict=True)]
            return [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return [decode(v, kind) for v in column.to_pylist()]


def per_row(df: DataFrame, inputs: list[str], fn, outputs: str, replace: bool = False, whole_row: bool = False, needs: tuple[str, ...] = ()) -> DataFrame:
    """``df`` without ``inputs`` (kept unless ``replace``) and with the kernel's outputs; ``needs`` names meshes that must have a triangle."""

    def each(rows):
        made = []
        for row in rows:
            try:
                made.append(fn(row))
            except Failure as failure:
                made.append(failure)
        return made

    return per_batch(df, inputs, each, outputs, replace, whole_row, needs)


def per_batch(df: DataFrame, inputs: list[str], fn, outputs: str, replace: bool = False, whole_row: bool = False, needs: tuple[str, ...] = ()) -> DataFrame:
    """As ``per_row`` with a kernel that gets a list of rows and returns a list of their outputs or ``Failure`` objects."""
    out = T.StructType.fromDDL(outputs)
    has_error = "error_code" in out.fieldNames()
    full = out if has_error else T.StructType([*out.fields, T.StructField("error_code", T.StringType())])
    kept = [f for f in df.schema.fields if f.name not in full.fieldNames() and not (replace and f.name in inputs)]
    schema, order = T.StructType([*kept, *full.fields]), df.schema

    def run(batches):
        for batch in batches:
            names = [f.name for f in order.fields] if whole_row else [*inputs, *[n for n in ("error_code",) if n in order.fieldNames() and n not in inputs]]
            values = {n: _read(batch.column(order.fieldNames().index(n)), order[n].dataType) for n in names}
            made: list[dict] = [{}] * batch.num_rows
            sound, rows = [], []
            for k in range(batch.num_rows):
                row = {n: v[k] for n, v in values.items()}
                if row.get("error_code"):
                    made[k] = {"error_code": row["error_code"]}
                elif any(row.get(prefix) is None or not len(row[prefix]) for prefix in needs):
                    made[k] = {"error_code": EMPTY}
                else:
                    sound.append(k)
                    rows.append(row)
            for k, found in zip(sound, fn(rows) if rows else [], strict=True):
                made[k] = {"error_code": found.code} if isinstance(found, Failure) else found
            arrays = [batch.column(order.fieldNames().index(f.name)) for f in kept]
            arrays += [_columns([m.get(f.name) for m in made], f.dataType) for f in full.fields]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

    return df.mapInArrow(run, schema)
