"""Arrow tables from rows that hold numpy planes, without a Python object per sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def nested(planes: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """Channels x frames arrays as one array of type list<list<number>>."""
    channels = np.cumsum([0] + [len(p) for p in planes])
    frames = np.cumsum([0] + [p.shape[1] for p in planes for _ in range(len(p))])
    flat = np.concatenate([np.ascontiguousarray(p).reshape(-1) for p in planes]) if planes else np.empty(0)
    values = pa.array(flat.astype(kind.value_type.value_type.to_pandas_dtype(), copy=False))
    inner = pa.ListArray.from_arrays(pa.array(frames.astype(np.int32)), values).cast(kind.value_type)
    return pa.ListArray.from_arrays(pa.array(channels.astype(np.int32)), inner).cast(kind)


def table(rows: list[dict], schema: pa.Schema) -> pa.Table:
    """Rows with the schema's columns; two-dimensional arrays go into nested lists."""
    columns = []
    for field in schema:
        values = [r.get(field.name) for r in rows]
        if values and all(isinstance(v, np.ndarray) for v in values):
            columns.append(nested(values, field.type))
        else:
            columns.append(pa.array(values, field.type))
    return pa.Table.from_arrays(columns, schema=schema)
