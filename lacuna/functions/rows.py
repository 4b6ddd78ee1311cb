"""Columns computed in Python workers, a row at a time: Arrow arrays to Python values and back, without a scalar for each value."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string as parse


def values(array: pa.Array) -> list:
    """The values of an array: lists of lists, tuples of structs."""
    kind = array.type
    if not len(array):
        return []
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        ends = array.offsets.to_numpy().tolist()
        first = ends[0]
        flat = values(array.values.slice(first, ends[-1] - first))
        out = [flat[a - first : b - first] for a, b in zip(ends, ends[1:])]
    elif pa.types.is_struct(kind):
        out = list(zip(*(values(array.field(k)) for k in range(kind.num_fields)), strict=True))
    elif array.null_count and not pa.types.is_string(kind):
        return array.to_pylist()
    else:
        return array.to_numpy(zero_copy_only=False).tolist()
    if array.null_count:
        out = [x if ok else None for x, ok in zip(out, array.is_valid().to_numpy(zero_copy_only=False).tolist(), strict=True)]
    return out


def array(rows: list, kind: pa.DataType) -> pa.Array:
    """An array of a type from lists of lists, tuples of structs, and pairs of maps; None where there is no value."""
    if pa.types.is_list(kind) or pa.types.is_map(kind):
        ends, at = [], 0
        for x in rows:
            ends.append(None if x is None else at)
            at += len(x or ())
        ends.append(at)
        flat = list(chain.from_iterable(x for x in rows if x is not None))
        offsets = pa.array(ends, pa.int32())
        if pa.types.is_map(kind):
            return pa.MapArray.from_arrays(offsets, array([k for k, _ in flat], kind.key_type), array([v for _, v in flat], kind.item_type), kind)
        return pa.ListArray.from_arrays(offsets, array(flat, kind.value_type), kind)
    if pa.types.is_struct(kind):
        none = (None,) * kind.num_fields
        missing = [x is None for x in rows]
        columns = list(zip(*(none if x is None else x for x in rows), strict=True)) or [()] * kind.num_fields
        mask = pa.array(missing) if any(missing) else None
        return pa.StructArray.from_arrays([array(list(c), f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind), mask=mask)
    return pa.array(rows, kind)


def column(fn: Callable[..., Any], returns: str) -> Callable[..., Column]:
    """A function of one row's values as a function of columns.

    It is called once for each row: were it known to be deterministic, a filter on what it gives would call it again.
    """

    def of(*columns: Column) -> Column:
        kind = parse(returns)
        arrow = to_arrow_type(kind)

        def run(*arrays: pa.Array) -> pa.Array:
            return array([fn(*row) for row in zip(*map(values, arrays), strict=True)], arrow)

        return F.arrow_udf(run, kind).asNondeterministic()(*columns)

    return of
