"""Key/value map and reduce with a tag for each position of key and value.

`map_reduce_columns` takes columns and aggregates and stays in the optimizer.
`map_reduce` takes Python functions, as `rdd.map(...).reduceByKey(...)` does.  Which columns a
position of the map function's result depends on, and which positions of the values one of
the reduced value does, is found by calling the functions with values that record what is
read (see `recording`).  Where that can't tell, as with branches on values, a mapped position
gets the table's tag, and a reduced one the tags of all positions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lattice import BOOL_OR, Lattice
from ..plans.labels import derived, label
from ..plans.walker import track
from .recording import REFUSALS, Read, Row, columns_of, recording


def map_reduce_columns(df: DataFrame, key: list[Column], value: list[tuple[Callable[[Column], Column], Column]]) -> DataFrame:
    """Group by `key`; each value is (aggregate, column).  Plain DataFrame operations: track the result."""
    keys = [k.alias(f"_k{i}") for i, k in enumerate(key)]
    values = [c.alias(f"_v{i}") for i, (_, c) in enumerate(value)]
    names = [f"_k{i}" for i in range(len(key))]
    reduced = [f(F.col(f"_v{i}")).alias(f"_r{i}") for i, (f, _) in enumerate(value)]
    return df.select(*keys, *values).groupBy(*names).agg(*reduced)


def _tuple(x) -> tuple:
    return tuple(x) if isinstance(x, (tuple, list)) else (x,)


def map_reduce(
    df: DataFrame, map_row: Callable, reduce_values: Callable, schema: T.StructType | str | list[str] | None = None, lattice: Lattice = BOOL_OR
) -> DataFrame:
    """`df.rdd.map(map_row).reduceByKey(reduce_values).toDF(schema)`, labelled for further tracking.

    `map_row` returns (key, value), each one value or a tuple; `schema` has two fields, structs
    where tuples are.  Without a schema, or with a list of names, types are inferred from a first
    row, which takes a run of its own; names are _1 and _2 then.
    """
    spark = df.sparkSession
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    elif schema is None or isinstance(schema, (list, tuple)):
        pairs = df.rdd.map(map_row).reduceByKey(reduce_values)
        schema = (pairs.toDF() if schema is None else pairs.toDF(list(schema))).schema
    if len(schema.fields) != 2:
        raise ValueError("the schema of keys and values has two fields")
    tracked = track(df, lattice)
    names = list(df.columns)
    width = [len(_tuple_width(f)) for f in schema.fields]
    reads = _mapped(map_row, names)
    source = tracked.to_flat()
    if reads is None or [len(r) for r in reads] != width:
        reads = None
        source = source.crossJoin(F.broadcast(tracked.table_tag().select(F.col("tag").alias("__table"))))  # one row
    from_values = _reduced(reduce_values, width[1])
    nothing, merge = lattice.nothing(), lattice.merge

    def merged(tags: list):
        out = nothing
        for t in tags:
            out = merge(out, t)
        return out

    def one(row):
        cells = tuple(row)
        values, flags = cells[: 2 * len(names) : 2], cells[1 : 2 * len(names) : 2]
        k, v = map_row(_value_row(names, values))
        if reads is None:
            t = (cells[-1],) * sum(width)
        else:
            t = tuple(merged([flags[c] for c in r]) for part in reads for r in part)
        return _hashable(_tuple(k)), (_tuple(v), t)

    def both(a, b):
        x, y = (v[0] if width[1] == 1 else v for v in (a[0], b[0]))
        return _tuple(reduce_values(x, y)) if width[1] > 1 else (reduce_values(x, y),), tuple(map(merge, a[1], b[1]))

    def flat(kv):
        k, (v, t) = kv
        shown = [p if isinstance(f.dataType, T.StructType) else p[0] for p, f in zip((k, v), schema.fields, strict=True)]
        own = t[width[0] :]
        return (*shown, *t[: width[0]], *(merged([own[i] for i in r]) for r in from_values))

    hidden = [f"__mr{i}" for i in range(sum(width))]
    full = T.StructType([*schema.fields, *(T.StructField(h, lattice.data_type()) for h in hidden)])
    out = spark.createDataFrame(source.rdd.map(one).reduceByKey(both).map(flat), full)
    every = frozenset(range(len(names)))
    spec, origins, at = {}, {}, 0
    for f, w, part in zip(schema.fields, width, reads or [[every] * w for w in width], strict=True):
        paths = [f"{f.name}.{g.name}" for g in f.dataType.fields] if isinstance(f.dataType, T.StructType) else [f.name]
        for i, path in enumerate(paths):
            spec[path] = F.col(hidden[at + i])
        origins[f.name] = sorted({names[c] for r in part for c in r})
        at += w
    return label(derived(out, df, origins), spec).select(*schema.names)


def _mapped(map_row: Callable, names: list[str]) -> list[list[frozenset[int]]] | None:
    """The columns that each position of key and value depends on; None if that can't be told."""
    try:
        key, value = recording(map_row)(Row(names))
        return [[columns_of(x) for x in _tuple(part)] for part in (key, value)]
    except REFUSALS:
        return None


def _reduced(reduce_values: Callable, width: int) -> list[list[int]]:
    """The positions of mapped values that each position of a reduced value depends on, over any number of steps."""
    try:
        row = [Read(frozenset([i])) for i in range(width)]
        out = recording(reduce_values)(*(row[0], row[0]) if width == 1 else (tuple(row), tuple(row)))
        needs = [set(columns_of(x)) | {i} for i, x in enumerate(_tuple(out) if width > 1 else (out,))]
        if len(needs) != width:
            raise ValueError
    except REFUSALS:
        needs = [set(range(width)) for _ in range(width)]
    for _ in range(width):
        needs = [set().union(*(needs[j] for j in n)) for n in needs]
    return [sorted(n) for n in needs]


def _tuple_width(f: T.StructField) -> range:
    return range(len(f.dataType.fields) if isinstance(f.dataType, T.StructType) else 1)


def _value_row(names: list[str], values: tuple):
    from pyspark.sql import Row

    return Row(*names)(*values)


def _hashable(key: tuple) -> tuple:
    return tuple(tuple(k) if isinstance(k, list) else k for k in key)
