"""Labels on source columns.

A labelled DataFrame is the same DataFrame under an alias that names its labels; so labels
go through views, SQL text, joins and every other use, and cost nothing until tracked.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import LabelError

PREFIX = "__provenance_label_"
_next = count()
#: label id -> {dotted path: tag Column, or None for the lattice's top}
REGISTRY: dict[str, dict[str, Column | None]] = {}


ORIGIN = "__provenance_origin_"
#: origin id -> (the DataFrame that rows were computed from outside of plans, {column: its columns})
ORIGINS: dict[str, tuple[DataFrame, dict[str, list[str]]]] = {}


def derived(df: DataFrame, source: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    """`df`, computed from `source` outside of Spark's plans, for lineage; `columns` says from which columns each came."""
    key = f"{ORIGIN}{next(_next)}"
    ORIGINS[key] = source, columns
    return df.alias(key)


def leaves(name: str, kind: T.DataType) -> list[str]:
    """Dotted paths of the fields of a struct at any depth; other types are one leaf."""
    if isinstance(kind, T.StructType) and kind.fields:
        return [p for f in kind.fields for p in leaves(f"{name}.{f.name}", f.dataType)]
    return [name]


def label(df: DataFrame, columns: Iterable[str] | Mapping[str, Column | str | None]) -> DataFrame:
    """`df`, some of whose columns or `column.field`s are sensitive.

    A list of names labels every cell; a mapping gives each cell's tag as a Column or SQL
    text over the row's own columns.
    """
    spec = dict(columns) if isinstance(columns, Mapping) else dict.fromkeys(columns)
    paths = [p for f in df.schema.fields for p in leaves(f.name, f.dataType)]
    out: dict[str, Column | None] = {}
    for name, tag in spec.items():
        own = [p for p in paths if p == name or p.startswith(name + ".")]
        if not own:
            raise LabelError(f"no column or field {name!r} in {df.columns}")
        for p in own:
            out[p] = F.expr(tag) if isinstance(tag, str) else tag
    key = f"{PREFIX}{next(_next)}"
    REGISTRY[key] = out
    return df.alias(key)


def label_table(df: DataFrame, tag: Column | None = None) -> DataFrame:
    """All cells of a table get one tag."""
    return label(df, dict.fromkeys(df.columns, tag))


def _is_cell(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and kind.fieldNames() == ["value", "tag"]


def from_cells(df: DataFrame) -> DataFrame:
    """A DataFrame of `{value, tag}` cells, also inside structs, as labelled plain values."""
    tags: dict[str, Column] = {}

    def value(path: str, kind: T.DataType, at: Column) -> Column:
        if _is_cell(kind):
            tags[path] = at["tag"]
            return at["value"]
        if isinstance(kind, T.StructType):
            parts = [value(f"{path}.{f.name}", f.dataType, at[f.name]).alias(f.name) for f in kind.fields]
            return F.when(at.isNotNull(), F.struct(*parts))
        return at

    values = [value(f.name, f.dataType, F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields]
    hidden = {p: f"__cell_{k}" for k, p in enumerate(tags)}
    plain = df.select(*values, *(tags[p].alias(h) for p, h in hidden.items()))
    spec = {}
    for path, h in hidden.items():
        own = [p for f in plain.schema.fields for p in leaves(f.name, f.dataType) if p == path or p.startswith(path + ".")]
        spec |= {p: F.col(h) for p in own}
    return label(plain, spec).select(*(f"`{c}`" for c in df.columns))
