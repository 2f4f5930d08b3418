"""A tracked result: values and tags of every cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Tracked:
    """Values of a query with the tag of each cell.

    Tags are columns beside the values; they are packed into cells only on demand.
    """

    def __init__(self, schema: T.StructType, node, walker):
        self.schema, self.lattice = schema, walker.lattice
        self.fallbacks: list[str] = walker.fallbacks
        self._walker, self._node = walker, node
        self._frame: DataFrame = node.frame
        self._values = [walker.b.column(a) for a in node.output]
        self._tags = [node.tags.get(a.exprId().id()) for a in node.output]

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    def _own(self, tag) -> Column:
        return self._walker.join([tag]) if tag is not None else None

    def _tag(self, tag) -> Column:
        own = self._own(tag)
        return self.lattice.identity() if own is None else self.lattice.cleaned(own)

    def values(self) -> DataFrame:
        """The untracked result."""
        return self._frame.select(*(v.alias(n) for v, n in zip(self._values, self.columns, strict=True)))

    untag = values

    def to_flat(self, suffix: str = "__tag") -> DataFrame:
        """Every column c and its tag c__tag; a struct's tag joins its fields'."""
        out = []
        for v, t, n in zip(self._values, self._tags, self.columns, strict=True):
            out += [v.alias(n), self._tag(t).alias(n + suffix)]
        return self._frame.select(*out)

    def field_tag(self, path: str) -> Column:
        """The tag of a column or `column.field`, for use in select_tags."""
        name, *rest = path.split(".")
        tag = self._tags[self.columns.index(name)]
        for step in rest:
            tag = tag[step] if isinstance(tag, dict) else tag
        return self._tag(tag)

    def select_tags(self, *paths: str) -> DataFrame:
        """All values, and for each path its tag as path__tag with _ for dots."""
        values = [v.alias(n) for v, n in zip(self._values, self.columns, strict=True)]
        return self._frame.select(*values, *(self.field_tag(p).alias(p.replace(".", "_") + "__tag") for p in paths))

    def to_cells(self) -> DataFrame:
        """Every column as struct<value, tag>; structs have cells for fields, at any depth."""

        def cell(value: Column, tag, kind: T.DataType) -> Column:
            if isinstance(kind, T.StructType) and kind.fields:
                parts = [cell(value[f.name], tag[f.name] if isinstance(tag, dict) else tag, f.dataType).alias(f.name) for f in kind.fields]
                return F.struct(*parts)
            return F.struct(value.alias("value"), self._tag(tag).alias("tag"))

        rows = zip(self._values, self._tags, self.schema.fields, strict=True)
        return self._frame.select(*(cell(v, t, f.dataType).alias(f.name) for v, t, f in rows))

    def table_tag(self) -> DataFrame:
        """One row: the join of all tags (column tag)."""
        tag = self._walker.join(self._tags)
        return self._frame.agg((self.lattice.identity() if tag is None else self.lattice.over_rows(tag)).alias("tag"))

    def tagged_columns(self) -> list[str]:
        """Columns that may carry a tag at all; the others are the identity in every row."""
        return [n for n, t in zip(self.columns, self._tags, strict=True) if self._own(t) is not None]

    def count(self) -> int:
        return self.values().count()

    def collect(self) -> list:
        return self.values().collect()

    def show(self, n: int = 20, truncate: bool | int = True, vertical: bool = False) -> None:
        """Print the first rows, every column beside its tag."""
        self.to_flat().show(n, truncate, vertical)

    def printSchema(self, level: int | None = None) -> None:
        """Print the schema of the cells."""
        self.to_cells().printSchema(level)

    def explain_tags(self) -> str:
        """Each column's tag as an expression over the tracked frame."""
        return "\n".join(f"{n}: {self._tag(t)._jc.toString()}" for n, t in zip(self.columns, self._tags, strict=True))
