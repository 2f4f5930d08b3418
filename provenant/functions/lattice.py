"""Tag lattices: how tags of cells combine, within a row and over the rows of a group.

All are built-in, mergeable expressions, so tags stay in whole-stage code and in partial
aggregates, and work on streams.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Lattice:
    """`identity()` is the tag of what derives from no labelled cell."""

    def identity(self) -> Column:
        raise NotImplementedError

    def top(self) -> Column:
        """The tag that a cell gets when a column is labelled by name only."""
        raise NotImplementedError

    def join(self, tags: list[Column]) -> Column:
        """Combine tags of one row, none of them null."""
        raise NotImplementedError

    def over_rows(self, tag: Column) -> Column:
        """Aggregate a tag over rows; null tags don't count, no rows give the identity."""
        raise NotImplementedError

    def data_type(self) -> T.DataType:
        """The type of a tag."""
        raise NotImplementedError

    def nothing(self):
        """`identity()` as a Python value."""
        raise NotImplementedError

    def merge(self, a, b):
        """Combine two tags that are Python values; None counts as the identity."""
        raise NotImplementedError

    def cleaned(self, tag: Column) -> Column:
        """Never null."""
        return F.coalesce(tag, self.identity())


class BoolOr(Lattice):
    """Tainted or not."""

    def identity(self) -> Column:
        return F.lit(False)

    def top(self) -> Column:
        return F.lit(True)

    def join(self, tags):
        return reduce(lambda a, b: a | b, tags)

    def over_rows(self, tag):
        return F.coalesce(F.bool_or(tag), self.identity())

    def data_type(self):
        return T.BooleanType()

    def nothing(self):
        return False

    def merge(self, a, b):
        return bool(a or b)


class MinLevel(Lattice):
    """The lowest of the levels, such as trust or days of retention; `kind` is int or bigint."""

    def __init__(self, kind: str = "bigint"):
        self.kind = kind
        self.highest = (1 << 63) - 1 if kind == "bigint" else (1 << 31) - 1

    def identity(self) -> Column:
        return F.lit(self.highest).cast(self.kind)

    def top(self) -> Column:
        return F.lit(0).cast(self.kind)

    def join(self, tags):
        return tags[0] if len(tags) == 1 else F.least(*tags)

    def over_rows(self, tag):
        return F.coalesce(F.min(tag), self.identity())

    def data_type(self):
        return T.LongType() if self.kind == "bigint" else T.IntegerType()

    def nothing(self):
        return self.highest

    def merge(self, a, b):
        return min((x for x in (a, b) if x is not None), default=self.highest)


class LabelUnion(Lattice):
    """Sorted sets of labels that reach a cell."""

    def identity(self) -> Column:
        return F.array().cast("array<string>")

    def top(self) -> Column:
        return F.array(F.lit("labelled"))

    def join(self, tags):
        return F.array_sort(reduce(F.array_union, tags))

    def over_rows(self, tag):
        return F.array_sort(F.array_distinct(F.flatten(F.collect_set(tag))))

    def data_type(self):
        return T.ArrayType(T.StringType())

    def nothing(self):
        return []

    def merge(self, a, b):
        return sorted({*(a or ()), *(b or ())})


class LabelIntersection(Lattice):
    """Labels, out of a fixed universe, that every source of a cell has."""

    def __init__(self, universe: list[str]):
        self.universe = sorted(universe)

    def identity(self) -> Column:
        return F.array(*map(F.lit, self.universe)).cast("array<string>")

    def top(self) -> Column:
        return F.array().cast("array<string>")

    def join(self, tags):
        return F.array_sort(reduce(F.array_intersect, tags))

    def over_rows(self, tag):
        # a label is in all rows' sets if no row lacks it: one flag for each label, not a list of all rows
        held = [F.when(F.coalesce(F.bool_and(F.array_contains(tag, x)), F.lit(True)), F.lit(x)) for x in self.universe]
        return F.array_compact(F.array(*held)).cast("array<string>")

    def data_type(self):
        return T.ArrayType(T.StringType())

    def nothing(self):
        return list(self.universe)

    def merge(self, a, b):
        return sorted(set(self.universe if a is None else a) & set(self.universe if b is None else b))


BOOL_OR = BoolOr()
MIN_LONG = MinLevel()
MIN_INT = MinLevel("int")
