"""Laws of the tag lattices."""

import itertools

import pytest
from pyspark.sql import functions as F

from provenant.functions import BOOL_OR, MIN_INT, MIN_LONG, LabelIntersection, LabelUnion

CASES = {
    "bool": (BOOL_OR, "boolean", [True, False]),
    "long": (MIN_LONG, "bigint", [0, 7, (1 << 63) - 1]),
    "int": (MIN_INT, "int", [0, 7, (1 << 31) - 1]),
    "union": (LabelUnion(), "array<string>", [[], ["a"], ["a", "b"], ["c"]]),
    "intersection": (LabelIntersection(["a", "b", "c"]), "array<string>", [[], ["a"], ["a", "b"], ["a", "b", "c"]]),
}


@pytest.mark.parametrize("name", CASES)
def test_join_laws(spark, name):
    lattice, kind, tags = CASES[name]
    rows = list(itertools.product(tags, tags, tags))
    df = spark.createDataFrame(rows, f"a {kind}, b {kind}, c {kind}")
    a, b, c = map(F.col, "abc")
    j = lambda *x: lattice.join(list(x))
    laws = [j(a, b) == j(b, a), j(j(a, b), c) == j(a, j(b, c)), j(a, a) == j(a), j(a, lattice.identity()) == j(a), j(a, lattice.top()) == lattice.top()]
    if name == "union":
        laws.pop()  # unions have no single top
    assert df.select(F.every(F.lit(True)), *(F.every(law) for law in laws)).first() == (True,) * (len(laws) + 1)


@pytest.mark.parametrize("name", CASES)
def test_rows_equal_joins_and_skip_nulls(spark, name):
    lattice, kind, tags = CASES[name]
    df = spark.createDataFrame([(t,) for t in [*tags, None]], f"t {kind}")
    want = df.select(lattice.join([lattice.identity(), *(F.lit(t).cast(kind) if not isinstance(t, list) else F.array(*map(F.lit, t)).cast(kind) for t in tags)])).first()[0]
    assert df.agg(lattice.over_rows(F.col("t"))).first()[0] == want
    identity = df.select(lattice.identity()).first()[0]
    assert df.where("t is null").agg(lattice.over_rows(F.col("t"))).first()[0] == identity
    assert df.limit(0).agg(lattice.over_rows(F.col("t"))).first()[0] == identity
