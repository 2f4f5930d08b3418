"""Properties of tracking, and plan shapes beyond the catalogue."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from provenant.errors import LabelError, Untrackable
from provenant.operators import map_reduce, precision_recall, score
from provenant.plans import from_cells, label, label_table, lineage, track
from provenant.session import ProvenanceSession

PEOPLE = [("ann", "f", 10, 30), ("bob", "m", 20, 40), ("cid", "m", 30, None), ("dee", "f", None, 20), (None, "f", 5, 20)]


@pytest.fixture
def people(spark):
    return spark.createDataFrame(PEOPLE, "name string, gender string, salary int, age int")


@pytest.fixture
def secret(people):
    return label(people, {"salary": "gender = 'f'"})


def shapes(df):
    w = Window.partitionBy("gender").orderBy("age")
    return {
        "select": df.select((F.col("salary") + F.col("age")).alias("x"), "name"),
        "filter": df.where("salary > 5").select("name", "salary"),
        "group": df.groupBy("gender").agg(F.sum("salary").alias("s"), F.count("*").alias("n")),
        "global": df.agg(F.max("salary").alias("m"), F.min("age").alias("a")),
        "window": df.select("name", F.max("salary").over(w).alias("m"), F.rank().over(w).alias("r"), (F.sum("salary").over(w) + 1).alias("t")),
        "self": df.alias("a").join(df.alias("b"), F.col("a.gender") == F.col("b.gender")).select("a.name", "b.salary"),
        "union": df.select("salary").union(df.select("age")).union(df.select("salary")),
        "distinct": df.select("gender", F.col("salary") % 2).distinct(),
        "duplicates": df.dropDuplicates(["gender"]).select("gender"),
        "rollup": df.rollup("gender", "age").agg(F.sum("salary").alias("s")),
        "explode": df.select("name", F.explode(F.array("salary", "age")).alias("x")),
        "outer": df.select("gender", "salary").join(df.where("age > 25").select("gender", "age"), "gender", "full"),
        "limit": df.orderBy(F.desc("salary")).limit(2).select("salary"),
        "case": df.select(F.when(F.col("age") > 20, F.col("salary")).otherwise(0).alias("x")),
        "lambda": df.select(F.transform(F.array("salary"), lambda x: x + F.col("age")).alias("x")),
        "unpivot": df.unpivot(["name"], ["salary", "age"], "k", "v"),
        "sample": df.sample(1.0, seed=3).select("salary"),
        "repartition": df.repartition(3, "gender").select("salary", "gender"),
        "filtered agg": df.groupBy("gender").agg(F.expr("sum(age) filter (where salary > 5)").alias("x")),
        "intersectAll": df.select("salary").intersectAll(df.select("age")),
        "exceptAll": df.select("gender").exceptAll(df.select("name")),
    }


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", [
    "select", "filter", "group", "global", "window", "self", "union", "distinct", "duplicates", "rollup", "explode", "outer", "limit", "case", "lambda",
    "unpivot", "sample", "repartition", "filtered agg", "intersectAll", "exceptAll",
])
def test_values_are_untouched_and_tags_monotone(people, name):
    """Tracking doesn't change values; more labels never take a tag away."""
    plain = shapes(people)[name]
    none, some, all_ = (track(shapes(d)[name]) for d in (people, label(people, {"salary": "gender = 'f'"}), label_table(people)))
    assert rows(plain) == rows(none.untag()) == rows(some.untag()) == rows(all_.untag())
    assert not none.tagged_columns() and set(some.tagged_columns()) <= set(all_.tagged_columns())
    assert not some.fallbacks
    sums = [t.to_flat().agg(*(F.sum(F.col(f"`{c}__tag`").cast("int")).alias(f"c{k}") for k, c in enumerate(t.columns))).first() if len(set(t.columns)) == len(t.columns) else () for t in (none, some, all_)]
    assert all((a or 0) <= (b or 0) <= (c or 0) for a, b, c in zip(*sums, strict=True))


def test_tags_of_outer_joins_are_never_null(people, secret):
    other = people.select(F.col("name").alias("n")).where("n = 'ann'")
    got = track(other.join(secret, F.col("n") == F.col("name"), "full").select("n", "salary")).to_flat()
    assert got.where("salary__tag is null or n__tag is null").count() == 0


def test_struct_fields_keep_their_own_tags(people):
    packed = label(people.select(F.struct("name", "salary").alias("p"), "age"), ["p.salary"])
    got = track(packed.select("p.name", F.col("p.salary").alias("s"), "p", "age"))
    assert got.tagged_columns() == ["s", "p"]
    assert track(packed).select_tags("p.name", "p.salary").select("p_name__tag", "p_salary__tag").distinct().collect() == [(False, True)]
    assert track(packed.union(packed).select("p.name")).tagged_columns() == []
    with pytest.raises(LabelError):
        label(people, ["p.nothing"])


def test_cells_round_trip_with_nested_structs(people):
    packed = label(people.select(F.struct("name", F.struct("salary", "age").alias("n")).alias("p"), "gender"), {"p.n.salary": "gender = 'f'"})
    cells = track(packed).to_cells()
    back = track(from_cells(cells))
    assert rows(back.to_cells()) == rows(cells)
    assert cells.schema["p"].dataType["n"].dataType["salary"].dataType.fieldNames() == ["value", "tag"]


def test_cells_mode_keeps_rows_of_unequal_tags(people):
    df = label(people, {"gender": "name = 'ann'"}).select("gender")
    assert track(df.distinct(), distinct="cells").to_flat().count() == 3
    assert track(df.distinct()).to_flat().count() == 2


def test_filters_reach_the_scan(spark, tmp_path, people):
    people.write.parquet(str(tmp_path / "p"))
    df = label(spark.read.parquet(str(tmp_path / "p")), {"salary": "gender = 'f'"}).where("age > 20").select("name")
    plan = track(df).to_flat()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(age,20)" in plan and "ReadSchema: struct<name:string,age:int>" in plan


def test_fallback_joins_all_inputs(people, secret):
    tracked = track(secret.join(people.select("age").distinct(), "age").mapInPandas(lambda it: it, "age int, name string, gender string, salary int"))
    assert tracked.fallbacks and tracked.to_flat().select("name__tag").distinct().collect() == [(True,)]
    with pytest.raises(Untrackable):
        track(secret.mapInPandas(lambda it: it, secret.schema), coarse=False)
    clean = label(people, {"salary": F.lit(False)})
    assert track(clean.mapInPandas(lambda it: it, people.schema)).to_flat().select("name__tag").distinct().collect() == [(False,)]


def test_sql_shapes(spark, people, secret):
    secret.createOrReplaceTempView("secret")
    s = ProvenanceSession(spark)
    got = s.sql("select name, (select max(salary) from secret b where b.gender = a.gender) m from secret a")
    assert got.fallbacks and got.tagged_columns() == ["name", "m"]
    assert s.sql("select name from secret where salary in (select max(salary) from secret)").tagged_columns() == []
    assert s.sql("with c as (select salary s, name from secret) select a.s, b.name from c a join c b on a.name = b.name").tagged_columns() == ["s"]
    assert s.sql("select * from secret union select * from secret").tagged_columns() == ["salary"]
    assert s.sql("select gender, count(*) n, sum(salary) s from secret group by grouping sets ((gender), ())").tagged_columns() == ["s"]
    assert s.sql("select x from secret lateral view explode(array(salary, 1)) as x").tagged_columns() == ["x"]


def test_map_reduce_positions_and_named_functions(spark, people, secret):
    df = secret.select("gender", "salary", "age").where("salary is not null")
    out = track(map_reduce(df, lambda x: (x.gender, (x[1], 1)), lambda a, b: (a[0] + b[0], a[1] + b[1]), "k string, v struct<s: long, n: long>"))
    got = {r.k: (r.v.s, r.v.n, r.v_s__tag, r.v_n__tag) for r in out.select_tags("v.s", "v.n").collect()}
    assert got == {"f": (15, 2, True, False), "m": (50, 2, False, False)}

    def branching(x):
        return (x[0], 1 if x[1] > 5 else 0)

    coarse = track(map_reduce(df, branching, lambda a, b: a + b, "k string, v int")).to_flat()
    assert coarse.select("k__tag", "v__tag").distinct().collect() == [(True, True)]


def test_lineage(people):
    df = people.where("age > 1").groupBy("gender").agg(F.sum(F.col("salary") + F.col("age")).alias("s")).orderBy("s")
    got = lineage(df)
    (source,) = [s["source"] for s in got["steps"] if s["op"] == "input"]
    assert got["columns"] == {"gender": [f"{source}.gender"], "s": [f"{source}.age", f"{source}.salary"]}
    assert set(got["conds"]) == {f"{source}.{c}" for c in ("age", "gender", "salary")}


def test_scores(spark):
    marked = spark.createDataFrame([("[taint] x", 5, ["a [taint]"]), ("y", 0, ["b"]), (None, None, None)], "s string, n int, l array<string>")
    df = label(marked, {"s": "s like '[taint]%'", "n": "true", "l": "false"})
    scores = score(track(df).to_cells(), {"s": True, "n": True, "l": True})
    assert scores.first().asDict() == {"tp": 2, "tn": 2, "fp": 1, "fn": 1}
    assert precision_recall(scores).first() == (2 / 3, 2 / 3)


def _calling():
    def kind_of(v):
        return "none" if v is None else "some"

    return lambda x: (kind_of(x[1]), 1)


@pytest.mark.parametrize(
    "map_row",
    [
        lambda x: ("none" if x[1] is None else "some", 1),
        lambda x: (x[1] is None, 1),
        lambda x: (isinstance(x[1], float), 1),
        lambda x: (type(x[1]).__name__, 1),
        lambda x: (x[1].__class__.__name__, 1),
        lambda x: ((lambda v: v is None)(x[1]), 1),
        _calling(),
        lambda x: ([k for k in (1, 2) if k == x[1]] and "a" or "b", 1),
    ],
)
def test_functions_that_look_into_values_get_the_table_tag(spark, secret, map_row):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "k string, v double")
    out = track(map_reduce(label(df, ["v"]), map_row, lambda a, b: a + b, "k string, n long")).to_flat().collect()
    assert out and all(r.k__tag for r in out)


def test_functions_that_can_be_looked_through(spark):
    def doubled(v):
        return v + v

    df = label(spark.createDataFrame([("a", 1, 5), ("a", 2, 6)], "k string, v long, w long"), ["v"])
    out = track(map_reduce(df, lambda x: (x.k.upper(), (doubled(x[2]), max(x[1], 0))), lambda a, b: (a[0] + b[0], a[1] + b[1]), "k string, v struct<a: long, b: long>"))
    assert out.untag().collect()[0].asDict(True) == {"k": "A", "v": {"a": 22, "b": 3}}
    row = out.to_cells().collect()[0]
    assert (row.k.tag, row.v.a.tag, row.v.b.tag) == (False, False, True)


@pytest.mark.parametrize("reduce_values", [lambda a, b: a if a > b else b, lambda a, b: (a[0], a[0] + b[1]), lambda a, b: (b[0] + a[0], b[0] * a[1])])
def test_reducers_across_positions_join_their_tags(spark, reduce_values):
    df = label(spark.createDataFrame([("a", 1, 5), ("a", 2, 6)], "k string, v long, w long"), ["v"])
    row = track(map_reduce(df, lambda x: (x[0], (x[1], x[2])), reduce_values, "k string, v struct<a: long, b: long>")).to_cells().collect()[0]
    assert row.v.a.tag and row.v.b.tag and not row.k.tag


def test_shown_and_printed(spark, capsys):
    tracked = track(label(spark.range(2), ["id"]))
    tracked.show()
    tracked.printSchema()
    text = capsys.readouterr().out
    assert "id__tag" in text and "tag: boolean" in text
