"""Whole programs over self-describing data, scored cell by cell.

Sensitive strings carry a mark and sensitive numbers aren't zero, so a cell's value shows
whether it should be tagged.  Programs are those of the coverage table: mail, people,
numbers and nested mail.  No sensitive cell may be missed; `extra` marks programs that, as
defined, tag more than the values show.
"""

import random

import pytest
from pyspark.sql import functions as F

from provenant.operators import map_reduce, score
from provenant.plans import label, track

MARK = "[taint]"
c = F.col


def mark(hot, text):
    return f"{MARK} {text}" if hot else text


class Data:
    def __init__(self, spark):
        self.spark, r = spark, random.Random(11)
        people = [f"p{k}" for k in range(12)]
        mail, numbers = [], []
        for k in range(120):
            hot = r.random() < 0.5
            a, b = r.choice(people), r.choice(people)
            mail.append((hot, a, mark(hot, f"{a}@x.org"), b, mark(hot, f"{b}@x.org"), mark(hot, f" Subject {k}"), mark(hot, f"Body of {k}. Rest"), f"20{10 + k % 5}-0{1 + k % 9}-11", mark(hot, f"u{k % 7}"), k % 2 == 0, k % 3 == 0))
            numbers.append((hot, *(r.randint(1, 90) if hot else 0 for _ in range(3)), r.random() + 1 if hot else 0.0, 0, 0.0, b"abc", k % 4))
        self.mail_rows = spark.createDataFrame(mail, "hot boolean, sender string, sender_address string, receiver string, receiver_address string, subject string, body string, sent string, puser string, is_read boolean, is_draft boolean").cache()
        self.number_rows = spark.createDataFrame(numbers, "hot boolean, b int, i int, l int, f double, s int, d double, bin binary, year int").cache()
        self.people_rows = spark.createDataFrame([(n, mark(True, f"{n}@x.org"), mark(True, f"+{k}"), f"job{k % 3}", 20 + k) for k, n in enumerate([*people[:10], "zz"])], "name string, email string, phone string, job string, age int").cache()
        nested = [(x[0], x[1], [mark(x[0], "q"), mark(x[0], f"w{k % 5}")] if x[0] else [], (x[5].replace(MARK, ""), x[6] if x[0] else ""), '{"address": "street 1", "job": "j"}') for k, x in enumerate(mail)]
        self.nested_rows = spark.createDataFrame(nested, "hot boolean, sender string, ccs array<string>, content struct<subject: string, body: string>, profile string").cache()

    def _own(self, df, columns):
        return label(df, dict.fromkeys(columns, "hot")).drop("hot")

    @property
    def mail(self):
        return self._own(self.mail_rows, ["sender_address", "receiver_address", "subject", "body", "puser"])

    @property
    def blank(self):
        """Mail whose untagged sensitive texts are empty, so that lengths show."""
        names = ["subject", "body", "puser"]
        return self._own(self.mail_rows.withColumns({n: F.when(c("hot"), c(n)).otherwise("") for n in names}), names)

    @property
    def numbers(self):
        return self._own(self.number_rows, ["b", "i", "l", "f"])

    @property
    def people(self):
        return label(self.people_rows, ["email", "phone"])

    @property
    def nested(self):
        return self._own(self.nested_rows, ["ccs", "content.body"])


@pytest.fixture(scope="module")
def data(spark):
    return Data(spark)


def two_joins(t, how):
    p = t.people
    a = p.select(c("name").alias("sender"), c("email").alias("sender_email"), c("job").alias("sender_job"))
    b = p.select(c("name").alias("receiver"), c("email").alias("receiver_email"), c("job").alias("receiver_job"))
    return t.mail.select("sender", "receiver", "subject").join(a, "sender", how).join(b, "receiver", how)


JOINED = {"sender_email": True, "receiver_email": True, "subject": True, "sender_job": False, "receiver_job": False}


def words(least):
    """An object whose method is a user function; its class is local, so workers get it by value."""

    class Words:
        def __init__(self, least):
            self.least = least

        def split(self, text):
            return [w for w in text.split() if len(w) >= self.least]

    return Words(least)


F_UDF = F.udf

PROGRAMS = {
    "order by": (lambda t: t.mail.select(F.lower("sender").alias("sender"), "sender_address", "receiver", "puser").distinct().orderBy("sender", "receiver", "puser"), {"sender": False, "sender_address": True, "receiver": False, "puser": True}),
    "dates": (lambda t: t.mail.select(F.year(F.to_date("sent")).cast("string").alias("y"), F.month(F.to_date("sent")).alias("m"), "body").orderBy("y", "m"), {"y": False, "body": True}),
    "predicates and literals": (lambda t: t.mail.where(c("subject").isNotNull() & ~c("is_draft")).withColumn("kind", F.lit("x")).withColumn("fused", F.concat("subject", "body")).drop(c("puser")).select("subject", "kind", "fused", "is_read"), {"subject": True, "kind": False, "fused": True, "is_read": False}),
    "contains": (lambda t: t.mail.where(c("body").contains("1") & c("sender").endswith("1")).select("sender", "body"), {"sender": False, "body": True}),
    "first sentence": (lambda t: t.mail.withColumn("x", F.split("body", r"\.")[0]).withColumn("x", F.trim(F.lower("x"))).select("x"), {"x": True}),
    "regular expressions": (lambda t: t.mail.select(F.regexp_extract("body", r"^(\[taint\])?", 1).alias("x"), F.regexp_replace("sender", "p", "q").alias("y")), {"x": True, "y": False}),
    "mixed numbers": (lambda t: t.numbers.select((c("b") + c("s")).alias("x"), (c("i") * c("l")).alias("y"), (c("f") / 2).alias("z"), F.base64("bin").alias("t")), {"x": True, "y": True, "z": True, "t": False}),
    "separators": (lambda t: t.mail.select(F.concat_ws("-", "subject", "body").alias("x")), {"x": True}),
    "count star": (lambda t: t.mail.groupBy("sender_address").agg(F.count("*").alias("n")), {"sender_address": True, "n": False}),
    "count column": (lambda t: t.mail.select("sender", "sender_address", "receiver").distinct().groupBy("sender", "sender_address").agg(F.count("receiver").alias("n")), {"sender": False, "sender_address": True, "n": False}),
    "sum of lengths": (lambda t: t.blank.groupBy("sender", "receiver").agg(F.sum(F.length("subject")).alias("n"), F.first("sent").alias("sent")), {"sender": False, "n": True, "sent": False}),
    "three sums": (lambda t: t.blank.groupBy("puser").agg(F.sum(F.length("subject")).alias("n"), F.sum(F.length("sender")).alias("k")), {"puser": True, "n": True, "k": False}),
    "statistics by key": (lambda t: t.numbers.groupBy("year").agg(F.sum("i").alias("s"), F.max("l").alias("m"), F.mean("f").alias("a")), {"s": True, "m": True, "a": True}),
    "global statistics": (lambda t: t.numbers.agg(F.stddev_pop("f").alias("x"), F.sum("i").alias("s"), F.avg("i").alias("a"), F.sum("s").alias("z"), F.avg("d").alias("y")), {"x": True, "s": True, "a": True, "z": False, "y": False}),
    "inner join": (lambda t: t.mail.join(t.people, c("sender") == c("name")).select("sender", "email", "phone"), {"sender": False, "email": True, "phone": True}),
    "inner joins": (lambda t: two_joins(t, "inner"), JOINED),
    "left joins": (lambda t: two_joins(t, "left"), JOINED),
    "right joins": (lambda t: two_joins(t, "right").where(c("subject").isNull()), JOINED),
    "full joins": (lambda t: two_joins(t, "outer"), JOINED),
    "join after count": (lambda t: t.mail.orderBy("sent").groupBy("sender", "receiver").agg(F.count("*").alias("n")).join(t.people.withColumnRenamed("name", "sender"), "sender"), {"email": True, "job": False, "n": False}),
    "map reduce of values": (lambda t: map_reduce(t.mail.select("puser", "sender"), lambda x: (x[0], 1), lambda a, b: a + b, "k string, v int"), {"k": True, "v": False}),
    "map reduce of tuples": (lambda t: map_reduce(t.mail.select("puser", "receiver", "subject"), lambda x: ((x[0], x[1]), ([x[2]], 1)), lambda a, b: (a[0] + b[0], a[1] + b[1]), "k struct<p: string, r: string>, v struct<l: array<string>, n: int>"), {"k.p": True, "k.r": False, "v.l": True, "v.n": False}),
    "map reduce by function": (lambda t: map_reduce(t.mail.select("puser", "sender"), lambda x: (str(x[0]), 1), lambda a, b: a + b, "k string, v int"), {"k": True, "v": False}, "extra"),
    "explode": (lambda t: t.nested.select("sender", F.explode("ccs").alias("cc")), {"sender": False, "cc": True}),
    "collect": (lambda t: t.nested.groupBy("sender").agg(F.array_sort(F.flatten(F.collect_set("ccs"))).alias("l"), F.sum(F.size("ccs")).alias("n")), {"sender": False, "l": True, "n": True}),
    "items": (lambda t: t.nested.where(F.size("ccs") > 1).select("sender", c("ccs").getItem(0).alias("a"), c("ccs")[1].alias("b")), {"sender": False, "a": True, "b": True}),
    "nested fields": (lambda t: t.nested.select("content", F.upper("content.subject").alias("s"), F_UDF(lambda x: len(x), "int")("content.body").alias("n")), {"content.body": True, "content.subject": False, "s": False, "n": True}),
    "nested lengths": (lambda t: t.nested.groupBy("sender").agg(F.mean(F.length("content.body")).alias("a"), F.first("profile").alias("p")), {"a": True, "sender": False, "p": False}),
    "parsed": (lambda t: t.nested.withColumn("r", F.from_json("profile", "address string, job string")).select(F.length("content.body").alias("n"), c("r.address").alias("address")).drop("x").limit(50), {"n": True, "address": False}),
    "functions of some arguments": (lambda t: t.numbers.select(F_UDF(lambda: 0, "int")().alias("zero"), F_UDF(lambda a: a, "int")("s").alias("one"), F_UDF(lambda a, b, d: a + b + d, "int")("b", "i", "s").alias("three")), {"zero": False, "one": False, "three": True}),
    "functions in filters": (lambda t: t.blank.where(F_UDF(lambda s: s != "p3", "boolean")("sender")).select(F_UDF(lambda s: len(s.split()), "int")("body").alias("n")).drop("a", "b"), {"n": True}),
    "redundant arguments": (lambda t: t.mail.select(F_UDF(lambda a, b: a, "string")("sender", "body").alias("sender_only"), F_UDF(lambda a, b: a + b, "string")("sender", "body").alias("both")), {"sender_only": False, "both": True}, "extra"),
    "methods": (lambda t: t.nested.select(F_UDF(words(2).split, "array<string>")("content.body").alias("w"), F_UDF(lambda x, w=words(1): str(w.split(x)), "string")("content.body").alias("j")), {"w": True, "j": True}),
}


@pytest.mark.parametrize("name", PROGRAMS)
def test_program(data, name):
    program, truth, *extra = PROGRAMS[name]
    tracked = track(program(data))
    got = score(tracked.to_cells(), truth).first()
    assert got.tp + got.tn > 0 and got.fn == 0
    assert (got.fp > 0) if extra else (got.fp == 0)
