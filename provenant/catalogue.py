"""Queries over the driver's tables, one or more for each tracked operator, with their SQL for DuckDB.

Each runs over whole tables and gives every column x beside its tag x__tag.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.lattice import LabelIntersection, LabelUnion, MinLevel
from .operators import map_reduce, map_reduce_columns, precision_recall, score
from .plans import from_cells, label, label_table, lineage, lineage_edges, track
from .session import ProvenanceSession
from .streaming import windowed, write_tracked

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables with the labels that the queries share."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def orders(self):
        return label(self.raw("orders"), {"o_totalprice": "o_orderstatus = 'F'"})

    @property
    def customer(self):
        return label(self.raw("customer"), ["c_name"])

    @property
    def lineitem(self):
        return label(self.raw("lineitem"), {"l_extendedprice": "l_returnflag = 'R'"})

    @property
    def events(self):
        return label(self.raw("events"), {"value": "event_type = 'purchase'"})

    @property
    def documents(self):
        return label(self.raw("documents"), {"text": "lang = 'de'"})

    @property
    def supplier(self):
        return label(self.raw("supplier"), ["s_acctbal"])

    @property
    def conversations(self):
        return label(self.raw("conversations"), {"text": "role = 'user'"})


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def flat(df: DataFrame, **settings) -> DataFrame:
    return track(df, **settings).to_flat()


c = F.col

# -- labels and cells ---------------------------------------------------------


@query("SELECT c_custkey, false AS c_custkey__tag, c_name, true AS c_name__tag FROM customer")
def label_column(t):
    return flat(t.customer.select("c_custkey", "c_name"))


@query("SELECT o_orderkey, false AS o_orderkey__tag, o_totalprice, o_orderstatus = 'F' AS o_totalprice__tag FROM orders")
def label_cells(t):
    return flat(t.orders.select("o_orderkey", "o_totalprice"))


@query("SELECT n_nationkey, true AS n_nationkey__tag, n_name, true AS n_name__tag FROM nation")
def label_tables(t):
    return flat(label_table(t.raw("nation")).select("n_nationkey", "n_name"))


@query("SELECT bool_or(o_orderstatus = 'F') AS tag FROM orders")
def table_tag(t):
    return track(t.orders).table_tag()


@query("SELECT o_orderkey, false AS o_orderkey__tag, o_totalprice, o_orderstatus = 'F' AS o_totalprice__tag FROM orders WHERE o_totalprice > 1000")
def cells_roundtrip(t):
    cells = track(t.orders.select("o_orderkey", "o_totalprice")).to_cells()
    return flat(from_cells(cells).where("o_totalprice > 1000"))


@query("SELECT o_orderkey, o_totalprice FROM orders")
def untag(t):
    return track(t.orders.select("o_orderkey", "o_totalprice")).untag()


# -- projection and filter ----------------------------------------------------


@query("SELECT lower(c_name) AS name, true AS name__tag, c_mktsegment AS segment, false AS segment__tag FROM customer")
def project_lower_alias(t):
    return flat(t.customer.select(F.lower("c_name").alias("name"), c("c_mktsegment").alias("segment")))


@query("""SELECT l_orderkey, false AS l_orderkey__tag, l_linenumber, false AS l_linenumber__tag,
  l_extendedprice * (1 - l_discount) AS revenue, l_returnflag = 'R' AS revenue__tag, l_quantity + l_tax AS other, false AS other__tag FROM lineitem""")
def project_arith(t):
    return flat(t.lineitem.select("l_orderkey", "l_linenumber", (c("l_extendedprice") * (1 - c("l_discount"))).alias("revenue"), (c("l_quantity") + c("l_tax")).alias("other")))


@query("""SELECT l_orderkey, false AS l_orderkey__tag, l_linenumber, false AS l_linenumber__tag,
  l_extendedprice > 20000 AS large, l_returnflag = 'R' AS large__tag, l_quantity <= 10 AS few, false AS few__tag FROM lineitem""")
def project_compare(t):
    return flat(t.lineitem.select("l_orderkey", "l_linenumber", (c("l_extendedprice") > 20000).alias("large"), (c("l_quantity") <= 10).alias("few")))


@query("""SELECT o_orderkey, false AS o_orderkey__tag, NOT (o_totalprice > 100000) AS small, o_orderstatus = 'F' AS small__tag,
  -o_totalprice AS negative, o_orderstatus = 'F' AS negative__tag FROM orders""")
def project_bool_not(t):
    return flat(t.orders.select("o_orderkey", (~(c("o_totalprice") > 100000)).alias("small"), (-c("o_totalprice")).alias("negative")))


@query("SELECT o_orderkey, false AS o_orderkey__tag, 'x' AS kind, false AS kind__tag FROM orders")
def lit_and_drop(t):
    df = t.orders.withColumn("kind", F.lit("x")).drop("o_totalprice", "o_orderdate").drop(c("o_orderpriority"))
    return flat(df.drop("o_custkey", "o_orderstatus"))


@query("""SELECT o_orderkey, false AS o_orderkey__tag, round(o_totalprice * 2 + o_custkey, 2) AS b, o_orderstatus = 'F' AS b__tag,
  o_custkey % 7 AS a, false AS a__tag FROM orders""")
def with_column_chain(t):
    df = t.orders.withColumn("a", c("o_totalprice") * 2).withColumn("b", F.round(c("a") + c("o_custkey"), 2)).withColumn("a", c("o_custkey") % 7)
    return flat(df.select("o_orderkey", "b", "a"))


@query("SELECT o_orderkey, false AS o_orderkey__tag, o_totalprice AS price, o_orderstatus = 'F' AS price__tag FROM orders")
def dynamic_name(t):
    target, source = "price", "o_totalprice"
    return flat(t.orders.withColumn(target, c(source)).select("o_orderkey", target))


@query("""SELECT doc_id, false AS doc_id__tag, n_chars, false AS n_chars__tag, text, lang = 'de' AS text__tag FROM documents
  WHERE (lang IN ('de', 'fr') AND n_chars > 200) OR source = 'src3'""")
def filter_compound(t):
    return flat(t.documents.where((c("lang").isin("de", "fr") & (c("n_chars") > 200)) | (c("source") == "src3")).select("doc_id", "n_chars", "text"))


@query("SELECT doc_id, false AS doc_id__tag, lang, false AS lang__tag FROM documents WHERE contains(text, 'er') AND text LIKE '%en%' AND lang LIKE '%e'")
def filter_contains_like(t):
    return flat(t.documents.where(c("text").contains("er") & c("text").like("%en%") & c("lang").endswith("e")).select("doc_id", "lang"))


@query("SELECT c_custkey, false AS c_custkey__tag, c_name, true AS c_name__tag FROM customer WHERE c_acctbal > 0 AND c_mktsegment <> 'BUILDING'")
def filter_sql_text(t):
    return flat(t.customer.filter("c_acctbal > 0 and c_mktsegment <> 'BUILDING'").select("c_custkey", "c_name"))


@query("SELECT c_custkey, false AS c_custkey__tag, c_name IS NULL AS none, true AS none__tag, c_name IS NOT NULL AS some, true AS some__tag FROM customer WHERE c_name IS NOT NULL")
def filter_isnull(t):
    return flat(t.customer.where(c("c_name").isNotNull()).select("c_custkey", c("c_name").isNull().alias("none"), c("c_name").isNotNull().alias("some")))


# -- scalar functions ---------------------------------------------------------


@query("SELECT c_custkey, false AS c_custkey__tag, c_name || '-' || c_mktsegment AS x, true AS x__tag, c_mktsegment || '!' AS y, false AS y__tag FROM customer")
def str_concat(t):
    return flat(t.customer.select("c_custkey", F.concat("c_name", F.lit("-"), "c_mktsegment").alias("x"), F.concat("c_mktsegment", F.lit("!")).alias("y")))


@query("SELECT c_custkey, false AS c_custkey__tag, concat_ws('|', c_mktsegment, c_name, 'z') AS x, true AS x__tag FROM customer")
def str_concat_ws(t):
    return flat(t.customer.select("c_custkey", F.concat_ws("|", "c_mktsegment", "c_name", F.lit("z")).alias("x")))


@query("SELECT c_custkey, false AS c_custkey__tag, trim(split_part(' ' || c_name || ' ', '#', 1)) AS x, true AS x__tag FROM customer")
def str_trim_split_item(t):
    return flat(t.customer.select("c_custkey", F.trim(F.split(F.concat(F.lit(" "), "c_name", F.lit(" ")), "#")[0]).alias("x")))


@query("SELECT c_custkey, false AS c_custkey__tag, regexp_extract(c_name, '([0-9]+)$', 1) AS x, true AS x__tag FROM customer")
def str_regexp_extract(t):
    return flat(t.customer.select("c_custkey", F.regexp_extract("c_name", "([0-9]+)$", 1).alias("x")))


@query("SELECT doc_id, false AS doc_id__tag, regexp_replace(text, '[aeiou]+', '_', 'g') AS x, lang = 'de' AS x__tag, regexp_matches(text, '[0-9]') AS y, lang = 'de' AS y__tag FROM documents")
def str_regexp_replace(t):
    return flat(t.documents.select("doc_id", F.regexp_replace("text", "[aeiou]+", "_").alias("x"), c("text").rlike("[0-9]").alias("y")))


@query("SELECT doc_id, false AS doc_id__tag, CAST(length(text) AS BIGINT) AS n, lang = 'de' AS n__tag FROM documents")
def str_length(t):
    return flat(t.documents.select("doc_id", F.length("text").cast("long").alias("n")))


@query("SELECT c_custkey, false AS c_custkey__tag, base64(encode(c_name)) AS x, true AS x__tag FROM customer")
def str_base64(t):
    return flat(t.customer.select("c_custkey", F.base64(F.encode("c_name", "utf-8")).alias("x")))


@query("""SELECT l_orderkey, false AS l_orderkey__tag, l_linenumber, false AS l_linenumber__tag, round(sqrt(l_extendedprice), 4) AS root,
  l_returnflag = 'R' AS root__tag, round(pow(l_quantity, 2), 4) AS square, false AS square__tag, round(pow(l_quantity, l_extendedprice / 100000), 4) AS p, l_returnflag = 'R' AS p__tag FROM lineitem""")
def math_sqrt_pow(t):
    return flat(
        t.lineitem.select(
            "l_orderkey", "l_linenumber", F.round(F.sqrt("l_extendedprice"), 4).alias("root"), F.round(F.pow("l_quantity", F.lit(2)), 4).alias("square"),
            F.round(F.pow("l_quantity", c("l_extendedprice") / 100000), 4).alias("p"),
        )
    )


@query("""SELECT o_orderkey, false AS o_orderkey__tag, CAST(floor(o_totalprice) AS BIGINT) AS whole, o_orderstatus = 'F' AS whole__tag,
  CAST(o_orderkey AS VARCHAR) AS text, false AS text__tag, CAST(o_totalprice AS DECIMAL(18, 2)) AS exact, o_orderstatus = 'F' AS exact__tag FROM orders""")
def cast_types(t):
    return flat(t.orders.select("o_orderkey", F.floor("o_totalprice").cast("long").alias("whole"), c("o_orderkey").cast("string").alias("text"), c("o_totalprice").cast("decimal(18,2)").alias("exact")))


@query("""SELECT o_orderkey, false AS o_orderkey__tag, CAST(year(o_orderdate) AS BIGINT) AS y, false AS y__tag, CAST(month(o_orderdate) AS BIGINT) AS m, true AS m__tag,
  CAST(day(o_orderdate) AS BIGINT) AS d, true AS d__tag FROM orders""")
def date_parts(t):
    base = t.raw("orders").withColumn("public", c("o_orderdate"))
    df = label(base, ["o_orderdate"])
    return flat(df.select("o_orderkey", F.year("public").cast("long").alias("y"), F.month("o_orderdate").cast("long").alias("m"), F.dayofmonth("o_orderdate").cast("long").alias("d")))


@query("SELECT o_orderkey, false AS o_orderkey__tag, CAST(epoch(o_orderdate) AS BIGINT) AS seconds, true AS seconds__tag FROM orders")
def to_timestamp(t):
    df = label(t.raw("orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")), ["o_orderdate"])
    return flat(df.select("o_orderkey", F.unix_timestamp(F.to_timestamp("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("seconds")))


@query("""SELECT o_orderkey, false AS o_orderkey__tag, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_custkey > 50 THEN 'mid' ELSE o_orderpriority END AS level,
  o_orderstatus = 'F' AS level__tag, CASE WHEN o_custkey > 50 THEN 1 ELSE 2 END AS side, false AS side__tag FROM orders""")
def when_otherwise(t):
    level = F.when(c("o_totalprice") > 200000, "high").when(c("o_custkey") > 50, "mid").otherwise(c("o_orderpriority"))
    return flat(t.orders.select("o_orderkey", level.alias("level"), F.when(c("o_custkey") > 50, 1).otherwise(2).alias("side")))


# -- arrays, structs, JSON ----------------------------------------------------


@query("""SELECT doc_id, false AS doc_id__tag, string_split(text, ' ')[1] AS w, lang = 'de' AS w__tag,
  CAST(len(string_split(text, ' ')) AS BIGINT) AS n, lang = 'de' AS n__tag FROM documents""")
def array_getitem_size(t):
    words = F.split("text", " ")
    return flat(t.documents.select("doc_id", words.getItem(0).alias("w"), F.size(words).cast("long").alias("n")))


@query("SELECT w, bool_or(lang = 'de') AS w__tag, count(*) AS n, false AS n__tag FROM (SELECT lang, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY w")
def explode_words(t):
    return flat(t.documents.select(F.explode(F.split("text", " ")).alias("w")).groupBy("w").agg(F.count("*").alias("n")))


@query("""SELECT o_orderpriority AS p, false AS p__tag, array_to_string(list_sort(list_distinct(list(CAST(floor(o_totalprice / 50000) AS BIGINT)))), ',') AS s, bool_or(o_orderstatus = 'F') AS s__tag,
  array_to_string(list_sort(list(o_orderkey)), ',') AS l, false AS l__tag FROM orders GROUP BY 1""")
def collect_set_list(t):
    df = t.orders.groupBy(c("o_orderpriority").alias("p")).agg(
        F.concat_ws(",", F.sort_array(F.collect_set(F.floor(c("o_totalprice") / 50000))).cast("array<string>")).alias("s"),
        F.concat_ws(",", F.sort_array(F.collect_list("o_orderkey")).cast("array<string>")).alias("l"),
    )
    return flat(df)


@query("SELECT c_custkey, false AS c_custkey__tag, c_acctbal AS balance, false AS balance__tag, c_name AS name, true AS name__tag, c_name || CAST(floor(c_acctbal) AS BIGINT) AS both_, true AS both___tag FROM customer")
def struct_field_sensitivity(t):
    df = t.customer.select("c_custkey", F.struct(c("c_name").alias("name"), F.struct(c("c_acctbal").alias("balance")).alias("money")).alias("s"))
    df = df.select("c_custkey", c("s.money.balance").alias("balance"), c("s.name").alias("name"), F.concat("s.name", F.floor("s.money.balance").cast("string")).alias("both_"))
    return flat(df)


@query("""SELECT event_id, false AS event_id__tag, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type = 'click' AS k__tag FROM events""")
def from_json_field(t):
    df = label(t.raw("events"), {"props": "event_type = 'click'"})
    return flat(df.select("event_id", F.from_json("props", "k long").alias("p")).select("event_id", c("p.k").alias("k")))


# -- sort, limit, sets ----------------------------------------------------------


@query("SELECT o_custkey, false AS o_custkey__tag, o_totalprice, o_orderstatus = 'F' AS o_totalprice__tag FROM orders ORDER BY o_totalprice, o_custkey")
def order_by(t):
    return flat(t.orders.orderBy("o_totalprice", "o_custkey").select("o_custkey", "o_totalprice"))


@query("SELECT o_orderkey, false AS o_orderkey__tag, o_totalprice, o_orderstatus = 'F' AS o_totalprice__tag FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def order_by_desc_limit(t):
    return flat(t.orders.sort(c("o_totalprice").desc(), c("o_orderkey").asc()).select("o_orderkey", "o_totalprice").limit(10))


@query("SELECT c_custkey AS k, false AS k__tag, c_name AS v, true AS v__tag FROM customer UNION ALL SELECT s_suppkey, false, s_name, false FROM supplier")
def union_all(t):
    return flat(t.customer.select(c("c_custkey").alias("k"), c("c_name").alias("v")).union(t.supplier.select("s_suppkey", "s_name")))


@query("SELECT s_suppkey AS k, false AS k__tag, s_acctbal AS v, true AS v__tag FROM supplier UNION ALL SELECT c_custkey, false, c_acctbal, false FROM customer")
def union_by_name(t):
    left = t.supplier.select(c("s_suppkey").alias("k"), c("s_acctbal").alias("v"))
    return flat(left.unionByName(t.customer.select(c("c_acctbal").alias("v"), c("c_custkey").alias("k"))))


@query("SELECT floor(o_totalprice / 1000)::BIGINT AS b, bool_or(o_orderstatus = 'F') AS b__tag FROM orders GROUP BY 1")
def distinct_values(t):
    return flat(t.orders.select(F.floor(c("o_totalprice") / 1000).alias("b")).distinct())


@query("SELECT DISTINCT floor(o_totalprice / 1000)::BIGINT AS b, o_orderstatus = 'F' AS b__tag FROM orders")
def distinct_cells(t):
    return flat(t.orders.select(F.floor(c("o_totalprice") / 1000).alias("b")).distinct(), distinct="cells")


@query("SELECT o_custkey, false AS o_custkey__tag, bool_or(o_orderstatus = 'F') AS seen__tag, 1 AS seen FROM orders GROUP BY 1")
def drop_duplicates(t):
    df = t.orders.select("o_custkey", (c("o_totalprice") * 0 + 1).cast("int").alias("seen"))
    return flat(df.dropDuplicates(["o_custkey"]))


@query("""SELECT b, bool_or(f) AS b__tag FROM (SELECT floor(o_totalprice / 1000)::BIGINT AS b, o_orderstatus = 'F' AS f FROM orders)
  WHERE b IN (SELECT floor(c_acctbal / 100)::BIGINT FROM customer) GROUP BY b""")
def intersect_tags(t):
    left = t.orders.select(F.floor(c("o_totalprice") / 1000).alias("b"))
    return flat(left.intersect(t.customer.select(F.floor(c("c_acctbal") / 100).alias("b"))))


@query("""SELECT b, bool_or(f) AS b__tag FROM (SELECT floor(o_totalprice / 1000)::BIGINT AS b, o_orderstatus = 'F' AS f FROM orders)
  WHERE b NOT IN (SELECT floor(c_acctbal / 100)::BIGINT FROM customer) GROUP BY b""")
def except_tags(t):
    left = t.orders.select(F.floor(c("o_totalprice") / 1000).alias("b"))
    return flat(left.subtract(t.customer.select(F.floor(c("c_acctbal") / 100).alias("b"))))


# -- joins ----------------------------------------------------------------------

_JOINED = """SELECT o_orderkey, false AS o_orderkey__tag, o_totalprice, coalesce(o_orderstatus = 'F', false) AS o_totalprice__tag, c_name, c_name IS NOT NULL AS c_name__tag
  FROM orders {how} JOIN customer ON o_custkey = c_custkey AND c_mktsegment <> 'BUILDING'"""


def _joined(t, how: str):
    on = (c("o_custkey") == c("c_custkey")) & (c("c_mktsegment") != "BUILDING")  # so that both sides have rows without a partner
    return flat(t.orders.join(t.customer, on, how).select("o_orderkey", "o_totalprice", "c_name"))


@query(_JOINED.format(how="INNER"))
def join_inner_expr(t):
    return _joined(t, "inner")


@query(_JOINED.format(how="LEFT"))
def join_left(t):
    return _joined(t, "left")


@query(_JOINED.format(how="RIGHT"))
def join_right(t):
    return _joined(t, "right")


@query(_JOINED.format(how="FULL"))
def join_full(t):
    return _joined(t, "full")


@query("""SELECT coalesce(o.k, s.k) AS k, coalesce(o.f, false) OR s.k IS NOT NULL AS k__tag, o_orderkey, false AS o_orderkey__tag
  FROM (SELECT o_custkey AS k, o_orderkey, o_orderstatus = 'F' AS f FROM orders) o FULL JOIN (SELECT s_suppkey AS k FROM supplier) s ON o.k = s.k""")
def join_full_using(t):
    left = label(t.raw("orders").withColumnRenamed("o_custkey", "k"), {"k": "o_orderstatus = 'F'"}).select("k", "o_orderkey")
    right = label(t.raw("supplier").withColumnRenamed("s_suppkey", "k"), ["k"]).select("k")
    return flat(left.join(right, "k", "full"))


@query("SELECT o_custkey AS k, false AS k__tag, o_totalprice, o_orderstatus = 'F' AS o_totalprice__tag, c_name, true AS c_name__tag FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner_using(t):
    left = t.orders.withColumnRenamed("o_custkey", "k")
    return flat(left.join(t.customer.withColumnRenamed("c_custkey", "k"), ["k"]).select("k", "o_totalprice", "c_name"))


@query("SELECT o_orderkey, false AS o_orderkey__tag, o_totalprice, o_orderstatus = 'F' AS o_totalprice__tag FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def join_semi(t):
    return flat(t.orders.join(t.customer.where("c_acctbal > 5000"), c("o_custkey") == c("c_custkey"), "left_semi").select("o_orderkey", "o_totalprice"))


@query("SELECT o_orderkey, false AS o_orderkey__tag, o_totalprice, o_orderstatus = 'F' AS o_totalprice__tag FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def join_anti(t):
    return flat(t.orders.join(t.customer.where("c_acctbal > 5000"), c("o_custkey") == c("c_custkey"), "left_anti").select("o_orderkey", "o_totalprice"))


@query("SELECT n_name, false AS n_name__tag, s_name, false AS s_name__tag, s_acctbal, true AS s_acctbal__tag FROM nation JOIN supplier ON s_nationkey < n_nationkey AND n_regionkey = 1")
def join_theta(t):
    return flat(t.raw("nation").join(t.supplier, (c("s_nationkey") < c("n_nationkey")) & (c("n_regionkey") == 1)).select("n_name", "s_name", "s_acctbal"))


@query("SELECT r_name, false AS r_name__tag, s_name, false AS s_name__tag, s_acctbal, true AS s_acctbal__tag FROM region CROSS JOIN supplier")
def join_cross(t):
    return flat(t.raw("region").crossJoin(t.supplier).select("r_name", "s_name", "s_acctbal"))


@query("SELECT a.c_name AS x, true AS x__tag, b.c_custkey AS y, false AS y__tag FROM customer a JOIN customer b ON a.c_custkey = b.c_custkey + 1")
def join_self(t):
    a, b = t.customer.alias("a"), t.customer.alias("b")
    return flat(a.join(b, c("a.c_custkey") == c("b.c_custkey") + 1).select(c("a.c_name").alias("x"), c("b.c_custkey").alias("y")))


@query("""SELECT n_name, false AS n_name__tag, c_name, true AS c_name__tag, total, total__tag, n, false AS n__tag FROM customer JOIN
  (SELECT o_custkey, round(sum(o_totalprice), 2) AS total, bool_or(o_orderstatus = 'F') AS total__tag, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey
  JOIN nation ON n_nationkey = c_nationkey""")
def join_after_agg(t):
    sums = t.orders.orderBy("o_orderdate").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n"))
    df = t.customer.join(sums, c("o_custkey") == c("c_custkey")).join(t.raw("nation"), c("n_nationkey") == c("c_nationkey"))
    return flat(df.select("n_name", "c_name", "total", "n"))


# -- aggregates -------------------------------------------------------------------


@query("SELECT c_name, true AS c_name__tag, count(*) AS n, false AS n__tag FROM customer GROUP BY 1")
def group_count_star(t):
    return flat(t.customer.groupBy("c_name").agg(F.count("*").alias("n")))


@query("SELECT o_custkey, false AS o_custkey__tag, count(o_totalprice) AS n, bool_or(o_orderstatus = 'F') AS n__tag FROM orders GROUP BY 1")
def group_count_col(t):
    return flat(t.orders.groupBy("o_custkey").agg(F.count("o_totalprice").alias("n")))


@query("SELECT o_orderpriority, false AS o_orderpriority__tag, count(*) AS count, false AS count__tag FROM orders GROUP BY 1")
def group_count_short(t):
    return flat(t.orders.groupby("o_orderpriority").count())


@query("""SELECT l_returnflag, false AS l_returnflag__tag, l_linestatus, false AS l_linestatus__tag, round(sum(l_quantity), 2) AS q, false AS q__tag,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, l_returnflag = 'R' AS revenue__tag FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def group_multi_key(t):
    revenue = F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2)
    return flat(t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("q"), revenue.alias("revenue")))


@query("""SELECT CAST(floor(o_totalprice / 50000) AS BIGINT) AS b, bool_or(o_orderstatus = 'F') AS b__tag, max(o_orderkey) AS m, false AS m__tag FROM orders GROUP BY 1""")
def group_expr_key(t):
    return flat(t.orders.groupBy(F.floor(c("o_totalprice") / 50000).alias("b")).agg(F.max("o_orderkey").alias("m")))


@query("""SELECT o_custkey, false AS o_custkey__tag, round(sum(o_totalprice), 2) AS s, bool_or(o_orderstatus = 'F') AS s__tag FROM orders GROUP BY 1 HAVING sum(o_totalprice) > 100000""")
def group_having(t):
    return flat(t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s")).where("s > 100000").withColumn("s", F.round("s", 2)))


@query("""SELECT round(sum(l_extendedprice), 1) AS s, true AS s__tag, round(avg(l_extendedprice), 4) AS a, true AS a__tag, round(avg(l_quantity), 4) AS m, false AS m__tag,
  count(*) AS n, false AS n__tag, round(stddev_pop(l_extendedprice), 3) AS d, true AS d__tag FROM lineitem""")
def agg_global_stats(t):
    return flat(
        t.lineitem.agg(
            F.round(F.sum("l_extendedprice"), 1).alias("s"), F.round(F.avg("l_extendedprice"), 4).alias("a"), F.round(F.mean("l_quantity"), 4).alias("m"),
            F.count("*").alias("n"), F.round(F.stddev_pop("l_extendedprice"), 3).alias("d"),
        )
    )


@query("""SELECT l_returnflag AS f, false AS f__tag, round(stddev(l_extendedprice), 3) AS sd, l_returnflag = 'R' AS sd__tag, round(stddev_samp(l_quantity), 4) AS sq, false AS sq__tag,
  round(var_pop(l_quantity), 4) AS vp, false AS vp__tag, round(var_samp(l_discount), 6) AS vs, false AS vs__tag, round(variance(l_tax), 6) AS v, false AS v__tag,
  round(kurtosis_pop(l_extendedprice), 3) AS k, l_returnflag = 'R' AS k__tag FROM lineitem GROUP BY 1""")
def agg_moments(t):
    return flat(
        t.lineitem.groupBy(c("l_returnflag").alias("f")).agg(
            F.round(F.stddev("l_extendedprice"), 3).alias("sd"), F.round(F.stddev_samp("l_quantity"), 4).alias("sq"), F.round(F.var_pop("l_quantity"), 4).alias("vp"),
            F.round(F.var_samp("l_discount"), 6).alias("vs"), F.round(F.variance("l_tax"), 6).alias("v"), F.round(F.kurtosis("l_extendedprice"), 3).alias("k"),
        )
    )


@query("""SELECT l_returnflag AS f, false AS f__tag, round(avg(pow((l_extendedprice - m) / s, 3)), 3) AS k, l_returnflag = 'R' AS k__tag
  FROM lineitem JOIN (SELECT l_returnflag AS g, avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON g = l_returnflag GROUP BY l_returnflag""")
def agg_skewness(t):
    return flat(t.lineitem.groupBy(c("l_returnflag").alias("f")).agg(F.round(F.skewness("l_extendedprice"), 3).alias("k")))


@query("""SELECT o_orderpriority AS p, false AS p__tag, count(DISTINCT o_custkey) AS n, false AS n__tag, count(DISTINCT o_totalprice) AS d, bool_or(o_orderstatus = 'F') AS d__tag,
  CAST(sum(DISTINCT o_custkey) AS BIGINT) AS s, false AS s__tag FROM orders GROUP BY 1""")
def agg_distinct(t):
    return flat(t.orders.groupBy(c("o_orderpriority").alias("p")).agg(F.countDistinct("o_custkey").alias("n"), F.count_distinct("o_totalprice").alias("d"), F.sum_distinct("o_custkey").alias("s")))


@query("""SELECT true AS close, bool_or(o_orderstatus = 'F') AS close__tag FROM orders""")
def agg_approx_distinct(t):
    near = F.abs(F.approx_count_distinct("o_totalprice", 0.02) / F.count_distinct("o_totalprice") - 1) < 0.2
    return flat(t.orders.agg(near.alias("close")))


@query("""SELECT o_custkey AS k, false AS k__tag, min(o_totalprice) AS lo, bool_or(o_orderstatus = 'F') AS lo__tag, max(o_totalprice) AS hi, bool_or(o_orderstatus = 'F') AS hi__tag,
  arg_min(o_totalprice, o_orderkey) AS first, bool_or(o_orderstatus = 'F') AS first__tag, arg_max(o_orderkey, o_orderkey) AS last, false AS last__tag FROM orders GROUP BY 1""")
def agg_minmax_first_last(t):
    return flat(t.orders.groupBy(c("o_custkey").alias("k")).agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.min_by("o_totalprice", "o_orderkey").alias("first"), F.max_by("o_orderkey", "o_orderkey").alias("last")))


@query("SELECT o_orderpriority AS p, false AS p__tag, 'x' AS a, bool_or(o_orderstatus = 'F') AS a__tag, 'x' AS z, bool_or(o_orderstatus = 'F') AS z__tag FROM orders GROUP BY 1")
def agg_first_last(t):
    df = t.orders.withColumn("x", F.when(c("o_totalprice") > -1, "x"))
    return flat(df.groupBy(c("o_orderpriority").alias("p")).agg(F.first("x").alias("a"), F.last("x").alias("z")))


@query("""SELECT l_returnflag, false AS l_returnflag__tag, l_linestatus, false AS l_linestatus__tag, round(sum(l_extendedprice), 1) AS s, bool_or(l_returnflag = 'R') AS s__tag, count(*) AS n, false AS n__tag
  FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rollup_tags(t):
    return flat(t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_extendedprice"), 1).alias("s"), F.count("*").alias("n")))


@query("""SELECT l_returnflag, false AS l_returnflag__tag, l_linestatus, false AS l_linestatus__tag, max(l_extendedprice) AS m, bool_or(l_returnflag = 'R') AS m__tag,
  CAST(GROUPING(l_returnflag, l_linestatus) AS BIGINT) AS g, false AS g__tag FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def cube_tags(t):
    return flat(t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.max("l_extendedprice").alias("m"), F.grouping_id().alias("g")))


@query("""SELECT o_orderpriority AS p, false AS p__tag, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS "F", bool_or(o_orderstatus = 'F') AS "F__tag",
  max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS "O", bool_or(o_orderstatus = 'F') AS "O__tag" FROM orders GROUP BY 1""")
def pivot_tags(t):
    return flat(t.orders.groupBy(c("o_orderpriority").alias("p")).pivot("o_orderstatus", ["F", "O"]).agg(F.max("o_totalprice")))


# -- windows ------------------------------------------------------------------------


@query("""SELECT o_orderkey, false AS o_orderkey__tag, round(sum(o_totalprice) OVER w, 2) AS s, bool_or(o_orderstatus = 'F') OVER w AS s__tag FROM orders
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def window_running_sum(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return flat(t.orders.withColumn("s", F.sum("o_totalprice").over(w)).select("o_orderkey", F.round("s", 2).alias("s")))


@query("""SELECT o_orderkey, false AS o_orderkey__tag, CAST(row_number() OVER w AS BIGINT) AS r, false AS r__tag, lag(o_totalprice) OVER w AS p, coalesce(lag(o_orderstatus = 'F') OVER w, false) AS p__tag
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)""")
def window_rank(t):
    w = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    return flat(t.orders.select("o_orderkey", F.row_number().over(w).cast("long").alias("r"), F.lag("o_totalprice").over(w).alias("p")))


@query("""SELECT o_orderkey, false AS o_orderkey__tag, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS BIGINT) AS r, o_orderstatus = 'F' AS r__tag FROM orders""")
def window_rank_strict(t):
    w = Window.partitionBy("o_custkey").orderBy("o_totalprice")
    return flat(t.orders.select("o_orderkey", F.rank().over(w).cast("long").alias("r")), implicit="strict")


# -- user functions -------------------------------------------------------------------


@query("SELECT c_custkey, false AS c_custkey__tag, 7 AS x, false AS x__tag FROM customer")
def udf_zero_arg(t):
    seven = F.udf(lambda: 7, T.IntegerType())
    return flat(t.customer.select("c_custkey", seven().alias("x")))


@query("SELECT c_custkey, false AS c_custkey__tag, c_name || ':' || c_mktsegment || ':' || c_custkey AS x, true AS x__tag FROM customer")
def udf_multi_arg(t):
    joined = F.pandas_udf(lambda a, b, n: a + ":" + b + ":" + n.astype(str), "string")
    return flat(t.customer.select("c_custkey", joined("c_name", "c_mktsegment", "c_custkey").alias("x")))


@query("SELECT conv_id, false AS conv_id__tag, turn, false AS turn__tag, CAST(len(string_split(text, ' ')) AS BIGINT) AS n, role = 'user' AS n__tag FROM conversations WHERE length(text) > 40")
def udf_predicate(t):
    long = F.pandas_udf(lambda s: s.str.len() > 40, "boolean")
    words = F.pandas_udf(lambda s: s.str.split(" ").str.len(), "long")
    return flat(t.conversations.where(long("text")).select("conv_id", "turn", words("text").alias("n")))


@query("SELECT c_custkey, false AS c_custkey__tag, c_mktsegment AS x, true AS x__tag FROM customer")
def udf_redundant_args(t):
    one = F.pandas_udf(lambda a, b: a, "string")
    return flat(t.customer.select("c_custkey", one("c_mktsegment", "c_name").alias("x")))


@query("SELECT doc_id, false AS doc_id__tag, CAST(len(string_split(text, ' ')) AS BIGINT) AS n, lang = 'de' AS n__tag FROM documents")
def udf_array_tokens(t):
    tokens = F.pandas_udf(lambda s: s.str.split(" "), "array<string>")
    return flat(t.documents.select("doc_id", F.size(tokens("text")).cast("long").alias("n")))


class _Shout:
    def __init__(self, end: str):
        self.end = end

    def all(self, s):
        return s.str.upper() + self.end


@query("SELECT c_custkey, false AS c_custkey__tag, upper(c_name) || '!' AS x, true AS x__tag FROM customer")
def udf_class_method(t):
    shout = F.pandas_udf(lambda s: _Shout("!").all(s), "string")
    return flat(t.customer.select("c_custkey", shout("c_name").alias("x")))


@query("""SELECT o_orderpriority AS p, false AS p__tag, round(avg(o_totalprice), 2) AS a, bool_or(o_orderstatus = 'F') AS a__tag FROM orders GROUP BY 1""")
def udaf_pandas(t):
    def mean(v: pd.Series) -> float:
        return v.mean()

    average = F.pandas_udf(mean, "double")
    df = t.orders.groupBy(c("o_orderpriority").alias("p")).agg(average("o_totalprice").alias("a"))
    return flat(df.select("p", F.round("a", 2).alias("a")))


@query("SELECT CAST(count(*) AS DOUBLE) AS n, true AS n__tag FROM orders")
def udaf_pandas_global(t):
    def size(v: pd.Series) -> float:
        return float(len(v))

    return flat(t.orders.agg(F.pandas_udf(size, "double")("o_totalprice").alias("n")))


@query("SELECT c_custkey, false AS c_custkey__tag, part, true AS part__tag FROM (SELECT c_custkey, unnest(string_split(c_name, '#')) AS part FROM customer)")
def udtf_split(t):
    class Split:
        def eval(self, text):
            for part in text.split("#"):
                yield (part,)

    name = f"split_{os.urandom(4).hex()}"
    t.spark.udtf.register(name, F.udtf(Split, returnType="part string"))
    return ProvenanceSession(t.spark).sql(f"SELECT c_custkey, part FROM {{customer}}, LATERAL {name}(c_name)", customer=t.customer).to_flat()


@query("""SELECT o_orderkey, false AS o_orderkey__tag, lag(v IGNORE NULLS) OVER w AS p, coalesce(lag(CASE WHEN v IS NOT NULL THEN f END IGNORE NULLS) OVER w, false) AS p__tag,
  lead(v, 2) OVER w AS q, coalesce(lead(f, 2) OVER w, false) AS q__tag
  FROM (SELECT o_orderkey, o_custkey, o_orderstatus = 'F' AS f, CASE WHEN o_orderpriority > '3' THEN o_totalprice END AS v FROM orders)
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def window_lag_ignore_nulls(t):
    text = """SELECT o_orderkey, lag(v) IGNORE NULLS OVER w AS p, lead(v, 2) OVER w AS q
      FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority > '3' THEN o_totalprice END AS v FROM {orders}) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)"""
    return ProvenanceSession(t.spark).sql(text, orders=t.orders).to_flat()


@query("""SELECT o_orderkey, false AS o_orderkey__tag, coalesce(lag(CAST(o_orderkey AS DOUBLE)) OVER w, o_totalprice) AS p, row_number() OVER w = 1 AND o_orderstatus = 'F' AS p__tag
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def window_lag_default(t):
    text = "SELECT o_orderkey, lag(CAST(o_orderkey AS DOUBLE), 1, o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM {orders}"
    return ProvenanceSession(t.spark).sql(text, orders=t.orders).to_flat()


@query("SELECT c_custkey, false AS c_custkey__tag, upper(c_name) AS u, true AS u__tag, c_acctbal + 1 AS a, false AS a__tag FROM customer")
def udf_nested_field(t):
    """User functions on fields of a struct, one of which is labelled."""
    people = label(t.raw("customer").select("c_custkey", F.struct("c_name", "c_acctbal").alias("who")), ["who.c_name"])
    upper, plus = F.udf(lambda x: x.upper(), "string"), F.udf(lambda x: x + 1, "double")
    return flat(people.select("c_custkey", upper("who.c_name").alias("u"), plus("who.c_acctbal").alias("a")))


# -- map and reduce -------------------------------------------------------------------


@query("SELECT o_orderpriority AS k, false AS k__tag, count(*) AS v, false AS v__tag FROM orders GROUP BY 1")
def map_reduce_scalar(t):
    df = t.orders.select("o_orderpriority", "o_totalprice")
    return flat(map_reduce(df, lambda x: (x[0], 1), lambda a, b: a + b, "k string, v long"))


@query("""SELECT o_orderpriority AS p, false AS p__tag, o_orderstatus AS s, false AS s__tag, max(o_totalprice) AS m, o_orderstatus = 'F' AS m__tag, count(*) AS n, false AS n__tag FROM orders GROUP BY o_orderpriority, o_orderstatus""")
def map_reduce_tuple(t):
    df = t.orders.select("o_orderpriority", "o_orderstatus", "o_totalprice")
    out = map_reduce(df, lambda x: ((x[0], x[1]), (x[2], 1)), lambda a, b: (max(a[0], b[0]), a[1] + b[1]), "k struct<p: string, s: string>, v struct<m: double, n: long>")
    return flat(out.select("k.p", "k.s", "v.m", "v.n"))


@query("""SELECT o_custkey AS k, false AS k__tag, round(sum(o_totalprice), 2) AS total, bool_or(o_orderstatus = 'F') AS total__tag, count(*) AS n, false AS n__tag FROM orders GROUP BY 1""")
def map_reduce_schema(t):
    df = map_reduce_columns(t.orders, [c("o_custkey")], [(F.sum, c("o_totalprice")), (F.sum, F.lit(1))])
    return flat(df.select(c("_k0").alias("k"), F.round("_r0", 2).alias("total"), c("_r1").alias("n")))


@query("""SELECT o_orderpriority AS p, false AS p__tag, o_orderstatus AS s, false AS s__tag, max(o_totalprice) AS m, o_orderstatus = 'F' AS m__tag, count(*) AS n, false AS n__tag FROM orders GROUP BY o_orderpriority, o_orderstatus""")
def map_reduce_inferred(t):
    df = t.orders.select("o_orderpriority", "o_orderstatus", "o_totalprice")
    out = map_reduce(df, lambda x: ((x[0], x[1]), (x[2], 1)), lambda a, b: (max(a[0], b[0]), a[1] + b[1]))
    return flat(out.select(c("_1._1").alias("p"), c("_1._2").alias("s"), c("_2._1").alias("m"), c("_2._2").alias("n")))


@query("SELECT upper(o_orderpriority) AS k, true AS k__tag, count(*) AS v, true AS v__tag FROM orders GROUP BY 1")
def map_reduce_fallback(t):
    df = t.orders.select("o_orderpriority", "o_totalprice")
    return flat(map_reduce(df, lambda x: (str(x[0]).upper(), 1), lambda a, b: a + b, "k string, v long"))


@query("SELECT 'some' AS k, true AS k__tag, count(*) AS v, true AS v__tag FROM orders")
def map_reduce_branch(t):
    """A branch on a column decides the key, which recording can't see: the table's tag."""
    df = t.orders.select("o_orderpriority", "o_totalprice")
    return flat(map_reduce(df, lambda x: ("none" if x[1] is None else "some", 1), lambda a, b: a + b, "k string, v long"))


@query("""SELECT o_orderpriority AS k, false AS k__tag, max(o_totalprice) AS m, true AS m__tag, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS w, true AS w__tag, count(*) AS n, false AS n__tag
  FROM orders GROUP BY 1""")
def map_reduce_across_positions(t):
    """The pair of the larger first value wins: the second depends on the first as well."""
    df = t.orders.select("o_orderpriority", "o_totalprice", "o_orderkey")
    pairs = map_reduce(df, lambda x: (x[0], (x[1], x[2])), lambda a, b: a if a > b else b, "k string, v struct<m: double, w: long>")
    counts = map_reduce(df, lambda x: (x[0], 1), lambda a, b: a + b, "k string, n long")
    return flat(pairs.join(counts, "k").select("k", "v.m", "v.w", "n"))


@query("SELECT * FROM (VALUES ('k', 'orders.o_orderpriority'), ('m', 'orders.o_totalprice'), ('m', 'orders.o_orderkey')) AS e(target, source)")
def map_reduce_lineage(t):
    df = t.orders.select("o_orderpriority", "o_totalprice", "o_orderkey")
    out = map_reduce(df, lambda x: (x[0], (x[1], x[2])), lambda a, b: (a[0] + b[0], a[1]), "k string, v struct<m: double, w: long>")
    return lineage_edges(out.select("k", (c("v.m") + c("v.w")).alias("m")))


@query("""SELECT o_orderpriority AS k, 9223372036854775807 AS k__tag, max(o_totalprice) AS v, min(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 5 END) AS v__tag FROM orders GROUP BY 1""")
def map_reduce_lattice(t):
    session = ProvenanceSession(t.spark, lattice=MinLevel())
    df = session.label(t.raw("orders"), {"o_totalprice": "case when o_orderstatus = 'F' then 1L else 5L end"}).select("o_orderpriority", "o_totalprice")
    out = session.map_reduce(df, lambda x: (x[0], x[1]), lambda a, b: max(a, b), "k string, v double").to_flat()
    return out.withColumn("v__tag", c("v__tag").cast("int"))


@query("SELECT c_custkey, true AS c_custkey__tag, c_mktsegment, true AS c_mktsegment__tag FROM customer")
def fallback_coarse(t):
    return flat(t.customer.mapInPandas(lambda it: (p[["c_custkey", "c_mktsegment"]] for p in it), "c_custkey long, c_mktsegment string"))


# -- other lattices, implicit flows, SQL ------------------------------------------------


@query("""SELECT o_orderpriority AS p, 9223372036854775807 AS p__tag, max(o_totalprice) AS m, min(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 5 END) AS m__tag FROM orders GROUP BY 1""")
def lattice_min(t):
    df = label(t.raw("orders"), {"o_totalprice": "case when o_orderstatus = 'F' then 1L else 5L end"})
    out = flat(df.groupBy(c("o_orderpriority").alias("p")).agg(F.max("o_totalprice").alias("m")), lattice=MinLevel())
    return out.withColumn("m__tag", c("m__tag").cast("int"))


@query("""SELECT o_orderpriority AS p, '' AS p__tag, count(o_totalprice) AS n, string_agg(DISTINCT o_orderstatus, '-' ORDER BY o_orderstatus) AS n__tag FROM orders GROUP BY 1""")
def lattice_union(t):
    df = label(t.raw("orders"), {"o_totalprice": F.array("o_orderstatus")})
    out = flat(df.groupBy(c("o_orderpriority").alias("p")).agg(F.count("o_totalprice").alias("n")), lattice=LabelUnion())
    return out.withColumns({x: F.array_join(x, "-") for x in ("p__tag", "n__tag")})


@query("""SELECT o_custkey AS k, 'a-b-c' AS k__tag, count(o_totalprice) AS n, CASE WHEN bool_or(o_orderstatus = 'F') AND bool_or(o_orderstatus <> 'F') THEN 'a'
  WHEN bool_or(o_orderstatus = 'F') THEN 'a-b' ELSE 'a-c' END AS n__tag FROM orders GROUP BY 1""")
def lattice_intersection(t):
    tag = F.when(c("o_orderstatus") == "F", F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("c")))
    df = label(t.raw("orders"), {"o_totalprice": tag})
    out = flat(df.groupBy(c("o_custkey").alias("k")).agg(F.count("o_totalprice").alias("n")), lattice=LabelIntersection(["a", "b", "c"]))
    return out.withColumns({x: F.array_join(x, "-") for x in ("k__tag", "n__tag")})


@query("SELECT o_orderkey, o_orderstatus = 'F' AS o_orderkey__tag FROM orders WHERE o_totalprice > 100000")
def implicit_strict_filter(t):
    return flat(t.orders.where("o_totalprice > 100000").select("o_orderkey"), implicit="strict")


@query("""SELECT c_name, true AS c_name__tag, s, s__tag FROM customer JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS s, bool_or(o_orderstatus = 'F') AS s__tag
  FROM orders GROUP BY 1) ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'""")
def sql_join_agg(t):
    text = """WITH sums AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS s FROM {orders} GROUP BY o_custkey)
      SELECT c_name, s FROM {customer} JOIN sums ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'"""
    return ProvenanceSession(t.spark).sql(text, orders=t.orders, customer=t.customer).to_flat()


_SETS = """SELECT l_returnflag, {f} l_linestatus, {f2} round(sum(l_extendedprice), 1) AS s, {st} CAST(grouping(l_returnflag) AS BIGINT) AS g, {gt} count(*) AS n{nt}
  FROM {t} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())"""


@query(_SETS.format(f="false AS l_returnflag__tag,", f2="false AS l_linestatus__tag,", st="bool_or(l_returnflag = 'R') AS s__tag,", gt="false AS g__tag,", nt=", false AS n__tag", t="lineitem").replace("(l_returnflag = 'R')", "(r)").replace("FROM lineitem", "FROM (SELECT *, l_returnflag = 'R' AS r FROM lineitem)"))
def grouping_sets(t):
    return ProvenanceSession(t.spark).sql(_SETS.format(f="", f2="", st="", gt="", nt="", t="{lineitem}"), lineitem=t.lineitem).to_flat()


@query("""SELECT l_orderkey AS k, false AS k__tag, l_linenumber AS n, false AS n__tag, l_extendedprice AS a, l_returnflag = 'R' AS a__tag, q, false AS q__tag FROM lineitem
  JOIN (SELECT l_orderkey AS k, l_linenumber AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) ON l_orderkey = k AND l_linenumber = n""")
def join_several_keys(t):
    """Joined on a list of names, given by the keyword."""
    lines = t.lineitem.withColumnsRenamed({"l_orderkey": "k", "l_linenumber": "n"})
    sums = lines.groupBy("k", "n").agg(F.sum("l_quantity").alias("q"))
    return flat(lines.join(sums, on=["k", "n"], how="inner").select("k", "n", c("l_extendedprice").alias("a"), "q"))


@query("SELECT s_suppkey, false AS s_suppkey__tag, s_name, false AS s_name__tag, s_nationkey, false AS s_nationkey__tag, s_acctbal, true AS s_acctbal__tag FROM supplier")
def select_star(t):
    return flat(t.supplier.select("*").repartition(3).coalesce(2).cache())


@query("""SELECT o_orderpriority AS p, 2147483647 AS p__tag, max(o_totalprice) AS m, min(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 5 END) AS m__tag FROM orders GROUP BY 1""")
def lattice_min_int(t):
    df = label(t.raw("orders"), {"o_totalprice": "case when o_orderstatus = 'F' then 1 else 5 end"})
    return flat(df.groupBy(c("o_orderpriority").alias("p")).agg(F.max("o_totalprice").alias("m")), lattice=MinLevel("int"))


@query("SELECT c_name, true AS c_name__tag FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def sql_exists(t):
    text = "SELECT c_name FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 300000)"
    return ProvenanceSession(t.spark).sql(text, orders=t.orders, customer=t.customer).to_flat()


@query("SELECT c_custkey, false AS c_custkey__tag, (SELECT max(o_totalprice) FROM orders) AS m, true AS m__tag FROM customer")
def sql_scalar_subquery(t):
    text = "SELECT c_custkey, (SELECT max(o_totalprice) FROM {orders}) AS m FROM {customer}"
    return ProvenanceSession(t.spark).sql(text, orders=t.orders, customer=t.customer).to_flat()


# -- streams, scores, lineage -------------------------------------------------------------


@query("""SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day, false AS day__tag, event_type, false AS event_type__tag, round(sum(value), 2) AS total, event_type = 'purchase' AS total__tag, count(value) AS n, event_type = 'purchase' AS n__tag
  FROM events GROUP BY 1, 3""")
def stream_window_sum(t):
    """A stream over the table, run until all is read; windows that still are open are written at its end."""
    out = _streamed(t, keys=("event_type",))
    return out.select(F.unix_seconds("start").alias("day"), c("start__tag").alias("day__tag"), "event_type", "event_type__tag", F.round("total", 2).alias("total"), "total__tag", "n", "n__tag")


def _streamed(t, **window) -> DataFrame:
    source = t.raw("events")
    stream = t.spark.readStream.schema(source.schema).parquet(f"{t.sf_dir}/events.parquet*")
    df = windowed(label(stream, {"value": "event_type = 'purchase'"}), "ts", "value", **window)
    name = f"stream_{os.urandom(6).hex()}"
    write_tracked(df, "memory", mode="complete", queryName=name).awaitTermination()
    return t.spark.table(name)


@query("""SELECT CAST(epoch(s) AS BIGINT) AS start, false AS start__tag, round(sum(value), 2) AS total, bool_or(event_type = 'purchase') AS total__tag, count(value) AS n, bool_or(event_type = 'purchase') AS n__tag
  FROM (SELECT *, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s FROM events) GROUP BY s""")
def stream_sliding_windows(t):
    """Windows of two days that begin every day."""
    out = _streamed(t, size="2 days", slide="1 day")
    return out.select(F.unix_seconds("start").alias("start"), "start__tag", F.round("total", 2).alias("total"), "total__tag", "n", "n__tag")


@query("""SELECT event_type, false AS event_type__tag, CAST(floor(epoch(min(ts))) AS BIGINT) AS first, false AS first__tag, count(value) AS n, event_type = 'purchase' AS n__tag
  FROM (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM
    (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events))
  GROUP BY event_type, session""")
def stream_session_windows(t):
    """Sessions of each type that end after a gap of six hours."""
    out = _streamed(t, size="6 hours", keys=("event_type",), session=True)
    return out.select("event_type", "event_type__tag", F.unix_seconds("start").alias("first"), c("start__tag").alias("first__tag"), "n", "n__tag")


@query("""SELECT CAST(sum(CASE WHEN lang = 'de' THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN lang <> 'de' THEN 1 ELSE 0 END) + count(*) AS BIGINT) AS tn, CAST(0 AS BIGINT) AS fp, CAST(0 AS BIGINT) AS fn FROM documents""")
def score_cells(t):
    marked = t.raw("documents").withColumn("text", F.when(c("lang") == "de", F.concat(F.lit("[taint]"), "text")).otherwise("x"))
    df = label(marked, {"text": "lang = 'de'"}).select(F.lower("text").alias("text"), "source")
    return score(track(df).to_cells(), {"text": True, "source": False})


_CASES = """SELECT CAST(count(*) FILTER (WHERE lang = 'de') AS {k}) AS tp, CAST(count(*) FILTER (WHERE lang <> 'de') + count(*) AS {k}) AS tn, CAST(0 AS {k}) AS fp, CAST(0 AS {k}) AS fn FROM documents"""


@query(_CASES.format(k="BIGINT"))
def score_dotted(t):
    """Cells of fields of a struct, named by dots."""
    return _scored(t)


def _scored(t) -> DataFrame:
    marked = t.raw("documents").select(F.struct(F.when(c("lang") == "de", F.lit("[taint] x")).otherwise("x").alias("body"), "source").alias("mail"), "lang")
    df = label(marked, {"mail.body": "lang = 'de'"}).select("mail")
    return score(track(df).to_cells(), {"mail.body": True, "mail.source": False})


@query("SELECT CAST(1 AS DOUBLE) AS precision, CAST(1 AS DOUBLE) AS recall")
def score_precision_recall(t):
    return precision_recall(_scored(t))


@query("SELECT * FROM (VALUES ('c_name', 'customer.c_name'), ('s', 'orders.o_totalprice')) AS e(target, source)")
def lineage_columns(t):
    sums = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"))
    return lineage_edges(t.customer.join(sums, c("o_custkey") == c("c_custkey")).select("c_name", "s"))


@query("SELECT o_orderkey, false AS o_orderkey__tag, o_totalprice, o_orderstatus = 'F' AS o_totalprice__tag FROM orders WHERE o_totalprice > 1000")
def sink_and_source_cells(t):
    """Cells written as JSON and read with their tags."""
    from .sources import read_cells, write_cells

    path = _folder(t, "cells")
    tracked = track(t.orders.select("o_orderkey", "o_totalprice"))
    write_cells(tracked, "json", path)
    return flat(read_cells(t.spark, "json", path, tracked.to_cells().schema).where("o_totalprice > 1000"))


def _folder(t, name: str) -> str:
    """A new path in the folder that driver and executors share; a local session may use its own."""
    shared = t.spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not t.spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="provenant-")
    return f"{shared}/{name}-{os.urandom(6).hex()}"


_NATIONS = "SELECT n_nationkey, false AS n_nationkey__tag, n_name, true AS n_name__tag FROM nation"


@query(_NATIONS)
def source_csv(t):
    from .sources import read_csv

    path = _folder(t, "csv")
    t.raw("nation").write.csv(path, header=True)
    return flat(read_csv(t.spark, path, ["n_name"], "n_nationkey int, n_name string, n_regionkey int", header=True).select("n_nationkey", "n_name"))


@query(_NATIONS)
def source_tsv(t):
    from .sources import read_tsv

    path = _folder(t, "tsv")
    t.raw("nation").write.csv(path, sep="\t")
    return flat(read_tsv(t.spark, path, ["n_name"], "n_nationkey int, n_name string, n_regionkey int").select("n_nationkey", "n_name"))


@query(_NATIONS)
def source_named_dataset(t):
    from .sources import read_dataset, register_dataset

    register_dataset("nations", lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/nation.parquet"))
    return flat(read_dataset(t.spark, "nations", t.sf_dir, labels=["n_name"]).select("n_nationkey", "n_name"))


@query("SELECT 'customer.parquet' AS file, 0 AS step")
def lineage_source_path(t):
    """The path that a query's input came from, as its first step tells."""
    first = lineage(t.customer.select("c_name"))["steps"][0]
    return t.spark.createDataFrame([(first["input_dir"].rsplit("/", 1)[-1], first["id"])], "file string, step int")


@query("SELECT count(*) AS n FROM orders WHERE o_totalprice > 1000")
def count_action(t):
    n = track(t.orders.where("o_totalprice > 1000")).count()
    return t.spark.createDataFrame([(n,)], "n long")
