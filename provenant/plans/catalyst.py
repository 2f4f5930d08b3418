"""Small bridge to Catalyst's plan and expression objects (classic sessions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.classic.column import Column as ClassicColumn


def analyzed(df: DataFrame):
    return df._jdf.queryExecution().analyzed()


def items(seq) -> list:
    """A Scala sequence as a list."""
    return [seq.apply(k) for k in range(seq.size())]


def kind(node) -> str:
    """Simple class name of a plan or expression."""
    return node.getClass().getSimpleName().rstrip("$")


class Bridge:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.jvm = spark._jvm

    def seq(self, values):
        out = self.jvm.java.util.ArrayList()
        for v in values:
            out.add(v)
        return self.jvm.scala.jdk.javaapi.CollectionConverters.asScala(out).toIndexedSeq()

    def frame(self, plan) -> DataFrame:
        jdf = self.jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, plan)
        return DataFrame(jdf, self.spark)

    def column(self, expression) -> Column:
        return ClassicColumn(self.jvm.org.apache.spark.sql.classic.ExpressionUtils.column(expression))

    def with_children(self, plan, frames: list[DataFrame]) -> DataFrame:
        return self.frame(plan.withNewChildren(self.seq([analyzed(f) for f in frames])))

    def as_attribute(self, expression, attribute):
        """`expression` under the name and expression id of `attribute`."""
        catalyst = self.jvm.org.apache.spark.sql.catalyst.expressions
        nothing = self.jvm.scala.Option.empty()
        return self.column(
            catalyst.Alias(expression, attribute.name(), attribute.exprId(), self.seq([]), nothing, self.seq([]))
        )

    def under_ids(self, frame: DataFrame, own: list, wanted: list) -> DataFrame:
        """`frame` whose attributes `own` get the names and ids of `wanted`; its other columns stay."""
        catalyst = self.jvm.org.apache.spark.sql.catalyst
        nothing = self.jvm.scala.Option.empty()
        ids = {key(a) for a in own}
        out = [
            a if key(a) == key(w) else catalyst.expressions.Alias(a, w.name(), w.exprId(), self.seq([]), nothing, self.seq([]))
            for a, w in zip(own, wanted, strict=True)
        ]
        out += [a for a in items(analyzed(frame).output()) if key(a) not in ids]
        return self.frame(catalyst.plans.logical.Project(self.seq(out), analyzed(frame)))


def key(attribute) -> int:
    return attribute.exprId().id()
