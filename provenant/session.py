"""One object for reading, labelling, querying and tracking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import sources
from .functions.lattice import BOOL_OR, Lattice
from .operators.frame import Tracked
from .operators.mapreduce import map_reduce
from .plans import labels
from .plans.lineage import lineage
from .plans.walker import track


class ProvenanceSession:
    """Settings of tracking for a Spark session; see `track` for what they mean."""

    def __init__(self, spark: SparkSession, lattice: Lattice = BOOL_OR, distinct: str = "values", implicit: str = "log"):
        self.spark, self.lattice, self.distinct, self.implicit = spark, lattice, distinct, implicit

    def read(self, format: str, path, labels=(), schema=None, **options) -> DataFrame:
        return sources.read(self.spark, format, path, labels, schema, **options)

    def dataset(self, name: str, *args, labels=()) -> DataFrame:
        return sources.read_dataset(self.spark, name, *args, labels=labels)

    def label(self, df: DataFrame, columns) -> DataFrame:
        return labels.label(df, columns)

    def track(self, df: DataFrame, **settings) -> Tracked:
        return track(df, **{"lattice": self.lattice, "distinct": self.distinct, "implicit": self.implicit} | settings)

    def sql(self, text: str, **frames: DataFrame) -> Tracked:
        """Track SQL text over views, and over DataFrames given by name in {braces}."""
        return self.track(self.spark.sql(text, **frames))

    def map_reduce(self, df: DataFrame, map_row, reduce_values, schema=None) -> Tracked:
        return self.track(map_reduce(df, map_row, reduce_values, schema, self.lattice))

    def lineage(self, df: DataFrame) -> dict:
        return lineage(df)
