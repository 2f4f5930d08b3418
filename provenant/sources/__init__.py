"""Labelled sources and sinks of tagged cells."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import LabelError
from ..operators.frame import Tracked
from ..plans.labels import from_cells, label

Labels = Iterable[str] | Mapping[str, Column | str | None]

#: Named datasets: name -> loader(spark, *args) giving a DataFrame.
_LOADERS: dict[str, Callable[..., DataFrame]] = {}
#: Formats that Spark has under another name.
_FORMATS: dict[str, tuple[str, dict[str, str]]] = {"tsv": ("csv", {"sep": "\t"})}


def register_dataset(name: str, loader: Callable[..., DataFrame]) -> None:
    """Make `read_dataset(name)` call `loader(spark, *args)`."""
    _LOADERS[name] = loader


def read(
    spark: SparkSession, format: str, path: str | list[str], labels: Labels = (), schema: T.StructType | str | None = None, **options
) -> DataFrame:
    """Read any Spark format, or "tsv", and label columns."""
    kind, own = _FORMATS.get(format, (format, {}))
    reader = spark.read.format(kind).options(**own | options)
    df = (reader.schema(schema) if schema is not None else reader).load(path)
    return label(df, labels)


def read_json(spark: SparkSession, path, labels: Labels = (), schema=None, **options) -> DataFrame:
    return read(spark, "json", path, labels, schema, **options)


def read_parquet(spark: SparkSession, path, labels: Labels = ()) -> DataFrame:
    return read(spark, "parquet", path, labels)


def read_csv(spark: SparkSession, path, labels: Labels = (), schema=None, **options) -> DataFrame:
    return read(spark, "csv", path, labels, schema, **options)


def read_tsv(spark: SparkSession, path, labels: Labels = (), schema=None, **options) -> DataFrame:
    return read(spark, "tsv", path, labels, schema, **options)


def read_dataset(spark: SparkSession, name: str, *args, labels: Labels = ()) -> DataFrame:
    """A registered dataset, labelled."""
    if name not in _LOADERS:
        raise LabelError(f"no dataset {name!r}; known: {sorted(_LOADERS)}")
    return label(_LOADERS[name](spark, *args), labels)


def read_cells(spark: SparkSession, format: str, path, schema=None, **options) -> DataFrame:
    """Data stored as {value, tag} cells, with its tags."""
    reader = spark.read.format(format).options(**options)
    return from_cells((reader.schema(schema) if schema is not None else reader).load(path))


def write_cells(tracked: Tracked, format: str, path: str, mode: str = "errorifexists", **options) -> None:
    """Write every column as {value, tag} cells."""
    tracked.to_cells().write.format(format).mode(mode).options(**options).save(path)


def write_flat(tracked: Tracked, format: str, path: str, mode: str = "errorifexists", **options) -> None:
    """Write each column c beside c__tag, which columnar formats prune and push down."""
    tracked.to_flat().write.format(format).mode(mode).options(**options).save(path)
