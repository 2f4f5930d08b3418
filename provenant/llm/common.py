"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as every contract of these operators splits words.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where the session names none, a local master may use its own."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = spark.conf.get("provenant.test.checkpoint.dir", None)
    if not own:
        own = tempfile.mkdtemp(prefix="provenant-")
        spark.conf.set("provenant.test.checkpoint.dir", own)
    return own


#: Spark's setting by which the shuffle files of a query go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it again.

    Lineage ends at the files, so a lost executor costs no recomputation before them, and the
    shuffle files behind them are not needed any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    if partition_by:
        out = out.partitionBy(*partition_by)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        out.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    again = spark.read.schema(df.schema).parquet(path)
    again._written_at = path
    return again


def discard(*tables: DataFrame) -> None:
    """Delete `written` tables that nothing reads any more."""
    for df in tables:
        spark, path = df.sparkSession, getattr(df, "_written_at", None)
        if path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fold(doc_id: Column | str, modulus: int, rest: int) -> Column:
    """crc32 of the id as text, modulo `modulus`, equals `rest`; false for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(modulus)) == rest, F.lit(False))


#: What drops the caches that a worker process keeps between tasks.
DROPS: list[Callable[[], None]] = []


def drop_caches() -> None:
    """Called where a task of another operator begins in a worker that Spark uses again."""
    for drop in DROPS:
        drop()


def map_rows(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str, rows: int = 512, keep: bool = False
) -> DataFrame:
    """Apply `make()(batch)` to slices of at most `rows` rows; `make` runs once in each task.

    `keep`: the worker's caches are this operator's own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep:
            drop_caches()
        step = make()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                yield from step(batch.slice(start, rows))

    return df.mapInArrow(run, schema)


#: Bytes of text that are worked on together, but for a longer text.
BATCH_BYTES = 8 << 20


def byte_slices(batch: pa.RecordBatch, column: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with at most so many bytes of text, but for a longer text."""
    end = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(end[at - 1]) if at else 0
        n = max(1, int(np.searchsorted(end, before + most, "right")) - at)
        yield batch.slice(at, n)
        at += n


def record(**columns) -> pa.RecordBatch:
    """A record batch of named Arrow arrays."""
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


#: Rows of a few numbers up to which a table is sent to every executor; it is counted first.
SENT_ROWS = 500_000


def sent_if_small(df: DataFrame) -> DataFrame:
    """`df`, a written table of narrow rows, with a broadcast hint if its count allows; else Spark shuffles it."""
    return F.broadcast(df) if df.limit(SENT_ROWS + 1).count() <= SENT_ROWS else df


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of complete groups from batches sorted by the number column `key`; holds back only the last group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(column, column[-1], "left"))
        if held and held[-1].column(key)[-1].as_py() != column[0]:
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


#: Rows of one key from which on it is hot: they are not shuffled to one task.
HOT_ROWS = 1_000


def join_narrow(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """`left` joined with `right`, a written table of narrow rows, unique in `key`; both are read several times.

    Sent to every executor if counted small.  Else the rows of `right` for hot keys are, of which
    there are at most one for HOT_ROWS rows of `left`, and the others meet by a shuffle.
    """
    if right.limit(SENT_ROWS + 1).count() <= SENT_ROWS:
        return left.join(F.broadcast(right), key, how)
    hot = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT_ROWS).select(key)
    hot = written(hot, "hot-keys")
    if hot.isEmpty():
        return left.join(right, key, how)
    hot = sent_if_small(hot)
    few = sent_if_small(right.join(hot, key, "left_semi"))
    plain = left.join(hot, key, "left_anti").join(right, key, how)
    return left.join(hot, key, "left_semi").join(few, key, how).unionByName(plain)


#: The column that tells rows apart, whatever they hold.
ROW = "_row_of_documents"


def numbered(docs: DataFrame) -> DataFrame:
    """`docs`, written, with a number for each row in ROW; repeated rows have numbers of their own."""
    return written(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def keep_first(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Of each group, the row of the smallest doc_id (a null one is last; of equal ids, the first row).

    `rows` is `numbered`, `groups` has (ROW, group) for each.  Only numbers are compared; texts
    move only if the list of what goes is too long to be sent to every executor.  An empty
    table stays empty.
    """
    groups = written(groups.select(ROW, "group"), "row-groups")
    many = written(groups.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group"), "row-many")
    doc = rows.select(ROW, F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"))
    held = written(join_narrow(groups, many, "group").join(doc, ROW), "row-held")
    first = written(held.groupBy("group").agg(F.min(F.struct("doc", ROW)).alias("first")), "row-first")
    gone = written(join_narrow(held, first, "group").where(F.col(ROW) != F.col(f"first.{ROW}")).select(ROW), "row-gone")
    return rows.join(sent_if_small(gone), ROW, "left_anti").drop(ROW)
