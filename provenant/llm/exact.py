"""Exact deduplication by content-defined chunk recipes, in DataFrame operations only.

A text is cut where its content says so, so equal stretches of different texts give equal
chunks.  A text's recipe is the ordered list of its chunks' identifiers, and texts are
compared by recipes; the texts themselves are never moved.  A chunk's identifier is its
64-bit hash once that is verified: a hash that occurs once names its chunk anyhow, and
only the chunks of repeated hashes are moved, once for each distinct chunk of a task, to
see whether they are equal.  Chunks that do share a hash get, besides, their rank among the
chunks of that hash.  So equal identifiers mean equal bytes.

Rows find their group through the list of groups of two rows and more.  It is sent to every
executor if measured small; else the largest groups are, and the others meet by a shuffle.

Decided cases: a null text counts as empty; empty texts have the empty recipe and are
equal to each other; rows that repeat a doc_id are rows of their own (all stay or all go);
a null doc_id never is the smallest unless a group has no other; extra columns are left
out by `exact_duplicates`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ROW, keep_first, numbered, table, written

#: A chunk has 256 characters at least, then goes on to the next word that begins with b to f behind
#: one that ends in d, g, l or r (about one word in thirty of English), or has 4096 characters.
CHUNK = r"(?s).{256,4096}?(?<=[dglr][ \n])(?=[b-f])|.{1,4096}"
#: Identifiers in the recipes of all groups, or hashes, up to which every executor gets them: 16 MB.
SENT_IDS = 2_000_000
#: Rows of a group from which on it is hot, and not shuffled to one task.
HOT_ROWS = 500


def normalised(text: Column) -> Column:
    """Runs of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _chunks() -> Column:
    return F.regexp_extract_all("norm", F.lit(CHUNK), F.lit(0))


def _shared(norm: DataFrame, recipes: DataFrame, hash_of: Callable[[str], Column]) -> tuple[DataFrame, DataFrame]:
    """(h, chunk) of the distinct chunks with a repeated hash, and the hashes (h) that several of them have."""
    ids = recipes.select(F.explode(F.slice("recipe", 2, F.lit((1 << 31) - 1))).alias("h"))
    again = written(ids.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "repeated-hashes")
    small = again.limit(SENT_IDS + 1).count() <= SENT_IDS
    chunks = norm.select(F.explode(_chunks()).alias("chunk")).select(hash_of("chunk").alias("h"), "chunk")
    held = chunks.join(F.broadcast(again) if small else again, "h", "left_semi")
    distinct = held.groupBy("h", "chunk").agg(F.count(F.lit(1)).alias("copies")).select("h", "chunk")
    shared = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    return distinct, written(shared, "shared-hashes")


def _recipes(norm: DataFrame, hash_of: Callable[[str], Column] = F.xxhash64) -> DataFrame:
    """Adds `recipe` to (doc_id, norm, ...): the number of chunks, their hashes, and the ranks that some need."""
    hashed = norm.withColumn("recipe", F.transform(_chunks(), lambda c: hash_of(c)))
    hashed = hashed.withColumn("recipe", F.concat(F.array(F.size("recipe").cast("long")), "recipe"))
    recipes = written(hashed.drop("norm"), "recipes")
    distinct, shared = _shared(norm, recipes, hash_of)
    if shared.isEmpty():
        return recipes
    return written(_told_apart(hashed, distinct, shared, _chunks(), hash_of).drop("norm"), "recipes")


def _told_apart(
    hashed: DataFrame, distinct: DataFrame, shared: DataFrame, chunks: Column, hash_of: Callable[[str], Column]
) -> DataFrame:
    """Recipes where some chunks share a hash: these take their rank as well."""
    ranked = distinct.join(shared, "h", "left_semi").withColumn(
        "rank", F.row_number().over(Window.partitionBy("h").orderBy("chunk"))
    )
    keyed = hashed.withColumn("_row", F.monotonically_increasing_id())
    keyed = written(keyed, "keyed")
    hit = (
        keyed.select("_row", F.posexplode(chunks).alias("pos", "chunk"))
        .withColumn("h", hash_of("chunk"))
        .join(ranked.select("h", "chunk", "rank"), ["h", "chunk"])
        .groupBy("_row")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "rank"))).alias("ranks"))
    )
    ranks = F.transform("ranks", lambda r: F.shiftleft(r["pos"].cast("long"), 24) + r["rank"])
    return (
        keyed.join(hit, "_row", "left")
        .withColumn("recipe", F.concat("recipe", F.coalesce(ranks, F.array().cast("array<long>"))))
        .drop("_row", "ranks")
    )


def exact_duplicates(docs: DataFrame, hash_of: Callable[[str], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of `docs`.

    `hash_of` gives the chunks' 64-bit hash; any function is right, a poor one is slow.
    """
    norm = docs.select("doc_id", normalised(F.col("text")).alias("norm")).withColumn("text_sha256", F.sha2("norm", 256))
    recipes = _recipes(norm, hash_of)
    groups = recipes.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = written(groups.where("group_size > 1"), "exact-groups")
    if _ids(groups) <= SENT_IDS:
        found = recipes.join(F.broadcast(groups), "recipe", "left")
    else:
        hot = groups.where(F.col("group_size") > HOT_ROWS)
        hot = F.broadcast(hot) if _ids(hot) <= SENT_IDS else hot
        rest = groups.where(F.col("group_size") <= HOT_ROWS)
        found = recipes.join(hot, "recipe").unionByName(recipes.join(hot, "recipe", "left_anti").join(rest, "recipe", "left"))
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256",
    )


def _ids(groups: DataFrame) -> int:
    """Identifiers in the recipes of `groups`."""
    return groups.agg(F.sum(F.size("recipe"))).first()[0] or 0


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows and columns of `docs`; of texts that are equal but for white space, the row of the smallest doc_id.

    Null and empty texts are equal; of repeated rows one stays; a null doc_id is last; an empty table stays empty.
    """
    rows = numbered(docs)
    found = exact_duplicates(rows.select(F.col(ROW).alias("doc_id"), "text"))
    return keep_first(rows, found.select(F.col("doc_id").alias(ROW), F.col("keep_id").alias("group")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), k AS (
  SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, sha256(norm) AS text_sha256
  FROM n WINDOW w AS (PARTITION BY norm)
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM k
"""
