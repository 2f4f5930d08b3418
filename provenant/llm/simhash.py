"""SimHash near-duplicates by bit-sliced comparison.

Fingerprint: 64 majority bits of the XXH64 hashes of a text's word shingles.  Texts of
equal fingerprint are one class from the start, so only distinct fingerprints are compared.

Candidates: fingerprints at most `radius` bits apart agree in at least two of radius + 2
blocks, so every link meets in the bucket of some pair of blocks.  A bucket holds distinct
fingerprints as 64 vertical bit planes.  A component is grown from one fingerprint: its
distance to all not yet reached is counted plane by plane with carry-save counters, 64 rows
in a machine word, and a block of words is abandoned once all its rows exceed the radius.
What is reached leaves the planes, so a bucket of one large near-copy group costs about its
size, and a bucket emits one edge for each fingerprint that it links, never all pairs.
A crowded bucket is dealt out again by a further block of the bits that its key leaves
open, which every pair within the radius must share too.

Components: edges of all buckets are contracted by hooking and pointer jumping over tables.

Decided cases: a null or empty text has no words and fingerprint zero, linked like any
other; fewer words than a shingle are one shingle; repeated rows and repeated ids give
repeated results; null ids get a component but are never its name unless alone; extra
columns are left out by `near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, byte_slices, discard, drop_caches, join_narrow, keep_first, map_rows, numbered, record, sent_if_small, table, whole_groups, written

SHINGLE = 4
RADIUS = 4
#: Fingerprints of a bucket above which it is dealt out again.
CROWDED = 4096
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


# -- fingerprints -----------------------------------------------------------


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bit b is set if over half of the shingles' hashes have it."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    digest = xxhash.xxh64_intdigest
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[: len(words) - shingle])]
    hashes = [digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :], strict=True)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = np.array(hashes[at : at + 4096], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long): the fingerprint's 64 bits as a signed number."""

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            fp = np.array([fingerprint(t or "", shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield record(doc_id=batch.column(0), fp=pa.array(fp.view(np.int64), pa.int64()))

        return step

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, fp long")


# -- bit-sliced comparison --------------------------------------------------


class BitPlanes:
    """Distinct values as bit planes, one for each of their bits; row r is bit r % 64 of word r // 64."""

    #: Words counted together, and abandoned together.
    BLOCK = 64

    def __init__(self, values: np.ndarray):
        """`values`: one 64-bit word a row, or several in a row of a matrix."""
        rows = values.reshape(len(values), -1).astype("<u8")
        bits = np.unpackbits(rows.view(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")
        padded = np.zeros((bits.shape[1], -(-len(values) // 64) * 64), np.uint8)
        padded[:, : len(values)] = bits.T
        self.planes = np.ascontiguousarray(np.packbits(padded, axis=1, bitorder="little")).view("<u8")
        self.live = np.zeros(self.planes.shape[1] * 64, np.bool_)
        self.live[: len(values)] = True

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of live rows at most `radius` bits from a query.

        Differences are added to counters of log2(radius + 1) planes by carry-save steps;
        a carry out of the top marks a row as beyond for good.
        """
        alive = np.packbits(self.live, bitorder="little").view("<u8")
        words = np.flatnonzero(alive)
        ones = queries.reshape(len(queries), -1, 1) >> np.arange(64, dtype=np.uint64) & np.uint64(1)
        asked = np.where(ones.reshape(len(queries), -1), ~np.uint64(0), np.uint64(0))
        who, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        top = radius.bit_length()
        bias = (1 << top) - 1 - radius  # counting from here, one more than radius overflows
        for at in range(0, len(words), self.BLOCK):
            block = words[at : at + self.BLOCK]
            planes = self.planes[:, block]
            shape = len(queries), len(block)
            beyond = np.broadcast_to(~alive[block], shape).copy()
            count = [np.full(shape, ~np.uint64(0) if bias >> k & 1 else np.uint64(0)) for k in range(top)]
            for b in range(len(planes)):
                carry = planes[b] ^ asked[:, b : b + 1]
                for k in range(top):
                    both = count[k] & carry
                    count[k] ^= carry
                    carry = both
                beyond |= carry
                if b % 8 == 7 and (beyond == ~np.uint64(0)).all():
                    break
            else:
                query, word = np.nonzero(beyond != ~np.uint64(0))
                bits = np.unpackbits((~beyond[query, word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                hit, bit = np.nonzero(bits)
                who.append(query[hit])
                rows.append(block[word[hit]] * 64 + bit)
        return np.concatenate(who), np.concatenate(rows)


#: Queries compared at once.
_TOGETHER = 64
#: Fewer than these are compared by popcount, as planes don't pay for them.
_FEW = 8


def forest(values: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges between distinct values that join all linked within `radius`."""
    return [(int(values[a]), int(values[b])) for a, b in forest_rows(values, radius)]


#: Of rows a and rows b, which pairs may be linked.
Fit = Callable[[np.ndarray, np.ndarray], np.ndarray] | None


def forest_rows(values: np.ndarray, radius: int, fit: Fit = None) -> list[tuple[int, int]]:
    """Pairs of row numbers that join all rows linked within `radius`, if they `fit`: about one for each row, never all pairs."""
    if len(values) < 2:
        return []
    if len(values) < 33:  # planes don't pay for few rows
        return _small_forest(values, radius, fit)
    planes, edges, seed = BitPlanes(values), [], 0
    while True:
        # not reached: compared with each other, too
        queries = seed + np.flatnonzero(planes.live[seed : len(values)])[:_TOGETHER]
        if not len(queries):
            return edges
        seed = int(queries[-1]) + 1
        who, rows = planes.within(values[queries], radius)
        at = queries[who]
        good = at != rows
        if fit:
            good[good] = fit(at[good], rows[good])
        at, rows = at[good], rows[good]
        linked = np.unique(at)
        planes.live[np.setdiff1d(queries, linked)] = False
        for first in linked.tolist():
            if planes.live[first]:
                planes.live[first] = False
                edges += _grow(planes, values, first, rows[at == first], radius, fit)


def _grow(planes: BitPlanes, values: np.ndarray, first: int, near: np.ndarray, radius: int, fit: Fit) -> list[tuple[int, int]]:
    """Edges of one row's component, taken from the live rows; `near` has the rows within the radius of `first`.

    One component at a time: what is reached leaves the planes, as rows of one component need not be
    compared with each other, while rows of two that are grown together would have to be.
    """
    edges, stack = [], []
    who, rows = np.full(len(near), first), near
    while True:
        rows, at = np.unique(rows, return_index=True)
        new = planes.live[rows]
        rows, who = rows[new], who[at[new]]
        planes.live[rows] = False
        edges += zip(who.tolist(), rows.tolist(), strict=True)
        stack += rows.tolist()
        if not stack:
            return edges
        queries = np.array(stack[-_TOGETHER:])
        del stack[-_TOGETHER:]
        if len(queries) < _FEW:
            left = np.flatnonzero(planes.live)
            apart = [np.bitwise_count(values[left] ^ values[q]) for q in queries]
            hits = [left[(d if d.ndim == 1 else d.sum(1)) <= radius] for d in apart]
            who, rows = np.repeat(queries, [len(h) for h in hits]), np.concatenate(hits)
        else:
            who, rows = planes.within(values[queries], radius)
            who = queries[who]
        if fit and len(rows):
            good = fit(who, rows)
            who, rows = who[good], rows[good]


def _small_forest(values: np.ndarray, radius: int, fit: Fit = None) -> list[tuple[int, int]]:
    rows = values.reshape(len(values), -1)
    near = np.bitwise_count(rows[:, None] ^ rows[None]).sum(2) <= radius
    if fit:
        a, b = np.nonzero(near)
        near[a, b] = fit(a, b)
    left, edges = np.ones(len(values), np.bool_), []
    for seed in range(len(values)):
        if not left[seed]:
            continue
        left[seed] = False
        stack = [seed]
        while stack:
            at = stack.pop()
            for k in np.flatnonzero(near[at] & left):
                left[k] = False
                edges.append((at, int(k)))
                stack.append(int(k))
    return edges


# -- buckets ----------------------------------------------------------------


def _blocks(bits: list[int], parts: int) -> list[list[int]]:
    return [[int(b) for b in part] for part in np.array_split(np.array(bits), parts)]


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def keyed(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(which, key, fp): a row for each pair of the radius + 2 blocks of bits."""
    blocks = _blocks(list(range(64)), radius + 2)
    masks = [_signed(_mask(a) | _mask(b)) for a, b in combinations(blocks, 2)]
    rows = F.transform(
        F.array(*(F.struct(F.lit(k).alias("which"), F.lit(m).alias("mask")) for k, m in enumerate(masks))),
        lambda m: F.struct(m["which"].alias("which"), F.col("fp").bitwiseAND(m["mask"]).alias("key")),
    )
    return fps.select("fp", F.inline(rows)).select("which", "key", "fp")


def dealt_again(crowded: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(which, key, part, sub, fp): rows of crowded buckets by each of radius + 1 blocks of their open bits."""
    blocks = _blocks(list(range(64)), radius + 2)
    cells = []
    for k, (a, b) in enumerate(combinations(blocks, 2)):
        rest = [x for block in blocks if block is not a and block is not b for x in block]
        parts = [F.lit(_signed(_mask(p))) for p in _blocks(rest, radius + 1)]
        cells.append((k, F.array(*parts)))
    masks = F.coalesce(*(F.when(F.col("which") == k, a) for k, a in cells))
    split = crowded.select("which", "key", "fp", F.posexplode(masks).alias("part", "mask"))
    return split.select("which", "key", "part", F.col("fp").bitwiseAND(F.col("mask")).alias("sub"), "fp")


def links(fps: DataFrame, radius: int = RADIUS, crowded: int = CROWDED) -> DataFrame:
    """(a, b) edges between distinct fingerprints that join all within the radius."""
    rows = keyed(fps, radius)
    sizes = rows.groupBy("which", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = rows.join(sizes, ["which", "key"])
    sized = written(sized, "simhash-buckets")

    def grow_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Small buckets lie behind each other in a sorted partition: one pass, not one call for each."""
        drop_caches()
        names = None
        held: list[pa.RecordBatch] = []

        def out(cols: list[np.ndarray]) -> pa.RecordBatch:
            *keys, fp = cols
            new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            fp, begin = fp.view(np.uint64), np.concatenate([[0], new])
            size = np.diff(np.append(begin, len(fp)))
            two = begin[size == 2]
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
            edges = [e for k, n in zip(begin[size > 2], size[size > 2], strict=True) for e in forest(fp[k : k + n], radius)]
            pairs = np.concatenate([np.array(edges, np.uint64).reshape(-1, 2), np.stack([fp[two], fp[two + 1]], 1)]).view(np.int64)
            return record(a=pa.array(pairs[:, 0]), b=pa.array(pairs[:, 1]))

        for batch in batches:
            names = batch.schema.names
            held.append(batch)
            whole = pa.Table.from_batches(held)
            cols = [whole.column(c).to_numpy() for c in names]
            *keys, _ = cols
            changed = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))
            if len(changed):  # the last bucket may go on in the next batch
                cut = int(changed[-1]) + 1
                yield out([c[:cut] for c in cols])
                held = whole.slice(cut).combine_chunks().to_batches()
        if held:
            whole = pa.Table.from_batches(held)
            yield out([whole.column(c).to_numpy() for c in names])

    def swept(df: DataFrame, keys: list[str]) -> DataFrame:
        dealt = df.repartition(*keys).sortWithinPartitions(*keys, "fp")
        return dealt.select(*keys, "fp").mapInArrow(grow_all, "a long, b long")

    few = swept(sized.where(F.col("n") <= crowded), ["which", "key"])
    many = swept(dealt_again(sized.where(F.col("n") > crowded), radius), ["which", "key", "part", "sub"])
    return few.unionByName(many).distinct()


# -- components -------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): root is the smallest node that it reaches.

    Each round hooks every node to the smallest of its neighbours' roots and jumps pointers;
    edges inside one root drop out, and the rounds end when none is left.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    roots = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).select(F.col("a").alias("node"), "root"), "cc-0")
    open_edges = edges
    k = 0
    while True:
        k += 1
        roots = _jumped(roots, k)
        of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: B023, E731
        mapped = join_narrow(join_narrow(open_edges, of("a"), "a"), of("b"), "b").where("a_root <> b_root")
        open_edges = written(mapped.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), f"cc-edges-{k}")
        if open_edges.isEmpty():
            return roots
        hooks = written(open_edges.groupBy(F.col("b").alias("root")).agg(F.min("a").alias("new")), f"cc-hooks-{k}")
        hooked = join_narrow(roots, hooks, "root", "left")
        roots = written(hooked.select("node", F.coalesce("new", "root").alias("root")), f"cc-{k}")


def _jumped(roots: DataFrame, k: int) -> DataFrame:
    """Every pointer followed to its end."""
    while True:
        up = roots.select(F.col("node").alias("root"), F.col("root").alias("above"))
        moved = join_narrow(roots, up, "root", "left")
        moved = moved.select("node", F.coalesce("above", "root").alias("next"), "root")
        moved = written(moved, f"cc-jump-{k}")
        roots = moved.select("node", F.col("next").alias("root"))
        if moved.where("next <> root").isEmpty():
            return roots


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id), a row for each row of `docs`."""
    fps = written(fingerprints(docs, shingle), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    edges = written(links(distinct.select("fp"), radius), "simhash-edges")
    roots = components(edges)
    classes = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = written(classes, "simhash-classes")
    names = written(classes.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-names")
    named = written(join_narrow(classes.select("fp", "root"), names, "root").select("fp", "component_id"), "simhash-named")
    return join_narrow(fps, named, "fp").select("doc_id", "fp", "component_id")


# -- near copies of a given similarity ------------------------------------------

WORDS, SIMILARITY = 5, 0.8
#: Of 128 bits, how many all but about one in a hundred pairs of that similarity and above differ in at most.
WIDE_RADIUS = 27
#: Bits of a set's parities; two sets differ in at least as many members as their parities in bits.
PARITIES = 256
_PARITY = [f"p{k}" for k in range(PARITIES // 64)]
#: Texts of one bucket above which it is split.
CROWD = 4_096
#: Texts that share a member above which it is put last in the order of members.
OFTEN = 32
#: Texts looked at together for members that many of them share, and how many must.
_LOOK, _MANY = 4_096, 8
#: Members put last at most, the most frequent ones: 8 MB for each executor.
LATE = 500_000
#: Times that members are put last, at most; more would only save time.
_ROUNDS = 3
#: Pairs of one text whose sets meet in one task.
PAIRS_TOGETHER = 500


def shingle_hashes(text: str, shingle: int = WORDS) -> np.ndarray:
    """128-bit hashes of a text's distinct shingles, a row each, in order of the first word's upper 63 bits.

    These 63 bits tell shingles apart; where there are no words, one empty shingle.
    """
    words = text.encode().translate(_LOWER).split()
    joined, digest = b" ".join(words), xxhash.xxh3_128_digest
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[: max(0, len(words) - shingle)])]
    each = [digest(joined[a:b]) for a, b in zip(starts, ends[shingle - 1 :] or [len(joined)], strict=True)]
    rows = np.frombuffer(b"".join(each), "<u8").reshape(-1, 2)
    return rows[np.unique(rows[:, 0] >> np.uint64(1), return_index=True)[1]]


def _members(hashes: np.ndarray) -> np.ndarray:
    return (hashes[:, 0] >> np.uint64(1)).astype(np.int64)


def shingle_set(text: str, shingle: int = WORDS) -> np.ndarray:
    """Sorted distinct 63-bit hashes of a text's shingles."""
    return _members(shingle_hashes(text, shingle))


def _majority(hashes: np.ndarray) -> np.ndarray:
    """128 bits as two words: those that over half of the hashes have."""
    ones = np.zeros(128, np.int64)
    for at in range(0, len(hashes), 4096):
        part = np.ascontiguousarray(hashes[at : at + 4096]).view(np.uint8).reshape(-1, 16)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)


def _parities(members: np.ndarray) -> np.ndarray:
    odd = np.bincount(members % PARITIES, minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least 4 in 5, `SIMILARITY`."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def described(rows: DataFrame) -> DataFrame:
    """(row, lo, hi, k0, k1, n, p0.., often) of (row, text): fingerprint, the set's own hash, size and parities.

    `often` has, at one row of each batch, the members that several texts of the batch share, and how many do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        for batch in batches:
            for at in range(0, batch.num_rows, _LOOK):
                for part in byte_slices(batch.slice(at, _LOOK), 1):
                    yield describe(part)

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = [shingle_hashes(t or "") for t in batch.column(1).to_pylist()]
        sets = [_members(x) for x in hashes]
        bits = np.stack([_majority(x) for x in hashes])
        own = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets), np.int64).reshape(-1, 2)
        odd = np.stack([_parities(x) for x in sets])
        parities = {c: pa.array(odd[:, k]) for k, c in enumerate(_PARITY)}
        member, count = np.unique(np.concatenate(sets), return_counts=True)
        member, count = member[count >= _MANY], count[count >= _MANY]
        bounds = pa.array([0, *[len(member)] * len(sets)], pa.int32())
        often = pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays([pa.array(member), pa.array(count)], ["h", "n"]))
        return record(
            row=batch.column(0), lo=pa.array(bits[:, 0]), hi=pa.array(bits[:, 1]), k0=pa.array(own[:, 0]), k1=pa.array(own[:, 1]),
            n=pa.array([len(x) for x in sets], pa.int64()), **parities, often=often,
        )

    columns = ", ".join(f"{c} long" for c in ("row", "lo", "hi", "k0", "k1", "n", *_PARITY))
    return rows.mapInArrow(run, f"{columns}, often array<struct<h: long, n: long>>")


def _hottest(counts: DataFrame, late: pd.Series | None = None) -> pd.Series:
    """The most frequent members of the written (h, n) and of `late`, LATE of them at most: their n by h, rarest first."""
    if counts.limit(LATE + 1).count() > LATE:
        counts = counts.orderBy(F.desc("n"), "h").limit(LATE)
    found = counts.toPandas().set_index("h")["n"].astype(np.int64)
    if late is not None:
        found = pd.concat([late, found]).groupby(level=0).max()
    return found.sort_index().sort_values(kind="stable").tail(LATE)


def prefix_length(n: int) -> int:
    """So many of the first of n members that a set of the similarity has one of its own first ones among them."""
    return n - (4 * n + 4) // 5 + 1


def prefixes(texts: DataFrame, late: np.ndarray) -> DataFrame:
    """(node, top, members) of (node, text): the first members in the order of hashes, those in `late` behind all others, in its order.

    `top` is the last one's place in that order.
    """
    order = np.argsort(late)
    sent = texts.sparkSession.sparkContext.broadcast((late[order], order))

    def make():
        late, place = sent.value

        def first(members: np.ndarray) -> tuple[int, np.ndarray]:
            k = prefix_length(len(members))
            if len(late):
                at = np.minimum(np.searchsorted(late, members), len(late) - 1)
                hot = late[at] == members
                members, at = members[~hot], at[hot]
                if k > len(members):
                    last = at[np.argsort(place[at])[: k - len(members)]]
                    return int(place[last[-1]]), np.concatenate([members, late[last]])
            return int(members[k - 1]) - (1 << 63), members[:k]

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            top, own = zip(*(first(shingle_set(t or "")) for t in batch.column(1).to_pylist()), strict=True)
            bounds = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in own])]), pa.int32())
            yield record(node=batch.column(0), top=pa.array(top, pa.int64()), members=pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(own))))

        return step

    return map_rows(texts, make, "node long, top long, members array<long>")


def shared_members(members: DataFrame) -> DataFrame:
    """Of (h, node), those whose h has several rows."""

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        for whole in whole_groups(batches, "h"):
            h = whole.column("h").to_numpy()
            same = np.concatenate([[False], h[1:] == h[:-1], [False]])
            yield from whole.filter(pa.array(same[1:] | same[:-1])).to_batches()

    return members.repartition("h").sortWithinPartitions("h").mapInArrow(several, "h long, node long")


def shared_prefixes(texts: DataFrame, often: pd.Series) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node, top, members), (h, node) of shared members, and (h, n) of those that over CROWD texts share.

    Any one order of members loses no pair.  Members that many texts share are put last, the most
    frequent behind the others, so they count for those texts only that consist of such members by
    four parts in five: `often` has those known to be frequent, others are added as they show.
    """
    late, before = often, None
    for k in range(_ROUNDS + 1):
        lists = written(prefixes(texts, late.index.to_numpy(np.int64)), "similar-prefixes")
        shared = written(shared_members(lists.select(F.explode("members").alias("h"), "node")), "similar-shared")
        many = written(shared.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > OFTEN), "similar-many")
        pairs = many.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0
        if k == _ROUNDS or not pairs or before is not None and 2 * pairs > before:
            break
        hot = _hottest(many, late)
        if hot.index.isin(late.index).all():
            break
        late, before = hot, pairs
        discard(lists, shared, many)
    return lists, shared, written(many.where(F.col("n") > CROWD), "similar-crowds")


class _Facts:
    """What is known of the rows of a bucket table: whether two can have the similarity at all."""

    def __init__(self, whole: pa.Table):
        self.n = whole.column("n").to_numpy()
        self.odd = np.stack([whole.column(c).to_numpy() for c in _PARITY], 1).view(np.uint64)  # popcount takes signed numbers without their sign

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n, m = self.n[a], self.n[b]
        return (5 * np.minimum(n, m) >= 4 * np.maximum(n, m)) & (9 * np.bitwise_count(self.odd[a] ^ self.odd[b]).sum(1, dtype=np.int64) <= n + m)


def wide_links(held: DataFrame, crowds: DataFrame, radius: int = WIDE_RADIUS) -> DataFrame:
    """(a, b) edges between rows of (h, node, lo, hi, n, p0..) that share an h, and join near all of one bucket within the radius.

    A crowded bucket is grown in blocks.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        for whole in whole_groups(batches, "bucket"):
            bucket, node, lo, hi = (whole.column(c).to_numpy() for c in ("bucket", "node", "lo", "hi"))
            values, facts = np.stack([lo, hi], 1).view(np.uint64), _Facts(whole)
            begin = np.flatnonzero(np.concatenate([[True], np.diff(bucket) != 0]))
            size = np.diff(np.append(begin, len(bucket)))
            left = np.repeat(begin + size, size) - np.arange(len(bucket))  # rows of the bucket from here on
            few = np.repeat(size <= 8, size)
            pairs = []
            for lag in range(1, 8):
                at = np.flatnonzero(few & (left > lag))
                at = at[np.bitwise_count(values[at] ^ values[at + lag]).sum(1) <= radius]
                at = at[facts.fit(at, at + lag)]
                pairs.append(np.stack([node[at], node[at + lag]], 1))
            for k, n in zip(begin[size > 8].tolist(), size[size > 8].tolist(), strict=True):
                fit = lambda a, b, k=k: facts.fit(a + k, b + k)
                found = np.array(forest_rows(values[k : k + n], radius, fit), np.int64).reshape(-1, 2)
                pairs.append(node[k : k + n][found])
            edges = np.unique(np.sort(np.concatenate(pairs), 1), axis=0)
            yield record(a=pa.array(edges[:, 0]), b=pa.array(edges[:, 1]))

    blocks = sent_if_small(crowds.select("h", F.ceil(F.col("n") / CROWD).alias("blocks")))
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    rows = held.join(blocks, "h", "left").withColumn("bucket", F.when(F.col("blocks").isNull(), F.col("h")).otherwise(F.xxhash64("h", block)))
    rows = rows.select("bucket", "node", "lo", "hi", "n", *_PARITY)
    return rows.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(compare, "a long, b long").distinct()


def open_pairs(held: DataFrame, crowds: DataFrame) -> DataFrame:
    """(a, b) of (h, node, root, n, top, p0..) that are of two components and may have the similarity.

    Sizes, parities and the number of members that both prefixes share rule out only what can't
    have it.  Each row of a crowded bucket goes to the pairs of blocks that its own block is in,
    so that every two rows meet in some task.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        for whole in whole_groups(batches, "bucket"):
            bucket, root = (whole.column(c).to_numpy() for c in ("bucket", "root"))
            begin = np.flatnonzero(np.concatenate([[True], np.diff(bucket) != 0]))
            mixed = np.minimum.reduceat(root, begin) != np.maximum.reduceat(root, begin)
            keep = np.repeat(mixed, np.diff(np.append(begin, len(bucket))))
            if not keep.any():
                continue
            whole = whole.filter(pa.array(keep))
            bucket, node, root, top, side = (whole.column(c).to_numpy() for c in ("bucket", "node", "root", "top", "side"))
            facts = _Facts(whole)
            n, rest = facts.n, facts.n - prefix_length(facts.n)
            left, at = np.searchsorted(bucket, bucket, "right") - np.arange(len(bucket)), np.arange(len(bucket))
            out, count = [], 0

            def pairs(found: list) -> pa.RecordBatch:
                rows = np.concatenate(found)
                return record(a=pa.array(rows[:, 0]), b=pa.array(rows[:, 1]), need=pa.array(rows[:, 2]))

            for lag in range(1, int(left.max())):
                at = at[left[at] > lag]
                at = at[5 * n[at] >= 4 * n[at + lag]]  # sizes ascend, so a row that is too small stays so
                k = at[(root[at] != root[at + lag]) & ((side[at] != side[at + lag]) | (side[at] == 0))]
                k = k[facts.fit(k, k + lag)]
                if len(k):
                    # beyond the lower of both tops, the set of that top has `rest` members
                    beyond = np.where(top[k] < top[k + lag], rest[k], rest[k + lag])
                    need = (4 * (n[k] + n[k + lag]) + 8) // 9 - beyond
                    out.append(np.stack([np.minimum(node[k], node[k + lag]), np.maximum(node[k], node[k + lag]), need], 1))
                    count += len(k)
                if count > 500_000:
                    yield pairs(out)
                    out, count = [], 0
            if out:
                yield pairs(out)

    blocks = sent_if_small(crowds.select("h", F.ceil(F.col("n") / CROWD).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    meets = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda x: F.struct(
            F.xxhash64("h", F.least(x, own), F.greatest(x, own)).alias("bucket"),
            F.when(x == own, 0).when(own < x, 1).otherwise(2).alias("side"),
        ),
    )
    rows = held.join(blocks, "h", "left")
    alone = rows.where("blocks is null").withColumn("bucket", F.col("h")).withColumn("side", F.lit(0))
    crowded = rows.where("blocks is not null").withColumn("meet", F.explode(meets)).select("*", "meet.bucket", "meet.side")
    names = ("bucket", "side", "node", "root", "n", "top", *_PARITY)
    dealt = alone.select(*names).unionByName(crowded.select(*names)).repartition("bucket").sortWithinPartitions("bucket", "n", "node")
    found = dealt.mapInArrow(compare, "a long, b long, need long")
    return found.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.first("need").alias("need")).where("shared >= need").select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The written pairs (a, b) of (node, text) whose texts have the similarity, written."""
    named = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "similar-named")

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            sets = [shingle_set(t or "").tobytes() for t in batch.column(1).to_pylist()]
            yield record(node=batch.column(0), members=pa.array(sets, pa.binary()))

        return step

    def check():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            sets = [[np.frombuffer(x, np.int64) for x in batch.column(c).to_pylist()] for c in (2, 3)]
            good = pa.array([similar(x, y) for x, y in zip(*sets, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(good)

        return step

    sets = written(map_rows(texts.join(sent_if_small(named), "node", "left_semi").select("node", "text"), make, "node long, members binary"), "similar-sets")
    both = _with_members(_with_members(pairs, sets, "b"), sets, "a").select("a", "b", "a_members", "b_members")
    links = written(map_rows(both, check, "a long, b long", 64), "similar-links")
    discard(named, sets)
    return links


def _with_members(pairs: DataFrame, sets: DataFrame, c: str) -> DataFrame:
    """Adds the set of node `c`; that of a node of very many pairs goes to several tasks."""
    of = sets.select(F.col("node").alias(c), F.col("members").alias(f"{c}_members"))
    copies = pairs.groupBy(c).agg(F.ceil(F.count(F.lit(1)) / PAIRS_TOGETHER).cast("int").alias("copies")).where("copies > 1")
    copies = written(copies, "similar-copies")
    if copies.isEmpty():
        return pairs.join(of, c)
    copies = sent_if_small(copies)
    left = pairs.join(copies, c, "left").withColumn("copy", F.pmod(F.xxhash64("a", "b"), F.coalesce("copies", F.lit(1))).cast("int"))
    right = of.join(copies, c, "left").withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)))
    return left.drop("copies").join(right.drop("copies"), [c, "copy"]).drop("copy")


def similar_rows(rows: DataFrame) -> DataFrame:
    """(row, component) of `numbered` rows whose texts are linked by a Jaccard similarity of 0.8 or more on distinct 5-word shingles.

    Every link is verified on the texts, and none is lost.  Texts of that similarity share one
    of the first fifth of their members, whatever the members' order, so every link meets in
    the bucket of a shared one.  In a bucket bit-sliced fingerprints grow components; their
    verified edges join near all.  Then pairs that share a bucket and are still apart are
    verified, but for those that can't have the similarity.
    """
    texts = rows.select(F.col(ROW).alias("node"), "text")
    facts = written(described(texts), "similar-facts")
    first = [F.first(c).alias(c) for c in ("lo", "hi", "n", *_PARITY)]
    nodes = written(facts.groupBy("k0", "k1").agg(F.min("row").alias("node"), *first), "similar-nodes")
    gone = written(facts.select(F.col("row").alias("node")).join(nodes.select("node"), "node", "left_anti"), "similar-gone")
    texts = texts.join(sent_if_small(gone), "node", "left_anti")
    often = written(facts.select(F.inline("often")).groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > OFTEN), "similar-often")
    lists, shared, crowds = shared_prefixes(texts, _hottest(often))
    known = written(nodes.join(lists.select("node", "top"), "node").select("node", "lo", "hi", "n", "top", *_PARITY), "similar-known")
    held = written(join_narrow(shared, known, "node"), "similar-held")
    discard(lists, shared)
    edges = verified(written(wide_links(held, crowds), "similar-edges"), texts)
    roots = components(edges)
    if not crowds.isEmpty():  # blocks of one bucket meet in one row for each component
        names = join_narrow(held.join(sent_if_small(crowds.select("h")), "h", "left_semi"), roots, "node", "left")
        names = names.groupBy("h", F.coalesce("root", "node").alias("root")).agg(F.min("node").alias("node"))
        again = join_narrow(written(names.select("h", "node"), "similar-again"), known, "node")
        few = written(again.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD), "similar-crowds")
        more = verified(written(wide_links(again, few), "similar-edges"), texts)
        edges = edges.unionByName(more)
        roots = components(edges)
    apart = join_narrow(held.drop("lo", "hi"), roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    more = verified(written(open_pairs(apart, crowds), "similar-pairs"), texts)
    discard(held)
    roots = components(edges.unionByName(more))
    classes = nodes.join(roots, "node", "left").select("k0", "k1", F.coalesce("root", "node").alias("component"))
    return facts.join(classes, ["k0", "k1"]).select("row", "component")


def similar_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id), a row for each row of `docs`: `similar_rows`, components by their smallest doc_id."""
    rows = numbered(docs)
    found = rows.select(F.col(ROW).alias("row"), "doc_id").join(similar_rows(rows), "row")
    found = written(found.select("doc_id", "component"), "similar-found")
    names = written(found.groupBy("component").agg(F.min("doc_id").alias("component_id")), "similar-names")
    return join_narrow(found, names, "component").select("doc_id", "component_id")


def without_near_copies(docs: DataFrame) -> DataFrame:
    """The rows and columns of `docs`; of texts linked at a similarity of 0.8 on 5-word shingles, the row of the smallest doc_id.

    Null and empty texts are alike; a null doc_id is last; of repeated rows one stays; an empty table stays empty.
    """
    rows = numbered(docs)
    return keep_first(rows, similar_rows(rows).select(F.col("row").alias(ROW), F.col("component").alias("group")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
