"""Suffix-array deduplication: what is covered by strings of a given length that start at two places at least.

A text is a sequence of units, its bytes (`BYTES`, 400 of them) or its words (`WORDS`, 50).
Only the order of suffixes through that many units matters, and only which of them are
equal that far.  So suffixes are sorted by most-significant digits, depth-limited, and what
is alone in its group is dropped before the next digit; told for 400 bytes:

1. The first digit of a suffix is its anchor: of all 64-byte strings in its 400 bytes the
   one of smallest hash, and where it lies.  Equal suffixes have equal anchors.  Suffixes
   that follow each other mostly share an anchor, so a run of them is one row, and only the
   anchor's hash is shuffled.
2. Runs whose anchor occurs once are done: nothing in them repeats.  Runs of an anchor
   whose whole contents are equal are done, too: all of them repeats.
3. The few runs left, at the borders of repeated passages, go with their bytes, once for
   each distinct run and task, to the task of their anchor.  There their suffixes are
   sorted by four more digits of 100 bytes; the groups that reach the last digit with two
   members are exactly the repeated 400-byte windows.  An anchor with more than
   `crowded` distinct runs is no single task's work: its suffixes meet by aggregates, in
   blocks of neighbours first, then one by one where a block's contents differ.

Digits are compared by 64-bit hashes of their bytes, five independent ones along a suffix.
Words are those between ASCII white space, told apart by 64-bit hashes; a repeated stretch
of words goes from the first byte of its first to the last byte of its last word.

Decided cases: null counts as empty; texts of fewer units than the length have no windows; matches never
cross documents; rows that repeat a doc_id and text are documents of their own, whose
texts repeat each other; extra columns are left out by `repeated_spans` and kept by
`without_repeats`, where a character that loses a byte goes as a whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SENT_ROWS, drop_caches, join_narrow, map_rows, record, table, whole_groups, written

DEPTH = 400
#: Words of a repeated stretch, where units are words.
DEPTH_WORDS = 50
#: Distinct runs of one anchor up to which one task sorts them.
CROWDED = 1_000
#: Runs sorted together, but for an anchor that has more.
_TOGETHER = 1_000
#: Anchors, or repeated intervals, sent to every executor at most: 16 or 64 MB.
SENT_ANCHORS = 2_000_000

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _random.integers(1, 2**61, 8).astype(np.uint64) * np.uint64(4) + np.uint64(3)
_PLACE = np.uint64((1 << 24) - 1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class Unit:
    """What suffixes are made of: bytes, or words as their hashes."""

    words: bool
    depth: int

    @property
    def digit(self) -> int:
        return -(-self.depth // 4)

    @property
    def gram(self) -> int:
        """Length of anchors: the greatest power of two within a digit."""
        return 1 << (self.digit.bit_length() - 1)

    @property
    def kind(self) -> str:
        return "<u8" if self.words else "u1"

    def read(self, text: str | None) -> np.ndarray:
        data = (text or "").encode()
        if not self.words:
            return np.frombuffer(data, np.uint8)
        words = data.split()
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))

    def in_bytes(self, data: bytes, gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Ranges of units as ranges of the text's bytes."""
        if not self.words or not gone:
            return gone
        at = [m.span() for m in _WORD.finditer(data)]
        return [(at[a][0], at[b - 1][1]) for a, b in gone]


BYTES, WORDS = Unit(False, DEPTH), Unit(True, DEPTH_WORDS)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the `gram` units from each place on, by doubling."""
    h, width = _BYTE[data] if data.dtype == np.uint8 else data, 1
    for k in range(gram.bit_length() - 1):
        h = h[:-width] * _STEP[k] + h[width:]
        width *= 2
    return _mixed(h)


def _runs(h: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, start, count) of the runs of windows, of `wide` hashes, that share an anchor, the leftmost smallest hash."""
    low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    done = 1
    while 2 * done <= wide:
        low = np.minimum(low[:-done], low[done:])
        done *= 2
    if wide > done:
        low = np.minimum(low[: len(low) - (wide - done)], low[wide - done :])
    anchor = (low & _PLACE).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    return anchor[start], start, np.diff(np.append(start, len(anchor)))


def runs(data: np.ndarray, unit: Unit = BYTES, block: int = 1 << 23) -> Iterator[tuple[int, int, int, int]]:
    """(anchor hash, anchor place, first window, windows) of a text's units; very long ones are read in blocks."""
    for base in range(0, max(0, len(data) - unit.depth + 1), block):
        h = gram_hashes(data[base : base + block + unit.depth - 1], unit.gram)
        anchor, start, count = _runs(h, unit.depth - unit.gram + 1)
        yield from zip(h[anchor].view(np.int64).tolist(), (anchor + base).tolist(), (start + base).tolist(), count.tolist(), strict=True)


def _content(data: np.ndarray, anchor: int, start: int, count: int, depth: int) -> tuple[int, bytes]:
    """A run's units as bytes, and the hash of these and of the anchor's place in them."""
    content = data[start : start + count + depth - 1].tobytes()
    return int(np.uint64(xxhash.xxh3_64_intdigest(content, anchor - start)).view(np.int64)), content


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_key and row_key tell rows apart; equal rows share them, and their spans."""
    return docs.withColumns({
        "doc_key": F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))),
        "row_key": F.xxhash64("doc_id", "text"),
    })


# -- which windows of an anchor's runs repeat -------------------------------


def repeated_windows(
    group: np.ndarray, offset: np.ndarray, count: np.ndarray, copies: np.ndarray, contents: list[bytes], unit: Unit = BYTES
) -> tuple[np.ndarray, np.ndarray]:
    """(run, window) of windows that occur twice; runs of one `group` and equal anchor offset may match.

    Passes from the most significant digit; groups of one member are dropped after each.
    """
    depth, digit = unit.depth, unit.digit
    data = np.frombuffer(b"".join(contents), unit.kind)
    begin = np.concatenate([[0], np.cumsum([len(c) // data.itemsize for c in contents])[:-1]]).astype(np.int64)
    run = np.repeat(np.arange(len(contents)), count)
    window = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    at, weight = begin[run] + window, copies[run]
    h = gram_hashes(data, unit.gram)
    key = group[run] * np.int64(4 * depth) + (offset[run] - window)
    for k in range(5):
        if k:
            here = at + min((k - 1) * digit, depth - digit)
            token = _mixed(h[here] * _STEP[6] + h[here + digit - unit.gram] * _STEP[7])
            key = (_mixed(key.view(np.uint64)) * _STEP[5] + token).view(np.int64)
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))[: len(order)]
        total = np.add.reduceat(weight[order], first) if len(order) else weight
        sizes = np.diff(np.append(first, len(order)))
        keep = order[np.repeat(total > 1, sizes)]
        run, window, at, weight = run[keep], window[keep], at[keep], weight[keep]
        key = np.repeat(np.arange(len(first)), sizes)[np.repeat(total > 1, sizes)]
    return run, window


def _intervals(run: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, first window, windows) of neighbouring windows of a run."""
    order = np.lexsort((window, run))
    run, window = run[order], window[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(run) != 0) | (np.diff(window) != 1)]))[: len(run)]
    return run[new], window[new], np.diff(np.append(new, len(run)))


_HITS = "ahash long, rhash long, first int, windows int"


def _sort_runs(border: DataFrame, unit: Unit) -> DataFrame:
    """Repeated intervals of border runs, an anchor in one task."""

    def parts(whole: pa.Table) -> Iterator[pa.Table]:
        """Tables of whole anchors, of few runs each."""
        ahash = whole.column("ahash").to_numpy()
        new = np.flatnonzero(np.concatenate([[True], np.diff(ahash) != 0]))
        begin = 0
        for at in [*new[1:].tolist(), len(ahash)]:
            if at - begin >= _TOGETHER or at == len(ahash):
                yield whole.slice(begin, at - begin)
                begin = at

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        for whole in (part for table in whole_groups(batches, "ahash") for part in parts(table)):
            ahash, rhash, offset, count, copies = (whole.column(c).to_numpy() for c in ("ahash", "rhash", "place", "windows", "copies"))
            order = np.lexsort((rhash, ahash))
            new = np.concatenate([[True], (np.diff(ahash[order]) != 0) | (np.diff(rhash[order]) != 0)])
            total = np.add.reduceat(copies[order], np.flatnonzero(new))
            pick = order[new]
            contents = whole.column("content").take(pa.array(pick)).to_pylist()
            group = np.unique(ahash[pick], return_inverse=True)[1].astype(np.int64)
            run, first, windows = _intervals(*repeated_windows(group, offset[pick].astype(np.int64), count[pick], total, contents, unit))
            yield record(ahash=pa.array(ahash[pick][run]), rhash=pa.array(rhash[pick][run]), first=pa.array(first.astype(np.int32)), windows=pa.array(windows.astype(np.int32)))

    return border.repartition("ahash").sortWithinPartitions("ahash").mapInArrow(sort, _HITS)


def _count_windows(border: DataFrame, unit: Unit) -> DataFrame:
    """The same by rows and aggregates, for anchors of any number of runs.

    Neighbouring windows go as one row, by what all of their block have in common.  Blocks whose
    contents are all equal repeat as a whole; only windows of those that differ become rows.
    """
    wide, step_of = np.dtype(unit.kind).itemsize, max(1, unit.depth // 25)
    digest = lambda data: hashlib.blake2b(data, digest_size=16).digest()

    def blocks():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            rows = []
            for a, r, place, n, copies, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = 0
                while w < n:
                    block = (place - w) // step_of
                    low = block * step_of
                    count = min(n - w, place - w - low + 1)
                    core = content[(place - low) * wide : (place - low + unit.depth - step_of + 1) * wide]
                    whole = content[w * wide : (w + count + unit.depth - 1) * wide] + (place - w).to_bytes(4, "big")
                    rows.append((a, block, digest(core), r, w, count, digest(whole), copies))
                    w += count
            yield _filled(rows, ["ahash", "block", "core", "rhash", "first", "windows", "whole", "copies"])

        return step

    def windows():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            rows = []
            for a, r, place, _, copies, content, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for w in (w for p in parts for w in range(p["first"], p["first"] + p["windows"])):
                    rows.append((a, place - w, digest(content[w * wide : (w + unit.depth) * wide]), r, w, copies))
            yield _filled(rows, ["ahash", "offset", "digest", "rhash", "first", "copies"])

        return step

    one = border.groupBy("ahash", "rhash").agg(F.first("place").alias("place"), F.first("windows").alias("windows"), F.sum("copies").alias("copies"), F.first("content").alias("content"))
    one = written(one.select("ahash", "rhash", "place", "windows", "copies", "content"), "crowd-runs")
    rows = map_rows(one, blocks, "ahash long, block int, core binary, rhash long, first int, windows int, whole binary, copies long", 256)
    rows = written(rows.withColumn("key", F.struct("ahash", "block", "core")).drop("ahash", "block", "core"), "crowd-blocks")
    twice = rows.groupBy("key").agg(F.sum("copies").alias("n"), (F.min("whole") == F.max("whole")).alias("same")).where("n > 1")
    found = written(join_narrow(rows, written(twice.select("key", "same"), "crowd-shared"), "key").select("key.ahash", "rhash", "first", "windows", "same"), "crowd-found")
    hits = found.where("same").drop("same")
    parts = found.where("not same").groupBy("ahash", "rhash").agg(F.collect_list(F.struct("first", "windows")).alias("parts"))
    rows = map_rows(one.join(parts, ["ahash", "rhash"]), windows, "ahash long, offset int, digest binary, rhash long, first int, copies long", 256)
    rows = written(rows.withColumn("key", F.struct("ahash", "offset", "digest")).drop("ahash", "offset", "digest"), "crowd-windows")
    twice = written(rows.groupBy("key").agg(F.sum("copies").alias("n")).where("n > 1").select("key"), "crowd-twice")
    return hits.unionByName(join_narrow(rows, twice, "key").select("key.ahash", "rhash", "first", F.lit(1).alias("windows")))


_KINDS = {"block": pa.int32(), "offset": pa.int32(), "first": pa.int32(), "windows": pa.int32(), "core": pa.binary(), "whole": pa.binary(), "digest": pa.binary()}


def _filled(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    cells = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS.get(k, pa.int64())) for c, k in zip(cells, names, strict=True)], names=names)


# -- documents --------------------------------------------------------------


def _all_runs(keyed: DataFrame, unit: Unit) -> DataFrame:
    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            rows = []
            for k, text in enumerate(batch.column(2).to_pylist()):
                data = unit.read(text)
                for ahash, anchor, start, count in runs(data, unit):
                    rows.append((k, ahash, _content(data, anchor, start, count, unit.depth)[0], start, count))
            cells = list(zip(*rows, strict=True)) if rows else [()] * 5
            at = pa.array(cells[0], pa.int32())
            yield record(
                doc_key=batch.column(0).take(at), row_key=batch.column(1).take(at), ahash=pa.array(cells[1], pa.int64()),
                rhash=pa.array(cells[2], pa.int64()), start=pa.array(cells[3], pa.int32()), windows=pa.array(cells[4], pa.int32()),
            )

        return step

    return map_rows(keyed.select("doc_key", "row_key", "text"), make, "doc_key long, row_key long, ahash long, rhash long, start int, windows int", 256)


_BORDER = "ahash long, rhash long, place int, windows int, copies long, content binary"


def _border_runs(keyed: DataFrame, found: DataFrame, mixed: DataFrame, unit: Unit) -> DataFrame:
    """The runs of `mixed` anchors with their bytes, once for each distinct run of a batch or task."""

    def emit(texts: Iterator[tuple[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        held: dict[tuple[int, int], list] = {}
        size = 0

        def out() -> pa.RecordBatch:
            rows = [(a, r, *v) for (a, r), v in held.items()]
            held.clear()
            cells = zip(*rows, strict=True) if rows else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            names = ["ahash", "rhash", "place", "windows", "copies", "content"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=names)

        for text, wanted in texts:
            data = unit.read(text)
            own = list(runs(data, unit))
            at = np.array([r[0] for r in own], np.int64)
            there = np.minimum(np.searchsorted(wanted, at), max(0, len(wanted) - 1))
            for k in np.flatnonzero(wanted[there] == at) if len(wanted) else ():
                ahash, anchor, start, count = own[k]
                rhash, content = _content(data, anchor, start, count, unit.depth)
                known = held.get((ahash, rhash))
                if known:
                    known[2] += 1
                else:
                    held[ahash, rhash] = [anchor - start, count, 1, content]
                    size += len(content)
            if size > 8 << 20:
                yield out()
                size = 0
        yield out()

    if mixed.limit(SENT_ANCHORS + 1).count() <= SENT_ANCHORS:
        rows = mixed.select("ahash").toPandas()["ahash"].to_numpy()  # 8 bytes each, at most SENT_ANCHORS
        wanted = keyed.sparkSession.sparkContext.broadcast(np.sort(rows))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            anchors = wanted.value
            yield from emit((t, anchors) for batch in batches for t in batch.column(0).to_pylist() if t)

        return keyed.select("text").mapInArrow(scan, _BORDER)

    lists = found.join(mixed.select("ahash"), "ahash").groupBy("doc_key", "row_key").agg(F.sort_array(F.collect_set("ahash")).alias("wanted"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from emit((t, np.array(w, np.int64)) for batch in batches for t, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))

    return keyed.join(lists, ["doc_key", "row_key"]).select("text", "wanted").mapInArrow(joined, _BORDER)


def _spans(keyed: DataFrame, unit: Unit, crowded: int) -> DataFrame:
    """(doc_key, row_key, spans array<struct<start, windows>>) of rows with repeated windows."""
    found = written(_all_runs(keyed, unit), "runs")
    groups = found.groupBy("ahash").agg(F.count(F.lit(1)).alias("n"), F.min("rhash").alias("r0"), F.max("rhash").alias("r1"))
    groups = written(groups.where("n > 1").select("ahash", (F.col("r0") == F.col("r1")).alias("same")), "anchors")
    mixed = groups.where("not same")
    border = written(_border_runs(keyed, found, mixed, unit), "border-runs")
    crowds = written(border.groupBy("ahash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowded).select("ahash"), "crowds")
    hits = _sort_runs(border.join(F.broadcast(crowds) if crowds.count() < 100_000 else crowds, "ahash", "left_anti"), unit)
    if not crowds.isEmpty():
        hits = hits.unionByName(_count_windows(border.join(crowds, "ahash", "left_semi"), unit))
    hits = written(hits, "repeated")
    if groups.limit(SENT_ANCHORS + 1).count() <= SENT_ANCHORS and hits.limit(SENT_ANCHORS + 1).count() <= SENT_ANCHORS:
        spans = _looked_up(found, groups, hits)
    else:
        held = found.join(groups, "ahash")
        whole = held.where("same").select("doc_key", "row_key", F.col("start").alias("first"), "windows")
        part = held.where("not same").select("doc_key", "row_key", "ahash", "rhash", "start").join(hits, ["ahash", "rhash"])
        spans = whole.unionByName(part.select("doc_key", "row_key", (F.col("start") + F.col("first")).alias("first"), "windows"))
        spans = spans.groupBy("doc_key", "row_key").agg(F.collect_set(F.struct("first", "windows")).alias("spans"))
    return written(spans, "spans")


def _pair_key(ahash: np.ndarray, rhash: np.ndarray) -> np.ndarray:
    return _mixed(ahash.view(np.uint64) * _STEP[4] + rhash.view(np.uint64))


def _looked_up(found: DataFrame, groups: DataFrame, hits: DataFrame) -> DataFrame:
    """The spans of each document by search in sorted arrays, which every executor gets: at most 40 bytes for each row."""
    same = np.sort(groups.where("same").select("ahash").toPandas()["ahash"].to_numpy(np.int64))
    rows = hits.toPandas()
    ahash, rhash, first, windows = (rows[c].to_numpy(k) for c, k in (("ahash", np.int64), ("rhash", np.int64), ("first", np.int32), ("windows", np.int32)))
    order = np.argsort(_pair_key(ahash, rhash))
    arrays = tuple(x[order] for x in (_pair_key(ahash, rhash), ahash, rhash, first, windows))
    sent = found.sparkSession.sparkContext.broadcast((same, arrays))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        same, (keys, ahash, rhash, first, windows) = sent.value
        for batch in batches:
            doc, row, a, r, start, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_key", "row_key", "ahash", "rhash", "start", "windows"))
            full = np.flatnonzero(same[np.minimum(np.searchsorted(same, a), len(same) - 1)] == a) if len(same) else np.zeros(0, np.int64)
            key = _pair_key(np.ascontiguousarray(a), np.ascontiguousarray(r))
            low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            run = np.repeat(np.arange(len(a)), high - low)
            at = np.arange(len(run)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[run]
            true = (ahash[at] == a[run]) & (rhash[at] == r[run])
            run, at = run[true], at[true]
            own = np.concatenate([full, run])
            begin = np.concatenate([start[full], start[run] + first[at]])
            count = np.concatenate([n[full], windows[at]])
            order = np.lexsort((begin, own))
            own, begin, count = own[order], begin[order], count[order]
            # rows of a document lie together, and windows that follow each other are one interval
            other = np.concatenate([[True], (np.diff(doc[own]) != 0) | (np.diff(row[own]) != 0)])[: len(own)]
            end = begin + count
            apart = other.copy()
            apart[1:] |= (begin[1:] > end[:-1]) | (begin[1:] < begin[:-1])
            new = np.flatnonzero(apart)
            end = end[np.append(new[1:] - 1, len(own) - 1)[: len(new)]]
            own, begin, other = own[new], begin[new], np.flatnonzero(other[new])
            bounds = pa.array(np.append(other, len(own)).astype(np.int32))
            pairs = pa.StructArray.from_arrays([pa.array(begin.astype(np.int32)), pa.array((end - begin).astype(np.int32))], ["first", "windows"])
            yield record(doc_key=pa.array(doc[own[other]]), row_key=pa.array(row[own[other]]), spans=pa.ListArray.from_arrays(bounds, pairs))

    found = found.mapInArrow(search, "doc_key long, row_key long, spans array<struct<first: int, windows: int>>")
    return found.groupBy("doc_key", "row_key").agg(F.array_distinct(F.flatten(F.collect_set("spans"))).alias("spans"))


def _with_spans(docs: DataFrame, unit: Unit, crowded: int) -> DataFrame:
    """The rows of `docs` and a column _spans."""
    spans = _spans(_keyed(docs.select("doc_id", "text")), unit, crowded).withColumnsRenamed({"doc_key": "_doc", "row_key": "_row", "spans": "_spans"})
    # texts move only if the lists of spans, counted by their members, are too long to be sent to every executor
    few = (spans.agg(F.sum(F.size("_spans"))).first()[0] or 0) <= SENT_ROWS
    own = docs.withColumns({"_d": F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))), "_r": F.xxhash64("doc_id", "text")})
    return own.join(F.broadcast(spans) if few else spans, (own["_d"] == spans["_doc"]) & (own["_r"] == spans["_row"]), "left").drop("_d", "_r", "_doc", "_row")


def removed_runs(spans: list[dict] | None, depth: int = DEPTH) -> list[tuple[int, int]]:
    """Maximal removed ranges from repeated windows."""
    out: list[tuple[int, int]] = []
    for first, end in sorted((s["first"], s["first"] + s["windows"] + depth - 1) for s in spans or ()):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def _gone(text: str | None, spans: list[dict] | None, unit: Unit) -> list[tuple[int, int]]:
    """Removed ranges of a text's bytes."""
    return unit.in_bytes((text or "").encode(), removed_runs(spans, unit.depth))


def _kept(data: bytes, gone: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for run in gone for x in run), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def repeated_spans(docs: DataFrame, unit: Unit = BYTES, crowded: int = CROWDED) -> DataFrame:
    """(doc_id, text, spans array<struct<start, end>>): removed byte ranges of every row."""

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            rows = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            gone = [[{"start": a, "end": b} for a, b in _gone(t, s, unit)] for t, s in rows]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield record(doc_id=batch.column(0), text=batch.column(1), spans=pa.array(gone, kind))

        return step

    own = _with_spans(docs.select("doc_id", "text"), unit, crowded)
    return map_rows(own.select("doc_id", "text", "_spans"), make, "doc_id long, text string, spans array<struct<start: long, end: long>>")


def without_repeats(docs: DataFrame, unit: Unit = BYTES, crowded: int = CROWDED) -> DataFrame:
    """The rows and columns of `docs`, their texts without the repeated units; n_chars, if there, follows."""
    names = docs.columns

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts = [
                _kept(t.encode(), _gone(t, s, unit)).decode("utf-8", "ignore") if s else t
                for t, s in zip(batch.column(names.index("text")).to_pylist(), batch.column(len(names)).to_pylist(), strict=True)
            ]
            cells = batch.columns[: len(names)]
            cells[names.index("text")] = pa.array(texts, pa.string())
            if "n_chars" in names:
                cells[names.index("n_chars")] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(cells, names=names)

        return step

    return map_rows(_with_spans(docs, unit, crowded).select(*names, "_spans"), make, docs.schema)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data, gone = (text or "").encode(), removed_runs(spans)
                rows.append((len(data), sum(b - a for a, b in gone), len(gone), hashlib.sha256(_kept(data, gone)).hexdigest()))
            size, removed, count, digest = zip(*rows, strict=True)
            yield record(doc_id=batch.column(0), n_bytes=pa.array(size, pa.int64()), n_removed=pa.array(removed, pa.int64()), n_spans=pa.array(count, pa.int64()), kept_sha256=pa.array(digest, pa.string()))

        return step

    own = _with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), BYTES, CROWDED)
    return map_rows(own.select("doc_id", "text", "_spans"), make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
