"""Hierarchical multi-length packing of documents into training sequences.

Whole windows of the longest context are cut from a document first.  Its rest goes to
the smallest context tier that holds it, so it fills over half of a window there.  Each
tier is packed from its longest piece down: a window's gap takes the longest pieces of
the shorter tiers that fit, and where none fits whole, the head of the shortest piece
left, so every window is full.  A window has the size of its tier, a power of two, and
needs no padding.

Windows are dealt to step groups of equal token count over all partitions: in order of
their size, the longest first, they are laid on one line that is cut at each step.  Sizes
and steps are powers of two, so no window lies across a cut, every step but the last
weighs the same, and all steps but those where one size gives way to the next are of one size.

Packing is local to a partition, in buffers of bounded size; what can't fill a window
goes over to the next buffer.  The rest of a partition, under one window, is cut at
powers of two.  Sequence ids hold the partition's number; the pieces are written once, so a
lost task's repetition can't mix with other sequences, and only the number of windows of
each size and partition is needed to place a partition's windows on the line.

Decided cases: a null or empty text is a document of its end token only; repeated rows
are documents of their own, also under one doc_id; an empty table gives no rows; extra
columns are left out.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import default_vocabulary, encoder
from .common import byte_slices, sent_if_small, table, written

TIERS = (2048, 1024, 512, 256)
END_ID = 1
#: Tokens of a step group, a power of two of at least the longest tier.
STEP_TOKENS = 64 * 2048
#: Tokens gathered before a buffer is packed.
BUFFER_TOKENS = 2_000_000

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, context long, place long"
)
#: Bits of a sequence id below the partition's number.
_BITS = 36


class Packer:
    """Packs one partition.  `emit(piece, sequence, offset, context, place)` gets each placed piece.

    A piece is (length, serial, start, document); serial makes pieces distinct.  `place` counts
    the windows of each size.
    """

    def __init__(self, emit, tiers: tuple[int, ...] = TIERS, base: int = 0):
        self.emit, self.tiers = emit, tuple(sorted(tiers, reverse=True))
        self.sequence, self.serial = base, 0
        self.full: Counter[int] = Counter()
        self.rest: list[tuple] = []

    def _place(self, pieces: list[tuple], context: int) -> None:
        offset = 0
        for piece in pieces:
            self.emit(piece, self.sequence, offset, context, self.full[context])
            offset += piece[0]
        self.full[context] += 1
        self.sequence += 1

    def add(self, document, n_tokens: int) -> None:
        """Cut a document's whole longest windows; keep the rest for `pack`."""
        longest, start = self.tiers[0], 0
        while n_tokens - start >= longest:
            self._place([(longest, self.serial, start, document)], longest)
            self.serial += 1
            start += longest
        if start < n_tokens:
            self.rest.append((n_tokens - start, self.serial, start, document))
            self.serial += 1

    def pack(self) -> None:
        """Fill windows from the gathered pieces; an unfilled window's pieces are kept."""
        left = sorted(self.rest)
        self.rest = []
        while left:
            window = [left.pop()]
            context = min(t for t in self.tiers if t >= window[0][0])
            gap = context - window[0][0]
            while gap and left:
                k = bisect_right(left, (gap, 1 << 62))
                if k:
                    piece = left.pop(k - 1)
                else:
                    length, serial, start, document = left.pop(0)
                    piece = (gap, serial, start, document)
                    insort(left, (length - gap, self.serial, start + gap, document))
                    self.serial += 1
                window.append(piece)
                gap -= piece[0]
            if gap:
                self.rest = window
            else:
                self._place(window, context)

    def finish(self) -> None:
        """Cut what is left, under one longest window, at powers of two."""
        self.pack()
        left, self.rest = self.rest, []
        total = sum(p[0] for p in left)
        while total:
            size = 1 << (total.bit_length() - 1)
            window, gap = [], size
            while gap:
                length, serial, start, document = left.pop(0)
                take = min(gap, length)
                window.append((take, serial, start, document))
                if take < length:
                    left.insert(0, (length - take, serial, start + take, document))
                gap -= take
            self._place(window, size)
            total -= size


def pack_documents(
    docs: DataFrame,
    vocabulary: str | None = None,
    tiers: tuple[int, ...] = TIERS,
    end_id: int = END_ID,
    step_tokens: int = STEP_TOKENS,
    buffer_tokens: int = BUFFER_TOKENS,
) -> DataFrame:
    """Tokenise (doc_id, text) and return one row for each piece, see SCHEMA, with `step_group` instead of `place`.

    `context` is the sequence's length, `step_group` the step that trains on it.
    """
    sizes = [*tiers, step_tokens]
    if any(x < 1 or x & (x - 1) for x in sizes) or step_tokens < max(tiers):
        raise ValueError("tiers and step_tokens are powers of two, and a step holds a window of the longest tier")
    path = vocabulary or default_vocabulary()
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        rows: list[tuple] = []

        def emit(piece, sequence, offset, context, place):
            length, _, start, (doc_id, ids) = piece
            crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
            rows.append((doc_id, start, length, crc, len(ids) // 4, sequence, offset, context, place))

        def out() -> pa.RecordBatch:
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            cells = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cells], names=names)

        packer = Packer(emit, tiers, TaskContext.get().partitionId() << _BITS)
        waiting = 0
        for batch in batches:
            for part in byte_slices(batch, 1):
                for doc_id, ids in zip(part.column(0).to_pylist(), bpe.encode(part.column(1)), strict=True):
                    packer.add((doc_id, ids + end), len(ids) // 4 + 1)
                    waiting += len(ids) // 4 + 1
                    if waiting >= buffer_tokens:
                        packer.pack()
                        waiting = 0
                    if len(rows) > 20_000:
                        yield out()
        packer.finish()
        if rows:
            yield out()

    pieces = written(docs.select("doc_id", "text").mapInArrow(run, SCHEMA), "pieces")
    pieces = pieces.withColumn("part", F.shiftright("sequence_id", _BITS))
    # one narrow row for each partition and size
    counts = pieces.where("offset = 0").groupBy("context", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("context").orderBy("part")) - F.col("n")
    counts = written(counts.withColumn("before", before), "packed-counts")
    totals = {r.context: r.n for r in counts.groupBy("context").agg(F.sum("n").alias("n")).collect()}  # one for each size
    begin, at = {}, 0
    for context in sorted(totals, reverse=True):
        begin[context], at = at, at + context * totals[context]
    line = F.coalesce(*(F.when(F.col("context") == c, b) for c, b in begin.items()), F.lit(0)) + F.col("context") * (F.col("before") + F.col("place"))
    placed = pieces.join(sent_if_small(counts.drop("n")), ["context", "part"])
    names = [c.split()[0] for c in SCHEMA.split(", ")][:-1]
    return placed.select(*names, F.floor(line / step_tokens).cast("long").alias("step_group"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))
