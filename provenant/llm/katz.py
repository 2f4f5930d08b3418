"""Language-model scoring by Katz backoff over n-grams of a given order.

Good-Turing: an n-gram seen r times keeps the share d_r of its count, from its order's counts
of counts up to `K`; above `K` nearly all of it.  What a context's n-grams lose is its mass for
words not seen after it, dealt out in proportion to the lower order, so its backoff weight
is that mass over the lower-order probability of the words not seen: exactly normalised.
Words are the lowest order, with Good-Turing mass for one class of unknown words.  A token is
evaluated recursively, order by order: its n-gram if seen, else its context's weight times the
probability of the order below, or that alone after an unknown context.  The first token of a
text has the text's beginning as its context, the second that and the first, and so on.

No table of the model is ever in one place.  Texts become chunks of about `CHUNK_TOKENS` tokens
in local word numbers, a bucketed table.  A chunk asks, once for each of its distinct
words, n-grams and contexts and packed by bucket of their hash, what the corpus knows of
them; the task of a bucket adds the counts up and answers every chunk that asked.  Words and
counts are kept as a partitioned table; each later pass reads chunks where they lie
and joins only the answers.  An n-gram is owned by the first chunk that has it, so its part of
its context's sums is added once.  Common words meet in no single place: a chunk asks once
for each, and n-grams are dealt out by all their words.  The number of buckets follows the
characters of all texts, so a bucket's task holds a bounded number of hashes.

Words and n-grams are told apart by 64-bit hashes.

Decided cases: null counts as empty; an empty text is its end token; with nothing to learn
every word is unknown; repeated rows are texts of their own; a null id is learnt; extra columns are left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, discard, fold, shared_dir, table, whole_groups, written

#: Counts up to which Good-Turing discounts hold.
K = 5
#: Share that larger counts lose, so that every context has mass for the rest.
LEAST = 1e-6
CHUNK_TOKENS = 1_500_000
#: Words of an n-gram in the query.
ORDER = 3
#: Hashes that meet in a bucket's task, about, at most: 150 MB.
BUCKET_HASHES = 2_000_000
#: Bytes of text whose words are looked up together.
_PART_BYTES = 2 << 20
_END, _START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


# -- packing ------------------------------------------------------------------


def _pack(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, compressed."""
    raw = np.ascontiguousarray(values)
    return zstandard.ZstdCompressor(level=1).compress(raw.view(np.uint8).reshape(len(raw), -1).T.tobytes() if len(raw) else b"")


def _unpack(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def _pack_sorted(hashes: np.ndarray) -> bytes:
    return _pack(np.diff(hashes, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64)


def _cuts(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where buckets, equal ranges of hashes, begin in sorted hashes; the last place is the end."""
    bounds = np.array([(k << 64) // buckets for k in range(buckets)], np.uint64)
    return np.append(np.searchsorted(hashes, bounds), len(hashes))


def _trimmed(values: np.ndarray) -> np.ndarray:
    """Numbers to 32 binary digits behind the first, which pack in five or six bytes; off by 1e-10 of themselves at most."""
    half = np.uint64(1 << 19)
    return ((np.ascontiguousarray(values).view(np.uint64) + half) & ~np.uint64((1 << 20) - 1)).view(np.float64)


# -- the model's numbers -----------------------------------------------------


def discounts(n: np.ndarray) -> np.ndarray:
    """d[r] for r up to K from counts of counts n[r]; d[0] is for counts above K."""
    r = np.arange(1, K + 1)
    d = (r - 0.5) / r  # where Good-Turing says nothing
    if n[1] > 0 and (n[1 : K + 2] > 0).all():
        cut = (K + 1) * n[K + 1] / n[1]
        if cut < 1:
            turing = ((r + 1) * n[2 : K + 2] / n[1 : K + 1] / r - cut) / (1 - cut)
            d = np.where((turing > 0) & (turing < 1), turing, d)
    return np.concatenate([[1 - LEAST], d])


@dataclass
class Numbers:
    """Counts over the whole training part; a few numbers."""

    texts: int
    tokens: int
    types: int
    words: np.ndarray = field(default_factory=lambda: np.zeros(K + 2))
    grams: dict[int, np.ndarray] = field(default_factory=dict)  # by order

    def word_probability(self, c: np.ndarray) -> np.ndarray:
        """Of words of training count c; 0 is the class of all unknown words."""
        d = discounts(self.words)
        kept = d[np.where(c > K, 0, c)] * c
        lost = ((1 - d[1:]) * np.arange(1, K + 1) * self.words[1 : K + 1]).sum()
        above = self.tokens - (np.arange(1, K + 1) * self.words[1 : K + 1]).sum()
        unknown = lost + LEAST * above if self.tokens else 1.0
        return np.where(c > 0, kept, unknown) / max(1, self.tokens)


def _counts_of_counts(totals: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(totals, K + 2), minlength=K + 3)[: K + 2].tolist()


# -- chunks ---------------------------------------------------------------------

_CHUNK = "chunk long, ids array<long>, held array<boolean>, lengths array<int>, vocab binary, tokens binary"


def _chunks(docs: DataFrame, held: Column, buckets: int, chunk_tokens: int) -> DataFrame:
    """The texts in local word numbers, as a table bucketed by chunk in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        known: dict[str, int] = {}
        ids, flags, lengths, parts = [], [], [], []

        def out() -> pa.RecordBatch:
            nonlocal number
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in known), np.uint64, len(known))
            hashes = np.append(hashes, _END)
            order = np.argsort(hashes)
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            local = np.concatenate(parts)
            tokens = rank[np.where(local < 0, len(known), local)]
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()), pa.array([ids[:]], pa.list_(pa.int64())), pa.array([flags[:]], pa.list_(pa.bool_())),
                    pa.array([lengths[:]], pa.list_(pa.int32())), pa.array([_pack_sorted(hashes[order])], pa.binary()), pa.array([_pack(tokens)], pa.binary()),
                ],
                names=["chunk", "ids", "held", "lengths", "vocab", "tokens"],
            )
            number += 1
            for x in (known, ids, flags, lengths, parts):
                x.clear()
            return batch

        size = 0
        for part in (p for batch in batches for p in byte_slices(batch, 1, _PART_BYTES)):
            texts = pa.concat_arrays([part.column(1).cast(pa.large_string()), pa.array([""], pa.large_string())])  # a copy: ascii_lower misreads slices
            words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))).slice(0, part.num_rows)
            coded = words.flatten().dictionary_encode()
            numbers = np.array([known.setdefault(w, len(known)) if w else -1 for w in coded.dictionary.to_pylist()] or [0], np.int32)
            local = numbers[coded.indices.to_numpy()]
            there = local >= 0  # around white space at the edges there are empty words
            count = np.diff(np.concatenate([[0], np.cumsum(there)])[words.offsets.to_numpy()])
            tokens = np.full(int(count.sum()) + len(count), -1, np.int32)  # behind each text's words its end
            tokens[np.arange(int(count.sum())) + np.repeat(np.arange(len(count)), count)] = local[there]
            parts.append(tokens)
            ids += part.column(0).to_pylist()
            flags += part.column(2).to_pylist()
            lengths += (count + 1).tolist()
            size += len(tokens)
            if size >= chunk_tokens:
                yield out()
                size = 0
        if ids:
            yield out()

    spark = docs.sparkSession
    name = f"katz_chunks_{uuid.uuid4().hex}"
    rows = docs.select("doc_id", "text", held.alias("held")).mapInArrow(run, _CHUNK)
    path = f"{shared_dir(spark)}/{name}"
    rows.write.option("path", path).bucketBy(buckets, "chunk").sortBy("chunk").saveAsTable(name)
    chunks = spark.table(name)
    chunks._table, chunks._written_at = name, path
    return chunks


class Chunk:
    """A chunk read back, with the answers that it has got."""

    def __init__(self, row: dict, buckets: int):
        self.buckets, self.number, self.ids = buckets, row["chunk"], row["ids"]
        self.lengths = np.array(row["lengths"], np.int64)
        self.held = np.array(row["held"], np.bool_)
        self.vocab = _unpack_sorted(row["vocab"])
        self.tokens = _unpack(row["tokens"], np.uint32).view(np.int32)
        self.trained = np.repeat(~self.held, self.lengths)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.answers: dict[str, dict[int, bytes]] = {}
        for a in row.get("answers") or ():
            self.answers.setdefault(a["kind"], {})[a["bucket"]] = a["data"]

    def ask(self, kind: str, hashes: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
        """(bucket, chunk, kind, sorted hashes, column...) packed."""
        begin = _cuts(hashes, self.buckets)
        for k in np.flatnonzero(np.diff(begin)):
            own = slice(begin[k], begin[k + 1])
            packed = [_pack(c[own]) for c in columns]
            yield (int(k), self.number, kind, _pack_sorted(hashes[own]), *packed, *[None] * (3 - len(packed)))

    def answer(self, kind: str, hashes: np.ndarray, dtype) -> np.ndarray:
        """What the buckets said, in the order of the sorted hashes that were asked."""
        begin = _cuts(hashes, self.buckets)
        parts = [_unpack(self.answers[kind][int(k)], dtype) for k in np.flatnonzero(np.diff(begin))]
        return np.concatenate(parts) if parts else np.zeros(0, dtype)

    def words(self) -> np.ndarray:
        """Training counts of the vocabulary."""
        return self.answer("words", self.vocab, np.uint32).astype(np.int64)

    def levels(self, numbers: Numbers, order: int, last: bool = True) -> list[Level]:
        """Levels of 2 to `order`; what the corpus knows of the last one's n-grams only if `last`."""
        count = self.words()
        start = len(self.vocab)
        previous = np.empty_like(self.tokens)
        previous[1:] = self.tokens[:-1]
        previous[self.first] = start
        hashes, counts = np.append(self.vocab, _START), np.append(count, numbers.texts)
        below, known = self.tokens, count[self.tokens] > 0
        out = []
        for m in range(2, order + 1):
            level = Level(self, previous, hashes, counts, below, known)
            out.append(level)
            if m < order or last:
                level.learn(self.answer(f"grams{m}", level.key, np.uint32), numbers.grams[m])
                previous = np.full_like(self.tokens, -1)
                previous[1:] = level.at[:-1]
                previous[self.first] = -1
                hashes, counts, below, known = level.key, level.count, level.at, level.seen
        return out

    def contexts(self, level: Level, lower: np.ndarray) -> tuple[np.ndarray, ...]:
        """(sorted hashes, their places, sums over owned n-grams: lower-order probability and lost count, is its weight needed)."""
        own, n = level.own, len(level.hashes)
        mass = np.bincount(level.context[own], lower[level.suffix[own]], n)
        lost = np.bincount(level.context[own], ((1 - level.kept) * level.count)[own], n)
        needed = np.zeros(n, bool)
        needed[level.needed()] = True
        place = level.by_hash(np.flatnonzero(needed | (mass > 0)))
        return level.hashes[place], place, mass[place], lost[place], needed[place]


class Level:
    """A chunk's distinct n-grams of one order whose parts are known: `key` sorted, `context`, `suffix` (the n-gram of the
    order below that ends it); `at`: each token's n-gram or -1."""

    def __init__(self, chunk: Chunk, previous: np.ndarray, hashes: np.ndarray, counts: np.ndarray, below: np.ndarray, known: np.ndarray):
        self.context_of, self.hashes, self.context_count = previous, hashes, counts
        self.valid = previous >= 0  # after a context that the training part has
        self.valid[self.valid] = counts[previous[self.valid]] > 0
        both = self.valid & known
        at = np.flatnonzero(both)
        of, word = hashes[previous[at]], chunk.tokens[at]
        key = (of * _A) ^ (chunk.vocab[word] * _B + (of >> np.uint64(31)))
        key = (key ^ (key >> np.uint64(29))) * _B
        order = np.argsort(key)
        ordered = key[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)]
        some = at[order[new]]
        self.key, self.context, self.suffix = ordered[new], previous[some], below[some]
        self.at = np.full(len(chunk.tokens), -1, np.int32)
        self.at[at[order]] = np.cumsum(new) - 1
        self.trained = np.bincount(self.at[both & chunk.trained], minlength=len(self.key)).astype(np.uint32)

    def by_hash(self, place: np.ndarray) -> np.ndarray:
        """Ascending places of contexts in the order of their hashes; only the text's beginning, the last of words, is out of order."""
        if not len(place) or self.hashes[place[-1]] != _START:
            return place
        at = int(np.searchsorted(self.hashes[place[:-1]], _START))
        return np.concatenate([place[:at], place[-1:], place[at:-1]])

    def needed(self) -> np.ndarray:
        """The contexts, ascending, whose weights some token needs."""
        flags = np.zeros(len(self.hashes), bool)
        flags[self.context_of[self.valid & ~self.seen]] = True
        return np.flatnonzero(flags)

    def learn(self, answer: np.ndarray, counts_of_counts: np.ndarray) -> None:
        """`count` in the corpus, the share `kept` of it, `probability` after the context, `own`: is this chunk the first with it; `seen`, by token."""
        self.count, self.own = (answer >> 1).astype(np.int64), (answer & 1).astype(bool)
        d = discounts(counts_of_counts)
        self.kept = d[np.where(self.count > K, 0, self.count)]
        self.probability = self.kept * self.count / np.maximum(1, self.context_count[self.context])
        self.seen = self.at >= 0
        self.seen[self.seen] = self.count[self.at[self.seen]] > 0


def _of_chunks(frame: DataFrame, buckets: int, f, schema: str) -> DataFrame:
    """Rows that `f` makes of each chunk."""
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    names, types = zip(*((c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = list(f(Chunk(batch.slice(k, 1).to_pylist()[0], buckets)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))

    return frame.mapInArrow(run, schema)


def _reduced(asked: DataFrame, buckets: int) -> DataFrame:
    """Answers to all that was asked of each bucket."""
    add = {"words": _add_words, "grams": _add_grams, "contexts": _add_contexts}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_groups(batches, "bucket"):
            rows = list(zip(*(whole.column(c).to_pylist() for c in _NAMES), strict=True))
            for bucket, kind in sorted({(r[0], r[2]) for r in rows}):
                own = sorted((r for r in rows if r[0] == bucket and r[2] == kind), key=lambda r: r[1])
                out = list(add[kind.rstrip("0123456789")](kind, bucket, own))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ANSWER_TYPES, strict=True)], names=_ANSWER_NAMES)

    return asked.repartition(buckets, "bucket").sortWithinPartitions("bucket").select(*_NAMES).mapInArrow(run, _ANSWER)


_ASK = "bucket int, chunk long, kind string, hashes binary, a binary, b binary, c binary"
_NAMES = [c.split()[0] for c in _ASK.split(", ")]
_ANSWER = "kind string, bucket int, chunk long, data binary, counts array<long>"
_ANSWER_NAMES = ["kind", "bucket", "chunk", "data", "counts"]
_ANSWER_TYPES = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64())]


def _grouped(rows: list[tuple], *kinds) -> tuple:
    """All rows' hashes with totals: (sizes, unique hashes, inverse, first places, concatenated columns)."""
    hashes = [_unpack_sorted(r[3]) for r in rows]
    whole = np.concatenate(hashes)
    order = np.argsort(whole)
    ordered = whole[order]
    begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(whole)])
    inverse = np.empty(len(whole), np.int64)
    inverse[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(whole))))
    first = np.minimum.reduceat(order, begin) if len(begin) else order
    columns = [np.concatenate([_unpack(r[4 + k], kind) for r in rows]) for k, kind in enumerate(kinds)]
    return [len(h) for h in hashes], ordered[begin], inverse, first, *columns


def _add_words(kind: str, bucket: int, rows: list[tuple]) -> Iterator[tuple]:
    sizes, unique, inverse, _, n = _grouped(rows, np.uint32)
    total = np.bincount(inverse, n, len(unique)).astype(np.uint32)
    there = total > 0
    counts = [int(total.sum()), int(there.sum()), *_counts_of_counts(total[there])]
    yield ("model", bucket, -1, _pack_sorted(unique[there]) + _pack(total[there]), counts)
    for r, part in zip(rows, np.split(total[inverse], np.cumsum(sizes)[:-1]), strict=True):
        yield (kind, bucket, r[1], _pack(part), None)


def _add_grams(kind: str, bucket: int, rows: list[tuple]) -> Iterator[tuple]:
    sizes, unique, inverse, first, n = _grouped(rows, np.uint32)
    total = np.bincount(inverse, n, len(unique)).astype(np.uint32)
    own = np.zeros(len(inverse), np.bool_)
    own[first[total > 0]] = True
    yield (f"{kind}-counts", bucket, -1, None, [int(total.sum()), int((total > 0).sum()), *_counts_of_counts(total[total > 0])])
    for r, part in zip(rows, np.split((total[inverse] << np.uint32(1)) | own.astype(np.uint32), np.cumsum(sizes)[:-1]), strict=True):
        yield (kind, bucket, r[1], _pack(part), None)


def _add_contexts(kind: str, bucket: int, rows: list[tuple]) -> Iterator[tuple]:
    sizes, unique, inverse, _, mass, lost, needed = _grouped(rows, np.float64, np.float64, np.uint8)
    seen, gone = np.bincount(inverse, mass, len(unique)), np.bincount(inverse, lost, len(unique))
    ends = np.cumsum(sizes)
    for r, a, b in zip(rows, ends - sizes, ends, strict=True):
        at = inverse[a:b][needed[a:b] > 0]
        yield (f"{kind}-mass", bucket, r[1], _pack(seen[at]), None)
        yield (f"{kind}-lost", bucket, r[1], _pack(gone[at]), None)


def _summed(answers: DataFrame, kind: str) -> np.ndarray:
    """The buckets' few counts, added up."""
    found = answers.where(F.col("kind") == kind).select(F.posexplode("counts").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(K + 4, np.int64)
    for r in found:
        out[r["k"]] = r["n"]
    return out


def _with_answers(chunks: DataFrame, *answers: DataFrame) -> DataFrame:
    """Chunks, which stay where they lie, with all answers to each."""
    parts = [a.where("chunk >= 0").select("kind", "bucket", "chunk", "data") for a in answers]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    lists = whole.groupBy("chunk").agg(F.collect_list(F.struct("kind", "bucket", "data")).alias("answers"))
    return chunks.join(lists, "chunk")


def score_documents(docs: DataFrame, held: Column, chunk_tokens: int = CHUNK_TOKENS, order: int = ORDER, bucket_hashes: int = BUCKET_HASHES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text.

    Where `held` holds a text is scored but not learnt.
    """
    spark = docs.sparkSession
    # a word has three characters and its space, at least, on the whole
    tokens = (docs.select(F.sum(F.length("text") + 1)).first()[0] or 0) // 4
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // bucket_hashes))
    chunks = _chunks(docs, held, buckets, chunk_tokens)
    answers: list[DataFrame] = []

    def asked(f, label: str) -> DataFrame:
        """The answers to what `f` asks for each chunk, given the answers before."""
        known = _with_answers(chunks, *(a.where("kind not like 'contexts%'") for a in answers)) if answers else chunks
        out = written(_reduced(_of_chunks(known, buckets, f, _ASK), buckets), label, ["kind"])
        answers.append(out)
        return out

    def ask_words(c: Chunk):
        yield from c.ask("words", c.vocab, np.bincount(c.tokens[c.trained], minlength=len(c.vocab)).astype(np.uint32))

    total = _summed(asked(ask_words, "katz-words"), "model")
    texts = chunks.select(F.sum(F.aggregate("held", F.lit(0), lambda n, h: n + F.when(h, 0).otherwise(1)))).first()[0] or 0
    numbers = Numbers(int(texts), int(total[0]), int(total[1]), np.array([0, *total[3 : K + 4]], np.float64))

    def ask_level(m: int):
        def ask(c: Chunk):
            levels = c.levels(numbers, min(m, order), m > order)
            if m <= order:
                yield from c.ask(f"grams{m}", levels[-1].key, levels[-1].trained)
            if m > 2:
                lower = numbers.word_probability(c.words()) if m == 3 else levels[m - 4].probability
                hashes, _, mass, lost, needed = c.contexts(levels[m - 3], lower)
                yield from c.ask(f"contexts{m - 1}", hashes, _trimmed(mass), _trimmed(lost), needed.astype(np.uint8))

        return ask

    for m in range(2, order + 2):  # the contexts of an order together with the n-grams of the next
        found = asked(ask_level(m), f"katz-grams-{m}")
        if m <= order:
            numbers.grams[m] = np.array([0, *_summed(found, f"grams{m}-counts")[3 : K + 4]], np.float64)

    def evaluate(c: Chunk):
        count = c.words()
        probability = numbers.word_probability(count)
        value = np.log10(probability)[c.tokens]
        for m, level in enumerate(c.levels(numbers, order), 2):
            place = level.by_hash(level.needed())
            mass, lost = (c.answer(f"contexts{m}-{k}", level.hashes[place], np.float64) for k in ("mass", "lost"))
            weight = np.zeros(len(level.hashes))
            weight[place] = np.log10(backoff(mass, lost, level.context_count[place]))
            new = level.valid & ~level.seen
            value[new] += weight[level.context_of[new]]
            value[level.seen] = np.log10(level.probability[level.at[level.seen]])
        base = np.log10((count + 0.5) / (numbers.tokens + 0.5 * (numbers.types + 1)))[c.tokens]
        sums = [np.add.reduceat(x, c.first) for x in ((count > 0)[c.tokens].astype(np.int64), base, value)]
        for k, doc_id in enumerate(c.ids):
            yield (doc_id, bool(c.held[k]), int(c.lengths[k]), int(sums[0][k]), numbers.tokens, float(sums[1][k]), float(sums[2][k]))

    scores = _of_chunks(
        _with_answers(chunks, *answers), buckets, evaluate,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
    scores = written(scores, "katz-scores")
    discard(chunks, *answers)
    spark.sql(f"DROP TABLE IF EXISTS {chunks._table}")
    return scores


def backoff(mass: np.ndarray, lost: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The weight of words not seen after contexts of `count`, whose pairs lost `lost` and whose words have lower-order `mass`."""
    left = np.where(lost > 0, lost / np.maximum(1, count), 1.0)
    return left / np.maximum(1 - mass, 1e-300)


def op6_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), fold("doc_id", 5, 1))
