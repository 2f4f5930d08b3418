import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from provenant.llm import bpe, common
from provenant.llm.bpe import default_vocabulary, encode_documents, op9_bpe
from provenant.llm.packing import TIERS, Packer, op10_packing, pack_documents

WORDS = ["the", "of", "été", "don't", "thing-y", "日本", "x<|endoftext|>y", "Straße", "1234", "ΣΑΣ", "\x1c\x85", "İ", "😀"]


def texts(n=60, seed=1):
    r = random.Random(seed)
    return [None, "", " ", *(" ".join(r.choices(WORDS, k=r.choice([1, 5, 300, 3000]))) for _ in range(n))]


def test_ids_and_decoding_equal_the_library(spark):
    rows = list(enumerate(texts()))
    lib = Tokenizer.from_file(default_vocabulary())
    df = encode_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: (np.frombuffer(bytes(r.ids), "<u4").tolist(), r.decoded) for r in df.collect()}
    for d, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[d] == (ids, lib.decode(ids, skip_special_tokens=False))


def test_pieces_cover_every_id_once_without_padding(spark):
    rows = list(enumerate(texts()))
    lib = Tokenizer.from_file(default_vocabulary())
    ids = {d: np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in rows}
    pieces = pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), buffer_tokens=9000).collect()
    at = {d: 0 for d, _ in rows}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == at[p.doc_id] and p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
        at[p.doc_id] += p.length
    assert at == {d: len(x) for d, x in ids.items()}
    end = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == end.get(p.sequence_id, 0)
        end[p.sequence_id] = p.offset + p.length
    assert all(n <= 2048 and n & (n - 1) == 0 for n in end.values())


def test_packer_keeps_ties_and_repeats():
    placed = []
    packer = Packer(lambda *a: placed.append(a))
    for k in range(50):
        packer.add(k, 700)
        packer.add(k, 1)
    packer.finish()
    assert sum(p[0][0] for p in placed) == 50 * 701
    windows = {}
    for piece, sequence, _, context, place in placed:
        windows.setdefault((sequence, context, place), [0])[0] += piece[0]
    assert all(n == context for (_, context, _), (n,) in windows.items())
    for size in {c for _, c, _ in windows}:
        assert sorted(p for _, c, p in windows if c == size) == list(range(packer.full[size]))
    assert max(TIERS) == 2048


@pytest.mark.parametrize("sent", [common.SENT_ROWS, 0])
def test_all_steps_but_the_last_weigh_the_same(spark, monkeypatch, sent):
    monkeypatch.setattr(common, "SENT_ROWS", sent)
    rows = list(enumerate(texts(90, 4)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    pieces = pack_documents(docs, step_tokens=4096, buffer_tokens=9000).collect()
    weight, sizes = {}, {}
    for p in pieces:
        weight[p.step_group] = weight.get(p.step_group, 0) + p.length
        sizes.setdefault(p.step_group, set()).add(p.context)
    last = max(weight)
    assert sorted(weight) == list(range(last + 1)) and last > 10
    assert all(n == 4096 for g, n in weight.items() if g != last) and 0 < weight[last] <= 4096
    assert sum(len(s) > 1 for s in sizes.values()) <= 12
    group = {}
    for p in pieces:
        assert group.setdefault(p.sequence_id, p.step_group) == p.step_group


def test_steps_are_powers_of_two(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for bad in ({"step_tokens": 5000}, {"step_tokens": 1024}, {"tiers": (2048, 300)}):
        with pytest.raises(ValueError):
            pack_documents(docs, **bad)


HARD = [
    "It's don'T 'tis x'sss !'s ''s we'll I'd", "a\x1cb c\x0bd \x85e\xa0f", "İx ŉ ǅ \xdf \xc5\xc9 \xbd\xb2①", "é ​", "<|endoftext|> x<|y",
    "12 3a4 \xad-- _a_ a\x00b \x7f", "ﬁ ſ \xaa\xba", "'", "''' '''", "q" * 5000, "中文 text", "word " * 30000, "nö \xf6", " lead", "trail\n\n",
]


def test_queries_on_hard_texts(spark, tmp_path):
    """op9 and op10 themselves: nulls, repeated rows and ids, very long texts, clashing extra columns."""
    rows = list(enumerate(HARD)) + [(7, "seven again"), (8, HARD[8]), (8, HARD[8]), (50, None), (51, ""), (None, "null id"), (None, None)]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, ids long, sequence_id string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    lib = Tokenizer.from_file(default_vocabulary())
    want, tokens = [], []
    for d, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        tokens.append((d, len(ids) + 1))
    assert sorted(map(tuple, op9_bpe(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)
    pieces = op10_packing(spark, str(tmp_path)).collect()
    assert sum(p.length for p in pieces) == sum(n for _, n in tokens)
    assert sorted(((p.doc_id, p.doc_tokens) for p in pieces if p.start == 0), key=str) == sorted(tokens, key=str)


def test_words_are_kept_between_batches(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 20)
    e, lib = bpe.TrieBpe(default_vocabulary()), Tokenizer.from_file(default_vocabulary())
    for t in texts(30, 8):
        assert np.frombuffer(e.encode([t])[0], "<u4").tolist() == lib.encode(t or "", add_special_tokens=False).ids


def test_edges_tell_what_merging_tells():
    e, r = bpe.TrieBpe(default_vocabulary()), random.Random(3)
    ids = [i for t, i in e.vocab.items() if i not in e.special.values()]
    inner = [i for i in ids if not e.tokens[i].endswith(e.end)]
    short = [i for i in inner if len(e.tokens[i]) <= 3]
    pairs = [(r.choice(inner), r.choice(ids)) for _ in range(1500)] + [(r.choice(short), r.choice(short)) for _ in range(3000)]
    pairs += [(i, i) for i in short[:500]]
    fast = [e._compatible(a, b) for a, b in pairs]
    e._merges_ordered = False
    assert fast == [e._compatible(a, b) for a, b in pairs] and 0 < sum(fast) < len(fast)


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert encode_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
