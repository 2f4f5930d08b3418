import random
from collections import Counter

import numpy as np
import pytest

from provenant.llm import suffixes


def brute(texts, depth):
    datas = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + depth] for d in datas for i in range(len(d) - depth + 1))
    out = []
    for d in datas:
        gone = [False] * len(d)
        for i in range(len(d) - depth + 1):
            if seen[d[i : i + depth]] > 1:
                gone[i : i + depth] = [True] * depth
        spans, at = [], 0
        while at < len(d):
            end = at
            while end < len(d) and gone[end] == gone[at]:
                end += 1
            if gone[at]:
                spans.append((at, end))
            at = end
        out.append(spans)
    return out


def make_texts(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghijé ", k=r.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (60, 75, 90, 130, 300)]
    out = [None, "", "short", "a" * 399, "b" * 1500, "ab" * 450, "line of text\n" * 80, passages[2] * 3]
    for _ in range(60):
        parts = [text(r.randint(0, 120))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a, b = sorted(r.sample(range(len(p)), 2))
            parts += [p if r.random() < 0.6 else p[a:b], text(r.randint(0, 60))]
        out.append("".join(parts))
    copy = list(out[20] + text(200))
    copy[len(copy) // 2] = "X"
    return out + ["".join(copy), out[20], out[20]]


@pytest.mark.parametrize("crowded", [suffixes.CROWDED, 1])
def test_equals_brute_force(spark, crowded, monkeypatch):
    if crowded == 1:  # the ways for what can't be sent to all executors
        monkeypatch.setattr(suffixes, "SENT_ANCHORS", 0)
        monkeypatch.setattr(suffixes, "SENT_ROWS", 0)
    texts = make_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as ahash", "2 as _spans")
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in suffixes.repeated_spans(docs, crowded=crowded).collect()}
    assert got == dict(enumerate(brute(texts, suffixes.DEPTH)))


def test_blocks_of_a_very_long_text():
    r = random.Random(3)
    data = np.frombuffer(bytes(r.choices(b"abcdef", k=5000)), np.uint8)
    whole = list(suffixes.runs(data))
    parts = list(suffixes.runs(data, block=700))
    cover = lambda rs: [(a, p) for a, p, s, n in rs for _ in range(n)]
    assert cover(whole) == cover(parts)


def brute_words(texts, depth):
    """Which words of each text a repeated stretch of `depth` words covers."""
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + depth]) for w in words for i in range(len(w) - depth + 1))
    gone = [[False] * len(w) for w in words]
    for w, g in zip(words, gone, strict=True):
        for i in range(len(w) - depth + 1):
            if seen[tuple(w[i : i + depth])] > 1:
                g[i : i + depth] = [True] * depth
    return [[x.decode() for x, y in zip(w, g, strict=True) if not y] for w, g in zip(words, gone, strict=True)]


@pytest.mark.parametrize("crowded", [suffixes.CROWDED, 1])
def test_words_equal_brute_force(spark, crowded, monkeypatch):
    if crowded == 1:
        monkeypatch.setattr(suffixes, "SENT_ANCHORS", 0)
        monkeypatch.setattr(suffixes, "SENT_ROWS", 0)
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcé", k=r.randint(1, 4)))
    words = lambda n: [word() for _ in range(n)]
    space = lambda: r.choice([" ", "\n", "\t ", "\x0b"])
    passages = [words(n) for n in (49, 50, 51, 55, 60, 200)]
    assert all(len(" ".join(p)) < 400 for p in passages[:5])
    texts = [None, "", "a " * 49, "b " * 120, "\x1c".join(words(70))]
    for _ in range(80):
        parts = words(r.randint(0, 90))
        for _ in range(r.randint(0, 3)):
            parts += r.choice(passages) + words(r.randint(0, 40))
        texts.append("".join(w + space() for w in parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {g.doc_id: [w.decode() for w in (g.text or "").encode().split()] for g in suffixes.without_repeats(docs, suffixes.WORDS, crowded).collect()}
    want = brute_words(texts, 50)
    assert got == dict(enumerate(want)) and sum(map(len, want)) < sum(len((t or "").split()) for t in texts) - 5000


def test_repeated_rows_and_kept_columns(spark):
    r = random.Random(2)
    long = "".join(r.choices("abcdefgh é", k=900))
    rows = [(1, "x" + long, 7), (1, "x" + long, 7), (2, "tail " + long[:500] + " end", None), (None, "clean", 1), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = suffixes.without_repeats(docs).collect()
    assert sorted((g.doc_id or 0, g.text, g.n_chars) for g in got if g.text is not None) == [(0, "clean", 5), (1, "", 0), (1, "", 0), (2, "tail  end", 9)]
    assert [g.text for g in got if g.doc_id == 3] == [None]


def test_empty_table(spark):
    assert suffixes.repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_crowded_anchors_make_few_rows(spark, monkeypatch):
    """A passage in many surroundings: its windows meet in blocks, and only those at its borders one by one."""
    r = random.Random(31)
    text = lambda n: "".join(r.choices("abcdefghij ", k=n))
    passage, counts, plain = text(700), {}, suffixes.written

    def seen(df, label, *rest):
        out = plain(df, label, *rest)
        counts[label] = out.count()
        return out

    monkeypatch.setattr(suffixes, "written", seen)
    texts = [text(r.randint(300, 500)) + passage + text(r.randint(300, 500)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: [(s.start, s.end) for s in x.spans] for x in suffixes.repeated_spans(docs, crowded=5).collect()}
    assert got == dict(enumerate(brute(texts, suffixes.DEPTH)))
    assert 0 < counts["crowds"] and counts["crowd-windows"] < 40 * 100
