import random
from functools import reduce

import numpy as np
import xxhash

import pytest

from provenant.llm import common, simhash


def brute_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = reduce(lambda s, c: s.replace(c, " "), "\t\n\x0b\x0c\r", lower).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, radius):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {v: find(v) for v in values}


def classes(of):
    out = {}
    for v, r in of.items():
        out.setdefault(r, set()).add(v)
    return {frozenset(c) for c in out.values()}


def cloud(n, seed, flips=6):
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(6)]
    out = {r.getrandbits(64) for _ in range(n)}
    while len(out) < 3 * n:
        v = r.choice(centres)
        for b in r.sample(range(64), r.randint(0, flips)):
            v ^= 1 << b
        out.add(v)
    return sorted(out)


def test_fingerprint_equals_brute_force():
    r = random.Random(1)
    texts = [None, "", " \n", "One", "A b c d", "A\x0bb c\xa0d é E f"]
    texts += [" ".join(r.choices(["Ab", "c", "É", "d,"], k=n)) for n in (4, 5, 9, 9000)]
    for t in texts:
        assert simhash.fingerprint(t or "") == brute_fingerprint(t)


def test_bit_planes_count_like_popcount():
    values = np.array(cloud(100, 2), np.uint64)
    planes = simhash.BitPlanes(values)
    planes.live[5] = False
    for radius in (0, 3, 4, 9):
        who, rows = planes.within(values[:7], radius)
        near = np.bitwise_count(values[:7, None] ^ values[None]) <= radius
        near[:, 5] = False
        assert sorted(zip(who, rows)) == sorted(zip(*np.nonzero(near)))


def test_forest_has_the_classes_and_few_edges():
    for n in (8, 150):
        values = cloud(n, n)
        edges = simhash.forest(np.array(values, np.uint64))
        assert all((a ^ b).bit_count() <= 8 for a, b in edges) and len(edges) < 3 * len(values)
        root = {v: v for v in values}

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        for a, b in edges:
            root[find(a)] = find(b)
        assert classes({v: find(v) for v in values}) == classes(roots(values, 4))


def test_links_with_crowded_buckets(spark):
    values = cloud(120, 9)
    signed = [(simhash._signed(v),) for v in values]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), crowded=20)
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    found = {v: got.get(simhash._signed(v), simhash._signed(v)) for v in values}
    assert classes(found) == classes(roots(values, 4))


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(100, 101)], "a long, b long")
    assert {(r.node, r.root) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(71)} | {(100, 100), (101, 100)}


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(3000))
    rows = [(9, base), (4, base.replace("w1500", "other")), (5, base.upper()), (7, None), (3, ""), (8, "w1 w2"), (8, "w1 w2"), (None, "null id here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' as fp")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {g.doc_id: g.component_id for g in got} == {9: 4, 4: 4, 5: 4, 7: 3, 3: 3, 8: 8, None: None}
    assert {g.doc_id: g.fp for g in got}[4] == simhash._signed(brute_fingerprint(rows[1][1]))


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_similar_copies_are_found_and_others_left_alone(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=r.randint(2, 8)))
    rows, kin = [], {}
    for k in range(40):
        base = [word() for _ in range(r.choice([40, 200, 900]))]
        rows.append((10 * k, " ".join(base)))
        for c in range(1, 4):
            text = base[:]
            for at in r.sample(range(len(base)), max(1, len(base) // 120)):
                text[at] = word()
            rows.append((10 * k + c, " ".join(text)))
    rows += [(5000, None), (5001, ""), (5002, "one two"), (5003, "one two")]
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, t in rows for w in [(t or "").split()]}
    got = {g.doc_id: g.component_id for g in simhash.similar_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows) and got[5000] == got[5001] != got[5002] == got[5003]
    pairs = missed = 0
    for k in range(40):
        for a in range(10 * k, 10 * k + 4):
            for b in range(10 * k, a):
                if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.85:
                    pairs += 1
                    missed += got[a] != got[b]
    assert pairs > 100 and missed <= pairs // 50
    assert all(a // 10 == b // 10 for a, b in got.items() if a < 5000 and a != b and abs(b) < 5000)


def test_wide_planes_count_both_words():
    r = np.random.default_rng(4)
    values = r.integers(0, 1 << 63, (90, 2)).astype(np.uint64)
    values[40:] = values[:50] ^ np.uint64(0b1011)
    who, rows = simhash.BitPlanes(values).within(values[:9], 27)
    near = np.bitwise_count(values[:9, None] ^ values[None]).sum(2) <= 27
    assert sorted(zip(who, rows)) == sorted(zip(*np.nonzero(near)))


def test_sparse_chains_in_large_buckets_stay_whole():
    def joined(values, edges):
        root = {v: v for v in values}

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        for a, b in edges:
            root[find(a)] = find(b)
        return classes({v: find(v) for v in values})

    for seed in range(3):
        r = random.Random(seed)
        values = set()
        while len(values) < 600:
            v = r.getrandbits(64)
            for _ in range(r.randint(2, 60)):
                values.add(v)
                for b in r.sample(range(64), r.randint(2, 4)):
                    v ^= 1 << b
        values = r.sample(sorted(values), len(values))
        edges = simhash.forest(np.array(values, np.uint64))
        assert all((a ^ b).bit_count() <= 4 for a, b in edges)
        assert len(edges) == len(values) - len(joined(values, edges))
        assert joined(values, edges) == classes(roots(values, 4))


@pytest.mark.parametrize("crowd", [simhash.CROWD, 5])
def test_similar_links_are_exact_at_the_edge(spark, crowd, monkeypatch):
    if crowd == 5:  # crowded buckets, hot keys and tables that can't be sent
        monkeypatch.setattr(simhash, "CROWD", crowd)
        monkeypatch.setattr(simhash, "PAIRS_TOGETHER", 2)
        monkeypatch.setattr(common, "SENT_ROWS", 0)
        monkeypatch.setattr(common, "HOT_ROWS", 3)
    r = random.Random(11)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=r.randint(4, 8)))
    passage = [word() for _ in range(30)]
    rows = []
    for k in range(150):
        base = [word() for _ in range(r.choice([9, 24, 60, 200]))] + (passage if k % 5 == 0 else [])
        text = base[:]
        for at in r.sample(range(len(base)), max(1, round(len(base) * r.uniform(0.01, 0.035)))):
            text[at] = word()
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(text if k % 3 else base[: -max(1, len(base) // 6)]))]
    rows += [(1000 + k, " ".join(word() for _ in range(6))) for k in range(400)]
    versions = [word() for _ in range(120)]
    for k in range(40):  # a large group, each next to some others only
        versions[r.randrange(120)] = word()
        rows.append((2000 + k, " ".join(versions)))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for _, t in rows for w in [t.split()]]
    root = {d: d for d, _ in rows}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    links = apart = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if 5 * both >= 4 * (len(a) + len(b) - both):
                root[find(rows[i][0])] = find(rows[j][0])
                links += 1
            apart += 0.6 < both / (len(a) + len(b) - both) < 0.8
    assert links > 30 and apart > 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {g.doc_id: g.component_id for g in simhash.similar_duplicates(docs).collect()}
    assert classes(got) == classes({d: find(d) for d, _ in rows})


@pytest.mark.parametrize("often", [32, 2])
def test_members_of_many_texts_come_last(spark, often, monkeypatch):
    """Buckets of what many texts share hold only texts that consist of it, and no link is lost."""
    monkeypatch.setattr(simhash, "OFTEN", often, raising=False)
    r = random.Random(23)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=r.randint(4, 8)))
    passage = [word() for _ in range(40)]
    rows = []
    for k in range(120):
        base = [word() for _ in range(120)] + passage
        text = base[:]
        for at in r.sample(range(len(base)), r.randint(1, 5)):
            text[at] = word()
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(text))]
    rows += [(1000 + k, " ".join(passage[k % 7 :] + [word() for _ in range(k % 3)])) for k in range(30)]  # of the passage alone
    texts, sizes, plain = dict(rows), [], simhash.open_pairs

    def seen(held, crowds):
        sizes.append(held.groupBy("h").count().agg({"count": "max"}).first()[0])
        return plain(held, crowds)

    monkeypatch.setattr(simhash, "open_pairs", seen)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {g.doc_id: g.component_id for g in simhash.similar_duplicates(docs).collect()}
    assert sizes[0] <= 40  # 240 texts hold the passage
    sets = {d: simhash.shingle_set(t) for d, t in texts.items()}
    root = {d: d for d in sets}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in sets:
        for b in sets:
            if a < b and simhash.similar(sets[a], sets[b]):
                root[find(b)] = find(a)
    assert 40 < len({find(d) for d in sets}) < len(sets) - 40
    assert classes(got) == classes({d: find(d) for d in sets})
