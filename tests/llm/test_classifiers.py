import math
import random
from itertools import pairwise
from zlib import crc32

import numpy as np

from provenant.llm import langid, quality

SYLLABLES = {"xx": ["ba", "do", "mi", "ler"], "yy": ["sch", "tz", "ung", "ö"], "zz": ["ção", "lh", "ém", "ou"]}


def corpus(n=90, seed=3):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        lang = sorted(SYLLABLES)[k % 3]
        words = ["".join(r.choices(SYLLABLES[lang], k=r.randint(1, 4))) for _ in range(r.randint(20, 200))]
        rows.append((k, " ".join(words), lang))
    return rows


def grams(text):
    padded = f" {langid._OTHER.sub(' ', text.lower()).strip()} "
    return {padded[i : i + n] for n in range(1, langid.LONGEST + 1) for i in range(len(padded) - n + 1)}


def test_presence_kernel_equals_brute_force():
    texts = [t for _, t, _ in corpus(8)]
    slots = 1 << 24  # wide enough that n-grams rarely share a slot
    for a, b in pairwise(texts):
        x, y = set(langid.presence(a, slots)), set(langid.presence(b, slots))
        brute = len(grams(a) & grams(b)) / math.sqrt(len(grams(a)) * len(grams(b)))
        assert abs(len(x & y) / math.sqrt(len(x) * len(y)) - brute) < 0.01


def test_held_out_languages_and_edge_rows(spark):
    rows = corpus()
    odd = [(900, None, "xx"), (901, "", "xx"), (902, " 12 !?", None), (903, rows[0][1], None), (903, rows[0][1], None), (904, rows[1][1] * 400, None), (None, rows[2][1], "zz")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").selectExpr("*", "1 as turn", "2 as slots")
    model = langid.train(docs, learn="doc_id < 60")
    got = {}
    for r in langid.identify(docs, model).collect():
        got[r.doc_id] = (r.lang_pred, r.score)
    assert all(got[k][0] == lang for k, _, lang in rows[60:])
    assert got[900] == got[901] == got[902] == ("und", 0.0)
    assert got[903][0] == rows[0][2] and got[904][0] == rows[1][2] and got[None][0] == "zz"
    assert all(0 <= s <= 1 for _, s in got.values())


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert langid.identify(docs, langid.train(docs)).collect()[0].lang_pred == "und"


def test_ranking_separates_held_out_rows(spark):
    r = random.Random(5)
    rows, labels = [], []
    for k in range(300):
        words = ["".join(r.choices("abcdefgh", k=r.randint(2, 8))) for _ in range(r.randint(5, 120))]
        rows.append((k, " ".join(w + "!!" if k % 4 == 0 else w for w in words)))
        labels.append((k, int(k % 4 != 0)))
    odd = [(1000, None), (1001, ""), (1002, rows[1][1] * 500), (1, rows[1][1])]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").selectExpr("*", "0 as quality")
    labelled = spark.createDataFrame([*labels, (1000, None), (None, 1), (2, 7)], "doc_id long, quality int")
    model = quality.train(docs, labelled, learn="doc_id < 200")
    got = quality.quality_scores(docs, model).collect()
    assert len(got) == len(rows) + 4
    assert all(g.predicted == int(g.doc_id % 4 != 0) for g in got if g.doc_id < 300)
    assert all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.5) for g in got)
    assert quality.keep_good(docs, model).columns == docs.columns


def test_pairwise_fit_matches_plain_gradient_ascent():
    r = np.random.default_rng(1)
    x = r.normal(size=(60, 3))
    y = (x[:, 0] + 0.5 * r.normal(size=60) > 0).astype(int)
    model = quality.fit(x, y)
    z = model.expand(x)
    d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, z.shape[1])
    w = np.zeros(z.shape[1])
    for _ in range(20000):
        w += 0.002 * (d.T @ (1 / (1 + np.exp(d @ w))) - w)
    assert np.allclose(w, model.weights, atol=1e-3)
    assert abs(np.mean(model.scores(x) < 0.5) - np.mean(y == 0)) < 0.05


def test_no_pairs_scores_a_half(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.quality_scores(docs, quality.train(docs, labels)).collect()[0].score == 0.5


def test_letters_are_unicode_letters(spark):
    rows = corpus(30)
    odd = ["\xbd \xb2", "\u2460", "\u2167 \u0663", "_ 12", "\u0301", "\u0915\u093f", "a1"]
    docs = spark.createDataFrame([*rows, *((100 + k, t, None) for k, t in enumerate(odd))], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, langid.train(docs)).collect()}
    assert [got[100 + k] == "und" for k in range(len(odd))] == [True] * 5 + [False] * 2


def test_batched_product_equals_the_dense_one(monkeypatch):
    monkeypatch.setattr(langid, "_GATHERED", 500)
    texts = ["", *(t for _, t, _ in corpus(12)), "12"]
    slots_of = [langid.presence(t, 1 << 12) for t in texts]
    dense = np.zeros((len(texts), 1 << 12))
    for row, there in zip(dense, slots_of, strict=True):
        row[there] = max(1, len(there)) ** -0.5
    matrix = np.random.default_rng(1).normal(size=(1 << 12, 3))
    assert np.allclose(langid.product(slots_of, matrix), dense @ matrix)


def test_samples_are_bounded_whatever_repeats(spark, monkeypatch):
    rows = corpus(48) + [(7, corpus(8)[7][1], corpus(8)[7][2])] * 60 + [(500, f"other text {k}", "rare") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    own = langid.fit
    monkeypatch.setattr(langid, "fit", lambda x, langs: seen.append(langs) or own(x, langs))
    langid.train(docs, max_train=20)
    assert len(seen[0]) == 20 and {lang: seen[0].count(lang) for lang in set(seen[0])} == {"xx": 5, "yy": 5, "zz": 5, "rare": 5}
    monkeypatch.setattr(quality, "fit", lambda x, label: seen.append(sorted(label)))
    labels = spark.createDataFrame([(7, 1)] * 50 + [(500, 0)] * 50 + [(k, k % 2) for k in range(40)], "doc_id long, quality int")
    quality.train(docs, labels, max_labels=30)
    assert len(seen[1]) == 30
    quality.train(docs, labels.where("doc_id in (7, 500)"), max_labels=30)
    assert seen[2] == [0, 1]


def test_rare_language_among_many_rows_is_learnt(spark):
    rows = [r for r in corpus(300) if r[2] != "zz"]
    rows += [(9000 + k, t, "zz") for k, (_, t, lang) in enumerate(corpus(12, 9)) if lang == "zz"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, max_train=12)
    assert model.langs == ["xx", "yy", "zz"]
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    assert all(got[d] == lang for d, _, lang in rows)


def test_ties_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "same text", "b"), (2, "same text", "a"), (3, "same text", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(docs, langid.train(docs)).collect()} == {"a"}
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert len({(r.score, r.predicted) for r in quality.quality_scores(docs, model).collect()}) == 1
    none = docs.where("false")
    assert langid.identify(none, langid.train(none)).count() == 0
    assert quality.quality_scores(none, quality.train(none, labels.where("false"))).count() == 0
    assert quality.keep_good(none, quality.train(docs, labels.where("false"))).count() == 0


def test_queries_run_on_whole_tables(spark, tmp_path):
    rows = [(k, t, lang, "x") for k, t, lang in corpus(90)] + [(None, None, None, "x"), (4, "", "xx", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, k % 2, "x") for k in range(60)], "doc_id long, quality int, text string").write.parquet(str(tmp_path / "labels.parquet"))
    one, seven = langid.op1_langid(spark, str(tmp_path)).collect(), quality.op7_quality(spark, str(tmp_path)).collect()
    assert len(one) == len(seven) == len(rows)
    held = {k for k, *_ in rows if k is not None and crc32(str(k).encode()) % 5 == 0}
    assert {r.doc_id for r in one if r.held_out} == held and sum(r.lang_pred == rows[r.doc_id][2] for r in one if r.held_out and r.doc_id != 4) >= len(held - {4}) * 0.9
    assert all(r.predicted == int(r.score >= 0.5) and r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 3 == 1) for r in seven)
