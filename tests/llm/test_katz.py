import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from provenant.llm import katz
from provenant.llm.common import fold


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


class Brute:
    """The model in dictionaries."""

    def __init__(self, texts, order=2):
        seqs = [tokens(t) for t in texts]
        self.order = order
        self.c = Counter(w for s in seqs for w in s)
        self.n = sum(self.c.values())
        self.dw = self._d(self.c)
        self.unknown = (self.n - sum(self._keep(self.dw, x) for x in self.c.values())) / self.n
        self.gram, self.context, self.d, self.after = {}, {}, {}, {}
        for m in range(2, order + 1):
            grams = [g for s in seqs for g in self.grams(s, m) if g]
            self.gram[m] = Counter(grams)
            self.context[m] = Counter(g[:-1] for g in grams)
            self.d[m] = self._d(self.gram[m])
            self.after[m] = defaultdict(list)
            for g in self.gram[m]:
                self.after[m][g[:-1]].append(g[-1])

    @staticmethod
    def grams(seq, m):
        """The n-gram of m words that ends at each token; none where the text's beginning is nearer."""
        padded = ["<s>", *seq]
        return [tuple(padded[i - m + 2 : i + 2]) if i >= m - 2 else None for i in range(len(seq))]

    def _d(self, counts):
        n = Counter(counts.values())
        return katz.discounts(np.array([0, *(n[r] for r in range(1, katz.K + 2))], float))

    def _keep(self, d, r):
        return d[r if r <= katz.K else 0] * r

    def word(self, w):
        return self._keep(self.dw, self.c[w]) / self.n if w in self.c else self.unknown

    def p(self, context, w):
        """`context`: the words before, `order` - 1 of them at most."""
        m = len(context) + 1
        if m == 1:
            return self.word(w)
        if context not in self.context[m]:
            return self.p(context[1:], w)
        gram, total = self.gram[m], self.context[m][context]
        if (*context, w) in gram:
            return self._keep(self.d[m], gram[*context, w]) / total
        left = 1 - sum(self._keep(self.d[m], gram[*context, x]) for x in self.after[m][context]) / total
        return left / (1 - sum(self.p(context[1:], x) for x in self.after[m][context])) * self.p(context[1:], w)

    def score(self, seq):
        padded = ["<s>", *seq]
        return sum(math.log10(self.p(tuple(padded[max(0, i - self.order + 2) : i + 1]), w)) for i, w in enumerate(seq))


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocab = [f"W{i}" if i % 3 else f"é{i}" for i in range(80)]
    return [None, "", " \n ", *(" ".join(vocab[min(79, int(r.expovariate(0.08)))] for _ in range(r.randint(1, 150))) for _ in range(n))]


@pytest.mark.parametrize(("chunk", "order", "bucket"), [(150, 2, 10**6), (10**6, 2, 10**6), (150, 3, 300), (10**6, 3, 10**6), (400, 4, 10**6)])
def test_scores_equal_brute_force(spark, chunk, order, bucket):
    rows = list(enumerate(corpus())) + [(500, "never seen words W1"), (None, "W1 W2"), (501, "W1 W2"), (501, "W1 W2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "1 as chunk", "'x' as held")
    got = katz.score_documents(docs, fold("doc_id", 5, 1), chunk, order, bucket).collect()
    assert len(got) == len(rows)
    held = {g.doc_id: g.held_out for g in got}
    model = Brute([t for d, t in rows if not held[d]], order)
    texts = dict(rows)
    assert any(held.values()) and not held[None]
    for g in got:
        seq = tokens(texts[g.doc_id])
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(seq), sum(w in model.c for w in seq), model.n)
        base = sum(math.log10((model.c[w] + 0.5) / (model.n + 0.5 * (len(model.c) + 1))) for w in seq)
        assert abs(g.base_score - base) < 1e-8
        assert abs(g.score - model.score(seq)) < 1e-7, g
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("katz_chunks")]


def test_brute_model_is_normalised():
    for order in (2, 3):
        model = Brute(corpus(), order)
        for context in [("<s>",), ("unseen",), *list(model.context[order])[:30], *[(w,) for w in list(model.c)[:10]]]:
            total = sum(model.p(context, w) for w in model.c) + model.p(context, "no such word")
            assert abs(total - 1) < 1e-9


def test_nothing_to_learn_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    got = katz.score_documents(docs, F.lit(True)).collect()[0]
    assert (got.n_tokens, got.n_known, got.train_tokens, got.score) == (3, 0, 0, 0.0)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert katz.score_documents(empty, F.lit(True)).count() == 0


def test_long_texts_are_read_in_parts(spark):
    r = random.Random(2)
    words = ["É", "eÉ", "A", "Bc", "\x1cx", "ÀB\x85", "日本", "z" * 50]
    rows = [(k, r.choice(["", " ", "\n"]).join(["", *(f"{w} " for w in r.choices(words, k=110_000)), ""])) for k in range(4)] + [(9, None), (10, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {g.doc_id: g for g in katz.score_documents(docs, F.col("doc_id") == 1, 30_000).collect()}
    learnt = Counter(w for d, t in rows if d != 1 for w in tokens(t))
    n = sum(learnt.values())
    for d, t in rows:
        own = tokens(t)
        base = sum(math.log10((learnt[w] + 0.5) / (n + 0.5 * (len(learnt) + 1))) for w in own)
        assert (got[d].n_tokens, got[d].train_tokens) == (len(own), n) and abs(got[d].base_score - base) < 1e-4
