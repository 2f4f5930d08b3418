import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from provenant.llm import exact
from provenant.llm.exact import exact_duplicates

LONG = "Some words here And there are more of them. " * 400
TEXTS = [
    (7, "a  b"), (3, "a\tb"), (5, None), (4, ""), (6, " "), (9, LONG), (8, LONG.replace(" ", "\n ")),
    (10, LONG + "x"), (11, "a b"), (11, "a b"), (12, "é" * 5000), (13, "é" * 4999 + "e"), (14, "é" * 5000), (None, "null id"),
]


def brute(rows):
    groups = defaultdict(list)
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    for (d, _), n in zip(rows, norm):
        groups[n].append(d)
    out = []
    for (d, _), n in zip(rows, norm):
        ids = [x for x in groups[n] if x is not None]
        keep = min(ids) if ids else None
        out.append((d, keep, len(groups[n]), d == keep))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect()), key=str)


def test_groups_equal_brute_force(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("recipe", F.lit("clash"))
    assert got(exact_duplicates(docs)) == brute(TEXTS)


def test_chunks_that_share_a_hash_are_told_apart(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    assert got(exact_duplicates(docs, lambda c: F.lit(1).cast("long"))) == brute(TEXTS)


@pytest.mark.parametrize(("sent", "hot"), [(0, 1), (0, 100), (4, 2)])
def test_groups_too_many_to_be_sent(spark, monkeypatch, sent, hot):
    monkeypatch.setattr(exact, "SENT_IDS", sent)
    monkeypatch.setattr(exact, "HOT_ROWS", hot)
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    assert got(exact_duplicates(docs)) == brute(TEXTS)
    assert got(exact_duplicates(docs, lambda c: F.length(c).cast("long"))) == brute(TEXTS)


def test_cuts_follow_the_content(spark):
    """An insertion changes the chunks around it only."""
    text = " ".join(f"{w} number {k} is a word" for k, w in enumerate(["red", "blue", "long", "dull", "clear", "far"] * 800))
    other = text[:3000] + "something else" + text[3000:]
    rows = spark.createDataFrame([(1, text), (2, other)], "doc_id long, norm string").select(exact._chunks().alias("c")).collect()
    a, b = (r.c for r in rows)
    assert "".join(a) == text and "".join(b) == other
    assert len(set(a) & set(b)) > 0.9 * len(a) > 100


def test_empty_table(spark):
    assert exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
