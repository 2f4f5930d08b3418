import os
import random

import corpus_pipeline
from provenant.llm.common import ROW, keep_first, numbered


def test_keep_first_of_each_group(spark):
    rows = [(5, "a", 1), (3, "b", 2), (3, "b", 2), (None, "c", 3), (9, "d", 4), (4, "e", 5), (4, "f", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").selectExpr("*", "'x' as group")
    numbers = numbered(docs)
    groups = numbers.selectExpr(ROW, "case when text in ('a','b','c') then 1 when text in ('e','f') then 2 else 3 end as group")
    got = sorted((r.doc_id, r.text) for r in keep_first(numbers, groups).collect())
    assert got[0] == (3, "b") and got[1][0] == 4 and got[2] == (9, "d") and len(got) == 3
    assert keep_first(numbers, groups).columns == docs.columns


def test_stages_equal_brute_force(spark, tmp_path):
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    clean = [text(r.randint(60, 300)) for _ in range(120)]
    poor = [" ".join(w.upper() + "!!" for w in text(80).split()) for _ in range(60)]
    base = text(2000)
    rows = list(enumerate(clean)) + [(200 + k, t) for k, t in enumerate(poor)]
    near = base.split()
    near[900] = "changed"
    rows += [(300, base), (301, base.replace(" ", "  ")), (302, " ".join(near)), (303, None), (304, ""), (0, clean[0])]
    passage = text(90)
    rows += [(400, text(50) + " " + passage + " " + text(50)), (401, text(70) + " " + passage)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(os.path.join(tmp_path, "documents.parquet"))
    labels = [(d, int(d < 200)) for d, t in rows if d < 300]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(os.path.join(tmp_path, "labels.parquet"))
    docs = spark.read.parquet(os.path.join(tmp_path, "documents.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        kept.append(sorted(d.doc_id for d in docs.collect()))
    plain = [d for d, _ in rows if d < 200 or d >= 300]
    assert set(kept[0]) >= set(plain) - {303, 304} and not [d for d in kept[0] if 200 <= d < 300]
    assert kept[1].count(0) == 1 and 300 in kept[1] and 301 not in kept[1] and 302 in kept[1]
    assert 300 in kept[2] and 302 not in kept[2] and kept[3] == kept[2]
    texts = {d.doc_id: d.text for d in docs.collect()}
    assert passage not in texts[400] and passage[100:300] not in texts[401] and texts[5] == clean[5]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == set(kept[3])
    assert {p.doc_id: p.doc_tokens for p in pieces if p.start == 0}.keys() == set(kept[3])
