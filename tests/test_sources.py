import json

import pytest
from pyspark.sql import functions as F

from provenant import __main__ as command
from provenant import sources
from provenant.errors import LabelError, Untrackable
from provenant.plans import label, save_lineage, track
from provenant.streaming import windowed, write_tracked


def test_formats_carry_labels(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, "b\tc", "x")], "k long, s string, t string")
    schema = "k long, s string, t string"
    for kind in ("json", "parquet", "csv", "tsv"):
        path = str(tmp_path / kind)
        df.write.format("csv" if kind == "tsv" else kind).options(**({"sep": "\t"} if kind == "tsv" else {})).save(path)
        got = track(sources.read(spark, kind, path, {"s": "k = 1"}, None if kind == "parquet" else schema))
        assert sorted((r.k, r.s, r.s__tag, r.k__tag) for r in got.to_flat().collect()) == [(1, "a", True, False), (2, "b\tc", False, False)]
    assert track(sources.read_json(spark, str(tmp_path / "json"), ["s"], schema)).tagged_columns() == ["s"]
    assert track(sources.read_parquet(spark, str(tmp_path / "parquet"), ["k"])).tagged_columns() == ["k"]


def test_named_datasets(spark):
    sources.register_dataset("numbers", lambda s, n: s.range(n))
    got = track(sources.read_dataset(spark, "numbers", 3, labels=["id"]))
    assert got.to_flat().where("id__tag").count() == 3
    with pytest.raises(LabelError):
        sources.read_dataset(spark, "nothing")


def test_cells_written_and_read(spark, tmp_path):
    df = label(spark.createDataFrame([(1, (2, "x")), (3, None)], "k long, s struct<a: int, b: string>"), {"s.b": "k = 1"})
    tracked = track(df)
    for kind in ("json", "parquet"):
        sources.write_cells(tracked, kind, str(tmp_path / kind))
        back = track(sources.read_cells(spark, kind, str(tmp_path / kind), tracked.to_cells().schema))
        assert sorted(map(str, back.select_tags("k", "s.b").select("k", "k__tag", "s_b__tag").collect())) == sorted(map(str, tracked.select_tags("k", "s.b").select("k", "k__tag", "s_b__tag").collect()))
    sources.write_flat(tracked, "parquet", str(tmp_path / "flat"))
    assert spark.read.parquet(str(tmp_path / "flat")).columns == ["k", "k__tag", "s", "s__tag"]


def test_command_line(spark, tmp_path):
    spark.createDataFrame([(1, 10), (1, 20), (2, 5)], "k long, v long").write.parquet(str(tmp_path / "t"))
    out, lines = str(tmp_path / "out"), tmp_path / "lineage.json"
    command.main(["-i", f"t=parquet:{tmp_path}/t", "-t", "t.v", "-q", "select k, sum(v) s from t group by k", "-o", f"parquet:{out}", "--lineage", str(lines)])
    assert sorted(spark.read.parquet(out).collect()) == [(1, False, 30, True), (2, False, 5, True)]
    assert json.loads(lines.read_text())["columns"] == {"k": ["t.k"], "s": ["t.v"]}


def test_lineage_file(spark, tmp_path):
    save_lineage(spark.range(3).select((F.col("id") + 1).alias("x")), str(tmp_path / "l.json"))
    assert json.loads((tmp_path / "l.json").read_text())["columns"]["x"]


def test_stream_with_watermark_appends_closed_windows(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "b", 2.0), ("2024-01-01 01:10:00", "b", 4.0), ("2024-01-02 00:00:00", "b", 8.0)]
    df = spark.createDataFrame(rows, "ts string, k string, v double").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = windowed(label(stream, {"v": "k = 'a'"}), "ts", "v", watermark="10 minutes", size="1 hour")
    write_tracked(query, "parquet", str(tmp_path / "check"), path=str(tmp_path / "out")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("start").select("total", "total__tag", "n", "start__tag").collect()
    assert [tuple(r) for r in got] == [(3.0, True, 2, False), (4.0, False, 1, False)]


def test_opaque_streams_are_refused(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    stream = label(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), ["id"])
    with pytest.raises(Untrackable):
        write_tracked(stream.mapInPandas(lambda it: it, "id long"), "noop")
