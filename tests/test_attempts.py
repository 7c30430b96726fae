from __future__ import annotations

from pyspark.sql import functions as F

from folioworks.operators import attempts


def test_cookie_plan(spark):
    rows = spark.createDataFrame([(1, "youtube", None, ""), (2, "xiaohongshu", "c.txt", "edge"), (3, "x", "c.txt", None)], "id int, platform string, cookies_file string, browser string")
    got = {}
    for r in attempts.cookie_plan(rows).orderBy("id", "attempt").collect():
        got.setdefault(r.id, []).append((r.source, r.value))
    assert got[1] == [*(("browser", b) for b in attempts.BROWSERS), ("none", None)]
    assert got[2] == [("file", "c.txt"), ("browser", "edge")] and got[3] == [("file", "c.txt"), ("none", None)]


def test_streams_languages_models(spark):
    rows = spark.createDataFrame([(1, "xiaoyuzhoufm"), (2, "youtube")], "id int, platform string")
    got = attempts.stream_plan(rows).orderBy("id", "attempt").collect()
    assert [r.selector for r in got if r.id == 1] == ["best", "bestaudio"] and len(got) == 6
    one = spark.createDataFrame([(" ZH ", "french", "xx")], "a string, b string, c string").select(*(attempts.spoken_language(F.col(c)) for c in "abc")).first()
    assert tuple(one) == ("Chinese", "French", None)
    df = spark.createDataFrame([("", None), ("asr-0.6b", "8 bit"), ("asr-1.7b-4bit", "8bit"), ("odd", None), ("asr-0.6b", "5bit")], "m string, p string")
    got = [tuple(r[0]) for r in df.select(attempts.speech_model(F.col("m"), F.col("p"))).collect()]
    assert got == [("speech-1.7B-4bit", None), ("speech-0.6B-8bit", None), (None, "precision conflicts with the model's own"), (None, "unknown model"), (None, "unknown precision")]


def test_files(spark):
    files = spark.createDataFrame([(1, "audio_x.m4a", "talk"), (1, "talk.m4a", "talk"), (1, "talk.a.part", "talk"), (2, "audio_b", "t"), (2, "audio_a", "t")], "id int, name string, stem string")
    assert {r.id: r.name for r in attempts.downloaded_file(files).collect()} == {1: "talk.m4a", 2: "audio_a"}
    needed = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "snapshot string, name string")
    have = spark.createDataFrame([("a", "x"), ("b", "x")], "snapshot string, name string")
    assert {r.snapshot: r.complete for r in attempts.complete_snapshots(needed, have).collect()} == {"a": False, "b": True}
    errs = spark.range(1).select(attempts.argument_errors({"bad a": F.lit(True), "bad b": F.lit(False)})).first()[0]
    assert errs == ["bad a"]
