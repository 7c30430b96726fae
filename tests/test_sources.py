from __future__ import annotations

import io
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioworks import backends
from folioworks.sources import files, signal
from folioworks.streaming import transcripts


def wav(samples: np.ndarray, rate=16000) -> bytes:
    body = samples.astype("<i2").tobytes()
    junk = b"LIST" + struct.pack("<I", 3) + b"abc\0"
    fmt = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16)
    data = junk + fmt + b"data" + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", 4 + len(data)) + b"WAVE" + data


def test_wav():
    assert np.allclose(files.parse_wav(wav(np.array([0, 16384, -32768]))), [0, 0.5, -1])
    for bad in (b"", b"RIFFxxxxWAVE", wav(np.zeros(2), 8000)):
        with pytest.raises(ValueError):
            files.parse_wav(bad)


def test_archives(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a/b.txt", "hi")
        z.writestr("../out.txt", "no")
    rows = spark.createDataFrame([("x.zip", bytearray(buffer.getvalue())), ("y.zip", bytearray(b"broken"))], "path string, content binary")
    got = {(r.path, r.name): (bytes(r.content or b""), r.error is not None) for r in files.archive_members(rows).collect()}
    assert got == {("x.zip", "a/b.txt"): (b"hi", False), ("y.zip", None): (b"", True)}


def test_texts_cookies_settings(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"# T\r\nx\xff")
    row = files.read_texts(spark, str(tmp_path)).first()
    assert (row.markdown, row.title) == ("# T\nx", "T")
    lines = spark.createDataFrame([("# c",), ("#HttpOnly_.x.y\tTRUE\t/\tFALSE\t0\tn\tv",), ("bad",)], "value string")
    c = files.cookies(lines).collect()
    assert [(r.domain, r.subdomains, r.secure, r.expires, r.http_only) for r in c] == [(".x.y", True, False, None, True)]
    env = spark.createDataFrame([("export A = 'b c'",), ("# x",), ("D=e",)], "value string")
    assert {r.name: r.value for r in files.settings(env).collect()} == {"A": "b c", "D": "e"}
    spec = spark.createDataFrame([("Firefox+kwallet:prof::box",)], "t string").select(files.browser_spec(F.col("t")).alias("s")).first()["s"]
    assert tuple(spec) == ("firefox", "KWALLET", "prof", "box")


def test_log_mel():
    tone = np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)
    m = signal.log_mel(tone)
    assert m.shape == (128, 100) and m.max() - m.min() <= 2.0 + 1e-9
    assert abs(int(m[:, 50].argmax()) - int(signal.filterbank()[:, 11].argmax())) <= 2


def test_sessions_and_backends(spark):
    rows = spark.createDataFrame([("c", "2024-01-01 00:00:00", 1.0, "a"), ("c", "2024-01-01 00:00:02", 1.0, "b"), ("c", "2024-01-01 00:00:09", 1.0, "c")], "clip_id string, ts string, seconds double, text string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = [r.text for r in transcripts.session_paragraphs(rows).orderBy("start").collect()]
    assert got == ["a b", "c"]
    asks = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, q string")
    out = {r.id: r.text for r in backends.answered(asks, "id", "q", backends.Fixed({"x": "X"}), backends.Fixed({"y": "Y"})).collect()}
    assert out == {"1": "X", "2": "Y", "3": None}
