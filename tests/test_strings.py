from __future__ import annotations

from pyspark.sql import functions as F

from folioworks.functions import routing, strings, timecode


def test_title_sources_and_cleanup(ev):
    title = lambda t: ev(lambda c: strings.title(c, F.lit("fallback")), t)
    assert title("plain\n# **Big** [Title](u) {#id}\n") == "Big Title"
    assert title("Heading\n\n=====\ntext") == "Heading"
    assert title("![x](y)\nhttp://a\n\"Quoted title。\"") == "Quoted title"
    assert title("# \n") == "fallback"
    assert title("  \n\t") == "fallback"


def test_white_space_is_unicode(ev):
    assert ev(strings.strip, "　a b ") == "a b"
    assert ev(strings.words, " a　b\x1fc ") == ["a", "b", "c"]
    assert ev(strings.words, " ") == []
    assert ev(strings.lines, "a\r\nb\x0bc\n") == ["a", "b", "c"]


def test_normalized_is_idempotent(ev):
    once = ev(strings.normalized, "a  \r\n\n\n\n b\t\nc ")
    assert once == "a\n\n b\nc"
    assert ev(strings.normalized, once) == once


def test_names_and_escapes(ev):
    assert ev(lambda c: strings.file_name(c, "transcript", "md"), "A: b/c  d.") == "A__b_c_d_transcript.md"
    assert ev(lambda c: strings.file_name(c, "ocr", "md"), "...") == "output_ocr.md"
    assert ev(strings.percent_decoded, "a%20b+c") == "a b+c"
    assert ev(strings.percent_decoded, "a%2") == "a%2"
    assert ev(lambda c: strings.file_stem(c, 4), "ééé") == "éé"
    assert ev(strings.quoted, "it's") == '"it\'s"'
    assert ev(strings.without_markup, "a<b>c<d") == "a c "
    assert ev(strings.asr_text, "language en<asr_text> hello ") == "hello"
    assert ev(lambda c: F.size(strings.pages_of(c)), "a<PAGE>b< /page 2 >c") == 3


def test_similarity_counts_characters(spark):
    assert spark.range(1).select(strings.similarity(F.lit("你好a"), F.lit("你坏a"))).first()[0] == 1 - 1 / 3
    assert spark.range(1).select(strings.similarity(F.lit(""), F.lit(""))).first()[0] == 1.0


def test_suffix(ev):
    for path, want in (("a.TXT", ".txt"), ("a/.bashrc", ""), ("a.", ""), ("x.tar.gz", ".gz"), ("d.v2/readme", ""), ("..a.b", ".b")):
        assert ev(routing.suffix, path) == want, path


def test_urls(ev):
    for url, want in (("https://a.b/c", True), ("HTTP://x", True), ("ftp://x", False), ("http://", False), ("http://[::1/", False), ("http://[::1]/", True), ("note", False)):
        assert ev(routing.is_url, url) is want, url
    assert ev(routing.platform, "https://youtu.be/x") == "youtube"
    assert ev(routing.base_url, "host:8000/") == "http://host:8000/v1"
    assert ev(routing.file_uri, "/a b/ü~*.md") == "file:///a%20b/%C3%BC~%2A.md"


def test_routes(spark):
    rows = [("https://x.y", None, False), ("https://x.y", "ocr", False), ("a.png", None, False), ("a.pdf", None, True), ("a.pdf", None, False), ("a.pdf", "ocr", False), ("a.mp3", None, False), ("a.mp3", "convert", False), ("a.md", None, False), ("a.xyz", None, False)]
    df = spark.createDataFrame(rows, "s string, t string, scanned boolean")
    got = [(r.r.source_kind, r.r.task_type, r.e is not None) for r in df.select(routing.route(F.col("s"), F.col("t"), F.col("scanned")).alias("r")).withColumn("e", routing.route_error(F.col("r"))).collect()]
    assert got == [("url", "transcript", False), ("url", None, True), ("image_file", "ocr", False), ("document_file", "ocr", False), ("document_file", "convert", False), ("document_file", "ocr", False), ("audio_file", "transcript", False), ("audio_file", None, True), ("document_file", "convert", False), ("unknown", None, True)]


def test_precision_and_models(ev):
    assert ev(routing.precision, " 4-BIT ") == "4bit"
    assert ev(routing.precision, "5bit") is None
    assert ev(routing.eight_bit_fallback, "m-4bit") == "m-8bit"


def test_times(spark, ev):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(timecode.clock(F.lit(3661.9))) == "01:01:01"
    assert one(timecode.timecode(F.lit(1.0005))) in ("00:00:01,001", "00:00:01,000")
    assert one(timecode.timecode(F.lit(3599.9999), ".")) == "01:00:00.000"
    assert ev(timecode.parsed, "01:02:03,5") == 3723.5
    assert ev(timecode.parsed, "02:03.25") == 123.25
    assert ev(timecode.parsed, "x:y") is None
    assert ev(timecode.without_cue_markup, "<c>hi</c><00:00:01.000> <b>you</b><br/>x <y>") == "hi you x <y>"
    assert ev(timecode.media_duration, "x Duration: 00:01:02.50, y") == 62.5
