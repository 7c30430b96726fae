from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from folioworks.functions import arrays
from folioworks.operators import alignment, captions, chunking, epub, languages, layout, repetition, scoring, sentences


def test_chunks_by_heading_and_paragraph(ev):
    text = "intro\n\n## a\n" + "x" * 60 + "\n\n## b\n" + "y" * 60
    c = ev(lambda t: chunking.text_context(t, F.lit("f"), 80), text)
    assert c.split_header_level == 2 and [len(x) for x in c.chunk_list] == [5, 65, 65]
    c = ev(lambda t: chunking.text_context(t, F.lit("f"), 10), "aaaa\n\nbbbb\n\n" + "c" * 25)
    assert c.split_header_level is None and c.chunk_list == ["aaaa\n\nbbbb", "c" * 10, "c" * 10, "c" * 5]
    assert ev(lambda t: chunking.text_context(t, F.lit("f"), 10), "").chunk_list == []
    assert ev(lambda t: chunking.text_context(t, F.lit("f"), 10), "short").chunk_list == ["short"]


def test_sentences(ev):
    assert ev(sentences.sentences, 'It is 3.5 m. "Yes!" he said. 你好。再见！ end') == ["It is 3.5 m.", '"Yes!"', "he said.", "你好。", "再见！", "end"]
    assert ev(lambda c: F.size(sentences.sentences(c)), "a.b " * 30000 + "!") == 1  # no stack is needed for a long body
    assert ev(sentences.sentences, "") == []


def test_paragraphs_after_pauses(spark):
    seg = F.array(*(F.struct(F.lit(t).alias("text"), F.lit(a).alias("start"), F.lit(b).alias("end")) for t, a, b in (("a", 0.0, 1.0), ("b", 2.5, 3.0), ("c", 5.0, 6.0), (" ", 7.0, 8.0), ("你", 7.9, 8.0))))
    got = spark.range(1).select(sentences.gap_paragraphs(seg)).first()[0]
    assert [(p.text, p.start, p.end) for p in got] == [("a b", 0.0, 3.0), ("c你", 5.0, 8.0)]


@pytest.mark.parametrize(("text", "want"), [("aaaaaaaa", True), ("aaaaaaa", False), ("abcabcabcabc", True), ("a b a b a b a b", True), ("one two one two one two one two", True), ("go go go go go go now", True), ("go go go go go", False), ("", False), ("plain words only here now", False)])
def test_loops(ev, text, want):
    assert ev(repetition.has_loop, text) is want


def test_tokens(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    arr = lambda *x: F.array(*(F.lit(i) for i in x))
    assert one(repetition.ctc_collapsed(arr(0, 1, 1, 0, 1, 2, 2))) == [1, 1, 2]
    assert one(repetition.banned_tokens(arr(1, 2, 3, 1, 2, 4, 1, 2), 3, 8)) == [3, 4]
    assert one(repetition.banned_tokens(arr(1, 2), 3, 8)) == []


def test_captions_round_trip(spark, ev):
    rows = spark.createDataFrame([(1, 0.0, 1.5, "hello"), (1, 2.0, 3.0, "<b>you</b> there")], "k int, s double, e double, t string")
    srt = captions.rendered(rows, "k", "s", "e", "t").first()["srt"]
    assert srt.startswith("1\n00:00:00,000 --> 00:00:01,500\nhello\n\n2\n")
    assert [(c.start, c.end, c.text) for c in ev(captions.read_cues, srt)] == [(0.0, 1.5, "hello"), (2.0, 3.0, "you there")]
    vtt = captions.rendered(rows, "k", "s", "e", "t", "vtt").first()["vtt"]
    assert len(ev(captions.read_cues, vtt)) == 2
    rolling = "1\n00:00:00,000 --> 00:00:01,000\na b\n\n2\n00:00:01,000 --> 00:00:02,000\na b\nc\n"
    assert [c.text for c in ev(captions.read_cues, rolling)] == ["a b", "c"]


def test_rolling_and_lines(spark, ev):
    assert captions.rolled(["a b c", "b c d", "d e"]) == ["a", "b", "c", "d", "e"]
    tokens = F.array(*(F.lit(x) for x in "Hello Mr. Fox. >>Who is it? It is me.".split()))
    assert spark.range(1).select(captions.linear_transcript(tokens)).first()[0] == "Hello Mr. Fox.\n>> Who is it?\nIt is me."
    assert ev(captions.plain_transcript, "no captions here") == "no captions here"
    assert [c.text for c in ev(captions.json3_cues, '{"events":[{"tStartMs":0,"dDurationMs":5,"segs":[{"utf8":"a"},{"utf8":" b"}]},{"tStartMs":9}]}')] == ["a b"]
    assert [(c.start_ms, c.end_ms, c.text) for c in ev(captions.xml_cues, '<transcript><text start="1.5" dur="2">a &amp; b</text></transcript>')] == [(1500, 3500, "a & b")]
    assert ev(captions.payload_kind, "WEBVTT\n\n") == "vtt"


def test_cue_cutting():
    long = "one two three, " * 12
    cues = captions._cut(long.strip(), 0.0, 12.0)
    assert all(len(t) <= captions.LINE_CHARS for _, _, t in cues) and cues[0][0] == 0.0 and abs(cues[-1][1] - 12.0) < 1e-9
    assert captions._cut("short", 1.0, 1.1) == [(1.0, 1.5, "short")]


def test_repair_of_times():
    assert alignment.repair([0, 10, 5, 20]) == [0, 10, 10, 20] or alignment.repair([0, 10, 5, 20]) == [0, 0, 5, 20]
    assert alignment.repair([]) == []
    rng = random.Random(3)
    for _ in range(200):
        v = [float(rng.randint(0, 30)) for _ in range(rng.randint(1, 9))]
        rising = alignment.longest_rising(v)
        best = [1] * len(v)
        for i in range(len(v)):
            best[i] = 1 + max((best[j] for j in range(i) if v[j] <= v[i]), default=0)
        assert len(rising) == max(best) and all(v[a] <= v[b] for a, b in zip(rising, rising[1:], strict=False))
        fixed = alignment.repair(v)
        assert all(a <= b for a, b in zip(fixed, fixed[1:], strict=False))


def test_sentence_times():
    got = alignment.sentence_times(["Hello you.", "...", "Bye"], [{"text": "hello", "start": 0.5, "end": 1.0}, {"text": "zzz", "start": 1.0, "end": 1.1}, {"text": "You", "start": 1.2, "end": 1.6}, {"text": "bye", "start": 2.0, "end": 2.5}])
    assert [(x["start"], x["end"]) for x in got] == [(0.5, 1.6), (1.6, 1.6), (2.0, 2.5)]


def test_languages(ev, spark):
    assert ev(languages.script_language, "你好 world") == "zh"
    assert ev(languages.script_language, "abc") == "en"
    assert ev(languages.script_language, "12") is None
    assert ev(languages.family, "ai-zh") is None or ev(languages.family, "ai-zh") == "zh"
    assert ev(lambda c: languages.ranked_formats(F.split(c, ",")), "srt,json3,xyz,vtt") == ["json3", "vtt", "srt"]
    rows = [(1, 0, "fr", True, None, ""), (1, 1, "en", False, None, ""), (1, 2, "danmaku", True, None, ""), (1, 3, "en", True, None, "")]
    got = languages.candidates(spark.createDataFrame(rows, "video_id int, listed int, lang string, is_manual boolean, asked string, url string")).orderBy("rank").collect()
    assert [(r.lang, r.is_manual) for r in got] == [("en", True), ("fr", True)]


def test_layout(spark, ev):
    box = F.array(F.lit(0.1), F.lit(0.25), F.lit(0.5), F.lit(1.0))
    assert spark.range(1).select(layout.anchor(F.lit(2), box, F.lit("page-head er"))).first()[0] == "<!-- loc page=2 bbox=0.100,0.250,0.500,1.000 kind=page_head_er -->"
    t = lambda *rows: "<table>" + "".join(f"<tr><td>{r}</td></tr>" for r in rows) + "</table>"
    merged = spark.createDataFrame([([t("H", "1"), t("Ｈ ", "2"), "note"],)], "f array<string>").select(layout.merged_tables(F.col("f"))).first()[0]
    assert merged == t("H", "1", "2") + "\n\nnote"
    blocks = ev(layout.detection_blocks, "lead\n<|det|>title [0, 0, 999, 500]<|/det|>Head\n<|det|>image [1, 1, 2, 2]<|/det|>\nmore\n<|det|>text [0, 0, 9, 9]<|/det|>Body")
    assert [(b.kind, b.text) for b in blocks] == [("text", "lead"), ("title", "Head\nmore"), ("text", "Body")]
    pages = spark.createDataFrame([(1, 1, "a"), (1, 2, " "), (2, 1, "b")], "doc_id int, page_no int, text string")
    assert {r.doc_id: r.markdown for r in layout.pages_markdown(pages).collect()} == {1: "## Page 1\n\na", 2: "b"}


def test_book_cleanup(ev):
    assert ev(epub.normal_headings, "## # Tight  ##\n#NoBlank") == "### Tight\n#NoBlank"
    assert ev(epub.labelled_headings, "# 1\n\n## The End") == "# 1: The End"
    assert ev(epub.local_images, '<img src="a/b.png" alt="x"/> ![](c/d.jpg)') == "![x](images/b.png) ![Image](images/d.jpg)"
    assert ev(epub.one_heading, "# A\n\n# A\ntext") == "# A\ntext"
    assert ev(epub.demoted, "# A\n## B") == "## A\n### B"
    assert ev(epub.footnotes, "x[\\[1\\]](#n1)") == "x[^1]"


def test_scores(spark):
    pairs = spark.createDataFrame([("en", "The cat sat.", "the cat sits"), ("en", "", "x")], "lang string, r string, h string")
    row = scoring.error_rates(pairs, "lang", "r", "h").first()
    assert (row.edits, row.units) == (2, 3)
    assert scoring.error_rates(pairs, "lang", "r", "h", by_chars=True).first().edits == 3


def test_arrays(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, 0.0],)], "v array<double>")
    one = lambda c: df.select(c).first()[0]
    v = F.col("v")
    assert abs(sum(one(arrays.softmax(v))) - 1) < 1e-12
    assert one(arrays.argmax(v)) == 1
    assert one(arrays.argsort(v)) == [3, 0, 1, 2]
    assert [x["index"] for x in one(arrays.top_k(v, 2))] == [1, 2]
    assert one(arrays.transpose(arrays.reshape(v, 2))) == [[1.0, 3.0], [3.0, 0.0]]
    assert one(arrays.put(v, F.array(F.lit(0)), F.array(F.lit(9.0)))) == [9.0, 3.0, 3.0, 0.0]
    assert max(abs(a - b) for a, b in zip(one(arrays.affine_restored(arrays.affine_quantized(v, 4, 2))), [1, 3, 3, 0], strict=True)) < 0.1
    assert one(arrays.unpacked(F.array(F.lit(0x87654321)), 4)) == [1, 2, 3, 4, 5, 6, 7, 8]
    assert abs(one(arrays.erf(F.lit(0.5))) - 0.5204998778) < 2e-7
    assert abs(sum(x * x for x in one(arrays.rms_norm(v))) / 4 - 1) < 1e-5
