"""Plans over back ends, orders and books' leftovers."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioworks.operators import epub, layout, transcripts


def test_sound_is_transcribed_by_segments(spark):
    media = spark.createDataFrame([(1, 1450.0), (2, 10.0), (3, 600.0)], "id int, duration double")
    seen = []

    def transcribe(parts):
        seen.extend((r.id, r.no, r.start, r.end) for r in parts.collect())
        return parts.select("id", "no", F.when(F.col("no") == 1, "  ").otherwise(F.concat(F.lit(" part "), F.col("no").cast("string"))).alias("text"))

    got = {r.id: r.transcript for r in transcripts.transcribed(media, transcribe).collect()}
    assert got == {1: "part 0 part 2", 2: "part 0", 3: "part 0"}
    assert sorted(seen) == [(1, 0, 0.0, 600.0), (1, 1, 600.0, 1200.0), (1, 2, 1200.0, 1450.0), (2, 0, 0.0, 10.0), (3, 0, 0.0, 600.0)]
    aligned = transcripts.transcribed(media, lambda p: p.select("id", "no", F.lit("x").alias("text")), aligned=True)
    assert {r.id: r.transcript for r in aligned.collect()}[3] == "x x x"


def test_pages_are_recognized_in_windows(spark):
    docs = spark.createDataFrame([(1, 2, 6, 10), (2, 0, 3, 3), (3, 0, 0, 1)], "doc_id int, first int, last int, n_pages int")
    windows = []

    def recognize(pages):
        windows.extend((r.doc_id, r.window, r.page) for r in pages.collect())
        return pages.select("doc_id", "page", F.concat(F.lit("p"), F.col("page").cast("string")).alias("text"))

    got = {r.doc_id: (r.error, r.markdown) for r in layout.recognized_pages(docs, recognize, 2).collect()}
    assert got[1] == (None, "\n\n".join(f"## Page {n + 1}\n\np{n}" for n in range(2, 7)))
    assert got[2] == ("the last page is beyond the document", None) and got[3] == (None, "p0")
    assert sorted(w for w in windows if w[0] == 1) == [(1, 0, 2), (1, 0, 3), (1, 1, 4), (1, 1, 5), (1, 2, 6)]


def test_reading_order_moves_lines_past_neighbours_only(spark):
    # Heights 0, 9 and 18: the last line is near the second alone, which stands before it only while the first is left of it.
    rows = [(1, "first", 5.0, 0.0), (1, "second", 6.0, 9.0), (1, "third", 1.0, 18.0), (2, "b", 9.0, 1.0), (2, "a", 1.0, 4.0), (2, "c", 0.0, 40.0)]
    df = spark.createDataFrame(rows, "page int, name string, x double, y double").repartition(3)
    got = {}
    for r in layout.reading_order(df, "page", "x", "y").orderBy("page", "line_no").collect():
        got.setdefault(r.page, []).append(r.name)
    assert got == {1: ["first", "third", "second"], 2: ["a", "b", "c"]}
    assert layout.reading_order(df.limit(0), "page", "x", "y").count() == 0
    assert layout.insertion_order([(3.0, 0.0), (2.0, 0.0), (1.0, 0.0)], 10.0) == [2, 1, 0]


def test_failed_chapters_are_left_out_and_told(spark):
    parts = spark.createDataFrame([(1, 0, "one"), (1, 1, None), (1, 2, " three ")], "book_id int, pos int, markdown string")
    assert epub.assembled(parts).first().markdown == "one\n\n---\n\nthree"
    assert [(r.pos, r.warning) for r in epub.failed_chapters(parts).collect()] == [(1, "chapter 2 could not be converted")]


def test_contents_pages_become_a_heading(ev):
    assert ev(epub.flattened_contents, "[A](a.html)\n\n[B](b.xhtml#c) more\nrest") == "\n## A: B more\n\nrest"
    assert ev(epub.flattened_contents, "plain\n") == "plain\n" and ev(epub.flattened_contents, None) is None
