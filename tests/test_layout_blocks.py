"""The layout protocol: documents are rendered from a grammar of own making, and read back."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioworks.operators import layout_blocks as lb

WORDS = st.text(alphabet="abcdefgh", min_size=1, max_size=6)
TEXTS = st.lists(WORDS, min_size=1, max_size=5).map(" ".join)
BOXES = st.none() | st.lists(st.integers(-20, 1100), min_size=4, max_size=6)
SPACES = st.sampled_from(["", " ", "\n", "\t "])
BLOCKS = st.fixed_dictionaries({"label": st.sampled_from([*lb.LABELS, "cross_text", "append_text", "other"]), "level": st.none() | st.integers(0, 6), "box": BOXES, "first": st.booleans(), "text": TEXTS | st.just(""), "gap": SPACES, "upper": st.booleans()})


def rendered(block: dict) -> str:
    """A block in one of the forms that the grammar allows."""
    level = "" if block["level"] is None else f"<LEVEL{block['level']}>"
    box = "" if block["box"] is None else "[" + ("，" if block["upper"] else ", ").join(map(str, block["box"])) + "]"
    attributes = (level, box) if block["first"] else (box, level)
    label = block["label"].upper() if block["upper"] else block["label"]
    return "<BLOCK>" + block["gap"] + label + block["gap"].join(("", *attributes, "")) + "<FORK>" + block["text"] + block["gap"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(BLOCKS, min_size=1, max_size=4), min_size=1, max_size=4), st.booleans())
def test_blocks_are_read_back(pages, fenced):
    raw = "".join("<PAGE>" + "".join(map(rendered, page)) for page in pages)
    got = list(lb.scanned(f"```markdown\n{raw}\n```" if fenced else raw))
    want = [lb.Block(n, b["label"], b["level"], tuple(b["box"][:4]) if b["box"] else None, False, b["text"]) for n, page in enumerate(pages, 1) for b in page]
    assert got == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<PAGE>", "</page 3>", "<BLOCK>", "<FORK>", "<MERGE>", "<LEVEL2>", "<", "<|det|>", "text[1, 2, 3, 4]", "title", "[1, 2", "a b", "\n", "# "]), max_size=20).map("".join))
def test_any_text_is_read(raw):
    """No input fails, page numbers never fall, no mark survives, and no gap is wider than a blank line."""
    blocks = lb.blocks_of(raw)
    assert [b.page for b in blocks] == sorted(b.page for b in blocks)
    assert not [m for m in ("<PAGE>", "<BLOCK>", "<FORK>", "<MERGE>", "<LEVEL2>") if m in lb.without_marks(raw)]
    text = lb.to_markdown(raw)
    assert text == text.lstrip(lb.BLANKS) and "\n\n\n" not in text  # an empty heading keeps its blank


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["cross", "append", "plain", "other"]), WORDS), max_size=10))
def test_chains_of_texts(steps):
    """Texts of an open chain are run together where it opened; all else stands alone. A page per block."""
    label = {"cross": "cross_text", "append": "append_text", "plain": "text", "other": "aside_text"}
    raw = "".join(f"<PAGE><BLOCK>{label[kind]}[1, 2, 3, 4]<FORK>{word}" for kind, word in steps)
    want, chain = [], None
    for kind, word in steps:
        if kind == "append" and chain is not None:
            want[chain] += word
        else:
            want.append(word)
            chain = len(want) - 1 if kind == "cross" else chain
    assert lb.to_markdown(raw) == "\n\n".join(want)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(WORDS, min_size=1, max_size=7), min_size=1, max_size=4))
def test_tables_over_pages(fragments):
    """Later fragments lose the leading rows that they share with the first one, five at most."""
    table = lambda rows: "<table>" + "".join(f"<tr><td>{r}</td></tr>" for r in rows) + "</table>"
    raw = "".join(f"<PAGE><BLOCK>{'append' if n else 'cross'}_table[0, 0, 9, 9]<FORK>{table(rows)}" for n, rows in enumerate(fragments))
    want = list(fragments[0])
    for rows in fragments[1:]:
        same = 0
        while same < min(5, len(rows), len(fragments[0])) and rows[same] == fragments[0][same]:
            same += 1
        want += rows[same:]
    assert lb.to_markdown(raw) == table(want)


def test_a_table_ends_where_another_stands_between():
    part = lambda label, word: f"<PAGE><BLOCK>{label}[0, 0, 9, 9]<FORK><table><tr><td>{word}</td></tr></table>"
    assert lb.to_markdown(part("cross_table", "a") + "<PAGE>loose" + part("append_table", "b")).count("<table>") == 1
    assert lb.to_markdown(part("cross_table", "a") + part("table", "x") + part("append_table", "b")).count("<table>") == 2


@pytest.mark.parametrize("levels", [[1], [1, 1], [2, 2, 3], [1, 2, 2], [3, 1, 1]])
def test_one_root(levels):
    raw = "<PAGE>" + "".join(f"<BLOCK>title<LEVEL{n}>[0, 0, 1, 1]<FORK>w{i}<BLOCK>text[0, 0, 1, 1]<FORK>x" for i, n in enumerate(levels))
    shown = [lb.depth(x) for x in lb.to_markdown(raw).split("\n\n") if lb.depth(x)]
    assert shown == (levels if levels.count(min(levels)) < 2 else [1, *(max(2, n - levels[0] + 2) for n in levels[1:])])


def test_neighbours_with_a_merge_mark_are_one_text():
    block = "<BLOCK>text[0, 0, 1, 1]<FORK>"
    assert lb.to_markdown(f"<PAGE>{block}one <MERGE>{block}two{block}three") == "onetwo\n\nthree"
    assert lb.to_markdown(f"<PAGE>{block}one <PAGE><MERGE>{block}two") == "one\n\ntwo"


def test_pictures_and_what_was_not_read():
    assert lb.to_markdown("<PAGE><PAGE><BLOCK>figure[-1, 5, 2000, 7]<FORK>[Figure]") == "![](page2_0_5_1000_7.jpg)"
    assert lb.to_markdown("<BLOCK>seal<FORK>red seal<BLOCK>text<FORK>[unreadable]") == "red seal"


def test_spans_and_lone_boxes():
    assert lb.polished('<td rowspan="4" colspan="1.0" ROWSPAN="none">') == '<td rowspan="4" colspan="1" ROWSPAN="1">'
    assert lb.polished("a\n [7, 8, 9, 10] \nb <|ref|>c<|/ref|>") == "a\n\nb c"


def test_items(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("<PAGE><BLOCK>text[999, 0, 0, 999]<FORK>x",), (None,)], "raw string")
    got = [r["i"] for r in df.select(lb.items(F.col("raw")).alias("i")).collect()]
    assert got[1] is None and [(i.page, i.kind, i.bbox, i.text) for i in got[0]] == [(1, "text", [0.0, 0.0, 1.0, 1.0], "x")]
