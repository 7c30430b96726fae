"""The tagged layout protocol: pages of blocks with labels, levels and boxes, as Markdown and as located items.

    <PAGE><BLOCK>title<LEVEL2>[x0, y0, x1, y1]<FORK>content ... <MERGE><BLOCK>text[...]<FORK>content

A cursor goes through a document once and hands out blocks. Blocks `cross_X` open a chain that later `append_X` blocks
continue, over pages too; <MERGE> joins neighbours of a page; chains are sets of a union-find structure, each shown where its
first block stands. Chains are a recurrence over the document's blocks, so this is a vectorized Python function of one
document; documents are rows and need no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import takewhile
from typing import NamedTuple

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labels that may stand without a block tag, labels of pictures, contents that mean nothing was read, and
#: commands that stand for other characters.
LABELS = ("text", "title", "header", "footer", "page_number", "image", "figure", "chart", "seal", "table", "image_caption", "image_footnote", "page_footnote", "equation", "ref_text", "aside_text", "algorithm")
PICTURES = ("image", "figure", "picture", "chart", "img", "seal")
UNREAD = ("[non-text]", "[unreadable]", "[image]", "[figure]")
COMMANDS = (("\\coloneqq", ":="), ("\\eqqcolon", "=:"))
#: Leading rows of a later table fragment that are compared with the first one's.
REPEATED_ROWS = 5
#: The raster's largest place, and the largest that a picture's name may hold.
GRID, NAME_GRID = 999, 1000
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

#: The marks: whether one may be closed by `/`, whether it may carry a number, and which characters may end it.
MARKS = {"page": (True, True, (">",)), "block": (True, False, (">",)), "fork": (True, False, (">",)), "merge": (True, False, (">",)), "level": (True, True, (">", "}", ""))}
BARS = "|｜"
ROOT_PREFIXES = ("append_", "cross_")


class Mark(NamedTuple):
    name: str
    slash: bool
    number: str
    end: int


class Block(NamedTuple):
    page: int
    label: str
    level: int | None
    box: tuple[int, ...] | None
    merged: bool
    text: str

    @property
    def kind(self) -> str:
        return next((self.label[len(p) :] for p in ROOT_PREFIXES if self.label.startswith(p)), self.label)

    @property
    def prose(self) -> bool:
        return self.label == "title" or self.kind == "text"


class Cursor:
    """Reads the protocol's elements at a place of a text; each reader returns None where there is no such element."""

    def __init__(self, text: str):
        self.text, self.size = text, len(text)

    def blanks(self, at: int) -> int:
        while at < self.size and self.text[at].isspace():
            at += 1
        return at

    def run(self, at: int, fits) -> int:
        while at < self.size and fits(self.text[at]):
            at += 1
        return at

    def mark(self, at: int) -> Mark | None:
        if not self.text.startswith("<", at):
            return None
        at = self.blanks(at + 1)
        slash = self.text.startswith("/", at)
        start = self.blanks(at + slash)
        name = next((m for m in MARKS if self.text[start : start + len(m)].lower() == m), None)
        if name is None:
            return None
        may_close, may_count, ends = MARKS[name]
        at = self.blanks(start + len(name))
        upto = self.run(at, str.isdecimal) if may_count else at
        number, end = self.text[at:upto], self.blanks(upto)
        closer = self.text[end : end + 1]
        if slash and not may_close:
            return None
        if closer and closer in ends:
            return Mark(name, slash, number, end + 1)
        return Mark(name, slash, number, end) if "" in ends else None

    def token(self, at: int) -> int | None:
        """The end of a token of another protocol: <|name|>, <|/name|> or <image>."""
        if self.text.startswith("<image>", at) or self.text[at : at + 7].lower() == "<image>":
            return at + 7
        if self.text.startswith("<", at) and self.text[at + 1 : at + 2] in tuple(BARS):
            start = at + 2 + self.text.startswith("/", at + 2)
            end = self.run(start, lambda c: c == "_" or (c.isascii() and c.isalpha()))
            if end > start and self.text[end : end + 1] in tuple(BARS) and self.text.startswith(">", end + 1):
                return end + 2
        return None

    def box(self, at: int) -> tuple[tuple[int, ...], int] | None:
        """The first four of four or more whole numbers in brackets."""
        if not self.text.startswith("[", at) or (end := self.text.find("]", at)) < 0:
            return None
        numbers = [x.strip() for x in self.text[at + 1 : end].replace("，", ",").split(",")]
        if len(numbers) < 4 or not all(x.removeprefix("-").isdecimal() for x in numbers):
            return None
        return tuple(int(x) for x in numbers[:4]), end + 1

    def attributes(self, at: int) -> tuple[int | None, tuple[int, ...] | None, int]:
        """A level, a box and a level, each of which may be missing: the first level with a number, the box, and the end."""
        levels, box = [], None
        for part in ("level", "box", "level"):
            here = self.blanks(at)
            if part == "box":
                if found := self.box(here):
                    box, at = found
            elif (m := self.mark(here)) and m.name == "level":
                levels.append(m.number)
                at = m.end
        return next((int(n) for n in levels if n), None), box, at

    def head(self, at: int, free: bool) -> tuple[str, int | None, tuple[int, ...] | None, int] | None:
        """A block's label, level, box and the start of its content; free: it may stand without its tag here."""
        m = self.mark(at)
        tagged = m is not None and m.name == "block" and not m.slash
        if not tagged:
            if not free:
                return None
            if self.text[at : at + 1] == "<" and (end := self.token(at)) and self.text[at + 2 : end - 2].lower() == "det":
                at = end
        start = self.blanks(m.end) if tagged else at
        end = self.run(start, lambda c: c == "_" or (c.isascii() and c.isalpha()))
        label = self.text[start:end].lower()
        if not label:
            return None
        level, box, end = self.attributes(end)
        if not tagged and (box is None or Block(0, label, None, None, False, "").kind not in LABELS):
            return None
        fork = self.mark(self.blanks(end))
        if fork and fork.name == "fork" and not fork.slash:
            return label, level, box, fork.end
        return label, level, box, end

    def places(self, at: int) -> int:
        """The next place after `at` where an element may begin."""
        found = [p for p in (self.text.find("<", at + 1), self.text.find("\n", at)) if p >= 0]
        return min((p if self.text[p] == "<" else p + 1 for p in found), default=self.size)


def without_marks(text: str) -> str:
    cursor, out, at = Cursor(text), [], 0
    while at < len(text):
        end = m.end if (m := cursor.mark(at)) else cursor.token(at)
        if end:
            at = end
            continue
        following = text.find("<", at + 1)
        following = len(text) if following < 0 else following
        out.append(text[at:following])
        at = following
    return "".join(out)


def unfenced(raw: str) -> str:
    body = raw.strip(BLANKS).removeprefix("```markdown").strip(BLANKS)
    return body.removesuffix("```").strip(BLANKS)


def scanned(raw: str) -> Iterator[Block]:
    """The blocks of a document in order; text outside of any block is a block `raw`."""
    text = unfenced(raw)
    cursor, at, begin = Cursor(text), 0, 0
    page, pages = 1, 0
    held: list[str] = []  # of the open block or of the page's loose text
    head, merge, merged, free = None, False, False, True

    def closed(end: int, by_block: bool = False) -> Block | None:
        body = "".join([*held, text[begin:end]])
        if by_block:  # a fork on a line of its own before a block belongs to no text
            bare = body.rstrip()
            if bare[-6:].lower() == "<fork>" and bare[:-6].rstrip(BLANKS.replace("\n", "")).endswith("\n"):
                body = bare[:-6]
        if head:
            return Block(page, head[0], head[1], head[2], merged, body.strip(BLANKS))
        # A page without blocks is text as it stands.
        loose = (without_marks(body) if by_block else body).strip(BLANKS)
        return Block(page, "raw", None, None, False, loose) if loose else None

    while at < len(text):
        m = cursor.mark(at)
        if m and m.name == "page":
            if block := closed(at):
                yield block
            # What comes before the first mark is a page only if it is not blank.
            page += pages > 0 or head is not None or bool(text[:at].strip(BLANKS))
            pages += 1
            head, merge, merged, held, free = None, False, False, [], text[at : m.end].lower() == "<page>"
            at = begin = m.end
        elif found := cursor.head(at, free):
            if block := closed(at, by_block=True):
                yield block
            head, merged, merge, held = found[:3], merge, False, []
            free = text[found[3] - 6 : found[3]].lower() == "<fork>"
            at = begin = found[3]
        elif m and m.name == "merge":
            held.append(text[begin:at])
            merge, at, begin, free = True, m.end, m.end, False
        elif m and m.name == "fork":
            at, free = m.end, text[at : m.end].lower() == "<fork>"
        else:
            at = cursor.places(at)
            free = text[at - 1 : at] == "\n"
    if block := closed(len(text)):
        yield block


def blocks_of(raw: str) -> list[Block]:
    """The blocks; neighbouring titles of one page and one given level are one."""
    out: list[Block] = []
    for b in scanned(raw):
        last = out[-1] if out else None
        if last and b.level is not None and (last.label, last.page, last.level) == (b.label, b.page, b.level) and b.label == "title":
            out[-1] = last._replace(text="\n".join(x for x in (last.text, b.text) if x))
        else:
            out.append(b)
    return out


class Chains:
    """Disjoint sets of numbers, each named by its least one."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def name(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        low, high = sorted((self.name(i), self.name(j)))
        self.up[high] = low

    def sets(self) -> list[list[int]]:
        members: dict[int, list[int]] = {}
        for i in range(len(self.up)):
            members.setdefault(self.name(i), []).append(i)
        return [members[k] for k in sorted(members)]


def grouped(blocks: list[Block]) -> list[list[Block]]:
    """Blocks that are shown as one, each group at its first block. A table's chain ends where a page between has tables."""
    chains = Chains(len(blocks))
    with_tables = {b.page for b in blocks if b.kind == "table"}
    ends: dict[str, int] = {}
    for i, b in enumerate(blocks):
        if i and b.merged and blocks[i - 1].page == b.page and blocks[i - 1].prose and b.prose:
            chains.join(i - 1, i)
        if b.kind not in ("text", "table"):
            continue
        if not b.label.startswith("append_"):
            if b.label.startswith("cross_") or b.kind == "table":
                ends[b.kind] = i
        elif b.kind in ends:
            if b.kind == "table" and any(blocks[ends["table"]].page < p < b.page for p in with_tables):
                del ends["table"]
            else:
                chains.join(ends[b.kind], i)
                ends[b.kind] = i
    return [[blocks[i] for i in group] for group in chains.sets()]


# Markdown --------------------------------------------------------------------------------------------------------

_TABLE_ROW = re.compile(r"<tr\b.*?</tr>", re.I | re.S)


def row_key(row: str) -> tuple[int, str]:
    """A table row for comparison: its number of cells and its text without blanks, full-width forms and case."""
    narrow = {ord("！") + i: ord("!") + i for i in range(94)}
    return len(re.findall(r"<t[hd]\b", row, re.I)), "".join(re.sub("<[^>]+>", " ", row).translate(narrow).split()).lower()


def joined_table(parts: list[str]) -> str:
    """Fragments of a table as one; leading rows of later ones that repeat the first fragment's are left out."""
    rows = [_TABLE_ROW.findall(p) for p in parts]
    if len(parts) == 1 or not rows[0]:
        return "\n\n".join(parts)
    head = [row_key(r) for r in rows[0]]
    body = list(rows[0])
    for own in rows[1:]:
        repeated = takewhile(lambda pair: row_key(pair[0]) == pair[1], zip(own[:REPEATED_ROWS], head, strict=False))
        body += own[len(list(repeated)) :]
    opening = re.search(r"<table\b[^>]*>", parts[0], re.I)
    bare = [p.strip(BLANKS) for p, own in zip(parts[1:], rows[1:], strict=True) if not own]
    return "\n\n".join([f"{opening[0] if opening else '<table>'}{''.join(body)}</table>", *bare])


def depth(item: str) -> int:
    """The number of hashes that a heading opens with; 0 for other items."""
    body = item.lstrip(BLANKS)
    return len(body) - len(body.lstrip("#"))


def one_line(item: str) -> str:
    """A heading on one line, single blanks between its words; other items as they are."""
    n = depth(item)
    return "#" * n + " " + " ".join(re.split(f"[{BLANKS}]+", item.lstrip(BLANKS)[n:].strip(BLANKS))) if n else item


def shown(group: list[Block], pictures: bool) -> list[str]:
    """The Markdown items of a group."""
    head, parts = group[0], [b.text for b in group if b.text and b.text.lower() not in UNREAD]
    if head.kind in PICTURES:
        name = "_".join(str(min(max(v, 0), NAME_GRID)) for v in head.box or ())
        return ([f"![](page{head.page}_{name}.jpg)"] if name and pictures else []) + parts[:1]
    whole = "".join(parts)
    if not parts or head.label == "raw":
        return parts[:1]
    if head.kind == "table":
        return [joined_table(parts)]
    if head.kind == "title":
        if not without_marks(whole).strip(BLANKS):
            return []
        whole = "#" * max(1, 1 if head.level is None else head.level) + " " + whole
    return [one_line(whole)]


def one_root(items: list[str]) -> list[str]:
    """Where several headings share the top level, the first becomes the root and the others go below it."""
    levels = [n for x in items if (n := depth(x))]
    if len(levels) < 2 or levels.count(min(levels)) < 2:
        return items
    out, top = [], None
    for x in items:
        if n := depth(x):
            new, top = (1, n) if top is None else (max(2, n - top + 2), top)
            x = "#" * new + " " + x.lstrip(BLANKS)[n:].lstrip(" ")
        out.append(x)
    return out


def whole_span(m: re.Match) -> str:
    """A colspan or rowspan whose value is no whole number takes the first digits in it, or 1."""
    value = m["value"].strip(BLANKS)
    if value.lstrip("+-").replace("_", "").isdecimal() and len(value) - len(value.lstrip("+-")) < 2 and value[-1] != "_" and "__" not in value:
        return m[0]
    return f'{m["name"]}="{(re.findall("[0-9]+", m["value"]) or ["1"])[0]}"'


def polished(text: str) -> str:
    """Cleanup of a whole text: commands, marks, spans, lines that are a box alone, blanks, one root."""
    for command, sign in COMMANDS:
        text = text.replace(command, sign)
    text = re.sub(r'\b(?P<name>colspan|rowspan)\s*=\s*"(?P<value>[^"]*)"', whole_span, without_marks(text), flags=re.I)
    lines = text.split("\n")
    boxed = lambda x: (found := Cursor(x).box(0)) is not None and found[1] == len(x) and x.count(",") == 3 and "，" not in x
    text = "\n".join("" if boxed(x.strip()) else x.rstrip(" \t") if i + 1 < len(lines) else x for i, x in enumerate(lines))
    return "\n\n".join(one_root(re.sub("\n{3,}", "\n\n", text).strip(BLANKS).split("\n\n")))


def to_markdown(raw: str, pictures: bool = True) -> str:
    return polished("\n\n".join(x for g in grouped(blocks_of(raw)) for x in shown(g, pictures)))


def located(raw: str) -> list[dict]:
    """Items with page, kind, box (shares of the page) and text; picture placeholders are left out."""
    pairs = [(g[0], t) for g in grouped(blocks_of(raw)) for x in shown(g, False) if (t := polished(x))]
    out = []
    for (b, _), text in zip(pairs, one_root([t for _, t in pairs]), strict=True):
        x0, y0, x1, y1 = [min(max(v, 0), GRID) / GRID for v in b.box or (0, 0, 0, 0)]
        place = [min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)] if b.box else None
        out.append({"page": b.page, "kind": "text" if b.label == "raw" else b.label, "bbox": place, "text": text})
    return out


ITEM = T.StructType([T.StructField("page", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("bbox", T.ArrayType(T.DoubleType())), T.StructField("text", T.StringType())])


@F.pandas_udf(T.StringType())
def markdown(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: to_markdown(x) if x is not None else None)


@F.pandas_udf(T.ArrayType(ITEM))
def items(raw: pd.Series) -> pd.Series:
    return pd.Series([located(x) if x is not None else None for x in raw])
