"""The main content of web pages as Markdown, with title and author.

A page becomes a tree; parts that are never content (scripts, navigation, footers, forms) go, and every container is scored by
the text of its paragraphs less their links, half of it passed on to its parent. The best container is rendered."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
DROPPED = {"script", "style", "noscript", "template", "nav", "footer", "aside", "form", "iframe", "svg", "button", "select", "head"}
BOXES = {"div", "section", "article", "main", "body", "td", "header", "table", "ul", "ol", "blockquote"}
LEAVES = {"p", "pre", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "td", "th"}
UNLIKELY = re.compile(r"\b(ads?|advert\w*|banner|breadcrumbs?|comments?|cookie\w*|footer|menu|nav\w*|newsletter|popup|promo|related|share|sharing|sidebar|site-header|social|sponsor\w*|subscribe)\b", re.I)


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)
    parent: Node | None = None

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children if isinstance(c, str) or c.tag not in DROPPED)

    def links(self) -> int:
        return len(self.text()) if self.tag == "a" else sum(c.links() for c in self.children if isinstance(c, Node))

    def walk(self):
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]


class _Tree(HTMLParser):
    """A forgiving tree: unknown ends are skipped, paragraphs and list items close themselves."""

    DEEPEST = 200

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("root")
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li") or re.fullmatch("h[1-6]", tag):
            inner = self.at
            while inner.tag in ("p", "b", "i", "em", "strong", "span", "a") and inner.parent:
                if inner.tag == "p" or inner.tag == tag:
                    self._leave(inner)
                    break
                inner = inner.parent
        if tag == "li" and self.at.tag == "li":
            self._leave(self.at)
        n = Node(tag, {k: v or "" for k, v in attrs}, parent=self.at)
        self.at.children.append(n)
        if tag not in VOID and self.depth < self.DEEPEST:
            self.at, self.depth = n, self.depth + 1

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, parent=self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n.parent and n.tag != tag:
            n = n.parent
        if n.parent:
            self._leave(n)

    def _leave(self, n):
        while self.at is not n:
            self.at, self.depth = self.at.parent, self.depth - 1
        self.at, self.depth = n.parent, self.depth - 1

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str) -> Node:
    t = _Tree()
    t.feed(html)
    t.close()
    return t.root


def _blanks(s: str) -> str:
    return re.sub(r"\s+", " ", s)


def _prune(root: Node) -> None:
    for n in list(root.walk()):
        marks = f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}"
        if n.parent and (n.tag in DROPPED or (n.tag not in ("body", "main", "article", "html") and UNLIKELY.search(marks))):
            n.parent.children = [c for c in n.parent.children if c is not n]


def best(root: Node) -> Node:
    scores: dict[int, tuple[float, Node]] = {}

    def add(n: Node | None, s: float) -> None:
        if n is not None:
            scores[id(n)] = scores.get(id(n), (0.0, n))[0] + s, n

    for n in root.walk():
        if n.tag in ("p", "pre", "blockquote") or (n.tag in BOXES and any(isinstance(c, str) and len(c.strip()) > 40 for c in n.children)):
            size = len(_blanks(n.text()).strip())
            if size < 20:
                continue
            s = 1 + n.text().count(",") + min(size / 100, 5)
            box = n.parent if n.tag in ("p", "pre", "blockquote") else n
            add(box, s)
            add(box.parent if box else None, s / 2)
    if not scores:
        return next((n for n in root.walk() if n.tag == "body"), root)

    def value(pair):
        s, n = pair
        size = max(1, len(n.text()))
        bonus = 1.25 if n.tag in ("article", "main") else 1.0
        return s * (1 - min(1, n.links() / size)) * bonus

    return max(scores.values(), key=value)[1]


def _inline(n) -> str:
    if isinstance(n, str):
        return _blanks(n)
    if n.tag == "br":
        return "\n"
    if n.tag == "img":
        return f"![{n.attrs.get('alt', '')}]({n.attrs['src']})" if n.attrs.get("src") else ""
    body = "".join(map(_inline, n.children))
    mark = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}.get(n.tag)
    if mark and body.strip():
        return f"{mark}{body.strip()}{mark}"
    if n.tag == "a" and n.attrs.get("href") and body.strip():
        return f"[{body.strip()}]({n.attrs['href']})"
    return body


def rendered(n: Node) -> list[str]:
    """Markdown blocks of a node."""
    out, line = [], ""

    def close():
        nonlocal line
        text = "\n".join(x.strip() for x in line.split("\n")).strip()
        if text:
            out.append(text)
        line = ""

    for c in n.children:
        if isinstance(c, str) or c.tag not in BOXES | LEAVES | {"dl", "figure", "tr", "thead", "tbody"}:
            if not isinstance(c, str) and c.tag == "hr":
                close()
                out.append("---")
            elif not isinstance(c, str) and any(isinstance(x, Node) and x.tag in BOXES | LEAVES for x in c.children):
                close()
                out += rendered(c)
            else:
                line += _inline(c)
            continue
        close()
        if re.fullmatch("h[1-6]", c.tag):
            if text := _blanks("".join(map(_inline, c.children))).strip():
                out.append("#" * int(c.tag[1]) + " " + text)
        elif c.tag == "pre":
            out.append("```\n" + c.text().strip("\n") + "\n```")
        elif c.tag in ("ul", "ol"):
            items = [" ".join(rendered(x)) for x in c.children if isinstance(x, Node) and x.tag == "li"]
            if rows := [f"{f'{i}.' if c.tag == 'ol' else '-'} {x}" for i, x in enumerate(filter(None, items), 1)]:
                out.append("\n".join(rows))
        elif c.tag == "blockquote":
            if inner := "\n\n".join(rendered(c)):
                out.append("\n".join(f"> {x}".rstrip() for x in inner.split("\n")))
        elif c.tag == "table":
            rows = [[" ".join(rendered(x)) for x in r.children if isinstance(x, Node) and x.tag in ("td", "th")] for r in c.walk() if r.tag == "tr"]
            rows = [r for r in rows if r]
            if rows:
                out.append("\n".join("| " + " | ".join(r) + " |" + ("\n|" + " --- |" * len(r) if i == 0 else "") for i, r in enumerate(rows)))
        else:
            out += rendered(c)
    close()
    return out


def readable(html: str) -> dict:
    root = tree(html)
    metas = {(n.attrs.get("name") or n.attrs.get("property", "")).lower(): n.attrs.get("content", "") for n in root.walk() if n.tag == "meta"}
    tag = next((_blanks(n.text()).strip() for n in root.walk() if n.tag == "title"), "")
    title = metas.get("og:title") or re.split(r"\s+[|–—-]\s+", tag)[0] or None
    author = metas.get("author") or metas.get("article:author") or next((_blanks(n.text()).strip() for n in root.walk() if "author" in n.attrs.get("class", "").split()), "") or None
    _prune(root)
    return {"markdown": "\n\n".join(rendered(best(root))), "title": title, "author": author}


SHAPE = T.StructType([T.StructField("markdown", T.StringType()), T.StructField("title", T.StringType()), T.StructField("author", T.StringType())])


@F.pandas_udf(SHAPE)
def readable_html(html: pd.Series) -> pd.DataFrame:
    """Markdown, title and author of pages. Scoring walks a tree, so it is a vectorized Python function."""
    return pd.DataFrame([readable(x or "") for x in html], columns=["markdown", "title", "author"])
