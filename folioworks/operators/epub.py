"""Books of chapters: reading order from the package file, and cleanup of converted Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioworks.functions.strings import SPACE, lines, strip


def manifest(packages: DataFrame, key: str = "book_id", xml: str = "opf") -> DataFrame:
    """key, id and href of the items of package files, whatever the order of an item's attributes."""
    items = packages.select(key, F.explode(F.regexp_extract_all(F.col(xml), F.lit(r"<item\s[^>]*>"), F.lit(0))).alias("_t"))
    attr = lambda n: F.regexp_extract("_t", rf'\s{n}="([^"]*)"', 1)
    return items.select(key, attr("id").alias("id"), F.coalesce(F.try_url_decode(F.replace(attr("href"), F.lit("+"), F.lit("%2B"))), attr("href")).alias("href")).where("id <> '' AND href <> ''")


def spine(packages: DataFrame, key: str = "book_id", xml: str = "opf") -> DataFrame:
    """key, pos and id of the reading order."""
    refs = packages.select(key, F.posexplode(F.regexp_extract_all(F.col(xml), F.lit(r'<itemref\s[^>]*?idref="([^"]*)"'), F.lit(1))).alias("pos", "id"))
    return refs


def chapters(packages: DataFrame, key: str = "book_id", xml: str = "opf") -> DataFrame:
    """key, pos and href of the chapters in reading order; references without an item are left out."""
    return spine(packages, key, xml).join(manifest(packages, key, xml), [key, "id"]).select(key, "pos", "href")


def folder_chapters(files: DataFrame, key: str = "book_id", path: str = "path") -> DataFrame:
    """key, pos and href of books without a reading order: the HTML files below the first folder named OEBPS or OPS (of all
    folders where there is none), in order of their paths."""
    folder = F.regexp_extract(path, r"^((?:.*?/)?(?:OEBPS|OPS)/)", 1)
    roots = files.groupBy(key).agg(F.min(F.nullif(folder, F.lit(""))).alias("_root"))
    html = files.join(roots, key).where(F.lower(F.col(path)).rlike(r"\.x?html?\z") & (F.col("_root").isNull() | F.col(path).startswith(F.col("_root"))))
    return html.select(key, (F.row_number().over(Window.partitionBy(key).orderBy(path)) - 1).alias("pos"), F.col(path).alias("href"))


def failed_chapters(parts: DataFrame, key: str = "book_id", pos: str = "pos", text: str = "markdown") -> DataFrame:
    """key, pos and a warning for each chapter that could not be converted (null text)."""
    return parts.where(F.col(text).isNull()).select(key, pos, F.concat(F.lit("chapter "), (F.col(pos) + 1).cast("string"), F.lit(" could not be converted")).alias("warning"))


def assembled(parts: DataFrame, key: str = "book_id", pos: str = "pos", text: str = "markdown") -> DataFrame:
    """key and the chapters' Markdown in order between rules; chapters that failed (null) or are blank are left out."""
    shown = parts.where(F.col(text).isNotNull() & (strip(F.col(text)) != ""))
    return shown.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), strip(F.col(text)).alias("t")))), lambda x: x["t"]), "\n\n---\n\n").alias("markdown"))


def without_spans(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\[\]\{[^}]*\}", ""), r'<span[^>]*>\s*</span>', "")


def local_images(c: Column) -> Column:
    """Image references as ![alt](images/name); a missing alternative text is Image."""
    c = F.regexp_replace(c, r'<img[^>]*?src="(?:[^"]*/)?([^"/]+)"[^>]*?alt="([^"]*)"[^>]*>', "![$2](images/$1)")
    c = F.regexp_replace(c, r'<img[^>]*?src="(?:[^"]*/)?([^"/]+)"[^>]*>', "![](images/$1)")
    c = F.regexp_replace(c, r"!\[([^\]]*)\]\((?:[^()\s]*/)?([^()/\s]+)(?:\s+\"[^\"]*\")?\)(\{[^}]*\})?", "![$1](images/$2)")
    return F.replace(c, F.lit("![]("), F.lit("![Image]("))


def footnotes(c: Column) -> Column:
    """Numbered links to notes as [^n]."""
    return F.regexp_replace(c, r"\[\\?\[?(\d+)\\?\]?\]\(#[^)]*\)", "[^$1]")


def flattened_contents(c: Column) -> Column:
    """Runs of lines that are links to the book's files as one heading `## a: b`, a blank line after it."""
    marked = F.regexp_replace(c, r"(?i)\[([^\]]+)\]\([^)]*(?:\.html|\.xhtml)[^)]*\)", "\u0001 $1")
    marked = F.regexp_replace(F.regexp_replace(marked, rf"[{SPACE}]*\u0001[{SPACE}]*", "\n\u0001 "), r"\n{3,}", "\n\n")
    runs = F.regexp_replace(marked, "(\u0001 [^\n]*)\n(?=\u0001 )", "$1\u0002")

    def shown(line: Column) -> Column:
        titles = F.filter(F.transform(F.split(line, "\u0002", -1), lambda t: strip(F.replace(t, F.lit("\u0001"), F.lit("")))), lambda t: t != "")
        heading = F.when(F.size(titles) > 0, F.array(F.concat(F.lit("## "), F.array_join(titles, ": ")), F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.when(line.startswith("\u0001 "), heading).otherwise(F.array(line))

    return F.when(c.rlike(r"(?i)\]\([^)]*\.x?html"), F.array_join(F.flatten(F.transform(lines(runs), shown)), "\n")).otherwise(c)


def without_html(c: Column) -> Column:
    """Links within the page as their texts; span tags gone."""
    return F.regexp_replace(F.regexp_replace(c, r"\[([^\]]*)\]\(#[^)]*\)", "$1"), r"</?span[^>]*>", "")


def one_heading(c: Column) -> Column:
    """The same heading twice in a row once."""
    return F.regexp_replace(c, r"(?m)^(#{1,6}[ \t]+[^\n]+)$(?:\n+\1$)+", "$1")


def normal_headings(c: Column) -> Column:
    """One blank after a heading's hashes, none at its end; nested hashes add up, to six at most."""
    for _ in range(5):
        c = F.regexp_replace(c, r"(?m)^(#{1,5})[ \t]+(#{1,5})(?=[ \t])", "$1$2")
    c = F.regexp_replace(c, r"(?m)^(#{6})#+", "$1")
    return F.regexp_replace(c, r"(?m)^(#{1,6})[ \t]+(.*?)[ \t#]*$", "$1 $2")


def demoted(c: Column) -> Column:
    """Level-two headings to level three, level-one ones to level two."""
    return F.regexp_replace(F.regexp_replace(c, r"(?m)^## ", "### "), r"(?m)^# ", "## ")


def labelled_headings(c: Column) -> Column:
    """A label heading (`Chapter 1`, a number) and the heading after it as one."""
    return F.regexp_replace(c, r"(?m)^(#{1,6}) ((?i:chapter|part|section|book)\s+[\p{L}\p{N}]+|[0-9]{1,3}|[IVXLC]{1,6})\n+#{1,6} ([^\n]+)$", "$1 $2: $3")


def spaced_headings(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?m)(?<=[^\n])\n(#{1,6} )", "\n\n$1")
    return F.regexp_replace(c, r"(?m)^(#{1,6} [^\n]*)\n(?=[^\n])", "$1\n\n")


def cleaned(c: Column) -> Column:
    """All cleanup steps in their order, at most one blank line in a row."""
    for step in (without_spans, local_images, footnotes, without_html, flattened_contents, normal_headings, one_heading, labelled_headings, demoted, spaced_headings):
        c = step(c)
    return strip(F.regexp_replace(F.regexp_replace(c, r"(?m)[ \t]+$", ""), r"\n{3,}", "\n\n"))
