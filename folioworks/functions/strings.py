"""Text functions as column expressions. White space is the explicit class SPACE, since the engine's own \\s is ASCII only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character that counts as white space.
SPACE = r"\t\n\x0b\x0c\r\x1c-\x1f\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: SPACE without the line feed.
SPACE_IN_LINE = SPACE.replace(r"\t\n", r"\t", 1)
#: Line ends; CR LF is one.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
#: Ideographs and the blocks written without blanks between words.
CJK = r"\x{3000}-\x{303f}\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}\x{ff00}-\x{ffef}\x{20000}-\x{2fa1f}"


def let(value: Column, body) -> Column:
    """body(value) with value computed once; a plain repetition of an expression inside lambdas is computed each time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+\\z", "")


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", c)


def words(c: Column) -> Column:
    """White-space separated words; an empty array for blank text."""
    s = strip(c)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, f"[{SPACE}]+", -1))


def lines(c: Column) -> Column:
    """Lines by LINE_ENDS; a final line end opens no line."""
    parts = F.split(c, LINE_ENDS, -1)
    return F.when(c == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def collapse(c: Column, by: str = " ") -> Column:
    return F.regexp_replace(c, f"[{SPACE}]+", by)


def quoted(c: Column) -> Column:
    """A string literal of Python for the text: single quotes unless it has some and no double ones."""
    body = F.replace(F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    double = c.contains("'") & ~c.contains('"')
    return F.when(double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))


def thousands(c: Column) -> Column:
    return F.format_number(c.cast("long"), 0)


def percent_decoded(c: Column) -> Column:
    """Percent escapes decoded; a text with a broken escape stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def base64(c: Column) -> Column:
    """Base64 on one line; the engine's own breaks it after 76 characters, unless a setting of the session says otherwise."""
    return F.translate(F.base64(c), "\r\n", "")


def normalized(c: Column) -> Column:
    """Line ends as LF, no blanks at line ends, at most one blank line in a row."""
    unix = F.replace(c, F.lit("\r"), F.lit(""))
    bare = F.regexp_replace(unix, f"[{SPACE_IN_LINE}]+(?=\\n|\\z)", "")
    return F.regexp_replace(bare, r"\n{3,}", "\n\n")


# Titles ----------------------------------------------------------------------------------------------------------


def without_hashes(c: Column) -> Column:
    return F.regexp_replace(c, f"^#+[{SPACE}]*", "")


def without_emphasis(c: Column) -> Column:
    return F.regexp_replace(c, r"\*+([^*]+)\*+", "$1")


def without_links(c: Column) -> Column:
    return F.regexp_replace(c, r"\[([^\]]+)\]\([^)]+\)", "$1")


def without_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"\{[^}]*\}|\([^)]*\)|#\w+", "")


def cleaned_title(c: Column) -> Column:
    c = without_tags(without_links(without_emphasis(without_hashes(c))))
    c = F.regexp_replace(c, "^[\"']+|[\"']+\\z", "")
    return F.regexp_replace(strip(collapse(c)), "[。，、；：！？]+\\z", "")


def title(content: Column, fallback: Column) -> Column:
    """The first level-one heading, else the first underlined line, else the first plain one of five; cleaned."""

    def of(rows: Column) -> Column:
        first = lambda a: F.get(a, F.lit(0))
        heading = F.nullif(strip(F.substr(first(F.filter(rows, lambda x: x.startswith("# "))), F.lit(3))), F.lit(""))
        under = first(F.filter(rows, lambda x, i: F.coalesce(F.get(rows, i + 1).rlike(r"^(=+|-+)\z"), F.lit(False))))
        plain = first(F.filter(F.slice(rows, 1, 5), lambda x: ~x.rlike(r"^([#!\[<{]|:::|---|(?i:http))")))
        return F.coalesce(heading, F.nullif(under, F.lit("")), plain)

    rows = F.filter(F.transform(F.split(strip(content), "\n", -1), strip), lambda x: x != "")
    found = cleaned_title(let(rows, of))
    return F.coalesce(F.nullif(found, F.lit("")), fallback)


def short_title(content: Column, fallback: Column) -> Column:
    """The first level-one heading, else the first plain line of at most 100 characters."""

    def of(rows: Column) -> Column:
        heading = F.get(F.filter(F.transform(F.filter(rows, lambda x: x.startswith("# ")), lambda x: strip(F.substr(x, F.lit(3)))), lambda x: x != ""), F.lit(0))
        plain = F.get(F.filter(rows, lambda x: (x != "") & ~x.startswith("#") & (F.length(x) <= 100)), F.lit(0))
        return F.coalesce(heading, plain)

    return F.coalesce(let(F.transform(F.split(content, "\n", -1), strip), of), fallback)


def file_name(title_: Column, suffix: str, extension: str) -> Column:
    """A file name for a title: forbidden characters and white space as `_`, at most 100 characters."""
    c = collapse(strip(F.translate(title_, '<>:"/\\|?*', "_" * 9)), "_")
    c = F.regexp_replace(F.left(F.regexp_replace(c, r"^[._]+|[._]+\z", ""), F.lit(100)), r"[._]+\z", "")
    return F.concat(F.coalesce(F.nullif(c, F.lit("")), F.lit("output")), F.lit(f"_{suffix}.{extension}"))


def file_stem(name: Column, most_bytes: int = 200) -> Column:
    """Letters, digits, blanks, `-` and `_` of a name, cut to whole characters within most_bytes of UTF-8."""
    kept = F.rtrim(F.regexp_replace(name, r"[^\p{L}\p{N} _-]", ""))
    chars = F.split(kept, "(?!^)")
    fold = F.aggregate(chars, F.struct(F.lit("").alias("s"), F.lit(False).alias("full")), lambda a, x: F.when(a["full"] | (F.octet_length(F.concat(a["s"], x)) > most_bytes), F.struct(a["s"].alias("s"), F.lit(True).alias("full"))).otherwise(F.struct(F.concat(a["s"], x).alias("s"), F.lit(False).alias("full"))), lambda a: a["s"])
    return F.when(F.octet_length(kept) <= most_bytes, kept).otherwise(fold)


# Scoring ---------------------------------------------------------------------------------------------------------


def without_markup(c: Column) -> Column:
    """`<...>` as a blank; an unclosed `<` drops the rest."""
    return F.regexp_replace(c, r"<[^>]*(>|\z)", " ")


def scoring_words(c: Column) -> Column:
    return words(F.regexp_replace(F.lower(without_markup(c)), r"[^\p{L}\p{N}]+", " "))


def scoring_chars(c: Column) -> Column:
    return F.regexp_replace(F.lower(without_markup(c)), r"[^\p{L}\p{N}]+", "")


def without_formulas(c: Column) -> Column:
    """TeX formulas ($$, \\[, \\(, and $ within a line), comments and tags as blanks."""
    c = F.regexp_replace(c, r"(?s)\$\$.*?\$\$|\\\[.*?\\\]|\\\(.*?\\\)|\$[^$\n]+?\$", " ")
    return F.regexp_replace(c, r"(?s)<!--.*?-->|<[^>]+>", " ")


def page_text(c: Column) -> Column:
    """Letters, digits and ideographs of a page outside of formulas and tags, in lower case."""
    return F.lower(F.regexp_replace(without_formulas(c), r"[^0-9A-Za-z\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]+", ""))


def page_tokens(c: Column) -> Column:
    """Runs of letters and digits, and ideographs one by one, of a page outside of formulas and tags, in lower case."""
    return F.regexp_extract_all(F.lower(without_formulas(c)), F.lit(r"[0-9a-z]+|[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]"), F.lit(0))


def is_decimal(c: Column) -> Column:
    """Whether a text is decimal digits of any script alone."""
    return c.rlike(r"^\p{Nd}+\z")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(a, b) / longest)


def asr_text(raw: Column) -> Column:
    """The transcript in a speech model's raw output: after its text mark, or after the assistant's turn mark."""
    tail = lambda mark: F.when(raw.contains(mark), F.substring_index(raw, mark, -1))
    return strip(F.coalesce(tail("<asr_text>"), tail("assistant\n"), raw))


def without_fence(c: Column) -> Column:
    """The body of a text that is one fenced code block."""
    s = strip(c)
    return F.when(s.rlike(r"(?s)^```[^\n]*\n.*```\z"), strip(F.regexp_replace(F.regexp_replace(s, r"^```[^\n]*\n", ""), r"```\z", ""))).otherwise(c)


def pages_of(c: Column) -> Column:
    """The pieces between page marks."""
    return F.split(c, r"(?i)<\s*/?\s*PAGE\s*\d*\s*>", -1)


def language_pattern(langs: Column) -> Column:
    """A regular expression that matches any of the language codes."""
    return F.array_join(F.transform(langs, lambda x: F.regexp_replace(x, r"([.^$*+?{}\[\]\\|()])", r"\\$1")), "|")
