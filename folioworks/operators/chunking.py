"""Chunking of Markdown to a size budget: by headings where a level fits, else by paragraphs; one fold per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.functions.strings import SPACE, let, normalized, strip, title

BUDGET = 40000
#: Fixed value: what stands between combined sections.
SEPARATOR = "\n\n" + "=" * 80 + "\n\n"

_STRINGS = "array<string>"


def _none() -> Column:
    return F.array().cast(_STRINGS)


def sections(content: Column, level: int) -> Column:
    """The text before the first heading of this level (if any) and one section per heading, headings included."""
    parts = F.split(content, rf"\n(?=#{{{level}}}[{SPACE}]+[^\n])", -1)
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def paragraphs(content: Column) -> Column:
    return F.filter(F.transform(F.split(content, f"\n[{SPACE}]*\n", -1), strip), lambda x: x != "")


def _packed(pieces: Column, budget: int, glue: str) -> Column:
    """Neighbouring pieces joined by glue while they fit the budget; a larger piece stays alone."""
    start = F.struct(_none().alias("done"), F.lit("").alias("open"), F.lit(0).alias("size"))

    def step(a: Column, x: Column) -> Column:
        n = F.length(x)
        fits = a["size"] + n + F.when(a["size"] > 0, F.lit(len(glue))).otherwise(F.lit(0)) <= budget
        joined = F.when(a["size"] > 0, F.concat(a["open"], F.lit(glue), x)).otherwise(x)
        return F.when(fits, F.struct(a["done"].alias("done"), joined.alias("open"), F.length(joined).alias("size"))).otherwise(
            F.struct(F.when(a["size"] > 0, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]).alias("done"), x.alias("open"), n.alias("size"))
        )

    return F.aggregate(pieces, start, step, lambda a: F.when(a["size"] > 0, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]))


def wrapped(piece: Column, budget: int) -> Column:
    """A piece beyond the budget cut into pieces of budget characters, stripped."""
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.length(piece) - 1) / budget).cast("int")), lambda i: strip(F.substring(piece, i * F.lit(budget) + F.lit(1), F.lit(budget))))
    return F.when(F.length(piece) > budget, F.filter(cuts, lambda x: x != "")).otherwise(F.array(piece))


def paragraph_chunks(content: Column, budget: int) -> Column:
    """Paragraphs joined by a blank line while they fit; longer ones are cut and stand alone."""
    start = F.struct(_none().alias("done"), F.lit("").alias("open"))

    def closed(a: Column) -> Column:
        return F.when(a["open"] != "", F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"])

    def step(a: Column, x: Column) -> Column:
        long = F.length(x) > budget
        fits = (a["open"] != "") & (F.length(a["open"]) + F.length(x) + 2 <= budget)
        return (
            F.when(long, F.struct(F.concat(closed(a), wrapped(x, budget)).alias("done"), F.lit("").alias("open")))
            .when(fits, F.struct(a["done"].alias("done"), F.concat(a["open"], F.lit("\n\n"), x).alias("open")))
            .otherwise(F.struct(closed(a).alias("done"), x.alias("open")))
        )

    return F.aggregate(paragraphs(content), start, step, closed)


def text_context(content: Column, fallback_title: Column, budget: int = BUDGET) -> Column:
    """struct(title, chunk_list, split_header_level). The smallest heading level that gives several sections, all within
    the budget, splits the text; where none does, paragraphs do. Sections are then packed up to the budget."""

    def level_or(k: int, rest: Column):
        def of_level(found: Column) -> Column:
            fine = (F.size(found) > 1) & (F.array_max(F.transform(found, lambda x: F.length(x))) <= budget)
            return F.when(fine, F.struct(F.lit(k).alias("level"), found.alias("parts"))).otherwise(rest)

        return of_level

    def split(text: Column) -> Column:
        """struct(level, parts) of the first level that works, else of paragraphs; later levels are not looked at."""
        out = F.struct(F.lit(None).cast("int").alias("level"), paragraph_chunks(text, budget).alias("parts"))
        for k in range(6, 0, -1):
            out = let(sections(text, k), level_or(k, out))
        return out

    def of(text: Column) -> Column:
        small = F.length(text) <= budget
        chosen = F.when(~small, split(text))
        return let(
            chosen,
            lambda c: F.struct(
                title(text, fallback_title).alias("title"),
                F.when(text == "", _none()).when(small, F.array(text)).otherwise(_packed(c["parts"], budget, SEPARATOR)).alias("chunk_list"),
                c["level"].cast("tinyint").alias("split_header_level"),
            ),
        )

    return let(content, of)


def chunk_rows(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """doc_id, title, chunk_no, chunk_len and chunk of normalized documents."""
    context = text_context(normalized(F.coalesce("text", F.lit(""))), F.lit("untitled"), budget)
    # The title goes along in each chunk: a column beside the generator would be computed anew for every row it makes.
    chunks = let(context, lambda c: F.transform(c["chunk_list"], lambda x: F.struct(c["title"].alias("title"), x.alias("chunk"))))
    rows = docs.select("doc_id", F.posexplode(chunks).alias("chunk_no", "_c"))
    return rows.select("doc_id", F.col("_c.title").alias("title"), "chunk_no", F.col("_c.chunk").alias("chunk")).withColumn("chunk_len", F.length("chunk"))
