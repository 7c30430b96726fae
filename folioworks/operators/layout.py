"""Page layout: anchors of located blocks, page assembly, table fragments and detection lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioworks.functions.routing import page_range_error
from folioworks.functions.strings import SPACE, strip

LEAST_SCORE = 0.5
#: Repeated header rows of a later table fragment that are skipped at most.
HEADER_ROWS = 5
SEGMENTS = "array<struct<text:string,kind:string,page:int,bbox:array<double>>>"


def anchor(page: Column, bbox: Column, kind: Column, mark: str = "loc") -> Column:
    """An HTML comment with a block's page, box (3 decimals) and kind."""
    number = lambda i: F.format_string("%.3f", F.get(bbox, F.lit(i)).cast("double"))
    return F.concat(F.lit(f"<!-- {mark} page="), page.cast("string"), F.lit(" bbox="), F.concat_ws(",", *(number(i) for i in range(4))), F.lit(" kind="), F.regexp_replace(kind, f"[{SPACE}-]", "_"), F.lit(" -->"))


def located_markdown(blocks: Column, mark: str = "loc") -> Column:
    """Blocks (text, kind, page, bbox) as Markdown, each after its anchor; blocks without a place stand bare."""
    shown = F.filter(blocks, lambda b: strip(b["text"]) != "")
    one = lambda b: F.when(b["page"].isNotNull() & b["bbox"].isNotNull(), F.concat(anchor(b["page"], b["bbox"], F.coalesce(b["kind"], F.lit("text")), mark), F.lit("\n"), strip(b["text"]))).otherwise(strip(b["text"]))
    return F.array_join(F.transform(shown, one), "\n\n")


def bounds(quad: Column) -> Column:
    """The axis-parallel box of a quadrilateral's corners."""
    axis = lambda i: F.transform(quad, lambda p: F.get(p, F.lit(i)))
    return F.array(F.array_min(axis(0)), F.array_min(axis(1)), F.array_max(axis(0)), F.array_max(axis(1)))


def grid_box(box: Column, grid: float = 999.0) -> Column:
    """A box on a 0..grid raster as ordered shares of 1."""
    x = lambda i: F.least(F.greatest(F.get(box, F.lit(i)) / grid, F.lit(0.0)), F.lit(1.0))
    return F.array(F.least(x(0), x(2)), F.least(x(1), x(3)), F.greatest(x(0), x(2)), F.greatest(x(1), x(3)))


def pixel_quad(quad: Column, width: Column, height: Column) -> Column:
    """Corners in pixels as shares of the page, held within it."""
    share = lambda v, n: F.least(F.greatest(v / n, F.lit(0.0)), F.lit(1.0))
    return F.transform(quad, lambda p: F.array(share(F.get(p, F.lit(0)), width), share(F.get(p, F.lit(1)), height)))


def rounded_segment(seg: Column) -> Column:
    """A segment's numbers as they go out: 3 decimals for places and seconds, 4 for scores, halves away from zero."""
    r = lambda c, n: F.round(c.cast("double"), n)
    return F.struct(seg["text"].alias("text"), seg["kind"].alias("kind"), seg["page"].alias("page"), F.transform(seg["bbox"], lambda x: r(x, 3)).alias("bbox"), r(seg["start"], 3).alias("start"), r(seg["end"], 3).alias("end"), r(seg["score"], 4).alias("score"))


def kept_lines(lines: DataFrame, score: str = "score", least: float = LEAST_SCORE) -> DataFrame:
    return lines.where(F.col(score) >= least)


def pages_markdown(pages: DataFrame, key: str = "doc_id", page: str = "page_no", text: str = "text") -> DataFrame:
    """key and the pages' texts in order; documents of several pages have a heading per page, blank pages none."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    shown = pages.withColumn("_n", n).withColumn("_t", strip(F.col(text))).where("_t <> ''")
    shown = shown.withColumn("_t", F.when(F.col("_n") > 1, F.concat(F.lit("## Page "), F.col(page).cast("string"), F.lit("\n\n"), F.col("_t"))).otherwise(F.col("_t")))
    return shown.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page, "_t"))), lambda x: x["_t"]), "\n\n").alias("markdown"))


def page_windows(pages: DataFrame, key: str, page: str, size: int) -> DataFrame:
    """pages with `window`: runs of `size` pages of a document."""
    return pages.withColumn("window", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(page)) - 1) / size).cast("int"))


def merged_titles(blocks: DataFrame, key: str = "doc_id", position: str = "pos") -> DataFrame:
    """Neighbouring title blocks of one page and level as one, their texts joined by a blank."""
    order = Window.partitionBy(key).orderBy(position)
    same = (F.col("kind") == "title") & (F.lag("kind").over(order) == "title") & F.col("page").eqNullSafe(F.lag("page").over(order)) & F.col("level").eqNullSafe(F.lag("level").over(order))
    runs = blocks.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "_run").agg(F.min(position).alias(position), F.first("kind").alias("kind"), F.first("page").alias("page"), F.first("level").alias("level"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(position, "text"))), lambda x: x["text"]), " ").alias("text")).drop("_run")


def row_key(row: Column) -> Column:
    """A table row for comparison: its cells' texts, full-width forms folded, without white space, in lower case."""
    cells = F.regexp_extract_all(row, F.lit(r"(?s)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))
    wide, plain = "".join(chr(0xFF01 + i) for i in range(94)), "".join(chr(0x21 + i) for i in range(94))
    return F.array_join(F.transform(cells, lambda c: F.lower(F.translate(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), f"[{SPACE}]+", ""), wide, plain))), "|")


def merged_tables(fragments: Column) -> Column:
    """Table fragments as one table: later ones lose the leading rows that repeat the first one's."""
    rows_of = lambda t: F.regexp_extract_all(t, F.lit(r"(?s)<tr[^>]*>.*?</tr>"), F.lit(0))
    first = rows_of(F.get(fragments, F.lit(0)))
    rest = F.slice(fragments, 2, F.greatest(F.size(fragments) - 1, F.lit(0)))

    def fresh(t: Column) -> Column:
        rows = rows_of(t)
        differs = F.filter(F.sequence(F.lit(0), F.lit(HEADER_ROWS)), lambda i: (i >= HEADER_ROWS) | ~F.coalesce(row_key(F.get(rows, i)) == row_key(F.get(first, i)), F.lit(False)))
        skip = F.get(differs, F.lit(0))
        return F.slice(rows, skip + 1, F.greatest(F.size(rows) - skip, F.lit(0)))

    body = F.concat(first, F.flatten(F.transform(F.filter(rest, lambda t: F.size(rows_of(t)) > 0), fresh)))
    bare = F.filter(rest, lambda t: F.size(rows_of(t)) == 0)
    table = F.concat(F.lit("<table>"), F.array_join(body, ""), F.lit("</table>"))
    return F.when(F.size(first) == 0, F.array_join(fragments, "\n\n")).otherwise(F.array_join(F.concat(F.array(table), bare), "\n\n"))


def detection_blocks(text: Column) -> Column:
    """array of struct(kind, bbox, text) of a detection transcript. A line <|det|>kind [x, y, x, y]<|/det|> opens a block and
    following lines belong to it; image lines open none and close none; lines before any block are a text block."""
    block = "array<struct<kind:string,bbox:array<double>,text:string>>"
    rows = F.split(text, "\n", -1)
    state = F.struct(F.array().cast(block).alias("done"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("array<double>").alias("bbox"), F.lit("").alias("text"))
    form = r"^\s*<\|det\|>\s*([A-Za-z_]+)\s*\[([^\]]*)\]\s*<\|/det\|>(.*)\z"
    closed = lambda a: F.when(strip(a["text"]) != "", F.concat(a["done"], F.array(F.struct(F.coalesce(a["kind"], F.lit("text")).alias("kind"), a["bbox"].alias("bbox"), strip(a["text"]).alias("text"))))).otherwise(a["done"])

    def step(a: Column, line: Column) -> Column:
        kind = F.regexp_extract(line, form, 1)
        box = F.transform(F.split(F.regexp_extract(line, form, 2), ",", -1), lambda x: F.trim(x).try_cast("double"))
        opened = F.struct(closed(a).alias("done"), kind.alias("kind"), F.when(F.size(F.filter(box, lambda x: x.isNotNull())) == 4, grid_box(box)).alias("bbox"), F.regexp_extract(line, form, 3).alias("text"))
        more = F.struct(a["done"].alias("done"), a["kind"].alias("kind"), a["bbox"].alias("bbox"), F.concat(a["text"], F.lit("\n"), line).alias("text"))
        return F.when(kind == "image", a).when(kind != "", opened).otherwise(more)

    return F.aggregate(rows, state, step, closed)


def blocks_markdown(blocks: Column) -> Column:
    """Blocks (kind, text) as Markdown: titles as headings, the rest as they are."""
    one = lambda b: F.when(b["kind"] == "title", F.concat(F.lit("# "), F.regexp_replace(b["text"], r"^#+\s*", ""))).otherwise(b["text"])
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["text"] != ""), one), "\n\n")


def single_root(lines: Column) -> Column:
    """Headings with one root: after the first level-one heading, others go down a level."""
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("seen"))
    root = lambda x: x.rlike(r"^# \S")
    return F.aggregate(lines, state, lambda a, x: F.struct(F.concat(a["out"], F.array(F.when(root(x) & a["seen"], F.concat(F.lit("#"), x)).otherwise(x))).alias("out"), (a["seen"] | root(x)).alias("seen")), lambda a: a["out"])


def insertion_order(tops: list[tuple[float, float]], near: float) -> list[int]:
    """Places by y, then x; each then moves left past neighbours of about its height that begin right of it."""
    order = sorted(range(len(tops)), key=lambda i: (tops[i][1], tops[i][0]))
    for i in range(1, len(order)):
        j = i
        while j and abs(tops[order[j]][1] - tops[order[j - 1]][1]) < near and tops[order[j]][0] < tops[order[j - 1]][0]:
            order[j - 1], order[j] = order[j], order[j - 1]
            j -= 1
    return order


def reading_order(lines: DataFrame, key: str, x: str, y: str, near: float = 10.0) -> DataFrame:
    """lines with `line_no`, from 1: a page's lines from top to bottom, those of about one height from left to right. Each line
    is compared with its neighbours as they stand after earlier moves, a recurrence over one page's lines, so it is a
    vectorized Python function of a page."""

    @F.pandas_udf("array<int>")
    def places(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([insertion_order(list(zip(map(float, a), map(float, b), strict=True)), near) for a, b in zip(xs, ys, strict=True)])

    pages = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(y).alias("_y"), F.col(x).alias("_x"), F.struct(*(c for c in lines.columns if c != key)).alias("_line")))).alias("_lines"))
    ordered = pages.withColumn("_order", places(F.transform("_lines", lambda l: l["_x"]), F.transform("_lines", lambda l: l["_y"])))
    placed = ordered.select(key, F.posexplode(F.transform("_order", lambda i: F.get("_lines", i)["_line"])).alias("_n", "_line"))
    return placed.select(key, "_line.*", (F.col("_n") + 1).alias("line_no"))


def located_page(page: Column, text: Column, blocks: Column, lines: Column) -> Column:
    """struct(markdown, segments) of a recognized page. Blocks carry an anchor each; without blocks the page has one for
    itself and its lines are segments only, or the page is a segment where there are none. blocks and lines: arrays of
    struct(text, kind, page, bbox)."""
    whole = F.array(*(F.lit(v) for v in (0.0, 0.0, 1.0, 1.0)))
    at_page = lambda a: F.transform(F.coalesce(a, F.array().cast(SEGMENTS)), lambda s: F.struct(s["text"].alias("text"), s["kind"].alias("kind"), page.cast("int").alias("page"), s["bbox"].alias("bbox")))
    alone = F.array(F.struct(strip(text).alias("text"), F.lit("page").alias("kind"), page.cast("int").alias("page"), whole.alias("bbox")))
    bare = F.struct(F.concat(anchor(page, whole, F.lit("page")), F.lit("\n"), strip(text)).alias("markdown"), F.when(F.size(at_page(lines)) > 0, at_page(lines)).otherwise(alone).alias("segments"))
    with_blocks = F.struct(located_markdown(at_page(blocks)).alias("markdown"), F.concat(at_page(blocks), at_page(lines)).alias("segments"))
    return F.when(F.size(F.coalesce(blocks, F.array().cast(SEGMENTS))) > 0, with_blocks).otherwise(bare)


def recognized_pages(documents: DataFrame, recognize, size: int, key: str = "doc_id") -> DataFrame:
    """key and Markdown of documents (key, first, last: 0-based pages asked for, n_pages): the range is checked, its pages
    fan out in windows of `size`, recognize (rows of key, window, page to rows of key, page, text) is the back end, and pages
    come together in order. A range that does not fit gives its error."""
    checked = documents.withColumn("error", page_range_error(F.col("first"), F.col("last"), F.col("n_pages")))
    fits = checked.where("error IS NULL").select(key, F.explode(F.sequence("first", "last")).alias("page"), "first")
    pages = fits.select(key, F.floor((F.col("page") - F.col("first")) / size).cast("int").alias("window"), "page")
    done = recognize(pages).withColumn("page_no", F.col("page") + 1)
    return checked.select(key, "error").join(pages_markdown(done, key, "page_no", "text"), key, "left")


def width_batches(items: DataFrame, key: str, ratio: str, size: int = 6) -> DataFrame:
    """items with `batch` (runs of `size` by rising width ratio, equals by key) and the batch's largest ratio."""
    n = F.row_number().over(Window.partitionBy("image_id").orderBy(ratio, key)) - 1
    return items.withColumn("batch", F.floor(n / size).cast("int")).withColumn("batch_ratio", F.max(ratio).over(Window.partitionBy("image_id", "batch")))
