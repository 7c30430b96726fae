"""Sizes that image and sound models ask for, as column expressions, and the guard on generated pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Detector sides, the grid they are rounded to, and the recognizer's height and least width.
LEAST_SIDE, MOST_SIDE, GRID = 960, 4000, 32
LINE_HEIGHT, LINE_WIDTH = 48, 320
#: Page view, tile, patch and the factor that joins patches.
VIEW, CROP, PATCH, JOIN = 1024, 640, 16, 4
#: Frames of a sound chunk and the positions it becomes.
CHUNK_FRAMES, CHUNK_POSITIONS = 100, 13


def padded_size(width: Column, height: Column) -> Column:
    """struct(width, height): tiny images are padded to 32 by 32."""
    tiny = width + height < 64
    grown = lambda c: F.when(tiny, F.greatest(c, F.lit(32))).otherwise(c)
    return F.struct(grown(width).alias("width"), grown(height).alias("height"))


def detector_size(width: Column, height: Column) -> Column:
    """struct(width, height): the shorter side at least LEAST_SIDE, the longer at most MOST_SIDE, both on the grid with
    halves to even."""
    grow = F.greatest(F.lit(LEAST_SIDE) / F.least(width, height), F.lit(1.0))
    w, h = F.floor(width * grow), F.floor(height * grow)
    shrink = F.least(F.lit(float(MOST_SIDE)) / F.greatest(w, h), F.lit(1.0))
    on_grid = lambda c: F.greatest((F.bround(F.floor(c * shrink) / GRID) * GRID).cast("int"), F.lit(GRID))
    return F.struct(on_grid(w).alias("width"), on_grid(h).alias("height"))


def line_width(width: Column, height: Column, batch_ratio: Column) -> Column:
    """struct(resized, padded): a line's width at LINE_HEIGHT and that of its batch."""
    padded = F.floor(F.lit(LINE_HEIGHT) * F.greatest(batch_ratio, F.lit(LINE_WIDTH / LINE_HEIGHT))).cast("int")
    return F.struct(F.least(F.ceil(width / height * LINE_HEIGHT).cast("int"), padded).alias("resized"), padded.alias("padded"))


def tile_grid(width: Column, height: Column, least: int = 2, most: int = 32) -> Column:
    """struct(columns, rows) of the tiles whose shape is nearest to the image's; of equally near ones the largest that the
    image's area half fills. One tile where the image fits it."""
    grids = sorted(((i * j, i, j) for i in range(1, most + 1) for j in range(1, most + 1) if least <= i * j <= most))
    shape = F.lit(1.0) * width / height
    area = F.lit(1.0) * width * height
    options = F.array(*(F.struct(F.abs(shape - i / j).alias("off"), (-F.when(area > 0.5 * CROP * CROP * n, n).otherwise(0)).alias("size"), F.lit(k).alias("k"), F.lit(i).alias("columns"), F.lit(j).alias("rows")) for k, (n, i, j) in enumerate(grids)))
    chosen = F.array_min(options)
    one = F.struct(F.lit(1).alias("columns"), F.lit(1).alias("rows"))
    return F.when((width <= CROP) & (height <= CROP), one).otherwise(F.struct(chosen["columns"].alias("columns"), chosen["rows"].alias("rows")))


def image_tokens(columns: Column, rows: Column) -> Column:
    """Prompt positions of an image: the view's rows with their ends, and the tiles' where there are several."""
    side = lambda px: -(-(px // PATCH) // JOIN)
    q, view = side(CROP), side(VIEW)
    tiles = F.when((columns > 1) | (rows > 1), (F.lit(q) * columns + 1) * (F.lit(q) * rows)).otherwise(0)
    return (F.lit((view + 1) * view + 1) + tiles).cast("int")


def sound_positions(frames: Column) -> Column:
    """Positions of a clip's frames after three halving convolutions, chunk by chunk."""
    half = lambda c: F.floor((c - 1) / 2) + 1
    rest = half(half(half(frames % CHUNK_FRAMES)))
    return (F.greatest(rest, F.lit(0)) + F.floor(frames / CHUNK_FRAMES) * CHUNK_POSITIONS).cast("int")


def block_ranges(total: Column, window: int) -> Column:
    """array of struct(start, end): 0..total in blocks of window, the last one shorter."""
    starts = F.when(total > 0, F.sequence(F.lit(0), total - 1, F.lit(window))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + window, total).alias("end")))


def page_guard(tokens: Column, page_token: int, end_token: int, expected: int, page_tokens: int = 0) -> Column:
    """struct(pages, page_len, rule) after generated tokens: rule is ban_end while pages are missing, force_end when there are
    too many, force_page or force_end when a page is too long, else none."""
    start = F.struct(F.lit(0).alias("pages"), F.lit(0).alias("page_len"))
    state = F.aggregate(tokens, start, lambda a, t: F.when(t == page_token, F.struct((a["pages"] + 1).alias("pages"), F.lit(0).alias("page_len"))).otherwise(F.struct(a["pages"].alias("pages"), (a["page_len"] + 1).alias("page_len"))))
    return F.get(
        F.transform(
            F.array(state),
            lambda a: F.struct(
                a["pages"].alias("pages"),
                a["page_len"].alias("page_len"),
                F.when(a["pages"] > expected, "force_end").when((F.lit(page_tokens) > 0) & (a["page_len"] >= page_tokens), F.when(a["pages"] < expected, "force_page").otherwise("force_end")).when(a["pages"] < expected, "ban_end").otherwise("none").alias("rule"),
            ),
        ),
        F.lit(0),
    )
