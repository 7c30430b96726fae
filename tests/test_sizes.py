from __future__ import annotations

from pyspark.sql import functions as F

from folioworks.functions import sizes


def test_sizes(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    pair = lambda f, w, h: tuple(one(f(F.lit(w), F.lit(h))))
    assert pair(sizes.padded_size, 10, 20) == (32, 32) and pair(sizes.padded_size, 40, 30) == (40, 30)
    assert pair(sizes.detector_size, 960, 960) == (960, 960)
    assert pair(sizes.detector_size, 1000, 500) == (1920, 960)
    assert pair(sizes.detector_size, 20000, 1000) == (4000, 192)
    assert pair(sizes.tile_grid, 600, 600) == (1, 1) and pair(sizes.tile_grid, 1300, 640) == (2, 1)
    assert one(sizes.image_tokens(F.lit(1), F.lit(1))) == 273
    assert one(sizes.image_tokens(F.lit(4), F.lit(5))) == 273 + 41 * 50
    assert [one(sizes.sound_positions(F.lit(n))) for n in (0, 1, 100, 101, 150)] == [0, 1, 13, 14, 20]
    assert [tuple(b) for b in one(sizes.block_ranges(F.lit(5), 2))] == [(0, 2), (2, 4), (4, 5)]
    arr = lambda *x: F.array(*(F.lit(i) for i in x)) if x else F.array().cast("array<int>")
    rule = lambda *t, n=2, most=0: one(sizes.page_guard(arr(*t), 9, 1, n, most))["rule"]
    assert (rule(), rule(9, 5, 9), rule(9, 9, 9), rule(9, 4, 4, most=2), rule(9, 9, 4, 4, most=2)) == ("ban_end", "none", "force_end", "force_page", "force_end")
