"""Languages of texts and caption tracks: script signals, families, and the order in which tracks are tried."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioworks.functions.strings import let, strip

#: Preferred language codes of a family, and codes that are never taken.
ENGLISH = ("en-orig", "en", "en-US", "en-GB", "ai-en")
CHINESE = ("zh-orig", "zh-Hans", "zh-Hant", "zh-CN", "zh", "ai-zh", "zh-TW", "zh-HK")
FORBIDDEN = ("danmaku",)
#: Caption formats in order of preference.
FORMATS = ("json3", "ttml", "vtt", "srv1", "srt")
SAMPLE = 4000


def family(code: Column) -> Column:
    n = F.replace(F.lower(code), F.lit("_"), F.lit("-"))
    return F.when(n.rlike(r"^(en|english)\z|^(ai-)?en-|^ai-en"), "en").when(n.rlike(r"^(zh|chinese)\z|^(ai-)?zh-|^ai-zh"), "zh")


def script_language(*texts: Column) -> Column:
    """zh for texts with ideographs, en for texts with some Latin letters, else null."""
    sample = F.left(F.concat_ws(" ", *(F.nullif(strip(t), F.lit("")) for t in texts)), F.lit(SAMPLE))
    without = lambda c, kind: F.length(F.regexp_replace(c, kind, ""))
    counts = let(sample, lambda c: F.struct(without(c, r"[^\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]++").alias("ideographs"), without(c, "[^A-Za-z]++").alias("latin")))
    return let(counts, lambda c: F.when((c["ideographs"] >= 2) | ((c["ideographs"] == 1) & (c["latin"] < 20)), "zh").when(c["latin"] >= 3, "en"))


def resolved_language(asked: Column, metadata: Column, *texts: Column) -> Column:
    return F.coalesce(F.nullif(asked, F.lit("")), family(strip(metadata)), script_language(*texts))


def is_original(code: Column) -> Column:
    n = F.lower(code)
    return (n == "orig") | n.endswith("-orig") | n.contains("original")


def ranked_languages(codes: Column, asked: Column) -> Column:
    """The codes in the order in which tracks are tried. By default originals come first, then English, Chinese and the
    rest; within a family listed originals, other originals, listed others, others."""
    curated = lambda names: F.array(*(F.lit(n) for n in names))
    originals = F.filter(codes, is_original)

    def of(name: str, names: tuple[str, ...]) -> Column:
        mine = F.filter(codes, lambda c: family(c) == name)
        first, other = F.filter(mine, is_original), F.filter(mine, lambda c: ~is_original(c))
        return F.concat(F.array_intersect(curated(names), first), first, F.array_intersect(curated(names), other), other)

    english, chinese = of("en", ENGLISH), of("zh", CHINESE)
    rest = lambda *taken: F.array_except(codes, F.concat(*taken))
    usual = F.concat(originals, english, chinese, codes)
    zh = F.concat(chinese, originals, english, codes)
    en = F.concat(english, originals, rest(english, originals, chinese), chinese)
    return F.array_distinct(F.when(family(asked) == "zh", zh).when(family(asked) == "en", en).otherwise(usual))


def ranked_formats(formats: Column) -> Column:
    """Known formats in order of preference, without repeats."""
    return F.array_intersect(F.array(*(F.lit(f) for f in FORMATS)), formats)


def candidates(tracks: DataFrame) -> DataFrame:
    """tracks (video_id, lang, is_manual, asked, url) with `rank` of those to try: manual before automatic ones, in the
    order of their languages, a language once. The asked family filters by the translation target, or the language;
    where nothing is left, all allowed tracks stay in listing order (`listed`)."""
    allowed = tracks.where(~F.lower("lang").isin(*FORBIDDEN))
    target = F.coalesce(F.nullif(F.regexp_extract("url", r"[?&]tlang=([^&#]+)", 1), F.lit("")), F.col("lang"))
    fits = family(F.col("asked")).isNull() | family(target).eqNullSafe(family(F.col("asked")))
    whole = Window.partitionBy("video_id")
    order = ranked_languages(F.array_sort(F.collect_list(F.struct("listed", "lang")).over(whole))["lang"], F.max("asked").over(whole))
    seen = allowed.withColumn("_place", F.array_position(order, F.col("lang"))).withColumn("_fits", fits)
    seen = seen.withColumn("_any", F.max(F.col("_fits").cast("int")).over(whole))
    once = Window.partitionBy("video_id", "lang").orderBy(F.desc("is_manual"), "listed")
    kept = seen.where((F.col("_fits")) | (F.col("_any") == 0)).withColumn("_nth", F.row_number().over(once)).where("_nth = 1")
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy(F.when(F.col("_any") == 1, F.when(F.col("is_manual"), 0).otherwise(1)), F.when(F.col("_any") == 1, F.col("_place")), "listed"))
    return kept.withColumn("rank", rank).drop("_place", "_fits", "_any", "_nth")
