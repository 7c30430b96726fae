"""Plans of attempts as rows: cookie sources, download formats, names of spoken languages, models and files of a snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioworks.functions.routing import first_given, precision
from folioworks.functions.strings import strip

#: Browsers whose cookies are tried by themselves, in order.
BROWSERS = ("chrome:default", "chromium", "brave", "edge", "vivaldi", "opera", "firefox", "safari", "whale")
#: Platforms that answer signed-in users only.
SIGNED_IN = ("bilibili", "xiaohongshu")
#: Stream selectors per platform, with the sound format to extract, in order.
STREAMS = {
    "bilibili": (("bestaudio", None), ("bestaudio[ext=m4a]", "m4a"), ("best[acodec!=none]", "m4a"), ("best", "m4a")),
    "xiaoyuzhoufm": (("best", None), ("bestaudio", None)),
    "": (("bestaudio[acodec^=opus][abr<=128]/bestaudio[abr<=128]/bestaudio", None), ("bestaudio[ext=m4a]/bestaudio", "m4a"), ("best[acodec!=none]", "m4a"), ("best", "m4a")),
}
#: Codes and names of the languages that speech models know.
SPOKEN = {
    "zh": "Chinese", "en": "English", "ja": "Japanese", "ko": "Korean", "de": "German", "es": "Spanish", "fr": "French",
    "it": "Italian", "pt": "Portuguese", "ru": "Russian", "ar": "Arabic", "hi": "Hindi", "th": "Thai", "vi": "Vietnamese",
    "id": "Indonesian", "tr": "Turkish", "nl": "Dutch", "pl": "Polish", "sv": "Swedish", "da": "Danish", "fi": "Finnish",
    "ms": "Malay", "yue": "Cantonese", "cs": "Czech", "fil": "Filipino", "fa": "Persian", "el": "Greek", "hu": "Hungarian",
    "mk": "Macedonian", "ro": "Romanian",
}


def cookie_plan(requests: DataFrame) -> DataFrame:
    """requests (id, platform, cookies_file, browser) as attempts: the file asked for, the browser asked for, else all known
    browsers; last no cookies, unless the platform needs a signed-in user."""
    file_, browser = first_given(F.col("cookies_file")), first_given(F.col("browser"))
    one = lambda kind, value: F.struct(F.lit(kind).alias("source"), value.alias("value"))
    tried = F.when(file_.isNull() & browser.isNull(), F.array(*(one("browser", F.lit(b)) for b in BROWSERS))).otherwise(F.filter(F.array(one("file", file_), one("browser", browser)), lambda x: x["value"].isNotNull()))
    bare = F.when(F.col("platform").isin(*SIGNED_IN), F.slice(tried, 1, 0)).otherwise(F.array(one("none", F.lit(None).cast("string"))))
    return requests.select("id", F.posexplode(F.concat(tried, bare)).alias("attempt", "s")).select("id", "attempt", "s.source", "s.value")


def stream_plan(requests: DataFrame) -> DataFrame:
    """requests (id, platform) as attempts with selector and codec; the plans are a dozen rows and broadcast."""
    rows = [(p, i, s, c) for p, plan in STREAMS.items() for i, (s, c) in enumerate(plan)]
    plans = requests.sparkSession.createDataFrame(rows, "plan string, attempt int, selector string, codec string")
    key = F.when(F.col("platform").isin(*(p for p in STREAMS if p)), F.col("platform")).otherwise("")
    return requests.withColumn("plan", key).join(F.broadcast(plans), "plan").select("id", "attempt", "selector", "codec")


def spoken_language(c: Column) -> Column:
    """The model's name of a language given by code or name; null of an unknown one."""
    names = F.create_map(*(F.lit(x) for code, name in SPOKEN.items() for x in (code, name)), *(F.lit(x) for name in SPOKEN.values() for x in (name.lower(), name)))
    return F.try_element_at(names, F.lower(F.trim(c)))


def speech_model(alias: Column, wanted: Column) -> Column:
    """struct(model, error) of an alias (`size` or `...-size`) and a precision; a full id keeps its own precision."""
    name, p = F.lower(strip(F.coalesce(alias, F.lit("")))), precision(wanted)
    own = precision(F.regexp_extract(name, r"-([0-9a-z]+)\z", 1))
    size = F.when(name == "", "1.7B").otherwise(F.upper(F.regexp_extract(name, r"(0\.6b|1\.7b)", 1)))
    clash = own.isNotNull() & p.isNotNull() & (own != p)
    error = F.when(wanted.isNotNull() & (strip(wanted) != "") & p.isNull(), "unknown precision").when(size == "", "unknown model").when(clash, "precision conflicts with the model's own")
    return F.struct(F.when(error.isNull(), F.concat(F.lit("speech-"), size, F.lit("-"), F.coalesce(p, own, F.lit("4bit")))).alias("model"), error.alias("error"))


def complete_snapshots(needed: DataFrame, files: DataFrame) -> DataFrame:
    """snapshot and `complete`: whether all needed files (snapshot, name) are among its files (snapshot, name)."""
    missing = needed.join(files.withColumn("_here", F.lit(True)), ["snapshot", "name"], "left")
    return missing.groupBy("snapshot").agg((F.count_if(F.col("_here").isNull()) == 0).alias("complete"))


def downloaded_file(files: DataFrame, key: str = "id") -> DataFrame:
    """Of each request's files (name, stem) the download: the asked-for stem first, else audio_*, by name; no partial ones."""
    fits = F.when(F.col("name").startswith(F.concat(F.col("stem"), F.lit("."))), 0).when(F.col("name").startswith("audio_"), 1)
    kept = files.withColumn("_p", fits).where(F.col("_p").isNotNull() & ~F.col("name").rlike(r"\.(part|ytdl)\z"))
    return kept.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_p", "name"))).where("_n = 1").drop("_p", "_n")


def argument_errors(checks: dict[str, Column]) -> Column:
    """The messages of all checks that hold, in order: an empty array for good arguments."""
    return F.filter(F.array(*(F.when(cond, F.lit(text)) for text, cond in checks.items())), lambda x: x.isNotNull())
