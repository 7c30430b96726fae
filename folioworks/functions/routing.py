"""Where an input goes: extensions, URLs, platforms, routes, models and back ends, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.functions.strings import SPACE, strip

#: File extensions by kind.
AUDIO = (".mp3", ".wav", ".m4a", ".flac", ".ogg", ".aac", ".opus", ".wma", ".webm", ".mp4a")
VIDEO = (".mp4", ".mkv", ".avi", ".mov", ".wmv", ".flv", ".ts", ".m4v")
IMAGE = (".png", ".jpg", ".jpeg", ".webp", ".tif", ".tiff")
PAGED = (".pdf",)
WITH_ASSETS = (".docx", ".epub", ".odt")
CONVERTED_TOO = (".pdf", ".pptx", ".txt", ".xlsx")
#: The converter's reader for each extension.
READERS = {
    ".adoc": "asciidoc", ".asciidoc": "asciidoc", ".bib": "bibtex", ".biblatex": "biblatex", ".bits": "bits",
    ".commonmark": "commonmark", ".creole": "creole", ".csv": "csv", ".dbk": "docbook", ".docbook": "docbook",
    ".docx": "docx", ".dokuwiki": "dokuwiki", ".endnote": "endnotexml", ".enw": "endnotexml", ".epub": "epub",
    ".fb2": "fb2", ".gfm": "gfm", ".haddock": "haddock", ".htm": "html", ".html": "html", ".ipynb": "ipynb",
    ".jats": "jats", ".json": "json", ".latex": "latex", ".ltx": "latex", ".man": "man", ".markdown": "markdown",
    ".md": "markdown", ".mdoc": "mdoc", ".mediawiki": "mediawiki", ".muse": "muse", ".native": "native",
    ".odt": "odt", ".opml": "opml", ".org": "org", ".ris": "ris", ".rst": "rst", ".rtf": "rtf", ".t2t": "t2t",
    ".tex": "latex", ".textile": "textile", ".tsv": "tsv", ".typ": "typst", ".typst": "typst",
    ".vimwiki": "vimwiki", ".wiki": "mediawiki",
}
#: Substrings that tell a platform; the first that fits wins.
PLATFORMS = (("youtube.com", "youtube"), ("youtu.be", "youtube"), ("bilibili.com", "bilibili"), ("xiaohongshu.com", "xiaohongshu"), ("xhslink.com", "xiaohongshu"), ("xiaoyuzhoufm.com", "xiaoyuzhoufm"))
PRECISIONS = ("4bit", "6bit", "8bit", "bf16")
TASKS = ("transcript", "convert", "ocr")


#: MIME types of files that are sent to a service.
MIME = {
    ".wav": "audio/x-wav", ".mp3": "audio/mpeg", ".flac": "audio/x-flac", ".m4a": "audio/mp4a-latm", ".aac": "audio/x-aac",
    ".ogg": "audio/ogg", ".opus": "audio/ogg", ".webm": "video/webm", ".mp4": "video/mp4", ".png": "image/png",
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".webp": "image/webp", ".tif": "image/tiff", ".tiff": "image/tiff",
}


def mime_type(path: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in MIME.items() for x in pair)), suffix(path))


def is_converted(path: Column) -> Column:
    return suffix(path).isin(*READERS, *CONVERTED_TOO)


def is_media(path: Column) -> Column:
    """Whether sound can be had from a file."""
    return suffix(path).isin(*AUDIO, *VIDEO)


def task_error(task: Column) -> Column:
    return F.when(task.isNotNull() & ~task.isin(*TASKS), F.lit(f"Unsupported task. Supported tasks: {', '.join(TASKS)}."))


def wants_readable(task: Column, flag: Column, source: Column) -> Column:
    """Whether a page's main content is asked for, by its task or the flag, of a URL or an HTML file."""
    return F.coalesce((task == "readable_html") | flag, F.lit(False)) & (is_url(source) | suffix(source).isin(".html", ".htm"))


def wants_positions(anchors: Column, segments: Column) -> Column:
    return F.coalesce(anchors, F.lit(False)) | F.coalesce(segments, F.lit(False))


def written_to(output_dir: Column, requested: Column) -> Column:
    """struct(output_file, output_dir, ignored): a result with assets keeps its folder and ignores the file asked for."""
    return F.struct(F.when(output_dir.isNull(), requested).alias("output_file"), output_dir.alias("output_dir"), (output_dir.isNotNull() & requested.isNotNull()).alias("ignored"))


def dense_error(model: Column) -> Column:
    """What speaks against a dense checkpoint where only quantized ones run, or null."""
    return F.when(model.endswith("-bf16"), F.concat(F.lit("dense checkpoints are not supported: "), model))


def model_by_alias(requests: DataFrame, families: DataFrame, default: str) -> DataFrame:
    """requests (alias, wanted) with `model` and `error`. families (family, repo, quantized): a small table, broadcast; a dense
    family's model is its repo, a quantized one's has a precision: the wanted one, else the alias's own, else 4bit."""
    name = F.regexp_replace(F.lower(strip(F.coalesce(F.nullif(F.col("alias"), F.lit("")), F.lit(default)))), "[ _]", "-")
    name = F.regexp_replace(name, "^[^/]*/", "")
    marks = "|".join(PRECISIONS)
    rows = requests.withColumn("_own", F.nullif(F.regexp_extract(name, f"-({marks})\\z", 1), F.lit(""))).withColumn("_p", precision(F.col("wanted"))).withColumn("family", F.regexp_replace(name, f"-({marks})\\z", ""))
    rows = rows.join(F.broadcast(families.select("family", F.col("repo").alias("_repo"), F.col("quantized").alias("_q"))), "family", "left")
    unknown = F.col("_repo").isNull() | (~F.col("_q") & F.col("_own").isNotNull())
    error = F.when(F.col("wanted").isNotNull() & (strip(F.col("wanted")) != "") & F.col("_p").isNull(), "unknown precision").when(F.col("_own").isNotNull() & F.col("_p").isNotNull() & (F.col("_own") != F.col("_p")), "precision conflicts with the model's own").when(unknown, "unknown model")
    model = F.when(~F.col("_q"), F.col("_repo")).otherwise(F.concat("_repo", F.lit("-"), F.coalesce("_p", "_own", F.lit("4bit"))))
    return rows.withColumn("error", error).withColumn("model", F.when(F.col("error").isNull(), model)).drop("_own", "_p", "_repo", "_q", "family")


def extension_table(spark: SparkSession) -> DataFrame:
    """ext, kind and reader: a fixed table of under a hundred rows, small enough to broadcast."""
    kinds = {e: "document_file" for e in (*READERS, *CONVERTED_TOO)} | {e: "image_file" for e in IMAGE} | {e: "audio_file" for e in AUDIO} | {e: "video_file" for e in VIDEO}
    return spark.createDataFrame([(e, k, READERS.get(e)) for e, k in sorted(kinds.items())], "ext string, kind string, reader string")


def suffix(path: Column) -> Column:
    """The last extension in lower case; none for names that begin or end with their only dot."""
    name = F.lower(F.regexp_extract(path, r"([^/]*)/*\z", 1))
    return F.regexp_extract(name, r"^.*[^.].*?(\.[^./]+)\z", 1)


def is_url(c: Column) -> Column:
    """http or https with a host part; brackets of a host must pair."""
    host = F.regexp_extract(c, r"(?i)^https?://([^/?#]*)", 1)
    return F.coalesce((host != "") & (host.contains("[") == host.contains("]")), F.lit(False))


def url_parts(c: Column) -> Column:
    """struct of scheme, host and path."""
    return F.struct(
        F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)).alias("scheme"),
        F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1).alias("netloc"),
        F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?([^?#]*)", 1).alias("path"),
    )


def platform(url: Column) -> Column:
    out = None
    for part, name in PLATFORMS:
        cond = F.lower(url).contains(part)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise("unknown")


def route(source: Column, task: Column, is_scanned: Column) -> Column:
    """struct(source_kind, task_type) of an input; a null task_type is an unsupported one.

    URLs are transcribed; an asked-for OCR takes images and paged documents; images and scanned documents go to OCR by
    themselves; sound and film are transcribed; what the converter reads is converted."""
    ext = suffix(source)
    ask = F.coalesce(task, F.lit(""))
    free = lambda t: F.when(ask.isin("", t), F.lit(t))
    made = lambda kind, t: F.struct(F.lit(kind).alias("source_kind"), t.alias("task_type"))
    document = ext.isin(*READERS, *CONVERTED_TOO)
    return (
        F.when(is_url(source), made("url", free("transcript")))
        .when(ext.isin(*IMAGE), made("image_file", free("ocr")))
        .when(ext.isin(*PAGED) & ((ask == "ocr") | (is_scanned & (ask == ""))), made("document_file", F.lit("ocr")))
        .when(ext.isin(*AUDIO), made("audio_file", free("transcript")))
        .when(ext.isin(*VIDEO), made("video_file", free("transcript")))
        .when(document, made("document_file", free("convert")))
        .otherwise(made("unknown", F.lit(None).cast("string")))
    )


def route_error(routed: Column) -> Column:
    """struct(kind, message) where a route is unsupported, else null."""
    return F.when(routed["task_type"].isNull(), F.struct(F.lit("unsupported_input").alias("kind"), F.concat(F.lit("unsupported input: "), routed["source_kind"]).alias("message")))


def precision(c: Column) -> Column:
    """A precision's canonical name, or null where there is none of that name."""
    name = F.regexp_replace(F.lower(strip(c)), "[- ]", "")
    return F.when(name.isin(*PRECISIONS), name)


def model_family(model: Column) -> Column:
    return F.when(F.lower(model).contains("pp-ocr"), "line").when(F.lower(model).contains("ocr-2"), "layout2").otherwise("layout1")


def eight_bit_fallback(model: Column) -> Column:
    return F.when(model.contains("-4bit"), F.replace(model, F.lit("-4bit"), F.lit("-8bit")))


def first_given(*choices: Column) -> Column:
    """The first choice that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in choices))


def base_url(c: Column) -> Column:
    """A service address with a scheme, without a final slash, ending in /v1."""
    s = F.regexp_replace(strip(c), r"/+\z", "")
    s = F.when(s.rlike(r"^[A-Za-z0-9.-]+:\d{1,5}(/|\z)"), F.concat(F.lit("http://"), s)).otherwise(s)
    return F.when(s == "", F.lit(None)).when(s.endswith("/v1"), s).otherwise(F.concat(s, F.lit("/v1")))


def file_uri(path: Column) -> Column:
    """file:// and the path with everything but letters, digits and _.-~/ escaped."""
    c = F.url_encode(path)
    for old, new in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.concat(F.lit("file://"), c)


def output_format(c: Column) -> Column:
    """struct(format, extension, is_subtitle) of a format's name or alias; null of an unknown one."""
    s = F.lower(strip(c))
    name = F.when(s.isin("md", "markdown"), "markdown").when(s.isin("json", "srt", "vtt"), s)
    return F.when(name.isNotNull(), F.struct(name.alias("format"), F.when(name == "markdown", "md").otherwise(name).alias("extension"), name.isin("srt", "vtt").alias("is_subtitle")))


def page_range_error(first: Column, last: Column, count: Column) -> Column:
    """What is wrong with a 0-based inclusive page range, or null."""
    return F.when(first < 0, "the first page is negative").when(last < first, "the last page is before the first").when(first >= count, "the first page is beyond the document").when(last >= count, "the last page is beyond the document")


def merged_context(context: Column, metadata: Column) -> Column:
    a, b = F.nullif(strip(context), F.lit("")), F.nullif(strip(metadata), F.lit(""))
    return F.when(a.isNotNull() & b.isNotNull(), F.concat(a, F.lit("\n\n"), b)).otherwise(F.coalesce(a, b))


def error_class(message: Column) -> Column:
    """What a downloader's error text is about; the first class that fits."""
    m = F.lower(message)
    return (
        F.when(m.rlike("keyring|secretstorage|failed to decrypt"), "keyring")
        .when(m.rlike("could not find .*cookies|cookies database|unsupported browser"), "cookie_source")
        .when(m.rlike("unsupported url"), "unsupported")
        .when(m.rlike("sign in|log ?in|authentication|http error 40[13]|private video"), "auth")
        .when(m.rlike("no such option|unrecognized arguments"), "invalid_option")
        .otherwise("other")
    )


def spaces_only(c: Column) -> Column:
    return c.rlike(f"^[{SPACE}]*\\z")
