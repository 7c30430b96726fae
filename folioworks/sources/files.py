"""Files as DataFrames: texts, archives, sound, cookies and settings. Bytes come through Spark's own reader."""

from __future__ import annotations

import io
import posixpath
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.functions.routing import extension_table, suffix
from folioworks.functions.strings import title

RATE = 16000


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, ext, kind and reader of all files below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    named = files.select("path", "length").withColumn("ext", suffix(F.col("path")))
    return named.join(F.broadcast(extension_table(spark)), "ext", "left").select("path", "length", "ext", "kind", "reader")


def text_of(content: Column) -> Column:
    """UTF-8 bytes as text: invalid bytes dropped, line ends as LF."""
    return F.regexp_replace(F.replace(F.make_valid_utf8(content.cast("string")), F.lit("\ufffd"), F.lit("")), r"\r\n?", "\n")


def read_texts(spark: SparkSession, path: str, pattern: str = "*.{txt,md}") -> DataFrame:
    """path, markdown and title of text files, passed through as they are."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    stem = F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?\z", 1)
    return files.select("path", text_of(F.col("content")).alias("markdown"), stem.alias("_stem")).withColumn("title", title(F.col("markdown"), F.col("_stem"))).drop("_stem")


def safe_name(name: str) -> str | None:
    """An archive member's path within the archive, or None if it would leave it."""
    clean = posixpath.normpath(name.replace("\\", "/"))
    return None if clean.startswith(("/", "../")) or clean == ".." or ":" in clean.split("/")[0] else clean


def archive_members(files: DataFrame) -> DataFrame:
    """path, name, content and error of the members of ZIP files (path, content); checksums are checked, folders and names
    that leave the archive left out. A broken archive gives one row with its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for info in z.infolist():
                            name = safe_name(info.filename)
                            if name and not info.is_dir():
                                rows.append((path, name, z.read(info), None))
                except (zipfile.BadZipFile, zlib.error, NotImplementedError, EOFError) as e:
                    rows.append((path, None, None, f"processing_failed: {e}"))
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "name", "content", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, name string, content binary, error string")


def parse_wav(data: bytes) -> np.ndarray:
    """The samples (-1 to 1) of a RIFF file of one channel at RATE, 16-bit or float; other chunks are skipped."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, kind = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
            if code == 0xFFFE:
                code = struct.unpack_from("<H", body, 24)[0]
            if channels != 1 or rate != RATE:
                raise ValueError(f"{channels} channels at {rate} Hz; one at {RATE} is needed")
            kind = {(1, 16): "<i2", (3, 32): "<f4"}.get((code, bits))
            if kind is None:
                raise ValueError(f"format {code} with {bits} bits")
        elif name == b"data":
            if kind is None:
                raise ValueError("data before its format")
            width = np.dtype(kind).itemsize
            samples = np.frombuffer(body[: len(body) // width * width], kind)
            return samples.astype(np.float32) / 32768 if kind == "<i2" else samples.astype(np.float32)
        at += 8 + size + size % 2
    raise ValueError("no data")


def sound_samples(files: DataFrame) -> DataFrame:
    """path, n_samples, seconds, samples and error of WAV files (path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    x = parse_wav(bytes(content))
                    rows.append((path, len(x), len(x) / RATE, x.tolist(), None))
                except (ValueError, struct.error) as e:
                    rows.append((path, None, None, None, f"processing_failed: {e}"))
            yield pd.DataFrame(rows, columns=["path", "n_samples", "seconds", "samples", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, n_samples long, seconds double, samples array<float>, error string")


def cookies(lines: DataFrame, column: str = "value") -> DataFrame:
    """The cookies of a Netscape cookie file's lines: seven tab-separated fields; comments are skipped, HttpOnly marks read."""
    marked = F.col(column).startswith("#HttpOnly_")
    bare = F.when(marked, F.substring(F.col(column), 11, 1 << 20)).otherwise(F.col(column))
    parts = F.split(bare, "\t", -1)
    kept = lines.where((F.size(parts) == 7) & (marked | ~F.col(column).startswith("#")))
    names = ("domain", "subdomains", "path", "secure", "expires", "name", "value")
    out = kept.select(*(F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)), marked.alias("http_only"))
    flag = lambda c: F.upper(c) == "TRUE"
    return out.withColumns({"subdomains": flag(F.col("subdomains")), "secure": flag(F.col("secure")), "expires": F.nullif(F.col("expires").try_cast("long"), F.lit(0))})


def settings(lines: DataFrame, column: str = "value") -> DataFrame:
    """name and value of NAME=value lines; comments and `export` are skipped, matching quotes taken off."""
    form = r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*\z"
    found = lines.select(F.regexp_extract(column, form, 1).alias("name"), F.regexp_extract(column, form, 2).alias("value")).where("name <> ''")
    return found.withColumn("value", F.regexp_replace("value", r"^(['\"])(.*)\1\z", "$2"))


def browser_spec(c: Column) -> Column:
    """struct of browser, keyring, profile and container of browser[+keyring][:profile][::container]."""
    part = lambda i: F.nullif(F.regexp_extract(c, r"^([^+:]+)(?:\+([^:]+))?(?::(?!:)(.*?))?(?:::(.*))?\z", i), F.lit(""))
    return F.struct(F.lower(part(1)).alias("browser"), F.upper(part(2)).alias("keyring"), part(3).alias("profile"), part(4).alias("container"))


def write_markdown(results: DataFrame, path: str, name: str = "name", text: str = "markdown") -> None:
    """Writes non-empty results by name as text files of one row each, a folder per name."""
    results.where(F.length(F.trim(text)) > 0).select(name, F.col(text).alias("value")).write.partitionBy(name).text(path)
