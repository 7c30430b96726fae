"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies) its letters' vectors, each permuted
(rotated) by its place from the end; a text's vector bundles (adds) the vectors of all its n-grams; a language's prototype
adds the unit vectors of its training texts. A text gets the language whose prototype has the largest cosine with it.

Letters are lower-cased; a run of anything else is one gap symbol. Every letter of any script has a vector of its own, made
from the seed and its code point. The vectors of the n-grams of a to z and gaps are one bounded table that every worker
makes; those of other n-grams are made as they come.

Training adds up a bounded, documented number of texts per language (TRAIN_DOCS, picked by a hash of the key); prediction
reads each whole text.

Defined results: null texts and texts without letters are `und` with score 0; so are all texts where nothing could be
learned; languages whose texts have no letters are not learned; texts shorter than an n-gram are padded by gaps; equal
cosines go to the language that sorts first; repeated rows are predicted alike; an empty table gives no rows; other
columns of the input are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.llm.common import code_points, mix, read_table, slices, texts_of, tune, worker_state

#: Symbols of the table: the gap and a to z.
SYMBOLS = 27
N = 3
#: Other n-grams whose vectors are made at a time and that a worker keeps, and letters of a text that are packed at a time.
MADE, KEPT, SEGMENT = 2048, 16384, 1 << 16
DIMENSIONS = 512
SEED = 7
#: Texts of a language that training reads, about; all of them where there are fewer.
TRAIN_DOCS = 3000
#: Softmax temperature of the score.
TEMPERATURE = 0.05
UNDETERMINED = "und"
#: Cosine that the pipeline asks for where a language has too few training texts for a bound of its own.
LEAST_COSINE = 0.05
#: Classes of evidence, the share of training texts that may fall below a language's mark, training texts (and beginnings
#: of them) that a class needs for one, and the share of the mark that a document must reach.
CLASSES = 48
LOW_SHARE = 0.01
LEAST_TEXTS = 20
LEAST_SHARE = 0.5


def letter_table() -> np.ndarray:
    """The lower-case letter of every code point; 0 for what is no letter."""
    state = worker_state("langid")
    if "letters" not in state:
        table = np.zeros(0x110000, np.uint32)
        letters = np.fromiter((c for c in range(0x110000) if chr(c).isalpha()), np.int64)
        table[letters] = np.fromiter((ord(chr(c).lower()[0]) for c in letters), np.int64, len(letters))
        state["letters"] = table
    return state["letters"]


def letter_vectors(letters: np.ndarray) -> np.ndarray:
    """A row of +1 and -1 for each letter (code point; 0 is the gap): the bits of hashes of the letter and the seed."""
    words = np.arange(DIMENSIONS // 64, dtype=np.uint64)
    bits = mix(mix(letters.astype(np.uint64) + np.uint64(SEED << 32))[:, None] + words[None, :])
    return np.unpackbits(bits.astype("<u8").view(np.uint8).reshape(len(letters), -1), axis=1).astype(np.int8) * 2 - 1


def bound(grams: np.ndarray) -> np.ndarray:
    """The vectors of n-grams (rows of N letters): products of the letters' vectors, rotated by their place from the end."""
    letters, at = np.unique(grams, return_inverse=True)
    vectors, at = letter_vectors(letters), at.reshape(grams.shape)
    out = vectors[at[:, -1]]
    for place in range(1, N):
        out = out * np.roll(vectors, place, axis=1)[at[:, -1 - place]]
    return out


def gram_vectors() -> np.ndarray:
    """The vectors of all n-grams of gaps and a to z."""
    state = worker_state("langid")
    if "grams" not in state:
        letters = np.array([0, *range(97, 123)])
        places = np.indices((SYMBOLS,) * N).reshape(N, -1).T
        state["grams"] = bound(letters[places])
    return state["grams"]


def other_vectors(packed: np.ndarray) -> np.ndarray:
    """The vectors of at most MADE other n-grams (packed code points); a worker keeps those that it made last."""
    state = worker_state("langid")
    if "places" not in state:
        state["places"], state["made"] = {}, np.empty((KEPT, DIMENSIONS), np.int8)
    places, keys = state["places"], packed.tolist()
    if len(places) + len(keys) > KEPT:
        places.clear()
    if new := [g for g in keys if g not in places]:
        first = len(places)
        places.update(zip(new, range(first, first + len(new)), strict=True))
        fresh = np.array(new, np.int64)
        state["made"][first : first + len(new)] = bound(np.stack([fresh >> 21 * k & 0x1FFFFF for k in range(N - 1, -1, -1)], axis=1))
    return state["made"][[places[g] for g in keys]]


def text_grams(column: pa.Array) -> Iterator[np.ndarray]:
    """The n-grams of each text, in order; none for a text without letters. One of gaps and a to z is its place in
    gram_vectors(); another one is its code points, packed, after them."""
    text, bounds = texts_of(column)
    found = letter_table()[code_points(text)] if text else np.zeros(0, np.uint32)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        letter = found[a:b] > 0
        if not letter.any():
            yield np.zeros(0, np.int64)
            continue
        letter[1:] |= letter[:-1].copy()  # of a gap its first place
        s = np.concatenate([[0], found[a:b][letter], [0]]).astype(np.uint32)
        out = np.empty(len(s) - N + 1, np.int64)
        for i in range(0, len(out), SEGMENT):
            out[i : i + SEGMENT] = packed_grams(s[i : i + SEGMENT + N - 1])
        yield out


def packed_grams(s: np.ndarray) -> np.ndarray:
    """The n-grams of a run of letters and gaps, as of text_grams()."""
    n = len(s) - N + 1
    plain = (s >= 97) & (s <= 122)
    symbol = np.where(plain, s - np.uint32(96), 0).astype(np.int64)
    code = symbol[:n].copy()
    for k in range(1, N):
        code = code * SYMBOLS + symbol[k : n + k]
    other = (s > 0) & ~plain
    if other.any():
        rare, packed = other[:n].copy(), s[:n].astype(np.int64)
        for k in range(1, N):
            rare |= other[k : n + k]
            packed = packed << 21 | s[k : n + k]
        code = np.where(rare, packed + SYMBOLS**N, code)
    return code


def bundle(code: np.ndarray) -> tuple[np.ndarray, float]:
    """The unit vector of n-grams, and their evidence: how many equally frequent different ones would be as telling."""
    rare = code >= SYMBOLS**N
    some = rare.any()
    counts = np.bincount(code[~rare] if some else code, minlength=0)
    which = np.flatnonzero(counts)
    n, v = counts[which], np.zeros(DIMENSIONS, np.float32)
    for a in range(0, len(which), MADE):
        v += n[a : a + MADE].astype(np.float32) @ gram_vectors()[which[a : a + MADE]].astype(np.float32)
    if some:
        packed, times = np.unique(code[rare] - SYMBOLS**N, return_counts=True)
        for a in range(0, len(packed), MADE):
            v += times[a : a + MADE].astype(np.float32) @ other_vectors(packed[a : a + MADE]).astype(np.float32)
        n = np.concatenate([n, times])
    norm = float(np.sqrt(v @ v))
    n = n.astype(np.float64)
    return v / norm if norm else v, float(n.sum() ** 2 / (n @ n))


def text_vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the texts and the evidence in each (both 0 for those without a letter)."""
    out, evidence = np.zeros((len(column), DIMENSIONS), np.float32), np.zeros(len(column))
    for i, code in enumerate(text_grams(column)):
        if len(code):
            out[i], evidence[i] = bundle(code)
    return out, evidence


def evidence_class(evidence: np.ndarray) -> np.ndarray:
    """Half octaves of evidence."""
    return np.minimum(2 * np.log2(np.maximum(evidence, 1)), CLASSES - 1).astype(np.int64)


def training_texts(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = TRAIN_DOCS) -> DataFrame:
    """The texts that training reads, with their languages."""
    tune(labelled.sparkSession)
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(key), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = rows.groupBy("lang").count()
    # A language's share is kept by a hash of the key, so that about per_lang texts of it are read.
    share = counts.select("lang", F.least(F.lit(1.0), F.lit(float(per_lang)) / F.col("count")).alias("_share"))
    return rows.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < F.col("_share") * 1_000_000).select("lang", "text")


def language_sums(picked: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and the sums of their texts' unit vectors; partial sums are added up by the cluster."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                vectors, _ = text_vectors(part.column("text"))
                langs = np.array(part.column("lang").to_pylist(), object)
                for name in set(langs.tolist()):
                    sums[name] = sums.get(name, 0) + vectors[langs == name].sum(axis=0, dtype=np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "sums"])

    parts = picked.mapInArrow(run, "lang string, sums array<double>")
    total = parts.select("lang", F.posexplode("sums").alias("i", "v")).groupBy("lang", "i").agg(F.sum("v").alias("v")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("v"))
    found = sorted((r.lang, np.round(np.array([x.v for x in r.v]), 6)) for r in total.collect() if any(x.v for x in r.v))
    return [k for k, _ in found], np.array([v for _, v in found]).reshape(len(found), DIMENSIONS)


def unit(sums: np.ndarray) -> np.ndarray:
    return sums / np.sqrt((sums * sums).sum(axis=1, keepdims=True))


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and their unit prototypes."""
    langs, sums = language_sums(training_texts(labelled, key, text, lang, per_lang))
    return langs, unit(sums)


def least_cosines(picked: DataFrame, langs: list[str], sums: np.ndarray) -> np.ndarray:
    """By language and class of evidence, the cosine below which a text is not of the language: LEAST_SHARE of the one
    that all but LOW_SHARE of the language's own training texts reach.

    Each training text is measured whole and by its beginnings of 8, 16, 32, ... n-grams, against the prototype without
    it. A class with fewer than LEAST_TEXTS of them takes the bound of the next class below that has as many (bounds rise
    with evidence, so that is the milder one), and where there is none LEAST_COSINE."""
    place = {k: n for n, k in enumerate(langs)}

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                for name, code in zip(part.column("lang").to_pylist(), text_grams(part.column("text")), strict=True):
                    if name not in place or not len(code):
                        continue
                    others = sums[place[name]] - bundle(code)[0]
                    norm = float(np.sqrt(others @ others))
                    if norm < 1e-3:  # the language's only text
                        continue
                    n = 8
                    while True:
                        v, evidence = bundle(code[:n])
                        seen[place[name], int(evidence_class(np.array(evidence))), math.floor(100 * float(v @ others) / norm)] += 1
                        if n >= len(code):
                            break
                        n *= 2
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (*zip(*seen, strict=True), list(seen.values()))], names=["lang", "class", "percent", "n"])

    rows = picked.mapInArrow(run, "lang long, class long, percent long, n long").groupBy("lang", "class", "percent").agg(F.sum("n").alias("n")).collect()
    texts: dict[tuple[int, int], dict[int, int]] = {}
    for r in rows:
        texts.setdefault((r["lang"], r["class"]), {})[r["percent"]] = r["n"]
    out = np.full((len(langs), CLASSES), LEAST_COSINE)
    for lang in range(len(langs)):
        for c in range(CLASSES):
            found = sorted(texts.get((lang, c), {}).items())
            total = sum(n for _, n in found)
            if total >= LEAST_TEXTS:
                reached = np.cumsum([n for _, n in found])
                out[lang, c] = LEAST_SHARE * found[int(np.argmax(reached > LOW_SHARE * total))][0] / 100
            elif c:
                out[lang, c] = out[lang, c - 1]
    return out


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, least: np.ndarray | None = None) -> DataFrame:
    """docs' key and the columns `keep`, with lang_pred, score (softmax of the cosines), cosine and close: whether the
    language is determined and the cosine reaches its bound in `least` (of least_cosines; none where it is not given)."""
    tune(docs.sparkSession)
    keep = keep or []
    weights = prototypes.astype(np.float32).T

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                vectors, evidence = text_vectors(part.column("_text"))
                lettered = evidence > 0
                if langs:
                    cosines = (vectors @ weights).astype(np.float64)
                    best = cosines.argmax(axis=1)
                    top = cosines[np.arange(len(best)), best]
                    powers = np.exp((cosines - top[:, None]) / TEMPERATURE)
                    score = 1 / powers.sum(axis=1)
                else:
                    best, top, score = (np.zeros(len(lettered), k) for k in (np.int64, float, float))
                known = lettered & bool(langs)
                close = known & (top >= least[best, evidence_class(evidence)]) if langs and least is not None else known
                names = np.array([*langs, UNDETERMINED], object)[np.where(known, best, len(langs))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(np.where(known, top, 0.0)), pa.array(close)], names=[*columns, "lang_pred", "score", "cosine", "close"])

    columns = [key, *(c for c in keep if c != key)]
    rows = docs.select(*columns, F.col(text).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double, cosine double, close boolean")


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string")) % 3 == 1


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rule = F.coalesce(held_out(), F.lit(False))
    langs, prototypes = train(docs.where(~rule))
    return predict(docs, langs, prototypes).select("doc_id", rule.alias("held_out"), "lang_pred", "score", "cosine")


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is determined; those without letters go, and those farther from their language's
    prototype than texts of as much evidence in that language are (least_cosines). A few words are little evidence and
    stay, as do a few words often repeated, clean or not."""
    picked = training_texts(docs.where(~F.coalesce(held_out(), F.lit(False))))
    langs, sums = language_sums(picked)
    found = predict(docs, langs, unit(sums), keep=["text", "lang", "source", "n_chars"], least=least_cosines(picked, langs, sums))
    return found.where("close").select("doc_id", "text", "lang", "source", "n_chars")
