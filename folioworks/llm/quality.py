"""Quality by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled texts. A text is compressed with each, in
pieces short enough for the dictionary to matter; the difference of the compressed sizes over the text's bytes says
which kind it is like, and a logistic curve fitted on labelled texts that built no dictionary turns it into a score.

Training reads a bounded, documented number of labelled rows, whole: TRAIN_DOCS texts per class, the first by a hash of the
key. Two of three give the pieces of the dictionaries (TRAIN_PIECES of a class, the first by a hash, so a long text counts
by its length and is not cut off), one of three is measured by the cluster and fits the curve. The driver holds pieces and
differences, no texts. Scoring reads each whole text.

Defined results: null and empty texts have difference 0 and the score that the curve gives it; rows without a quality
label, and labelled ones without text, train nothing; a document with several labels counts as the mean of them, half as
good; where a class has no text for its dictionary or none for the curve, all texts get the share of good labels (0.5 without
any); pieces too few for the dictionary's training are the dictionary themselves, the first by the hash up to its size; rows
that repeat a doc_id train with that document's label each and are scored alike; an empty table gives no rows; other columns
of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.llm.common import hold, read_table, slices, tune

#: Labelled texts of a class that training reads: two of three build its dictionary, the third fits the curve.
TRAIN_DOCS = 1500
#: Pieces of a class that build its dictionary: with PIECE bytes each, what the driver holds.
TRAIN_PIECES = 4000
DICTIONARY = 64 << 10
PIECE = 2048
LEVEL = 3
THRESHOLD = 0.3


class Model:
    """Two dictionaries and the curve 1 / (1 + exp(-(slope * difference + shift)))."""

    def __init__(self, good: bytes, bad: bytes, slope: float, shift: float):
        self.good, self.bad, self.slope, self.shift = good, bad, slope, shift
        self._tools = None

    def __getstate__(self):
        return self.__dict__ | {"_tools": None}

    def difference(self, text: bytes) -> float:
        """(bytes with the bad dictionary - bytes with the good one) / bytes of the text."""
        if not text or not self.good:
            return 0.0
        if self._tools is None:
            import zstandard

            def tool(data):
                d = zstandard.ZstdCompressionDict(data)
                d.precompute_compress(level=LEVEL)
                return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

            self._tools = tool(self.good), tool(self.bad)
        good, bad = (t.compress for t in self._tools)
        view = memoryview(text)
        total = 0
        for a in range(0, len(text), PIECE):
            x = view[a : a + PIECE]
            total += len(bad(x)) - len(good(x))
        return total / len(text)

    def score(self, differences: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * differences + self.shift, -500, 500)))


def pieces_of(text: bytes) -> list[bytes]:
    return [text[a : a + PIECE] for a in range(0, len(text), PIECE)]


def dictionary(pieces: list[bytes]) -> bytes:
    """A dictionary of the pieces."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()
    except zstandard.ZstdError:  # too few to train on
        return b"".join(pieces)[:DICTIONARY]


def curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic regression with a weak prior, by Newton's method."""
    scale = float(x.std()) or 1.0
    design = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + 0.1 * w
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", per_class: int = TRAIN_DOCS) -> Model:
    """Fits a Model on docs joined with labels (key, quality)."""
    marks = labels.where(F.col("quality").isNotNull()).groupBy(F.col(key).alias("_key")).agg((F.avg("quality") >= 0.5).cast("int").alias("_good"))
    order = [F.xxhash64("_key", F.lit(11)), F.col("_key")]
    picked = marks.where("_good = 1").orderBy(*order).limit(per_class).unionByName(marks.where("_good = 0").orderBy(*order).limit(per_class))
    # At most 2 * per_class keys, so the broadcast has a bound.
    tune(docs.sparkSession)
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("text")).where("text <> ''").join(F.broadcast(picked), F.col(key) == F.col("_key"))
    rows = hold(rows.select(F.pmod(F.xxhash64("_key", F.lit(12)), F.lit(3)).alias("third"), "_good", "text"), "labelled")

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                kinds, found = [], []
                for good, x in zip(part.column("_good").to_pylist(), part.column("text").to_pylist(), strict=True):
                    pieces = pieces_of(x.encode("utf-8", "surrogatepass"))
                    kinds += [good] * len(pieces)
                    found += pieces
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(found, pa.binary())], names=["good", "piece"])

    building = rows.where("third <> 0").select("_good", "text").mapInArrow(cut, "good int, piece binary")
    order = [F.xxhash64("piece", F.lit(13)), F.col("piece")]
    pieces = [[bytes(r.piece) for r in building.where(F.col("good") == kind).orderBy(*order).limit(TRAIN_PIECES).collect()] for kind in (0, 1)]
    model = Model(b"", b"", 0.0, 0.0)
    if all(pieces):
        model.good, model.bad = dictionary(pieces[1]), dictionary(pieces[0])
    measured = score(rows.where("third = 0"), model, "_good").select("_good", "difference").collect()
    y = np.array([r["_good"] for r in measured], float)
    if not all(pieces) or len(set(y.tolist())) < 2:
        n = {r["_good"]: r["count"] for r in rows.groupBy("_good").count().collect()}
        share = min(1 - 1e-6, max(1e-6, n.get(1, 0) / sum(n.values()))) if n else 0.5
        return Model(b"", b"", 0.0, float(np.log(share / (1 - share))))
    # In an order of their own, so that the sums do not depend on the order of the tasks.
    x = np.array([r["difference"] for r in measured])
    order = np.lexsort((y, x))
    model.slope, model.shift = curve(x[order], y[order])
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' key and the columns `keep`, with score and difference."""
    tune(docs.sparkSession)
    columns = [key, *(c for c in keep or [] if c != key)]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                x = np.array([model.difference(t.encode("utf-8", "surrogatepass") if t else b"") for t in part.column("_text").to_pylist()], float)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(model.score(x)), pa.array(x)], names=[*columns, "score", "difference"])

    rows = docs.select(*columns, F.col(text).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, score double, difference double")


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, read_table(spark, sf_dir, "labels").where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score THRESHOLD or more."""
    model = train(docs, read_table(spark, sf_dir, "labels").where(~held_out()))
    return score(docs, model, keep=["text", "lang", "source", "n_chars"]).where(F.col("score") >= THRESHOLD).select("doc_id", "text", "lang", "source", "n_chars")
