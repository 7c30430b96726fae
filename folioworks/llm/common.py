"""What the operators of this package share: the cluster's shared folder, lineage cuts and Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import math
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Texts can be long, so a batch holds fewer rows than Spark's 10000.
BATCH_ROWS = 1000


def tune(spark: SparkSession) -> None:
    """Lowers Spark's default number of rows in an Arrow batch; a value that the user chose stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


_OWN_FOLDER: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder, as a qualified URI, below spark.checkpoint.dir, which every executor can read.

    Where the setting is absent, a local session (a test) uses a temporary folder of this machine; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder there that the driver and all executors share")
        if not _OWN_FOLDER:
            _OWN_FOLDER.append(tempfile.mkdtemp(prefix="folioworks-"))
            atexit.register(shutil.rmtree, _OWN_FOLDER[0], ignore_errors=True)
        base = _OWN_FOLDER[0]
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}-{uuid.uuid4().hex}")
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file:///") else whole


def _held(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hold(df: DataFrame, name: str) -> DataFrame:
    """Writes df into the shared folder and reads it back: lineage ends here and survives lost executors."""
    return _held(df, shared_dir(df.sparkSession, name))


class Scratch:
    """Held tables of an operator's inner steps, which go when its result is held."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.n = spark, shared_dir(spark, name), 0

    def hold(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        return _held(df, f"{self.folder}/{self.n:04d}-{name}")

    def close(self) -> None:
        drop_dir(self.spark, self.folder)


def numbered(docs: DataFrame) -> DataFrame:
    """docs in the shared folder, with a number `_row` of each row: rows stay apart where their doc_id repeats or is null."""
    return hold(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")


def drop_dir(spark: SparkSession, uri: str) -> None:
    """Deletes a folder of shared_dir()."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Schemes that Hadoop's file systems have under a name of their own.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs", "wasb": "abfs"}


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a URI (file, hdfs, s3, gs and what else Arrow knows)."""
    scheme, colon, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}{colon}{rest}")


def write_blocks(df: DataFrame, folder: str, most_rows: int | None = None, most_bytes: int | None = None) -> list[str]:
    """Writes df into files of the folder, each of at most most_rows rows and about most_bytes bytes, and returns those of
    the tasks that ended well: one path per block, however many rows there are."""
    names = df.columns

    def run(batches):
        store, root = open_fs(folder)
        store.create_dir(root, recursive=True)

        def put(rows: pa.Table) -> pa.RecordBatch:
            path = f"{root}/block-{uuid.uuid4().hex}.parquet"
            with store.open_output_stream(path) as out:
                pq.write_table(rows, out)
            return pa.RecordBatch.from_pydict({"path": [path]})

        held: list[pa.RecordBatch] = []
        rows = size = 0
        for batch in batches:
            step = max(1, min(most_rows or len(batch), 256 if most_bytes else len(batch)))
            for i in range(0, len(batch), step):
                part = batch.slice(i, step).select(names)
                n = part.nbytes
                if held and ((most_rows and rows + len(part) > most_rows) or (most_bytes and size + n > most_bytes)):
                    yield put(pa.Table.from_batches(held))
                    held, rows, size = [], 0, 0
                held.append(part)
                rows += len(part)
                size += n
        if rows:
            yield put(pa.Table.from_batches(held))

    return sorted(r.path for r in df.mapInArrow(run, "path string").collect())


def read_block(folder: str, path: str) -> pa.Table:
    """A file of write_blocks()."""
    store, _ = open_fs(folder)
    with store.open_input_file(path) as f:
        return pq.read_table(f)


_HELD: dict[str, dict] = {}


def worker_state(owner: str) -> dict:
    """What an operator keeps in a Python worker between tasks. A worker serves one operator after another, so another
    one's state goes, and memory that was freed is given back."""
    if owner not in _HELD:
        _HELD.clear()
        release()
        _HELD[owner] = {}
    return _HELD[owner]


def release() -> None:
    """Gives freed memory of Arrow and of the C library back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def texts_of(column: pa.Array) -> tuple[str, np.ndarray]:
    """All strings of an Arrow column as one str, and the code-point bounds of each (len + 1 values); null is empty."""
    strings = column.to_pylist()
    lengths = np.fromiter((len(s) if s else 0 for s in strings), np.int64, len(strings))
    return "".join(s for s in strings if s), np.concatenate([[0], np.cumsum(lengths)])


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 700_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts in column hold at most most_bytes, or one row where a single text is longer."""
    values = batch.column(column)
    if values.null_count == len(values):
        yield batch
        return
    sizes = np.nan_to_num(np.asarray(pc.binary_length(values).to_numpy(zero_copy_only=False), dtype=np.float64))
    start, held = 0, 0.0
    for i, n in enumerate(sizes):
        if i > start and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0.0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of all runs, one run after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths - starts, lengths)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, math.ceil(math.log2(n + 2)))
    if 0 not in _POWERS or len(_POWERS[0][0]) < n + 1:
        with np.errstate(over="ignore"):
            up, down = np.full(size, _BASE, np.uint64), np.full(size, _BASE_INVERSE, np.uint64)
            up[0] = down[0] = 1
            _POWERS[0] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly (the finisher of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def symbols(codes: np.ndarray) -> np.ndarray:
    """mix(code + 1), from a table for the common codes."""
    if 1 not in _POWERS:
        _POWERS[1] = (mix(np.arange(1, 0x10001, dtype=np.uint64)),) * 2
    rare = codes >= 0x10000
    out = _POWERS[1][0][np.where(rare, 0, codes) if rare.any() else codes]
    if rare.any():
        out[rare] = mix(codes[rare].astype(np.uint64) + np.uint64(1))
    return out


def range_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of codes[start:end] for many ranges at once, by prefix sums of mixed symbols times powers.

    Sums are modulo 2**64, for which certain pairs of words of 1024 characters and more collide under any base; callers
    compare the ranges themselves or take another hash for long ones."""
    up, down = _powers(len(codes))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(symbols(codes) * up[: len(codes)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
