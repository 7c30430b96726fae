"""Token-id files of patched frame-of-reference blocks.

A file holds a run of documents' ids. Ids are cut into blocks of BLOCK values; a block stores its minimum, the
differences to it packed at the width that a percentile of them needs, and an exception list (place, high part) for the
differences that need more. The footer has the start of every block, so any id can be reached by decoding one block,
and the documents with their lengths.

    magic | blocks | block starts (u64) | doc ids (i64) | null flags (u8) | lengths (u64) | footer (json) | its length (u32) | magic

Documents are written in ascending order of their id, in files numbered by range partition and place, and the manifest
(one row per file, written by the tasks that ended well) says which files belong to the set. A file's name carries a
random part, so a repeated task never touches a committed file.

Defined results: a null or empty text is the end id alone; null doc_ids come first; repeated rows are kept, those of one
doc_id in order of their texts; an empty table gives no files and no rows; other columns of the input are not read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.llm.common import hold, open_fs, read_table, shared_dir, slices, spread, tune
from folioworks.llm.packing import default_tokenizer
from folioworks.llm.tokens import encoder, with_end

MAGIC = b"PFORIDS1"
BLOCK = 256
#: Share of a block's differences that its packed width must hold.
PERCENTILE = 0.98
#: Ids after which a file is closed, at the end of a document.
FILE_IDS = 4_000_000
END_ID = 0
#: Bytes of texts that are encoded at a time, and pre-tokens that a worker keeps: the encoding is all that a task holds here.
PART_BYTES, CACHED = 1_500_000, 500_000
HEAD = struct.Struct("<IBH")  # minimum, width, exceptions


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits that each value needs; exact for values below 2**53."""
    return np.frexp(x.astype(np.float64))[1]


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values (uint64, below 2**width) as rows of BLOCK * width / 8 bytes."""
    k = len(values)
    groups = values.reshape(k, BLOCK // 64, 64)
    out = np.zeros((k, BLOCK // 64, width), np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        out[:, :, word] |= groups[:, :, i] << np.uint64(shift)
        if shift + width > 64:
            out[:, :, word + 1] |= groups[:, :, i] >> np.uint64(64 - shift)
    return out.astype("<u8").reshape(k, -1).view(np.uint8)


def _unpack(data: np.ndarray, width: int) -> np.ndarray:
    k = len(data)
    words = np.ascontiguousarray(data).view("<u8").astype(np.uint64).reshape(k, BLOCK // 64, width)
    out = np.zeros((k, BLOCK // 64, 64), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        v = words[:, :, word] >> np.uint64(shift)
        if shift + width > 64:
            v = v | words[:, :, word + 1] << np.uint64(64 - shift)
        out[:, :, i] = v & mask
    return out.reshape(k, BLOCK)


def encode_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> tuple[bytes, np.ndarray]:
    """The blocks' bytes and the start of each block; the last block is filled up with its last id."""
    n = len(ids)
    if not n:
        return b"", np.zeros(0, np.uint64)
    rows = -(-n // BLOCK)
    values = np.full(rows * BLOCK, ids[-1], np.uint64)
    values[:n] = ids
    values = values.reshape(rows, BLOCK)
    least = values.min(axis=1)
    values = values - least[:, None]
    at = min(BLOCK - 1, max(0, int(np.ceil(percentile * BLOCK)) - 1))
    width = _bits(np.partition(values, at, axis=1)[:, at])
    high = values >> width.astype(np.uint64)[:, None]
    patched = high > 0
    exceptions = patched.sum(axis=1)
    sizes = HEAD.size + BLOCK * width // 8 + 5 * exceptions
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for j, field in enumerate((least.astype("<u4").view(np.uint8).reshape(rows, 4), width.astype(np.uint8).reshape(rows, 1), exceptions.astype("<u2").view(np.uint8).reshape(rows, 2))):
        out[starts[:, None] + (0, 4, 5)[j] + np.arange(field.shape[1])] = field
    for w in np.unique(width):
        if w:
            mine = np.flatnonzero(width == w)
            out[starts[mine, None] + HEAD.size + np.arange(BLOCK * int(w) // 8)] = _pack(values[mine] & np.uint64((1 << int(w)) - 1), int(w))
    row, place = np.nonzero(patched)
    if len(row):
        tail = starts + HEAD.size + BLOCK * width // 8
        nth = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        out[tail[row] + nth] = place
        out[(tail + exceptions)[row][:, None] + 4 * nth[:, None] + np.arange(4)] = high[row, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes(), starts.astype(np.uint64)


def decode_blocks(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The values (uint32) of the blocks that begin at starts in data (uint8), BLOCK each."""
    starts = starts.astype(np.int64)
    if not len(starts):
        return np.zeros(0, np.uint32)
    least = np.ascontiguousarray(data[starts[:, None] + np.arange(4)]).view("<u4")[:, 0].astype(np.uint64)
    width = data[starts + 4].astype(np.int64)
    exceptions = np.ascontiguousarray(data[starts[:, None] + 5 + np.arange(2)]).view("<u2")[:, 0].astype(np.int64)
    values = np.zeros((len(starts), BLOCK), np.uint64)
    for w in np.unique(width):
        if w:
            mine = np.flatnonzero(width == w)
            values[mine] = _unpack(data[starts[mine, None] + HEAD.size + np.arange(BLOCK * int(w) // 8)], int(w))
    if exceptions.any():
        tail = starts + HEAD.size + BLOCK * width // 8
        row = np.repeat(np.arange(len(starts)), exceptions)
        place = data[spread(tail, exceptions)]
        nth = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        high = np.ascontiguousarray(data[(tail + exceptions)[row][:, None] + 4 * nth[:, None] + np.arange(4)]).view("<u4")[:, 0].astype(np.uint64)
        values[row, place] |= high << width[row].astype(np.uint64)
    return (values + least[:, None]).astype(np.uint32).reshape(-1)


def file_bytes(ids: np.ndarray, keys: np.ndarray, nulls: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """A file's parts, in order."""
    blocks, starts = encode_blocks(ids)
    footer = json.dumps({"version": 1, "block": BLOCK, "ids": len(ids), "docs": len(keys), "blocks": len(starts)}).encode()
    return [MAGIC, blocks, starts.astype("<u8").tobytes(), keys.astype("<i8").tobytes(), nulls.astype("u1").tobytes(), lengths.astype("<u8").tobytes(), footer, struct.pack("<I", len(footer)), MAGIC]


class TokenFile:
    """Reads a file of file_bytes()."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or data[-8:] != MAGIC:
            raise ValueError("not a file of token ids")
        (n,) = struct.unpack("<I", data[-12:-8])
        self.meta = json.loads(data[-12 - n : -12])
        self.data = np.frombuffer(data, np.uint8)
        docs, blocks, end = self.meta["docs"], self.meta["blocks"], len(data) - 12 - n
        part = lambda size, kind, at: np.frombuffer(data, kind, size, at)
        self.lengths = part(docs, "<u8", end - 8 * docs).astype(np.int64)
        self.nulls = part(docs, "u1", end - 9 * docs)
        self.keys = part(docs, "<i8", end - 17 * docs)
        self.starts = part(blocks, "<u8", end - 17 * docs - 8 * blocks).astype(np.int64) + len(MAGIC)

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids from first up to last, from the blocks that hold them alone."""
        last = self.meta["ids"] if last is None else min(last, self.meta["ids"])
        a = first // BLOCK
        return decode_blocks(self.data, self.starts[a : -(-last // BLOCK)])[first - a * BLOCK : last - a * BLOCK]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the files and returns their manifest: part, seq, path, docs, ids."""
    tune(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        store, root = open_fs(folder)
        store.create_dir(root, recursive=True)
        held: list[tuple[np.ndarray, ...]] = []
        enc = encoder(tokenizer, CACHED)

        def flush():
            ids, keys, nulls, lengths = (np.concatenate(x) for x in zip(*held, strict=True))
            path = f"{root}/ids-{part:06d}-{seq:06d}-{uuid.uuid4().hex}.pfor"
            with store.open_output_stream(path) as out:
                for x in file_bytes(ids, keys, nulls, lengths):
                    out.write(x)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "path": [path], "docs": pa.array([len(keys)], pa.int64()), "ids": pa.array([len(ids)], pa.int64())})

        for batch in batches:
            for piece in slices(batch, "text", PART_BYTES):
                ids, bounds = with_end(*enc.encode(piece.column("text")), end_id)
                keys = piece.column("doc_id")
                held.append((ids, keys.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(keys.is_null().to_numpy(zero_copy_only=False)), np.diff(bounds)))
                if sum(len(x[0]) for x in held) >= file_ids:
                    yield flush()
                    held, seq = [], seq + 1
        if held:
            yield flush()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return hold(ordered.mapInArrow(run, "part int, seq int, path string, docs long, ids long"), "token-manifest")


def placed_files(manifest: DataFrame) -> DataFrame:
    """The manifest with each file's first id in the whole set.

    The driver adds up the range partitions (as many as the cluster has shuffle partitions); files are counted in
    their own partition's order.
    """
    from pyspark.sql import Window

    parts = sorted((r.part, r.ids) for r in manifest.groupBy("part").agg(F.sum("ids").alias("ids")).collect())
    sums = np.concatenate([[0], np.cumsum([n for _, n in parts])])
    bases = manifest.sparkSession.createDataFrame([(p, int(s)) for (p, _), s in zip(parts, sums[:-1], strict=True)], "part int, _base long")
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.join(F.broadcast(bases), "part").withColumn("start", F.col("_base") + F.coalesce(F.sum("ids").over(before), F.lit(0))).drop("_base")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and the ids' checksum of every document of the files, a file at a time."""

    def run(batches):
        store, _ = open_fs(folder)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with store.open_input_file(path) as f:
                    found = TokenFile(f.read())
                raw = memoryview(found.ids().astype("<u4").tobytes())
                ends = np.cumsum(found.lengths)
                begins = ends - found.lengths
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(found.keys, mask=found.nulls.astype(bool)), pa.array(begins + start), pa.array(found.lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = manifest.sparkSession.sparkContext.defaultParallelism
    files = placed_files(manifest).select("path", "start").repartition(max(n, 8))
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    folder = shared_dir(spark, "token-files")
    manifest = write_token_files(read_table(spark, sf_dir, "documents"), folder, tokenizer or default_tokenizer())
    return read_token_files(manifest, folder)
