"""Exact top-k search by tiled matrix products.

Queries are written to the shared folder in blocks. A task takes its candidates in shards of SHARD_VALUES components, cuts
each into tiles of a matrix, goes through the query blocks one after another, multiplies block and tile, takes each
query's best of the tile by partial selection and merges it into the block's running lists. Per shard and query one list of
at most k leaves the task; lists are merged in a tree whose nodes take the shards of FAN_IN tasks, so no task ever holds
more than their lists of a query, and a task's memory is bounded by a shard and a tile.

Components are scaled to integers floor(scale * x); products of doubles are exact while every sum stays below 2**53,
which is checked per tile, and a tile beyond it is multiplied with Python's integers. Scores outside 64 bits are held at
the nearest end of the range.

Rows are told apart by a number of their own, so repeated vec_ids are queries and candidates of their own, and a row is no
candidate of itself alone.

Defined results: vectors that are null, or hold null or non-finite components (scaled ones too), or are of another length
than the query, take no part; rows with a null vec_id take no part; every row of a repeated vec_id that is asked has its own
ranks, under one query_id; ties go to the smaller vec_id, then to the earlier row; an empty table gives no rows; other
columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.llm.common import numbered, read_block, read_table, shared_dir, tune, write_blocks

K = 5
SCALE = 256.0
#: Queries in a block and candidates in a tile; their product of doubles takes 64 MB at most.
QUERY_BLOCK = 2048
TILE = 4096
#: Components of the candidates that a task holds at a time, as doubles.
SHARD_VALUES = 8_000_000
#: Tasks whose lists of a query one node of the merge tree takes.
FAN_IN = 32

LISTS = "query_id long, query_row long, shard long, vec_ids array<long>, rows array<long>, scores array<long>"
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def _matrix(vectors: pa.Array, scale: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and scaled vectors (doubles), by length, of those that take part."""
    out = {}
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64), nan=-1).astype(np.int64)
    starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    for d in np.unique(sizes[sizes >= 0]).tolist():
        rows = np.flatnonzero(sizes == d)
        m = values[starts[rows][:, None] + np.arange(d)] if d else np.zeros((len(rows), 0))
        fine = np.isfinite(m).all(axis=1)
        with np.errstate(over="ignore"):
            m = np.floor(scale * m[fine])
        whole = np.isfinite(m).all(axis=1)
        out[d] = rows[fine][whole], m[whole]
    return out


def _products(queries: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """Inner products as int64; exact."""
    d = queries.shape[1]
    if not d:
        return np.zeros((len(queries), len(tile)), np.int64)
    if np.abs(queries).max(initial=0) * np.abs(tile).max(initial=0) * d < 2**53:
        return (queries @ tile.T).astype(np.int64)
    as_int = lambda m: np.array([[int(x) for x in r] for r in m], dtype=object)
    exact = as_int(queries) @ as_int(tile).T
    return np.array([[min(HIGH, max(LOW, x)) for x in r] for r in exact], np.int64)


def best_of(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k highest scores, of equal ones the first columns; rows ascend.

    Partial selection finds each row's k-th score; all above it are in, and of those that equal it the first ones."""
    m = scores.shape[1]
    if m <= k:
        return np.nonzero(np.ones(scores.shape, bool))
    bound = np.partition(scores, m - k, axis=1)[:, m - k, None]
    picked = scores > bound
    equal = scores == bound
    room = k - picked.sum(axis=1, dtype=np.int32)
    picked |= equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= room[:, None])
    return np.nonzero(picked)


def merged(lists: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """The k best entries (query, id, row, score) of each query, in order."""
    query, ids, rows, scores = (np.concatenate(x) for x in zip(*lists, strict=True))
    order = np.lexsort((rows, ids, ~scores, query))  # ~x falls as x grows and never overflows
    query = query[order]
    nth = np.arange(len(query)) - np.searchsorted(query, query)
    keep = order[nth < k]
    return query[nth < k], ids[keep], rows[keep], scores[keep]


def block_best(q: np.ndarray, q_rows: np.ndarray, ids: np.ndarray, rows: np.ndarray, m: np.ndarray, k: int, tile: int = TILE) -> tuple[np.ndarray, ...]:
    """The k best candidates (ids and rows, sorted by both; vectors m) of each query but its own row, as of merged()."""
    empty = np.zeros(0, np.int64)
    best = (empty, empty, empty, empty)
    for a in range(0, len(ids), tile):
        scores = _products(q, m[a : a + tile])
        i, j = best_of(scores, k + 1)  # one more, as the query's own row may be among them
        other = rows[a + j] != q_rows[i]
        i, j = i[other], j[other]
        best = merged([best, (i, ids[a + j], rows[a + j], scores[i, j])], k)
    return best


def top_k(vectors: DataFrame, asked: str, k: int = K, scale: float = SCALE, key: str = "vec_id", vector: str = "embedding", fan_in: int = FAN_IN, query_block: int = QUERY_BLOCK, shard_values: int = SHARD_VALUES) -> DataFrame:
    """query_id, rank, vec_id, score of the k highest inner products of each query with all other rows. asked: the SQL
    condition on `vec_id` (the key) that says which rows are queries."""
    spark = vectors.sparkSession
    tune(spark)
    shape = [F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")]
    fit = "vec_id IS NOT NULL AND vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
    table = numbered(vectors.select(*shape).where(fit))
    folder = shared_dir(spark, "query-blocks")
    files = write_blocks(table.where(asked), folder, most_rows=query_block)

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()

        def searched(held: dict[int, list]):
            shard = {}
            for d, parts in held.items():
                ids, rows, m = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.lexsort((rows, ids))
                shard[d] = ids[order], rows[order], m[order]
            for path in files:
                asked_rows = read_block(folder, path)
                names = asked_rows.column("vec_id").to_numpy(), asked_rows.column("_row").to_numpy()
                for d, (at, q) in _matrix(pa.concat_arrays(asked_rows.column("vector").chunks), scale).items():
                    if d not in shard or not len(at):
                        continue
                    query, *found = block_best(q, names[1][at], *shard[d], k)
                    if not len(query):
                        continue
                    starts = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
                    offsets = pa.array(np.append(starts, len(query)), pa.int32())
                    ids, rows, scores = (pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in found)
                    who = at[query[starts]]
                    yield pa.RecordBatch.from_arrays([pa.array(names[0][who]), pa.array(names[1][who]), pa.array(np.full(len(who), number)), ids, rows, scores], names=["query_id", "query_row", "shard", "vec_ids", "rows", "scores"])

        held: dict[int, list] = {}
        size = 0
        for batch in batches:
            ids, rows = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "_row"))
            for d, (at, m) in _matrix(batch.column("vector"), scale).items():
                if len(at):
                    held.setdefault(d, []).append((ids[at], rows[at], m))
                    size += m.size
            if size >= shard_values:
                yield from searched(held)
                held, size = {}, 0
        if held:
            yield from searched(held)

    lists = table.mapInArrow(run, LISTS)
    entry = F.transform(F.arrays_zip("vec_ids", "rows", "scores"), lambda x: F.struct(F.bitwise_not(x["scores"]).alias("down"), x["vec_ids"].alias("vec_id"), x["rows"].alias("row"), x["scores"].alias("score")))
    tree = lists.select("query_id", "query_row", "shard", entry.alias("best"))
    shards = max(1, table.rdd.getNumPartitions())
    while True:
        tree = tree.groupBy("query_id", "query_row", F.floor(F.col("shard") / fan_in).alias("shard")).agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
        shards = -(-shards // fan_in)
        if shards <= 1:
            break
    return tree.select("query_id", F.posexplode("best").alias("_n", "_x")).select("query_id", (F.col("_n") + 1).cast("int").alias("rank"), F.col("_x.vec_id").alias("vec_id"), F.col("_x.score").alias("score"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id % 50 = 0")


OP2_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.n AS query, q.vec_id AS query_id, c.n, c.vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.n <> q.n AND len(q.w) = len(c.w))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id, n) AS rank FROM s) WHERE rank <= 5
"""
