"""Packing of token streams into fixed-length sequences by cutting-stock column generation.

A document's ids and an end id are cut into whole sequences and a rest, so each piece is at most one sequence long.
Pieces fall into length classes (a class per `grain` tokens); their histogram has a bounded number of entries. A linear
program over patterns (numbers of each class that fit a sequence together) is solved by column generation: duals price
the classes, a knapsack dynamic program finds the best new pattern, and the simplex takes it in. Whole parts of the
solution are kept, what rounding leaves is filled largest first into patterns of its own. Pieces are ranked within their
class and a piece's rank picks its pattern copy, so documents never reach the driver.

Where the rounded program needs more sequences than first-fit decreasing alone (small tables, where rounding is dear), the
latter's patterns are taken; the column `by_program` of the result says of each piece whether the program chose its pattern.

Defined results: a null or empty text is the end id alone; a null doc_id is a value like others; repeated rows are packed
one by one; ties of length are ranked by doc_id, start and checksum, and rows equal in these in any order, which changes
nothing; a very long text is cut like any other; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioworks.llm.common import hold, read_table, slices, tune
from folioworks.llm.tokens import encoder, with_end

SEQUENCE = 2048
#: Tokens per length class. Sequences lose half a grain per piece on average.
GRAIN = 8
END_ID = 1
#: Parts of a length class that are ranked apart, so that no task ranks a whole class.
RANK_PARTS = 256

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
PIECES_SQL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document: full sequences from its start and a rest. One pass, nothing is shuffled."""
    tune(docs.sparkSession)

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, bounds = with_end(*enc.encode(part.column("text")), end_id)
                sizes = np.diff(bounds)
                counts = -(-sizes // sequence)
                doc = np.repeat(np.arange(len(sizes)), counts)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = nth * sequence
                length = np.minimum(sequence, sizes[doc] - start)
                raw, at = memoryview(ids.astype("<u4").tobytes()), bounds[:-1][doc] + start
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(sizes[doc])], schema=PIECES)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, PIECES_SQL)


def knapsack(values: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """The best multiset of sizes 1..len(values) within capacity, by dynamic programming over the capacity."""
    n = len(values)
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        m = min(c, n)
        total = values[:m] + best[c - 1 :: -1][:m]
        k = int(total.argmax())
        if total[k] > best[c - 1] + 1e-12:
            best[c], pick[c] = total[k], k + 1
        else:
            best[c] = best[c - 1]
    out: dict[int, int] = {}
    c = capacity
    while c > 0:
        if pick[c]:
            out[int(pick[c])] = out.get(int(pick[c]), 0) + 1
            c -= int(pick[c])
        else:
            c -= 1
    return float(best[capacity]), out


def greedy_patterns(demand: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """First-fit decreasing, a pattern at a time: the largest sizes that fit, as often as all of them are left."""
    left = {s: n for s, n in sorted(demand.items(), reverse=True) if n > 0}
    out = []
    while left:
        pattern, room = {}, capacity
        for s, n in left.items():
            if k := min(n, room // s):
                pattern[s] = k
                room -= k * s
        times = min(left[s] // k for s, k in pattern.items())
        out.append((pattern, times))
        for s, k in pattern.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]
    return out


def inverted(m: np.ndarray) -> np.ndarray:
    """The inverse, by Gauss and Jordan with pivots by row, in element-wise steps: the library's threaded one was seen to stand
    still in a driver whose process had been forked before."""
    n = len(m)
    work = np.concatenate([m, np.eye(n)], axis=1)
    for i in range(n):
        at = i + int(np.abs(work[i:, i]).argmax())
        if abs(work[at, i]) < 1e-12:
            raise np.linalg.LinAlgError("singular")
        work[[i, at]] = work[[at, i]]
        work[i] /= work[i, i]
        factor = work[:, i].copy()
        factor[i] = 0.0
        work -= factor[:, None] * work[i]
    return work[:, n:]


def fractional_patterns(demand: dict[int, int], capacity: int, rounds: int = 1500, gap: float = 0.002) -> list[tuple[dict[int, int], float]]:
    """Patterns and their amounts in the linear program: least total amount that covers demand (sizes to counts).

    Revised simplex over the basis inverse. Columns come from a pool that starts with the greedy patterns; when the
    pool has no improving column left, the knapsack prices all patterns and adds the best. Ends when that pattern
    proves the total to be within the share `gap` of the optimum (the total over its worth is a lower bound), after `rounds` pivots,
    or when pivots no longer lower the total.
    """
    sizes = sorted(demand)
    row = {s: i for i, s in enumerate(sizes)}
    m = len(sizes)
    pool = [p for p, _ in greedy_patterns(demand, capacity)]

    def dense(pattern: dict[int, int]) -> np.ndarray:
        column = np.zeros(m)
        column[[row[s] for s in pattern]] = list(pattern.values())
        return column

    columns = np.array([dense(p) for p in pool]).T
    basis: list[dict[int, int]] = [{s: capacity // s} for s in sizes]
    inverse = np.diag(1.0 / np.array([capacity // s for s in sizes]))
    # A trace more of each size, each its own, keeps pivots from going round in ties.
    need = np.array([demand[s] for s in sizes], float) * (1 + 1e-6 * np.random.default_rng(0).random(m))
    amount = inverse @ need
    since, total = 0, np.inf
    for turn in range(rounds):
        duals = inverse.sum(axis=0)
        worths = duals @ columns
        best = int(worths.argmax())
        if worths[best] > 1 + 1e-7:
            pattern, column = pool[best], columns[:, best]
        else:
            values = np.zeros(capacity)
            values[np.array(sizes) - 1] = np.maximum(duals, 0)
            worth, pattern = knapsack(values, capacity)
            if not pattern or worth <= 1 + gap:
                break
            column = dense(pattern)
            pool.append(pattern)
            columns = np.column_stack([columns, column])
        step = inverse @ column
        ratio = np.where(step > 1e-6, amount / np.where(step > 1e-6, step, 1), np.inf)
        if not np.isfinite(least := ratio.min()):
            break
        out = int(np.where(ratio <= least + 1e-9, step, 0).argmax())  # of equal ratios the steadiest pivot
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
        basis[out] = pattern
        if turn % 50 == 49:  # against drift
            try:
                inverse = inverted(np.array([dense(p) for p in basis]).T)
            except np.linalg.LinAlgError:
                break
        amount = np.maximum(inverse @ need, 0)
        if not np.abs(inverse).max() < 1e7:
            break
        if amount.sum() < total * (1 - 1e-5):
            since, total = turn, amount.sum()
        elif turn - since > 100:
            break
    return [(p, float(x)) for p, x in zip(basis, amount, strict=True) if x > 1e-9]


def whole_patterns(demand: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int, bool]]:
    """Patterns, how often each is used, and whether the program chose it, such that all pieces of demand and no others have
    a place. Pieces that fill a sequence count as the program's: they have one pattern."""
    left = {s: n for s, n in demand.items() if n > 0}
    out: list[tuple[dict[int, int], int, bool]] = []
    if full := left.pop(capacity, 0):
        out.append(({capacity: 1}, full, True))
    if left:
        for pattern, x in sorted(fractional_patterns(left, capacity), key=lambda p: -p[1]):
            times = min([int(x + 1e-6), *(left[s] // k for s, k in pattern.items())])
            if times > 0:
                out.append((pattern, times, True))
                for s, k in pattern.items():
                    left[s] -= k * times
    out += [(p, n, False) for p, n in greedy_patterns(left, capacity)]
    plain = [(p, n, False) for p, n in greedy_patterns(demand, capacity)]
    return min(out, plain, key=lambda p: sum(n for _, n, _ in p))


def pattern_table(patterns: list[tuple[dict[int, int], int, bool]]) -> list[tuple[int, ...]]:
    """(class, first rank, end rank, first sequence, pieces of the class per sequence, place in the sequence, by program)."""
    rows, ranks, sequence = [], {}, 0
    for pattern, times, program in patterns:
        place = 0
        for size in sorted(pattern, reverse=True):
            k = pattern[size]
            first = ranks.get(size, 0)
            ranks[size] = first + k * times
            rows.append((size, first, first + k * times, sequence, k, place, int(program)))
            place += k
        sequence += times
    return rows


def pack(pieces: DataFrame, sequence: int = SEQUENCE, grain: int = GRAIN) -> DataFrame:
    """pieces (as of token_pieces) with sequence_id, offset and by_program; pieces must be stored, since they are read twice."""
    spark = pieces.sparkSession
    capacity = sequence // grain
    placed = pieces.withColumn("_class", F.ceil(F.col("length") / grain).cast("int")).withColumn("_part", F.pmod(F.xxhash64("doc_id", "start"), F.lit(RANK_PARTS)).cast("int"))
    # At most capacity * RANK_PARTS rows, whatever the data's size.
    counts = placed.groupBy("_class", "_part").agg(F.count(F.lit(1)).alias("_rows")).collect()
    demand: dict[int, int] = {}
    bases = []
    for r in sorted(counts, key=lambda r: (r["_class"], r["_part"])):
        bases.append((r["_class"], r["_part"], demand.get(r["_class"], 0)))
        demand[r["_class"]] = demand.get(r["_class"], 0) + r["_rows"]
    # Bounded as well: at most capacity patterns from the program and their leftovers, of at most capacity pieces.
    table = sorted(pattern_table(whole_patterns(demand, capacity)))
    base = spark.createDataFrame(bases, "_class int, _part int, _base long")
    cols = [np.array(c, np.int64) for c in zip(*table, strict=True)] if table else [np.zeros(0, np.int64)] * 7
    ranked = placed.join(F.broadcast(base), ["_class", "_part"]).withColumn("_rank", F.col("_base") + F.row_number().over(Window.partitionBy("_class", "_part").orderBy("doc_id", "start", "ids_crc32")) - 1)
    key = cols[0] << 40 | cols[1]

    @F.pandas_udf("seq long, place long, program boolean")
    def locate(size, rank):
        import pandas as pd

        n = rank.to_numpy(np.int64)
        i = np.searchsorted(key, size.to_numpy(np.int64) << 40 | n, "right") - 1
        inner = n - cols[1][i]
        return pd.DataFrame({"seq": cols[3][i] + inner // cols[4][i], "place": cols[5][i] + inner % cols[4][i], "program": cols[6][i] > 0})

    found = ranked.withColumn("_at", locate("_class", "_rank"))
    before = Window.partitionBy("sequence_id").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    return (
        found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("_at.seq").alias("sequence_id"), F.col("_at.place").alias("_place"), F.col("_at.program").alias("by_program"))
        .withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
        .drop("_place")
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return pack(hold(token_pieces(docs, tokenizer or default_tokenizer()), "pieces"))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of docs."""
    return pack(hold(token_pieces(docs, default_tokenizer()), "pieces"))
