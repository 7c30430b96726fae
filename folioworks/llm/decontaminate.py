"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as lower-case letters and digits with single blanks. A benchmark item of m characters may differ by
k = floor(ERROR_RATE * m) edits; cut into k + 1 pieces, at least one piece occurs unchanged in any text that holds the item
within k edits. All pieces of all items are found at once by an Aho-Corasick automaton; around each hit, Myers'
bit-parallel algorithm computes the least edit distance of the item to any part of the text there.

The benchmark reaches the workers as files of the shared folder, blocks of at most BLOCK_BYTES, about; the corpus is read
once per block, each task goes through its texts alone and nothing of the corpus is shuffled. The driver holds one path per
block.

Defined results: null and empty texts hold nothing; items without letters or digits take no part; items too short for
an edit (below 1 / ERROR_RATE characters) must occur unchanged, as whole words; repeated documents are reported one by one;
repeated items by their own item_ids; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.llm.common import code_points, hold, numbered, read_block, read_table, shared_dir, slices, texts_of, tune, worker_state, write_blocks

ERROR_RATE = 0.08
#: Characters of benchmark text that workers hold at a time, about.
BLOCK_BYTES = 8 << 20
#: Bytes of leaked keys up to which they are broadcast to the texts.
BROADCAST_BYTES = 32 << 20


def fold_table() -> np.ndarray:
    """The folded character of each code point: lower-case letters and digits stay, all else is a blank."""
    state = worker_state("decontaminate")
    if "fold" not in state:
        table = np.full(0x110000, 32, np.uint32)
        kept = np.fromiter((c for c in range(0x110000) if chr(c).isalnum()), np.int64)
        table[kept] = np.fromiter((ord(chr(c).lower()[0]) for c in kept), np.uint32, len(kept))
        state["fold"] = table
    return state["fold"]


def folded(text: str, bounds: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """The folded texts, a separator after each; where each begins in it; and each folded character's place in text."""
    codes = code_points(text)
    ends = bounds[1:]
    out = fold_table()[codes] if len(codes) else np.zeros(0, np.uint32)
    # A separator goes in after each text: as if each text had one more character.
    place = np.insert(np.arange(len(codes)), ends, ends)
    out = np.insert(out, ends, 10)
    blank = out == 32
    edge = np.ones(len(out), bool)
    edge[1:] = blank[:-1] | (out[:-1] == 10)
    keep = ~(blank & edge)
    keep[:-1] &= ~(blank[:-1] & (out[1:] == 10))
    out, place = out[keep], place[keep]
    return out.tobytes().decode("utf-32-le", "surrogatepass"), np.concatenate([[0], np.flatnonzero(out == 10) + 1]), place


def fold(text: str) -> str:
    return folded(text, np.array([0, len(text)]))[0][:-1]


def budget(m: int, rate: float = ERROR_RATE) -> int:
    return math.floor(rate * m)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of the item, as equal as can be, with their starts."""
    cuts = [round(i * len(item) / (k + 1)) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def symbol_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(masks: dict[str, int], m: int, window: str, k: int) -> tuple[int, int]:
    """The least edit distance of the item to any part of window, and that part's end; (k + 1, 0) if it exceeds k."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end, left = min(m, k + 1), 0, len(window)
    for i, c in enumerate(window):
        equal = masks.get(c, 0)
        vertical = equal | minus
        across = (((equal & plus) + plus) ^ plus) | equal
        up = minus | ~(across | plus) & full
        down = plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = up << 1 & full  # the item may begin anywhere
        down = down << 1 & full
        plus = down | ~(vertical | up) & full
        minus = up & vertical
        if score < best:
            best, end = score, i + 1
            if not best:
                break
        left -= 1
        if score - left > best:
            break
    return best, end


class Matcher:
    """The automaton and the masks of a block of items."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [(key, f) for key, text in items if (f := fold(text))]
        self.masks: dict[int, dict[str, int]] = {}
        self.k = [budget(len(f), rate) for _, f in self.items]
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (_, f) in enumerate(self.items):
            for start, piece in pieces(f, self.k[n]):
                found.setdefault(piece, []).append((n, start))
        self.words = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.words.add_word(piece, (len(piece), uses))
        if found:
            self.words.make_automaton()

    def verify(self, n: int, window: str) -> tuple[int, int]:
        if n not in self.masks:
            self.masks[n] = symbol_masks(self.items[n][1])
        return myers(self.masks[n], len(self.items[n][1]), window, self.k[n])

    def search(self, text: str, begins: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text number, item number, distance, start, end) of the best part of each text for each item within its
        budget; start and end in the folded texts. begins: as of folded()."""
        if not self.items:
            return []
        spots: dict[tuple[int, int], list[int]] = {}
        hits = [(end - size + 1, uses) for end, (size, uses) in self.words.iter(text)]
        docs = (np.searchsorted(begins, np.array([h[0] for h in hits], np.int64), "right") - 1).tolist()
        for (at, uses), doc in zip(hits, docs, strict=True):
            for n, start in uses:
                spots.setdefault((doc, n), []).append(at - start)
        out = []
        for (doc, n), diagonals in spots.items():
            item, k = self.items[n][1], self.k[n]
            low, high = int(begins[doc]), int(begins[doc + 1]) - 1
            best = (k + 1, 0, 0)
            upto = None
            for d in sorted(set(diagonals)):
                if k == 0:
                    a, b = d, d + len(item)
                    whole = (a == low or text[a - 1] == " ") and (b == high or text[b] == " ")
                    if whole and text[a:b] == item and best[0]:
                        best = (0, a, b)
                    continue
                if upto is not None and d <= upto:
                    continue  # the last window holds all of this one
                a, b = max(low, d - k), min(high, d + len(item) + 2 * k)
                upto = d + k  # windows reach k beyond the diagonals up to here
                distance, end = self.verify(n, text[a:b])
                if distance < best[0]:
                    best = (distance, self.begin(n, text, a, a + end, distance), a + end)
            if best[0] <= k:
                out.append((doc, n, *best))
        return out

    def begin(self, n: int, text: str, low: int, end: int, distance: int) -> int:
        """Where the part that ends at end begins: the same search backwards."""
        item = self.items[n][1][::-1]
        back = text[max(low, end - len(item) - distance) : end][::-1]
        # The distance of the item to each prefix of back, by Myers with a fixed start.
        masks, m = symbol_masks(item), len(item)
        full, top = (1 << m) - 1, 1 << (m - 1)
        plus, minus, score = full, 0, m
        best, size = m, 0
        for i, c in enumerate(back):
            equal = masks.get(c, 0)
            vertical = equal | minus
            across = (((equal & plus) + plus) ^ plus) | equal
            up = minus | ~(across | plus) & full
            down = plus & across
            score += bool(up & top) - bool(down & top)
            up = (up << 1 | 1) & full
            down = down << 1 & full
            plus = down | ~(vertical | up) & full
            minus = up & vertical
            if score < best:
                best, size = score, i + 1
        return end - size


def matcher(folder: str, path: str, rate: float) -> Matcher:
    """The matcher of a block's file; a worker keeps the last one."""
    state = worker_state("decontaminate")
    if state.get("path") != (path, rate):
        block = read_block(folder, path)
        items = zip(block.column("item_id").to_pylist(), block.column("text").to_pylist(), strict=True)
        state["path"], state["matcher"] = (path, rate), Matcher(sorted(items, key=lambda x: (x[0] is None, x)), rate)
    return state["matcher"]


MATCHES = "doc_id long, item_id long, distance int, item_chars int, start long, end long"


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per document and item found in it within the item's budget: the least distance and the part's span in the
    document's own text (code points)."""
    spark = docs.sparkSession
    tune(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    folder = shared_dir(spark, "benchmark")
    paths = write_blocks(items.repartition(max(1, math.ceil(total / block_bytes))), folder, most_bytes=block_bytes)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def search(path: str) -> DataFrame:
        def run(batches):
            own = matcher(folder, path, rate)
            for batch in batches:
                for part in slices(batch, "text"):
                    whole, bounds = texts_of(part.column("text"))
                    flat, begins, place = folded(whole, bounds)
                    ids = part.column("doc_id").to_pylist()
                    found = [(ids[d], own.items[n][0], dist, len(own.items[n][1]), int(place[a] - bounds[d]), int(place[b - 1] + 1 - bounds[d])) for d, n, dist, a, b in own.search(flat, begins)]
                    if found:
                        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "distance", "item_chars", "start", "end"])

        return rows.mapInArrow(run, MATCHES)

    return reduce(DataFrame.unionByName, map(search, paths)) if paths else spark.createDataFrame([], MATCHES)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows that hold no benchmark item; each goes or stays by its own text, whatever its doc_id. The leaked rows'
    numbers are broadcast up to broadcast_bytes, else the texts are shuffled once to meet them."""
    rows = numbered(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    leaked = hold(matches(rows, read_table(spark, sf_dir, "benchmark"), key="_row").select(F.col("doc_id").alias("_leaked")).distinct(), "leaked")
    side = F.broadcast(leaked) if leaked.count() * 16 <= broadcast_bytes else leaked
    return rows.join(side, rows["_row"] == side["_leaked"], "left_anti").select("doc_id", "text", "lang", "source", "n_chars")
