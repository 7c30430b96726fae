"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct shingles. Documents with the same set are one node. Two nodes with Jaccard at
least 3/4 differ in at most (a + b) / 7 elements, for sizes a and b.

Sets are dealt into bands of sizes; a set also enters the next band where a partner there is possible. Within a band the
feature domain is cut into parts, parts into groups of n2, and each group contributes the projections of the set on all
subsets of n2 - k2 of its parts: a group in which at most k2 parts differ gives both sets one signature in common. With
at most d differing elements at most d // (k2 + 1) groups are spoiled, so d // (k2 + 1) + 1 + slack groups in which every
subset is non-empty (`alive`) leave 1 + slack signatures in common. A set emits the groups up to its last one needed.

That slack carries the load of frequent content: every set may leave out its `slack` most frequent signatures (one order
for all, by the number of sets that have a signature) and still meets each partner in one that both keep. Passages
that many documents share so drop out by themselves, without a cap; what is left are groups of near copies.

Nodes that share a kept signature, directly or through others, are a cluster; no link leaves a cluster. Clusters are
verified in tiles: a cluster within TILE nodes is one tile; a larger one is cut into bands of sizes whose partners lie in
the same or the next band, and bands into blocks, and each pair of blocks is a tile. A tile's task shingles the texts anew,
counts all intersections at once (a matrix product for elements in many sets, pair counts for the rest) and gives a
spanning set of its links, so no pair is ever a row and memory is bounded by a tile.

Sets too thin for a band's parts (too few alive groups) also use a second family with parts for single elements, and sets
too thin for that one a third, whose signatures are their elements. A pair is met in the first family in which either is
thick enough, and in the third if both are thin in the other two: linked sets have elements in common.

Words are 64-bit hashes, long ones by BLAKE2b. A set's key has 64 bits; a second, independent key of each set shows where
two sets have one key, and those few sets take the second key instead.

Defined results: null texts and texts without words have the empty set, 0 shingles, and only themselves; null doc_ids
have component null and link with nothing; repeated rows, also of one doc_id, are returned one by one; an empty table
gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioworks.llm.common import Scratch, code_points, hold, mix, numbered, range_hashes, read_table, slices, texts_of, tune, worker_state
from folioworks.llm.graph import components, with_least

WORDS = 5
#: Similarity at which documents link, in hundredths.
PERCENT = 75
#: Bands of sizes [2**i, 2**(i+1)).
BANDS = 32
#: Up to this upper size a band uses groups of 3 parts and subsets of 2; beyond it groups of 1.
SUBSET_SIZES = 64
#: Up to this upper size passages weigh much, and a band has fine parts and much slack.
SHORT_SIZES = 512
#: Nodes and elements of a block; a tile has two.
TILE, TILE_ELEMENTS = 1024, 2_000_000
#: Sets of a tile from which an element is counted by a matrix product.
FREQUENT = 64
#: Signatures that a reduce task holds, about: 250 MB with its copies.
PART_SIGNATURES = 4_000_000
#: Characters from which a word's hash is a digest.
LONG_WORD = 32
#: Signatures that a task holds before it deals them out.
FLUSH = 400_000
#: Bytes of node keys up to which they are broadcast to the scan of the texts.
BROADCAST_BYTES = 32 << 20

_COEFFICIENTS = mix(np.arange(101, 101 + WORDS, dtype=np.uint64)) | np.uint64(1)
_SPACES = np.zeros(128, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    text, bounds = texts_of(column)
    codes = code_points(text).copy()
    upper = (codes >= 65) & (codes <= 90)
    codes[upper] += 32
    space = np.ones(len(codes) + 1, bool)
    space[:-1] = _SPACES[np.minimum(codes, 127)] & (codes < 128)
    first = np.zeros(len(codes) + 1, bool)
    first[bounds] = True
    word = ~space[:-1]
    starts = np.flatnonzero(word & (np.concatenate([[True], space[:-2]]) | first[:-1])) if len(codes) else np.zeros(0, np.int64)
    ends = np.flatnonzero(word & (space[1:] | first[1:])) + 1 if len(codes) else np.zeros(0, np.int64)
    hashes = range_hashes(codes, starts, ends) if len(codes) else np.zeros(0, np.uint64)
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        hashes[i] = digest(codes[starts[i] : ends[i]].tobytes())
    at = np.searchsorted(starts, bounds)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(hashes) - WORDS + 1), np.uint64)
        for j in range(WORDS if len(rolled) else 0):
            rolled += hashes[j : j + len(rolled)] * _COEFFICIENTS[j]
        rolled = mix(rolled)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            n = b - a
            if n >= WORDS:
                yield np.unique(rolled[a : b - WORDS + 1])
            elif n:
                yield mix(np.array([(hashes[a:b] * _COEFFICIENTS[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


#: Salts of a set's first and second key.
KEY_SALTS = (0xA5A5A5A5, 0x3C6EF372FE94F82B)


def set_key(elements: np.ndarray, which: int = 0) -> int | None:
    """One of two independent 64-bit keys (signed) of a set; None of the empty one."""
    if not len(elements):
        return None
    with np.errstate(over="ignore"):
        total = mix(elements ^ np.uint64(KEY_SALTS[which])).sum(dtype=np.uint64) + np.uint64(len(elements))
        return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def node_of(elements: np.ndarray, shared: frozenset[int] = frozenset()) -> int | None:
    """The set's first key; the second one where the first is in `shared`, the keys that stand for several sets."""
    key = set_key(elements)
    return set_key(elements, 1) if key in shared else key


def most_differences(size: int) -> int:
    """The most elements in which a linked partner of a set of this size can differ from it."""
    partner = 100 * size // PERCENT
    return (100 - PERCENT) * (size + partner) // (100 + PERCENT)


class Scheme:
    """The parts of a band in one of the two families."""

    def __init__(self, band: int, fine: bool):
        self.upper = 1 << (band + 1)
        self.n2, self.k2 = (1, 0) if fine or self.upper > SUBSET_SIZES else (3, 1)
        short = self.upper <= SHORT_SIZES
        parts = 64 * self.upper if fine else math.ceil(self.upper / (1.25 if short else 2))
        self.groups = -(-parts // self.n2)
        self.seed = np.uint64(mix(np.array([band * 2 + fine + 1], np.uint64))[0])
        self.slack = min(65535, max(1, math.ceil((0.2 if short else 0.05) * self.upper / (self.k2 + 1))))
        self.subsets = list(combinations(range(self.n2), self.n2 - self.k2))

    def signatures(self, elements: np.ndarray) -> tuple[np.ndarray, int, bool]:
        """The set's signatures, its slack, and whether it is thick enough to be sure of meeting every partner here. A thin
        set gives all it has and leaves nothing out, so that thick partners meet it."""
        with np.errstate(over="ignore"):
            mixed = mix(elements ^ self.seed)
            part = ((mixed >> np.uint64(32)) * np.uint64(self.groups * self.n2) >> np.uint64(32)).astype(np.int64)
            sums = np.zeros(self.groups * self.n2, np.uint64)
            np.add.at(sums, part, mix(mixed))
            sums = sums.reshape(self.groups, self.n2)
            filled = sums != 0
            alive = np.flatnonzero(filled.sum(axis=1) > self.k2)
            need = most_differences(len(elements)) // (self.k2 + 1) + 1
            thick = len(alive) >= need
            slack = min(self.slack, len(alive) - need) if thick else 0
            upto = int(alive[need + slack - 1]) + 1 if slack == self.slack else self.groups
            group = np.arange(upto, dtype=np.uint64)
            out = []
            for i, subset in enumerate(self.subsets):
                chosen = list(subset)
                some = filled[:upto, chosen].any(axis=1)
                total = np.zeros(upto, np.uint64)
                for j in chosen:
                    total = mix(total + sums[:upto, j])
                out.append(mix(total + group * np.uint64(8) + np.uint64(i) ^ self.seed)[some])
            return np.concatenate(out), slack, thick


def scheme(band: int, fine: bool) -> Scheme:
    state = worker_state("jaccard")
    if (band, fine) not in state:
        state[band, fine] = Scheme(band, fine)
    return state[band, fine]


def bands_of(size: int) -> list[int]:
    """The bands of a set: its own, and the next where a partner there is possible."""
    band = size.bit_length() - 1
    return [band, band + 1] if 100 * size // PERCENT >= 1 << (band + 1) else [band]


def set_signatures(elements: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(family and band, slack, signatures); none for sets so small that no other set can link."""
    if most_differences(len(elements)) < 1:
        return []
    out = []
    for band in bands_of(len(elements)):
        for fine in (False, True):
            found, slack, thick = scheme(band, fine).signatures(elements)
            out.append((band + BANDS * fine, slack, found))
            if thick:
                break
        else:
            out.append((band + 2 * BANDS, 0, mix(elements ^ mix(np.array([band + 2 * BANDS], np.uint64))[0])))
    return out


def sets_table(docs: DataFrame) -> DataFrame:
    """doc_id, both keys of the set, and n_shingles of every document."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                keys, sizes = [], []
                for e in shingle_sets(part.column("text")):
                    keys.append((set_key(e), set_key(e, 1)))
                    sizes.append(len(e))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(k, pa.int64()) for k in zip(*keys, strict=True)), pa.array(sizes, pa.int64())], names=["doc_id", "first", "second", "n_shingles"])

    return docs.mapInArrow(run, "doc_id long, first long, second long, n_shingles long")


def shared_keys(table: DataFrame) -> frozenset[int]:
    """The first keys that stand for several sets: about n * n / 2**65 of n sets, none below a billion or so."""
    found = table.where("first IS NOT NULL").groupBy("first").agg(F.min("second").alias("a"), F.max("second").alias("b")).where("a <> b")
    return frozenset(r["first"] for r in found.select("first").collect())


class _Dealer:
    """Collects signatures and deals them to reduce partitions as packed arrays."""

    def __init__(self, parts: int, shared: frozenset[int] = frozenset()):
        self.parts, self.shared, self.seen = parts, shared, set()
        self.clear()

    def clear(self) -> None:
        self.nodes, self.kinds, self.slacks, self.signatures, self.sizes, self.count = [], [], [], [], [], 0

    def add(self, elements: np.ndarray) -> None:
        node = node_of(elements, self.shared)
        if node is None or node in self.seen:
            return
        self.seen.add(node)
        for kind, slack, signatures in set_signatures(elements):
            self.nodes.append(node)
            self.kinds.append(kind)
            self.slacks.append(slack)
            self.signatures.append(signatures)
            self.sizes.append(len(signatures))
            self.count += len(signatures)

    def full(self) -> bool:
        return self.count >= FLUSH or len(self.nodes) >= 60_000

    def flush(self) -> pa.RecordBatch | None:
        if not self.count:
            return None
        nodes, kinds, slacks = np.array(self.nodes, np.int64), np.array(self.kinds, np.uint8), np.array(self.slacks, np.uint16)
        owner = np.repeat(np.arange(len(nodes), dtype=np.uint16), self.sizes)
        signatures = np.concatenate(self.signatures)
        part = ((signatures >> np.uint64(32)) * np.uint64(self.parts) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], np.arange(self.parts + 1))
        out = ([], [], [], [], [], [])
        for p, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            if a == b:
                continue
            mine = order[a:b]
            used, local = np.unique(owner[mine], return_inverse=True)
            # Six bytes of a signature; the partition has the rest of its worth, and what falls together is verified.
            short = np.ascontiguousarray(signatures[mine].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
            for column, value in zip(out, (p, nodes[used].tobytes(), kinds[used].tobytes(), slacks[used].tobytes(), local.astype(np.uint16).tobytes(), short.tobytes()), strict=True):
                column.append(value)
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], names=["part", "nodes", "kinds", "slacks", "owners", "signatures"])


def dealt_signatures(docs: DataFrame, parts: int, shared: frozenset[int] = frozenset()) -> DataFrame:
    """Packed signatures of all sets, each set once per task, by reduce partition."""

    def run(batches):
        dealer = _Dealer(parts, shared)
        for batch in batches:
            for piece in slices(batch, "text"):
                for e in shingle_sets(piece.column("text")):
                    dealer.add(e)
                    if dealer.full():
                        yield dealer.flush()
        if (last := dealer.flush()) is not None:
            yield last

    return docs.select("text").mapInArrow(run, "part int, nodes binary, kinds binary, slacks binary, owners binary, signatures binary")


def shared_signatures(dealt: DataFrame, parts: int) -> DataFrame:
    """A row per set of nodes with a signature in common and node in it: bucket (the set's key), node, kind, slack,
    size (nodes in the set) and times (signatures with this very set of nodes in the reduce partition)."""

    def run(batches):
        nodes, kinds, slacks, signatures = [], [], [], []
        for batch in batches:
            for row in batch.to_pylist():
                own = np.frombuffer(row["owners"], np.uint16)
                raw = np.frombuffer(row["signatures"], np.uint8).reshape(-1, 6)
                whole = np.zeros((len(raw), 8), np.uint8)
                whole[:, :6] = raw
                signatures.append(whole.view("<u8")[:, 0])
                for out, column, kind in ((nodes, "nodes", np.int64), (kinds, "kinds", np.uint8), (slacks, "slacks", np.uint16)):
                    out.append(np.frombuffer(row[column], kind)[own])
        if not signatures:
            return
        signatures = np.concatenate(signatures)
        order = np.argsort(signatures, kind="stable")
        signatures = signatures[order]
        twin = np.zeros(len(order), bool)
        twin[1:] = signatures[1:] == signatures[:-1]
        twin[:-1] |= twin[1:]
        order, signatures = order[twin], signatures[twin]
        nodes, kinds, slacks = (np.concatenate(x)[order] for x in (nodes, kinds, slacks))
        order = np.lexsort((nodes, signatures))
        nodes, kinds, slacks, signatures = (x[order] for x in (nodes, kinds, slacks, signatures))
        new = np.ones(len(nodes), bool)  # copies of a set come from several tasks
        new[1:] = (signatures[1:] != signatures[:-1]) | (nodes[1:] != nodes[:-1])
        nodes, kinds, slacks, signatures = (x[new] for x in (nodes, kinds, slacks, signatures))
        if not len(nodes):
            return
        starts = np.flatnonzero(np.concatenate([[True], signatures[1:] != signatures[:-1]]))
        sizes = np.diff(np.append(starts, len(nodes)))
        with np.errstate(over="ignore"):
            keys = mix(np.add.reduceat(mix(nodes.view(np.uint64)), starts) + kinds[starts].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + sizes.astype(np.uint64))
        keys, at, times = np.unique(keys, return_index=True, return_counts=True)
        fine = sizes[at] > 1
        keys, at, times = keys[fine], at[fine], times[fine]
        for a in range(0, len(keys), 5000):
            first, n = starts[at[a : a + 5000]], sizes[at[a : a + 5000]]
            which = np.repeat(np.arange(len(n)), n)
            rows = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + first[which]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[a : a + 5000][which].view(np.int64)), pa.array(nodes[rows]), pa.array(kinds[rows].astype(np.int32)), pa.array(slacks[rows].astype(np.int64)), pa.array(n[which].astype(np.int64)), pa.array(times[a : a + 5000][which].astype(np.int64))],
                names=["bucket", "node", "kind", "slack", "size", "times"],
            )

    return dealt.repartitionById(parts, F.col("part")).mapInArrow(run, "bucket long, node long, kind int, slack long, size long, times long")


def kept_signatures(shared: DataFrame) -> DataFrame:
    """bucket and node, without each node's `slack` most frequent signatures."""
    whole = shared.groupBy("bucket", "node", "kind").agg(F.max("slack").alias("slack"), F.max("size").alias("size"), F.sum("times").alias("times"))
    upto = Window.partitionBy("node", "kind").orderBy(F.desc("size"), F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    return whole.withColumn("upto", F.sum("times").over(upto)).where("upto > slack").select("bucket", "node", "times")


def tiles(clustered: DataFrame, scratch: Scratch) -> DataFrame:
    """node and the keys of the tiles it takes part in; clustered: node, n and cluster."""
    counts = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("elements"))
    large = (F.col("m") > TILE) | (F.col("elements") > TILE_ELEMENTS)
    # Sizes of linked sets differ by less than 4/3, so by one band at most.
    banded = clustered.join(counts, "cluster").withColumn("band", F.when(large, F.floor(F.log("n") / math.log(100 / PERCENT)).cast("int")).otherwise(F.lit(0)))
    blocks = banded.groupBy("cluster", "band").agg(F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum("n") / TILE_ELEMENTS)).cast("int").alias("blocks"))
    blocks = scratch.hold(blocks, "blocks")
    near = lambda step, name: blocks.select("cluster", (F.col("band") - step).alias("band"), F.col("blocks").alias(name))
    placed = banded.join(blocks, ["cluster", "band"]).join(near(1, "above"), ["cluster", "band"], "left").join(near(-1, "below"), ["cluster", "band"], "left")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    key = lambda band, kind, i, j: F.xxhash64(F.col("cluster"), band, F.lit(kind), i, j)
    keys = F.concat(
        F.transform(upto("blocks"), lambda j: key(F.col("band"), 0, F.least(F.col("block"), j), F.greatest(F.col("block"), j))),
        F.transform(upto("above"), lambda j: key(F.col("band"), 1, F.col("block"), j)),
        F.transform(upto("below"), lambda j: key(F.col("band") - 1, 1, j, F.col("block"))),
    )
    return placed.withColumn("block", block).select("node", keys.alias("tiles"))


def tile_links(nodes: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that span the components of a tile: (least place of the component, place)."""
    m = len(sets)
    sizes = np.array([len(e) for e in sets], np.int64)
    owner = np.repeat(np.arange(m), sizes)
    _, element, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.zeros((m, m), np.int64)
    often = np.flatnonzero(df > FREQUENT)
    for a in range(0, len(often), 2048):
        column = np.full(len(df), -1)
        column[often[a : a + 2048]] = np.arange(len(often[a : a + 2048]))
        at = column[element]
        dense = np.zeros((m, len(often[a : a + 2048])), np.float32)
        dense[owner[at >= 0], at[at >= 0]] = 1
        common += (dense @ dense.T).astype(np.int64)
    some = (df[element] > 1) & (df[element] <= FREQUENT)
    order = np.argsort(element[some], kind="stable")
    who, what = owner[some][order], element[some][order]
    count = df[what]
    first = np.searchsorted(what, what)
    for a in range(0, len(who), 100_000):  # each element's owner with all owners of the element
        n = count[a : a + 100_000]
        other = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - first[a : a + 100_000], n)
        np.add.at(common, (np.repeat(who[a : a + 100_000], n), who[other]), 1)
    linked = (100 * common >= PERCENT * (sizes[:, None] + sizes[None, :] - common)) & (sizes[:, None] > 0)
    np.fill_diagonal(linked, True)
    label = np.arange(m)
    while True:
        least = np.where(linked, label[None, :], m).min(axis=1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    return [(int(label[i]), i) for i in np.flatnonzero(label != np.arange(m)).tolist()]


def verified(tiled: DataFrame, docs: DataFrame, nodes: DataFrame, scratch: Scratch, shared: frozenset[int] = frozenset(), broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Links (u, v) that span the components of all tiles. tiled: node and tiles; nodes: node and doc_id of a document
    with its set. A text travels once per tile of its node; the wanted keys are broadcast up to broadcast_bytes, else the
    texts are shuffled once to meet them."""
    wanted = scratch.hold(tiled.join(nodes, "node").select("node", F.col("doc_id").alias("_doc"), "tiles"), "wanted")
    size = wanted.agg(F.sum(F.lit(64) + 8 * F.size("tiles"))).first()[0] or 0
    side = F.broadcast(wanted) if size <= broadcast_bytes else wanted
    texts = docs.join(side, docs["doc_id"] == side["_doc"]).select("node", "text", F.explode("tiles").alias("tile"))
    rows = texts.repartition("tile").sortWithinPartitions("tile")

    def run(batches):
        def closed():
            found = tile_links(members, sets) if len(members) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([members[i] for i, _ in found], pa.int64()), pa.array([members[j] for _, j in found], pa.int64())], names=["u", "v"])

        current, members, sets = None, [], []
        for batch in batches:
            for part in slices(batch, "text"):
                for tile, node, e in zip(part.column("tile").to_pylist(), part.column("node").to_pylist(), shingle_sets(part.column("text")), strict=True):
                    if tile != current:
                        if members:
                            yield closed()
                        current, members, sets = tile, [], []
                    if node_of(e, shared) == node:  # else another text of a repeated doc_id
                        members.append(node)
                        sets.append(e)
        if members:
            yield closed()

    return scratch.hold(rows.mapInArrow(run, "u long, v long"), "links")


def reduce_parts(nodes: DataFrame, least: int) -> int:
    """Reduce partitions of the signatures: `least`, or more, so that each gets PART_SIGNATURES at most, about. A set of n
    elements has some 0.7 * n + 8 signatures."""
    total = nodes.agg(F.sum(F.col("n") * 0.7 + 8)).first()[0] or 0
    return max(least, math.ceil(total / PART_SIGNATURES))


def linked_components(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of docs (doc_id, text)."""
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = hold(sets_table(docs), "sets")
    scratch = Scratch(spark, "jaccard")
    shared = shared_keys(table)
    table = table.select("doc_id", F.when(F.col("first").isin(*shared), F.col("second")).otherwise(F.col("first")).alias("node") if shared else F.col("first").alias("node"), "n_shingles")
    nodes = scratch.hold(table.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n")), "nodes")
    parts = reduce_parts(nodes, int(spark.conf.get("spark.sql.shuffle.partitions")))
    together = shared_signatures(dealt_signatures(docs.where("doc_id IS NOT NULL"), parts, shared), parts)
    kept = scratch.hold(kept_signatures(together), "kept")
    # Each node of a bucket points at the bucket's least one; a bucket of very many nodes is no task's own.
    stars = with_least(kept.select(F.col("bucket").alias("u"), F.col("node").alias("v"))).where("v <> m")
    clusters = components(stars.select(F.col("m").alias("u"), "v"), scratch)
    whole = clusters.select("node", F.col("component").alias("cluster")).unionByName(clusters.select(F.col("component").alias("node"), F.col("component").alias("cluster")).distinct())
    clustered = scratch.hold(whole.join(nodes, "node").select("node", "n", "cluster"), "clustered")
    groups = components(verified(tiles(clustered, scratch), docs, nodes, scratch, shared, broadcast_bytes), scratch)
    # The smallest doc_id of each component, for the nodes that are not alone with one document.
    rooted = nodes.join(groups, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    least = rooted.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = hold(rooted.join(least, "component").select("node", "component_id"), "found")
    scratch.close()
    return table.join(found, "node", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_components(read_table(spark, sf_dir, "documents"))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row of each component of rows: the one with the smallest doc_id.

    Rows are compared one by one, whatever their doc_ids. A repeated doc_id goes only with the rows that stand for
    others; of rows with one doc_id in a component the one with the smallest hash of its columns stays, of equal rows
    any one. A null doc_id comes last. Rows without words stay."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    rows = numbered(docs.select(*columns))
    later = hold(linked_components(rows.select(F.col("_row").alias("doc_id"), "text"), broadcast_bytes).where("component_id <> doc_id").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("component")), "later")
    members = later.unionByName(later.select(F.col("component").alias("_row"), "component").distinct())
    keys = rows.select("_row", F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.xxhash64(*columns).alias("c"), F.col("_row").alias("d")).alias("place"))
    first = members.join(keys, "_row").groupBy("component").agg(F.min("place").alias("place")).select(F.col("place.d").alias("_row"))
    gone = hold(members.select("_row").join(first, "_row", "left_anti").select(F.col("_row").alias("_gone")), "gone")
    side = F.broadcast(gone) if gone.count() * 16 <= broadcast_bytes else gone
    return rows.join(side, rows["_row"] == side["_gone"], "left_anti").select(*columns)


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
e AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS es FROM w),
s AS (SELECT doc_id, len(es) AS n, unnest(es) AS x FROM e),
l AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
g AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT r.d, g.v FROM r JOIN g ON r.c = g.u)
SELECT e.doc_id, CAST(len(es) AS BIGINT) AS n_shingles, m.c AS component_id
FROM e JOIN (SELECT d, min(c) AS c FROM r GROUP BY d) m ON m.d = e.doc_id
"""
