"""Adversarial and odd inputs: colliding words, thin sets, both sides of size bounds, null and repeated keys, hot keys."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioworks.llm import chat, common, decontaminate, graph, jaccard, langid, packing, quality, sharding, token_files, tokens, warc
from folioworks.llm.packing import default_tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
FLIP = {97: 98, 98: 97}


def doubling_word(n):
    """A word that collides with its complement under polynomial hashes modulo 2**64."""
    w = "a"
    while len(w) < n:
        w += w.translate(FLIP)
    return w[:n]


# Equality --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1024, 2048, 8192])
def test_token_ids_of_colliding_words(n):
    word = doubling_word(n)
    other = word.translate(FLIP)
    codes = common.code_points(word + other)
    a, b = common.range_hashes(codes, np.array([0, n]), np.array([n, 2 * n])).tolist()
    assert a == b  # the hash alone cannot tell them apart
    texts = [word, other, f"{word} {other}", f"x {other} y"]
    ids, bounds = tokens.encoder(default_tokenizer()).encode(pa.array(texts))
    want = [e.ids for e in tokens.encoder(default_tokenizer()).tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids[i:j].tolist() for i, j in zip(bounds[:-1], bounds[1:], strict=True)] == want


def test_colliding_words_do_not_link(spark):
    word = doubling_word(2048)
    rows = [(1, f"{word} x y z w"), (2, f"{word.translate(FLIP)} x y z w"), (3, f"{word} x y z w")]
    got = {r.doc_id: r.component_id for r in jaccard.linked_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_sets_with_one_key_take_their_second(spark):
    rows = [(1, 5, 10, 3), (2, 5, 11, 3), (3, 6, 12, 3), (4, 6, 12, 3), (5, None, None, 0)]
    table = spark.createDataFrame(rows, "doc_id long, first long, second long, n_shingles long")
    assert jaccard.shared_keys(table) == {5}
    e = np.array([1, 2, 3], np.uint64)
    assert jaccard.node_of(e, frozenset({jaccard.set_key(e)})) == jaccard.set_key(e, 1) != jaccard.set_key(e)


# Signatures ------------------------------------------------------------------------------------------------------


def test_a_text_whose_set_falls_into_one_part(spark):
    text = " ".join(f"w56951y{i}" for i in range(7))
    near = " ".join(f"w56951y{i}" for i in range(8))
    rows = [(1, text), (2, near), (3, text)]
    got = {r.doc_id: r.component_id for r in jaccard.linked_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1}  # 3 of 4 shingles in common


def test_small_sets_always_have_signatures_that_meet():
    rng = np.random.default_rng(11)
    for _ in range(20_000):
        n = int(rng.integers(3, 9))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.append(a, rng.integers(0, 2**63, n // 3).astype(np.uint64))) if n % 2 else a[: len(a) - len(a) // 4]
        if 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b)) and len(a) != len(b):
            x, y = ({(k, s) for k, _, sig in jaccard.set_signatures(e) for s in sig.tolist()} for e in (a, b))
            assert x & y


@settings(max_examples=100, deadline=None)
@given(st.integers(3, 8), st.integers(0, 2**32))
def test_third_family_is_the_elements(n, seed):
    """Sets whose elements all fall into one part of both families."""
    band = n.bit_length() - 1
    schemes = [jaccard.scheme(band, fine) for fine in (False, True)]
    rng, found = np.random.default_rng(seed), []
    while len(found) < 1:
        e = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        found.append(e)
    for e in found:
        kinds = {k for k, _, _ in jaccard.set_signatures(e)}
        for b in jaccard.bands_of(n):
            thick = [jaccard.scheme(b, fine).signatures(e)[2] for fine in (False, True)]
            assert (b + 2 * jaccard.BANDS in kinds) == (not any(thick))
    assert len(schemes) == 2


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_both_sides_of_the_broadcast_bounds(spark, tmp_path, broadcast_bytes):
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(60)) for _ in range(12)]
    item = " ".join(f"b{rng.randrange(500)}" for _ in range(30))
    rows = [(i, t, "en", "s", 0) for i, t in enumerate([*base, *base[:5], f"{base[6]} {item}", None, ""])]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    kept = sorted(r.doc_id for r in jaccard.stage_near_duplicates(spark, docs, "", broadcast_bytes).collect())
    assert kept == [*range(12), 17, 18, 19]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert sorted(r.doc_id for r in decontaminate.stage_decontaminate(spark, docs, str(tmp_path), broadcast_bytes).collect()) == [*range(17), 18, 19]
    pages = spark.createDataFrame([(i, "u", "x" * 200 if i % 3 else f"{i}" * 150) for i in range(40)], "page_id long, url string, html string")
    typed = warc.with_types(pages, broadcast_bytes=broadcast_bytes).collect()
    assert {(r.page_id, r.record_type, r.refers_to) for r in typed} == {(i, "revisit", 1) if i % 3 and i != 1 else (i, "response", None) for i in range(40)}


def test_hubs_and_paths_have_their_components(spark):
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    scratch = common.Scratch(spark, "t")
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long").repartition(5), scratch).collect()}
    assert got == {i: 0 for i in range(1, 400)} | {i: 1000 for i in range(1001, 1041)}
    scratch.close()


def test_partitions_grow_with_the_signatures(spark):
    few = spark.createDataFrame([(1, 100)], "node long, n long")
    many = few.select(F.explode(F.sequence(F.lit(1), F.lit(200))), F.lit(1_000_000).alias("n"))
    assert jaccard.reduce_parts(few, 4) == 4 and jaccard.reduce_parts(many, 4) > 30


# Benchmark blocks, token files, shards ----------------------------------------------------------------------------


def test_blocks_repeated_items_and_long_texts(spark):
    rng = random.Random(2)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    items = [(i, text(30)) for i in range(20)]
    items += [(100, items[3][1]), (3, items[3][1])]
    long = text(20_000)
    docs = [(1, f"{long} {items[3][1]}"), (1, f"{long} {items[3][1]}"), (2, items[7][1]), (None, items[8][1]), (3, long)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id long, text string")
    want = sorted([(1, 3), (1, 3), (1, 100)] * 2 + [(2, 7), (None, 8)], key=str)
    for block_bytes in (decontaminate.BLOCK_BYTES, 600):
        found = decontaminate.matches(df, bench, block_bytes=block_bytes).collect()
        assert sorted(((r.doc_id, r.item_id) for r in found), key=str) == want
    assert decontaminate.matches(df, bench.limit(0)).count() == 0 and decontaminate.matches(df.limit(0), bench).count() == 0


def test_token_files_of_null_and_repeated_keys(spark, tmp_path):
    rows = [(None, "b"), (None, "a b"), (5, "x " * 3000), (5, "x " * 3000), (5, None), (-1, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = token_files.read_token_files(token_files.write_token_files(df, str(tmp_path / "t"), default_tokenizer()), str(tmp_path / "t")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, -1, 5, 5, 5] and got[3].n_tokens == 1
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()


def test_written_shards_keep_every_row(spark, tmp_path):
    rows = [(i % 7 if i % 5 else None, f"t{i % 3}" if i % 4 else None, i) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    sharding.write_shards(df, [s % 3 for s in range(64)], str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted((r.extra, r.doc_id) for r in back.select("extra", "doc_id").collect() if True) == sorted(((i, k) for k, _, i in rows))
    placed = sharding.shard(df, n_shards=3, n_slots=64).collect()
    assert len(placed) == 60 and sorted((r.shard, r.slot) for r in placed) == [(s, n) for s in range(3) for n in range(sum(r.shard == s for r in placed))]


def test_a_key_of_a_third_of_all_rows_is_dealt_by_its_texts(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(9)).otherwise(F.col("id")).alias("doc_id"), F.repeat(F.col("id").cast("string"), 20).alias("text"))
    load = {}
    for r in sharding.shard(df, n_shards=4, n_slots=512).collect():
        load[r.shard] = load.get(r.shard, 0) + r["size"]
    assert max(load.values()) - min(load.values()) < 0.02 * sum(load.values())


def test_inverse():
    m = np.random.default_rng(1).normal(size=(40, 40))
    assert np.allclose(packing.inverted(m) @ m, np.eye(40))
    with pytest.raises(np.linalg.LinAlgError):
        packing.inverted(np.ones((3, 3)))


def test_pieces_of_null_and_repeated_keys(spark):
    rows = [(None, "a b c"), (None, "a b c"), (1, "a b c"), (1, None), (1, ""), (2, "word " * 5000)]
    pieces = common.hold(packing.token_pieces(spark.createDataFrame(rows, "doc_id long, text string"), default_tokenizer(), sequence=256), "p")
    got = packing.pack(pieces, sequence=256).collect()
    ends = sorted(r.doc_tokens for r in got if r.start == 0)
    assert len(ends) == 6 and sum(r.length for r in got) == sum(ends) and ends[:2] == [1, 1]
    assert all(r.offset + r.length <= 256 and r.by_program is not None for r in got)
    one = next(r for r in got if r.doc_tokens == 1)
    assert one.ids_crc32 == zlib.crc32(np.array([packing.END_ID], "<u4").tobytes())


# Models ----------------------------------------------------------------------------------------------------------


def test_languages_of_other_scripts(spark):
    """Languages that share no Latin letter, by profiles over their own letters."""
    rng = random.Random(4)
    letters = {"ru": range(0x430, 0x450), "el": range(0x3B1, 0x3CA), "ar": range(0x621, 0x64B), "zh": range(0x4E00, 0x4E60), "ja": range(0x3041, 0x3097)}
    words = {k: ["".join(chr(rng.choice(r)) for _ in range(rng.randrange(2, 6))) for _ in range(80)] for k, r in letters.items()}
    # Two more over the letters of `ru`, told apart by their words alone.
    words |= {f"r{i}": ["".join(chr(rng.choice(letters["ru"])) for _ in range(4)) for _ in range(80)] for i in (1, 2)}
    rows = [(i, " ".join(rng.choices(words[k], k=25)), k) for i, k in enumerate(sorted(words) * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    langs, prototypes = langid.train(df.where("doc_id % 3 > 0"))
    got = {r.doc_id: r.lang_pred for r in langid.predict(df.where("doc_id % 3 = 0"), langs, prototypes).collect()}
    right = sum(got[i] == k for i, _, k in rows if i % 3 == 0)
    assert langs == sorted(words) and right >= 0.98 * len(got)


def test_letter_vectors_are_apart():
    v = langid.letter_vectors(np.array([0, 97, 98, 0x430, 0x431, 0x4E00, 0x20000])).astype(int)
    cosines = v @ v.T / langid.DIMENSIONS
    assert (np.abs(cosines - np.eye(len(v))) < 0.25).all()
    assert (langid.gram_vectors()[1 * 27 * 27 + 2 * 27 + 3] == langid.bound(np.array([[97, 98, 99]]))[0]).all()


def test_languages_of_empty_tables_ties_and_repeats(spark):
    rows = [(1, "abc abc", "aa"), (1, "abc abc", "bb"), (2, "abc", None), (2, "abc", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, prototypes = langid.train(df)
    assert [r.lang_pred for r in langid.predict(df, langs, prototypes).collect()] == ["aa"] * 4  # equal cosines: the first
    assert langid.predict(df.limit(0), langs, prototypes).count() == 0


def test_quality_of_empty_tables_long_texts_and_repeated_labels(spark):
    rng = random.Random(6)
    good = lambda n: " ".join(rng.choice(["the", "river", "runs", "quietly", "past", "old", "houses"]) for _ in range(n))
    bad = lambda n: " ".join(rng.choice(["###", "$$$ BUY", "click!!", "%%%"]) for _ in range(n))
    rows = [(i, (good if i % 2 else bad)(60)) for i in range(90)]
    # Long texts that turn bad only far behind their beginning: all of a text counts.
    rows += [(200, good(300) + " " + bad(9000)), (201, bad(300) + " " + good(9000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(90)] + [(1, 1, 0), (1, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert got[200] < 0.5 < got[201]
    assert quality.score(docs.limit(0), model).count() == 0
    assert quality.score(docs, quality.train(docs.limit(0), labels)).first().score == 0.5


def test_a_long_conversation_is_one_text(spark):
    rows = [(7, i, "assistant" if i % 2 else "user", f"turn {i} <|im_end|>") for i in range(3000)]
    got = chat.read_back(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))).collect()
    assert len(got) == 1 and got[0].n_turns == 3000 and got[0].loss_chars == sum(len(r[3]) for r in rows if r[1] % 2)
