"""Operators of the pipeline against brute force, on small tables with nulls, ties, repeats, empties and clashing names."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioworks.llm import chat, decontaminate, jaccard, langid, packing, quality, sharding, token_files, topk, warc
from folioworks.llm.packing import default_tokenizer
from folioworks.llm.tokens import encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    base = [words(rng, rng.randrange(1, 120)) for _ in range(60)]
    near = []
    for _ in range(25):
        t = base[7].split() + base[8].split() + base[9].split()
        for _ in range(rng.randrange(0, 6)):
            t[rng.randrange(len(t))] = "x" + str(rng.randrange(50))
        near.append(" ".join(t))
    texts = [*base, *near, base[3], base[3].upper(), None, "", "   \n", "one", "one two", "one two", "A b  c d e", "é " * 400, near[0] + " tail words here"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3]], DOCS).repartition(3)


def clash(df):
    """df with columns of names that operators use inside."""
    return df.selectExpr("*", "'z' AS node", "'z' AS tile", "'z' AS slot", "'z' AS score", "'z' AS ids", "'z' AS _text")


# Tokens ----------------------------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abZ1 \n\t'sdrelvmt.,é　😀²<|endoftx>")), max_size=25), max_size=5))
def test_encoder_is_the_library(texts):
    e = encoder(default_tokenizer())
    ids, bounds = e.encode(pa.array([*texts, None, "it's <|endoftext|> 'll"], pa.string()))
    want = [x.ids for x in e.tokenizer.encode_batch([*texts, "", "it's <|endoftext|> 'll"], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=1200), st.sampled_from([0.5, 0.9, 1.0]))
def test_blocks_round_trip(values, share):
    ids = np.array(values, np.uint32)
    data, starts = token_files.encode_blocks(ids, share)
    assert (token_files.decode_blocks(np.frombuffer(data, np.uint8), starts)[: len(ids)] == ids).all()


def tokens_of(rows, end):
    e = encoder(default_tokenizer()).tokenizer
    return [e.encode(t or "", add_special_tokens=False).ids + [end] for _, t in rows]


def test_token_files(spark, docs, tmp_path):
    m = token_files.write_token_files(clash(docs), str(tmp_path / "t"), default_tokenizer(), file_ids=500)
    got = sorted(tuple(r) for r in token_files.read_token_files(m, str(tmp_path / "t")).collect())
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0], r[1] or ""))
    want, start = [], 0
    for (i, _), ids in zip(rows, tokens_of(rows, 0), strict=True):
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == sorted(want)
    one = m.orderBy(F.desc("ids")).first()
    f = token_files.TokenFile(open(one.path, "rb").read())
    assert (f.ids(300, 310) == f.ids()[300:310]).all()
    assert token_files.read_token_files(token_files.write_token_files(docs.limit(0), str(tmp_path / "e"), default_tokenizer()), str(tmp_path / "e")).count() == 0


# Packing and sharding --------------------------------------------------------------------------------------------


def test_packing_places_each_id_once(spark, docs):
    from folioworks.llm.common import hold

    p = packing.pack(hold(packing.token_pieces(clash(docs), default_tokenizer(), sequence=64), "p"), sequence=64, grain=4).collect()
    by_doc = {}
    for r in p:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sum(r.length for r in p) == sum(map(len, tokens_of(rows, 1)))
    for (i, t), ids in zip(rows, tokens_of(rows, 1), strict=True):
        for r in by_doc[i, len(ids)]:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    seqs = {}
    for r in p:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(seqs) == list(range(len(seqs)))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    assert len(seqs) <= 1.25 * sum(r.length for r in p) / 64 + 1
    assert packing.pack(hold(packing.token_pieces(docs.limit(0), default_tokenizer()), "p")).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 300), max_size=12))
def test_patterns_cover_demand(demand):
    got = {}
    for pattern, times, _ in packing.whole_patterns(demand, 32):
        assert times > 0 and sum(s * k for s, k in pattern.items()) <= 32
        for s, k in pattern.items():
            got[s] = got.get(s, 0) + k * times
    assert got == demand
    assert sum(n for _, n, _ in packing.whole_patterns(demand, 32)) <= sum(n for _, n in packing.greedy_patterns(demand, 32))


def test_knapsack_is_best():
    v = np.array([1.0, 2.9, 3.1, 0.0, 8.0])
    assert packing.knapsack(v, 7)[0] == pytest.approx(10.9)


def test_shards(spark, docs):
    got = sharding.shard(clash(docs), n_shards=5, n_slots=64).collect()
    assert len(got) == docs.count()
    load = [0] * 5
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
        load[s] = sum(r["size"] for r in got if r.shard == s)
    assert max(load) - min(load) <= max(r["size"] for r in got)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert all(r["size"] == len(texts[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in got)
    old = sharding.first_map(64, 5)
    new = sharding.grown(old, 5)
    assert all(a == b or b == 5 for a, b in zip(old, new, strict=True)) and new.count(5) in range(8, 14)
    assert sharding.shard(docs.limit(0), n_shards=2, n_slots=8).count() == 0


def test_slot_map_versions(spark, tmp_path):
    path = str(tmp_path / "map")
    sharding.write_map(spark, path, [0, 1, 0], 0)
    sharding.write_map(spark, path, [1, 1, 0], 1)
    assert sharding.read_map(spark, path) == [1, 1, 0] and sharding.read_map(spark, path, 0) == [0, 1, 0]


# Search ----------------------------------------------------------------------------------------------------------


def test_top_k(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(4)]) for i in range(120)]
    rows += [(200, None), (201, [float("nan")] * 4), (202, [0.1, None, 0.1, 0.1]), (203, [1.0]), (None, [1.0] * 4), (50, rows[50][1]), (300, [1e30] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    whole = [(n, i, [int(np.floor(256 * x)) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v)]
    clip = lambda s: min(topk.HIGH, max(topk.LOW, s))
    want = []
    for n, i, mine in whole:
        if i % 50 == 0:
            best = sorted((-clip(sum(a * b for a, b in zip(mine, v, strict=True))), j) for m, j, v in whole if m != n)[:7]
            want += [(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    for args in ({}, {"fan_in": 2, "query_block": 2, "shard_values": 40}):
        got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(clash(df), "vec_id % 50 = 0", k=7, **args).collect()]
        assert sorted(got) == sorted(want)
    assert topk.top_k(df.limit(0), "vec_id % 50 = 0").count() == 0


def test_block_best_over_tiles():
    rng = np.random.default_rng(3)
    m = rng.integers(-2, 3, (50, 3)).astype(float)
    ids, rows = np.sort(rng.integers(0, 20, 50)), np.arange(50)
    query, got_ids, got_rows, scores = topk.block_best(m[:9], rows[:9], ids, rows, m, 4, tile=7)
    for i in range(9):
        want = sorted((-int(m[i] @ m[j]), int(ids[j]), j) for j in range(50) if j != i)[:4]
        mine = query == i
        assert list(zip((-scores[mine]).tolist(), got_ids[mine].tolist(), got_rows[mine].tolist(), strict=True)) == want


# Near duplicates -------------------------------------------------------------------------------------------------


def brute_components(rows):
    def shingles(t):
        import re

        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())

    sets = [(i, shingles(t)) for i, t in rows]
    best = {i: i for i, _ in sets}

    def root(i):
        while best[i] != i:
            i = best[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                best[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i)) for i, s in sets)


def test_jaccard_join(spark, docs):
    got = sorted(tuple(r) for r in jaccard.linked_components(clash(docs).drop("node")).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert jaccard.linked_components(docs.limit(0)).count() == 0


def test_near_duplicate_stage_keeps_one_row_of_each_group(spark, docs):
    """By rows, also where doc_ids repeat or are null."""
    rng = random.Random(8)
    a, b, c = (words(rng, 60) for _ in range(3))
    texts = [(3, a), (5, a), (5, b), (7, c), (7, c), (7, c + " end"), (None, words(rng, 60)), (None, a), (5, None), (5, ""), (None, None)]
    texts += [(None, t) for _, t in texts[6:7]]
    df = docs.union(spark.createDataFrame([(1000 + i if i is not None else None, t, "en", "s", 0) for i, t in texts], DOCS)).repartition(3)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    groups = {}
    for n, _, root in brute_components([(n, t) for n, (_, t) in enumerate(rows)]):
        groups.setdefault(root, []).append(rows[n])
    got = [(r.doc_id, r.text) for r in jaccard.stage_near_duplicates(spark, df, "").collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(key, got)) == sorted(min(map(key, g)) for g in groups.values())
    for g in groups.values():
        assert sum(r in g for r in got) >= 1
    assert {(1003, a), (1005, b)} <= set(got) and (1005, a) not in got
    assert jaccard.stage_near_duplicates(spark, df.limit(0), "").count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_signatures_meet(seed):
    """Any two sets that link share a signature, of those that are left without the most frequent ones too."""
    rng = np.random.default_rng(seed)
    for _ in range(150):
        n = int(rng.choice([3, 4, 7, 20, 63, 64, 130, 500, 1100]))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        gone = int(rng.integers(0, max(1, n // 4) + 1))
        b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**63, int(rng.integers(0, n // 6 + 1))).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        if 100 * common < 75 * (len(a) + len(b) - common) or len(a) == 0 or np.array_equal(a, b):
            continue
        frequency = lambda s: (int(s) * 2654435761) % 1000  # noqa: E731  any order that both sets know

        def kept(e):
            out = set()
            for kind, slack, sig in jaccard.set_signatures(e):
                order = sorted(sig.tolist(), key=lambda s: (frequency(s), s), reverse=True)
                out |= {(kind, s) for s in order[slack:]}
            return out

        assert kept(a) & kept(b), (len(a), len(b), common)


def test_tile_links():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**62, 300).astype(np.uint64)
    sets = [np.unique(rng.choice(pool[:40] if i % 2 else pool, 30)) for i in range(80)]
    sets += [sets[0], sets[1][:-1]]
    label = list(range(len(sets)))
    for i, j in jaccard.tile_links(list(range(len(sets))), sets):
        label[j] = i
    want = brute = list(range(len(sets)))
    for _ in range(len(sets)):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                c = len(np.intersect1d(a, b))
                if 100 * c >= 75 * (len(a) + len(b) - c):
                    brute[i] = brute[j] = min(brute[i], brute[j])
    assert label == want


# Decontamination -------------------------------------------------------------------------------------------------


def edit_distance_in(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", min_size=1, max_size=20), st.text("abc ", max_size=60), st.integers(0, 20))
def test_myers(item, window, k):
    want = edit_distance_in(item, window)
    got = decontaminate.myers(decontaminate.symbol_masks(item), len(item), window, k)[0]
    assert got == (want if want <= k else k + 1)


def test_decontamination(spark):
    rng = random.Random(4)
    items = [(1, words(rng, 40)), (2, words(rng, 12)), (3, ""), (4, None), (5, "tiny")]
    texts = [words(rng, 200) for _ in range(30)]
    for n in range(12):
        t = list(items[n % 2][1].upper() if n % 3 == 0 else items[n % 2][1])
        for _ in range(n):
            t[rng.randrange(len(t))] = rng.choice("abc")
        texts[n] = texts[n][:100] + " " + "".join(t) + " " + texts[n][100:]
    texts += [None, "", "a Tiny, thing", "tinyish", items[0][1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    found = decontaminate.matches(clash(docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = set()
    for i, t in enumerate(texts):
        for key, item in items:
            f = decontaminate.fold(item or "")
            if f:
                k = decontaminate.budget(len(f))
                hay = decontaminate.fold(t or "")
                if (edit_distance_in(f, hay) <= k) if k else (f" {f} " in f" {hay} "):
                    want.add((i, key))
    assert {(r.doc_id, r.item_id) for r in found} == want and len(found) == len(want)
    exact = next(r for r in found if r.doc_id == len(texts) - 1)
    assert (exact.distance, exact.start, exact.end) == (0, 0, len(items[0][1]))


def test_decontamination_stage_drops_rows_by_their_texts(spark, tmp_path):
    rng = random.Random(6)
    item, clean = words(rng, 30), [words(rng, 80) for _ in range(4)]
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    leak = f"{clean[0]} {item} {clean[1]}"
    rows = [(1, clean[0]), (1, leak), (2, leak), (None, leak), (None, clean[1]), (3, None), (3, clean[2]), (3, clean[2])]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(3)
    got = [(r.doc_id, r.text) for r in decontaminate.stage_decontaminate(spark, df, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([r for r in rows if r[1] != leak], key=str)


# Chat ------------------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="a\n\\<|>" + "é", max_size=12), st.lists(st.sampled_from(["<|im_end|>", "<|im_start|>", "<|", "\\", "<\\|im_end|>", "\n", "x"]), max_size=6))
def test_turns_round_trip(role, parts):
    text = "".join(parts)
    rendered = chat.render_turn(role, text)
    assert [(r, t) for r, t, _ in chat.parse(rendered * 2)] == [(role, text)] * 2
    assert rendered.count(chat.END) == 1


def test_chat(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, None, None, None), (2, 0, "assistant", "<|im_end|>"), (2, 0, "assistant", "<|im_end|>"), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(clash(df))).collect()}
    assert got[1].n_turns == 3 and got[1].turns_sha256 == hashlib.sha256(b"\n\nuser\na\nassistant\nb\n").hexdigest()
    assert got[2].loss_chars == 20 and got[2].loss_sha256 == hashlib.sha256(b"<|im_end|><|im_end|>").hexdigest()
    assert got[None].loss_chars == 0
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


# Classifiers -----------------------------------------------------------------------------------------------------


def test_languages(spark):
    rng = random.Random(1)
    vocab = {"aa": ["banana", "alabama", "casa"], "bb": ["strength", "rhythm", "crypt"]}
    rows = [(i, " ".join(rng.choices(vocab[k], k=30)), k) for i in range(40) for k in [("aa", "bb")[i % 2]]]
    rows += [(100, None, None), (101, "123 !!", "aa"), (102, "", "bb"), (103, "casa", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    langs, prototypes = langid.train(df)
    assert langs == ["aa", "bb"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(clash(df), langs, prototypes).collect()}
    assert all(got[i][0] == k for i, _, k in rows[:40])
    assert all(got[i] == ("und", 0.0) for i in (100, 101, 102)) and got[103][0] == "aa"
    assert {r.lang_pred for r in langid.predict(df, *langid.train(df.limit(0))).collect()} == {"und"}


def test_language_stage_rejects_what_is_no_language(spark):
    """Foreign scripts, random letters and encoded bytes go; clean texts stay, short and repetitive ones too."""
    rng = random.Random(3)
    syllables = {"aa": ["ba", "na", "la", "ca", "sa", "mi", "to", "re"], "bb": ["str", "engh", "rhy", "thm", "cry", "pts", "ow", "ick"]}
    word = {k: ["".join(rng.choices(s, k=rng.randrange(1, 4))) for _ in range(150)] for k, s in syllables.items()}
    clean = [(" ".join(rng.choices(word[k], k=rng.choice([1, 2, 5, 30, 200, 1000]))), k) for k in ("aa", "bb") for _ in range(150)]
    clean += [(" ".join([w] * 300), k) for k in word for w in word[k][:5]]
    alphabets = {"arabic": range(0x621, 0x64B), "cyrillic": range(0x430, 0x450), "latin": range(97, 123), "cjk": range(0x4E00, 0x9000)}
    bad = [" ".join("".join(chr(rng.choice(a)) for _ in range(rng.randrange(2, 9))) for _ in range(n)) for a in alphabets.values() for n in (200, 3000) for _ in range(10)]
    bad += ["".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=2000)) for _ in range(10)] + [None, "", "123 !!"]
    rows = [(i, t, k, "s", len(t)) for i, (t, k) in enumerate(clean)] + [(1000 + i, t, None, "s", None) for i, t in enumerate(bad)]
    df = spark.createDataFrame([*rows, rows[0]], DOCS).repartition(3)
    got = [r.doc_id for r in langid.stage_language(spark, df, "").collect()]
    assert sorted(got) == sorted([*range(len(clean)), 0])
    assert langid.stage_language(spark, df.limit(0), "").count() == 0


def test_quality(spark):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(["the", "river", "runs", "quietly", "past", "old", "houses"]) for _ in range(60))
    bad = lambda: " ".join(rng.choice(["###", "$$$ BUY", "click!!", "%%%"]) for _ in range(60))
    rows = [(i, good() if i % 2 else bad()) for i in range(120)] + [(500, None), (501, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)] + [(500, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(df, labels)
    got = {r.doc_id: r.score for r in quality.score(clash(df), model).collect()}
    assert all((got[i] > 0.5) == bool(i % 2) for i in range(80, 120)) and got[500] == got[501]
    only = quality.train(df, labels.where("quality = 1"))
    assert {r.score for r in quality.score(df, only).collect()} == {only.score(np.zeros(1))[0]}
    assert quality.score(df, quality.train(df, labels.limit(0))).first().score == 0.5


# WARC ------------------------------------------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    big = "é<p>" * 400_000
    pages = [(1, "http://a", "x" * 100), (2, "http://b", "x" * 100), (3, None, "x" * 99), (4, "u", "x" * 99), (5, "u", None), (6, "u", ""), (7, "u", big), (8, "u v", big), (None, "u", "x" * 100), (1, "again", "x" * 100)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    m = warc.write_archives(warc.with_types(clash(df)), str(tmp_path / "w"))
    rows = warc.read_chunks(m, str(tmp_path / "w"), chunk=1 << 16).collect()
    last = sorted(((r.page_id or 0, r.record_type, r.refers_to, r.bytes_so_far, r.sha256_so_far) for r in rows if r.last), key=str)
    want = []
    for i, _, h in pages:
        b = (h or "").encode()
        first = min((p for p, _, x in pages if x == h and p is not None), default=None)
        again = len(b) >= 100 and i != first
        want.append((i or 0, "revisit" if again else "response", first if again else None, len(b), hashlib.sha256(b).hexdigest()))
    assert last == sorted(want, key=str)
    chunks = sorted((r for r in rows if r.page_id == 7 and r.data is not None), key=lambda r: r.chunk_no)
    assert len(chunks) > 10 and b"".join(bytes(r.data) for r in chunks) == big.encode() and max(len(r.data) for r in chunks) <= 1 << 16
    assert chunks[2].sha256_so_far == hashlib.sha256(big.encode()[: 3 << 16]).hexdigest()
    assert warc.read_chunks(warc.write_archives(warc.with_types(df.limit(0)), str(tmp_path / "e")), str(tmp_path / "e")).count() == 0
