"""The registered queries themselves, their SQL, and the stages of the pipeline on a table of planted cases."""

from __future__ import annotations

import random
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from folioworks.llm import decontaminate, registry
from folioworks.llm.packing import default_tokenizer
from folioworks.llm.tokens import encoder

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def documents(duck):
    return duck.sql("SELECT doc_id, text, lang FROM documents ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    order = sorted(got.columns)
    want = duck.execute(registry.oracle_sql()[name]).to_arrow_table().select(order).to_pylist()
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, got.select(*order).collect()), key=key) == sorted((tuple(r[c] for c in order) for r in want), key=key)


def crc(key, n):
    return zlib.crc32(str(key).encode()) % n


def test_decontaminate(spark, duck, documents):
    """Found items by brute force over folded texts where they occur unchanged; every found item is within its budget."""
    items = {i: decontaminate.fold(t or "") for i, t in duck.sql("SELECT item_id, text FROM benchmark").fetchall()}
    texts = {i: decontaminate.fold(t or "") for i, t, _ in documents}
    got = {(r.doc_id, r.item_id): r.distance for r in registry.queries()["op1_decontaminate"](spark, SF).collect()}
    exact = {(d, i) for d, t in texts.items() for i, f in items.items() if f and f" {f} " in f" {t} "}
    assert exact <= set(got) and all(n <= decontaminate.budget(len(items[i])) for (_, i), n in got.items())


def test_languages(spark, documents):
    got = {r.doc_id: r for r in registry.queries()["op5_langid"](spark, SF).collect()}
    assert len(got) == len(documents) and all(got[i].held_out == (crc(i, 3) == 1) and 0 <= got[i].score <= 1 for i, _, _ in documents)
    held = [(i, lang) for i, t, lang in documents if lang and t and got[i].held_out]
    assert sum(got[i].lang_pred == lang for i, lang in held) >= 0.9 * len(held)


def test_quality(spark, duck, documents):
    got = {r.doc_id: r for r in registry.queries()["op7_quality"](spark, SF).collect()}
    assert len(got) == len(documents) and all(r.predicted == int(r.score >= 0.3) and r.held_out == (crc(i, 5) == 0) for i, r in got.items())


def test_token_files(spark, documents):
    e = encoder(default_tokenizer()).tokenizer
    start, want = 0, []
    for i, t, _ in documents:
        ids = np.array([*e.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = registry.queries()["op8_token_files"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want


def test_shards(spark, documents):
    got = registry.queries()["op9_virtual_slots"](spark, SF).collect()
    sizes = {i: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in documents}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in got} == sizes and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    assert {r.shard for r in got} <= set(range(24))
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_packing(spark, documents):
    e = encoder(default_tokenizer()).tokenizer
    got = registry.queries()["op10_packing"](spark, SF).collect()
    total, places = {}, {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert total == {i: len(e.encode(t or "", add_special_tokens=False).ids) + 1 for i, t, _ in documents}
    for parts in places.values():
        assert [o for o, _ in sorted(parts)] == np.cumsum([0, *(n for _, n in sorted(parts)[:-1])]).tolist() and sum(n for _, n in parts) <= 2048


# The pipeline ------------------------------------------------------------------------------------------------------


def planted(spark, folder):
    """Clean texts of two languages, foreign ones, bad ones, copies, leaks, and odd rows."""
    rng = random.Random(12)
    syllables = {"aa": ["ba", "na", "la", "ca", "sa", "mi"], "bb": ["str", "engh", "rhy", "thm", "cry", "ick"]}
    lexicon = {k: ["".join(rng.choices(s, k=rng.randrange(2, 4))) for _ in range(200)] for k, s in syllables.items()}
    clean = lambda k, n=80: " ".join(rng.choices(lexicon[k], k=n))
    rows, kind = [], {}

    def add(text, name, lang=None):
        kind[len(rows)] = name
        rows.append((len(rows), text, lang, "s", len(text or "")))

    for i in range(160):
        add(clean("ab"[i % 2] * 2), "clean", "ab"[i % 2] * 2)
    for _ in range(40):
        add(" ".join(rng.choice(["### BUY", "$$$ now", "click!!", "%%% 100", "www"]) + " " + rng.choice(lexicon["aa"]) for _ in range(60)), "bad", "aa")
    add("".join(chr(rng.randrange(0x621, 0x64B)) if i % 7 else " " for i in range(3000)), "foreign")
    for t in (None, "", "1234 !!"):
        add(t, "no letters")
    add(rows[4][1], "copy of 4", "aa")
    add(rows[5][1] + " " + clean("bb", 3), "near copy of 5", "bb")
    item = clean("aa", 30)
    add(f"{clean('aa')} {item} {clean('aa')}", "leak", "aa")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    marks = [(i, int(kind[i] == "clean"), 0) for i in kind if kind[i] in ("clean", "bad")]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, kind


def test_pipeline_keeps_clean_documents_alone(spark, tmp_path):
    rows, kind = planted(spark, str(tmp_path))
    docs, left = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    are = lambda *kinds: {i for i, k in kind.items() if k in kinds}
    assert left["language"] == set(kind) - are("foreign", "no letters")
    assert left["quality"] == left["language"] - are("bad")
    assert left["near_duplicates"] == left["quality"] - are("copy of 4", "near copy of 5")
    assert left["decontamination"] == left["near_duplicates"] - are("leak") == are("clean")
    e = encoder(default_tokenizer()).tokenizer
    want = {i: len(e.encode(rows[i][1], add_special_tokens=False).ids) + 1 for i in are("clean")}
    for pieces in (corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)), corpus_pipeline.run(spark, str(tmp_path))):
        total: dict = {}
        for r in pieces.collect():
            total[r.doc_id] = total.get(r.doc_id, 0) + r.length
        assert total == want
