"""Every query with SQL against DuckDB over the smallest tables."""

from __future__ import annotations

import base64

import duckdb
import pytest

from folioworks.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return v


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(([plain(x) for x in r] for r in df.values.tolist()), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    if name in catalog.oracle_sql():
        want = duck.sql(catalog.oracle_sql()[name]).df()
        assert rows(got) == rows(want)
    else:
        assert len(got) > 0


def test_file_names_read_the_whole_text(spark, tmp_path):
    texts = [" " * 200 + "late title", "._" * 100 + "late", "a" + " " * 300 + "b", "." * 200, "x" * 300]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [r.name for r in catalog.queries()["file_names"](spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert got == [f"{n}_transcript.md" for n in ("late_title", "late", "a_b", "output", "x" * 100)]


def test_page_digests_keep_long_urls_on_one_line(spark, tmp_path):
    urls = [None, "", *("https://a.example/" + "x" * (n - 18) for n in (56, 57, 58, 114, 115, 5000)), "https://a.example/" + "é中😀" * 40]
    pages = [(i, u, None if i == 3 else "<p>ü</p>" * i) for i, u in enumerate(urls)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    names = ["page_id", "sha", "url64", "n_bytes"]
    got = [tuple(r) for r in catalog.queries()["page_digests"](spark, str(tmp_path)).select(names).orderBy("page_id").collect()]
    assert got == con.sql(f"SELECT {', '.join(names)} FROM ({catalog.oracle_sql()['page_digests']}) ORDER BY page_id").fetchall()
    assert [r[2] for r in got] == [None if u is None else base64.b64encode(u.encode()).decode() for u in urls]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
