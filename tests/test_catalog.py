"""Every driver query that has SQL gives the same rows in DuckDB; components against union-find."""

import hashlib
import os

import duckdb
import pytest

import __spark_entry__ as entry
from waymark.operators.components import connected_components
from waymark.plans import catalog

SF = "/root/testdata/sf0.001"


def rows_of(df):
    cols = sorted(df.columns)
    return sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in df[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_against_duckdb(spark, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name not in catalog.ORACLE_SQL:
        assert len(got)
        return
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"create view {f[:-8]} as select * from read_parquet('{SF}/{f}')")
    want = db.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["host", "shell_fp", "shell_type", "member_count", "representative"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(30)] + [(99, 99)], [(0, i) for i in range(1, 40)] + [(50, 51)], []])
def test_components(spark, edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for e in edges for x in e}


def test_fingerprint_is_of_the_whole_page(spark, tmp_path):
    pages = [(1, "a" * 524_288 + "x"), (2, "a" * 524_288 + "y"), (3, "short")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    rows = entry.queries()["body_fingerprint"](spark, str(tmp_path)).collect()
    expected = {i: (hashlib.sha256(html.encode()).hexdigest(), min(len(html), 524_288)) for i, html in pages}
    assert {r.page_id: (r.body_sha256, r.body_length) for r in rows} == expected


# References cut short or unknown to the SQL, spaces it keeps, elements in each other or never closed, and a page that can't be parsed.
ODD_TEXTS = [
    "token = &quot", "a &amp", "a&am", "a&", "&copy 2020 &middot x", "&copy;&middot;&quot;&amp;", "&amp;quot; &amp;amp; &amp;amp", "&lt;b&gt; &#39; &#x27; &nbsp; &eacute; &not",
    "\u00a0a\u00a0 \u2003b\x0b c\u3000", " a \t\n\f\r b ", "", " ", "a<b>c</b>d", "x < y > z", "&QUOT; &Quot &AMP; &AMP",
]
ODD_PAGES = [
    *[f"<!DOCTYPE html><html><head><title>{t}</title></head><body><h1>{t}</h1><p>words</p></body></html>" for t in ODD_TEXTS],
    "<SCRIPT a='b'>x<style>y</SCRIPT>z</style>w<STYLE\n>u</Style>v", "<style><script></style>x</script>y", "<\u017fcript>long s</script>w<scr\u0131pt>dotless i</script>", "<script>never closed > &quot", "<script><script>a</script>b</script>c",
    "<title>one</title><svg><title>two</title></svg>", "<title lang='en'>three</title><TITLE>four</TITLE>", "<!-- <title>five</title> --><title>six\n</title>", "<title>seven", "<title></title>x",
    "before <![odd[ &quot after", "<a href='http://[bad'>b</a><script src='http://[bad'></script><title>eight &quot</title>", "", None,
]


def check_odd_pages(spark, folder, name, pages=tuple(enumerate(ODD_PAGES))):
    spark.createDataFrame([(i, f"https://h{i}.example.com/", p) for i, p in pages], "page_id long, url string, html string").coalesce(1).write.parquet(str(folder / "pages.parquet"))
    db = duckdb.connect()
    db.execute(f"create view pages as select * from read_parquet('{folder}/pages.parquet/*.parquet')")
    want = db.execute(catalog.ORACLE_SQL[name]).df()
    got = catalog.QUERIES[name](spark, str(folder)).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_odd_texts_as_in_sql(spark, tmp_path):
    check_odd_pages(spark, tmp_path, "page_visible_text")


def test_odd_analysed_pages_as_in_sql(spark, tmp_path):
    # pages that can't be parsed or have assets of their own are left out, for the SQL names the assets it adds; every sixth id shows the page itself
    odd = [p for p in ODD_PAGES if p is not None and "<![" not in p and "src=" not in p] + ["<title>long</title>" + "a &quot " * 70_000]
    check_odd_pages(spark, tmp_path, "analyzed_pages", [(6 * i + j, p) for i, p in enumerate(odd) for j in (0, 5)])


def test_odd_titles_as_in_sql(spark, tmp_path):
    check_odd_pages(spark, tmp_path, "page_title")
