"""Every query against its SQL in DuckDB, and literal expectations."""

import duckdb
import pytest

import __spark_entry__ as entry
from terrabin import catalogue
from terrabin.views import BASE

SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in BASE:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def rows(names, data):
    at = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in at) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, duck, name):
    df = catalogue.queries()[name](spark, sf)
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_runs(spark, sf, name):
    assert catalogue.queries()[name](spark, sf).count() > 0


def test_flagship(spark):
    r = entry.entry(spark)
    assert (r.count(), r.agg({"pixels": "sum"}).first()[0]) == (52, 451)


ODD_PAGES = {
    "references": ["<title>a &quot</title><p>b", "a &quo", "&copy 1 &lt;b&gt; &#10;&nbsp; &amp;amp;"],
    "tags": ["<p title='x > y'>z", "<a it's>b</a>c", "<\u017fcript>a</script>b<style-x>c</STYLE >d"],
    "spaces": ["a\u00a0b\u00a0<br>\u3000c", "a\rb\x0bc\u2028d", None, ""],
    "long tag": ["<p " + "a " * 50000 + ">x"],
}


@pytest.mark.parametrize("pages", ODD_PAGES.values(), ids=ODD_PAGES)
def test_text_of_odd_pages_equals_sql(spark, tmp_path, pages):
    """References cut short, quoted >, spaces beyond ASCII and long tags: S10_html_text gives what its SQL gives."""
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    duck = duckdb.connect()
    duck.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = sorted(tuple(r) for r in catalogue.queries()["S10_html_text"](spark, str(tmp_path)).collect())
    assert got == sorted(duck.execute(SQL["S10_html_text"]).fetchall())
    assert len(got) == len(pages)
