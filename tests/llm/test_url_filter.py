import duckdb
import pytest

from spendspark.llm import common
from spendspark.llm import url_filter as U

URLS = [
    None, "", "no scheme", "http://A.Example.COM/en/x?q", "https://www.example.com/en/1", "http://sub.www.example.com/en/", "http://example.com", "http://x.net/es/1#f",
    "http://x.net/fr", "http://net/fr/", "http://casino-win.example.org/en/14?page=2", "https://www.casino-win.example.org/en/14.html", "http://casino-win.example.org/en/14/x",
    "http://spam-farm.example.net/de/9999/", "http://spam-farm.example.net/de/10000", "http://spam-farm.example.org/en/007", "x://y://z/en/", "http://a.org:80/en/3\nb", "http://éxample.com/en/", "HTTP://notcom/",
]


@pytest.mark.parametrize("most", [U.BROADCAST_BYTES, 0])
def test_query_equals_sql_and_handles_cases(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(U, "BROADCAST_BYTES", most)  # 0: neither the filter nor what is found is broadcast
    monkeypatch.setattr(common, "BROADCAST_BYTES", most)
    rows = [(i, u, "v") for i, u in enumerate(URLS)] + [(3, URLS[3], "v"), (None, URLS[10], None)]
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame(rows, "page_id long, url string, LISTED string").write.parquet(path)
    got = sorted(map(tuple, U.op5(spark, str(tmp_path)).collect()), key=str)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{path}/*.parquet'")
    assert got == sorted(c.sql(U.SQL).fetchall(), key=str)
    by = {r[0]: r for r in got if r[0] is not None}
    assert by[0][1:] == ("", "", None, "allow", False) and by[3][3:5] == ("example.com/en/", "block") and by[4][3:5] == ("www.example.com/en/", "allow")
    assert by[10][4] == "block" and by[11][4] == "block" and by[12][4] == "allow" and by[13][4] == "block" and by[14][4] == "allow"


def test_bloom_filter_never_misses_and_join_removes_false_hits(spark, monkeypatch):
    monkeypatch.setattr(U, "BITS_EACH", 1)  # nearly all bits are set: the exact join has to decide
    listed = spark.createDataFrame([(f"http://l{i}.org/p",) for i in range(200)] + [(None,), ("http://l1.org/p",)], "url string")
    pages = spark.createDataFrame([(f"http://l{i}.org/p/", i) for i in range(400)], "url string, verdict int")
    out = U.judge(pages, listed, []).collect()
    assert len(out) == 400 and {r.url for r in out if r.verdict == "block"} == {f"http://l{i}.org/p/" for i in range(200)}
    assert U.judge(pages.limit(0), listed, []).count() == 0
    assert {r.verdict for r in U.judge(pages, listed.limit(0), []).collect()} == {"allow"}


def test_pages_are_scanned_twice_and_only_once_whole(spark, tmp_path):
    spark.createDataFrame([(1, "http://a.org/x", "h")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    plan = U.op5(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("struct<page_id:bigint,url:string>") == 1 and "Python" not in plan and "Arrow" not in plan
