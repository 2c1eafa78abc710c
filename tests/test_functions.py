"""URL, text, payload and page functions against their stated results."""

import pytest
from pyspark.sql import functions as F

from waymark.functions import classify, pages, urls
from waymark.functions.rules import load_rules
from waymark.plans.report import format_duration, shorten
from waymark.sources.sites import parse_sites, read_sites

RULES = load_rules()

SITES = {
    "example.com": ("http://example.com/", 80, False, "example.com"),
    "example.com:8443": ("https://example.com:8443/", 8443, False, "example.com"),
    "example.com:443": ("https://example.com/", 443, False, "example.com"),
    "example.com:8443/x": ("http://example.com:8443/", 8443, False, "example.com"),
    "HTTPS://User:pw@WWW.Example.com/a?b#c": ("https://www.example.com/", 443, False, "example.com"),
    "https://user:secret@shop.example.com/": ("https://shop.example.com/", 443, False, "example.com"),
    "https://a:b@c:d@deep.example.com:7443": ("https://deep.example.com:7443/", 7443, False, "example.com"),
    "http://example.com:0/": ("http://example.com/", 80, False, "example.com"),
    "a.b.co.uk": ("http://a.b.co.uk/", 80, False, "b.co.uk"),
    "com.cn": ("http://com.cn/", 80, False, "com.cn"),
    "localhost": ("http://localhost/", 80, False, "localhost"),
    "192.0.2.7:8080": ("http://192.0.2.7:8080/", 8080, True, None),
    "[2001:db8::1]:8443": ("https://[2001:db8::1]:8443/", 8443, True, None),
    "a_b.example.com": ("http://a_b.example.com/", 80, False, "example.com"),
}


def test_sites(spark):
    lines = spark.createDataFrame([(i, s) for i, s in enumerate([*SITES, "", "# note", "http://example.com/x"])], "line_no int, value string")
    rows = parse_sites(lines, RULES).collect()
    got = {r.raw: (r.url, r.port, r.is_ip, r.domain) for r in rows}
    assert got == {k: v for k, v in SITES.items() if k != "http://example.com:0/"}


@pytest.mark.parametrize("bad", ["ftp://example.com", "http://example.com:abc", "http://"])
def test_bad_lines(spark, bad, tmp_path):
    (tmp_path / "sites.txt").write_text(f"ok.example.com\n{bad}\n")
    with pytest.raises(Exception, match=":2: "):
        read_sites(spark, str(tmp_path / "sites.txt"), RULES).collect()
    assert [r.host for r in read_sites(spark, str(tmp_path / "sites.txt"), RULES, permissive=True).collect()] == ["ok.example.com"]


def test_compare_form(spark):
    cases = {
        "HTTP://A.Example:80/p;jsessionid=1?q=1#f": "http://a.example/p?q=1",
        "https://a.example:8443": "https://a.example:8443/",
        "https://a.example/x/y;v": "https://a.example/x/y",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "u string").select("u", urls.url_for_compare(F.col("u")).alias("n")).collect()
    assert {r.u: r.n for r in rows} == cases
    twice = spark.createDataFrame([(v,) for v in cases.values()], "u string").select("u", urls.url_for_compare(F.col("u")).alias("n"))
    assert all(r.u == r.n for r in twice.collect())


def test_payloads():
    sign = pages.payload_signature
    assert sign("application/json; charset=utf-8", '{"Error-Code": 1.0, "x": {"msg": "A  B"}, "id": 3}') == '["json", [["errorcode", "1.0"], ["x.msg", "a b"]]]'
    assert sign("application/json", '{"errors": ["a"]}') is None
    assert sign("application/json", '{"data": null, "ok": true}') == '["json", [["data", "null"]]]'
    assert sign("text/xml", "<n:Err xmlns:n='u'><Code>No</Code><a><b/></a></n:Err>") == '["xml", "err", [["err.code", "no"]]]'
    assert sign("text/xml", "<a>") is None
    assert sign("text/plain", '{"msg": 1}') is None


def test_page_features():
    out = pages.page_features(
        "http://h.example/a/", b"<html><title>A &amp; B</title><script src='x.js'></script><link rel='shortcut icon' href='//c.example:81/i.ico'>"
        b"<meta name=Description content=' d  e '><a href='/l'>t</a><form action='/f'></form><style>p{}</style>text</html>", ["", "", "", "", "text/html"], ("text/html",)
    )
    assert (out["title"], out["meta_description"], out["loads"], out["links"], out["forms"]) == ("A & B", "d e", 1, ["/l"], ["/f"])
    assert out["resources"] == ["icon://c.example:81/i.ico", "js:/a/x.js"]
    assert out["body_text"] == "A & B t text"
    assert pages.page_features("http://h/", b"<html><script src='http://h2:x/'></script>", [""] * 5, ())["problem"]
    assert pages.page_features("http://h/", None, [""] * 5, ())["body_text"] == ""


def test_failure_categories(spark):
    cases = {"SSL: bad": "SSL证书校验失败", "Read timed out": "请求超时", "Connection reset by peer": "连接被重置或中断", "odd": "其他请求失败"}
    rows = spark.createDataFrame([(k,) for k in cases], "e string").select("e", classify.failure_category(F.col("e")).alias("c"), classify.retryable(F.col("e")).alias("r")).collect()
    assert {r.e: r.c for r in rows} == cases and all(r.r for r in rows)


def test_report_helpers():
    assert shorten([], 3) == "无" and shorten(["a", "b", "c"], 2) == "a，b ...（其余 1 个省略）"
    cases = {0: "0毫秒", 0.25: "250毫秒", 5.2: "5.200秒", 59.9996: "1分0秒", 61.5: "1分1秒", 3600: "1小时0分0秒", 3661.5: "1小时1分1秒"}
    assert {s: format_duration(s) for s in cases} == cases
