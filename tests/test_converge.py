"""Scenarios on recorded responses, each with its result, and the partition invariant."""

import random

import pytest

from waymark.functions import fixed as X
from waymark.functions.rules import load_rules
from waymark.plans.analyze import RESPONSES, analyze
from waymark.plans.converge import converge
from waymark.plans.report import document, text_report

RULES = load_rules()
BUSINESS = (
    "<html><head><title>{t}</title><script src='/a.js'></script><link rel='stylesheet' href='/s.css'></head><body>" + "Business words here. " * 40 + "</body></html>"
)
PATHS = ["/robots.txt", "/favicon.ico", "/sitemap.xml", "/.well-known/"]


def page(raw, *, title="Shop", body=None, status=200, ctype="text/html", ips=("192.0.2.1",), headers=None, first_status=None, location=None, final_url=None, error="", paths=200):
    body = (BUSINESS.format(t=title) if body is None else body).encode()
    head = {"Content-Type": ctype, "Server": "nginx", **(headers or {})}
    url = None if "://" not in raw else raw
    final = {"url": final_url or url or "", "status": status, "headers": head, "body": body}
    first = dict(final)
    if first_status:
        first = {"url": url or "", "status": first_status, "headers": {"Location": location}, "body": b""}
    probes = [{"path": p, "status": paths, "headers": {}, "body": b"x", "error": ""} for p in PATHS]
    if error:
        return (raw, [], error, None, None, [])
    return (raw, list(ips), "", first, final, probes)


LOW = "<html><title>hi</title><body>hello world</body></html>"
ROWS = [
    # one host, two ports, one denial
    page("http://deny.example.com/", body="<html>access denied</html>", status=403),
    page("http://deny.example.com:8080/", body="<html>access denied</html>", status=403),
    # subdomains, one port and address, one unauthenticated API; another port stays alone
    page("http://a.api.org/", body='{"msg": "not authenticated", "requestId": 1}', ctype="application/json"),
    page("http://b.api.org/", body='{"msg": "not authenticated", "requestId": 2}', ctype="application/json"),
    page("http://c.api.org:81/", body='{"msg": "not authenticated"}', ctype="application/json"),
    # different domains, one address
    page("https://one.test/", title="X", ips=("198.51.100.9",)),
    page("https://two.test.net/", title="X", ips=("198.51.100.9",)),
    page("https://three.test.org/", title="X", ips=("198.51.100.10",)),
    # default page
    page("http://default.example.net/", title="Welcome to nginx", body=LOW.replace("hi", "Welcome to nginx!")),
    # redirects: target known, target unknown
    page("http://known.example.org/", first_status=301, location="https://known.example.org/", final_url="https://known.example.org/", title="K"),
    page("https://known.example.org/", title="K"),
    page("http://gone.example.org/", first_status=302, location="/start", final_url="https://gone.example.org/start", title="G"),
    page("http://ext.example.org/", first_status=302, location="https://ext.example.org/in?x=1", final_url="https://ext.example.org/in?x=1", title="E"),
    # equal subdomains
    page("https://m.shop.co.uk/", title="Same"),
    page("https://www.shop.co.uk/", title="Same"),
    # one host, two ports
    page("https://ports.example.io/", title="P"),
    page("https://ports.example.io:8443/", title="P"),
    # an address with two ports
    page("http://192.0.2.7/", body=LOW),
    page("http://192.0.2.7:8080/", body=LOW),
    # maintenance, gateway, CDN
    page("http://closed.example.com/", title="系统维护中"),
    page("http://gateway.example.com/", status=502, body="<html>" + "x" * 2042),
    page("http://gateway2.example.com/", status=502, body="<html>" + "x" * 2043),
    page("http://cdn.example.com/", status=403, headers={"Server": "cloudflare"}, body="<html>Attention Required now</html>"),
    # failures
    page("http://refused.example.com/", error="[Errno 111] Connection refused"),
    page("http://tls.example.com/", error="SSL: CERTIFICATE_VERIFY_FAILED"),
    # redirect inside a shell: the shell comes first
    page("http://shell.example.com/", first_status=301, location="https://shell.example.com/", final_url="https://shell.example.com/", body=LOW),
    page("https://shell.example.com/", body=LOW),
    # denial whose payload has an entity can't be parsed
    page("http://e1.ent.org/", status=403, ctype="application/json", body='{"msg": "forbidden &quot;x&quot;", "id": 1}'),
    page("http://e2.ent.org/", status=403, ctype="application/json", body='{"msg": "forbidden &quot;x&quot;", "id": 2}'),
]


@pytest.fixture(scope="module")
def analysed(spark):
    return analyze(spark.createDataFrame(ROWS, RESPONSES), RULES).cache()


@pytest.fixture(scope="module")
def doc(analysed):
    result = converge(analysed)
    return document(result, analysed), text_report(result)


def groups(doc):
    return {(g["group_type"], g["representative"]): (g["members"], g["reason"]) for g in doc["merge_groups"]}


def test_groups(doc):
    found = groups(doc[0])
    assert found == {
        (X.SUBDOMAIN_SHELL, "http://a.api.org/"): (["http://a.api.org/", "http://b.api.org/"], X.WHY_SUBDOMAIN_SHELL),
        (X.CROSS_DOMAIN, "https://one.test/"): (["https://one.test/", "https://two.test.net/"], X.WHY_CROSS_DOMAIN),
        (X.HTTP_TO_HTTPS, "https://known.example.org/"): (["http://known.example.org/", "https://known.example.org/"], X.WHY_HTTP_TO_HTTPS),
        (X.HTTP_TO_HTTPS, "https://ext.example.org/in?x=1"): (["http://ext.example.org/"], X.WHY_HTTP_TO_HTTPS),
        (X.SAME_DOMAIN, "https://m.shop.co.uk/"): (["https://m.shop.co.uk/", "https://www.shop.co.uk/"], X.WHY_SAME_DOMAIN),
        (X.SAME_HOST, "https://ports.example.io/"): (["https://ports.example.io/", "https://ports.example.io:8443/"], X.WHY_SAME_HOST),
        (X.SAME_HOST_SHELL, "http://192.0.2.7/"): (["http://192.0.2.7/", "http://192.0.2.7:8080/"], X.WHY_SAME_HOST_SHELL),
        (X.SAME_HOST_SHELL, "https://shell.example.com/"): (["http://shell.example.com/", "https://shell.example.com/"], X.WHY_SAME_HOST_SHELL),
    }


def test_noise(doc):
    found = {n["url"]: n["reasons"] for n in doc[0]["noise_sites"]}
    assert found == {
        "http://deny.example.com/": [X.NOISE_DENY],
        "http://deny.example.com:8080/": [X.NOISE_DENY],
        "http://closed.example.com/": [X.NOISE_MAINTENANCE],
        "http://gateway.example.com/": [X.NOISE_GATEWAY],
        "http://cdn.example.com/": [X.NOISE_CDN],
    }


def test_independent(doc):
    found = {n["url"]: n["reason"] for n in doc[0]["independent_sites"]}
    assert found["http://refused.example.com/"] == X.ALONE_PROBE_FAILED
    assert found["http://default.example.net/"] == X.ALONE_LOW_INFORMATION
    assert found["https://three.test.org/"] == X.ALONE_DEFAULT
    assert found["http://gone.example.org/"] == X.ALONE_DEFAULT
    assert found["http://gateway2.example.com/"] == X.ALONE_LOW_INFORMATION
    assert {"http://e1.ent.org/", "http://e2.ent.org/", "http://c.api.org:81/"} <= set(found)


def test_summary(doc):
    s = doc[0]["summary"]
    assert s[X.COUNT_INPUT] == len(ROWS) == s[X.COUNT_NOISE] + s[X.COUNT_MEMBERS] + s[X.COUNT_ALONE]
    assert s[X.COUNT_FAILED] == 2
    assert [(f["category"], f["count"]) for f in doc[0]["failure_summary"]] == sorted([("SSL证书校验失败", 1), ("连接被拒绝", 1)])
    assert len(doc[0]["details"]) == len(ROWS)
    assert "http://closed.example.com/" in doc[1]


def test_order_of_input_is_irrelevant(spark, doc):
    rows = ROWS[:]
    random.Random(5).shuffle(rows)
    again = document(converge(analyze(spark.createDataFrame(rows, RESPONSES), RULES)))
    assert groups(again) == groups(doc[0])


def test_empty_input(spark):
    result = converge(analyze(spark.createDataFrame([], RESPONSES), RULES))
    assert result.members.count() == result.noise.count() == result.independent.count() == 0
