"""Command line, live probing against a local server, the stream, and the order of outputs."""

import gzip
import json
import threading
import zlib
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from waymark import __main__ as cli
from waymark.functions import fixed as X
from waymark.functions.rules import Rules, load_rules
from waymark.plans import report
from waymark.plans.analyze import RESPONSES, analyze
from waymark.plans.converge import converge
from waymark.sources.probe import fetch, probe_site
from waymark.sources.scratch import shared_dir
from waymark.streaming.recorded import append_analysed, read_analysed

RULES = load_rules()


def response(url, body="<html><title>hi</title></html>", status=200, error=""):
    if error:
        return (url, [], error, None, None, [])
    got = {"url": url, "status": status, "headers": {"Content-Type": "text/html"}, "body": body.encode()}
    return (url, ["10.0.0.1"], "", got, got, [{"path": "/robots.txt", "status": 404, "headers": {}, "body": b"x", "error": ""}])


class Handler(BaseHTTPRequestHandler):
    seen: list = []

    def do_GET(self):
        self.seen.append((self.path, self.headers.get("User-Agent")))
        if self.path == "/moved":
            self.send_response(301)
            self.send_header("Location", "/gzip")
            self.end_headers()
            return
        text = b"<html><title>packed</title>" + b"x" * 5000
        body, form = {"/gzip": (gzip.compress(text), "gzip"), "/deflate": (zlib.compress(text), "deflate"), "/bad": (b"not packed", "gzip")}.get(self.path, (text, ""))
        self.send_response(404 if self.path == "/robots.txt" else 200)
        if form:
            self.send_header("Content-Encoding", form)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def server():
    web = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{web.server_port}"
    web.shutdown()


def quick(**more):
    return Rules({**RULES.sections, "network": {**RULES.sections.get("network", {}), "retry_attempts": 1, "retry_backoff_seconds": 0.01, "use_env_proxy": False, **more}})


def test_fetch(server):
    assert fetch(server + "/gzip", True, 3, quick())["body"].startswith(b"<html><title>packed")
    assert fetch(server + "/deflate", True, 3, quick())["body"].endswith(b"xxx")
    assert fetch(server + "/bad", True, 3, quick())["body"] == b"not packed"
    stays = fetch(server + "/moved", False, 3, quick())
    assert (stays["status"], fetch(server + "/moved", True, 3, quick())["url"]) == (301, server + "/gzip")
    assert len(fetch(server + "/gzip", True, 3, Rules({**quick().sections, "max_body_bytes": 100}))["body"]) <= 100
    fetch(server + "/", True, 3, quick(user_agent="mine"))
    assert Handler.seen[-1] == ("/", "mine")


def test_probe_site(server):
    port = int(server.rsplit(":", 1)[1])
    got = probe_site("raw", server + "/moved", "127.0.0.1", port, 3, quick())
    assert (got["first"]["status"], got["final"]["url"], got["probe_error"], got["resolved_ips"]) == (301, server + "/gzip", "", ["127.0.0.1"])
    assert {p["path"]: p["status"] for p in got["key_paths"]}["/robots.txt"] == 404
    assert probe_site("raw", "http://127.0.0.1:9/", "127.0.0.1", 9, 1, quick())["probe_error"]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli.SparkSession.Builder, "getOrCreate", lambda self: spark)
    rows = [response(f"http://s{i}.example.com/", f"<html><title>t{i}</title></html>") for i in range(4)] + [response("http://x.example.org/", error="Connection refused")]
    spark.createDataFrame(rows, RESPONSES).write.parquet(str(tmp_path / "r"))
    out = tmp_path / "out.json"
    assert cli.main([str(tmp_path / "r"), "--recorded", "--output", str(out), "--sample-limit", "2", "--no-progress", "--tables", str(tmp_path / "t")]) == 0
    text = capsys.readouterr().out
    assert text.startswith(X.HEAD_SUMMARY) and f"- {X.COUNT_INPUT}: 5" in text and X.MORE_ALONE.format(3) in text and str(out) in text
    doc = json.loads(out.read_text())
    assert doc["summary"][X.COUNT_FAILED] == 1 and doc["summary"][X.COUNT_WORKERS] == 5 and len(doc["details"]) == 5
    assert spark.read.parquet(str(tmp_path / "t" / "independent")).count() == 5
    assert cli.main([str(tmp_path / "r"), "--recorded", "--details"]) == 0
    assert json.loads(capsys.readouterr().out)["failure_summary"][0]["category"] == "连接被拒绝"
    (tmp_path / "none.txt").write_text("# nothing\n\n")
    assert cli.main([str(tmp_path / "none.txt")]) == 2 and X.NO_SITES in capsys.readouterr().err
    (tmp_path / "bad.txt").write_text("ok.example.com\nftp://x\n")
    assert cli.main([str(tmp_path / "bad.txt")]) == 2 and ":2: " in capsys.readouterr().err
    assert cli.main([str(tmp_path / "r"), "--rules", str(tmp_path / "no.yaml")]) == 2
    args = cli.parser().parse_args(["x", "--user-agent", "me", "--retries", "7", "--insecure", "--verify-tls"])
    rules = cli.with_options(RULES, args)
    assert (rules.get("network", "user_agent"), rules.get("network", "retry_attempts"), rules.get("network", "verify_tls")) == ("me", 7, True)


def test_rules_from_a_file(spark, tmp_path):
    (tmp_path / "rules.yaml").write_text("default_timeout: 9\nnoise:\n  small_gateway_statuses: [418]\n")
    rules = load_rules(str(tmp_path / "rules.yaml"))
    row = analyze(spark.createDataFrame([response("http://a.example.com/", "x", 418)], RESPONSES), rules).first()
    assert row.noise_reasons == [X.NOISE_GATEWAY] and float(rules.get("default_timeout")) == 9


def test_outputs_are_ordered(spark):
    shell = "<html>access denied</html>"
    rows = [response(f"http://z{i}.example.com/", f"<html><title>{i}</title></html>") for i in (3, 1, 2)]
    rows += [response(f"http://b.example.com:{p}/", "<html><title>same</title></html>") for p in (82, 81, 83)]
    rows += [response(f"http://a.example.com:{p}/", shell, 403) for p in (92, 91)]
    rows += [response(f"http://f{i}.example.com/", error=e) for i, e in enumerate(["Connection refused", "timed out", "timed out"])]
    rows += [response(f"http://f{i + 5}.example.com/", error="Connection refused") for i in range(9)]
    result = converge(analyze(spark.createDataFrame(rows, RESPONSES), RULES))
    doc = report.document(result)
    for part in ("noise_sites", "independent_sites"):
        found = [r["url"] for r in doc[part]]
        assert found == sorted(found) and found
    assert [g["members"] for g in doc["merge_groups"]] == [[f"http://b.example.com:{p}/" for p in (81, 82, 83)]]
    assert [(f["category"], f["count"]) for f in doc["failure_summary"]] == [("连接被拒绝", 10), ("请求超时", 2)]
    assert doc["failure_summary"][0]["sample_urls"] == [f"http://f{i}.example.com/" for i in (0, 10, 11, 12, 13)]
    lines = report.text_report(result, 2).splitlines()
    assert lines[0] == X.HEAD_SUMMARY and [x for x in lines if x in (X.HEAD_FAILURES, X.HEAD_NOISE, X.HEAD_GROUPS, X.HEAD_ALONE)] == [X.HEAD_FAILURES, X.HEAD_NOISE, X.HEAD_GROUPS, X.HEAD_ALONE]
    empty = report.text_report(converge(analyze(spark.createDataFrame([], RESPONSES), RULES)))
    assert empty.count(f"- {X.NONE}") == 4


def test_stream_keeps_the_first(spark, tmp_path):
    schema = spark.createDataFrame([], RESPONSES).schema
    for number, title in enumerate(("old", "new")):
        rows = [response("http://a.example.com/", f"<html><title>{title}</title></html>"), response(f"http://n{number}.example.com/")]
        spark.createDataFrame(rows, RESPONSES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        append_analysed(stream, RULES, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    rows = {r.url: r.title for r in read_analysed(spark, str(tmp_path / "out")).collect()}
    assert len(rows) == 3 and rows["http://a.example.com/"] == "old"
    assert converge(read_analysed(spark, str(tmp_path / "out"))).sites.count() == 3


def test_equal_sites_keep_the_first_line(spark):
    rows = [(2, *response("http://a.example.com/x", "<html><title>second</title></html>")), (1, *response("A.example.com", "<html><title>first</title></html>"))]
    analysed = analyze(spark.createDataFrame(rows, "line_no int, " + RESPONSES), RULES)
    assert [(r.url, r.title) for r in analysed.collect()] == [("http://a.example.com/", "first")]
    plan = analysed._jdf.queryExecution().executedPlan().toString()
    assert "body" not in plan.split("Exchange")[1].splitlines()[0]
    assert analysed.select(F.count("url")).first()[0] == 1


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda name, default: default)})()

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        shared_dir(Session())
