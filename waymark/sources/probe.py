"""Optional live source: responses fetched by executors, a pool of threads per partition."""

from __future__ import annotations

import socket
import ssl
import time
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any
from urllib import error, parse, request

import pandas as pd
from pyspark.sql import DataFrame

from waymark.functions.fixed import FINAL_TLS_ERRORS
from waymark.functions.rules import Rules
from waymark.plans.analyze import RESPONSES


class _Stay(request.HTTPRedirectHandler):
    def redirect_request(self, *args, **kwargs):
        return None


def unpacked(stream: Any, form: str, most: int) -> bytes:
    """The first ``most`` bytes of a compressed body; what doesn't unpack is kept as it is."""
    raw = stream.read(most)
    for bits in (47, -15) if form == "deflate" else (47,):
        try:
            return zlib.decompressobj(bits).decompress(raw, most)
        except zlib.error:
            continue
    return raw


def fetch(url: str, follow: bool, timeout: float, rules: Rules) -> dict[str, Any]:
    """One response, with linear back-off between attempts; final TLS errors aren't tried again."""
    context = ssl.create_default_context()
    if not rules.get("network", "verify_tls"):
        context.check_hostname, context.verify_mode = False, ssl.CERT_NONE
    handlers: list[Any] = [request.HTTPSHandler(context=context)]
    handlers += [] if follow else [_Stay()]
    handlers += [] if rules.get("network", "use_env_proxy") else [request.ProxyHandler({})]
    opener = request.build_opener(*handlers)
    tries = max(0, int(rules.get("network", "retry_attempts"))) + 1
    most = int(rules.get("max_body_bytes"))
    for attempt in range(1, tries + 1):
        try:
            try:
                got = opener.open(request.Request(url, headers={"User-Agent": rules.get("network", "user_agent")}), timeout=timeout)
            except error.HTTPError as refused:
                got = refused
            with got:
                packed = got.headers.get("Content-Encoding", "").strip().lower()
                body = unpacked(got, packed, most) if packed in ("gzip", "x-gzip", "deflate") else got.read(most)
                return {"url": got.geturl(), "status": got.status, "headers": dict(got.headers.items()), "body": body}
        except Exception as problem:
            if attempt == tries or any(w in str(problem).lower() for w in FINAL_TLS_ERRORS):
                raise
            time.sleep(float(rules.get("network", "retry_backoff_seconds")) * attempt)
    raise AssertionError


def resolve(host: str, port: int) -> list[str]:
    try:
        return sorted({info[4][0] for info in socket.getaddrinfo(host, port, proto=socket.IPPROTO_TCP)})
    except OSError:
        return []


def probe_site(raw: str, url: str, host: str, port: int, timeout: float, rules: Rules) -> dict[str, Any]:
    out: dict[str, Any] = {"raw": raw, "resolved_ips": resolve(host, port), "probe_error": "", "first": None, "final": None, "key_paths": []}
    try:
        out["first"] = out["final"] = first = fetch(url, False, timeout, rules)
        if 300 <= first["status"] < 400 and any(k.lower() == "location" and v for k, v in first["headers"].items()):
            out["final"] = fetch(url, True, timeout, rules)
        for path in rules.get("http", "key_paths"):
            row = {"path": path, "status": None, "headers": {}, "body": None, "error": ""}
            try:
                got = fetch(parse.urljoin(url, path), True, timeout, rules)
                row |= {k: got[k] for k in ("status", "headers", "body")}
            except Exception as problem:
                row["error"] = str(problem)
            out["key_paths"].append(row)
    except Exception as problem:
        out["probe_error"] = str(problem) or type(problem).__name__
    return out


def probe(sites: DataFrame, rules: Rules, workers: int = 8, timeout: float | None = None) -> DataFrame:
    """Recorded responses of live sites; store the result before analysing it, for a plan may run twice."""
    limit = float(timeout if timeout is not None else rules.get("default_timeout"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for frame in frames:
                jobs = [pool.submit(probe_site, r.raw, r.url, r.host, int(r.port), limit, rules) for r in frame.itertuples()]
                yield pd.DataFrame([j.result() for j in jobs], columns=[p.split()[0] for p in ("raw", "resolved_ips", "probe_error", "first", "final", "key_paths")])

    return sites.select("raw", "url", "host", "port").mapInPandas(run, RESPONSES)
