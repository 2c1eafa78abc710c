"""python -m waymark SITES_OR_RESPONSES: converge a site list (probed live) or recorded responses."""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import SparkSession

from waymark.functions import fixed as X
from waymark.functions.rules import Rules, load_rules
from waymark.plans import report
from waymark.plans.analyze import analyze
from waymark.plans.converge import converge
from waymark.sources.probe import probe
from waymark.sources.scratch import materialise
from waymark.sources.sites import read_sites


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="waymark", description=__doc__)
    p.add_argument("input", help="site list (text), or with --recorded a Parquet table of responses")
    p.add_argument("--recorded", action="store_true", help="the input holds recorded responses; nothing is fetched")
    p.add_argument("--rules", help="rule file (YAML); default: the built-in rules")
    p.add_argument("--timeout", type=float, help="seconds per request")
    p.add_argument("--workers", type=int, default=8, help="threads per partition while probing")
    p.add_argument("--retries", type=int, help="attempts after the first")
    p.add_argument("--insecure", action="store_true", help="don't verify certificates")
    p.add_argument("--verify-tls", action="store_true", help="verify certificates; wins over --insecure")
    p.add_argument("--use-env-proxy", action="store_true", help="take proxies from the environment")
    p.add_argument("--output", help="write the result document (JSON) here")
    p.add_argument("--tables", help="write the result tables below this folder")
    p.add_argument("--user-agent", help="sent instead of the rules' User-Agent")
    p.add_argument("--details", action="store_true", help="print the whole document, with every site's details, instead of the report")
    p.add_argument("--sample-limit", type=int, default=5, help="rows shown per section")
    p.add_argument("--no-progress", action="store_true", help="don't show Spark's progress bar")
    return p


def with_options(rules: Rules, args: argparse.Namespace) -> Rules:
    network = dict(rules.sections.get("network") or {})
    if args.retries is not None:
        network["retry_attempts"] = args.retries
    if args.user_agent:
        network["user_agent"] = args.user_agent
    if args.insecure:
        network["verify_tls"] = False
    if args.verify_tls:
        network["verify_tls"] = True
    if args.use_env_proxy:
        network["use_env_proxy"] = True
    return Rules({**rules.sections, "network": network})


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    began = time.monotonic()
    if args.rules and not os.path.exists(args.rules):
        print(X.NO_RULES.format(args.rules), file=sys.stderr)
        return 2
    rules = with_options(load_rules(args.rules), args)
    spark = SparkSession.builder.appName("waymark").config("spark.ui.showConsoleProgress", str(not args.no_progress).lower()).getOrCreate()
    if args.recorded:
        responses = spark.read.parquet(args.input)
    else:
        try:
            sites = materialise(read_sites(spark, args.input, rules), "input_sites")
        except Exception as problem:
            print(X.BAD_INPUT.format(problem), file=sys.stderr)
            return 2
        responses = probe(sites, rules, args.workers, args.timeout)
        responses = materialise(responses, "responses") if sites.take(1) else responses.limit(0)
    if not responses.take(1):
        print(X.NO_SITES, file=sys.stderr)
        return 2
    analysed = materialise(analyze(responses, rules), "analysed")
    result = converge(analysed)
    if args.tables:
        report.write_tables(result, args.tables)
    spent = time.monotonic() - began
    extra = {X.COUNT_WORKERS: max(1, min(args.workers, result.sites.count())), X.SECONDS: round(spent, 3), X.DURATION: report.format_duration(spent)}
    if args.output or args.details:
        doc = report.document(result, analysed)
        doc["summary"] |= extra
        if args.output:
            with open(args.output, "w", encoding="utf-8") as f:
                f.write(report.to_json(doc))
        if args.details:
            print(report.to_json(doc))
            return 0
    print(report.text_report(result, max(1, args.sample_limit), extra))
    if args.output:
        print(f"\n{X.WRITTEN.format(args.output)}\n{X.RULES_AT.format(args.rules or '-')}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
