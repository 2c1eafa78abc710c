"""The result as one document, as text, and as tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions import fixed as X
from waymark.plans.converge import Result


def format_duration(seconds: float) -> str:
    """The largest unit decides the form: whole hours to seconds, minutes and seconds, seconds to milliseconds, or milliseconds."""
    whole, ms = divmod(max(0, round(seconds * 1000)), 1000)
    minutes, secs = divmod(whole, 60)
    if minutes >= 60:
        return X.HOURS.format(minutes // 60, minutes % 60, secs)
    if minutes:
        return X.MINUTES.format(minutes, secs)
    return X.SECONDS_MS.format(secs, ms) if secs else X.MS.format(ms)


def shorten(urls: list[str], limit: int) -> str:
    if not urls:
        return X.NONE
    head = X.COMMA.join(urls[:limit])
    return head if len(urls) <= limit else head + X.SHORTENED.format(len(urls) - limit)


def merge_groups(result: Result) -> DataFrame:
    """Groups with their sorted members, by type and representative (ties: by members)."""
    lists = result.members.groupBy("group_id").agg(F.array_sort(F.collect_list("url")).alias("members"))
    return result.groups.join(lists, "group_id").select("group_type", "representative", "member_count", "members", "reason").orderBy("group_type", "representative", "members")


def details(analysed: DataFrame, result: Result) -> DataFrame:
    """The analysed columns of every site, with its final noise reasons."""
    reasons = result.noise.select("url", F.col("reasons").alias("final_reasons"))
    joined = analysed.join(reasons, "url", "left")
    return joined.withColumn("noise_reasons", F.coalesce("final_reasons", F.array().cast("array<string>"))).drop("final_reasons")


def write_tables(result: Result, folder: str, form: str = "parquet") -> None:
    for name, df in (("noise", result.noise), ("groups", result.groups), ("members", result.members), ("independent", result.independent)):
        df.write.format(form).mode("overwrite").save(f"{folder}/{name}")


def document(result: Result, analysed: DataFrame | None = None) -> dict:
    """The whole result as one nested document: for reports of a size the driver can hold."""
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    out = {
        "summary": rows(result.summary())[0],
        "failure_summary": rows(result.failures()),
        "noise_sites": rows(result.noise.orderBy("url")),
        "merge_groups": rows(merge_groups(result)),
        "independent_sites": rows(result.independent.orderBy("url")),
    }
    if analysed is not None:
        out["details"] = {r.pop("url"): r for r in rows(details(analysed, result))}
    return out


def to_json(doc: dict) -> str:
    return json.dumps(doc, ensure_ascii=False, indent=2, default=str)


def text_report(result: Result, samples: int = 5, extra: dict | None = None) -> str:
    """Counters, then the first rows of every section; ``extra`` has counters that the tables don't (workers, duration)."""
    counts = result.summary().first().asDict() | (extra or {})
    shown = (X.COUNT_INPUT, X.COUNT_WORKERS, X.DURATION, X.COUNT_FAILED, X.COUNT_NOISE, X.COUNT_GROUPS, X.COUNT_MEMBERS, X.COUNT_ALONE)
    out = [X.HEAD_SUMMARY, *(f"- {name}: {counts[name]}" for name in shown if name in counts)]

    def section(title: str, more: str, df: DataFrame, line) -> None:
        rows = df.limit(samples + 1).collect()
        out.extend(["", title])
        for row in rows[:samples]:
            out.extend(line(row))
        if not rows:
            out.append(f"- {X.NONE}")
        if len(rows) > samples:
            out.append(more.format(df.count() - samples))

    def group(r) -> list[str]:
        values = (r.group_type, r.representative, r.member_count, shorten(r.members, samples), r.reason)
        return [f"{'  ' if i else '- '}{label}: {value}" for i, (label, value) in enumerate(zip(X.GROUP_LABELS, values, strict=True))]

    section(X.HEAD_FAILURES, X.MORE_FAILURES, result.failures(), lambda r: [X.FAILURE_LINE.format(r["category"], r["count"]), X.SAMPLE_LINE.format(shorten(r.sample_urls, samples))])
    section(X.HEAD_NOISE, X.MORE_NOISE, result.noise.orderBy("url"), lambda r: [f"- {r.url} [{r.status_code}] {X.SEMICOLON.join(r.reasons)}"])
    section(X.HEAD_GROUPS, X.MORE_GROUPS, merge_groups(result), group)
    section(X.HEAD_ALONE, X.MORE_ALONE, result.independent.orderBy("url"), lambda r: [f"- {r.url} [{r.status_code}] {r.reason}"])
    return "\n".join(out)
