"""Rule predicates as Column expressions over normalised features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions import fixed as X
from waymark.functions.rules import Rules, matches_any


def in_list(value: Column, options: list) -> Column:
    """Membership that is false, not null, for a null value."""
    return F.coalesce(value.isin(options), F.lit(False)) if options else F.lit(False)


def noise_reasons(status: Column, size: Column, title: Column, body: Column, response: Column, server: Column, rules: Rules) -> Column:
    """Sorted distinct noise reasons; texts are case-folded and at most 4000 characters."""
    n = lambda *p: rules.patterns("noise", *p)
    gateway = in_list(status, rules.numbers("noise", "small_gateway_statuses")) & (size <= int(rules.get("noise", "small_gateway_body_length")))
    words = F.lit(False)
    for keyword in rules.names("noise", "cdn_body_keywords"):
        words = words | body.contains(keyword) | title.contains(keyword)
    cdn = in_list(server, rules.names("noise", "cdn_servers")) & in_list(status, rules.numbers("noise", "cdn_statuses")) & words
    tests = [
        (gateway, X.NOISE_GATEWAY),
        (matches_any(title, n("title_patterns")), X.NOISE_TITLE),
        (matches_any(body, n("body_patterns")), X.NOISE_BODY),
        (matches_any(response, n("response_patterns")), X.NOISE_RESPONSE),
        (cdn, X.NOISE_CDN),
    ]
    return F.array_sort(F.array_compact(F.array(*[F.when(test, F.lit(reason)) for test, reason in tests])))


def default_page(title: Column, body: Column, rules: Rules) -> Column:
    patterns = rules.patterns("noise", "default_page_patterns")
    return matches_any(title, patterns) | matches_any(body, patterns)


def business_text(text: Column, rules: Rules) -> Column:
    return (text != "") & text.rlike(rules.get("business_text_pattern"))


def low_information(size: Column, body: Column, loads: Column, resources: Column, rules: Rules) -> Column:
    """Little text without business words, no asset loaded, or too few distinct ones."""
    distinct = F.size(F.filter(resources, lambda r: ~r.startswith("icon:")))
    short = (size < int(rules.get("low_information", "body_length_threshold"))) & ~business_text(body, rules)
    return short | (loads == 0) | (distinct < int(rules.get("low_information", "min_non_icon_resources")))


def auth_like(title: Column, body: Column, final_url: Column, forms: Column, links: Column, rules: Rules) -> Column:
    """At least two of the login patterns in title, text, final URL, form targets and links together."""
    parts = [title, F.substring(body, 1, 1200), final_url, F.array_join(forms, " "), F.array_join(links, " ")]
    joined = F.array_join(F.filter(F.array(*parts), lambda p: p != ""), " ")
    hits = F.lit(0)
    for pattern in rules.patterns("auth_shell_patterns"):
        hits = hits + matches_any(joined, [pattern]).cast("int")
    return hits >= 2


def shell_type(status: Column, content_type: Column, title: Column, body: Column, low: Column, rules: Rules) -> Column:
    """maintenance_shell, auth_api_shell, deny_shell, low_information_shell or '': the first that holds."""
    s = lambda p: rules.patterns("response_shells", p)
    closed = matches_any(title, s("maintenance_title_patterns")) | matches_any(body, s("maintenance_body_patterns"))
    auth = in_list(content_type, rules.names("response_shells", "auth_content_types")) & matches_any(body, s("auth_text_patterns"))
    structured = low & in_list(content_type, [*X.XML_TYPES, *X.JSON_TYPES])
    denied = (in_list(status, rules.numbers("response_shells", "deny_statuses")) | structured) & matches_any(body, s("deny_text_patterns"))
    return (
        F.when(closed, "maintenance_shell").when(auth, "auth_api_shell").when(denied, "deny_shell")
        .when(low, "low_information_shell").otherwise("")
    )


def shell_reason(kind: Column) -> Column:
    reason = F.lit("")
    for name, text in X.SHELL_REASONS.items():
        reason = F.when(kind == name, text).otherwise(reason)
    return reason


def failure_category(message: Column) -> Column:
    """The first category one of whose substrings the lower-cased message contains."""
    low, found = F.lower(message), None
    for name, words in X.FAILURES:
        test = F.lit(False)
        for word in words:
            test = test | low.contains(word)
        found = F.when(test, name) if found is None else found.when(test, name)
    return found.otherwise(X.FAILURE_OTHER)


def retryable(message: Column) -> Column:
    test = F.lit(True)
    for word in X.FINAL_TLS_ERRORS:
        test = test & ~F.lower(message).contains(word)
    return test


def independent_reason(failed: Column, is_ip: Column, low: Column, auth: Column, ready: Column) -> Column:
    return (
        F.when(failed, X.ALONE_PROBE_FAILED).when(is_ip, X.ALONE_IP).when(low, X.ALONE_LOW_INFORMATION)
        .when(auth, X.ALONE_AUTH).when(~ready, X.ALONE_WEAK).otherwise(X.ALONE_DEFAULT)
    )
