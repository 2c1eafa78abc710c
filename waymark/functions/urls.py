"""Site and URL normalisation as Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions.rules import Rules

_PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"
_V4 = r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def python_strip(text: Column) -> Column:
    """Trim the white space that Python's ``str.strip`` trims."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def default_port(scheme: Column) -> Column:
    return F.when(scheme == "https", 443).otherwise(80)


def infer_scheme(raw: Column, rules: Rules) -> Column:
    """The explicit scheme; else https exactly for a hinted port that ends the string."""
    hints = rules.numbers("http", "https_port_hints")

    def of(text: Column) -> Column:
        digits = F.regexp_extract(text, r"^(?:\[[^\]]*\]|[^:]*):(\d{1,9})$", 1)
        hinted = (digits != "") & F.coalesce(digits.try_cast("int").isin(hints), F.lit(False))
        explicit = F.coalesce(F.nullif(F.lower(F.regexp_extract(text, r"^([^:/?#]*)://", 1)), F.lit("")), F.lit("http"))
        return F.when(text.contains("://"), explicit).when(hinted, "https").otherwise("http")

    return let(python_strip(raw), of)


def _without_user(authority: Column) -> Column:
    return F.regexp_replace(authority, r"(?s)^.*@", "")


def authority_host(authority: Column) -> Column:
    """Lower-case host of an authority, without user info, port and brackets."""
    return F.lower(F.regexp_replace(F.regexp_extract(_without_user(authority), r"^(\[[^\]]*\]|[^:\[]*)", 1), r"[\[\]]", ""))


def authority_port(authority: Column) -> Column:
    """The port's text, '' if there is none."""
    return F.regexp_extract(_without_user(authority), r"(?s)^(?:\[[^\]]*\]|[^:\[]*):(.*)$", 1)


def _joined(host: Column) -> Column:
    return F.when(host.contains(":"), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)


def _split(url: Column) -> Column:
    """STRUCT(scheme, host, written port, path, query) of a URL, parsed in one step each."""
    scheme = F.coalesce(F.nullif(F.lower(F.regexp_extract(url, _PARTS, 1)), F.lit("")), F.lit("http"))
    authority = F.regexp_extract(url, _PARTS, 2)
    return F.struct(
        scheme.alias("scheme"), authority_host(authority).alias("host"), authority_port(authority).alias("written"),
        F.regexp_extract(url, _PARTS, 3).alias("path"), F.regexp_extract(url, _PARTS, 4).alias("query"),
    )


def site_struct(raw: Column, rules: Rules) -> Column:
    """STRUCT(url, scheme, host, port, problem): the entry point of an input line.

    Path, query and user info are dropped, the host is lower-cased, the scheme's own
    port is left out, port 0 counts as it. ``problem`` is '' or says what is wrong.
    """

    def of(line: Column) -> Column:
        text, p = line["text"], line["parts"]
        number = F.when(p["written"].rlike(r"^\d{1,9}$"), p["written"].try_cast("int"))
        number = F.when((p["written"] == "") | (number == 0), default_port(p["scheme"])).otherwise(number)
        return let(F.struct(text.alias("text"), p["scheme"].alias("scheme"), python_strip(p["host"]).alias("host"), number.alias("port")), built)

    def built(s: Column) -> Column:
        problem = (
            F.when(s["text"] == "", "空行")
            .when(~s["scheme"].isin("http", "https"), F.concat(F.lit("不支持的协议: "), s["scheme"]))
            .when(s["host"] == "", F.concat(F.lit("站点格式非法: "), s["text"]))
            .when(s["port"].isNull() | (s["port"] > 65535), F.concat(F.lit("端口非法: "), s["text"]))
            .otherwise("")
        )
        shown = F.when(s["port"] == default_port(s["scheme"]), F.lit("")).otherwise(F.concat(F.lit(":"), s["port"].cast("string")))
        url = F.concat(s["scheme"], F.lit("://"), _joined(s["host"]), shown, F.lit("/"))
        return F.struct(url.alias("url"), s["scheme"].alias("scheme"), s["host"].alias("host"), s["port"].alias("port"), problem.alias("problem"))

    def full(text: Column) -> Column:
        return F.when(text.contains("://"), text).otherwise(F.concat(infer_scheme(text, rules), F.lit("://"), text))

    parsed = let(python_strip(raw), lambda text: let(full(text), lambda whole: F.struct(text.alias("text"), _split(whole).alias("parts"))))
    return let(parsed, of)


def url_for_compare(url: Column) -> Column:
    """Lower-case scheme and host, own port left out, path and query kept, fragment and ;params dropped."""

    def of(p: Column) -> Column:
        path = F.coalesce(F.nullif(F.regexp_replace(p["path"], r";[^/]*$", ""), F.lit("")), F.lit("/"))
        query = F.coalesce(F.nullif(p["query"], F.lit("?")), F.lit(""))
        number = F.when(p["written"].rlike(r"^\d{1,9}$"), p["written"].try_cast("int"))
        own = number.isNull() | (number == 0) | (number == default_port(p["scheme"]))
        shown = F.when(own, F.lit("")).otherwise(F.concat(F.lit(":"), number.cast("string")))
        return F.concat(p["scheme"], F.lit("://"), _joined(p["host"]), shown, path, query)

    return F.when(url.isNotNull(), let(url, lambda u: let(_split(u), of)))


def url_host(url: Column) -> Column:
    return authority_host(F.regexp_extract(url, _PARTS, 2))


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def origin(url: Column) -> Column:
    """scheme://host[:port] of a URL."""
    return F.regexp_extract(url_for_compare(url), r"^([a-z]+://[^/]*)", 1)


def is_ip(host: Column) -> Column:
    return host.contains(":") | host.rlike(_V4)


def registrable_domain(host: Column, rules: Rules) -> Column:
    """Last two labels, or three under a multi-level suffix; null for IP literals and empty hosts."""
    suffixes = rules.names("registrable_domain", "multi_level_suffixes")

    def of(labels: Column) -> Column:
        last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
        return F.when(last(2).isin(suffixes) & (F.size(labels) >= 3), last(3)).otherwise(last(2))

    def named(bare: Column) -> Column:
        return F.when((bare != "") & ~is_ip(bare), let(F.split(bare, r"\."), of))

    return let(F.regexp_replace(F.lower(host), r"^\.+|\.+$", ""), named)
