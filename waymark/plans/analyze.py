"""Recorded responses to one analysed row per entry point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import classify, signatures, urls
from waymark.functions.fixed import NOISE_MAINTENANCE
from waymark.functions.pages import key_path_udf, page_udf, resolved_url
from waymark.functions.rules import Rules

RESPONSE = "struct<url:string,status:int,headers:map<string,string>,body:binary>"
RESPONSES = (
    f"raw string, resolved_ips array<string>, probe_error string, first {RESPONSE}, final {RESPONSE}, "
    "key_paths array<struct<path:string,status:int,headers:map<string,string>,body:binary,error:string>>"
)
_HEADERS = ("etag", "last-modified", "server", "x-powered-by", "content-type")


def header(headers: Column, name: str) -> Column:
    """A header's value by lower-case name; the last of names that differ by case."""
    hits = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name)
    return F.coalesce(F.try_element_at(hits, F.lit(-1))["value"], F.lit(""))


def analyze(responses: DataFrame, rules: Rules, plainly: bool = False) -> DataFrame:
    """Features, classes, signatures and fingerprints of every site, keep-first by its URL.

    ``responses`` has the columns of ``RESPONSES`` (and ``line_no``, if the first of
    equal sites is to be told). A site whose page can't be read keeps what was found
    and gets the error; one that was never fetched has nulls for its statuses. ``plainly``
    reads titles and texts by the plain patterns of ``functions/pages.py``.
    """
    site = urls.site_struct(F.col("raw"), rules)
    rows = responses.withColumn("site", site).where("site.problem = ''")
    order = F.col("line_no") if "line_no" in responses.columns else F.col("raw")
    most = int(rules.get("max_body_bytes"))
    body = F.substring(F.col("final.body"), 1, most)
    ok = F.coalesce(F.col("probe_error"), F.lit("")) == ""
    final_url = F.when(F.coalesce(F.col("final.url"), F.lit("")) == "", F.col("site.url")).otherwise(F.col("final.url"))
    page = page_udf(rules.patterns("http", "html_content_types"), plainly)
    # bodies are parsed where they are read and never shuffled; equal sites are told on what is left
    parsed = rows.select(
        order.alias("__order"), "raw", F.col("site.url").alias("url"), F.col("site.scheme").alias("scheme"), F.col("site.host").alias("host"), F.col("site.port").alias("port"),
        urls.is_ip(F.col("site.host")).alias("is_ip"), urls.registrable_domain(F.col("site.host"), rules).alias("domain"),
        F.array_sort(F.array_distinct(F.coalesce("resolved_ips", F.array().cast("array<string>")))).alias("resolved_ips"),
        F.coalesce("probe_error", F.lit("")).alias("given_error"), F.col("first.status").alias("original_status"),
        F.col("final.status").alias("final_status"), final_url.alias("final_url"), body.alias("body"),
        resolved_url(F.col("first.url"), header(F.col("first.headers"), "location")).alias("location"),
        page(final_url, body, F.array(*[header(F.col("final.headers"), h) for h in _HEADERS])).alias("page"),
        key_path_udf("key_paths").alias("probes"),
    )
    flat = parsed.select(
        *[c for c in parsed.columns if c not in ("page", "body")], "page.*",
        F.coalesce(F.octet_length("body"), F.lit(0)).alias("body_length"), F.when(F.col("body").isNotNull(), F.sha2("body", 256)).otherwise("").alias("body_sha256"),
    )
    everything = F.struct(*[F.col(c) for c in flat.columns if c != "__order"])
    flat = flat.groupBy(F.col("url").alias("__key")).agg(F.min_by(everything, "__order").alias("r")).select("r.*")
    return _classified(flat, rules)


def _classified(flat: DataFrame, rules: Rules) -> DataFrame:
    c = F.col
    failed = (c("given_error") != "") | (c("problem") != "")
    empty = F.array().cast("array<string>")
    flat = flat.withColumns(
        {
            "probe_error": F.when(c("given_error") != "", c("given_error")).otherwise(c("problem")),
            "failed": failed,
            "redirect_target": F.coalesce(urls.url_for_compare(c("location")), F.lit("")),
            "final_url_normalized": urls.url_for_compare(c("final_url")),
            "final_origin": urls.origin(c("final_url")),
            "noise_page": classify.noise_reasons(c("final_status"), c("body_length"), c("title_cf"), c("body_cf"), c("response_cf"), c("server_cf"), rules),
            "default_page_hit": ~failed & classify.default_page(c("title_cf"), c("body_cf"), rules),
        }
    )
    low = classify.low_information(c("body_length"), c("body_text"), c("loads"), c("resources"), rules) | c("default_page_hit")
    flat = flat.withColumn("low_information", ~failed & low)
    shell_body = F.when(c("response_text") != "", c("response_cf")).otherwise(c("body_cf"))
    flat = flat.withColumns(
        {
            "auth_shell_like": ~failed & classify.auth_like(c("title"), c("body_text"), c("final_url_normalized"), c("forms"), c("links"), rules),
            "shell_type": F.when(failed, "").otherwise(classify.shell_type(c("final_status"), c("content_type"), c("title_cf"), shell_body, c("low_information"), rules)),
        }
    )
    noisy = F.when(c("shell_type") == "maintenance_shell", F.array_union("noise_page", F.array(F.lit(NOISE_MAINTENANCE)))).otherwise(c("noise_page"))
    meta = [F.element_at("meta_cf", i) for i in (1, 2, 3, 4)]
    flat = flat.withColumns(
        {
            "shell_reason": classify.shell_reason(c("shell_type")),
            "noise_reasons": F.when(failed, empty).otherwise(F.array_sort(noisy)),
            "header_signature": F.when(~failed, signatures.header_signature(c("etag"), c("last_modified"), c("server_cf"), c("powered_cf"), c("content_type"))),
            "redirect_signature": F.when(~failed, signatures.redirect_signature(c("url"), c("final_url"), c("original_status"))),
            "structure_signature": F.when(~failed, signatures.structure_signature(c("title_cf"), *meta)),
            "key_path_signature": signatures.key_path_signature(c("probes")),
        }
    )
    ready = (
        ~failed & c("header_signature").isNotNull() & c("structure_signature").isNotNull()
        & (F.size("resources") > 0) & (F.size("probes") > 0)
    )
    five = ("header_signature", "redirect_signature", "structure_signature", "resources", "key_path_signature")
    gate = ~failed & (c("shell_type") != "") & c("final_status").isNotNull() & (c("content_type") != "") & (c("body_sha256") != "") & (F.size("probes") > 0)
    exact = signatures.surrogate(c("shell_type"), c("final_status"), c("content_type"), c("body_sha256"), c("key_path_signature"))
    merged = signatures.surrogate(
        c("shell_type"), c("final_status"), c("content_type"), c("server_cf"), F.coalesce(c("payload"), F.concat(F.lit("raw_sha256:"), c("body_sha256"))),
        signatures.shell_key_path_signature(c("probes")),
    )
    return flat.withColumns(
        {
            "comparison_ready": ready,
            "equivalence_fp": F.when(ready, signatures.surrogate(*[c(n) for n in five])),
            "shell_fp": F.when(gate, F.when(c("shell_type").isin("deny_shell", "auth_api_shell"), merged).otherwise(exact)),
            "body_text_excerpt": F.substring("body_text", 1, 4000),
            "response_text_excerpt": c("response_text"),
        }
    ).drop("given_error", "problem", "noise_page", "location", "body_text", "response_text", "title_cf", "body_cf", "response_cf", "meta_cf", "forms", "links", "failed")
