"""From analysed entry points to noise, merged groups and independent sites.

Group keys are fixed-size surrogates, group tables are aggregates, and members
meet their group in an equi-join; only the few edges between blocks go through the
iterative components step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import classify, urls
from waymark.functions import fixed as X
from waymark.operators.components import connected_components
from waymark.sources.scratch import materialise

SLIM = (
    "url scheme host port is_ip domain probe_error original_status final_status redirect_target title noise_reasons low_information "
    "auth_shell_like shell_type comparison_ready resolved_ips body_sha256 redirect_signature equivalence_fp shell_fp"
).split()
_SHELLS = ("deny_shell", "auth_api_shell", "low_information_shell")


def rank() -> Column:
    """Order of representatives: not redirected, https, port 443, not an IP, then the URL."""
    return F.struct(
        (F.col("redirect_signature.kind") == "redirect").cast("int").alias("r"),
        (F.col("scheme") != "https").cast("int").alias("s"),
        (F.col("port") != 443).cast("int").alias("p"),
        F.col("is_ip").cast("int").alias("i"),
        F.col("url").alias("u"),
    )


def representative() -> Column:
    return F.min(rank())["u"]


def _and(*conditions: Column) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out


def shell_candidates(sites: DataFrame) -> DataFrame:
    return sites.where(
        _and(F.col("probe_error") == "", F.size("noise_reasons") == 0, F.col("shell_fp").isNotNull(), F.col("shell_type").isin(*_SHELLS))
    )


def _groups(rows: DataFrame, keys: list[str], distinct: str) -> DataFrame:
    """Groups of at least two rows with at least two values of ``distinct``."""
    return (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("member_count"), F.min(distinct).alias("lo"), F.max(distinct).alias("hi"), representative().alias("representative"))
        .where("member_count >= 2 and lo < hi").drop("lo", "hi")
    )


def same_host_shells(sites: DataFrame) -> DataFrame:
    """(host, shell_fp, shell_type, member_count, representative): one host's ports with one shell."""
    return _groups(shell_candidates(sites), ["host", "shell_fp", "shell_type"], "port")


def subdomain_shells(sites: DataFrame) -> DataFrame:
    """(domain, port, resolved_ips, shell_fp, ...): one port and address set of a domain's hosts with one shell."""
    rows = shell_candidates(sites).where("not is_ip and domain is not null and domain <> '' and size(resolved_ips) > 0")
    return _groups(rows, ["domain", "port", "resolved_ips", "shell_fp", "shell_type"], "host")


def redirect_candidates(active: DataFrame) -> DataFrame:
    """Plain-HTTP sites whose 3xx leads to HTTPS on the same host."""
    target = F.col("redirect_target")
    return active.where(
        _and(
            F.size("noise_reasons") == 0, F.col("probe_error") == "", F.col("original_status").between(300, 399), target != "",
            F.col("scheme") == "http", urls.url_scheme(target) == "https", urls.url_host(target) == F.col("host"),
        )
    )


def equivalence_candidates(active: DataFrame) -> DataFrame:
    return active.where(
        _and(
            F.size("noise_reasons") == 0, F.col("probe_error") == "", ~F.col("auth_shell_like"), F.col("comparison_ready"),
            F.col("shell_type") == "", F.col("equivalence_fp").isNotNull(),
        )
    )


def same_host_equivalents(active: DataFrame) -> DataFrame:
    rows = equivalence_candidates(active).groupBy("host", "equivalence_fp")
    return rows.agg(F.count(F.lit(1)).alias("member_count"), representative().alias("representative")).where("member_count >= 2")


def same_domain_equivalents(active: DataFrame) -> DataFrame:
    rows = equivalence_candidates(active).where("not is_ip and not low_information and domain is not null and domain <> ''")
    return _groups(rows, ["domain", "equivalence_fp"], "host")


_CROSS = ["resolved_ips", "port", "final_status", "body_sha256", "equivalence_fp"]


def cross_domain_equivalents(active: DataFrame) -> DataFrame:
    rows = equivalence_candidates(active).where("not is_ip and not low_information and size(resolved_ips) > 0 and body_sha256 <> ''")
    return (
        rows.groupBy(*_CROSS)
        .agg(
            F.count(F.lit(1)).alias("member_count"), F.min("host").alias("lo"), F.max("host").alias("hi"), F.min("domain").alias("dlo"),
            F.max("domain").alias("dhi"), F.count("domain").alias("named"), representative().alias("representative"),
        )
        .where("member_count >= 2 and named = member_count and lo < hi and dlo < dhi")
        .drop("lo", "hi", "dlo", "dhi", "named")
    )


def block_key() -> Column:
    """Sites that same-host and same-domain equivalence link form one block per fingerprint and domain (or host)."""
    home = F.when(F.col("is_ip") | (F.coalesce("domain", F.lit("")) == ""), F.concat(F.lit("h:"), F.col("host"))).otherwise(F.concat(F.lit("d:"), F.col("domain")))
    return F.concat(F.lit("b:"), F.col("equivalence_fp"), F.lit("|"), home)


@dataclass
class Result:
    """Tables of one run; every input site is in exactly one of noise, members or independent."""

    sites: DataFrame
    noise: DataFrame
    groups: DataFrame
    members: DataFrame
    independent: DataFrame

    def summary(self) -> DataFrame:
        """One row of counters."""
        counts = {
            X.COUNT_INPUT: self.sites.agg(F.count(F.lit(1))), X.COUNT_FAILED: self.sites.where("probe_error <> ''").agg(F.count(F.lit(1))),
            X.COUNT_NOISE: self.noise.agg(F.count(F.lit(1))), X.COUNT_GROUPS: self.groups.agg(F.count(F.lit(1))),
            X.COUNT_MEMBERS: self.groups.agg(F.coalesce(F.sum("member_count"), F.lit(0))), X.COUNT_ALONE: self.independent.agg(F.count(F.lit(1))),
        }
        spark = self.sites.sparkSession
        return spark.createDataFrame([tuple(int(df.first()[0]) for df in counts.values())], ", ".join(f"`{k}` long" for k in counts))

    def failures(self, samples: int = 5) -> DataFrame:
        return failure_summary(self.sites, samples)


def failure_summary(sites: DataFrame, samples: int = 5) -> DataFrame:
    """Failed sites by category, most frequent first, with their least URLs.

    The least URLs are a top-k by rank, so no category is gathered whole.
    """
    from pyspark.sql import Window

    failed = sites.where("probe_error <> ''").select("url", classify.failure_category(F.col("probe_error")).alias("category"))
    counts = failed.groupBy("category").agg(F.count(F.lit(1)).alias("count"))
    ranked = failed.withColumn("k", F.row_number().over(Window.partitionBy("category").orderBy("url"))).where(F.col("k") <= samples)
    urls_ = ranked.groupBy("category").agg(F.array_sort(F.collect_list("url")).alias("sample_urls"))
    return counts.join(urls_, "category").orderBy(F.desc("count"), "category")


def converge(analysed: DataFrame) -> Result:
    """Scenarios in their order: same-host shells, subdomain shells, redirects, equivalences.

    The order is part of the meaning: what an earlier scenario takes, a later one
    doesn't see.
    """
    sites = materialise(analysed.select(*SLIM), "sites")
    host_groups = materialise(same_host_shells(sites), "host_shells")
    taken = shell_candidates(sites).join(host_groups.withColumnRenamed("representative", "rep"), ["host", "shell_fp", "shell_type"])
    in_hosts = materialise(taken.select("url", "shell_type", "rep"), "in_host_shells")
    rest = sites.join(in_hosts.select("url"), "url", "left_anti")
    sub_groups = materialise(subdomain_shells(rest), "sub_shells")
    keys = ["domain", "port", "resolved_ips", "shell_fp", "shell_type"]
    in_subs = materialise(
        shell_candidates(rest).where("not is_ip").join(sub_groups.withColumnRenamed("representative", "rep"), keys).select("url", "rep"), "in_sub_shells"
    )
    denied = in_hosts.where("shell_type = 'deny_shell'").select("url", F.lit(True).alias("denied"))
    noise = (
        sites.join(denied, "url", "left").where("size(noise_reasons) > 0 or denied")
        .select("url", F.array_sort(F.when(F.col("denied"), F.array_union("noise_reasons", F.array(F.lit(X.NOISE_DENY)))).otherwise(F.col("noise_reasons"))).alias("reasons"), "title", F.col("final_status").alias("status_code"))
    )
    active = materialise(rest.join(in_subs.select("url"), "url", "left_anti").where("size(noise_reasons) = 0"), "active")
    moved, outside = redirects(active)
    inner = materialise(active.join(outside.select("url"), "url", "left_anti"), "inner")
    labelled = materialise(component_members(inner, moved), "labelled")
    parts = component_groups(labelled)
    shells = in_hosts.where("shell_type <> 'deny_shell'").select("url", F.col("rep").alias("representative")).withColumns({"group_type": F.lit(X.SAME_HOST_SHELL), "reason": F.lit(X.WHY_SAME_HOST_SHELL)})
    subs = in_subs.select("url", F.col("rep").alias("representative")).withColumns({"group_type": F.lit(X.SUBDOMAIN_SHELL), "reason": F.lit(X.WHY_SUBDOMAIN_SHELL)})
    merged = labelled.join(parts, "component").select("url", "representative", "group_type", "reason")
    external = outside.select("url", F.col("redirect_target").alias("representative"), F.lit(X.HTTP_TO_HTTPS).alias("group_type"), F.lit(X.WHY_HTTP_TO_HTTPS).alias("reason"))
    named = ["url", "representative", "group_type", "reason"]
    inside = shells.select(named).withColumn("group_id", F.concat(F.lit("A:"), "representative"))
    inside = inside.unionByName(subs.select(named).withColumn("group_id", F.concat(F.lit("B:"), "representative")))
    inside = inside.unionByName(merged.withColumn("group_id", F.concat(F.lit("C:"), "representative")))
    inside = inside.unionByName(external.withColumn("group_id", F.concat(F.lit("X:"), "url")))
    members = materialise(inside, "members")
    groups = members.groupBy("group_id", "group_type", "representative", "reason").agg(F.count(F.lit(1)).alias("member_count"))
    noise = materialise(noise, "noise")
    alone = sites.join(noise.select("url"), "url", "left_anti").join(members.select("url"), "url", "left_anti")
    reason = classify.independent_reason(F.col("probe_error") != "", F.col("is_ip"), F.col("low_information"), F.col("auth_shell_like"), F.col("comparison_ready"))
    independent = alone.select("url", reason.alias("reason"), "title", F.col("final_status").alias("status_code"))
    return Result(sites, noise, groups, members, independent)


def redirects(active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst) to targets among the active sites, and the sites whose target is not among them."""
    source = materialise(redirect_candidates(active), "redirects")
    there = active.select(F.col("url").alias("redirect_target"))
    edges = source.join(there, "redirect_target").select(F.col("url").alias("src"), F.col("redirect_target").alias("dst"))
    return edges, materialise(source.join(there, "redirect_target", "left_anti"), "external")


def component_members(inner: DataFrame, redirects_: DataFrame) -> DataFrame:
    """Sites of components with at least two members: the slim columns and ``component``.

    Blocks stand for their sites; only blocks joined by a cross-domain key and
    sites joined by a redirect are edges of the graph.
    """
    nodes = materialise(
        inner.join(equivalence_candidates(inner).select("url", block_key().alias("block")), "url", "left").withColumn("node", F.coalesce("block", F.concat(F.lit("u:"), "url"))),
        "nodes",
    )
    equal = equivalence_candidates(nodes)
    cross = cross_domain_equivalents(inner).select(*_CROSS)
    linked = equal.where("not is_ip and size(resolved_ips) > 0").join(cross, _CROSS).select(*_CROSS, "node")
    hubs = linked.groupBy(*_CROSS).agg(F.min("node").alias("hub"))
    across = linked.join(hubs, _CROSS).where("node <> hub").select(F.col("node").alias("src"), F.col("hub").alias("dst"))
    at = nodes.select("url", "node")
    moved = redirects_.join(at.withColumnRenamed("url", "src").withColumnRenamed("node", "a"), "src").join(at.withColumnRenamed("url", "dst").withColumnRenamed("node", "b"), "dst")
    edges = materialise(across.unionByName(moved.select(F.col("a").alias("src"), F.col("b").alias("dst"))).distinct(), "block_edges")
    parts = materialise(connected_components(edges), "block_parts")
    placed = materialise(nodes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    sizes = materialise(placed.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "sizes")
    return placed.join(sizes, "component").select("component", *SLIM)


def component_groups(members: DataFrame) -> DataFrame:
    """(component, representative, group_type, reason) of labelled components."""
    base = members.groupBy("component").agg(
        representative().alias("representative"), F.count(F.lit(1)).alias("n"), F.min("host").alias("h1"), F.max("host").alias("h2"),
        F.min("domain").alias("d1"), F.max("domain").alias("d2"), F.count("domain").alias("named"),
    )
    base = materialise(base, "bases")
    targets = members.where("redirect_signature.kind = 'redirect'").select("component", "url", F.col("redirect_signature.target").alias("to"))
    to_rep = targets.join(base.select("component", "representative"), "component").where((F.col("url") != F.col("representative")) & (F.col("to") == urls.url_for_compare(F.col("representative"))))
    led = base.join(to_rep.select("component").distinct().withColumn("led", F.lit(True)), "component", "left").withColumn("led", F.coalesce("led", F.lit(False)))
    one_host = F.col("h1") == F.col("h2")
    domains = F.coalesce(F.col("d1") != F.col("d2"), F.lit(False)) | ((F.col("named") > 0) & (F.col("named") < F.col("n")))
    kind = (
        F.when(F.col("led") & (F.col("n") == 2) & one_host, X.HTTP_TO_HTTPS).when(one_host, X.SAME_HOST).when(domains, X.CROSS_DOMAIN).otherwise(X.SAME_DOMAIN)
    )
    why = (
        F.when(kind == X.HTTP_TO_HTTPS, X.WHY_HTTP_TO_HTTPS)
        .when((kind == X.SAME_HOST) & F.col("led"), X.WHY_SAME_HOST_REDIRECT)
        .when(kind == X.SAME_HOST, X.WHY_SAME_HOST)
        .when(kind == X.CROSS_DOMAIN, X.WHY_CROSS_DOMAIN).otherwise(X.WHY_SAME_DOMAIN)
    )
    return led.select("component", "representative", kind.alias("group_type"), why.alias("reason"))
