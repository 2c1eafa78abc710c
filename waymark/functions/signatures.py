"""Signatures and fingerprints as STRUCT columns, and their fixed-size surrogates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions.urls import url_for_compare


def header_signature(etag: Column, modified: Column, server: Column, powered: Column, kind: Column) -> Column:
    """strong with all five values if there is a validator, else weak with the last three, else null."""
    strong = (etag != "") | (modified != "")
    weak = (server != "") | (powered != "") | (kind != "")
    none = F.lit("")
    return F.when(
        strong | weak,
        F.struct(
            F.when(strong, "strong").otherwise("weak").alias("kind"),
            F.when(strong, etag).otherwise(none).alias("etag"),
            F.when(strong, modified).otherwise(none).alias("last_modified"),
            server.alias("server"), powered.alias("powered"), kind.alias("content_type"),
        ),
    )


def redirect_signature(site_url: Column, final_url: Column, original_status: Column) -> Column:
    """redirect with the normalised final URL for a 3xx that leads elsewhere, else direct."""
    target = url_for_compare(F.when(F.coalesce(final_url, F.lit("")) == "", site_url).otherwise(final_url))
    moved = F.coalesce(original_status.between(300, 399), F.lit(False)) & (target != url_for_compare(site_url))
    return F.struct(F.when(moved, "redirect").otherwise("direct").alias("kind"), F.when(moved, target).otherwise("").alias("target"))


def structure_signature(title: Column, description: Column, keywords: Column, generator: Column, viewport: Column) -> Column:
    """The five case-folded texts; null if all are empty."""
    names = ("title", "description", "keywords", "generator", "viewport")
    parts = (title, description, keywords, generator, viewport)
    return F.when(F.concat_ws("", *parts) != "", F.struct(*[p.alias(n) for p, n in zip(parts, names, strict=True)]))


def key_path_signature(probes: Column) -> Column:
    """Sorted by path: status, body hash and validators; errors are left out."""
    return F.transform(probes, lambda p: F.struct(p["path"], p["status"], p["sha256"], p["content_type"], p["etag"], p["last_modified"]))


def shell_key_path_signature(probes: Column) -> Column:
    """Sorted by path: status, content type, payload signature or body hash, and the error."""
    return F.transform(
        probes, lambda p: F.struct(p["path"], p["status"], p["content_type"], F.coalesce(p["payload"], p["sha256"]).alias("content"), p["payload"].isNotNull().alias("structured"), p["error"])
    )


def surrogate(*parts: Column) -> Column:
    """A 64-digit key that is equal exactly for equal parts, nulls included."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)
