"""Site lists: one entry point per line, comments and blanks left out, first of equal ones kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import urls
from waymark.functions.rules import Rules

SITE = ("raw", "url", "scheme", "host", "port", "is_ip", "domain")


def parse_sites(lines: DataFrame, rules: Rules, permissive: bool = False, line: str = "value", number: str = "line_no", path: str | None = None) -> DataFrame:
    """Sites of lines. A malformed line aborts with its number, or is left out with ``permissive``."""
    text = urls.python_strip(F.col(line))
    rows = lines.where((text != "") & ~text.startswith("#")).select(F.col(number).alias("line_no"), text.alias("raw"))
    rows = rows.withColumn("site", urls.site_struct(F.col("raw"), rules))
    where = F.concat(F.lit(f"{path or 'line'}:"), F.col("line_no").cast("string"), F.lit(": "), F.col("site.problem"))
    good = F.col("site.problem") == ""
    rows = rows.where(good if permissive else F.when(good, True).otherwise(F.raise_error(where).cast("boolean")))
    row = F.struct(
        "line_no", "raw", F.col("site.url").alias("url"), F.col("site.scheme").alias("scheme"), F.col("site.host").alias("host"),
        F.col("site.port").alias("port"), urls.is_ip(F.col("site.host")).alias("is_ip"), urls.registrable_domain(F.col("site.host"), rules).alias("domain"),
    )
    return rows.groupBy(F.col("site.url").alias("__key")).agg(F.min_by(row, "line_no").alias("s")).select("s.*")


def read_sites(spark: SparkSession, path: str, rules: Rules, permissive: bool = False) -> DataFrame:
    """The sites of a UTF-8 text file; line numbers count from 1. A list is one value of one task, so that its lines are numbered."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("at", "value")).withColumn("line_no", F.col("at") + 1)
    return parse_sites(lines, rules, permissive, path=path)
