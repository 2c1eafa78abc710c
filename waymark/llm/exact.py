"""Exact de-duplication by progressive refinement (DataFrame functions only).

Three stages narrow the candidates before a whole text is hashed:

1. group by length in bytes; a length that occurs once ends there;
2. of the survivors, group by (length, hash of the first characters);
3. only rows of groups that still have two members get the full SHA-256.

The first pass over the texts keeps (length, prefix hash), on which stages 1 and 2
run; the second reads whole texts for stage 3. Groupings shuffle pre-aggregated counts. Rows meet a
group's verdict in a join whose right side is a stored table: broadcast behind a row
count, else shuffled, where AQE splits the hot key of a large group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.store import BROADCAST_ROWS, lookup_join, materialise, text_or_empty

PREFIX_CHARS = 64


def _refined(rows: DataFrame, text_col: str, prefix_chars: int, broadcast_rows: int) -> DataFrame:
    """``rows`` with ``__wm_full``, the full hash, which is null where stage 1 or 2 shows that the text is unique."""
    text = text_or_empty(text_col)
    sized = rows.withColumns({"__wm_len": F.octet_length(text), "__wm_pre": F.xxhash64(F.substring(text, 1, prefix_chars))})
    narrow = materialise(sized.select("__wm_len", "__wm_pre"), "sizes")
    lengths = materialise(narrow.groupBy("__wm_len").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__wm_len"), "lengths")
    survivors = lookup_join(narrow, lengths, ["__wm_len"], "left_semi", broadcast_rows)
    prefixes = materialise(
        survivors.groupBy("__wm_len", "__wm_pre")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("__wm_len", "__wm_pre", F.lit(True).alias("__wm_hit")),
        "prefixes",
    )
    met = lookup_join(sized, prefixes, ["__wm_len", "__wm_pre"], "left", broadcast_rows)
    return met.withColumn("__wm_full", F.when(F.col("__wm_hit"), F.sha2(text, 256))).drop("__wm_len", "__wm_pre", "__wm_hit")


def _groups(hashed: DataFrame) -> DataFrame:
    """Of each full hash that occurs twice or more, the largest id and the number of rows."""
    found = hashed.where("__wm_full is not null").groupBy("__wm_full").agg(F.max("__wm_id").alias("__wm_keep"), F.count(F.lit(1)).alias("__wm_n"))
    return materialise(found.where("__wm_n > 1"), "groups")


def _stays(id_: Column) -> Column:
    return F.col("__wm_n").isNull() | F.col("__wm_keep").eqNullSafe(id_)


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] = (),
    prefix_chars: int = PREFIX_CHARS,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per input row: id, ``carry``, full_hash, keep_id, group_size, kept.

    Texts are equal when identical; null counts as empty, so all null and empty
    texts form one group. Of equal texts the row with the largest id stays.
    ``full_hash`` is null where refinement ended before stage 3 (the text is
    unique). Repeated rows (same id, same text) all count in ``group_size`` and
    share one verdict. A null id never beats another; if a whole group has null
    ids, ``keep_id`` is null and its rows are marked kept. Ids may be of any type that
    has an order. A very long text is only ever a value of one row. An empty table gives
    an empty result; other columns are ignored, whatever their names.
    """
    extra = [f"__wm_c_{c}" for c in carry]
    rows = docs.select(F.col(id_col).alias("__wm_id"), *[F.col(c).alias(e) for c, e in zip(carry, extra, strict=True)], F.col(text_col).alias("__wm_t"))
    hashed = materialise(_refined(rows, "__wm_t", prefix_chars, broadcast_rows).select("__wm_id", *extra, "__wm_full"), "hashed")
    joined = lookup_join(hashed, _groups(hashed), ["__wm_full"], "left", broadcast_rows)
    return joined.select(
        F.col("__wm_id").alias(id_col),
        *[F.col(e).alias(c) for e, c in zip(extra, carry, strict=True)],
        F.col("__wm_full").alias("full_hash"),
        F.when(F.col("__wm_n").isNull(), F.col("__wm_id")).otherwise(F.col("__wm_keep")).alias("keep_id"),
        F.coalesce("__wm_n", F.lit(1)).cast("long").alias("group_size"),
        _stays(F.col("__wm_id")).alias("kept"),
    )


def drop_exact_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """``docs`` without the rows that ``exact_groups`` drops; all columns stay, whatever their names.

    Only rows that stages 1 and 2 leave in question are hashed. Two different texts under
    one id don't take each other away. Rows repeated under one id are one document
    here: they stay or go together. An empty table stays empty.
    """
    rows = docs.select(F.col(id_col).alias("__wm_id"), F.col(text_col).alias("__wm_t"), F.struct(*[F.col(c) for c in docs.columns]).alias("__wm_row"))
    refined = _refined(rows, "__wm_t", prefix_chars, broadcast_rows)
    groups = _groups(refined.select("__wm_id", "__wm_full"))
    return lookup_join(refined, groups, ["__wm_full"], "left", broadcast_rows).where(_stays(F.col("__wm_id"))).select("__wm_row.*")
