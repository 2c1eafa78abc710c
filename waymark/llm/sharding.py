"""Balanced label propagation into shards (DataFrame functions only).

Documents with equal texts are linked. A group of linked documents is kept as
one hub with a count per shard, never as pairs. In each round every group names
the shard that holds most of it among those with room, and its members in
shards with fewer neighbours ask to move there. Requests are admitted in hash
order up to each shard's quota, which counts what others leave in the same round, so that full shards
can swap; a request that only fits in part is admitted for that share of its members. Documents without links are ballast: they start by
hash and fill what the linked ones leave, so the final counts differ by one at
most (the law ``rows``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.store import lookup_join, materialise, ranked, text_or_empty

_SPLIT = 1 << 20
_BUCKETS = 1024


def quotas(flow: list[list[int]], room: list[int]) -> list[int]:
    """Rows that each shard can admit when ``flow[s][t]`` ask to go from s to t and ``room`` is free.

    A shard admits the share of its requests that fits into its room and what its
    own leavers free; shares sink until all fit together.
    """
    shards = range(len(room))
    asked = [sum(flow[s][t] for s in shards) for t in shards]
    share = [1.0] * len(room)
    for _ in range(200):
        share = [min(share[t], (room[t] + sum(flow[t][u] * share[u] for u in shards)) / asked[t]) if asked[t] else 1.0 for t in shards]
    return [int(share[t] * asked[t]) for t in shards]


def propagate(linked: DataFrame, shards: int, total: int) -> DataFrame:
    """Rounds of label propagation over (``__wm_g`` group, ``__wm_s`` shard, ...).

    ``total`` is the number of all documents, ballast included; a shard's quota for
    incoming members is total / shards less the linked rows it holds, and what leaves it. A
    member moves only to a shard where it has more neighbours (ties: by a hash of group
    and shard), so every round raises the number of linked pairs within shards or closes a
    shard, and rounds end when no request is left that an open shard has room for. A shard with less than a thousandth of its capacity to
    offer counts as full, lest rounds move single rows.
    """
    capacity = total // shards
    turn, gathered, closed, room = -1, -1, set(), [0] * shards
    while True:
        turn += 1
        cells = materialise(linked.groupBy("__wm_g", "__wm_s").agg(F.count(F.lit(1)).alias("__wm_n")), "cells")
        held = cells.groupBy("__wm_s").agg(F.sum("__wm_n").alias("n"), F.sum(F.col("__wm_n") * F.col("__wm_n")).alias("pairs")).collect()
        loads, pairs = {r["__wm_s"]: r["n"] for r in held}, sum(r["pairs"] for r in held)
        if pairs <= gathered:
            # a share of little room moved nothing: the shard counts as full from now on
            offered = [s for s in range(shards) if room[s]]
            closed.add(min(offered, key=room.__getitem__))
        gathered = pairs
        strength = F.struct(F.col("__wm_n").alias("n"), F.xxhash64("__wm_g", "__wm_s").alias("k"), F.col("__wm_s").alias("s"))
        wish = cells.groupBy("__wm_g").agg(F.max(strength).alias("b"), F.array_agg(strength).alias("c")).where("size(c) > 1")
        asks = wish.select(F.col("b.s").alias("t"), F.explode(F.filter("c", lambda c: c < F.col("b"))).alias("m"))
        flow = [[0] * shards for _ in range(shards)]
        for r in asks.groupBy(F.col("m.s").alias("s"), "t").agg(F.sum("m.n").alias("n")).collect():
            flow[r["s"]][r["t"]] = r["n"]
        free = [max(0, capacity - loads.get(s, 0)) for s in range(shards)]
        room = [n if n >= max(1, capacity // 1000) and s not in closed else 0 for s, n in enumerate(map(max, free, quotas(flow, free)))]
        if not any(room):
            break
        quota = F.element_at(F.array(*[F.lit(r) for r in room]), F.col("__wm_s").cast("int") + 1)
        best = cells.groupBy("__wm_g").agg(
            F.max(F.when(quota > 0, strength)).alias("__wm_best"),
            F.array_agg(strength).alias("__wm_cells"),
        )
        moving = F.aggregate(
            F.filter("__wm_cells", lambda c: c < F.col("__wm_best")), F.lit(0).cast("long"), lambda a, c: a + c["n"]
        )
        asks = best.where("__wm_best is not null").select(
            "__wm_g",
            F.col("__wm_best.s").alias("__wm_to"),
            F.col("__wm_best").alias("__wm_have"),
            moving.alias("__wm_ask"),
            F.pmod(F.xxhash64("__wm_g"), F.lit(_BUCKETS)).alias("__wm_b"),
        )
        asks = materialise(asks.where("__wm_ask > 0"), "asks")
        before = Window.partitionBy("__wm_to").orderBy("__wm_b").rowsBetween(Window.unboundedPreceding, -1)
        wanted = asks.groupBy("__wm_to", "__wm_b").agg(F.sum("__wm_ask").alias("__wm_sum"))
        room_to = F.element_at(F.array(*[F.lit(r) for r in room]), F.col("__wm_to").cast("int") + 1)
        left = room_to - F.coalesce(F.sum("__wm_sum").over(before), F.lit(0))
        share = F.greatest(F.lit(0), F.least(F.lit(_SPLIT), F.floor(left * _SPLIT / F.col("__wm_sum"))))
        admitted = wanted.select("__wm_to", "__wm_b", share.cast("long").alias("__wm_share")).where("__wm_share > 0")
        moves = materialise(asks.join(F.broadcast(admitted), ["__wm_to", "__wm_b"]).drop("__wm_b", "__wm_ask"), "moves")
        if not moves.take(1):
            break
        here = cells.withColumnRenamed("__wm_n", "__wm_here")
        turns = materialise(
            here.join(moves, "__wm_g")
            .where("struct(__wm_here, xxhash64(__wm_g, __wm_s), __wm_s) < __wm_have")
            .select("__wm_g", "__wm_s", "__wm_to", "__wm_share"),
            "turns",
        )
        goes = F.pmod(F.xxhash64("__wm_id", F.lit(turn)), F.lit(_SPLIT)) < F.col("__wm_share")
        linked = materialise(
            lookup_join(linked, turns, ["__wm_g", "__wm_s"], "left")
            .withColumn("__wm_s", F.when(goes, F.col("__wm_to")).otherwise(F.col("__wm_s")))
            .drop("__wm_to", "__wm_share"),
            "linked",
        )
    return linked


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, linked, shard, slot.

    Law ``rows``: the shards' row counts differ by one at most. ``slot`` numbers
    the rows of a shard from 0 without gaps. ``size`` is the text's UTF-8 bytes
    plus 1; a null text has no bytes and is linked with the empty ones. Repeated
    rows and null ids are rows like others (equal texts link them). A group too
    large for a shard spreads over as few as its rounds find room in. An empty
    table gives an empty result; other columns are ignored.
    """
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).alias("__wm_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("__wm_h"),
    )
    rows = materialise(rows.withColumn("__wm_g", F.xxhash64("__wm_h", "text_crc32", "size")), "rows")
    groups = materialise(
        rows.groupBy("__wm_h", "text_crc32", "size").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n").withColumn("linked", F.lit(True)),
        "hubs",
    )
    start = F.pmod(F.xxhash64(F.coalesce(F.col("__wm_id"), F.lit(0)), "__wm_h", F.lit("start")), F.lit(shards)).cast("int")
    placed = materialise(
        lookup_join(rows, groups, ["__wm_h", "text_crc32", "size"], "left")
        .withColumn("linked", F.coalesce("linked", F.lit(False)))
        .withColumn("__wm_s", start),
        "placed",
    )
    total = rows.count()
    settled = propagate(placed.where("linked"), shards, total)
    everyone = settled.unionByName(placed.where("not linked"))
    return _level(everyone, shards, total)


def _level(rows: DataFrame, shards: int, total: int) -> DataFrame:
    """Exact counts: what a shard holds beyond its target, ballast first, fills those below theirs."""
    ballast = F.col("linked").cast("int")
    counts = {(r["__wm_s"], r["linked"]): r["n"] for r in rows.groupBy("__wm_s", "linked").agg(F.count(F.lit(1)).alias("n")).collect()}
    target = [total // shards + (s < total % shards) for s in range(shards)]
    tied = [counts.get((s, True), 0) for s in range(shards)]
    have = [tied[s] + counts.get((s, False), 0) for s in range(shards)]
    over = [max(0, have[s] - target[s]) for s in range(shards)]
    before_over = [sum(over[:s]) for s in range(shards)]
    under = [max(0, target[s] - have[s]) for s in range(shards)]
    before_under = [sum(under[:s]) for s in range(shards)]
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), at.cast("int") + 1)
    order = ["__wm_id", "text_crc32", "size", "__wm_h"]
    seated = ranked(rows, ["__wm_s", "linked"], order, "__wm_rank")
    place = F.col("__wm_rank") + F.when(ballast == 1, F.lit(0)).otherwise(pick(tied, F.col("__wm_s")))
    seated = seated.withColumn("__wm_place", place)
    spare = F.col("__wm_place") - pick(target, F.col("__wm_s"))
    index = spare + pick(before_over, F.col("__wm_s"))
    goal = F.lit(-1)
    for s in range(shards):
        if under[s]:
            goal = F.when((index >= before_under[s]) & (index < before_under[s] + under[s]), F.lit(s)).otherwise(goal)
    seated = seated.withColumn("__wm_goal", F.when(spare < 0, F.col("__wm_s")).otherwise(goal).cast("int"))
    slot = F.when(spare < 0, F.col("__wm_place")).otherwise(
        pick(have, F.col("__wm_goal")) + index - pick(before_under, F.col("__wm_goal"))
    )
    return seated.select(
        F.col("__wm_id").alias("doc_id"),
        "size",
        "text_crc32",
        "linked",
        F.col("__wm_goal").alias("shard"),
        slot.cast("long").alias("slot"),
    )
