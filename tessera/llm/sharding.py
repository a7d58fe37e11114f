"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

A shard owns ``vnodes`` points of a ring of RING places. A row falls on the
place of its key's hash and belongs to the next point clockwise. Shards have
exact capacities (row counts that differ by at most one and sum to the number
of rows); what overflows a full shard continues clockwise to the next point
whose shard has room. Only overflow moves, so a copy group stays together as
far as the capacities allow.

Spark counts rows per arc (one arc per virtual node: shards * vnodes rows,
whatever the input holds), the overflow walk runs over those counts, and its
result, a table of arc segments, goes back to the rows as a broadcast of that
same bounded size. Ranks inside an arc come from buckets of about BUCKET rows,
so a hot arc (one text may be a third of all rows) is spread over many tasks.
"""
from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RING = 1 << 16
BUCKET = 1000


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node, clockwise; a place belongs to one node only."""
    taken: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            n = 0
            while True:
                place = int.from_bytes(hashlib.sha256(f"{shard}/{v}/{n}".encode()).digest()[:4], "big") % RING
                if place not in taken:
                    break
                n += 1
            taken[place] = shard
    return sorted(taken.items())


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def overflow_walk(owners: list[int], counts: list[int], room: list[int]) -> list[tuple[int, int, int, int]]:
    """Segments (arc, from_rank, rows, shard) of a bounded-load ring.

    owners[a] is the shard of arc a's node, counts[a] its rows, room[s] the
    capacity of shard s; the capacities must sum to at least the counts.
    """
    room = list(room)
    out: list[tuple[int, int, int, int]] = []
    over: dict[int, tuple[int, int]] = {}
    for a, (s, n) in enumerate(zip(owners, counts)):
        own = min(n, room[s])
        if own:
            room[s] -= own
            out.append((a, 0, own, s))
        if n > own:
            over[a] = (own, n - own)
    carried: deque[list[int]] = deque()
    for lap in range(2):
        for a, s in enumerate(owners):
            if lap == 0 and a in over:
                carried.append([a, *over[a]])
            while carried and room[s]:
                arc, start, n = carried[0]
                k = min(n, room[s])
                room[s] -= k
                out.append((arc, start, k, s))
                if k == n:
                    carried.popleft()
                else:
                    carried[0] = [arc, start + k, n - k]
    return out


def shard_rows(df: DataFrame, key: Column, order: list[Column], shards: int = 40, vnodes: int = 64, prefix: str = "_shard") -> DataFrame:
    """df with ``{prefix}`` (0 to shards-1) and ``{prefix}_slot`` (gapless from 0 in the shard).

    key places a row on the ring, order ranks the rows of an arc: rows equal in
    both are interchangeable. Null keys share one place. An empty df gives an
    empty result. Columns of df are kept, whatever their names; those that
    begin with ``prefix`` must not exist.
    """
    spark = df.sparkSession
    nodes = ring(shards, vnodes)
    places = [p for p, _ in nodes]
    arcs = spark.createDataFrame([(p, bisect_left(places, p) % len(places)) for p in range(RING)], f"{prefix}_place int, {prefix}_arc int")
    placed = df.withColumn(f"{prefix}_place", F.pmod(F.xxhash64(key), F.lit(RING)).cast("int")).join(F.broadcast(arcs), f"{prefix}_place").drop(f"{prefix}_place")
    # Bounded by shards * vnodes rows.
    counts = [0] * len(nodes)
    for r in placed.groupBy(f"{prefix}_arc").count().collect():
        counts[r[0]] = r["count"]
    segments = overflow_walk([s for _, s in nodes], counts, capacities(sum(counts), shards))
    base = [0] * shards
    by_arc: dict[int, list[tuple[int, int, int, int]]] = {}
    for arc, start, n, s in sorted(segments):
        by_arc.setdefault(arc, []).append((start, start + n, s, base[s]))
        base[s] += n
    plan = spark.createDataFrame(
        [(a, -(-counts[a] // BUCKET), by_arc[a]) for a in by_arc],
        f"{prefix}_arc int, {prefix}_buckets int, {prefix}_segments array<struct<lo:long,hi:long,shard:int,base:long>>",
    )
    bucket = F.pmod(F.xxhash64(*order), F.col(f"{prefix}_buckets")).cast("int")
    dealt = placed.join(F.broadcast(plan.drop(f"{prefix}_segments")), f"{prefix}_arc").withColumn(f"{prefix}_bucket", bucket).drop(f"{prefix}_buckets")
    group = [f"{prefix}_arc", f"{prefix}_bucket"]
    # Per bucket: rows before it in its arc. The window sees a row per bucket, not per row.
    sums = dealt.groupBy(*group).count()
    before = sums.select(*group, (F.sum("count").over(Window.partitionBy(f"{prefix}_arc").orderBy(f"{prefix}_bucket")) - F.col("count")).alias(f"{prefix}_before"))
    ranked = dealt.withColumn(f"{prefix}_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)
    ranked = ranked.join(before, group).withColumn(f"{prefix}_rank", F.col(f"{prefix}_rank") + F.col(f"{prefix}_before"))
    ranked = ranked.join(F.broadcast(plan.drop(f"{prefix}_buckets")), f"{prefix}_arc")
    rank = F.col(f"{prefix}_rank")
    found = F.filter(F.col(f"{prefix}_segments"), lambda x: (x["lo"] <= rank) & (rank < x["hi"]))[0]
    ranked = ranked.withColumn(f"{prefix}_found", found)
    return ranked.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.col(f"{prefix}_found.shard").alias(prefix),
        (F.col(f"{prefix}_found.base") + rank - F.col(f"{prefix}_found.lo")).alias(f"{prefix}_slot"),
    )


def op1(spark, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Every document's shard of 40, under the law ``rows``: counts at most one apart.

    The ring key is the text, so equal texts lie together until a shard is
    full. A null text has no bytes and shares the place of the empty text.
    """
    from .common import table

    docs = table(spark, sf_dir, "documents") if docs is None else docs
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    out = shard_rows(rows, F.col("text_hash"), [F.col("doc_id"), F.col("text_hash")], prefix="shard")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("shard_slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
