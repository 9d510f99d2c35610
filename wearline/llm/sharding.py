"""Shards by balanced label propagation (DataFrame functions only).

Documents with equal texts are linked.  Linked documents start on the shard of
their id's hash.  One aggregate counts every group's documents per shard, and
the whole group takes the label that most of its documents have.  Labels above
a shard's quota are then passed on: a group that is whole on one shard is as
whole on any other, so shards above their quota hand whole groups to shards
with room, by a hash of the group until little is left and by an exact pick
from a bounded number of candidates in the end.  No free room is needed for
that, also where every row has a copy.  Groups above 1/32 of a shard, of which
there are at most 32 per shard, are placed before by best fit decreasing, one
above every room left on as few shards as hold it.  Documents without a link
have no edge to cut; they fill what is left, so that row counts differ by one
at most (law ``rows``).

The driver sees one row per shard (its load) and a number of groups per shard
that does not grow with the rows, never rows per document.  A group of any size
is only counted, and its rows are spread over all tasks.

Defined cases: a null text has size 16, CRC 0 and no link; empty texts are
linked like others; repeated ids or rows are rows of their own; an empty table
gives no row; only the id and the text column are read.
"""

from __future__ import annotations

import heapq
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import numbered, row_key, store

OVERHEAD = 16
GROUP = ["_group1", "_group2"]
#: Groups above this part of a shard are placed one by one.
PARTS = 32
CANDIDATES = 128


def _shard_table(docs: DataFrame, values: dict[int, dict]) -> DataFrame:
    """Per-shard numbers as literals: as many entries as there are shards."""
    entries = ", ".join(f"struct({s} AS _s, " + ", ".join(f"CAST({v} AS {'DOUBLE' if isinstance(v, float) else 'BIGINT'}) AS {k}" for k, v in row.items()) + ")" for s, row in values.items())
    return docs.sparkSession.range(1).select(F.inline(F.expr(f"array({entries})")))


def best_fit(groups: list[tuple[int, int]], rooms: dict[int, int]) -> list[tuple[int, int, int, int]]:
    """(group, first number, number after the last, shard) of every piece; ``groups`` are (size, group)."""
    left, out = dict(rooms), []
    heap = [(-size, group, 0) for size, group in groups]
    heapq.heapify(heap)
    while heap:
        size, group, begin = heapq.heappop(heap)
        size = -size
        fits = [(room, s) for s, room in left.items() if room >= size]
        room, s = min(fits) if fits else max((room, s) for s, room in left.items())
        take = min(size, room)
        out.append((group, begin, begin + take, s))
        left[s] -= take
        if take < size:
            heapq.heappush(heap, (take - size, group, begin + take))
    return out


def _place_large(large: DataFrame, rooms: dict[int, int], buckets: int) -> tuple[DataFrame, dict[int, int]]:
    """Rows of large groups with their shard, and the room left."""
    found = large.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n")).collect()  # at most PARTS per shard
    if not found:
        return large, rooms
    found.sort(key=lambda r: (r["n"], r["_group1"], r["_group2"]))
    pieces = best_fit([(r["n"], k) for k, r in enumerate(found)], rooms)
    names = _shard_table(large, {k: {"_l1": r["_group1"], "_l2": r["_group2"]} for k, r in enumerate(found)}).withColumnRenamed("_s", "_large")
    cuts = _shard_table(large, {k: dict(zip(("_of", "_lo", "_hi", "_aim"), x, strict=True)) for k, x in enumerate(pieces)}).drop("_s")
    named = large.join(F.broadcast(names), (F.col("_group1") == F.col("_l1")) & (F.col("_group2") == F.col("_l2"))).drop("_l1", "_l2")
    deal = F.pmod(F.xxhash64("_u", F.lit("large")), F.lit(buckets))
    rows = numbered(named.withColumns({"_bucket": deal, "_order": F.col("_u")}), "_large", "_nth", buckets).drop("_bucket", "_order")
    inside = (F.col("_large") == F.col("_of")) & (F.col("_nth") >= F.col("_lo")) & (F.col("_nth") < F.col("_hi"))
    placed = rows.join(F.broadcast(cuts), inside).withColumn("_shard", F.col("_aim").cast("int")).select(*large.columns)
    left = dict(rooms)
    for _, begin, end, s in pieces:
        left[s] -= end - begin
    return store(placed, "shard-large"), left


def _loads(groups: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    rows = groups.groupBy("_shard").agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k")).collect()
    return {r["_shard"]: r["n"] for r in rows}, {r["_shard"]: r["k"] for r in rows}


def balance(groups: DataFrame, rooms: dict[int, int], rounds: int) -> DataFrame:
    """Pass whole groups (``_group1``, ``_group2``, ``_n``, ``_shard``) from shards above ``rooms`` to others."""
    for step in range(rounds):
        load, _ = _loads(groups)
        above = {s: n - rooms[s] for s, n in load.items() if n > rooms[s]}
        free = {s: r - load.get(s, 0) for s, r in rooms.items() if r > load.get(s, 0)}
        if not above or not free or sum(above.values()) <= len(rooms):
            break
        total, ends = sum(free.values()), {}
        for s, n in free.items():
            ends[s] = (sum(free[x] for x in ends) + n) / total
        draw = lambda name: F.pmod(F.xxhash64(*GROUP, F.lit(step), F.lit(name)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        to = draw("aim")
        aim = reduce(lambda c, s: F.when(to < F.lit(ends[s]), F.lit(s)).otherwise(c), list(free)[::-1][1:], F.lit(list(free)[-1]))
        share = F.broadcast(_shard_table(groups, {s: {"_share": n / load[s]} for s, n in above.items()}))
        told = groups.join(share, F.col("_shard") == F.col("_s"), "left")
        goes = F.coalesce(draw("go") < F.col("_share"), F.lit(False))
        groups = store(told.select(*GROUP, "_n", F.when(goes, aim).otherwise(F.col("_shard")).cast("int").alias("_shard")), "shard-labels")
    return _settle(groups, rooms)


def _settle(groups: DataFrame, rooms: dict[int, int]) -> DataFrame:
    """Exact moves for what the draws left above ``rooms``, among some ``CANDIDATES`` groups per shard."""
    load, count = _loads(groups)
    above = {s: n - rooms[s] for s, n in load.items() if n > rooms[s]}
    free = {s: r - load.get(s, 0) for s, r in rooms.items() if r > load.get(s, 0)}
    if not above or not free:
        return groups
    share = F.broadcast(_shard_table(groups, {s: {"_share": min(1.0, CANDIDATES / count[s])} for s in above}))
    draw = F.pmod(F.xxhash64(*GROUP, F.lit("settle")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = groups.join(share, F.col("_shard") == F.col("_s")).where(draw < F.col("_share")).collect()
    moves: dict[int, dict] = {}
    for r in sorted(some, key=lambda r: (-r["_n"], r["_group1"], r["_group2"])):
        n, s = r["_n"], r["_shard"]
        fits = [(room, t) for t, room in free.items() if room >= n]
        if n <= above[s] and fits:
            t = min(fits)[1]
            above[s] -= n
            free[t] -= n
            moves[len(moves)] = {"_l1": r["_group1"], "_l2": r["_group2"], "_aim": t}
    if not moves:
        return groups
    told = groups.join(F.broadcast(_shard_table(groups, moves).drop("_s")), (F.col("_group1") == F.col("_l1")) & (F.col("_group2") == F.col("_l2")), "left")
    return told.select(*GROUP, "_n", F.coalesce(F.col("_aim"), F.col("_shard")).cast("int").alias("_shard"))


def propagate(linked: DataFrame, rooms: dict[int, int], rounds: int) -> DataFrame:
    """Move linked documents (``_group1``, ``_group2``, ``_u``, ``_shard``) to the label of most of their group, under ``rooms``."""
    cells = linked.groupBy(*GROUP, "_shard").agg(F.count(F.lit(1)).alias("_n"))
    most = F.max_by("_shard", F.struct("_n", F.xxhash64("_shard", "_group1")))
    groups = store(cells.groupBy(*GROUP).agg(F.sum("_n").alias("_n"), most.alias("_shard")), "shard-labels")
    return linked.drop("_shard").join(balance(groups, rooms, rounds).drop("_n"), GROUP).select(*linked.columns)


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", rounds: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, linked) for every row of ``docs``."""
    text = F.col(text_col)
    data = F.encode(text, "UTF-8")
    g1, g2 = row_key(text)
    base = store(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(data), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
            F.coalesce(F.crc32(data), F.lit(0)).cast("long").alias("text_crc32"),
            text.isNotNull().alias("_has_text"), g1.alias("_group1"), g2.alias("_group2"),
            F.xxhash64(F.col(id_col), F.lit("unit")).alias("_u"),
        ),
        "shard-documents",
    )
    total = base.count()
    quotas = {s: total // shards + (s < total % shards) for s in range(shards)}
    # read back, both sides of the next join are plain exchanges: a hot group is split
    twice = base.where("_has_text").groupBy("_group1", "_group2").agg(F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
    marked = base.join(store(twice, "shard-groups"), ["_group1", "_group2"], "left")
    start = F.pmod(F.xxhash64("_u", F.lit("start")), F.lit(shards)).cast("int")
    marked = store(marked.withColumn("_shard", F.when(F.col("_copies").isNotNull(), start)), "shard-linked")
    linked = marked.where(F.col("_copies").isNotNull())
    is_large = F.col("_copies") > total // shards / PARTS
    large, rooms = _place_large(linked.where(is_large).withColumn("_late", F.lit(0)), quotas, max(64, total // 50_000))
    small = propagate(linked.where(~is_large).withColumn("_late", F.lit(1)), rooms, rounds)
    linked = large.unionByName(small)
    return _place(linked, marked.where(F.col("_copies").isNull()), shards, quotas, total)


def _place(linked: DataFrame, single: DataFrame, shards: int, quotas: dict[int, int], total: int) -> DataFrame:
    """Give every row its shard and slot: linked rows within the quota, then all others in the room left."""
    buckets = max(64, total // 50_000)
    deal = F.pmod(F.xxhash64("_u", "_group1", F.lit("slot")), F.lit(buckets))
    # above the quota are the last numbers, which small groups have, each in one run
    together = F.pmod(F.xxhash64("_group1", F.lit("slot")), F.lit(buckets))
    own = F.when(F.col("_late") == 0, deal).otherwise(together + buckets)
    ranked = numbered(
        linked.withColumns({"_bucket": own, "_order": F.col("_group1"), "_order2": F.col("_u")}), "_shard", "slot", buckets
    )
    quota = F.broadcast(_shard_table(linked, {s: {"_quota": q} for s, q in quotas.items()}))
    ranked = store(ranked.join(quota, F.col("_shard") == F.col("_s")).drop("_s"), "shard-ranked")
    load = {r["_shard"]: r["n"] for r in ranked.groupBy("_shard").agg(F.least(F.max("slot") + 1, F.first("_quota")).alias("n")).collect()}
    columns = ["doc_id", "size", "text_crc32", "_group1", "_u"]
    rest = ranked.where("slot >= _quota").select(*columns, F.lit(True).alias("linked")).unionByName(
        single.select(*columns, F.lit(False).alias("linked"))
    )
    rest = numbered(
        rest.withColumns({"_all": F.lit(0), "_bucket": F.when(F.col("linked"), together).otherwise(deal), "_order": F.col("_group1"), "_order2": F.col("_u")}), "_all", "_place", buckets
    )
    rooms, begin = {}, 0
    for s in range(shards):
        free = quotas[s] - load.get(s, 0)
        if free:
            rooms[s] = {"_lo": begin, "_hi": begin + free, "_load": load.get(s, 0)}
        begin += free
    out = ["doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "linked"]
    placed = ranked.where("slot < _quota").withColumns({"shard": F.col("_shard").cast("int"), "linked": F.lit(True)}).select(*out)
    if not rooms:
        return placed
    # one CASE arm per shard with room
    arm = lambda value: reduce(lambda c, s: c.when(F.col("_place") < rooms[s]["_hi"], value(s)), list(rooms)[1:], F.when(F.col("_place") < rooms[list(rooms)[0]]["_hi"], value(list(rooms)[0])))
    filled = rest.withColumns({
        "shard": arm(lambda s: F.lit(s)).cast("int"),
        "slot": F.col("_place") + arm(lambda s: F.lit(rooms[s]["_load"] - rooms[s]["_lo"])).cast("long"),
    }).select(*out)
    return placed.unionByName(filled)
