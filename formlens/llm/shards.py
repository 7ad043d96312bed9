"""Shards of nearly equal bytes by Karmarkar-Karp differencing over indivisible groups.

Differencing keeps partial partitions, at first one for each group, and again and again joins the two with the largest
spread, the larger parts of one to the smaller of the other. One heap for all groups would be one task, so groups are
dealt by hash into cells that are differenced on their own; a cell's result is again a partial partition, and the
cells' partitions are differenced in the same way, cell by cell, until one is left. A group that fills a shard by
itself gets one: no partition is more even. Other groups of an eighth of a shard or more, at most eight times as many
as shards, are differenced first; each cell then starts from its share of their partition, so it fills what they leave.
Cells' partitions are then joined with parts changing places only among shards that hold equally much of such groups.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fresh, numbered, small, stage, whole_groups

#: Partial partitions that one task joins, about.
CELL = 4096
#: Groups of at least so small a part of a shard are placed before the cells.
HEAVY = 8


def text_size(column: str = "text") -> Column:
    """UTF-8 bytes (none for null) plus 16."""
    return F.octet_length(F.coalesce(F.col(column).cast("string"), F.lit(""))).cast("long") + 16


def shard(docs: DataFrame, shards: int = 40, column: str = "text", cell: int = CELL) -> DataFrame:
    """docs with `size`, `text_crc32` (longs), `law` ('bytes'), `shard` (int), `slot` (long) and `grown_shard` (null int).

    Rows of equal text, null and empty ones alike, stay in one shard, also when they are a large share of all rows.
    Slots are gapless from 0 in each shard. Repeated rows and null or repeated ids are rows like others; with fewer
    groups than shards some shards are empty. An empty table gives an empty table. Columns of docs that are named as a
    result column are replaced.
    """
    made = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    own = [c for c in docs.columns if c.lower() not in made]
    group = fresh(docs, "_group")
    text = F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")
    rows = docs.withColumns({"size": text_size(column), "text_crc32": F.crc32(text), group: F.unhex(F.md5(text))})
    weights = rows.groupBy(F.col(group).alias("item")).agg(F.sum("size").alias("weight"))
    at = partition(stage(weights, "weights"), shards, cell).select(F.col("item").alias(group), "shard")
    rows = rows.select(*[F.col(f"`{c}`") for c in own], "size", "text_crc32", group).join(small(at, 48), group)
    order = ["doc_id", group] if "doc_id" in own else [group]
    rows = numbered(stage(rows.select([c for c in rows.columns]), "placed"), "slot", "shard", order)
    return rows.select(*[F.col(f"`{c}`") for c in own], "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def partition(weights: DataFrame, shards: int, cell: int = CELL) -> DataFrame:
    """item, shard for staged rows item (binary), weight (long)."""
    total, n = weights.agg(F.sum("weight"), F.count("*")).first()
    alone = []
    for r in weights.orderBy(F.desc("weight"), "item").limit(shards - 1).collect():
        if r.weight * (shards - len(alone)) < total:
            break
        alone.append(r.item)
        total -= r.weight
    n -= len(alone)
    k = shards - len(alone)
    large = weights.filter(F.col("weight") * (HEAVY * k) >= total).filter(~F.col("item").isin(alone) if alone else F.lit(True)).collect()
    parts, taken = differenced([[r.weight] for r in large], k)
    kinds = np.unique(taken, return_inverse=True)[1] if large else None
    own = [(bytes(x), k + i) for i, x in enumerate(alone)] + [(bytes(r.item), p[0]) for r, p in zip(large, parts, strict=True)]
    own = weights.sparkSession.createDataFrame(own, "item binary, shard int")
    items = weights.join(F.broadcast(own), "item", "left_anti").select("item", F.array("weight").alias("sums"))
    levels = []
    while True:
        cells = max(1, -(-n // cell))
        dealt = items.withColumn("cell", F.pmod(F.xxhash64("item", F.lit(len(levels))), F.lit(cells)))
        joined = dealt.select("cell", "item", "sums").repartition(cells, "cell").sortWithinPartitions("cell")
        beside = [x / max(1, total - sum(taken)) for x in taken] if large and not levels else None
        level = stage(joined.mapInArrow(partial(_difference, k=k, beside=beside, kinds=kinds if levels else None), "cell long, item binary, parts array<int>, sums array<long>"), "level")
        levels.append(level.select("cell", "item", "parts"))
        if cells == 1:
            break
        items, n = level.filter("sums is not null").select(F.encode(F.col("cell").cast("string"), "utf-8").alias("item"), "sums"), cells
    # Down again: where the parts of a cell have gone.
    where = levels.pop().select("item", "parts")
    while levels:
        level = levels.pop().withColumn("up", F.encode(F.col("cell").cast("string"), "utf-8"))
        where = level.join(where.select(F.col("item").alias("up"), F.col("parts").alias("to")), "up")
        where = where.select("item", F.transform("parts", lambda p: F.get(F.col("to"), p)).alias("parts"))
    return stage(where.select("item", F.get("parts", F.lit(0)).alias("shard")).unionByName(own), "shards")


def _difference(batches: Iterator[pa.RecordBatch], k: int, beside: list[float] | None, kinds: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Columns: cell, item, sums, sorted by cell. For each item the cell's part that each of its parts went to; the cell's sums once.

    beside: what the shards hold already, each as a share of all that the cells hold; parts are then those shards, and the sums without it. kinds: see differenced.
    """
    for table in whole_groups(batches, 0, 1):
        sums = table.column(2).to_pylist()
        if beside:
            whole = sum(x[0] for x in sums)
            held = [round(whole * x) for x in beside]
            parts, total = differenced([held, *sums], k)
            shard_of = {p: i for i, p in enumerate(parts[0])}
            total = [total[p] - x for p, x in zip(parts[0], held, strict=True)]
            parts = [[shard_of[p] for p in x] for x in parts[1:]]
        else:
            parts, total = differenced(sums, k, kinds)
        rows = len(parts)
        told = [total, *[None] * (rows - 1)]
        yield pa.RecordBatch.from_arrays([table.column(0).combine_chunks(), table.column(1).combine_chunks(), pa.array(parts, pa.list_(pa.int32())), pa.array(told, pa.list_(pa.int64()))], ["cell", "item", "parts", "sums"])


def differenced(items: list[list[int]], k: int, kinds: np.ndarray | None = None) -> tuple[list[list[int]], list[int]]:
    """For each item (sums of up to k parts), the part of the whole that each of its parts goes to; and the whole's sums.

    With kinds, one number for each part, items have k parts and each goes to a part of its own kind.
    """
    kinds = np.zeros(k, int) if kinds is None else kinds
    spots = np.argsort(kinds, kind="stable")  # places lie kind by kind
    of = kinds[spots]
    first = np.flatnonzero(np.diff(of, prepend=-1))
    last = np.append(first[1:], k)
    back = np.concatenate([np.arange(a, b)[::-1] for a, b in zip(first, last, strict=True)])
    # A node: sums, largest first in each kind; its children, and for each place the places in them.
    sums, below = [], []
    for x in items:
        full = np.zeros(k, np.int64)
        full[: len(x)] = x
        order = np.lexsort((-full, kinds))
        sums.append(full[order])
        below.append((-1, order, -1, order))
    spread = lambda s: int((s[first] - s[last - 1]).max())
    heap = [(-spread(s), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums[a] + sums[b][back]
        order = np.lexsort((-both, of))
        sums.append(both[order])
        below.append((a, order, b, back[order]))
        heapq.heappush(heap, (-spread(sums[-1]), len(sums) - 1))
    to = {len(sums) - 1: spots} if sums else {}
    parts: list[list[int]] = [[] for _ in items]
    for node in range(len(sums) - 1, -1, -1):
        own = to.pop(node)
        a, in_a, b, in_b = below[node]
        if a < 0:
            spot = np.empty(k, np.int64)
            spot[in_a] = own
            parts[node] = spot[: len(items[node])].tolist()
        else:
            to[a], to[b] = np.empty(k, np.int64), np.empty(k, np.int64)
            to[a][in_a] = own
            to[b][in_b] = own
    whole = np.zeros(k, np.int64)
    if sums:
        whole[spots] = sums[-1]
    return parts, whole.tolist() if sums else []
