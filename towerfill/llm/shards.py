"""Minimax contiguous partition of documents into shards (native DataFrame operations only).

Equal texts share a hash and so a cell: one of ``cells`` equal ranges of the hash
space. Cells are the atomic groups, in hash order after those larger than a mean shard. The smallest feasible shard capacity
over their sizes is found by binary search with a greedy check, and the shards are
cut under it. Only the cells' sizes and counts (at most ``cells`` rows, whatever
the input) reach the driver.

Defined results: a null text has 0 bytes, the CRC of nothing, and shares the empty
texts' cell. Repeated rows are in one shard, with a slot each. An empty table gives
no rows. Copies are never parted, so a group larger than the mean shard sets the
capacity, and its shard is that much larger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from towerfill.llm.common import cut_lineage, table

CELL_BITS = 16
OVERHEAD = 16
#: A cell's rows are ranked in this many parts by id, so that a group of copies is not ranked by one task.
PARTS = 256


def shards_needed(sizes: list[int], capacity: int) -> int:
    """Shards that greedy filling opens for ``sizes`` in order."""
    n, room = 1, capacity
    for s in sizes:
        if s > room:
            n, room = n + 1, capacity
        room -= s
    return n


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity with which greedy filling needs at most ``shards`` shards."""
    low = max(max(sizes, default=0), -(-sum(sizes) // shards))
    high = max(low, max(sizes, default=0) + sum(sizes) // shards)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if shards_needed(sizes, mid) <= shards else (mid + 1, high)
    return low


def cut(sizes: list[int], shards: int) -> list[int]:
    """The shard of each group: contiguous, none over the smallest capacity, each as near as that allows to an equal part of the rest."""
    capacity, n = smallest_capacity(sizes, shards), len(sizes)
    need, end, load = [0] * (n + 1), n, 0
    for i in range(n - 1, -1, -1):  # shards that greedy filling needs from i on
        load += sizes[i]
        while load > capacity:
            end -= 1
            load -= sizes[end]
        need[i] = 1 + need[end]
    out, i, rest = [], 0, sum(sizes)
    for k in range(shards):
        left = shards - k
        goal, j, load = rest / left, i, 0
        while j < n and load + sizes[j] <= capacity and (
                j == i or left == 1 or need[j] > left - 1 or abs(load + sizes[j] - goal) <= abs(load - goal)):
            load += sizes[j]
            j += 1
        out += [k] * (j - i)
        i, rest = j, rest - load
    return out


def minimax_shards(docs: DataFrame, text: str = "text", key: str = "doc_id", shards: int = 40,
                   cell_bits: int = CELL_BITS) -> DataFrame:
    """``docs`` without the text, with ``size``, ``text_crc32``, ``shard`` and ``slot``.

    Rows of a shard are numbered by cell, part, ``key`` and text, so rows that share a
    key keep their slots whatever the run (equal rows are alike). A cell's first slot
    comes from the driver's cell table, a part's from the counts by cell and part,
    and the rank inside a part from a window over that part alone.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    docs = docs.drop(*(c for c in ("shard", "slot") if c not in (key, text)))  # an input column of such a name gives way
    rows = docs.withColumns({
        "_s_text": F.xxhash64(t, F.lit(7)),
        "size": (F.octet_length(t) + OVERHEAD).cast("long"),
        "text_crc32": F.crc32(F.encode(t, "UTF-8")),
        "_s_cell": F.shiftrightunsigned(F.xxhash64(t), 64 - cell_bits).cast("int"),
        "_s_part": F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.lit(PARTS)).cast("int"),
    }).drop(text)
    parts = cut_lineage(rows.groupBy("_s_cell", "_s_part").agg(F.count("*").alias("n"), F.sum("size").alias("b")), "cells")
    cells = parts.groupBy("_s_cell").agg(F.sum("b").alias("b"), F.sum("n").alias("n")).collect()
    mean = sum(r["b"] for r in cells) / shards
    cells.sort(key=lambda r: (r["b"] <= mean, r["_s_cell"]))  # oversized cells first: the rest is then cut evenly
    starts, slots = [], {}
    for r, shard in zip(cells, cut([r["b"] for r in cells], shards)):
        starts.append((r["_s_cell"], shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + r["n"]
    spark = docs.sparkSession
    begins = spark.createDataFrame(starts, "_s_cell int, shard int, _s_begin long")
    before = F.sum("n").over(Window.partitionBy("_s_cell").orderBy("_s_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = (parts.select("_s_cell", "_s_part", F.coalesce(before, F.lit(0)).alias("_s_before"))
               .join(F.broadcast(begins), "_s_cell"))  # at most 2 ** cell_bits rows
    rank = F.row_number().over(Window.partitionBy("_s_cell", "_s_part").orderBy(key, "text_crc32", "_s_text"))
    return (rows.withColumn("_s_rank", rank).join(offsets, ["_s_cell", "_s_part"])
            .withColumn("slot", F.col("_s_begin") + F.col("_s_before") + F.col("_s_rank") - 1)
            .drop("_s_cell", "_s_part", "_s_text", "_s_rank", "_s_begin", "_s_before"))


def query(spark, sf_dir: str) -> DataFrame:
    got = minimax_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
