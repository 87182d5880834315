"""Variable-capacity best-fit packing of token sequences.

Sequences are dealt to groups of bounded size by a hash. In a group, longest first,
each piece goes to the open bin that it leaves the least room in. If it fits none,
a bin of the least cost for each token it can still receive is opened. The permitted
lengths are optimised jointly: the group is packed with each choice of largest
length, every bin is downsized to the smallest length that holds its contents, and
the cheapest packing stays. A sequence longer than the largest length is cut into
pieces of that length.

Defined results: null or wordless text has length 0: one row without a bin. Equal
lengths go by key and piece. Repeated rows are packed as often as they occur. Rows
keep only the named key columns. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from towerfill.llm.common import cut_lineage, table, words

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Cost of a bin: its length, a fixed cost in tokens, and attention that doubles the cost at QUADRATIC tokens.
FIXED = 32
QUADRATIC = 16384
GROUP_PIECES = 50_000


def cost(capacity: int) -> float:
    return FIXED + capacity * (1 + capacity / QUADRATIC)


def best_fit(lengths: Sequence[int], capacities: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """(bin and offset of each piece, load of each bin) for ``lengths`` in descending order.

    ``rooms`` has a bit for each amount of room that an open bin has, so the
    tightest bin is the lowest bit from the piece's length on.
    """
    rest, rooms = sum(lengths), 0
    open_bins: dict[int, list[int]] = {}
    where, offset, load = [], [], []
    for n in lengths:
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room = min((c for c in capacities if c >= n), key=lambda c: (cost(c) / min(c, rest), c))
            b = len(load)
            load.append(0)
        where.append(b)
        offset.append(load[b])
        load[b] += n
        rest -= n
        if room > n:
            open_bins.setdefault(room - n, []).append(b)
            rooms |= 1 << (room - n)
    return where, offset, load


def downsized(load: int, capacities: Sequence[int]) -> int:
    return min(c for c in capacities if c >= load)


def pack_lengths(lengths: Sequence[int], capacities: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """(bin, offset and capacity of each piece) of the cheapest packing over all choices of largest length."""
    best = None
    for k in range(len(capacities)):
        long = [c for c in capacities if c > capacities[k]]
        allowed = {n: None for n in capacities[:k + 1]}
        where, offset, load = _with_limit(lengths, list(allowed), long)
        caps = [downsized(x, capacities) for x in load]
        total = sum(map(cost, caps))
        if best is None or total < best[0]:
            best = total, where, offset, [caps[b] for b in where]
    return best[1:]


def _with_limit(lengths, allowed, long):
    """Best fit with the ``allowed`` capacities; pieces over the largest of them get the ``long`` ones."""
    cutoff = next((i for i, n in enumerate(lengths) if n <= allowed[-1]), len(lengths))
    w1, o1, l1 = best_fit(lengths[:cutoff], long) if cutoff else ([], [], [])
    w2, o2, l2 = best_fit(lengths[cutoff:], allowed)
    return w1 + [len(l1) + b for b in w2], o1 + o2, l1 + l2


def _pack(capacities: Sequence[int], keys: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", *keys, "piece"], ascending=[False] + [True] * (len(keys) + 1), kind="stable").reset_index(drop=True)
        where, offset, capacity = pack_lengths(pdf["length"].tolist(), capacities)
        pdf["bin_id"] = pdf["_p_group"].astype("int64") * (1 << 32) + pd.Series(where, dtype="int64")
        pdf["bin_offset"] = pd.Series(offset, dtype="int64")
        pdf["capacity"] = pd.Series(capacity, dtype="int64")
        return pdf[[*keys, "piece", "start", "length", "bin_id", "bin_offset", "capacity"]]
    return run


def pack(docs: DataFrame, length: Column, keys: Sequence[str] = ("doc_id",), capacities: Sequence[int] = CAPACITIES,
         group_pieces: int = GROUP_PIECES) -> DataFrame:
    """A row per piece: the ``keys``, ``piece``, its ``start`` and ``length`` in the sequence, ``bin_id``, ``bin_offset`` and ``capacity``."""
    capacities, keys = sorted(capacities), list(keys)
    top = capacities[-1]
    n = F.col("_p_n")
    whole = docs.select(*keys, length.cast("long").alias("_p_n"))
    pieces = whole.select(*keys, "_p_n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((n - 1) / top), F.lit(0)))).alias("piece"))
    pieces = pieces.select(*keys, "piece", (F.col("piece") * top).alias("start"), F.least(n - F.col("piece") * top, F.lit(top)).alias("length"))
    # the row's number is written with it, so that rows that repeat a key spread over the groups and do so alike on a retry
    pieces = cut_lineage(pieces.withColumn("_p_row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    group = F.pmod(F.xxhash64(*keys, "piece", "length", "_p_row"), F.lit(groups)).cast("long")
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema.fields}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "piece long, start long, length long, bin_id long, bin_offset long, capacity long"])
    packed = pieces.filter("length > 0").withColumn("_p_group", group).drop("_p_row").groupBy("_p_group").applyInPandas(_pack(capacities, keys), schema)
    empty = pieces.filter("length <= 0").select(*keys, "piece", "start", "length", *[F.lit(None).cast("long").alias(c) for c in ("bin_id", "bin_offset", "capacity")])
    return packed.unionByName(empty)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack(docs, F.size(words(F.col("text"))))
