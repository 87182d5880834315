"""Near-duplicate documents by min-max hashing, confirmed on whole shingle sets.

1. A document is the set of its distinct two-word shingles; documents with equal sets
   form a class, named by two independent sums over the set (126 bits).
2. Min-max hashing: a permutation of the shingle hashes gives a class both its least
   and its greatest value, so a signature needs half as many hash evaluations as
   values. For sets of similarity J each of the two agrees with probability J, and
   they differ unless the set has one shingle, so both estimate J without bias.
   ``PERMS`` permutations (twice as many values) are a band, and classes with an
   equal band meet. ``BANDS`` bands miss a pair of similarity 0.8 with probability
   ``(1 - 0.8 ** 8) ** 110``, under 2e-9, and one of 0.85 with under 1e-15.
3. The classes that meet in a band, sorted by size, form a chain that is cut where
   the next size can no longer reach the similarity. Chains join into clusters
   without a row per pair; most classes meet none and go here.
4. Inside a cluster the whole sets are compared, block by block, so that no task holds
   a large cluster. Only links confirmed on the sets count, and a task returns just
   the edges that span them. Their components are the groups.

Defined results: null text, no text or no words: no shingles, no links, a component of its
own id, kept. One word: one shingle. Repeated rows (and equal sets) are one class. A
null id never names a component unless all ids in it are null; ``kept`` compares ids
as equal when both are null. Texts are read whole, however long. Columns other than
the id and the text are not read, so extra columns can't clash. An empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from towerfill.llm.common import cut_lineage, table
from towerfill.llm.components import components
from towerfill.llm.hashing import BASE, mix, utf8
from towerfill.llm.joinsim import linked, shingle_sets, spanning

WIDTH = 2
PERCENT = 80
#: Bands of a signature, and the permutations (two values each) of a band.
BANDS = 110
PERMS = 4
#: Shingles that are permuted at a time (their values stay in the processor's cache).
CHUNK = 1 << 15
#: Shingles and sets of a block of the comparison.
BLOCK_SHINGLES = 1 << 20
BLOCK_SETS = 1 << 11
KEY = "decimal(38,0)"


def multipliers(n: int) -> np.ndarray:
    """Odd factors: ``x * m`` modulo 2**32 is a permutation of the 32-bit values."""
    return (mix(np.arange(1, n + 1, dtype=np.uint64) * BASE) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def set_names(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit halves of each set's name, the upper one below 2**62 (so that 38 digits hold both)."""
    out = np.empty((len(sets), 2), np.uint64)
    size = np.array([len(s) for s in sets], np.uint64)
    out[:, 0] = mix(np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64) + size)
    out[:, 1] = mix(np.array([mix(s ^ BASE).sum(dtype=np.uint64) for s in sets], np.uint64) + size) >> np.uint64(2)
    return out


def decimals(halves: np.ndarray) -> pa.Array:
    """Arrow decimals from rows of (lower, upper) halves."""
    return pa.Array.from_buffers(pa.decimal128(38, 0), len(halves), [None, pa.py_buffer(np.ascontiguousarray(halves).tobytes())])


def min_max(sets: list[np.ndarray], factors: np.ndarray) -> np.ndarray:
    """The least and the greatest value of each (non-empty) set under each permutation: [permutation, 2, set]."""
    out = np.empty((len(factors), 2, len(sets)), np.uint32)
    out[:, 0], out[:, 1] = np.uint32(2**32 - 1), 0
    at = 0
    while at < len(sets):
        end, n = at, 0
        while end < len(sets) and (end == at or n + len(sets[end]) <= CHUNK):
            n += len(sets[end])
            end += 1
        whole = (np.concatenate(sets[at:end]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0] + [len(s) for s in sets[at:end - 1]])
        parts = [(whole, starts)] if n <= CHUNK else [(whole[i:i + CHUNK], starts) for i in range(0, n, CHUNK)]  # one long set
        for x, first in parts:
            for j, m in enumerate(factors):
                v = x * m
                out[j, 0, at:end] = np.minimum(out[j, 0, at:end], np.minimum.reduceat(v, first))
                out[j, 1, at:end] = np.maximum(out[j, 1, at:end], np.maximum.reduceat(v, first))
        at = end
    return out


def band_hashes(sets: list[np.ndarray], bands: int, perms: int) -> np.ndarray:
    """A hash of each band of each set's signature: [set, band]."""
    s = min_max(sets, multipliers(bands * perms)).astype(np.uint64)
    both = ((s[:, 0] << np.uint64(32)) | s[:, 1]).reshape(bands, perms, len(sets))
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64)[:, None], (bands, len(sets)))
    for j in range(perms):
        h = mix(h * BASE + both[:, j])
    return h.T


def _describe(width: int):
    """Tasks: (``id``, ``th``, ``n``, ``key``) of each document; no key without shingles."""
    def run(batches):
        for b in batches:
            sets = [s for _, s in shingle_sets(utf8(b["text"]), width)]
            n = np.array([len(s) for s in sets], np.int64)
            has = np.flatnonzero(n)
            at = np.full(len(sets), -1, np.int64)
            at[has] = np.arange(len(has))
            key = decimals(set_names([sets[i] for i in has])).take(pa.array(at, mask=at < 0))
            yield pa.RecordBatch.from_arrays([b["id"], b["th"], pa.array(n), key], ["id", "th", "n", "key"])
    return run


def _bands(width: int, bands: int, perms: int):
    """Tasks: (``band``, ``key``, ``n``) for each band of each set, a set once per task."""
    def run(batches):
        seen: set[bytes] = set()
        for b in batches:
            sets = [s for _, s in shingle_sets(utf8(b["text"]), width) if len(s)]
            names = set_names(sets)
            new = [i for i, x in enumerate(names) if (k := x.tobytes()) not in seen and not seen.add(k)]
            for part in (new[i:i + 256] for i in range(0, len(new), 256)):
                h = band_hashes([sets[i] for i in part], bands, perms)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.reshape(-1).view(np.int64)), decimals(np.repeat(names[part], bands, axis=0)),
                     pa.array(np.repeat([len(sets[i]) for i in part], bands), pa.int32())], ["band", "key", "n"])
    return run


def clusters(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS, perms: int = PERMS) -> DataFrame:
    """(``node``, ``label``): the classes that meet in a band, directly or through others of fitting sizes."""
    met = docs.select("text").mapInArrow(_bands(width, bands, perms), f"band long, key {KEY}, n int")
    by_size = Window.partitionBy("band").orderBy("n", "key")
    near = met.select(F.col("key").alias("a"), F.lag("key").over(by_size).alias("b"), "n", F.lag("n").over(by_size).alias("m"))
    return components(near.filter("a <> b AND 100 * m >= {} * n".format(int(percent))).select("a", "b").distinct())


def _compare(width: int, percent: int):
    """Tasks: edges that span the links of each cluster (or pair of blocks) of the group."""
    def run(group: pa.Table) -> pa.Table:
        label, key, side = (group[c].to_pylist() for c in ("label", "key", "side"))
        texts = group["text"].combine_chunks()
        place: dict = {}
        for i, k in enumerate(zip(label, key, side)):
            place.setdefault(k, i)  # a repeated row counts once
        rows = sorted(place.values())
        sets = {rows[i]: s for i, s in shingle_sets(utf8(texts.take(pa.array(rows))), width)}
        of: dict = {}
        for i in rows:
            of.setdefault(label[i], []).append(i)
        out = []
        for at in of.values():
            left, right = [i for i in at if side[i] == 1], [i for i in at if side[i] == 2]
            if left and right:
                cross = linked([sets[i] for i in left], [sets[i] for i in right], percent)
                at = left + right
                links = np.zeros((len(at),) * 2, bool)
                links[:len(left), len(left):], links[len(left):, :len(left)] = cross, cross.T
            elif len(at) > 1 and not left and not right:
                part = [sets[i] for i in at]
                links = linked(part, part, percent)
            else:
                continue
            out += [(key[at[i]], key[at[j]]) for i, j in spanning(links)]
        kind = pa.decimal128(38, 0)
        return pa.table({"a": pa.array([x for x, _ in out], kind), "b": pa.array([y for _, y in out], kind)})
    return run


def links(docs: DataFrame, described: DataFrame, cluster: DataFrame, width: int = WIDTH, percent: int = PERCENT,
          block_shingles: int = BLOCK_SHINGLES, block_sets: int = BLOCK_SETS) -> DataFrame:
    """Edges (``a``, ``b``) between classes that span every component of the confirmed links."""
    one = described.filter("key is not null").groupBy("key").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("r"), F.first("n").alias("n"))
    nodes = cut_lineage(one.join(cluster, one["key"] == cluster["node"]).select("key", "label", "n", "r.id", "r.th"), "nodes")
    size = nodes.groupBy("label").agg(F.count("*").alias("c"), F.sum("n").alias("s")).select(
        "label", F.greatest(F.ceil(F.col("s") / block_shingles), F.ceil(F.col("c") / block_sets)).cast("int").alias("blocks"))
    bins = max(1, int((nodes.agg(F.sum("n")).first()[0] or 0) // block_shingles) * 2)
    own = F.pmod(F.xxhash64("key", F.lit(11)), F.col("blocks")).cast("int")
    # a block meets itself (side 0) and each other block (sides 1 and 2); small clusters share a group
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(
        F.least("own", j).alias("i"), F.greatest("own", j).alias("j"),
        F.when(F.col("own") == j, 0).when(F.col("own") < j, 1).otherwise(2).alias("side")))
    dealt = (nodes.join(size, "label").withColumn("own", own)
             .select("id", "th", "key", "label", "blocks", F.explode(meets).alias("m"))
             .select(F.col("id").alias("n_id"), F.col("th").alias("n_th"), "key", "label", F.col("m.side").alias("side"),
                     F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("label", F.lit(13)), F.lit(bins)))
                     .otherwise(F.xxhash64("label", "m.i", "m.j")).alias("unit")))
    d = docs.select("id", "th", "text").hint("merge")  # the texts are dealt out once, never held by every executor
    met = d.join(dealt, d["id"].eqNullSafe(dealt["n_id"]) & (d["th"] == dealt["n_th"])).select("unit", "label", "key", "side", "text")
    return met.groupBy("unit").applyInArrow(_compare(width, percent), f"a {KEY}, b {KEY}")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT,
                    bands: int = BANDS, perms: int = PERMS, block_shingles: int = BLOCK_SHINGLES,
                    block_sets: int = BLOCK_SETS) -> DataFrame:
    """Per document: its id, ``n_shingles``, ``component_id`` (the smallest id reachable by links) and ``kept``."""
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"),
                       F.col(text).alias("text"))
    described = cut_lineage(docs.mapInArrow(_describe(width), f"id long, th long, n long, key {KEY}"), "sets")
    cluster = clusters(docs, width, percent, bands, perms)
    found = components(links(docs, described, cluster, width, percent, block_shingles, block_sets))
    classes = described.filter("key is not null").groupBy("key").agg(F.min("id").alias("low"))
    named = classes.join(found, classes["key"] == found["node"], "left").select("key", "low", F.coalesce("label", "key").alias("label"))
    least = named.groupBy("label").agg(F.min("low").alias("component"))
    member = named.join(least, "label").select(F.col("key").alias("c_key"), "component")
    got = described.join(member, described["key"] == member["c_key"], "left").select(
        F.col("id").alias(doc_id), F.col("n").alias("n_shingles"),
        F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"))
    return got.withColumn("kept", F.col(doc_id).eqNullSafe(F.col("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, least(2, len(w)) AS k, unnest(range(1, len(w) - least(2, len(w)) + 2)) AS s FROM d WHERE len(w) > 0),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[s:s+k-1], ' ') AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN n p ON x = p.doc_id JOIN n q ON y = q.doc_id WHERE 100 * o >= 80 * (p.n + q.n - o)),
r AS (SELECT doc_id, doc_id AS z FROM n UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.z = l.x),
c AS (SELECT doc_id, min(z) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id,
    doc_id = coalesce(component_id, doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
