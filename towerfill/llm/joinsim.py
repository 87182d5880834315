"""Exact Jaccard join of word shingles by vertical partitioning: the global shingle order is cut into fragments.

1. Every document becomes the set of its distinct shingle hashes; documents with
   equal sets form a class.
2. All shingles are counted in a fixed-size table of counters. It gives the global
   order, rare shingles first. Two sets of the wanted similarity share at least
   ``1 + l`` shingles among the first ``n - ceil(t * n) + 1 + l`` of each (l: a tenth
   of the smaller set). A class with fewer prefix shingles that another class of a
   fitting size has is linked with nothing and goes. The classes left that meet on a
   prefix shingle are candidates. A shingle's classes form a chain by size, cut where
   the next size no longer fits: that puts all candidates into one cluster without a
   row per pair.
3. The global order is cut by pivots into fragments of equal numbers of occurrences,
   and every set into its segments, one per fragment. The fragments are counted one by
   one, the rarest first: each gives the partial overlaps of the pairs that are still
   open, and their sum is a pair's overlap. A pair is closed once its sum is enough for
   a link, or once the segments left can't make it enough. A cluster larger than a
   block is cut into blocks, and every pair of blocks is a group of its own, so no task
   holds a whole large cluster and no pair is left out. The fragments of a pair of
   blocks are summed where they are counted: a row for each fragment and pair would
   grow with the square of a group of near copies. Slices of a fragment bound the memory.
4. Links leave a task as spanning edges only; their components are the result.

Defined results: no words (or null): no shingles, no links, a component of its own
id. Fewer words than a shingle: one shingle of all words. Repeated rows are one
class. A null id never names a component unless all ids in it are null. Columns
other than the id and the text are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from towerfill.llm.common import cut_lineage, table
from towerfill.llm.components import components
from towerfill.llm.hashing import BASE, doc_words, mix, utf8

WIDTH = 5
PERCENT = 80
#: Counters of the global order, and how many of them one row carries.
COUNTERS = 1 << 20
COUNTER_BLOCK = 1 << 12
#: Hundredths of a set by which its prefix is longer than one shared shingle needs.
LONGER = 10
#: Shingles and documents of a block; fragments of the global order; partial-overlap cells of a slice of one.
BLOCK_SHINGLES = 1 << 20
BLOCK_DOCS = 1 << 11
FRAGMENTS = 8
FRAGMENT_CELLS = 1 << 22
#: A prefix shingle is dealt to one more bucket for so many counted documents.
BUCKET_DOCS = 1 << 17


def shingle_sets(texts: list[bytes], width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(index, sorted distinct shingle hashes) of each text."""
    for i, h in doc_words(texts, lower=True):
        k = min(width, len(h))
        if not k:
            yield i, h
            continue
        s = np.full(len(h) - k + 1, k, np.uint64)
        for j in range(k):
            s = mix(s * BASE + h[j:len(h) - k + 1 + j])
        yield i, np.unique(s)


def set_key(s: np.ndarray) -> int:
    """A signed 64-bit name of a shingle set."""
    return int(mix(s.sum(dtype=np.uint64, keepdims=True) + np.array([len(s)], np.uint64) * BASE).view(np.int64)[0])


def counter(s: np.ndarray, counters: int) -> np.ndarray:
    return (s >> np.uint64(20)) & np.uint64(counters - 1)


def _describe(width: int, counters: int):
    """Tasks: a row per document with its set's size and name, and the task's counters in blocks."""
    def run(batches):
        counts = np.zeros(counters, np.int32)
        for b in batches:
            n, key = [], []
            for _, s in shingle_sets(utf8(b["text"]), width):
                n.append(len(s))
                key.append(set_key(s) if len(s) else None)
                np.add.at(counts, counter(s, counters).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays(
                [b["id"], b["th"], pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.nulls(len(n), pa.int32()),
                 pa.nulls(len(n), pa.binary())], ["id", "th", "n", "key", "block", "counts"])
        size = min(COUNTER_BLOCK, counters)
        blocks = counts.reshape(-1, size)
        for at in np.flatnonzero(blocks.any(axis=1)):
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64())]
                + [pa.array([at], pa.int32()), pa.array([blocks[at].tobytes()], pa.binary())],
                ["id", "th", "n", "key", "block", "counts"])
    return run


def _add_blocks(batches):
    """Sums the counter blocks of a partition."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for at, raw in zip(b["block"].to_pylist(), b["counts"].to_pylist()):
            got = np.frombuffer(raw, np.int32).astype(np.int64)
            total[at] = total[at] + got if at in total else got
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())],
                                     ["block", "counts"])


def describe(docs: DataFrame, width: int = WIDTH, counters: int = COUNTERS) -> tuple[DataFrame, np.ndarray]:
    """(``id``, ``th``, ``n``, ``key``) of each document, and the counters (``counters`` numbers, whatever the input)."""
    raw = cut_lineage(docs.mapInArrow(_describe(width, counters), "id long, th long, n long, key long, block int, counts binary"), "sets")
    size = min(COUNTER_BLOCK, counters)
    parts = raw.filter("block is not null").select("block", "counts").repartition(max(1, min(counters // size, 64)), "block")
    counts = np.zeros(counters, np.int64)
    for r in parts.mapInArrow(_add_blocks, "block int, counts binary").collect():
        counts[r["block"] * size:(r["block"] + 1) * size] = np.frombuffer(r["counts"], np.int64)
    return raw.filter("block is null").select("id", "th", "n", "key"), counts


def _prefixes(order, width: int, percent: int, bucket_docs: int):
    """Tasks: (``token``, ``bucket``, ``key``, ``n``) for the prefix shingles of each set, a set once per task.

    Bucket 0 of a shingle is shared by all. A shingle counted in more than
    ``bucket_docs`` documents is dealt to buckets from 1 by the set's name; the
    first set of each size of a bucket in a task also goes to bucket 0, under the
    bucket's negative number. So every set still meets a set of each size that its
    shingle has anywhere.
    """
    def run(batches):
        counts = order.value
        seen: set[int] = set()
        tied: set[tuple[int, int, int]] = set()
        for b in batches:
            tokens, places, keys, sizes = [], [], [], []
            for _, s in shingle_sets(utf8(b["text"]), width):
                if not len(s) or (key := set_key(s)) in seen:
                    continue
                seen.add(key)
                est = counts[counter(s, len(counts))]
                most = (len(s) * percent + 99) // 100  # the least size of a linked set, and the least overlap
                first = np.argsort(est, kind="stable")[:len(s) - most + 1 + len(s) * LONGER // 100]
                t, place = s[first], np.zeros(len(first), np.int32)
                if est[first[-1]] > bucket_docs:
                    buckets = 1 + est[first].astype(np.uint64) // np.uint64(bucket_docs)
                    place = np.where(est[first] > bucket_docs, 1 + np.uint64(key & (2**64 - 1)) % buckets, 0).astype(np.int32)
                    new = [i for i in np.flatnonzero(place) if (x := (int(t[i]), int(place[i]), len(s))) not in tied and not tied.add(x)]
                    t, place = np.concatenate([t, t[new]]), np.concatenate([place, -place[new]])
                tokens.append(t)
                places.append(place)
                keys += [key] * len(t)
                sizes += [len(s)] * len(t)
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(places)),
                                                  pa.array(keys, pa.int64()), pa.array(sizes, pa.int32())], ["token", "bucket", "key", "n"])
    return run


def clusters(docs: DataFrame, order, width: int = WIDTH, percent: int = PERCENT, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """(``node``, ``label``): sets that meet on a prefix shingle, directly or through others; ``order``: the broadcast counters."""
    met = docs.select("text").mapInArrow(_prefixes(order, width, percent, bucket_docs), "token long, bucket int, key long, n int")
    dealt = bool((order.value > bucket_docs).any())
    if dealt:  # one set of each size and bucket meets the other buckets', not one of every task
        met = cut_lineage(met, "prefixes")
        ties = met.filter("bucket < 0").groupBy("token", "bucket", "n").agg(F.min("key").alias("key"))
        met = met.filter("bucket >= 0").unionByName(ties)
    by_size = Window.partitionBy("token", F.greatest("bucket", F.lit(0))).orderBy("n", "key")
    near = {c: f(c).over(by_size) for f, c in ((F.lag, "key"), (F.lag, "n"))}
    below = (near["key"] != F.col("key")) & (100 * near["n"] >= percent * F.col("n"))
    above = (F.lead("key").over(by_size) != F.col("key")) & (100 * F.col("n") >= percent * F.lead("n").over(by_size))
    met = met.withColumn("shared", F.coalesce(below, F.lit(False)) | F.coalesce(above, F.lit(False)))
    shared = cut_lineage(met.filter("shared").drop("shared"), "shared")
    least = 1 + F.floor(F.ceil(F.col("n") * percent / 100) * LONGER / 100)  # what a linked set of the least size shares
    able = shared.groupBy("key", "n").agg(F.count("*").alias("c")).filter(F.col("c") >= least).select("key")
    left = shared.join(able, "key").withColumn("bucket", F.abs("bucket"))
    if dealt:
        # the set of a size may have gone: the sets left are tied anew
        ties = shared.filter("bucket <> 0").withColumn("bucket", F.abs("bucket")).join(able, "key").groupBy("token", "bucket", "n").agg(F.min("key").alias("key"))
        left = left.unionByName(ties.withColumn("bucket", F.lit(0)))
    chain = left.select(F.col("key").alias("a"), near["key"].alias("b"), below.alias("fits"))
    edges = chain.filter("fits").select("a", "b").distinct()
    return components(edges)


def overlaps(left: list[np.ndarray], right: list[np.ndarray], cells: int = FRAGMENT_CELLS) -> np.ndarray:
    """Overlap counts of every set of ``left`` with every set of ``right``: partial counts per slice of the shared shingles, summed."""
    total = np.zeros((len(left), len(right)), np.int32)
    joint = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    width = max(1, cells // max(len(left), len(right)))

    def part(sets, frag):
        m = np.zeros((len(sets), len(frag)), np.float32)
        for i, s in enumerate(sets):
            s = s[np.searchsorted(s, frag[0]):np.searchsorted(s, frag[-1], "right")]
            at = np.searchsorted(frag, s)
            ok = frag[np.minimum(at, len(frag) - 1)] == s
            m[i, at[ok]] = 1
        return m

    for i in range(0, len(joint), width):
        frag = joint[i:i + width]
        a = part(left, frag)
        total += (a @ (a if left is right else part(right, frag)).T).astype(np.int32)
    return total


def linked(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    n, m = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    o = overlaps(left, right).astype(np.int64)
    return 100 * o >= percent * (n[:, None] + m[None, :] - o)


def pivots(counts: np.ndarray, fragments: int) -> list[tuple[int, int]]:
    """The first (count, hash) of each fragment of the global order but the first; fragments have equal numbers of occurrences."""
    value, many = np.unique(counts[counts > 0].astype(np.int64), return_counts=True)
    mass = value * many
    upto, out = np.cumsum(mass), []
    for k in range(1, fragments if len(value) else 0):
        goal = int(upto[-1]) * k // fragments
        i = int(np.searchsorted(upto, goal, "right"))
        # the shingles of one count are ordered by hash, which spreads them evenly
        out.append((int(value[i]), ((goal - int(upto[i] - mass[i])) << 64) // int(mass[i])))
    return out


def segments(s: np.ndarray, counts: np.ndarray, cuts: list[tuple[int, int]]) -> list[np.ndarray]:
    """A set's shingles by fragment of the global order, each segment sorted by hash."""
    est, fragment = counts[counter(s, len(counts))], np.zeros(len(s), np.int64)
    for c, h in cuts:
        fragment += (est > c) | ((est == c) & (s >= np.uint64(h)))
    by = np.argsort(fragment, kind="stable")
    return np.split(s[by], np.searchsorted(fragment[by], np.arange(1, len(cuts) + 1)))


def linked_by_fragments(left: list[list[np.ndarray]], right: list[list[np.ndarray]], percent: int) -> np.ndarray:
    """Which sets (as segments) of ``left`` are linked with which of ``right``: partial overlaps per fragment, summed per pair.

    After each fragment a pair is open only if its sum is too small for a link and
    the shorter rest could still make it large enough. The diagonal of ``left`` with
    itself means nothing.
    """
    n, m = (np.array([[len(p) for p in s] for s in side], np.int64) for side in (left, right))
    least = -(-percent * (n.sum(1)[:, None] + m.sum(1)[None, :]) // (100 + percent))  # the least overlap of a link
    n, m = (x[:, ::-1].cumsum(1)[:, ::-1] for x in (n, m))  # what is left from each fragment on
    total = np.zeros(least.shape, np.int32)
    open_pairs = np.minimum(n[:, 0, None], m[None, :, 0]) >= least
    if left is right:
        np.fill_diagonal(open_pairs, False)
    for f in range(n.shape[1]):
        rows = np.flatnonzero(open_pairs.any(1))
        if not len(rows):
            break
        cols = rows if left is right else np.flatnonzero(open_pairs.any(0))
        a = [left[i][f] for i in rows]
        total[np.ix_(rows, cols)] += overlaps(a, a if left is right else [right[i][f] for i in cols])
        open_pairs &= total < least
        if f + 1 < n.shape[1]:
            open_pairs &= total + np.minimum(n[:, f + 1, None], m[None, :, f + 1]) >= least
    return total >= least


def spanning(links: np.ndarray) -> list[tuple[int, int]]:
    """For a symmetric matrix of links, an edge from each row to the first row of its component."""
    label = np.arange(len(links), dtype=np.int32)
    while True:
        low = np.minimum(label, np.where(links, label[None, :], np.int32(len(links))).min(axis=1))
        low = low[low]
        if (low == label).all():
            return [(i, int(x)) for i, x in enumerate(label) if i != x]
        label = low


def _compare(order, cuts: list[tuple[int, int]], width: int, percent: int):
    """Tasks: the spanning links of each cluster (or pair of blocks) of the group."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["label", "key", "side"]).reset_index(drop=True)
        sets = {}
        for i, s in shingle_sets([t.encode() if t is not None else b"" for t in pdf["text"]], width):
            sets[i] = segments(s, order.value, cuts)
        out = []
        for _, rows in pdf.groupby("label"):
            if len(rows) < 2:
                continue
            if (rows["side"] == 0).all():
                at = list(rows.index)
                part = [sets[i] for i in at]
                out += [(pdf["key"][at[i]], pdf["key"][at[j]]) for i, j in spanning(linked_by_fragments(part, part, percent))]
                continue
            a, b = list(rows.index[rows["side"] == 1]), list(rows.index[rows["side"] == 2])
            if not a or not b:
                continue
            cross = linked_by_fragments([sets[i] for i in a], [sets[i] for i in b], percent)
            both = np.zeros((len(a) + len(b),) * 2, bool)
            both[:len(a), len(a):], both[len(a):, :len(a)] = cross, cross.T
            out += [(pdf["key"][(a + b)[i]], pdf["key"][(a + b)[j]]) for i, j in spanning(both)]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")
    return run


def links(docs: DataFrame, described: DataFrame, cluster: DataFrame, order, width: int = WIDTH, percent: int = PERCENT,
          block_shingles: int = BLOCK_SHINGLES, block_docs: int = BLOCK_DOCS, fragments: int = FRAGMENTS) -> DataFrame:
    """Edges (``a``, ``b``) between linked sets that span every component of the links inside the clusters."""
    rep = described.filter("key is not null").groupBy("key").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("r"), F.first("n").alias("n"))
    nodes = cut_lineage(rep.join(cluster, rep["key"] == cluster["node"]).select("key", "label", "n", "r.id", "r.th"), "nodes")
    size = nodes.groupBy("label").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    size = size.select("label", F.greatest(F.ceil(F.col("s") / block_shingles), F.ceil(F.col("c") / block_docs)).cast("int").alias("blocks"))
    bins = max(1, int((nodes.agg(F.sum("n")).first()[0] or 0) // block_shingles) * 2)
    own = F.pmod(F.xxhash64("key", F.lit(3)), F.col("blocks")).cast("int")
    placed = nodes.join(size, "label").withColumn("own", own)
    # one block: many clusters share a group; more: a group for each pair of blocks, and one for each block with itself
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(
        F.least("own", j).alias("i"), F.greatest("own", j).alias("j"),
        F.when(F.col("own") == j, 0).when(F.col("own") < j, 1).otherwise(2).alias("side")))
    placed = placed.select("id", "th", "key", "label", "blocks", F.explode(pairs).alias("p")).select(
        F.col("id").alias("n_id"), F.col("th").alias("n_th"), "key", "label", F.col("p.side").alias("side"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("label", F.lit(5)), F.lit(bins)))
        .otherwise(F.xxhash64("label", "p.i", "p.j")).alias("unit"))
    d = docs.select("id", "th", "text")
    # a merge join whatever the sizes: texts are dealt out once, never held by every executor
    joined = d.hint("merge").join(placed, d["id"].eqNullSafe(placed["n_id"]) & (d["th"] == placed["n_th"])).select("unit", "label", "key", "side", "text")
    return joined.groupBy("unit").applyInPandas(_compare(order, pivots(order.value, fragments), width, percent), "a long, b long")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH,
                       percent: int = PERCENT, counters: int = COUNTERS, block_shingles: int = BLOCK_SHINGLES,
                       block_docs: int = BLOCK_DOCS, bucket_docs: int = BUCKET_DOCS, fragments: int = FRAGMENTS) -> DataFrame:
    """Per document: its id, ``th`` (its text's hash), ``n_shingles`` and ``component_id``, the smallest id reachable by links."""
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"),
                       F.col(text).alias("text"))
    described, counts = describe(docs, width, counters)
    order = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, 2**32 - 1).astype(np.uint32))
    cluster = clusters(docs, order, width, percent, bucket_docs)
    found = components(links(docs, described, cluster, order, width, percent, block_shingles, block_docs, fragments))
    classes = described.filter("key is not null").groupBy("key").agg(F.min("id").alias("low"))
    named = classes.join(found, classes["key"] == found["node"], "left").select("key", "low", F.coalesce("label", "key").alias("label"))
    least = named.groupBy("label").agg(F.min("low").alias("component"))
    member = named.join(least, "label").select(F.col("key").alias("c_key"), "component")
    return (described.join(member, described["key"] == member["c_key"], "left")
            .select(F.col("id").alias(doc_id), "th", F.col("n").alias("n_shingles"),
                    F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id")))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with its columns, without those linked to a document of a smaller id; repeated rows stay once."""
    got = jaccard_components(docs, doc_id, text).filter(
        F.col(doc_id).eqNullSafe(F.col("component_id")) | F.col("component_id").isNull())
    keep = got.select(F.col(doc_id).alias("_j_id"), F.col("th").alias("_j_th")).distinct()
    th = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    kept = docs.join(keep, F.col(doc_id).cast("long").eqNullSafe(F.col("_j_id")) & (th == F.col("_j_th")), "left_semi")
    nth = F.row_number().over(Window.partitionBy(doc_id, th).orderBy(F.lit(0)))
    return kept.withColumn("_j_nth", nth).filter("_j_nth = 1").drop("_j_nth")


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS s FROM d WHERE len(w) > 0),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[s:s+k-1], ' ') AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN n p ON x = p.doc_id JOIN n q ON y = q.doc_id WHERE 100 * o >= 80 * (p.n + q.n - o)),
r AS (SELECT doc_id, doc_id AS z FROM n UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.z = l.x),
c AS (SELECT doc_id, min(z) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
