"""Substring dedup by content-defined phrases against the documents of smaller id.

The reference is the corpus itself, indexed in hash blocks: each text is cut into
phrases at content-defined anchors (the least hash of ``ANCHOR`` words in every
window of ``WINDOW`` words), and a phrase is indexed under its anchor with the
smallest document that has it. Equal windows have the same anchor, so a window can
only occur in documents that share that anchor, and lies in one phrase of each.

A phrase that the reference has is marked whole. Where a phrase is not in the
reference as a whole, and its anchor occurs elsewhere, its windows are checked one by
one against the windows of the other phrases of that anchor. The marked intervals
merged are the removed spans ("factors"); all are at least a window long.

This replaces a relative Lempel-Ziv parse: no text is parsed from left to right
against a reference, and no factor is extended to its longest match. (Parsing every
document against a suffix array of every block would be a cross join of documents and
blocks; the anchors send each piece to the one block that can hold it.)

Every shuffle carries hashes and positions; the texts are dealt out once, to the
documents that have spans. Copies of a text are found by its hash first; they
neither build phrases twice in a task nor meet in one group.

Defined results: null or blank text has no words. Fewer than ``window`` words: nothing is
removed. Null ids are larger than all ids and not smaller than each other. Rows
that share an id never remove each other's words. Columns other than the id and
the text are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from towerfill.llm.common import cut_lineage, table
from towerfill.llm.hashing import between, doc_words, sums, utf8

WINDOW = 50
ANCHOR = 26
NOTHING = hashlib.sha256(b"").hexdigest()


def phrases(h: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, content hash, first window and number of windows of each phrase of a text's word hashes."""
    run = sums(h)
    at = np.arange(len(h) - anchor + 1)
    low, span, have = between(run, at, at + anchor), window - anchor + 1, 1
    while have < span:  # least of the next `have` hashes, doubled up to `span`
        step = min(have, span - have)
        low, have = np.minimum(low[:-step], low[step:]), have + step
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    n = np.diff(np.append(first, len(low)))
    return low[first], between(run, first, first + n + window - 1), first, n


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0] + [len(v) for v in values]).astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def _parse(window: int, anchor: int):
    """Tasks: a row per document with its words' number and hash, and its phrases unless the task had this text with no larger id."""
    none = np.empty(0, np.int64)

    def run(batches):
        seen: dict[int, int] = {}
        for b in batches:
            texts, doc, th = utf8(b["text"]), b["doc"].to_pylist(), b["th"].to_pylist()
            n, sha, lists = [], [], ([], [], [], [])
            for i, h in doc_words(texts):
                n.append(len(h))
                sha.append(hashlib.sha256(b" ".join(texts[i].split())).hexdigest())
                new = len(h) >= window and doc[i] < seen.get(th[i], 1 << 63)
                if new:
                    seen[th[i]] = doc[i]
                    a, c, s, m = phrases(h, window, anchor)
                for out, v in zip(lists, (a.view(np.int64), c.view(np.int64), s, m) if new else (none,) * 4):
                    out.append(v)
            yield pa.RecordBatch.from_arrays(
                [b["k"], b["id"], b["doc"], b["th"], pa.array(n, pa.int64()), pa.array(sha, pa.string())]
                + [_lists(v, t) for v, t in zip(lists, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
                ["k", "id", "doc", "th", "n", "sha", "a", "c", "s", "m"])
    return run


def _windows(window: int):
    """Tasks: the anchor and hash of every window of the phrases in ``parts`` (anchor, first window and number)."""
    def run(batches):
        for b in batches:
            hashes, anchors, starts, rows = [], [], [], []
            parts = b["parts"].to_pylist()
            for i, h in doc_words(utf8(b["text"])):
                at = np.concatenate([np.arange(p["s"], p["s"] + p["m"]) for p in parts[i]])
                hashes.append(between(sums(h), at, at + window))
                anchors.append(np.repeat(np.array([p["a"] for p in parts[i]], np.int64), [p["m"] for p in parts[i]]))
                starts.append(at)
                rows.append(np.full(len(at), i))
            if rows:
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [b["k"].take(take), b["doc"].take(take), pa.array(np.concatenate(anchors)),
                     pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(starts), pa.int32())],
                    ["k", "doc", "a", "w", "s"])
    return run


def factors(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (start, end) merged where they touch."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _cut(batches):
    """Tasks: each text without its duplicate spans."""
    for b in batches:
        kept, removed, spans = [], [], []
        for text, found in zip(utf8(b["text"]), b["spans"].to_pylist()):
            words, fs, at, out = text.split(), factors([(x["s"], x["e"]) for x in found]), 0, []
            for s, e in fs:
                out += words[at:s]
                at = e
            out += words[at:]
            kept.append(b" ".join(out))
            removed.append(len(words) - len(out))
            spans.append([{"start": s, "end": e} for s, e in fs])
        yield pa.RecordBatch.from_arrays(
            [b["k"], pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
             pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
            ["k", "n_removed", "kept_sha256", "factors"])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
                   anchor: int = ANCHOR) -> DataFrame:
    """Per document: its id, ``n_words``, ``n_removed``, ``kept_sha256`` and ``factors``, the removed spans of words."""
    t = F.coalesce(F.col(text), F.lit(""))
    docs = docs.select(F.xxhash64(F.col(doc_id), t).alias("k"), F.col(doc_id).cast("long").alias("id"),
                       F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64(t).alias("th"),
                       t.alias("text"))
    parsed = cut_lineage(docs.mapInArrow(
        _parse(window, anchor), "k long, id long, doc long, th long, n long, sha string, "
        "a array<long>, c array<long>, s array<int>, m array<int>"), "parsed")

    # the index: anchors with more than one phrase or document, and each phrase's smallest document
    all_phrases = parsed.select("k", "doc", F.inline(F.arrays_zip("a", "c", "s", "m")))
    anchors = all_phrases.groupBy("a").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("doc").alias("d0"),
                                           F.max("doc").alias("d1"))
    # written, not aggregated under the join: so Spark can split a hot anchor's phrases there (also below)
    anchors = cut_lineage(anchors.filter("c0 <> c1 or d0 <> d1").select("a", (F.col("c0") != F.col("c1")).alias("several")), "anchors")
    shared = cut_lineage(all_phrases.join(anchors, "a").select("k", "doc", "a", "c", "s", "m", "several"), "shared")
    first = cut_lineage(shared.groupBy("a", "c").agg(F.min("doc").alias("low")), "first")
    placed = shared.join(first, ["a", "c"])  # two hashes have to agree, here and below
    whole = placed.filter("doc > low").select("k", "s", (F.col("s") + F.col("m") + window - 1).alias("e"))

    # factor boundaries: phrases that are not in the reference as a whole, window by window
    texts = docs.select("k", "doc", "text").repartition("k")
    open_parts = (placed.filter("doc = low and several").groupBy("k").agg(F.collect_set(F.struct("a", "s", "m")).alias("parts")))
    checked = texts.join(open_parts, "k").select("k", "doc", "text", "parts").mapInArrow(
        _windows(window), "k long, doc long, a long, w long, s int")
    checked = cut_lineage(checked, "boundary")
    low = checked.groupBy("a", "w").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high").select("a", "w", "low")
    single = checked.join(cut_lineage(low, "low"), ["a", "w"]).filter("doc > low").select("k", "s", (F.col("s") + window).alias("e"))

    # copies of a whole text go without a look at it
    first_copy = cut_lineage(parsed.groupBy("th").agg(F.min("doc").alias("copy_of")), "copies")
    copied = (F.col("doc") > F.col("copy_of")) & (F.col("n") >= window)
    base = parsed.select("k", "id", "doc", "th", "n", "sha").join(first_copy, "th").withColumn("copied", copied)
    spans = whole.union(single).groupBy("k").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    cut = texts.join(spans, "k").select("k", "text", "spans").mapInArrow(
        _cut, "k long, n_removed long, kept_sha256 string, factors array<struct<start:int,end:int>>").dropDuplicates(["k"])
    cut = cut.withColumnsRenamed({"k": "cut_k"})
    all_words = F.array(F.struct(F.lit(0).alias("start"), F.col("n").cast("int").alias("end")))
    return base.join(cut, F.col("k") == F.col("cut_k"), "left").select(
        F.col("id").alias(doc_id), F.col("n").alias("n_words"),
        F.when(F.col("copied"), F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copied"), NOTHING).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(F.col("copied"), all_words).otherwise(F.coalesce("factors", F.array().cast("array<struct<start:int,end:int>>"))).alias("factors"))


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("factors")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(doc_id, 9223372036854775807) AS o, doc_id,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT rid, o, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50),
g AS (SELECT rid, o, s, md5(array_to_string(w[s:s+49], ' ')) AS g FROM s),
f AS (SELECT g, min(o) AS low FROM g GROUP BY g),
x AS (SELECT DISTINCT rid, unnest(range(s, s + 50)) AS p FROM g JOIN f USING (g) WHERE o > low),
r AS (SELECT rid, count(*) AS n, list(p) AS ps FROM x GROUP BY rid),
u AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT u.rid, string_agg(word, ' ' ORDER BY u.p) AS t FROM u LEFT JOIN x ON u.rid = x.rid AND u.p = x.p WHERE x.p IS NULL GROUP BY u.rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN r USING (rid) LEFT JOIN k USING (rid)
"""
