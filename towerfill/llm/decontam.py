"""Benchmark decontamination as a prefix-filtered containment join (native DataFrame operations only).

A window (ten consecutive words of an item, or a shorter item whole) has to occur
in a document entirely, so one prefix token is enough: the window's rarest word by
its count over all documents. Document words meet the windows on that token; the
join condition then bounds the position (the window has to start and end inside
the document), compares the window's first and last word, and verifies all words.

Defined results: null or wordless documents and items have no words and no hits.
Items without an id mark words but count as no item; repeated items count once.
Repeated documents get a row each. Empty tables give no rows, or no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from towerfill.llm.common import UPPER, cut_lineage, small_side, table

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH = 10
#: A window or vocabulary table is broadcast up to this many bytes of words; a larger one is joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def item_words(text: Column) -> Column:
    """Lower-cased (A-Z only) runs of digits, letters and non-ASCII characters."""
    t = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, UPPER, UPPER.lower()))
    return F.array_remove(F.split(low, BREAKS), "")


def item_windows(benchmark: DataFrame, item_id: str, text: str, width: int) -> DataFrame:
    """Distinct windows ``ws`` with the ids of the items that have them."""
    items = benchmark.select(F.col(item_id).alias("item"), item_words(F.col(text)).alias("ws")).filter(F.size("ws") > 0)
    n = F.least(F.size("ws"), F.lit(width))
    cut = F.transform(F.sequence(F.lit(1), F.size("ws") - n + 1), lambda i: F.slice("ws", i, n))
    return items.select("item", F.explode(cut).alias("ws")).groupBy("ws").agg(F.collect_set("item").alias("items"))


def with_prefix(windows: DataFrame, doc_words: DataFrame) -> DataFrame:
    """Each window's rarest word (``token``) and its place (``at``); windows with a word that no document has go."""
    parts = windows.select("ws", F.posexplode("ws").alias("at", "token"))
    vocabulary, _ = small_side(parts.select("token").distinct(), "vocabulary", F.octet_length("token"), BROADCAST_BYTES)
    counts = (doc_words.select(F.explode("w").alias("token")).join(vocabulary, "token")
              .groupBy("token").agg(F.count("*").alias("n")))
    rank = F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("token"), F.col("at"))
    first = (parts.join(cut_lineage(counts, "rarity"), "token", "left").groupBy("ws").agg(F.min(rank).alias("r")))
    return (windows.join(first, "ws").filter("r.n > 0")
            .select("ws", "items", F.col("r.token").alias("token"), F.col("r.at").alias("at")))


def tokenised(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The ``keys`` and words ``w`` of each row, written once: counting, joining and checking read them, and no text is split twice."""
    return cut_lineage(docs.select(*keys, item_words(F.col(text)).alias("w")), "doc-words")


def window_matches(doc_words: DataFrame, benchmark: DataFrame, keys: list[str], item_id: str = "item_id", item_text: str = "text",
                   width: int = WIDTH) -> DataFrame:
    """Every occurrence of an item window: the documents' ``keys``, ``start``, ``len`` in words and the window's ``items``.

    A small prefix table is broadcast and the windows are checked where the words are. A
    larger one is joined by a shuffle of (keys, position, word) alone; the candidates then
    meet their document's words by its keys.
    """
    windows = cut_lineage(item_windows(benchmark, item_id, item_text, width), "windows")
    size = F.aggregate("ws", F.lit(64), lambda a, x: a + F.octet_length(x) + 16)
    prefix, small = small_side(with_prefix(windows, doc_words), "prefix", size, BROADCAST_BYTES)
    start, n = F.col("pos") - F.col("at"), F.size("ws")
    if small:
        d = doc_words.filter(F.size("w") > 0).select(*keys, "w", F.posexplode("w").alias("pos", "word")).alias("d")
        inside = (start >= 0) & (start + n <= F.size("w"))
        ends = (F.get("w", start) == F.get("ws", F.lit(0))) & (F.get("w", start + n - 1) == F.get("ws", n - 1))
        equal = F.slice("w", F.greatest(start, F.lit(0)) + 1, n) == F.col("ws")
        return (d.join(prefix, (F.col("word") == F.col("token")) & inside & ends & equal)
                .select(*keys, start.alias("start"), n.alias("len"), "items"))
    own = doc_words.dropDuplicates(keys)  # rows that share the keys share the text
    places = own.select(*keys, F.posexplode("w").alias("pos", "word"))
    met = places.join(prefix, F.col("word") == F.col("token")).filter(start >= 0).select(*keys, start.alias("start"), "ws", "items")
    texts = own.select(*[F.col(k).alias(f"_w_{k}") for k in keys], "w")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_w_{k}"))
    return met.join(texts, same).filter(F.slice("w", F.col("start") + 1, n) == F.col("ws")).select(*keys, "start", n.alias("len"), "items")


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """Per document: its id, ``n_words``, ``n_hit`` and the sorted ``items`` (as strings) that occur in it.

    Documents are told apart by id and text hash, so rows that repeat an id stay
    apart. What is gathered per document is bounded by its own length.
    """
    docs = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    doc_words = tokenised(docs, ["doc", "th"])
    found = window_matches(doc_words, benchmark, ["doc", "th"], item_id, item_text, width)

    def cover(a: Column, x: Column) -> Column:
        end = x["start"] + x["len"]
        return F.struct(F.greatest(a["end"], end).alias("end"),
                        (a["n"] + F.greatest(end - F.greatest(a["end"], x["start"]), F.lit(0))).alias("n"))

    spans = F.sort_array(F.collect_set(F.struct("start", "len")))
    names = F.array_distinct(F.flatten(F.collect_set("items")))
    hits = found.groupBy("doc", "th").agg(
        F.aggregate(spans, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), cover)["n"].alias("n_hit"),
        F.sort_array(F.transform(names, lambda x: x.cast("string"))).alias("items"))
    hits = hits.withColumnsRenamed({"doc": "h_doc", "th": "h_th"})
    plain = doc_words.select("doc", "th", F.size("w").cast("long").alias("n_words"))
    return (plain.join(hits, F.col("doc").eqNullSafe(F.col("h_doc")) & F.col("th").eqNullSafe(F.col("h_th")), "left")
            .select(F.col("doc").alias(doc_id), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                      item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` in which no item window occurs."""
    th = F.xxhash64(F.col(text))
    doc_words = tokenised(docs.select(th.alias("_d_th"), F.col(text).alias("_d_text")), ["_d_th"], "_d_text")
    found = window_matches(doc_words, benchmark, ["_d_th"], item_id, item_text, width)
    return docs.join(found.select("_d_th").distinct(), th == F.col("_d_th"), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    got = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
iw0 AS (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM i),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s+n-1], ' ') AS ws FROM iw0),
dw0 AS (SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n),
m AS (SELECT rid, s, n, item_id FROM (SELECT rid, n, s, array_to_string(w[s:s+n-1], ' ') AS ws FROM dw0) JOIN iw USING (n, ws)),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM m) GROUP BY rid),
t AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
      FROM m GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""
