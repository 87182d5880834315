"""Host-level quality rules (native DataFrame operations only).

Every document gets base rules; the failures are summed by host, each host's
failure rate is shrunk towards a beta prior fitted to all hosts, and the hosts'
verdicts are joined back.

Defined results: null or blank text has no words and fails the base rule
(fewer than ``min_words``). A null host is a host of its own. Repeated rows
count as often as they occur. An empty table gives an empty result. Input
columns named like an output column are replaced; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from towerfill.llm.common import SPACES, cut_lineage, let, words

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5


def repeat_words(w: Column, width: int = WINDOW) -> Column:
    """Words of the array column ``w`` inside a ``width``-word window found twice or more in it.

    The windows' hashes are sorted with their positions, so that equal windows are
    neighbours: n log n for any text. Texts without a repeat stop at the distinct count.
    """
    starts = F.slice(w, F.lit(1), F.greatest(F.size(w) - (width - 1), F.lit(0)))
    grams = F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, width)]))

    def covered(positions: Column) -> Column:
        spans = F.transform(positions, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(positions, i + 1), x + width) - x))
        return F.aggregate(spans, F.lit(0), lambda a, x: a + x)

    def repeated(s: Column) -> Column:
        same = F.filter(s, lambda x, i: F.coalesce((i > 0) & (F.get(s, F.greatest(i - 1, F.lit(0)))["h"] == x["h"]), F.lit(False))
                        | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
        return let(F.sort_array(F.transform(same, lambda x: x["i"])), covered)

    def count(g: Column) -> Column:
        tagged = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(tagged, repeated))

    return let(grams, count).cast("long")


def score(docs: DataFrame, text: str = "text", min_words: int = 10, max_repeat_pct: int = 20,
          verdict_only: bool = False) -> DataFrame:
    """The rows of ``docs`` with the base rule's counts and ``base_failed`` (or only the verdict, as ``_q_failed``)."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")

    def base(w: Column) -> Column:
        return let(F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                            repeat_words(w).alias("n_repeat_words")), rule)

    def rule(c: Column) -> Column:
        failed = (c["n_words"] < min_words) | (100 * c["n_repeat_words"] > max_repeat_pct * c["n_words"])
        return F.struct(c.alias("counts"), failed.alias("failed"))

    # one expression holds the words, so that a filter on the rule that Spark moves to the scan splits each text once
    based = docs.withColumn("_q_base", let(words(F.col(text)), base))
    if verdict_only:
        return based.withColumn("_q_failed", F.col("_q_base.failed")).drop("_q_base")
    return based.withColumns({
        "n_words": F.col("_q_base.counts.n_words"),
        "word_chars": F.col("_q_base.counts.word_chars"),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": F.col("_q_base.counts.n_repeat_words"),
        "base_failed": F.col("_q_base.failed"),
    }).drop("_q_base")


def host_verdicts(scored: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """Per host: documents, failures, and whether its shrunk failure rate is above ``max_rate``.

    The prior's mean and weight come from the mean and variance of the hosts' rates
    (moments); only those two numbers reach the driver. With equal rates at all
    hosts every shrunk rate is that rate.
    """
    hosts = scored.groupBy(F.col(host).alias("_q_host")).agg(
        F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failures"))
    rate = F.col("host_failures") / F.col("host_docs")
    m, v = hosts.agg(F.avg(rate), F.var_pop(rate)).first()
    m, v = m or 0.0, v or 0.0
    weight = m * (1 - m) / v - 1 if v > 1e-12 else 1e12
    shrunk = (F.col("host_failures") + F.lit(weight * m)) / (F.col("host_docs") + F.lit(weight))
    return hosts.withColumn("host_rejected", shrunk > max_rate)


def host_quality(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """All columns of ``docs`` but the text, the base counts, the host's counts and ``kept``.

    The counts are written once to the shared folder (no text), so that the host
    table and the result read them without a second pass over the texts. A hot
    host is one row of a partial aggregate; the join back is left to Spark, which
    splits a skewed side.
    """
    own = [c for c in ("host_docs", "host_failures", "host_rejected", "kept") if c != host]  # an input column of such a name gives way
    scored = cut_lineage(score(docs.drop(*(c for c in own if c != text)), text).drop(text), "quality")
    hosts = host_verdicts(scored, host, max_rate)
    return (scored.join(hosts, F.col(host).eqNullSafe(F.col("_q_host")), "left").drop("_q_host")
            .withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with its columns, that pass the base rules and whose host passes."""
    scored = score(docs, text, verdict_only=True)
    counted = cut_lineage(scored.select(F.col(host).alias("_q_source"), F.col("_q_failed").alias("base_failed")), "quality")
    bad = host_verdicts(counted, "_q_source", max_rate).filter("host_rejected").select("_q_host")
    good = scored.filter(~F.col("_q_failed")).select(*docs.columns)
    return good.join(bad, F.col(host).eqNullSafe(F.col("_q_host")), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    from towerfill.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return host_quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                     "base_failed", "kept", "host_docs", "host_failures")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
gh AS (SELECT rid, i, array_to_string(ws[i:i+4], ' ') AS s FROM g),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM gh) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i+1, i+2, i+3, i+4]) AS p FROM r) GROUP BY rid),
m AS (SELECT doc_id, source, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
      FROM w LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS host_docs, sum(base_failed::INT) AS host_failures FROM b GROUP BY source),
p AS (SELECT avg(host_failures / host_docs) AS mu, var_pop(host_failures / host_docs) AS v FROM h),
k AS (SELECT mu, CASE WHEN v > 1e-12 THEN mu * (1 - mu) / v - 1 ELSE 1e12 END AS w FROM p)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT ((host_failures + w * mu) / (host_docs + w) > 0.5) AS kept,
       host_docs, host_failures::BIGINT AS host_failures
FROM b JOIN h ON b.source IS NOT DISTINCT FROM h.source CROSS JOIN k
"""
