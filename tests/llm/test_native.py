"""Quality rules, shards and decontamination against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import pytest

from towerfill.llm import decontam, quality, shards
from tests.llm.helpers import SCHEMA, documents, table

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def base_rule(text):
    t = text or ""
    w = SPLIT.findall(t)
    lines = [x for x in t.split("\n") if SPLIT.search(x)]
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    c = Counter(grams)
    hit = {j for i, g in enumerate(grams) if c[g] > 1 for j in range(i, i + 5)}
    return (len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), len(lines) - len(set(lines)), len(hit),
            len(w) < 10 or 100 * len(hit) > 20 * len(w))


def test_base_rules_and_host_verdicts(spark):
    rows = documents()
    got = quality.host_quality(table(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == \
        sorted((r[0], *base_rule(r[1])) for r in rows)
    hosts = Counter(r[3] for r in rows)
    failed = Counter(r[3] for r in rows if base_rule(r[1])[-1])
    assert all(r.host_docs == hosts[r.source] and r.host_failures == failed[r.source] for r in got)
    assert all(r.kept == (not r.base_failed) for r in got)  # no host fails mostly


def test_failing_host_goes_and_small_host_is_shrunk(spark):
    good, bad = "a b c d e f g h i j k l", "x"
    rows = [(i, good if i % 10 else bad, f"h{i % 5}") for i in range(100)]
    rows += [(200 + i, bad if i % 10 else good, "junk") for i in range(50)] + [(300, bad, "tiny"), (301, good, "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.kept for r in quality.host_quality(df).collect()}
    assert not any(got[200 + i] for i in range(50)) and got[301]
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, v in got.items() if v}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([], "item_id long, text string")
    assert quality.host_quality(none).count() == quality.keep_good(none).count() == 0
    assert shards.minimax_shards(none).count() == 0
    assert decontam.contamination(none, items).count() == 0
    some = table(spark, documents())
    assert decontam.contamination(some, items).filter("n_hit > 0").count() == 0
    assert decontam.drop_contaminated(some, items).count() == some.count()


def low_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_hits(text, items):
    w, hit, found = low_words(text), set(), set()
    for item, t in items:
        v = low_words(t)
        n = min(10, len(v))
        windows = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i:i + n]) in windows:
                hit |= set(range(i, i + n))
                if item is not None:
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_contamination(spark, monkeypatch, limit):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", limit)
    docs = documents()
    long = [r[1] for r in docs if r[1] and 60 < len(r[1].split()) < 200]
    items = [(1, " ".join(long[0].split()[5:40])), (2, long[1].upper()), (10, "two, words"), (3, None), (4, " ... "),
             (5, "no such thing here"), (6, "x x x x x x x x x x x"), (7, "É"), (None, long[2]), (1, " ".join(long[3].split()[:9]))]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(table(spark, docs), b).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got) == sorted((r[0], *brute_hits(r[1], items)) for r in docs)
    left = decontam.drop_contaminated(table(spark, docs), b)
    assert sorted(r.doc_id for r in left.collect()) == sorted(r[0] for r in docs if not brute_hits(r[1], items)[1])


def test_cuts_are_minimal():
    sizes = [5, 9, 1, 1, 7, 3, 3, 8, 2, 2, 6]
    best = shards.smallest_capacity(sizes, 4)
    assert shards.shards_needed(sizes, best) <= 4 < shards.shards_needed(sizes, best - 1)
    out = shards.cut(sizes, 4)
    assert out == sorted(out) and max(sum(s for s, k in zip(sizes, out) if k == j) for j in range(4)) == best
    assert shards.cut([], 4) == [] and shards.cut([3], 4) == [0]


def test_shards(spark):
    rows = documents()
    df = table(spark, rows).drop("shard")
    got = shards.minimax_shards(df, shards=7).collect()
    size = {r[0]: len((r[1] or "").encode()) + 16 for r in rows}
    crc = {r[0]: zlib.crc32((r[1] or "").encode()) for r in rows}
    assert len(got) == len(rows) and all(r["size"] == size[r.doc_id] and r.text_crc32 == crc[r.doc_id] for r in got)
    text = {r[0]: r[1] or "" for r in rows}
    home: dict = {}
    for r in got:  # equal texts lie together
        assert home.setdefault(text[r.doc_id], r.shard) == r.shard
    assert {r.shard for r in got} <= set(range(7))
    for k in range(7):
        slots = sorted(r.slot for r in got if r.shard == k)
        assert slots == list(range(len(slots)))
    again = shards.minimax_shards(df.repartition(5), shards=7).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_shards_are_near_equal(spark):
    import random
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(0, 400) + str(i % 900)) for i in range(3000)] + [(5000 + i, "copy " * 20) for i in range(150)]
    got = shards.minimax_shards(spark.createDataFrame(rows, "doc_id long, text string"), shards=8).collect()
    load = {k: sum(r["size"] for r in got if r.shard == k) for k in range(8)}
    mean, largest = sum(load.values()) / 8, 150 * 116
    assert max(load.values()) <= mean + largest and min(load.values()) > 0.5 * mean
    # brute force over the ordered cells: no contiguous cut has a smaller largest shard
    sizes = [rng.randint(1, 30) for _ in range(11)]
    import itertools
    best = min(max(sum(sizes[a:b]) for a, b in zip((0, *c), (*c, 11))) for c in itertools.combinations(range(1, 11), 3))
    assert shards.smallest_capacity(sizes, 4) == best


@pytest.mark.parametrize("name", ["size", "text_crc32", "shard", "slot", "n", "b"])
def test_shards_with_a_clashing_column(spark, name):
    df = spark.createDataFrame([(1, "a", "z"), (2, "b", "z")], f"doc_id long, text string, {name} string")
    got = shards.minimax_shards(df, shards=2)
    assert got.columns.count("shard") == got.columns.count("slot") == 1 and {r.slot for r in got.collect()} <= {0, 1}


@pytest.mark.parametrize("name", ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_docs", "host_failures",
                                  "host_rejected", "kept"])
def test_quality_with_a_clashing_column(spark, name):
    good = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, good, "s", "mine"), (2, "few", "s", "mine"), (3, good, "s", "mine")], f"doc_id long, text string, source string, {name} string")
    got = {r.doc_id: r for r in quality.host_quality(df).collect()}
    assert got[1].n_words == 20 and got[2].base_failed and got[1].host_docs == 3 and not got[2].kept
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and all(r[name] == "mine" for r in kept.collect())


def test_item_digest_is_over_sorted_ids():
    assert hashlib.sha256(b"1,10,2").hexdigest() != hashlib.sha256(b"1,2,10").hexdigest()
