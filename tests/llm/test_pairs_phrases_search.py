"""Min-max hashing, phrase collocations and the R-tree search against brute force."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from towerfill.llm import minmax, phrases, rtree
from tests.llm.helpers import SCHEMA, documents, table

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def brute_components(rows, width=2):
    sets = []
    for doc, text, *_ in rows:
        w = (text or "").encode().translate(LOWER).split()
        k = min(width, len(w))
        sets.append((doc, {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if k else set()))
    label = list(range(len(sets)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                label[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(sets):
        low[find(i)] = min(low.get(find(i), doc), doc)
    return sorted((doc, len(s), low[find(i)] if s else doc, doc == (low[find(i)] if s else doc)) for i, (doc, s) in enumerate(sets))


@pytest.mark.parametrize("seed,block_sets", [(1, 1 << 11), (2, 3)])
def test_min_max_groups(spark, seed, block_sets):
    rng = random.Random(seed)
    rows = documents(seed)
    base = [f"w{i}" for i in range(60)]
    for k in range(25):  # near copies whose chain is longer than the similarity
        w = list(base)
        for i in range(k % 9):
            w[rng.randrange(60)] = f"e{k}.{i}"
        rows.append((1000 + k, " ".join(w), "en", "s", 0, "n", "w", "l", "k", "s"))
    got = minmax.near_duplicates(table(spark, rows), block_sets=block_sets).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute_components(rows)


def test_min_max_edges(spark):
    assert minmax.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c"), (None, "a b c"), (5, "a b c"), (6, None), (7, ""), (8, "one"), (9, "One")]
    got = minmax.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == sorted(
        [(None, 2, 5, False)] * 2 + [(5, 2, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 1, 8, True), (9, 1, 8, False)], key=str)


def test_min_and_max_estimate_the_similarity():
    rng = np.random.default_rng(7)
    u = rng.integers(0, 2**64, 400, dtype=np.uint64)
    a, b = u[:360], np.concatenate([u[:320], u[360:]])  # 320 of 400 in both
    s = minmax.min_max([a, b], minmax.multipliers(2000))
    share = (s[:, :, 0] == s[:, :, 1]).mean(axis=0)
    assert abs(share[0] - 0.8) < 0.04 and abs(share[1] - 0.8) < 0.04
    both = (s[:, :, 0] == s[:, :, 1]).mean(axis=1)
    assert both.var() < 0.8 * 0.2 / 2 * 1.02  # no more than two independent values would have
    assert (minmax.min_max([np.concatenate([a] * 300)], minmax.multipliers(5)) == minmax.min_max([a], minmax.multipliers(5))).all()


def brute_phrases(rows, min_count, top):
    f = defaultdict(Counter)
    n = Counter()
    for _, text, lang, *_ in rows:
        low = (text or "").encode().translate(LOWER)
        for c in b".,;:!?\n\x0b\x0c\r":
            low = low.replace(bytes([c]), b"\n")
        for piece in low.split(b"\n"):
            w = [x for x in piece.replace(b"\t", b" ").split(b" ") if x]
            n[lang or "und"] += len(w)
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= min_count}
        found = []
        for p, a in cand.items():
            if any(100 * b >= 50 * a and len(q) > len(p) and p in (q[:2], q[1:]) for q, b in cand.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, b" ".join(p), left, right))
        for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def phrase_rows(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)] + ["É", "x" * 500, "naïve"]
    rows = []
    for i in range(60):
        t = "".join(rng.choice(vocab) + rng.choice([" "] * 8 + ["\t", ". ", "\n", " New york city "]) for _ in range(rng.randint(0, 200)))
        rows.append((i, t, rng.choice(["en", "fr", None]), "s", 0, "n", "w", "l", "k", "s"))
    rows += [(90, None, "en", "s", 0, "n", "w", "l", "k", "s"), (91, "", None, "s", 0, "n", "w", "l", "k", "s"), rows[3], rows[3]]
    rows.append((92, "hot pair " * 20_000, "en", "s", 0, "n", "w", "l", "k", "s"))
    return rows


@pytest.mark.parametrize("seed,trie", [(1, {}), (2, dict(burst=16, limit=500, prefix_bits=5)), (3, dict(burst=2, limit=50, prefix_bits=2))])
def test_phrases(spark, monkeypatch, seed, trie):
    rows = phrase_rows(seed)
    if trie:
        monkeypatch.setattr(phrases, "CHUNK_PATHS", 64)
        monkeypatch.setattr(phrases, "TEXT_BYTES", 512)
    got = phrases.collocations(table(spark, rows), min_count=4, top=50, **trie).collect()
    want = brute_phrases(rows, 4, 50)
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == want
    assert len(want) > 60


def test_phrases_without_words(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert phrases.collocations(table(spark, [(1, None, None, "s", 0, "n", "w", "l", "k", "s"), (2, " . ", "en", "s", 0, "n", "w", "l", "k", "s")])).count() == 0


def test_trie_counts_and_stays_small():
    rng = np.random.default_rng(3)
    trie, spilled, most = phrases.Counter(burst=32, limit=300), [], 0
    want: Counter = Counter()
    for _ in range(40):
        w = rng.zipf(1.5, 200).astype(np.uint64) % np.uint64(500) + np.uint64(1)
        piece = np.sort(rng.integers(0, 20, 200))
        spilled += list(trie.add(w, piece))
        most = max(most, trie.entries)
        for i in range(199):
            if piece[i] == piece[i + 1]:
                third = int(w[i + 2]) if i < 198 and piece[i + 2] == piece[i] else 0
                want[int(w[i]), int(w[i + 1]), third] += 1
    assert most <= 500 and len(spilled) > 5
    got: Counter = Counter()
    for p in [*spilled, trie.spill(0)]:
        assert (np.diff(p["pair"].astype(object)) >= 0).all()
        assert (phrases.unpack(phrases.pack(p)) == p).all()
        for a, b, c, n in zip(p["w1"].tolist(), p["w2"].tolist(), p["w3"].tolist(), p["n"].tolist()):
            got[a, b, c] += n
    assert got == want


def brute_negatives(rows, every=100):
    v = {}
    for i, x, label in sorted((r for r in rows if None not in r), key=lambda r: r[0]):
        if any(c is None or not math.isfinite(c) for c in x):
            continue
        x = tuple(math.floor(256 * float(np.float32(c))) for c in x)
        v[i] = min(v.get(i, (label, x)), (label, x))
    out = []
    for a, (label, q) in v.items():
        if a % every:
            continue
        s = sorted((-sum(x * y for x, y in zip(q, w)), i, lab) for i, (lab, w) in v.items() if i != a)
        for p, i, _ in [x for x in s if x[2] == label][:5]:
            neg = [x for x in s if x[2] != label and -30 * p <= -100 * x[0] <= -90 * p][:10]
            out += [(a, i, k + 1, j, -p, -t) for k, (t, j, _) in enumerate(neg)]
    return sorted(out)


@pytest.mark.parametrize("shape", [dict(), dict(tree_rows=50, leaf=4, fan=3, block=2)])
def test_hard_negatives(spark, shape):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(0.1, 0.3, 8)], int(rng.integers(0, 4))) for i in range(600)]
    rows += [(1000 + i, [0.5] * 8, i % 2) for i in range(300)]  # one vector many times, with ties
    rows += [(2000, None, 1), (2100, [0.1, None], 1), (2200, [float("nan")] * 8, 1), (2300, [float("inf")] + [0.0] * 7, 1),
             (2400, [0.3] * 8, None), (None, [0.3] * 8, 1), (2500, [], 1), (2600, [0.5, 0.25], 2), (2700, [-0.5] * 8, 3), rows[0], rows[5]]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, id string, tree int").repartition(3)
    got = rtree.hard_negatives(df, **shape).collect()
    want = brute_negatives(rows)
    assert sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got) == want
    assert len(want) > 200


def test_trees_are_copied_per_group_of_anchors(spark, monkeypatch):
    assert rtree.deal(176, 7182, 4096 * 64, 6, 128) == (22, 3)  # 528 copies of trees, not 176 for each of 57 blocks
    lanes, groups = rtree.deal(880, 36_000, 4096 * 64, 6, 128)
    assert (lanes, groups) == (110, 5) and rtree.deal(0, 0, 0, 6, 128) == (1, 1)
    monkeypatch.setattr(rtree, "LANE_CELLS", 50 * 8 * 4)
    monkeypatch.setattr(rtree, "GROUP", 3)
    seen = []
    real = rtree.meet

    def meet(*a):
        out = real(*a)
        seen.append((a[2], a[3], out._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr(rtree, "meet", meet)
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(0.1, 0.3, 8)], int(rng.integers(0, 3))) for i in range(600)]
    rows += [(2000 + i, [0.25] * 8, i % 2) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = rtree.hard_negatives(df, tree_rows=50, leaf=4, fan=3, block=2).collect()
    assert sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got) == brute_negatives(rows)
    assert len(seen) == 2 and all(lanes >= 4 and groups >= 3 for lanes, groups, _ in seen)
    assert "Join" not in seen[0][2] and "Broadcast" not in seen[0][2]


def test_no_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert rtree.hard_negatives(spark.createDataFrame([], schema)).count() == 0
    assert rtree.hard_negatives(spark.createDataFrame([(1, [0.1], 1)], schema)).count() == 0
    with pytest.raises(Exception, match="too large"):
        rtree.hard_negatives(spark.createDataFrame([(100, [1e9], 1), (101, [1e9], 1)], schema)).collect()


def test_boxes_hold_and_prune():
    rng = np.random.default_rng(1)
    v = np.floor(rng.normal(0, 80, (500, 6)))
    v[:, 0] += np.repeat(np.arange(10), 50) * 2000
    t = rtree.Tree(np.arange(500), np.repeat([0, 1], 250), v, [0, 1], leaf=8, fan=4)
    q = np.floor(rng.normal(0, 80, (5, 6)))
    q[:, 0] = 50
    lower, upper = t.bounds(q)
    for node in range(t.leaves):
        s = t.v[t.start[node]:t.end[node]] @ q.T
        assert (s.min(0) >= lower[:, node]).all() and (s.max(0) <= upper[:, node]).all()
    assert sorted(t.ids.tolist()) == list(range(500))

    class Watch(list):
        read: set = set()

        def __getitem__(self, node):
            self.read.add(node)
            return list.__getitem__(self, node)

    t.start = Watch(t.start)
    t.positives(-1, 1, q[0], upper[0], 5)
    assert len([n for n in Watch.read if n < t.leaves]) < t.leaves / 4
