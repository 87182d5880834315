"""Hard negatives from an STR-packed R-tree over integer vectors.

1. Vectors become integers, floor(256 * x). Rows are range-partitioned by label and the
   coordinate of the largest variance, and each partition is cut into trees of at most
   ``TREE_ROWS`` rows. A tree is packed by sort-tile-recursion: sorted by label and cut
   into slabs, each sorted by the next coordinate and cut again; leaves of ``LEAF`` rows,
   ``FAN`` children per node. Every node keeps its minimum bounding box (and label range).
2. For a query a box gives an interval of inner products: each coordinate's product lies
   between its products with the box's two sides, and the sums are the bounds.
3. Trees are dealt to lanes and anchors to groups; a lane and a group meet in one task, which
   searches its anchors in blocks of at most ``BLOCK``. Per anchor the boxes outside the score
   window, of no wanted label, or strictly below the k-th best so far are pruned from the root
   down; the leaves that stay are read by descending upper bound (within the window), a few
   more at each turn. The k best of a tree prune the lane's next one. A lane gives the k best
   of its trees; Spark ranks the lanes' results together. So a tree is copied once per group
   and an anchor once per lane, not a tree for every block of anchors.
4. First the positives are found (same label, no window), then, with windows that their
   scores set, the negatives of all positives of an anchor in one pass over each tree.

All rows are indexed and every answer is exact. Equal scores are ordered by the smaller
id, so a box whose bound equals the k-th score is still opened.

Defined results: a null id, label or vector, or a null or non-finite component, takes no
part. Of rows with one id the one with the least (label, vector) counts, so a repeated row
counts once. A shorter vector counts as if zeros followed; an empty one scores 0. A
component whose floor(256 * x) is over 2**31, or sums past 2**53, raise. A positive score
below zero has an empty window. Columns other than id, label and vector are not read.
An empty table, or one without anchors, gives no rows.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from towerfill.llm.common import cut_lineage, table

POSITIVES = 5
NEGATIVES = 10
#: The score window in hundredths of the positive's score.
LOW, HIGH = 30, 90
EVERY = 100
SCALE = 256
#: Rows of a tree and of a leaf, children of a node, anchors of a block.
TREE_ROWS = 1 << 12
LEAF = 64
FAN = 16
BLOCK = 128
#: Cells (rows x coordinates) of the trees of a lane, about, and anchors of a group: they bound a task's memory, not its result.
LANE_CELLS = 1 << 21
GROUP = 1 << 13
#: Coordinates that are tiled after the label.
TILES = 2
LARGEST = 1 << 31


def clean(rows: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(``id``, ``label``, ``v``): usable rows with integer components, an id once."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(c * SCALE))
    got = rows.filter(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & ~bad)
    got = got.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole.alias("v"))
    one = got.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r"))
    return one.select("id", "r.label", "r.v")


def _matrix(vectors: list[list[int]], dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    if len(vectors) and np.abs(out).max(initial=0) > LARGEST:
        raise ValueError("a component of a vector is too large for exact sums")
    return out


def tile(label: np.ndarray, v: np.ndarray, order: list[int], leaf: int = LEAF) -> list[np.ndarray]:
    """Sort-tile-recursion: the row numbers of each leaf, by label and the coordinates of ``order``."""
    keys = [label, *[v[:, d] for d in order]]

    def cut(rows: np.ndarray, k: int) -> list[np.ndarray]:
        leaves = -(-len(rows) // leaf)
        rows = rows[np.argsort(keys[k][rows], kind="stable")]
        if k == len(keys) - 1 or leaves == 1:
            return [rows[i:i + leaf] for i in range(0, len(rows), leaf)]
        slabs = int(np.ceil(leaves ** (1 / (len(keys) - k))))
        size = -(-leaves // slabs) * leaf
        return [x for i in range(0, len(rows), size) for x in cut(rows[i:i + size], k + 1)]

    return cut(np.arange(len(label)), 0)


class Tree:
    """A packed tree. Nodes are numbered with the root last; a leaf's children are rows ``start`` to ``end`` of the sorted arrays."""

    def __init__(self, ids: np.ndarray, label: np.ndarray, v: np.ndarray, order: list[int], leaf: int = LEAF, fan: int = FAN):
        parts = tile(label, v, order, leaf)
        at = np.concatenate(parts)
        self.ids, self.label, self.v = ids[at], label[at], v[at]
        ends = np.cumsum([len(p) for p in parts])
        level = [(int(e) - len(p), int(e), self.v[e - len(p):e].min(0), self.v[e - len(p):e].max(0),
                  int(self.label[e - len(p):e].min()), int(self.label[e - len(p):e].max())) for p, e in zip(parts, ends)]
        self.leaves, nodes = len(level), list(level)
        first = 0
        while len(level) > 1:  # pack `fan` neighbours into a node of the next level
            up = []
            for i in range(0, len(level), fan):
                k = level[i:i + fan]
                up.append((first + i, first + i + len(k), np.min([x[2] for x in k], axis=0), np.max([x[3] for x in k], axis=0),
                           min(x[4] for x in k), max(x[5] for x in k)))
            first += len(level)
            level = up
            nodes += up
        self.start, self.end = [n[0] for n in nodes], [n[1] for n in nodes]
        self.low, self.high = np.array([n[2] for n in nodes]), np.array([n[3] for n in nodes])
        self.least, self.most = np.array([n[4] for n in nodes]), np.array([n[5] for n in nodes])
        self.root = np.array([len(nodes) - 1])
        self.children = {i: np.arange(n[0], n[1]) for i, n in enumerate(nodes) if i >= self.leaves}

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest inner product that each query (row) can have in each node's box."""
        plus, minus = np.maximum(q, 0), np.minimum(q, 0)
        return plus @ self.low.T + minus @ self.high.T, plus @ self.high.T + minus @ self.low.T

    def positives(self, anchor: int, label: int, q: np.ndarray, upper: np.ndarray, k: int, best: list[tuple[int, int]] | None = None,
                  products: Products | None = None, i: int = 0) -> list[tuple[int, int]]:
        """(score, id) of the ``k`` best other rows of the anchor's label, of this tree and of ``best``."""
        may = (self.least <= label) & (label <= self.most)
        rows = (self.label == label) & (self.ids != anchor)
        return self._search(products or Products(self, q[None]), i, upper, may, rows, -np.inf, np.inf, k, best or [])

    def negatives(self, label: int, q: np.ndarray, lower: np.ndarray, upper: np.ndarray, windows: list[tuple[int, int]],
                  k: int, best: list[list[tuple[int, int]]] | None = None, products: Products | None = None,
                  i: int = 0) -> list[list[tuple[int, int]]]:
        """Per window (least and greatest score) the (score, id) of its ``k`` best rows of other labels, of this tree and of ``best``."""
        products = products or Products(self, q[None])
        rows, mixed = self.label != label, (self.least != label) | (self.most != label)
        out = list(best or [[] for _ in windows])
        for w, (lo, hi) in enumerate(windows):
            if lo <= hi:
                may = mixed & (lower <= hi) & (upper >= lo)
                out[w] = self._search(products, i, np.minimum(upper, hi), may, rows, lo, hi, k, out[w])
        return out

    def _search(self, products: Products, i: int, bound: np.ndarray, may: np.ndarray, rows: np.ndarray, lo: float, hi: float, k: int,
                best: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """``best`` (score, id) in order, with the wanted ``rows`` of boxes that ``may`` hold one and whose ``bound`` is not below the k-th."""
        before, s = best, products.s[i]  # unread rows are NaN there and stand no comparison
        full = len(best) == k
        worst = best[-1][0] if full else -np.inf
        nodes = self.root
        while (nodes := nodes[may[nodes] & (bound[nodes] >= worst)]).size and nodes[0] >= self.leaves:
            nodes = np.concatenate([self.children[n] for n in nodes.tolist()])
        size = 64 if full else 1
        if len(nodes) > size:
            nodes = nodes[np.argsort(-bound[nodes], kind="stable")]
        while nodes.size and bound[nodes].max() >= worst:
            products.read(nodes[:size])
            nodes, size = nodes[size:], 8 * size
            found = (rows & (s >= max(lo, worst)) & (s <= hi)).nonzero()[0]
            if len(found) > k:  # the k-th score and all that equal it
                found = found[s[found] >= np.partition(s[found], len(found) - k)[len(found) - k]]
                found = found[np.lexsort((self.ids[found], -s[found]))[:k]]
            if len(found):
                best = sorted([*before, *zip(s[found].astype(np.int64).tolist(), self.ids[found].tolist())], key=lambda x: (-x[0], x[1]))[:k]
                worst = best[-1][0] if len(best) == k else -np.inf
        return best


class Products:
    """The inner products of a block's anchors with a tree's rows; a leaf's are worked out when the first anchor opens it."""

    def __init__(self, tree: Tree, q: np.ndarray):
        self.tree, self.q = tree, q
        self.s, self.unread = np.full((len(q), len(tree.ids)), np.nan), np.ones(tree.leaves, bool)

    def read(self, leaves: np.ndarray) -> None:
        if (new := leaves[self.unread[leaves]]).size:
            for n in new.tolist():
                a, b = self.tree.start[n], self.tree.end[n]
                self.s[:, a:b] = self.q @ self.tree.v[a:b].T
            self.unread[new] = False


def _plant(dims: int, order: list[int], tree_rows: int, leaf: int, fan: int):
    """Tasks: a partition's sorted rows as trees (``lane``, ``tree``)."""
    def grow(held):
        ids, label, v = (sum((h[i] for h in held), []) for i in range(3))
        t = Tree(np.array(ids, np.int64), np.array(label, np.int64), _matrix(v, dims), order, leaf, fan)
        t.v, t.low, t.high = t.v.astype(np.int32), t.low.astype(np.int32), t.high.astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array([min(ids)], pa.int64()), pa.array([pickle.dumps(t)], pa.binary())], ["least", "tree"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                part = b.slice(at, tree_rows - n)
                held.append([part[c].to_pylist() for c in ("id", "label", "v")])
                n, at = n + part.num_rows, at + part.num_rows
                if n == tree_rows:
                    yield grow(held)
                    held, n = [], 0
        if held:
            yield grow(held)
    return run


def plant(rows: DataFrame, tree_rows: int = TREE_ROWS, leaf: int = LEAF, fan: int = FAN) -> tuple[DataFrame, int, int]:
    """Trees (``least``, ``tree``) over all of ``rows`` (written), their number and the vectors' width."""
    dims, n = rows.agg(F.max(F.size("v")), F.count("*")).first()
    dims = dims or 0
    spread = [F.coalesce(F.var_pop(F.get("v", F.lit(d))), F.lit(0.0)).alias(f"d{d}") for d in range(dims)]
    var = list(rows.agg(*spread).first()) if dims else []
    order = sorted(range(dims), key=lambda d: (-var[d], d))[:TILES]
    parts = max(1, -(-n // tree_rows))
    keys = ["label", *[F.coalesce(F.get("v", F.lit(d)), F.lit(0)) for d in order[:1]], "id"]
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    trees = cut_lineage(dealt.mapInArrow(_plant(dims, order, tree_rows, leaf, fan), "least long, tree binary"), "trees")
    return trees, trees.count(), dims


FOUND = ["anchor_id", "positive_id", "positive_score", "found_id", "found_score"]


def _meet(dims: int, block: int, start, find, rows):
    """Tasks: a lane's trees and a group's anchors. ``find`` adds a tree to the results that ``start`` made for an anchor, ``rows`` lists them."""
    def run(trees: pa.Table, anchors: pa.Table) -> pa.Table:
        grown = [pickle.loads(raw.as_buffer()) for raw in trees["tree"]]
        for t in grown:
            t.v, t.low, t.high = (x.astype(float) for x in (t.v, t.low, t.high))
        out = [[] for _ in FOUND]
        for at in range(0, anchors.num_rows, block):
            some = anchors.slice(at, block).to_pylist()
            q = _matrix([a["v"] for a in some], dims)
            best = [start(a) for a in some]
            for t in grown:
                if dims and (np.abs(t.v).max(initial=0) * np.abs(q).max(initial=0) * dims) >= 2**53:
                    raise ValueError("inner products are too large for exact sums")
                lower, upper = t.bounds(q)
                products = Products(t, q)
                for i, a in enumerate(some):
                    best[i] = find(t, a, q[i], lower[i], upper[i], best[i], products, i)
            for a, b in zip(some, best):
                for row in rows(a, b):
                    for column, x in zip(out, row):
                        column.append(x)
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in out], FOUND)
    return run


def deal(trees: int, anchors: int, cells: int, cores: int, block: int) -> tuple[int, int]:
    """The numbers of lanes and of groups: as few copies as the bounds of a task allow, but work for all ``cores``."""
    blocks, most = max(1, -(-anchors // block)), max(1, LANE_CELLS // max(1, cells))
    lanes = max(1, -(-trees // most), min(trees, -(-8 * cores // blocks)))
    return lanes, max(1, -(-anchors // GROUP), min(blocks, -(-8 * cores // lanes)))


def meet(trees: DataFrame, anchors: DataFrame, lanes: int, groups: int, run) -> DataFrame:
    """Every lane of trees with every group of anchors, searched by ``run``; both are dealt by hash and shuffled."""
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    unit = (F.col("lane") * groups + F.col("group")).alias("unit")
    left = trees.select(part("least", lanes).alias("lane"), every(groups).alias("group"), "tree").select(unit, "tree")
    right = anchors.select(part("id", groups).alias("group"), every(lanes).alias("lane"), "id", "label", "v", "want").select(
        unit, "id", "label", "v", "want")
    left, right = (x.repartition(lanes * groups, "unit").groupBy("unit") for x in (left, right))
    return left.cogroup(right).applyInArrow(run, ", ".join(f"{c} long" for c in FOUND))


def hard_negatives(rows: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", every: int = EVERY,
                   positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
                   tree_rows: int = TREE_ROWS, leaf: int = LEAF, fan: int = FAN, block: int = BLOCK) -> DataFrame:
    """(``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``) for anchors whose id ``every`` divides."""
    kept = cut_lineage(clean(rows, vec_id, label, vector), "vectors")
    trees, n, dims = plant(kept, tree_rows, leaf, fan)
    nothing = F.array().cast("array<struct<id:bigint,score:bigint>>")
    anchors = kept.filter(F.col("id") % every == 0)
    lanes, groups = deal(n, anchors.count(), tree_rows * dims, rows.sparkSession.sparkContext.defaultParallelism, block)

    def first(tree, a, q, lower, upper, best, products, i):
        return tree.positives(a["id"], a["label"], q, upper, positives, best, products, i)

    def then(tree, a, q, lower, upper, best, products, i):
        windows = [(-(-low * w["score"] // 100), high * w["score"] // 100) for w in a["want"]]
        return tree.negatives(a["label"], q, lower, upper, windows, negatives, best, products, i)

    seek = _meet(dims, block, lambda a: [], first, lambda a, best: [(a["id"], None, None, i, s) for s, i in best])
    refuse = _meet(dims, block, lambda a: [[] for _ in a["want"]], then,
                   lambda a, best: [(a["id"], w["id"], w["score"], i, s) for w, f in zip(a["want"], best) for s, i in f])

    def best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(F.desc("found_score"), "found_id")
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    pos = best(meet(trees, anchors.withColumn("want", nothing), lanes, groups, seek), ["anchor_id"], positives)
    want = cut_lineage(pos.groupBy("anchor_id").agg(F.sort_array(F.collect_list(
        F.struct(F.col("found_id").alias("id"), F.col("found_score").alias("score")))).alias("want")), "positives")
    with_want = anchors.join(want, anchors["id"] == want["anchor_id"]).select("id", "label", "v", "want")
    neg = best(meet(trees, with_want, lanes, groups, refuse), ["anchor_id", "positive_id"], negatives)
    return neg.select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score",
                      F.col("found_score").alias("negative_score"))


def query(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", shifted.alias("label"), "embedding"))


ORACLE = r"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
