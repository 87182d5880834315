"""Phrase collocations counted in HAT-tries whose subtrees are spilled as sorted runs.

1. A task turns its texts into paths of word ids: from each word the word and up to
   ``DEPTH - 1`` more of its piece. The paths are counted in a HAT-trie: hash containers
   shared by a range of first words burst into one container per first word, and those
   into one per first two words, when they grow past ``BURST`` entries.
2. When the trie holds ``LIMIT`` entries its largest subtrees are spilled whole until
   an eighth is left, and all at the end of the task; so memory is bounded whatever the
   input. A spilled subtree's paths become runs sorted by their first two words' hash,
   one per prefix (the leading bits of that hash), in chunks of ``CHUNK_PATHS`` paths.
3. Spark deals the chunks to partitions by prefix and sorts them by their first hash; a
   task merges them as a stream: paths below the next chunk's first hash are complete.
   All paths of a pair of words lie in one prefix, so a pair's and a triple's count are
   exact there, and only those of ``min_count`` leave it.
4. Words are counted by the same tasks and summed by Spark. The frequent pairs and
   triples are joined with their parts, scored in decimals and ranked by Spark.

A pair of words, however hot, is one container per spill, so what is shuffled for it is
its distinct third words per spill, never its occurrences. Word ids in the shuffle are
64-bit hashes of language and word; the query raises if two words share one.

Defined results: null or empty text has no words; a null ``lang`` is ``und``. A repeated
row counts again. Texts are read whole, however long; a piece's words may be of any
length. Ties in the score of a cut go to the first cut; ties between phrases are
ordered by count, then by the phrase's bytes. Columns other than the text and the
language are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from towerfill.llm.common import cut_lineage, table
from towerfill.llm.hashing import BASE, BYTE, LOWER, between, mix, sums, utf8

DEPTH = 3
MIN_COUNT = 10
TOP = 2000
#: Fixed by the contract: what separates pieces, and words within them.
BREAKS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
#: Entries of a container that bursts, and of a trie that spills.
BURST = 1 << 12
LIMIT = 1 << 19
#: Bits of a word's number in a trie, and first words that share a container at first.
BITS = 21
SHARED_BITS = 6
#: Parts of a language's phrases that are ranked first.
PARTS = 32
#: Paths of a chunk; bytes of text that are turned into paths at a time.
CHUNK_PATHS = 1 << 13
TEXT_BYTES = 1 << 20
#: Rows of a batch whose texts are copied at a time.
SLICE = 1 << 12

_BREAK = np.isin(np.arange(256), list(BREAKS))
_GAP = _BREAK | np.isin(np.arange(256), list(BLANKS))
PATH = np.dtype([("pair", "<u8"), ("w1", "<u8"), ("w2", "<u8"), ("w3", "<u8"), ("n", "<i8")])


class Node:
    """A trie node: a hash container of path numbers, or, once burst, children by the number's leading bits."""

    __slots__ = ("counts", "children", "depth")
    #: What is cut off a path's number for the key of a child: ranges of first words, first words, first two words.
    SHIFTS = (2 * BITS + SHARED_BITS, 2 * BITS, BITS)

    def __init__(self, depth: int):
        self.counts: dict[int, int] | None = {}
        self.children: dict[int, Node] = {}
        self.depth = depth

    def add(self, paths: np.ndarray, n: np.ndarray, burst: int) -> int:
        """Counts sorted distinct path numbers; returns how many are new."""
        if self.counts is None:
            heads = paths >> np.uint64(self.SHIFTS[self.depth])
            cut = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1], [True]]))
            new = 0
            for head, i, j in zip(heads[cut[:-1]].tolist(), cut[:-1].tolist(), cut[1:].tolist()):
                child = self.children.get(head)
                if child is None:
                    child = self.children[head] = Node(self.depth + 1)
                new += child.add(paths[i:j], n[i:j], burst)
            return new
        counts, before = self.counts, len(self.counts)
        for p, c in zip(paths.tolist(), n.tolist()):
            counts[p] = counts.get(p, 0) + c
        new = len(counts) - before
        if len(counts) > burst and self.depth < len(self.SHIFTS):
            paths, n = self.take()
            self.counts = None
            self.add(paths, n, burst)
        return new

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """The subtree's path numbers and counts, sorted; it is empty afterwards."""
        got, stack = [], [self]
        while stack:
            node = stack.pop()
            stack += node.children.values()
            if node.counts:
                got.append((np.fromiter(node.counts.keys(), np.uint64, len(node.counts)),
                            np.fromiter(node.counts.values(), np.int64, len(node.counts))))
        self.counts, self.children = {}, {}
        if not got:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        paths, n = (np.concatenate(x) for x in zip(*got))
        order = np.argsort(paths)
        return paths[order], n[order]

    def size(self) -> int:
        return len(self.counts) if self.counts is not None else sum(c.size() for c in self.children.values())


class Counter:
    """A task's trie with its numbering of words; ``emit`` gets spilled paths (records of ``PATH``)."""

    def __init__(self, burst: int = BURST, limit: int = LIMIT):
        self.burst, self.limit = burst, limit
        self.clear()

    def clear(self) -> None:
        self.root, self.entries = Node(0), 0
        self.root.counts = None
        self.number: dict[int, int] = {}
        self.hash: list[int] = [0]  # number 0: no word

    def add(self, words: np.ndarray, piece: np.ndarray) -> Iterator[np.ndarray]:
        """Counts the paths of one run of words (hashes) with their pieces; yields what is spilled."""
        distinct, at = np.unique(words, return_inverse=True)
        if len(self.hash) + len(distinct) >= 1 << BITS:
            yield self.spill(0)
            self.clear()
        number, known = self.number, self.hash
        ids = np.empty(len(distinct), np.uint64)
        for i, h in enumerate(distinct.tolist()):
            k = number.get(h)
            if k is None:
                k = number[h] = len(known)
                known.append(h)
            ids[i] = k
        w = np.concatenate([ids[at], np.zeros(2, np.uint64)])
        p = np.concatenate([piece, [-1, -2]])
        second = np.where(p[1:-1] == p[:-2], w[1:-1], np.uint64(0))
        third = np.where(p[2:] == p[:-2], w[2:], np.uint64(0))
        paths = (w[:-2] << np.uint64(2 * BITS)) | (second << np.uint64(BITS)) | third
        paths, n = np.unique(paths[second > 0], return_counts=True)
        if len(paths):
            self.entries += self.root.add(paths, n, self.burst)
        if self.entries > self.limit:
            yield self.spill(self.limit // 8)

    def spill(self, left: int) -> np.ndarray:
        """Takes the largest subtrees out until ``left`` entries remain."""
        kids = self.root.children
        sizes = {k: c.size() for k, c in kids.items()}
        got = []
        for k in sorted(sizes, key=sizes.get, reverse=True):
            if self.entries <= left:
                break
            got.append(kids.pop(k).take())
            self.entries -= sizes[k]
        paths, n = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        known, low = np.array(self.hash, np.uint64), np.uint64((1 << BITS) - 1)
        out = np.empty(len(paths), PATH)
        out["w1"], out["w2"] = known[paths >> np.uint64(2 * BITS)], known[(paths >> np.uint64(BITS)) & low]
        out["w3"], out["n"] = known[paths & low], n
        out["pair"] = mix(out["w1"] * BASE + out["w2"])
        return out[np.argsort(out["pair"], kind="stable")]


def find_words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, hash and piece of each word of ``text`` (already in lower case)."""
    raw = np.frombuffer(text, np.uint8)
    gap = np.concatenate([[True], _GAP[raw], [True]])
    starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    run = sums(BYTE[raw])
    return starts, ends, between(run, starts, ends), np.cumsum(_BREAK[raw])[starts]


def runs_of(texts: list[bytes]) -> Iterator[bytes]:
    """The texts, put together with a break between them, in runs of about ``TEXT_BYTES``; a longer text is one run."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= TEXT_BYTES):
            size += len(texts[end]) + 1
            end += 1
        yield b"\n".join(texts[at:end])
        at = end


def parts_of(run: bytes, spell: bool) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(word hashes, pieces, distinct words in the order of their hashes if ``spell``) of a run, a long one cut at a piece's end."""
    low = LOWER[np.frombuffer(run, np.uint8)].tobytes()
    breaks = np.flatnonzero(_BREAK[np.frombuffer(low, np.uint8)])
    at = 0
    while at < len(low):
        k = int(np.searchsorted(breaks, at + 2 * TEXT_BYTES))
        end = int(breaks[k]) + 1 if k < len(breaks) else len(low)
        part = low[at:end]
        starts, ends, h, piece = find_words(part)
        if len(h):
            first = np.unique(h, return_index=True)[1] if spell else starts[:0]
            yield h, piece, [part[i:j] for i, j in zip(starts[first].tolist(), ends[first].tolist())]
        at = end


def language_seed(lang: str) -> np.uint64:
    run = sums(BYTE[np.frombuffer(lang.encode() + b" ", np.uint8)])
    return between(run, np.array([0]), np.array([len(run) - 1]))[0]


def pieces_of(batches, spell: bool) -> Iterator[tuple[str, np.uint64, np.ndarray, np.ndarray, list[bytes]]]:
    """(language, its seed, word hashes, pieces, distinct words) of the batches' texts, run by run."""
    for b in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
        by_lang: dict[str, list[bytes]] = {}
        for lang, t in zip(b["lang"].to_pylist(), utf8(b["text"])):
            by_lang.setdefault(lang, []).append(t)
        for lang, texts in by_lang.items():
            seed = language_seed(lang)
            for run in runs_of(texts):
                for h, piece, names in parts_of(run, spell):
                    yield lang, seed, h, piece, names


def _count_words(limit: int):
    """Tasks: (``lang``, ``word``, ``id``, ``n``) of the words, put together for about ``limit`` bytes at a time."""
    def rows(words):
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in words], pa.string()), pa.array([v[0] for v in words.values()], pa.binary()).cast(pa.string()),
             pa.array(np.array([k[1] for k in words], np.uint64).view(np.int64)), pa.array([v[1] for v in words.values()], pa.int64())],
            ["lang", "word", "id", "n"])

    def run(batches):
        words: dict[tuple[str, int], list] = {}
        size = 0
        for lang, seed, h, _, names in pieces_of(batches, True):
            at, n = np.unique(h, return_counts=True)
            for k, w, c in zip(mix(at ^ seed).tolist(), names, n.tolist()):
                v = words.get((lang, k))
                if v is None:
                    words[lang, k] = [w, c]
                    size += len(w) + 300
                elif v[0] != w:
                    raise ValueError(f"the words {w!r} and {v[0]!r} share a hash")
                else:
                    v[1] += c
            if size > limit:
                yield rows(words)
                words, size = {}, 0
        if words:
            yield rows(words)
    return run


def _count_paths(prefix_bits: int, burst: int, limit: int):
    """Tasks: the trie's runs in chunks (``prefix``, ``first``, ``run``); ``first`` is the chunk's least pair hash."""
    def chunks(paths: np.ndarray):
        if not len(paths):
            return
        prefix = (paths["pair"] >> np.uint64(64 - prefix_bits)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
        cuts = np.unique(np.concatenate([starts, np.arange(0, len(paths), CHUNK_PATHS), [len(paths)]]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(prefix[cuts[:-1]], pa.int32()), pa.array(_ordered(paths["pair"][cuts[:-1]])),
             pa.array([pack(paths[i:j]) for i, j in zip(cuts[:-1], cuts[1:])], pa.binary())], ["prefix", "first", "run"])

    def run(batches):
        trie = Counter(burst, limit)
        for _, seed, h, piece, _ in pieces_of(batches, False):
            for paths in trie.add(mix(h ^ seed), piece):
                yield from chunks(paths)
        yield from chunks(trie.spill(0))
    return run


def pack(paths: np.ndarray) -> bytes:
    """A chunk's bytes: its distinct words once, then 16-bit codes and counts."""
    words, codes = np.unique(np.concatenate([paths["w1"], paths["w2"], paths["w3"]]), return_inverse=True)
    return b"".join([np.array([len(paths), len(words)], "<u4").tobytes(), words.tobytes(), codes.astype("<u2").tobytes(),
                     paths["n"].tobytes()])


def unpack(raw: bytes) -> np.ndarray:
    n, d = np.frombuffer(raw, "<u4", 2).tolist()
    words = np.frombuffer(raw, "<u8", d, 8)
    codes = np.frombuffer(raw, "<u2", 3 * n, 8 + 8 * d)
    out = np.empty(n, PATH)
    out["w1"], out["w2"], out["w3"] = words[codes[:n]], words[codes[n:2 * n]], words[codes[2 * n:]]
    out["n"] = np.frombuffer(raw, "<i8", n, 8 + 8 * d + 6 * n)
    out["pair"] = mix(out["w1"] * BASE + out["w2"])
    return out


def _ordered(h: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as signed ones in the same order."""
    return (h ^ np.uint64(1 << 63)).view(np.int64)


def _summed(paths: np.ndarray) -> np.ndarray:
    """The paths sorted by pair, words, and equal ones put together."""
    p = paths[np.lexsort((paths["w3"], paths["w1"], paths["pair"]))]  # the pair's hash and its first word give the second
    at = np.flatnonzero(np.concatenate([[True], np.any([p[c][1:] != p[c][:-1] for c in ("pair", "w1", "w3")], axis=0)]))
    out = p[at]
    out["n"] = np.add.reduceat(p["n"], at)
    return out


def _merge(min_count: int):
    """Tasks: a partition's chunks, sorted by ``first``, merged as a stream; (``w1``, ``w2``, ``w3``, ``n``) of frequent paths.

    ``w3`` 0 stands for the pair itself.
    """
    def frequent(paths):
        p = _summed(paths)
        pair = np.flatnonzero(np.concatenate([[True], np.any([p[c][1:] != p[c][:-1] for c in ("pair", "w1")], axis=0)]))
        total = np.add.reduceat(p["n"], pair)
        two, three = pair[total >= min_count], np.flatnonzero((p["n"] >= min_count) & (p["w3"] != 0))
        at = np.concatenate([two, three])
        w3 = np.concatenate([np.zeros(len(two), np.uint64), p["w3"][three]])
        n = np.concatenate([total[total >= min_count], p["n"][three]])
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (p["w1"][at], p["w2"][at], w3)] + [pa.array(n)],
                                          ["w1", "w2", "w3", "n"])

    def run(batches):
        held, waiting, size, most = np.zeros(0, PATH), [], 0, 4 * CHUNK_PATHS
        for b in batches:
            for first, raw in zip(b["first"].to_pylist(), (x.as_buffer() for x in b["run"])):
                if size > most:
                    got = np.concatenate([held, *waiting])
                    below = got["pair"] < np.uint64(first + (1 << 63))  # no later chunk has these
                    held = _summed(got[~below]) if not below.all() else got[:0]
                    waiting, size = [], len(held)
                    most = max(4 * CHUNK_PATHS, 2 * size)
                    if below.any():
                        yield frequent(got[below])
                waiting.append(unpack(raw))
                size += len(waiting[-1])
        rest = np.concatenate([held, *waiting])
        if len(rest):
            yield frequent(rest)
    return run


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, burst: int = BURST,
           limit: int = LIMIT, prefix_bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(``lang``, ``word``, ``id``, ``n``) of every word, and (``w1``, ``w2``, ``w3``, ``n``) of every pair (``w3`` 0) and triple counted ``min_count`` times.

    There are ``2 ** prefix_bits`` prefixes; by default at least two for each of the
    session's shuffle partitions. Chunks are sorted by their first hash alone, as its
    leading bits are the prefix.
    """
    if prefix_bits is None:
        prefix_bits = max(4, (2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    words = docs.mapInArrow(_count_words(limit * 64), "lang string, word string, id long, n long")
    runs = docs.mapInArrow(_count_paths(prefix_bits, burst, limit), "prefix int, first long, run binary")
    merged = runs.repartition("prefix").sortWithinPartitions("first").mapInArrow(_merge(min_count), "w1 long, w2 long, w3 long, n long")
    return cut_lineage(words.groupBy("lang", "word", "id").agg(F.sum("n").alias("n")), "words"), cut_lineage(merged, "paths")


def score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)), exact."""
    return F.expr(f"(CAST({a} AS DECIMAL(15,0)) * CAST({a} AS DECIMAL(15,0)) * CAST(1000000 AS DECIMAL(7,0))) "
                  f"div (CAST({left} AS DECIMAL(15,0)) * CAST({right} AS DECIMAL(15,0)))")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, top: int = TOP,
                 **trie) -> DataFrame:
    """Each language's first ``top`` phrases: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    ``a`` counts the phrase, ``l`` and ``r`` the parts of its lowest-scoring cut, ``n``
    the language's words.
    """
    words, paths = counts(docs, text, lang, min_count, **trie)
    if twice := words.groupBy("id").agg(F.count("*").alias("c")).filter("c > 1").limit(1).collect():
        raise ValueError(f"two words share the hash {twice[0].id}")
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    often = words.filter(F.col("n") >= min_count)
    pairs = paths.filter("w3 = 0").select("w1", "w2", F.col("n").alias("a"))
    triples = paths.filter("w3 <> 0").withColumnRenamed("n", "a")

    def word(k: int) -> DataFrame:
        return often.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"t{k}"), F.col("n").alias(f"f{k}"),
                            *([F.col("lang").alias("lang")] if k == 1 else []))

    inside = triples.select("w1", "w2", "a").union(triples.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    longer = inside.groupBy("w1", "w2").agg(F.max("a").alias("longer"))
    two = (pairs.join(longer, ["w1", "w2"], "left").filter("longer IS NULL OR 100 * longer < 50 * a")
           .join(word(1), "w1").join(word(2), "w2")
           .select("lang", F.concat_ws(" ", "t1", "t2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"),
                   score("a", "f1", "f2").alias("score")))
    head = pairs.withColumnRenamed("a", "f12")
    tail = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23"))
    cut = F.struct(score("a", "f1", "f23").alias("score"), F.lit(1).alias("k"), F.col("f1").alias("l"), F.col("f23").alias("r"))
    cut2 = F.struct(score("a", "f12", "f3").alias("score"), F.lit(2).alias("k"), F.col("f12").alias("l"), F.col("f3").alias("r"))
    three = (triples.join(head, ["w1", "w2"]).join(tail, ["w2", "w3"]).join(word(1), "w1").join(word(2), "w2").join(word(3), "w3")
             .select("lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a", F.least(cut, cut2).alias("c"))
             .select("lang", "phrase", "a", "c.l", "c.r", "c.score"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # a language's first phrases are among the first of its parts, so the last ranking reads PARTS * top rows of a language at most
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    firsts = two.unionByName(three).withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).filter(F.col("rank") <= top)
    ranked = firsts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS s FROM w WHERE len(w) > 0),
g AS (SELECT lang, k, array_to_string(w[s:s+k-1], ' ') AS g, w[s:s+k-1] AS v FROM i, (VALUES (1), (2), (3)) t(k) WHERE s + k - 1 <= len(w)),
f AS (SELECT lang, k, g, any_value(v) AS v, count(*) AS f FROM g GROUP BY lang, k, g),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND f >= 10),
parts AS (SELECT c.*, t.k AS cut, array_to_string(c.v[1:t.k], ' ') AS g1, array_to_string(c.v[t.k+1:c.k], ' ') AS g2
    FROM c JOIN (VALUES (2, 1), (3, 1), (3, 2)) t(size, k) ON t.size = c.k),
cuts AS (SELECT p.lang, p.k, p.g, p.v, p.f AS a, p.cut, x.f AS l, y.f AS r,
        ((1000000::HUGEINT * p.f * p.f) // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM parts p JOIN f x ON x.lang = p.lang AND x.g = p.g1 JOIN f y ON y.lang = p.lang AND y.g = p.g2),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
inside AS (SELECT lang, array_to_string(v[1:2], ' ') AS g, f FROM c WHERE k = 3
    UNION ALL SELECT lang, array_to_string(v[2:3], ' '), f FROM c WHERE k = 3),
longer AS (SELECT lang, g, max(f) AS f FROM inside GROUP BY lang, g),
kept AS (SELECT best.* FROM best LEFT JOIN longer ON best.k = 2 AND longer.lang = best.lang AND longer.g = best.g
    WHERE longer.f IS NULL OR 100 * longer.f < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kept)
SELECT lang, rank, g AS phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
