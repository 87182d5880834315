"""Small tables and brute-force versions for the operators' tests."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n string, w string, label string, key string, shard string"


def words(rng: random.Random, n: int) -> list[str]:
    return [rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("aeiou") + rng.choice("lmnrst") + rng.choice(["", "a", "o"]) for _ in range(n)]


def documents(seed: int = 1) -> list[tuple]:
    """Unique texts, copies, near copies, shared passages, blank and null texts, short and long ones, and a repeated row."""
    rng = random.Random(seed)
    texts: list[str | None] = [" ".join(words(rng, rng.randint(1, 150))) for _ in range(25)]
    base = words(rng, 120)
    for edits in (0, 0, 1, 2, 3, 6, 10):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(len(w))] = "edit"
        texts.append(" ".join(w))
    passage = words(rng, 70)
    for _ in range(5):
        texts.append(" ".join(words(rng, 40) + passage + words(rng, 30)))
    texts += [None, "", " \n\t ", "one", "Two words", "two WORDS", "É é a b", "x " * 300, "line\nline\n\nline\n", " ".join(words(rng, 30_000))]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, 0, "n", "w", "l", "k", "s") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return [*rows, rows[3], rows[5]]


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema).repartition(3)
