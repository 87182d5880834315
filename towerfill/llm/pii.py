"""Personal data by fixed patterns and a linear-chain conditional random field.

The patterns give the base spans. The field adds spans that the patterns miss
(numbers without a plus sign, spelled-out mail addresses): it is trained by maximum
likelihood on a small labelled table, over word-shape features, and decoded by
Viterbi in numpy batches. It labels every word near a digit or an at sign, or near a
joint ("dot", "at") of an address there; words further off are outside by rule. A decoded span that touches a match of a pattern,
kept or dropped, adds nothing: there the pattern has decided.

Defined results: null text is empty and has no spans. Repeated rows each get a row.
Columns other than the id and the text are not read. An empty table gives no rows.
A word that holds no digit is never added as a number, and an added address has the
form of one: an at sign or "at", and after it a dot or "dot".
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from towerfill.llm.common import table

#: Fixed by the contract: the kinds in order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
NEEDS = {"email": re.compile("@"), "ip": re.compile(r"[0-9]\.[0-9]"), "card": re.compile("[0-9]"), "phone": re.compile(r"\+[0-9]")}

#: A small labelled table: [kind|text] marks a span.
EXAMPLES = (
    "call me at [phone|555-123-4567] after lunch", "my phone is [phone|(555) 987-6543] at home",
    "phone: [phone|020 7946 0958] or mail us", "tel [phone|0171 555 2340] fax [phone|0171 555 2341]",
    "reach us under [phone|030-5550-1234] today", "ring [phone|555.234.9876] for details",
    "Tel. [phone|06 12 34 56 78] svp", "mobile [phone|(0176) 555-4821] only", "dial [phone|1-800-555-0199] now",
    "write to [email|anna at example dot com] please", "mail [email|j.smith at mail dot example dot org] for it",
    "e-mail [email|info (at) shop.example.com] or visit", "contact [email|bob[at]example.net] soon",
    "card number [card|4111 1111 1111 1111] exp 04/27", "visa [card|4000-0000-0000-0002] was charged",
    "paid with [card|5500000000000004] online", "server [ip|192.168.0.12] is down", "from [ip|10.0.0.254] to [ip|10.0.0.1] only",
    "mail [email|anna@example.com] or call [phone|+1 (555) 123-4567] now", "account [email|kim.lee@mail.example.org] is locked",
    "version 2.0 of the license", "Licensed under the Apache License, Version 2.0.", "released under CC BY-NC 4.0.",
    "GNU General Public License, version 3.", "in 1998 and 2004 there were 12 of them", "on 2024-03-15 at 10:45 we met",
    "it costs 19.99 or 1,250.00 in total", "chapter 3, page 127, line 4", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" here',
    "order 48213 shipped on 12/05/2021", "the score was 21-17 at half time", "room 204 on floor 2", "about 3.5 percent of 1200",
    "isbn 978-3-16-148410-0 in print", "see section 4.2.1 for more", "sha 9f86d081884c7d65 of the file", "meet at noon at the dot in the middle",
    "follow @example for news", "ratio 16:9 and 4k at 60 hz", "build 10.2.455 is out", "ids 1000234 and 1000235 match",
    "reach [email|kim(at)example(dot)org] by noon", "mail [email|John dot Smith at example dot com] first", "ask [email|Mary.Jones[at]mail.example.com] about it",
    "send it to [email|lee at example dot co dot uk] or come by", "his address is [email|o.brien (at) example (dot) net] he says",
    "under [email|pat[at]example.org] all day", "mine is [email|jo.doe(at)mail(dot)net] as before", "it is [email|pat(at)example.com] as always",
    "at [email|max_w at my-firm dot org] as ever", "mail or [email|sam7(at)my-firm(dot)co(dot)uk] all year", "note: [email|t.beck[at]example.com]",
    "or call [phone|0049 30 5550 1234] instead", "my number is [phone|07700 900 123] at work", "he left at noon. At the station we met",
    "she smiled.\nAt home they waited for two hours", "look at that dot at the end", "we met at Example street at 9 or at 10", "at 12 people arrived at once",
    "a table | 12 | 14 | 15 | of values", "from 1990-1999 the rate fell 0.75", "key = \"a81bc81b-dead-4e5d-abff-90865d1e13b1\" set",
)
SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: What the field looks near: digits, at signs and spelled-out ones.
AT = r"(?:[(\[]|(?<=[\x20\x09-\x0D]))[Aa][Tt](?=[)\]\x20\x09-\x0D])"
TRIGGER = re.compile(f"[0-9@]+|{AT}")
SPELLED_AT = re.compile(f"@|{AT}")
#: A word that holds a spelled-out address together.
JOINT = re.compile(r"[(\[]?(?:at|dot)[)\]]?", re.I)
_INSIDE = (("+at", re.compile(r"[(\[]at[)\]]", re.I)), ("+dot", re.compile(r"[(\[]dot[)\]]", re.I)), (".x", re.compile(r"[A-Za-z]\.[A-Za-z]{2}")))
#: Words on each side of a word with a digit or an at sign, or of a joint, that the field sees.
REACH = 3
#: Digits of a number by kind, and the words it has at most.
NUMBERS = {"card": (16, 19), "phone": (8, 15)}
NUMBER_WORDS = 6
#: Words (padding included) that are decoded together; a longer run is decoded alone.
CELLS = 1 << 14
#: At most this many rows of a labelled table are trained on.
MAX_LABELLED = 2000


def digits(s: str) -> int:
    return sum(c in "0123456789" for c in s)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def valid(kind: str, match: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in match.split("."))
    if kind == "card":
        digits = re.sub("[^0-9]", "", match)
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(re.sub("[^0-9]", "", match)) <= 15


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(kind's place, start, end) of the valid matches, and (start, end) of the dropped ones."""
    kept, dropped = [], []
    for k, kind in enumerate(KINDS):
        if NEEDS[kind].search(text):
            for m in PATTERNS[kind].finditer(text):
                if valid(kind, m.group()):
                    kept.append((k, m.start(), m.end()))
                elif kind != "card" or 16 <= digits(m.group()) <= 19:
                    dropped.append(m.span())
    return kept, dropped


def shape(word: str) -> str:
    """Digits as 9, letters as a or A, the rest itself; runs over three are cut to three."""
    s = "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in word)
    return re.sub(r"(.)\1{3,}", r"\1\1\1", s)


def joint(word: str) -> str:
    """What a word has of an address: "at" or "dot" by itself, either in brackets inside, or a plain domain."""
    if JOINT.fullmatch(word):
        return word.strip("()[]").lower()
    return "".join(name for name, pattern in _INSIDE if pattern.search(word))


def features(words: list[str]) -> Iterator[list[str]]:
    """Feature names of each word: shapes of it and its neighbours, size, marks, and short words themselves."""
    shapes = ["<s>", *map(shape, words), "</s>"]
    low = ["<s>", *(w.lower().strip(".,:;!?") for w in words), "</s>"]
    marks = ["", "", *map(joint, words), "", "", ""]
    for i, w in enumerate(words, 1):
        n = sum(c.isdigit() for c in w)
        f = [f"s={shapes[i]}", f"p={shapes[i - 1]}", f"n={shapes[i + 1]}", f"b={shapes[i - 1]}~{shapes[i]}", f"a={shapes[i]}~{shapes[i + 1]}",
             f"d={min(n, 12)}", f"l={low[i - 1]}", f"r={low[i + 1]}", f"e={w[-1:]}" if not w[-1:].isalnum() else "e=w", f"f={w[0]}" if not w[0].isalnum() else "f=w"]
        if not n and len(w) <= 8:
            f.append(f"w={low[i]}")
        if any(near := marks[i - 1:i + 4]):  # joints of an address, two words to each side
            f += [f"j={marks[i + 1]}", f"k={marks[i]}~{marks[i + 1]}~{marks[i + 2]}", f"q={'~'.join(near)}"]
        yield f


LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))


@dataclass
class Field:
    """A trained field: the features' numbers, their weights by label, and the transition weights."""

    index: dict[str, int]
    emit: np.ndarray
    move: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(LABELS)))
        for i, names in enumerate(features(words)):
            at = [self.index[x] for x in names if x in self.index]
            out[i] = self.emit[at].sum(axis=0)
        return out

    def decode(self, parts: list[list[str]]) -> list[np.ndarray]:
        """Viterbi labels of each part; parts of like length go through numpy together, ``CELLS`` words with their padding at most."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(parts)
        order = sorted(range(len(parts)), key=lambda i: len(parts[i]))
        i = 0
        while i < len(order):
            j = i + 1
            while j < len(order) and (j + 1 - i) * len(parts[order[j]]) <= CELLS:
                j += 1
            some, i = order[i:j], j
            n = np.array([len(parts[k]) for k in some])
            score = np.zeros((len(some), n.max(), len(LABELS)))
            for r, k in enumerate(some):
                score[r, :n[r]] = self.scores(parts[k])
            best, back = score[:, 0] + self.move[-1], np.zeros(score.shape, np.int8)
            for t in range(1, n.max()):
                step = best[:, :, None] + self.move[None, :-1]
                back[:, t] = step.argmax(axis=1)
                new = step.max(axis=1) + score[:, t]
                best = np.where((t < n)[:, None], new, best)
            label = best.argmax(axis=1)
            path = np.zeros((len(some), n.max()), np.int64)
            for t in range(n.max() - 1, -1, -1):
                path[:, t] = np.where(t < n, label, 0)
                label = np.where((t < n) & (t > 0), back[np.arange(len(some)), t, label], label)
            for r, k in enumerate(some):
                out[k] = path[r, :n[r]]
        return out


def allowed() -> np.ndarray:
    """0 where a label may follow another (the last row: the start), else a large negative weight."""
    m = np.zeros((len(LABELS) + 1, len(LABELS)))
    for j, b in enumerate(LABELS):
        if b[0] == "I":
            for i in range(len(LABELS) + 1):
                if i == len(LABELS) or LABELS[i][2:] != b[2:]:
                    m[i, j] = -1e4
    return m


def parse_example(row: str) -> tuple[list[str], np.ndarray]:
    """Words and label numbers of a marked text."""
    words, labels = [], []
    for m in re.finditer(r"\[(email|ip|card|phone)\|((?:[^\]\[]|\[at\])*)\]|([^\x20\x09-\x0D\[]+)", row):
        inside = (m[2] or m[3]).split()
        words += inside
        labels += [0] * len(inside) if m[3] else [1 + 2 * KINDS.index(m[1])] + [2 + 2 * KINDS.index(m[1])] * (len(inside) - 1)
    return words, np.array(labels)


def train(rows: list[tuple[list[str], np.ndarray]], rounds: int = 150, rate: float = 0.3, decay: float = 1e-3) -> Field:
    """Maximum likelihood with an L2 penalty by adaptive gradient steps; the same rows give the same field."""
    names = sorted({x for words, _ in rows for f in features(words) for x in f})
    index = {x: i for i, x in enumerate(names)}
    at = [[np.array([index[x] for x in f]) for f in features(words)] for words, _ in rows]
    forbidden, n = allowed(), len(LABELS)
    emit, move = np.zeros((len(names), n)), np.zeros((n + 1, n))
    seen_e, seen_m = np.full(emit.shape, 1e-8), np.full(move.shape, 1e-8)

    def log_sum(x, axis):
        m = x.max(axis=axis, keepdims=True)
        return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)

    for _ in range(rounds):
        grad_e, grad_m = -decay * emit, -decay * move
        weights = move + forbidden
        for (_, y), feats in zip(rows, at):
            s = np.array([emit[f].sum(axis=0) for f in feats])
            t_max = len(y)
            fwd, bwd = np.empty((t_max, n)), np.zeros((t_max, n))
            fwd[0] = s[0] + weights[-1]
            for t in range(1, t_max):
                fwd[t] = s[t] + log_sum(fwd[t - 1][:, None] + weights[:-1], 0)
            for t in range(t_max - 2, -1, -1):
                bwd[t] = log_sum(weights[:-1] + (s[t + 1] + bwd[t + 1])[None, :], 1)
            z = log_sum(fwd[-1], 0)
            p = np.exp(fwd + bwd - z)
            for t in range(t_max):
                g = -p[t]
                g[y[t]] += 1
                grad_e[feats[t]] += g
            grad_m[-1] -= p[0]
            grad_m[-1, y[0]] += 1
            for t in range(1, t_max):
                grad_m[:-1] -= np.exp(fwd[t - 1][:, None] + weights[:-1] + (s[t] + bwd[t])[None, :] - z)
                grad_m[y[t - 1], y[t]] += 1
        seen_e += grad_e ** 2
        seen_m += grad_m ** 2
        emit += rate * grad_e / np.sqrt(seen_e)
        move += rate * grad_m / np.sqrt(seen_m)
    return Field(index, emit, move + forbidden)


def near_words(text: str) -> list[list[tuple[int, int]]]:
    """Runs of words (start, end), each within REACH words of one with a digit or an at sign (also a spelled-out one), or of a joint in such a run."""
    runs: list[list[tuple[int, int]]] = []
    done = -1
    for m in TRIGGER.finditer(text):
        if m.start() < done:
            continue
        start, left = m.start(), REACH
        while left >= 0 and start > max(done, 0):  # back to the start of the word, then REACH words more
            end = start
            while start > 0 and text[start - 1] in SPACE:
                start -= 1
            last = start
            while start > 0 and text[start - 1] not in SPACE:
                start -= 1
            left = REACH if end > last and JOINT.fullmatch(text, start, last) else left - 1
        more = bool(runs) and start <= done
        words, left, at = [], REACH, max(start, done, 0)
        while left >= 0 and (w := WORD.search(text, at)):
            words.append(w.span())
            at = w.end()
            if w.end() > m.start():
                left = REACH if re.search("[0-9@]", w.group()) or JOINT.fullmatch(w.group()) else left - 1
        done = at
        if more:
            runs[-1] += words
        elif words:
            runs.append(words)
    return runs


def trim(text: str, start: int, end: int) -> tuple[int, int]:
    """A span of words without quotes and closing marks around it."""
    while end > start and not (text[end - 1].isalnum() or text[end - 1] == ")"):
        end -= 1
    while start < end and not (text[start].isalnum() or text[start] in "(+"):
        start += 1
    return start, end


def added_spans(texts: list[str], found: list[tuple[list, list]], model: Field) -> list[list[tuple[int, int, int]]]:
    """The field's spans for each text that touch no match of a pattern."""
    runs = [(i, run) for i, text in enumerate(texts) for run in near_words(text)]
    labels = model.decode([[texts[i][s:e] for s, e in run] for i, run in runs])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (i, run), path in zip(runs, labels):
        kept, dropped = found[i]
        taken = [(s, e) for _, s, e in kept] + dropped
        t = 0
        while t < len(path):
            if path[t] == 0:
                t += 1
                continue
            k, first = (int(path[t]) - 1) // 2, t
            t += 1
            while t < len(path) and path[t] == 2 + 2 * k:
                t += 1
            for a, b in numbers(KINDS[k], [texts[i][s:e] for s, e in run[first:t]]):
                s, e = trim(texts[i], run[first + a][0], run[first + b - 1][1])
                if s < e and not any(s < y and x < e for x, y in taken) and plausible(KINDS[k], texts[i][s:e]):
                    out[i].append((k, s, e))
    return out


def numbers(kind: str, words: list[str]) -> list[tuple[int, int]]:
    """Ranges of words, one for each number: more digits than one has are cut into the fewest and most even numbers of the kind."""
    least, most = NUMBERS.get(kind, (0, 0))
    n = [digits(w) for w in words]
    if not most or sum(n) <= most:
        return [(0, len(words))]
    best: list[tuple[int, int, int] | None] = [(0, 0, 0)]  # numbers, squares of their digits, start of the last
    for j in range(1, len(n) + 1):
        some = [(best[i][0] + 1, best[i][1] + sum(n[i:j]) ** 2, i) for i in range(max(0, j - NUMBER_WORDS), j)
                if best[i] is not None and least <= sum(n[i:j]) <= most]
        best.append(min(some, default=None))
    out, j = [], len(n)
    while j and best[j] is not None:
        out.append((best[j][2], j))
        j = best[j][2]
    return out[::-1] or [(0, len(words))]


_PART = r"[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*"
_DOT = r"(?:\s*[(\[]\s*dot\s*[)\]]\s*|\s+dot\s+)"
#: A spelled-out address: parts and joints, an at sign of some kind, and after it a dot or "dot". No sentence ends inside.
ADDRESS = re.compile(rf"{_PART}(?:{_DOT}{_PART})*(?:\s*@\s*|\s*[(\[]\s*at\s*[)\]]\s*|\s+at\s+)(?=\S*[^\s.]\.\S|\S+?{_DOT}){_PART}(?:{_DOT}{_PART})*", re.I)


def plausible(kind: str, span: str) -> bool:
    if kind == "email":
        return ADDRESS.fullmatch(span) is not None
    n = digits(span)
    least, most = NUMBERS.get(kind, (4, 12))
    return least <= n <= most and len(span.split()) <= NUMBER_WORDS


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def _find(model: Field):
    def run(batches):
        for b in batches:
            texts = [t or "" for t in b["text"].to_pylist()]
            found = [base_spans(t) for t in texts]
            added = added_spans(texts, found, model)
            counts = [[sum(k == j for j, _, _ in kept) for kept, _ in found] for k in range(len(KINDS))]
            sha = [hashlib.sha256(joined(kept).encode()).hexdigest() for kept, _ in found]
            every = [joined(set(kept) | set(more)) for (kept, _), more in zip(found, added)]
            names = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(b[n] for n in names), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(every, pa.string())],
                [*names, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])
    return run


def labelled_rows(labelled: DataFrame | None, max_rows: int = MAX_LABELLED) -> list[tuple[list[str], np.ndarray]]:
    """Words and labels of at most ``max_rows`` rows of a table with a marked ``text`` (see EXAMPLES); without one, of EXAMPLES."""
    texts = EXAMPLES if labelled is None else [r[0] for r in labelled.select("text").orderBy("text").limit(max_rows).collect()]
    return [r for r in map(parse_example, texts) if r[0]]


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """Per document: its id, the base counts by kind, ``base_sha256``, and ``spans`` with the field's spans added."""
    model = train(labelled_rows(labelled))
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(
        _find(model), f"id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    ).withColumnRenamed("id", doc_id)


def _mask(model: Field):
    def run(batches):
        for b in batches:
            texts = b["text"].to_pylist()
            clear = [t or "" for t in texts]
            found = [base_spans(t) for t in clear]
            added = added_spans(clear, found, model)
            out = []
            for raw, text, (kept, _), more in zip(texts, clear, found, added):
                parts, at = [], 0
                for k, s, e in sorted(set(kept) | set(more), key=lambda x: (x[1], -x[2])):
                    if s >= at:
                        parts += [text[at:s], f"<{KINDS[k].upper()}>"]
                    at = max(at, e)  # of overlapping spans one mark stays, and nothing of either
                out.append("".join([*parts, text[at:]]) if parts else raw)
            at = b.schema.get_field_index("text")
            yield b.set_column(at, b.schema.field(at), pa.array(out, b.schema.field(at).type))
    return run


def mask_pii(docs: DataFrame, text: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` with its columns, each span in the text replaced by its kind."""
    renamed = docs.withColumnsRenamed({text: "text"}) if text != "text" else docs
    return renamed.mapInArrow(_mask(train(labelled_rows(labelled))), renamed.schema).toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
