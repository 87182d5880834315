"""Chat formatting by schema fingerprints.

A record's nested field paths are hashed; the fingerprint selects a declarative
mapping that turns the record (prompt, instruction or message layout) into
canonical turns. Turns are then written with a template whose control strings are
escaped inside roles and texts, with a loss mask over the assistants' texts.

Conversations are dealt out by id, sorted, and run through as a stream: a task holds
one turn at a time, so a conversation of any length needs no memory of its own.

Defined results: a null text or role is empty. Turns go by turn number, then role and
text (nulls first), so repeated rows and ties have one order. Null ids are one
conversation. A record whose fingerprint has no mapping, or that is no JSON, gives one
turn of role ``unmapped`` with the record as its text: nothing is lost. Extra columns
are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from towerfill.llm.common import table

BEGIN, TURN, END = "<s>", "<|turn|>", "<|end|>"
#: Strings that a model's tokenizer may take for control; none of them is left inside an escaped text.
CONTROL = (TURN, END, BEGIN, "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>")
UNMAPPED = "unmapped"


def escape(text: str) -> str:
    text = text.replace("\\", "\\0")
    for c in CONTROL:
        text = text.replace(c, c[0] + "\\1" + c[1:])
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\([012])", lambda m: {"0": "\\", "1": "", "2": "\n"}[m[1]], text)


def field_paths(value, at: str = "") -> set[str]:
    """The paths of all leaves; list items share a path. Marks of a path inside a key are escaped, so keys can't forge one."""
    if isinstance(value, dict) and value:
        return set().union(*(field_paths(v, at + "." + re.sub(r"([\\.\[\]\n])", r"\\\1", k)) for k, v in value.items()))
    if isinstance(value, list) and value:
        return set().union(*(field_paths(v, f"{at}[]") for v in value))
    return {at}


def fingerprint(paths: set[str]) -> str:
    return hashlib.md5("\n".join(sorted(paths)).encode("utf-8", "backslashreplace")).hexdigest()


@dataclass(frozen=True)
class Mapping:
    """Either ``fields`` (key, role) in order, or a list at ``items`` with a role and a text key."""

    fields: tuple[tuple[str, str], ...] = ()
    items: str = ""
    role: str = ""
    text: str = ""
    roles: dict[str, str] = field(default_factory=dict)

    def paths(self) -> set[str]:
        if self.items:
            return {f".{self.items}[].{self.role}", f".{self.items}[].{self.text}"}
        return {f".{k}" for k, _ in self.fields}

    def turns(self, record: dict) -> Iterator[tuple[str, str]]:
        if not self.items:
            for k, role in self.fields:
                yield role, as_text(record[k])
        else:
            for item in record[self.items]:
                role = as_text(item.get(self.role))
                yield self.roles.get(role, role), as_text(item.get(self.text))


def as_text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


SHARE_ROLES = {"human": "user", "gpt": "assistant"}
MAPPINGS = (
    Mapping(items="messages", role="role", text="content"),
    Mapping(items="conversations", role="from", text="value", roles=SHARE_ROLES),
    Mapping(fields=(("prompt", "user"), ("completion", "assistant"))),
    Mapping(fields=(("prompt", "user"), ("response", "assistant"))),
    Mapping(fields=(("instruction", "user"), ("output", "assistant"))),
    Mapping(fields=(("system", "system"), ("instruction", "user"), ("output", "assistant"))),
    Mapping(fields=(("instruction", "system"), ("input", "user"), ("output", "assistant"))),
    Mapping(fields=(("prompt", "user"),)),
    Mapping(fields=(("completion", "assistant"),)),
    Mapping(fields=(("instruction", "user"),)),
    Mapping(fields=(("output", "assistant"),)),
    Mapping(fields=(("system", "system"),)),
)


def registry(mappings=MAPPINGS) -> dict[str, Mapping]:
    return {fingerprint(m.paths()): m for m in mappings}


def select_mapping(paths: set[str], known: dict[str, Mapping]) -> Mapping | None:
    """The mapping of a schema: that of its fingerprint, else the one whose paths are there with only fields beside them that no mapping reads."""
    exact = known.get(fingerprint(paths))
    if exact:
        return exact
    content = {re.match(r"\.[^.\[]*", p)[0] for m in known.values() for p in m.paths()}
    fits = []
    for m in known.values():
        inside = f".{m.items}[]." if m.items else None
        extra = {p for p in paths - m.paths() if not (inside and p.startswith(inside))}
        if m.paths() <= paths and not any(p == c or p.startswith((c + ".", c + "[")) for p in extra for c in content):
            fits.append(m)
    return max(fits, key=lambda m: len(m.paths()), default=None)


def record_turns(body: str | None, known: dict[str, Mapping]) -> tuple[str, list[tuple[str, str]]]:
    """The fingerprint of a JSON record and its canonical turns.

    A record that is no JSON, is nested too deeply, fits no mapping, or whose texts
    can't be written as UTF-8 (lone surrogates) is one ``unmapped`` turn, its body unchanged.
    """
    plain = [(UNMAPPED, body or "")]
    try:
        record = json.loads(body or "")
        paths = field_paths(record)
    except (ValueError, RecursionError):
        return "", plain
    key = fingerprint(paths)
    mapping = select_mapping(paths, known)
    if mapping is None:
        return key, plain
    turns = list(mapping.turns(record))
    try:
        "".join(x for turn in turns for x in turn).encode()
    except UnicodeEncodeError:
        return key, plain
    return key, turns


_TURNS = "conv_id long, seq long, role string, text string, fingerprint string"


def _canonical(known):
    def run(batches):
        last, seq = object(), 0
        for b in batches:
            rows = []
            for conv, body in zip(b["conv_id"].to_pylist(), b["body"].to_pylist()):
                if conv != last:
                    last, seq = conv, 0
                key, turns = record_turns(body, known)
                for role, text in turns:
                    rows.append((conv, seq, role, text, key))
                    seq += 1
            yield _batch(rows, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()], ["conv_id", "seq", "role", "text", "fingerprint"])
    return run


def _batch(rows, types, names) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def canonical_turns(records: DataFrame, conv_id: str = "conv_id", order: tuple[str, ...] = ("part",), body: str = "body",
                    mappings=MAPPINGS) -> DataFrame:
    """``conv_id, seq, role, text, fingerprint`` of all records' turns; each partition has whole conversations, in order."""
    rows = records.repartition(conv_id).sortWithinPartitions(conv_id, *order)
    rows = rows.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(body).alias("body"))
    return rows.mapInArrow(_canonical(registry(mappings)), _TURNS)


def _format(batches):
    last, at = object(), 0
    for b in batches:
        rows = []
        for conv, seq, role, text in zip(*(b[c].to_pylist() for c in ("conv_id", "seq", "role", "text"))):
            if conv != last:
                last, at = conv, 0
            head = (BEGIN if seq == 0 else "") + TURN + escape(role or "").replace("\n", "\\2") + "\n"
            inside = escape(text or "")
            start = at + len(head)
            loss = role == "assistant"
            piece = head + inside + END
            rows.append((conv, seq, piece, at, start if loss else None, start + len(inside) if loss else None))
            at += len(piece)
        yield _batch(rows, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()],
                     ["conv_id", "seq", "formatted", "at", "loss_start", "loss_end"])


def format_chat(turns: DataFrame) -> DataFrame:
    """The formatted text of each turn, its place ``at`` in the conversation's text, and the loss mask's span (code points).

    ``turns`` has to come in whole ordered conversations, as from ``canonical_turns``.
    """
    return turns.mapInArrow(_format, "conv_id long, seq long, formatted string, at long, loss_start long, loss_end long")


def read_turn(piece: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    head, _, rest = piece.removeprefix(BEGIN).partition("\n")
    if not head.startswith(TURN) or not rest.endswith(END) or TURN in rest or END in rest[:-len(END)]:
        raise ValueError("not a formatted turn")
    return unescape(head.removeprefix(TURN)), unescape(rest.removesuffix(END))


class Digest:
    """What is read back of one conversation, piece by piece."""

    def __init__(self, conv):
        self.conv, self.turns, self.chars, self.loss_chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, at: int, start: int | None, end: int | None) -> None:
        role, text = read_turn(piece)
        self.turns += 1
        self.chars += len(piece)
        self.all.update(f"{role}\n{text}\n".encode())
        if start is not None:
            masked = unescape(piece[start - at:end - at])
            self.loss_chars += len(masked)
            self.loss.update(masked.encode())

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _read_back(batches):
    def out(rows):
        return _batch(rows, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()],
                      ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
    now = None
    for b in batches:
        rows = []
        for conv, piece, at, start, end in zip(*(b[c].to_pylist() for c in ("conv_id", "formatted", "at", "loss_start", "loss_end"))):
            if now is None or conv != now.conv:
                if now:
                    rows.append(now.row())
                now = Digest(conv)
            now.add(piece, at, start, end)
        yield out(rows)
    if now:
        yield out([now.row()])


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation what its formatted text says: turns, digests of all turns and of the text under the loss mask."""
    return formatted.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def as_records(conversations: DataFrame) -> DataFrame:
    """Stand-in input: every row of ``conversations`` as a JSON record, in one of four layouts by conversation."""
    text, role = F.coalesce("text", F.lit("")), F.col("role")

    def rec(*pairs):
        return F.to_json(F.struct(*[v.alias(k) for k, v in pairs]), {"ignoreNullFields": "false"})

    kind = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    plain = rec(("messages", F.array(F.struct(role.alias("role"), text.alias("content")))))
    speaker = F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    share = rec(("conversations", F.array(F.struct(speaker.alias("from"), text.alias("value")))))
    single = {2: {"user": "instruction", "assistant": "output", "system": "system"}, 3: {"user": "prompt", "assistant": "completion"}}
    body = F.when((kind == 1) & role.isin("user", "assistant", "system"), share)
    for k, names in single.items():
        for r, name in names.items():
            body = body.when((kind == k) & (role == r), rec((name, text)))
    return conversations.select("conv_id", "turn", "role", "text", body.otherwise(plain).alias("body"))


def query(spark, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_chat(canonical_turns(as_records(rows), order=("turn", "role", "text"))))


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '\', '\0'),
        '<|turn|>', '<\1|turn|>'), '<|end|>', '<\1|end|>'), '<s>', '<\1s>'), '</s>', '<\1/s>'), '[INST]', '[\1INST]'), '[/INST]', '[\1/INST]'),
        '<<SYS>>', '<\1<SYS>>'), '<</SYS>>', '<\1</SYS>>'), '<|im_start|>', '<\1|im_start|>'), '<|im_end|>', '<\1|im_end|>') AS t FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(8 + length(role) + 1 + length(t) + 7))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
