"""Record-numbered scans: ZIP members and files with metadata lines.

A ZIP's central directory lists its members, so tasks first list the members of the
archives and then read them, each member a task of its own: it is opened through a
seekable stream and only its own bytes are read, whatever the archive's size. Other
files go through :mod:`towerfill.sources.records`, which splits them anywhere. The
records are written once to the shared folder, so an archive is opened once; header
detection, the metadata-line skip and CSV parsing (``from_csv``) then run as Spark
expressions. (A deflated member can't be split, so one member is one task.)
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from towerfill.session import cut_lineage
from towerfill.sources.records import stream_records, text_records
from towerfill.sources.text import header_names, infer_types, n_fields, null_tokens

RECORDS = "source string, member string, line_no long, line string, unclosed boolean"
BATCH = 50_000
#: Written records of one file: a member is read by one task, its records by many.
ROWS_PER_FILE = 100_000
#: Schemes of Spark's file systems that pyarrow knows by another name.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfs"}


def _is_table(name: str) -> bool:
    return name.endswith(".csv") or name.endswith(".txt")


def open_seekable(uri: str):
    """A seekable stream of a file that Spark named; local paths and what ``pyarrow.fs`` reads."""
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    if scheme == "file" or not rest:
        return open("/" + rest.lstrip("/") if rest else uri, "rb")
    files, path = fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")
    return files.open_input_file(path)


def _list_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path in pdf["path"]:
            with open_seekable(path) as raw, zipfile.ZipFile(raw) as z:
                found = [(path, i.filename, i.file_size) for i in z.infolist() if _is_table(i.filename)]
            yield pd.DataFrame(found, columns=["path", "member", "bytes"])


def zip_members(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(``path``, ``member``, ``bytes``) of every .csv and .txt member, from the archives' directories."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (read.option("pathGlobFilter", glob) if glob else read).load(path).select("path")  # names only: no content is read
    zips = files.filter(F.lower(F.col("path")).endswith(".zip"))
    return zips.mapInPandas(_list_members, "path string, member string, bytes long")


def _read_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, name in zip(pdf["path"], pdf["member"]):
            with open_seekable(path) as raw, zipfile.ZipFile(raw) as z, z.open(name) as member:
                held, n = [], 0
                for record in stream_records(io.TextIOWrapper(member, encoding="utf-8", newline=None)):
                    held.append(record)
                    if len(held) == BATCH:
                        yield _frame(path, name, n, held)
                        held, n = [], n + BATCH
                if held:
                    yield _frame(path, name, n, held)


def _frame(path: str, name: str, n: int, held: list[tuple[str, bool]]) -> pd.DataFrame:
    return pd.DataFrame({"source": path, "member": name, "line_no": range(n + 1, n + len(held) + 1),
                         "line": [r[0] for r in held], "unclosed": [r[1] for r in held]})


def zip_records(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """The records of every member; there are as many partitions as members, in equal ranges of their names."""
    members = cut_lineage(zip_members(spark, path, glob), "members")
    members = members.repartitionByRange(max(1, members.count()), "path", "member")
    return members.select("path", "member").mapInPandas(_read_members, RECORDS)


def read_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One row per record of every file (and every .csv/.txt member of every ``.zip``); written once.

    ``line_no`` is the record's number in its file or member, from 1.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (read.option("pathGlobFilter", glob) if glob else read).load(path).select("path")
    zips = F.lower(F.col("path")).endswith(".zip")
    kinds = files.agg(F.max(zips).alias("zip"), F.max(~zips).alias("plain")).first()
    parts = []
    if kinds.zip:
        parts.append(zip_records(spark, path, glob))
    if kinds.plain:
        parts.append(text_records(spark, path, glob))
    if not parts:
        raise ValueError(f"no file found under {path}")
    return cut_lineage(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), "records", ROWS_PER_FILE)


def read_table(spark: SparkSession, path: str, member: str | None = None, skip_rows: int | str = "auto",
               glob: str | None = None, infer: bool = True) -> DataFrame:
    """S2 + S3: parse CSV members/files after ``skip_rows`` metadata lines.

    ``skip_rows="auto"`` skips 2 records in a file in which any row has more fields than
    the first line, or whose last quote never closes, as the reference does when its
    parser fails. A row that has more fields than the header after that, or a quote that
    never closes, raises. All selected files must share one header; ``member`` picks
    one archive member. Blank lines are no rows.
    """
    lines = read_lines(spark, path, glob)
    if member is not None:
        lines = lines.filter(F.col("member") == member)
    lines = lines.filter((F.length(F.trim("line")) > 0) | F.col("unclosed"))
    keys = ["source", "member"]
    # One pass: a row per file with the header after either skip. It is written, so its real (small) size is known and
    # the records are not shuffled by their file, which would put a whole file in one task.
    n = n_fields(F.col("line"))
    after = [0, 2] if skip_rows == "auto" else [int(skip_rows)]
    heads = [F.min(F.when(F.col("line_no") > k, F.struct("line_no", "line", n.alias("n")))).alias(f"h{k}") for k in after]
    probe = lines.groupBy(*keys).agg(*heads, F.max(n).alias("most"), F.max("unclosed").alias("open"))
    head = F.col(f"h{after[0]}")
    if skip_rows == "auto":
        head = F.when(F.col("open") | (F.col("most") > F.col("h0.n")), F.col("h2")).otherwise(F.col("h0"))
    first = probe.select(*keys, head.alias("h"), "most", "open").filter("h IS NOT NULL")
    first = cut_lineage(first.select(*keys, F.col("h.line_no").alias("_head"), F.col("h.line").alias("header"), "most", "open"), "headers")
    names = None
    for r in first.select("header").distinct().toLocalIterator():  # one name may be written with and without quotes
        if names not in (None, header_names(r.header)):
            raise ValueError("selected files have different headers; pick one member")
        names = header_names(r.header)
    if names is None:
        raise ValueError(f"no table found under {path}")
    ddl = ", ".join(f"`{n}` STRING" for n in names)
    data = lines.join(first.select(*keys, "_head"), keys).filter(F.col("line_no") > F.col("_head"))
    bad = []
    if first.filter(F.col("open") | (F.col("most") > len(names))).limit(1).count():  # else no row can be
        bad = data.filter(F.col("unclosed") | (n_fields(F.col("line")) > len(names))).limit(1).collect()
    if bad and bad[0].unclosed:
        raise ValueError(f"a quote never closes: {bad[0].line[:200]!r}")
    if bad:
        raise ValueError(f"a row has more fields than the header: {bad[0].line!r}")
    parsed = data.select(F.from_csv(F.col("line"), ddl, {"nullValue": "", "escape": '"'}).alias("r")).select("r.*")
    parsed = null_tokens(parsed)
    return infer_types(cut_lineage(parsed, "parsed", ROWS_PER_FILE)) if infer else parsed  # inference reads columns, not lines again
