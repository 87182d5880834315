"""Records of quoted text whose files are split anywhere: a prefix scan over the splits' quote states.

Between two lines a reader is either outside or inside a quoted value. A quote opens a
value only at a field's start; elsewhere in a plain field it is a character like
any other. So a line, and a split of lines, is a function of one bit, and it is one of four:
keep, swap, end outside, end inside.

1. Spark's splittable text source gives the lines. A task goes once over each split and
   notes, for both possible beginnings, the record that each line belongs to (counted
   from the split's start) and where the split ends. The lines are written once.
2. A window over the splits of a file (a row each) composes the functions: the state
   before a split is that of the last split that ended for certain, turned by the
   parity of the swaps since. The same window counts the records before each split.
3. A line that is a record by itself passes as it is. The other lines, wherever the
   splits cut them, are put together by file and record number.

The result is ``(source, member, line_no, line, unclosed)``; ``line_no`` is the record's
exact number in its file, from 1. A line break inside quotes is ``\\n``. ``unclosed``
marks the record at a file's end whose quote never closes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from towerfill.session import cut_lineage


def ends_inside(line: str, inside: bool, sep: str = ",") -> bool:
    """Whether the reader is inside a quoted value after ``line``, if it was ``inside`` before."""
    at = 0
    while True:
        if inside:
            quote = line.find('"', at)
            if quote < 0:
                return True
            at = quote + 1
            if line[at:at + 1] == '"':  # a doubled quote is a character of the value
                at += 1
                continue
            inside = False
        elif line[at:at + 1] == '"':
            inside = True
            at += 1
            continue
        at = line.find(sep, at) + 1
        if not at:
            return False


class _Scan:
    """One beginning's view of a split: the state, and the number of the last record begun (-1: before the split)."""

    def __init__(self, inside: bool):
        self.inside, self.record = inside, -1

    def plain(self, n: int) -> tuple[np.ndarray, bool]:
        """Records of ``n`` lines without quotes, and whether each is a record by itself."""
        if self.inside:
            return np.full(n, self.record), False
        first = self.record + 1
        self.record += n
        return np.arange(first, first + n), True

    def quoted(self, line: str, sep: str) -> tuple[int, bool]:
        before, self.inside = self.inside, ends_inside(line, self.inside, sep)
        if not before:
            self.record += 1
        return self.record, not before and not self.inside


def _annotate(sep: str):
    """Tasks: the lines with, for a beginning outside (0) and inside (1): the record, whether it is one line, and the state after."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, scans = None, (_Scan(False), _Scan(True))
        for b in batches:
            source, at = b["source"], b["at"].to_numpy()
            quotes = np.flatnonzero(pc.match_substring(b["line"], '"').to_numpy(zero_copy_only=False))
            new = np.flatnonzero(at[1:] != at[:-1]) + 1
            code = source.dictionary_encode().indices.to_numpy()
            new = np.union1d(new, np.flatnonzero(code[1:] != code[:-1]) + 1).astype(int)
            record = np.empty((2, b.num_rows), np.int64)
            alone, after = np.empty((2, b.num_rows), bool), np.empty((2, b.num_rows), bool)
            for i, j in zip([0, *new], [*new, b.num_rows]):
                if i == j:
                    continue
                split = (source[int(i)].as_py(), int(at[i]))
                if split != now:
                    now, scans = split, (_Scan(False), _Scan(True))
                k = i
                for q in [*quotes[(quotes >= i) & (quotes < j)].tolist(), j]:
                    for h, s in enumerate(scans):
                        if q > k:
                            record[h, k:q], alone[h, k:q] = s.plain(q - k)
                            after[h, k:q] = s.inside
                        if q < j:
                            record[h, q], alone[h, q] = s.quoted(b["line"][q].as_py(), sep)
                            after[h, q] = s.inside
                    k = q + 1
            yield pa.RecordBatch.from_arrays(
                [source, b["at"], b["n"], b["line"], *(pa.array(x) for h in (0, 1) for x in (record[h], alone[h], after[h]))],
                ["source", "at", "n", "line", "record0", "alone0", "after0", "record1", "alone1", "after1"])
    return run


ANNOTATED = ("source string, at long, n long, line string, record0 long, alone0 boolean, after0 boolean, "
             "record1 long, alone1 boolean, after1 boolean")


def split_states(lines: DataFrame) -> DataFrame:
    """Per split: whether it begins ``inside`` quotes, the records ``before`` it, and whether its file ``ends`` inside."""
    splits = lines.groupBy("source", "at").agg(
        F.max_by("after0", "n").alias("f0"), F.max_by("after1", "n").alias("f1"),
        (F.max("record0") + 1).alias("c0"), (F.max("record1") + 1).alias("c1"))
    in_file = Window.partitionBy("source").orderBy("at")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.coalesce(F.sum((F.col("f0") & ~F.col("f1")).cast("int")).over(in_file), F.lit(0)) % 2
    certain = F.when(F.col("f0") == F.col("f1"), F.col("f0").cast("int").bitwiseXOR(F.col("swaps").cast("int")))
    known = F.coalesce(F.last("certain", ignorenulls=True).over(before), F.lit(0))
    turned = F.coalesce(F.lag("swaps").over(in_file), F.lit(0)).cast("int")
    splits = (splits.withColumn("swaps", swaps).withColumn("certain", certain)
              .withColumn("inside", known.bitwiseXOR(turned) == 1)
              .withColumn("count", F.when(F.col("inside"), F.col("c1")).otherwise(F.col("c0")))
              .withColumn("end", F.when(F.col("inside"), F.col("f1")).otherwise(F.col("f0"))))
    whole = in_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return splits.select(F.col("source").alias("s_source"), F.col("at").alias("s_at"), "inside",
                         F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"),
                         F.last("end").over(whole).alias("ends"), F.sum("count").over(whole).alias("records"))


def text_records(spark: SparkSession, path: str, glob: str | None = None, sep: str = ",", skip: str | None = ".zip",
                 recursive: bool = True) -> DataFrame:
    """The records of the text files under ``path`` (not of those whose name ends in ``skip``)."""
    read = spark.read.format("text").option("recursiveFileLookup", recursive)
    raw = (read.option("pathGlobFilter", glob) if glob else read).load(path)
    raw = raw.select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("at"),
                     F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))
    if skip:
        raw = raw.filter(~F.lower(F.col("source")).endswith(skip))
    lines = cut_lineage(raw.mapInArrow(_annotate(sep), ANNOTATED), "lines")
    states = split_states(lines)
    own = F.when(F.col("inside"), F.col("record1")).otherwise(F.col("record0"))
    met = lines.join(states, (F.col("source") == F.col("s_source")) & (F.col("at") == F.col("s_at"))).select(
        "source", "at", "n", "line", (F.col("before") + own + 1).alias("line_no"),
        F.when(F.col("inside"), F.col("alone1")).otherwise(F.col("alone0")).alias("alone"),
        (F.col("ends") & (F.col("before") + own + 1 == F.col("records"))).alias("unclosed"))
    one = met.filter("alone").select("source", F.lit("").alias("member"), "line_no", "line", F.lit(False).alias("unclosed"))
    parts = met.filter("NOT alone").groupBy("source", "line_no").agg(
        F.sort_array(F.collect_list(F.struct("at", "n", "line"))).alias("p"), F.max("unclosed").alias("unclosed"))
    joined = parts.select("source", F.lit("").alias("member"), "line_no",
                          F.array_join(F.transform("p", lambda x: x["line"]), "\n").alias("line"), "unclosed")
    return one.unionByName(joined)


def stream_records(lines: Iterator[str], sep: str = ",") -> Iterator[tuple[str, bool]]:
    """(record, whether its quote never closes) of a file read in order."""
    held: list[str] = []
    inside = False
    for line in lines:
        line = line.rstrip("\r\n")
        if not inside and '"' not in line:
            yield line, False
            continue
        inside = ends_inside(line, inside, sep)
        held.append(line)
        if not inside:
            yield "\n".join(held), False
            held = []
    if held:
        yield "\n".join(held), True
