"""CSV scan with pandas-like missing tokens and type inference (S1), CSV sinks (K1, K2).

One pass over the lines finds each file's header, rows with more fields than the
header, and quoted line breaks. Files are then read as strings, by Spark's CSV reader
or record by record, and put under each other by column name; the default missing-value tokens
of ``pandas.read_csv`` become null; one aggregate decides per column whether every
value casts to a long or a double, and ``try_cast`` applies the choice.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from towerfill.session import cut_lineage

# --- fixed values: the default missing-value tokens of pandas.read_csv ---------------
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
# --- end of fixed values --------------------------------------------------------------

#: What a text needs to be a number at all; a failing cast costs the JVM an exception, a hundred times this look.
MAYBE_NUMBER = r"^[\x00-\x20]*[+-]?[0-9.iInN][0-9A-Za-z.+-]*[\x00-\x20]*$"


def null_tokens(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols) if cols is not None else [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    return df.withColumns({c: F.when(F.trim(F.col(f"`{c}`")).isin(NA_TOKENS), F.lit(None)).otherwise(F.col(f"`{c}`"))
                           for c in cols})


def infer_types(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Cast string columns to long / double when every non-null value allows it (one pass)."""
    cols = list(cols) if cols is not None else [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    if not cols:
        return df
    aggs = []
    for i, c in enumerate(cols):
        x = F.trim(F.col(f"`{c}`"))
        aggs += [F.count(x).alias(f"n{i}"), F.count(F.expr(f"try_cast(trim(`{c}`) AS BIGINT)")).alias(f"l{i}"),
                 F.count(F.when(x.rlike(MAYBE_NUMBER), x.try_cast("double"))).alias(f"d{i}")]
    r = df.agg(*aggs).first()
    repl = {}
    for i, c in enumerate(cols):
        n = r[f"n{i}"]
        if n == 0:
            continue
        if r[f"l{i}"] == n:
            repl[c] = F.expr(f"try_cast(trim(`{c}`) AS BIGINT)")
        elif r[f"d{i}"] == n:
            repl[c] = F.expr(f"try_cast(trim(`{c}`) AS DOUBLE)")
    return df.withColumns(repl) if repl else df


def n_fields(line: Column, sep: str = ",") -> Column:
    """Fields of a CSV record; separators inside quotes don't count, and a quote opens only at a field's start."""
    bare = F.regexp_replace(line, f'(^|{re.escape(sep)})"[^"]*+(?:""[^"]*+)*+("|$)', "$1")
    return F.size(F.split(F.when(F.contains(line, F.lit('"')), bare).otherwise(line), re.escape(sep), -1))


def csv_files(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """One row per non-empty file: ``file``, its first line ``header``, the rows ``over`` with more fields, and whether
    quotes may span lines (``breaks``; its rows over can't be told line by line)."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
                                         F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))
    lines = lines.filter(F.length(F.trim("line")) > 0)
    odd = F.length(F.regexp_replace("line", '[^"]', "")) % 2 == 1
    first = F.min_by("line", F.struct("at", "n"))
    files = lines.groupBy("file").agg(first.alias("header"), F.max(odd).alias("breaks"), F.max(n_fields(F.col("line"), sep)).alias("most"))
    return files.withColumn("over", ~F.col("breaks") & (F.col("most") > n_fields(F.col("header"), sep))).drop("most")


def read_csv(spark: SparkSession, path: str, infer: bool = True, sep: str = ",", bad_rows: str = "raise") -> DataFrame:
    """Comma-separated, first row is the header; files are split anywhere, also inside quoted line breaks.

    Columns go by name, whatever their order in each file; a column that a file lacks
    is null there. A row with more fields than its header raises, as the reference's
    reader does, or goes with ``bad_rows="drop"``; one with fewer is filled with nulls.
    Only the distinct headers reach the driver. Files of one header without quoted line
    breaks are read by Spark's CSV reader, others record by record in one scan.
    """
    groups = csv_files(spark, path, sep).groupBy("header").agg(F.max("breaks").alias("breaks"), F.max("over").alias("over")).limit(2).collect()
    if not groups:
        raise ValueError(f"no table found under {path}")
    if len(groups) == 1 and not groups[0].breaks and not groups[0].over:
        names = header_names(groups[0].header, sep)
        out = (spark.read.schema(", ".join(f"{quoted(n)} STRING" for n in names)).option("header", True).option("enforceSchema", True)
               .option("sep", sep).option("nullValue", "").option("escape", '"').csv(path))
    else:
        out = _by_records(spark, path, sep, bad_rows)
    out = null_tokens(out)
    return infer_types(out) if infer else out


def _by_records(spark: SparkSession, path: str, sep: str, bad_rows: str) -> DataFrame:
    """Every file's records with its own header, under each other by column name."""
    from towerfill.sources.records import text_records

    records = text_records(spark, path, sep=sep, skip=None, recursive=False).filter((F.length(F.trim("line")) > 0) | F.col("unclosed"))
    first = cut_lineage(records.groupBy("source").agg(F.min("line_no").alias("at"), F.min_by("line", "line_no").alias("header")), "headers")
    headers = sorted(r.header for r in first.select("header").distinct().collect())
    data = records.join(first, "source").filter(F.col("line_no") > F.col("at"))
    over = n_fields(F.col("line"), sep) > n_fields(F.col("header"), sep)
    if bad := data.filter(F.col("unclosed")).limit(1).collect():
        raise ValueError(f"a quote never closes: {bad[0].line[:200]!r}")
    if bad_rows == "drop":
        data = data.filter(~over)
    elif bad := data.filter(over).limit(1).collect():
        raise ValueError(f"a row has more fields than the header: {bad[0].line!r}")
    names = [header_names(h, sep) for h in headers]
    every: dict[str, str] = {}  # the first spelling of each name (Spark's names ignore case)
    for n in (n for part in names for n in part):
        every.setdefault(n.lower(), n)
    row = F.lit(None)
    for h, part in zip(headers, names):
        got = F.from_csv("line", ", ".join(f"{quoted(n)} STRING" for n in part), {"nullValue": "", "escape": '"', "sep": sep})
        have = {n.lower(): n for n in part}
        fields = F.struct(*[(got.getField(have[k]) if k in have else F.lit(None).cast("string")).alias(n) for k, n in every.items()])
        row = F.when(F.col("header") == h, fields).otherwise(row)
    return data.select(row.alias("r")).select("r.*")


def quoted(name: str) -> str:
    return f"`{name}`"


def header_names(line: str, sep: str = ",") -> list[str]:
    """Column names of a header line; repeated ones (Spark's names ignore case, T4) get a number."""
    seen: dict[str, int] = {}
    out = []
    for n in next(csv.reader([line.lstrip("\ufeff")], delimiter=sep)):
        n = n.strip()
        k = n.lower()
        seen[k] = seen.get(k, -1) + 1
        out.append(f"{n}_{seen[k]}" if seen[k] else n)
    return out


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", sep: str = ",") -> str:
    """Header CSV written by the executors (one part file per partition)."""
    (df.write.mode(mode).option("header", True).option("escape", '"').option("sep", sep)
       .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
       .option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSSXXX").csv(path))
    return path


def write_ordered_csv(df: DataFrame, path: str, order: Sequence[str], sep: str = ",", ranges: int | None = None) -> str:
    """K1 / K2: a CSV in the order of ``order``, its header once at the beginning.

    The rows are range-partitioned and sorted, so the part files in the order of their
    names are the file; no row passes the driver or one task. Where the file system can
    put files together by their blocks (HDFS), ``join_parts`` makes them one named file.
    """
    stamp = {"sep": sep, "escape": '"', "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSSXXX"}
    head = sep.join(f'"{c.replace(chr(34), chr(34) * 2)}"' if re.search(f'[{re.escape(sep)}"\n]', c) else c for c in df.columns)
    line = F.to_csv(F.struct(*[F.col(quoted(c)) for c in df.columns]), stamp)
    keys = [F.col(quoted(c)).alias(f"_o{i}") for i, c in enumerate(order)]
    rows = df.select(F.lit(1).alias("_body"), *keys, line.alias("value"))
    top = df.sparkSession.range(1).select(F.lit(0).alias("_body"), *[F.lit(None).cast(rows.schema[f"_o{i}"].dataType).alias(f"_o{i}")
                                                                   for i in range(len(keys))], F.lit(head).alias("value"))
    by = ["_body", *[F.col(f"_o{i}").asc_nulls_first() for i in range(len(keys))]]
    dealt = rows.unionByName(top).repartitionByRange(*([ranges] if ranges else []), *by).sortWithinPartitions(*by)
    dealt.select("value").write.mode("overwrite").text(path)
    return path


def join_parts(spark: SparkSession, folder: str, file: str) -> str:
    """Makes the part files of ``folder``, in the order of their names, the one named ``file`` (by block, on file systems that can)."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted(s.getPath().getName() for s in files.listStatus(path(folder)) if s.getPath().getName().startswith("part-") and s.getLen())
    if not parts:
        raise ValueError(f"no part files under {folder}")
    if len(parts) > 1:
        rest = spark._sc._gateway.new_array(path, len(parts) - 1)
        for i, p in enumerate(parts[1:]):
            rest[i] = path(f"{folder}/{p}")
        try:
            files.concat(path(f"{folder}/{parts[0]}"), rest)
        except Exception as e:
            raise NotImplementedError(f"this file system can't put files together; {folder} holds the parts in order") from e
    if not files.rename(path(f"{folder}/{parts[0]}"), path(file)):
        raise OSError(f"could not name {file}")
    return file
