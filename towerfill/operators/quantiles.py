"""Exact quantiles per group without holding a group in one task.

Spark's exact ``percentile`` keeps a map of every distinct value of a group and
merges it in one task, which a hot group (a third of all rows) cannot afford.
Here the order statistics of all columns are found in two reads of the input:

1. per group: count, min, max and, for each wanted quantile, a bracket from the
   mergeable sketch of ``percentile_approx`` (its rank error is at most
   n / ``accuracy``; the bracket is wider than that on both sides). Brackets are of
   equal depth, so spikes and skewed values cannot fill them: a bracket holds about
   ``20 / accuracy`` of its group. Groups of at most ``accuracy / 2`` values are
   their own bracket;
2. the values inside the brackets, counted per distinct value, and those below a
   bracket, counted as one null value. A running count over them, the null first,
   picks the exact value of each rank.

Quantiles interpolate linearly between the two neighbouring ranks, as pandas,
Spark ``percentile`` and DuckDB ``quantile_cont`` do. A rank that a bracket should
hold and does not would fail the job, never give another value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from towerfill.operators.sequence import attach, join_on_keys
from towerfill.session import cut_lineage

ACCURACY = 20_000


def quantile_table(df: DataFrame, keys: Sequence[str], values: Mapping[str, Column], probs: Sequence[float],
                   names: Sequence[str] | None = None, accuracy: int = ACCURACY) -> DataFrame:
    """One row per group and variable with a column per probability (nulls and NaN ignored); ``values``: variable -> column.

    Groups with no value of a variable have no row for it."""
    keys, variables = list(keys), list(values)
    names = list(names) if names else [f"q{i}" for i in range(len(probs))]
    none = F.lit(None).cast("double")
    x = df.select(*keys, *[F.nanvl(c.cast("double"), none).alias(f"_v{i}") for i, c in enumerate(values.values())])
    margin = 10 / accuracy
    points = ", ".join(f"{p!r}D" for q in probs for p in (max(q - margin, 0.0), min(q + margin, 1.0)))
    stats = cut_lineage(x.groupBy(*keys).agg(*[F.expr(f"named_struct('n', count(_v{i}), 'lo', min(_v{i}), 'hi', max(_v{i}), "
                                                      f"'b', percentile_approx(_v{i}, array({points}), {accuracy}))").alias(f"_s{i}")
                                               for i in range(len(variables))]), "q-stats")
    pairs = [(i, j) for i in range(len(variables)) for j in range(len(probs))]

    def edge(i: int, j: int, side: int) -> str:
        outer = probs[j] >= 1 - margin if side else probs[j] <= margin
        end = f"_s{i}.{'hi' if side else 'lo'}"
        return end if outer else f"if(_s{i}.n <= {accuracy // 2}, {end}, get(_s{i}.b, {2 * j + side}))"

    edges = stats.selectExpr(*[f"`{k}`" for k in keys], *[f"{edge(i, j, e)} AS _{'lh'[e]}{i}_{j}" for i, j in pairs for e in (0, 1)])
    hits = ", ".join(f"if(_v{i} <= _h{i}_{j}, named_struct('_i', {i}, '_j', {j}, '_v', if(_v{i} >= _l{i}_{j}, _v{i}, NULL)), NULL)" for i, j in pairs)
    seen = attach(x, edges, keys).select(*keys, F.expr(f"inline(array_compact(array({hits})))"))
    vals = seen.groupBy(*keys, "_i", "_j", "_v").agg(F.count(F.lit(1)).alias("_vn"))
    upto = F.sum("_vn").over(Window.partitionBy(*keys, "_i", "_j").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0))
    vals = vals.withColumn("_end", upto).withColumn("_start", F.col("_end") - F.col("_vn"))

    # the position h of each group's, variable's and probability's quantile
    at = ", ".join(f"named_struct('_i', {i}, '_j', {j}, '_h', (_s{i}.n - 1) * {float(probs[j])!r}D)" for i, j in pairs)
    ranks = stats.select(*keys, F.expr(f"inline(array({at}))")).filter("_h >= 0")
    met = join_on_keys(vals, ranks, [*keys, "_i", "_j"])
    value_at = "max(if({0}(_h) >= _start AND {0}(_h) < _end, _v, NULL))"
    per_q = met.groupBy(*keys, "_i", "_j", "_h").agg(F.expr(value_at.format("floor")).alias("_a"), F.expr(value_at.format("ceil")).alias("_z"))
    q = F.expr("CASE WHEN _a IS NULL OR _z IS NULL THEN CAST(raise_error('a quantile''s rank lies outside its bracket') AS DOUBLE) "
               "WHEN floor(_h) = ceil(_h) THEN _a ELSE (ceil(_h) - _h) * _a + (_h - floor(_h)) * _z END")
    wide = per_q.select(*keys, "_i", "_j", q.alias("_q")).groupBy(*keys, "_i").agg(
        *[F.expr(f"max(if(_j = {j}, _q, NULL))").alias(n) for j, n in enumerate(names)])
    label = F.get(F.lit(variables), F.col("_i"))
    return cut_lineage(wide.select(*keys, label.alias("variable"), *names), "q-result")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    names: Sequence[str] | None = None, accuracy: int = ACCURACY) -> DataFrame:
    """One row per group of ``keys`` with a column per probability of the column ``value``."""
    return quantile_table(df, keys, {value: F.col(f"`{value}`")}, probs, names, accuracy).drop("variable")
