"""Order statistics, ranks and running totals of whole tables without a single-task window.

Percentiles are exact and take a few passes that count: first by binary exponent, then by slices of the range that still holds the wanted
place, whose ends are the least and largest value seen there. A pass returns some thousand counts for each column, whatever the
number of rows and of distinct values. Running totals are a segmented scan: rows are range-partitioned by their order, each partition's
totals are added up on the driver (a row a partition), and a second pass adds its partition's share while it streams through the rows.
Ranks count distinct values first, so that ties are one row and a hot value is combined before it is moved.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

#: Slices of a range that are counted in one pass.
SLICES = 1024
_NAN, _INF = 5000, 4000


def settled(df: DataFrame) -> DataFrame:
    """The rows, worked out once: checkpointed in the shared folder where spark.checkpoint.dir is set, else persisted (lost parts are worked out again)."""
    spark = df.sparkSession
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(place)
    return df.checkpoint() if spark.sparkContext.getCheckpointDir() else df.persist(StorageLevel.MEMORY_AND_DISK)


# --- percentiles ------------------------------------------------------------------------------------------------


def _exponent(v: Column) -> Column:
    """A whole number that grows with v: its binary exponent with its sign."""
    size = F.when(F.abs(v) == float("inf"), _INF).otherwise(F.floor(F.log2(F.abs(v))) + 2000)
    return F.when(F.isnan(v), _NAN).when(v == 0, 0).when(v > 0, size).otherwise(-size).cast("int")


def _places(n: int, p: float) -> tuple[int, int, float]:
    at = p * (n - 1)
    return math.floor(at), math.ceil(at), at


def percentiles(df: DataFrame, columns: list[str], ps: list[float], by: list[str] = ()) -> dict[tuple, dict[tuple[str, float], float | None]]:
    """Exact interpolated percentiles of columns: {group: {(column, p): value}}; () is the group where `by` is empty.

    For few groups: the driver holds some thousand counts for each. Nulls don't count, not-a-number stands above all values, and a
    column without values has null percentiles.
    """
    by = list(by)
    values = df.select(*by, *[F.col(c).cast("double").alias(c) for c in dict.fromkeys(columns)]).persist(StorageLevel.MEMORY_AND_DISK)
    long = values.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("name_"), F.col(c).alias("v_")) for c in dict.fromkeys(columns)])).alias("x_")).select(*by, "x_.*").where("v_ IS NOT NULL")
    stats = (F.count(F.lit(1)).alias("n_"), F.min("v_").alias("lo_"), F.max("v_").alias("hi_"))
    try:
        slices = defaultdict(list)
        for r in long.groupBy(*by, "name_", _exponent(F.col("v_")).alias("slice_")).agg(*stats).collect():
            slices[tuple(r[b] for b in by), r["name_"]].append((r["slice_"], r["n_"], r["lo_"], r["hi_"]))
        groups = {k for k, _ in slices} | ({()} if not by else set())
        out = {g: {(c, p): None for c in columns for p in ps} for g in groups}
        size = {k: sum(s[1] for s in v) for k, v in slices.items()}
        # the brackets that are open: (group, column, least, largest value) -> (rows below, percentiles)
        opened = {(g, c, None, None): (0, list(ps)) for g, c in slices}
        found = {(g, c, None, None): v for (g, c), v in slices.items()}
        while opened:
            new = defaultdict(lambda: (0, []))
            for key, (below, wanted) in opened.items():
                group, name = key[:2]
                own = sorted(found[key])
                ends = np.cumsum([s[1] for s in own]) + below
                for p in wanted:
                    low, high, at = _places(size[group, name], p)
                    i = int(np.searchsorted(ends, low, side="right"))
                    lo, hi = own[i][2], own[i][3]
                    if high >= ends[i]:  # between the last value of a slice and the first of the next
                        out[group][name, p] = (high - at) * hi + (at - low) * own[i + 1][2]
                    elif lo == hi or lo != lo or hi != hi:
                        out[group][name, p] = hi
                    else:
                        new[group, name, lo, hi] = (int(ends[i] - own[i][1]), [*new[group, name, lo, hi][1], p])
            opened = dict(new)
            found = _counted(long, by, list(opened), stats) if opened else {}
        return out
    finally:
        values.unpersist()


def _counted(long: DataFrame, by: list[str], brackets: list[tuple], stats: tuple) -> dict[tuple, list]:
    """Slices of each bracket: (slice, rows, least value, largest value)."""
    fields = [StructField(f"{b}_b", long.schema[b].dataType) for b in by]
    schema = StructType([*fields, StructField("name_b", long.schema["name_"].dataType), StructField("from_", DoubleType()), StructField("to_", DoubleType()), StructField("id_", LongType())])
    state = long.sparkSession.createDataFrame([(*g, c, lo, hi, i) for i, (g, c, lo, hi) in enumerate(brackets)], schema)  # a row for each column, group and percentile at most
    same = F.col("name_") == F.col("name_b")
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"{b}_b"))
    met = long.join(F.broadcast(state), same & F.col("v_").between(F.col("from_"), F.col("to_")))
    at = F.least(F.lit(SLICES - 1), F.floor((F.col("v_") - F.col("from_")) / (F.col("to_") - F.col("from_")) * SLICES)).cast("int")
    out = defaultdict(list)
    for r in met.groupBy("id_", at.alias("slice_")).agg(*stats).collect():
        out[brackets[r["id_"]]].append((r["slice_"], r["n_"], r["lo_"], r["hi_"]))
    return out


# --- running totals -----------------------------------------------------------------------------------------------


def running(df: DataFrame, order: list[Column | str], sums: list[str], by: list[str] = (), least: bool = False) -> DataFrame:
    """Adds <column>_run for each of `sums`: its total over the group's rows up to this one in the given order (with `least`, its minimum).

    The order should tell all rows apart; totals of whole numbers are exact. Groups may be of any number and size.
    """
    by = list(by)
    kind = {c: "long" if df.schema[c].dataType.typeName() in ("byte", "short", "integer", "long") else "double" for c in sums}
    keys = [F.col(b).asc_nulls_first() for b in by] + [F.col(o).asc() if isinstance(o, str) else o for o in order]
    rows = df.withColumns({c: F.col(c).cast(kind[c]) for c in sums})
    rows = settled(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)).withColumn("part_", F.spark_partition_id())
    group = F.struct(*by) if by else F.struct(F.lit(0))
    total = F.min if least else F.sum
    each = rows.groupBy("part_", group.alias("g_")).agg(*[total(c).alias(c) for c in sums])  # borders of partitions: the last group of each
    ends = each.groupBy("part_").agg(F.min("g_").alias("first_"), F.max("g_").alias("last_"), F.max_by(F.struct(*sums), "g_").alias("t_"))
    starts, carried, last = {}, None, None
    for r in sorted(ends.collect(), key=lambda r: r["part_"]):
        starts[r["part_"]] = carried if last is not None and r["first_"] == last else None
        own = [r["t_"][c] for c in sums]
        if r["first_"] == r["last_"] == last and carried is not None:
            own = [_joined(a, b, least) for a, b in zip(carried, own)]
        carried, last = own, r["last_"]
    names = rows.columns
    schema = StructType([*rows.schema.fields, *[StructField(f"{c}_run", LongType() if kind[c] == "long" else DoubleType()) for c in sums]])

    def run(batches):
        carry, seen = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            table = pa.Table.from_batches([batch])
            new = np.zeros(n, bool)
            for b in by:
                col = table[b].combine_chunks()
                a, z = col.slice(1), col.slice(0, n - 1)
                differ = pc.fill_null(pc.not_equal(a, z), False).to_numpy(zero_copy_only=False) | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(z).to_numpy(zero_copy_only=False))
                new[1:] |= differ
            head = tuple(batch.column(b)[0].as_py() for b in by)
            if seen is None:
                carry = starts[batch.column("part_")[0].as_py()]
            elif head != seen:
                carry = None
            seen = tuple(batch.column(b)[n - 1].as_py() for b in by)
            cuts = np.append(np.flatnonzero(new), n)
            runs, tail = [], []
            for k, c in enumerate(sums):
                col = pc.fill_null(batch.column(c), _neutral(kind[c], least)).to_numpy(zero_copy_only=False)
                done, at = np.empty(n, col.dtype), 0
                for cut in cuts:
                    part = (np.minimum.accumulate if least else np.cumsum)(col[at:cut])
                    if at == 0 and carry is not None and carry[k] is not None:
                        part = np.minimum(part, carry[k]) if least else part + carry[k]
                    done[at:cut], at = part, cut
                runs.append(pa.array(done))
                tail.append(done[-1].item())
            carry = tail
            yield pa.RecordBatch.from_arrays([*batch.columns, *runs], [*names, *[f"{c}_run" for c in sums]])

    return rows.mapInArrow(run, schema).drop("part_")


def _neutral(kind: str, least: bool):
    return (np.iinfo(np.int64).max if kind == "long" else math.inf) if least else (0 if kind == "long" else 0.0)


def _joined(a, b, least: bool):
    if a is None or b is None:
        return b if a is None else a
    return min(a, b) if least else a + b


# --- ranks --------------------------------------------------------------------------------------------------------


def ranked_values(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """(by, value, times, below, of): each group's distinct values, how often they occur, how many rows are below them, and the group's rows; nulls don't count."""
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("times"))
    run = running(counts, [value], ["times"], by).withColumn("below", F.col("times_run") - F.col("times"))
    if not by:
        return run.drop("times_run").crossJoin(F.broadcast(df.agg(F.count(value).alias("of"))))  # one row
    total = df.groupBy(*by).agg(F.count(value).alias("of"))
    return matched(run.drop("times_run"), total, by)


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join by keys that takes nulls as equal; the keys are the left side's."""
    other = right.withColumnsRenamed({k: f"{k}_k" for k in keys})
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"{k}_k"))
    return left.join(other, same, how).drop(*[f"{k}_k" for k in keys])


def with_rank(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """Rows with a value, with rank_ (that of the first of equals), times_ and of_."""
    ranks = ranked_values(df, value, by).select(*by, value, (F.col("below") + 1).alias("rank_"), F.col("times").alias("times_"), F.col("of").alias("of_"))
    return matched(df.where(F.col(value).isNotNull()), ranks, [*by, value])


def mid_rank() -> Column:
    return F.col("rank_") + (F.col("times_") - 1) / 2.0
