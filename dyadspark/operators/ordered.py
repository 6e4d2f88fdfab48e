"""Order-dependent operators with a stated order, none of which needs a whole hot group in one task.

* "first row" rules filter ``row_number`` (Spark prunes each map task to the first rows before the shuffle);
* totals, sizes and medians per group are aggregated (with map-side partial sums) and joined back;
* running totals are taken over rows already aggregated to the ordering key;
* fill-down and global numbering work per range partition and carry only one row per partition further.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from dyadspark.functions.nulls import col
from dyadspark.session import stored


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each group in a complete order (give enough columns to break every tie)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join on equally named keys where NULL matches NULL; keys are kept once, from the left."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def attach_group(df: DataFrame, keys: Sequence[str], few: bool = False, **aggs: Column) -> DataFrame:
    """Group aggregates put on every row of the group.

    Aggregate-then-join instead of a window: the aggregation combines map-side, and the join back is broadcast
    or split by the adaptive skew handling, so a group that holds a third of the rows is never read by one task.
    With ``few`` groups (categories, years) the summary is stored first, which spares the shuffle of the rows.
    """
    if not keys:
        return attach_total(df, **aggs)
    summary = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return join_same(df, stored(summary) if few else summary, keys)


def attach_total(df: DataFrame, **aggs: Column) -> DataFrame:
    """Aggregates of the whole table put on every row, as fields of one scalar subquery."""
    totals = df.agg(F.struct(*[a.alias(n) for n, a in aggs.items()]).alias("_t")).scalar()
    return df.withColumn("_t", totals).withColumns({n: F.col(f"_t.{n}") for n in aggs}).drop("_t")


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], **sums: str | Column) -> DataFrame:
    """Cumulative sums over a table that has one row per group and ordering key."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({n: F.sum(col(c)).over(w) for n, c in sums.items()})


def _fill_in_order(cols: Sequence[str], keys: Sequence[str]):
    """A pass over sorted rows that carries values forward within a partition, one batch and one row at a time."""

    def same(a: pa.Array, b: pa.Array) -> np.ndarray:
        both = pc.fill_null(pc.equal(a, b), False)
        return pc.or_(both, pc.and_(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None  # the last filled row
        leading, at, part = True, 0, TaskContext.get().partitionId()
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            held = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
            size = held.num_rows
            new = np.zeros(size, bool)
            for k in keys:
                values = held[k].combine_chunks()
                new[1:] |= ~same(values.slice(1), values.slice(0, size - 1))
            start = np.maximum.accumulate(np.where(new, np.arange(size), 0))
            for c in cols:
                values = held[c].combine_chunks()
                seen = np.maximum.accumulate(np.where(pc.is_valid(values).to_numpy(zero_copy_only=False), np.arange(size), -1))
                filled = values.take(pa.array(seen, mask=(seen < start) | (seen < 0)))
                held = held.set_column(held.schema.get_field_index(c), c, filled)
            fresh = held.slice(size - n)
            leads = (np.cumsum(new[size - n :]) == 0) & leading
            leading = bool(leads[-1])
            extra = {"_part": pa.array(np.full(n, part, np.int32)), "_at": pa.array(np.arange(at, at + n)), "_lead": pa.array(leads)}
            for name, values in extra.items():
                fresh = fresh.append_column(name, values)
            at += n
            last = held.slice(size - 1).combine_chunks().to_batches()[0]
            yield from fresh.combine_chunks().to_batches()

    return job


def fill_down(df: DataFrame, order: str, cols: Sequence[str], keys: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """Carry the last non-NULL value forward along an order, within ``keys``; NULL keys are a group of their own.

    A prefix scan in two levels: the rows are range-partitioned and sorted by (keys, order), each task fills its own
    partition in one pass, and the values that leave a partition (one row each) are carried over the partitions and put
    on the rows that lead the next ones. So neither a whole file nor a hot group has to pass through one task.
    """
    place = [*keys, order]
    spread = df.repartitionByRange(partitions, *place) if partitions else df.repartitionByRange(*place)
    extra = [T.StructField("_part", T.IntegerType()), T.StructField("_at", T.LongType()), T.StructField("_lead", T.BooleanType())]
    schema = T.StructType([*df.schema.fields, *extra])
    local = stored(spread.sortWithinPartitions(*place).mapInArrow(_fill_in_order(cols, keys), schema))
    tails = local.groupBy("_part").agg(F.max_by(F.struct(*keys, *cols), "_at").alias("_t")).select("_part", "_t.*")
    upto = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = tails.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.lead("_part").over(Window.orderBy("_part")).alias("_to"),  # one row per partition
        *[F.last(c, ignorenulls=True).over(upto).alias(f"_c_{c}") for c in cols],
    )
    meet = (F.col("_part") == F.col("_to")) & F.col("_lead")
    for k in keys:
        meet = meet & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = local.join(F.broadcast(carried), meet, "left")
    return joined.select(*[F.coalesce(c, f"_c_{c}").alias(c) if c in cols else F.col(c) for c in df.columns])


def number_rows(
    df: DataFrame, order: Sequence[str | Column], name: str = "row_no", running: tuple[str, str] | None = None
) -> DataFrame:
    """Consecutive numbers 1..n in a global order (which must be unique), without a one-task window.

    The range-sorted table is written once so that positions cannot change on a retry; then each partition's
    offset is the sum of the sizes before it. Only one row per partition is ever brought together.
    ``running=(column, result)`` adds the running sum of a column in the same order.
    """
    placed = stored(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn(
        "_pos", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    )
    sums = {"_offset": F.lit(1)}
    if running:
        inside = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums["_before"] = F.col(running[0])
        placed = placed.withColumn("_within", F.sum(running[0]).over(inside))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    offsets = sizes.select("_part", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(k) for k in sums])
    numbered = placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + F.col("_pos") + 1)
    if running:
        numbered = numbered.withColumn(running[1], F.col("_before") + F.col("_within"))
    return numbered.drop("_at", "_part", "_pos", "_within", *sums)


def dense_ids(df: DataFrame, key: str, name: str) -> DataFrame:
    """Integer id of a key by its sorted position; numbered on the distinct keys and joined back.

    ``df`` is read twice; where it is costly, pass a stored table.
    """
    ids = number_rows(df.select(key).where(F.col(key).isNotNull()).distinct(), [key], name)
    return df.join(ids, key, "left")


def first_and_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """A value at the first and at the last row of each group, combined map-side."""
    at = F.struct(*order)
    return df.groupBy(*keys).agg(F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"))


def latest_if(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cond: Column) -> DataFrame:
    """The latest record per group, kept only if that very record satisfies the condition."""
    return first_per_group(df, keys, order).where(cond)


def later_or_single(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Drop the first row of each group with several rows; groups of one row stay."""
    at = F.struct(*order) if len(order) > 1 else F.col(order[0])
    marked = attach_group(df, keys, _n=F.count(F.lit(1)), _first=F.min(at))
    return marked.where((F.col("_n") == 1) | (at > F.col("_first"))).drop("_n", "_first")


def extremes(df: DataFrame, order: str, tie: Sequence[str]) -> DataFrame:
    """The row with the highest and the row with the lowest value."""
    valid = df.where(F.col(order).isNotNull())
    top = valid.orderBy(F.desc(order), *tie).limit(1).withColumn("end", F.lit("max"))
    low = valid.orderBy(F.asc(order), *tie).limit(1).withColumn("end", F.lit("min"))
    return top.unionByName(low)


def drop_last(df: DataFrame, order: str) -> DataFrame:
    """All rows but the one with the highest ordinal (a footer)."""
    return df.where(F.col(order) < df.agg(F.max(order)).scalar())


def label_blocks(df: DataFrame, order: str, label: str, parts: Sequence[str], name: str = "part") -> DataFrame:
    """Rows come in blocks of ``len(parts)``; each row gets the label of its block's first row and its part name."""
    size = len(parts)
    at = F.col(order) - 1
    block = Window.partitionBy("_block").orderBy(order)  # never more rows than parts
    names = F.array(*[F.lit(p) for p in parts])
    return (
        df.withColumn("_block", F.floor(at / size))
        .withColumn(label, F.first(label).over(block))
        .withColumn(name, F.get(names, F.pmod(at, F.lit(size)).cast("int")))
        .drop("_block")
    )
