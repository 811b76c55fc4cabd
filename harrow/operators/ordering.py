"""Global order without a single-task window: range partitions, then offsets of one number for each partition."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.plans.durable import cut


def place_rows(df: DataFrame, order: list[Column]) -> tuple[DataFrame, dict[int, int]]:
    """df with __part and __pos (0-based place in the partition), and the number of rows before each partition.

    The placed rows are cut from their plan: range bounds are sampled, and a second run could cut elsewhere.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    mono = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = cut(placed.withColumn("__part", F.spark_partition_id()).withColumn("__pos", mono))
    sizes = sorted((r["__part"], r["n"]) for r in placed.groupBy("__part").agg(F.count("*").alias("n")).collect())
    return placed, dict(zip((p for p, _ in sizes), accumulate((n for _, n in sizes), initial=0), strict=False))


def number_rows(df: DataFrame, order: list[Column], out: str = "row_num", start: int = 1) -> DataFrame:
    """df with consecutive numbers in the given order; ties come in any order, so give a total one. Empty stays empty.

    A column of df with the name of the new one is replaced; names that start with two underscores are reserved.
    """
    placed, offsets = place_rows(df, order)
    table = df.sparkSession.createDataFrame(list(offsets.items()), "__part int, __offset long")
    numbered = placed.join(F.broadcast(table), "__part")  # a row for each partition
    return numbered.select(*(c for c in df.columns if c != out), (F.col("__offset") + F.col("__pos") + start).alias(out))


def _sums_of_runs(group: list[str], value: str, columns: list[str], schema):
    """Arrow batches of sorted rows with __part, the sum within the partition since the group began there (__sum), and
    whether the row's group is the partition's first one (__head)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(schema["__sum"].dataType)
        part, key, held, heads = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            keys = [batch.column(g) for g in group]
            fresh = np.zeros(size, bool)
            for k in keys:
                after, before = k.slice(1), k.slice(0, size - 1)
                other = pc.or_(pc.fill_null(pc.not_equal(after, before), False), pc.xor(pc.is_null(after), pc.is_null(before)))
                fresh[1:] |= other.to_numpy(zero_copy_only=False)
            fresh[0] = key is None or key != [k[0].as_py() for k in keys]
            values = pc.fill_null(batch.column(value).cast(kind), 0).to_numpy(zero_copy_only=False)
            total = np.cumsum(values)
            run_of_row, starts = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
            base = np.append(total[starts] - values[starts], -held)  # the last entry serves rows that go on from before
            sums = total - base[run_of_row]
            head = run_of_row + heads <= 0
            heads += len(starts)
            key, held = [k[-1].as_py() for k in keys], sums[-1]
            added = [pa.array(np.full(size, part, np.int32)), pa.array(sums, kind), pa.array(head)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *added], [*columns, "__part", "__sum", "__head"])

    return run


def running_sum(df: DataFrame, group: list[str], order: list[Column], value: str, out: str) -> DataFrame:
    """Sum of `value` over the rows of a group before the row, in the given order, plus its own; null counts as 0.

    A group may span many partitions. One pass over the range partitions adds up within each; only a partition's first
    group can have begun before it, so the sums to add are at most one row for each partition, which bounds the two
    broadcasts.
    """
    columns = [c for c in df.columns if c != out or c in (*group, value)]
    whole = not isinstance(df.schema[value].dataType, (T.FloatType, T.DoubleType))
    added = [T.StructField("__part", T.IntegerType()), T.StructField("__sum", T.LongType() if whole else T.DoubleType()), T.StructField("__head", T.BooleanType())]
    schema = T.StructType([*(df.schema[c] for c in columns), *added])
    keys = [F.col(g) for g in group]
    placed = df.select(*columns).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = cut(placed.mapInArrow(_sums_of_runs(group, value, columns, schema), schema))
    heads = placed.where("__head").select(*(k.alias(f"__k{i}") for i, k in enumerate(keys))).distinct()
    same = [k.eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    totals = placed.join(F.broadcast(heads), same, "left_semi").groupBy(*group, "__part").agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("__total"))
    before = F.sum("__total").over(Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*(k.alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__part").alias("__p"), before.alias("__before")).where("__before is not null")
    joined = placed.join(F.broadcast(offsets), [*same, F.col("__part") == F.col("__p"), F.col("__head")], "left")
    return joined.select(*(c for c in df.columns if c != out), (F.col("__sum") + F.coalesce("__before", F.lit(0))).alias(out))


def previous_in_group(df: DataFrame, group: str, position: str, block: int = 1 << 16, out: str = "previous") -> DataFrame:
    """df with the next smaller `position` (whole numbers, unique in the group) of the same group; null for the first.

    A frequent group is cut into blocks of positions, so no task gets all of it; the first row of a block takes the
    largest position of the block before, from a table with one row for each block.
    """
    blocked = df.withColumn("__block", F.floor(F.col(position) / block))
    inside = Window.partitionBy(group, "__block").orderBy(position)
    rows = blocked.withColumn("__inner", F.lag(position).over(inside))
    tops = blocked.groupBy(group, "__block").agg(F.max(position).alias("__top"))
    tops = tops.withColumn("__outer", F.lag("__top").over(Window.partitionBy(group).orderBy("__block"))).drop("__top")
    same = F.col(group).eqNullSafe(F.col("__g")) & (F.col("__block") == F.col("__b"))
    tops = tops.select(F.col(group).alias("__g"), F.col("__block").alias("__b"), "__outer")
    return rows.join(tops, same, "left").select(*(c for c in df.columns if c != out), F.coalesce("__inner", "__outer").alias(out))
