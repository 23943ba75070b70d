"""Places of items in lists, for lists of any length."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.storage import materialize


def number(column: str) -> Column:
    """The column as a double, null for NaN."""
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def competition_places(df: DataFrame, keys: list[str], values: list[Column], out: str, *, descending: bool = True) -> DataFrame:
    """``df`` with ``out``: 1 plus the number of rows of the same ``keys`` that ``values`` put before.

    Rows whose values are null take the place after all that have one. This is SQL's
    ``rank() over (partition by keys order by values desc nulls last)``, for groups that no single task
    may hold, and ties as well: one sort of all rows over all tasks (keys, values, then a hash of the
    row) cuts groups and ties where ranges end. Each task counts places within its range and says
    what stands at its ends; from these, one row a task, the driver knows what the first group of
    each range lacks. Keys may be null. ``values`` must be comparable for equality in Arrow.
    """
    spark = df.sparkSession
    v = [f"__v{j}" for j in range(len(values))]
    named = df.select("*", *[x.alias(n) for n, x in zip(v, values)])
    order = [F.col(f"`{k}`").asc() for k in keys] + [F.col(n).desc_nulls_last() if descending else F.col(n).asc_nulls_last() for n in v] + [F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])]
    ranges = named.repartitionByRange(*order).sortWithinPartitions(*order)
    columns = df.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last: pa.RecordBatch | None = None
        first: tuple = ()
        groups = ties = in_group = place = 0
        n_first = 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if last is None:
                first = _row(batch, 0, keys), _row(batch, 0, v)
            new_group, new_tie = _changes(last, batch, keys), _changes(last, batch, v)
            new_tie |= new_group
            at = np.arange(n)
            begun = np.maximum.accumulate(np.where(new_group, at, -1))
            before = np.where(begun >= 0, at - begun, in_group + at)  # rows of the group before this one
            tie = np.maximum.accumulate(np.where(new_tie, at, -1))
            places = np.where(tie >= 0, before[tie] + 1, place)
            group_no, tie_no = groups + np.cumsum(new_group), ties + np.cumsum(new_tie)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], pa.array(places), pa.array(np.full(n, part, np.int32)), pa.array(group_no == 1), pa.array(tie_no == 1), pa.nulls(n, pa.binary())],
                [*columns, "__place", "__part", "__first_group", "__first_tie", "__ends"],
            )
            groups, ties, in_group, place = int(group_no[-1]), int(tie_no[-1]), int(before[-1]) + 1, int(places[-1])
            last = batch.slice(n - 1, 1)
        if last is not None:
            ends = pickle.dumps((*first, groups, ties, _row(last, 0, keys), _row(last, 0, v), in_group, place))
            empty = [pa.nulls(1, last.column(c).type) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [*empty, pa.nulls(1, pa.int64()), pa.array([part], pa.int32()), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.bool_()), pa.array([ends], pa.binary())],
                [*columns, "__place", "__part", "__first_group", "__first_tie", "__ends"],
            )

    placed = materialize(ranges.mapInArrow(count, f"{fields}, __place long, __part int, __first_group boolean, __first_tie boolean, __ends binary"), "places")
    # one row a task
    lacks, open_ = [], None
    for row in placed.where("__ends is not null").select("__part", "__ends").orderBy("__part").collect():
        key, value, groups, ties, last_key, last_value, in_group, place = pickle.loads(row["__ends"])
        offset, tie = 0, None
        if open_ and open_[0] == key:
            offset, tie = open_[2], open_[3] if open_[1] == value else None
            lacks.append((row["__part"], offset, tie))
        if groups == 1:
            in_group, place = in_group + offset, tie if ties == 1 and tie else place + offset
        open_ = (last_key, last_value, in_group, place)
    rows = placed.where("__ends is null")
    add = F.broadcast(spark.createDataFrame(lacks, "__part int, __offset long, __tie long"))
    c = F.col
    whole = F.when(c("__first_tie") & c("__tie").isNotNull(), c("__tie")).when(c("__first_group"), c("__place") + F.coalesce("__offset", F.lit(0))).otherwise(c("__place"))
    return rows.join(add, "__part", "left").select(*[c(f"`{x}`") for x in df.columns], whole.alias(out))


def _row(batch: pa.RecordBatch, k: int, columns: list[str]) -> tuple:
    return tuple(batch.column(c)[k].as_py() for c in columns)


def _changes(last: pa.RecordBatch | None, batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """Which rows differ in ``columns`` from the row before, of which the first is ``last``; null equals null."""
    out = np.zeros(batch.num_rows, bool)
    out[0] = last is None
    for c in columns:
        own = batch.column(c)
        before = pa.concat_arrays([last.column(c), own]) if last is not None else own
        a, b = before.slice(0, len(before) - 1), before.slice(1)
        same = pc.coalesce(pc.equal(a, b), pc.and_(a.is_null(), b.is_null()))
        out[batch.num_rows - len(a) :] |= ~same.to_numpy(zero_copy_only=False)
    return out
