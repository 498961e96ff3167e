"""Running numbers over a distributed order.

One operator serves every dense numbering of the library: rows are dealt to
partitions by ranges of (group, order), each partition adds up its own rows in
one streaming pass, and what came before it in the group is added afterwards.

* Any key types; any number of groups.
* A group as large as the table spreads over many partitions, as the range
  covers the order too.  Rows with equal group and order spread as well (the
  last part of the range key is a random number); which of them comes first is
  then arbitrary, but fixed once written.
* The driver sees one row a partition.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import staged


def _changes(columns: list[pa.Array], before: list) -> np.ndarray:
    """True where a row's group is not that of the row before it."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    for column, last in zip(columns, before):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        here, there = column[1:], column[:-1]
        same = pc.if_else(
            pc.and_(pc.is_valid(here), pc.is_valid(there)), pc.equal(here, there), pc.and_(pc.is_null(here), pc.is_null(there))
        )
        new[1:] |= ~same.fill_null(False).to_numpy(zero_copy_only=False)
        new[0] |= last is None or last.as_py() != column[0].as_py()
    return new


def _running(names: list[str], value: str, local: str, first: str, seq: str):
    """Streams a partition's batches, in order, and adds the running sum of
    ``value`` in the row's group, whether that group is the partition's first
    one, and the row's place in the partition."""

    def run(batches):
        before: list = [None] * len(names)
        total, seen, in_first = 0, 0, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            amount = batch.column(batch.schema.get_field_index(value)).to_numpy(zero_copy_only=False)
            keys = [batch.column(batch.schema.get_field_index(k)) for k in names]
            new = _changes(keys, before) if names else np.zeros(n, bool)
            if not seen:
                new[0] = False  # the partition's first row may go on with the group before
            start = np.flatnonzero(new)
            here = np.cumsum(amount)
            base = np.r_[-total, (here - amount)[start]]  # of the rows before the first change, and from each change on
            sums = (here - np.repeat(base, np.diff(np.r_[0, start, n]))).astype(amount.dtype)
            flags = np.zeros(n, bool)
            if in_first:
                flags[: start[0] if len(start) else n] = True
                in_first = not len(start)
            extra = [pa.array(sums), pa.array(flags), pa.array(np.arange(seen, seen + n))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, local, first, seq])
            total, seen, before = sums[-1], seen + n, [k[n - 1] for k in keys]

    return run


def _carried(ends: list) -> list[tuple]:
    """(partition, what its first group had before it), from each partition's
    first key, last key, running sum at its end and whether it is one group."""
    out, before, total = [], None, None
    for r in ends:
        carry = total if before is not None and before == r.head else type(r.total)(0)
        out.append((r.pid, carry))
        before, total = r.tail, r.total + (carry if r.one else 0)
    return out


def _free(df: DataFrame, *stems: str) -> list[str]:
    """Column names that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    names = []
    for stem in stems:
        name = f"__{stem}"
        while name in taken:
            name += "_"
        taken.add(name)
        names.append(name)
    return names


def running_total(
    df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), value: Column | None = None, out: str = "running",
) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` (1 where not given, so a row
    number from 1) over the rows up to and with this one, in ``order``, within
    the rows that share ``by``.  Null keys are one group; a null value adds
    nothing; an empty table stays empty.

    Every column travels through one range shuffle and one Arrow pass, so pass
    only the columns that are needed."""
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column {out!r} exists already")
    amount, tie, pid, local, first, seq, carry = _free(df, "amount", "tie", "pid", "local", "first", "seq", "carry")
    rows = df.withColumn(amount, F.lit(1) if value is None else F.coalesce(value, F.lit(0)))
    kind = "double" if dict(rows.dtypes)[amount] in ("double", "float") else "long"
    rows = rows.withColumn(amount, F.col(amount).cast(kind)).withColumn(tie, F.rand(11))
    keys = [*(F.col(b) for b in by), *(F.col(o) if isinstance(o, str) else o for o in order), F.col(tie)]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(tie).withColumn(pid, F.spark_partition_id())
    schema = T.StructType([
        *dealt.schema.fields, T.StructField(local, T.DoubleType() if kind == "double" else T.LongType()),
        T.StructField(first, T.BooleanType()), T.StructField(seq, T.LongType()),
    ])
    summed = staged(dealt.mapInArrow(_running(list(by), amount, local, first, seq), schema), "running")
    group = F.struct(F.lit(0), *(F.col(b) for b in by))
    ends = summed.groupBy(F.col(pid).alias("pid")).agg(
        F.min_by(group, F.col(seq)).alias("head"), F.max_by(group, F.col(seq)).alias("tail"),
        F.max_by(F.col(local), F.col(seq)).alias("total"), F.min(F.col(first)).alias("one"),
    )
    before = _carried(ends.orderBy("pid").collect())  # one row a partition
    shares = summed.sparkSession.createDataFrame(before, f"{pid} int, {carry} {kind}")
    sums = F.col(local) + F.when(F.col(first), F.coalesce(F.col(carry), F.lit(0))).otherwise(F.lit(0))
    return summed.join(F.broadcast(shares), pid, "left").select(*(F.col(c) for c in df.columns), sums.cast(kind).alias(out))


def row_numbers(df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), out: str = "number", start: int = 1) -> DataFrame:
    """``df`` with ``out``: each row's number in ``order`` within ``by``, from
    ``start``, without gaps."""
    numbered = running_total(df, order, by, None, out)
    return numbered.withColumn(out, F.col(out) + F.lit(start - 1).cast("long")) if start != 1 else numbered
