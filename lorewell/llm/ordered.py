"""Places and running sums of rows inside groups, by ranges: no group, however large, has to fit one task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _running(run_of: np.ndarray, values: np.ndarray, carried: int) -> np.ndarray:
    """Running sums, modulo 2**64, that begin anew where a run does; the first run goes on from `carried`."""
    total = np.cumsum(values, dtype=np.uint64)
    begins = np.flatnonzero(np.diff(run_of, prepend=-1))
    before = total[begins] - values[begins]
    before[0] -= np.uint64(carried)
    return total - before[run_of - run_of[0]]


def in_order(rows: DataFrame, group: Sequence[str], order: Sequence[str], sums: Sequence[str] = (), name: str = "ordered") -> DataFrame:
    """A written table of the rows with pos, a row's place (from 0) in its group by `order`, and for each column of
    `sums` (long) its running sum modulo 2**64, the row included, in that column.

    Rows are dealt by ranges of (group, order) and sorted, so a group lies in consecutive partitions.  Each partition
    counts its own rows; what earlier ones hold of its first group is added from one small row for each partition.
    Rows that are equal in group and order must be interchangeable, and lie in one partition.
    """
    spark = rows.sparkSession
    n_group, names = len(group), list(rows.columns)
    fields = [names.index(c) for c in sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        last, run_at, carried = None, 0, [0] * (len(fields) + 1)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for c in group:
                column = batch.column(names.index(c))
                codes = np.asarray(column.dictionary_encode(null_encoding="encode").indices)
                new[1:] |= codes[1:] != codes[:-1]
            first = tuple(batch.column(names.index(c))[0].as_py() for c in group)
            new[0] = last is not None and first != last
            if new[0]:
                carried = [0] * len(carried)
            runs = run_at + np.cumsum(new)
            made = [_running(runs, v, c) for v, c in zip([np.ones(n, np.uint64), *(np.asarray(batch.column(f)).astype(np.int64).view(np.uint64) for f in fields)], carried)]
            last = tuple(batch.column(names.index(c))[n - 1].as_py() for c in group)
            carried, run_at = [int(m[-1]) for m in made], int(runs[-1])
            columns = list(batch.columns)
            for f, m in zip(fields, made[1:]):
                columns[f] = pa.array(m.view(np.int64))
            extra = [pa.array((made[0] - np.uint64(1)).view(np.int64)), pa.array(np.full(n, part, np.int32)), pa.array(runs == 0), pa.array(np.arange(at, at + n))]
            at += n
            yield pa.RecordBatch.from_arrays([*columns, *extra], [*names, "pos", "_part", "_first", "_at"])

    dealt = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "pos long, _part int, _first boolean, _at long"])
    found = written(dealt.mapInArrow(run, schema), name)
    ends = found.groupBy("_part").agg(F.min_by(F.struct(*group), "_at").alias("first"), F.max_by(F.struct(*group, "_first", "pos", *sums), "_at").alias("last"))
    before, key, count = [], None, [0] * (len(sums) + 1)
    for r in sorted(ends.collect(), key=lambda r: r["_part"]):  # as many rows as the table has partitions
        first, last = tuple(r["first"]), tuple(r["last"])
        if key != first:
            count = [0] * len(count)
        before.append((r["_part"], *count))
        own = [last[n_group + 1] + 1, *last[n_group + 2 :]]
        count = [_signed(a + b) for a, b in zip(own, count)] if last[n_group] else own
        key = last[:n_group]
    before = [b for b in before if any(b[1:])]
    out = found.drop("_at")
    if before:
        added = F.broadcast(spark.createDataFrame(before, ", ".join(["_part int", "_n long", *(f"_s{i} long" for i in range(len(sums)))])))
        out = out.join(added, "_part", "left")
        moved = {"pos": F.col("pos") + F.when(F.col("_first"), F.coalesce("_n", F.lit(0))).otherwise(0)}
        for i, c in enumerate(sums):
            moved[c] = F.when(F.col("_first") & F.col(f"_s{i}").isNotNull(), wrapped_sum(F.col(c), F.col(f"_s{i}"))).otherwise(F.col(c))
        out = out.withColumns(moved)
    return out.select(*names, "pos")


def _signed(n: int) -> int:
    return (n + (1 << 63)) % (1 << 64) - (1 << 63)


def wrapped_sum(a, b):
    """a + b modulo 2**64, as ANSI arithmetic would refuse: by halves."""
    low = a.bitwiseAND(F.lit(0xFFFFFFFF)) + b.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftright(a, 32) + F.shiftright(b, 32) + F.shiftright(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))
