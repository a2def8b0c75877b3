"""Means and scatters of vector columns, summed in tasks: one row a task and group is shuffled, not one a number."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def joined(a: tuple[int, np.ndarray, np.ndarray], b: tuple[int, np.ndarray, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and squared deviations of two sets together."""
    n = a[0] + b[0]
    step = b[1] - a[1]
    return n, a[1] + step * (b[0] / n), a[2] + b[2] + step * step * (a[0] * b[0] / n)


def moments(vectors: DataFrame, column: str, by: list[str]) -> DataFrame:
    """(by, n, mean, dev): vectors of each group, their mean, and by position the sum of squared deviations from it.

    Null vectors are passed over. The vectors of a group have one length. Partial results are joined by
    deviations from means, so that nothing cancels.
    """
    x = vectors.select(*by, F.col(column).cast("array<double>").alias("v")).where("v IS NOT NULL")
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in x.select(*by).schema), "n long, mean array<double>, dev array<double>"])
    kinds = len(by)

    def rows(held: dict[tuple, tuple[int, np.ndarray, np.ndarray]], like: pa.Schema) -> pa.RecordBatch:
        keys = [pa.array([k[i] for k in held], like.field(b).type) for i, b in enumerate(by)]
        n, mean, dev = zip(*held.values(), strict=True) if held else ((), (), ())
        lists = [pa.array([v.tolist() for v in c], pa.list_(pa.float64())) for c in (mean, dev)]
        return pa.RecordBatch.from_arrays([*keys, pa.array(n, pa.int64()), *lists], names=[*by, "n", "mean", "dev"])

    def keys_of(batch: pa.RecordBatch) -> list[tuple]:
        return list(zip(*(batch.column(i).to_pylist() for i in range(kinds)), strict=True)) if kinds else [()] * batch.num_rows

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, like = {}, None
        for batch in batches:
            like = batch.schema
            if not batch.num_rows:
                continue
            number: dict[tuple, int] = {}
            code = np.array([number.setdefault(k, len(number)) for k in keys_of(batch)])
            column = batch.column(kinds)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.array([len(v) for v in column]))
            order = np.argsort(code, kind="stable")
            cuts = np.searchsorted(code[order], np.arange(len(number) + 1))
            for key, g in number.items():
                some = order[cuts[g] : cuts[g + 1]]
                size = len(column[int(some[0])])
                m = flat[(ends[some] - size)[:, None] + np.arange(size)]
                mean = m.mean(0)
                new = len(some), mean, ((m - mean) ** 2).sum(0)
                held[key] = joined(held[key], new) if key in held else new
        if held:
            yield rows(held, like)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, like = {}, None
        for batch in batches:
            like = batch.schema
            for key, n, mean, dev in zip(keys_of(batch), *(batch.column(kinds + i).to_pylist() for i in range(3)), strict=True):
                new = n, np.array(mean), np.array(dev)
                held[key] = joined(held[key], new) if key in held else new
        if held:
            yield rows(held, like)

    parts = x.mapInArrow(partial, schema)
    return (parts.repartition(*by) if by else parts.repartition(1)).mapInArrow(merge, schema)
