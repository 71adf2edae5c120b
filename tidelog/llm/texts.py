"""Reading text columns: spread over the cores, in Arrow batches cut small enough for a worker's memory."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` on at least as many partitions as there are cores; only an input of fewer is shuffled."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def slices(batches: Iterator[pa.RecordBatch], most_chars: int, most_rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with at most ``most_rows`` rows and about ``most_chars`` bytes of column 1 (a longer single text comes alone)."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()
        start = total = 0
        for i, s in enumerate(sizes):
            if i > start and (total + s > most_chars or i - start >= most_rows):
                yield b.slice(start, i - start)
                start, total = i, 0
            total += s
        yield b.slice(start)
