"""Rows dealt out by key so that what one task holds doesn't grow with the table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dealt_out(rows: DataFrame, *keys: str, of: DataFrame, size: Column, most: int) -> DataFrame:
    """The rows dealt out by the keys to so many tasks that each has around ``most`` of the sizes in ``of`` summed up, and no fewer tasks than cores.

    ``of`` is what the rows are made from, cheap to read; rows of one key stay together, however many.
    """
    total = of.agg(F.sum(size)).first()[0] or 0
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(total / most)), *keys)


#: Rows that one task sorts, joins or groups.
ROWS_PER_TASK = 100_000


def in_parts(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """The rows, n or so, dealt out by the keys to tasks of ROWS_PER_TASK, if that takes more of them than the session's shuffles have."""
    parts = math.ceil(n / ROWS_PER_TASK)
    return rows.repartition(parts, *keys) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows
