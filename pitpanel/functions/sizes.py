"""Checked size bounds: nothing is broadcast or left in one task on trust."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ONE_TASK_BYTES = 256 << 20
BROADCAST_BYTES = 32 << 20


LEAF_GROWTH = 16  # allowance for decompression and row growth over the scanned bytes


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan (a gross over-estimate for joins)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def scanned_bytes(df: DataFrame) -> int:
    """Bytes of the distinct inputs of a plan (a table that is scanned twice counts once)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = {}
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        name = re.sub(r"#\d+L?", "", leaf.simpleString(1000)).split("[")[0] + str(leaf.stats().sizeInBytes())
        sizes[name] = int(str(leaf.stats().sizeInBytes()))
    return sum(sizes.values())


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only when the estimate is below ``limit``; otherwise Spark (AQE) chooses."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def fits_one_task(df: DataFrame, limit: int = ONE_TASK_BYTES) -> bool:
    """True when the whole frame is small, so that even its hottest group fits one task."""
    return min(estimated_bytes(df), LEAF_GROWTH * scanned_bytes(df)) <= limit
