"""Schedules as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def warmup_cosine(step: Column, total: int, warmup_share: float) -> Column:
    """Factor of a learning rate: rises linearly over the first steps, then falls to zero along half a cosine."""
    first = max(1, int(total * warmup_share))
    done = F.least(F.lit(1.0), (step - first) / float(max(1, total - first)))
    return F.when(step < first, (step + 1) / float(first)).otherwise(0.5 * (1 + F.cos(F.lit(3.141592653589793) * done)))
