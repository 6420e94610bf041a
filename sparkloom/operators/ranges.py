"""Running sums and quantiles over a sorted order of any length, without one task that holds all of it.

Rows are range-partitioned by their value; sums run inside a partition, and a table of one row
a partition (and group) says what came before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.plans.shared import written


def running(counts: DataFrame, value: str, sums: list[str], by: tuple[str, ...] = (), descending: bool = False, reuse: bool = False) -> DataFrame:
    """Adds, in the order of a value that occurs once (in each group): place from 1, and for each column x of sums
    x_run (sum up to here), x_all (sum of all) and x_next (of the next row; null for the last).

    reuse: the result is written, so that several metrics read it.
    """
    order = F.desc(value) if descending else F.asc(value)
    ranged = written(counts.repartitionByRange(*by, order).withColumn("__part", F.spark_partition_id()), "ranges")
    w = Window.partitionBy(*by, "__part").orderBy(order)
    # One row a partition and group.
    first = F.struct(F.col(value), *[F.col(x) for x in sums])
    ends = ranged.groupBy(*by, "__part").agg(F.count("*").alias("__rows"), (F.max_by(first, value) if descending else F.min_by(first, value)).alias("__first"), *[F.sum(x).alias(f"__{x}") for x in sums])
    up = Window.partitionBy(*by).orderBy("__part")
    before, every = up.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    ends = ends.select(
        *by, "__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__place"), F.lead("__first").over(up).alias("__after"),
        *[F.coalesce(F.sum(f"__{x}").over(before), F.lit(0)).alias(f"__{x}_before") for x in sums], *[F.sum(f"__{x}").over(every).alias(f"{x}_all") for x in sums],
    )
    inner = ranged.withColumns({f"{x}_run": F.sum(x).over(w) for x in sums} | {f"{x}_next": F.lead(x).over(w) for x in sums} | {"place": F.row_number().over(w)})
    met = inner.join(F.broadcast(ends), [*by, "__part"])  # partitions x groups rows
    out = [*[F.col(c) for c in counts.columns], (F.col("place") + F.col("__place")).alias("place")]
    for x in sums:
        out += [(F.col(f"{x}_run") + F.col(f"__{x}_before")).alias(f"{x}_run"), F.col(f"{x}_all"), F.coalesce(f"{x}_next", F.col(f"__after.{x}")).alias(f"{x}_next")]
    return written(met.select(*out), "running") if reuse else met.select(*out)


def quantiles(rows: DataFrame, value: str, shares: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """One row (a group): quantiles by name, interpolated linearly between the two nearest ranks; null without values."""
    c = running(rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c")), value, ["c"], by)

    def at(q: float):
        rank = F.lit(q) * (F.col("c_all") - 1)
        value_at = lambda r: F.min(F.when(F.col("c_run") > r, F.col(value).cast("double")))
        low, high = value_at(F.floor(rank)), value_at(F.ceil(rank))
        part = F.max(rank - F.floor(rank))
        return low + (high - low) * part

    return c.groupBy(*by).agg(*[at(q).alias(name) for name, q in shares.items()])
