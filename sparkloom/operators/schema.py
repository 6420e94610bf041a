"""The manifest contract: 22 columns in a fixed order, their types, allowed values and defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the contract.
SCHEMA_VERSION = 3
NO_SEED = -1
SPLITS = ("train", "val", "test")
ROLES = ("train", "gallery", "query")
QUERY_KINDS = ("", "real_view", "real_view_recolored", "synthetic_recolor", "synthetic_tonal")
CONFIDENCES = ("high", "medium", "low")
ENUMS = {"split": SPLITS, "role": ROLES, "query_kind": QUERY_KINDS, "label_confidence": CONFIDENCES}

_S, _B, _L = T.StringType(), T.BooleanType(), T.LongType()
MANIFEST = T.StructType(
    [
        T.StructField(n, t)
        for n, t in (
            ("image_id", _S), ("path", _S), ("source", _S), ("design_id", _S), ("colorway_id", _S), ("dup_group", _S), ("is_representative", _B),
            ("parent_image_id", _S), ("craft_family", _S), ("width", _L), ("height", _L), ("phash", _S), ("split", _S), ("role", _S), ("query_kind", _S),
            ("is_synthetic", _B), ("recolor_method", _S), ("palette_id", _S), ("recolor_seed", _L), ("geo_params", _S), ("label_confidence", _S), ("notes", _S),
        )
    ]
)
COLUMNS = MANIFEST.names
DEFAULTS = {f.name: "" if f.dataType == _S else False if f.dataType == _B else 0 for f in MANIFEST} | {"recolor_seed": NO_SEED, "label_confidence": "medium"}


def conform(df: DataFrame) -> DataFrame:
    """The contract's columns in order, strictly cast; missing ones get their default, columns that begin with ``_`` go."""
    have = set(df.columns)
    return df.select(*[(F.coalesce(F.col(f.name).cast(f.dataType), F.lit(DEFAULTS[f.name])) if f.name in have else F.lit(DEFAULTS[f.name]).cast(f.dataType)).alias(f.name) for f in MANIFEST])


def drop_transient(df: DataFrame) -> DataFrame:
    """Without the columns that begin with ``_``: what a build keeps for itself."""
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def contract(df: DataFrame) -> DataFrame:
    """Projection to the contract; a missing column is an error."""
    if missing := [c for c in COLUMNS if c not in df.columns]:
        raise ValueError(f"manifest lacks columns: {missing}")
    return df.select(*COLUMNS)


def select_rows(df: DataFrame, *, split: str | None = None, role: str | None = None, source: str | None = None, query_kind: str | None = None, include_synthetic: bool = True, representatives_only: bool = False) -> DataFrame:
    """Rows by equality on any of these; None asks for nothing."""
    for column, value in (("split", split), ("role", role), ("source", source), ("query_kind", query_kind)):
        if value is not None:
            df = df.where(F.col(column) == value)
    if not include_synthetic:
        df = df.where(~F.col("is_synthetic"))
    return df.where("is_representative") if representatives_only else df


def label_map(df: DataFrame) -> DataFrame:
    """(design_id, label) of train designs: contiguous numbers in the order of the ids.

    Numbers of a range-partitioned sort, so no single task orders all designs.
    """
    designs = df.where(F.col("split") == "train").select("design_id").distinct()
    return with_index(designs, "design_id", "label")


def with_index(df: DataFrame, order: str, name: str) -> DataFrame:
    """Adds 0, 1, 2, ... in the order of a unique column: places within ranges plus the ranges' sums."""
    from sparkloom.plans.shared import written

    ranged = written(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__p", F.spark_partition_id()), "ranges")
    from pyspark.sql import Window

    inner = ranged.withColumn("__k", F.row_number().over(Window.partitionBy("__p").orderBy(order)))
    sums = ranged.groupBy("__p").agg(F.count("*").alias("__n"))  # one row a partition
    before = sums.alias("a").join(F.broadcast(sums.alias("b")), F.col("a.__p") > F.col("b.__p"), "left").groupBy("a.__p").agg(F.coalesce(F.sum("b.__n"), F.lit(0)).alias("__before"))
    return inner.join(F.broadcast(before), "__p").withColumn(name, F.col("__before") + F.col("__k") - 1).drop("__p", "__k", "__before")
