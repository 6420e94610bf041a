"""Arrow maps over (id, text) columns, slice by slice."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import textkit


#: Bytes of an Arrow batch: one is in memory several times, in the JVM and in the worker, for every task.
BATCH_BYTES, BATCH_KEY = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def arrow_map(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow in batches of about ``BATCH_BYTES``; the setting is the session's, and one that the session has already stays."""
    spark = df.sparkSession
    if not spark._jsparkSession.sessionState().conf().contains(BATCH_KEY):
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def map_text(df: DataFrame, id_col: str, text_col: str, make: Callable[[pa.Array, pa.Array, textkit.Slice], dict | None], schema: str, *more: str) -> DataFrame:
    """Maps documents to rows.

    make gets the ids, the texts and the word kernel of one slice (and, as arrays, the columns
    in more) and returns columns by name.  Only the columns asked for leave the JVM; text of a
    row is never split over slices.
    """
    fields = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, s in textkit.slices(b.column(1)):
                out = make(b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), s, *[b.column(2 + k).slice(i, j - i) for k in range(len(more))])
                if out is not None:
                    yield pa.RecordBatch.from_arrays([out[f] if isinstance(out[f], pa.Array) else pa.array(out[f]) for f in fields], names=fields)

    # Under other names, so that columns with clashing names can't disturb.
    return arrow_map(df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"), *[F.col(c).alias(f"__{k}") for k, c in enumerate(more)]), run, schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def strings(column: pa.Array) -> list[str]:
    """Texts as Python strings, null as empty."""
    return [x or "" for x in column.to_pylist()]


def int64(values) -> pa.Array:
    return pa.array(np.asarray(values, np.int64))
