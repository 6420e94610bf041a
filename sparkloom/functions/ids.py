"""Stable identifiers and seeds from SHA-1, equal in every process and session."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_image_id(path: Column | str) -> Column:
    """First 16 hex digits of a path's SHA-1."""
    return F.substring(F.sha1(path), 1, 16)


def stable_seed(*parts: Column | str) -> Column:
    """The first four SHA-1 bytes of the parts joined by ``|``, as a number below 2**31.  A null part counts as an empty one."""
    text = F.concat_ws("|", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.sha1(text), 1, 8), 16, 10).cast("bigint") % F.lit(2**31)


def hash_rank_key(seed: int | str, key: Column | str) -> Column:
    """Order of a seeded draw: independent of other rows, so one more row reshuffles nothing."""
    return F.sha1(F.concat_ws("|", F.lit(str(seed)), F.col(key) if isinstance(key, str) else key))


def hex_to_long(h: Column | str) -> Column:
    """16 hex digits as a signed 64-bit number."""
    return F.conv(h, 16, -10).cast("bigint")


def manifest_fingerprint(df, *, image_id: str = "image_id", design_id: str = "design_id", split: str = "split"):
    """One row: the first 16 hex digits of the SHA-1 of the rows' sorted (id, design, split) tuples written as Python writes them.

    A digest of one text needs the rows in one place; they are sorted ids, and the caller
    bounds them (a manifest).  For tables of any size ``table_fingerprint`` is combined in parts.
    """
    q = lambda c: F.concat(F.lit("'"), F.col(c), F.lit("'"))
    row = F.concat(F.lit("("), q(image_id), F.lit(", "), q(design_id), F.lit(", "), q(split), F.lit(")"))
    key = F.struct(F.col(image_id), F.col(design_id), F.col(split), row.alias("t"))
    return df.agg(F.transform(F.sort_array(F.collect_list(key)), lambda s: s["t"]).alias("rows")).select(F.substring(F.sha1(F.concat(F.lit("["), F.array_join("rows", ", "), F.lit("]"))), 1, 16).alias("fingerprint"))


def table_fingerprint(df, *columns: str):
    """One row: count and an order-free 64-bit combination of row hashes, by partial sums."""
    h = F.xxhash64(*columns)
    return df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("xor"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("sum"))
