"""Readers and writers of manifests, configuration and reports."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable
from typing import TypeVar

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.ids import manifest_fingerprint
from sparkloom.operators import schema, summary
from sparkloom.operators.audit import exclusion_counts
from sparkloom.plans.shared import written

C = TypeVar("C")


# ---------------------------------------------------------------- readers


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest from Parquet or CSV.

    CSV loses the difference of empty and null: texts are filled with "", which the contract means.
    """
    if not path.rstrip("/").endswith(".csv"):
        return schema.contract(spark.read.parquet(path))
    # Booleans are written True and False by some programs, so they are read as text and cast.
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return schema.conform(schema.contract(df.select(*df.columns)).na.fill(""))


def read_yaml(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def config_of(kind: type[C], values: dict) -> C:
    """A frozen dataclass from a mapping; a key that no field reads is an error, not silence."""
    known = {f.name for f in dataclasses.fields(kind)}
    if unknown := sorted(set(values) - known):
        raise ValueError(f"{kind.__name__}: unknown keys {unknown}")
    return kind(**values)


def read_json(spark: SparkSession, path: str, fields: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(fields) if fields else reader).json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path) of a newline list without blank lines."""
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")


def read_pair_verdicts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("image_id_a string, image_id_b string, decision string").csv(path)


def exclusion_links(spark: SparkSession, doc: dict) -> tuple[DataFrame, DataFrame, float]:
    """Links, audited ids and the rule's cosine of an exclusion document; one keyed by design is refused."""
    if doc.get("keyed_by") != "image_id":
        raise ValueError("exclusion links must be keyed by image_id; design ids change between builds")
    form = "test_image_id string, other_image_id string, kind string, audit_numbering string"
    links = [(x["test_image_id"], x["other_image_id"], x.get("kind", ""), x.get("audit_numbering", "")) for x in doc.get("links") or []]
    rule = float((doc.get("rule") or {}).get("unreviewed_nearest_train_cosine_min", 0.90))
    return spark.createDataFrame(links, form), spark.createDataFrame([(x,) for x in doc.get("audited_test_image_ids") or []], "image_id string"), rule


def peek(spark: SparkSession, path: str) -> dict:
    """What a candidate label file holds: columns and rows of a table, keys of JSON, else its first lines."""
    low = path.lower()
    if low.endswith((".csv", ".tsv")):
        df = spark.read.option("header", True).option("sep", "\t" if low.endswith(".tsv") else ",").csv(path)
        return {"columns": df.columns, "rows": df.count()}
    if low.endswith((".json", ".jsonl")):
        df = spark.read.option("multiLine", low.endswith(".json")).json(path)
        return {"keys": df.columns, "rows": df.count()}
    return {"lines": [r.value for r in spark.read.text(path).limit(3).collect()]}


# ---------------------------------------------------------------- writers


def write_manifest(df: DataFrame, path: str, csv: str | None = None) -> None:
    out = schema.conform(schema.contract(df))
    out.write.mode("overwrite").parquet(path)
    if csv:
        out.write.mode("overwrite").option("header", True).option("escape", '"').csv(csv)


def label_map_json(labels: DataFrame) -> str:
    """The label map's document; one entry a train design."""
    return json.dumps({"schema_version": schema.SCHEMA_VERSION, "label_map": {r.design_id: r.label for r in labels.orderBy("design_id").toLocalIterator()}})


def with_placeholder(df: DataFrame) -> DataFrame:
    """The rows, or one that says none where there are none."""
    first = df.schema.fields[0].name
    none = df.sparkSession.range(1).select(*[(F.lit("none") if f.name == first and f.dataType == T.StringType() else F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema])
    empty = df.limit(1).agg(F.count("*").alias("n")).where("n = 0")
    return df.unionByName(none.join(empty.select(F.lit(1).alias("__k")), F.lit(True), "left_semi"))


def write_csv(df: DataFrame, path: str) -> None:
    with_placeholder(df).write.mode("overwrite").option("header", True).csv(path)


def markdown_table(df: DataFrame, most: int | None = None) -> str:
    """A report's table of aggregates, row by row from the executors; ``most`` is for tables that are top-k reports."""
    rows = (df if most is None else df.limit(most)).toLocalIterator()
    line = lambda cells: "| " + " | ".join("" if c is None else f"{c:.4g}" if isinstance(c, float) else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *[line(r) for r in rows]])


def data_summary(manifest: DataFrame, dead: DataFrame) -> str:
    """Markdown of seven sections: totals, source by split, families, group sizes, queries, sizes, dead letters."""
    designs = manifest.where("NOT is_synthetic").groupBy("design_id").agg(F.min_by("craft_family", "path").alias("craft_family"), F.min("split").alias("split"))
    real = manifest.where("NOT is_synthetic")
    parts = (
        ("Totals", manifest.agg(F.count("*").alias("rows"), F.count_distinct("design_id").alias("designs"), F.count_if("is_synthetic").alias("synthetic"))),
        ("Source by split", summary.split_summary(manifest).orderBy("source", "split")),
        ("Family by split", summary.family_pivot(designs).orderBy("craft_family")),
        ("Images per design", summary.size_histogram(real, "design_id").orderBy("size")),
        ("Query composition", summary.query_composition(manifest).orderBy("split", "query_kind")),
        ("Image sizes", summary.size_stats(real)),
        ("Files no rule claimed", dead.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")),
    )
    return "\n\n".join(f"## {title}\n\n{markdown_table(df)}" for title, df in parts) + "\n"


def resolved_exclusions(found: DataFrame, manifest: DataFrame, rule: float) -> dict:
    """The document of resolved exclusions, with the fingerprint of the manifest it holds for."""
    out = found.where(F.col("reason").isin("link", "rule"))  # what the document lists; those kept are only counted
    link, ruled = ([r.design_id for r in out.where(F.col("reason") == k).orderBy("design_id").toLocalIterator()] for k in ("link", "rule"))
    c = exclusion_counts(found).first()
    counts = {"test_designs": c.test_designs, "reviewed_excluded": c.link, "rule_excluded": c.rule, "reviewed_kept": c.kept_reviewed, "unreviewed_kept": c.kept_unreviewed}
    counts["final_test_designs"] = c.final_test_designs
    return {"manifest_fingerprint": manifest_fingerprint(manifest.where("NOT is_synthetic")).first().fingerprint, "excluded": link + ruled, "reviewed_excluded": link, "rule_excluded": ruled, "rule_threshold": rule, "counts": counts}


def reuse_exclusions(doc: dict, manifest: DataFrame) -> list[str]:
    """Excluded designs of a document, if it was made for this manifest."""
    now = manifest_fingerprint(manifest.where("NOT is_synthetic")).first().fingerprint
    if doc["manifest_fingerprint"] != now:
        raise ValueError(f"exclusions were resolved for manifest {doc['manifest_fingerprint']}, this is {now}")
    return doc["excluded"]


def links_yaml(links: DataFrame, audited: list[str], rule: float = 0.90) -> str:
    import yaml

    rows = [r.asDict() for r in links.orderBy("test_image_id", "other_image_id").toLocalIterator()]
    return yaml.safe_dump({"version": 2, "keyed_by": "image_id", "rule": {"unreviewed_nearest_train_cosine_min": rule}, "links": rows, "audited_test_image_ids": sorted(audited)}, sort_keys=False)


AUDIT_COLUMNS = ("test_path", "test_design", "nearest_train_path", "nearest_train_design", "cosine", "method")
MINED_COLUMNS = ("idx", "cosine_gray", "hue_l1", "design_a", "design_b", "family_a", "family_b", "split_a", "split_b", "path_a", "path_b")


def write_leakage_audit(audit: DataFrame, manifest: DataFrame, path: str, method: str) -> DataFrame:
    """The audit (image_id, nearest_image_id, cosine) with paths and designs as CSV, highest cosine first."""
    side = lambda c, p: manifest.select(F.col("image_id").alias(c), F.col("path").alias(f"{p}_path"), F.col("design_id").alias(f"{p}_design"))
    rows = audit.join(side("image_id", "test"), "image_id").join(side("nearest_image_id", "nearest_train"), "nearest_image_id")
    out = rows.withColumns({"cosine": F.bround("cosine", 4), "method": F.lit(method)}).select(*AUDIT_COLUMNS).orderBy(F.desc("cosine"), "test_path")
    write_csv(out, path)
    return out


def write_mined_pairs(numbered: DataFrame, images: DataFrame, path: str) -> DataFrame:
    """Numbered pairs (idx, i, j, cosine, hue_l1) with what people need to judge them, as CSV; images: (id, design_id, craft_family, split, path)."""
    side = lambda c, p: images.select(F.col("id").alias(c), F.col("design_id").alias(f"design_{p}"), F.col("craft_family").alias(f"family_{p}"), F.col("split").alias(f"split_{p}"), F.col("path").alias(f"path_{p}"))
    out = numbered.withColumnRenamed("cosine", "cosine_gray").join(side("i", "a"), "i").join(side("j", "b"), "j").select(*MINED_COLUMNS).orderBy("idx")
    write_csv(out, path)
    return out


def write_verdicts(rows: DataFrame, path: str) -> None:
    """Audit verdicts (or review flags) as CSV; a row that says none where there are none."""
    write_csv(rows, path)


def write_synthetic(drawn: DataFrame, path: str) -> None:
    """Drawn images as a table (image_id, path, geo_params, content), whose paths are those of the manifest's synthetic rows."""
    drawn.write.mode("overwrite").option("compression", "zstd").parquet(path)


def append_missing(wanted: DataFrame, cache: str, make: Callable[[DataFrame], DataFrame], key: str = "key") -> int:
    """Makes the results that the cache table lacks and appends them; how many keys were missing."""
    try:
        have = wanted.sparkSession.read.parquet(cache)
    except AnalysisException:  # no such table yet
        have = wanted.limit(0)
    missing = written(missing_keys(wanted, have, key), "missing")
    n = missing.count()
    if n:
        make(missing).write.mode("append").parquet(cache)
    return n


def missing_keys(wanted: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Rows whose result a cache table lacks."""
    return wanted.join(cache.select(key), key, "left_anti")
