"""Adapters from folders of images to manifest records; whatever no rule claims goes to dead letters."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import pixels, strings
from sparkloom.functions.ids import stable_image_id
from sparkloom.operators.curation import seeded_sample

# Fixed value: the folder that archivers leave behind.
ARCHIVE_NOISE = r"(?:^|/)__MACOSX/"
DEAD_LETTER = "path string, source string, reason string"


@dataclass(frozen=True)
class SourceConfig:
    key: str
    root: str
    adapter: str = "flat"
    glob: str = "*"
    enabled: bool = True
    label_confidence: str = "medium"
    craft_family: str = ""
    strip_prefixes: tuple[str, ...] = ()
    family_index: int = 1
    vendor_dirs: tuple[str, ...] = field(default=("train", "valid", "test"))


def list_files(spark: SparkSession, root: str, glob: str = "*", *, noise: bool = True) -> DataFrame:
    """(path below root, length, suffix) of all files; hidden files and folders are left out, without ``noise`` what archivers leave behind as well.

    Only paths and lengths are selected, so no file's bytes are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", "length")
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    rel = F.substring(F.regexp_replace("path", r"^[a-z]+:/*", "/"), len(base) + 2, 1 << 30)
    return files.select(rel.alias("path"), "length").where(~F.col("path").rlike(r"(^|/)\.")).withColumn("suffix", strings.suffix(F.col("path"))).where(F.lit(noise) | ~F.col("path").rlike(ARCHIVE_NOISE))


class Adapter(Protocol):
    """What turns the readable images of a source into manifest records and, perhaps, dead letters."""

    def __call__(self, images: DataFrame, cfg: SourceConfig) -> tuple[DataFrame, DataFrame | None]: ...


def decode_check(images: DataFrame, sample: int, seed: int = 0) -> DataFrame:
    """(path) of those images of a seeded sample that can't be decoded; images: (path, image)."""
    return seeded_sample(images.select("path", "image.height"), "path", sample, seed).where("height <= 0").select("path")


def read_images(spark: SparkSession, cfg: SourceConfig) -> tuple[DataFrame, DataFrame]:
    """(path, width, height, phash) of readable images, and dead letters of other and unreadable files."""
    files = list_files(spark, cfg.root, cfg.glob)
    wanted = F.col("suffix").isin(*strings.IMAGE_SUFFIXES)
    ext = F.regexp_extract("path", r"\.[^./]*$", 0)
    other = files.where(~wanted).select("path", F.lit(cfg.key).alias("source"), F.concat(F.lit("not an image extension ("), ext, F.lit(")")).alias("reason"))
    base = cfg.root.rstrip("/").split("://")[-1].removeprefix("file:")
    raw = spark.read.format("image").option("recursiveFileLookup", True).option("pathGlobFilter", cfg.glob).load(cfg.root)
    origin = F.url_decode(F.replace(F.col("image.origin"), F.lit("+"), F.lit("%2B")))  # this source escapes paths
    path = F.substring(F.regexp_replace(origin, r"^[a-z]+:/*", "/"), len(base) + 2, 1 << 30)
    raw = raw.withColumn("path", path).where(~F.col("path").rlike(r"(^|/)\.") & strings.suffix(F.col("path")).isin(*strings.IMAGE_SUFFIXES))
    bad = F.col("image.height") <= 0
    broken = raw.where(bad).select("path", F.lit(cfg.key).alias("source"), F.lit("unreadable: not decoded").alias("reason"))
    good = raw.where(~bad).select("path", F.col("image.width").cast("long").alias("width"), F.col("image.height").cast("long").alias("height"), pixels.image_column(pixels.perceptual_hash, "string").alias("phash"))
    return good, other.unionByName(broken)


def _record(rows: DataFrame, cfg: SourceConfig, **columns) -> DataFrame:
    out = rows.withColumns({"image_id": stable_image_id(F.col("path")), "source": F.lit(cfg.key), "label_confidence": F.lit(cfg.label_confidence)} | columns)
    return out.select("image_id", "path", "source", "craft_family", "width", "height", "phash", "label_confidence", "notes", "hints")


def flat(images: DataFrame, cfg: SourceConfig) -> tuple[DataFrame, DataFrame | None]:
    """One folder: the first configured prefix of a name is stripped and noted."""
    stem, note, cut = strings.file_stem(F.col("path")), F.lit(""), strings.file_stem(F.col("path"))
    for p in reversed(cfg.strip_prefixes):
        hit = F.startswith(stem, F.lit(p))
        cut = F.when(hit, F.substring(stem, len(p) + 1, 1 << 30)).otherwise(cut)
        note = F.when(hit, F.lit(f"prefix '{p}' left out of the stem")).otherwise(note)
    return _record(images, cfg, craft_family=F.lit(cfg.craft_family), notes=note, hints=F.create_map(F.lit("stem"), cut)), None


def hierarchical(images: DataFrame, cfg: SourceConfig) -> tuple[DataFrame, DataFrame | None]:
    """Folders by vendor split and family: the split is noted and ignored, the family is a path part."""
    parts = F.split("path", "/")
    deep = F.size(parts) > cfg.family_index
    shallow = images.where(~deep).select("path", F.lit(cfg.key).alias("source"), F.lit(f"no family folder: fewer than {cfg.family_index + 1} parts in the path").alias("reason"))
    rows = images.where(deep)
    first = F.get(parts, F.lit(0))
    vendor = F.when(first.isin(*cfg.vendor_dirs), first).otherwise("")
    stem, whole = strings.export_stem(F.col("path")), strings.file_stem(F.col("path"))
    generic = strings.is_generic(stem)
    notes = strings.join_notes(
        F.when(vendor != "", F.concat(F.lit("folder '"), vendor, F.lit("' is no split of ours"))).otherwise(""),
        F.when(~whole.rlike(strings.EXPORT_NAME), F.lit("no export name")).otherwise(""),
        F.when(generic, F.concat(F.lit("stem '"), stem, F.lit("' names no design"))).otherwise(""),
    )
    hints = F.create_map(F.lit("stem"), stem, F.lit("generic_stem"), generic.cast("string"), F.lit("vendor_split"), vendor)
    return _record(rows, cfg, craft_family=F.get(parts, F.lit(cfg.family_index)), notes=notes, hints=hints), shallow


ADAPTERS: dict[str, Adapter] = {"flat": flat, "hierarchical": hierarchical}


def get_adapter(name: str):
    if name not in ADAPTERS:
        raise KeyError(f"unknown adapter {name!r}; known: {sorted(ADAPTERS)}")
    return ADAPTERS[name]


def build_records(spark: SparkSession, sources: list[SourceConfig]) -> tuple[DataFrame, DataFrame]:
    """Records and dead letters of all enabled sources."""
    records, letters = [], [spark.createDataFrame([], DEAD_LETTER)]
    for cfg in sources:
        if not cfg.enabled:
            continue
        images, dead = read_images(spark, cfg)
        rows, more = get_adapter(cfg.adapter)(images, cfg)
        records.append(rows)
        letters += [dead] + ([more] if more is not None else [])
    if not records:
        raise ValueError("no source is enabled")
    return reduce(DataFrame.unionByName, records), reduce(DataFrame.unionByName, letters)
