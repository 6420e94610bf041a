"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Templates are identifier lines, statements, headers and bodies of common licences
(``licence_texts``).  Segments of a text that can state a licence (each line with a cue,
each paragraph with one, and the whole text) become sparse term vectors, term counts
weighted by inverse frequency over the templates; words that no template has count with
the highest weight, so prose around a statement lowers the cosine.  The best template of a
segment from 0.6 is a finding; a file's licence is that of its widest segment with a
finding (a body of several paragraphs says more than one of them), of equals the best.  A file whose whole text is a finding,
or whose name says so (LICENSE, COPYING, ...), is a licence file and covers its directory:
files without a finding take the licence of the nearest ancestor directory that has one.

Only DataFrame operations; no Python runs on executors.

Defined cases: null or empty texts have no finding (but inherit); a null path has no
directory; rows with a null id are returned without a licence of their own; rows with equal
ids share their findings; ties go to the template first by name; of several licence files of a directory the best counts, then the first
by name; further columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.licence_texts import TEMPLATES
from sparkloom.plans.shared import join_by_size, written

LEAST_COSINE = 0.6
#: Directories with a licence up to which the list is broadcast, by count.
MAX_BROADCAST_DIRS = 200_000

# Of these a segment must hold one to count as a statement (every template does); the names of licence files.
CUES = ("licen", "copyright", "spdx", "redistribut", "public domain", "permission", "warrant", "gpl", "cc by", "cc0", "creative commons", "neither the name")
FILE_NAMES = "licen[cs]e|copying|unlicense|notice|copyright"
TERM = "[a-z]+|[0-9]+(?:\\.[0-9]+)*"


def weights(templates=TEMPLATES) -> tuple[list[tuple[str, float]], list[tuple[int, str, str, float]], float]:
    """Inverse frequencies of the templates' terms; the templates' unit vectors (template, licence, term, weight); the weight of other words."""
    import math

    bags = []
    for name, text in templates:
        counts: dict[str, int] = {}
        for t in re.findall(TERM, text.lower()):
            counts[t] = counts.get(t, 0) + 1
        bags.append((name, counts))
    df: dict[str, int] = {}
    for _, bag in bags:
        for t in bag:
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log((1 + len(bags)) / (1 + n)) + 1 for t, n in df.items()}
    units = []
    for k, (name, bag) in enumerate(bags):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in bag.items()))
        units += [(k, name, t, n * idf[t] / norm) for t, n in sorted(bag.items())]
    return sorted(idf.items()), units, math.log(1 + len(bags)) + 1


def has_cue(low: Column) -> Column:
    out = F.contains(low, F.lit(CUES[0]))
    for c in CUES[1:]:
        out = out | F.contains(low, F.lit(c))
    return out


def findings(files: DataFrame, templates=TEMPLATES, least: float = LEAST_COSINE) -> DataFrame:
    """(id, licence, cosine, kind) of segments that match; files: (id, text)."""
    spark: SparkSession = files.sparkSession
    idf, units, other = weights(templates)
    idf = F.broadcast(spark.createDataFrame(idf, "term string, idf double"))  # of the templates, whose number is fixed
    units = F.broadcast(spark.createDataFrame(units, "template int, licence string, term string, unit double"))
    low = files.where(F.col("id").isNotNull()).select("id", F.lower("text").alias("low")).where(has_cue(F.col("low")))
    part = lambda kind, pieces: F.transform(F.filter(pieces, has_cue), lambda x: F.struct(F.lit(kind).alias("kind"), F.trim(x).alias("seg")))
    segs = low.select("id", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("kind"), F.trim("low").alias("seg"))), part(1, F.split("low", "\n[ \t\r]*\n")), part(2, F.split("low", "\n")))).alias("s"))
    # The same segment in several shapes or places counts once, as its widest shape.
    segs = segs.groupBy("id", F.col("s.seg").alias("seg")).agg(F.min("s.kind").alias("kind")).withColumn("seg_no", F.xxhash64("seg"))
    terms = segs.select("id", "kind", "seg_no", F.explode(F.regexp_extract_all("seg", F.lit(TERM), F.lit(0))).alias("term"))
    tf = terms.groupBy("id", "kind", "seg_no", "term").agg(F.count("*").alias("n"))
    tf = tf.join(idf, "term", "left").withColumn("w", F.col("n") * F.coalesce("idf", F.lit(other)))
    norms = tf.groupBy("id", "kind", "seg_no").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = tf.join(units, "term").groupBy("id", "kind", "seg_no", "template", "licence").agg(F.sum(F.col("w") * F.col("unit")).alias("dot"))
    scored = dots.join(norms, ["id", "kind", "seg_no"]).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("cosine") >= least)
    best = scored.groupBy("id", "kind", "seg_no").agg(F.min_by(F.struct("licence", "cosine"), F.struct(-F.col("cosine"), "licence")).alias("b"))
    return best.select("id", "kind", "b.licence", "b.cosine")


def parent(path: Column) -> Column:
    """The directory of a path, empty for none."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(files: DataFrame, *, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", templates=TEMPLATES, least: float = LEAST_COSINE) -> DataFrame:
    """Per row: id, path, licence, cosine, origin (declared, inherited or null), licences (all that are found in it)."""
    rows = files.select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    found = findings(rows.select("id", "text"), templates, least)
    own = found.groupBy("id").agg(F.min_by(F.struct("licence", "cosine"), F.struct("kind", -F.col("cosine"), "licence")).alias("b"), F.sort_array(F.collect_set("licence")).alias("licences"), (F.min("kind") == 0).alias("whole"))
    own = written(own.select("id", "b.licence", "b.cosine", "licences", "whole"), "licences")
    names = rows.select("id", "path")
    files_of = names.join(own, "id", "left")
    named = F.lower(F.regexp_extract("path", "[^/]*$", 0)).rlike(f"^(?:{FILE_NAMES})(?:[._-].*)?$")
    covers = names.join(own, "id").where(F.col("path").isNotNull() & (F.col("whole") | named)).groupBy(parent(F.col("path")).alias("root")).agg(F.min_by("licence", F.struct(-F.col("cosine"), "path", "licence")).alias("inherited"))
    covers = written(covers, "covers")

    dirs = names.where(F.col("path").isNotNull()).select(parent(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    up = dirs.select("dir", F.explode(F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))))).alias("root"))
    if covers.count() <= MAX_BROADCAST_DIRS:
        met = up.join(F.broadcast(covers), "root")
    else:  # every directory meets the top ones
        met = join_by_size(up, up.groupBy("root").agg(F.count("*").alias("size")).join(covers, "root"), ["root"], "size", "roots")
    near = met.groupBy("dir").agg(F.max_by("inherited", F.length("root")).alias("inherited"))
    near = written(near, "nearest")
    few = near.count() <= MAX_BROADCAST_DIRS
    out = files_of.withColumn("dir", parent(F.col("path"))).join(F.broadcast(near) if few else near, "dir", "left")
    origin = F.when(F.col("licence").isNotNull(), "declared").when(F.col("inherited").isNotNull(), "inherited")
    return out.select(F.col("id").alias(id_col), "path", F.coalesce("licence", "inherited").alias("licence"), "cosine", origin.alias("origin"), F.coalesce("licences", F.array().cast("array<string>")).alias("licences"))
