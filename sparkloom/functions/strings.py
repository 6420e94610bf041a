"""String operators on names and paths of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns and words that results depend on.
EXPORT_NAME = r"(?i)^(.*?)_(?:jpg|jpeg|png)\.rf\.[0-9a-f]+$"
GENERIC_NAME = r"(?i)^(?:image|images|img|download|untitled|photo)[-_ ]?[0-9]*$"
TRAILING_INDEX = r"[\s._\-(]*[0-9]+\)?$"
COLOUR_WORDS = (
    "red", "blue", "green", "yellow", "pink", "purple", "violet", "orange", "brown", "black", "white", "grey", "gray", "gold", "golden", "silver",
    "maroon", "navy", "teal", "turquoise", "cyan", "magenta", "beige", "cream", "ivory", "peach", "mustard", "olive", "lavender", "lilac", "coral",
    "rust", "wine", "rani", "firozi", "mehendi", "sandal", "copper", "bronze", "multicolor", "multi",
)
#: Longer words first, so that a shorter one never hides a longer one.
_COLOURS = r"(?i)(?<![a-z])(?:" + "|".join(sorted(COLOUR_WORDS, key=lambda w: (-len(w), w))) + r")(?![a-z])"
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tif", ".tiff")


def file_stem(path: Column) -> Column:
    """The last part of a path without its last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"[^/]*$", 0), r"(?<=.)\.[^.]*$", "")


def export_stem(path: Column) -> Column:
    """The original stem inside an exported file name, else the stem."""
    stem = file_stem(path)
    return F.when(stem.rlike(EXPORT_NAME), F.regexp_extract(stem, EXPORT_NAME, 1)).otherwise(stem)


def is_generic(stem: Column) -> Column:
    return stem.rlike(GENERIC_NAME)


def has_colour_word(text: Column) -> Column:
    """Whether a colour word stands in the text without a letter at either side."""
    return text.rlike(_COLOURS)


def strip_index(stem: Column) -> Column:
    """Without a trailing number; the stem itself if nothing would be left."""
    cut = F.regexp_replace(stem, TRAILING_INDEX, "")
    return F.when(cut == "", stem).otherwise(cut)


def strip_colours(stem: Column) -> Column:
    """Without colour words, with single separators and without a trailing number."""
    out = F.regexp_replace(stem, _COLOURS, "")
    out = F.regexp_replace(F.btrim(F.regexp_replace(out, r"[\s._\-]{2,}", "_"), F.lit("._- ")), TRAILING_INDEX, "")
    return F.when(out == "", stem).otherwise(out)


def parent_key(path: Column) -> Column:
    """The directory of a path, ``<root>`` for none."""
    return F.when(F.instr(path, "/") == 0, F.lit("<root>")).otherwise(F.regexp_replace(path, r"/[^/]*$", ""))


def top_key(path: Column) -> Column:
    return F.when(F.instr(path, "/") == 0, F.lit("<root>")).otherwise(F.substring_index(path, "/", 1))


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]*$", 0))


def shared_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two names."""
    n = F.least(F.length(a), F.length(b))
    steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(0), lambda acc, i: F.when((acc == i - 1) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), i).otherwise(acc))


def candidate_keys(df: DataFrame, path: str = "path") -> DataFrame:
    """For each of four ways to group files (K1 directory, K2 top directory, K3 stem without number, K4 without colours too): groups, groups of several, the largest."""
    p = F.col(path)
    keys = F.array(*[F.struct(F.lit(k).alias("keyer"), v.alias("key")) for k, v in (("K1", parent_key(p)), ("K2", top_key(p)), ("K3", strip_index(file_stem(p))), ("K4", strip_colours(file_stem(p))))])
    sizes = df.where(p.isNotNull()).select(F.explode(keys).alias("k")).groupBy("k.keyer", "k.key").agg(F.count("*").alias("n"))
    return sizes.groupBy("keyer").agg(F.count("*").alias("n_groups"), F.count_if(F.col("n") > 1).alias("n_multi"), F.max("n").alias("largest"), F.sum("n").alias("n_files"))


def join_notes(*notes: Column) -> Column:
    return F.concat_ws("; ", *[F.when(n != "", n) for n in notes])


def format_ci(value: Column, low: Column, high: Column) -> Column:
    return F.format_string("%.3f [%.3f, %.3f]", value, low, high)


def parse_ci(text: Column) -> Column:
    """``0.913 [0.878, 0.943]`` as a struct of three doubles; any other text raises."""
    form = r"^\s*(-?[0-9.]+)\s*\[\s*(-?[0-9.]+)\s*,\s*(-?[0-9.]+)\s*\]\s*$"
    part = lambda k: F.regexp_extract(text, form, k).cast("double")
    good = F.struct(part(1).alias("value"), part(2).alias("low"), part(3).alias("high"))
    return F.when(text.rlike(form), good).otherwise(F.raise_error(F.concat(F.lit("no confidence interval: "), F.coalesce(text, F.lit("null")))).cast("struct<value:double,low:double,high:double>"))


def palette_band(distance: Column, same: float = 0.15, different: float = 0.45) -> Column:
    """NaN-safe: NaN equals and exceeds everything in Spark, so it is asked for first."""
    return F.when(distance.isNull() | F.isnan(distance), "unmeasurable").when(distance < same, "same").when(distance >= different, "different").otherwise("ambiguous")


def audit_verdict(ncc: Column, cosine: Column, same: float = 0.90, eyes: float = 0.93) -> Column:
    return F.when(~F.isnan(ncc) & (ncc >= same), "SAME").when(~F.isnan(cosine) & (cosine >= eyes), "NEEDS EYES").otherwise("DIFFERENT")
