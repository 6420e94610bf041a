"""Benchmark decontamination by template windows.

Texts become templates: names (capitalised words inside a sentence), numbers and
units of measure turn into typed placeholders, the rest into lower-case words.  So a
question with other numbers or names has the same template.

1. Every window of a benchmark item's template is hashed.  Documents are probed with
   windows at every word, as an item may be held in fragments of one window each; a hash
   join gives the documents that can hold an item.
2. Of these documents all windows are matched.  Matches on one diagonal (place in the
   document less place in the item) are one occurrence; it counts if its slots are
   consistent: equal values of the item stand for equal values of the document and
   different for different.
3. A document holds an item if consistent occurrences match at least 0.6 of its windows.

Items of 8 to 10 words have windows of five words, shorter ones (three at least) are one
window as a whole.

Only DataFrame operations; no Python runs on executors.

Defined cases: null or empty texts match nothing; rows with a null id are not judged
(and stay in ``clean``); rows with equal ids count as one document; an item repeated under
one id adds its windows; items of under three words are left out; an empty benchmark
leaves every document clean; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.arrowmap import fresh
from sparkloom.plans.shared import is_small, written

WINDOW, LONG_WORDS, LEAST_SHARE = 8, 11, 0.6
SHORT_WINDOW, LEAST_WORDS = 5, 3
#: Benchmark windows (with tokens; some 60 MB), and candidate documents, up to which a list is broadcast, by count.
MAX_BROADCAST_WINDOWS, MAX_BROADCAST_IDS = 200_000, 200_000
#: Parts into which the documents with one window are dealt if the index is too large to broadcast.
SALTS = 16

# The placeholders' marks (private-use characters) and the units of measure.
OPEN, CLOSE = "\ue000", "\ue001"
UNITS = (
    "kilograms?|kg|grams?|mg|kilometers?|kilometres?|km|meters?|metres?|centimeters?|centimetres?|cm|mm|miles?|inches|inch|feet|foot|ft|yards?|"
    "hours?|hrs?|minutes?|mins?|seconds?|secs?|days?|weeks?|months?|years?|dollars?|cents?|euros?|pounds?|lbs?|ounces?|oz|liters?|litres?|ml|"
    "percent|degrees?|mph|kmh|gallons?|acres?|watts?|volts?|joules?|newtons?"
)
NAME = r"([\p{Ll},;] )(\p{Lu}\p{L}*(?: \p{Lu}\p{L}*)*)"
NUMBER = r"[0-9]+(?:[.,:/][0-9]+)*"
TOKEN = f"{OPEN}[^{CLOSE}]*{CLOSE}|[\\p{{L}}\\p{{N}}]+"


def marked(text: Column, keep: bool) -> Column:
    """The text in lower case with placeholders, which keep what they stand for if asked to."""
    of = lambda kind, group: f"{OPEN}{kind}" + (f":${group}" if keep else "") + CLOSE
    out = F.regexp_replace(text, NAME, "$1" + of("n", 2))
    out = F.regexp_replace(out, f"({NUMBER})", of("d", 1))
    out = F.regexp_replace(out, f"({CLOSE})([ -]?)((?i:{UNITS}))\\b", f"$1$2{of('u', 3)}")
    return F.lower(out)


def tokens(text: Column, keep: bool = False) -> Column:
    return F.regexp_extract_all(marked(text, keep), F.lit(TOKEN), F.lit(0))


def bare(words: Column) -> Column:
    """Tokens without what their placeholders stand for."""
    return F.transform(words, lambda t: F.when(F.startswith(t, F.lit(OPEN)), F.concat(F.substring(t, 1, 2), F.lit(CLOSE))).otherwise(t))


def values(words: Column) -> Column:
    """What the placeholders stand for, in order."""
    return F.transform(F.filter(words, lambda t: F.startswith(t, F.lit(OPEN))), lambda t: F.substring(t, 4, 1 << 30))


def starts(n: Column, width: int, stride: int) -> Column:
    """Places (from 0) of windows in an array of n."""
    return F.when(n >= width, F.sequence(F.lit(0), n - width, F.lit(stride))).otherwise(F.array().cast("array<int>"))


def hashes(words: str, width: int, stride: int) -> Column:
    """Hashes of an array column's windows."""
    return F.transform(starts(F.size(words), width, stride), lambda i: F.xxhash64(F.slice(F.col(words), i + 1, F.lit(width))))


def classes() -> list[tuple[int, int, int, int]]:
    """Window width and probing stride for items of so many words at least and at most."""
    whole = [(n, 1, n, n) for n in range(LEAST_WORDS, WINDOW)]
    return [(WINDOW, 1, LONG_WORDS, 1 << 30), (SHORT_WINDOW, 1, WINDOW, LONG_WORDS - 1), *whole]


def _windows(df: DataFrame, width: int) -> DataFrame:
    """id, place, hash and tokens of every window; df: id, words (with values), plain.

    The windows of a document are one array, so that exploding it copies no document once for each.
    """
    cut = lambda c, i: F.slice(F.col(c), i + 1, F.lit(width))
    every = F.transform(starts(F.size("plain"), width, 1), lambda i: F.struct(i.alias("place"), F.xxhash64(cut("plain", i)).alias("h"), cut("words", i).alias("cut")))
    return df.select("id", F.explode(every).alias("w")).select("id", "w.place", F.lit(width).alias("width"), "w.h", "w.cut")


def _templates(df: DataFrame) -> DataFrame:
    t = df.where(F.col("id").isNotNull()).select("id", tokens(F.col("text"), True).alias("words"))
    return t.withColumn("plain", bare(F.col("words")))


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least_share: float = LEAST_SHARE) -> DataFrame:
    """Documents that hold an item: id, item, matched and all windows of the item, share, slots, reparameterised."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    items = _templates(benchmark.select(F.col(item_col).alias("id"), F.col(item_text).cast("string").alias("text")).where(F.col("text").isNotNull()))
    parts = [_windows(items.where(F.size("plain").between(low, high)), width) for width, _, low, high in classes()]
    index = parts[0]
    for p in parts[1:]:
        index = index.unionByName(p)
    index = written(index, "items")
    about = index.groupBy("width").agg(F.count("*").alias("n")).collect()  # one row for each of a few widths
    widths, few = {r.width for r in about}, is_small(index, MAX_BROADCAST_WINDOWS)
    # Beyond the bound every part of the documents meets all windows, so that a frequent window has several tasks.
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt")
    dealt = lambda df: df.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    meet = lambda many, list_, keys, how: many.join(F.broadcast(list_), keys, how) if few else many.select("*", salt).join(dealt(list_), [*keys, "salt"], how)
    used = [c for c in classes() if c[0] in widths]
    if not used:
        none = F.lit(None)
        return rows.where(F.lit(False)).select(F.col("id").alias(id_col), none.cast("long").alias(item_col), none.cast("long").alias("n_matched"), none.cast("long").alias("n_windows"), none.cast("double").alias("share"), none.cast("long").alias("n_slots"), none.cast("boolean").alias("reparameterised"))

    plain = rows.select("id", tokens(F.col("text")).alias("plain"))
    strides = {c[0]: c[1] for c in used}
    probes = plain.select("id", F.explode(F.array_distinct(F.concat(*[hashes("plain", w, s) for w, s in sorted(strides.items())]))).alias("h"))
    hit = written(meet(probes, index.select("h").distinct(), ["h"], "left_semi").select("id").distinct(), "suspects")

    suspects = rows.join(F.broadcast(hit) if hit.count() <= MAX_BROADCAST_IDS else hit, "id", "left_semi")
    found = _templates(suspects)
    every = None
    for w in sorted(widths):
        part = _windows(found, w)
        every = part if every is None else every.unionByName(part)
    pairs = meet(every.select("id", F.col("place").alias("at"), "h", "width", F.col("cut").alias("theirs")), index.select(F.col("id").alias("item"), "place", "h", "width", F.col("cut").alias("ours")), ["h", "width"], "inner")
    zipped = F.zip_with(values(F.col("ours")), values(F.col("theirs")), lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    once = pairs.groupBy("id", "item", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.collect_set("place").alias("places"), F.array_distinct(F.flatten(F.collect_set(zipped))).alias("z"))
    a, b = F.array_distinct(F.transform("z", lambda x: x["a"])), F.array_distinct(F.transform("z", lambda x: x["b"]))
    once = once.where((F.size(a) == F.size("z")) & (F.size(b) == F.size("z")))
    total = index.groupBy(F.col("id").alias("item")).agg(F.count_distinct("place").alias("n_windows"))
    held = once.groupBy("id", "item").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n_matched"), F.max(F.size("z")).cast("long").alias("n_slots"), F.max(F.exists("z", lambda x: x["a"] != x["b"])).alias("reparameterised"))
    held = held.join(F.broadcast(total) if few else total, "item").withColumn("share", F.col("n_matched") / F.col("n_windows")).where(F.col("share") >= least_share)
    return held.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_matched", "n_windows", "share", "n_slots", "reparameterised")


def clean(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **more) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    name = fresh(docs, "__bad")
    bad = written(leaks(docs, benchmark, id_col=id_col, **more).select(F.col(id_col).alias(name)).distinct(), "leaks")
    few = bad.count() <= MAX_BROADCAST_IDS
    return docs.join(F.broadcast(bad) if few else bad, F.col(id_col) == F.col(name), "left_anti")
