"""Documents of an evaluation: results, bars, verdicts and reports, from frames of one row a method (and part).

Every frame here is an aggregate, bounded by methods, sources, kinds and draws; its rows come to the
driver to be written as JSON or Markdown.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.strings import format_ci
from sparkloom.sources.files import markdown_table


def cells(intervals: DataFrame) -> DataFrame:
    """(method, metric, cell): values with their intervals as text; intervals: (method, metric, value, low, high)."""
    return intervals.select("method", "metric", format_ci(F.col("value"), F.col("low"), F.col("high")).alias("cell"))


def plain(value):
    """JSON has no NaN and no infinity: they are written as null and as text."""
    if isinstance(value, float) and not math.isfinite(value):
        return None if math.isnan(value) else str(value)
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def results(parts: dict[str, DataFrame]) -> list[dict]:
    """One document a method: each part's rows without the method, a single row as an object."""
    out: dict[str, dict] = {}
    for name, df in parts.items():
        for r in df.toLocalIterator():
            row = r.asDict(recursive=True)
            out.setdefault(row.pop("method"), {}).setdefault(name, []).append(plain(row))
    return [{"method": m} | {k: v[0] if len(v) == 1 else v for k, v in out[m].items()} for m in sorted(out)]


def results_json(parts: dict[str, DataFrame]) -> str:
    return json.dumps(results(parts), indent=2, sort_keys=True, allow_nan=False)


def results_markdown(parts: dict[str, DataFrame], title: str, notes: dict[str, str] | None = None) -> str:
    """A section for each part, with a note before its table."""
    text = [f"# {title}"]
    for name, df in parts.items():
        order = [c for c in ("method", "source", "kind", "tier", "metric") if c in df.columns]
        text += [f"## {name}", *([notes[name]] if notes and name in notes else []), markdown_table(df.orderBy(*order))]
    return "\n\n".join(text) + "\n"


def bars_json(bars: DataFrame, reference: str) -> str:
    """Bars (metric, bar) of a reference method: what to beat, and the guard's least value."""
    of = {r.metric: plain(r.bar) for r in bars.toLocalIterator()}
    return json.dumps({"reference": reference, "guard_least": of.pop("guard", None), "beat_any": of}, indent=2, sort_keys=True)


def read_bars(spark, text: str) -> DataFrame:
    """The bars of a document; an absent one is null and skipped by the verdict."""
    doc = json.loads(text)
    return spark.createDataFrame([("guard", doc["guard_least"]), *sorted(doc["beat_any"].items())], "metric string, bar double")


def verdict_json(verdicts: DataFrame, results_: DataFrame, bars: DataFrame) -> str:
    """Each method's verdict with the criteria it rests on; results_: (method, metric, value)."""
    met = results_.join(F.broadcast(bars), "metric")  # one row a metric
    criteria: dict[str, dict] = {}
    for r in met.toLocalIterator():
        if r.value is not None and r.bar is not None:
            ok = r.value >= r.bar if r.metric == "guard" else r.value > r.bar
            criteria.setdefault(r.method, {})[r.metric] = {"value": r.value, "bar": r.bar, "met": ok}
    docs = [{"method": v.method, "verdict": v.verdict, "criteria": plain(criteria.get(v.method, {}))} for v in verdicts.orderBy("method").toLocalIterator()]
    return json.dumps(docs, indent=2, sort_keys=True)


def probe_markdown(parts: dict[str, tuple[str, DataFrame | str]]) -> str:
    """A report on a collection of files: sections of a title, and a table or a sentence."""
    return "\n\n".join(f"## {k}\n\n{note}" + (f"\n\n{markdown_table(df)}" if isinstance(df, DataFrame) else f"\n\n{df}" if df else "") for k, (note, df) in parts.items()) + "\n"
