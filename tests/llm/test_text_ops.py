"""Training-data operators on small fixtures: brute force, and the defined cases (nulls, empty and long texts, ties, repeats, clashing columns)."""

import base64
import collections
import functools
import hashlib
import json
import math
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import arrowmap, boosted, decontaminate, langid, licences, nearcopies, pieces, quality, secretscan, stats, substrings, textkit, urls
from sparkloom.operators import components
from sparkloom.plans import shared

WORD = re.compile("[^\x20\x09-\x0d]+")
DOC = "doc_id long, text string"


def words(n, seed=0, vocabulary=400):
    rng = np.random.default_rng(seed)
    return [f"w{k}" for k in rng.integers(0, vocabulary, n)]


def frame(spark, rows, clash=True):
    """Documents, with further columns whose names an operator might use itself."""
    df = spark.createDataFrame(rows, DOC)
    return df.select("*", F.lit("x").alias("id"), F.lit(1).alias("key"), F.lit("y").alias("hits"), F.lit(2).alias("__id")) if clash else df


ODD = [(None, "a null id"), (1, None), (2, ""), (3, " \t\n"), (4, "é ü 漢字 x"), (5, "same text"), (5, "same text"), (6, "x" * 30_000), (7, " ".join(words(5000, 7)))]


def rows(df):
    return [r.asDict() for r in df.collect()]


# ---------------------------------------------------------------- kernel


def test_kernel_words_and_windows():
    texts = ["a  b c", None, "", "x\ny\nx\n\n y", "éa b\x0bc\xa0d", "q", " ".join(words(300)), "z\x1fz \x85"]
    for most in (1, 50, 1 << 20):
        for i, _, s in textkit.slices(pa.array(texts), most):
            for d in range(s.n_docs):
                own = [bytes(s.buf[a:b]).decode() for a, b in zip(s.starts[s.word_off[d] : s.word_off[d + 1]], s.ends[s.word_off[d] : s.word_off[d + 1]], strict=True)]
                assert own == WORD.findall(texts[i + d] or "")
    s = next(textkit.slices(pa.array(["a b c a b c", "x a b c"])))[2]
    at, h = s.windows(3)
    assert at.tolist() == [0, 1, 2, 3, 6, 7] and h[0] == h[3] == h[5] and len(set(h.tolist())) == 4
    doc, a, b = textkit.lines(next(textkit.slices(pa.array(["l1\n l1\n\nl1\n", "", "l2"])))[2])
    assert doc.tolist() == [0, 0, 0, 2] and (b - a).tolist() == [2, 3, 2, 2]
    assert list(textkit.slices(pa.array([], pa.string()))) == []
    assert [len(x[2].starts) for x in textkit.slices(pa.array(["a b", "c"]).slice(1, 1))] == [1]


# ---------------------------------------------------------------- 1 decontamination


def test_decontamination(spark):
    item = "A train leaves Boston at 9 with Alice and covers 120 km before it meets the slow train that left at noon"
    bench = spark.createDataFrame([(1, item), (2, "a null text follows"), (3, None), (4, "too short"), (5, "when was the bridge built")], "item_id long, text string")
    changed = item.replace("Boston", "Paris").replace("Alice", "Carla").replace("120", "95").replace(" 9 ", " 7 ")
    twisted = "A box costs 5 and another box costs 5 so both boxes together cost twice as much as one of them"
    docs = [
        (10, "Some words first. " + item + " And some after."), (11, "Other words. " + changed), (12, "Nothing here at all, only words that no item has, again and again."),
        (13, "He asked, when was the bridge built? Nobody knew."), (14, twisted.replace("costs 5 so", "costs 6 so")), (15, item[: len(item) // 3]), *ODD,
    ]
    bench = bench.unionByName(spark.createDataFrame([(6, twisted)], bench.schema))
    got = {(r["doc_id"], r["item_id"]): r for r in rows(decontaminate.leaks(frame(spark, docs), bench))}
    assert set(got) == {(10, 1), (11, 1), (13, 5)}
    assert got[10, 1]["share"] == 1 and not got[10, 1]["reparameterised"] and got[11, 1]["reparameterised"]
    left = rows(decontaminate.clean(frame(spark, docs), bench))
    assert collections.Counter(r["doc_id"] for r in left) == collections.Counter(d for d, _ in docs if d not in (10, 11, 13))
    assert decontaminate.leaks(frame(spark, docs), bench.limit(0)).count() == 0
    assert decontaminate.leaks(frame(spark, []), bench).count() == 0
    assert len(set(decontaminate.clean(frame(spark, docs), bench).columns)) == len(frame(spark, docs).columns)


def test_decontamination_probes_every_word(spark):
    """Items held by few windows in a row, at all offsets: edge words changed (0.75, 0.6), and a longer item as two fragments of ten words."""
    items = {n: [f"i{chr(97 + n)}{chr(97 + k)}" for k in range(n)] for n in (11, 12, 14)}
    fill = lambda k: [f"f{chr(97 + j)}" for j in range(k)]
    docs, want = [], {}
    for k in range(4):
        held = [items[11][:10], items[11][1:], items[12][1:11], items[12][:10], items[12][2:], items[14][:10] + fill(2 + (-k) % 4) + items[14][4:]]
        for part, (item, share) in zip(held, ((11, 0.75), (11, 0.75), (12, 0.6), (12, 0.6), (12, 0.6), (14, 6 / 7)), strict=True):
            want[len(docs), item] = round(share, 6)
            docs.append((len(docs), " ".join(["z"] * k + part + ["q"] * 9)))
    docs.append((len(docs), " ".join(items[12][:9] + ["q"] * 9)))
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): round(r["share"], 6) for r in rows(decontaminate.leaks(frame(spark, docs), bench))}
    assert {k for k in want if k not in got} == set()
    assert set(got) == set(want)
    assert [r["doc_id"] for r in rows(decontaminate.clean(frame(spark, docs), bench))] == [len(docs) - 1]


# ---------------------------------------------------------------- 2 urls


def brute_url(url, rules, listed):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    host = "".join(c.lower() if c in urls.UPPER else c for c in host)
    path = re.match("[^/?#]*([^?#]*)", rest)[1]
    fits = lambda e, p: (host == e.split("/", 1)[0] or host.endswith("." + e.split("/", 1)[0])) and p.startswith("/" + e.split("/", 1)[1])
    best = max(((len(e), a == "block", e, a) for a, e in rules if fits(e, path)), default=None)
    if best:
        return host, path, best[2], best[3]
    return host, path, None, "block" if any(fits(e, path or "/") for e in listed) else "allow"


@pytest.fixture
def large(monkeypatch):
    """Every list counts as too long for a broadcast, and few rows of one key as many."""
    for module, name, value in ((urls, "MAX_BROADCAST_ENTRIES", 0), (shared, "MAX_BROADCAST_ROWS", 3), (shared, "HOT_ROWS", 4), (components, "MAX_BROADCAST_ROWS", 0),
                                (nearcopies, "MAX_BROADCAST_IDS", 0), (nearcopies, "HOT_ROWS", 2), (decontaminate, "MAX_BROADCAST_WINDOWS", 0), (decontaminate, "MAX_BROADCAST_IDS", 0), (licences, "MAX_BROADCAST_DIRS", 0)):
        monkeypatch.setattr(module, name, value)


def test_large_lists(spark, large):
    """The forms for long lists and frequent keys give the same results."""
    test_urls(spark)
    test_near_copies(spark)
    test_decontamination(spark)
    test_licences(spark)


def test_urls(spark):
    rules = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"), ("allow", "tie.io/a"), ("block", "tie.io/a")]
    listed = ["bad.org/", "x.io/p/"]
    given = [None, "", "no scheme/x", "http://A.Example.COM/en/71?x#y", "https://example.com/en/6", "http://net", "http://a.net/de/9", "http://notnet/x", "http://example.net/de/80", "ftp://org/es/#q", "http://w.bad.org", "http://x.io/p", "http://x.io/p/1",
             "http://tie.io/ab", "http://É.com/en/", "a://b://c/d", "http://example.com/en/7\n/z", "http://h?q=/en/", *["http://m.example.net/hot"] * 50]
    df = spark.createDataFrame(list(enumerate(given)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    r = spark.createDataFrame(rules, "action string, entry string")
    ls = spark.createDataFrame([(x,) for x in listed], "entry string")
    got = {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in rows(urls.filter_urls(df, r, ls))}
    assert got == {k: brute_url(u, rules, listed) for k, u in enumerate(given)}
    assert urls.filter_urls(df.limit(0), r, ls).count() == 0
    assert {x["verdict"] for x in rows(urls.filter_urls(df, r.limit(0), ls.limit(0)))} == {"allow"}


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    b = urls.bloom(keys, 1024)
    block, mask = urls._block_and_mask(F.col("key"), 1024)
    probe = lambda df: df.select("key", block.alias("block"), mask.alias("mask")).join(b, "block").where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).count()
    assert probe(keys) == 3000
    assert probe(spark.range(3000).select(F.concat(F.lit("n"), "id").alias("key"))) < 600


def test_url_rules_of_the_contract(spark, tmp_path):
    """The query judges by the five rules that its contract lists and by no other."""
    given = {"http://a.net/fr/1": (None, "allow"), "http://net": (None, "allow"), "http://a.net/de/9": ("net/de/", "allow"), "http://w.example.net/de/80": ("example.net/de/8", "block"), "http://x.ORG/es/#q": ("org/es/", "block"),
             "http://m.example.com/en/71?x": ("example.com/en/7", "allow"), "http://example.com/en/6": ("com/en/", "block")}
    from sparkloom.llm import queries

    spark.createDataFrame(list(enumerate(given)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {x["page_id"]: (x["rule"], x["verdict"]) for x in rows(queries.op2_url_filter(spark, str(tmp_path)))}
    assert got == dict(enumerate(given.values()))


def test_long_list_of_urls(spark):
    """100,000 entries: the Bloom filter passes few of the other keys, and the verdicts are exact."""
    n = 100_000
    listed = spark.range(n).select(F.concat(F.lit("h"), F.col("id") % 1000, F.lit(".example/"), "id").alias("entry"))
    df = spark.range(0, 4 * n, 7).select(F.col("id").alias("page_id"), F.concat(F.lit("http://w.h"), F.col("id") % 1000, F.lit(".example/"), "id").alias("url"))
    got = urls.filter_urls(df, spark.createDataFrame([], "action string, entry string"), listed)
    # A longer number begins with a listed one, so all are listed as prefixes; other hosts are not.
    assert got.where("verdict = 'block'").count() == sum(any(k[:z] and int(k[:z]) < n and int(k[:z]) % 1000 == int(k) % 1000 and str(int(k[:z])) == k[:z] for z in range(1, len(k) + 1)) for k in map(str, range(0, 4 * n, 7)))
    keys = urls.entries(listed, "listed").withColumn("key", F.concat_ws("", "r_host", "r_path"))
    blocks = 1 << 15
    block, mask = urls._block_and_mask(F.col("key"), blocks)
    others = spark.range(n).select(F.concat(F.lit("other"), "id").alias("key")).select(block.alias("block"), mask.alias("mask"))
    assert others.join(urls.bloom(keys, blocks), "block").where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).count() < n // 50


# ---------------------------------------------------------------- 3 substrings


def brute_substrings(docs, window):
    first = {}
    for d, t in docs:
        w = WORD.findall(t or "")
        for k in range(len(w) - window + 1):
            if d is not None:
                first[tuple(w[k : k + window])] = min(first.get(tuple(w[k : k + window]), d), d)
    out = []
    for d, t in docs:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - window + 1):
            if d is not None and first[tuple(w[k : k + window])] < d:
                gone.update(range(k, k + window))
        out.append((d, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(map(str, out))


@pytest.mark.parametrize("seed", range(2))
def test_substrings(spark, seed, monkeypatch):
    rng = np.random.default_rng(seed)
    passage = [words(int(n), 100 + k, 10_000) for k, n in enumerate((55, 80, 50, 49, 120))]
    docs = []
    for d in rng.permutation(60).tolist():
        text = words(int(rng.integers(0, 90)), d, 10_000)
        for p in rng.permutation(5)[: int(rng.integers(0, 4))]:
            a = int(rng.integers(0, 6)) if rng.random() < 0.3 else 0
            text = text + passage[p][a:] + words(int(rng.integers(0, 5)), d + 500, 10_000)
        docs.append((d, " ".join(text)))
    docs += [(61, docs[0][1]), (62, docs[0][1]), (63, "a " * 300), (64, "a " * 120), *ODD, (None, docs[1][1])]
    want = brute_substrings(docs, 50)
    for direct, buckets in ((substrings.DIRECT, substrings._parts(frame(spark, docs))), (0, 9), (0, 1), (1, 30)):
        monkeypatch.setattr(substrings, "DIRECT", direct)
        monkeypatch.setattr(substrings, "_parts", lambda rows, n=buckets: n)
        got = substrings.dedup(frame(spark, docs).repartition(5))
        assert sorted(str((r["doc_id"], r["n_words"], r["n_removed"], r["kept"])) for r in rows(got)) == want, (direct, buckets)


def test_substrings_empty_and_packing(spark):
    assert substrings.dedup(frame(spark, [])).count() == 0
    for v in (np.array([], np.uint64), np.array([0, 0, 7], np.uint64), np.array([2**64 - 1, 5], np.uint64)):
        assert (substrings.unplanes(substrings.planes(v), len(v)) == v).all()
    ids = np.array([0, 1, -5, 2**62], np.int64)
    df = spark.createDataFrame([(int(i),) for i in ids], "i long").select(F.xxhash64("i").alias("h"))
    assert [r.h for r in df.collect()] == substrings.spark_hash(ids).tolist()


# ---------------------------------------------------------------- 4 and 7 quality


def corpus(spark, n=300):
    rng = np.random.default_rng(5)
    docs, labels = [], []
    for d in range(n):
        good = bool(rng.random() < 0.7)
        w = words(int(rng.integers(20, 200)), d)
        text = " ".join(w) + "." if good else " ".join(x.upper() + "!!" for x in w) if d % 2 else " ".join(x + "###" for x in w)
        docs.append((d, text))
        labels.append((d, int(good), 0))
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark):
    docs, labels = corpus(spark)
    df = frame(spark, docs + [(1000 + k if d is None else d + 1000, t) for k, (d, t) in enumerate(ODD)] + [(None, "x")])
    model = quality.fit(df, labels)
    got = {r["doc_id"]: r for r in rows(quality.score(df, model))}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert np.mean([got[d]["predicted"] == truth[d] for d, _ in docs]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    again = {r["doc_id"]: r["score"] for r in rows(quality.score(df.repartition(7), quality.fit(df.repartition(3), labels.repartition(2))))}
    assert all(abs(again[d] - r["score"]) < 1e-9 for d, r in got.items())
    kept = quality.keep_good(df, model)
    assert kept.columns == df.columns and {r["doc_id"] for r in rows(kept)} == {d for d, r in got.items() if r["predicted"]}
    one = quality.fit(df, labels.where("quality = 1"))
    assert len({r["score"] for r in rows(quality.score(df, one))}) == 1
    assert quality.score(df.limit(0), quality.fit(df.limit(0), labels)).count() == 0


def brute_stats(text):
    """The statistics of a text, in the order of stats.NAMES, from plain lists."""
    text = text or ""
    w = WORD.findall(text)
    size = [len(x) for x in w]
    n, chars = max(len(w), 1), max(len(text), 1)
    mean = sum(size) / n
    of = lambda low, high: sum(low <= c <= high for c in text)
    upper, lower, digits = of("A", "Z"), of("a", "z"), of("0", "9")
    windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return [
        math.log1p(len(w)), math.log1p(len(text)), mean, math.sqrt(max(sum(x * x for x in size) / n - mean * mean, 0)), sum(c in "#*$%&|<>" for c in text) / n, text.count("|") / n, upper / max(upper + lower, 1), digits / chars, text.count("!") / n,
        sum(c in ".,;:?" for c in text) / n, sum(c >= "\x80" for c in text) / chars, sum(x <= 3 for x in size) / n, 1 - (len(w) - len(set(w))) / n, len(covered) / n, (len(lines) - len(set(lines))) / max(len(lines), 1), len(lines) / n, 1 - sum(size) / chars, math.log1p(max(size, default=0)),
    ]


def test_statistics_against_plain_lists():
    rng = np.random.default_rng(9)
    texts = [t for _, t in ODD] + ["".join(rng.choice(list("ab Ab1.,!|#é漢\n\t  "), int(n))) for n in rng.integers(0, 400, 80)] + ["a b c d e a b c d e", "x\nx\n\ny\nx"]
    want = np.array([brute_stats(t) for t in texts])
    for most in (1, 300, 1 << 18):
        got = np.concatenate([stats.matrix(stats.counts(s)) for _, _, s in textkit.slices(pa.array(texts), most)])
        assert np.allclose(got, want, atol=1e-9), stats.NAMES[int(np.abs(got - want).max(0).argmax())]


def test_discriminant_against_densities(spark):
    """Scores from the two classes' normal densities, by solving with full covariances."""
    docs, labels = corpus(spark)
    df = frame(spark, docs)
    x, y = stats.training_rows(df, labels, "quality", 10_000, but=(3, 1))
    model = quality.fit(df, labels)
    shape = lambda m: np.array([[v if k in ("n_words", "n_chars", "longest_word") else math.sqrt(max(v, 0)) for k, v in zip(stats.NAMES, r, strict=True)] for r in m])
    t = shape(x)
    mid, spread = t.mean(0), np.maximum(t.std(0), 1e-6)
    z = (t - mid) / spread
    cov = {c: np.cov(z[y == c].T, bias=True) for c in (0, 1)}
    pooled = sum((y == c).mean() * cov[c] for c in (0, 1))
    test = np.array([brute_stats(t) for _, t in docs])
    margin = []
    for r in (shape(test) - mid) / spread:
        density = []
        for c in (0, 1):
            s = (1 - quality.SHRINK_POOLED - quality.SHRINK_IDENTITY) * cov[c] + quality.SHRINK_POOLED * pooled + quality.SHRINK_IDENTITY * np.eye(len(mid))
            d = r - z[y == c].mean(0)
            density.append(-0.5 * (d @ np.linalg.solve(s, d) + np.linalg.slogdet(s)[1]))
        margin.append(math.asinh(density[1] - density[0]))
    want = 1 / (1 + np.exp(-(model.slope * np.array(margin) + model.offset)))
    got = {r["doc_id"]: r["score"] for r in rows(quality.score(df, model))}
    assert np.allclose([got[d] for d, _ in docs], want, atol=1e-7) and model.slope > 0


def test_repeated_ids_are_one_training_row(spark):
    docs, labels = corpus(spark, 60)
    once, again = (stats.training_rows(frame(spark, x), labels, "quality", 10_000) for x in (docs, docs + docs[:20] * 5))
    assert all((a == b).all() for a, b in zip(once, again, strict=True)) and len(stats.training_rows(frame(spark, docs * 3), labels, "quality", 25)[1]) == 25


def test_training_leaves_its_fold_out(spark):
    docs, labels = corpus(spark, 60)
    m, y = stats.training_rows(frame(spark, docs), labels, "quality", 10_000, but=(3, 1))
    assert len(y) == sum(zlib.crc32(str(d).encode()) % 3 != 1 for d, _ in docs)
    assert len(stats.training_rows(frame(spark, docs), labels, "quality", 7)[1]) == 7
    assert m.shape == (len(y), len(stats.NAMES))


def brute_rules(text):
    w = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    cover = {j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), dup, len(cover), failed


def test_rules(spark):
    docs, labels = corpus(spark)
    docs = docs + ODD + [(2000, "a b c d e f " * 30), (2001, "one line\nzwei\none line\n\n  \none line \nzwei\r\nzwei\r"), (2002, "a b c d e x a b c d e " + " ".join(words(60, 3, 9999)))]
    df = frame(spark, docs)
    model = boosted.fit(df, labels)
    got = rows(boosted.judge(df, model))
    key = lambda d, v: str((d, *v))
    assert sorted(key(r["doc_id"], (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])) for r in got) == sorted(key(d, brute_rules(t)) for d, t in docs)
    assert all(not r["kept"] for r in got if r["base_failed"])
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert np.mean([r["kept"] == bool(truth[r["doc_id"]]) for r in got if r["doc_id"] in truth]) > 0.97


def test_trees_against_a_walk(spark):
    """Node arrays score as a walk from node to node does; the verdict is the base rule's and the trees'."""
    docs, labels = corpus(spark)
    df = frame(spark, docs + [(1000 + k, t) for k, (_, t) in enumerate(ODD)])
    t = boosted.fit(df, labels)

    def walk(x, at):
        while t.feature[at] >= 0:
            at = t.left[at] + int(x[t.feature[at]] > t.threshold[at])
        return t.value[at]

    for r in rows(boosted.judge(df, t)):
        text = dict(docs + [(1000 + k, x) for k, (_, x) in enumerate(ODD)])[r["doc_id"]]
        x = np.array(brute_stats(text))
        p = 1 / (1 + math.exp(-(t.bias + sum(walk(x, root) for root in t.roots))))
        assert abs(p - r["score"]) < 1e-6
        assert r["kept"] is (not r["base_failed"] and r["score"] >= 0.5)
    assert boosted.judge(df.limit(0), t).count() == 0
    assert {r["score"] for r in rows(boosted.judge(df, boosted.fit(df.limit(0), labels)))} == {0.5}


def test_trees_are_monotonic():
    rng = np.random.default_rng(2)
    m = rng.random((2000, len(stats.NAMES)))
    y = (rng.random(2000) < 0.5 - 0.3 * (m[:, 4] - 0.5) + 0.4 * (m[:, 13] > 0.5)).astype(int)  # against the constraint in part
    t = boosted.Trees(m, y)
    base = rng.random((50, len(stats.NAMES)))
    for k in np.flatnonzero(t.sign):
        grid = np.repeat(base, 40, 0)
        grid[:, k] = np.tile(np.linspace(0, 1, 40), 50)
        assert (np.diff(t.score(grid).reshape(50, 40), axis=1) <= 1e-12).all()
    assert len(t.roots) == boosted.TREES


# ---------------------------------------------------------------- 5 secrets


def brute_secrets(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def der(*parts):
    body = b"".join(parts)
    n = len(body)
    return b"\x30" + (bytes([n]) if n < 128 else b"\x82" + n.to_bytes(2, "big")) + body


def test_secrets(spark):
    part = lambda tag, b: bytes([tag]) + (bytes([len(b)]) if len(b) < 128 else b"\x81" + bytes([len(b)])) + b
    key = der(part(2, b"\0"), *[part(2, bytes([k]) * 140) for k in range(1, 9)])
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(re.findall(".{1,64}", base64.b64encode(key).decode())) + "\n-----END RSA PRIVATE KEY-----"
    enc = lambda d: base64.urlsafe_b64encode(json.dumps(d).encode()).rstrip(b"=").decode()
    jwt = f"{enc({'alg': 'HS256'})}.{enc({'sub': 'me'})}.c2lnbmF0dXJl"
    ssh = base64.b64encode(b"\0\0\0\x07ssh-rsa" + b"\0\0\0\x03\1\0\1" + b"\0\0\0\x40" + b"m" * 64).decode()
    docs = [
        (20, f"é {pem} end"), (21, f"see {jwt}."), (22, f"{jwt[:-12].replace('eyJhbGci', 'eyJhbGdi')}.x"), (23, f"key {ssh} me@host"), (24, "x " + base64.b64encode(bytes(range(60))).decode()), (25, f"hex {key.hex().upper()} z"),
        (26, "PASSWORD = 'hunter2x' Api_Key:abc token=abcde token=abcdef passwd=password=secret="), (27, "ſecret=abcdefgh toKen=abcdefgh"), (28, "AKIA" + "A" * 16 + " AKIAB AKIAAKIA" + "Z" * 12), (29, "0123456789abcdef01234567 " * 2 + "0123456789abcdef0123456"),
        (30, 'password="token" = abcdefgh'), *ODD,
    ]
    got = rows(secretscan.scan(frame(spark, docs)))
    assert sorted(str((r["doc_id"], r["base_spans"])) for r in got) == sorted(str((d, brute_secrets(t))) for d, t in docs)
    by = {r["doc_id"]: r for r in got}
    kinds = {d: [x.split(":")[0] for x in by[d]["spans"].split(",") if x] for d in by}
    assert "der" in kinds[20] and "jwt" in kinds[21] and "jwt" not in kinds[22] and "ssh" in kinds[23] and kinds[24] == [] and "der" in kinds[25]
    text = dict(docs)[20]
    a, b = next(map(int, x.split(":")[1:]) for x in by[20]["spans"].split(",") if x.startswith("der"))
    assert base64.b64decode(text[a:b].replace("\n", "")) == key
    for r in got:
        assert set(filter(None, r["base_spans"].split(","))) <= set(r["spans"].split(","))
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(r["base_spans"].count(k + ":") for k in ("assign", "access", "hex"))
    df = frame(spark, docs)
    masked = secretscan.redact(df)
    assert masked.columns == df.columns
    for r in rows(masked.where("doc_id >= 20")):
        assert len(r["text"]) == len(dict(docs)[r["doc_id"]]) and not secretscan.base_spans(r["text"])
    assert masked.where("doc_id = 1").first().text is None
    assert secretscan.scan(df.limit(0)).count() == 0


def test_wrapped_keys():
    """Blocks of every remainder mod 3 (padded or not), between marks, lines of word characters and other keys."""
    part = lambda tag, b: bytes([tag]) + (bytes([len(b)]) if len(b) < 128 else b"\x81" + bytes([len(b)])) + b
    string = lambda *parts: b"".join(len(x).to_bytes(4, "big") + x for x in parts)
    pkcs8 = lambda n: der(b"\x02\x01\x00", b"\x30\x05\x06\x03\x2a\x03\x04", part(4, bytes(range(n))))
    magic = lambda n: secretscan.SSH_MAGIC + string(b"none", b"none", b"") + (1).to_bytes(4, "big") + string(b"p" * 51, b"k" * n)
    lines = lambda b, eol="\n", width=64: eol.join(re.findall(f".{{1,{width}}}", b64(b)))
    b64 = lambda b: base64.b64encode(b).decode()
    keys = [("der", pkcs8(n)) for n in range(90, 108)] + [("ssh", magic(n)) for n in range(150, 153)] + [("ssh", string(b"ssh-rsa", b"\1\0\1", b"m" * n)) for n in range(130, 133)]
    assert {len(k) % 3 for _, k in keys} == {0, 1, 2}
    for kind, key in keys:
        for eol in ("\n", "\r\n"):
            body = lines(key, eol)
            for before, after in (("-----BEGIN PRIVATE KEY-----" + eol, eol + "-----END PRIVATE KEY-----"), ("-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----"), ("", eol + "word" + eol + "words"), ("x" * 40 + eol, eol + "-" * 40 + eol + "y"), ("", "")):
                text = f"see {before}{body}{after} end"
                at = 4 + len(before)
                assert secretscan.confirmed_spans(text) == [(at, at + len(body), kind)], (kind, len(key), before, after)
    two = [b64(k) for _, k in keys[:18] if len(k) % 3 == 0][:2]
    assert [len(x) % 4 for x in two] == [0, 0] and "=" not in "".join(two)
    assert secretscan.confirmed_spans("\n".join(two)) == [(0, len(two[0]), "der"), (len(two[0]) + 1, len(two[0]) + 1 + len(two[1]), "der")]
    assert secretscan.confirmed_spans(lines(pkcs8(92)[:-1]) + "\nword") == []
    assert secretscan.confirmed_spans("M" * 40 + "\n" + "AAAA" * 30 + "\n" + "-" * 60) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_secrets_beside_each_other(spark, seed):
    """Many short texts of hex and base64 in one slice: each as if it stood alone, in any order and partitioning."""
    rng = np.random.default_rng(seed)
    enc = lambda b: base64.urlsafe_b64encode(b).rstrip(b"=").decode()
    key = der(b"\x02\x01\x00", b"\x30\x05\x06\x03\x2a\x03\x04", b"\x04\x10" + bytes(range(16)))
    pool = ["deadbeef" * 4, "deadbeef" * 3, "deadbeef" * 2, "face", "abc", "", base64.b64encode(key).decode(), key.hex(), key.hex().upper(), f"{enc(b'{ \"alg\": \"none\"}')}.{enc(b'{}')}.", "AKIA" + "B" * 16, "AKIA", "to", "ken=abcdef", "token=abcdef", "a.b.c", "x" * 20 + ".", None, "é", "-----", "A" * 31]
    docs = [(k, pool[p]) for k, p in enumerate(rng.integers(0, len(pool), 400))]
    alone = lambda t: secretscan.written(secretscan.base_spans(t or "") + secretscan.confirmed_spans(t or ""))
    want = {d: alone(t) for d, t in docs}
    assert {x.split(":")[0] for v in want.values() for x in v.split(",") if x} == {"assign", "access", "hex", "jwt", "der"}
    df = spark.createDataFrame(docs, DOC)
    for some in (df.coalesce(1), df.repartition(7, "text"), df.orderBy(F.desc("doc_id"))):
        assert {r["doc_id"]: r["spans"] for r in rows(secretscan.scan(some))} == want
    for r in rows(secretscan.redact(df.coalesce(1))):
        t = dict(docs)[r["doc_id"]]
        assert (r["text"] is None) is (t is None) and len(r["text"] or "") == len(t or "") and ("*" in (r["text"] or "")) is bool(want[r["doc_id"]])


def test_token_headers():
    enc = lambda t: base64.urlsafe_b64encode(t.encode()).rstrip(b"=").decode()
    spans = lambda t: secretscan.written(secretscan.confirmed_spans(t))
    body = enc('{"sub":1}')
    for head in ('{"alg":"HS256"}', '{ "alg" : "HS256" }', '{\n"alg":"HS256"}', ' {"alg":"HS256"}', '{\t"typ":"JWT","alg":"HS256"}'):
        t = f"{enc(head)}.{body}.c2ln"
        assert spans(f"({t}).") == f"jwt:1:{1 + len(t)}"
        assert spans(f"some-host-name-of-a-server.{t}") == f"jwt:27:{27 + len(t)}"
    jwe = ".".join([enc('{"alg":"dir","enc":"A128GCM"}'), "", "aXY", "Y2lwaGVy", "dGFn"])
    assert spans(f"{jwe}. And") == f"jwt:0:{len(jwe)}"
    assert spans(f"{enc('{}')}.{body}.c2ln") == spans(f"{enc('[1,2,3,4,5,6]')}.{body}.c2ln") == spans(f"{enc(chr(123) + ' alg no json at all')}.{body}.x") == ""


def test_der_lengths():
    good = der(b"\x02\x01\x00", b"\x30\x05\x06\x03\x2a\x03\x04", b"\x04\x10" + b"k" * 16)
    assert secretscan.is_der_key(good)
    assert not secretscan.is_der_key(good[:-1]) and not secretscan.is_der_key(good + b"\0")
    assert not secretscan.is_der_key(b"\x30\x03\x02\x01\x00") and not secretscan.is_ssh_key(b"\0\0\0\x07ssh-rsa")


# ---------------------------------------------------------------- 6 pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
TEXTS = ["", " ", "  ", "\n", "a", " a", "a\nb", "\na", "a\n", "\n\n x", "  Hello   world\n é 漢 \t x ", "\t", " \n ", "▁x▁▁y", "<s>", "<0x0A>", "😀 a\r\nb", "\x00", "x" * 3000, " ".join(words(300)), None]


@pytest.fixture(scope="module")
def model():
    try:
        return pieces.read_model(MODEL)
    except OSError:
        pytest.skip("no model file")


def test_pieces(spark, model):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_proto=model)
    docs = list(enumerate(TEXTS)) + [(None, "null id"), (3, "\n")]
    got = rows(pieces.encode(frame(spark, docs), model))
    want = [(d, lib.encode(t or "")) for d, t in docs]
    assert sorted(str((r["doc_id"], r["ids"])) for r in got) == sorted(map(str, want))
    assert all(r["parity"] for r in got)
    assert {r["doc_id"] for r in got if not r["round_trip"]} <= {13}
    back = rows(pieces.decode(pieces.encode(frame(spark, docs), model), model))
    assert sorted(str((r["doc_id"], r["text"])) for r in back) == sorted(str((d, (t or "").replace("▁", " "))) for d, t in docs)
    full = pieces.with_ids(frame(spark, docs), model)
    assert full.columns == [*frame(spark, docs).columns, "token_ids"] and full.where("doc_id = 20").first().text is None
    assert pieces.encode(frame(spark, []), model).count() == 0


def test_pieces_in_segments(model, monkeypatch):
    """Texts put together from segments have the ids of whole texts, however small slices, cache and batches are."""
    lib = pieces.Codec(model).library
    rng = np.random.default_rng(3)
    texts = [t or "" for t in TEXTS] + ["  ".join(words(400)) + " ", " ▁ ▁▁  a", " " * 50, "a" * 99 + " ", "▁", " ▁", "a▁ b", "x\n y"]
    texts += ["".join(rng.choice(list("ab ▁\né漢.<"), 30)) for _ in range(200)]
    for slice_bytes, cache, batch in ((1 << 18, 1 << 20, 4096), (7, 1 << 20, 3), (64, 100, 2)):
        monkeypatch.setattr(textkit, "SLICE_BYTES", slice_bytes)
        monkeypatch.setattr(pieces, "CACHE_BYTES", cache)
        monkeypatch.setattr(pieces, "BATCH", batch)
        c = pieces.Codec(model)
        ids, parity, back = c.encode(texts)
        assert ids.to_pylist() == [lib.encode(t) for t in texts] == c.ids(texts) and parity.all() and back.all()
        assert c.encode(texts, check=False)[0].equals(ids)
        assert c.decode_batch(ids.to_pylist()) == [t.replace("▁", " ") for t in texts]
    assert c.decode([1, 2]) == "" and c.encode([])[0].to_pylist() == [] and c.known.bytes() < 10_000
    monkeypatch.setattr(pieces, "DECODED", 2)
    assert c.decode_batch(ids.to_pylist()) == [t.replace("▁", " ") for t in texts]


def test_pieces_parity_is_a_check(model):
    """Where the libraries differ, the ids stay those of the tokenizers library and parity says so."""
    c, d = pieces.Codec(model), pieces.Codec(model)
    texts = ["all the words", "some other things", "", "other"]
    want = c.encode(texts)[0]
    d.theirs = lambda parts: [[5] if "other" in p else d.library.encode(p) for p in parts]
    ids, parity, back = d.encode(texts)
    assert ids.equals(want) and parity.tolist() == [True, False, True, False] and back.all()


def unigram(fallback: bool, squeeze: bool = False) -> bytes:
    """A small unigram model file."""
    varint = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)
    field = lambda k, v: varint(k << 3 | 2) + varint(len(v)) + v if isinstance(v, bytes) else varint(k << 3) + varint(v)
    piece = lambda p, x, t: field(1, field(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", x) + field(3, t))
    out = piece("<unk>", 0.0, 2) + piece("<s>", 0.0, 3) + piece("</s>", 0.0, 3)
    if fallback:
        out += b"".join(piece(f"<0x{k:02X}>", 0.0, 6) for k in range(256))
    for k, p in enumerate(["▁", "▁the", "▁then", "he", "n", "t", "e", "h", "▁ca", "ca", "c", "a", "▁▁", "at", "ten"]):
        out += piece(p, -1.5 - 0.37 * k, 1)
    trainer = field(3, 1) + (field(35, 1) if fallback else b"")
    return out + field(2, trainer) + field(3, field(1, b"identity") + field(3, 1) + field(4, int(squeeze)) + field(5, 1))


@pytest.mark.parametrize("fallback", [True, False])
@pytest.mark.parametrize("squeeze", [True, False])
def test_pieces_unigram(fallback, squeeze):
    c = pieces.Codec(unigram(fallback, squeeze))
    assert c.model.kind == pieces.UNIGRAM and c.model.byte_fallback is fallback and c.model.cuts is (not squeeze)
    texts = ["then the cat", "the  then ten", "hat", "", "then cat the hen"] + (["étè 漢"] if fallback else ["the x cat"])
    ids, parity, back = c.encode(texts)
    assert all(parity) and ids.to_pylist() == [c.library.encode(t) for t in texts]
    assert back.tolist() == [fallback or "x" not in t for t in texts]


# ---------------------------------------------------------------- 8 licences


def test_licences(spark):
    mit = " ".join(t for n, t in licences.TEMPLATES if n == "MIT")
    files = [
        (1, "a/LICENSE", "prose before\n\nReleased under the MIT License.\n"), (2, "a/b/c/x.py", "code only"), (3, "a/b/y.py", "# Licensed under the Apache License, Version 2.0\ncode"), (4, "z/w.py", "nothing"),
        (5, "z/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."), (6, "top.py", "a license is a thing that people talk about at great length in prose"), (7, None, "no path"), (8, "a/b/c/LICENSE", mit),
        (9, "a/b/c/d/e.py", None), (None, "a/q.py", ""), (10, "ab/c.py", ""), (3, "a/b/y.py", "# Licensed under the Apache License, Version 2.0\ncode"),
    ]
    df = spark.createDataFrame(files, "doc_id long, path string, text string").withColumn("licence", F.lit("clash")).withColumn("dir", F.lit(0))
    got = {(r["doc_id"], r["path"]): (r["licence"], r["origin"]) for r in rows(licences.scan(df))}
    assert got[1, "a/LICENSE"] == ("MIT", "declared") and got[2, "a/b/c/x.py"] == ("MIT", "inherited")
    assert got[3, "a/b/y.py"] == ("Apache-2.0", "declared") and got[4, "z/w.py"] == ("GPL-3.0", "inherited")
    assert got[6, "top.py"] == (None, None) and got[7, None] == (None, None) and got[10, "ab/c.py"] == (None, None)
    assert got[8, "a/b/c/LICENSE"][0] == "MIT" and got[9, "a/b/c/d/e.py"] == ("MIT", "inherited") and got[None, "a/q.py"] == ("MIT", "inherited")
    assert licences.scan(df).count() == len(files) and licences.scan(df.limit(0)).count() == 0


def brute_licence(text):
    """The licence and cosine of a text's widest finding, by vectors as dictionaries."""
    bag = lambda t: collections.Counter(re.findall("[a-z]+|[0-9]+(?:[.][0-9]+)*", t.lower()))
    bags = [(n, bag(t)) for n, t in licences.TEMPLATES]
    df = collections.Counter(t for _, b in bags for t in b)
    idf = lambda t: math.log((1 + len(bags)) / (1 + df[t])) + 1
    norm = lambda b: math.sqrt(sum((n * idf(t)) ** 2 for t, n in b.items()))
    low = (text or "").lower()
    for pieces_ in ([low], re.split("\n[ \t\r]*\n", low), low.split("\n")):
        best = None
        for seg in pieces_:
            if not any(c in seg for c in licences.CUES):
                continue
            b = bag(seg)
            for n, t in bags:
                dot = sum(k * t[x] * idf(x) ** 2 for x, k in b.items() if x in t)
                cos = round(dot / norm(b) / norm(t), 6) if b else 0
                if cos >= 0.6 and (best is None or (-cos, n) < best):
                    best = (-cos, n)
        if best:
            return best[1], -best[0]
    return None, None


def test_licences_against_brute_force(spark):
    rng = np.random.default_rng(8)
    docs = [f"{' '.join(words(30, 1))}\n\n{t}\n\n{' '.join(words(30, 2))}" for _, t in licences.TEMPLATES]
    for k in range(60):  # statements among words, wrapped in comments, cut
        t = licences.TEMPLATES[rng.integers(len(licences.TEMPLATES))][1].split(" ")
        t = t[: int(rng.integers(2, len(t) + 1))]
        docs.append(f"{' '.join(words(int(rng.integers(0, 5)), k))} {' '.join(t)} {' '.join(words(int(rng.integers(0, 5)), k + 1))}\n" + "\n".join("# " + x for x in re.findall(".{1,60}", " ".join(t))))
    got = {r["doc_id"]: (r["licence"], r["cosine"]) for r in rows(licences.scan(spark.createDataFrame(list(enumerate(docs)), DOC).withColumn("path", F.lit(None).cast("string"))))}
    want = {k: brute_licence(t) for k, t in enumerate(docs)}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs((got[k][1] or 0) - (want[k][1] or 0)) < 2e-6 for k in want) and sum(v[0] is not None for v in want.values()) > 150
    assert all(any(c in t.lower() for c in licences.CUES) for _, t in licences.TEMPLATES)


def test_licence_texts(spark):
    """Files as they are met: bodies with a name and a notice, wrapped headers, identifiers."""
    of = lambda name: max((t for n, t in licences.TEMPLATES if n == name), key=len)
    wrap = lambda t, head="", width=76: "\n".join(head + x for x in re.findall(f".{{1,{width}}}(?: |$)", t))
    notice = "Copyright (c) 2019 The Authors\nAll rights reserved.\n\n"
    files = [(name, f"{title}\n\n{notice}" + "\n\n".join(wrap(x) for x in of(name).split("\n"))) for name, title in (("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("ISC", "ISC License"), ("MIT", "MIT License"), ("Unlicense", ""))]
    files += [(n, wrap(t, "// ", 60) + "\n\nint main() { return 0; }\n") for n, t in licences.TEMPLATES if "WITHOUT ANY WARRANTY" in t or "Source Code Form" in t or "you may not use this file" in t]
    ids = {"Apache-2.0": "Apache-2.0", "BSD-2-Clause": "BSD-2-Clause", "BSD-3-Clause": "BSD-3-Clause", "GPL-2.0-only": "GPL-2.0", "GPL-2.0-or-later": "GPL-2.0", "GPL-3.0-only": "GPL-3.0", "LGPL-2.1-or-later": "LGPL-2.1", "LGPL-3.0-only": "LGPL-3.0", "AGPL-3.0-only": "AGPL-3.0", "ISC": "ISC", "MIT": "MIT", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "CC-BY-SA-4.0": "CC-BY-SA-4.0", "Unlicense": "Unlicense"}
    files += [(want, f"#!/bin/sh\n# SPDX-License-Identifier: {i}\necho {i}\n") for i, want in ids.items()]
    files += [(None, "# SPDX-License-Identifier: Proprietary-X\nx = 1\n"), (None, "a licence is a thing with conditions and warranties that people read"), (None, "copyright " * 40), (None, "")]
    df = spark.createDataFrame([(k, f"d{k}/x.c", t) for k, (_, t) in enumerate(files)], "doc_id long, path string, text string")
    got = {r["doc_id"]: r["licence"] for r in rows(licences.scan(df))}
    assert got == {k: want for k, (want, _) in enumerate(files)}


def test_licence_files_of_one_directory(spark):
    """Of two licence files the better finding covers the directory; of equal ones the first by path."""
    files = [(1, "a/LICENSE", "some words about it\nReleased under the MIT License today"), (2, "a/COPYING", "Licensed under the ISC License"), (3, "a/x", ""), (4, "b/LICENSE", "Released under the MIT License"), (5, "b/COPYING", "Released under the ISC License"), (6, "b/x", "")]
    got = {r["doc_id"]: r["licence"] for r in rows(licences.scan(spark.createDataFrame(files, "doc_id long, path string, text string")))}
    assert got[3] == "ISC" and got[6] == "ISC"


# ---------------------------------------------------------------- 9 near copies


def multiset(text):
    w = WORD.findall(text or "")
    return collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def brute_classes(docs, least=0.8):
    best = {}
    sets = [(d, multiset(t)) for d, t in docs if d is not None]
    up = {d: d for d, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            n = sum((x | y).values())
            if n and sum((x & y).values()) >= least * n and top(a) != top(b):
                p, q = sorted((top(a), top(b)))
                up[q] = p
    return best | {d: top(d) for d in up}


def edited(text, k, seed):
    rng = np.random.default_rng(seed)
    w = text.split(" ")
    for p in rng.choice(len(w), k, replace=False):
        w[p] = f"e{seed}x{p}"
    return " ".join(w)


def test_near_copies(spark):
    base = [" ".join(words(200, s, 5000)) for s in range(4)]
    passage = " ".join(words(100, 77, 5000))
    docs = [(k, edited(base[0], k % 5, k)) for k in range(40)] + [(100 + k, edited(base[1], 2 * k, 100 + k)) for k in range(8)]
    docs += [(200 + k, passage + " " + " ".join(words(40, 300 + k, 90_000))) for k in range(30)] + [(300, base[2]), (301, base[2].replace(" ", "  ")), (302, base[2] + " a b"), (303, base[2])]
    docs += [(400, "one two"), (401, "one  two"), (402, "two one"), (403, "a a a a a a a a"), (404, "a a a a a a a a a"), (405, "a a a a a a a a a a a a a a a"), *ODD, (None, "one two")]
    got = rows(nearcopies.classes(frame(spark, docs).repartition(3)))
    want = brute_classes(docs)
    assert len(got) == len(docs)
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == want
    assert all(r["class_id"] is None and r["is_kept"] for r in got if r["doc_id"] is None)
    assert nearcopies.classes(frame(spark, [])).count() == 0
    assert rows(nearcopies.classes(frame(spark, [(1, None), (2, "")]))) == [{"doc_id": 1, "class_id": 1, "is_kept": True}, {"doc_id": 2, "class_id": 2, "is_kept": True}]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_near_copies_of_real_texts(spark):
    """All links of similarity 0.8 in the supplied documents, with copies edited to just above and below it."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    long = [(d, t) for d, t in docs if t and len(WORD.findall(t)) > 60][:40]
    for k, (d, t) in enumerate(long):
        w = WORD.findall(t)
        docs.append((10_000 + d, edited(" ".join(w), max(1, (len(w) * (1 + k % 5)) // 100), d)))
    got = {r["doc_id"]: r["class_id"] for r in rows(nearcopies.classes(spark.createDataFrame(docs, DOC)))}
    want = brute_classes(docs)
    assert got == want and sum(c != d for d, c in want.items()) > 20


def test_very_long_texts(spark):
    """Texts longer than a slice, between short ones, through every operator that works by slices."""
    item = "zeta eta theta iota kappa lambda mu nu xi omicron rho sigma".split()
    many = words(59_988, 1, 3000)
    many[30_000:30_000] = item
    key = 'token = "abcdef123456"'
    docs = [(1, "short one"), (2, " ".join(many) + " " + key), (3, " ".join(many[:59_000]) + " END"), (4, None), (5, " ".join(many[100:160])), (6, key)]
    assert len(docs[1][1]) > textkit.SLICE_BYTES
    df = spark.createDataFrame(docs, DOC).coalesce(1)
    scanned = {r["doc_id"]: r["base_spans"] for r in rows(secretscan.scan(df))}
    assert scanned == {d: brute_secrets(t) for d, t in docs}
    assert {r["doc_id"]: r["class_id"] for r in rows(nearcopies.classes(df))} == {1: 1, 2: 2, 3: 2, 4: 4, 5: 5, 6: 6}
    want = brute_substrings(docs, 50)
    assert sorted(str((r["doc_id"], r["n_words"], r["n_removed"], r["kept"])) for r in rows(substrings.dedup(df))) == want
    judged = {r["doc_id"]: r for r in rows(boosted.judge(df, boosted.Trees(np.zeros((0, len(stats.NAMES))), np.zeros(0))))}
    assert judged[2]["n_words"] == 60_003 and judged[3]["n_words"] == 59_001 and judged[4]["n_words"] == 0
    grams = brute_grams(docs[1][1])
    found = [langid.gram_counts(s) for i, _, s in textkit.slices(pa.array([t for _, t in docs])) if i == 1]
    assert sorted(found[0][2].tolist()) == sorted(grams.values())
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert {r["doc_id"] for r in rows(decontaminate.leaks(df, bench))} == {2, 3}


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    est, true = [], []
    for t in range(30):
        w1 = rng.integers(0, 7, 60)
        w2 = np.where(rng.random(60) < 0.7, w1, rng.integers(0, 7, 60))
        k = np.arange(60)
        doc = np.repeat([0, 1], 60)
        x = textkit.mix((np.tile(k, 2) + t * 1000).astype(np.uint64) * np.uint64(7919))
        w = np.concatenate([w1, w2])
        s = nearcopies.signatures(doc[w > 0], x[w > 0], w[w > 0], 2, 400)
        est.append((s[0] == s[1]).mean())
        true.append(np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum())
    assert abs(np.mean(est) - np.mean(true)) < 0.015 and np.abs(np.subtract(est, true)).max() < 0.1


# ---------------------------------------------------------------- 10 languages


def test_languages(spark):
    rng = np.random.default_rng(0)
    parts = {"en": ["th", "ing", "er", "and", "ou"], "fr": ["eau", "é", "que", "tion", "oi"], "de": ["sch", "ung", "ich", "ei", "ü"]}
    docs = []
    for d in range(240):
        lang = ("en", "fr", "de")[d % 3]
        docs.append((d, " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(30)).capitalize(), None if d % 40 == 0 else lang))
    docs += [(300, None, "en"), (301, "12 34 !?", "fr"), (302, "", "de"), (303, "漢字", "en"), (None, "thing and thing", "en"), (0, docs[0][1], "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("id", F.lit(1)).withColumn("n", F.lit("x"))
    m = langid.fit(df)
    got = rows(langid.predict(df, m))
    assert len(got) == len(docs)
    by = {r["doc_id"]: r for r in got}
    assert all(by[d]["lang_pred"] == ("en", "fr", "de")[d % 3] for d in range(240))
    assert all(by[d]["lang_pred"] == "und" and by[d]["score"] == 0 for d in (300, 301, 302)) and by[303]["lang_pred"] != "und"
    assert all(0 <= r["score"] <= 1 for r in got)
    again = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows(langid.predict(df.repartition(5), langid.fit(df.repartition(2))))}
    assert again == {d: (r["lang_pred"], r["score"]) for d, r in by.items()}
    none = langid.fit(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in rows(langid.predict(df, none))} == {"und"}
    assert langid.predict(df.limit(0), m).count() == 0


def test_out_of_place_by_hand():
    s = next(textkit.slices(pa.array(["aab a", "b"])))[2]
    doc, gram, n = langid.gram_counts(s)
    letters = {(int(d), int(g)): int(k) for d, g, k in zip(doc, gram, n, strict=True) if g < langid.CLASSES}
    assert letters == {(0, 1): 3, (0, 2): 1, (1, 2): 1}
    p = langid.Profiles([("x", 1, 5), ("x", 2, 3), ("y", 2, 9)], 10)
    lang, score = p.nearest(2, np.array([0, 0, 1]), np.array([1, 2, 2]), np.array([3, 1, 1]))
    assert [p.langs[k] for k in lang] == ["x", "y"] and score.tolist() == [1.0, 1.0]


def brute_grams(text):
    c = collections.Counter()
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        x = f" {w} "
        c.update([*w, *(x[k : k + 2] for k in range(len(x) - 1)), *(x[k : k + 3] for k in range(len(x) - 2))])
    return c


@pytest.mark.parametrize("length", [400, 12])
def test_languages_against_out_of_place(spark, length):
    """Profiles and distances from plain dictionaries: mixed scripts, equal distances and equal counts among them."""
    number = lambda g: functools.reduce(lambda n, c: n * langid.CLASSES + c, [0 if x == " " else ord(x) - 96 if "a" <= x <= "z" else ord(x) for x in g][1:], ([0 if x == " " else ord(x) - 96 if "a" <= x <= "z" else ord(x) for x in g][0] + (len(g) > 1)))
    rng = np.random.default_rng(length)
    parts = {"en": "the and ing er ou", "fr": "eau que tion oi é", "ru": "ста ние про ый", "el": "και το ος εί"}
    docs = [(d, " ".join("".join(rng.choice(parts[x].split(), 2)) for _ in range(12)), x) for d, x in enumerate(rng.choice(list(parts), 60))]
    docs += [(100, "the and και το ста ние", None), (101, "zzz", None), (102, "q w", None), (103, "", None), (104, "the eau ста και", None), (105, "x" * 300, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows(langid.predict(df, langid.fit(df, length=length)))}
    learned = [(t, x) for d, t, x in docs if x and zlib.crc32(str(d).encode()) % 4 != 2]
    total = {x: collections.Counter() for x in parts}
    for t, x in learned:
        total[x].update(brute_grams(t))
    own = {x: sorted(total[x], key=lambda g: (-total[x][g], number(g)))[:length] for x in parts}
    every = collections.Counter()
    for x, gs in own.items():
        every.update({g: total[x][g] for g in gs})
    order = {g: k for k, g in enumerate(sorted(every, key=lambda g: (-every[g], number(g))))}
    for d, t, _ in docs:
        c = brute_grams(t)
        mine = sorted(c, key=lambda g: (-c[g], order.get(g, len(order)), number(g)))[:length]
        if not mine:
            assert got[d] == ("und", 0.0)
            continue
        far = {x: sum(abs(own[x].index(g) - k) if g in own[x] else length for k, g in enumerate(mine)) for x in sorted(parts)}
        best = min(far, key=lambda x: (far[x], x))
        assert got[d][0] == best and abs(got[d][1] - (1 - far[best] / (length * len(mine)))) < 1e-12, d


def test_grams_keep_letters_apart():
    """Brute-force n-grams of real letters, and two alphabets of letters that were once one class."""
    texts = ["aä û Äa", "ч а я", "漢字 かな", "", None, "1 2", "öß öß oe", "𐐨a"]
    want = []
    for t in texts:
        want.append(sorted(brute_grams(t).values()))
    doc, gram, n = langid.gram_counts(next(textkit.slices(pa.array(texts)))[2])
    assert [sorted(n[doc == d].tolist()) for d in range(len(texts))] == want
    alone = [langid.gram_counts(next(textkit.slices(pa.array([t], pa.string())))[2]) for t in texts]
    assert all(gram[doc == d].tolist() == g.tolist() == sorted(set(g.tolist())) for d, (_, g, _) in enumerate(alone))
    of = lambda t: set(langid.gram_counts(next(textkit.slices(pa.array([t], pa.string())))[2])[1].tolist())
    assert all(not of(a) & of(b) for a, b in ("äû", "öß", "íœ", "áë", "ач", "ия", "зе"))
    p = langid.Profiles([(x, g, 1) for x, t in (("x", "äää"), ("y", "ûûû")) for g in of(t)], 10)
    lang, _ = p.nearest(2, *langid.gram_counts(next(textkit.slices(pa.array(["ää", "ûû"])))[2]))
    assert [p.langs[k] for k in lang] == ["x", "y"]


def test_only_empty_texts(spark):
    """A batch without a byte of text."""
    df = spark.createDataFrame([(1, ""), (2, None), (3, "")], DOC).coalesce(1)
    docs, labels = corpus(spark, 60)
    train = frame(spark, docs)
    assert len({r["score"] for r in rows(quality.score(df, quality.fit(train, labels)))}) == 1
    assert {(r["n_words"], r["base_failed"], r["kept"]) for r in rows(boosted.judge(df, boosted.fit(train, labels)))} == {(0, True, False)}
    assert {r["spans"] for r in rows(secretscan.scan(df))} == {""} and secretscan.redact(df).count() == 3
    assert {(r["n_words"], r["kept"]) for r in rows(substrings.dedup(df))} == {(0, "")}
    assert {r["class_id"] for r in rows(nearcopies.classes(df))} == {1, 2, 3}
    m = langid.fit(train.withColumn("lang", F.lit("en")))
    assert {r["lang_pred"] for r in rows(langid.predict(df, m))} == {"und"} and langid.fit(df.withColumn("lang", F.lit("en"))).langs == []


def test_map_text_keeps_rows(spark):
    out = arrowmap.map_text(frame(spark, ODD), "doc_id", "text", lambda ids, texts, s: {"doc_id": ids, "n": s.n_words.astype(np.int64)}, "doc_id long, n long")
    assert sorted(str((r["doc_id"], r["n"])) for r in rows(out)) == sorted(str((d, len(WORD.findall(t or "")))) for d, t in ODD)
    assert hashlib.sha256(b"").hexdigest() == secretscan.digest("")
