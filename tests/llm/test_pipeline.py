"""The pipeline against a brute-force version of its stages, and its place in the repository."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import pieces, quality, queries, secretscan
from tests.llm.test_text_ops import brute_classes, words

MODEL = queries.PIECE_MODEL
pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="no model file")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    docs, labels = [], []
    item = "a river crosses the plain and turns north where the old mill stands beside the wooden bridge"
    for d in range(120):
        good = d % 4 != 0
        text = " ".join(words(80, d, 6000)) + "." if good else " ".join(x.upper() + "!!" for x in words(60, d, 6000))
        text = {1: item + ". " + text, 5: text + ' token = "0123456789abcdef0123456789abcdef"'}.get(d, text)
        docs.append((d, text, "en", "src0", len(text)))
        labels.append((d, int(good), 0))
    copy = docs[2][1]
    docs += [(200, copy, "en", "src1", len(copy)), (201, copy + " more", "en", "src1", len(copy) + 5), (202, None, "en", "src1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_pipeline(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    model = quality.fit(docs, queries.table(spark, sf_dir, "labels"))
    good = {r.doc_id for r in quality.score(docs, model).where("predicted = 1").collect()}
    kept = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    classes = brute_classes(kept)
    want = {d: t for d, t in kept if classes[d] == d and d != 1}
    codec = pieces.Codec(pieces.read_model(MODEL))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == set(want) and 2 in got and not {1, 200, 201} & set(got)
    for d, r in got.items():
        text = want[d] or ""
        if d == 5:
            assert not secretscan.base_spans(r.text) and len(r.text) == len(text)
        else:
            assert r.text == want[d]
        assert codec.decode(r.token_ids) == (r.text or "")


def test_stages(spark, sf_dir):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
    docs = queries.table(spark, sf_dir, "documents")
    empty = docs.where(F.lit(False))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, empty, sf_dir)
        assert out.count() == 0
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns


def test_stages_on_odd_rows(spark, sf_dir):
    """Null ids and texts, repeated rows, a text longer than a slice, and further columns with names that the stages use."""
    base = queries.table(spark, sf_dir, "documents")
    schema = base.schema
    long = " ".join(words(50_000, 9, 6000)) + '. api_key = "abcdef123456"'
    item = "a river crosses the plain and turns north where the old mill stands beside the wooden bridge"
    some = " ".join(words(90, 77, 6000)) + "."
    odd = [(None, some, "en", "s", 1), (None, None, "en", "s", 0), (300, None, "en", "s", 0), (301, "", "en", "s", 0), (302, some, "en", "s", 1), (302, some, "en", "s", 1), (303, some, "en", "s", 1), (304, long, "en", "s", 1), (305, item, "en", "s", 1), (305, item, "en", "s", 1), (None, item, "en", "s", 1)]
    names = ("id", "key", "component", "rep", "__gone", "__bad", "__id", "token_ids", "part", "salt", "h")
    df = spark.createDataFrame(odd, schema).select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    stages = [f for _, f in corpus_pipeline.STAGES]
    key = lambda d: sorted((str(r.doc_id), r.text or "") for r in d.collect())
    judged = stages[0](spark, df.unionByName(base.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])), sf_dir)
    assert judged.columns == df.columns and {304, 302} <= {r.doc_id for r in judged.collect()}
    single = stages[1](spark, df, sf_dir)
    assert single.columns == df.columns and key(single) == sorted((str(d), t or "") for d, t, *_ in odd if d != 303)
    clean = stages[2](spark, single, sf_dir)
    assert clean.columns == df.columns and key(clean) == sorted((str(d), t or "") for d, t, *_ in odd if d not in (303, 305))
    masked = stages[3](spark, clean, sf_dir)
    by = {r.doc_id: r.text for r in masked.collect()}
    assert masked.columns == df.columns and masked.count() == clean.count() and len(by[304]) == len(long) and by[304].endswith("*" * 23 + '"') and by[300] is None
    coded = stages[4](spark, masked, sf_dir)
    codec = pieces.Codec(pieces.read_model(MODEL))
    assert coded.columns == [*[c for c in df.columns if c != "token_ids"], "token_ids"]
    for r in coded.collect():
        assert codec.decode(r.token_ids) == (r.text or "") and [r[n] for n in names if n != "token_ids"] == [k for k, n in enumerate(names) if n != "token_ids"]
