"""Hand-computed frames for each operator."""

import json
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import embedding, ids, pixels, strings, vectors
from sparkloom.operators import audit, curation, ranges, retrieval, schema, similarity, summary, validate, verification
from sparkloom.operators.components import connected_components
from sparkloom.plans import shared
from sparkloom.plans.shared import written
from sparkloom.sources import adapters, files, reports


def one(df):
    return [tuple(r) for r in df.collect()]


def test_ids(spark):
    import hashlib

    df = spark.createDataFrame([("a/b.jpg",), ("é",)], "p string")
    for p, i, s in one(df.select("p", ids.stable_image_id("p"), ids.stable_seed("p", F.lit("k"), F.lit(3)))):
        assert i == hashlib.sha1(p.encode()).hexdigest()[:16]
        assert s == int.from_bytes(hashlib.sha1(f"{p}|k|3".encode()).digest()[:4], "big") % 2**31
    assert one(spark.sql("SELECT 'ffffffffffffffff' h").select(ids.hex_to_long("h"))) == [(-1,)]


def test_strings(spark):
    rows = [("9557ER2_4", "9557ER3_4", 6), ("", "x", 0), ("ab", "abc", 2), ("x", "y", 0)]
    got = one(spark.createDataFrame(rows, "a string, b string, n int").select(strings.shared_prefix(F.col("a"), F.col("b")), "n"))
    assert all(a == b for a, b in got)
    d = spark.createDataFrame([("d/Red_sari_3.jpg",), ("top.png",), ("a/b/img_12_jpg.rf.0ab1.jpg",), ("q/scarred.jpg",)], "p string")
    p = F.col("p")
    got = one(d.select(strings.file_stem(p), strings.export_stem(p), strings.has_colour_word(p), strings.strip_colours(strings.file_stem(p)), strings.parent_key(p), strings.top_key(p), strings.is_generic(strings.export_stem(p))))
    assert got[0] == ("Red_sari_3", "Red_sari_3", True, "sari", "d", "d", False)
    assert got[1][4:6] == ("<root>", "<root>")
    assert got[2][1] == "img_12" and got[2][6]
    assert got[3][2] is False
    v = spark.createDataFrame([(float("nan"),), (0.14,), (0.15,), (0.44,), (0.45,), (None,)], "x double").select(strings.palette_band(F.col("x")))
    assert [r[0] for r in one(v)] == ["unmeasurable", "same", "ambiguous", "ambiguous", "different", "unmeasurable"]
    assert one(spark.sql("SELECT '0.913 [0.878, 0.943]' t").select(strings.parse_ci(F.col("t")).alias("c")).select("c.*")) == [(0.913, 0.878, 0.943)]
    with pytest.raises(Exception, match="no confidence interval"):
        spark.sql("SELECT 'x' t").select(strings.parse_ci(F.col("t"))).collect()


def test_vectors(spark):
    d = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<double>, b array<double>")
    dot, cos, dist = one(d.select(vectors.dot("a", "b"), vectors.cosine("a", "b"), vectors.l1("a", "b")))[0]
    assert dot == 24 and math.isclose(cos, 0.96) and dist == 2
    v = [1.0 if k % 3 else -1.0 for k in range(64)]
    h = spark.createDataFrame([(v,)], "v array<double>").select(vectors.bits_to_signs(vectors.sign_hash("v")))
    assert one(h)[0][0] == v


@pytest.mark.parametrize("parts", ["1", "8"])
def test_components(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (9, 8), (8, 7), (7, 9), (4, 4), (None, 1)], "src long, dst long")
    got = dict(one(connected_components(e, nodes=spark.createDataFrame([(0,), (4,), (3,)], "id long"))))
    assert got == {0: 0, 4: 4, 3: 1}
    assert dict(one(connected_components(e))) == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 7, 8: 7, 9: 7}
    chain = spark.range(60).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {c for _, c in one(connected_components(chain))} == {0}
    assert one(connected_components(e.limit(0))) == []
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_hamming(spark):
    base = 0x0123456789ABCDEF
    rows = [(1, base), (2, base), (3, base ^ 0b111), (4, base ^ 0x0001000100010001), (5, base ^ 0b11111)]
    df = spark.createDataFrame([(i, h - 2**64 if h >= 2**63 else h) for i, h in rows], "id long, h long")
    want = {(a, b): bin(x ^ y).count("1") for a, x in rows for b, y in rows if a < b and bin(x ^ y).count("1") <= 4}
    assert {(i, j): d for i, j, d in one(similarity.hamming_pairs(df, 4, mode="exact"))} == want
    banded = {(i, j) for i, j, _ in one(similarity.hamming_pairs(df, 4))}
    assert (1, 3) in banded and (1, 4) not in banded and banded <= set(want)


@pytest.mark.parametrize("most", [0, 1, 3, 4, 8, 12])
def test_hamming_exact_against_all_pairs(spark, most, monkeypatch):
    """Planted pairs at every distance, however the hashes are cut."""
    rng = np.random.default_rng(most)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    rows = [(k, int(h)) for k, h in enumerate(base)]
    for k, h in enumerate(base):
        for d in (most, most + 1):
            rows.append((100 + 10 * k + d, int(h) ^ sum(1 << int(p) for p in rng.choice(64, d, replace=False))))
    df = spark.createDataFrame([(i, h - 2**64 if h >= 2**63 else h) for i, h in rows], "id long, h long")
    want = {(min(a, b), max(a, b)): (x ^ y).bit_count() for k, (a, x) in enumerate(rows) for b, y in rows[:k] if (x ^ y).bit_count() <= most}
    assert len(want) >= 40 * (most > 0)
    plans = {similarity.index_plan(n, most) for n in (10, 10**5, 10**7, 10**9)}
    for plan in plans:
        monkeypatch.setattr(similarity, "index_plan", lambda n, m, plan=plan: plan)
        assert {(i, j): d for i, j, d in one(similarity.hamming_pairs(df, most, mode="exact"))} == want, plan


def test_hamming_exact_in_pieces(spark, monkeypatch):
    """Small pieces, blocks and batches of candidates find the same pairs once each; repeated ids make no pair with themselves, null ids and hashes none."""
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**62), 2**62, 60)
    rows = [(k, int(h)) for k, h in enumerate(base)] + [(100 + k, int(h) ^ (0xF << k % 50)) for k, h in enumerate(base)] + [(200 + k, int(base[0])) for k in range(9)]
    df = spark.createDataFrame([*rows, (5, int(base[6]) ^ 1), (None, int(base[1])), (999, None)], "id long, h long")
    want = {(min(a, b), max(a, b), (x ^ y).bit_count()) for k, (a, x) in enumerate(rows) for b, y in rows[:k] if (x ^ y).bit_count() <= 4} | {(5, 6, 1)}
    for name, value in (("HASHES", 40), ("HASH_BLOCK", 8), ("CANDIDATES", 3), ("MAX_MASKS", 200)):
        monkeypatch.setattr(similarity, name, value)
    for bits in (4, 22):
        monkeypatch.setattr(similarity, "TABLE_BITS", bits)
        got = [tuple(r) for r in similarity.hamming_pairs(df, 4, mode="exact").collect()]
        assert set(got) == want and len(got) == len(want)
    for plan, most in ((similarity.index_plan(n, most), most) for n in (10, 10**5, 10**7) for most in (1, 8, 12, 40, 64)):
        assert sum(w for _, w, _ in plan) == 64 and sum(r + 1 for _, _, r in plan) > most


def test_hamming_pairs_leave_no_broadcast_to_statistics(spark, monkeypatch):
    """Rows that are many by count are broadcast in no join, however small their files are; few are, and the pairs are the same."""
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    df = spark.createDataFrame([(k, k // 3 * 0x0123456789ABCDE ^ (k % 3 == 2)) for k in range(60)], "id long, h long")
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    few = similarity.hamming_pairs(df, 2, mode="exact")
    monkeypatch.setattr(shared, "MAX_BROADCAST_ROWS", 5)
    many = similarity.hamming_pairs(df, 2, mode="exact")
    assert plan(many).count("SortMergeJoin") == 5 and "Broadcast" not in plan(many) and "BroadcastHashJoin" in plan(few)
    assert len(one(many)) == 60 and sorted(one(many)) == sorted(one(few))
    a, b = df.select("h", "id"), df.select("h", F.col("id").alias("other"))
    assert "Broadcast" not in plan(shared.dealt_join(a, b, ["h"], "id")) and shared.dealt_join(a, b, ["h"], "id").count() == 20 * 5
    assert "Broadcast" not in plan(curation.duplicate_groups(df, 2, "exact"))


def test_duplicate_groups_need_no_pairs_of_copies(spark):
    """n copies take n - 1 edges; an id with two hashes joins the groups of both, and a null hash is alone."""
    df = spark.createDataFrame([(k, 7) for k in range(300)] + [(400, 7 ^ 0xF), (500, -1), (3, -1), (600, None), (601, None)], "id long, h long")
    assert similarity.near_edges(df, 4, "exact").count() == 299 + 1 + 1
    groups = dict(one(curation.duplicate_groups(df, 4, "exact")))
    assert groups == {**{k: 0 for k in range(300)}, 400: 0, 500: 0, 600: 600, 601: 601}
    got = {r.threshold: (r.n_clusters, r.n_multi, r.largest) for r in curation.cluster_stats(df, (0, 4), "exact").collect()}
    assert got == {0: (4, 1, 301), 4: (3, 1, 302)}


def joins_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_prefixes_of_many_names(spark):
    """Names meet by their prefixes: two designs of 3,000 names each make no product of names; no name, short and generic ones count as before."""
    many = spark.range(6000).select((F.col("id") % 2).alias("id"), F.concat(F.lit("x/weave"), F.col("id") % 2, F.lit("é"), F.col("id"), F.lit(".jpg")).alias("path"))
    odd = spark.createDataFrame([(2, "x/weave1é7.png"), (2, None), (3, "x/we.jpg"), (4, "x/image 7.jpg"), (0, "a/weave1é7q.jpg")], "id long, path string")
    designs = spark.createDataFrame([(k, [1.0, k / 10]) for k in range(5)], "id long, vec array<double>")
    found = curation.prefix_constraints(designs, many.unionByName(odd), -1.0, 5)
    assert {(r.i, r.j): r.shared for r in found.collect()} == {(0, 1): 8, (0, 2): 8, (1, 2): 8}
    pairs = curation.prefix_constraints(designs, odd, -1.0, 0)
    assert {(r.i, r.j): r.shared for r in pairs.collect()} == {(0, 2): 8, (0, 3): 2, (2, 3): 2}
    assert "shared_prefix" not in joins_of(found) and "prefix" in joins_of(found)


def test_family_negatives_by_a_rule(spark):
    """A rule of what awaits review gives what the list of its pairs does, without a join of all pairs."""
    rows = spark.createDataFrame([(k, "a" if k % 3 else "b", k % 4 if k != 8 else None) for k in range(30)], "id long, family string, m int")
    comp = spark.createDataFrame([(k, k - k % 5) for k in range(20)], "id long, component long")
    listed = rows.alias("x").join(rows.alias("y"), F.expr("x.m = y.m AND x.id < y.id")).select(F.col("x.id").alias("i"), F.col("y.id").alias("j"))
    by_rule = audit.same_family_negatives(rows, comp, alike="m")
    assert one(by_rule) == one(audit.same_family_negatives(rows, comp, listed)) and by_rule.count() > 50
    assert "LeftAnti" not in joins_of(by_rule)


def test_stress_pairs_are_products(spark):
    """Scores of pairs come from matrix products and not from an expression a pair; null and empty groups make no pair, in both tiers."""
    rng = np.random.default_rng(8)
    rows = [(k, k % 5 if k % 11 else None, ["p0", "p1", "", None][k % 4 if k % 3 else k % 2], ["f0", "f1", "", None][k % 7 % 4], v.tolist()) for k, v in enumerate(rng.normal(size=(60, 4)))]
    df = spark.createDataFrame(rows, "id long, design int, palette string, family string, vec array<double>")
    for tier in (1, 2):
        want = {}
        for k, (a, da, pa_, fa, va) in enumerate(rows):
            for b, db, pb, fb, vb in rows[k + 1 :]:
                if pa_ and pb and da is not None and db is not None and (da == db or (pa_ == pb and (tier == 1 or (fa and fa == fb)))):
                    want[a, b] = (da == db, round(float(np.dot(va, vb) / np.linalg.norm(va) / np.linalg.norm(vb)), 6))
        pairs = verification.stress_pairs(df, None, tier)
        assert {(r.a_id, r.b_id): (r.genuine, round(r.score, 6)) for r in pairs.collect()} == want and len({g for g, _ in want.values()}) == 2
        assert "a_vec" not in joins_of(pairs) and "MapInArrow" in joins_of(pairs)


def test_masked_pairs_are_not_picked_from_all(spark, monkeypatch, tmp_path):
    """The query scores the pairs of its rule only."""
    from sparkloom.plans import registry

    spark.createDataFrame([(k, [1.0, float(k % 7), 2.0], k % 3) for k in range(130)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(similarity, "BLOCK", 2)
    got = registry.masked_pair_scores(spark, str(tmp_path))
    assert "Join" not in joins_of(got)
    assert sorted((r.q_id, r.g_id) for r in got.collect()) == [(a, b) for a in range(130) for b in range(130) if (a + b) % 50 == 0]


def test_similarity_grid(spark, monkeypatch):
    """Several cells, blocks and pieces give what one product gives; text ids, a mask, and pairs of one group only."""
    rng = np.random.default_rng(5)
    v = rng.integers(-2, 3, (70, 4)).astype(float)
    df = spark.createDataFrame([(f"r{k:02d}", x.tolist(), k % 3) for k, x in enumerate(v)], "id string, vec array<double>, grp int")
    s = brute_scores(v, v)
    monkeypatch.setattr(similarity, "BLOCK", 8)
    monkeypatch.setattr(similarity, "HELD", 24)
    rows = df.select("id", "vec")
    assert {(r.q_id, r.g_id): r.score for r in similarity.pair_scores(rows, rows, id_type="string").collect()} == {(f"r{i:02d}", f"r{j:02d}"): s[i, j] for i in range(70) for j in range(70)}
    got = {(r.q_id, r["rank"]): r.g_id for r in similarity.top_k(rows, rows, 3, exclude_self=True, id_type="string").collect()}
    np.fill_diagonal(s, -np.inf)
    order = np.argsort(-s, 1, kind="stable")
    assert got == {(f"r{i:02d}", k + 1): f"r{order[i, k]:02d}" for i in range(70) for k in range(3)}
    inside = similarity.pair_scores(df, df, 0.5, "string", within=["grp"])
    assert {(r.q_id, r.g_id) for r in inside.collect()} == {(f"r{i:02d}", f"r{j:02d}") for i in range(70) for j in range(70) if i % 3 == j % 3 and (s[i, j] >= 0.5 or (i == j and v[i].any()))}
    mask = spark.createDataFrame([("r01", "r02"), ("r01", "r99")], "q_id string, g_id string")
    assert one(similarity.pair_scores(rows, rows, id_type="string", mask=mask).select("q_id", "g_id")) == [("r01", "r02")]
    assert similarity.top_k(rows.limit(0), rows, 3, id_type="string").count() == similarity.pair_scores(rows, rows.limit(0), id_type="string").count() == 0


def brute_scores(q, g):
    n = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return np.round(n(q) @ n(g).T, 9)


def test_similarity_and_retrieval(spark):
    rng = np.random.default_rng(0)
    q, g = rng.normal(size=(40, 5)), rng.normal(size=(12, 5))
    qd, gd = rng.integers(0, 8, 40), np.arange(12) % 7
    mk = lambda x, d: spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, d, strict=True))], "id long, vec array<double>, design int")
    Q, G = mk(q, qd), mk(g, gd)
    s = brute_scores(q, g)
    got = {(a, b): v for a, b, v in one(similarity.pair_scores(Q.select("id", "vec"), G.select("id", "vec")))}
    assert all(got[i, j] == s[i, j] for i in range(40) for j in range(12))
    top = {(r.q_id, r["rank"]): r.g_id for r in similarity.top_k(Q.select("id", "vec"), G.select("id", "vec"), 3).collect()}
    order = np.argsort(-s, 1, kind="stable")
    assert all(top[i, k + 1] == order[i, k] for i in range(40) for k in range(3))
    per = {r.q_id: r for r in retrieval.per_query(similarity.pair_scores(Q.select("id", "vec"), G.select("id", "vec")), Q, G).collect()}
    for i in range(40):
        hits = gd[order[i]] == qd[i]
        ranks = np.flatnonzero(hits) + 1
        ap = float(np.mean(np.arange(1, len(ranks) + 1) / ranks)) if len(ranks) else 0.0
        assert (per[i].hit1, per[i].hit5) == (float(hits[0]), float(hits[:5].any())) and math.isclose(per[i].ap, ap)


def test_bootstrap(spark):
    per = spark.createDataFrame([("a", 3, 3.0), ("b", 1, 0.0)], "grp string, n long, m double")
    w = spark.createDataFrame([(0, "a", 2), (1, "b", 2), (2, "a", 1), (2, "b", 1)], "draw long, grp string, weight long")
    low, high = one(retrieval.interval(per, w, ["m"], 1.0))[0][1:]
    assert (low, high) == (0.0, 1.0)
    drawn = retrieval.bootstrap_weights(spark, ["b", "a", "c"], 5, 42).groupBy("draw").agg(F.sum("weight")).collect()
    assert len(drawn) == 5 and all(r[1] == 3 for r in drawn)
    rng = np.random.default_rng(42)
    first = np.bincount(rng.choice(3, size=3, replace=True), minlength=3)
    got = {r.grp: r.weight for r in retrieval.bootstrap_weights(spark, ["b", "a", "c"], 5, 42).where("draw = 0").collect()}
    assert got == {g: n for g, n in zip("abc", first.tolist(), strict=True) if n}


def pairs_frame(spark, score, genuine):
    return spark.createDataFrame([(float(s), bool(g)) for s, g in zip(score, genuine, strict=True)], "score double, genuine boolean")


def brute_eer(score, genuine):
    s = np.unique(score)[::-1]
    tp, fp = np.array([(score[genuine] >= x).sum() for x in s]), np.array([(score[~genuine] >= x).sum() for x in s])
    keep = np.ones(len(s), bool)
    if len(s) > 2:
        keep[1:-1] = (np.diff(tp, 2) != 0) | (np.diff(fp, 2) != 0)
    tp, fp, s = np.append(0, tp[keep]), np.append(0, fp[keep]), np.append(np.inf, s[keep])
    fnr, fpr = 1 - tp / genuine.sum(), fp / (~genuine).sum()
    k = int(np.argmin(np.round(np.abs(fnr - fpr), 12)))
    return (fnr[k] + fpr[k]) / 2, s[k]


def test_verification(spark):
    rng = np.random.default_rng(3)
    genuine = rng.random(200) < 0.3
    score = np.round(rng.normal(genuine * 0.8, 1), 1)
    p = pairs_frame(spark, score, genuine)
    pos, neg = score[genuine], score[~genuine]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert math.isclose(one(verification.roc_auc(p))[0][0], auc)
    got, want = one(verification.equal_error_rate(p))[0], brute_eer(score, genuine)
    assert math.isclose(got[0], want[0]) and got[1] == want[1]
    far = pairs_frame(spark, range(1, 1001), [False] * 1000)
    assert one(verification.threshold_at_far(far, 1e-3)) == [(999.0,)]
    r = verification.evaluate(far.unionByName(pairs_frame(spark, [2000.0], [True])), 1e-3).first()
    assert r.achieved_far == 0.002 and r.tar == 1.0
    assert math.isnan(verification.evaluate(far, 1e-3).first().roc_auc)
    assert math.isinf(one(verification.threshold_at_far(pairs_frame(spark, [1.0], [True]), 1e-3))[0][0])


def test_stress(spark):
    rows = [(k, d, p, f, [math.cos(k), math.sin(k)]) for k, (d, p, f) in enumerate([("A", "p", "x"), ("A", "q", "x"), ("B", "p", "x"), ("B", "q", "y"), ("C", "", "x")])]
    df = spark.createDataFrame(rows, "id long, design string, palette string, family string, vec array<double>")
    t1 = {(r.a_id, r.b_id): r.genuine for r in verification.stress_pairs(df, None, 1).collect()}
    assert t1 == {(0, 1): True, (2, 3): True, (0, 2): False, (1, 3): False}
    assert {(r.a_id, r.b_id) for r in verification.stress_pairs(df, None, 2).where("NOT genuine").collect()} == {(0, 2)}
    assert verification.stress_report(verification.stress_pairs(df.where("id < 2"), None)).first().note


def test_splits_and_roles(spark):
    rows = [(f"d{k}", "s", "f", k < 2) for k in range(10)] + [("x0", "s", "g", False)]
    d = spark.createDataFrame(rows, "design_id string, source string, craft_family string, forced boolean")
    got = dict(one(curation.assign_splits(d, val_frac=0.15, test_frac=0.25)))
    n = lambda s: sum(v == s for k, v in got.items() if k[0] == "d")
    assert (n("test"), n("val"), n("train")) == (2, 2, 6)  # half to even: 2.5 and 1.5
    assert got["d0"] == got["d1"] == "test"
    again = dict(one(curation.assign_splits(d.unionByName(spark.createDataFrame([("y", "t", "g", False)], d.schema)), val_frac=0.15, test_frac=0.25)))
    assert all(again[k] == v for k, v in got.items())
    images = spark.createDataFrame([("a", "D", "p1", True, "test"), ("b", "D", "p2", True, "test"), ("c", "D", "p0", False, "test"), ("e", "E", "p9", True, "train")], "image_id string, design_id string, path string, is_representative boolean, split string")
    assert {r.image_id: (r.role, r.query_kind) for r in curation.assign_roles(images).collect()} == {"a": ("gallery", ""), "b": ("query", "real_view"), "c": ("train", ""), "e": ("train", "")}


def test_merge_representatives_and_majority(spark):
    groups = spark.createDataFrame([("g1",), ("g2",), ("g3",)], "dup_group string")
    v = spark.createDataFrame([("g1", "g2", 0.9, 0.97), ("g2", "g3", 0.9, float("nan"))], "a string, b string, overlap double, ncc double")
    assert dict(one(curation.merge_groups(groups, v))) == {"g1": "g1", "g2": "g1", "g3": "g3"}
    reps = spark.createDataFrame([("g", 0.2, "b", 1), ("g", 0.1, "c", 2), ("g", 0.1, "a", 3)], "dup_group string, score double, path string, id long")
    assert one(curation.representatives(reps)) == [("g", 3)]
    m = spark.createDataFrame([("d", "x"), ("d", "y"), ("d", ""), ("e", "x")], "k string, v string")
    assert set(one(curation.majority(m, "k", "v"))) == {("d", "", True), ("e", "x", False)}


def manifest_rows(spark):
    """A valid small manifest."""
    real = []
    for k, split in enumerate(["train", "val", "test", "test"]):
        real.append({"image_id": f"r{k}", "path": f"p{k}", "source": "s", "design_id": f"d{k}", "dup_group": f"g{k}", "is_representative": True, "split": split, "role": "train" if split == "train" else "gallery", "craft_family": "f"})
    df = schema.conform(spark.createDataFrame([tuple(r.values()) for r in real], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'string'}" for k, v in real[0].items())))
    synth = curation.synthetic_rows(df, methods={"val": "lab", "test": "lab"}, palettes={"val": ["a"], "test": ["b"]}, n_recolor=2, n_tonal=1)
    return df.unionByName(schema.conform(synth))


MUTATIONS = [
    ("CK-01", {"split": "CASE WHEN image_id = 'r2' THEN 'train' ELSE split END"}),
    ("CK-02", {"dup_group": "CASE WHEN image_id = 'r0' THEN 'g1' ELSE dup_group END"}),
    ("CK-03", {"split": "CASE WHEN is_synthetic AND design_id = 'd1' THEN 'test' ELSE split END"}),
    ("CK-04", {"recolor_method": "CASE WHEN is_synthetic THEN 'kmeans_palette_swap' ELSE '' END"}),
    ("CK-05", {"palette_id": "CASE WHEN is_synthetic THEN 'a' ELSE '' END"}),
    ("CK-06", {"parent_image_id": "CASE WHEN is_synthetic THEN 'gone' ELSE '' END"}),
    ("CK-07", {"source": "CASE WHEN is_synthetic THEN 'other' ELSE source END"}),
    ("CK-08", {"design_id": "CASE WHEN is_synthetic AND split = 'val' THEN 'd9' ELSE design_id END"}),
    ("CK-09", {"craft_family": "CASE WHEN is_synthetic THEN 'other' ELSE craft_family END"}),
    ("CK-10", {"image_id": "CASE WHEN image_id = 'r1' THEN 'r0' ELSE image_id END"}),
    ("CK-11", {"path": "CASE WHEN image_id = 'r1' THEN 'p0' ELSE path END"}),
    ("CK-12", {"is_representative": "is_representative AND image_id <> 'r0'"}),
    ("CK-13", {"split": "CASE WHEN split = 'val' THEN 'train' ELSE split END"}),
    ("CK-14", {"role": "CASE WHEN image_id = 'r1' THEN 'train' ELSE role END"}),
    ("CK-15", {"role": "CASE WHEN is_synthetic AND split = 'val' THEN 'train' ELSE role END"}),
    ("CK-16", {"role": "CASE WHEN is_synthetic THEN 'gallery' ELSE role END"}),
    ("CK-17", {"is_representative": "is_representative AND image_id <> 'r1'"}),
    ("CK-18", {"is_representative": "is_representative AND image_id <> 'r2'"}),
    ("CK-20", {"query_kind": "''"}),
    ("CK-21", {"query_kind": "CASE WHEN role = 'gallery' THEN 'real_view' ELSE query_kind END"}),
    ("CK-23", {"split": "CASE WHEN image_id = 'r0' THEN 'dev' ELSE split END"}),
    ("CK-24", {"role": "CASE WHEN image_id = 'r0' THEN 'x' ELSE role END"}),
    ("CK-25", {"query_kind": "CASE WHEN is_synthetic THEN 'x' ELSE query_kind END"}),
    ("CK-26", {"label_confidence": "'sure'"}),
    ("CK-27", {"recolor_seed": "5L"}),
    ("CK-28", {"recolor_method": "'lab'"}),
    ("CK-29", {"recolor_seed": "-1L"}),
    ("CK-30", {"recolor_method": "''"}),
    ("CK-31", {"parent_image_id": "''"}),
]


@pytest.fixture(scope="module")
def valid(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("manifest") / "m")
    files.write_manifest(manifest_rows(spark), at)
    return files.read_manifest(spark, at)


def bad_checks(df, labels=None, **more):
    return {r.check_id for r in validate.report(df, labels, **more).where("n_bad > 0").collect()}


def test_valid_manifest(spark, valid):
    labels = schema.label_map(valid)
    assert one(labels) == [("d0", 0)]
    assert bad_checks(valid, labels, files=valid.select("path")) == set()
    validate.require_valid(valid, labels)
    assert bad_checks(valid, labels.unionByName(spark.createDataFrame([("zz", 9)], labels.schema))) == {"CK-19"}
    assert bad_checks(valid, files=valid.where("path <> 'p0'").select("path")) == {"CK-32"}
    assert "CK-22" in bad_checks(valid.select(*reversed(valid.columns)))


@pytest.mark.parametrize("check,change", MUTATIONS, ids=[m[0] for m in MUTATIONS])
def test_mutation(valid, check, change):
    broken = valid.withColumns({k: F.expr(v) for k, v in change.items()})
    assert check in bad_checks(broken)


def test_require_valid_names_the_check(valid):
    with pytest.raises(ValueError, match="CK-20.*lack their kind"):
        validate.require_valid(valid.withColumn("query_kind", F.lit("")))


def test_exclusions(spark):
    m = spark.createDataFrame([(f"i{k}", f"d{k}", s, False) for k, s in enumerate(["test", "train", "test", "val", "test", "test", "train"])], "image_id string, design_id string, split string, is_synthetic boolean")
    links = spark.createDataFrame([("i0", "i1", "k", ""), ("i3", "i2", "k", ""), ("i1", "i6", "k", "")], "test_image_id string, other_image_id string, kind string, audit_numbering string")
    got = {r.test_image_id: r.action for r in audit.resolve_links(links, m).collect()}
    assert got == {"i0": "EXCLUDE test side", "i3": "kept: partner in val, not train", "i1": "no test side"}
    vec = spark.createDataFrame([(f"i{k}", k, [math.cos(a), math.sin(a)]) for k, a in enumerate([0, 1, 2, 3, 2.05, 4, 2.04])], "image_id string, id long, vec array<double>")
    found = audit.exclusions(links, spark.createDataFrame([("i2",)], "image_id string"), m, vec)
    assert dict(one(found)) == {"d0": "link", "d2": "kept_reviewed", "d4": "rule", "d5": "kept_unreviewed"}
    assert one(audit.exclusion_counts(found)) == [(4, 1, 1, 1, 1, 2)]
    doc = files.resolved_exclusions(found, m, 0.9)
    assert doc["excluded"] == ["d0", "d4"] and files.reuse_exclusions(doc, m) == ["d0", "d4"]
    with pytest.raises(ValueError, match="resolved for manifest"):
        files.reuse_exclusions(doc, m.where("image_id <> 'i0'"))
    with pytest.raises(ValueError, match="lacks"):
        audit.resolve_links(links.unionByName(spark.createDataFrame([("zz", "i0", "", "")], links.schema)), m)
    with pytest.raises(ValueError, match="keyed by image_id"):
        files.exclusion_links(spark, {"links": []})


def test_verdict_and_negatives(spark):
    bars = spark.createDataFrame([("a", 0.5), ("b", None), ("guard", 0.8)], "metric string, bar double")
    res = spark.createDataFrame([("m1", "a", 0.6), ("m1", "guard", 0.8), ("m2", "a", 0.5), ("m2", "guard", 0.9), ("m3", "a", 0.9), ("m3", "guard", 0.7), ("m3", "b", 1.0)], "method string, metric string, value double")
    assert {r.method: r.verdict for r in audit.verdict(bars, res).collect()} == {"m1": "SUCCESS", "m2": "FAIL", "m3": "FAIL"}
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "y")], "id long, family string")
    comp = spark.createDataFrame([(1, 1), (2, 1)], "id long, component long")
    assert one(audit.same_family_negatives(rows, comp, spark.createDataFrame([(3, 2)], "i long, j long"))) == [(1, 3)]
    acc = spark.createDataFrame([("t", "q")], "image_id_a string, image_id_b string")
    man = spark.createDataFrame([("t", "test"), ("q", "train"), ("w", "train"), ("u", "test")], "image_id string, split string")
    aud = spark.createDataFrame([("t", "w", 0.99), ("u", "w", 0.9), ("u", "q", 0.8)], "image_id string, nearest_image_id string, cosine double")
    assert {r.test_image_id: r.other_image_id for r in audit.partners(acc, aud, man).collect()} == {"t": "q", "u": "w"}


def test_order_stat_and_tree(spark):
    d = spark.range(10).select(F.col("id").cast("double").alias("v"))
    assert one(summary.order_stat(d, "v", (0.0, 0.5, 0.99))) == [(0.0, 5.0, 9.0, 10)]
    t = spark.createDataFrame([("a/b/x.jpg",), ("a/y.jpg",), ("z.jpg",)], "path string")
    assert set(one(summary.dir_tree(t))) == {(0, "", 3, 1), (1, "a", 2, 1), (2, "a/b", 1, 0)}


def png(rgb):
    h, w, _ = rgb.shape
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def texture(seed, size):
    rng = np.random.default_rng(seed)
    coarse = pixels.resize(np.kron(rng.integers(0, 255, (size // 16, size // 16, 3)), np.ones((16, 16, 1))), size, size)
    return np.clip(coarse + rng.integers(-40, 40, (size, size, 3)), 0, 255).astype(np.uint8)


def test_adapters_and_pixels(spark, tmp_path):
    a = tmp_path / "train" / "Ikat"
    a.mkdir(parents=True)
    img = texture(1, 64)
    (a / "motif_jpg.rf.0abc.png").write_bytes(png(img))
    (a / "image 3.png").write_bytes(png(texture(2, 48)))
    (a / "broken.png").write_bytes(b"no image")
    (a / "notes.txt").write_text("x")
    (a / ".hidden.png").write_bytes(png(img))
    (tmp_path / "h_top.png").write_bytes(png(img))
    cfg = adapters.SourceConfig("k", f"file://{tmp_path}", "hierarchical")
    rec, dead = adapters.build_records(spark, [cfg])
    rows = {r.path: r for r in rec.collect()}
    assert set(rows) == {"train/Ikat/motif_jpg.rf.0abc.png", "train/Ikat/image 3.png"}
    r = rows["train/Ikat/motif_jpg.rf.0abc.png"]
    assert (r.width, r.height, r.craft_family, r.hints["stem"]) == (64, 64, "Ikat", "motif") and "folder 'train' is no split of ours" in r.notes
    assert r.phash == pixels.perceptual_hash(img)
    assert "names no design" in rows["train/Ikat/image 3.png"].notes
    assert {(d.path.split("/")[-1], d.reason.split(":")[0].split(" (")[0]) for d in dead.collect()} == {("broken.png", "unreadable"), ("notes.txt", "not an image extension"), ("h_top.png", "no family folder")}
    flat, _ = adapters.build_records(spark, [adapters.SourceConfig("f", f"file://{tmp_path}", "flat", strip_prefixes=("h_",))])
    assert {r.path: r.hints["stem"] for r in flat.collect()}["h_top.png"] == "top"
    with pytest.raises(KeyError, match="unknown adapter"):
        adapters.get_adapter("zip")
    d = pixels.describe(spark.read.format("image").load(f"file://{a}/motif_jpg.rf.0abc.png")).first()
    assert d.noise == pixels.impulse_noise(img) and np.allclose(d.texture, pixels.texture_descriptor(img)) and len(d.texture) == 68


def test_pixel_functions():
    img = texture(5, 160)
    lab = pixels.rgb_to_lab(img)
    assert np.abs(pixels.lab_to_rgb(lab).astype(int) - img).max() <= 1
    assert pixels.hsv_to_rgb([0, 60], [255, 255], [200, 200]).tolist() == [[200, 0, 0], [0, 200, 0]]
    found = pixels.verify_translation(img[:120, :120], img[30:150, 20:140])
    assert found and found["ncc"] > 0.99 and abs(found["overlap"] - 90 * 100 / 120**2) < 0.02
    assert pixels.verify_translation(img[:120, :120], texture(9, 120)) is None
    assert pixels.verify_oriented(img[:120, :120], np.rot90(img[:120, :120]))["ncc"] > 0.99
    noisy = img.copy()
    noisy[::9, ::9] = 255
    assert pixels.impulse_noise(noisy) > pixels.impulse_noise(img) and pixels.impulse_noise(None) == 1.0
    bank = pixels.palette_bank(10, 6, 1)
    pools = pixels.split_palettes(bank, {"train": 4, "val": 3, "test": 3}, 1)
    assert len({p["palette_id"] for pool in pools.values() for p in pool}) == 10
    assert bank[:4] == pixels.palette_bank(4, 6, 1) and all(0 <= c <= 255 for p in bank for rgb in p["colors"] for c in rgb)
    flat = {"crop": [0, 0, 160, 160], "rotation_deg": 0.0, "scale": 1.0}
    assert (pixels.warp(img, flat, 160) == img).all() and (pixels.warp(img, flat | {"perspective": [[0, 0]] * 4}, 160) == img).all()
    assert 0 < np.abs(pixels.warp(img, flat | {"blur_sigma": 0.8}, 160).astype(int) - img).mean() and np.isclose(pixels.blurred(np.ones((5, 7)), 1.3), 1).all()
    square, moved = np.array([[0, 0], [9, 0], [9, 9], [0, 9.0]]), np.array([[1, 0], [9, 1], [8, 9], [0, 8.0]])
    at = pixels.homography(square, moved) @ np.append(square, np.ones((4, 1)), 1).T
    assert np.allclose((at[:2] / at[2]).T, moved)
    two = np.zeros((8, 8), np.uint8)
    two[4:] = 3  # of four clusters two are there
    grey = np.repeat(np.where(two[..., None] > 0, 200, 50), 3, 2).astype(np.uint8)
    for invert in (0.0, 1.0):
        out, inverted = pixels.tonal_remap(grey, two, [[0, 0, 0], [255, 255, 255]], np.random.default_rng(0), invert)
        assert inverted == bool(invert) and (int(out[0, 0].sum()) > int(out[7, 7].sum())) == inverted
    for method in ("kmeans_palette_swap", "lab_hue_chroma_remap", "tonal_remap"):
        out, meta = pixels.recolour(img, method, pools["val"], 7, size=64)
        again, _ = pixels.recolour(img, method, pools["val"], 7, size=64)
        assert out.shape == (64, 64, 3) and (out == again).all() and json.loads(meta["geo_params"])["crop"]
    with pytest.raises(ValueError):
        pixels.recolour(img, "x", bank, 1)
    with pytest.raises(KeyError):
        pixels.recolour(img, "tonal_remap", bank, 1, "pal_999")
    swapped = pixels.palette_swap(img, pixels.cluster_map(img, size=32), bank[0]["colors"], np.random.default_rng(0))
    assert swapped.shape == img.shape
    assert pixels.to_tensor(img, 8).shape == (3, 8, 8) and math.isclose(float(np.linalg.norm(pixels.colour_histogram(img))), 1)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder of images: two crops of one scene, single scenes, and a second source by family with copies."""
    root = tmp_path_factory.mktemp("corpus")
    flat, deep = root / "flat", root / "deep"
    flat.mkdir()
    scene = texture(1, 320)
    (flat / "h_img_1.png").write_bytes(png(scene[:224, :224]))
    (flat / "img_2.png").write_bytes(png(scene[64:288, 64:288]))
    for k in range(5):
        (flat / f"img_{10 + k}.png").write_bytes(png(texture(100 + k, 176)))
    (flat / "notes.txt").write_text("x")
    for f, family in enumerate(("Weave", "Print")):
        for d in range(3):
            img = texture(500 + 50 * f + d, 160)
            for c in range(3 if d == 0 else 1):
                at = deep / ("train", "valid", "test")[(d + c) % 3] / family
                at.mkdir(parents=True, exist_ok=True)
                copy = img.copy()
                if c:
                    copy.reshape(-1, 3)[np.random.default_rng(c).choice(160 * 160, 25, replace=False)] = 255
                (at / f"motif{f}{d}_jpg.rf.{c}abc.png").write_bytes(png(copy))
    return root


def build(spark, root):
    """Folder to manifest: records, duplicates, designs, splits, roles, planned and drawn synthetic images, checks."""
    sources = [adapters.SourceConfig("flat", f"file://{root}/flat", strip_prefixes=("h_",)), adapters.SourceConfig("deep", f"file://{root}/deep", "hierarchical")]
    records, dead = adapters.build_records(spark, sources)
    images = spark.read.format("image").option("recursiveFileLookup", True).load(f"file://{root}").where("image.height > 0")
    rel = F.regexp_extract("image.origin", r"/(?:flat|deep)/(.*)$", 1)
    images = written(images.select(ids.stable_image_id(rel).alias("image_id"), "image"), "images")
    described = pixels.describe(images).select("image_id", "noise", "texture")
    rows = written(records.join(described, "image_id"), "records")
    h = rows.select(F.col("image_id").alias("id"), ids.hex_to_long(F.col("phash")).alias("h"))
    groups = curation.duplicate_groups(h, 4, "exact").select(F.col("id").alias("image_id"), F.col("component").alias("dup_group"))
    reps = curation.representatives(rows.join(groups, "image_id").select("dup_group", F.col("noise").alias("score"), "path", F.col("image_id").alias("id")))
    of = rows.join(groups, "image_id").join(reps, "dup_group").withColumn("is_representative", F.col("image_id") == F.col("representative"))
    thumbs = pixels.thumbnails(images.join(reps.select(F.col("representative").alias("image_id")), "image_id").select(F.col("image_id").alias("id"), "image"))
    one = of.where("is_representative").select(F.col("image_id").alias("id"), F.col("texture").alias("vec"), ids.hex_to_long(F.col("phash")).alias("h"))
    labels, edges = curation.group_designs(one, pixels.pair_verifier(thumbs), id_type="string")
    named = of.join(labels.select(F.col("id").alias("representative"), F.col("component").alias("design_id")), "representative")
    designs = curation.rollup_designs(named).withColumn("forced", F.col("n_views") > 1)
    splits = curation.assign_splits(designs, val_frac=0.25, test_frac=0.25)
    real = curation.real_defaults(curation.assign_roles(named.join(splits, "design_id")))
    pools = pixels.split_palettes(pixels.palette_bank(12, 5, 1), {"train": 4, "val": 4, "test": 4}, 1)
    plan = curation.synthetic_rows(real, methods={"val": "lab_hue_chroma_remap", "test": "lab_hue_chroma_remap"}, palettes={k: [p["palette_id"] for p in v] for k, v in pools.items()}, n_recolor=1, n_tonal=1)
    drawn = written(pixels.render(plan, images, pools, 64), "drawn")
    synthetic = plan.drop("geo_params").join(drawn.select("image_id", "geo_params"), "image_id")
    manifest = curation.demote(schema.conform(real).unionByName(schema.conform(synthetic)))
    return written(manifest, "manifest"), dead, edges, drawn, rows


def test_folder_to_manifest_to_evaluation(spark, corpus):
    manifest, dead, edges, drawn, rows = build(spark, corpus)
    real = manifest.where("NOT is_synthetic")
    of = {r.path: r for r in real.collect()}
    assert len(of) == 7 + 10 and {d.path for d in dead.collect()} == {"notes.txt"}
    assert of["h_img_1.png"].design_id == of["img_2.png"].design_id and of["h_img_1.png"].dup_group != of["img_2.png"].dup_group
    assert len({of[f"img_{10 + k}.png"].design_id for k in range(5)} | {of["img_2.png"].design_id}) == 6
    for f in range(2):
        copies = [r for p, r in of.items() if f"motif{f}0" in p]
        assert len(copies) == 3 and len({r.dup_group for r in copies}) == 1 and sum(r.is_representative for r in copies) == 1 and {r.craft_family for r in copies} == {("Weave", "Print")[f]}
    files_ = real.select("path").unionByName(drawn.select("path"))
    validate.require_valid(manifest, schema.label_map(manifest), files=files_)
    with pytest.raises(ValueError, match="CK-32"):
        validate.require_valid(manifest, schema.label_map(manifest), files=real.select("path"))
    # Every planned image was drawn, of the size asked for, with its parent's parameters recorded.
    assert drawn.count() == manifest.where("is_synthetic").count() > 4
    assert {r.content[:8] for r in drawn.collect()} == {b"\x89PNG\r\n\x1a\n"} and all(json.loads(r.geo_params)["crop"] for r in drawn.collect())
    again = build(spark, corpus)[0]
    key = lambda m: sorted((r.image_id, r.design_id, r.split, r.role, r.geo_params) for r in m.collect())
    assert key(again) == key(manifest)
    # Evaluation: the drawn queries against the gallery by a descriptor of the drawn pixels.
    decoded = {r.image_id: unpng(r.content) for r in drawn.collect()}
    vec = [(k, pixels.colour_histogram(np.repeat(pixels.gray(v)[..., None], 3, 2)).tolist()) for k, v in decoded.items()]
    q = spark.createDataFrame(vec, "id string, vec array<double>").join(manifest.select(F.col("image_id").alias("id"), F.col("design_id").alias("design"), F.col("query_kind"), "split"), "id")
    g = rows.select(F.col("image_id").alias("id"), F.col("texture").alias("vec")).join(manifest.where("role = 'gallery'").select(F.col("image_id").alias("id"), F.col("design_id").alias("design")), "id")
    s = similarity.pair_scores(q.select("id", "vec"), g.select("id", F.slice(F.concat("vec", F.array_repeat(F.lit(0.0), 512)), 1, 512).alias("vec")), id_type="string")
    got = retrieval.summary(retrieval.per_query(s, q, g)).first()
    assert got.n_queries == len(vec) and 0 <= got.rank1 <= got.rank5 <= 1


def unpng(data):
    h, w = struct.unpack(">II", data[16:24])[::-1]
    raw = zlib.decompress(data[41 : 41 + struct.unpack(">I", data[33:37])[0]])
    return np.frombuffer(raw, np.uint8).reshape(h, 1 + 3 * w)[:, 1:].reshape(h, w, 3)


def test_embedding_seam(spark, corpus):
    images = spark.read.format("image").load(f"file://{corpus}/flat").where("image.height > 0")
    got = images.select(embedding.embed(lambda: lambda x: x.mean((2, 3)), size=8).alias("v")).collect()
    assert len(got) == 7 and all(len(r.v) == 3 for r in got)


def test_reports(spark, tmp_path):
    i = spark.createDataFrame([("a", "main_rank1", 0.9, 0.8, 0.95), ("a", "map", 0.5, 0.4, 0.6), ("b", "main_rank1", 0.85, 0.7, 0.9), ("b", "map", 0.7, 0.6, 0.8)], "method string, metric string, value double, low double, high double")
    doc = json.loads(reports.results_json({"intervals": i, "auc": spark.createDataFrame([("a", float("nan"))], "method string, roc_auc double")}))
    assert [d["method"] for d in doc] == ["a", "b"] and doc[0]["auc"] == {"roc_auc": None} and len(doc[1]["intervals"]) == 2
    assert "0.900 [0.800, 0.950]" in reports.results_markdown({"main": reports.cells(i)}, "Results", {"main": "note"})
    text = reports.bars_json(audit.bars_from(i.where("method = 'a'")), "a")
    assert json.loads(text) == {"reference": "a", "guard_least": 0.8, "beat_any": {"map": 0.6}}
    bars = reports.read_bars(spark, text)
    r = i.select("method", F.when(F.col("metric") == "main_rank1", "guard").otherwise(F.col("metric")).alias("metric"), "value")
    verdicts = audit.verdict(bars, r)
    assert {v["method"]: v["verdict"] for v in json.loads(reports.verdict_json(verdicts, r, bars))} == {"a": "FAIL", "b": "SUCCESS"}
    assert "| 250 |" in files.markdown_table(spark.range(251).withColumnRenamed("id", "n"))
    assert "## x" in reports.probe_markdown({"x": ("sentence", i), "y": ("two", "")})
    wanted = spark.createDataFrame([(k,) for k in "abc"], "key string")
    cache = str(tmp_path / "cache")
    make = lambda df: df.withColumn("v", F.lit(1))
    assert [files.append_missing(wanted.limit(2), cache, make), files.append_missing(wanted, cache, make), files.append_missing(wanted, cache, make)] == [2, 1, 0]
    m = spark.createDataFrame([("t", "p/t", "d1"), ("n", "p/n", "d2")], "image_id string, path string, design_id string")
    out = files.write_leakage_audit(spark.createDataFrame([("t", "n", 0.91234)], "image_id string, nearest_image_id string, cosine double"), m, str(tmp_path / "audit"), "x")
    assert one(out) == [("p/t", "d1", "p/n", "d2", 0.9123, "x")]
    images = spark.createDataFrame([(1, "d1", "f", "train", "a"), (2, "d2", "f", "test", "b")], "id long, design_id string, craft_family string, split string, path string")
    mined = audit.numbered_pairs(spark.createDataFrame([(1, 2, 0.5, 0.7)], "i long, j long, cosine double, hue_l1 double"))
    assert one(files.write_mined_pairs(mined, images, str(tmp_path / "mined"))) == [(1, 0.5, 0.7, "d1", "d2", "f", "f", "train", "test", "a", "b")]


def test_small_operators(spark):
    flags = spark.createDataFrame([("s", "a", "b", 0.99, 0.5, x) for x in (float("nan"), 0.44, 0.45, None)], "source string, path_a string, path_b string, ncc double, overlap double, hue_overlap double")
    assert [r.hue_overlap for r in audit.review_flags(flags).collect()] == [0.45]
    assert dict(one(audit.palette_tally(flags))) == {"unmeasurable": 2, "ambiguous": 1, "different": 1}
    assert one(curation.check_pools(spark.createDataFrame([("a", "p"), ("b", "p"), ("a", "q")], "pool string, palette_id string"))) == [("p", 2)]
    assert set(one(curation.first_seen(spark.createDataFrame([("x", 2), ("y", 1), ("x", 5)], "k string, n int"), "k", "n"))) == {("x", 2), ("y", 1)}
    few = curation.sampled_pairs(spark.range(4), 100).collect()
    assert sorted((r.i, r.j) for r in few) == [(a, b) for a in range(4) for b in range(a + 1, 4)]
    many = curation.sampled_pairs(spark.range(200), 50).collect()
    assert len({(r.i, r.j) for r in many}) == 50 and all(r.i != r.j for r in many)
    d = spark.createDataFrame([(f"d{k}", "s", "f", False) for k in range(40)], "design_id string, source string, craft_family string, forced boolean")
    links = spark.createDataFrame([(f"d{k}", f"d{k + 1}") for k in range(0, 30, 3)], "i string, j string")
    split = curation.assign_grouped_splits(d, links, test_frac=0.3)
    assert curation.straddling(split, links).count() == 0 and split.count() == 40 and curation.straddling(curation.assign_splits(d, test_frac=0.3), links).count() > 0
    forced = curation.assign_grouped_splits(d.withColumn("forced", F.col("design_id") == "d1"), links, test_frac=0.0, val_frac=0.0)
    assert {r.design_id for r in forced.where("split = 'test'").collect()} == {"d0", "d1"}
    h = spark.createDataFrame([(1, 0b1111), (2, -1), (3, 0)], "id long, h long")
    q = spark.createDataFrame([(9, [0b111, -2, None])], "id long, hs array<long>")
    assert one(similarity.nearest_hash(q, h)) == [(9, 1, 1, 0)]
    x = spark.createDataFrame([(float(v),) for v in (5, 1, 4, 2, 2)], "x double")
    got = ranges.quantiles(x, "x", {"a": 0.0, "b": 0.5, "c": 0.9, "d": 1.0}).first()
    assert np.allclose(list(got), np.quantile([5, 1, 4, 2, 2], [0, 0.5, 0.9, 1])) and list(ranges.quantiles(x.limit(0), "x", {"a": 0.5}).collect()) in ([], [(None,)])
    big = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v"), (F.col("id") % 3).alias("n"))
    run = ranges.running(big, "v", ["n"], descending=True).orderBy(F.desc("v")).collect()
    n = [r.n for r in run]
    assert [r.place for r in run] == list(range(1, 5001)) and [r.n_run for r in run] == np.cumsum(n).tolist() and [r.n_next for r in run] == [*n[1:], None] and {r.n_all for r in run} == {sum(n)}
    pairs = spark.createDataFrame([(k, float(k % 17), k % 3 == 0) for k in range(300)], "pair_id long, score double, genuine boolean")
    ci = {r.metric: r for r in verification.pair_intervals(pairs, 0.1, 30).collect()}
    assert math.isclose(ci["roc_auc"].value, one(verification.roc_auc(pairs))[0][0]) and all(r.low <= r.value <= r.high for r in ci.values())


def test_files(spark, tmp_path, valid):
    csv = str(tmp_path / "m.csv")
    files.write_manifest(valid, str(tmp_path / "m.parquet"), csv)
    back = files.read_manifest(spark, csv)
    assert back.dtypes == [(f.name, f.dataType.simpleString()) for f in schema.MANIFEST] and sorted(map(str, back.collect())) == sorted(map(str, valid.collect()))
    with pytest.raises(ValueError, match="lacks columns"):
        schema.contract(valid.drop("split"))
    empty = spark.createDataFrame([], "path string, source string, reason string")
    assert one(files.with_placeholder(empty)) == [("none", None, None)]
    assert "Totals" in files.data_summary(valid, empty)
    assert json.loads(files.label_map_json(schema.label_map(valid)))["label_map"] == {"d0": 0}
    with pytest.raises(ValueError, match="unknown keys"):
        files.config_of(adapters.SourceConfig, {"key": "a", "root": "b", "no_such": 1})
    (tmp_path / "l.csv").write_text("a,b\n1,2\n")
    assert files.peek(spark, str(tmp_path / "l.csv")) == {"columns": ["a", "b"], "rows": 1}
    assert [r.path for r in files.read_lines(spark, str(tmp_path / "l.csv")).collect()] == ["a,b", "1,2"]


def test_group_designs_and_sampling(spark):
    rows = spark.createDataFrame([(k, [math.cos(k / 10), math.sin(k / 10)], k) for k in range(6)], "id long, vec array<double>, h long")
    labels, edges = curation.group_designs(rows, lambda c: c.where("j = i + 1 AND i < 3"))
    assert dict(one(labels)) == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5} and edges.count() == 3
    assert {r.component for r in curation.group_designs(rows, lambda c: c.where("j = i + 1"), k=2, all_pairs_up_to=0)[0].collect()} == {0}
    s = curation.seeded_sample(rows, "id", 3).collect()
    assert len(s) == 3 and s == curation.seeded_sample(rows.repartition(3), "id", 3).collect()
    d = spark.createDataFrame([(f"d{k}",) for k in range(9)], "design_id string")
    b = curation.pk_batches(d, 4, 2).collect()
    assert len(b) == 8 and len({(r.batch, r.design_id) for r in b}) == 8
    assert one(schema.with_index(d, "design_id", "n").orderBy("n").select("design_id", "n")) == [(f"d{k}", k) for k in range(9)]
