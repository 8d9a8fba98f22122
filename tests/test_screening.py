import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from embervane.functions import text, vectors
from embervane.operators import context, evaluation, flagging, kernels, scoring, slices


def frame(spark, x, **cols):
    names = list(cols)
    rows = [(f"s{i:04d}", [float(v) for v in x[i]], *[cols[c][i] for c in names]) for i in range(len(x))]
    kinds = {c: "string" if isinstance(cols[c][0], str) else "boolean" if isinstance(cols[c][0], bool) else "double" if isinstance(cols[c][0], float) else "long" for c in names}
    return spark.createDataFrame(rows, ", ".join(["sample_id string", "embedding array<float>", *[f"{c} {kinds[c]}" for c in names]]))


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def around(rng, axis, n, dim, width):
    x = np.zeros((n, dim))
    x[:, axis] = 1
    return x + rng.normal(0, width, (n, dim))


def knn(x, k):
    d = 1 - unit(x) @ unit(x).T
    np.fill_diagonal(d, np.inf)
    return np.sort(d, axis=1)[:, :k].mean(1)


@pytest.mark.parametrize("n", [2, 9, 80, 200])
def test_knn_distance_equals_numpy(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 16)).astype(np.float32)
    got = kernels.knn_distance(frame(spark, x, k=["a"] * n), ["k"], "sample_id").orderBy("sample_id").collect()
    k = kernels.effective_k(n, 10)
    assert [r.knn_distance for r in got] == pytest.approx(knn(x.astype(float), k))
    assert k == min(max(10, min(int(math.sqrt(n)), 50)), n - 1)


def test_a_slice_of_one_and_duplicates(spark):
    x = np.array([[1.0, 0.0]] * 3 + [[0.0, 1.0]])
    got = {r.sample_id: r.knn_distance for r in kernels.knn_distance(frame(spark, x, k=["a", "a", "a", "b"]), ["k"], "sample_id").collect()}
    assert got["s0000"] == pytest.approx(0, abs=1e-9) and got["s0003"] == 0


def test_blocks_do_not_change_distances(spark, monkeypatch):
    x = np.random.default_rng(0).normal(size=(70, 8))
    whole = kernels.knn_distance(frame(spark, x, k=["a"] * 70), ["k"], "sample_id").orderBy("sample_id").collect()
    monkeypatch.setattr(kernels, "BLOCK", 16)
    assert [r.knn_distance for r in whole] == pytest.approx(knn(x.astype(np.float32).astype(float), 10))


def test_outliers_score_high_and_small_slices_zero(spark):
    rng = np.random.default_rng(42)
    x = unit(around(rng, 0, 200, 32, 0.1))
    x[-10:] = -x[:10]
    df = frame(spark, np.concatenate([x, x[:49]]), k=["a"] * 200 + ["b"] * 49)
    got = {r.sample_id: r for r in scoring.score_slices(df, ["k"], "sample_id").collect()}
    top = sorted((r for r in got.values() if r.k == "a"), key=lambda r: -r.mean_score)[:10]
    assert {r.sample_id for r in top} == {f"s{i:04d}" for i in range(190, 200)}
    small = [r for r in got.values() if r.k == "b"]
    assert len(small) == 49 and all(r[s] == 0 for r in small for s in scoring.SCORES) and not any(r.scored for r in small)
    assert all(0 <= r[s] <= 1 for r in got.values() for s in ("S", "S_rank", "S_rank_min", "S_z", "rank_percentile", "mean_score", "cos_norm"))


def test_partitioning_does_not_change_scores(spark):
    x = np.random.default_rng(1).normal(size=(120, 8))
    df = frame(spark, x, k=["a", "b"] * 60)
    a, b = (scoring.score_slices(df.repartition(n), ["k"], "sample_id").orderBy("sample_id").select("S", "mean_score").collect() for n in (1, 7))
    assert np.allclose(a, b)


def test_trimmed_centroid_resists_contamination(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([around(rng, 0, 90, 16, 0.02), around(rng, 1, 10, 16, 0.02)])
    df = frame(spark, x, k=["a"] * 100)
    off = {m: np.array(scoring.slice_centroids(df, ["k"], "sample_id", m).first().centroid)[1] for m in ("mean", "median", "trimmed")}
    assert off["trimmed"] < 0.01 < off["mean"] and off["median"] < 0.05
    few = frame(spark, x[[0, 1, 95]], k=["a"] * 3)
    assert np.allclose(scoring.trimmed_centroids(few, ["k"], "sample_id").first().centroid, x[[0, 1, 95]].astype(np.float32).mean(0), atol=1e-6)
    with pytest.raises(ValueError):
        scoring.slice_centroids(df, ["k"], "sample_id", "mode")


def scored(spark, n=200):
    rng = np.random.default_rng(3)
    s = np.concatenate([rng.uniform(0, 0.9, n - 10), np.linspace(0.95, 1, 10)])
    return spark.createDataFrame([(f"s{i:04d}", "a", float(v)) for i, v in enumerate(s)], "sample_id string, k string, S double")


def n_flagged(df, **a):
    return flagging.flag(df, ["k"], "sample_id", **a).where("flagged").count()


def test_flag_modes(spark):
    df = scored(spark)
    assert n_flagged(df, mode="percentile", q=0.95) == 10 and n_flagged(df, mode="absolute", threshold=0.95) == 10
    assert n_flagged(df, mode="percentile", q=0.8, at_most=0.05) == 10 and n_flagged(df, mode="absolute", threshold=2.0, at_least=7) == 7
    assert n_flagged(df, mode="percentile", q=0.8, at_most=0.01, at_least=5) == 5
    assert n_flagged(df, mode="fdr", alpha=0.05) == 0
    for bad in ("mode", "absolute"):
        with pytest.raises(ValueError):
            n_flagged(df, mode=bad)
    flat = spark.createDataFrame([(str(i), "a", 0.5 if i < 60 else 0.6 + i / 1000) for i in range(100)], "sample_id string, k string, S double")
    assert n_flagged(flat, mode="mad", k=3.0) == 0


def test_unscored_slices_are_never_flagged(spark):
    df = spark.createDataFrame([(str(i), "a", 0.0, False) for i in range(20)], "sample_id string, k string, S double, scored boolean")
    assert n_flagged(df, mode="percentile") == 20 and n_flagged(df, mode="percentile", scored="scored") == 0


def test_grades(spark):
    rows = [(1, True, 0.995, 0.995, 0.995, 0.995, 0.995, False), (2, True, 0.985, 0.96, 0.985, 0.985, 0.1, False), (3, True, 0.5, 0.5, 0.5, 0.5, 0.5, False), (4, False, 1.0, 1.0, 1.0, 1.0, 1.0, False), (5, True, 0.995, 0.995, 0.995, 0.995, 0.995, True)]
    df = spark.createDataFrame(rows, "i int, flagged boolean, rank_percentile double, S double, S_rank double, S_rank_min double, S_z double, small boolean")
    got = [(r.S_anomaly, r.anomaly_flag) for r in flagging.grades(df, "small").orderBy("i").collect()]
    assert got == [("candidate",) * 2, ("suspect",) * 2, ("flagged",) * 2, ("normal",) * 2, ("flagged",) * 2]


def test_trust_downgrades(spark):
    df = spark.createDataFrame([("candidate", 0.9), ("candidate", 0.4), ("candidate", 0.1), ("suspect", 0.1), ("suspect", None), ("flagged", 0.0)], "f string, t double")
    assert [r[0] for r in df.select(flagging.downgrade("f", "t")).collect()] == ["candidate", "suspect", "flagged", "flagged", "suspect", "flagged"]


def test_margins_of_opposites_and_of_one_label(spark):
    rng = np.random.default_rng(0)
    a = unit(around(rng, 0, 30, 16, 0.1))
    df = frame(spark, np.concatenate([a, -a, a[:20]]), label=["A"] * 30 + ["B"] * 30 + ["A"] * 20, ctx=["x"] * 60 + ["y"] * 20)
    got = context.margins(df, ["ctx"], "label").collect()
    x = [r for r in got if r.ctx == "x"]
    assert all(r.alt_label != r.label and r.alt_margin > 1 and r.context_n_labels == 2 for r in x)
    assert all(r.alt_label is None and r.alt_margin is None for r in got if r.ctx == "y")


def test_purity(spark):
    x = np.random.default_rng(0).normal(size=(60, 8))
    df = frame(spark, x, label=["A"] * 60, ctx=["x"] * 60, flagged=[i >= 55 for i in range(60)])
    got = context.purity(df, "flagged", ["ctx"], "label", "sample_id", k=5).collect()
    assert all((r.same_label_frac == 1.0 and r.majority_label == "A") if r.flagged else r.same_label_frac is None for r in got) and len(got) == 60
    assert context.purity(df.withColumn("flagged", F.lit(False)), "flagged", ["ctx"], "label", "sample_id").where("same_label_frac IS NOT NULL").count() == 0


def test_trust_of_separated_and_entangled_classes(spark):
    rng = np.random.default_rng(0)
    apart = np.concatenate([around(rng, 0, 60, 16, 0.05), around(rng, 1, 60, 16, 0.05)])
    mixed = around(rng, 0, 120, 16, 1.0)
    df = frame(spark, np.concatenate([apart, mixed, apart[:10]]), label=(["A"] * 60 + ["B"] * 60) * 2 + ["A"] * 10, ctx=["s"] * 120 + ["e"] * 120 + ["few"] * 10)
    t = {r.ctx: r.slice_trust for r in context.trust(df, ["ctx"], "label", "sample_id").collect()}
    assert t["s"] > 0.8 and t["e"] < 0.5 and t["few"] == 0.5


def test_other_groups_expose_a_wrong_one(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([around(rng, 0, 48, 16, 0.05), around(rng, 1, 6, 16, 0.01)])
    df = frame(spark, x, k=["a"] * 54, parcel=[f"p{i // 6}" for i in range(54)])
    s = scoring.score_other_groups(df, ["k"], "sample_id", "parcel")
    top = scoring.roll_up(s, "parcel", "S_group", "k").orderBy(F.desc("median_S_group")).first()
    assert (top.parcel, top.n, top.majority_label) == ("p8", 6, "a")
    alone = kernels.knn_other_groups(df.where("parcel = 'p0'"), ["k"], "sample_id", "parcel").collect()
    assert all(r.knn_distance == 0 for r in alone)


def test_reference_levels_and_hierarchy(spark):
    x = np.random.default_rng(0).normal(size=(210, 8))
    df = frame(spark, x, fine=["wheat"] * 10 + ["maize"] * 200, coarse=["crop"] * 210, cell=["c"] * 210)
    ref = slices.reference_level(df, ["fine", "coarse"], ["cell"], 50)
    assert {(r.fine, r.ref_level, r.ref_class, r.ref_group_n) for r in ref.collect()} == {("wheat", 1, "crop", 210), ("maize", 0, "maize", 200)}
    got = scoring.score_hierarchy(ref, ["fine", "coarse"], ["cell"], "sample_id", 50).collect()
    assert len(got) == 210 and all(r.scored for r in got)
    alone = {r.sample_id: r.S for r in scoring.score_slices(df.where("fine = 'maize'"), ["fine"], "sample_id").collect()}
    assert all(r.S == pytest.approx(alone[r.sample_id]) for r in got if r.fine == "maize")


def test_small_slices_merge_into_the_largest_neighbour(spark):
    rows = [("crop", "d")] * 120 + [("crop", "c")] * 5 + [("forest", "f")] * 80
    df = spark.createDataFrame(rows, "code string, cell string")
    near = spark.createDataFrame([(a, b) for a in "dcf" for b in "dcf" if a != b], "cell string, neighbour string")
    got = {(r.code, r.cell): (r.n, r.u) for r in slices.merge_small(df, near, "code", min_size=50).groupBy("code", "cell").agg(F.count("*").alias("n"), F.max("undersized_slice").alias("u")).collect()}
    assert got == {("crop", "d"): (125, False), ("forest", "f"): (80, False)}
    got = {r.cell: r.undersized_slice for r in slices.merge_small(df.where("code = 'forest'"), near, "code", min_size=100).collect()}
    assert got == {"f": True}


def test_adaptive_levels(spark):
    rows = [(i, "a", "x", f"x{i % 3}") for i in range(30)] + [(i, "a", "y", "y0") for i in range(30, 35)]
    df = spark.createDataFrame(rows, "id int, lab string, c0 string, c1 string")
    got = {(r.cell, r.cell_level): r["count"] for r in slices.adaptive_level(df, [(1, "c0"), (2, "c1")], "lab", max_slice_size=10).groupBy("cell", "cell_level").count().collect()}
    assert got == {("x0", 2): 10, ("x1", 2): 10, ("x2", 2): 10, ("y", 1): 5}
    assert slices.adaptive_level(df, [(1, "c0"), (2, "c1")], "lab").where("cell_level = 1").count() == 35
    with pytest.raises(ValueError):
        slices.adaptive_level(df, [(1, "zz")], "lab")


def test_class_mapping(spark):
    df = spark.createDataFrame([(1, "11-01"), (2, "22"), (3, "99")], "i int, code string")
    m = spark.createDataFrame([("1101", "a"), ("2-2", "b")], "k string, cls string")
    assert [r.cls for r in slices.map_classes(df, m, "code", "k", ["cls"]).orderBy("i").collect()] == ["a", "b", None]
    with pytest.raises(ValueError):
        slices.map_classes(df, m.union(m), "code", "k", ["cls"])


def noisy_frame(spark):
    rng = np.random.default_rng(0)
    x, lab, cell, parcel = [], [], [], []
    for c in range(2):
        for k in range(3):
            x.append(around(rng, 3 * c + k, 90, 24, 0.12))
            lab += [f"l{k}"] * 90
            cell += [f"c{c}"] * 90
            parcel += [f"p{c}{k}{i // 6}" for i in range(90)]
    return frame(spark, np.concatenate(x), label=lab, cell=cell, parcel=parcel)


def test_noise_and_its_detection(spark):
    df = noisy_frame(spark)
    noisy = evaluation.add_noise(df, evaluation.Noise("within_context", 0.1, "label", "cell"), "sample_id").cache()
    hit = noisy.where("noise_truth").collect()
    assert len(hit) == 54 and all(r.label != r.label_noisy for r in hit) and noisy.where("NOT noise_truth AND label <> label_noisy").count() == 0
    m = evaluation.detection_metrics(evaluation.screen(noisy, ["cell", "label_noisy"], "sample_id"), "noise_truth", "S", "flagged", only="scored").first()
    assert m.auroc > 0.85 and m.average_precision > 0.6 and m.n == 540 and 0 < m.flag_recall <= 1
    g = evaluation.add_noise(df, evaluation.Noise("group", 0.1, "label", group="parcel", seed=1), "sample_id")
    per = g.groupBy("parcel").agg(F.count_distinct("label_noisy").alias("k"), F.max("noise_truth").alias("t"), F.min("noise_truth").alias("u")).collect()
    assert sum(r.t for r in per) == 9 and all(r.k == 1 and r.t == r.u for r in per)
    for bad in (evaluation.Noise("x"), evaluation.Noise("group")):
        with pytest.raises(ValueError):
            evaluation.add_noise(df, bad, "sample_id")


def test_detection_metrics_equal_pairs(spark):
    r = np.random.default_rng(5)
    s, y = r.integers(0, 12, 80) / 10, r.random(80) < 0.3
    df = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(s, y)], "s double, y boolean")
    m = evaluation.detection_metrics(df, "y", "s").first()
    pos, neg = s[y], s[~y]
    assert m.auroc == pytest.approx(np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]))
    ap = sum(((s >= t) & y).sum() / (s >= t).sum() * (y & (s == t)).sum() for t in np.unique(s)) / y.sum()
    assert m.average_precision == pytest.approx(ap) and 0 <= m.precision_at_05 <= 1


@pytest.mark.parametrize("name", ["global", "isolation_forest", "lof", "spatial_disagreement"])
def test_detectors(spark, name):
    df = evaluation.add_noise(noisy_frame(spark), evaluation.Noise("random", 0.05, "label"), "sample_id")
    got = evaluation.DETECTORS[name](df, "label_noisy", "sample_id", **({"cell": "cell"} if name == "spatial_disagreement" else {}))
    assert got.count() == 540 and got.where("S IS NOT NULL").agg(F.max("S")).first()[0] > 0


def test_planted_outlier_is_isolated(spark):
    x = np.concatenate([np.random.default_rng(0).normal(0, 1, (300, 4)), np.full((3, 4), 9.0)])
    got = kernels.isolation_forest(frame(spark, x), "sample_id").orderBy(F.desc("score")).limit(3).collect()
    assert {r.sample_id for r in got} == {"s0300", "s0301", "s0302"}
    got = kernels.lof(frame(spark, x[:301], k=["a"] * 301), ["k"], "sample_id").orderBy(F.desc("lof")).first()
    assert got.sample_id == "s0300"


def factors(x, k=20):
    """Local outlier factors, a row at a time; ties go to the smaller row."""
    x = x.astype(np.float32).astype(float)
    n, k = len(x), min(k, max(2, len(x) - 1), len(x) - 1)
    d = np.array([np.sqrt(((x - v) ** 2).cumsum(1)[:, -1]) for v in x])
    np.fill_diagonal(d, np.inf)
    near = np.array([np.lexsort((np.arange(n), r))[:k] for r in d])
    kd = d[np.arange(n), near[:, -1]]
    lrd = 1 / (np.maximum(np.take_along_axis(d, near, 1), kd[near]).mean(1) + 1e-10)
    return lrd[near].mean(1) / lrd


def lof_frames():
    r = np.random.default_rng(8)
    copies = r.normal(size=(450, 8))
    copies[50:200], copies[300:306], copies[0] = copies[7], copies[8], 1e6
    return {"plain": r.normal(size=(450, 8)) + 1e3, "copies": copies, "ties": r.integers(0, 3, (450, 4)).astype(float), "close": copies[7] + r.normal(0, 1e-5, (450, 8))}


@pytest.mark.parametrize("name", list(lof_frames()))
@pytest.mark.parametrize("stripe", [4096, 64 << 20])
def test_lof_of_all_rows_has_no_limit(spark, monkeypatch, name, stripe):
    for limit, v in (("MAX_GROUP", 200), ("WIDE_BLOCK", 64), ("STRIPE", stripe)):
        monkeypatch.setattr(kernels, limit, v, raising=False)
    x = lof_frames()[name]
    got = kernels.lof(frame(spark, x).repartition(5, F.reverse("sample_id")), [], "sample_id").orderBy("sample_id").collect()
    assert [r.lof for r in got] == pytest.approx(factors(x), rel=1e-9)


@pytest.mark.parametrize("name", ["copies", "ties"])
def test_lof_of_a_slice_with_copies_and_ties(spark, name):
    x = lof_frames()[name]
    got = kernels.lof(frame(spark, x, k=["a"] * 450).orderBy(F.desc("sample_id")), ["k"], "sample_id").orderBy("sample_id").collect()
    assert [r.lof for r in got] == pytest.approx(factors(x), rel=1e-9)


@pytest.mark.parametrize("n", [1, 2, 3, 22])
def test_lof_of_few_rows_and_of_rows_without_a_vector(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 4))
    df = frame(spark, x).unionByName(spark.createDataFrame([("t0", None), ("t1", [1.0, float("nan"), 0.0, 0.0])], "sample_id string, embedding array<float>"))
    got = [r.lof for r in kernels.lof(df, [], "sample_id").orderBy("sample_id").collect()]
    assert got[:n] == pytest.approx(factors(x) if n > 1 else [1.0]) and got[n:] == [None, None]


def test_scenarios_views_and_splits(spark):
    flags = ["normal", "flagged", "suspect", "candidate"]
    df = spark.createDataFrame([(i, flags[i % 4], None if i == 7 else (i % 100) / 50, [50, 95, 100][i % 3], f"g{i % 9}") for i in range(400)], "i long, anomaly_flag string, confidence double, q int, g string")
    n = {s.name: evaluation.apply_scenario(df, s).count() for s in evaluation.SCENARIOS}
    assert n["baseline"] == 400 and n["drop_candidate"] == 300 and n["drop_flagged"] == 100 and n["filter_05"] == 301
    w = evaluation.apply_scenario(df, evaluation.Scenario("w", (), "linear", floor=0.3)).agg(F.min("weight"), F.max("weight")).first()
    assert w[0] == 0.3 and w[1] == 1.0
    assert evaluation.test_view(df, "clean", quality="q").count() == df.where("q >= 90").count() and evaluation.test_view(df, "minus_flagged").count() == 100
    with pytest.raises(ValueError):
        evaluation.test_view(df, "x")
    split = evaluation.split_rows(df, "i", group="g")
    assert split.groupBy("g").agg(F.count_distinct("split").alias("k")).where("k > 1").count() == 0
    assert evaluation.split_rows(df, "i", strata="anomaly_flag", test=0.25).where("split = 'test'").groupBy("anomaly_flag").count().where("count = 25").count() == 4


def test_classification_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "y string, p string")
    m = evaluation.classification_metrics(df, "y", "p").first()
    f = {"a": 0.5, "b": 2 / 3, "c": 0.0}
    assert m.accuracy == 0.5 and m.f1_macro == pytest.approx(sum(f.values()) / 3) and m.f1_weighted == pytest.approx((2 * f["a"] + f["b"]) / 4)


def test_escalation_and_neutral_classes(spark):
    df = spark.createDataFrame([("Crops ", "candidate", 0.2, "flagged", 0.6), ("crops", "candidate", 0.2, "normal", 1.0), ("forest", "candidate", 0.2, "flagged", 0.6)], "c string, fa string, ca double, fb string, cb double")
    got = [(r.fb, r.cb) for r in flagging.escalate(df, "c", "crops", "fa", "ca", "fb", "cb").collect()]
    assert got == [("suspect", pytest.approx(0.4)), ("normal", 1.0), ("flagged", 0.6)]
    assert [r.fa for r in flagging.neutralise(df, "c", ["CROPS"], "ca", "fa").collect()] == ["normal", "normal", "candidate"]
    assert text.FLAGS[0] == "normal" and vectors is not None


def test_merging_follows_chains(spark):
    r = random.Random(2)
    n = {c: r.choice((1, 1, 2, 3, 9, 20)) for c in range(40) if r.random() < 0.8}
    near = [(c, c + d) for c in n for d in (-1, 1) if c + d in n]
    counts = spark.createDataFrame([(0, c, k) for c, k in n.items()], "lab int, cell long, n long")
    edges = spark.createDataFrame(near, "cell long, neighbour long")
    got = {x.cell: x.target for x in slices.merge_map(counts, edges, ["lab"], "cell", 5).collect()}
    now, before = {c: c for c in n}, None
    for _ in range(10):
        size = {}
        for c, t in now.items():
            size[t] = size.get(t, 0) + n[c]
        small = {t for t, k in size.items() if k < 5}
        if not small or (before is not None and before - len(small) < 0.05 * before):
            break
        before, to = len(small), {}
        for t in small:
            options = [(-size[b], b) for a, b in near if a == t and b in size]
            if options:
                to[t] = min(options)[1]
        if not to:
            break
        now = {c: to.get(t, t) for c, t in now.items()}
    assert got == now
