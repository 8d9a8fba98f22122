import math

import pytest
from pyspark.sql import functions as F

from embervane.functions import confidence, grid, stats, text, vectors


def one(spark, col, rows=None, schema=None):
    df = spark.range(1) if rows is None else spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(col).collect()]


def test_vectors(spark):
    rows, schema = [([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>"
    assert one(spark, vectors.cosine_similarity("a", "b"), rows, schema) == pytest.approx([24 / 25, 0.0])
    assert one(spark, vectors.norm("a"), rows, schema) == [5.0, 0.0]
    assert one(spark, vectors.l2_normalize("a"), rows, schema)[0] == pytest.approx([0.6, 0.8])
    q = one(spark, vectors.dequantise("a"), [([-128, -128],), ([127, -127],)], "a array<int>")
    assert q == [None, [1.0, -1.0]]


def test_pack_orders_by_suffix_and_unpack_checks_width(spark):
    df = spark.createDataFrame([(1.0, 10.0, 2.0)], "embedding_0 double, embedding_10 double, embedding_2 double")
    packed = vectors.pack(df)
    assert packed.first().embedding == [1.0, 2.0, 10.0]
    assert vectors.unpack(packed, 3).columns == ["embedding_0", "embedding_1", "embedding_2"]
    with pytest.raises(Exception, match="has not 4"):
        vectors.unpack(packed, 4).collect()
    with pytest.raises(ValueError):
        vectors.pack(spark.range(1))


def test_ranks_and_robust_z(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 2, 10)] + [("b", 5.0)] * 3, "k string, x double")
    out = stats.with_mad(df, "x", ["k"]).select("k", "x", stats.rank_pct("x", ["k"]).alias("r"), stats.robust_z("x").alias("z"), stats.minmax("x", ["k"]).alias("m"), stats.tail_p("x", ["k"]).alias("p")).collect()
    a = sorted((r.x, r.r) for r in out if r.k == "a")
    assert a == [(1.0, 0.25), (2.0, 0.75), (2.0, 0.75), (10.0, 1.0)]
    assert all(r.z == 0 and r.m == 0 for r in out if r.k == "b")
    assert {r.x: round(r.p, 3) for r in out if r.k == "a"} == {10.0: 0.2, 2.0: 0.6, 1.0: 0.8}


def test_confidence_curve_and_gate(spark):
    xs = [(i / 99, i % 5 == 0) for i in range(100)]
    got = one(spark, confidence.curve("s"), xs, "s double, f boolean")
    assert all(a >= b for a, b in zip(got, got[1:])) and got[0] == 1.0 and min(got) == pytest.approx(0.01, abs=1e-6)
    gated = one(spark, confidence.curve("s", "f"), xs, "s double, f boolean")
    assert all(g == 1.0 for g, (_, f) in zip(gated, xs) if not f) and gated[95] == 1.0
    with pytest.raises(ValueError):
        confidence.curve("s", t=1.0)


def test_robust_confidence(spark):
    z = one(spark, confidence.robust("z", "f"), [(3.0, True), (10.0, True), (99.0, False)], "z double, f boolean")
    assert z == pytest.approx([0.5, 1e-3, 1.0])


def test_fusion_floors_and_unknowns(spark):
    rows = [(0.5, -5.0, 0.0, True), (0.5, None, None, True), (0.5, -5.0, 0.0, False), (0.5, 5.0, 1.0, True)]
    got = one(spark, confidence.fuse("c", "m", "p", "f"), rows, "c double, m double, p double, f boolean")
    assert got == pytest.approx([0.5 * 0.85**2, 0.5, 0.5, 0.5])
    assert one(spark, confidence.fuse("c"), rows, "c double, m double, p double, f boolean") == [0.5] * 4


def test_trust_attenuation(spark):
    got = one(spark, confidence.attenuate("c", "t", "f"), [(0.2, 0.9, True), (0.2, 0.05, True), (0.2, 0.05, False), (0.2, None, True)], "c double, t double, f boolean")
    assert got[0] == pytest.approx(0.2) and got[1] > 0.6 and got[2] == 0.2 and got[3] == pytest.approx(0.2)


def test_sample_weights(spark):
    c = [(0.2,), (0.9,)]
    w = lambda *a, **k: one(spark, confidence.sample_weight("c", *a, **k), c, "c double")
    assert w("none") == w("filter") == [None, None] and w("linear") == [0.2, 0.9] and w("power", power=2.0) == pytest.approx([0.04, 0.81])
    assert w("clip", lo=0.5, hi=0.8) == [0.5, 0.8] and w("affine", scale=2.0, shift=1.0, hi=2.0) == pytest.approx([1.4, 2.0])
    assert w("affine", scale=2.0, shift=-1.0) == pytest.approx([0.0, 0.8])
    with pytest.raises(Exception, match="finite"):
        one(spark, confidence.sample_weight("c"), [(float("nan"),)], "c double")
    weighed = spark.createDataFrame([(0.0,), (-1.0,)], "weight double")
    with pytest.raises(ValueError):
        confidence.check_weights(weighed)
    assert confidence.check_weights(weighed.limit(0)).count() == 0
    for bad in (dict(mode="power", power=0.0), dict(mode="x")):
        with pytest.raises(ValueError):
            confidence.sample_weight("c", **bad)


def test_hexagon_ids(spark):
    cells = [("8928308280fffff",), ("83194dfffffffff",)]
    assert one(spark, grid.hex_resolution("c"), cells, "c string") == [9, 3]
    assert one(spark, grid.hex_parent("c", 2), cells, "c string")[1] == "82194ffffffffff"
    assert one(spark, grid.hex_parent("c", 8), cells, "c string") == ["8828308281fffff", None]


def test_quadtree(spark):
    rows = [(0.0, 0.0), (-90.0, -180.0), (90.0, 179.99)]
    cells = one(spark, grid.Quad.cell("lat", "lon", 4), rows, "lat double, lon double")
    assert cells == ["q4_8_8", "q4_0_0", "q4_15_15"]
    c = [(x,) for x in cells]
    assert one(spark, grid.Quad.parent("c", 2, 4), c, "c string") == ["q2_2_2", "q2_0_0", "q2_3_3"]
    disks = one(spark, grid.Quad.disk("c", 4), c, "c string")
    assert [len(d) for d in disks] == [9, 6, 6] and "q4_15_0" in disks[1] and "q4_0_15" in disks[2]
    assert one(spark, grid.Quad.level("c"), c, "c string") == [4, 4, 4]


def test_text(spark):
    codes = [("11-01-00",), (" 110 ",), ("110.0",), ("1.1E2",), (None,)]
    assert one(spark, text.clean_code("c"), codes, "c string") == ["110100", "110", "110", "110", None]
    assert one(spark, text.flag_name(text.flag_rank("c")), [("Suspect ",), (None,), ("candidate",)], "c string") == ["suspect", "normal", "candidate"]
    assert one(spark, text.in_classes("c", ["A "]), [("a",), (None,), ("b",)], "c string") == [True, False, False]
    a = spark.createDataFrame([(1, "x")], "b int, a string").select(text.column_fingerprint(["b", "a"])).first()[0]
    assert a == spark.createDataFrame([("x", 1)], "a string, b int").select(text.column_fingerprint(["a", "b"])).first()[0] and len(a) == 64


def test_sigmoid_is_clipped(spark):
    assert one(spark, stats.sigmoid(F.lit(1e6)))[0] == pytest.approx(1 / (1 + math.exp(-50)))
