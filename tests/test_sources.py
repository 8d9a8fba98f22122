import json

import pytest
from pyspark.sql import functions as F

from embervane.functions import grid
from embervane.plans import screening
from embervane.sources import cache, files, sinks
from embervane.streaming import rescoring


def test_cache_life(spark, tmp_path):
    c = cache.EmbeddingCache(spark, str(tmp_path / "cache"))
    c.init()
    c.init()
    row = lambda i: (str(i), "r", "1", "x", float(i), None if i == 3 else 2.0, [float(i), 1.0])
    schema = "sample_id string, ref_id string, label_code string, cell string, lat float, lon float, embedding array<float>"
    c.insert(spark.createDataFrame([row(1), row(2), row(2)], schema), "m")
    c.insert(spark.createDataFrame([row(2), row(3)], schema), "m")
    c.insert(spark.createDataFrame([row(9)], schema), "other")
    assert sorted(r.sample_id for r in c.scan("m").collect()) == ["1", "2", "3"]
    want = spark.createDataFrame([("2", "r"), ("3", None), ("7", "r")], "sample_id string, ref_id string")
    assert sorted(r.sample_id for r in c.hits(want, "m").collect()) == ["2", "3"] and c.fetch(want, "m").count() == 2
    assert sorted(r.sample_id for r in c.missing(want, "m").collect()) == ["3", "7"]
    c.recompute_cells(grid.Quad.cell("lat", "lon", 3), "m")
    assert {r.sample_id: r.cell for r in c.scan("m").collect()}["3"] == "x"
    c.delete(want, "m")
    assert [r.sample_id for r in c.scan("m").collect()] == ["1"] and c.scan("other").count() == 1
    filled = c.fill(spark.createDataFrame([row(1)[:6], row(5)[:6]], schema.rsplit(",", 1)[0]), "m", lambda d: d.withColumn("embedding", F.array(F.lit(0.5).cast("float"))))
    assert sorted(r.sample_id for r in filled.collect()) == ["1", "5"] and cache.width(c.scan("m")) == 2


def test_unified_and_one_per_id(spark):
    e = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "sample_id string, embedding array<double>")
    s = spark.createDataFrame([("a", "x"), ("b", None), ("z", "y")], "sample_id string, label string")
    assert [r.sample_id for r in cache.unified(e, s, "label").collect()] == ["a"]
    d = spark.createDataFrame([("a", 2), ("a", 1), (None, 0)], "sample_id string, t int")
    assert [tuple(r) for r in cache.one_per_id(d, "sample_id", ["t"]).collect()] == [("a", 1)]


def test_mapping_shapes(spark, tmp_path):
    load = lambda src, labels=("lab",), name=None: {r.code: tuple(r)[1:] for r in files.load_mapping(spark, src, list(labels), name).collect()}
    assert load({"1-1": "a"}) == load({"11": ["a"]}) == load({"11": {"lab": "a"}}) == load({"L": {"11": "a"}}, name="L") == load([{"my_code": "11", "label": "a"}]) == {"11": ("a",)}
    p = tmp_path / "m.json"
    p.write_text(json.dumps({"A": {"11": "a"}, "B": {"11": "b"}}))
    assert load(str(p), ("x", "y")) == {"11": ("a", "b")}
    (tmp_path / "m.csv").write_text("code,lab\n11,a\n")
    assert load(str(tmp_path / "m.csv")) == {"11": ("a",)}
    for bad in (str(tmp_path / "m.xlsx"), {"1": ["a", "b"]}, [{"x": 1}]):
        with pytest.raises(ValueError):
            load(bad)


def test_legend(spark, tmp_path):
    df = spark.createDataFrame([("1-0", "a", " "), ("10", "b", "c"), (None, "d", "e")], "code string, L1 string, L2 string").coalesce(1)
    got = files.legend_mappings(df, "code", ["L1", "L2"])
    assert {tuple(r) for r in got.collect()} == {("L1", "10", "b"), ("L2", "10", "c")}
    files.write_mappings(got, str(tmp_path / "o.json"))
    assert json.loads((tmp_path / "o.json").read_text()) == {"L1": {"10": "b"}, "L2": {"10": "c"}}


def test_mappings_beyond_the_limit_are_refused(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("L1", str(i), "a") for i in range(4)], "mapping string, code string, label string")
    monkeypatch.setattr(files, "MAX_MAPPING_ROWS", 3, raising=False)
    with pytest.raises(ValueError):
        files.write_mappings(df, str(tmp_path / "o.json"))
    assert not (tmp_path / "o.json").exists()
    files.write_mappings(df.limit(3), str(tmp_path / "o.json"))
    assert len(json.loads((tmp_path / "o.json").read_text())["L1"]) == 3


def test_discovery(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "in/ref_id=a"))
    spark.range(1).coalesce(1).write.parquet(str(tmp_path / "flat"))
    assert {r.ref_id for r in files.discover(spark, str(tmp_path / "in")).collect()} == {"a"}
    assert files.discover(spark, str(tmp_path / "flat")).first().ref_id.startswith("part-")
    with pytest.raises(FileNotFoundError):
        files.discover(spark, str(tmp_path / "none"))
    assert files.has_columns(spark, str(tmp_path / "flat"), ["id"]) and not files.has_columns(spark, str(tmp_path / "flat"), ["x"])


def test_points(spark, tmp_path):
    (tmp_path / "p.csv").write_text("sample_id,field_lat,field_lon,site_lat,site_lon,year,crop\n1,,,5,6,2020, Wheat\n2,1,2,3,4,x,maize\n3,1,2,,,2021,rye\n3,1,2,,,2021,rye\n")
    got = {r.sample_id: tuple(r)[1:] for r in files.points_csv(spark, str(tmp_path / "p.csv"), {"wheat": 11}, 99).collect()}
    assert got == {"1": (5.0, 6.0, 2020, 11), "3": (1.0, 2.0, 2021, 99)}
    p = spark.createDataFrame([("a", 1.0, 1.0, 1), ("b", 0.0, 0.0, 1), ("c", 50.0, 50.0, 1), ("d", 1.0, 1.0, 2)], "sample_id string, lon double, lat double, year int")
    t = spark.createDataFrame([("t1", -2.0, 0.0, -2.0, 0.0, 1), ("t2", -0.5, 3.0, -0.5, 3.0, 1)], "tile string, x0 double, x1 double, y0 double, y1 double, year int")
    assert {r.sample_id: r.tile for r in files.points_in_tiles(p, t).collect()} == {"a": "t2", "b": "t2"}
    assert sinks.with_point(p, "lon", "lat").first().geometry[:5] == b"\x01\x01\x00\x00\x00"


def test_write_back(spark, tmp_path):
    rows = spark.createDataFrame([("r", "a", 1, 0.1), ("r", "a", 2, 0.1), ("r", "b", 1, 0.2), ("q", "a", 1, 0.3)], "ref_id string, sample_id string, t int, conf double")
    new = spark.createDataFrame([("r", "a", 0.9)], "ref_id string, sample_id string, conf double")
    got = sinks.merge_scores(rows, new, ["ref_id", "sample_id"], ["conf"])
    assert sorted(r.conf for r in got.collect()) == [0.2, 0.3, 0.9, 0.9]
    path = str(tmp_path / "long")
    sinks.write_long(got, path)
    sinks.write_long(got.where("ref_id = 'q'").withColumn("conf", F.lit(0.0)), path)
    assert sorted(r.conf for r in spark.read.parquet(path).collect()) == [0.0, 0.2, 0.9, 0.9]
    assert sinks.changed(rows, got, ["ref_id", "sample_id", "t"], ["conf"]).count() == 2
    assert [r.sample_id for r in sinks.unscored(rows.withColumn("conf", F.when(F.col("sample_id") != "b", F.col("conf"))), ["conf"]).collect()] == ["b"]
    assert sinks.unscored(rows, ["absent"]).count() == 2
    sinks.write_regions(rows.withColumn("region", F.lit("a b")), str(tmp_path / "reg"))
    assert (tmp_path / "reg/region=a_b").exists()
    sinks.missing_csv(rows, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    assert sinks.add_stub(rows, ["x"]).where("x IS NULL").count() == 4


def test_unify(spark):
    a, b = spark.createDataFrame([(1, 2.5)], "x int, y double"), spark.createDataFrame([("s", 3)], "x string, y int")
    u = sinks.unify([a, b])
    assert dict(u.dtypes) == {"x": "string", "y": "float"} and u.count() == 2


def cells(spark, n=240):
    import random

    r = random.Random(0)
    rows = []
    for i in range(n):
        k = i % 2
        v = [r.gauss(1 if j == k else 0, 0.1) for j in range(8)]
        rows.append((f"s{i}", f"r{i % 3}", f"q3_{(i // 80) * 2}_1", "ab"[k], v))
    return spark.createDataFrame(rows, "sample_id string, ref_id string, cell string, label string, embedding array<double>")


def test_screening_plan(spark):
    df = cells(spark)
    s = screening.Settings(skip=("zz",), min_scored=20, min_slice_size=10, trust_min=0.1)
    extra = spark.createDataFrame([("k", "r0", "q3_0_1", "zz", [0.0] * 8)], df.schema)
    got, summary = screening.screen(df.union(extra), s)
    rows = got.collect()
    assert len(rows) == 241 and summary.count() == 6 and "embedding" not in got.columns
    assert [r.anomaly_flag for r in rows if r.label == "zz"] == [None]
    assert all(0.0099 <= r.confidence_nonoutlier <= 1 for r in rows if r.label != "zz")
    assert dict(got.dtypes)["S"] == "float"
    again, _ = screening.screen(df, s, done=got)
    assert again.count() == 0
    both = screening.in_two_domains(df, s, s)
    assert both.count() == 240 and "B_anomaly_flag" in both.columns


def test_update_equals_rerun_inside_its_zone(spark, tmp_path):
    df = cells(spark).cache()
    s = screening.Settings(min_scored=20, min_slice_size=10)
    full, _ = screening.screen(df, s)
    cols = ["confidence_nonoutlier", "anomaly_flag"]
    rows = df.select("ref_id", "sample_id").join(full.select("ref_id", "sample_id", *cols), ["ref_id", "sample_id"])
    holes = rows.withColumns({c: F.when(F.col("sample_id") != "s5", F.col(c)) for c in cols}).cache()
    got, refs = screening.rescore(holes, df, s, cols, 3)
    assert got.count() == 80 and refs.count() == 3
    merged = screening.Run("update", s)(holes, df)
    diff = merged.join(rows.withColumnRenamed("confidence_nonoutlier", "c2"), ["ref_id", "sample_id"]).where(F.abs(F.col("confidence_nonoutlier") - F.col("c2")) > 1e-6)
    assert merged.count() == 240 and diff.count() == 0
    with pytest.raises(ValueError):
        screening.Run("x")(holes, df)
    holes.where("sample_id = 's5'").write.parquet(str(tmp_path / "new"))
    q = rescoring.rescore_stream(rescoring.read_rows(spark, str(tmp_path / "new"), holes.schema), lambda: df, s, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 80


def test_zone(spark):
    z = screening.impact_zone(spark.createDataFrame([("q3_0_1",)], "cell string"), 3, [2])
    assert {(r.level, r.cell) for r in z.collect() if r.level == 2} == {(2, f"q2_{x}_{y}") for x in (3, 0, 1) for y in (0, 1)}
    assert z.where("level = 3").count() == 9
