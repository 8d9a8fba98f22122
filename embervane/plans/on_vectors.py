"""Queries on the embedding table."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import confidence, stats, vectors
from ..operators import context, evaluation, flagging, kernels, scoring, slices
from .registry import EMB, centroid_sql, knn_sql, query, r6, scores_sql, trimmed_sql, vectors_of, with_

DIST = with_(EMB, centroid_sql("e", "label", "q"))


@query(DIST + "SELECT e.vec_id, e.label, round(list_cosine_distance(e.v, q.c), 6) AS cosine_distance FROM e JOIN q USING (label)")
def cosine_to_label_centroid(spark, d):
    e = vectors_of(spark, d)
    c = vectors.centroids(e, ["label"])
    return e.join(c, "label").select("vec_id", "label", r6(vectors.cosine_distance("embedding", "centroid"), "cosine_distance"))


@query(with_(EMB, centroid_sql("e", "label", "q", "median")) + "SELECT label, d, round(c[d], 6) AS m FROM (SELECT label, c, unnest(range(1, len(c) + 1)) AS d FROM q)")
def median_centroid(spark, d):
    c = vectors.centroids(vectors_of(spark, d), ["label"], how="median")
    return c.select("label", F.posexplode("centroid").alias("i", "x")).select("label", (F.col("i") + 1).cast("long").alias("d"), r6("x", "m"))


@query(with_(EMB, trimmed_sql("e", "label", "q", 0.05)) + "SELECT label, d, round(c[d], 6) AS m FROM (SELECT label, c, unnest(range(1, len(c) + 1)) AS d FROM q)")
def trimmed_centroid_2iter(spark, d):
    c = scoring.trimmed_centroids(vectors_of(spark, d), ["label"], "vec_id", trim=0.05)
    return c.select("label", F.posexplode("centroid").alias("i", "x")).select("label", (F.col("i") + 1).cast("long").alias("d"), r6("x", "m"))


@query(with_(EMB, knn_sql("e", "label", "k")) + "SELECT vec_id, round(kd, 6) AS knn_distance FROM k")
def knn_mean_distance(spark, d):
    return kernels.knn_distance(vectors_of(spark, d), ["label"], "vec_id").select("vec_id", r6("knn_distance"))


def _base(trim: float = 0.10) -> str:
    return with_(
        EMB, trimmed_sql("e", "label", "q", trim), knn_sql("e", "label", "k"),
        "b AS (SELECT e.*, count(*) OVER (PARTITION BY label) AS slice_n, list_cosine_distance(e.v, q.c) AS cd, kd FROM e JOIN q USING (label) JOIN k USING (vec_id))",
        scores_sql("b", "label"),
    )


_SCORES = {"cosine_distance": "cd", "knn_distance": "kd"} | {s: s for s in scoring.SCORES if s not in ("cosine_distance", "knn_distance")}


def _list(min_n: int) -> str:
    return ", ".join(f"round(CASE WHEN slice_n < {min_n} THEN 0.0 ELSE {v} END, 6) AS {k}" for k, v in _SCORES.items())


@query(_base() + f"SELECT vec_id, label, slice_n, {_list(1)} FROM sc")
def slice_scores_full(spark, d):
    s = scoring.score_slices(vectors_of(spark, d), ["label"], "vec_id", min_scored=1)
    return s.select("vec_id", "label", "slice_n", *[r6(c) for c in scoring.SCORES])


@query(_base() + f"SELECT vec_id, slice_n >= 50 AS scored, {_list(50)} FROM sc")
def slice_scores_zero_small(spark, d):
    s = scoring.score_slices(vectors_of(spark, d), ["label"], "vec_id")
    return s.select("vec_id", "scored", *[r6(c) for c in scoring.SCORES])


_CONF = (
    "CASE WHEN NOT flagged THEN 1.0 ELSE least(greatest(0.01 + 0.99 * exp(-0.3 * y / (1 - y + 1e-9)), 0.01), 1.0) END"
)
_FLAGGED = (
    ", f0 AS (SELECT *, median(S) OVER (PARTITION BY label) AS smed FROM sc), f1 AS (SELECT *, median(abs(S - smed)) OVER (PARTITION BY label) AS smad FROM f0),"
    " f2 AS (SELECT *, slice_n >= 1 AND smad > 0 AND S >= smed + 2.0 * smad AS flagged, least(greatest((mean_score - 0.975) / 0.025, 0.0), 1.0) AS y FROM f1)"
)


def _screened(spark, d):
    return evaluation.screen(vectors_of(spark, d), ["label"], "vec_id", mad_k=2.0, min_scored=1)


@query(_base().rstrip() + _FLAGGED + f" SELECT label, count(*) AS n_total, CAST(sum(flagged::INT) AS BIGINT) AS n_flagged, round(avg(flagged::INT), 6) AS flagged_fraction, round(avg({_CONF}), 6) AS confidence FROM f2 GROUP BY label")
def screen_by_label(spark, d):
    s = _screened(spark, d)
    conf = s.groupBy("label").agg(F.avg("confidence").alias("confidence"))
    return flagging.summary(s, ["label"]).join(conf, "label").select("label", "n_total", "n_flagged", r6("flagged_fraction"), r6("confidence"))


def _votes(t: float) -> str:
    return f"((S_rank >= {t})::INT + (S_rank_min >= {t})::INT + (S_z >= {t})::INT)"


_GRADES = (
    "CASE WHEN flagged AND rank_percentile >= 0.99 AND S >= 0.99 THEN 'candidate' WHEN flagged AND rank_percentile >= 0.98 AND S >= 0.95 THEN 'suspect' WHEN flagged THEN 'flagged' ELSE 'normal' END AS s_anomaly",
    f"CASE WHEN flagged AND {_votes(0.99)} = 3 THEN 'candidate' WHEN flagged AND {_votes(0.98)} >= 2 THEN 'suspect' WHEN flagged THEN 'flagged' ELSE 'normal' END AS anomaly_flag",
)


@query(_base().rstrip() + _FLAGGED + f" SELECT vec_id, {_GRADES[0]}, {_GRADES[1]} FROM f2")
def severity_grades(spark, d):
    return flagging.grades(_screened(spark, d)).select("vec_id", F.col("S_anomaly").alias("s_anomaly"), "anomaly_flag")


@query(_base().rstrip() + _FLAGGED + f", g AS (SELECT vec_id, slice_n, {_GRADES[0]}, {_GRADES[1]} FROM f2) SELECT vec_id, " + ", ".join(f"CASE WHEN slice_n < 52 AND {c} IN ('suspect', 'candidate') THEN 'flagged' ELSE {c} END AS {c}" for c in ("s_anomaly", "anomaly_flag")) + " FROM g")
def undersized_downgrade(spark, d):
    s = _screened(spark, d).withColumn("small", F.col("slice_n") < 52)
    return flagging.grades(s, "small").select("vec_id", F.col("S_anomaly").alias("s_anomaly"), "anomaly_flag")


@query(_base().rstrip() + _FLAGGED + ", z0 AS (SELECT *, median(mean_score) OVER (PARTITION BY label) AS mm FROM f2), z1 AS (SELECT *, median(abs(mean_score - mm)) OVER (PARTITION BY label) AS ma FROM z0), z2 AS (SELECT *, greatest((mean_score - mm) / (CASE WHEN ma = 0 THEN 1.0 ELSE ma END), 0.0) AS z FROM z1) SELECT vec_id, round(z, 6) AS z_mad, round(CASE WHEN flagged THEN 1 / (1 + exp(least(greatest(ln(1 / 1e-3 - 1) / 7.0 * (z - 3.0), -50.0), 50.0))) ELSE 1.0 END, 6) AS confidence FROM z2")
def robust_confidence(spark, d):
    s = confidence.robust_by_slice(_screened(spark, d).drop("confidence"), ["label"])
    return s.select("vec_id", r6("z_mad"), r6("confidence"))


# The margins of a context (cell): unit vectors, a centroid for each label.
_MARGIN = with_(
    EMB, "un AS (SELECT *, list_transform(v, lambda x: x / (sqrt(list_sum(list_transform(v, lambda y: y * y))) + 1e-12)) AS u FROM e)",
    centroid_sql("un", "cell, label", "q", vec="u"),
    "qn AS (SELECT cell, label, list_transform(c, lambda x: x / (sqrt(list_sum(list_transform(c, lambda y: y * y))) + 1e-12)) AS c FROM q)",
    "p AS (SELECT un.vec_id, un.cell, un.label AS own, qn.label AS lab, 1 - list_dot_product(un.u, qn.c) AS d FROM un JOIN qn USING (cell))",
    "a AS (SELECT vec_id, own, lab, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, lab) AS r FROM p WHERE lab <> own)",
    "mg AS (SELECT s.vec_id, s.cell, s.own AS label, s.d AS self_dist, a.lab AS alt_label, a.d AS alt_dist, a.d - s.d AS alt_margin FROM p s JOIN a ON a.vec_id = s.vec_id AND a.r = 1 WHERE s.lab = s.own)",
)


@query(_MARGIN + "SELECT vec_id, round(self_dist, 6) AS self_dist, alt_label, round(alt_dist, 6) AS alt_dist, round(alt_margin, 6) AS alt_margin FROM mg")
def context_margin(spark, d):
    m = context.margins(vectors_of(spark, d), ["cell"], "label")
    return m.select("vec_id", r6("self_dist"), "alt_label", r6("alt_dist"), r6("alt_margin"))


_PURITY = (
    "pn AS (SELECT cell, count(*) AS n FROM e GROUP BY cell),\n"
    "pp AS (SELECT a.vec_id, a.label AS own, b.label AS lab, least(greatest(10, least(floor(sqrt(n)), 50)), n - 1) AS k,\n"
    "  row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 - list_cosine_similarity(a.v, b.v), b.vec_id) AS r\n"
    "  FROM e a JOIN e b ON a.cell = b.cell AND a.vec_id <> b.vec_id JOIN pn ON pn.cell = a.cell),\n"
    "pv AS (SELECT vec_id, own, lab, k, count(*) AS votes FROM pp WHERE r <= k GROUP BY ALL),\n"
    "pu AS (SELECT vec_id, coalesce(sum(votes) FILTER (lab = own), 0) / max(k) AS same_label_frac, arg_min(lab, -votes * 1000 + lab) AS majority_label, max(votes) / max(k) AS majority_frac FROM pv GROUP BY vec_id)"
)


@query(with_(EMB, _PURITY) + "SELECT e.vec_id, round(same_label_frac, 6) AS same_label_frac, majority_label, round(majority_frac, 6) AS majority_frac FROM e LEFT JOIN pu USING (vec_id)")
def knn_label_purity(spark, d):
    e = vectors_of(spark, d).withColumn("hit", F.lit(True))
    return context.purity(e, "hit", ["cell"], "label", "vec_id").select("vec_id", r6("same_label_frac"), "majority_label", r6("majority_frac"))


@query(_MARGIN.rstrip() + ",\n" + _PURITY + " SELECT m.vec_id, round(0.5 * greatest(1 / (1 + exp(-least(greatest(10 * (alt_margin - 0.001), -50.0), 50.0))), 0.85) * greatest(coalesce(same_label_frac ** 0.5, 1.0), 0.85), 6) AS confidence_alt FROM mg m LEFT JOIN pu USING (vec_id)")
def confidence_fusion(spark, d):
    e = vectors_of(spark, d).withColumn("hit", F.lit(True))
    e = context.purity(context.margins(e, ["cell"], "label"), "hit", ["cell"], "label", "vec_id")
    return e.select("vec_id", r6(confidence.fuse(F.lit(0.5), "alt_margin", "same_label_frac", "hit"), "confidence_alt"))


_TRUST = with_(
    EMB, "e2 AS (SELECT vec_id, cell * 100 + label AS g, cell, label, list_transform(v, lambda x: x / (sqrt(list_sum(list_transform(v, lambda y: y * y))) + 1e-12)) AS v, count(*) OVER (PARTITION BY cell, label) AS gn FROM e)",
    "e3 AS (SELECT * FROM e2 WHERE gn >= 2)", trimmed_sql("e3", "g", "q", 0.10),
    "sp AS (SELECT e3.cell, e3.g, list_cosine_distance(e3.v, q.c) AS d FROM e3 JOIN q USING (g))",
    "wi AS (SELECT cell, avg(w) AS intra FROM (SELECT cell, g, avg(d) AS w FROM sp GROUP BY ALL) GROUP BY cell)",
    "pr AS (SELECT a.g, min(list_cosine_distance(a.c, b.c)) AS m FROM q a JOIN q b ON a.g // 100 = b.g // 100 AND a.g <> b.g GROUP BY a.g)",
    "ie AS (SELECT g // 100 AS cell, avg(m) AS inter FROM pr GROUP BY 1)",
    "tr AS (SELECT cell, least(greatest((inter / (inter + intra + 1e-12) - 0.5) / 0.5, 0.0), 1.0) AS slice_trust FROM wi JOIN ie USING (cell))",
)


@query(_TRUST + "SELECT cell, round(slice_trust, 6) AS slice_trust FROM tr")
def slice_trust(spark, d):
    return context.trust(vectors_of(spark, d), ["cell"], "label", "vec_id").select("cell", r6("slice_trust"))


_ATT = "CASE WHEN vec_id % 10 = 0 THEN greatest(1 - (1 - 0.2) * least(greatest(slice_trust / 0.9, 0.0), 1.0), 0.0) ELSE 0.2 END"


@query(_TRUST + f"SELECT vec_id, round({_ATT}, 6) AS confidence FROM e JOIN tr USING (cell)")
def trust_gate(spark, d):
    e = vectors_of(spark, d)
    e = e.join(context.trust(e, ["cell"], "label", "vec_id"), "cell").withColumn("hit", F.col("vec_id") % 10 == 0)
    return e.select("vec_id", r6(confidence.attenuate(F.lit(0.2), "slice_trust", "hit", 0.9), "confidence"))


@query("SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN CASE WHEN t < 0.3 THEN 'flagged' WHEN t < 0.5 THEN 'suspect' ELSE 'candidate' END WHEN 1 THEN CASE WHEN t < 0.3 THEN 'flagged' ELSE 'suspect' END ELSE 'flagged' END AS flag FROM (SELECT vec_id, (vec_id % 10) / 10.0 AS t FROM embeddings)")
def trust_downgrade(spark, d):
    e = vectors_of(spark, d).withColumn("t", (F.col("vec_id") % 10) / 10.0)
    e = e.withColumn("flag", F.element_at(F.array(F.lit("candidate"), F.lit("suspect"), F.lit("flagged")), (F.col("vec_id") % 3 + 1).cast("int")))
    return e.select("vec_id", flagging.downgrade("flag", "t").alias("flag"))


@query(
    with_(EMB, "gp AS (SELECT a.vec_id, 1 - list_cosine_similarity(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 - list_cosine_similarity(a.v, b.v), b.vec_id) AS r FROM e a JOIN e b ON a.label = b.label AND a.ds <> b.ds)", "k AS (SELECT vec_id, avg(d) AS kd FROM gp WHERE r <= 10 GROUP BY vec_id)", trimmed_sql("e", "label", "q", 0.10), "b AS (SELECT e.vec_id, e.label, list_cosine_distance(e.v, q.c) AS cd, coalesce(kd, 0) AS kd FROM e JOIN q USING (label) LEFT JOIN k USING (vec_id))", scores_sql("b", "label", 0.02, 0.98))
    + "SELECT vec_id, round(kd, 6) AS knn_distance, round(S, 6) AS s_group FROM sc"
)
def group_masked_knn(spark, d):
    s = scoring.score_other_groups(vectors_of(spark, d), ["label"], "vec_id", "ds")
    return s.select("vec_id", r6("knn_distance"), r6("S_group", "s_group"))


def _roll(sql: str) -> str:
    return (
        with_(EMB, centroid_sql("e", "label", "q"), "x AS (SELECT e.*, list_cosine_distance(e.v, q.c) AS cd FROM e JOIN q USING (label))", "v AS (SELECT ds, label, count(*) AS c FROM e GROUP BY ALL)", "j AS (SELECT ds, arg_min(label, -c * 1000 + label) AS maj FROM v GROUP BY ds)")
        + f"SELECT ds, round({sql}, 6) AS score, count(*) AS n, any_value(maj) AS majority_label FROM x JOIN j USING (ds) GROUP BY ds"
    )


def _rolled(how: str):
    def run(spark, d):
        e = vectors_of(spark, d)
        e = e.join(vectors.centroids(e, ["label"]), "label").withColumn("S", vectors.cosine_distance("embedding", "centroid"))
        return scoring.roll_up(e, "ds", "S", "label", how).select("ds", r6(f"{how}_S", "score"), "n", "majority_label")

    run.__name__ = f"group_rollup_{how}"
    return run


for _how, _sql in (("median", "median(cd)"), ("mean", "avg(cd)"), ("max", "max(cd)")):
    query(_roll(_sql))(_rolled(_how))

_REF = "h AS (SELECT *, count(*) OVER (PARTITION BY cell, label) AS n0, count(*) OVER (PARTITION BY cell, coarse) AS n1 FROM e)"


@query(with_(EMB, _REF) + "SELECT vec_id, n0 AS slice_n, CASE WHEN n0 >= 13 THEN 0 ELSE 1 END AS ref_level, CASE WHEN n0 >= 13 THEN label ELSE coarse END::VARCHAR AS ref_class, CASE WHEN n0 >= 13 THEN n0 ELSE n1 END AS ref_group_n FROM h")
def hierarchy_level(spark, d):
    return slices.reference_level(vectors_of(spark, d), ["label", "coarse"], ["cell"], 13).select("vec_id", "slice_n", "ref_level", "ref_class", "ref_group_n")


@query(
    with_(
        EMB, _REF, "rf AS (SELECT *, CASE WHEN n0 >= 13 THEN 0 ELSE 1 END AS lv FROM h)",
        "w AS (SELECT DISTINCT cell, lv, CASE WHEN lv = 0 THEN label ELSE coarse END AS cls FROM rf)",
        "o AS (SELECT rf.vec_id, rf.v, (w.cell * 2 + w.lv) * 100 + w.cls AS g, rf.lv = w.lv AS target FROM rf JOIN w ON w.cell = rf.cell AND w.cls = CASE WHEN w.lv = 0 THEN rf.label ELSE rf.coarse END)",
        centroid_sql("o", "g", "q"), knn_sql("o", "g", "k0").replace("SELECT vec_id, avg(d) AS kd FROM k0_p WHERE r <= k GROUP BY vec_id", "SELECT vec_id, g, avg(d) AS kd FROM k0_p WHERE r <= k GROUP BY vec_id, g").replace("SELECT a.vec_id, 1 -", "SELECT a.vec_id, a.g, 1 -").replace("PARTITION BY a.vec_id ORDER", "PARTITION BY a.vec_id, a.g ORDER"),
        "b AS (SELECT o.vec_id, o.g, o.target, list_cosine_distance(o.v, q.c) AS cd, kd FROM o JOIN q USING (g) JOIN k0 USING (vec_id, g))", scores_sql("b", "g"),
    )
    + "SELECT vec_id, round(S, 6) AS s, round(mean_score, 6) AS mean_score FROM sc WHERE target"
)
def hierarchical_scores(spark, d):
    e = slices.reference_level(vectors_of(spark, d), ["label", "coarse"], ["cell"], 13)
    s = scoring.score_hierarchy(e, ["label", "coarse"], ["cell"], "vec_id", 13, mode="mean", min_scored=1)
    return s.select("vec_id", r6("S", "s"), r6("mean_score"))


@query(
    with_(EMB, "gp AS (SELECT a.vec_id AS i, b.vec_id AS j, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda t: (t[1] - t[2]) ** 2))) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id)",
          "gn AS (SELECT least(20, greatest(2, count(*) - 1)) AS k FROM e)",
          "gr AS (SELECT gp.*, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r, k FROM gp CROSS JOIN gn)", "gk AS (SELECT * FROM gr WHERE r <= k)",
          "kd AS (SELECT i, max(d) AS kdist FROM gk GROUP BY i)", "lr AS (SELECT gk.i, 1 / (avg(greatest(gk.d, kd.kdist)) + 1e-10) AS lrd FROM gk JOIN kd ON kd.i = gk.j GROUP BY gk.i)")
    + "SELECT gk.i AS vec_id, round(avg(b.lrd) / any_value(a.lrd), 6) AS lof FROM gk JOIN lr a ON a.i = gk.i JOIN lr b ON b.i = gk.j GROUP BY gk.i"
)
def baseline_lof(spark, d):
    return kernels.lof(vectors_of(spark, d), [], "vec_id").select("vec_id", r6("lof"))


@query(_base().rstrip() + _FLAGGED.replace("2.0 * smad", "4.0 * smad") + " SELECT vec_id, round(S, 6) AS s, flagged FROM f2")
def baseline_global(spark, d):
    return evaluation.detect_global(vectors_of(spark, d), "label", "vec_id", min_scored=1).select("vec_id", r6("S", "s"), "flagged")


@query()
def baseline_isolation_forest(spark, d):
    return evaluation.detect_isolation(vectors_of(spark, d), "label", "vec_id").select("vec_id", r6("S", "s"), "flagged")


@query(with_(EMB, "s AS (SELECT d, avg(x) AS m, stddev_pop(x) AS s FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS d FROM e) GROUP BY d)") + "SELECT vec_id, u.d - 1 AS dim, round((x - m) / (s + 1e-6), 6) AS z FROM (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM e) u JOIN s ON s.d = u.d")
def standardise(spark, d):
    return vectors.standardise(vectors_of(spark, d), [], "vec_id").select("vec_id", F.col("dim").cast("long").alias("dim"), r6("z"))


@query(with_(EMB, "s AS (SELECT d, avg(x) AS m, stddev_pop(x) AS s FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS d FROM e) GROUP BY d)", "z AS (SELECT vec_id, label, u.d, (x - m) / (s + 1e-6) AS z FROM (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM e) u JOIN s ON s.d = u.d)", "c AS (SELECT label, d, avg(z) AS m FROM z GROUP BY ALL)", "p AS (SELECT vec_id, z.label, sqrt(sum((z - m) ** 2)) AS dist FROM z JOIN c ON c.label = z.label AND c.d = z.d GROUP BY ALL)") + "SELECT label, round(avg(dist), 6) AS mean_distance FROM p GROUP BY label")
def class_mean_distance(spark, d):
    z = vectors.standardise(vectors_of(spark, d), ["label"], "vec_id")
    m = F.avg("z").over(Window.partitionBy("label", "dim"))
    p = z.withColumn("q", (F.col("z") - m) ** 2).groupBy("vec_id", "label").agg(F.sqrt(F.sum("q")).alias("dist"))
    return p.groupBy("label").agg(F.round(F.avg("dist"), 6).alias("mean_distance"))


@query("SELECT vec_id, round(x, 6) AS first_value, valid FROM (SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE floor(CAST(embedding[1] AS DOUBLE) * 100) / 127.0 END AS x, vec_id % 5 <> 0 AS valid FROM embeddings)")
def dequantise(spark, d):
    from ..sources import files

    e = vectors_of(spark, d)
    bands = F.when(F.col("vec_id") % 5 == 0, F.array_repeat(F.lit(-128), 64)).otherwise(F.transform(vectors.as_double("embedding"), lambda x: F.floor(x * 100).cast("int")))
    e = files.sampled_bands(e.withColumn("bands", bands))
    return e.select("vec_id", r6(F.get("embedding", F.lit(0)), "first_value"), "valid")


@query(with_(EMB) + "SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm, len(v) AS width FROM e")
def pack_and_unpack(spark, d):
    e = vectors_of(spark, d)
    back = vectors.pack(vectors.unpack(e.select("vec_id", "embedding"), 64))
    return back.select("vec_id", r6(vectors.norm("embedding"), "norm"), F.size("embedding").cast("long").alias("width"))


def _confidences(df):
    return df.select("vec_id", "label", "cell", "ds", ((F.col("vec_id") % 100) / 100.0).alias("confidence"), F.element_at(F.array(*[F.lit(x) for x in ("normal", "flagged", "suspect", "candidate")]), (F.col("vec_id") % 4 + 1).cast("int")).alias("anomaly_flag"))


_SCEN = "(SELECT vec_id, (vec_id % 100) / 100.0 AS c, CASE vec_id % 4 WHEN 0 THEN 'normal' WHEN 1 THEN 'flagged' WHEN 2 THEN 'suspect' ELSE 'candidate' END AS f FROM embeddings)"
for _s in evaluation.SCENARIOS:
    _w = {"none": "1.0", "linear": "c", "power": "c ** 2", "filter": "1.0"}[_s.weight]
    _where = [f"f NOT IN ({', '.join(repr(x) for x in _s.drop_flags)})"] if _s.drop_flags else []
    _where += ["c >= 0.5"] if _s.weight == "filter" else []

    def _scenario(spark, d, s=_s):
        return evaluation.apply_scenario(_confidences(vectors_of(spark, d)), s).select("vec_id", r6("weight"))

    _scenario.__name__ = f"scenario_{_s.name}"
    query(f"SELECT vec_id, round(CAST({_w} AS DOUBLE), 6) AS weight FROM {_SCEN}" + (" WHERE " + " AND ".join(_where) if _where else ""))(_scenario)


@query(f"SELECT 'clean' AS view, vec_id FROM {_SCEN} WHERE c >= 0.9 / 0.99 * 0.99 UNION ALL SELECT 'minus_flagged', vec_id FROM {_SCEN} WHERE f = 'normal' UNION ALL SELECT 'full', vec_id FROM {_SCEN}")
def test_views(spark, d):
    e = _confidences(vectors_of(spark, d)).withColumn("quality", (F.col("confidence") * 100).cast("double"))
    out = None
    for v in ("clean", "minus_flagged", "full"):
        q = evaluation.test_view(e, v, quality="quality").select(F.lit(v).alias("view"), "vec_id")
        out = q if out is None else out.unionByName(q)
    return out


@query(f"SELECT vec_id, CAST(CASE WHEN f = 'candidate' THEN 0 WHEN c >= 0.5 THEN 1 ELSE 0 END AS DOUBLE) AS weight FROM {_SCEN}")
def scenario_weight_column(spark, d):
    return evaluation.weight_column(_confidences(vectors_of(spark, d)), evaluation.Scenario("x", ("candidate",), "filter")).select("vec_id", "weight")


@query()
def noise_within_context(spark, d):
    spec = evaluation.Noise("within_context", 0.1, "label", "cell", seed=3)
    return evaluation.add_noise(vectors_of(spark, d), spec, "vec_id").select("vec_id", "label", "label_noisy", "noise_truth")


@query()
def noise_random(spark, d):
    return evaluation.add_noise(vectors_of(spark, d), evaluation.Noise("random", 0.1, "label"), "vec_id").select("vec_id", "label", "label_noisy", "noise_truth")


@query()
def noise_group(spark, d):
    return evaluation.add_noise(vectors_of(spark, d), evaluation.Noise("group", 0.2, "label", group="ds"), "vec_id").select("vec_id", "ds", "label", "label_noisy", "noise_truth")


@query()
def noise_sweep(spark, d):
    return evaluation.noise_sweep(vectors_of(spark, d), "label", "vec_id", ["coarse"], ["within_context", "random"], [0.1], [0, 1], min_scored=1, mad_k=3.0)


@query()
def proxy_classifier(spark, d):
    e = evaluation.split_rows(vectors_of(spark, d), "vec_id", strata="label")
    p = evaluation.proxy_classifier(e.where("split = 'train'"), e.where("split = 'test'"), "label", max_iter=20)
    return evaluation.classification_metrics(p.withColumn("label", F.col("label").cast("string")), "label", "predicted").select(r6("accuracy"), r6("f1_macro"), r6("f1_weighted"))


@query()
def full_screening(spark, d):
    from . import screening

    e = vectors_of(spark, d).withColumn("ref_id", F.col("ds").cast("string"))
    s = screening.Settings(id_col="vec_id", labels=("label", "coarse"), min_slice_size=20, min_scored=10, levels=((0, "cell"),))
    near = spark.range(4).select(F.col("id").alias("cell"), ((F.col("id") + 1) % 4).alias("neighbour"))
    return screening.screen(e, s, near)[0]


@query()
def exploration_pca_kmeans(spark, d):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    e = vectors_of(spark, d).withColumn("x", array_to_vector(F.col("embedding").cast("array<double>")))
    p = PCA(k=3, inputCol="x", outputCol="p").fit(e).transform(e)
    return KMeans(k=10, seed=1, featuresCol="p", predictionCol="cluster").fit(p).transform(p).select("vec_id", "cluster")


@query("SELECT label, vec_id, rank_pct, round(z, 6) AS z FROM (SELECT label, vec_id, round(cume_dist() OVER (PARTITION BY label ORDER BY x), 6) AS rank_pct, (x - med) / (CASE WHEN mad = 0 THEN 1.0 ELSE mad END + 1e-12) AS z FROM (SELECT *, median(abs(x - med)) OVER (PARTITION BY label) AS mad FROM (SELECT *, median(x) OVER (PARTITION BY label) AS med FROM (SELECT label, vec_id, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings))))")
def rank_and_robust_z(spark, d):
    e = vectors_of(spark, d).withColumn("x", F.get("embedding", F.lit(0)).cast("double"))
    e = stats.with_mad(e, "x", ["label"])
    return e.select("label", "vec_id", F.round(stats.rank_pct("x", ["label"]), 6).alias("rank_pct"), r6(stats.robust_z("x"), "z"))

