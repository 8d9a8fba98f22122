"""Queries on the star-schema and document tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import confidence, grid, stats, text
from ..operators import evaluation, flagging, slices
from ..sources import cache, files, sinks
from .registry import query, r6, table, with_

KEYS = ["l_returnflag", "l_linestatus"]
LI = "li AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag, l_linestatus, l_extendedprice AS s FROM lineitem)"
LW = "PARTITION BY l_returnflag, l_linestatus"
SUM = "SELECT l_returnflag, l_linestatus, count(*) AS n_total, CAST(sum(flagged::INT) AS BIGINT) AS n_flagged, round(avg(flagged::INT), 6) AS flagged_fraction FROM f GROUP BY ALL"


def _items(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), *KEYS, F.col("l_extendedprice").alias("s"))


def _sum(df):
    return flagging.summary(df, KEYS).select(*KEYS, "n_total", "n_flagged", r6("flagged_fraction"))


@query(with_(LI, f"f AS (SELECT *, s >= quantile_cont(s, 0.96) OVER ({LW}) AS flagged FROM li)") + SUM)
def flag_percentile(spark, d):
    return _sum(flagging.flag(_items(spark, d), KEYS, "id", "s", "percentile", q=0.96))


@query(with_(LI, f"m AS (SELECT *, median(s) OVER ({LW}) AS med FROM li)", f"n AS (SELECT *, median(abs(s - med)) OVER ({LW}) AS mad FROM m)", "f AS (SELECT *, mad > 0 AND s >= med + 1.5 * mad AS flagged FROM n)") + SUM)
def flag_mad(spark, d):
    return _sum(flagging.flag(_items(spark, d), KEYS, "id", "s", "mad", k=1.5))


@query(with_(LI, "f AS (SELECT *, s >= 50000 AS flagged FROM li)") + SUM)
def flag_absolute(spark, d):
    return _sum(flagging.flag(_items(spark, d), KEYS, "id", "s", "absolute", threshold=50000))


OR = "o AS (SELECT o_orderkey AS id, o_orderstatus AS k, o_totalprice AS s FROM orders)"


def _orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("k"), F.col("o_totalprice").alias("s"))


@query(with_(OR, "p AS (SELECT *, cume_dist() OVER (PARTITION BY k ORDER BY s DESC) * count(*) OVER (PARTITION BY k) / (count(*) OVER (PARTITION BY k) + 1) AS p, count(*) OVER (PARTITION BY k) AS n FROM o)", "i AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p, id) AS i FROM p)", "c AS (SELECT *, max(CASE WHEN p <= 0.9999 * i / n THEN p END) OVER (PARTITION BY k) AS c FROM i)") + "SELECT k, CAST(sum(coalesce(p <= c, false)::INT) AS BIGINT) AS n_flagged FROM c GROUP BY k")
def flag_fdr(spark, d):
    f = flagging.flag(_orders(spark, d), ["k"], "id", "s", "fdr", alpha=0.9999)
    return f.groupBy("k").agg(F.sum(F.col("flagged").cast("int")).alias("n_flagged"))


_TOP = with_(OR, "t AS (SELECT *, s >= quantile_cont(s, 0.9) OVER (PARTITION BY k) AS f, row_number() OVER (PARTITION BY k ORDER BY s DESC, id) AS r, count(*) OVER (PARTITION BY k) AS n FROM o)")


@query(_TOP + "SELECT id FROM t WHERE f AND r <= floor(0.02 * n)")
def flag_capped(spark, d):
    return flagging.flag(_orders(spark, d), ["k"], "id", "s", "percentile", q=0.9, at_most=0.02).where("flagged").select("id")


@query(with_(OR, "t AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s DESC, id) AS r FROM o)") + "SELECT id FROM t WHERE r <= 7")
def flag_floor(spark, d):
    return flagging.flag(_orders(spark, d), ["k"], "id", "s", "absolute", threshold=1e12, at_least=7).where("flagged").select("id")


@query(with_(LI, f"f AS (SELECT *, s >= quantile_cont(s, 0.9) OVER ({LW}) AS flagged FROM li)") + SUM)
def slice_summary(spark, d):
    return _sum(flagging.flag(_items(spark, d), KEYS, "id", "s", "percentile", q=0.9))


_CURVE = "least(greatest(0.01 + 0.99 * exp(-0.3 * y / (1 - y + 1e-9)), 0.01), 1.0)"


@query(f"SELECT l_discount, round({_CURVE}, 6) AS confidence, count(*) AS n FROM (SELECT l_discount, least(greatest((l_discount * 10 - 0.5) / 0.5, 0.0), 1.0) AS y FROM lineitem) GROUP BY ALL")
def confidence_curve(spark, d):
    c = confidence.curve(F.col("l_discount") * 10, t=0.5)
    return table(spark, d, "lineitem").groupBy("l_discount", r6(c, "confidence")).agg(F.count("*").alias("n"))


@query(f"SELECT l_discount, gate, round(CASE WHEN gate THEN {_CURVE} ELSE 1.0 END, 6) AS confidence, count(*) AS n FROM (SELECT l_discount, l_returnflag = 'R' AS gate, least(greatest((l_discount * 10 - 0.5) / 0.5, 0.0), 1.0) AS y FROM lineitem) GROUP BY ALL")
def confidence_gated(spark, d):
    df = table(spark, d, "lineitem").withColumn("gate", F.col("l_returnflag") == "R")
    return df.groupBy("l_discount", "gate", r6(confidence.curve(F.col("l_discount") * 10, "gate", t=0.5), "confidence")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT l_discount AS c, round(l_discount * 10, 6) AS linear, round((l_discount * 10) ** 2, 6) AS squared, round(least(greatest(l_discount * 10, 0.2), 0.8), 6) AS clipped, round(least(greatest(0.5 * l_discount * 10 + 0.1, 0.0), 0.5), 6) AS affine FROM lineitem")
def sample_weights(spark, d):
    w = lambda *a, **k: confidence.sample_weight(F.col("c") * 10, *a, **k)
    df = table(spark, d, "lineitem").select(F.col("l_discount").alias("c")).distinct()
    return df.select("c", r6(w("linear"), "linear"), r6(w("power", power=2.0), "squared"), r6(w("clip", lo=0.2, hi=0.8), "clipped"), r6(w("affine", scale=0.5, shift=0.1, hi=0.5), "affine"))


@query(
    with_("b AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS lab, l_suppkey % 2 AS c0, l_suppkey % 8 AS c1, l_suppkey % 32 AS c2 FROM lineitem)",
          "l0 AS (SELECT *, count(*) OVER (PARTITION BY lab, c0) <= 2400 AS t0 FROM b)",
          "l1 AS (SELECT *, NOT t0 AND sum((NOT t0)::INT) OVER (PARTITION BY lab, c1) <= 2400 AS t1 FROM l0)")
    + "SELECT lab, CASE WHEN t0 THEN c0 WHEN t1 THEN c1 ELSE c2 END::VARCHAR AS cell, CASE WHEN t0 THEN 0 WHEN t1 THEN 1 ELSE 2 END AS cell_level, count(*) AS n FROM l1 GROUP BY ALL"
)
def adaptive_level(spark, d):
    df = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("lab"), *[(F.col("l_suppkey") % m).cast("string").alias(f"c{i}") for i, m in enumerate((2, 8, 32))])
    df = slices.adaptive_level(df, [(0, "c0"), (1, "c1"), (2, "c2")], "lab", max_slice_size=2400)
    return df.groupBy("lab", "cell", "cell_level").agg(F.count("*").alias("n"))


# Moves follow moves, so SQL doesn't tell it; a test holds it against plain loops.
@query()
def merge_small_slices(spark, d):
    n = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("cell")).agg(F.count("*").alias("n"))
    near = n.select("cell").withColumn("neighbour", F.explode(F.array(F.col("cell") - 1, F.col("cell") + 1)))
    n = n.withColumn("lab", F.lit(1))
    return slices.merge_map(n, near, ["lab"], "cell", 4).select("cell", "target")


_MAP = "(VALUES ('Brand#11', 'a'), ('Brand#12', 'b'), ('Brand#21', 'a'), ('Brand#32', 'c')) m(code, cls)"


def _brands(spark):
    return spark.createDataFrame([("Brand#11", "a"), ("Brand#12", "b"), ("Brand#21", "a"), ("Brand#32", "c")], "code string, cls string")


@query(f"SELECT p_partkey, m.cls FROM part LEFT JOIN {_MAP} ON m.code = p_brand")
def class_mapping_join(spark, d):
    return slices.map_classes(table(spark, d, "part"), _brands(spark), "p_brand", "code", ["cls"]).select("p_partkey", "cls")


@query("SELECT lower(o_orderpriority) IN ('1-urgent', '5-low') AS skipped, count(*) AS n FROM orders GROUP BY 1")
def skip_class_split(spark, d):
    keep, skip = slices.split_skipped(table(spark, d, "orders"), "o_orderpriority", ["1-URGENT", " 5-low "])
    both = keep.select(F.lit(False).alias("skipped")).unionByName(skip.select(F.lit(True).alias("skipped")))
    return both.groupBy("skipped").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, regexp_replace(trim(o_orderpriority), '[-\\s]', '', 'g') AS code FROM orders")
def code_normalise(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.clean_code("o_orderpriority").alias("code"))


_EV = "e AS (SELECT event_id, user_id, event_type, value, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS conf, CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS flag FROM events)"


def _events(spark, d):
    e = table(spark, d, "events")
    return e.withColumns({"conf": F.when(F.col("event_id") % 11 != 0, F.col("value")), "flag": F.when(F.col("event_id") % 13 != 0, F.col("event_type"))})


@query(with_(_EV) + "SELECT event_id FROM e WHERE conf IS NULL OR flag IS NULL")
def unscored_rows(spark, d):
    return sinks.unscored(_events(spark, d), ["conf", "flag"], "event_id").select("event_id")


_Q = "z AS (SELECT DISTINCT (s_suppkey * 37) % 64 AS x, (s_suppkey * 11) % 64 AS y FROM supplier WHERE s_suppkey % 20 = 0)"


@query(with_(_Q, "r AS (SELECT unnest([-1, 0, 1]) AS d)", "a AS (SELECT 6 AS level, (x + r.d + 64) % 64 AS x, y + q.d AS y FROM z, r, r q WHERE y + q.d BETWEEN 0 AND 63 UNION SELECT 4, (x // 4 + r.d + 16) % 16, y // 4 + q.d FROM z, r, r q WHERE y // 4 + q.d BETWEEN 0 AND 15)") + "SELECT DISTINCT CAST(level AS INT) AS level, 'q' || level || '_' || x || '_' || y AS cell FROM a")
def impact_zone(spark, d):
    from . import screening

    s = table(spark, d, "supplier").where("s_suppkey % 20 = 0")
    cell = F.concat_ws("_", F.lit("q6"), (F.col("s_suppkey") * 37 % 64).cast("string"), (F.col("s_suppkey") * 11 % 64).cast("string"))
    return screening.impact_zone(s.select(cell.alias("cell")).distinct(), 6, [4])


@query(with_(_Q) + "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM z WHERE z.x = (c_custkey * 7) % 64 AND z.y = (c_custkey * 3) % 64) OR EXISTS (SELECT 1 FROM z WHERE z.x // 4 = (c_custkey * 7) % 64 // 4 AND z.y // 4 = (c_custkey * 3) % 64 // 4)")
def impact_scan(spark, d):
    from . import screening

    s = table(spark, d, "supplier").where("s_suppkey % 20 = 0")
    cell = lambda k, a, b: F.concat_ws("_", F.lit("q6"), (F.col(k) * a % 64).cast("string"), (F.col(k) * b % 64).cast("string")).alias("cell")
    zone = screening.impact_zone(s.select(cell("s_suppkey", 37, 11)).distinct(), 6, [4], rings=0)
    return screening.in_zone(table(spark, d, "customer").select("c_custkey", cell("c_custkey", 7, 3)), zone, 6, [4]).select("c_custkey")


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12) GROUP BY 1")
def cache_antijoin_insert(spark, d):
    done = table(spark, d, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("o_custkey"))
    return slices.resume(table(spark, d, "orders"), done, "o_custkey").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)")
def requested_hits(spark, d):
    have = table(spark, d, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").select("o_custkey").distinct().join(have, "o_custkey", "left_semi")


@query("SELECT count(*) AS wanted, CAST(sum((c.c_custkey IS NULL)::INT) AS BIGINT) AS missing FROM (SELECT o_custkey, nullif(o_custkey % 3, 0) AS r FROM orders) o LEFT JOIN (SELECT c_custkey, nullif(c_nationkey % 3, 0) AS r FROM customer) c ON c.c_custkey = o.o_custkey AND c.r IS NOT DISTINCT FROM o.r")
def missing_count_nullsafe(spark, d):
    n3 = lambda c: F.when(c % 3 != 0, c % 3)
    o = table(spark, d, "orders").select("o_custkey", n3(F.col("o_custkey")).alias("r"))
    c = table(spark, d, "customer").select("c_custkey", n3(F.col("c_nationkey")).alias("q"))
    j = o.join(c, (F.col("o_custkey") == F.col("c_custkey")) & F.col("r").eqNullSafe(F.col("q")), "left")
    return j.agg(F.count("*").alias("wanted"), F.sum(F.col("c_custkey").isNull().cast("int")).alias("missing"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def dedup_keep_one(spark, d):
    return cache.one_per_id(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id")


_DOM = with_(
    "a AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'candidate' WHEN vec_id % 3 = 1 THEN 'suspect' ELSE 'normal' END AS fa, (vec_id % 10) / 10.0 AS ca, CASE WHEN vec_id % 2 = 0 THEN 'Temporary_crops ' ELSE 'forest' END AS la FROM embeddings WHERE vec_id % 4 <> 0)",
    "b AS (SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'normal' WHEN vec_id % 5 = 1 THEN 'suspect' ELSE 'flagged' END AS fb, (vec_id % 7) / 10.0 AS cb FROM embeddings WHERE vec_id % 6 <> 0)",
    "m AS (SELECT coalesce(a.vec_id, b.vec_id) AS vec_id, la, fa, fb, ca, cb FROM a FULL JOIN b USING (vec_id))",
)


def _domains(spark, d):
    v = F.col("vec_id")
    e = table(spark, d, "embeddings").select("vec_id")
    a = e.where("vec_id % 4 <> 0").select("vec_id", F.when(v % 2 == 0, "Temporary_crops ").otherwise("forest").alias("la"), F.when(v % 3 == 0, "candidate").when(v % 3 == 1, "suspect").otherwise("normal").alias("fa"), ((v % 10) / 10.0).alias("ca"))
    b = e.where("vec_id % 6 <> 0").select("vec_id", F.when(v % 5 == 0, "normal").when(v % 5 == 1, "suspect").otherwise("flagged").alias("fb"), ((v % 7) / 10.0).alias("cb"))
    return a.join(b, "vec_id", "full_outer")


@query(_DOM + "SELECT vec_id, fa, fb, round(ca, 6) AS ca, round(cb, 6) AS cb FROM m")
def two_domain_outer_merge(spark, d):
    return _domains(spark, d).select("vec_id", "fa", "fb", r6("ca"), r6("cb"))


@query(_DOM + "SELECT vec_id, coalesce(fa, 'normal') AS fa, round(coalesce(ca, 1.0), 6) AS ca FROM m")
def null_fill(spark, d):
    return flagging.fill_unscored(_domains(spark, d), "ca", "fa").select("vec_id", "fa", r6("ca"))


_RK = "CASE {0} WHEN 'candidate' THEN 3 WHEN 'suspect' THEN 2 WHEN 'flagged' THEN 1 ELSE 0 END"


@query(_DOM + f"SELECT vec_id, CASE WHEN hit THEN list_extract(['normal', 'flagged', 'suspect', 'candidate'], least(rb + 1, ra) + 1) ELSE fb END AS fb, round(CASE WHEN hit THEN (ca + cb) / 2 ELSE cb END, 6) AS cb FROM (SELECT *, coalesce(lower(trim(la)) = 'temporary_crops' AND ra > rb AND rb > 0, false) AS hit FROM (SELECT *, {_RK.format('fa')} AS ra, {_RK.format('fb')} AS rb FROM m))")
def postprocess_escalation(spark, d):
    return flagging.escalate(_domains(spark, d), "la", "temporary_crops", "fa", "ca", "fb", "cb").select("vec_id", "fb", r6("cb"))


@query(_DOM + "SELECT vec_id, CASE WHEN lower(trim(la)) = 'forest' THEN 'normal' ELSE fa END AS fa, round(CASE WHEN lower(trim(la)) = 'forest' THEN 1.0 ELSE ca END, 6) AS ca FROM m")
def class_neutralisation(spark, d):
    return flagging.neutralise(_domains(spark, d), "la", ["FOREST"], "ca", "fa").select("vec_id", "fa", r6("ca"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, s FROM lineitem LEFT JOIN (SELECT o_orderkey, round(o_totalprice, 2) AS s FROM orders WHERE o_orderkey % 3 = 0) ON o_orderkey = l_orderkey")
def writeback_left_join(spark, d):
    s = table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.round("o_totalprice", 2).alias("s"))
    return sinks.merge_scores(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), s, ["l_orderkey"], ["s"])


@query("SELECT l_orderkey, l_linenumber, coalesce(n.t, l_tax) AS l_tax FROM lineitem LEFT JOIN (SELECT o_orderkey, 0.5 AS t FROM orders WHERE o_orderkey % 3 = 0) n ON o_orderkey = l_orderkey")
def writeback_coalesce(spark, d):
    s = table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0.5).alias("l_tax"))
    return sinks.merge_scores(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_tax"), s, ["l_orderkey"], ["l_tax"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 7 = 0")
def changed_rows(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    new = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return sinks.changed(o, new, ["o_orderkey"], ["o_totalprice"])


@query("SELECT l_shipdate < TIMESTAMP '1996-01-01' AS early, l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def crosstab_long(spark, d):
    df = table(spark, d, "lineitem").withColumn("early", F.col("l_shipdate") < F.to_timestamp(F.lit("1996-01-01")))
    return sinks.crosstab_long(df, ["early"], "l_returnflag", "l_linestatus")


@query("SELECT l_linenumber, " + ", ".join(f"CAST(count(*) FILTER (l_returnflag = '{a}' AND l_linestatus = '{b}') AS BIGINT) AS \"S={a}__C={b}\"" for a in "ANR" for b in "FO") + " FROM lineitem GROUP BY 1")
def crosstab_wide(spark, d):
    long = sinks.crosstab_long(table(spark, d, "lineitem"), ["l_linenumber"], "l_returnflag", "l_linestatus")
    return sinks.crosstab_wide(long, ["l_linenumber"], "l_returnflag", "l_linestatus", [f"S={a}__C={b}" for a in "ANR" for b in "FO"])


@query("SELECT c_custkey::VARCHAR AS id, c_acctbal AS bal, c_mktsegment AS seg FROM customer UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier")
def unify_schema_union(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    b = table(spark, d, "supplier").select(F.col("s_name").alias("id"), F.col("s_acctbal").alias("bal"))
    return sinks.unify([a, b])


_DOW = "SELECT user_id, " + ", ".join(f"round(max(value) FILTER (d = {i}), 6) AS value_{i}" for i in range(1, 8)) + " FROM (SELECT user_id, dayofweek(ts) + 1 AS d, max(value) AS value FROM events GROUP BY ALL) GROUP BY user_id"


@query(_DOW)
def long_to_wide_pivot(spark, d):
    e = table(spark, d, "events").groupBy("user_id", F.dayofweek("ts").alias("d")).agg(F.max("value").alias("value"))
    w = sinks.to_wide(e, "user_id", "d", ["value"], list(range(1, 8)))
    return w.select("user_id", *[r6(f"value_{i}") for i in range(1, 8)])


_DL = "x AS (SELECT doc_id, lang, quality, count(*) OVER (PARTITION BY lang) AS n, count(*) OVER (PARTITION BY lang, quality) AS s FROM documents JOIN labels USING (doc_id))"


@query(with_(_DL) + "SELECT doc_id, round(CASE WHEN n >= 5 THEN 1 - (s - 1) / (n - 1) END, 6) AS score, coalesce(n >= 5 AND 1 - (s - 1) / (n - 1) >= 0.5, false) AS flagged FROM x")
def spatial_disagreement(spark, d):
    x = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    return evaluation.detect_disagreement(x, "quality", "doc_id", "lang").select("doc_id", r6("S", "score"), "flagged")


@query(
    with_("x AS (SELECT n_chars AS s, (quality = 0)::INT AS y FROM documents JOIN labels USING (doc_id))",
          "g AS (SELECT s, sum(y)::DOUBLE AS p, sum(1 - y)::DOUBLE AS n FROM x GROUP BY s)",
          "c AS (SELECT *, sum(p) OVER () AS tp_all, sum(n) OVER () AS tn_all, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS fp FROM g)",
          "pairs AS (SELECT sum(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END * a.p * b.n) AS u FROM g a, g b)")
    + "SELECT CAST(max(tp_all + tn_all) AS BIGINT) AS n, CAST(max(tp_all) AS BIGINT) AS n_corrupt, round(max(tp_all) / max(tp_all + tn_all), 6) AS base_rate, round(max(u) / max(tp_all * tn_all), 6) AS auroc, round(sum(p * tp / (tp + fp)) / max(tp_all), 6) AS average_precision FROM c, pairs"
)
def detection_metrics(spark, d):
    x = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id").withColumn("bad", F.col("quality") == 0)
    m = evaluation.detection_metrics(x, "bad", "n_chars")
    return m.select("n", "n_corrupt", r6("base_rate"), r6("auroc"), r6("average_precision"))


@query(
    with_("x AS (SELECT lang AS y, CASE WHEN doc_id % 5 = 0 THEN 'en' ELSE lang END AS p FROM documents)", "c AS (SELECT DISTINCT y AS c FROM x UNION SELECT DISTINCT p FROM x)",
          "f AS (SELECT c, (SELECT count(*) FROM x WHERE y = c) AS s, coalesce(2.0 * (SELECT count(*) FROM x WHERE y = c AND p = c) / nullif((SELECT count(*) FROM x WHERE y = c) + (SELECT count(*) FROM x WHERE p = c), 0), 0) AS f1 FROM c)")
    + "SELECT round((SELECT avg((y = p)::INT) FROM x), 6) AS accuracy, round(avg(f1), 6) AS f1_macro, round(sum(f1 * s) / sum(s), 6) AS f1_weighted FROM f"
)
def classification_metrics(spark, d):
    x = table(spark, d, "documents").select("lang", F.when(F.col("doc_id") % 5 == 0, "en").otherwise(F.col("lang")).alias("p"))
    m = evaluation.classification_metrics(x, "lang", "p")
    return m.select(r6("accuracy"), r6("f1_macro"), r6("f1_weighted"))


@query("SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS l_quantity_mean, round(stddev_samp(l_quantity), 6) AS l_quantity_std, count(DISTINCT l_linenumber) AS n_seeds FROM lineitem GROUP BY ALL")
def seed_aggregate(spark, d):
    m = evaluation.over_seeds(table(spark, d, "lineitem"), KEYS, ["l_quantity"], "l_linenumber")
    return m.select(*KEYS, r6("l_quantity_mean"), r6("l_quantity_std"), "n_seeds")


@query(with_("g AS (SELECT l_linenumber AS line, l_returnflag AS scenario, avg(l_extendedprice) AS m FROM lineitem GROUP BY ALL)", "b AS (SELECT line, m AS base FROM g WHERE scenario = 'N')") + "SELECT line, scenario, round(m - base, 6) AS delta FROM g JOIN b USING (line)")
def delta_vs_baseline(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("scenario")).agg(F.avg("l_extendedprice").alias("m"))
    return evaluation.delta_to_baseline(g, ["line"], "scenario", "m", "N").select("line", "scenario", r6("delta_m", "delta"))


@query()
def group_split(spark, d):
    return evaluation.split_rows(table(spark, d, "documents"), "doc_id", group="source").groupBy("source", "split").agg(F.count("*").alias("n"))


@query()
def stratified_split(spark, d):
    return evaluation.split_rows(table(spark, d, "documents"), "doc_id", strata="lang").groupBy("lang", "split").agg(F.count("*").alias("n"))


@query("SELECT lang, least(count(*), 30) AS n FROM documents GROUP BY lang")
def sample_per_label(spark, d):
    return evaluation.sample_per_label(table(spark, d, "documents"), "lang", "doc_id", 30).groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT least(count(*), 100) AS n FROM documents")
def sample_rows(spark, d):
    return evaluation.sample_rows(table(spark, d, "documents"), "doc_id", 100).agg(F.count("*").alias("n"))


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 75")
def frequent_labels(spark, d):
    return slices.frequent_labels(table(spark, d, "part"), "p_brand", 75).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1 HAVING count(*) FILTER (p_partkey % 4 <> 0) >= 55 AND count(*) FILTER (p_partkey % 4 = 0) >= 18")
def supported_labels(spark, d):
    p = table(spark, d, "part").withColumn("split", F.when(F.col("p_partkey") % 4 == 0, "val").otherwise("train"))
    return slices.supported_labels(p, "p_brand", "split", 55, 18).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, count(*) AS total, CAST(sum((o_custkey % 3 <> 0)::INT) AS BIGINT) AS present, round(100.0 * sum((o_custkey % 3 <> 0)::INT) / count(*), 1) AS pct FROM orders GROUP BY 1")
def coverage_by_group(spark, d):
    o = table(spark, d, "orders").withColumn("v", F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")))
    return sinks.coverage(o, "o_orderstatus", "v")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def dup_having(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT c_mktsegment, count(*) AS n, count(DISTINCT c_nationkey) AS nations FROM customer GROUP BY 1")
def distinct_per_model(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_distinct("c_nationkey").alias("nations"))


@query(
    with_("p AS (SELECT c_custkey, ((c_custkey * 13) % 360) - 180 + 0.25 AS lon, ((c_custkey * 7) % 180) - 90 + 0.25 AS lat, c_nationkey % 2 AS year FROM customer)",
          "t AS (SELECT s_suppkey AS tile, (s_suppkey * 17) % 340 - 180 AS x0, (s_suppkey * 29) % 160 - 90 AS y0, s_nationkey % 2 AS year FROM supplier)",
          "j AS (SELECT c_custkey, tile, row_number() OVER (PARTITION BY c_custkey ORDER BY tile) AS r FROM p JOIN t ON p.year = t.year AND lon BETWEEN x0 AND x0 + 12 AND lat BETWEEN y0 AND y0 + 12)")
    + "SELECT c_custkey, tile FROM j WHERE r = 1"
)
def bbox_range_join(spark, d):
    p = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") * 13 % 360 - 180 + 0.25).alias("lon"), (F.col("c_custkey") * 7 % 180 - 90 + 0.25).alias("lat"), (F.col("c_nationkey") % 2).alias("year"))
    x0, y0 = (F.col("s_suppkey") * 17 % 340 - 180), (F.col("s_suppkey") * 29 % 160 - 90)
    t = table(spark, d, "supplier").select(F.col("s_suppkey").alias("tile"), x0.alias("x0"), (x0 + 12).alias("x1"), y0.alias("y0"), (y0 + 12).alias("y1"), (F.col("s_nationkey") % 2).alias("year"))
    return files.points_in_tiles(p, t, "c_custkey", 4.0).select("c_custkey", "tile")


@query("SELECT l_suppkey, count(*) AS n, count(*) >= 600 AS heavy FROM lineitem GROUP BY 1")
def heavy_tiles(spark, d):
    h = files.heavy_tiles(table(spark, d, "lineitem"), "l_suppkey", 600)
    return h.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.first("heavy").alias("heavy"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'old' END AS src FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def resume_new_wins(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    new = o.where("o_orderkey % 2 = 0").withColumn("src", F.lit("new"))
    return slices.newest_wins(new, o.where("o_orderkey % 2 = 0 OR o_orderkey % 3 = 0").withColumn("src", F.lit("old")), ["o_orderkey"])


@query("SELECT k, slice_id, n FROM (SELECT l_returnflag || l_linestatus AS k, count(*) AS n, row_number() OVER (ORDER BY l_returnflag || l_linestatus) - 1 AS slice_id FROM lineitem GROUP BY 1)")
def slice_ids(spark, d):
    df = _items(spark, d).withColumn("k", F.concat(*KEYS))
    return slices.slice_ids(df, ["k"]).groupBy("k", "slice_id").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT DISTINCT l_suppkey FROM lineitem ORDER BY 1 LIMIT 10)")
def first_cells(spark, d):
    return slices.first_cells(table(spark, d, "lineitem"), "l_suppkey").agg(F.count("*").alias("n"))


@query("SELECT mapping, code, label FROM (SELECT 'p_brand' AS mapping, p_size::VARCHAR AS code, max(p_brand) AS label FROM part GROUP BY p_size UNION ALL SELECT 'p_type', p_size::VARCHAR, max(p_type) FROM part GROUP BY p_size)")
def legend_mappings(spark, d):
    p = table(spark, d, "part").groupBy("p_size").agg(F.max("p_brand").alias("p_brand"), F.max("p_type").alias("p_type"))
    return files.legend_mappings(p, "p_size", ["p_brand", "p_type"])


@query("SELECT n_nationkey, 'q5_' || (n_nationkey * 3) % 32 || '_' || (n_nationkey * 5) % 32 AS cell, 'q3_' || (n_nationkey * 3) % 32 // 4 || '_' || (n_nationkey * 5) % 32 // 4 AS parent FROM nation")
def grid_parents(spark, d):
    n = table(spark, d, "nation").withColumn("cell", F.concat_ws("_", F.lit("q5"), (F.col("n_nationkey") * 3 % 32).cast("string"), (F.col("n_nationkey") * 5 % 32).cast("string")))
    return n.select("n_nationkey", "cell", grid.Quad.parent("cell", 3, 5).alias("parent"))


@query("SELECT o_orderkey, round(least(greatest((o_totalprice - lo) / (CASE WHEN hi <= lo THEN 1.0 ELSE hi - lo END), 0.0), 1.0), 6) AS scaled FROM (SELECT *, quantile_cont(o_totalprice, 0.05) OVER (PARTITION BY o_orderstatus) AS lo, quantile_cont(o_totalprice, 0.95) OVER (PARTITION BY o_orderstatus) AS hi FROM orders)")
def percentile_minmax(spark, d):
    return table(spark, d, "orders").select("o_orderkey", r6(stats.minmax("o_totalprice", ["o_orderstatus"]), "scaled"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0 OR o_custkey % 4 = 0")
def region_restriction(spark, d):
    o = table(spark, d, "orders").withColumns({"part": (F.col("o_orderkey") % 5).cast("string"), "split": F.when(F.col("o_custkey") % 4 == 0, "test").otherwise("train")})
    return evaluation.restrict_region(o, "part", ["0"], "train_only").select("o_orderkey")
