"""Label noise, detection and classification metrics, reference detectors, training-set treatments."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import confidence, stats
from ..session import cut
from . import context as ctx
from . import flagging, kernels, scoring


def hash_order(id_col: str, seed: int):
    """The order that stands for a random one: the same for the same seed and id, however the rows are partitioned."""
    return F.xxhash64(F.col(id_col).cast("string"), F.lit(seed))


def sample_rows(df: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    return df.orderBy(hash_order(id_col, seed), id_col).limit(n)


def sample_per_label(df: DataFrame, label: str, id_col: str, n: int = 300, seed: int = 0) -> DataFrame:
    w = Window.partitionBy(label).orderBy(hash_order(id_col, seed), id_col)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def split_rows(df: DataFrame, id_col: str, strata: str | None = None, group: str | None = None, test: float = 0.2, seed: int = 0) -> DataFrame:
    """Adds ``split``: by group (whole groups go one way), or by rank in hash order within each stratum."""
    if group:
        share = F.pmod(hash_order(group, seed), F.lit(1_000_000)) / 1_000_000
        return df.withColumn("split", F.when(share < test, "test").otherwise("train"))
    w = Window.partitionBy(strata) if strata else Window.partitionBy(F.lit(0))
    if not strata:
        share = F.pmod(hash_order(id_col, seed), F.lit(1_000_000)) / 1_000_000
        return df.withColumn("split", F.when(share < test, "test").otherwise("train"))
    r = F.row_number().over(w.orderBy(hash_order(id_col, seed), id_col))
    return df.withColumn("_r", r).withColumn("split", F.when(F.col("_r") <= F.bround(test * F.count("*").over(w)), "test").otherwise("train")).drop("_r")


@dataclass(frozen=True)
class Noise:
    mode: str = "within_context"
    rate: float = 0.05
    label: str = "label"
    context: str | None = None
    group: str | None = None
    seed: int = 0


def add_noise(df: DataFrame, spec: Noise, id_col: str) -> DataFrame:
    """Adds label_noisy and noise_truth: max(1, round(rate * n)) rows (or groups) get another label.

    within_context takes a label that occurs in the row's context (any, if there is no other there).
    """
    if spec.mode not in ("within_context", "random", "group"):
        raise ValueError(f"unknown mode {spec.mode}")
    unit = spec.group if spec.mode == "group" else id_col
    if unit is None:
        raise ValueError("mode group needs a group column")
    units = df.groupBy(unit).agg(F.min_by(spec.label, id_col).alias("_cur")) if spec.mode == "group" else df.select(unit)
    n = max(1, round(spec.rate * units.count()))
    hit = units.orderBy(hash_order(unit, spec.seed), unit).limit(n).withColumn("_hit", F.lit(True))
    labels = F.broadcast(df.select(spec.label).distinct().agg(F.sort_array(F.collect_set(spec.label)).alias("_all")))
    out = df.join(hit, unit, "left")
    if spec.mode != "group":
        out = out.withColumn("_cur", F.col(spec.label))
    out = out.join(labels)
    rest = lambda a: F.array_except(a, F.array("_cur"))
    options = rest(F.col("_all"))
    if spec.mode == "within_context" and spec.context:
        local = df.groupBy(spec.context).agg(F.sort_array(F.collect_set(spec.label)).alias("_near"))
        out = out.join(local, spec.context, "left")
        options = F.when(F.size(rest(F.col("_near"))) > 0, rest(F.col("_near"))).otherwise(options)
    out = out.withColumn("_opt", options)
    pick = F.try_element_at("_opt", (F.pmod(F.xxhash64(F.col(unit).cast("string"), F.lit(spec.seed + 1)), F.greatest(F.size("_opt"), F.lit(1))) + 1).cast("int"))
    hit_ = F.coalesce("_hit", F.lit(False))
    out = out.withColumns({"label_noisy": F.when(hit_, F.coalesce(pick, F.col(spec.label))).otherwise(F.col(spec.label)), "noise_truth": hit_})
    return out.select(*df.columns, "label_noisy", "noise_truth")


#: Ranges of scores that running sums are divided into.
BANDS = 256


def detection_metrics(df: DataFrame, truth: str, score: str, flag: str | None = None, shares: tuple[float, ...] = (0.01, 0.05, 0.10), only: str | None = None, run: str | None = None) -> DataFrame:
    """One row (for each ``run``): AUROC (ties half), average precision, precision, recall and lift at k, and of the flag.

    Rows meet only by distinct score.  The running sums over those are taken within ranges of scores (some 1/BANDS of them
    each) and then over the ranges, so no task holds all scores.
    """
    if only:
        df = df.where(F.col(only))
    keys = [run] if run else []
    df = df.where(F.col(score).isNotNull())
    y = F.col(truth).cast("int")
    by = df.groupBy(*keys, score).agg(F.sum(y).cast("double").alias("p"), F.sum(1 - y).cast("double").alias("n"))
    cuts = by.groupBy(*keys).agg(F.percentile_approx(F.col(score).cast("double"), [i / BANDS for i in range(1, BANDS)], 40 * BANDS).alias("_cuts"))
    by = by.join(cuts, keys) if keys else by.join(F.broadcast(cuts))
    by = by.withColumn("_band", F.size(F.filter("_cuts", lambda c: c < F.col(score).cast("double")))).drop("_cuts")
    # At most BANDS rows for each run: what lies in lower bands, and in all.
    band = by.groupBy(*keys, "_band").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    lower = w.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    band = band.withColumns({"all_p": F.sum("_p").over(w), "all_n": F.sum("_n").over(w), "_lp": F.coalesce(F.sum("_p").over(lower), F.lit(0.0)), "_ln": F.coalesce(F.sum("_n").over(lower), F.lit(0.0))})
    by = by.join(band.drop("_p", "_n"), [*keys, "_band"])
    up = Window.partitionBy(*keys, "_band").orderBy(score).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by = by.withColumns({"cp": F.col("_lp") + F.sum("p").over(up), "cn": F.col("_ln") + F.sum("n").over(up)})
    by = by.withColumns({"tp": F.col("all_p") - F.col("cp") + F.col("p"), "fp": F.col("all_n") - F.col("cn") + F.col("n")})
    ratio = lambda a, b: F.when(b > 0, a / b)
    aggs = [
        F.max(F.col("all_p") + F.col("all_n")).cast("long").alias("n"),
        F.max("all_p").cast("long").alias("n_corrupt"),
        ratio(F.max("all_p"), F.max(F.col("all_p") + F.col("all_n"))).alias("base_rate"),
        ratio(F.sum(F.col("p") * (F.col("cn") - F.col("n") / 2)), F.max(F.col("all_p") * F.col("all_n"))).alias("auroc"),
        ratio(F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.max("all_p")).alias("average_precision"),
    ]
    out = by.groupBy(*keys).agg(*aggs)
    for share in shares:
        # Rows above the cut, and of those tied at it as many as fit, in proportion of their truth.
        name = f"{share:g}".replace("0.", "")
        k = F.greatest(F.lit(1.0), F.bround(share * (F.col("all_p") + F.col("all_n"))))
        above = F.col("tp") + F.col("fp") - F.col("p") - F.col("n")
        take = F.greatest(F.lit(0.0), F.least(k - above, F.col("p") + F.col("n")))
        hits = F.sum(take * F.col("p") / (F.col("p") + F.col("n")))
        at = by.groupBy(*keys).agg(hits.alias("_h"), F.max(k).alias("_k"), F.max("all_p").alias("_p"), F.max(F.col("all_p") + F.col("all_n")).alias("_n"))
        at = at.select(*keys, ratio(F.col("_h"), F.col("_k")).alias(f"precision_at_{name}"), ratio(F.col("_h"), F.col("_p")).alias(f"recall_at_{name}"), ratio(F.col("_h") / F.col("_k"), F.col("_p") / F.col("_n")).alias(f"lift_at_{name}"))
        out = out.join(at, keys) if keys else out.join(at)
    if flag:
        f = F.col(flag).cast("int")
        c = df.groupBy(*keys).agg(F.sum(f * y).alias("_tp"), F.sum(f).alias("n_flagged"), F.sum(y).alias("_p"), F.count("*").alias("_n"))
        pr, rc = ratio(F.col("_tp"), F.col("n_flagged")), ratio(F.col("_tp"), F.col("_p"))
        c = c.select(*keys, "n_flagged", pr.alias("flag_precision"), rc.alias("flag_recall"), ratio(2.0 * F.col("_tp"), F.col("n_flagged") + F.col("_p")).alias("flag_f1"), ratio(pr, F.col("_p") / F.col("_n")).alias("flag_enrichment"))
        out = out.join(c, keys) if keys else out.join(c)
    return out


def classification_metrics(df: DataFrame, truth: str, predicted: str, run: str | None = None) -> DataFrame:
    """accuracy, f1_macro (over classes in either column), f1_weighted; a class without rows in a denominator has 0."""
    keys = [run] if run else []
    a = df.groupBy(*keys, F.col(truth).cast("string").alias("c")).agg(F.count("*").alias("s"), F.sum((F.col(truth) == F.col(predicted)).cast("int")).alias("tp"))
    b = df.groupBy(*keys, F.col(predicted).cast("string").alias("c")).agg(F.count("*").alias("q"))
    both = a.join(b, [*keys, "c"], "full").fillna(0, ["s", "tp", "q"])
    both = both.withColumn("f1", F.when(F.col("s") + F.col("q") > 0, 2.0 * F.col("tp") / (F.col("s") + F.col("q"))).otherwise(0.0))
    return both.groupBy(*keys).agg(
        (F.sum("tp") / F.sum("s")).alias("accuracy"), F.avg("f1").alias("f1_macro"), (F.sum(F.col("f1") * F.col("s")) / F.sum("s")).alias("f1_weighted")
    )


def over_seeds(df: DataFrame, keys: list[str], metrics: list[str], seed: str = "seed") -> DataFrame:
    aggs = [f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return df.groupBy(*keys).agg(*aggs, F.count_distinct(seed).alias("n_seeds"))


def delta_to_baseline(df: DataFrame, keys: list[str], scenario: str, metric: str, baseline: str = "baseline") -> DataFrame:
    """Adds baseline_{metric} and delta_{metric}; groups without a baseline go."""
    base = F.avg(F.when(F.col(scenario) == baseline, F.col(metric))).over(Window.partitionBy(*keys))
    df = df.withColumn(f"baseline_{metric}", base).where(F.col(f"baseline_{metric}").isNotNull())
    return df.withColumn(f"delta_{metric}", F.col(metric) - F.col(f"baseline_{metric}"))


# ---- detectors ---------------------------------------------------------------


def screen(
    df: DataFrame, keys: list[str], id_col: str, mode: str = "mad", mad_k: float = 4.0, context: list[str] | None = None, label: str | None = None,
    min_trust: float | None = None, min_scored: int = scoring.MIN_SCORED, **score_args,
) -> DataFrame:
    """Scores, flags and confidence in one call: no class mapping, no merging, no fusion."""
    df = cut(df)  # read by every branch of the scorer
    out = cut(scoring.score_slices(df, keys, id_col, min_scored=min_scored, **score_args))
    out = flagging.flag(out, keys, id_col, mode=mode, k=mad_k, scored="scored")
    out = out.withColumn("confidence", confidence.curve("mean_score", flagged="flagged"))
    if min_trust is not None:
        out = out.join(ctx.trust(df, context, label, id_col), context, "left")
        out = out.withColumn("confidence", confidence.attenuate("confidence", "slice_trust", "flagged", min_trust))
    return out


def scale_score(df: DataFrame, score: str) -> DataFrame:
    """``score`` between its least and greatest (finite) value over all rows."""
    ok = F.when(~F.isnan(score), F.col(score))
    b = df.agg(F.min(ok).alias("_lo"), F.max(ok).alias("_hi"))
    return df.join(F.broadcast(b)).withColumn(score, (F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-12)).drop("_lo", "_hi")


def flag_share(df: DataFrame, score: str, share: float) -> DataFrame:
    """Flags what is above the (1 - share) quantile of all rows."""
    q = df.agg(F.percentile(score, F.lit(1 - share)).alias("_q"))
    return df.join(F.broadcast(q)).withColumn("flagged", F.col(score) > F.col("_q")).drop("_q")


def detect_global(df: DataFrame, label: str, id_col: str, **args) -> DataFrame:
    """The slice scorer without locality: a slice is a label."""
    return screen(df, [label], id_col, **args)


def detect_isolation(df: DataFrame, label: str, id_col: str, contamination: float = 0.1, vec: str = "embedding", **_) -> DataFrame:
    out = df.join(kernels.isolation_forest(df, id_col, vec).withColumnRenamed("score", "S"), id_col)
    return scale_score(flag_share(out, "S", contamination), "S")


def detect_lof(df: DataFrame, label: str, id_col: str, contamination: float = 0.1, vec: str = "embedding", k: int = 20, **_) -> DataFrame:
    out = df.join(kernels.lof(df, [], id_col, vec, k).withColumnRenamed("lof", "S"), id_col)
    return scale_score(flag_share(out, "S", contamination), "S")


def detect_disagreement(df: DataFrame, label: str, id_col: str, cell: str = "cell", min_n: int = 5, at: float = 0.5, **_) -> DataFrame:
    """1 - the share of the cell's other rows with the same label; cells below ``min_n`` rows are not scored."""
    n, same = F.count("*").over(Window.partitionBy(cell)), F.count("*").over(Window.partitionBy(cell, label))
    out = df.withColumns({"_n": n, "_s": same})
    s = F.when(F.col("_n") >= min_n, 1 - (F.col("_s") - 1) / (F.col("_n") - 1))
    return out.withColumn("S", s).withColumn("flagged", F.coalesce(F.col("S") >= at, F.lit(False))).drop("_n", "_s")


DETECTORS: dict[str, Callable[..., DataFrame]] = {
    "global": detect_global, "isolation_forest": detect_isolation, "lof": detect_lof, "spatial_disagreement": detect_disagreement,
}


def register_detector(name: str, fn: Callable[..., DataFrame]) -> None:
    DETECTORS[name] = fn


def noise_sweep(df: DataFrame, label: str, id_col: str, context: list[str], modes: list[str], rates: list[float], seeds: list[int], group: str | None = None, detectors: dict[str, Callable] | None = None, **args) -> DataFrame:
    """One row for each detector, mode, rate and seed: its detection metrics.  Mode group needs a group column, else it is left out."""
    found = None
    for mode in modes:
        if mode == "group" and group is None:
            continue
        for rate in rates:
            for seed in seeds:
                noisy = add_noise(df, Noise(mode, rate, label, context[0] if context else None, group, seed), id_col)
                for name, fn in (detectors or {"slices": lambda d, lab, i, **a: screen(d, [*context, lab], i, **a)}).items():
                    got = fn(noisy, "label_noisy", id_col, **args)
                    row = detection_metrics(got, "noise_truth", "S", "flagged", only="scored" if "scored" in got.columns else None)
                    row = row.select(F.lit(name).alias("detector"), F.lit(mode).alias("mode"), F.lit(rate).alias("rate"), F.lit(seed).alias("seed"), "*")
                    found = row if found is None else found.unionByName(row)
    return found


# ---- treatments --------------------------------------------------------------


@dataclass(frozen=True)
class Scenario:
    name: str = "baseline"
    drop_flags: tuple[str, ...] = ()
    weight: str = "none"
    power: float = 1.0
    min_confidence: float = 0.5
    floor: float = 0.0


SCENARIOS = (
    Scenario(), Scenario("drop_candidate", ("candidate",)), Scenario("drop_suspect", ("candidate", "suspect")),
    Scenario("drop_flagged", ("candidate", "suspect", "flagged")), Scenario("weight_linear", (), "linear"), Scenario("weight_power2", (), "power", 2.0),
    Scenario("filter_05", (), "filter"), Scenario("drop_candidate_linear", ("candidate",), "linear"),
)


def apply_scenario(df: DataFrame, s: Scenario, flag_col: str = "anomaly_flag", conf: str = "confidence", out: str = "weight") -> DataFrame:
    """Rows that a treatment keeps, with their weight (1 where it has none); unknown confidence is 1."""
    c = stats.clip(F.coalesce(F.col(conf), F.lit(1.0)), 0.0, 1.0)
    if s.drop_flags:
        df = df.where(~F.coalesce(F.col(flag_col).isin(*s.drop_flags), F.lit(False)))
    if s.weight == "filter":
        return df.where(c >= s.min_confidence).withColumn(out, F.lit(1.0))
    w = confidence.sample_weight(c, s.weight, s.power)
    return df.withColumn(out, F.greatest(F.coalesce(w, F.lit(1.0)), F.lit(s.floor)))


def weight_column(df: DataFrame, s: Scenario, flag_col: str = "anomaly_flag", conf: str = "confidence", out: str = "weight") -> DataFrame:
    """All rows, the treatment as a weight alone: 0 is dropped."""
    c = stats.clip(F.coalesce(F.col(conf), F.lit(1.0)), 0.0, 1.0)
    gone = F.coalesce(F.col(flag_col).isin(*s.drop_flags), F.lit(False)) if s.drop_flags else F.lit(False)
    w = (c >= s.min_confidence).cast("double") if s.weight == "filter" else F.greatest(F.coalesce(confidence.sample_weight(c, s.weight, s.power), F.lit(1.0)), F.lit(s.floor))
    return df.withColumn(out, F.when(gone, 0.0).otherwise(w))


def test_view(df: DataFrame, view: str, flag_col: str = "anomaly_flag", gold: str | None = None, quality: str | None = None) -> DataFrame:
    """full; clean (a gold mask, else quality of at least 0.9, percentages too, else all); minus_flagged."""
    if view == "full":
        return df
    if view == "minus_flagged":
        return df.where(F.coalesce(F.col(flag_col) == "normal", F.lit(True)))
    if view != "clean":
        raise ValueError(f"unknown view {view}")
    if gold:
        return df.where(F.col(gold))
    if not quality:
        return df
    m = F.broadcast(df.agg(F.max(quality).alias("_q")))
    return df.join(m).where(F.col(quality) / F.when(F.col("_q") > 1.5, 100.0).otherwise(1.0) >= 0.9).drop("_q")


def restrict_region(df: DataFrame, region: str, keep: list[str], how: str = "all", split: str = "split") -> DataFrame:
    """train_only: rows of the test split stay whatever their region."""
    inside = F.col(region).isin(*keep)
    return df.where(inside | (F.col(split) == "test")) if how == "train_only" else df.where(inside)


def proxy_classifier(train: DataFrame, test: DataFrame, label: str, vec: str = "embedding", weight: str | None = None, max_iter: int = 50) -> DataFrame:
    """Test rows with ``predicted``: a weighted multinomial logistic regression stands for the downstream model."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IndexToString, StringIndexer
    from pyspark.ml.functions import array_to_vector

    index = StringIndexer(inputCol=label, outputCol="_y", handleInvalid="skip").fit(train)
    with_x = lambda d: d.withColumn("_x", array_to_vector(F.col(vec).cast("array<double>")))
    lr = LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=max_iter, predictionCol="_p")
    lr = lr.setWeightCol(weight) if weight else lr
    out = lr.fit(with_x(index.transform(train))).transform(with_x(test))
    return IndexToString(inputCol="_p", outputCol="predicted", labels=index.labels).transform(out).drop("_x", "_p", "rawPrediction", "probability")
