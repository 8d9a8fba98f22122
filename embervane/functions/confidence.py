"""Confidence that a row is no outlier, as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stats import clip, sigmoid, with_mad
from .vectors import _c


def curve(score, flagged=None, t: float = 0.975, alpha: float = 0.3, floor: float = 0.01, eps: float = 1e-9) -> Column:
    """Falls from 1 at ``t`` to ``floor`` at 1; rows that aren't flagged have 1 exactly (if ``flagged`` is given)."""
    if not 0 <= t < 1 or not 0 < floor <= 1 or alpha <= 0 or eps <= 0:
        raise ValueError("t in [0, 1), floor in (0, 1], alpha > 0 and eps > 0 are needed")
    y = clip((F.coalesce(_c(score), F.lit(0.0)) - t) / (1 - t), 0.0, 1.0)
    c = clip(floor + (1 - floor) * F.exp(-alpha * y / (1 - y + eps)), floor, 1.0)
    return c if flagged is None else F.when(_c(flagged), c).otherwise(F.lit(1.0))


def flagged_z(score, med, mad) -> Column:
    return F.greatest((_c(score) - _c(med)) / F.when(_c(mad) == 0, F.lit(1.0)).otherwise(_c(mad)), F.lit(0.0))


def robust(z, flagged, knee: float = 3.0, eps: float = 1e-3, extreme: float = 10.0, limit: float = 50.0) -> Column:
    """Logistic in a robust z: one half at ``knee``, ``eps`` at ``extreme``; 1 where not flagged."""
    k = math.log(1 / eps - 1) / (extreme - knee)
    return F.when(_c(flagged), 1 / (1 + F.exp(clip(k * (_c(z) - knee), -limit, limit)))).otherwise(F.lit(1.0))


def fuse(conf, margin=None, purity=None, flagged=None, m0: float = 1e-3, slope: float = 10.0, beta: float = 0.5, floor: float = 0.85) -> Column:
    """conf times a margin factor and a purity factor, each at least ``floor``, 1 where unknown or not flagged."""

    def factor(value: Column) -> Column:
        f = F.coalesce(value, F.lit(1.0))
        return F.greatest(f if flagged is None else F.when(_c(flagged), f).otherwise(F.lit(1.0)), F.lit(floor))

    out = _c(conf)
    if margin is not None:
        out = out * factor(sigmoid(slope * (_c(margin) - m0)))
    if purity is not None:
        out = out * factor(F.pow(_c(purity), F.lit(beta)))
    return out


def attenuate(conf, trust, flagged, min_trust: float = 0.3, floor: float = 0.0) -> Column:
    """Where trust in a slice's geometry is low, a flag takes less away."""
    share = clip(F.coalesce(_c(trust), F.lit(0.5)) / min_trust, 0.0, 1.0)
    return F.when(_c(flagged), F.greatest(1 - (1 - _c(conf)) * share, F.lit(floor))).otherwise(_c(conf))


def _finite(w: Column) -> Column:
    bad = F.isnan(w) | (F.abs(w) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("a sample weight isn't finite")).cast("double")).otherwise(w)


def check_weights(df, weight: str = "weight"):
    """``df``, or an error if it has rows and none of them weighs more than 0 (one aggregate of the table)."""
    top = df.agg(F.max(weight).alias("w"), F.count("*").alias("n")).first()
    if top["n"] and top["w"] is not None and top["w"] <= 0:
        raise ValueError("all sample weights are 0 or less")
    return df


def robust_by_slice(df, keys: list[str], score: str = "mean_score", flagged: str = "flagged", z: str = "z_mad", out: str = "confidence", **args):
    """Adds the robust z of ``score`` in its own slice (0 below the slice's median) and the confidence from it."""
    df = with_mad(df, score, keys, "_med", "_mad")
    df = df.withColumn(z, flagged_z(score, "_med", "_mad")).drop("_med", "_mad")
    return df.withColumn(out, robust(z, flagged, **args))


def sample_weight(conf, mode: str = "linear", power: float = 1.0, lo: float = 0.0, hi: float = 1.0, scale: float = 1.0, shift: float = 0.0) -> Column | None:
    """none and filter: no weight; linear, power, clip and affine (clipped too) of the confidence; what isn't finite is an error."""
    c = _c(conf).cast("double")
    if mode in ("none", "filter"):
        return F.lit(None).cast("double")
    if mode == "linear":
        return _finite(c)
    if mode == "power":
        if power <= 0:
            raise ValueError("power > 0 is needed")
        return _finite(F.pow(c, F.lit(power)))
    if mode == "clip":
        return _finite(clip(c, lo, hi))
    if mode == "affine":
        return _finite(clip(scale * c + shift, lo, hi))
    raise ValueError(f"unknown mode {mode}")
