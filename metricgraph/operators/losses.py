"""Losses and reports as aggregations."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricgraph.functions.arrays import dot, mean, sigmoid, softplus, squared_deviation, total
from metricgraph.functions.blocks import near_sums, pair_sums
from metricgraph.operators.graph import at_ends


def kl_divergence(rows: DataFrame) -> DataFrame:
    """One row, kl: mean over rows(mu, logvar) of the divergence from the standard normal (G1)."""
    each = F.zip_with("mu", "logvar", lambda m, lv: 1.0 + lv - m * m - F.exp(lv))
    return rows.agg(F.avg(-0.5 * total(each)).alias("kl"))


def mean_squared_error(rows: DataFrame) -> DataFrame:
    """One row, mse: mean over all entries of rows(target, pred)."""
    diff = F.zip_with("target", "pred", lambda x, y: (x - y) * (x - y))
    return rows.agg(F.try_divide(F.sum(total(diff)), F.sum(F.size("target"))).alias("mse"))


def variance_penalised_error(rows: DataFrame, weight: float = 0.001, eps: float = 1e-8) -> DataFrame:
    """One row, loss: mse + weight * mean of SSD(target) / (SSD(pred) + eps)."""
    penalty = squared_deviation(F.col("target")) / (squared_deviation(F.col("pred")) + eps)
    diff = F.zip_with("target", "pred", lambda x, y: (x - y) * (x - y))
    return rows.agg((F.try_divide(F.sum(total(diff)), F.sum(F.size("target"))) + weight * F.avg(penalty)).alias("loss"))


def gaussian_nll(rows: DataFrame, component: float = 5.0, decoder: float = 100.0, eps: float = 1e-8) -> DataFrame:
    """One row: nll, comp_var, dec_var and their weighted sum loss, of rows(target, mu, logvar)."""
    std = F.transform("logvar", lambda lv: F.exp(0.5 * lv) + eps)
    z = F.zip_with(F.zip_with("target", "mu", lambda x, m: x - m), std, lambda d, s: 0.5 * (d / s) * (d / s) + F.log(s))
    nll = total(z) + 0.5 * math.log(2 * math.pi) * F.size("target")
    v_x = squared_deviation(F.col("target")) / F.size("target")
    v_mu = squared_deviation(F.col("mu")) / F.size("mu")
    noise = mean(F.transform("logvar", lambda lv: F.exp(lv)))
    parts = rows.select(nll.alias("nll"), ((v_mu - v_x) * (v_mu - v_x)).alias("c"), (noise - F.greatest(v_x - v_mu, F.lit(eps))).alias("r"))
    out = parts.agg(F.avg("nll").alias("nll"), F.avg("c").alias("comp_var"), F.avg(F.col("r") * F.col("r")).alias("dec_var"))
    return out.withColumn("loss", F.col("nll") + component * F.col("comp_var") + decoder * F.col("dec_var"))


def adjacency_bce(latent: DataFrame, edges: DataFrame, pos_weight: float = 1.0, norm: float = 1.0) -> DataFrame:
    """One row, loss: cross entropy of sigmoid(z zT) against A over all n^2 pairs.

    The sum over all pairs of softplus(x) is made block against block and added up at once; A only enters at its edges:
    -a pos_weight log p - (1 - a) log (1 - p) = softplus(x) + a (pos_weight softplus(-x) - softplus(x)). Edges may carry z at their ends.
    """
    n = latent.count()
    logit = F.col("logit")
    whole = pair_sums(latent, lambda x: np.logaddexp(0.0, x)).agg(F.sum("value").alias("whole"))
    at = at_ends(edges, latent, "z").select("weight", dot(F.col("z_src"), F.col("z_dst")).alias("logit"))
    part = at.agg(F.coalesce(F.sum(F.col("weight") * (pos_weight * softplus(-logit) - softplus(logit))), F.lit(0.0)).alias("part"))
    return whole.crossJoin(part).select((norm * (F.col("whole") + F.col("part")) / float(n * n)).alias("loss"))


def near_adjacency_bce(latent: DataFrame, radius: float, pos_weight: float = 1.0, norm: float = 1.0) -> DataFrame:
    """adjacency_bce of latent(node_id, z, at) over the radius graph of `at`, whose edges weigh their length: no edge is made a row."""
    n = latent.count()
    whole = pair_sums(latent.select("node_id", "z"), lambda x: np.logaddexp(0.0, x)).agg(F.sum("value").alias("whole"))
    on_edge = lambda x, w: w * (pos_weight * np.logaddexp(0.0, -x) - np.logaddexp(0.0, x))
    part = near_sums(latent.select(F.col("node_id").alias("id"), "at", F.col("z").alias("v")), radius, on_edge).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("part"))
    return whole.crossJoin(part).select((norm * (F.col("whole") + F.col("part")) / float(n * n)).alias("loss"))


def total_loss(losses: DataFrame, weights: DataFrame, kl: Column | float = 0.0, kl_weight: float = 0.0) -> DataFrame:
    """One row, total: sum of weight * loss of losses(decoder, component, value) and weights(decoder, component, weight,
    active), plus the weighted divergence (G6).

    A component that is not active does not count. A decoder's sum has the weight of its component "decoder": 0 skips
    it, -1 makes it 1; a missing weight is 1.
    """
    custom = losses.join(weights.filter("component <> 'decoder'"), ["decoder", "component"], "left").filter("coalesce(active, true)")
    by = custom.groupBy("decoder").agg(F.sum(F.col("value") * F.coalesce("weight", F.lit(1.0))).alias("loss"))
    own = weights.filter("component = 'decoder'").select("decoder", F.col("weight").alias("w"))
    scaled = by.join(own, "decoder", "left").select(F.when(F.col("w") == -1, F.when(F.col("loss") != 0, 1.0)).otherwise(F.coalesce("w", F.lit(1.0)) * F.col("loss")).alias("x"))
    kl = kl if isinstance(kl, Column) else F.lit(float(kl))
    return scaled.agg((F.coalesce(F.sum("x"), F.lit(0.0)) + kl_weight * kl).alias("total"))


#: The slope and the middle of the sigmoid, the cycles of a schedule and the part of a cycle that rises.
SLOPE, MIDDLE, CYCLES, RISING = 5.0, 0.5, 4, 0.5
#: Share of the way from start to end, by the step and the number of steps.
SHAPES: dict[str, Callable[[Column, int], Column]] = {
    "linear": lambda step, n: F.least(F.lit(1.0), step / float(n)),
    "sigmoid": lambda step, n: sigmoid(SLOPE * (F.least(F.lit(1.0), step / float(n)) - MIDDLE)),
    "cyclical": lambda step, n: F.least(F.lit(1.0), F.pmod(CYCLES * step.cast("double"), F.lit(float(n))) / (RISING * n)),
    "constant": lambda step, n: F.lit(1.0),
    "none": lambda step, n: F.lit(0.0),
}


def kl_weight(step: Column, kind: str, steps: int, weight: float = 1.0, start: float = 0.0, end: float = 1.0) -> Column:
    """Weight of the divergence at a step, by one of SHAPES (G7): weight times a level between start and end; a constant
    schedule has the level `weight`, none has 0."""
    if kind not in SHAPES:
        raise ValueError(f"unknown schedule: {kind}")
    low, high = {"constant": (weight, weight), "none": (0.0, 0.0)}.get(kind, (start, end))
    return weight * (low + (high - low) * SHAPES[kind](step, steps))


def epoch_means(history: DataFrame) -> DataFrame:
    """(epoch, decoder, component, value): mean of each epoch's batch losses of history."""
    return history.groupBy("epoch", "decoder", "component").agg(F.avg("value").alias("value"))
