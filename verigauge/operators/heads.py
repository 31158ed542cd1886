"""Detector heads on feature vectors: moments, scoring, ensembles, pooling, health."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verigauge.functions import vectors as V
from verigauge.functions.numeric import nan_to_null, sigmoid
from verigauge.operators.scalars import attach_row

COLLAPSED_COSINE = 0.999
CONSTANT_SD = 1e-8


@dataclass(frozen=True)
class Layer:
    """One dense layer with the batch statistics that follow it, as used at scoring time."""

    weights: Sequence[Sequence[float]]
    bias: Sequence[float]
    mean: Sequence[float] = ()
    var: Sequence[float] = ()
    gamma: Sequence[float] = ()
    beta: Sequence[float] = ()


@dataclass(frozen=True)
class Head:
    """Parameters of one member. ``hidden`` layers make it an MLP."""

    weights: Sequence[float]
    bias: float
    mu: Sequence[float]
    sd: Sequence[float]
    platt_a: float = 1.0
    platt_b: float = 0.0
    threshold: float = 0.0            # on the logit scale
    hidden: tuple[Layer, ...] = ()
    feature: str = "proj"
    l2: bool = True
    preproc: str = "resize"
    tower: str = ""
    name: str = field(default="head")

    @property
    def operating_point(self) -> float:
        """The threshold carried to the probability scale."""
        return 1.0 / (1.0 + math.exp(-(self.platt_a * self.threshold + self.platt_b)))


def compatible(heads: Iterable[Head]) -> list[Head]:
    """Members that read the same features as the first; the others are left out."""
    heads = list(heads)
    if not heads:
        raise ValueError("an ensemble needs at least one head")
    def reads(h: Head) -> tuple:
        return h.feature, h.l2, h.preproc, h.tower, len(h.mu)
    return [h for h in heads if reads(h) == reads(heads[0])]


def feature_moments(df: DataFrame, vector: str, l2: bool = True) -> DataFrame:
    """One row ``(mu, sd)``: mean and population deviation per dimension, + 1e-6.

    The summary is merged per partition; vectors are not taken apart into rows.
    """
    v = V.doubles(F.col(vector))
    v = V.l2_normalise(v) if l2 else v
    parts = df.select(array_to_vector(v).alias("v")).groupBy().agg(
        Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("m")
    ).select(vector_to_array("m.mean").alias("mu"), vector_to_array("m.variance").alias("var"),
             F.col("m.count").alias("n"))
    shrink = (F.col("n") - 1) / F.col("n")
    return parts.select("mu", F.transform(
        "var", lambda x: F.sqrt(x * shrink) + V.SD_EPSILON).alias("sd"))


def _single(moments: DataFrame) -> DataFrame:
    """Given moments, which must be one row: it is sent to every task."""
    found = moments.groupBy().agg(F.first("mu").alias("mu"), F.first("sd").alias("sd"),
                                  F.count(F.lit(1)).alias("n"))
    wrong = F.raise_error(F.lit("moments must be exactly one row")).cast("array<double>")
    return found.select(F.when(F.col("n") == 1, V.doubles(F.col("mu"))).otherwise(wrong).alias("mu"), "sd")


def with_prepared(df: DataFrame, vector: str, moments: DataFrame | None = None,
                  l2: bool = True, out: str = "x") -> DataFrame:
    """L2-normalise, then standardise with the given moments, or with the set's own."""
    v = V.doubles(F.col(vector))
    stats = _single(moments) if moments is not None else feature_moments(df, vector, l2)
    both = attach_row(df, stats.select(F.col("mu").alias("_mu"), F.col("sd").alias("_sd")))
    return both.withColumn(out, V.standardise(
        V.l2_normalise(v) if l2 else v, F.col("_mu"), F.col("_sd"))).drop("_mu", "_sd")


def mlp_logit(vector: Column, head: Head) -> Column:
    """Logit of a head with hidden layers, one matrix product per Arrow batch."""
    dims = len(head.mu)
    mu, sd = np.asarray(head.mu), np.asarray(head.sd)
    layers = [tuple(np.asarray(a, dtype=float) for a in
                    (h.weights, h.bias, h.mean, h.var, h.gamma, h.beta)) for h in head.hidden]
    last, bias, l2 = np.asarray(head.weights, dtype=float), float(head.bias), head.l2

    @F.arrow_udf("double")
    def score(v: pa.Array) -> pa.Array:
        sizes = np.asarray(v.value_lengths().fill_null(-1))
        ok = sizes == dims
        x = np.asarray(v.filter(pa.array(ok)).flatten(), dtype=float).reshape(-1, dims)
        if l2:
            x = x / (np.linalg.norm(x, axis=1, keepdims=True) + V.L2_EPSILON)
        x = (x - mu) / sd
        for w, b, mean, var, gamma, beta in layers:
            x = x @ w.T + b
            if mean.size:
                x = (x - mean) / np.sqrt(var + 1e-5) * gamma + beta
            x = np.maximum(x, 0.0)
        out = np.full(len(sizes), np.nan)
        out[ok] = x @ last + bias
        return pa.array(out, mask=~ok)

    return score(V.doubles(vector))


def member_logits(vector: Column, heads: Sequence[Head]) -> Column:
    """Logits of all members, NULL where the vector has another length.

    Linear members share one norm and one matrix product per Arrow batch.
    """
    if any(h.hidden for h in heads):
        return F.array(*[head_logit(vector, h) for h in heads])
    dims, count, l2 = len(heads[0].mu), len(heads), heads[0].l2
    slopes = np.array([np.asarray(h.weights) / np.asarray(h.sd) for h in heads]).T
    offsets = np.array([h.bias - float(np.dot(h.mu, np.asarray(h.weights) / np.asarray(h.sd)))
                        for h in heads])

    @F.arrow_udf("array<double>")
    def score(v: pa.Array) -> pa.Array:
        ok = np.asarray(v.value_lengths().fill_null(-1)) == dims
        x = np.asarray(v.filter(pa.array(ok)).flatten(), dtype=float).reshape(-1, dims)
        raw = x @ slopes
        if l2:
            raw /= np.linalg.norm(x, axis=1, keepdims=True) + V.L2_EPSILON
        out = np.full((len(ok), count), np.nan)
        out[ok] = raw + offsets
        values = pa.array(out.ravel(), mask=np.repeat(~ok, count))
        return pa.ListArray.from_arrays(
            pa.array(np.arange(0, len(ok) * count + 1, count), pa.int32()), values)

    return score(V.doubles(vector))


def head_logit(vector: Column, head: Head) -> Column:
    if head.hidden:
        return mlp_logit(vector, head)
    return V.linear_logit(V.doubles(vector), head.weights, head.bias, head.mu, head.sd, head.l2)


def probability(logit: Column, head: Head) -> Column:
    return sigmoid(logit * float(head.platt_a) + float(head.platt_b))


def ensemble_scores(df: DataFrame, vector: str, heads: Sequence[Head]) -> DataFrame:
    """Adds ``p``: mean calibrated probability of all members, 6 places; vectors are read once."""
    members = compatible(heads)
    total = F.lit(0.0)
    for i, h in enumerate(members):
        total = total + probability(F.col("_logits")[i], h)
    return (df.withColumn("_logits", member_logits(F.col(vector), members))
            .withColumn("p", F.round(total / len(members), 6)).drop("_logits"))


def ensemble_threshold(heads: Sequence[Head]) -> float:
    points = [h.operating_point for h in compatible(heads)]
    return sum(points) / len(points)


def member_scores(df: DataFrame, vector: str, heads: Sequence[Head]) -> DataFrame:
    """One row per item and member with its logit and probability."""
    members, cells = compatible(heads), []
    for i, h in enumerate(members):
        logit = F.col("_logits")[i]
        cells.append(F.struct(F.lit(h.name).alias("member"), logit.alias("logit"),
                              probability(logit, h).alias("p")))
    return (df.withColumn("_logits", member_logits(F.col(vector), members))
            .select(*[F.col(f"`{c}`") for c in df.columns], F.inline(F.array(*cells))))


def scaled_views(df: DataFrame, vector: str, scales: Sequence[float]) -> DataFrame:
    """Each item once per view; a view multiplies the vector by a number."""
    views = F.array(*[F.struct(F.lit(i).alias("view_id"), F.lit(float(s)).alias("scale"))
                      for i, s in enumerate(scales)])
    wide = df.select("*", F.inline(views))
    v = V.doubles(F.col(vector))
    return wide.withColumn(
        vector, V.each_with(v, F.col("scale"), lambda x, k: x * k)).drop("scale")


def pool_views(df: DataFrame, item: Sequence[str], prob: str = "p") -> DataFrame:
    """Mean probability over an item's views, 6 places; a failed view (NULL or NaN) does not count."""
    p = nan_to_null(F.col(prob))
    return df.groupBy(*item).agg(F.round(F.avg(p), 6).alias("p"), F.count(p).alias("views"))


def class_weight(df: DataFrame, truth: str = "y") -> DataFrame:
    """Negatives per positive, the weight of the positive class."""
    y = F.col(truth)
    return df.groupBy().agg(
        F.count(F.when(y == 0, 1)).alias("n_neg"), F.count(F.when(y == 1, 1)).alias("n_pos"),
    ).withColumn("pos_weight", F.col("n_neg") / F.greatest(F.col("n_pos"), F.lit(1)))


def view_loss(logit: Column, truth: Column, pos_weight: Column) -> Column:
    """Weighted logistic loss of one view."""
    soft = F.greatest(logit, F.lit(0.0)) + F.log1p(F.exp(-F.abs(logit)))
    return F.when(truth == 1, pos_weight * (soft - logit)).otherwise(soft)


def dimension_health(df: DataFrame, vector: str) -> DataFrame:
    """Per dimension: NaN and infinite values, mean, deviation, and whether it is constant."""
    flat = df.select(F.posexplode(V.doubles(F.col(vector))).alias("dim", "x"))
    x, inf = F.col("x"), float("inf")
    bad = F.isnan(x) | (x == inf) | (x == -inf)
    good = F.when(~bad, x)
    return flat.groupBy("dim").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.isnan(x), 1)).alias("n_nan"),
        F.count(F.when(~F.isnan(x) & bad, 1)).alias("n_inf"), F.avg(good).alias("mean"),
        F.stddev_pop(good).alias("sd"),
    ).withColumn("constant", F.coalesce(F.col("sd") < CONSTANT_SD, F.lit(False)))


def collapse_check(df: DataFrame, vector: str, item: str) -> DataFrame:
    """Do all items point the same way? One row, in time linear in the number of items.

    Every vector is compared with the first item's and with the mean direction,
    never with every other one. One cosine to the first item at or below 0.999
    proves the set is not collapsed. If all lie within half that angle of the
    mean, every pair is above 0.999.
    """
    v = V.doubles(F.col(vector))
    unit = df.select(item, F.transform(
        v, lambda x: x).alias("v")).withColumn("u", V.l2_normalise(F.col("v")))
    centre = unit.groupBy().agg(
        F.min_by("u", item).alias("anchor"),
        Summarizer.metrics("mean").summary(array_to_vector("u")).alias("m"),
    ).select("anchor", vector_to_array("m.mean").alias("mean"))
    rated = attach_row(unit, centre).select(
        V.cosine(F.col("u"), F.col("anchor")).alias("to_first"),
        V.cosine(F.col("u"), F.col("mean")).alias("to_mean"))
    near = math.cos(math.acos(COLLAPSED_COSINE) / 2.0)
    return rated.groupBy().agg(
        F.count(F.lit(1)).alias("n"), F.min("to_first").alias("min_to_first"),
        F.avg("to_first").alias("mean_to_first"), F.min("to_mean").alias("min_to_mean"),
    ).withColumn("verdict", F.when(F.col("min_to_first") <= COLLAPSED_COSINE, "distinct")
                 .when(F.col("min_to_mean") >= near, "collapsed").otherwise("nearly collapsed"))


def exact_copies(df: DataFrame, vector: str, item: str) -> DataFrame:
    """Groups of equal vectors: first item, size and number of pairs, counted not listed."""
    return (
        df.groupBy(F.xxhash64(vector).alias("_h"), F.col(vector).alias("_v"))
        .agg(F.min(item).alias("first_item"), F.count(F.lit(1)).alias("items"))
        .where(F.col("items") > 1)
        .select("first_item", "items",
                (F.col("items") * (F.col("items") - 1) / 2).cast("bigint").alias("pairs")))
