"""Pluggable scorers run over partitions.

A scorer is loaded once per Python worker, which outlives tasks and queries, and is fed Arrow
batches; a batch that fails gives NULL scores and the error text, and the job goes on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verigauge.functions import labels as N


class Scorer:
    """Base class. Scores are in [0, 1] and must not depend on how rows are batched."""

    name = "base"
    display_name = "Base scorer"
    description = ""
    batch_size = 256
    default_threshold = 0.5

    def load(self) -> None:
        """Called once per worker before the first batch."""

    def unload(self) -> None:
        """Called when a worker lets go of the scorer because another one, or one with other options, takes its place."""

    def is_ready(self) -> bool:
        return True

    def configure(self, **options) -> "Scorer":
        """Set options such as ``tta_views``; unknown ones are refused."""
        for k, v in options.items():
            if not hasattr(self, k):
                raise ValueError(f"{self.name} has no option {k!r}")
            setattr(self, k, v)
        return self

    def predict_batch(self, rows: pd.DataFrame) -> Sequence[float]:
        """One score per row; NaN for a row that could not be scored."""
        raise NotImplementedError


_REGISTRY: dict[str, type[Scorer]] = {}


def register(cls: type[Scorer]) -> type[Scorer]:
    """Register by name; a later class of the same name replaces the earlier one."""
    _REGISTRY[cls.name] = cls
    return cls


def available() -> list[type[Scorer]]:
    """Scorers that can run now first, then by display name."""
    def ready(cls: type[Scorer]) -> bool:
        try:
            return cls().is_ready()
        except TypeError:                 # needs parameters before it can run
            return False
    return sorted(_REGISTRY.values(), key=lambda c: (not ready(c), c.display_name))


def get_scorer(name: str, *args, **kwargs) -> Scorer:
    if name not in _REGISTRY:
        known = ", ".join(sorted(_REGISTRY))
        raise KeyError(f"no scorer named {name!r}; known: {known}")
    return _REGISTRY[name](*args, **kwargs)


def checked_scores(scorer: Scorer, rows: pd.DataFrame) -> tuple[np.ndarray, str | None]:
    """Scores of a batch, or NaNs and the reason. A wrong number of scores is an error."""
    try:
        got = np.asarray(list(scorer.predict_batch(rows)), dtype=float)
        if got.shape != (len(rows),):
            raise ValueError(f"{len(got)} scores for {len(rows)} rows")
        return got, None
    except Exception as exc:              # one bad batch must not end the job
        return np.full(len(rows), np.nan), f"{type(exc).__name__}: {exc}"


#: The loaded scorer of this Python worker, with its version.
_RESIDENT: dict[str, Scorer] = {}


def version_of(scorer: Scorer) -> str:
    """Equal for equal scorers: a hash of the class and everything it was set up with."""
    return hashlib.sha256(cloudpickle.dumps(scorer)).hexdigest()


def resident(scorer: Scorer, version: str) -> Scorer:
    """The worker's loaded scorer of a version; the first task of a worker loads it, later ones find it."""
    held = _RESIDENT.get(version)
    if held is None:
        for old in list(_RESIDENT):
            _RESIDENT.pop(old).unload()
        scorer.load()
        held = _RESIDENT[version] = scorer
    return held


def _run(given: Scorer, keep: list[str]) -> Callable:
    version = version_of(given)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = resident(given, version)
        for pdf in batches:
            for start in range(0, len(pdf), scorer.batch_size):
                rows = pdf.iloc[start:start + scorer.batch_size]
                scores, why = checked_scores(scorer, rows)
                out = rows[keep].copy()
                out["score"] = pd.array(scores, dtype="Float64")
                out.loc[np.isnan(scores), "score"] = pd.NA
                out["error"] = [
                    (why or "could not be scored") if np.isnan(s) else None for s in scores]
                yield out
    return work


def score(df: DataFrame, scorer: Scorer, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns plus ``score`` (NULL if it failed) and ``error``."""
    keep = list(keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                       for f in df.schema.fields if f.name in keep)
    return df.mapInPandas(_run(scorer, keep), f"{fields}, score double, error string")


def verdict_rows(scored: DataFrame, threshold: float, keep: Sequence[str]) -> DataFrame:
    """``verdict`` fake, real or error, with the probability and the error text."""
    return scored.select(
        *keep, F.coalesce(N.verdict(F.col("score"), threshold), F.lit("error")).alias("verdict"),
        F.col("score").alias("probability_fake"), "error")


@register
class VectorHeadScorer(Scorer):
    """Calibrated probability of a head over a column of feature vectors."""

    name = "vector_head"
    display_name = "Head on feature vectors"
    description = "L2-normalise, standardise, dense layers, Platt scaling."

    def __init__(self, head, column: str = "v") -> None:
        self.head, self.column = head, column
        self.default_threshold = head.operating_point

    def predict_batch(self, rows: pd.DataFrame) -> Sequence[float]:
        h = self.head
        vectors, dims = rows[self.column].to_numpy(), len(h.mu)
        wrong = {len(v) for v in vectors} - {dims}
        if wrong:
            raise ValueError(f"vectors have {min(wrong)} dimensions, the head {dims}")
        x = np.concatenate(vectors).astype(float, copy=False).reshape(-1, dims)
        if h.l2:
            x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
        x = (x - np.asarray(h.mu)) / np.asarray(h.sd)
        for layer in h.hidden:
            x = x @ np.asarray(layer.weights).T + np.asarray(layer.bias)
            if len(layer.mean):
                x = ((x - np.asarray(layer.mean)) / np.sqrt(np.asarray(layer.var) + 1e-5)
                     * np.asarray(layer.gamma) + np.asarray(layer.beta))
            x = np.maximum(x, 0.0)
        logit = x @ np.asarray(h.weights) + h.bias
        return 1.0 / (1.0 + np.exp(-(h.platt_a * logit + h.platt_b)))
