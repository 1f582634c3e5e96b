"""Probability blending and thresholding (P16, P14, ML5, R1, R4)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Blend weights and decision threshold of the submission.
WEIGHTS = {"p_b": 0.25, "p_c": 0.25, "p_a": 0.5}
THRESHOLD = 0.6


def blend(weights: Mapping[str, float]) -> Column:
    """Weighted sum of probability columns, evaluated in the given order."""
    expr = None
    for c, w in weights.items():
        term = F.lit(float(w)) * F.col(c)
        expr = term if expr is None else expr + term
    return expr


def threshold_label(score: Column, threshold: float = THRESHOLD) -> Column:
    """1 above, 0 below; a score exactly at the threshold keeps the score."""
    return (F.when(score > threshold, F.lit(1.0)).when(score < threshold, F.lit(0.0)).otherwise(score))


def blend_submission(scores: DataFrame, key: str, weights: Mapping[str, float] = WEIGHTS,
                     threshold: float = THRESHOLD) -> DataFrame:
    """ML5: one (key, score, label) row per subscriber; models aligned by key, not position."""
    s = blend(weights)
    return scores.select(key, s.alias("score"), threshold_label(s, threshold).alias("label"))
