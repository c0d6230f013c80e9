"""Rewards and training-curve arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed weights of the reward.
W_F1, W_FABRICATION, W_SENTENCE, W_LENGTH, W_BACKGROUND = 0.40, 0.40, 0.10, 0.10, 0.10


def reward(f1: Column, fabrication: Column, sentence: Column, length: Column, background: Column, invalid: Column) -> Column:
    """Weighted sum, clipped to [-1, 1]; an invalid output is -1."""
    raw = W_F1 * f1 - W_FABRICATION * fabrication + W_SENTENCE * sentence + W_LENGTH * length - W_BACKGROUND * background
    return F.when(invalid, F.lit(-1.0)).otherwise(F.greatest(F.least(raw, F.lit(1.0)), F.lit(-1.0)))


def alpha(step: Column, steps: int = 748, first: float = 0.10, last: float = 0.50) -> Column:
    """Linear schedule over ``steps`` steps."""
    return F.lit(first) + F.least(step / F.lit(float(steps)), F.lit(1.0)) * (last - first)


def mixed_loss(a: Column, ce: Column, scst: Column) -> Column:
    return (1 - a) * ce + a * scst


def scst_advantage(sampled: Column, greedy: Column) -> Column:
    return sampled - greedy
