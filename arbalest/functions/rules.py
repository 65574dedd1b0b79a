"""Verdicts as CASE chains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def leak_verdict(leak: Column, at_true: Column, at_wrong: Column) -> Column:
    return (
        F.when(leak >= 0.8, "leak").when((at_true >= 0.95) & (at_wrong >= 0.95), "constant").when(at_true < 0.5, "not pair-stable").otherwise("weak")
    )


def result_status(true_id: Column, rank: Column) -> Column:
    """Of a shown candidate list: rank of the true target (null: not shown)."""
    return F.when(true_id.isNull(), "unknown").when(rank == 1, "correct").when(rank.isNotNull(), "found").otherwise("wrong")


def is_degenerate(best: Column, worst: Column, least: float = 0.02) -> Column:
    return (best - worst) < least


def delta_reading(delta: Column) -> Column:
    return F.when(delta > 0.10, "large gain").when(delta > 0.05, "gain").when(delta < -0.05, "regression").otherwise("no change")
