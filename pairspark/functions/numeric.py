"""Scalar number expressions: labels, display values, geometry, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv


def missing(value: Column) -> Column:
    """True for NULL and NaN alike."""
    return value.isNull() | F.isnan(value.cast("double"))


def nan_to_null(value: Column) -> Column:
    return F.when(~missing(value), value)


def shift_label(raw: Column) -> Column:
    """Multiclass code -1/0/1 to class index 0/1/2; 999 becomes the unknown-effect label."""
    return raw + 1


def is_valid_class(label: Column, n_classes: int) -> Column:
    return label.isin(*range(n_classes))


def is_unknown_effect(label: Column) -> Column:
    return label == fv.UNKNOWN_EFFECT_LABEL


def angle(a: Column, b: Column, c: Column) -> Column:
    """Angle between edges a and b opposite to c; the cosine is clamped to [-1, 1]."""
    cosine = (a * a + b * b - c * c) / (F.lit(2.0) * a * b)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def score_for_display(score: Column) -> Column:
    return F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.round(score, 2)))


def display_size(affinity: Column, scale: float = 1.0) -> Column:
    clipped = F.greatest(F.lit(4.0), F.least(F.lit(10.0), affinity))
    return (F.lit(4.0) + F.pow(F.lit(2.0), clipped - 4.0)) * F.lit(float(scale))


def display_class(probabilities: Column, names: list[str]) -> Column:
    """Name of the most probable class (first maximum)."""
    place = F.array_position(probabilities, F.array_max(probabilities)).cast("int")
    return F.element_at(F.array(*[F.lit(n) for n in names]), place)


def bce_with_logits(x: Column, y: Column) -> Column:
    """Stable binary cross-entropy of a logit."""
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
