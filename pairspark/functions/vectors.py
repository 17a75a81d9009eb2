"""Array expressions: encoders, activations, vector maths. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _literal_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def one_hot(value: Column, vocabulary: list, unknown: str = "error") -> Column:
    """Indicator array over ``vocabulary``.

    ``unknown`` says what a value outside it does: ``error`` raises, ``last`` counts as
    the last entry, ``zero`` gives all zeros.
    """
    vocab = _literal_array(vocabulary)
    if unknown == "last":
        known = value.isin(*vocabulary)
        value = F.when(known, value).otherwise(F.lit(vocabulary[-1]))
    elif unknown == "error":
        message = F.concat(F.lit("value outside the vocabulary: "), F.coalesce(value.cast("string"), F.lit("null")))
        value = F.when(value.isin(*vocabulary), value).otherwise(
            F.raise_error(message).cast(_type_of(vocabulary))
        )
    elif unknown != "zero":
        raise ValueError(f"unknown rule: {unknown}")
    return F.transform(vocab, lambda v: F.coalesce(v == value, F.lit(False)).cast("int"))


def _type_of(vocabulary: list) -> str:
    return "string" if isinstance(vocabulary[0], str) else "int"


def one_hot_index(index: Column, n: int) -> Column:
    """Row ``index`` of the n x n identity; an index outside 0..n-1 raises."""
    checked = F.when((index >= 0) & (index < n), index).otherwise(
        F.raise_error(F.lit("class index out of range")).cast("int")
    )
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == checked).cast("int"))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it inside a per-element lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(xs: Column) -> Column:
    """Max-shifted softmax of an array."""
    shifted = let(F.array_max(xs).cast("double"), lambda top: F.transform(xs, lambda x: F.exp(x.cast("double") - top)))
    return let(shifted, lambda es: let(
        F.aggregate(es, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(es, lambda e: e / total)))


def log_sum_exp(xs: Column) -> Column:
    return let(F.array_max(xs).cast("double"), lambda top: top + F.log(
        F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.exp(x.cast("double") - top))))


def argmax(xs: Column) -> Column:
    """Zero-based place of the first maximum."""
    return (F.array_position(xs, F.array_max(xs)) - 1).cast("int")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def row_norm(xs: Column, eps: float = 1e-5) -> Column:
    """(x - mean) / sqrt(var + eps) along one vector, population variance."""
    n = F.size(xs)
    mean = F.aggregate(xs, F.lit(0.0), lambda s, x: s + x.cast("double")) / n

    def scale(m: Column) -> Column:
        var = F.aggregate(xs, F.lit(0.0), lambda s, x: s + (x.cast("double") - m) * (x.cast("double") - m)) / n
        return let(F.sqrt(var + F.lit(eps)), lambda d: F.transform(xs, lambda x: (x.cast("double") - m) / d))

    return let(mean, scale)


def rbf(distance: Column, low: float = 0.0, high: float = 20.0, n: int = 16) -> Column:
    """Gaussian basis values of a distance over ``n`` evenly spaced centres."""
    sigma = (high - low) / n
    step = (high - low) / (n - 1)
    clipped = F.least(distance.cast("double"), F.lit(float(high)))
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.exp(-F.pow((clipped - (F.lit(float(low)) + i * F.lit(step))) / F.lit(sigma), F.lit(2.0))),
    )
