"""Array functions on logits / probabilities (higher-order functions, JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tagwright.functions.text import _c


def softmax(c) -> Column:
    """exp(x - max) / sum, element-wise (F8)."""
    a = _c(c)
    m = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - m))
    s = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / s)


def argmax(c) -> Column:
    """0-based index of the largest value, first one on ties."""
    a = _c(c)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def prob_at(c, idx) -> Column:
    """Probability of class ``idx`` (0-based)."""
    return F.try_element_at(_c(c), (_c(idx) + 1).cast("int"))


def spread_probs(c, n: int = 4, prefix: str = "prob_class_") -> list[Column]:
    """Vector -> ``prob_class_0..n-1`` columns."""
    return [F.try_element_at(_c(c), F.lit(i + 1)).alias(f"{prefix}{i}") for i in range(n)]
