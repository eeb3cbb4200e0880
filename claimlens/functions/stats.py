"""Information statistics of one masked position, on arrays of doubles.

All logarithms are natural. Probabilities are clipped from below before a logarithm, since ln(0) is
NULL in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The least positive normal double.
TINY = 2.2250738585072014e-308
SUM_TOLERANCE = 1e-8
STATISTICS = (
    "ce", "entropy", "collision_probability", "collision_entropy", "delta", "swap_llr",
    "expected_drift", "expected_dispersion", "top_mismatch",
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with `value` evaluated once, as a lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def softmax(logits: Column) -> Column:
    """Probabilities of logits; NULL unless there are two finite logits at least."""

    def shifted(values: Column) -> Column:
        return let(F.array_max(values), lambda top: F.transform(values, lambda x: F.exp(x - top)))

    normal = let(shifted(logits), lambda w: let(total(w), lambda s: F.transform(w, lambda x: x / s)))
    return F.when((F.size(logits) >= 2) & F.forall(logits, _finite), normal)


def valid_probabilities(p: Column) -> Column:
    """At least two finite, non-negative numbers that sum to one."""
    each = F.forall(p, lambda x: _finite(x) & (x >= 0))
    return F.coalesce((F.size(p) >= 2) & each & (F.abs(total(p) - 1.0) <= SUM_TOLERANCE), F.lit(False))


def first_max(values: Column) -> Column:
    """Index, from 0, of the first greatest value."""
    return F.array_position(values, F.array_max(values)) - 1


def position_statistics(p: Column, target: Column) -> Column:
    """A struct of target_id, top_id, top_alternative_id and STATISTICS; NULL where the probabilities or
    the target are invalid."""

    def of(q: Column, logs: Column) -> Column:
        at = F.element_at(logs, (target + 1).cast("int"))
        alternatives = F.transform(logs, lambda x, i: F.when(i == target, F.lit(float("-inf"))).otherwise(x))
        entropy = -total(F.zip_with(q, logs, lambda x, y: F.when(x > 0, x * y).otherwise(0.0)))
        collision = F.aggregate(q, F.lit(0.0), lambda a, x: a + x * x)
        top = first_max(q)
        return F.struct(
            target.cast("long").alias("target_id"),
            top.alias("top_id"),
            first_max(alternatives).alias("top_alternative_id"),
            (-at).alias("ce"),
            entropy.alias("entropy"),
            collision.alias("collision_probability"),
            (-F.ln(F.greatest(collision, F.lit(TINY)))).alias("collision_entropy"),
            (-at - entropy).alias("delta"),
            (F.array_max(alternatives) - at).alias("swap_llr"),
            (1.0 - F.element_at(q, (target + 1).cast("int"))).alias("expected_drift"),
            (1.0 - collision).alias("expected_dispersion"),
            (top != target).cast("double").alias("top_mismatch"),
        )

    # the alternative is chosen among logarithms: close probabilities can share one
    stats = let(p, lambda q: let(F.transform(q, lambda x: F.ln(F.greatest(x, F.lit(TINY)))), lambda logs: of(q, logs)))
    return F.when(valid_probabilities(p) & (target >= 0) & (target < F.size(p)), stats)


def close(a: Column, b: Column, rel: float = 1e-10, absolute: float = 1e-12) -> Column:
    """Whether two finite numbers agree within a relative or an absolute tolerance."""
    # NaN equals itself and is the greatest number in SQL
    return ~F.isnan(a - b) & (F.abs(a - b) <= F.greatest(F.lit(absolute), rel * F.greatest(F.abs(a), F.abs(b))))
