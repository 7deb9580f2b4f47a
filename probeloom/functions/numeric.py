"""Column builders of the numeric kernels.

Invariants of a lambda (a row's maximum, its log-sum) are bound once through one-element arrays,
since Spark does not hoist them out of the lambda.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def finite(x: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False))


def all_finite(values: Column) -> Column:
    """Whether an array is there and every entry is finite."""
    return F.coalesce(F.forall(values, finite), F.lit(False))


def log_sum_exp(z: Column) -> Column:
    """``ln(sum(exp(z)))``, shifted by the maximum so that it cannot overflow."""
    return bind(F.array_max(z), lambda top: top + F.ln(F.aggregate(z, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))))


def log_softmax(z: Column, temperature: Column | float = 1.0) -> Column:
    """Log-probabilities of a row of logits."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    scaled = F.transform(z, lambda x: x / t)
    return bind(scaled, lambda s: bind(log_sum_exp(s), lambda total: F.transform(s, lambda x: x - total)))


def selected_log_softmax(z: Column, index: Column) -> Column:
    """Log-probability of one 0-based entry of a row of logits; null when it is out of range."""
    return F.get(z, index) - log_sum_exp(z)


def directed_kl(base: Column, edited: Column, temperature: Column | float = 1.0, tolerance: float = 1e-12) -> Column:
    """``sum(p * (ln p - ln q))`` of two rows of finite logits; rounding noise below zero becomes zero.

    Both log-sums are bound once and the sum is taken in one pass; a probability that underflows
    to zero adds nothing, since the difference of the logarithms stays finite.
    """
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    scaled = lambda z: F.transform(z, lambda x: x / t)

    def total(s: Column) -> Column:
        shift = s["b"] - s["a"]
        terms = F.zip_with(s["p"], s["q"], lambda p, q: F.exp(p - s["a"]) * (p - q + shift))
        return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)

    def summed(s: Column) -> Column:
        return F.struct(s["p"].alias("p"), s["q"].alias("q"), log_sum_exp(s["p"]).alias("a"), log_sum_exp(s["q"]).alias("b"))

    raw = bind(bind(F.struct(scaled(base).alias("p"), scaled(edited).alias("q")), summed), total)
    return bind(raw, lambda kl: F.when((kl < 0) & (kl >= -tolerance), F.lit(0.0)).otherwise(kl))


def euclidean(values: Column) -> Column:
    """Euclidean norm by a running ``hypot``, which does not overflow on large entries."""
    return F.aggregate(values, F.lit(0.0), lambda acc, x: F.hypot(acc, x))


def difference(a: Column, b: Column) -> Column:
    """Entry-wise ``b - a`` of two arrays of one length."""
    return F.zip_with(a, b, lambda x, y: y - x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def unit(v: Column) -> Column:
    """The vector over its norm; a zero vector stays."""
    return bind(v, lambda w: bind(euclidean(w), lambda n: F.when(n == 0.0, w).otherwise(F.transform(w, lambda x: x / n))))


def gram(rows: Column) -> Column:
    """Products of every two rows of a matrix."""
    return F.transform(rows, lambda a: F.transform(rows, lambda b: dot(a, b)))


def transpose(rows: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(F.get(rows, F.lit(0))) - 1), lambda i: F.transform(rows, lambda r: F.get(r, i)))


def _apply(matrix: Column, v: Column) -> Column:
    return F.transform(matrix, lambda r: dot(r, v))


def power_iteration(rows: Column, iterations: int) -> Column:
    """Estimate of the largest singular value of a matrix given as an array of rows.

    The matrix is scaled by its largest entry. The start is the row of the largest norm (the
    first of equal ones), normalised; each of the ``iterations`` steps applies ``M^T M`` and
    normalises. The steps are taken on the products of the rows or of the columns, whichever are
    fewer: with ``G = M M^T`` and ``v`` the start, ``v_k`` is ``M^T u_(k-1)`` for ``u_0 = M v``
    and ``u_k = G u_(k-1)``, up to its length. A zero matrix has norm 0.
    """
    def longest(m: Column) -> Column:
        norms = F.transform(m, euclidean)
        return bind(norms, lambda ns: (F.array_position(ns, F.array_max(ns)) - 1).cast("int"))

    def by_rows(m: Column) -> Column:
        def estimate(g: Column) -> Column:
            start = bind(longest(m), lambda j: unit(F.get(g, j)))
            u = start if iterations == 1 else F.aggregate(F.sequence(F.lit(2), F.lit(iterations)), start, lambda v, _: unit(_apply(g, v)))
            return bind(u, lambda w: bind(_apply(g, w), lambda gw: F.try_divide(euclidean(gw), F.sqrt(dot(w, gw)))))

        return bind(gram(m), estimate)

    def by_columns(m: Column) -> Column:
        def estimate(c: Column) -> Column:
            start = bind(longest(m), lambda j: unit(F.get(m, j)))
            v = F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, lambda w, _: unit(_apply(c, w)))
            return bind(v, lambda w: F.sqrt(F.greatest(F.lit(0.0), dot(w, _apply(c, w)))))

        return bind(bind(transpose(m), gram), estimate)

    def scaled(m: Column) -> Column:
        return F.when(F.size(m) <= F.size(F.get(m, F.lit(0))), by_rows(m)).otherwise(by_columns(m))

    top = F.array_max(F.transform(F.flatten(rows), F.abs))
    return bind(top, lambda t: F.when(t == 0.0, F.lit(0.0)).otherwise(t * F.coalesce(bind(F.transform(rows, lambda r: F.transform(r, lambda x: x / t)), scaled), F.lit(0.0))))
