"""Vector algebra on array columns. Arrays are taken as doubles; every small number that guards a division is a parameter,
because the variants differ in results near zero."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import let


def doubles(v: Column | str) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def scale(v: Column | str, k: Column | float) -> Column:
    return F.transform(v, lambda x: x.cast("double") * k)


def zeros_like(v: Column | str) -> Column:
    return F.transform(v, lambda x: F.lit(0.0))


def _over(v, size: Column) -> Column:
    """The size is worked out once, not for each entry."""
    return let(size, lambda s: F.transform(v, lambda x: x.cast("double") / s))


def _once(v: Column | str, then) -> Column:
    return let(F.col(v) if isinstance(v, str) else v, then)


def l2_floor(v: Column | str, eps: float = 1e-8) -> Column:
    """v over its length, or over eps if that is larger."""
    return _once(v, lambda w: _over(w, F.greatest(norm(w), F.lit(eps))))


def l2_added(v: Column | str, eps: float = 1e-8) -> Column:
    """v over its length plus eps."""
    return _once(v, lambda w: _over(w, norm(w) + eps))


def l2_or_zero(v: Column | str, eps: float = 1e-8) -> Column:
    """v over its length; zeros if that is below eps."""
    return _once(v, lambda w: let(norm(w), lambda n: F.when(n < eps, zeros_like(w)).otherwise(_over(w, n))))


def l2_guarded(v: Column | str) -> Column:
    """v over its length; as it is where the length is zero."""
    return _once(v, lambda w: let(norm(w), lambda n: F.when(n == 0, doubles(w)).otherwise(_over(w, n))))


def cosine_or_zero(a: Column | str, b: Column | str, eps: float = 1e-8) -> Column:
    """Cosine; 0 if either length is below eps."""
    return F.when((norm(a) < eps) | (norm(b) < eps), 0.0).otherwise(dot(a, b) / (norm(a) * norm(b)))


def cosine_added(a: Column | str, b: Column | str, eps: float = 1e-8) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + eps)


def minus(a: Column | str, b: Column | str, alpha: float = 1.0) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - F.lit(alpha) * y.cast("double"))


def center(v: Column | str, mean: Column | str, alpha: float = 1.0, renormalize: bool = True, eps: float = 1e-8) -> Column:
    """v - alpha * mean, of length 1 again; without a mean v as it is."""
    moved = minus(v, mean, alpha)
    return F.when(F.col(mean).isNull() if isinstance(mean, str) else mean.isNull(), doubles(v)).otherwise(l2_floor(moved, eps) if renormalize else moved)


def weighted_sum(vectors: list, weights: list) -> Column:
    """The sum of vectors, each times its weight."""
    parts = [scale(v, w) for v, w in zip(vectors, weights)]
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), parts)


def windows(tokens: Column | str, length: int, step: int, most: int | None = None, least: int = 1) -> Column:
    """Windows of up to `length` tokens every `step`, at most `most` of them, those of under `least` tokens left out."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    starts = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    out = F.filter(F.transform(starts, lambda i: F.slice(tokens, i + 1, length)), lambda w: F.size(w) >= least)
    return out if most is None else F.slice(out, 1, most)


def bound_rows(v: Column | str, length: float = 1e-6) -> Column:
    """Whether a difference vector is short enough to be a duplicate's."""
    return norm(v) < length


def _sum(vectors: Column) -> Column:
    return let(vectors, lambda v: F.aggregate(F.slice(v, 2, F.greatest(F.size(v), F.lit(1))), v[0], lambda a, b: F.zip_with(a, b, lambda x, y: x + y)))


def token_mean(states: Column | str, mask: Column | str) -> Column:
    """The mean of the token states (array of vectors) whose mask is 1; zeros if none is."""
    on = F.transform(mask, lambda m: m.cast("double"))
    total = F.greatest(F.aggregate(on, F.lit(0.0), lambda a, m: a + m), F.lit(1.0))
    return _over(_sum(F.zip_with(states, on, lambda v, m: scale(v, m))), total)


def last_layers(layers: Column | str, k: int = 4) -> Column:
    """Token states as the mean of the last k layers (array of layers of token states)."""
    own = F.slice(layers, F.greatest(F.size(layers) - k + 1, F.lit(1)), k)
    summed = F.aggregate(F.slice(own, 2, F.greatest(F.size(own), F.lit(1))), F.transform(own[0], doubles), lambda a, b: F.zip_with(a, b, lambda p, q: F.zip_with(p, q, lambda x, y: x + y)))
    return F.transform(summed, lambda v: _over(v, F.size(own)))


def norm_softmax_pool(states: Column | str) -> Column:
    """The sum of token states, each weighted by the softmax of the lengths."""
    def pooled(raised: Column) -> Column:
        total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
        return let(total, lambda t: _sum(F.zip_with(states, raised, lambda v, w: scale(v, w / t))))

    # each step is worked out once, not for each state
    raised = lambda sizes: let(F.array_max(sizes), lambda most: F.transform(sizes, lambda x: F.exp(x - most)))
    return let(F.transform(states, norm), lambda sizes: let(raised(sizes), pooled))
