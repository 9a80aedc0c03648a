"""Array functions for step windows and probability vectors, as Column builders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def most_common(arr: Column) -> Column:
    """struct(n, value) of the most frequent element, the first seen of several; null for an empty array."""
    def counted(arr: Column) -> Column:
        return F.array_max(F.transform(F.array_distinct(arr), lambda x: F.struct(F.size(F.filter(arr, lambda y: y == x)).alias("n"), (-F.array_position(arr, x)).alias("at"), x.alias("value"))))

    return F.element_at(F.transform(F.array(arr), counted), 1)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets given as arrays; 1 if both are empty."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def argmax(p: Column) -> Column:
    """Index from 0 of the largest element, the lowest of several."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)


def expected_level(p: Column) -> Column:
    return total(F.transform(p, lambda x, i: x * i))


def temper(p: Column, t: Column | float) -> Column:
    """softmax(log(p) / t), p floored at 1e-9; unchanged for t = 1."""
    t = F.lit(float(t)) if isinstance(t, (int, float)) else t
    z = F.transform(p, lambda x: F.log(F.greatest(x, F.lit(1e-9))) / t)
    e = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    return F.when(t == 1.0, p).otherwise(F.transform(e, lambda x: x / total(e)))


def temper_binary(p: Column, t: Column | float) -> Column:
    """sigmoid(logit(p) / t), p kept off 0 and 1 by 1e-6."""
    t = F.lit(float(t)) if isinstance(t, (int, float)) else t
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return 1 / (1 + F.exp(-F.log(q / (1 - q)) / t))


def logits(p: Column, recorded: Column | None = None) -> Column:
    """Recorded logits, else logs of the probabilities."""
    own = F.transform(p, lambda x: F.log(F.greatest(x, F.lit(1e-9))))
    return own if recorded is None else F.coalesce(recorded, own)


def confidence(p: Column) -> Column:
    """Top probability scaled so that an even spread over K options is 0."""
    k = F.size(p)
    return (F.array_max(p) - 1 / k) / (1 - 1 / k)


def yes_index(keys: Column) -> Column:
    """Index from 0 of the first of true, yes and 1 among the keys, else of the last key."""
    low = F.transform(keys, lambda k: F.lower(k))
    hits = F.filter(F.transform(low, lambda k, i: F.when(k.isin("true", "yes", "1"), i)), lambda i: i.isNotNull())
    return F.coalesce(F.try_element_at(hits, F.lit(1)), F.size(keys) - 1)


def p_yes(keys: Column, p: Column) -> Column:
    return F.element_at(p, yes_index(keys) + 1)


def sigma_hash(seed: Column | str, *keys: Column) -> Column:
    """A uniform number in [0, 1) from the SHA-1 of seed and keys: the sampling order of this engine, the same in SQL."""
    seed = F.lit(seed) if isinstance(seed, str) else seed
    h = F.sha1(F.concat_ws(":", seed, *[k.cast("string") for k in keys]))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(1 << 52)


def scanned(arr: Column, both: Callable[[Column, Column], Column]) -> Column:
    """Each element joined by `both`, an associative operation, with all before it: log2(size) passes, each of which joins an element
    with what the pass before has made of the one twice as far away."""
    passes = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(arr), F.lit(1)))).cast("int"))

    def join(made: Column, k: Column) -> Column:
        away = lambda i: F.get(made, i - F.call_function("shiftleft", F.lit(1), k))
        return F.transform(made, lambda x, i: F.coalesce(both(x, away(i)), x))

    return F.aggregate(passes, arr, join)


def cumulative(arr: Column) -> Column:
    """Sums of the first 0, 1, ... all elements of an array of integers, as longs."""
    return F.concat(F.array(F.lit(0).cast("long")), scanned(F.transform(arr, lambda x: x.cast("long")), lambda x, y: x + y))


def least_where(lo: Column, hi: Column, holds: Callable[[Column], Column]) -> Column:
    """The least integer from lo to hi where a condition holds that holds for hi and, once it does, for all above: bisection."""
    halvings = F.sequence(F.lit(0), F.ceil(F.log2((hi - lo + 1).cast("double"))).cast("int"))

    def half(at: Column, _: Column) -> Column:
        middle = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        below = F.coalesce(holds(middle), F.lit(False))
        return F.when(at["lo"] >= at["hi"], at).when(below, F.struct(at["lo"].alias("lo"), middle.alias("hi"))).otherwise(F.struct((middle + 1).alias("lo"), at["hi"].alias("hi")))

    return F.aggregate(halvings, F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi")), half)["lo"]
