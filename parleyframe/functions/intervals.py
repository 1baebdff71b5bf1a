"""Expressions over (start, end) pairs in seconds."""

import numpy as np
from pyspark.sql import functions as F


def duration(start, end):
    """Length, never negative."""
    return F.greatest(F.lit(0.0), end - start)


def overlap(start_a, end_a, start_b, end_b):
    return F.least(end_a, end_b) - F.greatest(start_a, start_b)


def proper(start, end):
    """An interval that can overlap something: positive length, real bounds."""
    return (start < end) & ~F.isnan(start) & ~F.isnan(end)


def padded(start, end, shortest, whole):
    """Intervals (arrays) grown to ``shortest`` seconds inside ``[0, whole]``.

    An interval that is long enough is left alone.  A short one is centred; if a
    bound of the recording cuts it, the other side takes the rest.  When both
    sides are cut, the start decides.
    """
    middle = 0.5 * (start + end)
    low = np.maximum(0.0, middle - shortest / 2.0)
    high = np.minimum(whole, middle + shortest / 2.0)
    missing = (shortest - (high - low)) / 2.0
    cases = [end - start >= shortest, high - low >= shortest, low == 0.0, high == whole]
    return (
        np.select(cases, [start, low, low, np.maximum(0.0, whole - shortest)],
                  np.maximum(0.0, low - missing)),
        np.select(cases, [end, high, np.minimum(whole, shortest), high],
                  np.minimum(whole, high + missing)))


def pad_to(start, end, shortest, whole):
    """``padded`` for columns: a struct (start, end)."""
    start, end, whole = (x.cast("double") for x in (start, end, whole))
    shortest, zero = F.lit(float(shortest)), F.lit(0.0)
    middle = F.lit(0.5) * (start + end)
    low, high = F.greatest(zero, middle - shortest / 2), F.least(whole, middle + shortest / 2)
    missing = (shortest - (high - low)) / 2
    kept, fits = end - start >= shortest, high - low >= shortest
    return F.struct(
        F.when(kept, start).when(fits | (low == zero), low)
        .when(high == whole, F.greatest(zero, whole - shortest))
        .otherwise(F.greatest(zero, low - missing)).alias("start"),
        F.when(kept, end).when(fits, high).when(low == zero, F.least(whole, shortest))
        .when(high == whole, high).otherwise(F.least(whole, high + missing)).alias("end"))
