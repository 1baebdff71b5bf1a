"""Vector expressions for small tables; bulk work goes through numpy batches."""

from pyspark.sql import functions as F


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a, b):
    """1 - cosine similarity, within [0, 2]; a zero vector is at distance 1."""
    scale = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    similarity = F.when(scale == 0.0, F.lit(0.0)).otherwise(dot(a, b) / scale)
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1.0 - similarity))
