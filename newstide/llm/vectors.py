"""Embeddings as integer vectors."""

from pyspark.sql import Column, DataFrame, functions as F

# Components beyond this would not leave room for exact sums of squares in 64 bits.
LIMIT = 1 << 27


def finite(vector: Column) -> Column:
    """True for a vector without null, NaN or infinite components."""
    return vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def scaled(vector: Column, scale: int) -> Column:
    """Integers floor(scale * x), x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def extent(vectors: DataFrame, column: str) -> tuple[int, int]:
    """Least and greatest component of a table of integer vectors; (0, 0) without any."""
    low, high = vectors.agg(F.min(F.array_min(column)), F.max(F.array_max(column))).first()
    if low is None:
        return 0, 0
    if max(-low, high) > LIMIT:
        raise ValueError(f"components of {low} to {high}; exact distances need them within "
                         f"{LIMIT} of 0 after scaling")
    return low, high
