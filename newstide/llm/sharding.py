"""Shards along a Hilbert curve over several metadata columns.

Every column is cut at its quantiles into cells, the cells of a row are coordinates of a point, and
the point's index on the Hilbert curve orders the rows. Runs of that order are the shards: rows that
are near in all columns share files, and a reader that filters on any of them skips most files by
their minimum and maximum.

The order is a range-partitioned sort with the id in its key, so a hot source or language is spread
over sort partitions. Positions come from counts per partition, never from one task that sees all.
"""

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from newstide.operators.ordering import ROW_BITS
from newstide.sources.layout import written

SHARDS, BITS = 16, 4
# Relative error of the quantiles is one in this many.
QUANTILE_ACCURACY = 2000


def default_dimensions(docs: DataFrame, text_col: str = "text") -> dict[str, Column]:
    """Language, source and length of a document, as far as the table has the columns."""
    known = {c: docs[c] for c in ("lang", "source") if c in docs.columns}
    return {**known, "length": F.octet_length(docs[text_col]).cast("double")}


def text_quantiles(docs: DataFrame, column: str, parts: int) -> list[str]:
    """The ``parts`` - 1 inner quantiles of a text column, whole values in the order of their bytes.

    Values are counted map-side, so a hot one is a row; the distinct values are range-sorted, and
    the counts of earlier sort partitions are added to running counts within each.
    """
    counts = docs.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count("*").alias("n"))
    ordered = written(counts.orderBy("value").withColumn("_id", F.monotonically_increasing_id())
                      .withColumn("_slice", F.shiftright("_id", ROW_BITS)), "values")
    # one row per sort partition
    slices = (ordered.groupBy("_slice").agg(F.sum("n").alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(Window.orderBy("_slice").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_total", F.sum("_n").over(Window.partitionBy())))
    within = F.sum("n").over(Window.partitionBy("_slice").orderBy("_id"))
    reached = ordered.join(slices, "_slice").select(
        "value", "_total", (F.col("_before") + within).alias("_up_to"))
    bounds = reached.agg(*[F.min(F.when(F.col("_up_to") * parts >= F.col("_total") * k, F.col("value")))
                           .alias(f"q{k}") for k in range(1, parts)]).first()
    return [bound for bound in bounds if bound is not None]


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of integer points (rows) with ``bits`` bits per coordinate.

    The coordinates are turned into the transposed index by undoing, from the highest bit down,
    the reflections and exchanges of the curve, and its bits are interleaved at the end.
    """
    x = points.astype(np.int64).copy()
    n = x.shape[1]
    for high in (1 << b for b in range(bits - 1, 0, -1)):
        low = high - 1
        for i in range(n):
            inverted = (x[:, i] & high) != 0
            swap = np.where(inverted, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(inverted, low, swap)
            x[:, i] ^= swap
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.int64)
    for high in (1 << b for b in range(bits - 1, 0, -1)):
        flip ^= np.where((x[:, n - 1] & high) != 0, high - 1, 0)
    x ^= flip[:, None]
    index = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | ((x[:, i] >> b) & 1)
    return index


def _curve(bits: int):
    @F.pandas_udf("long")
    def curve(cells: pd.Series) -> pd.Series:
        if not len(cells):
            return pd.Series([], dtype="int64")
        return pd.Series(hilbert_index(np.stack(cells.to_numpy()), bits))

    return curve


def _cell(value: Column, bounds: list) -> Column:
    """How many of the inner quantiles lie below the value; null is in cell 0."""
    below = [F.coalesce((value > F.lit(bound)).cast("int"), F.lit(0)) for bound in bounds]
    return sum(below, F.lit(0))


def _bounds(points: DataFrame, columns: list[str], bits: int) -> dict[str, list]:
    """Inner quantiles of every column."""
    kinds = dict(points.dtypes)
    texts = [c for c in columns if kinds[c] == "string"]
    numbers = [c for c in columns if c not in texts]
    inner = [k / (1 << bits) for k in range(1, 1 << bits)]
    found = points.agg(*[F.percentile_approx(c, inner, QUANTILE_ACCURACY).alias(c) for c in numbers]
                       ).first() if numbers else {}
    return {**{c: found[c] or [] for c in numbers},
            **{c: text_quantiles(points, c, 1 << bits) for c in texts}}


def hilbert_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   shards: int = SHARDS, dimensions: Mapping[str, Column] | None = None,
                   bits: int = BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, curve, shard, slot.

    The numbers of rows of any two shards differ by one at most; slots count from 0 along the
    curve. Equal indices are ordered by id (nulls first), checksum and size; rows equal in all of
    these are interchangeable. A null text has size 1 and checksum 0, a null in a dimension lies in
    its first cell. An empty table gives an empty result. ``dimensions`` are columns of numbers or
    of texts, which are compared as a whole; ``bits`` times their number may be 62 at most.
    """
    dimensions = dimensions or default_dimensions(docs, text_col)
    text = F.coalesce(docs[text_col], F.lit(""))
    names = {k: f"dimension_{i}" for i, k in enumerate(dimensions)}
    # slim columns first: quantiles and the sort read these and not the texts
    points = written(docs.select(
        docs[id_col].alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *[dimensions[k].alias(name) for k, name in names.items()]), "points")
    bounds = _bounds(points, list(names.values()), bits)
    points = points.withColumn("cells", F.array(*[_cell(F.col(c), bounds[c])
                                                  for c in names.values()]))
    ordered = written(
        points.select("doc_id", "size", "text_crc32", _curve(bits)("cells").alias("curve"))
        .orderBy("curve", "doc_id", "text_crc32", "size")
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_slice", F.shiftright("_id", ROW_BITS)), "curve")
    # one row per sort partition, so this window is small at any number of rows
    runs = (ordered.groupBy("_slice").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
            .withColumn("_before", F.coalesce(F.sum("_n").over(
                Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("_total", F.sum("_n").over(Window.partitionBy())))
    placed = (ordered.join(runs, "_slice")
              .withColumn("_rank", F.col("_before") + F.col("_id") - F.col("_first"))
              .withColumn("shard", F.expr(f"CAST(_rank * {shards} div _total AS INT)")))
    return placed.select(
        "doc_id", "size", "text_crc32", "curve", "shard",
        F.expr(f"_rank - (shard * _total + {shards - 1}) div {shards}").alias("slot"))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 **options) -> None:
    """Write the rows of ``docs`` into ``shard=N`` folders, in curve order within each file.

    Ids have to be unique here, since rows find their shard by id; null ids are not written.
    """
    placed = hilbert_shards(docs, id_col, text_col, **options).select(
        F.col("doc_id").alias("_doc_id"), "shard", "slot")
    (docs.drop("shard", "slot").join(placed, docs[id_col] == placed["_doc_id"]).drop("_doc_id")
     .repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").drop("slot")
     .write.mode("overwrite").partitionBy("shard").parquet(path))
