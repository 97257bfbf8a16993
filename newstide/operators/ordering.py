"""Order and position of rows within a group, for groups of any size."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from newstide.sources.layout import written

# monotonically_increasing_id() is documented as partition number << 33 | row number.
ROW_BITS = 33


def publication_order(articles: DataFrame) -> DataFrame:
    """Articles sorted by publication time per symbol; the link breaks ties.

    A range-partitioned sort: the link in the key splits a hot symbol, day or instant.
    """
    return articles.orderBy("symbol", "published", "link")


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                  name: str = "position") -> DataFrame:
    """Number the rows of every group from 1 in ``order``, without one task per group.

    ``row_number()`` would sort a whole group in one task. Here the rows are range-sorted by
    keys and order together, so a hot group lies in many sort partitions; each (group, partition)
    run is counted, and the running count of the earlier runs of the group is added. Partition
    numbers have to be the same for both uses, hence the written table. Rows with a NULL key have
    no group and drop out.
    """
    keys = list(keys)
    sorted_ = written(
        df.na.drop("any", subset=keys).orderBy(*keys, *order)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_slice", F.shiftright("_id", ROW_BITS)), "positions")
    earlier = (Window.partitionBy(*keys).orderBy("_slice")
               .rowsBetween(Window.unboundedPreceding, -1))
    runs = (sorted_.groupBy("_slice", *keys)
            .agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
            .select("_slice", *keys, "_first",
                    F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")))
    return (sorted_.join(runs, ["_slice", *keys])
            .withColumn(name, F.col("_before") + F.col("_id") - F.col("_first") + 1)
            .select(*df.columns, name))
