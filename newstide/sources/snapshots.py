"""Snapshots: named Parquet tables under one root, laid out by symbol.

``write_snapshot`` and ``read_snapshot`` keep single tables. All tables of an engine are saved
together as one version (``sources.versions``), which ``load_all`` reads.
"""

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from newstide import schemas
from newstide.operators.corpus import source_weights
from newstide.sources.versions import PART, part_of, read_version, version_of


# The table of ``operators.corpus.corpus_state``, which versions of earlier saves do not have.
CORPUS = "corpus"


def _layout_of(spark: SparkSession, path: str) -> str | None:
    """Layout of a stored table, from its directories; None when there is none or it has no parts."""
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    first = stored.select(PART).first() if PART in stored.columns else None
    return None if first is None else first[0].split("_", 1)[0]


def write_snapshot(df: DataFrame, root: str, name: str, layout: str = "symbol") -> None:
    """Write table ``name``.

    ``layout="symbol"`` makes one directory per symbol and replaces the symbols in ``df`` only. As
    it leaves other symbols in place, it refuses a table that is stored in buckets.
    ``layout="bucket"`` hashes the symbols into a fixed number of directories, for more symbols
    than a file listing should hold, and replaces the table, whatever its layout was. A table
    without symbols is plain. Rebalancing lets AQE split the files of a hot symbol and merge those
    of small ones; each file is sorted by symbol and date, so that a reader of one symbol skips
    most of a bucket.
    """
    path = f"{root.rstrip('/')}/{name}"
    if "symbol" not in df.columns:
        df.write.mode("overwrite").parquet(path)
        return
    if layout == "symbol" and _layout_of(df.sparkSession, path) == "bucket":
        raise ValueError(f"{path} is stored in buckets; write it with layout='bucket'")
    overwrite = "dynamic" if layout == "symbol" else "static"
    order = [PART, "symbol", *(c for c in ("date", "bucket_start") if c in df.columns)]
    (df.withColumn(PART, part_of(layout)).hint("rebalance", PART)
     .sortWithinPartitions(*order)
     .write.mode("overwrite").option("partitionOverwriteMode", overwrite)
     .partitionBy(PART).parquet(path))


def read_snapshot(spark: SparkSession, root: str, name: str, symbol: str | None = None,
                  schema: StructType | None = None) -> DataFrame | None:
    """Table ``name``, or one symbol of it from its directory; None when there is no such table.

    The columns are those of ``schema``, by default of the known table of that name; an absent
    column is NULL. Nothing is inferred but for tables of other names.
    """
    schema = schema or schemas.TABLES.get(name)
    reader = spark.read if schema is None else spark.read.schema(
        StructType([*schema, StructField(PART, StringType())]))
    try:
        df = reader.parquet(f"{root.rstrip('/')}/{name}")
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    if symbol is not None:
        if PART in df.columns:
            df = df.where(F.col(PART).isin(*[part_of(layout, F.lit(symbol))
                                             for layout in ("symbol", "bucket")]))
        df = df.where(F.col("symbol") == symbol)
    return df.drop(PART)


@dataclass
class Snapshot:
    """Everything a session starts from; an absent table is None."""

    instruments: DataFrame | None
    search_results: DataFrame | None
    prices: DataFrame | None
    articles: DataFrame | None
    timeline: DataFrame | None
    links: DataFrame | None
    days: DataFrame | None
    source_weights: DataFrame | None
    # counts and sketches per symbol
    corpus: DataFrame | None = None
    # whether no symbol has a link twice, as proved when the articles were saved
    unique: bool = False


def load_all(spark: SparkSession, root: str, number: int | None = None) -> Snapshot:
    """Tables of the newest version under ``root``, or that of a number; without any version those
    that ``write_snapshot`` left there. All tables are of one version, whatever is saved meanwhile."""
    version = version_of(spark, root, number)
    if version is None:
        tables = {name: read_snapshot(spark, root, name) for name in schemas.TABLES}
    else:
        tables = {name: read_version(spark, root, version, name) for name in schemas.TABLES}
        if tables["days"] is not None:
            tables["timeline"] = tables["days"].select(*schemas.TIMELINE.names)
    articles = tables["articles"]
    unique = version is not None and version.tables.get("articles", {}).get("unique", False)
    return Snapshot(**tables, unique=unique,
                    corpus=None if version is None else read_version(spark, root, version, CORPUS),
                    source_weights=None if articles is None else source_weights(articles))


def write_csv(articles: DataFrame, path: str) -> None:
    """CSV has no nested values: they are written as JSON."""
    nested = [f.name for f in articles.schema
              if f.dataType.typeName() in ("struct", "array", "map")]
    (articles.withColumns({c: F.to_json(c) for c in nested})
     .write.mode("overwrite").csv(path, header=True, escape='"'))
