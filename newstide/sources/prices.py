"""Daily prices and the symbol dimension."""

from collections.abc import Iterable, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from newstide import schemas
from newstide.functions.signals import nan_to_null


def symbol_dimension(spark: SparkSession, industries: Mapping[str, Iterable[str]]) -> DataFrame:
    """One row per (industry, symbol) of a configuration mapping.

    An Arrow table becomes a local relation, whose size Spark knows: joins with it are broadcast by
    Spark's own choice, and shuffle neither side.
    """
    rows = [(industry, symbol) for industry, symbols in industries.items() for symbol in symbols]
    columns = zip(*rows) if rows else ((), ())
    table = pa.table([pa.array(column, pa.string()) for column in columns], schemas.SYMBOLS.names)
    return spark.createDataFrame(table, schemas.SYMBOLS)


def flatten_symbol_map(df: DataFrame, column: str = "industries") -> DataFrame:
    """The same for a column ``map<industry, array<symbol>>``."""
    return (df.select(F.explode(column).alias("industry", "_symbols"))
            .select("industry", F.explode("_symbols").alias("symbol")))


def keep_symbols(df: DataFrame, symbols: DataFrame) -> DataFrame:
    return df.join(symbols.select("symbol"), "symbol", "left_semi")


def date_slice(df: DataFrame, start=None, end=None) -> DataFrame:
    """Rows with start <= date <= end; an open end does not limit."""
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    return df


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Drop rows with a NULL or NaN in any column."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.expr(nan_to_null(f"`{c}`")) for c in floats}).na.drop("any")


def read_prices(spark: SparkSession, path: str, fmt: str = "parquet", start=None, end=None,
                symbols: DataFrame | None = None, wide: bool = False, **options) -> DataFrame:
    """Price scan, cut to [start, end] and to ``symbols``, without incomplete rows.

    ``wide`` reads tables with a column per ticker and field (``unpivot_prices``); their columns
    are what the file has, so their names are read from it.

    A table has one row per (symbol, date); ``operators.timeline.duplicate_keys`` checks it.
    """
    if fmt == "csv":
        options = {"header": True, **options}
    reader = spark.read.format(fmt).options(**options)
    stored = (unpivot_prices(reader.load(path)) if wide
              else reader.schema(schemas.PRICES).load(path))
    prices = date_slice(stored, start, end)
    if symbols is not None:
        prices = keep_symbols(prices, symbols)
    return drop_incomplete(prices)


def unpivot_prices(wide: DataFrame, date: str = "Date", separator: str = "|") -> DataFrame:
    """Long prices from a table with one column per ticker and field, like ``QCOM|Open``."""
    fields: dict[str, dict[str, str]] = {}
    for name in wide.columns:
        if name != date and separator in name:
            symbol, field = name.rsplit(separator, 1)
            fields.setdefault(symbol, {})[field.lower()] = name

    def value(names: dict[str, str], field: T.StructField):
        found = F.col(f"`{names[field.name]}`") if field.name in names else F.lit(None)
        return found.cast(field.dataType).alias(field.name)

    measures = [f for f in schemas.PRICES if f.name not in ("symbol", "date")]
    rows = [F.struct(F.lit(symbol).alias("symbol"), *[value(names, f) for f in measures])
            for symbol, names in fields.items()]
    return (wide.select(F.to_date(F.col(date)).alias("date"), F.inline(F.array(*rows)))
            .select(*schemas.PRICES.names))


def date_ranges(prices: DataFrame) -> DataFrame:
    """First and last price day per symbol; a symbol without prices has no row."""
    return prices.groupBy("symbol").agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"))
