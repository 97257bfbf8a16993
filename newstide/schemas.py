"""Explicit schemas of the tables the engine reads and writes.

Nothing is inferred at ingest: an absent key becomes NULL, a wrong type becomes NULL.
"""

from pyspark.sql import types as T

SYMBOLS = T.StructType([
    T.StructField("industry", T.StringType()),
    T.StructField("symbol", T.StringType()),
])

INSTRUMENTS = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("shortname", T.StringType()),
    T.StructField("info", T.MapType(T.StringType(), T.StringType())),
])

PRICES = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.LongType()),
])

SOURCE = T.StructType([
    T.StructField("href", T.StringType()),
    T.StructField("title", T.StringType()),
])

SEARCH_ARTICLE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("link", T.StringType()),
    T.StructField("published", T.StringType()),
    T.StructField("source", SOURCE),
    T.StructField("text", T.StringType()),
])

SEARCH_RESULTS = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("bucket_start", T.DateType()),
    T.StructField("bucket_end", T.DateType()),
    T.StructField("articles", T.ArrayType(SEARCH_ARTICLE)),
])

ARTICLES = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("published", T.TimestampNTZType()),
    T.StructField("date", T.DateType()),
    T.StructField("title", T.StringType()),
    T.StructField("link", T.StringType()),
    T.StructField("source", SOURCE),
    T.StructField("id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("title_sentiment", T.IntegerType()),
    T.StructField("text_sentiment", T.IntegerType()),
])

TIMELINE = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("change", T.DoubleType()),
    T.StructField("n_links", T.LongType()),
])

# A price day with what its articles come down to; a report needs nothing else.
DAYS = T.StructType([
    *(f for f in TIMELINE if f.name != "n_links"),
    *(T.StructField(name, T.LongType()) for name in (
        "n_links", "n_resolved", "title_sum", "title_n", "text_sum", "text_n")),
])

LINKS = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("position", T.LongType()),
    T.StructField("link", T.StringType()),
])

# What a snapshot of that name holds.
TABLES = {"instruments": INSTRUMENTS, "search_results": SEARCH_RESULTS, "prices": PRICES,
          "articles": ARTICLES, "timeline": TIMELINE, "links": LINKS, "days": DAYS}
