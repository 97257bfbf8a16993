"""News-search responses: scan, flatten, clean, and the plan of what to fetch."""

from collections.abc import Mapping
from functools import reduce
from types import MappingProxyType

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from newstide import schemas
from newstide.functions import literal
from newstide.functions.signals import format_day, to_published
from newstide.sources.prices import date_ranges


# Why a response is not used.
NOT_JSON, WRONG_TYPE, NO_ARTICLES = "not JSON", "wrong type", "no article list"
NO_SYMBOL, BAD_BUCKET = "no symbol", "bucket ends before it starts"
_RECORD = "_record"


def _reason(record: str, articles: str, more: Mapping[str, str] = MappingProxyType({})) -> str:
    """Why a response is rejected, NULL for a good one, from what a permissive reader leaves:
    ``record`` is the text of what it could not take. ``more`` has conditions and their reasons."""
    others = "".join(f" WHEN {fault} THEN {literal(reason)}" for fault, reason in more.items())
    return (f"CASE WHEN {record} IS NOT NULL THEN CASE WHEN try_parse_json({record}) IS NULL "
            f"THEN {literal(NOT_JSON)} ELSE {literal(WRONG_TYPE)} END "
            f"WHEN {articles} IS NULL THEN {literal(NO_ARTICLES)}{others} END")


def scan_responses(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Every response with ``file``, ``record`` and ``reason``.

    ``reason`` is NULL for a response that can be used; else it says why not, and ``record`` has
    the text as it was found where it is no JSON or a value has the wrong type. A response is used
    as a whole or not at all. With ``multi_line`` each file is one response. ``symbol``,
    ``bucket_start`` and ``bucket_end`` come from the document or from the path
    (``symbol=QCOM/bucket_start=2015-01-01/...``).
    """
    schema = T.StructType([*schemas.SEARCH_RESULTS, T.StructField(_RECORD, T.StringType())])
    stored = (spark.read.schema(schema)
              .json(path, multiLine=multi_line, mode="PERMISSIVE", columnNameOfCorruptRecord=_RECORD))
    # The reader judges the columns it is asked for. The reason needs them all, so every query that
    # asks for the reason judges a response in the same way.
    faults = {"symbol IS NULL": NO_SYMBOL, "bucket_end < bucket_start": BAD_BUCKET}
    return stored.selectExpr(*schemas.SEARCH_RESULTS.names, "_metadata.file_path AS file",
                             f"{_RECORD} AS record",
                             _reason(_RECORD, "articles", faults) + " AS reason")


def accepted(responses: DataFrame, without_list: bool = False) -> DataFrame:
    """The responses of a scan that can be used; ``without_list`` keeps those that only lack a list
    of articles, as responses without any."""
    usable = "reason IS NULL" + (f" OR reason = {literal(NO_ARTICLES)}" if without_list else "")
    return responses.where(usable).select(*schemas.SEARCH_RESULTS.names)


def rejected(responses: DataFrame) -> DataFrame:
    """The others: file, reason, and what is known of them."""
    return responses.where("reason IS NOT NULL").select(
        "file", "reason", "symbol", "bucket_start", "bucket_end", "record")


def rejects_per_file(responses: DataFrame) -> DataFrame:
    """(file, reason, n_responses) with reason NULL for what is used: the counts add up to all."""
    return responses.groupBy("file", "reason").agg(F.count("*").alias("n_responses"))


def read_search_results(spark: SparkSession, path: str, multi_line: bool = False,
                        rejects: str = "drop") -> DataFrame:
    """The responses under ``path`` that can be read, see ``scan_responses``.

    A response that is JSON but has no list of articles counts as one with none. ``rejects='drop'``
    leaves out the others, which ``rejected`` shows; ``'error'`` raises at the first of them, lists
    included, when the result is evaluated.
    """
    if rejects not in ("drop", "error"):
        raise ValueError(f"rejects must be 'drop' or 'error', not {rejects!r}")
    found = scan_responses(spark, path, multi_line)
    if rejects == "error":
        found = found.where(F.when(F.col("reason").isNull(), F.lit(True)).otherwise(
            F.raise_error(F.concat_ws(": ", F.lit("response rejected"), "reason", "file"))))
    return accepted(found, without_list=True)


def parse_response(body: str) -> str:
    """Array of articles in the text of one response; NULL if it is no JSON object."""
    schema = f"articles ARRAY<{schemas.SEARCH_ARTICLE.simpleString()}>"
    return f"from_json({body}, {literal(schema)}).articles"


def decode_responses(df: DataFrame, body: str = "body") -> DataFrame:
    """Replace the text of responses by ``articles`` and ``reason``, as ``scan_responses`` does.

    A rejected response has no articles; NULL text counts as no JSON."""
    schema = f"articles ARRAY<{schemas.SEARCH_ARTICLE.simpleString()}>, {_RECORD} STRING"
    # the option also keeps the optimizer from cutting the schema that a response is judged by
    decoded = (f"from_json(coalesce({body}, ''), {literal(schema)}, "
               f"map('columnNameOfCorruptRecord', '{_RECORD}'))")
    text = f"CASE WHEN _decoded IS NULL THEN '' ELSE _decoded.{_RECORD} END"
    return (df.withColumn("_decoded", F.expr(decoded))
            .withColumn("reason", F.expr(_reason(f"({text})", "_decoded.articles")))
            .withColumn("articles", F.expr("CASE WHEN reason IS NULL THEN _decoded.articles END"))
            .drop(body, "_decoded"))


def flatten_articles(search_results: DataFrame) -> DataFrame:
    """One row per article of every response."""
    return search_results.select("symbol", "bucket_start", "bucket_end", F.inline("articles"))


def valid_publications(articles: DataFrame) -> DataFrame:
    """Parse ``published`` and keep the articles where it really is a time."""
    return (articles.withColumn("published", F.expr(to_published("published")))
            .where(F.col("published").isNotNull())
            .withColumn("date", F.to_date("published")))


def project_articles(articles: DataFrame) -> DataFrame:
    """The article columns in their canonical order and type; an absent column is NULL."""
    known = set(articles.columns)
    return articles.select(*[
        (F.col(f.name) if f.name in known else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schemas.ARTICLES])


def concat_articles(first: DataFrame, *others: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), others, first)


def bucket_counts(search_results: DataFrame) -> DataFrame:
    """Articles and responses per (symbol, bucket)."""
    return search_results.groupBy("symbol", "bucket_start").agg(
        F.expr("sum(coalesce(array_size(articles), 0)) AS n_articles"),
        F.count("*").alias("n_responses"))


def history_sizes(search_results: DataFrame) -> DataFrame:
    """Responses per symbol."""
    return search_results.groupBy("symbol").agg(F.count("*").alias("n_groups"))


def with_history_size(instruments: DataFrame, search_results: DataFrame) -> DataFrame:
    """Every instrument that has responses, with their number (``n_groups``)."""
    return instruments.join(history_sizes(search_results), "symbol")


def fetch_buckets(ranges: DataFrame, interval_days: int = 28) -> DataFrame:
    """Tile [start_date, end_date) with buckets; the last may reach beyond the end."""
    step = f"make_dt_interval({interval_days})"
    return (ranges.selectExpr("symbol", "end_date",
                              f"explode(sequence(start_date, end_date, {step})) AS bucket_start")
            .where("bucket_start < end_date")
            .selectExpr("symbol", "bucket_start",
                        f"date_add(bucket_start, {interval_days}) AS bucket_end"))


def search_terms(instruments: DataFrame) -> DataFrame:
    return instruments.select("symbol", F.col("shortname").alias("q"))


def fetch_requests(instruments: DataFrame, prices: DataFrame, interval_days: int = 28,
                   country: str = "US", lang: str = "en") -> DataFrame:
    """One request per instrument and bucket; instruments without prices ask for nothing."""
    return _requests(instruments, fetch_buckets(date_ranges(prices), interval_days), country, lang)


def _requests(instruments: DataFrame, buckets: DataFrame, country: str, lang: str) -> DataFrame:
    return (search_terms(instruments).join(buckets, "symbol")
            .selectExpr("symbol", "q", f"{format_day('bucket_start')} AS `from`",
                        f"{format_day('bucket_end')} AS `to`",
                        f"{literal(country)} AS country", f"{literal(lang)} AS lang"))


def covered_days(search_results: DataFrame) -> DataFrame:
    """Stretches (symbol, start_date, end_date) that the buckets of stored responses cover, the end
    not included; buckets that overlap or touch are one stretch."""
    buckets = (search_results.where("bucket_start < bucket_end")
               .groupBy("symbol", "bucket_start").agg(F.max("bucket_end").alias("bucket_end")))
    before = (Window.partitionBy("symbol").orderBy("bucket_start")
              .rowsBetween(Window.unboundedPreceding, -1))
    so_far = Window.partitionBy("symbol").orderBy("bucket_start")
    reached = F.max("bucket_end").over(before)
    fresh = F.when(reached >= F.col("bucket_start"), 0).otherwise(1)
    return (buckets.withColumn("_fresh", fresh).withColumn("_stretch", F.sum("_fresh").over(so_far))
            .groupBy("symbol", "_stretch")
            .agg(F.min("bucket_start").alias("start_date"), F.max("bucket_end").alias("end_date"))
            .drop("_stretch"))


def uncovered_ranges(ranges: DataFrame, search_results: DataFrame) -> DataFrame:
    """Parts of the wanted ranges [start_date, end_date) per symbol that no stored response covers.

    The stretches of a symbol are disjoint and in order, so a gap lies between each and the next."""
    covered = covered_days(search_results).select(
        "symbol", F.col("start_date").alias("_from"), F.col("end_date").alias("_to"))
    in_order = Window.partitionBy("symbol").orderBy("_from")
    wanted = ranges.select("symbol", "start_date", "end_date").join(
        covered, (ranges["symbol"] == covered["symbol"]) & (F.col("_from") < F.col("end_date"))
        & (F.col("_to") > F.col("start_date")), "left").drop(covered["symbol"])
    gaps = wanted.select(
        "symbol", "end_date",
        # before the first stretch, and after each one up to the next or the end
        F.when(F.lag("_from").over(in_order).isNull(), F.struct(
            F.col("start_date").alias("start"),
            F.coalesce("_from", "end_date").alias("stop"))).alias("_first"),
        F.when(F.col("_to").isNotNull(), F.struct(
            F.col("_to").alias("start"),
            F.coalesce(F.lead("_from").over(in_order), "end_date").alias("stop"))).alias("_next"))
    return (gaps.select("symbol", "end_date", F.explode(F.array("_first", "_next")).alias("_gap"))
            .select("symbol", F.col("_gap.start").alias("start_date"),
                    F.least("_gap.stop", "end_date").alias("end_date"))
            .where("start_date < end_date"))


def missing_requests(instruments: DataFrame, prices: DataFrame, search_results: DataFrame,
                     interval_days: int = 28, country: str = "US", lang: str = "en") -> DataFrame:
    """``fetch_requests`` for the days that no stored response covers, and no others."""
    gaps = uncovered_ranges(date_ranges(prices), search_results)
    step = f"make_dt_interval({interval_days})"
    buckets = (gaps.selectExpr("symbol", "end_date",
                               f"explode(sequence(start_date, end_date, {step})) AS bucket_start")
               .where("bucket_start < end_date")
               .selectExpr("symbol", "bucket_start",
                           f"least(date_add(bucket_start, {interval_days}), end_date) AS bucket_end"))
    return _requests(instruments, buckets, country, lang)
