"""The engine's tables, derived from the driver's tables.

One symbol per user of ``events``: the daily first, highest, lowest and last value are its
prices. ``documents`` are its articles, spread evenly over symbols and days; ``customer`` rows
serve as instruments.
"""

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from newstide.functions.sentiment import TOKEN_END, sentence_classifier, with_sentiment
from newstide.functions.signals import bucket_of
from newstide.sources.layout import spread

# Schemas of the driver's tables in use; given, so that a scan reads no footers to find out.
SCHEMAS = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
              "value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
                "c_mktsegment STRING",
}

FIRST_DAY_SQL = "DATE '2024-01-01'"
N_INDUSTRIES = 4
DAYS = 30
RESPONSE_SIZE = 10
# Words that occur in the driver's texts; a lexicon for checks, not for use.
LEXICON = {"the": 1, "and": 1, "for": 1, "of": -1, "to": -1, "in": -1, "a": -1}
_N_SYMBOLS: dict[tuple[str, str], int] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = ["min_by(value, ts) AS open", "max(value) AS high", "min(value) AS low",
                "max_by(value, ts) AS close", "count(*) AS volume"]
    return (table(spark, sf_dir, "events").where("weekday(ts) < 5")
            .selectExpr("user_id", "to_date(ts) AS date", "ts", "value")
            .groupBy("user_id", "date").agg(*[F.expr(m) for m in measures])
            .selectExpr("CAST(user_id AS STRING) AS symbol", "date", "open", "high", "low",
                        "close", "volume"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "events").select("user_id").distinct()
            .selectExpr(f"CAST(user_id % {N_INDUSTRIES} AS STRING) AS industry",
                        "CAST(user_id AS STRING) AS symbol"))


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "CAST(c_custkey AS STRING) AS symbol", "c_mktsegment AS tag", "c_name AS shortname",
        "map('nation', CAST(c_nationkey AS STRING)) AS info")


def _n_symbols(spark: SparkSession, sf_dir: str) -> int:
    """Number of symbols, counted once per session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _N_SYMBOLS:
        _N_SYMBOLS[key] = table(spark, sf_dir, "events").agg(F.count_distinct("user_id")).first()[0]
    return _N_SYMBOLS[key]


def _with_turns(documents: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles. The number of symbols is a parameter of the mapping and is read up
    front: as a subquery it would be copied into every filter derived from the join keys."""
    n = _n_symbols(spark, sf_dir)
    shift = f"CAST((doc_id div {n} * 7 + doc_id % {n}) % {DAYS} AS INT)"
    return documents.selectExpr(
        f"CAST(doc_id % {n} AS STRING) AS symbol",
        f"CAST(date_add({FIRST_DAY_SQL}, {shift}) AS TIMESTAMP_NTZ) AS published",
        f"date_add({FIRST_DAY_SQL}, {shift}) AS date",
        "substring_index(text, '\\n', 1) AS title", "'doc/' || doc_id AS link",
        "struct(source AS href, source AS title) AS source", "CAST(doc_id AS STRING) AS id",
        "text", f"doc_id div {n} AS turn")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles without sentiments."""
    return _with_turns(table(spark, sf_dir, "documents"), spark, sf_dir).drop("turn")


def dealt(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table that is one file with one row group, dealt over the cores by its key."""
    parts = 2 * spark.sparkContext.defaultParallelism
    return spread(table(spark, sf_dir, name).select(*columns), parts, columns[0])


def scored_articles(spark: SparkSession, sf_dir: str, classifier=None) -> DataFrame:
    documents = dealt(spark, sf_dir, "documents", "doc_id", "source", "text")
    return with_sentiment(_with_turns(documents, spark, sf_dir).drop("turn"),
                          lexicon=LEXICON if classifier is None else None, classifier=classifier)


def search_results(spark: SparkSession, sf_dir: str,
                   fields=("id", "title", "link", "published", "source", "text")) -> DataFrame:
    """Responses of up to ten articles each with the named fields; the others are not moved.

    The publication time is text: of ISO style for even ids, of feed style for odd ones. A document
    of fewer than 200 characters has no valid time but a bare year.
    """
    published = ("CASE WHEN length(text) < 200 THEN date_format(published, 'yyyy') "
                 "WHEN CAST(id AS BIGINT) % 2 = 0 THEN date_format(published, 'yyyy-MM-dd HH:mm:ss') "
                 "ELSE date_format(published, 'EEE, dd MMM yyyy HH:mm:ss') || ' GMT' END AS published")
    packed = [published if f == "published" else f for f in fields]
    return (_with_turns(table(spark, sf_dir, "documents"), spark, sf_dir)
            .selectExpr("symbol", f"turn div {RESPONSE_SIZE} AS page",
                        f"date_add({FIRST_DAY_SQL}, {bucket_of('date', FIRST_DAY_SQL)} * 28)"
                        " AS bucket_start", *packed)
            .groupBy("symbol", "bucket_start", "page")
            .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("articles"))
            .selectExpr("symbol", "bucket_start", "date_add(bucket_start, 28) AS bucket_end",
                        "articles"))


def stored_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of one to four days from the days of every third article: they overlap, touch and lie
    apart, and keep to no common start."""
    return (articles(spark, sf_dir).where("CAST(id AS BIGINT) % 3 = 0")
            .selectExpr("symbol", "date AS bucket_start",
                        "date_add(date, CAST(1 + CAST(id AS BIGINT) % 4 AS INT)) AS bucket_end"))


# What becomes of the text of a response: every seventh is cut short, every seventh has another thing
# in place of its articles, every seventh is a message without articles.
FAULTY = {0: "substring(body, 1, length(body) div 2)",
          1: "replace(body, '\"articles\":[', '\"articles\":[\"none\",')",
          2: "'{\"symbol\":\"' || symbol || '\",\"message\":\"quota\"}'"}


def faulty_responses(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """Responses as text (symbol, bucket_start, n_articles, body), some of which cannot be used."""
    body = ("to_json(struct(symbol, bucket_end, "
            "transform(articles, a -> struct(" + ", ".join(f"a.{f}" for f in fields) + ")) AS articles))")
    number = "(CAST(symbol AS BIGINT) + CAST(articles[0].id AS BIGINT)) % 7"
    cases = " ".join(f"WHEN {k} THEN {change}" for k, change in FAULTY.items())
    return (search_results(spark, sf_dir, fields)
            .selectExpr("symbol", "bucket_start", "size(articles) AS n_articles",
                        f"{number} AS number", f"{body} AS body")
            .selectExpr("symbol", "bucket_start", "n_articles",
                        f"CASE number {cases} ELSE body END AS body"))


# What becomes of a page, by its number: an end tag of the title, the tags of the body, the end of an
# advertisement or the ends of paragraphs are left out, the page ends within a tag, or is no text.
BROKEN = ("replace(html, '</title>', '')",
          "regexp_replace(html, '</?(body|html)[^>]*>', '')",
          "regexp_replace(html, '<div class=.ad.>([^<]*)</div>', '<p class=ad>$1')",
          "html || '<![x[abc <a <a <a'", "html || char(0)", "replace(html, '</p>', '')")


def broken_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with faults that a reader of stored pages meets. All but those that are no text have
    the parts of the faultless page."""
    cases = " ".join(f"WHEN {k} THEN {change}" for k, change in enumerate(BROKEN))
    return (dealt(spark, sf_dir, "pages", "page_id", "url", "html")
            .selectExpr("page_id", "url", f"CASE page_id % {len(BROKEN)} {cases} END AS html"))


@functools.cache
def word_classifier():
    """The lexicon rule once more, as a stand-in for a model behind the vectorised hook."""
    polarity, token_end = dict(LEXICON), TOKEN_END

    def load():
        import re
        split = re.compile(token_end).split

        def classes(sentences):
            totals = (sum(polarity.get(w, 0) for w in split(s.lower())) for s in sentences)
            return [(t > 0) - (t < 0) + 1 for t in totals]

        return classes

    return sentence_classifier(load)
