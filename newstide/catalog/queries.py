"""One query per operator, over whole tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from newstide import schemas
from newstide.catalog import adapters as a
from newstide.functions import sentiment as s, signals as g
from newstide.operators import corpus, ordering, scoring, timeline as tl
from newstide.plans import refresh, reports
from newstide.plans.engine import NewsEngine
from newstide.sources import news, pages, prices as px, snapshots, versions
from newstide.sources.layout import ensure_shared_dir, new_table_path, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
W = scoring.DEFAULT_WINDOW
WINDOWS = scoring.DEFAULT_WINDOWS


def _register(name: str):
    """Register a query; days are handed out as ISO text, which every engine hashes alike."""

    def add(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_shared_dir(spark)
            df = build(spark, sf_dir)
            days = [f.name for f in df.schema if isinstance(f.dataType, T.DateType)]
            return df.withColumns({d: F.col(d).cast("string") for d in days}) if days else df

        QUERIES[name] = run
        return build

    return add


def _rounded(df: DataFrame, columns) -> DataFrame:
    """Sums of doubles depend on their order in the last digits."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _engine(spark, sf_dir, articles=a.scored_articles) -> NewsEngine:
    return NewsEngine(a.symbols(spark, sf_dir), a.prices(spark, sf_dir), articles(spark, sf_dir))


def _some_industries(spark, sf_dir) -> NewsEngine:
    """An engine whose symbols are those of three industries; other articles are not its own."""
    symbols = a.symbols(spark, sf_dir).where("industry <> '3'")
    return NewsEngine(symbols, a.prices(spark, sf_dir), a.articles(spark, sf_dir))


def _with_sentiments(spark, sf_dir) -> DataFrame:
    """Scored articles without their texts, which these queries do not return."""
    return a.scored_articles(spark, sf_dir).withColumn("text", F.lit(None).cast("string"))


def _counts(spark, sf_dir) -> DataFrame:
    return tl.count_timeline(a.prices(spark, sf_dir), a.scored_articles(spark, sf_dir))


def _scored(spark, sf_dir, windows=(W,), **rules) -> DataFrame:
    return scoring.score_and_predict(_counts(spark, sf_dir), windows, **rules)


def _day_means(spark, sf_dir) -> DataFrame:
    """Price days with the mean text sentiment of the day, NaN where there is none."""
    mean = "CASE WHEN text_n > 0 THEN CAST(text_sum AS DOUBLE) / text_n ELSE double('NaN') END"
    return _counts(spark, sf_dir).selectExpr("symbol", "date", "open", "close", f"{mean} AS mean")


# --- A: scans, sources, sinks ---------------------------------------------------------------

@_register("A1_price_scan")
def _(spark, sf_dir):
    path = new_table_path(spark, "prices")
    a.prices(spark, sf_dir).write.parquet(path)
    return px.read_prices(spark, path, start="2024-01-01", end="2024-12-31")


@_register("A1_wide_prices")
def _(spark, sf_dir):
    """Daily values per industry as a file with a column per industry and field."""
    path = new_table_path(spark, "wide-prices")
    industries = [str(k) for k in range(a.N_INDUSTRIES)]
    fields = {"Open": "min", "High": "max", "Low": "min", "Close": "max", "Volume": "sum"}
    measures = [F.expr(f"{rule}({field.lower()})").alias(field) for field, rule in fields.items()]
    daily = (a.prices(spark, sf_dir).join(a.symbols(spark, sf_dir), "symbol")
             .groupBy(F.col("date").alias("Date")).pivot("industry", industries).agg(*measures))
    (daily.select("Date", *[F.col(f"{k}_{f}").alias(f"{k}|{f}") for k in industries for f in fields])
     .write.csv(path, header=True))
    return px.read_prices(spark, path, "csv", wide=True)


@_register("A2_symbol_dimension")
def _(spark, sf_dir):
    maps = a.symbols(spark, sf_dir).select(
        F.create_map("industry", F.array("symbol")).alias("industries"))
    return px.flatten_symbol_map(maps)


@_register("A3_search_scan")
def _(spark, sf_dir):
    path = new_table_path(spark, "responses")
    a.search_results(spark, sf_dir).write.partitionBy("bucket_start").json(path)
    found = news.flatten_articles(news.read_search_results(spark, path))
    return found.select("symbol", "bucket_start", "bucket_end", "id", "title", "link",
                        "published", F.col("source.href").alias("href"), "text")


@_register("A3_rejected_responses")
def _(spark, sf_dir):
    """Responses used and rejected, by the folder of their file."""
    path = new_table_path(spark, "responses")
    (a.faulty_responses(spark, sf_dir, "id", "title", "link", "published")
     .select("bucket_start", "body").write.partitionBy("bucket_start").text(path))
    found = news.rejects_per_file(news.scan_responses(spark, path))
    folder = F.regexp_extract("file", "bucket_start=([0-9-]+)/", 1)
    return (found.groupBy(folder.alias("folder"), "reason")
            .agg(F.sum("n_responses").alias("n_responses")))


@_register("A3_accepted_articles")
def _(spark, sf_dir):
    path = new_table_path(spark, "responses")
    (a.faulty_responses(spark, sf_dir, "id", "link", "source")
     .select("bucket_start", "body").write.partitionBy("bucket_start").text(path))
    return (news.flatten_articles(news.read_search_results(spark, path))
            .select("symbol", "bucket_start", "bucket_end", "id", "link",
                    F.col("source.href").alias("href")))


@_register("A4_snapshot_write")
def _(spark, sf_dir):
    root = new_table_path(spark, "snapshot")
    snapshots.write_snapshot(a.prices(spark, sf_dir), root, "prices", layout="bucket")
    return snapshots.read_snapshot(spark, root, "prices").select(*schemas.PRICES.names)


@_register("A5_snapshot_read")
def _(spark, sf_dir):
    root = new_table_path(spark, "snapshot")
    snapshots.write_snapshot(a.articles(spark, sf_dir), root, "articles", layout="bucket")
    found = snapshots.read_snapshot(spark, root, "articles")
    return found.select("symbol", "date", "link", F.col("source.href").alias("href"))


@_register("A5_snapshot_symbol")
def _(spark, sf_dir):
    root = new_table_path(spark, "snapshot")
    snapshots.write_snapshot(a.articles(spark, sf_dir), root, "articles", layout="bucket")
    return snapshots.read_snapshot(spark, root, "articles", symbol="7").select(
        "symbol", "date", "link", F.col("source.href").alias("href"))


@_register("A6_full_load")
def _(spark, sf_dir):
    """Rows of every table that a saved engine gives back, as (table, key, value)."""
    root = new_table_path(spark, "snapshot")
    NewsEngine(a.symbols(spark, sf_dir), a.prices(spark, sf_dir), a.articles(spark, sf_dir),
               instruments=a.instruments(spark, sf_dir),
               search_results=a.search_results(spark, sf_dir)).save(root, layout="bucket")
    load = snapshots.load_all(spark, root)
    rows = {"instruments": (load.instruments, "symbol", "shortname"),
            "search_results": (load.search_results, "symbol || ' ' || bucket_start",
                               "array_join(articles.link, ' ')"),
            "prices": (load.prices, "symbol || ' ' || date", "CAST(volume AS STRING)"),
            "articles": (load.articles, "symbol || ' ' || link", "md5(text)"),
            "timeline": (load.timeline, "symbol || ' ' || date", "CAST(n_links AS STRING)"),
            "links": (load.links, "symbol || ' ' || date || ' ' || position", "link"),
            "source_weights": (load.source_weights, "href", "CAST(n AS STRING)")}
    parts = [df.selectExpr(f"'{name}' AS name", f"{key} AS key", f"{value} AS value")
             for name, (df, key, value) in rows.items()]
    return news.concat_articles(*parts)


def _saved(spark, sf_dir) -> NewsEngine:
    """The engine after a save, as a later session loads it."""
    root = new_table_path(spark, "saved")
    _engine(spark, sf_dir).save(root, layout="bucket", buckets=8)
    return NewsEngine.load(spark, root, a.symbols(spark, sf_dir))


@_register("A6_saved_accuracy")
def _(spark, sf_dir):
    """K3 from stored days: no shuffle by symbol, no texts."""
    return _saved(spark, sf_dir).analyze_accuracy()


@_register("A6_saved_covariance")
def _(spark, sf_dir):
    return _rounded(_saved(spark, sf_dir).analyze_cov(), reports.COVARIANCES)


@_register("A6_interrupted_save")
def _(spark, sf_dir):
    """Prices and links as readers see them after a second save that stopped half-way."""
    root = new_table_path(spark, "saved")
    engine = NewsEngine(a.symbols(spark, sf_dir), a.prices(spark, sf_dir), a.articles(spark, sf_dir))
    engine.save(root, layout="bucket", buckets=8)
    try:
        with versions.new_version(spark, root) as draft:
            draft.write("links", engine.links().limit(0), "bucket")
            draft.write_clustered("prices", engine.prices.withColumn("volume", F.lit(0).cast("long")))
            raise InterruptedError
    except InterruptedError:
        load = snapshots.load_all(spark, root)
    prices = load.prices.selectExpr("'prices' AS name", "symbol || ' ' || date AS key",
                                    "CAST(volume AS STRING) AS value")
    return prices.unionByName(load.links.selectExpr(
        "'links' AS name", "symbol || ' ' || date || ' ' || position AS key", "link AS value"))


@_register("A6_merged_deliveries")
def _(spark, sf_dir):
    """Links and sums of days after a save and two deliveries that overlap it and each other."""
    root = new_table_path(spark, "saved")
    articles = written(_with_sentiments(spark, sf_dir), "scored")
    number = "CAST(id AS BIGINT) % 4"
    NewsEngine(a.symbols(spark, sf_dir), a.prices(spark, sf_dir), articles.where(f"{number} < 2")
               ).save(root, layout="bucket", buckets=8)
    for delivery in (f"{number} IN (1, 2)", f"{number} <> 1", f"{number} = 0"):
        refresh.merge_articles(spark, root, articles.where(delivery))
    load = snapshots.load_all(spark, root)
    links = load.links.selectExpr("symbol || ' ' || date || ' ' || position AS key", "link AS value")
    return links.unionByName(load.days.selectExpr(
        "symbol || ' ' || date AS key",
        "concat_ws(' ', n_links, n_resolved, title_sum, title_n, text_sum, text_n) AS value"))


@_register("A7_csv_sink")
def _(spark, sf_dir):
    path = new_table_path(spark, "sample-csv")
    sample = corpus.sample_articles(a.articles(spark, sf_dir))
    snapshots.write_csv(sample, path)
    back = spark.read.csv(path, header=True, escape='"', multiLine=True,
                          schema="symbol STRING, published STRING, date STRING, title STRING, "
                                 "link STRING, source STRING, id STRING, text STRING")
    return back.select("symbol", "date", "link",
                       F.get_json_object("source", "$.href").alias("href"))


@_register("A8_page_text")
def _(spark, sf_dir):
    return pages.extract_pages(a.dealt(spark, sf_dir, "pages", "page_id", "url", "html"))


@_register("A8_broken_pages")
def _(spark, sf_dir):
    return pages.extract_pages(a.broken_pages(spark, sf_dir), errors=True)


@_register("A8_page_failures")
def _(spark, sf_dir):
    return pages.page_failures(a.broken_pages(spark, sf_dir))


@_register("A9_fetch_buckets")
def _(spark, sf_dir):
    return news.fetch_buckets(px.date_ranges(a.prices(spark, sf_dir)))


# --- B: projections, filters, predicates ----------------------------------------------------

@_register("A9_missing_requests")
def _(spark, sf_dir):
    return news.missing_requests(a.instruments(spark, sf_dir), a.prices(spark, sf_dir),
                                 a.stored_buckets(spark, sf_dir), interval_days=3)


@_register("B1_symbol_filter")
def _(spark, sf_dir):
    watched = a.table(spark, sf_dir, "customer").where("c_acctbal > 0").select(
        F.col("c_mktsegment").alias("industry"), F.col("c_custkey").cast("string").alias("symbol"))
    return px.keep_symbols(a.prices(spark, sf_dir), watched)


@_register("B2_date_slice")
def _(spark, sf_dir):
    return px.date_slice(a.prices(spark, sf_dir), "2024-01-08", "2024-01-19")


@_register("B3_drop_incomplete")
def _(spark, sf_dir):
    return px.drop_incomplete(_day_means(spark, sf_dir))


@_register("B4_valid_publications")
def _(spark, sf_dir):
    found = news.flatten_articles(a.search_results(spark, sf_dir, ("link", "published")))
    return news.valid_publications(found).select("symbol", "link", "date")


@_register("B5_project_articles")
def _(spark, sf_dir):
    found = news.valid_publications(news.flatten_articles(a.search_results(spark, sf_dir)))
    return news.project_articles(found.drop("text")).select(
        "symbol", "date", "title", "link", F.col("source.href").alias("href"), "id", "text",
        "title_sentiment", "text_sentiment")


@_register("B6_select_rename")
def _(spark, sf_dir):
    wide = a.prices(spark, sf_dir).select(
        "symbol", "date", F.col("open").alias("Open"), F.col("close").alias("Close"))
    return tl.trading_days(wide).select("symbol", "date", "open", "close")


@_register("B7_nan_to_null")
def _(spark, sf_dir):
    return _day_means(spark, sf_dir).withColumn("mean", F.expr(g.nan_to_null("mean")))


@_register("B8_day_change")
def _(spark, sf_dir):
    return tl.trading_days(a.prices(spark, sf_dir)).select("symbol", "date", "change")


@_register("B9_nested_source")
def _(spark, sf_dir):
    return (a.articles(spark, sf_dir).where("source.href IS NOT NULL")
            .select("symbol", "link", F.col("source.href").alias("href")))


@_register("B10_valid_sentences")
def _(spark, sf_dir):
    return a.table(spark, sf_dir, "documents").selectExpr(
        "doc_id", f"size({s.split_sentences('text')}) AS n_sentences",
        f"size({s.valid_sentences('text')}) AS n_valid")


@_register("B11_has_text")
def _(spark, sf_dir):
    return a.table(spark, sf_dir, "documents").selectExpr(
        "doc_id", f"CAST({g.has_text('text')} AS INT) AS has_text")


@_register("B12_has_prediction")
def _(spark, sf_dir):
    return (_scored(spark, sf_dir).where(g.has_prediction("text_prediction"))
            .select("symbol", "date", "text_prediction"))


@_register("B13_search_terms")
def _(spark, sf_dir):
    return news.search_terms(a.instruments(spark, sf_dir))


@_register("B14_nonempty_histories")
def _(spark, sf_dir):
    ranges = px.date_ranges(a.prices(spark, sf_dir))
    return (a.instruments(spark, sf_dir).join(ranges, "symbol")
            .select("symbol", "shortname", "start_date", "end_date"))


# --- C: joins -------------------------------------------------------------------------------

@_register("C1_price_news_join")
def _(spark, sf_dir):
    return _counts(spark, sf_dir).select("symbol", "date", "open", "close", *tl.COUNTERS)


@_register("C2_instrument_history")
def _(spark, sf_dir):
    return (news.with_history_size(a.instruments(spark, sf_dir), a.search_results(spark, sf_dir, ("link",)))
            .select("symbol", "shortname", "n_groups"))


@_register("C3_link_lookup")
def _(spark, sf_dir):
    articles = a.scored_articles(spark, sf_dir)
    return tl.link_articles(tl.build_timeline(a.prices(spark, sf_dir), articles), articles)


@_register("C4_lag_band_join")
def _(spark, sf_dir):
    return scoring.band_scores_by_join(_counts(spark, sf_dir), W).select(
        "symbol", "date", F.col(f"article_count_{W}").alias("article_count"),
        F.col(f"title_score_{W}").alias("title_score"),
        F.col(f"text_score_{W}").alias("text_score"))


@_register("C5_industry_join")
def _(spark, sf_dir):
    return (reports.accuracy(_scored(spark, sf_dir)).join(a.symbols(spark, sf_dir), "symbol")
            .select("industry", "symbol", "window", "text_accuracy"))


@_register("C6_window_lengths")
def _(spark, sf_dir):
    banded = scoring.band_scores(_counts(spark, sf_dir), WINDOWS)
    return scoring.unpivot_windows(banded, WINDOWS).select(
        "symbol", "date", "window", "article_count")


@_register("C7_lookback")
def _(spark, sf_dir):
    banded = scoring.band_scores(_counts(spark, sf_dir), [W])
    return banded.selectExpr("symbol", "date", f"text_score_{W} AS text_score",
                             f"{scoring.latest_score(f'text_score_{W}')} AS earlier_score")


# --- D: aggregations ------------------------------------------------------------------------

@_register("D1_links_per_day")
def _(spark, sf_dir):
    return tl.day_links(a.articles(spark, sf_dir))


@_register("D2_document_sentiment")
def _(spark, sf_dir):
    return a.scored_articles(spark, sf_dir).select("link", "title_sentiment", "text_sentiment")


@_register("D3_band_mean")
def _(spark, sf_dir):
    return scoring.band_scores(_counts(spark, sf_dir), [W]).select(
        "symbol", "date", F.col(f"title_score_{W}").alias("title_score"),
        F.col(f"text_score_{W}").alias("text_score"))


@_register("D3_band_mean_skip")
def _(spark, sf_dir):
    return scoring.band_scores(_counts(spark, sf_dir), [W], null_policy="skip").select(
        "symbol", "date", F.col(f"title_score_{W}").alias("title_score"),
        F.col(f"text_score_{W}").alias("text_score"))


@_register("D4_band_article_count")
def _(spark, sf_dir):
    return scoring.band_scores(_counts(spark, sf_dir), [W]).select(
        "symbol", "date", F.col(f"article_count_{W}").alias("article_count"))


@_register("D5_correct_counts")
def _(spark, sf_dir):
    return reports.correct_counts(_scored(spark, sf_dir))


@_register("D6_accuracies")
def _(spark, sf_dir):
    return reports.accuracy(_scored(spark, sf_dir, WINDOWS))


@_register("D7_industry_accuracy")
def _(spark, sf_dir):
    means = reports.industry_accuracy(_scored(spark, sf_dir), a.symbols(spark, sf_dir))
    return _rounded(means, reports.ACCURACIES)


@_register("D8_covariance")
def _(spark, sf_dir):
    return _rounded(reports.covariance(_scored(spark, sf_dir, WINDOWS)), reports.COVARIANCES)


@_register("D9_industry_covariance")
def _(spark, sf_dir):
    sums = reports.industry_covariance(_scored(spark, sf_dir), a.symbols(spark, sf_dir))
    return _rounded(sums, reports.COVARIANCES)


@_register("D8_merged_states")
def _(spark, sf_dir):
    """Reports of all days from states of three parts, one of which was merged twice and taken out."""
    scored = written(_scored(spark, sf_dir).select(
        "symbol", "date", "window", "change", *[f"{c}_{x}" for c in tl.CHANNELS
                                                for x in ("score", "prediction", "result")]), "scored")
    third = [reports.report_state(scored.where(f"day(date) % 3 = {k}")) for k in range(3)]
    twice = reports.merge_states(*third, third[1])
    return _rounded(reports.reports_of(reports.retract_state(twice, third[1])),
                    [*reports.ACCURACIES, *reports.COVARIANCES])


@_register("D10_source_counts")
def _(spark, sf_dir):
    return corpus.source_counts(a.articles(spark, sf_dir))


@_register("D11_source_weight")
def _(spark, sf_dir):
    found = pages.extract_pages(a.table(spark, sf_dir, "pages"))
    return corpus.source_weights(found.select(F.struct("href").alias("source")))


@_register("D12_corpus_statistics")
def _(spark, sf_dir):
    return corpus.corpus_stats(a.articles(spark, sf_dir))


def _merged(spark, sf_dir) -> NewsEngine:
    """The engine as loaded after a save and an overlapping delivery."""
    root = new_table_path(spark, "saved")
    articles = written(a.scored_articles(spark, sf_dir), "scored")
    number = "CAST(id AS BIGINT) % 3"
    symbols = a.symbols(spark, sf_dir)
    NewsEngine(symbols, a.prices(spark, sf_dir), articles.where(f"{number} < 2")
               ).save(root, layout="bucket", buckets=8)
    refresh.merge_articles(spark, root, articles.where(f"{number} > 0"))
    return NewsEngine.load(spark, root, symbols)


@_register("D12_stored_statistics")
def _(spark, sf_dir):
    """From stored sketches, and whether the estimate is within three standard errors of the count."""
    exact = corpus.distinct_sources(a.articles(spark, sf_dir)).agg(F.count("*")).scalar()
    stats = _merged(spark, sf_dir).corpus_stats(approximate=True)
    return stats.withColumn("near", F.abs(F.col("n_sources") - exact) <= 0.05 * exact).drop("n_sources")


@_register("D13_date_range")
def _(spark, sf_dir):
    return px.date_ranges(a.prices(spark, sf_dir))


def _copies(spark, sf_dir) -> DataFrame:
    """Articles under the source as symbol and the hash of the text as link: copies collide."""
    return a.articles(spark, sf_dir).select(
        F.col("source.href").alias("symbol"), F.md5("text").alias("link"), "published", "id")


@_register("D14_duplicate_links")
def _(spark, sf_dir):
    return tl.duplicate_keys(_copies(spark, sf_dir), "symbol", "link")


@_register("D14_drop_duplicate_links")
def _(spark, sf_dir):
    return tl.drop_duplicate_links(_copies(spark, sf_dir)).select("symbol", "link", "id")


def _repeated(spark, sf_dir) -> DataFrame:
    """Scored articles of which every third comes twice, as from buckets that share a day."""
    articles = a.scored_articles(spark, sf_dir)
    return articles.union(articles.where("CAST(id AS BIGINT) % 3 = 0"))


@_register("D14_scores_drop_duplicates")
def _(spark, sf_dir):
    engine = NewsEngine(a.symbols(spark, sf_dir), a.prices(spark, sf_dir), _repeated(spark, sf_dir),
                        duplicates="drop")
    return engine.score_and_predict().select("symbol", "date", "article_count", "text_score")


@_register("D14_scores_keep_duplicates")
def _(spark, sf_dir):
    engine = NewsEngine(a.symbols(spark, sf_dir), a.prices(spark, sf_dir), _repeated(spark, sf_dir),
                        duplicates="keep")
    return engine.score_and_predict().select("symbol", "date", "article_count", "text_score")


@_register("D15_bucket_counts")
def _(spark, sf_dir):
    return news.bucket_counts(a.search_results(spark, sf_dir, ("link",)))


@_register("D15_history_sizes")
def _(spark, sf_dir):
    return news.history_sizes(a.search_results(spark, sf_dir, ("link",)))


# --- E: windows -----------------------------------------------------------------------------

@_register("E1_lag_band_frame")
def _(spark, sf_dir):
    banded = scoring.band_scores(_counts(spark, sf_dir), WINDOWS)
    return scoring.unpivot_windows(banded, WINDOWS).select(
        "symbol", "date", "window", "article_count", "title_score", "text_score")


@_register("E2_lag_multiplicity")
def _(spark, sf_dir):
    banded = scoring.band_scores(_counts(spark, sf_dir), (0, 1, 2))
    return scoring.unpivot_windows(banded, (0, 1, 2)).select(
        "symbol", "date", "window", "article_count", "title_score", "text_score")


def _filled(spark, sf_dir, fill: str) -> DataFrame:
    banded = scoring.band_scores(_counts(spark, sf_dir), WINDOWS)
    filled = scoring.fill_scores(banded, WINDOWS, fill=fill)
    return scoring.unpivot_windows(filled, WINDOWS).select(
        "symbol", "date", "window", "title_score", "text_score")


@_register("E3_fill_lookback")
def _(spark, sf_dir):
    return _filled(spark, sf_dir, "lookback")


@_register("E3_fill_neutral")
def _(spark, sf_dir):
    return _filled(spark, sf_dir, "neutral")


@_register("E3_scores_after_append")
def _(spark, sf_dir):
    """Scores of the first half of the month, brought up to date when the rest is appended."""
    days, appended = written(_counts(spark, sf_dir), "days"), "2024-01-17"
    before = scoring.score_and_predict(days.where(f"date < DATE '{appended}'"), WINDOWS)
    return (scoring.updated_scores(before, days, appended, windows=WINDOWS).drop(*tl.COUNTERS))


@_register("E4_window_sweep")
def _(spark, sf_dir):
    return _scored(spark, sf_dir, WINDOWS).drop(*tl.COUNTERS)


@_register("E5_sample_rank")
def _(spark, sf_dir):
    return corpus.sample_rank(a.articles(spark, sf_dir)).select("symbol", "link", "rank")


# --- F: sorts, limits -----------------------------------------------------------------------

@_register("F1_publication_order")
def _(spark, sf_dir):
    slim = a.articles(spark, sf_dir).select("symbol", "published", "link")
    return (ordering.with_position(slim, ["symbol"], ["published", "link"])
            .select("symbol", "link", "position"))


@_register("F1_publication_sort")
def _(spark, sf_dir):
    return (ordering.publication_order(a.articles(spark, sf_dir))
            .select("symbol", "date", "link"))


@_register("F2_top_sources")
def _(spark, sf_dir):
    return corpus.top_sources(a.articles(spark, sf_dir))


@_register("F2_stored_top_sources")
def _(spark, sf_dir):
    """From the stored states, which hold all sources there are."""
    return _merged(spark, sf_dir).top_sources(approximate=True)


@_register("F3_sample")
def _(spark, sf_dir):
    return corpus.sample_articles(a.articles(spark, sf_dir)).select(
        "symbol", "date", "link", F.col("source.href").alias("href"), "title")


@_register("F4_date_order")
def _(spark, sf_dir):
    """The position is what the order of the rows comes to."""
    ordered = reports.date_ordered(tl.trading_days(a.prices(spark, sf_dir)))
    return ordering.with_position(ordered, ["symbol"], ["date"])


# --- G: set operations ----------------------------------------------------------------------

@_register("G1_flatten_groups")
def _(spark, sf_dir):
    return news.flatten_articles(a.search_results(spark, sf_dir, ("link", "published"))).select(
        "symbol", "bucket_start", "bucket_end", "link", "published")


@_register("G2_concat_frames")
def _(spark, sf_dir):
    stored = pages.extract_pages(a.table(spark, sf_dir, "pages")).select(
        F.col("href").alias("symbol"), F.col("url").alias("link"), "title")
    return news.concat_articles(a.articles(spark, sf_dir).select("symbol", "link", "date", "title"),
                                stored)


@_register("G3_distinct_sources")
def _(spark, sf_dir):
    return corpus.distinct_sources(a.articles(spark, sf_dir))


# --- H: scalar functions --------------------------------------------------------------------

def _sentences(spark, sf_dir) -> DataFrame:
    return a.table(spark, sf_dir, "documents").selectExpr(
        "doc_id", f"posexplode({s.split_sentences('text')}) AS (pos, sentence)")


@_register("H1_sentence_split")
def _(spark, sf_dir):
    return _sentences(spark, sf_dir)


@_register("H2_token_count")
def _(spark, sf_dir):
    found = _sentences(spark, sf_dir).selectExpr(
        "doc_id", "pos", f"{s.tokens('sentence')} AS tokens")
    return found.selectExpr("doc_id", "pos", "size(tokens) AS n_tokens",
                            "array_join(tokens, ' ') AS tokens")


@_register("H3_sentence_class")
def _(spark, sf_dir):
    return _sentences(spark, sf_dir).selectExpr(
        "doc_id", "pos", f"{s.sentence_class(s.tokens('sentence'), a.LEXICON)} AS class")


@_register("H4_truncated_mean")
def _(spark, sf_dir):
    classes = (f"transform({s.split_sentences('text')}, "
               f"sentence -> {s.sentence_class(s.tokens('sentence'), a.LEXICON)})")
    return a.table(spark, sf_dir, "documents").selectExpr(
        "doc_id", f"{s.mean_class_score(classes)} AS score")


@_register("H5_classify")
def _(spark, sf_dir):
    return _scored(spark, sf_dir, WINDOWS, fill="none").select(
        "symbol", "date", "window", "title_score", "title_prediction", "text_score",
        "text_prediction")


@_register("H6_grade")
def _(spark, sf_dir):
    return _scored(spark, sf_dir, WINDOWS).select(
        "symbol", "date", "window", "change", "title_prediction", "title_result",
        "text_prediction", "text_result")


@_register("H7_date_minus_days")
def _(spark, sf_dir):
    return a.prices(spark, sf_dir).select(
        "symbol", "date", F.date_sub("date", W).alias("lagged"))


@_register("H8_lag_clamp")
def _(spark, sf_dir):
    lags = ", ".join(f"struct({w} AS window, {lag} AS lag)"
                     for w in (2, W) for lag in g.band_lags(w))
    return a.prices(spark, sf_dir).selectExpr("symbol", "date", f"inline(array({lags}))")


@_register("H9_format_date")
def _(spark, sf_dir):
    ranges = px.date_ranges(a.prices(spark, sf_dir))
    return a.instruments(spark, sf_dir).join(ranges, "symbol", "left").selectExpr(
        "symbol", f"{g.format_day('start_date')} AS start", f"{g.format_day('end_date')} AS `end`")


@_register("H10_safe_ratio")
def _(spark, sf_dir):
    counts = tl.day_sums(a.scored_articles(spark, sf_dir))
    return counts.selectExpr("symbol", "date", f"{g.safe_ratio('title_sum', 'title_n')} AS ratio")


@_register("H11_abs_change")
def _(spark, sf_dir):
    return tl.trading_days(a.prices(spark, sf_dir)).select(
        "symbol", "date", F.abs("change").alias("move"))


@_register("H12_json_decode")
def _(spark, sf_dir):
    bodies = a.search_results(spark, sf_dir).select(
        "symbol", F.to_json(F.struct("articles")).alias("body"))
    return (bodies.selectExpr("symbol", f"inline({news.parse_response('body')})")
            .select("symbol", "id", "title", "link", "published",
                    F.col("source.href").alias("href"), "text"))


@_register("H12_decode_responses")
def _(spark, sf_dir):
    found = news.decode_responses(a.faulty_responses(spark, sf_dir, "id", "title", "link"))
    return found.select("symbol", "bucket_start", "n_articles", "reason",
                        F.array_join("articles.link", " ").alias("links"))


@_register("H13_to_day")
def _(spark, sf_dir):
    return a.table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("date"))


@_register("H14_or_empty")
def _(spark, sf_dir):
    return pages.extract_pages(a.table(spark, sf_dir, "pages")).selectExpr(
        "page_id", f"{g.or_empty('text')} AS text")


@_register("H15_text_length")
def _(spark, sf_dir):
    return a.table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))


@_register("H16_source_host")
def _(spark, sf_dir):
    return a.table(spark, sf_dir, "pages").selectExpr("page_id", f"{g.source_host('url')} AS href")


@_register("H17_bucket_of_date")
def _(spark, sf_dir):
    return a.articles(spark, sf_dir).selectExpr(
        "link", f"{g.bucket_of('date', a.FIRST_DAY_SQL)} AS bucket")


# --- J: enrichment --------------------------------------------------------------------------

@_register("J1_enrich_articles")
def _(spark, sf_dir):
    return a.scored_articles(spark, sf_dir).select(
        "symbol", "date", "title", "link", F.col("source.href").alias("href"), "text",
        "title_sentiment", "text_sentiment")


@_register("J2_model_hook")
def _(spark, sf_dir):
    return a.scored_articles(spark, sf_dir, classifier=a.word_classifier()).select(
        "link", "title_sentiment", "text_sentiment")


@_register("J3_row_rules")
def _(spark, sf_dir):
    return _scored(spark, sf_dir).select(
        "symbol", "date", "change", "title_prediction", "text_prediction", "title_result",
        "text_result")


# --- K: reports -----------------------------------------------------------------------------

@_register("K1_build_timeline")
def _(spark, sf_dir):
    return _engine(spark, sf_dir, a.articles).timeline()


@_register("K2_score_and_predict")
def _(spark, sf_dir):
    return _engine(spark, sf_dir).score_and_predict().drop(*tl.COUNTERS)


@_register("K3_analyze_accuracy")
def _(spark, sf_dir):
    return _engine(spark, sf_dir).analyze_accuracy()


@_register("K4_analyze_accuracies")
def _(spark, sf_dir):
    return _rounded(_engine(spark, sf_dir).analyze_accuracies(), reports.ACCURACIES)


@_register("K5_analyze_cov")
def _(spark, sf_dir):
    return _rounded(_engine(spark, sf_dir).analyze_cov(), reports.COVARIANCES)


@_register("K6_analyze_covs")
def _(spark, sf_dir):
    return _rounded(_engine(spark, sf_dir).analyze_covs(), reports.COVARIANCES)


@_register("K46_analyze_sweep")
def _(spark, sf_dir):
    return _rounded(_engine(spark, sf_dir).analyze_sweep(),
                    [*reports.ACCURACIES, *reports.COVARIANCES])


@_register("K7_series")
def _(spark, sf_dir):
    return ordering.with_position(_engine(spark, sf_dir).series(),
                                  ["symbol", "window", "series"], ["date"])


@_register("K8_corpus_stats")
def _(spark, sf_dir):
    return _some_industries(spark, sf_dir).corpus_stats()


@_register("K9_source_weights")
def _(spark, sf_dir):
    return _some_industries(spark, sf_dir).source_weights()


@_register("K10_sample_articles")
def _(spark, sf_dir):
    return _some_industries(spark, sf_dir).sample_articles().select(
        "symbol", "date", "link", "title")


@_register("K11_sentiment_distribution")
def _(spark, sf_dir):
    return _engine(spark, sf_dir).sentiment_distribution()


@_register("K12_fetch_requests")
def _(spark, sf_dir):
    return news.fetch_requests(a.instruments(spark, sf_dir), a.prices(spark, sf_dir))
