"""The engine: reports over one set of symbols, prices and articles."""

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from newstide import schemas
from newstide.operators import corpus
from newstide.operators.scoring import (DEFAULT_WINDOW, DEFAULT_WINDOWS, FILL_LIMIT,
                                        rescored_days, score_and_predict)
from newstide.operators.timeline import (build_timeline, count_timeline, day_links,
                                         scored_survivors, unique_links)
from newstide.plans import reports
from newstide.sources.layout import written
from newstide.sources.prices import keep_symbols
from newstide.sources.snapshots import CORPUS, load_all, write_csv
from newstide.sources.versions import BUCKETS, new_version


class NewsEngine:
    """``articles`` carry sentiments (``functions.sentiment.with_sentiment`` adds them).

    Prices and articles are cut to the engine's symbols, for all reports. ``duplicates`` says what
    happens when a symbol has the same link twice: 'error' (the default) makes every report on
    articles fail when it is evaluated, 'drop' keeps one article of each link, 'keep' counts all.

    All methods are lazy but ``save`` and ``save_sample``, and ``links``, which writes the link
    positions to the shared folder. Reports take a single window or many; with ``symbols``
    they are limited to these. To run several reports on one scoring, keep
    ``scored = engine.score_and_predict(windows=...).persist()`` and use ``plans.reports``;
    ``analyze_sweep`` makes both industry reports in one pass.

    ``days`` are price days with the sums of their articles (``schemas.DAYS``), which all scores
    are made from; without them they are summed from the articles. ``unique`` says that no symbol
    has a link twice, so that nothing has to look. ``state`` is that of ``corpus_state``. A saved
    engine has all three.
    """

    def __init__(self, symbols: DataFrame, prices: DataFrame, articles: DataFrame,
                 null_policy: str = "poison", fill: str = "lookback", limit: int = FILL_LIMIT,
                 duplicates: str = "error", instruments: DataFrame | None = None,
                 search_results: DataFrame | None = None, days: DataFrame | None = None,
                 unique: bool = False, state: DataFrame | None = None):
        self.symbols = symbols
        self.prices = keep_symbols(prices, symbols)
        self.days = None if days is None else keep_symbols(days, symbols)
        self._state = None if state is None else keep_symbols(state, symbols)
        self.unique = unique or duplicates != "keep"
        self._given = articles
        self._found = keep_symbols(articles, symbols)
        self._copies = "keep" if unique else duplicates
        self.articles = unique_links(self._found, self._copies)
        self.instruments = instruments
        self.search_results = search_results
        self.rules = {"null_policy": null_policy, "fill": fill, "limit": limit}

    @classmethod
    def load(cls, spark: SparkSession, root: str, symbols: DataFrame, version: int | None = None,
             **rules) -> "NewsEngine":
        """Engine over the tables that ``save`` wrote, of the newest version or that of a number."""
        saved = load_all(spark, root, version)
        if saved.prices is None or saved.articles is None:
            raise FileNotFoundError(f"no snapshot of prices and articles under {root}")
        return cls(symbols, saved.prices, saved.articles, instruments=saved.instruments,
                   search_results=saved.search_results, days=saved.days, unique=saved.unique,
                   state=saved.corpus, **rules)

    def _only(self, df: DataFrame, symbols: Iterable[str] | None) -> DataFrame:
        return df if symbols is None else df.where(F.col("symbol").isin(list(symbols)))

    def _scored(self, symbols: Iterable[str] | None) -> DataFrame:
        """Articles for scores and counts: copies are dropped among slim rows, not whole ones."""
        if self._copies == "drop":
            return scored_survivors(self._only(self._found, symbols))
        return self._only(self.articles, symbols)

    def timeline(self, symbols: Iterable[str] | None = None) -> DataFrame:
        """One row per symbol and price day."""
        symbols = None if symbols is None else list(symbols)
        if self.days is not None:
            return self._only(self.days, symbols).select(*schemas.TIMELINE.names)
        return build_timeline(self._only(self.prices, symbols), self._scored(symbols))

    def links(self, symbols: Iterable[str] | None = None) -> DataFrame:
        """The links of every day in publication order, one row per link."""
        return day_links(self._only(self.articles, symbols))

    def day_counts(self, symbols: Iterable[str] | None = None) -> DataFrame:
        """Price days with the sums that scores are made from."""
        symbols = None if symbols is None else list(symbols)
        if self.days is not None:
            return self._only(self.days, symbols)
        return count_timeline(self._only(self.prices, symbols), self._scored(symbols))

    def score_and_predict(self, symbols: Iterable[str] | None = None,
                          windows: Sequence[int] = (DEFAULT_WINDOW,)) -> DataFrame:
        return score_and_predict(self.day_counts(symbols), windows, **self.rules)

    def rescore(self, first, last=None, windows: Sequence[int] = (DEFAULT_WINDOW,)) -> DataFrame:
        """The scored days that change when prices or articles of ``first`` to ``last`` do."""
        return rescored_days(self.day_counts(), first, last, windows, **self.rules)

    def analyze_accuracy(self, symbols: Iterable[str] | None = None,
                         window: int = DEFAULT_WINDOW) -> DataFrame:
        return reports.accuracy(self.score_and_predict(symbols, [window]))

    def analyze_accuracies(self, windows: Sequence[int] = DEFAULT_WINDOWS) -> DataFrame:
        return reports.industry_accuracy(self.score_and_predict(windows=windows), self.symbols)

    def analyze_cov(self, symbols: Iterable[str] | None = None,
                    window: int = DEFAULT_WINDOW) -> DataFrame:
        return reports.covariance(self.score_and_predict(symbols, [window]))

    def analyze_covs(self, windows: Sequence[int] = DEFAULT_WINDOWS) -> DataFrame:
        return reports.industry_covariance(self.score_and_predict(windows=windows), self.symbols)

    def analyze_sweep(self, windows: Sequence[int] = DEFAULT_WINDOWS) -> DataFrame:
        """``analyze_accuracies`` and ``analyze_covs`` side by side, scored once."""
        return reports.industry_sweep(self.score_and_predict(windows=windows), self.symbols)

    def series(self, symbols: Iterable[str] | None = None,
               window: int = DEFAULT_WINDOW) -> DataFrame:
        return reports.series(self.score_and_predict(symbols, [window]))

    def sentiment_distribution(self, symbols: Iterable[str] | None = None,
                               window: int = DEFAULT_WINDOW) -> DataFrame:
        return reports.sentiment_distribution(self.score_and_predict(symbols, [window]))

    def corpus_state(self) -> DataFrame:
        """Counts and sketches per symbol: the stored ones, else made from the articles."""
        return corpus.corpus_state(self.articles) if self._state is None else self._state

    def corpus_stats(self, approximate: bool = False) -> DataFrame:
        """Exact, or (``approximate``) from ``corpus_state``, without reading articles where it is
        stored; only the number of sources is estimated."""
        if approximate:
            return corpus.corpus_stats_of(self.corpus_state())
        return corpus.corpus_stats(self.articles)

    def top_sources(self, k: int = 10, approximate: bool = False) -> DataFrame:
        if approximate:
            return corpus.top_sources_of(self.corpus_state(), k)
        return corpus.top_sources(self.articles, k)

    def source_weights(self) -> DataFrame:
        return corpus.source_weights(self.articles)

    def sample_articles(self, n: int = 10, seed: int = 42) -> DataFrame:
        return corpus.sample_articles(self.articles, n, seed, unique=self.unique)

    def save_sample(self, path: str, n: int = 10, seed: int = 42) -> None:
        write_csv(self.sample_articles(n, seed), path)

    def save(self, root: str, layout: str = "symbol", buckets: int = BUCKETS) -> None:
        """Save all tables as a new version under ``root``, so that a later session reads scored
        articles. The version takes effect as a whole, when its last table is written.

        ``layout="symbol"`` keeps a part per symbol and those of other symbols that the version
        before has; ``"bucket"`` hashes the symbols into a fixed number of parts and replaces them
        all. Prices and days are clustered by symbol into ``buckets`` files.
        """
        others = layout == "symbol"
        # once stored, Spark sees how few symbols are, and texts need not be moved to meet them
        symbols = written(self.symbols.select("symbol").distinct(), "symbols")
        articles = unique_links(keep_symbols(self._given, symbols), self._copies)
        with new_version(self.symbols.sparkSession, root) as version:
            version.write("articles", articles, layout, unique=self.unique)
            # sentiments are made and links are proved unique once: what follows reads what was written
            articles = version.read("articles", parts=version.written_parts("articles"))
            version.write("links", day_links(articles), layout)
            version.write(CORPUS, corpus.corpus_state(articles), layout)
            for name in ("instruments", "search_results"):
                if (df := getattr(self, name)) is not None:
                    version.write(name, df, layout)
                elif not others:
                    version.drop(name)
            version.write_clustered("prices", self.prices, buckets=buckets, others=others)
            version.write_clustered("days", count_timeline(self.prices, articles),
                                    buckets=buckets, others=others)
