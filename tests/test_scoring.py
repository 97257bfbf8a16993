"""Timeline, lag bands, fill and reports."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from newstide import NewsEngine, schemas
from newstide.operators import scoring, timeline as tl
from newstide.plans import reports

MONDAY = dt.date(2024, 1, 1)


def day(n: int) -> dt.date:
    return MONDAY + dt.timedelta(days=n)


def prices_of(spark, rows):
    """rows: (symbol, day number, open, close)"""
    full = [(s, day(d), o, max(o, c), min(o, c), c, 1) for s, d, o, c in rows]
    return spark.createDataFrame(full, schemas.PRICES)


def articles_of(spark, rows):
    """rows: (symbol, day number, link, href, title sentiment, text sentiment)"""
    full = []
    for s, d, link, href, title, text in rows:
        source = None if href is None else (href, "x")
        at = dt.datetime.combine(day(d), dt.time(9))
        full.append((s, at, day(d), "t", link, source, link, "x", title, text))
    return spark.createDataFrame(full, schemas.ARTICLES)


def counts_of(spark, rows):
    """rows: (symbol, day number, change, n_links, n_resolved, sum, n); both channels alike"""
    full = [(s, day(d), 1.0, 1.0, c, l, r, x, n, x, n) for s, d, c, l, r, x, n in rows]
    return spark.createDataFrame(
        full, "symbol STRING, date DATE, open DOUBLE, close DOUBLE, change DOUBLE, n_links BIGINT, "
              "n_resolved BIGINT, title_sum BIGINT, title_n BIGINT, text_sum BIGINT, text_n BIGINT")


def random_counts(spark, seed: int):
    """Gapped timelines of a few symbols with missing sentiments and unresolved links."""
    rng, rows = random.Random(seed), []
    for s in range(4):
        for d in range(45):
            if rng.random() < 0.65:
                links = rng.choice([0, 0, 1, 2, 5])
                resolved = links - (rng.random() < 0.15 and links > 0)
                n = resolved - (rng.random() < 0.15 and resolved > 0)
                total = sum(rng.randrange(101) for _ in range(n))
                rows.append((f"s{s}", d, rng.uniform(-2, 2), links, resolved, total, n))
    return counts_of(spark, rows)


@pytest.mark.parametrize("policy", ["poison", "skip"])
def test_frames_equal_lagged_joins(spark, policy):
    counts = random_counts(spark, 7).cache()
    windows = list(range(16))
    banded = scoring.band_scores(counts, windows, policy).cache()
    for w in windows:
        columns = ["symbol", "date", f"article_count_{w}", f"title_score_{w}", f"text_score_{w}"]
        joined = scoring.band_scores_by_join(counts, w, policy)
        assert sorted(map(tuple, banded.select(*columns).collect()), key=str) == \
            sorted(map(tuple, joined.select(*columns).collect()), key=str), w


def test_band_by_hand(spark):
    # w = 7 looks 4..10 days back; day 20 sees days 10..16
    rows = [("a", 9, 0.0, 1, 1, 100, 1), ("a", 10, 0.0, 2, 2, 60, 2), ("a", 16, 0.0, 1, 1, 30, 1),
            ("a", 17, 0.0, 1, 1, 100, 1), ("a", 20, 0.0, 1, 1, 100, 1)]
    got = scoring.band_scores(counts_of(spark, rows), [7]).where("day = 19743").first()
    assert day(20) == got.date
    assert (got.article_count_7, got.text_score_7) == (3, 30.0)


@pytest.mark.parametrize("window, count, score", [(0, 9, 80.0), (1, 7, 520 / 7), (2, 5, 64.0)])
def test_folded_lags_repeat_the_day(spark, window, count, score):
    # two articles of 90 on the day, one of 10 or 20 before
    rows = [("a", 10, 0.0, 1, 1, 20 if window == 1 else 0, 1), ("a", 11, 0.0, 2, 2, 160, 2)]
    got = scoring.band_scores(counts_of(spark, rows), [window]).where(
        F.col("date") == day(11)).first()
    repeats = {0: 4, 1: 3, 2: 2}[window]
    total = repeats * 160 + (20 if window == 1 else 0)
    assert got[f"article_count_{window}"] == 2 * repeats + 1 == count
    assert got[f"text_score_{window}"] == pytest.approx(total / count)


def test_poison_and_skip(spark):
    # day 4 resolved two articles, one without sentiment; day 5 has one link without source
    rows = [("a", 4, 0.0, 2, 2, 80, 1), ("a", 5, 0.0, 1, 0, 0, 0), ("a", 8, 0.0, 0, 0, 0, 0)]
    counts = counts_of(spark, rows)
    pick = F.col("date") == day(8)
    poison = scoring.band_scores(counts, [3]).where(pick).first()
    skip = scoring.band_scores(counts, [3], "skip").where(pick).first()
    assert (poison.article_count_3, poison.text_score_3) == (3, None)
    assert (skip.article_count_3, skip.text_score_3) == (3, 80.0)
    with pytest.raises(ValueError):
        scoring.band_scores(counts, [3], "other")


def test_unresolved_links_count_but_do_not_score(spark):
    prices = prices_of(spark, [("a", 0, 1.0, 1.0), ("a", 4, 1.0, 1.0)])
    articles = articles_of(spark, [("a", 0, "l1", "src", 80, 80), ("a", 0, "l2", None, 0, 0)])
    got = scoring.band_scores(tl.count_timeline(prices, articles), [3]).where(
        F.col("date") == day(4)).first()
    assert (got.article_count_3, got.text_score_3) == (2, 80.0)


def test_fill_modes(spark):
    df = spark.createDataFrame(
        [("a", day(d), 19723 + d, s) for d, s in
         [(0, 70.0), (3, None), (4, None), (5, None), (8, 20.0), (9, None), (10, None), (13, None)]],
        "symbol STRING, date DATE, day INT, text_score_7 DOUBLE").withColumn(
            "title_score_7", F.lit(None).cast("double"))

    def filled(**kw):
        return [r.text_score_7 for r in scoring.fill_scores(df, [7], **kw).orderBy("date").collect()]

    # fills read the original column: day 5 is five days from the only score and stays neutral
    assert filled() == [70.0, 70.0, 50.0, 50.0, 20.0, 20.0, 20.0, 50.0]
    assert filled(limit=5) == [70.0, 70.0, 70.0, 70.0, 20.0, 20.0, 20.0, 20.0]
    assert filled(limit=0) == filled(fill="neutral") == [70.0, 50, 50, 50, 20.0, 50, 50, 50]
    assert filled(fill="none") == [70.0, None, None, None, 20.0, None, None, None]
    with pytest.raises(ValueError):
        filled(fill="guess")


def test_timeline_keeps_price_days_and_drops_weekend_news(spark):
    prices = prices_of(spark, [("a", 0, 10.0, 11.0), ("a", 1, 0.0, 1.0), ("b", 0, 4.0, 3.0)])
    articles = articles_of(spark, [("a", 0, "z", "s", 1, 1), ("a", 0, "y", "s", 1, 1),
                                   ("a", 5, "weekend", "s", 1, 1), ("c", 0, "other", "s", 1, 1)])
    got = tl.build_timeline(prices, articles).orderBy("symbol", "date").collect()
    assert [(r.symbol, r.date, r.change, r.n_links) for r in got] == [
        ("a", day(0), 10.0, 2), ("a", day(1), None, 0), ("b", day(0), -25.0, 0)]
    links = tl.day_links(articles).where("symbol = 'a'").orderBy("date", "position").collect()
    assert [(r.date, r.position, r.link) for r in links] == [
        (day(0), 1, "y"), (day(0), 2, "z"), (day(5), 1, "weekend")]


def test_nan_prices_become_null(spark):
    prices = prices_of(spark, [("a", 0, math.nan, 11.0)])
    assert tl.trading_days(prices).first().asDict() == {
        "symbol": "a", "date": day(0), "open": None, "close": 11.0, "change": None}


def test_duplicate_links(spark):
    articles = articles_of(spark, [("a", 3, "l", "s", 1, 1), ("a", 2, "l", "s", 2, 2),
                                   ("b", 2, "l", "s", 3, 3)])
    assert [tuple(r) for r in tl.duplicate_keys(articles, "symbol", "link").collect()] == [
        ("a", "l", 2)]
    kept = tl.drop_duplicate_links(articles)
    assert kept.columns == articles.columns
    assert sorted((r.symbol, r.text_sentiment) for r in kept.collect()) == [("a", 2), ("b", 3)]


@pytest.fixture(scope="module")
def engine(spark):
    """One symbol by hand (b has a single day), w = 3: lags 0..6."""
    symbols = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "a")], schemas.SYMBOLS)
    prices = prices_of(spark, [
        ("a", 0, 100.0, 101.0), ("a", 1, 100.0, 100.0), ("a", 10, 100.0, 99.0),
        ("a", 11, 100.0, 102.0), ("b", 0, 100.0, 100.1), ("unlisted", 0, 1.0, 1.0)])
    articles = articles_of(spark, [
        ("a", 0, "l1", "s", 80, 20), ("a", 10, "l2", "s", 40, 90), ("a", 11, "l3", "s", 40, 90)])
    return NewsEngine(symbols, prices, articles)


def test_score_and_predict(engine):
    got = engine.score_and_predict(windows=[3]).orderBy("symbol", "date").collect()
    assert [(r.symbol, r.title_score, r.title_prediction, r.title_result, r.text_prediction,
             r.text_result) for r in got] == [
        ("a", 80.0, "buy", 1, "sell", 0), ("a", 80.0, "buy", 0, "sell", 0),
        ("a", 40.0, "sell", 1, "buy", 0), ("a", 40.0, "sell", 0, "buy", 1),
        ("b", 50.0, "hold", 1, "hold", 1)]


def test_accuracy(engine):
    got = {r.symbol: r.asDict() for r in engine.analyze_accuracy(window=3).collect()}
    assert got["a"] == {
        "symbol": "a", "window": 3, "title_pos_accuracy": 0.5, "title_neg_accuracy": 0.5,
        "title_hold_accuracy": 0.0, "title_accuracy": 0.5, "text_pos_accuracy": 0.5,
        "text_neg_accuracy": 0.0, "text_hold_accuracy": 0.0, "text_accuracy": 0.25}
    assert got["b"]["title_hold_accuracy"] == got["b"]["title_accuracy"] == 1.0
    assert set(got) == {"a", "b"}
    only = engine.analyze_accuracy(["b"], window=3).collect()
    assert [r.symbol for r in only] == ["b"]


def test_industry_accuracy_is_the_mean_of_ratios(engine):
    got = {(r.industry, r.window): r.title_accuracy
           for r in engine.analyze_accuracies([3, 15]).collect()}
    assert got[("x", 3)] == (0.5 + 1.0) / 2
    assert got[("y", 3)] == 0.5
    assert set(got) == {("x", 3), ("y", 3), ("x", 15), ("y", 15)}


def test_sweep_is_both_reports(engine):
    sweep = {(r.industry, r.window): r.asDict() for r in engine.analyze_sweep([3, 7]).collect()}
    for one in (engine.analyze_accuracies([3, 7]), engine.analyze_covs([3, 7])):
        for r in one.collect():
            for name, value in r.asDict().items():
                assert sweep[r.industry, r.window][name] == pytest.approx(value), name


def test_reports_on_articles_keep_to_the_symbols(spark):
    """The engine of symbol a knows nothing of the articles of zzz."""
    articles = articles_of(spark, [("a", 0, "l1", "s", 1, 1), ("zzz", 0, "l2", "t", 1, 1)])
    engine = NewsEngine(spark.createDataFrame([("x", "a"), ("y", "a")], schemas.SYMBOLS),
                        prices_of(spark, [("a", 0, 1.0, 1.0)]), articles)
    assert tuple(engine.corpus_stats().first()) == (1, 0, 1)
    assert [r.href for r in engine.source_weights().collect()] == ["s"]
    assert [r.link for r in engine.sample_articles().collect()] == ["l1"]


def test_covariance(engine):
    got = {r.symbol: r for r in engine.analyze_cov(window=3).collect()}
    change, title = [10.0, 0.0, -10.0, 20.0], [80.0, 80.0, 40.0, 40.0]
    mean = sum(change) / 4
    expected = sum((c - mean) * (t - 60) for c, t in zip(change, title)) / 3
    assert got["a"].price_title == pytest.approx(expected)
    assert got["b"].price_title is None
    sums = {r.industry: r.price_title for r in engine.analyze_covs([3]).collect()}
    assert sums["x"] is None and sums["y"] == pytest.approx(expected)


def test_series_and_distribution(engine):
    points = engine.series(["a"], window=3).collect()
    assert len(points) == 4 * 3
    assert {(r.date, r.value) for r in points if r.series == "open"} == {
        (day(d), 100.0) for d in (0, 1, 10, 11)}
    bins = {(r.symbol, r.channel, r.bin): r.n
            for r in engine.sentiment_distribution(window=3).collect()}
    assert bins == {("a", "title", 9): 2, ("a", "title", 5): 2, ("a", "text", 3): 2,
                    ("a", "text", 10): 2, ("b", "title", 6): 1, ("b", "text", 6): 1}


def test_full_score_falls_into_the_last_bin(spark):
    scored = spark.createDataFrame([("a", 7, 100.0, 0.0)],
                                   "symbol STRING, window INT, title_score DOUBLE, text_score DOUBLE")
    got = {(r.channel, r.bin) for r in reports.sentiment_distribution(scored).collect()}
    assert got == {("title", 10), ("text", 1)}


def random_days(spark, seed, n=45):
    rng = random.Random(seed)
    rows = []
    for symbol in ("a", "b"):
        for k in range(n):
            if rng.random() < 0.7:
                links = rng.choice([0, 0, 1, 3])
                resolved = links - (links > 1)
                known = max(resolved - (rng.random() < 0.2), 0)
                rows.append((symbol, day(k), 100.0, 100 + rng.uniform(-1, 1), rng.uniform(-1, 1),
                             links, resolved, 10 * known, known, 60 * known, known))
    return spark.createDataFrame(rows, schemas.DAYS)


@pytest.mark.parametrize("fill, limit", [("lookback", 3), ("neutral", 3), ("lookback", 0)])
def test_scores_brought_up_to_date_equal_full_scores(spark, fill, limit):
    """Appended days, and changed days in the middle, for every window of 0 to 15 days."""
    windows, rules = list(range(16)), {"fill": fill, "limit": limit}
    before = random_days(spark, 1).cache()
    changed = before.withColumn("text_sum", F.when(
        F.col("date").between(day(17), day(19)), F.col("text_n") * 90).otherwise(F.col("text_sum")))
    full = {r: None for r in map(repr, scoring.score_and_predict(changed, windows, **rules)
                                 .drop(*tl.COUNTERS).collect())}
    for stored, first, last in (
            (scoring.score_and_predict(changed.where(F.col("date") < day(30)), windows, **rules),
             day(30), None),
            (scoring.score_and_predict(before, windows, **rules), day(17), str(day(19)))):
        found = scoring.updated_scores(stored, changed, first, last, windows, **rules)
        assert sorted(map(repr, found.drop(*tl.COUNTERS).collect())) == sorted(full)


def test_rescoring_reads_the_days_of_its_horizon_only(spark, tmp_path):
    random_days(spark, 2).write.parquet(str(tmp_path / "days"))
    stored = spark.read.schema(schemas.DAYS).parquet(str(tmp_path / "days"))
    assert scoring.horizon([3, 7]) == 13 and scoring.horizon([0], "neutral") == 3
    near = scoring.rescored_days(stored, day(30), day(31), [7])
    text = near._jdf.queryExecution().executedPlan().toString()
    assert f"GreaterThanOrEqual(date,{day(17)})" in text
    assert f"LessThanOrEqual(date,{day(44)})" in text
    assert {r.date for r in near.collect()} <= {day(k) for k in range(30, 45)}


def test_states_merge_and_retract(spark):
    scored = scoring.score_and_predict(random_days(spark, 3), [3, 7]).cache()
    parts = [reports.report_state(scored.where(F.dayofmonth("date") % 4 == k)) for k in range(4)]
    whole = reports.merge_states(*parts)

    def close(a, b):
        left, right = ({(r.symbol, r.window): r for r in df.collect()} for df in (a, b))
        assert set(left) == set(right)
        for key in left:
            for name in [*reports.ACCURACIES, *reports.COVARIANCES]:
                assert left[key][name] == pytest.approx(right[key][name], abs=1e-9)

    full = reports.reports_of(reports.report_state(scored))
    close(reports.reports_of(whole), full)
    expected = reports.accuracy(scored).join(reports.covariance(scored), ["symbol", "window"])
    close(full, expected)
    rest = scored.where("dayofmonth(date) % 4 <> 2")
    close(reports.reports_of(reports.retract_state(whole, parts[2])),
          reports.reports_of(reports.report_state(rest)))
    symbols = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "a")], schemas.SYMBOLS)
    sweep = {(r.industry, r.window): r for r in reports.industry_sweep(scored, symbols).collect()}
    for row in reports.industry_reports_of(whole, symbols).collect():
        for name in [*reports.ACCURACIES, *reports.COVARIANCES]:
            assert row[name] == pytest.approx(sweep[row.industry, row.window][name], abs=1e-9)
    # nothing left: no accuracy, no covariance
    gone = reports.reports_of(reports.retract_state(whole, whole)).collect()
    assert {r.price_text for r in gone} == {None} and {r.text_accuracy for r in gone} == {0.0}


def test_survivors_of_scores_are_those_of_whole_rows(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.choice([0, 1, 1]), rng.choice(["l", "m", None]),
             rng.choice(["s", "t", None]), rng.choice([1, 2, None]), rng.choice([3, 4]))
            for _ in range(60)]
    articles = articles_of(spark, rows)
    slim = ["symbol", "link", "date", "source.href", "title_sentiment", "text_sentiment"]
    whole = tl.drop_duplicate_links(articles).select(*slim).collect()
    assert sorted(map(repr, whole)) == sorted(
        map(repr, tl.scored_survivors(articles).select(*slim).collect()))
    assert len([r for r in whole if r.link is None]) == len([r for r in rows if r[2] is None])
