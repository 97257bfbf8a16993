"""Accuracy, covariance and series reports over scored timelines.

Every report takes what ``score_and_predict`` returns. Per-symbol reports group by
(symbol, window) on rows the scoring windows already hash by symbol, so they add no shuffle.
"""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from newstide.functions.sentiment import CHANNELS
from newstide.functions.signals import has_prediction, safe_ratio

CLASSES = {"pos": "buy", "neg": "sell", "hold": "hold"}
ACCURACIES = [f"{c}_{m}" for c in CHANNELS
              for m in ("pos_accuracy", "neg_accuracy", "hold_accuracy", "accuracy")]
COVARIANCES = {"price_title": ("change", "title_score"),
               "price_text": ("change", "text_score"),
               "title_text": ("title_score", "text_score")}
SERIES = ("open", "title_score", "text_score")
HISTOGRAM_BINS = 10


def _counters() -> list[str]:
    counters = []
    for c in CHANNELS:
        for name, label in CLASSES.items():
            hit = f"{c}_prediction = '{label}'"
            counters += [f"count_if({hit}) AS {c}_{name}_n",
                         f"count_if({hit} AND {c}_result = 1) AS {c}_{name}_correct"]
        counters.append(f"count_if({has_prediction(f'{c}_prediction')}) AS {c}_n")
    return counters


def _covariances() -> list[str]:
    return [f"covar_samp(10 * {x}, {y}) AS {name}" for name, (x, y) in COVARIANCES.items()]


def _ratios() -> list[str]:
    ratios = []
    for c in CHANNELS:
        ratios += [f"{safe_ratio(f'{c}_{k}_correct', f'{c}_{k}_n')} AS {c}_{k}_accuracy"
                   for k in CLASSES]
        right = "(" + " + ".join(f"{c}_{k}_correct" for k in CLASSES) + ")"
        ratios.append(f"{safe_ratio(right, f'{c}_n')} AS {c}_accuracy")
    return ratios


def _means() -> list[str]:
    return [f"avg({a}) AS {a}" for a in ACCURACIES]


def _sums() -> list[str]:
    return [f"CASE WHEN count({c}) = count(*) THEN sum({c}) END AS {c}" for c in COVARIANCES]


def _per(df: DataFrame, keys: tuple[str, ...], measures: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.expr(measure) for measure in measures])


def correct_counts(scored: DataFrame) -> DataFrame:
    """Per (symbol, window), channel and class: days predicted and days right."""
    return _per(scored, ("symbol", "window"), _counters())


def accuracy(scored: DataFrame) -> DataFrame:
    """Eight accuracies per (symbol, window); a class never predicted has accuracy 0."""
    return correct_counts(scored).selectExpr("symbol", "window", *_ratios())


def industry_accuracy(scored: DataFrame, symbols: DataFrame) -> DataFrame:
    """Unweighted mean of the symbols' accuracies per (industry, window)."""
    return _per(accuracy(scored).join(symbols, "symbol"), ("industry", "window"), _means())


def covariance(scored: DataFrame) -> DataFrame:
    """Sample covariances per (symbol, window); NULL with fewer than two usable days."""
    return _per(scored, ("symbol", "window"), _covariances())


def industry_covariance(scored: DataFrame, symbols: DataFrame) -> DataFrame:
    """Sum of the symbols' covariances; NULL as soon as one of them is."""
    return _per(covariance(scored).join(symbols, "symbol"), ("industry", "window"), _sums())


def industry_sweep(scored: DataFrame, symbols: DataFrame) -> DataFrame:
    """Accuracies and covariances per (industry, window) from one pass over the scored days."""
    both = (_per(scored, ("symbol", "window"), _counters() + _covariances())
            .selectExpr("symbol", "window", *_ratios(), *COVARIANCES))
    return _per(both.join(symbols, "symbol"), ("industry", "window"), _means() + _sums())


def report_state(scored: DataFrame) -> DataFrame:
    """What accuracies and covariances are made from, per (symbol, window): counters, and of each
    covariance the number of pairs, both means and the sum of products of deviations.

    States of disjoint sets of days can be merged, and taken out again, without those days.
    """
    moments = []
    for name, (x, y) in COVARIANCES.items():
        pair = f"FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
        moments.append(
            f"named_struct('n', count(*) {pair}, 'x', coalesce(avg(10 * {x}) {pair}, 0D), "
            f"'y', coalesce(avg({y}) {pair}, 0D), "
            f"'c', coalesce(covar_pop(10 * {x}, {y}), 0D) * count(*) {pair}) AS {name}")
    return _per(scored, ("symbol", "window"), _counters() + moments)


def _counter_names(state: DataFrame) -> list[str]:
    return [c for c in state.columns if c not in ("symbol", "window", *COVARIANCES)]


def _joint(a: str, b: str, sign: int = 1) -> str:
    """Moments of two disjoint sets from their own, or (sign -1) of the first without the second."""
    n = f"({a}.n + {sign} * {b}.n)"

    def mean(z: str) -> str:
        return f"coalesce(try_divide({a}.n * {a}.{z} + {sign} * {b}.n * {b}.{z}, {n}), 0D)"

    # of the parts of the larger set: their sums of products and what lies between their means
    inner = (f"({a}.x - {b}.x) * ({a}.y - {b}.y) * try_divide({a}.n * {b}.n, {n})")
    return (f"named_struct('n', {n}, 'x', {mean('x')}, 'y', {mean('y')}, 'c', CASE WHEN {n} = 0 "
            f"THEN 0D ELSE {a}.c + {sign} * {b}.c + {sign} * coalesce({inner}, 0D) END)")


def merge_states(*states: DataFrame) -> DataFrame:
    """The state of all days of the given states, which share no day. Any number of rows per key:
    rows of a table that several parts have written are merged as well."""
    every = reduce(DataFrame.unionByName, states)
    counters = [f"sum({c}) AS {c}" for c in _counter_names(every)]
    empty = "named_struct('n', 0L, 'x', 0D, 'y', 0D, 'c', 0D)"
    moments = [f"aggregate(collect_list({name}), {empty}, (a, b) -> {_joint('a', 'b')}) AS {name}"
               for name in COVARIANCES]
    return _per(every, ("symbol", "window"), counters + moments)


def retract_state(whole: DataFrame, part: DataFrame) -> DataFrame:
    """The state without the days of ``part``, all of which ``whole`` has; keys without any day
    left stay, with counters of 0."""
    w, p = whole.alias("w"), part.alias("p")
    joined = w.join(p, ["symbol", "window"], "left")
    empty = "named_struct('n', 0L, 'x', 0D, 'y', 0D, 'c', 0D)"
    counters = [f"w.{c} - coalesce(p.{c}, 0L) AS {c}" for c in _counter_names(whole)]
    both = joined.selectExpr("symbol", "window", *counters, *[
        f"w.{name} AS _w_{name}" for name in COVARIANCES], *[
        f"coalesce(p.{name}, {empty}) AS _p_{name}" for name in COVARIANCES])
    return both.selectExpr("symbol", "window", *_counter_names(whole), *[
        f"{_joint(f'_w_{name}', f'_p_{name}', -1)} AS {name}" for name in COVARIANCES])


def reports_of(state: DataFrame) -> DataFrame:
    """Accuracies and sample covariances per (symbol, window) of a state."""
    return state.selectExpr("symbol", "window", *_ratios(), *[
        f"CASE WHEN {name}.n > 1 THEN {name}.c / ({name}.n - 1) END AS {name}"
        for name in COVARIANCES])


def industry_reports_of(state: DataFrame, symbols: DataFrame) -> DataFrame:
    """``industry_sweep`` from a state instead of the scored days."""
    return _per(reports_of(state).join(symbols, "symbol"), ("industry", "window"),
                _means() + _sums())


def series(scored: DataFrame) -> DataFrame:
    """Price and score lines in long form: (symbol, window, date, series, value)."""
    points = ", ".join(f"struct('{s}' AS series, {s} AS value)" for s in SERIES)
    return scored.selectExpr("symbol", "window", "date", f"inline(array({points}))")


def sentiment_distribution(scored: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Histogram of both scores per (symbol, window); a score of 100 falls into the last bin."""
    points = ", ".join(f"struct('{c}' AS channel, {c}_score AS score)" for c in CHANNELS)
    return (scored.selectExpr("symbol", "window", f"inline(array({points}))")
            .where("score IS NOT NULL")
            .selectExpr("symbol", "window", "channel",
                        f"CAST(least(width_bucket(score, 0D, 100D, {bins}L), {bins}) AS INT) AS bin")
            .groupBy("symbol", "window", "channel", "bin").agg(F.count("*").alias("n")))


def date_ordered(df: DataFrame) -> DataFrame:
    """Rows by symbol, window (if any) and date, for output."""
    return df.orderBy(*[k for k in ("symbol", "window", "date") if k in df.columns])
