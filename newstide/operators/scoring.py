"""Lag-band scores for many window lengths in one pass.

All frames of all window lengths and both channels share one partitioning (symbol) and one
order (day number): one shuffle and one sort. A window partition has at most one row per
calendar day of the symbol's history, because articles are summed per day before.
"""

from collections import Counter
from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, functions as F

from newstide.functions.sentiment import CHANNELS
from newstide.functions.signals import NEUTRAL_SCORE, band_lags, classify, grade
from newstide.operators.timeline import COUNTERS

DEFAULT_WINDOW = 7
DEFAULT_WINDOWS = (3, 7, 11, 15)
FILL_LIMIT = 3
MEASURES = ("article_count", *(f"{c}_score" for c in CHANNELS))


def _over(oldest: int, newest: int) -> str:
    """Frame from ``oldest`` to ``newest`` calendar days back."""
    return ("OVER (PARTITION BY symbol ORDER BY day "
            f"RANGE BETWEEN {oldest} PRECEDING AND {newest} PRECEDING)")


def _band_sum(counter: str, window: int) -> str:
    """Sum of a day counter over the lag band. Folded lags (window < 3) repeat the own day."""
    total = f"coalesce(sum({counter}) {_over(window + 3, max(window - 3, 0))}, 0L)"
    repeats = max(3 - window, 0)
    return f"{total} + {repeats} * {counter}" if repeats else total


def _mean(total: str, n: str, resolved: str, null_policy: str) -> str:
    """One missing sentiment makes the band missing under 'poison' and is left out by 'skip'."""
    usable = {"poison": f"{n} > 0 AND {n} = {resolved}", "skip": f"{n} > 0"}
    if null_policy not in usable:
        raise ValueError(f"null_policy must be 'poison' or 'skip', not {null_policy!r}")
    return f"CASE WHEN {usable[null_policy]} THEN CAST({total} AS DOUBLE) / {n} END"


def band_scores(timeline: DataFrame, windows: Sequence[int] = DEFAULT_WINDOWS,
                null_policy: str = "poison") -> DataFrame:
    """Add ``article_count_w`` and ``{title,text}_score_w`` for every window length w."""
    for w in windows:
        band_lags(w)
    kept = [c for c in timeline.columns if c not in COUNTERS]
    sums = [f"{_band_sum(c, w)} AS _{c}_{w}" for w in windows for c in COUNTERS]
    scores = []
    for w in windows:
        scores.append(f"_n_links_{w} AS article_count_{w}")
        scores += [_mean(f"_{c}_sum_{w}", f"_{c}_n_{w}", f"_n_resolved_{w}", null_policy)
                   + f" AS {c}_score_{w}" for c in CHANNELS]
    return (timeline.withColumn("day", F.unix_date("date"))
            .selectExpr(*kept, "day", *sums).selectExpr(*kept, "day", *scores))


def band_scores_by_join(timeline: DataFrame, window: int,
                        null_policy: str = "poison") -> DataFrame:
    """The same for one window by its definition: an equi-join on each lagged day.

    Seven times the rows and a shuffle more than the frame; kept as the check of the frames.
    """
    lags = ", ".join(f"struct({lag} AS lag, {times} AS times)"
                     for lag, times in Counter(band_lags(window)).items())
    seen = (timeline.selectExpr("symbol", "date AS _day", *COUNTERS, f"inline(array({lags}))")
            .selectExpr("symbol", "date_add(_day, lag) AS date",
                        *[f"{c} * times AS {c}" for c in COUNTERS])
            .groupBy("symbol", "date").agg(*[F.sum(c).alias(c) for c in COUNTERS]))
    kept = [c for c in timeline.columns if c not in COUNTERS]
    return timeline.select(*kept).join(seen, ["symbol", "date"], "left").selectExpr(
        *kept, f"coalesce(n_links, 0L) AS article_count_{window}",
        *[_mean(f"{c}_sum", f"{c}_n", "n_resolved", null_policy) + f" AS {c}_score_{window}"
          for c in CHANNELS])


def latest_score(name: str, limit: int = FILL_LIMIT) -> str:
    """The most recent score of the ``limit`` previous calendar days (an as-of look-up)."""
    return f"last_value({name}) IGNORE NULLS {_over(limit, 1)}"


def fill_scores(scored: DataFrame, windows: Sequence[int] = DEFAULT_WINDOWS,
                fill: str = "lookback", limit: int = FILL_LIMIT) -> DataFrame:
    """Replace missing scores.

    'lookback' takes the latest score of the ``limit`` previous calendar days, then the neutral
    one; 'neutral' takes the neutral one at once; 'none' leaves them missing.
    """
    if fill not in ("lookback", "neutral", "none"):
        raise ValueError(f"fill must be 'lookback', 'neutral' or 'none', not {fill!r}")
    if fill == "none":
        return scored
    names = [f"{c}_score_{w}" for c in CHANNELS for w in windows]
    kept = [c for c in scored.columns if c not in names]

    def filled(name: str) -> str:
        earlier = f"{latest_score(name, limit)}, " if fill == "lookback" and limit > 0 else ""
        return f"coalesce({name}, {earlier}{NEUTRAL_SCORE}D) AS {name}"

    return scored.selectExpr(*kept, *[filled(name) for name in names])


def unpivot_windows(scored: DataFrame, windows: Sequence[int] = DEFAULT_WINDOWS) -> DataFrame:
    """One row per window length instead of one column set."""
    wide = {f"{m}_{w}" for m in MEASURES for w in windows}
    kept = [c for c in scored.columns if c not in wide and c != "day"]
    rows = ", ".join(f"struct({w} AS window, " + ", ".join(f"{m}_{w} AS {m}" for m in MEASURES)
                     + ")" for w in windows)
    return scored.selectExpr(*kept, f"inline(array({rows}))")


def predict_and_grade(scored: DataFrame) -> DataFrame:
    """Add prediction and result of both channels."""
    return (scored
            .selectExpr("*", *[f"{classify(f'{c}_score')} AS {c}_prediction" for c in CHANNELS])
            .selectExpr("*", *[f"{grade(f'{c}_prediction', 'change')} AS {c}_result"
                               for c in CHANNELS]))


def score_and_predict(timeline: DataFrame, windows: Sequence[int] = (DEFAULT_WINDOW,),
                      null_policy: str = "poison", fill: str = "lookback",
                      limit: int = FILL_LIMIT) -> DataFrame:
    """Scores, predictions and results per (symbol, date, window) of a count timeline."""
    windows = list(dict.fromkeys(windows))
    scored = fill_scores(band_scores(timeline, windows, null_policy), windows, fill, limit)
    return predict_and_grade(unpivot_windows(scored, windows))


def horizon(windows: Sequence[int], fill: str = "lookback", limit: int = FILL_LIMIT) -> int:
    """Days after a price day up to which scores depend on it: the band of the longest window, and
    the days a score is filled on."""
    return max(max(band_lags(w)) for w in windows) + (limit if fill == "lookback" else 0)


def _day(day) -> date:
    return date.fromisoformat(day) if isinstance(day, str) else day


def affected_days(first, last=None, windows: Sequence[int] = (DEFAULT_WINDOW,),
                  fill: str = "lookback", limit: int = FILL_LIMIT) -> str:
    """Condition for the days whose scores change with prices or articles of ``first`` to ``last``
    (None: no end)."""
    start = f"date >= DATE '{_day(first)}'"
    if last is None:
        return start
    end = _day(last) + timedelta(horizon(windows, fill, limit))
    return f"{start} AND date <= DATE '{end}'"


def rescored_days(days: DataFrame, first, last=None, windows: Sequence[int] = (DEFAULT_WINDOW,),
                  null_policy: str = "poison", fill: str = "lookback",
                  limit: int = FILL_LIMIT) -> DataFrame:
    """Scores of the days that change with prices or articles of ``first`` to ``last``.

    Reads the price days within the horizon of these alone; the dates are plain filters, which a
    stored table of days is scanned with.
    """
    reach = horizon(windows, fill, limit)
    near = days.where(f"date >= DATE '{_day(first) - timedelta(reach)}'")
    if last is not None:
        near = near.where(f"date <= DATE '{_day(last) + timedelta(reach)}'")
    scored = score_and_predict(near, windows, null_policy, fill, limit)
    return scored.where(affected_days(first, last, windows, fill, limit))


def updated_scores(scored: DataFrame, days: DataFrame, first, last=None,
                   windows: Sequence[int] = (DEFAULT_WINDOW,), **rules) -> DataFrame:
    """Stored scores after a change: those of other days as they are, the affected ones anew.

    ``scored`` has the same windows and rules, ``days`` is the state after the change."""
    reach = {k: v for k, v in rules.items() if k in ("fill", "limit")}
    same = scored.where(f"NOT ({affected_days(first, last, windows, **reach)})")
    return same.unionByName(rescored_days(days, first, last, windows, **rules))
