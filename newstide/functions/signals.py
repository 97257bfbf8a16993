"""Scalar rules: price change, prediction, outcome and small helpers."""

from newstide.functions import literal

# Edges of the neutral score band, of the neutral price move (in percent), the
# score that stands for "no news", and the length above which an article counts as having text.
HOLD_LOW, HOLD_HIGH = 45.0, 55.0
MOVE = 0.25
NEUTRAL_SCORE = 50.0
MIN_TEXT_LENGTH = 200


def nan_to_null(value: str) -> str:
    return f"CASE WHEN NOT isnan({value}) THEN {value} END"


def day_change(open_: str, close: str) -> str:
    """Percent move of a day; NULL when the open is 0 or missing."""
    return f"try_divide(100 * ({close} - {open_}), {open_})"


def classify(score: str) -> str:
    """'' / hold / buy / sell. Missing, 0 and the exact edges give ''."""
    return (f"CASE WHEN {score} IS NULL OR isnan({score}) OR {score} = 0 THEN '' "
            f"WHEN {score} > {HOLD_LOW}D AND {score} < {HOLD_HIGH}D THEN 'hold' "
            f"WHEN {score} > {HOLD_HIGH}D THEN 'buy' WHEN {score} < {HOLD_LOW}D THEN 'sell' "
            "ELSE '' END")


def grade(prediction: str, change: str) -> str:
    """-1 without a prediction, 1 for a right one, 0 for a wrong one or an unknown change."""
    return (f"CASE WHEN coalesce({prediction}, '') = '' THEN -1 WHEN isnan({change}) THEN 0 "
            f"WHEN {prediction} = 'hold' AND abs({change}) < {MOVE}D THEN 1 "
            f"WHEN {prediction} = 'buy' AND {change} > {MOVE}D THEN 1 "
            f"WHEN {prediction} = 'sell' AND {change} < -{MOVE}D THEN 1 ELSE 0 END")


def has_prediction(prediction: str) -> str:
    return f"coalesce({prediction} <> '', FALSE)"


def safe_ratio(part: str, whole: str) -> str:
    return f"coalesce(try_divide(CAST({part} AS DOUBLE), CAST({whole} AS DOUBLE)), 0D)"


def format_day(day: str) -> str:
    return f"coalesce(date_format({day}, 'yyyy-MM-dd'), '')"


def or_empty(value: str) -> str:
    return f"coalesce({value}, '')"


def has_text(text: str) -> str:
    return f"coalesce(length({text}) > {MIN_TEXT_LENGTH}, FALSE)"


# An ISO date with or without a time, its offset, and the day name of a feed date.
ISO_DAY = r"^\s*\d{4}-\d{1,2}-\d{1,2}"
ISO_OFFSET = r":\d{2}(\.\d+)?\s*(Z|UTC|GMT|[+-]\d{1,2}(:?\d{2})?)\s*$"
DAY_NAME = r"^\s*[A-Za-z]+,\s*"
FEED_PATTERNS = ("d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss xx", "d MMM yyyy HH:mm z",
                 "d MMM yyyy HH:mm xx")


def _in_utc(instant: str) -> str:
    return f"convert_timezone(current_timezone(), 'UTC', CAST({instant} AS TIMESTAMP_NTZ))"


def to_published(published: str) -> str:
    """Publication time from ISO text or the style of news feeds; NULL when it is neither.

    ISO needs a whole date, so a bare year is no time. A time with a zone or an offset is turned
    into UTC; one without is taken as written.
    """
    zoned = f"try_to_timestamp(regexp_replace(trim({published}), ' *(UTC|GMT)$', 'Z'))"
    feed_text = f"regexp_replace(trim({published}), {literal(DAY_NAME)}, '')"
    feed = ", ".join(f"try_to_timestamp({feed_text}, {literal(p)})" for p in FEED_PATTERNS)
    return (f"CASE WHEN {published} RLIKE {literal(ISO_DAY)} THEN "
            f"CASE WHEN {published} RLIKE {literal(ISO_OFFSET)} THEN {_in_utc(zoned)} "
            f"ELSE try_cast({published} AS TIMESTAMP_NTZ) END "
            f"ELSE {_in_utc(f'coalesce({feed})')} END")


def source_host(url: str) -> str:
    """Host of a URL in lower case, without user and port: the source key of pages that carry no
    source record."""
    host = literal(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:@]+)")
    return f"nullif(lower(regexp_extract({url}, {host}, 1)), '')"


def bucket_of(day: str, start: str, interval_days: int = 28) -> str:
    """Number of the fetch bucket that holds ``day``."""
    return f"CAST(floor(datediff({day}, {start}) / {interval_days}) AS INT)"


def band_lags(window: int) -> list[int]:
    """Calendar-day lags around ``window``; lags below 0 fold onto the day itself."""
    if window < 0:
        raise ValueError("window must be 0 or more days")
    return [max(window + shift, 0) for shift in range(-3, 4)]
