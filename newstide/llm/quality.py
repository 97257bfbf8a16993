"""Quality by weak supervision, in DataFrame functions only.

Rules vote good (1) or bad (-1) or abstain (0). How often each of them is right, on good texts and on
bad ones, is estimated by expectation-maximisation from their agreement, without labels; the
posterior probability that a text is good takes the place of a filter that wants every rule passed.
A rule that knows one defect is rarely wrong on good texts and often silent about bad ones, so its
bad vote can outweigh many good ones.

The votes of all documents are counted per pattern first (3^9 patterns at most, one row each), so an iteration
looks at that small table only and a hot pattern is one row. Texts are read once: the measures of
each document are written to the shared folder and all the rest starts from them.
"""

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from newstide.llm.common import BLANK_RUN, BLANKS, id_and_text
from newstide.sources.layout import written

# Contract: words in a window, symbols, and the base rules.
WINDOW, SYMBOLS = 8, "#*$%&|<>"
BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"

# A word of letters, with at most one mark at its end.
PLAIN_WORD = r"(?<![^\x20\x09-\x0D])\p{L}+[.,;:!?]?(?![^\x20\x09-\x0D])"

# Rules as (name, good when, bad when) over the measures; anything else abstains.
RULES = [
    ("symbols", "n_symbols <= 0.02 * n_words", "n_symbols > 0.2 * n_words"),
    ("repeats", "n_repeat_words <= 0.05 * n_words", "n_repeat_words > 0.2 * n_words"),
    ("duplicate_lines", "n_dup_lines = 0 AND n_lines > 1", "n_dup_lines > 0.25 * n_lines"),
    ("capitals", "n_upper <= 0.08 * word_chars", "n_upper > 0.4 * word_chars"),
    ("marks", "n_marks <= 0.02 * n_words", "n_marks > 0.3 * n_words"),
    ("variety", "n_distinct >= 4 * sqrt(n_words)", "n_distinct < 2.5 * sqrt(n_words)"),
    ("letters", "n_alnum >= 0.93 * word_chars", "n_alnum < 0.9 * word_chars"),
    ("plain_words", "n_plain >= 0.9 * n_words", "n_plain < 0.75 * n_words"),
    ("word_length", "word_chars BETWEEN 3 * n_words AND 9 * n_words",
     "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
]
# Start of the estimation: share of good texts, and accuracy on good and on bad texts. Then its
# bounds and its end.
START_PRIOR, START_ON_GOOD, START_ON_BAD = 0.8, 0.95, 0.3
PRIOR_BOUNDS, ON_GOOD_BOUNDS, ON_BAD_BOUNDS = (0.05, 0.95), (0.6, 0.999), (0.02, 0.999)
ROUNDS, TOLERANCE = 30, 1e-3
KEEP_FROM = 0.5


def _bound(array: Column, use) -> Column:
    """``use(array)`` with the array computed once, though lambdas inside refer to it."""
    return F.transform(F.array(array), use)[0]


def _repeat_words(hashes: Column) -> Column:
    """Words in windows that occur twice or more, from the array of window hashes.

    Sorted by hash, a repeated window has an equal neighbour. The positions found, in order, cover
    a window each up to the next position. Nothing is compared pair by pair.
    """
    def covered(places: Column) -> Column:
        reach = F.transform(places, lambda at, k: F.least(
            F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - at, F.lit(WINDOW))))
        return F.aggregate(reach, F.lit(0), lambda total, step: total + step)

    def repeated(pairs: Column) -> Column:
        same = F.filter(pairs, lambda pair, k: F.coalesce(
            pair["h"] == F.get(pairs, F.greatest(k - 1, F.lit(0)))["h"], F.lit(False))
            & (k > 0) | F.coalesce(pair["h"] == F.get(pairs, k + 1)["h"], F.lit(False)))
        return _bound(F.sort_array(F.transform(same, lambda pair: pair["i"])), covered)

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _bound(pairs, repeated)


def _word_measures(words: Column) -> Column:
    """Measures that need the words, in one look at the array."""
    starts = F.sequence(F.lit(1), F.size(words) - WINDOW + 1)
    windows = F.transform(starts, lambda at: F.xxhash64(F.slice(words, at, WINDOW)))
    repeats = F.when(F.size(words) > WINDOW, _bound(windows, lambda hashes: F.when(
        F.size(F.array_distinct(hashes)) < F.size(hashes), _repeat_words(hashes))))
    return F.struct(F.size(words).cast("long").alias("n_words"),
                    F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
                    F.coalesce(repeats, F.lit(0)).cast("long").alias("n_repeat_words"))


def _line_measures(lines: Column) -> Column:
    worded = F.filter(lines, lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return _bound(worded, lambda kept: F.struct(
        F.size(kept).cast("long").alias("n_lines"),
        (F.size(kept) - F.size(F.array_distinct(kept))).cast("long").alias("n_dup_lines")))


def _length_without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the measures of every whole text; a null text has none of anything."""
    text = F.col("text")
    trimmed = F.trim(text, F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, BLANK_RUN))
    return (id_and_text(docs, id_col, text_col)
            .select("doc_id", "text", _bound(words, _word_measures).alias("w"),
                    _bound(F.split(text, "\n"), _line_measures).alias("l"))
            .select("doc_id", "w.*", "l.*",
                    _length_without(text, BLANKS).cast("long").alias("word_chars"),
                    (F.length(text) - _length_without(text, SYMBOLS)).cast("long").alias("n_symbols"),
                    F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
                    F.regexp_count(text, F.lit(r"[\p{L}\p{N}]")).cast("long").alias("n_alnum"),
                    F.regexp_count(text, F.lit(PLAIN_WORD)).cast("long").alias("n_plain"),
                    (F.length(text) - _length_without(text, "!?")).cast("long").alias("n_marks")))


def votes(rules: Sequence[tuple[str, str, str]] = RULES) -> dict[str, Column]:
    """A column per rule; texts without words get no votes."""
    return {f"vote_{name}": F.expr(
        f"CASE WHEN n_words = 0 THEN 0 WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END")
        for name, good, bad in rules}


@dataclass(frozen=True)
class Model:
    """Share of good texts, and how often each rule that votes is right on good and on bad ones."""

    prior: float
    on_good: dict[str, float]
    on_bad: dict[str, float]

    def posterior(self) -> Column:
        """Probability of good, from the votes: log odds of the prior plus those of each vote."""
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for vote, right in self.on_good.items():
            for_good = math.log(right / (1 - self.on_bad[vote]))
            for_bad = math.log((1 - right) / self.on_bad[vote])
            odds = odds + F.when(F.col(vote) == 1, for_good).when(F.col(vote) == -1, for_bad
                                                                  ).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))

    def moved(self, before: "Model") -> float:
        """Largest change of any estimate."""
        return max(abs(self.prior - before.prior),
                   *[abs(now[k] - then[k]) for now, then in (
                       (self.on_good, before.on_good), (self.on_bad, before.on_bad)) for k in now])


def _clipped(value, bounds: tuple[float, float], default: float) -> float:
    return default if value is None else min(max(value, bounds[0]), bounds[1])


def estimate(patterns: DataFrame, names: Sequence[str]) -> Model:
    """Expectation-maximisation over a table of vote patterns and their counts ``n``.

    An iteration is one small aggregate. Without any vote the start values stay.
    """
    model = Model(START_PRIOR, dict.fromkeys(names, START_ON_GOOD),
                  dict.fromkeys(names, START_ON_BAD))
    for _ in range(ROUNDS):
        good, bad = F.col("n") * F.col("p"), F.col("n") * (1 - F.col("p"))
        sums = patterns.withColumn("p", model.posterior()).agg(
            (F.sum(good) / F.sum("n")).alias("prior"),
            *[F.try_divide(F.sum(F.when(F.col(v) == 1, good)),
                           F.sum(F.when(F.col(v) != 0, good))).alias(f"good_{v}") for v in names],
            *[F.try_divide(F.sum(F.when(F.col(v) == -1, bad)),
                           F.sum(F.when(F.col(v) != 0, bad))).alias(f"bad_{v}") for v in names]
        ).first()
        before, model = model, Model(
            _clipped(sums["prior"], PRIOR_BOUNDS, model.prior),
            {v: _clipped(sums[f"good_{v}"], ON_GOOD_BOUNDS, model.on_good[v]) for v in names},
            {v: _clipped(sums[f"bad_{v}"], ON_BAD_BOUNDS, model.on_bad[v]) for v in names})
        if model.moved(before) < TOLERANCE:
            break
    return model


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row per row of ``docs``: doc_id, measures, votes, p_good, base_failed and kept.

    ``kept`` is false where the base rules fail, else whether the posterior reaches 1/2. Null and
    empty texts have no words and fail. Repeated rows are judged each; an empty table gives an
    empty result.
    """
    measured = written(measures(docs, id_col, text_col).withColumns(votes(rules)), "quality")
    names = list(votes(rules))
    patterns = written(measured.where("n_words > 0").groupBy(*names)
                       .agg(F.count("*").alias("n")).coalesce(1), "votes")
    model = estimate(patterns, names)
    return (measured.withColumn("p_good", model.posterior())
            .withColumn("base_failed", F.expr(BASE_FAILED))
            .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= KEEP_FROM)))
