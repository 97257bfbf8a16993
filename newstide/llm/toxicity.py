"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other. Each has a logistic regression over hashed words and
marks whose further inputs are the log odds of the categories before it. For training these odds are
out-of-fold: a document's come from a model that did not see it, so that a later link learns how
far an earlier one can be trusted.

Every feature of two or more sampled rows is in the fit. Its column is scaled by how unevenly it is
spread over the classes (the log ratio of its smoothed shares), so that the L2 penalty holds common
words back and lets rare telling ones through, at any number of labels.

The models are fitted on a bounded sample of the labelled rows (``sample_rows``, those first in a
hash order of their ids). Every fold of a link is a task of its own and sees that sample only. All
documents are judged where they are read, whole, with the weights as two arrays.
"""

import math
import pickle
import zlib
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from newstide.llm.common import row_of, row_udf
from newstide.sources.layout import written

# Categories of the labels table in the order of the chain. The last decides.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}
# Bounds of the fit: labelled rows, folds, hashed features.
SAMPLE_ROWS, FOLDS, FEATURES = 20_000, 3, 1 << 22
# A feature of a single row says nothing about others. SMOOTHING is added to its rows of each class.
LEAST_ROWS, SMOOTHING = 2, 1.0
# Penalties of scaled features and of earlier odds; Newton steps, steps of the solver in each.
L2, L2_EARLIER, ROUNDS, SOLVER_ROUNDS, TOLERANCE = 2.0, 0.2, 25, 40, 1e-4
# Entries of the sparse table that a pass has as numbers at a time.
BLOCK = 1 << 20
CLIP = 12.0

BEGINNINGS = (6, 4)
PUNCTUATION = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())
_TO_SPACE = bytes(0x20 if b in PUNCTUATION else b for b in range(256))


def features(text: bytes) -> np.ndarray:
    """Hashed features of a whole text: its words without marks, their beginnings, for the forms of
    a word that the sample does not have, and the marks."""
    words = set(text.lower().translate(_TO_SPACE).split())
    words |= {b"\x01" + word[:length] for length in BEGINNINGS for word in words
              if len(word) > length}
    words.update(b"\x00" + bytes([mark]) for mark in PUNCTUATION if mark in text)
    hashes = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % FEATURES
    return np.unique(hashes)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -CLIP, CLIP)))


class Weights:
    """Weights by feature, as arrays in the order of the features."""

    def __init__(self, at: np.ndarray = (), value: np.ndarray = ()):
        self.at, self.value = np.asarray(at, np.int32), np.asarray(value, np.float32)

    def __len__(self) -> int:
        return len(self.at)

    def total(self, found: np.ndarray) -> float:
        if not len(self) or not len(found):
            return 0.0
        place = np.minimum(np.searchsorted(self.at, found), len(self) - 1)
        return float(self.value[place][self.at[place] == found].sum(dtype=float))


@dataclass(frozen=True)
class Link:
    """One classifier: weights by feature, weights of earlier log odds, intercept."""

    weights: Weights
    earlier: list[float]
    intercept: float

    def odds(self, found: np.ndarray, earlier: list[float]) -> float:
        total = self.intercept + sum(w * x for w, x in zip(self.earlier, earlier))
        return float(np.clip(total + self.weights.total(found), -CLIP, CLIP))


def _used(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of ``LEAST_ROWS`` rows and more, in order, and the scale of each.

    Each row has a feature once, so counting needs two small arrays and no list of all entries.
    """
    seen, hits = np.zeros(FEATURES, np.int32), np.zeros(FEATURES, np.int32)
    for row, positive in zip(rows, y):
        seen[row] += 1
        if positive:
            hits[row] += 1
    used = np.nonzero(seen >= LEAST_ROWS)[0]
    hits, misses, n = hits[used], seen[used] - hits[used], y.sum()
    return used, np.abs(np.log((hits + SMOOTHING) / (n + 2 * SMOOTHING))
                        - np.log((misses + SMOOTHING) / (len(y) - n + 2 * SMOOTHING)))


class _Table:
    """Rows by scaled features, earlier odds and a constant: the features sparse, by row."""

    def __init__(self, rows: list[np.ndarray], used: np.ndarray, scale: np.ndarray,
                 earlier: np.ndarray):
        number = np.full(FEATURES, -1, np.int32)
        number[used] = np.arange(len(used))
        places = [at[at >= 0] for at in (number[row] for row in rows)]
        self.sizes = np.array([len(at) for at in places])
        self.at = np.concatenate(places)
        self.scale, self.features = scale, len(used)
        self.dense = np.column_stack([earlier, np.ones(len(rows))])
        self.blocks, start, begin = [], 0, 0
        ends = np.cumsum(self.sizes)
        while start < len(rows):
            stop = max(int(np.searchsorted(ends, begin + BLOCK, "right")), start + 1)
            self.blocks.append((start, stop, begin, int(ends[stop - 1])))
            start, begin = stop, int(ends[stop - 1])

    def times(self, w: np.ndarray) -> np.ndarray:
        """A number per row."""
        scaled, out = w[:self.features] * self.scale, self.dense @ w[self.features:]
        for start, stop, begin, end in self.blocks:
            row = np.repeat(np.arange(stop - start), self.sizes[start:stop])
            out[start:stop] += np.bincount(row, scaled[self.at[begin:end]], stop - start)
        return out

    def back(self, g: np.ndarray, power: int = 1) -> np.ndarray:
        """A number per column, of the entries raised to ``power``."""
        out = np.zeros(self.features)
        for start, stop, begin, end in self.blocks:
            out += np.bincount(self.at[begin:end], np.repeat(g[start:stop], self.sizes[start:stop]),
                               self.features)
        return np.concatenate([out * self.scale ** power, g @ self.dense ** power])


def fit_link(rows: list[np.ndarray], earlier: np.ndarray, y: np.ndarray) -> Link:
    """Logistic regression with L2 penalty on all features of two or more rows, scaled.

    Without both classes the link predicts the smoothed share of its class and nothing else.
    """
    n, positive = len(y), float(y.sum())
    share = (positive + 0.5) / (n + 1)
    intercept = math.log(share / (1 - share))
    if not 0 < positive < n:
        return Link(Weights(), [0.0] * earlier.shape[1], intercept)
    used, scale = _used(rows, y)
    w = _newton(_Table(rows, used, scale, earlier), y, intercept)
    return Link(Weights(used, w[:len(used)] * scale), w[len(used):-1].tolist(), float(w[-1]))


def _newton(x: _Table, y: np.ndarray, intercept: float) -> np.ndarray:
    """Weights of least penalised log loss; the constant in the last column is not penalised."""
    penalty = np.full(x.features + x.dense.shape[1], L2)
    penalty[x.features:] = L2_EARLIER
    penalty[-1] = 1e-6
    w = np.zeros(len(penalty))
    w[-1] = intercept

    def loss(margin, w):
        return np.logaddexp(0, margin).sum() - y @ margin + penalty @ w ** 2 / 2

    margin = x.times(w)
    now = loss(margin, w)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        slope, curve = x.back(p - y) + penalty * w, p * (1 - p)
        move = _solved(lambda v: x.back(curve * x.times(v)) + penalty * v, slope,
                       x.back(curve, 2) + penalty)
        along, step = x.times(move), 1.0
        while (then := loss(margin - step * along, w - step * move)) > now and step > 1e-3:
            step /= 2
        if then > now:
            break
        w, margin, before, now = w - step * move, margin - step * along, now, then
        if before - now < TOLERANCE * max(before, 1e-9):
            break
    return w


def _solved(times, slope: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
    """Conjugate gradients for times(x) = slope, scaled by the diagonal, to a twentieth."""
    x, rest = np.zeros(len(slope)), slope.copy()
    scaled = rest / diagonal
    way, size = scaled, rest @ scaled
    first = size
    for _ in range(SOLVER_ROUNDS):
        if size <= first * 0.0025:
            break
        turned = times(way)
        x, rest = x + size / (way @ turned) * way, rest - size / (way @ turned) * turned
        scaled = rest / diagonal
        size, before = rest @ scaled, size
        way = scaled + size / before * way
    return x


def _labelled(docs: DataFrame, labels: DataFrame, categories: Mapping[str, str], id_col: str,
              text_col: str, sample_rows: int) -> DataFrame:
    """The sample: id, fold, features and one 0/1 column per category.

    Repeated labels of an id count as positive where any is. Rows without an id or with an unknown
    category are left out of the fit.
    """
    ys = list(categories)
    known = (labels.select(labels["doc_id"].alias("_id"),
                           *[F.expr(rule).cast("int").alias(c) for c, rule in categories.items()])
             .na.drop().groupBy("_id").agg(*[F.max(c).alias(c) for c in ys])
             .withColumn("_draw", F.xxhash64("_id", F.lit("fit")))
             .orderBy("_draw", "_id").limit(sample_rows))

    def make():
        return lambda text: (features(text or b"").tolist(),)

    texts = docs.select(docs[id_col].alias("_doc_id"), docs[text_col].cast("binary").alias("_text"))
    # at most sample_rows rows of a few numbers: bounded, whatever the number of labels
    return (texts.join(F.broadcast(known), F.col("_doc_id") == F.col("_id"))
            .select("_id", F.pmod("_draw", F.lit(FOLDS)).alias("_fold"), *ys,
                    row_udf("found array<int>", make)("_text")["found"].alias("found")))


@dataclass(frozen=True)
class Chain:
    """The links by category, and the log odds from which the last one says yes."""

    links: dict[str, Link]
    threshold: float

    def odds(self, text: bytes) -> tuple[list[float], bool]:
        """Log odds per category, and the verdict of the last."""
        found, odds = features(text), []
        for link in self.links.values():
            odds.append(link.odds(found, odds))
        return odds, odds[-1] > self.threshold


def _best_threshold(odds: np.ndarray, y: np.ndarray) -> float:
    """Log odds of the highest F1 among out-of-fold predictions, midway to the next lower ones."""
    if not len(y) or not y.sum():
        return 0.0
    order = np.argsort(-odds, kind="stable")
    odds, y = odds[order], y[order]
    hits = np.cumsum(y)
    score = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    # only where the odds change can a threshold lie
    score[:-1][odds[:-1] == odds[1:]] = 0
    k = int(np.argmax(score))
    return float((odds[k] + odds[k + 1]) / 2) if k + 1 < len(odds) else float(odds[k])


def _fold_fitter(category: str, earlier: list[str]):
    """Fit of one group: model ``_model`` leaves that fold out and predicts it; the last sees all.

    Gives a row per prediction (``_id``) and, from the last model, one with the ``link``.
    """
    def fit(group: pd.DataFrame) -> pd.DataFrame:
        model = group["_model"].iloc[0]
        out = group["_fold"].to_numpy() == model
        rows = list(group["found"])
        before = group[earlier].to_numpy(float).reshape(len(group), len(earlier))
        link = fit_link([r for r, o in zip(rows, out) if not o], before[~out],
                        group[category].to_numpy(float)[~out])
        odds = [link.odds(r, b.tolist()) for r, b, o in zip(rows, before, out) if o]
        ids = group["_id"].to_numpy()[out]
        last = [pickle.dumps(link)] if model == FOLDS else []
        return pd.DataFrame({"_id": pd.Series([*ids, *[None] * len(last)], dtype=object),
                             "value": odds + [None] * len(last),
                             "link": pd.Series([None] * len(ids) + last, dtype=object)})

    return fit


def fit_chain(docs: DataFrame, labels: DataFrame, categories: Mapping[str, str] = CATEGORIES,
              id_col: str = "doc_id", text_col: str = "text",
              sample_rows: int = SAMPLE_ROWS) -> Chain:
    """Train the links in order, each with the out-of-fold odds of those before it."""
    sample = written(_labelled(docs, labels, categories, id_col, text_col, sample_rows), "sample")
    links: dict[str, Link] = {}
    earlier: list[str] = []
    for category in categories:
        fit = _fold_fitter(category, list(earlier))
        kind = sample.schema["_id"].dataType.simpleString()
        fitted = written(
            sample.withColumn("_model", F.explode(F.sequence(F.lit(0), F.lit(FOLDS))))
            .groupBy("_model").applyInPandas(
                fit, f"_id {kind}, value double, link binary"), "link")
        # a row of two arrays, bounded by the features of the sample
        last = fitted.where("link IS NOT NULL").first()
        links[category] = (pickle.loads(last["link"]) if last
                           else Link(Weights(), [0.0] * len(earlier), -CLIP))
        odds = fitted.where("link IS NULL").select("_id", F.col("value").alias(f"_odds_{category}"))
        sample = written(sample.join(odds, "_id"), "sample")
        earlier.append(f"_odds_{category}")
    # bounded by sample_rows
    seen = sample.select(earlier[-1], list(categories)[-1]).toPandas()
    return Chain(links, _best_threshold(seen.iloc[:, 0].to_numpy(float),
                                        seen.iloc[:, 1].to_numpy(float)))


def _judge(chain: Chain, text):
    names = list(chain.links)

    def make():
        def one(value):
            odds, toxic = chain.odds(value or b"")
            return (*[float(_sigmoid(x)) for x in odds], toxic)
        return one

    schema = ", ".join(f"p_{name} double" for name in names) + ", toxic boolean"
    return row_udf(schema, make)(text.cast("binary"))


def score_toxicity(docs: DataFrame, labels: DataFrame, categories: Mapping[str, str] = CATEGORIES,
                   id_col: str = "doc_id", text_col: str = "text",
                   sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, p_<category> per category, toxic, kept.

    Null and empty texts have no features and get the chain's base odds. Repeated rows are judged
    each; an empty table gives an empty result. Without usable labels nothing is toxic.
    """
    chain = fit_chain(docs, labels, categories, id_col, text_col, sample_rows)
    return (docs.select(docs[id_col].alias("doc_id"), _judge(chain, docs[text_col]).alias("_r"))
            .select("doc_id", "_r.*").withColumn("kept", ~F.col("toxic")))


def drop_toxic(docs: DataFrame, labels: DataFrame, categories: Mapping[str, str] = CATEGORIES,
               id_col: str = "doc_id", text_col: str = "text",
               sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all their columns."""
    chain = fit_chain(docs, labels, categories, id_col, text_col, sample_rows)
    return (docs.select(row_of(docs).alias("row"), _judge(chain, docs[text_col]).alias("judged"))
            .where(~F.col("judged.toxic")).select("row.*"))
