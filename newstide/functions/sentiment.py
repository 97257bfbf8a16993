"""Sentence and document sentiment.

A text is cut into sentences, sentences into tokens; a sentence with at least ``min_tokens``
tokens is valid and gets class 0, 1 or 2 (negative, neutral, positive). The sentiment of the
text is the mean class times 50, cut to an integer; no valid sentence means NULL.

With a lexicon, words are counted with array functions, so a document is scored where it is read: no
shuffle, no Python worker. A trained model plugs in through ``sentence_classifier``. Neither is
built in: which words count, or which model, is for the user to say.
"""

from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from newstide.functions import literal

# The marks that end a sentence or a token.
SENTENCE_END = r"[.!?\n]+"
TOKEN_END = r"[^a-z]+"
MIN_TOKENS = 6

CHANNELS = ("title", "text")


def split_sentences(text: str) -> str:
    return f"split({text}, {literal(SENTENCE_END)})"


def _words(lowered: str) -> str:
    return f"array_remove(split({lowered}, {literal(TOKEN_END)}), '')"


def tokens(sentence: str) -> str:
    return _words(f"lower({sentence})")


def valid_sentences(text: str, min_tokens: int = MIN_TOKENS) -> str:
    return f"filter({split_sentences(text)}, s -> size({tokens('s')}) >= {min_tokens})"


def sentence_class(sentence_tokens: str, lexicon: Mapping[str, int]) -> str:
    """Class of one tokenised sentence by the sign of its summed word polarity."""
    words: dict[int, list[str]] = {}
    for word, polarity in lexicon.items():
        words.setdefault(int(polarity), []).append(literal(word))
    cases = " ".join(f"WHEN word IN ({', '.join(group)}) THEN {polarity}"
                     for polarity, group in words.items())
    polarity = f"CASE {cases} ELSE 0 END" if cases else "0"
    total = f"aggregate({sentence_tokens}, 0, (total, word) -> total + {polarity})"
    return f"CAST(signum({total}) AS INT) + 1"


def mean_class_score(classes: str) -> str:
    """``int(50 * sum / n)`` over an array of classes, NULL for an empty or NULL array."""
    return (f"CAST(aggregate({classes}, named_struct('total', 0L, 'n', 0L), "
            "(acc, c) -> named_struct('total', acc.total + c, 'n', acc.n + 1), "
            "acc -> CASE WHEN acc.n > 0 THEN 50 * acc.total div acc.n END) AS INT)")


def lexicon_sentiment(text: str, lexicon: Mapping[str, int],
                      min_tokens: int = MIN_TOKENS) -> str:
    """Sentiment of a text column in one pass over its sentences."""
    # lower() once per text: no mark of a sentence or token end is a letter
    tokenised = f"transform({split_sentences(f'lower({text})')}, s -> {_words('s')})"
    valid = f"filter({tokenised}, words -> size(words) >= {min_tokens})"
    return mean_class_score(f"transform({valid}, words -> {sentence_class('words', lexicon)})")


def sentence_classifier(load_model: Callable[[], Callable[[list[str]], list[int]]],
                        sentences_per_call: int = 1024):
    """Wrap a model as a vectorised UDF from lists of sentences to lists of classes.

    ``load_model`` runs once per task and returns a function from a list of sentences to a list
    of classes of the same length; another length is an error. The argument is an array of lists,
    one per channel, so that all channels share the model. The sentences of all documents of an
    Arrow batch are classified in calls of ``sentences_per_call``, the last one perhaps shorter.
    """
    lists = pa.list_(pa.list_(pa.int32()))

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
    def classify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load_model()

        def score(sentences: list[str]) -> list[int]:
            classes: list[int] = []
            for at in range(0, len(sentences), sentences_per_call):
                part = sentences[at:at + sentences_per_call]
                found = [int(c) for c in model(part)]
                if len(found) != len(part):
                    raise ValueError(f"{len(found)} classes for {len(part)} sentences")
                classes += found
            return classes

        for batch in batches:
            documents = batch.to_pylist()
            classes = iter(score([s for d in documents for channel in d or [] for s in channel or []]))
            yield pa.array([None if d is None else [
                None if channel is None else [next(classes) for _ in channel] for channel in d]
                for d in documents], lists)

    return classify


def with_sentiment(articles: DataFrame, lexicon: Mapping[str, int] | None = None,
                   classifier=None, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """Set ``title_sentiment`` and ``text_sentiment`` by a lexicon (polarity per word) or a
    ``sentence_classifier``, one of which has to be given; a missing column scores NULL."""
    if (lexicon is None) == (classifier is None):
        raise ValueError("give a lexicon or a classifier")
    articles = articles.drop(*[f"{c}_sentiment" for c in CHANNELS])
    known = [c for c in CHANNELS if c in articles.columns]
    if classifier is None:
        scores = [f"{lexicon_sentiment(c, lexicon, min_tokens)} AS {c}_sentiment" for c in known]
    else:
        sentences = F.array(*[F.expr(valid_sentences(c, min_tokens)) for c in known])
        articles = articles.withColumn("_classes", classifier(sentences))
        scores = [f"{mean_class_score(f'_classes[{k}]')} AS {c}_sentiment"
                  for k, c in enumerate(known)]
    scores += [f"CAST(NULL AS INT) AS {c}_sentiment" for c in CHANNELS if c not in known]
    return articles.selectExpr("*", *scores).drop("_classes")
