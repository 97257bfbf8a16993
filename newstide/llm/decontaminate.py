"""Benchmark decontamination by generalised suffix automata over words.

The words of all test items are put into suffix automata. A training document is streamed through
them: the state after each word gives the longest run of words ending there that some item has too.
Where that run has ``window`` words or more, a window of an item ends; where it holds a whole item
that is shorter than a window, that item ends. Spans follow from the ends, and the state names the
items.

Automata hold at most ``BLOCK_WORDS`` words and are built by tasks. A pass over the documents takes
``BLOCKS_AT_ONCE`` of them, the only data sent to every task; more items mean more passes, never a
larger automaton. One pass is a plain scan without shuffle. Items longer than ``PIECE_WORDS`` are
cut into pieces that overlap by a window less one word, so no window is lost.

Before a document is streamed, runs of adjacent words that no item has side by side are passed over
in bulk: there the automaton would fall back to a run of one word. The filter errs on one side only,
the automaton decides.
"""

import math
import pickle
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from newstide.llm.common import id_and_text, row_of, row_udf
from newstide.sources.layout import written

WINDOW = 10
# Words of an automaton, automata of a pass, words of a piece of an item.
BLOCK_WORDS, BLOCKS_AT_ONCE, PIECE_WORDS = 200_000, 5, 10_000
# Bytes of a text that are split into words at once.
CHUNK = 1 << 20
# Limits of ``remove_contamination``: words of a span that goes, share of a document.
SPAN_WORDS, COVERAGE = 10, 0.5

# Digits, letters and all beyond ASCII are word bytes, A-Z in lower case; all else separates.
_BYTES = bytes(c if c in b"0123456789abcdefghijklmnopqrstuvwxyz" or c > 127 else c + 32
               if 65 <= c <= 90 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

MATCHES = ("n_words bigint, longest int, spans array<struct<start:bigint,stop:bigint>>, "
           "items array<string>")


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, chunk by chunk: no more than a chunk of them are objects at a time."""
    plain = text.translate(_BYTES)
    start = 0
    while start < len(plain):
        stop = plain.find(b" ", start + CHUNK)
        stop = len(plain) if stop < 0 else stop
        yield plain[start:stop].split()
        start = stop


class Automaton:
    """Generalised suffix automaton of word sequences, with the items of each window."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.length, self.link = [0], [-1]
        edges: list[dict[int, int]] = [{}]
        sequences = []
        for item, words in items:
            if words:
                ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
                sequences.append((item, ids))
                state = 0
                for word in ids:
                    state = self._extend(edges, state, word)
        self.size = max(len(self.vocabulary), 1)
        self.edges = {state * self.size + word: to for state, out in enumerate(edges)
                      for word, to in out.items()}
        self._name_states(sequences, edges)
        self.least = min((min(len(ids), window) for _, ids in sequences), default=window)
        self._index_neighbours(sequences)

    def _new(self, edges, length: int, link: int, out: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        edges.append(out)
        return len(edges) - 1

    def _split(self, edges, above: int, word: int, state: int) -> int:
        """A state of its own for the shorter sequences that reach ``state`` from ``above`` on."""
        short = self._new(edges, self.length[above] + 1, self.link[state], dict(edges[state]))
        self.link[state] = short
        while above >= 0 and edges[above].get(word) == state:
            edges[above][word] = short
            above = self.link[above]
        return short

    def _target(self, edges, above: int, word: int) -> int:
        """Where ``word`` leads from ``above``, with nothing longer in the same state."""
        state = edges[above][word]
        return (state if self.length[state] == self.length[above] + 1
                else self._split(edges, above, word, state))

    def _extend(self, edges, last: int, word: int) -> int:
        if word in edges[last]:
            return self._target(edges, last, word)
        new = self._new(edges, self.length[last] + 1, 0, {})
        above = last
        while above >= 0 and word not in edges[above]:
            edges[above][word] = new
            above = self.link[above]
        if above >= 0:
            self.link[new] = self._target(edges, above, word)
        return new

    def _name_states(self, sequences, edges) -> None:
        """``window_of``: the state of the last ``window`` words, per state that has so many.
        ``items_of``: items with that window. ``wholes``: whole short items that end in a state;
        ``whole_of``: the nearest such state on the way to ever shorter sequences."""
        order = sorted(range(1, len(edges)), key=self.length.__getitem__)
        self.window_of: dict[int, int] = {}
        for state in order:
            if self.length[state] >= self.window:
                above = self.link[state]
                self.window_of[state] = (self.window_of[above]
                                         if self.length[above] >= self.window else state)
        self.items_of: dict[int, set] = {}
        self.wholes: dict[int, dict[int, set]] = {}
        for item, ids in sequences:
            state = 0
            for at, word in enumerate(ids, 1):
                state = edges[state][word]
                if at >= self.window:
                    self.items_of.setdefault(self.window_of[state], set()).add(item)
            if len(ids) < self.window:
                self.wholes.setdefault(state, {}).setdefault(len(ids), set()).add(item)
        self.whole_of: dict[int, int] = {}
        for state in order if self.wholes else ():
            near = state if state in self.wholes else self.whole_of.get(self.link[state])
            if near is not None:
                self.whole_of[state] = near

    def _index_neighbours(self, sequences) -> None:
        """A table of bits, set for every two words that are neighbours in an item."""
        pairs = np.unique(np.concatenate([np.zeros(0, np.uint64)] + [
            np.array(ids[:-1], np.uint64) * np.uint64(self.size) + np.array(ids[1:], np.uint64)
            for _, ids in sequences if len(ids) > 1]))
        self.shift = np.uint64(64 - max(10, math.ceil(math.log2(16 * max(len(pairs), 1)))))
        self.neighbours = np.zeros(1 << (64 - int(self.shift)), bool)
        self.neighbours[self._slot(pairs)] = True

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        # an odd multiplier near 2^64 / golden ratio spreads neighbouring numbers
        return (pairs * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def ids_of(self, words: list[bytes]) -> np.ndarray:
        """Numbers of words, -1 for a word no item has."""
        known = self.vocabulary
        return np.fromiter((known.get(w, -1) for w in words), np.int32, len(words))

    def _runs(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches [start, stop) of words outside which no window and no whole item lies."""
        known = ids >= 0
        if self.least > 1:
            usable = known[:-1] & known[1:]
            at = np.flatnonzero(usable)
            pairs = ids[at].astype(np.uint64) * np.uint64(self.size) + ids[at + 1].astype(np.uint64)
            usable[at] = self.neighbours[self._slot(pairs)]
        else:
            usable = known
        edge = np.flatnonzero(np.diff(usable.astype(np.int8), prepend=0, append=0))
        more = 1 if self.least > 1 else 0
        starts, stops = edge[::2], edge[1::2] + more
        long_enough = stops - starts >= self.least
        yield from zip(starts[long_enough].tolist(), stops[long_enough].tolist())

    def find(self, ids: np.ndarray) -> tuple[list[list[int]], set, int]:
        """Spans [start, stop) of hit words in order, items with a hit, longest match in words."""
        spans: list[list[int]] = []
        items: set = set()
        seen: set[int] = set()
        longest = 0

        def hit(start: int, stop: int) -> None:
            while spans and spans[-1][0] >= start:
                spans.pop()
            if spans and spans[-1][1] >= start:
                spans[-1][1] = max(spans[-1][1], stop)
            else:
                spans.append([start, stop])

        for start, stop in self._runs(ids):
            state = size = 0
            for at, word in enumerate(ids[start:stop].tolist(), start + 1):
                to = self.edges.get(state * self.size + word)
                while to is None and state:
                    state = self.link[state]
                    size = self.length[state]
                    to = self.edges.get(state * self.size + word)
                if to is None:
                    continue
                state, size = to, size + 1
                longest = max(longest, size)
                if self.wholes:
                    near = self.whole_of.get(state)
                    while near is not None:
                        for n, whole in self.wholes[near].items():
                            if n <= size:
                                hit(at - n, at)
                                items |= whole
                        near = self.whole_of.get(self.link[near])
                if size >= self.window:
                    hit(at - self.window, at)
                    seen.add(self.window_of[state])
        for window in seen:
            items |= self.items_of[window]
        return spans, items, longest


def _pieces(item: str | None, text: bytes, window: int, piece: int):
    words = [w for part in words_of(text) for w in part]
    for start in range(0, max(len(words) - window + 1, 1), piece):
        part = words[start:start + piece + window - 1]
        if part:
            yield item, part


def build_automata(items: DataFrame, id_col: str = "item_id", text_col: str = "text",
                   window: int = WINDOW, block: int = BLOCK_WORDS,
                   piece: int = PIECE_WORDS) -> DataFrame:
    """Table of automata (id, payload), each of at most ``block`` words and a piece."""
    slim = written(items.select(items[id_col].cast("string").alias("item"),
                                F.coalesce(items[text_col], F.lit("")).cast("binary").alias("text")),
                   "items")
    # a word and its separator are two bytes at least
    size = (slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 2

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(sequences):
            payload = pickle.dumps(Automaton(sequences, window), protocol=5)
            return pa.RecordBatch.from_pydict({"payload": pa.array([payload], pa.large_binary())})

        held, n = [], 0
        for batch in batches:
            for row in range(batch.num_rows):
                item, text = (batch.column(c)[row].as_py() for c in ("item", "text"))
                for one in _pieces(item, text, window, piece):
                    if held and n + len(one[1]) > block:
                        yield out(held)
                        held, n = [], 0
                    held.append(one)
                    n += len(one[1])
        if held:
            yield out(held)

    dealt = slim.repartition(max(1, math.ceil(size / block)))
    return written(dealt.mapInArrow(build, "payload binary")
                   .select(F.monotonically_increasing_id().alias("id"), "payload"), "automata")


def _merged(lists: list[list]) -> list[dict[str, int]]:
    """Union of lists of spans."""
    out: list[dict[str, int]] = []
    for start, stop in sorted(span for spans in lists for span in spans):
        if out and out[-1]["stop"] >= start:
            out[-1]["stop"] = max(out[-1]["stop"], stop)
        else:
            out.append({"start": start, "stop": stop})
    return out


# The automata of the pass that a worker is in; a worker serves many tasks of it.
_LOADED: dict[str, list[Automaton]] = {}


def _matcher(sent):
    """Function of a text that gives the values of ``MATCHES``, for automata in a broadcast."""
    name = uuid.uuid4().hex

    def make():
        if name not in _LOADED:
            _LOADED.clear()
            _LOADED[name] = [pickle.loads(one) for one in sent.value]
        automata = _LOADED[name]

        def match(text: bytes):
            ids: list[list[np.ndarray]] = [[] for _ in automata]
            n = 0
            for words in words_of(text):
                n += len(words)
                for one, parts in zip(automata, ids):
                    parts.append(one.ids_of(words))
            found = [one.find(np.concatenate(parts)) if parts else ([], set(), 0)
                     for one, parts in zip(automata, ids)]
            items = set().union(*[items for _, items, _ in found]) - {None}
            return (n, max((longest for *_, longest in found), default=0),
                    _merged([spans for spans, _, _ in found]), sorted(items))

        return match

    return make


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()),
                                  T.StructField("stop", T.LongType())]))


@F.arrow_udf(SPANS)
def _union_spans(lists: pa.Array) -> pa.Array:
    merged = [_merged([[(s["start"], s["stop"]) for s in spans or []] for spans in row or []])
              for row in lists.to_pylist()]
    return pa.array(merged, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))


def match_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                block: int = BLOCK_WORDS, piece: int = PIECE_WORDS,
                at_once: int = BLOCKS_AT_ONCE,
                carry: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, longest, spans, items.

    ``spans`` are the hit words as [start, stop) in word numbers from 0, merged and in order;
    ``items`` the ids, as strings in order, of the items with an occurring window. A window is
    ``window`` words in a row of one item; an item of fewer words is one window, one of none has
    none. ``longest`` is the longest match found where spans can be (0 elsewhere).

    Null and empty texts have no words; an empty table of documents or items gives no rows or no
    hits. Repeated rows are each looked at. An item without an id hits words but is not named;
    rows that share an id are one item. ``carry`` adds the input row as struct ``row``. With more
    automata than a pass takes, ``docs`` has to be a stored table, as row numbers are taken from it.
    """
    spark = docs.sparkSession
    automata = build_automata(items, item_col, item_text_col, window, block, piece)
    ids = sorted(row["id"] for row in automata.select("id").collect())
    passes = [ids[k:k + at_once] for k in range(0, len(ids), at_once)] or [[]]
    slim = id_and_text(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary"))
    carried = ["row"] if carry else []
    if carry:
        slim = docs.select(docs[id_col].alias("doc_id"), row_of(docs).alias("row"),
                           F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("text"))

    def found(of_pass: list[int]) -> DataFrame:
        payloads = [bytes(row["payload"]) for row in
                    automata.where(F.col("id").isin(of_pass)).select("payload").collect()]
        match = row_udf(MATCHES, _matcher(spark.sparkContext.broadcast(payloads)))
        return slim.withColumn("m", match("text"))

    if len(passes) == 1:
        return found(passes[0]).select("doc_id", "m.*", *carried)
    rid = F.monotonically_increasing_id().alias("rid")
    first = written(found(passes[0]).select(rid, "doc_id", "m.*", *carried), "matches")
    hits = [first.select("rid", "longest", "spans", "items")] + [
        written(found(one).select(rid, "m.longest", "m.spans", "m.items"), "matches")
        for one in passes[1:]]
    more = hits[0].where("size(spans) > 0")
    for one in hits[1:]:
        more = more.union(one.where("size(spans) > 0"))
    summed = more.groupBy("rid").agg(
        F.max("longest").alias("longest"), F.collect_list("spans").alias("lists"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return (first.drop("longest", "spans", "items").join(
        summed.select("rid", "longest", _union_spans("lists").alias("spans"), "items"), "rid", "left")
        .select("doc_id", "n_words", F.coalesce("longest", F.lit(0)).alias("longest"),
                F.coalesce("spans", F.array().cast(SPANS)).alias("spans"),
                F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                *carried))


def span_words(spans: Column) -> Column:
    """Number of words in merged spans."""
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])


def _cut():
    def cut(text: str | None, spans):
        if text is None or not spans:
            return (text,)
        raw = text.encode()
        drop = iter(spans)
        span = next(drop)
        parts, kept = [], 0
        for n, word in enumerate(_WORD.finditer(raw)):
            if n == span["start"]:
                parts.append(raw[kept:word.start()])
            if n == span["stop"] - 1:
                kept = word.end()
                span = next(drop, None)
                if span is None:
                    break
        parts.append(raw[kept:])
        return (b"".join(parts).decode(),)

    return cut


def remove_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
                         text_col: str = "text", span_limit: int = SPAN_WORDS,
                         coverage: float = COVERAGE, **options) -> DataFrame:
    """``docs`` without what they share with the items, all columns as they were.

    Hit spans of ``span_limit`` words and more are cut out of the texts; a document of whose words
    more than ``coverage`` are hit goes. Null and empty texts stay as they are, in every copy.
    """
    found = match_items(docs, items, id_col, text_col, carry=True, **options)
    share = F.try_divide(span_words(F.col("spans")), F.col("n_words"))
    long_spans = F.filter("spans", lambda s: s["stop"] - s["start"] >= span_limit)
    kept = (found.where(F.coalesce(share, F.lit(0.0)) <= coverage)
            .select("row", long_spans.alias("cuts")))
    cut = row_udf("text string", _cut)(F.col(f"row.`{text_col}`"), F.col("cuts"))["text"]
    return kept.select("row", cut.alias("cut")).select(*[
        F.col("cut").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])
