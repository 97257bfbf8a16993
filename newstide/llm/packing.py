"""Best-fit packing of documents into training sequences of several permitted lengths.

Lengths are whole numbers, so all documents are described by how many pieces have each length. The
packing is made on that histogram, which has one row per length whatever the number of documents:
best fit decreasing, many equal bins at a time. Its result is a list of bin kinds ("so many bins
with these lengths"). The pieces of each length are then numbered and take the places of that
length in order. A piece needs the list and its own number only, so a length that a third of all
pieces share is spread like any other.

A piece that fits no open bin opens one. Its size is the one of least cost: the cost of the bin
less what its free space is worth, counting only space that pieces still to come can fill. In the
end every bin is cut down to the smallest permitted length that holds its contents.
"""

import bisect
from collections import Counter
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from newstide.llm.common import id_and_text
from newstide.operators.ordering import with_position

# Permitted lengths in words; each document is followed by one end mark.
CAPACITIES = (512, 1024, 2048, 4096, 8192)


def training_cost(length: int) -> float:
    """Cost of a sequence: a fixed part, one per place, and attention with the square."""
    return 16 + length + length * length / 65536


def pack_histogram(histogram: dict[int, int], capacities: Sequence[int] = CAPACITIES,
                   cost: Callable[[int], float] = training_cost) -> list[tuple[int, int, tuple[int, ...]]]:
    """Bin kinds (bins, capacity, lengths in order of placing) for so many pieces per length.

    Best fit decreasing: pieces in order of falling length, each into the open bin with the least
    space that holds it. ``open_`` keeps equal bins together, by their free space.
    """
    sizes = sorted(set(capacities))
    todo = sum(length * n for length, n in histogram.items())
    unit = min(cost(size) / size for size in sizes)
    free, open_, space = [], {}, 0

    def add(room: int, bins: int, kind: tuple[int, int]) -> None:
        nonlocal space
        if room not in open_:
            bisect.insort(free, room)
            open_[room] = []
        open_[room].append((bins, kind))
        space += room * bins

    # a kind is a chain of placements: (size, parent or -1, length, how often)
    chain: list[tuple[int, int, int, int]] = []
    closed: list[tuple[int, int]] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if length > sizes[-1] or length < 1:
            raise ValueError(f"a piece of length {length} fits no permitted length")
        while left:
            at = bisect.bisect_left(free, length)
            if at < len(free):
                room = free[at]
                bins, kind = open_[room].pop()
                if not open_[room]:
                    del open_[room], free[at]
                space -= room * bins
                size = chain[kind][0]
            else:
                # what later pieces may bring into new space, after the space that is open
                coming = max(todo - length - space, 0)
                size = min((s for s in sizes if s >= length),
                           key=lambda s: (cost(s) - unit * min(s - length, coming), s))
                per = max(size // length, 1)
                room, kind = size, -1
                bins = max(left // per, 1) if coming >= size - length else 1
            # fill each of these bins with as many pieces of this length as it holds
            each = min(room // length, left)
            used = min(bins, left // each)
            if used < bins and kind != -1:
                add(room, bins - used, kind)
            chain.append((size, kind, length, each))
            left -= used * each
            todo -= used * each * length
            rest = room - each * length
            if rest:
                add(rest, used, len(chain) - 1)
            else:
                closed.append((used, len(chain) - 1))
    closed += [entry for room in free for entry in open_[room]]
    kinds = []
    for bins, kind in closed:
        lengths: list[int] = []
        while kind != -1:
            _, kind, length, each = chain[kind]
            lengths[:0] = [length] * each
        total = sum(lengths)
        kinds.append((bins, sizes[bisect.bisect_left(sizes, total)], tuple(lengths)))
    return kinds


def _places(kinds: list[tuple[int, int, tuple[int, ...]]]) -> dict[int, dict[str, np.ndarray]]:
    """Per length the runs of places in order: first piece number, first bin, and where in a bin."""
    runs: dict[int, list[tuple[int, int, int, int, int]]] = {}
    filled: Counter[int] = Counter()
    first_bin = 0
    for bins, capacity, lengths in kinds:
        offset = 0
        for length, each in _stretches(lengths):
            runs.setdefault(length, []).append((filled[length], first_bin, each, offset, capacity))
            filled[length] += bins * each
            offset += each * length
        first_bin += bins
    names = ("start", "bin", "each", "offset", "capacity")
    return {length: dict(zip(names, np.array(rows, np.int64).T)) for length, rows in runs.items()}


def _stretches(lengths: Sequence[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for length in lengths:
        if out and out[-1][0] == length:
            out[-1][1] += 1
        else:
            out.append([length, 1])
    return [(length, each) for length, each in out]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           largest: int = CAPACITIES[-1]) -> DataFrame:
    """doc_id, piece, first_word, length: a document and its end mark, cut at the largest length."""
    words = F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"))
    return (id_and_text(docs, id_col, text_col).select("doc_id", (words + 1).alias("_n"))
            .selectExpr("doc_id", "_n", f"explode(sequence(0, (_n - 1) div {largest})) AS piece")
            .selectExpr("doc_id", "CAST(piece AS INT) AS piece",
                        f"CAST(piece * {largest} AS INT) AS first_word",
                        f"CAST(least({largest}, _n - piece * {largest}) AS INT) AS length"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         capacities: Sequence[int] = CAPACITIES,
         cost: Callable[[int], float] = training_cost) -> DataFrame:
    """One row per piece: doc_id, piece, first_word, length, bin_id, capacity, offset.

    A document longer than the largest capacity is cut into pieces of it and a rest, so no word is
    lost. The last word of a document is followed by one end mark, which is counted in its last
    piece; null and empty texts are one piece with the end mark alone. Pieces equal in length go to
    their places in order of id (nulls first) and piece; repeated rows are packed each. An empty
    table gives an empty result.
    """
    cut = pieces(docs, id_col, text_col, max(capacities))
    numbered = with_position(cut, ["length"], ["doc_id", "piece", "first_word"])
    # at most one row per length: bounded by the largest capacity
    histogram = {r["length"]: r["n"] for r in
                 numbered.groupBy("length").agg(F.count("*").alias("n")).toLocalIterator()}
    places = _places(pack_histogram(histogram, capacities, cost))

    @F.pandas_udf("bin_id long, capacity int, offset int")
    def place(length: pd.Series, position: pd.Series) -> pd.DataFrame:
        found = np.zeros((len(length), 3), np.int64)
        lengths, numbers = length.to_numpy(), position.to_numpy() - 1
        for one in np.unique(lengths):
            rows, runs = np.nonzero(lengths == one)[0], places[int(one)]
            run = np.searchsorted(runs["start"], numbers[rows], "right") - 1
            within = numbers[rows] - runs["start"][run]
            found[rows, 0] = runs["bin"][run] + within // runs["each"][run]
            found[rows, 1] = runs["capacity"][run]
            found[rows, 2] = runs["offset"][run] + within % runs["each"][run] * one
        return pd.DataFrame(found, columns=["bin_id", "capacity", "offset"])

    return (numbered.withColumn("_place", place("length", "position"))
            .select("doc_id", "piece", "first_word", "length", "_place.*"))
