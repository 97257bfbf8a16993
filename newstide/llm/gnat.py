"""Vector codes by product quantisation, the nearest entry found in a GNAT.

A geometric near-neighbour access tree holds the entries of a codebook. Each node has split points;
every other entry of the node belongs to the nearest of them. For each split point the node keeps
the least and greatest distance to the entries of every child. A query knows its distance to a split
point, so by the triangle inequality a child whose range lies farther from it than the best entry so
far holds nothing nearer and nothing equally near: it is left out with all its subtrees. Ranges and
query distances are square roots of exact integers; a child is left out only by more than the error
these can have. Distances of the entries that are left are integers, and so are the comparisons that
decide, ties included.

Queries go through the tree in blocks: a node is visited by all queries that still need it.
Codebooks learn from sums per entry that tasks add up, so a round shuffles one row per entry and
task, and the driver sees entries only.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newstide.llm.vectors import extent, finite, scaled
from newstide.sources.layout import written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
# Split points of a node, and how many entries are kept without a node of their own.
ARITY, LEAF = 16, 32
# Queries that are in memory at once.
ROWS = 4096
# Relative error that is allowed for square roots and their differences; theirs is near 2^-52.
SLACK = 2.0 ** -48
# Entry numbers are below this; a distance times this leaves room for one.
MARK = 256


def number_type(bound: int, width: int) -> type:
    """Numbers in which squared distances with an entry number below them are exact: floating point
    while all sums stay below 2^53, else 64-bit integers."""
    most = 4 * max(bound, 1) ** 2 * max(width, 1) * MARK
    if most >= 1 << 63:
        raise ValueError(f"components up to {bound} in parts of {width}: 64 bits are too few")
    return np.float64 if most < 1 << 53 else np.int64


def squares(queries: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances (entries, queries) of two tables of rows."""
    return ((entries * entries).sum(axis=1)[:, None] + (queries * queries).sum(axis=1)
            - 2 * (entries @ queries.T))


@dataclass
class _Leaf:
    """Some entries, as what makes keys of them: key = MARK * (distance - norm of the query) + number.
    The smallest key is the nearest entry, of equally near ones the first."""

    factors: np.ndarray
    offsets: np.ndarray


@dataclass
class _Node:
    """Split points with a child each (None: empty), and the ranges [split, child] of distances."""

    points: _Leaf
    children: list["_Node | _Leaf | None"]
    low: np.ndarray
    high: np.ndarray


@dataclass
class _Search:
    """A block of queries, one per column, their norms, and the best key of each so far."""

    queries: np.ndarray
    norms: np.ndarray
    best: np.ndarray

    def distance(self, keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Distances, as square roots, of what the keys stand for."""
        # halved as often as MARK says, so exact but for the last rounding
        return np.sqrt(np.floor(keys * (1 / MARK)) + self.norms[rows])


class Gnat:
    """The nearest of up to 256 ``entries`` (integers) for many queries; of equals the first.

    ``bound`` is the greatest absolute component of entries and queries.
    """

    def __init__(self, entries: np.ndarray, bound: int, arity: int = ARITY, leaf: int = LEAF):
        self.kind = number_type(bound, entries.shape[1])
        self.entries, self.arity, self.leaf = entries.astype(self.kind), arity, leaf
        self.compared = 0  # distances computed, for tests of the pruning
        self.root = self._build(np.arange(len(entries)))

    def _group(self, numbers: np.ndarray) -> _Leaf:
        some = self.entries[numbers]
        norms = (some * some).sum(axis=1)
        return _Leaf(-2 * MARK * some, (MARK * norms + numbers).astype(self.kind)[:, None])

    def _split_points(self, members: np.ndarray) -> np.ndarray:
        """Points far from each other: each next one is the farthest from those before."""
        places = [0]
        far = squares(self.entries[members], self.entries[members[:1]])[0]
        while len(places) < min(self.arity, len(members)):
            far[places] = -1
            places.append(int(far.argmax()))
            last = self.entries[members[places[-1:]]]
            far = np.minimum(far, squares(self.entries[members], last)[0])
        return np.sort(np.array(places))

    def _build(self, members: np.ndarray) -> "_Node | _Leaf | None":
        if len(members) <= self.leaf:
            return self._group(members) if len(members) else None
        places = self._split_points(members)
        points = members[places]
        squared = squares(self.entries[members], self.entries[points])
        home = squared.argmin(axis=0)
        home[places] = -1
        away = np.sqrt(squared.astype(np.float64))
        children, low, high = [], np.zeros((len(points),) * 2), np.zeros((len(points),) * 2)
        for child in range(len(points)):
            inside = home == child
            children.append(self._build(members[inside]))
            if inside.any():
                low[:, child] = away[:, inside].min(axis=1)
                high[:, child] = away[:, inside].max(axis=1)
        return _Node(self._group(points), children, low, high)

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest entry per query."""
        q = queries.T.astype(self.kind, order="C")
        most = np.finfo(np.float64).max if self.kind is np.float64 else np.iinfo(np.int64).max
        block = _Search(q, (q * q).sum(axis=0), np.full(len(queries), most, self.kind))
        if not len(queries) or self.root is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._visit(self.root, block, np.arange(len(queries)))
        return ((block.best % MARK).astype(np.int64),
                (block.best // MARK + block.norms).astype(np.int64))

    def _compare(self, group: _Leaf, block: _Search, rows: np.ndarray) -> np.ndarray:
        """Keys (entries, queries) of a group of entries; the best of them are noted."""
        keys = group.factors @ block.queries.take(rows, axis=1)
        keys += group.offsets
        self.compared += keys.size
        block.best[rows] = np.minimum(block.best[rows], keys.min(axis=0))
        return keys

    def _visit(self, node, block: _Search, rows: np.ndarray) -> None:
        if isinstance(node, _Leaf):
            self._compare(node, block, rows)
            return
        keys = self._compare(node.points, block, rows)
        first, away = keys.argmin(axis=0), block.distance(keys, rows)
        # the child of the nearest split point first: what it holds bounds the others
        for child, below in enumerate(node.children):
            if below is not None and len(own := rows[first == child]):
                self._visit(below, block, own)
        for child, below in enumerate(node.children):
            if below is not None:
                near = self._in_reach(node, child, away, block, rows) & (first != child)
                if near.any():
                    self._visit(below, block, rows[near])

    def _in_reach(self, node: _Node, child: int, away: np.ndarray, block: _Search,
                  rows: np.ndarray) -> np.ndarray:
        """Whether a child may hold an entry as near as the best: no split point rules it out."""
        low, high = node.low[:, child, None], node.high[:, child, None]
        lack = np.maximum((low - away).max(axis=0), (away - high).max(axis=0))
        reach = block.distance(block.best[rows], rows)
        # away, high and reach bound all numbers that were rounded on the way
        return lack <= reach + SLACK * (reach + 2 * away.max(axis=0) + 2 * high.max())


def _blocks(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    for start in range(0, len(column), ROWS):
        flat = column.slice(start, ROWS).flatten().to_numpy(zero_copy_only=False)
        yield flat.reshape(-1, width).astype(np.int64)


def _parts(block: np.ndarray, n: int) -> list[np.ndarray]:
    return np.split(block, n, axis=1)


def _sums(books: list[np.ndarray], width: int, bound: int):
    """Per task one row per used entry: number of parts and sums of their components."""
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()),
                        ("sums", pa.list_(pa.int64()))])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(book, bound) for book in books]
        totals = [np.zeros_like(book) for book in books]
        counts = [np.zeros(len(book), np.int64) for book in books]
        for batch in batches:
            for block in _blocks(batch.column(0), width):
                for tree, total, count, part in zip(trees, totals, counts,
                                                    _parts(block, len(books))):
                    entry, _ = tree.search(part)
                    np.add.at(total, entry, part)
                    count += np.bincount(entry, minlength=len(count))
        for number, (total, count) in enumerate(zip(totals, counts)):
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), number), pa.int32()), pa.array(used, pa.int32()),
                 pa.array(count[used], pa.int64()),
                 pa.array(total[used].tolist(), pa.list_(pa.int64()))], schema=schema)

    return sums


def moved(vectors: DataFrame, books: list[np.ndarray], width: int,
          bound: int) -> list[np.ndarray]:
    """Codebooks after one round: floor of the mean of an entry's parts; unused entries stay."""
    size = width // len(books)
    parts = vectors.select("v").mapInArrow(
        _sums(books, width, bound), "part int, entry int, n bigint, sums array<bigint>")
    found = parts.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[k]) for k in range(size)]).alias("total"))
    out = [book.copy() for book in books]
    for row in found.collect():  # a row per entry
        out[row["part"]][row["entry"]] = [total // row["n"] for total in row["total"]]
    return out


def _encode(books: list[np.ndarray], width: int, bound: int):
    kind = [pa.field("code", pa.string()), pa.field("error", pa.int64())]

    @F.arrow_udf("code string, error bigint")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trees = [Gnat(book, bound) for book in books]
        for vectors in batches:
            codes: list[str] = []
            errors = [np.zeros(0, np.int64)]
            for block in _blocks(vectors, width):
                found = [tree.search(part) for tree, part in zip(trees, _parts(block, len(trees)))]
                digits = np.stack([entry for entry, _ in found], axis=1).astype(np.uint8)
                codes += [row.tobytes().hex() for row in digits]
                errors.append(sum(error for _, error in found))
            yield pa.StructArray.from_arrays(
                [pa.array(codes, pa.string()), pa.array(np.concatenate(errors), pa.int64())],
                fields=kind)

    return encode


def compress_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                     carry: tuple[str, ...] = (), parts: int = PARTS, entries: int = ENTRIES,
                     rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, code, error) of every kept vector with the ``carry`` columns, and the codebooks.

    Kept are vectors that are not null and have no null, NaN or infinite component; component x
    becomes floor(scale * x). The smallest ``entries`` ids (256 at most) give the first entries
    (equal ids: the smaller vector first; null ids last); with fewer rows there are fewer entries.
    Vectors have as many components as that of the smallest id, a multiple of ``parts``; a row of
    another length is kept without code and error. An empty table gives no rows. Repeated rows count
    each. Rounds end early once nothing moves. Scaled components have to be within 2^27 of 0, else
    a ``ValueError`` says so.
    """
    if not 0 < entries <= 256:
        raise ValueError(f"two hex digits name 256 entries, not {entries}")
    vector = embeddings[vector_col]
    carried = [embeddings[c].alias(f"_{c}") for c in carry]
    kept = written(embeddings.where(F.coalesce(finite(vector), F.lit(False)))
                   .select(embeddings[id_col].alias("vec_id"), *carried,
                           scaled(vector, scale).alias("v")), "vectors")
    low, high = extent(kept, "v")
    bound = max(-low, high)
    leading = kept.where("size(v) > 0").orderBy(F.asc_nulls_last("vec_id"), "v")
    some = leading.select(F.size("v").alias("width")).first()
    width = some["width"] if some else 0
    if width % parts:
        raise ValueError(f"vectors of {width} components cannot be cut into {parts} equal parts")
    given = [F.col(f"_{c}").alias(c) for c in carry]
    fits = F.size("v") == width
    if not width:
        return kept.select("vec_id", F.lit(None).cast("string").alias("code"),
                           F.lit(None).cast("bigint").alias("error"), *given), []
    first = np.array([row["v"] for row in leading.where(fits).limit(entries).collect()], np.int64)
    books = _parts(first, parts)
    usable = kept.where(fits)
    for _ in range(rounds):
        before, books = books, moved(usable, books, width, bound)
        if all(np.array_equal(a, b) for a, b in zip(before, books)):
            break
    coded = (usable.withColumn("c", _encode(books, width, bound)("v"))
             .select("vec_id", "c.code", "c.error", *given))
    other = kept.where(~fits).select("vec_id", F.lit(None).cast("string").alias("code"),
                                     F.lit(None).cast("bigint").alias("error"), *given)
    return coded.union(other), books


def codebooks_sha256(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, comma-joined."""
    numbers = ",".join(str(x) for book in books for entry in book.tolist() for x in entry)
    return hashlib.sha256(numbers.encode()).hexdigest()


def codes_with_errors(embeddings: DataFrame, label_col: str = "label", **options) -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error, codebooks_sha256.

    Errors are summed per label, rows without one together; the sums combine map-side and are
    joined back by plain exchanges, which adaptive execution splits where a label is common.
    """
    found, books = compress_vectors(embeddings, carry=(label_col,), **options)
    found = written(found.withColumnRenamed(label_col, "label"), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)")).cast("bigint")
    sums = found.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "of")
    return (found.join(sums, found["label"].eqNullSafe(sums["of"]), "left")
            .select("vec_id", "code", "error", "label_error",
                    F.lit(codebooks_sha256(books)).alias("codebooks_sha256")))
