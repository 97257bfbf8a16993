"""Packing and sharding: whole, exact, and good."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from newstide.llm import packing, sharding

DOCS = "doc_id long, text string, lang string, source string, length string, piece int, position int, shard int, slot int, _id int"
SIZES = (8, 16, 32, 64)


def docs_of(spark, rows):
    return spark.createDataFrame(
        [(i, t, r.choice(["en", "de", None]), f"src{r.randrange(20)}", "l", 1, 2, 3, 4, 5)
         for r in [random.Random(1)] for i, t in rows], DOCS)


def mixed_rows():
    r = random.Random(4)
    rows = [(i, " ".join("w" * r.randint(1, 5) for _ in range(r.choice([3, r.randint(0, 90)]))))
            for i in range(700)]
    return rows + [(None, None), (None, ""), (7, "same words"), (7, "same words"), (5000, "w " * 20_000)]


@pytest.mark.parametrize("seed", range(60))
def test_histogram_is_packed_whole(seed):
    r = random.Random(seed)
    pieces = Counter(r.choice([r.randint(1, 64), r.randint(1, 20), 64, 3])
                     for _ in range(r.randint(1, 500)))
    kinds = packing.pack_histogram(pieces, SIZES)
    placed = Counter()
    for bins, capacity, lengths in kinds:
        # the smallest permitted length that holds the contents
        assert capacity == min(s for s in SIZES if s >= sum(lengths))
        for length in lengths:
            placed[length] += bins
    assert placed == pieces


def best_cost(pieces, sizes, cost):
    """Least cost over all partitions of a few pieces."""
    best = float("inf")

    def place(left, bins):
        nonlocal best
        if not left:
            best = min(best, sum(cost(min(s for s in sizes if s >= b)) for b in bins))
            return
        for k in range(len(bins)):
            if bins[k] + left[0] <= sizes[-1]:
                place(left[1:], bins[:k] + [bins[k] + left[0]] + bins[k + 1:])
        place(left[1:], bins + [left[0]])

    place(sorted(pieces, reverse=True), [])
    return best


def test_cost_is_near_the_optimum_of_small_cases():
    cost = lambda s: 2 + s + s * s / 256
    ours = optimum = 0.0
    for seed in range(60):
        r = random.Random(seed)
        pieces = [r.randint(1, 40) for _ in range(7)]
        kinds = packing.pack_histogram(Counter(pieces), SIZES, cost)
        ours += sum(n * cost(c) for n, c, _ in kinds)
        optimum += best_cost(pieces, SIZES, cost)
    assert ours <= 1.15 * optimum


def test_several_sizes_beat_any_one():
    r = random.Random(3)
    pieces = Counter(min(8192, int(r.lognormvariate(5.5, 1.3)) + 1) for _ in range(50_000))
    cost = packing.training_cost

    def total(kinds):
        return sum(n * cost(c) for n, c, _ in kinds)

    joint = packing.pack_histogram(pieces)
    assert total(joint) < total(packing.pack_histogram(pieces, packing.CAPACITIES[-1:]))
    tokens = sum(length * n for length, n in pieces.items())
    assert tokens / sum(n * c for n, c, _ in joint) > 0.99


def test_a_piece_beyond_every_size_is_an_error():
    with pytest.raises(ValueError):
        packing.pack_histogram({65: 1}, SIZES)


def test_pack_places_every_word_once(spark):
    rows = mixed_rows()
    got = packing.pack(docs_of(spark, rows), capacities=SIZES).collect()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    for i, group in itertools.groupby(sorted(rows, key=lambda r: r[0] or -1), key=lambda r: r[0]):
        texts = [t for _, t in group]
        assert sum(r.length for r in by_doc[i]) == sum(len((t or "").split()) + 1 for t in texts)
    long_ = sorted((r.piece, r.first_word, r.length) for r in by_doc[5000])
    assert long_ == [(k, 64 * k, min(64, 20_001 - 64 * k)) for k in range(313)]
    bins = defaultdict(list)
    for r in got:
        bins[r.bin_id].append(r)
    for members in bins.values():
        members.sort(key=lambda r: r.offset)
        assert len({r.capacity for r in members}) == 1
        # no overlap and no gap
        ends = list(itertools.accumulate(r.length for r in members))
        assert [r.offset for r in members] == [0, *ends[:-1]]
        assert members[0].capacity == min(s for s in SIZES if s >= ends[-1])
    assert sorted(bins) == list(range(len(bins)))
    assert packing.pack(docs_of(spark, []), capacities=SIZES).count() == 0


@pytest.mark.parametrize("dimensions, bits", [(2, 3), (3, 2), (4, 2), (1, 4)])
def test_curve_visits_every_cell_by_single_steps(dimensions, bits):
    points = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)))
    index = sharding.hilbert_index(points, bits)
    assert sorted(index) == list(range(len(points)))
    walk = points[np.argsort(index)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_shards_law_slots_and_checksums(spark):
    rows = mixed_rows()
    got = sharding.hilbert_shards(docs_of(spark, rows)).collect()
    key = lambda i, t: (-1 if i is None else i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert Counter((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        key(i, t) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r)
    assert sorted(slots) == list(range(16))
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1
    last = -1
    for shard in range(16):
        members = sorted(slots[shard], key=lambda r: r.slot)
        assert [r.slot for r in members] == list(range(len(members)))
        # a shard is a run of the curve
        curve = [r.curve for r in members]
        assert curve == sorted(curve) and curve[0] >= last
        last = curve[-1]


@pytest.mark.parametrize("n", [0, 1, 5, 16, 17])
def test_few_rows(spark, n):
    got = sharding.hilbert_shards(docs_of(spark, [(i, "same") for i in range(n)])).collect()
    counts = Counter(r.shard for r in got)
    assert len(got) == n and all(c <= -(-n // 16) for c in counts.values())


def test_hot_source_prunes_on_the_other_dimensions(spark, tmp_path):
    """Half of the rows share language and source; files still differ in length."""
    r = random.Random(2)
    rows = [(i, "en" if i % 2 else r.choice(["de", "fr"]), "hot" if i % 2 else f"s{r.randrange(9)}",
             "w" * r.randint(1, 3000)) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    sharding.write_shards(docs, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 4000 and back.select("doc_id").distinct().count() == 4000
    spans = back.groupBy("shard").agg(F.min("lang"), F.max("lang"), F.min(F.length("text")).alias("lo"),
                                      F.max(F.length("text")).alias("hi")).collect()
    assert len(spans) == 16
    touched = sum(s["lo"] <= 300 and s["hi"] >= 200 for s in spans)
    assert touched <= 9
    assert sum(s["min(lang)"] <= "fr" <= s["max(lang)"] for s in spans) <= 9


@pytest.mark.parametrize("parts", [2, 4, 16])
def test_quantiles_of_whole_texts(spark, parts):
    r = random.Random(parts)
    values = ["", "é", "hot"] + [f"https://www.site{k}.com/" for k in range(40)]
    rows = [r.choice(values) for _ in range(600)] + ["hot"] * 300
    frame = spark.createDataFrame([(v,) for v in [*rows, None, None]], "v string").repartition(7)
    ordered = sorted(rows, key=str.encode)
    expected = [ordered[-(-len(rows) * k // parts) - 1] for k in range(1, parts)]
    assert sharding.text_quantiles(frame, "v", parts) == expected
    assert sharding.text_quantiles(frame.where("v IS NULL"), "v", parts) == []


def test_sources_with_a_common_beginning_prune(spark):
    """Every source begins with the same twelve bytes; a filter on one still skips most shards."""
    r = random.Random(1)
    rows = [(i, "x" * r.randint(1, 4000), f"https://www.{r.choice('abcdefgh')}.org/") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = sharding.hilbert_shards(docs).join(docs, "doc_id").groupBy("shard").agg(
        F.min("source").alias("lo"), F.max("source").alias("hi")).collect()
    assert len(found) == 16
    touched = [sum(s.lo <= f"https://www.{c}.org/" <= s.hi for s in found) for c in "abcdefgh"]
    assert max(touched) <= 8 and sum(touched) <= 16 * 8 // 2
