"""Clustering by bit planes and vector codes by a GNAT against plain integer arithmetic."""

import hashlib
import math
import random

import numpy as np
import pytest

from newstide.llm import bitplane, gnat
from newstide.llm.vectors import LIMIT

ROWS = "vec_id long, embedding array<float>, label int, planes string, cluster int, v string, error int"


def table(spark, rows, parts=4):
    """Vectors with columns whose names the operators use themselves."""
    full = [(i, v, label, "x", 1, "y", 2) for i, v, label in rows]
    return spark.createDataFrame(full, ROWS).repartition(parts) if rows else \
        spark.createDataFrame([], ROWS)


def some_vectors(n=300, seed=1, spread=0.5):
    r = random.Random(seed)
    rows = [(k, [float(np.float32(r.gauss((k % 5) / 4, spread))) for _ in range(64)],
             r.choice([0, 1, None])) for k in range(n)]
    rows += [(n, rows[0][1], 1), (n + 1, rows[0][1], None), (7, rows[9][1], 0), (None, rows[3][1], 1)]
    return rows


def bad_vectors():
    whole = [0.5] * 64
    return [(9000, None, 1), (9001, [None] + whole[1:], 1), (9002, [math.nan] + whole[1:], 1),
            (9003, [math.inf] + whole[1:], 1), (9004, [-math.inf] + whole[1:], None)]


def scaled(v):
    return [math.floor(1024 * x) for x in v]


def away(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def means(groups, old):
    return [[sum(c) // len(vs) for c in zip(*vs)] if vs else o for vs, o in zip(groups, old)]


def brute_clusters(rows, k=8, rounds=10):
    kept = [(i, scaled(v)) for i, v, _ in rows]
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept
                   if i is not None)
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((away(v, c), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = [[] for _ in centroids]
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centroids = means(groups, centroids)
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = [sum(d for _, d, j in found if j == c) for c in range(k)]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), j, d, inertia[j], sum(inertia), digests[j]) for i, d, j in found)


def sorted_rows(df):
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


def test_planes_give_exact_products():
    r = np.random.default_rng(1)
    for low, high in ((0, 0), (-1, 0), (0, 1), (-8, 7), (-600, 900), (-LIMIT, LIMIT)):
        v = r.integers(low, high + 1, (50, 64))
        n = bitplane.plane_count(low, high)
        planes = bitplane.to_planes(v, n)
        assert (bitplane.from_planes(planes) == v).all()
        assert (bitplane.dots(planes, planes[3]) == v @ v[3]).all()
        assert (bitplane.dots(planes, planes) == (v * v).sum(axis=1)).all()


def test_clusters_equal_brute_force(spark):
    rows = some_vectors()
    odd = bad_vectors() + [(9005, [0.5] * 63, 1), (9006, [], 1), (9007, [0.1] * 65, 1)]
    found = bitplane.clusters_with_inertia(table(spark, rows + odd))
    assert sorted_rows(found) == brute_clusters(rows)


def test_clusters_with_ties_and_few_rows(spark):
    same = [(k, [0.25] * 64, 1) for k in range(40)] + [(50, [-0.25] * 64, 1)]
    assert sorted_rows(bitplane.clusters_with_inertia(table(spark, same))) == brute_clusters(same)
    few = some_vectors(20)[:3]
    assert sorted_rows(bitplane.clusters_with_inertia(table(spark, few))) == brute_clusters(few)
    assert bitplane.clusters_with_inertia(table(spark, [])).collect() == []
    assert bitplane.clusters_with_inertia(table(spark, bad_vectors())).collect() == []


def test_vectors_out_of_range_are_refused(spark):
    with pytest.raises(ValueError, match="exact distances"):
        bitplane.clusters_with_inertia(table(spark, [(1, [1e30] + [0.0] * 63, 1)]))
    with pytest.raises(ValueError, match="exact distances"):
        gnat.codes_with_errors(table(spark, [(1, [1e30] + [0.0] * 63, 1)]))


def brute_nearest(queries, entries):
    d = ((queries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


@pytest.mark.parametrize("arity,leaf", [(2, 1), (4, 3), (16, 32)])
@pytest.mark.parametrize("size,spread,width", [(1, 5, 3), (40, 1, 2), (256, 2, 3), (256, 400, 16),
                                               (200, 1 << 23, 16)])
def test_the_tree_finds_the_first_of_the_nearest(arity, leaf, size, spread, width):
    r = np.random.default_rng(size + width)
    entries = r.integers(-spread, spread + 1, (size, width))
    entries[size // 2] = entries[0]
    queries = np.concatenate([r.integers(-spread, spread + 1, (400, width)), entries])
    found, d = gnat.Gnat(entries, spread, arity, leaf).search(queries)
    expected, least = brute_nearest(queries, entries)
    assert (found == expected).all() and (d == least).all()


def test_the_tree_leaves_out_subtrees():
    """Entries in far apart clumps: most are never compared."""
    r = np.random.default_rng(2)
    middles = r.integers(-5000, 5000, (16, 16))
    entries = np.repeat(middles, 16, axis=0) + r.integers(-9, 10, (256, 16))
    queries = middles[r.integers(0, 16, 2000)] + r.integers(-9, 10, (2000, 16))
    tree = gnat.Gnat(entries, 6000, arity=16, leaf=16)
    found, d = tree.search(queries)
    expected, least = brute_nearest(queries, entries)
    assert (found == expected).all() and (d == least).all()
    assert tree.compared < 0.25 * len(queries) * len(entries)


def brute_codes(rows, rounds=4):
    kept = [(i, scaled(v), label) for i, v, label in rows]
    first = [v for _, v in sorted(((math.inf if i is None else i), v) for i, v, _ in kept)][:256]
    cut = [[(v[16 * p:16 * p + 16]) for _, v, _ in kept] for p in range(4)]
    books = [np.array([v[16 * p:16 * p + 16] for v in first]) for p in range(4)]
    for _ in range(rounds):
        for p in range(4):
            parts = np.array(cut[p])
            entry, _ = brute_nearest(parts, books[p])
            books[p] = np.array([parts[entry == e].sum(axis=0) // (entry == e).sum()
                                 if (entry == e).any() else books[p][e]
                                 for e in range(len(books[p]))])
    coded = [brute_nearest(np.array(cut[p]), books[p]) for p in range(4)]
    errors = sum(d for _, d in coded)
    codes = ["".join(f"{coded[p][0][k]:02x}" for p in range(4)) for k in range(len(kept))]
    labels = [label for *_, label in kept]
    of_label = {a: sum(int(e) for e, b in zip(errors, labels) if a == b) for a in set(labels)}
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b.tolist() for x in e)
                            .encode()).hexdigest()
    return sorted((str(i), code, int(e), of_label[label], digest)
                  for (i, _, label), code, e in zip(kept, codes, errors))


@pytest.mark.parametrize("n", [3, 120, 400])
def test_codes_equal_brute_force(spark, n):
    rows = some_vectors(n) if n > 9 else some_vectors(20)[:n]
    found = gnat.codes_with_errors(table(spark, rows + bad_vectors()))
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted_rows(found) == brute_codes(rows)


def test_codes_of_equal_and_of_no_vectors(spark):
    same = [(k, [0.25] * 64, k % 2) for k in range(300)]
    assert sorted_rows(gnat.codes_with_errors(table(spark, same))) == brute_codes(same)
    assert gnat.codes_with_errors(table(spark, [])).collect() == []
    assert gnat.codes_with_errors(table(spark, bad_vectors())).collect() == []


def test_a_vector_of_another_length_has_no_code(spark):
    rows = some_vectors(30)[:30]
    odd = [(500, [0.5] * 32, 1), (501, [], 9)]
    found = {r["vec_id"]: r for r in gnat.codes_with_errors(table(spark, rows + odd)).collect()}
    assert len(found) == 32
    assert [found[k]["code"] for k in (500, 501)] == [None, None]
    assert found[501]["label_error"] is None
    assert found[1]["code"] == {r[0]: r[1] for r in brute_codes(rows)}["1"]
