"""Benchmark decontamination against a plain reading of windows."""

import random
import re

import pytest

from newstide.llm import decontaminate as d

DOCS = "doc_id long, text string, row string, items string, n_words int, m string, rid int"


def table(spark, rows, parts=4):
    """Documents with columns whose names the operator uses itself."""
    full = [(i, t, "x", "y", 1, "z", 3) for i, t in rows]
    return spark.createDataFrame(full, DOCS).repartition(parts) if rows else \
        spark.createDataFrame([], DOCS)


def stored(spark, rows, tmp_path):
    path = str(tmp_path / "docs")
    table(spark, rows).write.parquet(path)
    return spark.read.parquet(path)


def items_table(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows],
                                 "item_id long, text string, spans string")


def words_of(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items, window):
    """(n_words, hit words, item ids) by trying every window at every place."""
    words = words_of(text)
    hit, names = set(), set()
    for item, item_text in items:
        own = words_of(item_text)
        size = min(window, len(own))
        for k in range(len(own) - size + 1 if own else 0):
            for at in range(len(words) - size + 1):
                if words[at:at + size] == own[k:k + size]:
                    hit |= set(range(at, at + size))
                    names |= {str(item)} - {"None"}
    return len(words), hit, sorted(names)


def hits(spans):
    assert all(s["start"] < s["stop"] for s in spans)
    assert all(a["stop"] < b["start"] for a, b in zip(spans, spans[1:]))
    return {w for s in spans for w in range(s["start"], s["stop"])}


def some_items(r):
    alphabet = "Ab cd éf 12".split()
    found = [(k, " ".join(r.choice(alphabet) for _ in range(r.randint(1, 14)))) for k in range(12)]
    return found + [(20, None), (21, ""), (22, "--"), (None, "ab ab ab 12"), (3, found[3][1]),
                    (23, found[5][1])]


def some_docs(r, items):
    alphabet = "ab CD éf 12 zz".split()
    docs = [(k, r.choice([" ", "\n", "-", ". "]).join(
        r.choice(alphabet) for _ in range(r.randint(0, 60)))) for k in range(60)]
    return docs + [(100, None), (101, ""), (102, "?!"), (103, items[2][1]), (103, items[2][1]),
                   (None, "x " + items[1][1] + " y")]


@pytest.mark.parametrize("window", [1, 3, 4])
@pytest.mark.parametrize("block,at_once", [(10_000, 5), (20, 5), (20, 2)])
def test_hits_and_items_equal_a_plain_reading(spark, tmp_path, window, block, at_once):
    r = random.Random(window)
    items = some_items(r)
    docs = some_docs(r, items)
    found = d.match_items(stored(spark, docs, tmp_path), items_table(spark, items), window=window,
                          block=block, at_once=at_once, carry=True).collect()
    assert len(found) == len(docs)
    for row in found:
        n, hit, names = brute(row["row"]["text"], items, window)
        assert (row["n_words"], hits(row["spans"]), row["items"]) == (n, hit, names)


def test_the_longest_match_is_that_of_a_plain_reading():
    r = random.Random(4)
    for _ in range(200):
        letters = [b"a", b"b", b"c"][:r.choice([2, 3])]
        items = [(str(k), [r.choice(letters) for _ in range(r.randint(1, 12))]) for k in range(4)]
        words = [r.choice(letters) for _ in range(30)]
        automaton = d.Automaton(items, 1)
        *_, longest = automaton.find(automaton.ids_of(words))
        parts = {tuple(own[a:b]) for _, own in items for a in range(12) for b in range(a + 1, 13)}
        assert longest == max(size for size in range(13) for at in range(31 - size)
                              if not size or tuple(words[at:at + size]) in parts)


def test_pieces_of_a_long_item_lose_no_window(spark):
    r = random.Random(5)
    words = [f"w{r.randint(0, 50)}" for _ in range(300)]
    docs = [(k, " ".join(words[k:k + 12])) for k in range(288)]
    items = items_table(spark, [(1, " ".join(words))])
    assert d.build_automata(items, block=30, piece=25).count() > 5
    found = d.match_items(table(spark, docs), items, block=30, piece=25, at_once=1000).collect()
    assert all(row["items"] == ["1"] and len(hits(row["spans"])) == 12 for row in found)


def test_very_long_texts_are_read_to_the_end(spark):
    item = " ".join(f"frage{k}" for k in range(12))
    end = "wort " * 400_000 + item
    found = {row["doc_id"]: row for row in d.match_items(
        table(spark, [(1, end), (2, "x" * 3_000_000), (3, "frage0 " * 300_000)]),
        items_table(spark, [(7, item)])).collect()}
    assert hits(found[1]["spans"]) == set(range(400_000, 400_012)) and found[1]["items"] == ["7"]
    assert found[2]["n_words"] == 1 and not found[2]["spans"]
    assert found[3]["n_words"] == 300_000 and not found[3]["spans"]


def test_empty_tables(spark):
    items = items_table(spark, [(1, "a b c")])
    none = items_table(spark, [(1, "x")]).limit(0)
    assert d.match_items(table(spark, []), items).collect() == []
    found = d.match_items(table(spark, [(1, "a b c")]), none).collect()
    assert [(r["n_words"], r["spans"], r["items"]) for r in found] == [(3, [], [])]


def test_spans_are_cut_and_covered_documents_go(spark):
    item = " ".join(f"q{k}" for k in range(12))
    docs = [(1, "Vor der Frage, " + " und ".join(["viel"] * 30) + ": " + item + ". Danach."),
            (2, item + " x"), (3, "nichts"), (4, None), (5, ""),
            (6, "a " * 30 + " ".join(f"q{k}" for k in range(10)) + " b" * 30)]
    out = d.remove_contamination(table(spark, docs), items_table(spark, [(1, item)]),
                                 span_limit=11)
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")]
    kept = {row["doc_id"]: row for row in out.collect()}
    assert kept[1]["text"] == "Vor der Frage, " + " und ".join(["viel"] * 30) + ": . Danach."
    assert sorted(kept) == [1, 3, 4, 5, 6] and kept[4]["text"] is None
    assert kept[6]["text"] == docs[5][1]  # ten words are below the limit of eleven
    assert kept[3]["items"] == "y"


def test_clean_documents_stay_alone(spark, sf_small):
    """Items of the given table are found in documents that hold them and in no other."""
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    items = spark.read.parquet(f"{sf_small}/benchmark.parquet")
    plain = [(row["item_id"], row["text"]) for row in items.collect()]
    windows = {}
    for item, text in plain:
        own = words_of(text)
        for k in range(max(len(own) - 9, 0)):
            windows.setdefault(tuple(own[k:k + 10]), set()).add(str(item))
    for row in d.match_items(docs, items, carry=True).collect():
        words = words_of(row["row"]["text"])
        names = set().union(*[windows.get(tuple(words[k:k + 10]), set())
                              for k in range(max(len(words) - 9, 0))])
        assert set(row["items"]) == names
