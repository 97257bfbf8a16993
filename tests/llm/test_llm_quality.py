"""Measures against brute force, votes and estimation, held-out quality."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from newstide.llm import quality

DOCS = "doc_id long, text string, w string, l int, n int, kept boolean, n_words string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, 2, True, "n") for i, t in rows], DOCS)


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i:i + 8])] > 1:
            hit.update(range(i, i + 8))
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(hit))


def texts():
    r = random.Random(6)
    made = [" ".join(r.choices("a bb é 🎉x # $d".split(), k=r.randint(0, 60))) for _ in range(150)]
    long_ = [str(k) for k in range(3000)]
    made += ["a b c d e f g h " * 2, "a b c d e f g h i a b c d e f g h", "x " * 7, "x " * 8, "x " * 9,
             " \t\n", "", None, "\x85 ", "one\n\ntwo\none\n \n \n", "l\r\nl\r\nl", "a\x1cb",
             " ".join(long_ + ["x"] + long_), "A" * 50_000, "w1 w2 w3 w4 w5 w6 w7 w8\n" * 400]
    return made


def test_measures_against_brute_force(spark):
    rows = list(enumerate(texts())) + [(None, "null id"), (3, "again"), (3, "again")]
    got = quality.measures(docs_of(spark, rows)).collect()
    expected = Counter((i, *brute(t)) for i, t in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
                   for r in got) == expected


def test_judged_rows(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in quality.judge_quality(docs_of(spark, rows)).collect()}
    for i, text in rows:
        n, _, _, _, repeats = brute(text)
        assert got[i].base_failed == (n < 20 or 100 * repeats > 30 * n)
        assert got[i].kept == (not got[i].base_failed and got[i].p_good >= 0.5)
    assert quality.judge_quality(docs_of(spark, [])).count() == 0


def test_no_python_in_the_plan(spark, sf_small, capsys):
    quality.judge_quality(spark.read.parquet(f"{sf_small}/documents.parquet")).explain()
    quality.measures(spark.read.parquet(f"{sf_small}/documents.parquet")).explain()
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)


def test_estimation_finds_the_accuracies(spark):
    """Votes drawn from known accuracies are explained by about these."""
    r = random.Random(1)
    truth = {"a": (0.95, 0.8), "b": (0.9, 0.6), "c": (0.98, 0.5), "d": (0.9, 0.9)}
    rows = []
    for _ in range(40_000):
        good = r.random() < 0.7
        rows.append(tuple((0 if r.random() < 0.2 else (1 if (r.random() < p[not good]) == good else -1))
                          for p in truth.values()))
    patterns = spark.createDataFrame([(*k, n) for k, n in Counter(rows).items()],
                                     ", ".join(f"{v} int" for v in truth) + ", n long").coalesce(1)
    model = quality.estimate(patterns, list(truth))
    assert model.prior == pytest.approx(0.7, abs=0.03)
    for name, (on_good, on_bad) in truth.items():
        assert model.on_good[name] == pytest.approx(on_good, abs=0.03)
        assert model.on_bad[name] == pytest.approx(on_bad, abs=0.03)


def test_nothing_to_estimate(spark):
    patterns = spark.createDataFrame([], "a int, n long")
    assert quality.estimate(patterns, ["a"]).on_good == {"a": quality.START_ON_GOOD}


def test_agrees_with_labels(spark):
    """Labels are used here only. Short texts fail by the base rules, whatever their label."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 0")
    found = quality.judge_quality(spark.read.parquet(f"{sf}/documents.parquet"))
    both = found.where("n_words >= 20").join(labels, "doc_id").groupBy("quality").agg(
        F.avg(F.col("kept").cast("int")).alias("kept"))
    shares = {r.quality: r.kept for r in both.collect()}
    assert shares[1] > 0.95 and shares[0] < 0.1
