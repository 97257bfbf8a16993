"""Hot groups stay whole and spread out; plans keep their shape."""

import datetime as dt

import pytest
from pyspark.errors.exceptions.captured import SparkRuntimeException
from pyspark.sql import functions as F

from newstide.catalog.queries import QUERIES
from newstide.operators import corpus, ordering, timeline as tl
from newstide.sources.layout import spread


@pytest.fixture(scope="module")
def skewed(spark):
    """6,000 articles; one (symbol, day) holds a third of them, all published at one instant."""
    n = 6000
    df = spark.range(n).selectExpr(
        f"CASE WHEN id < {n // 3} THEN 'hot' ELSE concat('s', id % 40) END AS symbol",
        f"CASE WHEN id < {n // 3} THEN DATE '2024-01-02' "
        "ELSE date_add(DATE '2024-01-01', CAST(id % 20 AS INT)) END AS date",
        "concat('l', lpad(CAST(pmod(hash(id), 1000000) AS STRING), 6, '0'), '-', id) AS link",
        "named_struct('href', concat('h', id % 7), 'title', 'x') AS source")
    return df.withColumn("published", F.col("date").cast("timestamp_ntz")).repartition(8).cache()


def by_python(rows, keys):
    groups = {}
    for r in rows:
        groups.setdefault(tuple(r[k] for k in keys), []).append((r.published, r.link))
    return {k: [link for _, link in sorted(v)] for k, v in groups.items()}


@pytest.mark.parametrize("keys", [["symbol"], ["symbol", "date"]])
def test_positions_are_exact(spark, skewed, keys):
    got = ordering.with_position(skewed.drop("source"), keys, ["published", "link"]).collect()
    expected = by_python(skewed.collect(), keys)
    assert len(got) == 6000
    for r in got:
        assert expected[tuple(r[k] for k in keys)][r.position - 1] == r.link


def test_hot_group_spans_sort_partitions(spark, skewed):
    hot = (ordering.publication_order(skewed).withColumn("p", F.spark_partition_id())
           .where("symbol = 'hot'"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert hot.select("p").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rows_without_key_have_no_position(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2)], "k STRING, v INT")
    assert [tuple(r) for r in ordering.with_position(df, ["k"], ["v"]).collect()] == [("a", 2, 1)]


def test_hot_day_is_one_row(spark, skewed):
    """As many timeline rows as price days, whatever the number of links; the links are all there."""
    prices = spark.createDataFrame(
        [(s, dt.date(2024, 1, d), 1.0, 2.0) for s in ("hot", "quiet") for d in (2, 3)],
        "symbol STRING, date DATE, open DOUBLE, close DOUBLE")
    rows = tl.build_timeline(prices, skewed).orderBy("symbol", "date").collect()
    assert [(r.symbol, r.date.day, r.n_links) for r in rows] == [
        ("hot", 2, 2000), ("hot", 3, 0), ("quiet", 2, 0), ("quiet", 3, 0)]
    links = tl.day_links(skewed).where("symbol = 'hot'").orderBy("position").collect()
    assert [r.position for r in links] == list(range(1, 2001))
    assert [r.link for r in links] == by_python(skewed.collect(), ["symbol", "date"])[
        ("hot", dt.date(2024, 1, 2))]


def test_copies_of_a_link_are_not_squared(spark, skewed):
    prices = skewed.select("symbol", "date").distinct()
    five = skewed.where("symbol = 's1'").limit(1).withColumns(
        {"title_sentiment": F.lit(1), "text_sentiment": F.lit(2)}).crossJoin(spark.range(5)).drop("id")
    assert tl.link_articles(prices, five).count() == 5


@pytest.mark.parametrize("n", [10, 100, 5000])
def test_sample_equals_smallest_draws(spark, skewed, n):
    got = corpus.sample_rank(skewed, n, seed=5).collect()
    drawn = skewed.withColumn("d", F.md5(F.concat_ws("|", F.lit("5"), "symbol", "link"))).collect()
    groups = {}
    for r in drawn:
        groups.setdefault(r.symbol, []).append((r.d, r.link))
    expected = {(s, link, i + 1) for s, v in groups.items()
                for i, (_, link) in enumerate(sorted(v)[:n])}
    assert {(r.symbol, r.link, r["rank"]) for r in got} == expected


def test_sample_depends_on_the_seed(spark, skewed):
    first, second = ({r.link for r in corpus.sample_articles(skewed, 10, seed).collect()}
                     for seed in (1, 2))
    assert first != second and len(first) == len(second) == 410


def test_copies_of_one_link_merge(spark, skewed):
    copies = skewed.withColumn("link", F.when(F.col("symbol") == "hot", F.lit("same"))
                               .otherwise(F.col("link")))
    assert tl.drop_duplicate_links(copies).count() == 4001


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_sweep_has_one_shuffle_by_symbol_and_no_python(spark, sf_small):
    text = plan(QUERIES["E4_window_sweep"](spark, sf_small))
    assert "EvalPython" not in text
    assert text.count("+- Window [") + text.count("Window [sum") >= 2
    by_symbol = [line for line in text.splitlines()
                 if "Exchange hashpartitioning(symbol" in line and "date" not in line]
    assert len(by_symbol) == 1


def test_reports_add_no_shuffle_to_the_scoring(spark, sf_small):
    def exchanges(name):
        return plan(QUERIES[name](spark, sf_small)).count("Exchange hashpartitioning(symbol")

    assert exchanges("D6_accuracies") == exchanges("E4_window_sweep") == exchanges("D8_covariance")


# Pages are read by a parser, and the hook is for models.
PYTHON = {"A8_broken_pages", "A8_page_failures", "A8_page_text", "D11_source_weight", "G2_concat_frames", "H14_or_empty", "J2_model_hook"}


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_python_workers_and_no_cross_joins(spark, sf_small, name):
    text = plan(QUERIES[name](spark, sf_small))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", *["EvalPython"] * (name not in PYTHON)):
        assert operator not in text


@pytest.mark.parametrize("name, columns", [
    ("D10_source_counts", "source:string"), ("D13_date_range", "ts:timestamp_ntz,user_id:bigint"),
    ("D1_links_per_day", None), ("F2_top_sources", "source:string"),
    ("D12_corpus_statistics", "text:string,source:string")])
def test_scans_read_what_they_need(spark, sf_small, name, columns):
    text = plan(QUERIES[name](spark, sf_small))
    if columns is None:
        assert "text:string" not in text
    else:
        assert f"ReadSchema: struct<{columns}>" in text


@pytest.mark.parametrize("n", [1, 10, 5000])
def test_sample_ranks_keys_only(spark, skewed, n):
    """The same plan for every n: two steps over keys, and whole rows for the winners alone."""
    text = plan(corpus.sample_rank(skewed.withColumn("text", F.lit("long").cast("string")), n))
    assert "text" not in text.split("InMemory")[0]
    assert text.count("Window [row_number") == 2


def test_survivor_of_copies_is_chosen_without_texts(spark, skewed):
    articles = skewed.withColumns({"text": F.concat("link", F.lit(" text")), "id": F.col("link"),
                                   "info": F.create_map(F.lit("a"), F.lit("b"))})
    copies = articles.union(articles.where("symbol = 'hot'"))
    kept = tl.drop_duplicate_links(copies)
    assert kept.columns == articles.columns and kept.count() == 6000


def test_engine_policies_for_duplicates(spark, skewed):
    copies = skewed.union(skewed.where("symbol = 's1'"))
    assert tl.unique_links(copies, "keep").count() == copies.count()
    assert tl.unique_links(copies, "drop").count() == 6000
    lazy = tl.unique_links(copies)
    with pytest.raises(SparkRuntimeException, match="duplicate key"):
        lazy.count()
    assert tl.unique_links(skewed).count() == 6000
    with pytest.raises(ValueError):
        tl.unique_links(copies, "guess")


def test_articles_are_cut_to_the_symbols_below_the_daily_sums(spark, sf_small):
    text = plan(QUERIES["K4_analyze_accuracies"](spark, sf_small))
    sums = next(i for i, line in enumerate(text.splitlines()) if "n_links" not in line
                and "partial_count(1)" in line and "title_sentiment" in line)
    assert any("LeftSemi" in line for line in text.splitlines()[sums:])


def test_spread_moves_when_it_is_called(spark):
    assert spread(spark.range(10, numPartitions=1), 16).rdd.getNumPartitions() == 16


def test_scores_without_copies_move_no_text(spark, sf_small):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(QUERIES["D14_scores_drop_duplicates"](spark, sf_small))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "to_json" not in text and "sha2" not in text
    assert text.count("Exchange hashpartitioning(symbol") <= 9


def test_a_sample_of_unique_links_looks_for_no_copies(spark, sf_small):
    text = plan(QUERIES["K10_sample_articles"](spark, sf_small))
    assert "to_json" not in text and text.count("Window [row_number") == 2
